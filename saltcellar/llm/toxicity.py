"""Toxicity: a factorization machine over hashed terms of whole documents."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltcellar.llm.shared import key_hash, small_batches, stored, text_of

SAMPLE_ROWS = 4000  # labelled rows that the fit sees
FOLDS, HELD_OUT_FOLD = 4, 2
THRESHOLD = 0.3
HASH_BITS = 22
PREFIXES = (5, 6, 7)  # leading characters of longer words are terms as well
LEAST_ROWS, FREQUENT = 3, 0.02  # a bucket counts from so many sample rows on, and is frequent from this share on
CLEAR, FULL, FLOOR = 1.0, 8.0, 0.1
MOST_BUCKETS = 1 << 17
FACTORS, EPOCHS, BATCH, RATE, DECAY = 4, 12, 64, 0.1, 1e-4
CACHED_WORDS = 200_000
GRID = float(1 << 20)
WORD = re.compile(r"[^\W_]+")


def _bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "replace")) & ((1 << HASH_BITS) - 1)


def word_buckets(word: str) -> tuple[int, ...]:
    """Buckets of a word and of its prefixes."""
    return (_bucket(word), *(_bucket(word[:n] + "*") for n in PREFIXES if len(word) > n))


def text_buckets(text: str) -> list[int]:
    """The distinct buckets of a whole text in order."""
    return sorted({b for word in set(WORD.findall(text.lower())) for b in word_buckets(word)})


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


@dataclass
class Machine:
    """offset + sum of w x + sum over pairs of <v, v'> x x'. `buckets` in order; column 0 of `weights` is w, the others v."""

    buckets: np.ndarray
    values: np.ndarray
    weights: np.ndarray
    offset: float

    def scores(self, texts: list[str]) -> np.ndarray:
        place = {int(b): i for i, b in enumerate(self.buckets)}
        known: dict[str, tuple[int, ...]] = {}
        rows = []
        for text in texts:
            found: set[int] = set()
            for word in set(WORD.findall(text.lower())):
                columns = known.get(word)
                if columns is None:
                    if len(known) >= CACHED_WORDS:
                        known.clear()
                    columns = known[word] = tuple(place[b] for b in word_buckets(word) if b in place)
                found.update(columns)
            rows.append(np.array(sorted(found), dtype=np.int64))
        return sigmoid(margins(self.weights, self.offset, self.values, rows)[0])


def margins(weights: np.ndarray, offset: float, values: np.ndarray, rows: list[np.ndarray]):
    """Margin of each row of columns, by sums of squares instead of pairs; and what the gradients need."""
    columns = np.concatenate([np.empty(0, np.int64), *rows])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    x = values[columns]
    parts = weights[columns] * x[:, None]
    sums = np.stack([np.bincount(owner, parts[:, f], len(rows)) for f in range(weights.shape[1])], axis=1)
    squares = np.bincount(owner, (parts[:, 1:] ** 2).sum(axis=1), len(rows))
    return offset + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - squares), (columns, owner, x, parts, sums)


def gradients(weights: np.ndarray, offset: float, values: np.ndarray, rows: list[np.ndarray], labels: np.ndarray):
    """Of the summed log loss: (columns seen, their gradients, the offset's)."""
    margin, (columns, owner, x, parts, sums) = margins(weights, offset, values, rows)
    error = sigmoid(margin) - labels
    flow = (error[owner] * x)[:, None] * np.concatenate([np.ones((len(x), 1)), sums[owner, 1:] - parts[:, 1:]], axis=1)
    seen, at = np.unique(columns, return_inverse=True)
    grad = np.stack([np.bincount(at, flow[:, f], len(seen)) for f in range(weights.shape[1])], axis=1)
    return seen, grad.astype(np.float64), float(error.sum())


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, buckets: np.ndarray, values: np.ndarray, seed: int = 5) -> Machine:
    """AdaGrad on the log loss over rows of columns. One class only: a constant score; no row: 0.5."""
    random = np.random.default_rng(seed)
    share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    offset = float(np.log(share / (1 - share)))
    weights = np.concatenate([np.zeros((len(buckets), 1)), random.normal(0, 0.02, (len(buckets), FACTORS))], axis=1)
    if len(set(labels.tolist())) < 2:
        return Machine(buckets, values, np.zeros_like(weights), offset)
    held, held_offset = np.full(weights.shape, 1e-2), 1e-2
    for _ in range(EPOCHS):
        order = random.permutation(len(rows))
        for low in range(0, len(order), BATCH):
            chosen = order[low : low + BATCH]
            seen, grad, to_offset = gradients(weights, offset, values, [rows[i] for i in chosen], labels[chosen])
            grad += DECAY * weights[seen]
            held[seen] += grad * grad
            held_offset += to_offset**2
            # On a grid far above rounding errors, so that machines that add in another order agree.
            weights[seen] = np.round((weights[seen] - RATE * grad / np.sqrt(held[seen])) * GRID) / GRID
            offset = round((offset - RATE * to_offset / held_offset**0.5) * GRID) / GRID
    return Machine(buckets, values, weights, offset)


def held_out(key: Column) -> Column:
    """Fold of a row: by the CRC of its key written as text; never used in a fit."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS) == HELD_OUT_FOLD


def sample_rows(documents: DataFrame, labels: DataFrame, key: str, label: str, rows: int) -> DataFrame:
    """(row, mark, buckets) of at most `rows` labelled rows outside the held-out fold, with the smallest hashes of key and text.

    Repeated rows count once; null keys and labels are left out; a key with several labels has the highest.
    """
    marks = labels.select(F.col(key).alias("_key"), F.col(label).alias("mark")).filter("_key IS NOT NULL AND mark IS NOT NULL")
    marks = marks.groupBy("_key").agg((F.max("mark") > 0).cast("int").alias("mark")).filter(~held_out(F.col("_key")))
    hashed = documents.select(F.col(key).alias("_key"), F.xxhash64(F.col(key), text_of("text")).alias("row")).filter("_key IS NOT NULL")
    chosen = hashed.join(marks, "_key").groupBy("_key", "row").agg(F.first("mark").alias("mark"))
    chosen = chosen.orderBy("row", key_hash(F.col("_key")), "_key").limit(rows)

    @F.pandas_udf("array<int>")
    def buckets(texts: pd.Series) -> pd.Series:
        return texts.map(text_buckets)

    texts = documents.select(F.col(key).alias("_key"), F.xxhash64(F.col(key), text_of("text")).alias("row"), text_of("text").alias("text"))
    found = texts.join(F.broadcast(chosen), ["_key", "row"]).dropDuplicates(["_key", "row"])  # at most `rows` rows are sent
    return stored(found.select("row", "mark", buckets("text").alias("buckets")), "toxic-sample")


def bucket_values(sample: DataFrame) -> DataFrame:
    """(bucket, value): how strongly a bucket speaks for or against label 1 in the sample, as the size of its input.

    The value is the squared z score of its label counts, full from `FULL` on; frequent buckets keep a floor, as they may act in
    pairs only. Others without a clear association are left out; the `MOST_BUCKETS` clearest stay.
    """
    n, marked = (float(v or 0) for v in sample.agg(F.count("*"), F.sum("mark")).first())
    share = min(max(marked / n, 1 / (n + 1)), n / (n + 1)) if n else 0.5
    counts = sample.select("mark", F.explode("buckets").alias("bucket")).groupBy("bucket")
    counts = counts.agg(F.count("*").alias("rows"), F.sum("mark").alias("marked")).filter(F.col("rows") >= LEAST_ROWS)
    spread = F.sqrt(F.col("rows") * share * (1 - share) * (1 - F.col("rows") / (n + 1)))
    clear = counts.withColumn("z", F.abs(F.col("marked") - F.col("rows") * share) / spread)
    frequent = F.col("rows") >= FREQUENT * n
    value = F.greatest(F.least(F.col("z") / FULL, F.lit(1.0)) ** 2, F.when(frequent, FLOOR).otherwise(0.0))
    kept = clear.filter(frequent | (F.col("z") >= CLEAR)).select("bucket", value.alias("value"))
    return kept.orderBy(F.col("value").desc(), "bucket").limit(MOST_BUCKETS)


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Machine:
    """A machine from at most `rows` labelled rows. Tasks cut and hash the texts; the driver gets at most `MOST_BUCKETS` buckets
    and the sample's rows of bucket numbers."""
    sample = sample_rows(documents, labels, key, label, rows)
    values = stored(bucket_values(sample), "toxic-buckets")
    each = sample.select("row", F.explode("buckets").alias("bucket")).join(F.broadcast(values.select("bucket")), "bucket")
    lists = each.groupBy("row").agg(F.collect_list("bucket").alias("found"))
    got = sample.select("row", "mark").join(lists, "row", "left").orderBy("row").toPandas()
    known = values.orderBy("bucket").toPandas()
    buckets = known["bucket"].to_numpy(dtype=np.int64)
    columns = [np.searchsorted(buckets, np.sort(np.array([] if f is None else f, dtype=np.int64))) for f in got["found"]]
    return fit_machine(columns, got["mark"].to_numpy(dtype=np.float64), buckets, known["value"].to_numpy(dtype=np.float64))


def classify(documents: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """key, held_out, score (higher: label 1 likelier) and predicted (1 from `threshold` on) for every row of `documents`.

    Scores see the whole text only, null as empty. Words met in the sample, and prefixes of words, count once each however often
    they stand there. Repeated rows are scored each, equal texts equally; extra columns are not looked at; an empty table gives no
    row. Without labels every score is 0.5; with one class it is that class' clipped share.
    """
    machine = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, key, label))  # at most MOST_BUCKETS rows

    @F.pandas_udf("double")
    def rating(texts: pd.Series) -> pd.Series:
        return pd.Series(machine.value.scores(list(texts)), dtype="float64")

    scored = small_batches(documents).select(F.col(key).alias("_key"), rating(text_of("text")).alias("_score"))
    return scored.select(F.col("_key").alias(key), held_out(F.col("_key")).alias("held_out"), F.col("_score").alias("score"),
                         (F.col("_score") >= threshold).cast("int").alias("predicted"))
