"""Quality classifier: a byte-level convolutional network in numpy over whole documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltcellar.llm.shared import key_hash, small_batches, text_of

WIDTH, FILTERS, EMBEDDING = 6, 16, 8
BLOCK = 256  # a chunk is two neighbouring blocks, so chunks overlap by half
SAMPLE_ROWS = 4000  # labelled rows that the fit sees, whole
MOST_EPOCHS = 60
FOLDS, HELD_OUT_FOLD = 5, 0
THRESHOLD = 0.3
SLAB_BYTES = 1 << 18
BATCH_ROWS = 500  # texts that a scoring task holds at once
GRID = float(1 << 20)


@dataclass
class Network:
    """`tables[j, b]` is what byte b at offset j of a window adds to each filter; mean of pooled chunks -> logit."""

    tables: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        pooled = [chunk_features(self, part) for part in slabs(texts)]
        return sigmoid(np.concatenate(pooled) @ self.weight + self.offset) if pooled else np.zeros(0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def slabs(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in runs of bounded size; one long text is a run of its own."""
    run: list[bytes] = []
    held = 0
    for text in texts:
        if run and held + len(text) > SLAB_BYTES:
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text)
    if run:
        yield run


def _blocks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in whole blocks per text, and each text's number of blocks.

    A text has zeros before it and behind its end: windows at the end of one text see none of the next.
    """
    lead = b"\0" * (WIDTH - 1)
    counts = np.array([-(-(len(t) + len(lead)) // BLOCK) for t in texts])
    data = b"".join((lead + t).ljust(n * BLOCK, b"\0") for t, n in zip(texts, counts.tolist()))
    return np.frombuffer(data + b"\0" * WIDTH, dtype=np.uint8), counts


def _responses(tables: np.ndarray, data: np.ndarray) -> np.ndarray:
    length = len(data) - WIDTH
    out = tables[0].take(data[:length], axis=0)
    for j in range(1, WIDTH):
        out += tables[j].take(data[j : j + length], axis=0)
    return out


def _chunk_rows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second block of each chunk, and where the chunks of each text begin."""
    starts = np.cumsum(counts) - counts
    per_text = np.maximum(counts - 1, 1)
    begin = np.cumsum(per_text) - per_text
    first = np.repeat(starts - begin, per_text) + np.arange(per_text.sum())
    second = np.minimum(first + 1, np.repeat(starts + counts - 1, per_text))
    return first, second, begin


def chunk_features(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean over a text's overlapping chunks of the strongest response of each filter in the chunk."""
    data, counts = _blocks(texts)
    peaks = np.empty((int(counts.sum()), FILTERS), dtype=np.float32)
    step = SLAB_BYTES // BLOCK
    for low in range(0, len(peaks), step):  # a very long text passes through in slabs as well
        high = min(low + step, len(peaks))
        part = _responses(net.tables, data[low * BLOCK : high * BLOCK + WIDTH])
        peaks[low:high] = part.reshape(high - low, BLOCK, FILTERS).max(axis=1)
    first, second, begin = _chunk_rows(counts)
    chunks = np.maximum(np.maximum(peaks[first], peaks[second]) + net.bias, 0.0)
    return np.add.reduceat(chunks, begin, axis=0) / np.maximum(counts - 1, 1)[:, None]


def fit_network(texts: list[bytes], labels: np.ndarray, steps: int = 1500, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the log loss: about `steps` steps, at most `MOST_EPOCHS` passes. The byte embedding is shared by the offsets of the
    filters. One class only: a constant score."""
    random = np.random.default_rng(seed)
    share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    params = {
        "embed": random.normal(0, 0.5, (256, EMBEDDING)), "filters": random.normal(0, 0.5, (WIDTH, EMBEDDING, FILTERS)),
        "bias": np.zeros(FILTERS), "weight": random.normal(0, 0.1, FILTERS), "offset": np.array([np.log(share / (1 - share))]),
    }
    if len(set(labels.tolist())) < 2:
        return _network(params | {"weight": np.zeros(FILTERS)})
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    step = 0
    epochs = min(MOST_EPOCHS, -(-steps // -(-len(texts) // batch)))  # few texts give few steps, however long they are
    for epoch in range(epochs):
        order = random.permutation(len(texts))
        pace = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for low in range(0, len(order), batch):
            chosen = order[low : low + batch]
            step += 1
            grads = _gradients(params, [texts[i] for i in chosen], labels[chosen])
            for name, grad in grads.items():
                mean, square = moments[name]
                mean += 0.1 * (grad - mean)
                square += 0.01 * (grad * grad - square)
                fixed = (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-7)
                # On a grid far above rounding errors, so that machines that add in another order agree.
                params[name] = np.round((params[name] - pace * fixed) * GRID) / GRID
    return _network(params)


def _network(params: dict[str, np.ndarray]) -> Network:
    tables = np.einsum("be,jef->jbf", params["embed"], params["filters"])
    return Network(tables.astype(np.float32), params["bias"].astype(np.float32), params["weight"], float(params["offset"][0]))


def _gradients(params: dict[str, np.ndarray], texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
    tables = np.einsum("be,jef->jbf", params["embed"], params["filters"])
    data, counts = _blocks(texts)
    blocks = int(counts.sum())
    where, peaks = np.empty((blocks, FILTERS), dtype=np.int64), np.empty((blocks, FILTERS))
    for low in range(0, blocks, SLAB_BYTES // BLOCK):
        high = min(low + SLAB_BYTES // BLOCK, blocks)
        out = _responses(tables, data[low * BLOCK : high * BLOCK + WIDTH]).reshape(high - low, BLOCK, FILTERS)
        where[low:high] = out.argmax(axis=1)
        peaks[low:high] = np.take_along_axis(out, where[low:high, None, :], axis=1)[:, 0, :]
    first, second, begin = _chunk_rows(counts)
    from_second = peaks[second] > peaks[first]
    best = np.where(from_second, peaks[second], peaks[first]) + params["bias"]
    chunks = np.maximum(best, 0.0)
    per_text = np.maximum(counts - 1, 1)
    pooled = np.add.reduceat(chunks, begin, axis=0) / per_text[:, None]
    error = (sigmoid(pooled @ params["weight"] + params["offset"][0]) - labels) / len(texts)
    to_chunk = np.repeat(error / per_text, per_text)[:, None] * params["weight"] * (best > 0)
    block = np.where(from_second, second[:, None], first[:, None])
    position = block * BLOCK + where[block, np.arange(FILTERS)]
    filters = np.broadcast_to(np.arange(FILTERS), position.shape).ravel()
    flow = to_chunk.ravel()
    to_embed = np.zeros_like(params["embed"])
    to_filters = np.empty_like(params["filters"])
    for j in range(WIDTH):
        cells = data[position.ravel() + j].astype(np.int64) * FILTERS + filters
        to_table = np.bincount(cells, weights=flow, minlength=256 * FILTERS).reshape(256, FILTERS)
        to_embed += to_table @ params["filters"][j].T
        to_filters[j] = params["embed"].T @ to_table
    return {
        "embed": to_embed, "filters": to_filters, "bias": to_chunk.sum(axis=0),
        "weight": pooled.T @ error + 1e-4 * params["weight"], "offset": np.array([error.sum()]),
    }


def held_out(key: str = "doc_id"):
    """Fold of a row: by the CRC of its key written as text; never used in a fit."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % FOLDS) == HELD_OUT_FOLD


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", rows: int = SAMPLE_ROWS) -> Network:
    """A network from at most `rows` labelled rows outside the held-out fold, those with the smallest hashes of key and text.

    Rows that repeat key and text count once. The fit sees whole texts, so only the number of rows is bounded. Null labels are left
    out, several labels of one key count as the lowest. Without labels every score is 0.5; with one class it is that class' clipped share.
    """
    marks = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).filter("_key IS NOT NULL AND _label IS NOT NULL")
    marks = marks.groupBy("_key").agg((F.min("_label") > 0).cast("int").alias("_label")).filter(~held_out("_key"))
    row = F.xxhash64(F.col(key), text_of("text"))
    known = documents.select(F.col(key).alias("_key"), row.alias("_row")).filter("_key IS NOT NULL").join(marks, "_key").distinct()
    chosen = known.orderBy("_row", key_hash(F.col("_key")), "_key").limit(rows)
    texts = documents.select(F.col(key).alias("_key"), row.alias("_row"), text_of("text").alias("_text"))
    found = texts.join(F.broadcast(chosen), ["_key", "_row"]).dropDuplicates(["_key", "_row"])
    found = found.select("_key", "_label", "_text").collect()  # at most `rows` rows
    found.sort(key=lambda r: (r["_key"], r["_text"]))
    sample = [r["_text"].encode("utf-8", "replace") for r in found]
    return fit_network(sample, np.array([r["_label"] for r in found], dtype=np.float64))


def score(documents: DataFrame, net: Network, key: str = "doc_id") -> DataFrame:
    """(key, score) of each row over its whole text, in UTF-8 bytes; null text is empty text. Only the text is an input."""
    model = documents.sparkSession.sparkContext.broadcast(net)  # a few hundred KB, whatever the input

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t.encode("utf-8", "replace") for t in batch["_text"]]
            yield pd.DataFrame({key: batch["_key"], "score": model.value.scores(texts).astype("float64")})

    rows = small_batches(documents, BATCH_ROWS).select(F.col(key).alias("_key"), text_of("text").alias("_text"))
    return rows.mapInPandas(rate, f"`{key}` {documents.schema[key].dataType.simpleString()}, score double")


def classify(documents: DataFrame, labels: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """key, held_out, score (higher: label 1 likelier) and predicted (1 from `threshold` on) for every row of `documents`.

    Repeated rows are scored each; equal texts have equal scores; an empty table gives no row.
    """
    scored = score(documents, fit(documents, labels, key), key)
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, with all their columns. The text passes to the scoring tasks and back in place."""
    net = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, key))

    @F.pandas_udf("double")
    def rating(texts: pd.Series) -> pd.Series:
        return pd.Series(net.value.scores([t.encode("utf-8", "replace") for t in texts]), dtype="float64")

    return small_batches(documents, BATCH_ROWS).filter(rating(text_of("text")) >= threshold)
