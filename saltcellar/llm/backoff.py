"""Stupid-backoff scores of documents against the corpus they stand in."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltcellar.llm.grouped import spans, whole_groups
from saltcellar.llm.shared import small_batches, text_of
from saltcellar.llm.tokens import mix, slabs, word_hashes

ORDER, BACKOFF = 3, 0.4
BLOCK_CHARS = 1 << 23  # texts of about so many characters have their n-grams counted before they are sent
PART_CHARS = 1 << 23  # there is one part of the n-gram tables for so many characters of the corpus
_REQUEST = "block bigint, `order` int, part int, grams binary, times binary"
_ANSWER = "block bigint, `order` int, part int, counts binary"


def n_grams(words: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each word, and whether there is one within the text."""
    grams = words
    for back in range(1, order):
        before = np.zeros_like(words)
        before[back:] = words[:-back]
        grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + before)
    begin = np.repeat(np.cumsum(counts) - counts, counts)
    return mix(grams + np.uint64(order)), np.arange(len(words)) - begin >= order - 1


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as planes of equal bytes, only as many as the largest number needs; the first byte tells."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.ascontiguousarray(planes.T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").reshape(-1)


def squeezed(counts: np.ndarray) -> bytes:
    """Counts, most of them one and the same small number."""
    return zlib.compress(packed(counts), 1)


def unsqueezed(data: bytes) -> np.ndarray:
    return unpacked(zlib.decompress(data))


def packed_sorted(values: np.ndarray) -> bytes:
    """Sorted numbers by their steps: hashes that lie close take fewer bytes."""
    return values[:1].astype("<u8").tobytes() + packed(np.diff(values)) if len(values) else b""


def unpacked_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(data[:8], dtype="<u8"), unpacked(data[8:])]), dtype=np.uint64)


def _part_cuts(sorted_grams: np.ndarray, parts: int) -> np.ndarray:
    """Where the parts begin in sorted hashes: a part is a range of hash values."""
    limits = [(p << 64) // parts for p in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(sorted_grams, np.array(limits, dtype=np.uint64)), [len(sorted_grams)]]).astype(np.int64)


def _blocks(batches: Iterator[pd.DataFrame], block_chars: int) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    """(number, keys, words, words per text) of runs of rows; the number holds task and place, and reruns of a scan agree."""
    number = TaskContext.get().partitionId() << 32
    keys, words, counts, held = [], [], [], 0
    for batch in batches:
        texts = batch["text"].tolist()
        for part in slabs(texts):
            some, per_text = word_hashes(texts[part])
            keys += batch["key"].iloc[part].tolist()
            words.append(some)
            counts.append(per_text)
            held += sum(map(len, texts[part]))
            if held >= block_chars:
                yield number, keys, np.concatenate(words), np.concatenate(counts)
                number, keys, words, counts, held = number + 1, [], [], [], 0
    if keys:
        yield number, keys, np.concatenate(words), np.concatenate(counts)


def _requests(order: int, parts: int, block_chars: int):
    """The n-grams of each block, each once with its number, by order and part."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, _, words, counts in _blocks(batches, block_chars):
            for n in range(1, order + 1):
                grams, whole = n_grams(words, counts, n)
                values, times = np.unique(grams[whole], return_counts=True)
                cuts = _part_cuts(values, parts)
                rows = [
                    (number, n, p, packed_sorted(values[a:b]), squeezed(times[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a
                ]
                if rows:
                    yield pd.DataFrame(rows, columns=["block", "order", "part", "grams", "times"])

    return ask


def _answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often the other blocks have the n-grams each block asked for: one part of an n-gram table at a time."""
    keys = ["order", "part"]
    for run in whole_groups(batches, keys):
        for a, b in spans(run, keys):
            grams = [unpacked_sorted(g) for g in run["grams"].iloc[a:b]]
            times = np.concatenate([unsqueezed(t) for t in run["times"].iloc[a:b]])
            values, place = np.unique(np.concatenate(grams), return_inverse=True)
            totals = np.bincount(place, weights=times.astype(np.float64), minlength=len(values)).astype(np.uint64)
            cuts = np.cumsum([len(g) for g in grams])[:-1]
            yield run.iloc[a:b][["block", "order", "part"]].assign(counts=[squeezed(c) for c in np.split(totals[place] - times, cuts)])


def _payload(block_chars: int):
    """The words of each block as numbers in its own vocabulary."""

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, keys, words, counts in _blocks(batches, block_chars):
            vocabulary, ids = np.unique(words, return_inverse=True)
            planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
            yield pd.DataFrame(
                {
                    "block": [number], "order": [0], "part": [0], "counts": [zlib.compress(planes, 1)], "vocabulary": [packed_sorted(vocabulary)],
                    "keys": [keys], "lengths": [counts.astype(np.int64)],
                }
            )

    return carry


def _own(grams: np.ndarray, document: np.ndarray) -> np.ndarray:
    """How often the same document has each of its n-grams."""
    order = np.lexsort((grams, document))
    g, d = grams[order], document[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    group = np.cumsum(new) - 1
    out = np.empty(len(g), dtype=np.int64)
    out[order] = np.bincount(group)[group] if len(g) else 0
    return out


def _scores(order: int, factor: float, corpus_words: int, key: str):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in whole_groups(batches, ["block"]):
            for a, b in spans(run, ["block"]):
                rows = run.iloc[a:b]
                head = rows.iloc[0]
                counts = np.asarray(head["lengths"], dtype=np.int64)
                vocabulary = unpacked_sorted(head["vocabulary"])
                planes = np.frombuffer(zlib.decompress(head["counts"]), dtype=np.uint8).reshape(4, -1)
                words = vocabulary[np.ascontiguousarray(planes.T).view("<u4").reshape(-1)]
                document = np.repeat(np.arange(len(counts)), counts)
                seen: list[np.ndarray] = []
                for n in range(1, order + 1):
                    answers = rows[rows["order"] == n]
                    elsewhere = np.concatenate([unsqueezed(c) for c in answers["counts"]]) if len(answers) else np.zeros(0, dtype=np.uint64)
                    grams, whole = n_grams(words, counts, n)
                    left = np.zeros(len(words), dtype=np.int64)
                    if whole.any():
                        _, place, here = np.unique(grams[whole], return_inverse=True, return_counts=True)
                        left[whole] = (elsewhere.astype(np.int64) + here)[place] - _own(grams[whole], document[whole])
                    seen.append(left)
                others = np.maximum(corpus_words - counts, 1)[document]
                log = np.log(np.maximum(seen[0], 1) / others)
                for n in range(2, order + 1):
                    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
                    context = np.zeros(len(words), dtype=np.int64)
                    context[1:] = seen[n - 2][:-1]
                    found = seen[n - 1] > 0
                    ratio = np.log(np.maximum(seen[n - 1], 1) / np.maximum(context, 1))
                    log = np.where(place < n - 1, log, np.where(found, ratio, log + math.log(factor)))
                total = np.bincount(document, weights=log, minlength=len(counts))
                with np.errstate(invalid="ignore", divide="ignore"):
                    mean = np.where(counts > 0, total / counts, np.nan)
                yield pd.DataFrame({key: list(head["keys"]), "n_words": counts, "log_score": total, "mean_log_score": mean})

    return score


def score_corpus(
    documents: DataFrame, key: str = "doc_id", order: int = ORDER, factor: float = BACKOFF, block_chars: int = BLOCK_CHARS, part_chars: int = PART_CHARS
) -> DataFrame:
    """(key, n_words, log_score, mean_log_score) of every row of a stored table `documents`.

    A word scores c(n-gram) / c(its first n - 1 words) if the rest of the corpus has the n-gram; else `factor` times its score
    one order lower, down to c(word) / c(all words). Counts leave out the document's own occurrences, else every text would be
    its own best model; a word that no other document has counts once. log_score sums natural logarithms over the text;
    its mean is null for a text without words, whose sum is 0. Words are runs of letters and digits in lower case. Null text is
    empty, rows that repeat are documents of their own, an empty table gives no row.

    Blocks of documents count their n-grams and ask for each once; n-gram tables are parted by hash, and a part is joined with
    what all blocks ask of it by one task; the answers come back to the blocks, which sum up per document. A frequent n-gram is one entry of
    a block, so no part is hot, and tables and questions grow with the corpus. `documents` is scanned twice and must give the same rows in the same tasks
    both times, as stored tables do.
    """
    rows = small_batches(documents).select(F.col(key).alias("key"), text_of("text").alias("text"))
    number = F.regexp_count(F.lower("text"), F.lit(r"[0-9a-z\x{80}-\x{10FFFF}]+"))
    chars, words = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in (F.char_length("text"), number)]).first()
    parts = max(1, -(-chars // part_chars))
    asked = rows.mapInPandas(_requests(order, parts, block_chars), _REQUEST)
    # About a group a task: the numbers grow with the corpus, and a worker holds one group at a time.
    answers = asked.repartition(order * parts, "order", "part").sortWithinPartitions("order", "part", "block").mapInPandas(_answers, _ANSWER)
    kind = documents.schema[key].dataType.simpleString()
    carried = f"{_ANSWER}, vocabulary binary, keys array<{kind}>, lengths array<bigint>"
    payload = rows.mapInPandas(_payload(block_chars), carried)
    both = payload.unionByName(answers, allowMissingColumns=True)
    both = both.repartition(2 * max(1, -(-chars // block_chars)), "block").sortWithinPartitions("block", "order", "part")
    scored = both.mapInPandas(_scores(order, factor, words, key), f"`{key}` {kind}, n_words bigint, log_score double, mean_log_score double")
    return scored.withColumn("mean_log_score", F.nanvl("mean_log_score", F.lit(None).cast("double")))
