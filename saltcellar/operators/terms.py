"""Terms of one to three words in texts, counted in packed blocks: what is shuffled are sorted hashes of terms, a part of them at a time."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltcellar.session import stored

LONGEST_NGRAM, LEAST_DOCUMENTS = 3, 2
BLOCK_WORDS = 1 << 20  # texts of about so many words are packed, and have their terms counted, together
PARTS, PART_WORDS = 4, 1 << 22  # so many parts of all hashes, one after another; texts of few words have fewer
PIECE_WORDS = 1 << 20  # a task of a part gets the terms of about so many words

_BLOCK = "block long, texts array<string>, copies array<long>, lengths array<int>, vocabulary binary, ids binary, n_copies long, n_words long"
_OPENED = ("block", "texts", "copies", "lengths", "vocabulary", "ids")
_ASKED = "block long, piece int, grams binary, times binary"
_ANSWER = "block long, piece int, counts binary"
_LISTED = "text string, copies long, terms array<struct<term:string,tf:long,df:long>>"


@dataclass(frozen=True)
class Counted:
    """Packed blocks of texts, and for each part of the hashes the document frequencies of the blocks' terms."""

    blocks: DataFrame
    answers: tuple[DataFrame, ...]
    n_texts: int


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


def _squeezed(values: np.ndarray) -> bytes:
    return zlib.compress(packed(values), 1)


def _unsqueezed(data: bytes) -> np.ndarray:
    return unpacked(zlib.decompress(data))


def packed_sorted(values: np.ndarray) -> bytes:
    """Sorted numbers by their steps: hashes that lie close take fewer bytes."""
    return values[:1].astype("<u8").tobytes() + packed(np.diff(values)) if len(values) else b""


def unpacked_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(data[:8], dtype="<u8"), unpacked(data[8:])]), dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _packed_blocks(batches: Iterator[pa.RecordBatch], block_words: int) -> Iterator[pa.RecordBatch]:
    """(text hash, copies, words joined by blanks) to blocks: their words as numbers in a vocabulary of the block."""
    names = [column.split()[0] for column in _BLOCK.split(", ")]
    kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    number = TaskContext.get().partitionId() << 32
    texts, copies, lengths, words = [], [], [], []

    def block():
        codes, vocabulary = pd.factorize(np.array(words, dtype=object)) if words else (np.zeros(0, np.int64), [])
        often = np.argsort(-np.bincount(codes, minlength=len(vocabulary)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(often), dtype=np.uint64)
        rank[often] = np.arange(len(often), dtype=np.uint64)
        joined = "\n".join(vocabulary[k] for k in often).encode()
        row = [number, texts, copies, lengths, zlib.compress(joined, 1), _squeezed(rank[codes]), sum(copies), len(words)]
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds)], names)

    for batch in batches:
        for text, n, line in zip(*(batch.column(c).to_pylist() for c in ("text", "copies", "words"))):
            cut = line.split(" ") if line else []
            texts.append(text)
            copies.append(n)
            lengths.append(len(cut))
            words += cut
            if len(words) >= block_words:
                yield block()
                number, texts, copies, lengths, words = number + 1, [], [], [], []
    if texts:
        yield block()


class _Block:
    """A packed block, opened."""

    def __init__(self, row: dict):
        self.texts, self.copies, self.lengths = row["texts"], np.asarray(row["copies"], dtype=np.int64), np.asarray(row["lengths"], dtype=np.int64)
        joined = zlib.decompress(row["vocabulary"]).decode()
        self.words = np.array(joined.split("\n") if joined else [], dtype=object)
        self.ids = _unsqueezed(row["ids"]).astype(np.int64)
        self.text = np.repeat(np.arange(len(self.lengths)), self.lengths)

    def occurrences(self, part: int | None, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, place of the first word and number of words of each run of words in a part of the hashes (None: in all)."""
        words = pd.util.hash_array(self.words, categorize=False)[self.ids] if len(self.ids) else np.zeros(0, dtype=np.uint64)
        left = np.repeat(np.cumsum(self.lengths), self.lengths) - np.arange(len(words))  # words up to the end of the text
        found, grams = [], words
        for n in range(1, LONGEST_NGRAM + 1):
            if n > 1:
                after = np.zeros_like(words)
                after[: 1 - n] = words[n - 1 :]
                grams = _mixed(grams * np.uint64(0x9E3779B97F4A7C15) + after)
            hashes = _mixed(grams + np.uint64(n))
            kept = left >= n
            if part is not None:
                kept &= _share(hashes, parts) == part
            at = np.flatnonzero(kept)
            found.append((hashes[at], at, np.full(len(at), n, dtype=np.int8)))
        return tuple(np.concatenate([f[k] for f in found]) for k in range(3))

    def terms(self, part: int | None, parts: int):
        """Different hashes in order, place and length of the first run of each; and the pairs of a hash's number and a text with it, by
        hash, with the times it stands there."""
        hashes, at, size = self.occurrences(part, parts)
        order = np.argsort(hashes, kind="stable")  # the runs of one length stay in the order of texts
        hashes, at, size = hashes[order], at[order], size[order]
        text = self.text[at]
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = hashes[1:] != hashes[:-1]
        pair = new.copy()
        pair[1:] |= text[1:] != text[:-1]
        starts, firsts = np.flatnonzero(pair), np.flatnonzero(new)
        of = (np.cumsum(new) - 1)[starts]
        return hashes[firsts], at[firsts], size[firsts], of, text[starts], np.diff(np.append(starts, len(hashes)))

    def strings(self, at: np.ndarray, size: np.ndarray) -> pa.Array:
        """The runs of words as texts."""
        vocabulary, out = pa.array(self.words, pa.string()), []
        for n in range(1, LONGEST_NGRAM + 1):
            first = at[size == n]
            out.append(pc.binary_join_element_wise(*[vocabulary.take(pa.array(self.ids[first + k])) for k in range(n)], " "))
        whole = pa.concat_arrays(out)
        back = np.empty(len(at), dtype=np.int64)
        back[np.argsort(size, kind="stable")] = np.arange(len(at))
        return whole.take(pa.array(back))


def _share(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Which of equal ranges of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _ask(part: int, parts: int, pieces: int) -> Callable:
    """The terms of a part of the hashes, each once a block with the copies of the block's texts that hold it, by piece of the part."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row)
                hashes, _, _, of, text, _ = block.terms(part, parts)
                times = np.bincount(of, weights=block.copies[text], minlength=len(hashes)).astype(np.uint64)
                cuts = np.searchsorted(_share(hashes, parts * pieces), np.arange(part * pieces, (part + 1) * pieces + 1))
                rows = [(row["block"], part * pieces + s, packed_sorted(hashes[a:b]), _squeezed(times[a:b])) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                kinds, names = (pa.int64(), pa.int32(), pa.binary(), pa.binary()), ["block", "piece", "grams", "times"]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names)

    return ask


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of a piece's terms over all blocks, for each block in the order of its hashes."""
    grams = [unpacked_sorted(g) for g in rows["grams"]]
    times = np.concatenate([_unsqueezed(t) for t in rows["times"]])
    values, place = np.unique(np.concatenate(grams), return_inverse=True)
    totals = np.bincount(place, weights=times.astype(np.float64), minlength=len(values)).astype(np.uint64)
    cuts = np.cumsum([len(g) for g in grams])[:-1]
    return rows[["block", "piece"]].assign(counts=[_squeezed(c) for c in np.split(totals[place], cuts)])


def count_terms(cut: DataFrame, block_words: int = BLOCK_WORDS, part_words: int = PART_WORDS, piece_words: int = PIECE_WORDS) -> Counted:
    """(text hash, copies, words joined by blanks) of different texts, packed and with the document frequencies of their terms.

    Texts are cut and packed once, to a few bits a word. Then, for one part of the hashes after another, each block names its terms once, as
    sorted 64-bit hashes, and pieces of the part sum them up and answer; a frequent term is one entry of a block. The shuffles of a part are
    dropped before the next, so disk holds the blocks, the answers and one part. No vocabulary leaves the executors.
    """
    blocks = stored(cut.select("text", "copies", "words").mapInArrow(lambda batches: _packed_blocks(batches, block_words), _BLOCK), "caption-blocks")
    n_texts, words = (n or 0 for n in blocks.agg(F.sum("n_copies"), F.sum("n_words")).first())
    parts = max(1, min(PARTS, -(-words // part_words)))
    pieces = max(1, -(-words // (parts * piece_words)))
    answers = []
    for part in range(parts):
        asked = blocks.select(*_OPENED).mapInArrow(_ask(part, parts, pieces), _ASKED)
        answers.append(stored(asked.groupBy("piece").applyInPandas(_answer, _ANSWER), "caption-counts"))
    return Counted(blocks, tuple(answers), n_texts)


def _list(part: int | None, parts: int, n_texts: int, heaviest: int | None) -> Callable:
    def listed(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = {"text": [], "copies": [], "terms": []}
        for row in blocks.to_pylist():
            block = _Block(row)
            hashes, at, size, of, text, tf = block.terms(part, parts)
            counts = answers.sort_by("piece").column("counts").to_pylist()
            df = np.concatenate([_unsqueezed(c) for c in counts]).astype(np.int64) if counts else np.zeros(0, dtype=np.int64)
            kept = np.flatnonzero(df[of] >= LEAST_DOCUMENTS)
            of, text, tf = of[kept], text[kept], tf[kept]
            if heaviest is None:
                order = np.argsort(text, kind="stable")
            else:
                weight = term_weight(tf, df[of], n_texts)
                order = np.lexsort((-weight, text))
                first = np.flatnonzero(np.append(True, text[order][1:] != text[order][:-1])) if len(order) else order
                many = np.diff(np.append(first, len(order)))
                last = weight[order[first + np.minimum(many, heaviest) - 1]]  # ties with the last one stay: they are settled by name
                order = order[weight[order] >= np.repeat(last, many) * (1 - 1e-9)]
            of, text, tf = of[order], text[order], tf[order]
            used = np.unique(of)
            strings = block.strings(at[used], size[used]).take(pa.array(np.searchsorted(used, of)))
            entries = pa.StructArray.from_arrays([strings, pa.array(tf, pa.int64()), pa.array(df[of], pa.int64())], ["term", "tf", "df"])
            first = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else np.zeros(0, dtype=np.int64)
            out["text"].append(pa.array([block.texts[k] for k in text[first]], pa.string()))
            out["copies"].append(pa.array(block.copies[text[first]], pa.int64()))
            out["terms"].append(pa.ListArray.from_arrays(pa.array(np.append(first, len(text)), pa.int32()), entries))
        kinds = (pa.string(), pa.int64(), pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64()), ("df", pa.int64())])))
        return pa.table({k: pa.chunked_array(v, kind) for (k, v), kind in zip(out.items(), kinds)})

    return listed


def term_weight(tf: np.ndarray, df: np.ndarray, n_texts: int) -> np.ndarray:
    return tf * (np.log((n_texts + 1) / (df + 1)) + 1)


def term_lists(counted: Counted, part: int | None = None, heaviest: int | None = None) -> DataFrame:
    """(text hash, copies, terms) of texts with terms that stand in two texts or more: those of one part of the hashes, or all; with
    `heaviest` so many of the greatest weight, and any that weigh as much as the last of them."""
    found, parts = counted.blocks.select(*_OPENED), len(counted.answers)
    answers = counted.answers[part or 0]
    if part is None:
        for more in counted.answers[1:]:
            answers = answers.unionByName(more)
    both = found.groupBy("block").cogroup(answers.groupBy("block"))
    return both.applyInArrow(_list(part, parts, counted.n_texts, heaviest), _LISTED)


def parted_lists(counted: Counted) -> DataFrame:
    """The lists of all parts, one row a text and part. The column `part` says in its metadata how many parts there are."""
    found, parts = None, len(counted.answers)
    for part in range(parts):
        some = term_lists(counted, part).select("*", F.lit(part).alias("part", metadata={"parts": parts}))
        found = some if found is None else found.union(some)
    return found
