"""Cross-tokenizer alignment: the token ends of two tokenizers merged along diagonals of equal work."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltcellar.llm.shared import small_batches, stored, text_of

TOKENIZERS = "/opt/tokenizers"
FIRST_FILE, SECOND_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
# How the first tokenizer cuts texts before it merges bytes (fixed value of its kind).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE = 1 << 14  # merged ends in a piece of work
SLAB_BYTES, BLOCK_BYTES = 1 << 20, 1 << 23
SEPARATORS = (b",", b"|", b";")


def byte_level_alphabet() -> dict[str, int]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class Vocabulary:
    """`encode` lists of texts to lists of ids; `pieces[id]` are an id's bytes, `sizes` their lengths."""

    def __init__(self, pieces: list[bytes], encode):
        self.pieces, self.encode = pieces, encode
        self.sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        self.written = [str(i).encode() + s for i in range(len(pieces)) for s in SEPARATORS]


def _merges_in_id_order(model: dict) -> bool:
    ids = model["vocab"]
    made = [ids.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    return made == list(range(256, 256 + len(made))) and sorted(ids.values()) == list(range(256 + len(made)))


@cache
def byte_level(path: str) -> Vocabulary:
    """A byte-level tokenizer file. Where merges rank as their ids, the ranks alone encode the same and faster."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    alphabet, model = byte_level_alphabet(), spec["model"]
    special = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", ())}
    pieces = [b""] * (1 + max([*model["vocab"].values(), *special]))
    for token, number in model["vocab"].items():
        pieces[number] = bytes(alphabet[c] for c in token)
    ranks = {pieces[number]: number for number in model["vocab"].values()}
    for number, content in special.items():
        pieces[number] = content
    cut = spec.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec.get("normalizer")
    if plain and _merges_in_id_order(model):
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return Vocabulary(pieces, lambda texts: [encoding.encode_ordinary(t) for t in texts])
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return Vocabulary(pieces, lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])


@cache
def piece_level(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    numbers = range(model.get_piece_size())
    pieces = [
        bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in numbers
    ]
    return Vocabulary(pieces, lambda texts: model.encode(texts, num_threads=1) if texts else [])


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of the first d merged values come from `a`, for each diagonal d; equal values: `a` goes first.

    One binary search along each diagonal of the merge grid, all diagonals at once.
    """
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (seeking := low < high).any():
        middle = (low + high) // 2
        left = a[np.minimum(middle, len(a) - 1)]
        right = b[np.clip(diagonals - middle - 1, 0, len(b) - 1)]
        low, high = np.where(seeking & (left <= right), middle + 1, low), np.where(seeking & (left > right), middle, high)
    return low


def piece_overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in two sorted runs that hold the same value."""
    if not len(a) or not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.searchsorted(b, a)
    same = b[np.minimum(at, len(b) - 1)] == a
    return np.flatnonzero(same), at[same]


def common_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the equal values of two strictly increasing arrays, by pieces of `piece` merged values.

    Diagonals cut the merge into pieces of equal work, however the values lie; each piece is merged on its own. A value that
    ends one piece in `a` and begins the next in `b` is stitched from the two.
    """
    total = len(a) + len(b)
    cuts = np.append(np.arange(0, total, piece), total)
    in_a = crossings(a, b, cuts)
    in_b = cuts - in_a
    found_a, found_b = [], []
    for k in range(len(cuts) - 1):
        i, j = piece_overlaps(a[in_a[k] : in_a[k + 1]], b[in_b[k] : in_b[k + 1]])
        found_a.append(i + in_a[k])
        found_b.append(j + in_b[k])
        last, first = in_a[k + 1] - 1, in_b[k + 1]
        if last >= 0 and first < len(b) and a[last] == b[first]:
            found_a.append(np.array([last]))
            found_b.append(np.array([first]))
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def _tokens(vocabulary: Vocabulary, texts: list[str], wanted: list[bytes]) -> list[list[int] | None]:
    """Ids of each text, or None where their bytes are not the wanted ones."""
    pieces = vocabulary.pieces
    return [ids if b"".join([pieces[i] for i in ids]) == w else None for ids, w in zip(vocabulary.encode(texts), wanted)]


def align_texts(first: Vocabulary, second: Vocabulary, texts: list[str], piece: int = PIECE) -> dict[str, list]:
    """Per text: token counts, groups, their digest, and the linked id pairs (code, times).

    The ends of all texts are merged as one run of byte offsets: every text ends in a common end, so no group crosses texts.
    """
    filled = [i for i, t in enumerate(texts) if t]
    wanted = [b" " + texts[i].encode("utf-8", "replace") for i in filled]
    pairs = zip(filled, _tokens(first, [" " + texts[i] for i in filled], wanted), _tokens(second, [texts[i] for i in filled], wanted))
    kept = [(i, x, y) for i, x, y in pairs if x is not None and y is not None]
    n_a, n_b = np.array([len(x) for _, x, _ in kept], np.int64), np.array([len(y) for _, _, y in kept], np.int64)
    ids_a = np.fromiter(chain.from_iterable(x for _, x, _ in kept), np.int64, int(n_a.sum()))
    ids_b = np.fromiter(chain.from_iterable(y for _, _, y in kept), np.int64, int(n_b.sum()))
    link_a, link_b = common_ends(np.cumsum(first.sizes[ids_a]), np.cumsum(second.sizes[ids_b]), piece)

    # Where each token stands in the written groups: A tokens of a group, then its B tokens.
    upto_a, upto_b = link_a + 1, link_b + 1
    group_a = np.repeat(np.arange(len(link_a)), np.diff(upto_a, prepend=0))
    group_b = np.repeat(np.arange(len(link_b)), np.diff(upto_b, prepend=0))
    closes_a, closes_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    closes_a[link_a], closes_b[link_b] = 1, 2
    written = np.empty(len(ids_a) + len(ids_b), np.int64)
    written[np.arange(len(ids_a)) + (upto_b - np.diff(upto_b, prepend=0))[group_a]] = ids_a * 3 + closes_a
    written[np.arange(len(ids_b)) + upto_a[group_b]] = -(ids_b * 3 + closes_b) - 1  # B codes are negative
    ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
    links_upto = np.searchsorted(link_a, ends_a)

    # Distinct linked pairs of each text.
    text_of_link = np.searchsorted(ends_a, link_a, side="right")
    code = ids_a[link_a] * len(second.pieces) + ids_b[link_b]
    order = np.lexsort((code, text_of_link))
    code, owner = code[order], text_of_link[order]
    starts = np.flatnonzero(np.append(True, (np.diff(code) != 0) | (np.diff(owner) != 0))) if len(code) else np.empty(0, np.int64)
    times = np.diff(np.append(starts, len(code)))
    code, owner = code[starts], owner[starts]
    bounds = np.searchsorted(owner, np.arange(len(kept) + 1))

    out = {"n_a": [0] * len(texts), "n_b": [0] * len(texts), "n_groups": [0] * len(texts), "groups_sha256": [""] * len(texts)}
    codes, counts = [np.empty(0, np.int64)] * len(texts), [np.empty(0, np.int32)] * len(texts)
    begin, links = 0, 0
    names_a, names_b = first.written, second.written
    for k, (i, x, y) in enumerate(kept):
        stop = int(ends_a[k] + ends_b[k])
        line = b"".join([names_a[c] if c >= 0 else names_b[-c - 1] for c in written[begin:stop].tolist()])
        here = int(links_upto[k])
        out["n_a"][i], out["n_b"][i], out["n_groups"][i] = len(x), len(y), here - links
        out["groups_sha256"][i] = hashlib.sha256(line[:-1]).hexdigest()
        codes[i], counts[i] = code[bounds[k] : bounds[k + 1]], times[bounds[k] : bounds[k + 1]].astype(np.int32)
        begin, links = stop, here
    return out | {"codes": codes, "times": counts}


def _slabs(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    low, held = 0, 0
    for i, text in enumerate(texts):
        if i > low and held + len(text) > most:
            yield low, i
            low, held = i, 0
        held += len(text)
    if low < len(texts):
        yield low, len(texts)


def aligned(documents: DataFrame, key: str = "doc_id", folder: str = TOKENIZERS, first: str = FIRST_FILE, second: str = SECOND_FILE,
            slab_bytes: int = SLAB_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(_key as text, n_a, n_b, n_groups, groups_sha256, codes, times, block) of each row; a block is a run of rows of one task of
    about `block_bytes`. Texts are encoded whole, in slabs of about `slab_bytes` (one longer text is a slab of its own)."""
    paths = f"{folder}/{first}", f"{folder}/{second}"
    out_schema = ("n_a long, n_b long, n_groups long, groups_sha256 string, codes array<long>, times array<int>, block long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(paths[0]), piece_level(paths[1])
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for low, high in _slabs(texts, slab_bytes):
                held += sum(map(len, texts[low:high]))
                got = align_texts(a, b, texts[low:high])
                offsets = np.cumsum([0, *map(len, got["codes"])], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low), *[pa.array(got[c], pa.int64()) for c in ("n_a", "n_b", "n_groups")],
                        pa.array(got["groups_sha256"], pa.string()),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(got["codes"]), pa.int64())),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(got["times"]), pa.int32())),
                        pa.array(np.full(high - low, block), pa.int64()),
                    ],
                    names=["_key", "n_a", "n_b", "n_groups", "groups_sha256", "codes", "times", "block"],
                )
                if held >= block_bytes:
                    block, held = block + 1, 0

    rows = small_batches(documents).select(F.col(key).cast("string").alias("_key"), text_of("text").alias("_text"))
    return rows.mapInArrow(work, f"_key string, {out_schema}")


def pair_counts(rows: DataFrame, n_second: int) -> DataFrame:
    """(code, count, best): links of each id pair in all rows, and whether no pair of its B id has more."""
    counts = rows.select(F.explode(F.arrays_zip("codes", "times")).alias("p")).groupBy(F.col("p.codes").alias("code"))
    counts = stored(counts.agg(F.sum(F.col("p.times").cast("long")).alias("count")), "pair-counts")
    highest = counts.groupBy((F.col("code") % n_second).alias("b")).agg(F.max("count").alias("highest"))
    both = counts.join(highest, F.col("code") % n_second == F.col("b"))
    return both.select("code", "count", (F.col("count") == F.col("highest")).alias("best"))


def align(documents: DataFrame, key: str = "doc_id", folder: str = TOKENIZERS, first: str = FIRST_FILE, second: str = SECOND_FILE,
          slab_bytes: int = SLAB_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Token alignment of every row: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Space + text is encoded by `first` (byte level), text by `second` (pieces, which adds the space). Common byte ends cut the
    tokens into groups; as no token is empty, one link ends each group. Pair counts are taken over all rows and come back by
    block: each block asks once for each of its pairs, so what is shuffled is the blocks' vocabularies, and a frequent pair costs
    a row per block. Null and empty texts, and texts that either tokenizer does not give back byte by byte, have zeros and ''.
    Repeated rows count each; other columns are not looked at; an empty table gives no row.
    """
    rows = stored(aligned(documents, key, folder, first, second, slab_bytes, block_bytes), "aligned")
    counts = pair_counts(rows, len(piece_level(f"{folder}/{second}").pieces))
    asked = rows.select(F.col("block").alias("of"), F.explode("codes").alias("code")).distinct()
    answers = asked.join(counts, "code").select("of", "code", "count", "best")

    def sums(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("code")
        code, count, best = (found[c].to_numpy() for c in ("code", "count", "best"))
        n_best, total = [], []
        for mine, times in zip(docs["codes"], docs["times"]):
            at = np.searchsorted(code, mine)
            n_best.append(int(times[best[at]].sum()) if len(mine) else 0)
            total.append(int((times * count[at]).sum()) if len(mine) else 0)
        out = docs[["_key", "n_a", "n_b", "n_groups"]].assign(n_links=docs["n_groups"], n_best=n_best, count_sum=total)
        return out.assign(groups_sha256=docs["groups_sha256"])

    schema = "_key string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    done = rows.groupBy("block").cogroup(answers.groupBy("of")).applyInPandas(sums, schema)
    return done.select(F.col("_key").cast(documents.schema[key].dataType).alias(key), *done.columns[1:])
