"""Token alignment against plain loops over the ends of both tokenizers."""

import collections
import hashlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from saltcellar.llm import alignment
from saltcellar.llm.shared import table

A, B = (f"{alignment.TOKENIZERS}/{f}" for f in (alignment.FIRST_FILE, alignment.SECOND_FILE))


def _expected(rows):
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    bytes_of = alignment.byte_level_alphabet()
    held, counts = [], collections.Counter()
    for key, text in rows:
        if not text:
            held.append((key, [], [], [], []))
            continue
        ids_a, ids_b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        tokens_a = [bytes(bytes_of[c] for c in first.id_to_token(i)) for i in ids_a]
        tokens_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = (" " + text).encode()
        if b"".join(tokens_a) != whole or b"".join(tokens_b) != whole:
            held.append((key, [], [], [], []))
            continue
        ends_a, ends_b, at = {}, {}, 0
        for n, t in enumerate(tokens_a):
            at += len(t)
            ends_a[at] = n
        at = 0
        for n, t in enumerate(tokens_b):
            at += len(t)
            ends_b[at] = n
        links = [(ends_a[e], ends_b[e]) for e in sorted(set(ends_a) & set(ends_b))]
        groups, i, j = [], 0, 0
        for x, y in links:
            groups.append(",".join(map(str, ids_a[i : x + 1])) + "|" + ",".join(map(str, ids_b[j : y + 1])))
            i, j = x + 1, y + 1
        pairs = [(ids_a[x], ids_b[y]) for x, y in links]
        counts.update(pairs)
        held.append((key, ids_a, ids_b, groups, pairs))
    best = collections.defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for key, ids_a, ids_b, groups, pairs in held:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if ids_a else ""
        n_best = sum(counts[p] == best[p[1]] for p in pairs)
        out.append((key, len(ids_a), len(ids_b), len(groups), len(pairs), n_best, sum(counts[p] for p in pairs), digest))
    return sorted(out, key=str)


def _got(frame):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted([tuple(r[n] for n in names) for r in frame.collect()], key=str)


def test_sample_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = _expected(rows)
    assert _got(alignment.align(docs)) == want
    assert _got(alignment.align(docs.repartition(3), slab_bytes=5000, block_bytes=9000)) == want


def test_awkward_rows(spark, awkward, nothing):
    odd = ["a\0b", "▁x and ▁", "</s><s> <unk> <|endoftext|>", "  two\t\n", "é́ ﬁ ﻿", " ", "😀" * 300, "x" * 5000, " " * 3000, "日本語 текст"]
    more = spark.createDataFrame([(2**60 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    docs = awkward.withColumns({"codes": F.lit(1), "block": F.lit("b"), "_key": F.lit(0), "n_a": F.lit(None)}).unionByName(more, allowMissingColumns=True)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert _got(alignment.align(docs)) == _expected(rows)
    assert alignment.align(nothing).collect() == []


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1000])
def test_pieces_of_any_size(piece):
    r = np.random.default_rng(piece)
    for _ in range(60):
        a, b = (np.unique(r.integers(0, 60, r.integers(0, 50))) for _ in range(2))
        i, j = alignment.common_ends(a, b, piece)
        assert a[i].tolist() == b[j].tolist() == sorted(set(a) & set(b))


def test_diagonals_split_the_merge():
    a, b = np.array([1, 4, 4, 9]), np.array([0, 4, 5, 10, 11])
    merged = sorted([(v, 0) for v in a] + [(v, 1) for v in b])
    for d in range(10):
        assert alignment.crossings(a, b, np.array([d]))[0] == sum(side == 0 for _, side in merged[:d])


def test_files_of_other_kinds_use_the_library(tmp_path):
    """A tokenizer whose merges do not rank as its ids is not encoded by ranks."""
    import json

    spec = json.loads(open(A, encoding="utf-8").read())
    spec["model"]["merges"][0], spec["model"]["merges"][1] = spec["model"]["merges"][1], spec["model"]["merges"][0]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    text = " the tall tower, 12 é"
    assert alignment.byte_level(str(path)).encode([text])[0] == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids
    assert alignment.byte_level(A).encode([text])[0] == Tokenizer.from_file(A).encode(text, add_special_tokens=False).ids
