"""Ranked search against scoring every document for every item."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from saltcellar.llm import ranking
from saltcellar.llm.shared import table

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def _terms(text):
    return collections.Counter(PATTERN.findall((text or "").translate(LOWER)))


def _expected(docs, items, top=20):
    """(item_id, rank, doc_id, score); doc ids of equal scores in order, nulls first."""
    cut = [(key, _terms(text)) for key, text in docs]
    total = sum(1 for _, t in cut if t)
    words = sum(sum(t.values()) for _, t in cut)
    df = collections.Counter(term for _, t in cut for term in t)
    out = []
    for item, text in items:
        asked = _terms(text)
        weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) for t in asked if df[t]}
        scored = []
        for key, t in cut:
            if t:
                m = 100 - 25 + (25 * sum(t.values()) * total) // words
                score = sum(n * weight[w] * ((10**9 * t[w]) // (1000 * t[w] + 12 * m)) for w, n in asked.items() if w in t)
                if score > 0:
                    scored.append((-score, key is not None, key or 0, key))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:top], 1)]
    return sorted(out, key=str)


def _got(frame):
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect()], key=str)


def _frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_sample_documents(spark, monkeypatch):
    docs, items = (table(spark, "/root/testdata/sf0.001", n) for n in ("documents", "benchmark"))
    want = _expected([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert _got(ranking.search(docs, items)) == want
    monkeypatch.setattr(ranking, "SEED_ROWS", 5)
    assert _got(ranking.search(docs.repartition(5), items, group_terms=100, block_rows=3)) == want


def test_many_copies_and_frequent_words(spark):
    r = random.Random(2)
    word = lambda: f"w{min(int(r.expovariate(0.05)), 200)}"
    base = " ".join(word() for _ in range(40))
    docs = [(i, base + (f" {word()}" if i % 3 else "")) for i in range(300)] + [(1000 + i, " ".join(word() for _ in range(r.randint(1, 60)))) for i in range(400)]
    items = [(i, " ".join(word() for _ in range(r.randint(1, 25)))) for i in range(25)] + [(99, "w0 w1 w2"), (100, "w0"), (101, "unknown")]
    assert _got(ranking.search(*_frames(spark, docs, items), top=7)) == _expected(docs, items, 7)


def test_awkward_rows(spark, awkward, nothing):
    items = [(1, "word0 word7 Word14 ONE two"), (2, None), (None, "Ünïcode w5x5 tail"), (3, ""), (3, "one"), (3, "one"), (4, "~ , .")]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumns({"row": F.lit("x"), "item": F.lit(1), "rank": F.lit(2)})
    docs = awkward.withColumns({"row": F.lit(1), "score": F.lit("s"), "term": F.lit(3), "block": F.lit(4), "_key": F.lit(5)})
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert _got(ranking.search(docs, frame)) == _expected(rows, items)
    assert ranking.search(nothing, frame).collect() == []
    assert ranking.search(docs, frame.limit(0)).collect() == []


def test_blocks_bound_their_rows_and_some_are_skipped(spark):
    docs, items = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "benchmark"))
    wanted = ranking.vectors(items, "item_id", None, "t-items")
    rows = ranking.vectors(docs, "doc_id", ranking.term_filter(wanted.select(F.explode("codes").alias("term"))), "t-rows")
    n, words = rows.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    totals = ranking.Totals(n, words)
    asked = ranking.weighed_items(wanted, rows, totals)
    needed = ranking.needed_lists(asked, ranking.first_bounds(rows, asked, totals, 20))
    cut = ranking.blocks(rows, totals, ranking._lists(asked, needed), 4)
    each = cut.select("block", F.explode("rows").alias("row")).join(ranking.postings(rows, totals, "row"), "row")
    peak = cut.select("block", F.explode(F.arrays_zip("coordinates", "maxima")).alias("c")).select("block", F.col("c.coordinates").alias("term"), "c.maxima")
    best = each.groupBy("block", "term").agg(F.max("impact").alias("best"))
    assert peak.join(best, ["block", "term"]).filter("best <> maxima").count() == 0 and peak.join(best, ["block", "term"]).count() == peak.count()
    all_pairs = cut.join(needed, "term").select("item", F.explode("rows").alias("row")).distinct().count()
    assert 0 < ranking.surviving_pairs(cut, asked, needed).count() < 0.5 * all_pairs


@pytest.mark.parametrize("n", [0, 5, 32, 33, 500])
def test_clusters_are_small_and_alike(n):
    r = np.random.default_rng(n)
    centres = np.eye(16)[r.integers(0, 4, n)] if n else np.empty((0, 16))
    block = ranking.cluster(centres, 32)
    assert len(block) == n and (np.bincount(block) <= 32).all() if n else True


def test_term_filter_keeps_all_terms(spark):
    terms = spark.range(5000).select(F.xxhash64("id").alias("term")).union(spark.createDataFrame([(0,), (-1,), (2**24 - 1,)], "term long"))
    bits = np.frombuffer(ranking.term_filter(terms), np.uint8)
    place = np.array([t["term"] for t in terms.collect()]) & ((1 << ranking.FILTER_BITS) - 1)
    assert ((bits[place >> 3] >> (place & 7)) & 1).all() and np.unpackbits(bits).sum() == len(np.unique(place))
