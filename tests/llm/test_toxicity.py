"""The factorization machine against pairwise sums, differences and held-out labels."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from saltcellar.llm import toxicity
from saltcellar.llm.shared import table


def _machine(seed=1, n=30):
    r = np.random.default_rng(seed)
    return r.normal(0, 0.5, (n, 1 + toxicity.FACTORS)), 0.3, r.uniform(0.1, 1, n), [np.sort(r.choice(n, k, replace=False)) for k in (0, 1, 5, 12, 3)]


def _margin(weights, offset, values, row):
    linear = sum(weights[i, 0] * values[i] for i in row)
    return offset + linear + sum(weights[i, 1:] @ weights[j, 1:] * values[i] * values[j] for i, j in itertools.combinations(row, 2))


def test_margins_equal_sums_over_pairs():
    weights, offset, values, rows = _machine()
    got = toxicity.margins(weights, offset, values, rows)[0]
    assert np.allclose(got, [_margin(weights, offset, values, r) for r in rows])


def test_gradients_equal_differences():
    weights, offset, values, rows = _machine()
    labels = np.array([1.0, 0, 1, 0, 1])

    def loss(w, b):
        s = toxicity.sigmoid(np.array([_margin(w, b, values, r) for r in rows]))
        return -np.sum(labels * np.log(s) + (1 - labels) * np.log(1 - s))

    seen, grad, to_offset = toxicity.gradients(weights, offset, values, rows, labels)
    assert seen.tolist() == sorted({int(i) for r in rows for i in r})
    for k, f in itertools.product(range(0, len(seen), 3), range(weights.shape[1])):
        up, down = weights.copy(), weights.copy()
        up[seen[k], f] += 1e-5
        down[seen[k], f] -= 1e-5
        assert np.isclose((loss(up, offset) - loss(down, offset)) / 2e-5, grad[k, f], rtol=1e-4, atol=1e-8)
    assert np.isclose((loss(weights, offset + 1e-5) - loss(weights, offset - 1e-5)) / 2e-5, to_offset, rtol=1e-4)


def test_pairs_decide_where_single_terms_cannot(spark):
    """A word is harmful with one group of words and harmless with another: no sum of single weights tells them apart."""
    r = random.Random(4)
    rows = []
    for i in range(1200):
        insult, group = r.random() < 0.5, r.random() < 0.5
        words = [f"filler{r.randrange(40)}" for _ in range(8)] + ["vermin" if insult else "kitten", "people" if group else "garden"]
        r.shuffle(words)
        rows.append((i, " ".join(words), int(insult == group)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.classify(docs, docs.select("doc_id", "toxic")).join(docs.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    assert len(got) > 200 and sum(x["predicted"] == x["toxic"] for x in got) >= 0.95 * len(got)


def test_held_out_rows(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    got = toxicity.classify(docs, labels).join(labels, "doc_id").collect()
    judged = [x for x in got if x["held_out"]]
    assert {x["doc_id"] for x in judged} == {x["doc_id"] for x in got if zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2}
    toxic = [x for x in judged if x["toxic"]]
    assert sum(x["predicted"] for x in toxic) >= 0.85 * len(toxic)
    assert sum(x["predicted"] for x in judged if not x["toxic"]) <= 0.01 * (len(judged) - len(toxic))


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (5, None), (None, 1), (6, 0), (99, 1)], "doc_id long, toxic int")
    docs = awkward.withColumns({"score": F.lit("x"), "row": F.lit(1), "mark": F.lit(2), "_key": F.lit(3), "bucket": F.lit(4)})
    got = toxicity.classify(docs, labels).collect()
    assert sorted(str(x["doc_id"]) for x in got) == sorted(str(x["doc_id"]) for x in awkward.collect())
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.3) for x in got)
    assert toxicity.classify(nothing, labels).collect() == []
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {x["score"] for x in toxicity.classify(awkward, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert {round(x["score"], 9) for x in toxicity.classify(awkward, one).collect()} == {0.99}


def test_fit_is_bounded_and_order_free(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    one, two = (toxicity.fit(d, labels, rows=120) for d in (docs, docs.repartition(7)))
    assert toxicity.sample_rows(docs.union(docs), labels, "doc_id", "toxic", 120).count() == 120
    assert np.array_equal(one.buckets, two.buckets) and np.allclose(one.weights, two.weights)
    assert toxicity.text_buckets("") == [] and one.scores([""]) == pytest.approx(toxicity.sigmoid(np.array([one.offset])))
