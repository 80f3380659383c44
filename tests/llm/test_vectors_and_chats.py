"""Embeddings, reply trees, links and the pipeline against plain Python."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check_queries import TABLES, _rows
from saltcellar.llm import chat, embeddings, queries
from saltcellar.llm.components import components
from saltcellar.llm.shared import table

SMALL = "/root/testdata/sf0.001"


def test_near_vectors_by_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(300, 24))
    rows = [base[i] for i in range(300)] + [base[0] + 0.05 * r.normal(size=24) for _ in range(650)] + [base[i % 300] * 3 + 0.4 * r.normal(size=24) for i in range(300)]
    table_ = np.array(rows)
    unit = table_ / np.linalg.norm(table_, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(table_)], "vec_id long, embedding array<double>")
    got = {x["vec_id"]: x for x in embeddings.near_vectors(frame).collect()}
    links = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (links <= linked.sum(axis=1)).all() and links.sum() >= 0.98 * linked.sum()
    root = np.arange(len(rows))
    for _ in range(20):
        root = np.array([min(root[i], root[linked[i]].min(initial=root[i])) for i in range(len(rows))])
    assert np.mean([got[i]["component_id"] == root[i] for i in range(len(rows))]) > 0.99


def test_awkward_vectors(spark):
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, None, 1), (4, [0.0, 0.0], 1), (5, [1.0, None], 1), (6, [float("nan"), 1.0], 1),
        (7, [float("inf"), 1.0], 1), (None, [1.0, 0.0], 1), (8, [1.0, 0.0, 0.0], 1), (9, [], 1), (10, [0.0, -1.0], None),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int").withColumn("links", F.lit(1))
    got = {(x["vec_id"], x["n_links"]): x["component_id"] for x in embeddings.near_vectors(frame).collect()}
    assert len(embeddings.near_vectors(frame).collect()) == 12
    assert got[(1, 3)] == 1 and got[(2, 3)] == 1 and got[(None, 3)] == 1
    assert all(got[(i, 0)] == i for i in range(3, 11))
    assert embeddings.near_vectors(frame.limit(0)).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (150, 200), (7, 7), (300, 100)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def _nodes(spark, rows):
    return spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")


def test_best_branches(spark):
    rows = [
        (1, 1, None, 0.0, "user", "q"), (1, 2, 1, 1.0, "assistant", "good"), (1, 3, 1, 5.0, "assistant", "better"), (1, 4, 3, None, "user", "but"),
        (1, 5, 2, 9.0, "user", "thanks"), (2, 1, 99, 0.0, None, None), (3, 1, 2, 0.0, "user", "circle"), (3, 2, 1, 0.0, "user", "circle"),
    ]
    got = chat.format_trees(_nodes(spark, rows), most=None).collect()
    paths = {(r["tree"], r["rank"]): [t for _, t in chat.read_back(r["formatted"])] for r in got}
    assert paths == {(1, 1): ["q", "good", "thanks"], (1, 2): ["q", "better", "but"], (2, 1): [""]}
    learned = {(r["tree"], r["rank"]): [r["formatted"][a["start"] : a["end"]] for a in r["loss"]] for r in got}
    assert learned[(1, 1)] == ["good"] and learned[(2, 1)] == []
    assert {(r["tree"], r["rank"]) for r in chat.format_trees(_nodes(spark, rows)).collect()} == {(1, 1), (2, 1)}


def test_texts_come_back(spark):
    texts = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "~0~1~", "", "<", "<<SYS>>~n", "😀\n\n", None, "x" * 300_000, "a<|im_end|>", "\r\n~7"]
    rows = [(i % 2, i // 2, ("assistant", "user", "odd\nrole ~n", None)[i % 4], t) for i, t in enumerate(texts)] + [(5, None, "user", "first"), (5, 0, "user", "b"), (5, 0, "user", "b")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("score", F.lit("clash"))
    got = {r["tree"]["id"]: r for r in chat.format_trees(chat.threads(frame)).collect()}
    for conv in (0, 1, 5):
        want = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert chat.read_back(got[conv]["formatted"]) == [w[1:] for w in want]
    assert chat.digests(chat.format_trees(chat.threads(frame.limit(0)))).collect() == []


def test_long_thread(spark):
    frame = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(700)], "conv_id long, turn long, role string, text string")
    row = chat.digests(chat.format_trees(chat.threads(frame))).first()
    assert row["n_turns"] == 700 and row["loss_chars"] == sum(len(f"t{i}") for i in range(0, 700, 2))


def test_a_round_of_jumps_is_one_query(spark):
    """Open ends and nodes are counted by the writes: a chain of 16 replies takes five tables up and four down."""
    nodes = _nodes(spark, [(1, i, i - 1 if i else None, 0.0, "user", f"t{i}") for i in range(16)])
    log = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = log.executionsCount()
    path = chat.branches(nodes)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert log.executionsCount() - before <= 9
    assert [r["depth"] for r in path.orderBy("node").collect()] == list(range(1, 17))
    assert chat.branches(nodes.limit(0)).collect() == []


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    frame = queries.QUERIES[name](spark, SMALL)
    got = [tuple(r) for r in frame.collect()]
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    result = db.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert _rows(frame.columns, got) == _rows(names, result.fetchall())


def test_pipeline_stages(spark):
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SMALL)
        assert after.columns == columns
        kept = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert kept and kept <= {r["doc_id"] for r in before.select("doc_id").collect()}
        before = after
    run = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(run) <= {r["doc_id"] for r in before.collect()}
    assert all(1 <= r["copies"] <= 3 for r in run.values())
