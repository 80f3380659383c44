"""Density topics against plain loops, and their words."""

import collections
import hashlib
import math
import random
import time

import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from saltcellar.operators import tagging, terms, topics
from saltcellar.session import settle, stored


def _terms(text):
    stop = StopWordsRemover.loadDefaultStopWords("english")
    words = [w for w in text.lower().split() if len(w) > 1 and w not in stop]
    return collections.Counter(" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))


def _clusters(captions, k=topics.NEIGHBOURS, least=topics.LEAST_SIZE):
    """Sets of caption numbers by all pairs and union-find."""
    found = [_terms(c) for c in captions]
    df = collections.Counter(t for f in found for t in f)
    vectors = []
    for f in found:
        heavy = sorted(((tf * (math.log((len(captions) + 1) / (df[t] + 1)) + 1), t) for t, tf in f.items() if df[t] >= 2), key=lambda e: (-e[0], e[1]))
        heavy = heavy[: topics.VECTOR_TERMS]
        norm = math.sqrt(sum(w * w for w, _ in heavy))
        vectors.append({t: round(w / norm, 9) for w, t in heavy})

    def distance(a, b):
        cosine = sum(w * b.get(t, 0) for t, w in a.items())
        return max(round((1 - cosine) * 1000), 0) / 1000 if cosine >= topics.LEAST_SIMILARITY else None

    names = [i for i, v in enumerate(vectors) if v]
    far = {(i, j): 0.0 if vectors[i] == vectors[j] else distance(vectors[i], vectors[j]) for i in names for j in names}
    core = {}
    for i in names:
        near = sorted(d for j in names if (d := far[i, j]) is not None)
        if len(near) >= k:
            core[i] = near[k - 1]
    # The median goes over different vectors.
    different = {str(sorted(vectors[i].items())): core[i] for i in core}
    ordered = sorted(different.values())
    if not ordered:
        return []
    reach = ordered[math.ceil(len(ordered) / 2) - 1]
    root = {i: i for i in core if core[i] <= reach}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in root:
        for j in root:
            if far[i, j] is not None and max(far[i, j], core[i], core[j]) <= reach:
                root[find(i)] = find(j)
    groups = collections.defaultdict(set)
    for i in root:
        groups[find(i)].add(i)
    return sorted((sorted(g) for g in groups.values() if len(g) >= least), key=lambda g: (-len(g), g))


def _captions(n=150, seed=3):
    r = random.Random(seed)
    themes = [[f"{t}{i}" for i in range(12)] for t in ("soup", "party", "sale", "walk")]
    out = [" ".join(r.choice(t) for _ in range(r.randint(4, 9))) for t in themes for _ in range(n // 6)]
    return out + [" ".join(f"x{r.randrange(400)}" for _ in range(6)) for _ in range(n // 6)] + ["soup1 soup2 soup3"] * 7


@pytest.mark.parametrize("seed", [3, 8])
def test_topics_equal_plain_clusters(spark, seed):
    captions = _captions(seed=seed)
    rows = spark.createDataFrame([(c,) for c in captions], "text string").groupBy("text").agg(F.count("*").alias("copies"))
    found, _ = topics.caption_topics(rows)
    of = {r["text"]: r["topic"] for r in found.collect()}
    groups = collections.defaultdict(list)
    for i, c in enumerate(captions):
        topic = of.get(hashlib.md5(c.encode()).hexdigest())
        if topic is not None:
            groups[topic].append(i)
    want = _clusters(captions)
    assert len(want) >= 2 and sorted(map(sorted, groups.values()), key=lambda g: (-len(g), g)) == want
    assert sorted(groups) == list(range(len(groups))) and [len(groups[t]) for t in sorted(groups)] == sorted(map(len, groups.values()), reverse=True)


def test_forest_equals_plain_kruskal(spark):
    r = random.Random(5)
    edges = {}
    for _ in range(300):
        a, b = sorted(r.sample(range(90), 2))
        edges[f"n{a:02d}", f"n{b:02d}"] = r.randrange(20) / 20
    frame = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a string, b string, weight double")
    labels, forest = topics.spanning_forest(frame)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    want = set()
    for w, a, b in sorted((w, a, b) for (a, b), w in edges.items()):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.add((a, b, w))
    assert {tuple(x) for x in forest.collect()} == want
    got = {x["node"]: x["root"] for x in labels.collect()}
    assert len(got) == len({a for e in edges for a in e}) and all((got[a] == got[b]) == (find(a) == find(b)) for a in got for b in got)
    labels, forest = topics.spanning_forest(frame.limit(0))
    assert labels.collect() == [] and forest.collect() == []


def test_topic_table_lists_words_and_what_is_left_out(spark, rows):
    captions = ["dumpling noodle pork dumplings"] * 6 + ["holiday festival community event #sale"] * 6 + ["#only #tags", None, "free coupon xyz"]
    df = spark.createDataFrame([("a", str(n), c) for n, c in enumerate(captions)], "account_id string, media_id string, caption string")
    got = {r["topic"]: r for r in rows(tagging.topic_table(df))}
    assert got[None]["size"] == 3 and got[None]["words"] == "" and got[None]["category"] is None
    assert {(r["category"], r["size"]) for t, r in got.items() if t is not None} == {("product_topic", 6), ("event_topic", 6)}
    assert all(len(r["words"].split(", ")) == 5 for t, r in got.items() if t is not None)
    few = rows(tagging.topic_table(df.limit(3)))
    assert [(r["topic"], r["size"]) for r in few] == [(None, 3)]


def test_topic_terms_by_hand(spark, rows):
    terms = spark.createDataFrame([("a", 2, "x", 3), ("a", 2, "y", 1), ("b", 1, "x", 2), ("c", 1, "z", 9)], "text string, copies long, term string, tf long")
    assigned = spark.createDataFrame([("a", 0), ("b", 1)], "text string, topic int")
    got = {(r["topic"], r["term"]): r["weight"] for r in rows(topics.topic_terms(assigned, terms))}
    mean = (8 + 2) / 2
    assert got == pytest.approx({(0, "x"): 6 / 8 * math.log(1 + mean / 8), (0, "y"): 2 / 8 * math.log(1 + mean / 2), (1, "x"): 1 * math.log(1 + mean / 8)})


def _unit(r, size=6):
    found = {f"t{r.randrange(40)}": r.random() + 0.1 for _ in range(size)}
    norm = math.sqrt(sum(w * w for w in found.values()))
    return {t: round(w / norm, 9) for t, w in found.items()}


@pytest.mark.parametrize("block", [40, 1000])
def test_blocks_give_all_cores_and_the_forest_of_all_pairs(spark, block):
    r = random.Random(4)
    vectors = {f"n{i:03d}": _unit(r) for i in range(120)} | {"alone": {"only here": 1.0}}
    copies = {k: r.choice([1, 1, 1, 2, 4]) for k in vectors}
    frame = spark.createDataFrame([(k, copies[k], sorted(v.items())) for k, v in vectors.items()], "node string, n long, vector array<struct<term:string,weight:double>>")
    nodes = topics.coded(frame)
    far = {}
    for a in vectors:
        for b in vectors:
            cosine = sum(w * vectors[b].get(t, 0) for t, w in vectors[a].items())
            if a < b and cosine >= topics.LEAST_SIMILARITY:
                far[a, b] = max(math.floor((1 - cosine) * topics.GRID + 0.5), 0) / topics.GRID
    want = {}
    for k in vectors:
        near = sorted([(0.0, copies[k])] + [(d, copies[b if a == k else a]) for (a, b), d in far.items() if k in (a, b)])
        reached = [d for i, (d, _) in enumerate(near) if sum(n for _, n in near[: i + 1]) >= topics.NEIGHBOURS]
        want |= {k: reached[0]} if reached else {}
    cores = topics.core_distances(nodes, topics.near_counts(nodes, block=block))
    assert {x["node"]: x["core"] for x in cores.collect()} == want
    edges = topics.near_edges(nodes.join(cores, "node"), 0.6, block=block)
    plain = [(a, b, w) for (a, b), d in far.items() if a in want and b in want and (w := max(d, want[a], want[b])) <= 0.6]
    _, forest = topics.spanning_forest(edges)
    _, whole = topics.spanning_forest(spark.createDataFrame(plain, "a string, b string, weight double"))
    assert len(plain) > 100 and {tuple(x) for x in forest.collect()} == {tuple(x) for x in whole.collect()}


def test_terms_are_counted_where_their_text_is_cut(spark, rows):
    texts = spark.createDataFrame([("one two three", 2), ("two three two three", 1), ("alone", 1)], "text string, copies long")
    table = topics.term_table(texts, [])
    of = lambda text: hashlib.md5(text.encode()).hexdigest()
    first, second = of("one two three"), of("two three two three")
    want = {(first, t): (1, 2) for t in ("one", "one two", "one two three")} | {(first, t): (1, 3) for t in ("two", "three", "two three")}
    want |= {(second, t): (2, 3) for t in ("two", "three", "two three")}
    assert {(r["text"], r["term"]): (r["tf"], r["df"]) for r in rows(table)} == want
    # One exchange deals out the words, none the terms with their text, before the join by term.
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan.split("Generate")[0] and "slice" not in plan


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


@pytest.mark.parametrize("keep", [settle, lambda df: stored(df, "kept")])
def test_what_is_stored_leaves_no_shuffle_files(spark, keep):
    before = _shuffle_files(spark)
    sums = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("v"))
    kept = keep(sums)
    assert kept.columns == ["k", "v"]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    for _ in range(40):  # files go a moment later
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.25)
    assert not _shuffle_files(spark) - before
    assert kept.count() == 7 and sums.count() == 7


def _texts(seed=11, n=60):
    r = random.Random(seed)
    return [(" ".join([*(r.choice(["aa", "bb", "cc", "dd", f"x{r.randrange(99)}"]) for _ in range(r.randrange(0, 12))), f"u{i}"]), r.choice([1, 1, 2])) for i in range(n)]


def _plain(texts):
    found = {hashlib.md5(t.encode()).hexdigest(): (n, collections.Counter(" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))) for t, n in texts for w in [t.split()]}
    df = collections.Counter()
    for n, terms_of in found.values():
        df.update({t: n for t in terms_of})
    return {h: (n, {t: (tf, df[t]) for t, tf in terms_of.items() if df[t] >= 2}) for h, (n, terms_of) in found.items()}


@pytest.mark.parametrize("sizes", [(20, 30, 10), (10_000, 1000, 1000)])
def test_terms_of_many_blocks_and_parts(spark, sizes):
    texts = _texts()
    cut = spark.createDataFrame([(hashlib.md5(t.encode()).hexdigest(), n, t) for t, n in texts] + [("none", 1, "")], "text string, copies long, words string")
    counted = terms.count_terms(cut.repartition(3), *sizes)
    want = _plain(texts)
    parted = terms.parted_lists(counted)
    assert counted.n_texts == sum(n for _, n in texts) + 1 and parted.schema["part"].metadata["parts"] == len(counted.answers)
    got, seen = collections.defaultdict(dict), set()
    for row in parted.collect():
        terms_of = {e["term"]: (e["tf"], e["df"]) for e in row["terms"]}
        assert row["copies"] == want[row["text"]][0] and not terms_of.keys() & got[row["text"]].keys()
        got[row["text"]] |= terms_of
        seen |= {(t, row["part"]) for t in terms_of}
    assert got == {h: found for h, (_, found) in want.items() if found}
    assert len(seen) == len({t for t, _ in seen})  # a term is in one part
    for row in terms.term_lists(counted, heaviest=3).collect():
        weight = {t: tf * (math.log((counted.n_texts + 1) / (df + 1)) + 1) for t, (tf, df) in want[row["text"]][1].items()}
        least = sorted(weight.values(), reverse=True)[:3][-1]
        assert {e["term"] for e in row["terms"]} == {t for t, w in weight.items() if w >= least - 1e-9}


def test_topic_terms_of_lists_equal_those_of_rows(spark, rows):
    texts = spark.createDataFrame(_texts(), "text string, copies long")
    assigned = texts.select(F.md5("text").alias("text"), (F.length("text") % 3).alias("topic")).filter("topic > 0")
    plain = {(r["topic"], r["term"]): r["weight"] for r in rows(topics.topic_terms(assigned, topics.term_table(texts, [])))}
    lists = {(r["topic"], r["term"]): r["weight"] for r in rows(topics.topic_terms(assigned, topics.term_table(texts, [], lists=True)))}
    assert len(plain) > 30 and lists == pytest.approx(plain)
