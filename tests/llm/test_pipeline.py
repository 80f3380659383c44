"""The pipeline against plain Python, stage after stage."""

import collections
import hashlib
import random

import corpus_pipeline
from pyspark.sql import functions as F

from saltcellar.llm import decontaminate, linededup, quality
from saltcellar.llm.shared import table
from tests.llm.test_documents import _distance, _jaccard_truth


def _tables(spark, folder):
    r = random.Random(12)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(900)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    docs = [(i, "\n".join(say(r.randint(6, 14)) for _ in range(r.randint(3, 12)))) for i in range(70)]
    for i in range(8):  # near copies by lines, of which a scrap would be left
        lines = docs[5 * i][1].split("\n") * 3
        docs[5 * i] = (5 * i, "\n".join(f"{line} {k}x" for k, line in enumerate(lines)))
        copy = docs[5 * i][1].split("\n")
        copy[0], copy[-1] = say(9), say(9)
        docs.append((100 + i, "\n".join(copy)))
    docs += [(200 + i, docs[7 * i + 1][1]) for i in range(6)]  # exact copies
    docs += [(300 + i, docs[3 * i + 2][1].replace("\n", " ")) for i in range(6)]  # the same words in other lines
    items = [(i, say(30)) for i in range(3)]
    docs += [(400 + i, say(40) + "\n" + items[i][1] + "\n" + say(40)) for i in range(3)]
    docs += [(500 + i, "$$ @@ ## " * 30 + say(5)) for i in range(25)] + [(600, None), (601, ""), (602, "one"), (602, "one"), (None, say(30)), (None, say(30))]
    r.shuffle(docs)
    rows = [(i, t, "en", f"s{r.randrange(4)}", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 500), 0) for i, _ in docs if i is not None and i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def _lines(rows):
    """Repeated lines out: the first in the order of key, text hash and place stays."""
    norm = lambda line: line.strip(" ").lower()
    places = collections.defaultdict(list)
    for k, (i, h, t) in enumerate(rows):
        for p, line in enumerate(t.split("\n")):
            if len(norm(line)) >= linededup.SHORTEST:
                places[norm(line)].append(((i is not None, i or 0, h), p, k))
    first = {line: min(at)[:2] for line, at in places.items()}
    long = [(line, collections.Counter(line)) for line in first if len(line) >= linededup.SHORTEST_NEAR]
    near = set()
    for x, (a, ca) in enumerate(long):
        for b, cb in long[:x]:
            if abs(len(a) - len(b)) <= 2 and sum((ca - cb).values()) <= 2 and sum((cb - ca).values()) <= 2 and _distance(a, b) <= 2:
                near.add(a if first[a] > first[b] else b)
    out = []
    for k, (i, h, t) in enumerate(rows):
        kept = [line for p, line in enumerate(t.split("\n")) if norm(line) not in first or (first[norm(line)] == ((i is not None, i or 0, h), p) and norm(line) not in near)]
        out.append(("\n".join(kept), len(kept) < len(t.split("\n"))))
    return out


def _found(text, items):
    words = decontaminate.plain(text)
    for item in items:
        w = decontaminate.plain(item).split()
        for s in decontaminate.window_starts(len(w)):
            window = " ".join(w[s : s + decontaminate.WINDOW_WORDS])
            budget = int(len(window) * decontaminate.EDIT_SHARE)
            if decontaminate.end_distance(decontaminate._bits(window), len(window), words, budget) <= budget:
                return True
    return False


def _mix(rows):
    size = [len((t or "").split()) for _, t, *_ in rows]
    held = collections.Counter()
    for n, row in zip(size, rows):
        held[row[3]] += n
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(held))}
    left, open_, target = sum(held.values()), dict(weight), {}
    while open_:
        level = left / sum(open_.values())
        full = [s for s in open_ if 3 * held[s] <= level * open_[s]]
        if not full:
            target.update({s: level * w for s, w in open_.items()})
            break
        for s in full:
            target[s] = 3.0 * held[s]
            left -= target[s]
            del open_[s]
    out = []
    for s in held:
        mine = sorted((int(hashlib.md5("\n".join("" if v is None else str(v) for v in row).encode()).hexdigest()[:15], 16), n, row) for n, row in zip(size, rows) if row[3] == s)
        whole, rest = int(target[s] // held[s]) if held[s] else 0, 0.0
        part, more = min(target[s] - whole * held[s], held[s]), []
        for _, n, _ in mine:
            more.append(rest + n / 2 <= part if n else rest < part)
            rest += n
        out += [(row, n, min(whole + m, 3)) for m, (_, n, row) in zip(more, mine)]
    return out


def test_pipeline_by_plain_python(spark, tmp_path):
    folder = str(tmp_path)
    rows, items = _tables(spark, folder)
    docs = table(spark, folder, "documents")
    net = quality.fit(docs, table(spark, folder, "labels"))
    scores = net.scores([(t or "").encode() for _, t, *_ in rows])
    good = [row for row, s in zip(rows, scores) if s >= quality.THRESHOLD]
    got = corpus_pipeline.quality_stage(spark, docs, folder)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, good)) and 50 < len(good) < len(rows)

    hashes = {(r["doc_id"], r["text"]): r["h"] for r in docs.select("doc_id", "text", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("h")).collect()}
    cut = _lines([(row[0], hashes[row[0], row[1]], row[1] or "") for row in good])
    left = []
    for row, (text, changed) in zip(good, cut):
        if not changed:
            left.append((row[0], row[1] or "", *row[2:]))
        elif text.strip(" ") and len(text.strip(" ")) >= 0.2 * len(row[1]):
            left.append((row[0], text, *row[2:4], len(text)))
    got = corpus_pipeline.lines_stage(spark, got, folder)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, left))
    assert not {100 + i for i in range(8)} & {row[0] for row in left}  # no scraps of near copies

    keyed = [(row[0], row[1]) for row in left if row[0] is not None]
    _, group = _jaccard_truth(keyed)
    one = [row for row in left if row[0] is None or group.get(row[0], row[0]) == row[0]]
    got = corpus_pipeline.similar_stage(spark, got, folder)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, one)) and len(one) < len(left)

    clean = [row for row in one if not _found(row[1], [t for _, t in items])]
    got = corpus_pipeline.benchmark_stage(spark, got, folder)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, clean)) and len(clean) < len(one)

    mixed = sorted(str((*row, n, c, n * c)) for row, n, c in _mix(clean) if c)
    assert sorted(map(str, map(tuple, corpus_pipeline.run(spark, folder).collect()))) == mixed


def test_empty_pipeline(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, more int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
