"""Merged day bitmaps against plain sets."""

import random

from pyspark.sql import functions as F

from saltcellar.operators import distinct


def _rows(n=3000, seed=1):
    r = random.Random(seed)
    return [(f"s{r.randrange(3)}", f"202601{r.randint(1, 28):02d}", r.choice([None, *(f"o{r.randrange(900)}" for _ in range(9))]), f"c{r.randrange(200)}") for _ in range(n)]


def test_any_window_equals_sets(spark, rows, tmp_path):
    data = _rows()
    frame = spark.createDataFrame(data, "location_id string, business_date string, order_guid string, customer_id string")
    keys = {name: distinct.number_keys(frame, key) for name, key in (("orders", "order_guid"), ("customers", "customer_id"))}
    for numbered, column in zip(keys.values(), (2, 3)):
        numbers = [r["number"] for r in numbered.collect()]
        assert len(numbers) == len(set(numbers)) == len({d[column] for d in data} - {None})
    path = str(tmp_path / "days")
    distinct.day_bitmaps(frame, keys).write.parquet(path)
    days = spark.read.parquet(path)
    for places, start, end in ((None, None, None), (["s1"], "20260103", "20260109"), (["s0", "s2"], "20260110", None), (None, "20260301", None)):
        inside = [d for d in data if (places is None or d[0] in places) and (start or "") <= d[1] <= (end or "9")]
        want = {"orders": len({d[2] for d in inside} - {None}), "customers": len({d[3] for d in inside})}
        got = distinct.merged_counts(days, places, start, end)
        assert {r["measure"]: r["distinct"] for r in rows(got)} == {k: v for k, v in want.items() if v}
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("FileScan parquet") == 1 and "order_guid" not in plan
    by = distinct.merged_counts(days, by=["location_id"]).filter("measure = 'orders'")
    assert {r["location_id"]: r["distinct"] for r in rows(by)} == {p: len({d[2] for d in data if d[0] == p} - {None}) for p in ("s0", "s1", "s2")}


def test_many_buckets_and_no_rows(spark, rows):
    frame = spark.range(100_000).select(F.lit("s").alias("location_id"), F.concat(F.lit("202601"), F.lpad((F.col("id") % 9 + 1).cast("string"), 2, "0")).alias("business_date"),
                                        (F.col("id") % 70_000).cast("string").alias("order_guid"))
    days = distinct.day_bitmaps(frame, {"orders": distinct.number_keys(frame, "order_guid")})
    assert rows(distinct.merged_counts(days))[0]["distinct"] == 70_000
    nothing = frame.limit(0)
    assert rows(distinct.merged_counts(distinct.day_bitmaps(nothing, {"orders": distinct.number_keys(nothing, "order_guid")}))) == []
