import datetime as dt

import pytest
from pyspark.sql import functions as F

from saltcellar.operators import imports, views
from saltcellar.sources import files, sinks
from saltcellar.streaming import incremental

TODAY = dt.date(2026, 4, 11)
LOG = "location_id string, business_date string, file_type string"


def log(spark, *entries):
    return spark.createDataFrame(list(entries), LOG)


def sites(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "location_id string")


def test_sync_range(spark, rows):
    entries = log(spark, ("seen", "20260408", "API"), ("seen", "20260401", "API"), ("seen", "20260410", "CSV"), ("fresh", "20260410", "API"))
    got = rows(incremental.sync_range(sites(spark, "seen", "fresh", "new", "new"), entries, TODAY, interval_days=7), "location_id")
    assert [tuple(r.values()) for r in got] == [("new", "20260404", "20260410"), ("seen", "20260409", "20260410")]
    forced = rows(incremental.sync_range(sites(spark, "fresh"), entries, TODAY, start="20260101", end="20260102"))
    assert forced == [{"location_id": "fresh", "start_date": "20260101", "end_date": "20260102"}]
    assert rows(incremental.sync_range(sites(spark, "fresh"), entries, TODAY, start="20260501")) == []


def test_log_readers(spark, rows):
    entries = log(spark, ("a", "20260408", "API"), ("a", "20260408", "API"), ("a", "20260409", "CSV"), ("b", "20260401", "CSV"))
    assert rows(incremental.latest_import_date(entries, "a", "API")) == [{"location_id": "a", "latest_date": "20260408"}]
    assert [r["business_date"] for r in rows(incremental.imported_dates(entries, "a"))] == ["20260408", "20260409"]
    ranges = spark.createDataFrame([("a", "20260407", "20260410")], "location_id string, start_date string, end_date string")
    assert [r["business_date"] for r in rows(incremental.pending_dates(ranges, entries), "business_date")] == ["20260407", "20260410"]


@pytest.mark.parametrize(
    "start, end, expected",
    [
        (None, None, ("2026-03-12", "2026-04-11")), ("2026-04-01", None, ("2026-04-01", "2026-04-11")), (None, "2026-04-05", ("2026-04-05", "2026-04-05")),
        ("2026-04-01", "2026-04-05", ("2026-04-01", "2026-04-05")),
    ],
)
def test_refresh_window(spark, start, end, expected):
    df = spark.createDataFrame([(dt.datetime(2026, 4, 11, 3), start, end)], "now timestamp, s string, e string")
    got = incremental.refresh_window(df, F.col("now"), F.col("s"), F.col("e")).first()
    assert (got["start_date"], got["end_date"]) == expected


def test_refresh_window_refuses_a_reversed_range(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 4, 11),)], "now timestamp")
    with pytest.raises(Exception, match="on or before"):
        incremental.refresh_window(df, F.col("now"), F.lit("2026-05-01"), F.lit("2026-04-05")).collect()


@pytest.mark.parametrize("chunk, count, first, last", [
    ("year", 2, ("20240101", "20241231"), ("20250101", "20251231")), ("quarter", 8, ("20240101", "20240331"), ("20251001", "20251231")),
    ("month", 24, ("20240101", "20240131"), ("20251201", "20251231")),
])
def test_backfill_chunks(spark, chunk, count, first, last):
    df = spark.createDataFrame([(TODAY,)], "today date")
    got = [(r["start_date"], r["end_date"]) for r in incremental.backfill_chunks(df, F.col("today"), 2, chunk).orderBy("start_date").collect()]
    assert len(got) == count and got[0] == first and got[-1] == last
    if chunk == "month":
        assert ("20240201", "20240229") in got


def test_files_are_taken_once(spark, tmp_path):
    root, target, state = (str(tmp_path / n) for n in ("raw", "out", "state"))

    def land(place, day, text):
        folder = tmp_path / "raw" / place / day
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "PaymentDetails.csv").write_text("order_guid,payment_method,amount,payment_date\n" + text)

    def run():
        incremental.ingest_new_files(spark, root, "PaymentDetails", imports.import_payments, target, state, "payments", log=str(tmp_path / "log"))
        return files.read_table(spark, target, "payments")

    land("a", "20260410", "1,CASH,2.5,\n2,,x,\n")
    assert run().count() == 1
    assert run().count() == 1
    extra = spark.createDataFrame([("9", 1.0, "c", "20260410")], "order_guid string, amount double, location_id string, business_date string")
    sinks.append_rows(extra, target, "payments")
    assert run().count() == 2
    land("a", "20260411", "3,CASH,1,\n")
    land("b", "20260411", "4,CARD,1,t\n")
    final = run()
    assert sorted((r["order_guid"], r["location_id"], r["payment_date"]) for r in final.collect()) == [("1", "a", "20260410"), ("3", "a", "20260411"), ("4", "b", "t"), ("9", "c", None)]
    assert {(r["location_id"], r["business_date"], r["rows_imported"]) for r in files.read_table(spark, str(tmp_path / "log"), "import_log").collect()} == {
        ("a", "20260410", 2), ("a", "20260411", 1), ("b", "20260411", 1),
    }
    final = final.filter("order_guid != '9'")
    done = log(spark, ("a", "20260410", "CSV"))
    fresh = incremental.unlogged_imports(final, done, "CSV").orderBy("location_id").collect()
    assert [(r["location_id"], r["business_date"], r["rows_imported"]) for r in fresh] == [("a", "20260411", 1), ("b", "20260411", 1)]


def test_orders_arrive_with_other_headers(spark, tmp_path):
    folder = tmp_path / "raw" / "a" / "20260410"
    folder.mkdir(parents=True)
    (folder / "OrderDetails_1.csv").write_text("Order Id,Opened,Dining Options,Total,Amount,Tax,Tip,Discount Amount,Server\n1,,Delivery,9,8,1,0,0,Li\n")
    (folder / "OrderDetails_2.csv").write_text('Total,"Order Id",Tip\r\n5,2,1\r\n')
    target, state = str(tmp_path / "orders"), str(tmp_path / "state")
    incremental.ingest_new_files(spark, str(tmp_path / "raw"), "OrderDetails", imports.import_orders, target, state, "orders")
    stored = files.read_table(spark, target, "orders")
    assert sorted((r["order_guid"], r["total_amount"], r["tip_amount"]) for r in stored.collect()) == [("1", 9.0, 0.0), ("2", 5.0, 1.0)]
    assert views.orders_clean(stored).count() == 2 and stored.filter("created_at IS NULL").count() == 0
