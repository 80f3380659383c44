import pytest
from pyspark.sql import functions as F

from saltcellar import schemas
from saltcellar.operators import imports
from saltcellar.plans.samples import Samples
from saltcellar.sources import files, sinks


def export(root, place, day, name, text):
    folder = root / place / day
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def test_order_and_check_exports(spark, rows, tmp_path):
    head = "Order Id,Opened,Dining Options,Total,Amount,Tax,Tip,Discount Amount\n"
    export(tmp_path, "s 1", "20260410", "OrderDetails_1.csv", head + '1,4/10/26 1:05 PM,Dine In,10.5,9,1,,0\n,x,y,1,1,1,1,1\n2,,,abc,1,1,1,1\n3,,,,,,,\n')
    export(tmp_path, "s2", "20260411", "CheckDetails.csv", head + "9,t,NA,1,1,1,1,1\n")
    df = files.import_exports(spark, str(tmp_path), "orders", imports.import_orders)
    got = rows(df, "order_guid")
    assert [(r["order_guid"], r["location_id"], r["business_date"], r["order_type"]) for r in got] == [
        ("1", "s 1", "20260410", "Dine In"), ("3", "s 1", "20260410", "UNKNOWN"), ("9", "s2", "20260411", "UNKNOWN"),
    ]
    assert got[0]["tip_amount"] == 0.0 and got[1]["order_time"] is None
    assert files.import_exports(spark, str(tmp_path), "payments", imports.import_payments) is None


def test_columns_are_matched_by_name(spark, tmp_path):
    export(tmp_path, "a", "20260410", "PaymentDetails.csv", "order_guid,payment_method,amount,payment_date\n1,CASH,2,\n")
    export(tmp_path, "b", "20260410", "PaymentDetails.csv", "payment_method,order_guid,amount,payment_date,more\nCARD,2,3,,x\n")
    got = files.import_exports(spark, str(tmp_path), "payments", imports.import_payments).collect()
    assert sorted((r["order_guid"], r["payment_method"], r["amount"], r["location_id"]) for r in got) == [("1", "CASH", 2.0, "a"), ("2", "CARD", 3.0, "b")]


def test_items_inventory_and_labor(spark, rows, tmp_path):
    export(tmp_path, "a", "20260410", "ItemSelectionDetails.csv", "Order Id,Menu Item,Sales Category,Qty,Gross Price,Net Price\n1,Bao,,2.0,5,4\n1,,Food,,5,4\n")
    export(tmp_path, "a", "20260410", "AllItemsReport.csv", "Menu Item,Menu Group,Item Qty,Avg Price\nBao,Food,500,2.5\nTea,,,\n,x,1,1\n")
    head = "Employee,Job Title,In Date,Out Date,Total Hours,Payable Hours,Regular Hours,Overtime Hours,Cash Tips Declared,Non Cash Tips,Total Gratuity,Total Tips,Wage\n"
    export(tmp_path, "a", "20260410", "TimeEntries.csv", head + ' Li ,Cook,a,b,7.51,7.5,7.5,0,1,2,0,3,15\n  ,x,,,1,,,,,,,,\n')
    items = rows(files.import_exports(spark, str(tmp_path), "order_items", imports.import_items), "item_name")
    assert [(r["item_name"], r["quantity"], r["category"]) for r in items] == [("", 1, "Food"), ("Bao", 2, "")]
    stock = rows(files.import_exports(spark, str(tmp_path), "inventory", imports.import_inventory), "item_name")
    assert [(r["item_name"], r["reorder_level"], r["snapshot_date"]) for r in stock] == [("Bao", 50.0, "20260410"), ("Tea", 10.0, "20260410")]
    labor = rows(files.import_exports(spark, str(tmp_path), "time_entries", imports.import_time_entries))
    assert [(r["employee_name"], r["duration_minutes"], r["clock_in_time"]) for r in labor] == [("Li", 450, "a")]


def payments(spark, n, place="a"):
    return spark.range(n).select(
        F.col("id").cast("string").alias("order_guid"), F.lit("CASH").alias("payment_method"), F.lit(1.0).alias("amount"),
        F.lit(place).alias("location_id"), F.lit("20260410").alias("business_date"),
    )


def test_appends_count_and_fill_columns(spark, tmp_path):
    path = str(tmp_path / "payments")
    assert sinks.append_rows(payments(spark, 3), path, "payments") == 3
    assert sinks.append_rows(payments(spark, 2), path, "payments") == 2
    back = files.read_table(spark, path, "payments")
    assert back.count() == 5 and back.filter("payment_date IS NOT NULL").count() == 0


def test_schema_check_names_the_column(spark, tmp_path):
    path = str(tmp_path / "p")
    sinks.replace_table(payments(spark, 1).withColumn("amount", F.lit("x")), path)
    with pytest.raises(ValueError, match="amount double"):
        files.read_table(spark, path, "payments")


def test_missing_required(spark, rows):
    df = payments(spark, 3).withColumn("order_guid", F.when(F.col("order_guid") != "1", F.col("order_guid")))
    assert rows(sinks.missing_required(df, "payments"))[0] == {"table_name": "payments", "column_name": "order_guid", "missing_rows": 1}
    assert schemas.required("customer_orders") == ["order_guid", "location_id", "business_date"]


def test_partitioned_write_manifest_and_log(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_table(payments(spark, 3, "a"), path, "overwrite")
    sinks.write_table(payments(spark, 2, "b"), path, "append")
    assert (tmp_path / "t" / "location_id=a").is_dir()
    manifest = rows(sinks.write_manifest(spark, {"payments": path}, str(tmp_path / "m"), run="r1"))
    assert manifest[0]["row_count"] == 5 and manifest[0]["bytes"] > 0 and manifest[0]["run"] == "r1"
    counts = payments(spark, 1).select("location_id", "business_date", F.lit("CSV").alias("file_type"), F.lit("f").alias("file_name"), F.lit(5).cast("long").alias("rows_imported"))
    sinks.log_import(counts, str(tmp_path / "log"))
    logged = rows(files.read_table(spark, str(tmp_path / "log"), "import_log"))
    assert logged[0]["rows_imported"] == 5 and len(logged[0]["import_id"]) == 36 and logged[0]["import_timestamp"] is not None


def test_export_of_analysis_tables(spark, rows, tmp_path):
    table = payments(spark, 4)
    tables = dict.fromkeys(sinks.EXPORT_TABLES, table)
    counts = rows(sinks.export_tables(spark, tables, str(tmp_path)))
    assert [(r["table_name"], r["row_count"]) for r in counts] == [(name, 4) for name in sinks.EXPORT_TABLES]
    tables.pop("inventory")
    with pytest.raises(ValueError, match="inventory"):
        sinks.export_tables(spark, tables, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "payments_clean.parquet")).count() == 4


def test_headers_of_files_in_several_splits(spark, rows, tmp_path):
    """Only the first split of a file holds its header; cells go by the names of their own file."""
    folder = tmp_path / "store_a" / "20260105"
    folder.mkdir(parents=True)
    lines = [f'{i},"x, ""{i}""",{i * 2}' for i in range(2000)]
    (folder / "PaymentDetails_1.csv").write_text("\ufeffid,name,twice\n" + "\n".join(lines) + "\n\n", encoding="utf-8")
    (folder / "PaymentDetails_2.csv").write_text("extra,twice,id\r\n,7,a\r\nonly\r\n", encoding="utf-8")
    (folder / "PaymentDetails_3.csv").write_text("", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = files.read_export(spark, str(tmp_path), "PaymentDetails")
        assert files.export_lines(spark.read, str(tmp_path), "PaymentDetails").select("split").distinct().count() > 4
        got = rows(found)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    first = sorted((r for r in got if r["file_name"] == "PaymentDetails_1.csv"), key=lambda r: int(r["id"]))
    assert [(r["id"], r["name"], r["twice"], r["extra"]) for r in first] == [(str(i), f'x, "{i}"', str(i * 2), None) for i in range(2000)]
    second = [(r["extra"], r["twice"], r["id"], r["name"]) for r in got if r["file_name"] == "PaymentDetails_2.csv"]
    assert sorted(second, key=str) == [("only", None, None, None), (None, "7", "a", None)]
    assert {(r["location_id"], r["business_date"]) for r in got} == {("store_a", "20260105")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv") == 1


@pytest.mark.parametrize("at_once", [0, 16_000_000])
def test_lines_meet_headers_with_and_without_a_broadcast(spark, tmp_path, monkeypatch, at_once):
    export(tmp_path, "a b", "20260410", "PaymentDetails.csv", "order_guid,payment_method,amount,payment_date\n1,CASH,2,\n")
    export(tmp_path, "b", "20260411", "PaymentDetails.csv", "payment_method,order_guid,amount,payment_date,more\nCARD,2,3,,x\n")
    monkeypatch.setattr(files, "HEADERS_AT_ONCE", at_once)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large files, from whose size Spark guesses that of the headers
    try:
        found = files.read_export(spark, str(tmp_path), "PaymentDetails")
        plan = found._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ("BroadcastHashJoin" in plan) == (at_once > 0)
    # The path of a line is not cut again for every line.
    assert "regexp_extract" not in plan and "array_position" not in plan
    got = sorted((r["order_guid"], r["payment_method"], r["more"], r["location_id"], r["business_date"], r["file_name"]) for r in found.collect())
    assert got == [("1", "CASH", None, "a b", "20260410", "PaymentDetails.csv"), ("2", "CARD", "x", "b", "20260411", "PaymentDetails.csv")]


def test_landed_payloads_are_packed(spark, tmp_path):
    tables = Samples(spark, str(tmp_path))
    tables.profile_payload = spark.createDataFrame([("1", "a"), ("2", None)], "id string, username string")
    landed = tables.profile_documents
    assert landed.inputFiles() and all(name.endswith(".json.gz") for name in landed.inputFiles())
    assert sorted((r["id"], r["username"]) for r in landed.collect()) == [("1", "a"), ("2", None)]
