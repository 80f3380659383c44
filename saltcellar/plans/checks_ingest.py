"""Sources, sinks, payload flattening and imports over the sample tables, with SQL checks."""

from pyspark.sql import functions as F

from saltcellar import schemas
from saltcellar.functions.columns import cents
from saltcellar.operators import coverage, imports, payloads, views
from saltcellar.session import scratch_path
from saltcellar.sources import files, sinks

PLACE = "location_id"


def _stored_tables(t):
    folder = scratch_path(t.spark, "tables")
    raw = {
        "orders": t.raw_orders, "order_items": t.raw_items, "payments": t.raw_payments,
        "customer_orders": t.raw_customers, "inventory": t.inventory, "reviews": t.reviews,
    }
    for name, df in raw.items():
        sinks.write_table(df, f"{folder}/{name}.parquet", "overwrite", partition_by=())
    return files.read_tables(t.spark, folder, raw)


def _order_sheet(t):
    return t.raw_orders.select(
        F.col("order_guid").alias("Order Id"), F.col("order_time").alias("Opened"),
        F.col("order_type").alias("Dining Options"), F.col("total_amount").alias("Total"),
        F.col("subtotal").alias("Amount"), F.when(F.col("tax_amount") > 1, F.col("tax_amount")).alias("Tax"),
        F.when(F.col("tip_amount") > 0, F.col("tip_amount").cast("string")).otherwise("none").alias("Tip"),
        F.col("discount_amount").alias("Discount Amount"),
    )


def _exported(t, sheets, table, importer):
    """Write sheets as export folders, then import them."""
    root = scratch_path(t.spark, "exports")
    for place, (name, sheet) in enumerate(sheets):
        sheet.write.option("header", True).csv(f"{root}/store_{place}/20010801/{name}.csv")
    return files.import_exports(t.spark, root, table, importer)


def _import_orders(t):
    sheet = _order_sheet(t)
    return _exported(t, [("OrderDetails_2001", sheet), ("CheckDetails_2001", sheet)], "orders", imports.import_orders)


def _import_payments(t):
    sheet = t.raw_payments.select(
        "order_guid", F.when(F.col("payment_method") != "CASH", F.col("payment_method")).alias("payment_method"),
        "amount", F.when(F.col("payment_method") != "CREDIT", F.col("payment_date")).alias("payment_date"),
    )
    return _exported(t, [("PaymentDetails", sheet)], "payments", imports.import_payments)


def _import_items(t):
    sheet = t.raw_items.select(
        F.col("order_guid").alias("Order Id"), F.col("item_name").alias("Menu Item"), F.col("category").alias("Sales Category"),
        F.when(F.col("quantity") != 7, F.col("quantity").cast("double")).alias("Qty"),
        F.col("prediscount_total").alias("Gross Price"), F.col("total_price").alias("Net Price"),
    )
    return _exported(t, [("ItemSelectionDetails", sheet)], "order_items", imports.import_items)


def _import_inventory(t):
    sheet = t.inventory.select(
        F.col("item_name").alias("Menu Item"), F.col("category").alias("Menu Group"),
        (F.col("current_stock") * 10).alias("Item Qty"), F.col("unit_cost").alias("Avg Price"),
    )
    return _exported(t, [("AllItemsReport", sheet)], "inventory", imports.import_inventory)


def _import_time_entries(t):
    sheet = t.labor.select(
        F.concat(F.lit(" "), F.col("employee_name"), F.lit(" ")).alias("Employee"), F.col("job_title").alias("Job Title"),
        F.col("clock_in_time").alias("In Date"), F.col("clock_out_time").alias("Out Date"),
        F.col("total_hours").alias("Total Hours"), F.col("payable_hours").alias("Payable Hours"),
        F.col("regular_hours").alias("Regular Hours"), F.col("overtime_hours").alias("Overtime Hours"),
        F.col("cash_tips").alias("Cash Tips Declared"), F.col("non_cash_tips").alias("Non Cash Tips"),
        F.col("total_gratuity").alias("Total Gratuity"), F.col("total_tips").alias("Total Tips"), F.col("wage").alias("Wage"),
    )
    return _exported(t, [("TimeEntries", sheet)], "time_entries", imports.import_time_entries)


def _read_payload(t):
    path = scratch_path(t.spark, "landed")
    t.land_orders(path, "location_id")
    return coverage.payload_profile(files.read_payload(t.spark, path, schemas.ORDER_PAYLOAD))


def _location_totals(df):
    return df.groupBy("location_id").agg(
        F.count(F.lit(1)).alias("rows"), cents(F.col("total_amount").cast("double")).alias("total")
    )


def _write_table(t):
    path = scratch_path(t.spark, "orders")
    sinks.write_table(t.raw_orders, path, "overwrite")
    sinks.write_table(t.raw_orders, path, "append")
    return _location_totals(t.spark.read.parquet(path))


def _write_csv(t):
    path = scratch_path(t.spark, "orders-csv")
    sinks.write_csv(t.raw_orders, path, "overwrite")
    sinks.write_csv(t.raw_orders, path, "append")
    return _location_totals(t.spark.read.option("header", True).csv(path))


def _export_tables(t):
    return sinks.export_tables(
        t.spark,
        {
            "orders_clean": t.stored_orders, "order_items_clean": t.stored_items, "payments_clean": t.payments,
            "daily_sales": t.daily, "item_performance": views.item_performance(t.raw_items, t.stored_map), "menu_canonical_map": t.name_map, "inventory": t.inventory,
            "customer_orders_masked": t.masked,
        },
        scratch_path(t.spark, "analysis"),
    )


def _append_rows(t):
    path = scratch_path(t.spark, "payments")
    for _ in range(2):
        sinks.append_rows(t.raw_payments.drop("payment_date"), path, "payments")
    return t.spark.read.parquet(path).groupBy("payment_method").agg(
        F.count(F.lit(1)).alias("rows"), F.count("payment_date").alias("dated")
    )


def _replace_table(t):
    path = scratch_path(t.spark, "map")
    sinks.replace_table(t.name_map.filter(F.col("category").isNull()), path)
    sinks.replace_table(t.name_map, path)
    return files.read_table(t.spark, path, "menu_canonical_map")


def _import_log(t):
    path = scratch_path(t.spark, "log")
    sinks.log_import(t.import_log, path)
    kept = t.spark.read.parquet(path)
    return kept.groupBy("location_id", "file_type").agg(
        F.count_distinct("import_id").alias("entries"), F.sum("rows_imported").alias("rows"), F.max("business_date").alias("latest")
    )


def _manifest(t):
    folder = scratch_path(t.spark, "pull")
    paths = {}
    pulled = {
        "orders": t.raw_orders, "order_items": t.raw_items, "payments": t.raw_payments, "customer_orders": t.raw_customers, "inventory": t.inventory,
    }
    for name, df in pulled.items():
        paths[name] = f"{folder}/{name}"
        sinks.write_table(df, paths[name], "overwrite", partition_by=("location_id",))
    return sinks.write_manifest(t.spark, paths, f"{folder}/manifest", start_date="19950101", end_date="20011231").select(
        "table_name", "row_count", (F.col("bytes") > 0).alias("has_bytes"), "start_date", "end_date"
    )


QUERIES = {
    "parquet_tables_scan": lambda t: sinks.table_manifest(_stored_tables(t)),
    "import_orders": _import_orders,
    "import_payments": _import_payments,
    "import_items": _import_items,
    "import_inventory": _import_inventory,
    "import_time_entries": _import_time_entries,
    "payload_profile": _read_payload,
    "parquet_sink": _write_table,
    "csv_sink": _write_csv,
    "analysis_export": _export_tables,
    "append_rows": _append_rows,
    "replace_menu_map": _replace_table,
    "add_missing_columns": lambda t: sinks.add_missing_columns(t.raw_orders.drop("tip_amount", "created_at"), "orders")
    .groupBy("location_id").agg(F.count(F.lit(1)).alias("rows"), F.count("tip_amount").alias("tips"), F.count("created_at").alias("stamps")),
    "missing_required": lambda t: sinks.missing_required(
        t.raw_items.withColumn("order_guid", F.when(F.col("quantity") > 0, F.col("order_guid"))), "order_items"
    ),
    "import_log_append": _import_log,
    "pull_manifest": _manifest,
    "flatten_orders": lambda t: payloads.flatten_orders(t.order_documents, F.col(PLACE)),
    "flatten_order_items": lambda t: payloads.flatten_order_items(t.order_documents, F.col(PLACE)),
    "flatten_payments": lambda t: payloads.flatten_payments(t.order_documents, F.col(PLACE)),
    "flatten_customers": lambda t: payloads.flatten_customers(t.order_documents, F.col(PLACE)),
    "flatten_menus": lambda t: payloads.flatten_menus(
        t.menu_documents, F.lit("demo_asia"), "20010801"
    ),
    "first_nested": lambda t: t.order_documents.select(
        "businessDate", "location_id", "openedDate",
        payloads.first_nested("checks[].payments[].type").alias("payment_type"),
        payloads.first_nested("checks[].customer.email").alias("email"),
        payloads.first_nested("diningOption.name").alias("dining"),
    ),
    "profile_snapshot": lambda t: payloads.profile_snapshot(
        t.profile_documents, F.lit(" "), F.lit("run-1"), F.lit("UTC")
    ),
    "media_snapshots": lambda t: payloads.media_snapshots(
        payloads.insights_pivot(t.media_documents), F.concat(F.lit("acct_"), F.col("account")), F.col("account"), F.lit(None).cast("string"), F.lit("run-1")
    ),
    "timestamp_normalize": lambda t: t.media_documents.select(
        "id", F.col("timestamp").alias("given"), payloads.timestamp_normalize(F.col("timestamp")).alias("utc")
    ),
    "parse_payload_texts": lambda t: files.parse_payload(
        t.media_payload.select("account", F.to_json(F.struct("id", "insights")).alias("document")), "document", schemas.MEDIA_PAYLOAD.replace("account string, ", ""), ["account"]
    ).select("account", "id", F.size("insights").alias("metrics")),
    "insights_pivot": lambda t: payloads.insights_pivot(t.media_documents).select("id", "reach", "saved", "shares"),
    "media_window": lambda t: payloads.media_window(t.media_documents, "1998-02-01", "1998-12-31").select("id", "timestamp"),
    "customer_coverage": lambda t: coverage.customer_coverage(t.order_documents),
    "masked_email_sample": lambda t: coverage.masked_email_sample(t.order_documents),
    "modifier_coverage": lambda t: coverage.modifier_coverage(t.order_documents),
    "dining_option_coverage": lambda t: coverage.dining_option_coverage(t.order_documents),
    "dining_option_names": lambda t: coverage.dining_option_names(t.order_documents),
    "server_coverage": lambda t: coverage.server_coverage(t.order_documents),
    "menu_profile": lambda t: coverage.menu_profile(t.menu_documents),
}

BLOCKS = {
    "p_checks": """
        SELECT l_orderkey, l_linestatus, sum(price) AS amount, sum(discount) AS discount, sum(tax) AS tax, count(*) AS selections
        FROM lines GROUP BY ALL""",
    "p_all_checks": """
        SELECT p.*, c.*, c.amount - c.discount + c.tax AS total, l_linestatus = 'F' AND o_orderpriority = '2-HIGH' AS check_voided
        FROM placed_time p JOIN p_checks c ON o_orderkey = l_orderkey""",
    "p_live_orders": "SELECT * FROM placed_time WHERE o_totalprice >= 2000 AND NOT (o_orderstatus = 'F' AND o_orderpriority = '5-LOW')",
    "p_live": "SELECT * FROM p_all_checks WHERE NOT check_voided AND o_totalprice >= 2000 AND NOT (o_orderstatus = 'F' AND o_orderpriority = '5-LOW')",
    "p_customers": """
        SELECT l.order_guid, l.location_id, l.business_date, nullif(trim(customer_email), '') AS customer_email, nullif(trim(customer_phone), '') AS customer_phone,
               first_name, last_name FROM p_live l JOIN contacts USING (c_custkey)""",
    "p_iso": "SELECT *, strftime(moment, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS utc FROM media_stamped",
}

_STATUS_ORDER = "CASE WHEN tax_amount > 1 THEN tax_amount ELSE 0 END"

SQL = {
    "parquet_tables_scan": " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {r}"
        for n, r in (("orders", "raw_orders"), ("order_items", "raw_items"), ("payments", "raw_payments"),
                     ("customer_orders", "raw_customers"), ("inventory", "raw_inventory"), ("reviews", "raw_reviews"))
    ),
    "import_orders": f"""
        SELECT order_guid AS order_id, store AS location_id, '20010801' AS business_date, order_guid, order_time, coalesce(order_type, 'UNKNOWN') AS order_type,
               total_amount, subtotal, {_STATUS_ORDER} AS tax_amount, tip_amount, discount_amount
        FROM raw_orders, (VALUES ('store_0'), ('store_1')) stores(store) WHERE tip_amount > 0""",
    "import_payments": """
        SELECT order_guid, CASE WHEN payment_method = 'CASH' THEN 'UNKNOWN' ELSE payment_method END AS payment_method, amount,
               CASE WHEN payment_method = 'CREDIT' THEN '20010801' ELSE payment_date END AS payment_date, 'store_0' AS location_id, '20010801' AS business_date
        FROM raw_payments""",
    "import_items": """
        SELECT order_guid, item_name, category, CASE WHEN quantity = 7 THEN 1 ELSE quantity END AS quantity, prediscount_total, total_price,
               'store_0' AS location_id, '20010801' AS business_date FROM raw_items""",
    "import_inventory": """
        SELECT 'store_0' AS location_id, item_name, category, current_stock * 10 AS current_stock, greatest(10, current_stock * 10 * 0.1::DOUBLE) AS reorder_level,
               coalesce(unit_cost, 0) AS unit_cost, '20010801' AS snapshot_date, 'good' AS status FROM raw_inventory""",
    "import_time_entries": """
        SELECT * REPLACE ('store_0' AS location_id, '20010801' AS business_date) FROM raw_labor""",
    "payload_profile": """
        SELECT (SELECT count(*) FROM placed) AS orders, count(*) AS checks, count(*) AS payments, CAST(sum(selections) AS BIGINT) AS selections FROM p_checks""",
    "parquet_sink": "SELECT location_id, 2 * count(*) AS rows, round(2 * sum(total_amount), 2) AS total FROM raw_orders GROUP BY location_id",
    "csv_sink": "SELECT location_id, 2 * count(*) AS rows, round(2 * sum(total_amount), 2) AS total FROM raw_orders GROUP BY location_id",
    "analysis_export": " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {r}"
        for n, r in (("orders_clean", "v_orders"), ("order_items_clean", "v_items"), ("payments_clean", "raw_payments"), ("daily_sales", "v_daily"), ("item_performance", "v_item_performance"),
                     ("menu_canonical_map", "v_map"), ("inventory", "raw_inventory"), ("customer_orders_masked", "v_masked"))
    ),
    "append_rows": "SELECT payment_method, 2 * count(*) AS rows, 0 AS dated FROM raw_payments GROUP BY 1",
    "replace_menu_map": "SELECT * FROM v_map",
    "add_missing_columns": "SELECT location_id, count(*) AS rows, 0 AS tips, 0 AS stamps FROM raw_orders GROUP BY 1",
    "missing_required": """
        SELECT 'order_items' AS table_name, 'order_guid' AS column_name, count(*) FILTER (quantity <= 0) AS missing_rows FROM raw_items""",
    "import_log_append": """
        SELECT location_id, file_type, count(*) AS entries, CAST(sum(rows_imported) AS BIGINT) AS rows, max(business_date) AS latest FROM raw_import_log GROUP BY ALL""",
    "pull_manifest": """
        SELECT *, true AS has_bytes, '19950101' AS start_date, '20011231' AS end_date FROM (
            SELECT 'orders' AS table_name, count(*) AS row_count FROM raw_orders UNION ALL SELECT 'customer_orders', count(*) FROM raw_customers
            UNION ALL SELECT 'order_items', count(*) FROM raw_items UNION ALL SELECT 'payments', count(*) FROM raw_payments
            UNION ALL SELECT 'inventory', count(*) FROM raw_inventory)""",
    "flatten_orders": """
        SELECT order_guid AS order_id, location_id, business_date, order_guid, clock_text AS order_time,
               CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'UNKNOWN' ELSE o_orderpriority END AS order_type,
               CAST(coalesce(s.total, 0) AS DOUBLE) AS total_amount, CAST(coalesce(s.amount, 0) AS DOUBLE) AS subtotal,
               CAST(coalesce(s.tax, 0) AS DOUBLE) AS tax_amount, CAST(coalesce(s.tip, 0) AS DOUBLE) AS tip_amount, CAST(coalesce(s.discount, 0) AS DOUBLE) AS discount_amount
        FROM p_live_orders o LEFT JOIN (
            SELECT l_orderkey, sum(total) AS total, sum(amount) AS amount, sum(tax) AS tax, sum(discount) AS discount,
                   sum(CASE WHEN o_orderstatus <> 'F' THEN CAST(CAST(amount AS DECIMAL(12,2)) * 0.15 AS DECIMAL(12,2)) END) AS tip
            FROM p_live GROUP BY l_orderkey) s ON o_orderkey = l_orderkey""",
    "flatten_order_items": """
        SELECT l.order_guid, item_name, CASE WHEN l_returnflag = 'A' THEN '' ELSE kind END AS category,
               CASE WHEN l_linenumber = 6 OR quantity = 0 THEN 1 ELSE quantity END AS quantity, CAST(price AS DOUBLE) AS prediscount_total,
               CASE WHEN l_linenumber = 5 THEN 0 ELSE CAST(price - l.discount AS DOUBLE) END AS total_price, l.location_id, l.business_date
        FROM lines l JOIN p_live c ON l.l_orderkey = c.l_orderkey AND l.l_linestatus = c.l_linestatus WHERE l_returnflag <> 'N'""",
    "flatten_payments": """
        SELECT order_guid, CASE WHEN c_mktsegment = 'BUILDING' THEN 'UNKNOWN' ELSE c_mktsegment END AS payment_method, CAST(total AS DOUBLE) AS amount,
               '2001-08-01' AS payment_date, location_id, business_date FROM p_live""",
    "flatten_customers": "SELECT * FROM p_customers WHERE coalesce(customer_email, customer_phone, first_name) IS NOT NULL",
    "flatten_menus": """
        SELECT 'demo_asia' AS location_id, p_name AS item_name, p_brand AS category, 0::DOUBLE AS current_stock, 0::DOUBLE AS reorder_level,
               CASE WHEN p_size = 49 THEN 0 ELSE p_retailprice END AS unit_cost, '20010801' AS snapshot_date, 'good' AS status FROM part WHERE p_size <> 50""",
    "first_nested": """
        SELECT CAST(business_date AS BIGINT) AS businessDate, p.location_id, clock_text AS openedDate,
               CASE WHEN n > 0 AND c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS payment_type,
               CASE WHEN n > 0 THEN customer_email END AS email, CASE WHEN o_orderstatus <> 'O' THEN lower(o_orderpriority) END AS dining
        FROM placed_time p JOIN contacts USING (c_custkey) LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM p_checks GROUP BY 1) c ON o_orderkey = l_orderkey""",
    "profile_snapshot": """
        SELECT CAST(s_suppkey AS VARCHAR) AS account_id, CASE WHEN s_acctbal < 0 THEN CAST(s_suppkey AS VARCHAR) ELSE lower(s_name) END AS account_label,
               CASE WHEN s_acctbal >= 0 THEN lower(s_name) END AS username, s_name AS name, CAST(NULL AS VARCHAR) AS biography, 'BUSINESS' AS account_type,
               CAST(s_nationkey AS BIGINT) AS media_count, CASE WHEN s_acctbal >= 0 THEN CAST(floor(s_acctbal) AS BIGINT) END AS followers_count,
               CAST(NULL AS BIGINT) AS follows_count, CAST(NULL AS VARCHAR) AS profile_picture_url, 'UTC' AS local_timezone,
               strftime(DATE '2001-02-01' + s_nationkey, '%Y-%m-%d') || 'T01:30:00+00:00' AS snapshot_at,
               strftime(DATE '2001-02-01' + s_nationkey, '%Y%m%d') AS snapshot_date, 'run-1' AS source_run_id FROM supplier""",
    "media_snapshots": """
        SELECT 'acct_' || account AS account_id, account AS account_label, account AS username, media_id, nullif(trim(caption), '') AS caption,
               CASE WHEN media_product_type = 'REELS' THEN 'REEL' WHEN media_type = 'CAROUSEL_ALBUM' THEN 'CAROUSEL' ELSE media_type END AS media_type,
               media_product_type, 'https://social.example/p' AS permalink, CAST(NULL AS VARCHAR) AS media_url, CAST(NULL AS VARCHAR) AS thumbnail_url,
               stamp AS posted_at_raw, utc AS posted_at_utc, strftime(moment, '%Y%m%d') AS posted_date_utc, n_chars % 211 AS likes, n_chars % 17 AS comments_count,
               CASE WHEN lang <> 'fr' THEN n_chars % 1009 END AS views, n_chars % 3001 AS reach, n_chars % 7 AS saved,
               CASE WHEN lang <> 'de' THEN n_chars % 5 END AS shares, CAST(NULL AS BIGINT) AS total_interactions,
               CASE WHEN media_type = 'CAROUSEL_ALBUM' THEN to_json([
                    {'id': media_id || '-1', 'media_type': 'IMAGE', 'timestamp': stamp, 'posted_at_utc': utc, 'posted_date_utc': strftime(moment, '%Y%m%d'),
                     'media_url': CAST(NULL AS VARCHAR), 'thumbnail_url': CAST(NULL AS VARCHAR)},
                    {'id': media_id || '-2', 'media_type': 'VIDEO', 'timestamp': NULL, 'posted_at_utc': NULL, 'posted_date_utc': NULL,
                     'media_url': 'https://media.example/' || media_id, 'thumbnail_url': NULL}])::VARCHAR END AS children_json,
               CASE WHEN media_type = 'CAROUSEL_ALBUM' THEN 2 ELSE 0 END AS child_count, 'run-1' AS source_run_id FROM p_iso""",
    "timestamp_normalize": "SELECT media_id AS id, stamp AS given, utc FROM p_iso",
    "parse_payload_texts": "SELECT account, media_id AS id, 3 AS metrics FROM media_base",
    "insights_pivot": """
        SELECT media_id AS id, CAST(n_chars % 3001 AS VARCHAR) AS reach, CAST(n_chars % 7 AS VARCHAR) AS saved,
               CASE WHEN lang <> 'de' THEN CAST(n_chars % 5 AS VARCHAR) END AS shares FROM media_stamped""",
    "media_window": """
        SELECT media_id AS id, stamp AS timestamp FROM media_stamped
        WHERE moment IS NULL OR (moment >= TIMESTAMP '1998-02-01' AND moment < TIMESTAMP '1999-01-01')""",
    "customer_coverage": """
        SELECT count(*) AS checks, count(*) AS with_customer, count(nullif(trim(customer_email), '')) AS with_email, count(nullif(trim(customer_phone), '')) AS with_phone,
               count(first_name) AS with_name, count(DISTINCT lower(nullif(trim(customer_email), ''))) AS distinct_emails, 100::DOUBLE AS customer_pct
        FROM p_all_checks JOIN contacts USING (c_custkey)""",
    "masked_email_sample": """
        SELECT substr(mail, 1, 1) || '***@' || split_part(mail, '@', 2) AS masked_email
        FROM (SELECT trim(customer_email) AS mail FROM p_all_checks JOIN contacts USING (c_custkey) WHERE trim(customer_email) <> '' ORDER BY mail LIMIT 3)""",
    "modifier_coverage": """
        SELECT count(*) AS selections, count(*) FILTER (l_linenumber <= 2) AS with_modifiers, count(*) FILTER (l_linenumber <= 2) / count(*) * 100 AS pct
        FROM lines WHERE l_returnflag <> 'N'""",
    "dining_option_coverage": """
        SELECT count(*) AS orders, count(*) FILTER (o_orderstatus <> 'O') AS with_option, count(DISTINCT o_orderpriority) FILTER (o_orderstatus <> 'O') AS distinct_names,
               count(*) FILTER (o_orderstatus <> 'O') / count(*) * 100 AS pct FROM placed""",
    "dining_option_names": "SELECT lower(o_orderpriority) AS name, count(*) AS orders FROM placed WHERE o_orderstatus <> 'O' GROUP BY 1",
    "server_coverage": """
        SELECT count(*) AS checks, count(*) FILTER (l_linestatus = 'O' OR o_orderstatus = 'P') AS with_server,
               count(*) FILTER (l_linestatus = 'O' OR o_orderstatus = 'P') / count(*) * 100 AS pct FROM p_all_checks""",
    "menu_profile": """
        SELECT count(DISTINCT p_partkey // 100) AS menus, count(DISTINCT (p_partkey // 100, p_brand)) AS groups, count(*) AS items FROM part""",
}
