"""DuckDB definitions of the warehouse tables, independent of the Spark adapters."""

from __future__ import annotations

import re

TABLES: dict[str, str] = {
    "customer_places": """
        SELECT c_custkey, c_name, c_mktsegment,
               CASE WHEN r_name IN ('AFRICA', 'EUROPE') THEN 'site_' || r_regionkey
                    ELSE 'demo_' || lower(replace(r_name, ' ', '_')) END AS location_id
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "placed": """
        SELECT o.*, p.c_name, p.c_mktsegment, p.c_custkey, p.location_id,
               CAST(o_orderkey AS VARCHAR) AS order_guid, strftime(o_orderdate, '%Y%m%d') AS business_date,
               CAST(trunc(o_totalprice) AS BIGINT) % 14 + 8 AS hh, CAST(trunc(o_totalprice) AS BIGINT) % 60 AS mm
        FROM orders o JOIN customer_places p ON o_custkey = c_custkey""",
    "placed_time": """
        SELECT *, CASE
            WHEN o_orderstatus = 'F' THEN month(o_orderdate) || '/' || day(o_orderdate) || '/' || strftime(o_orderdate, '%y')
                 || ' ' || CASE WHEN hh > 12 THEN hh - 12 ELSE hh END || ':' || lpad(CAST(mm AS VARCHAR), 2, '0')
                 || CASE WHEN hh >= 12 THEN ' PM' ELSE ' AM' END
            ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T' || lpad(CAST(hh AS VARCHAR), 2, '0') || ':'
                 || lpad(CAST(mm AS VARCHAR), 2, '0')
                 || CASE WHEN o_orderstatus = 'O' THEN ':30.250Z' WHEN o_orderpriority = '5-LOW' THEN ':00+0000' ELSE ':00Z' END
            END AS clock_text
        FROM placed""",
    "line_money": """
        SELECT *, CAST(price * CASE WHEN l_returnflag = 'R' THEN CAST(l_discount AS DECIMAL(4,2)) ELSE 0.00 END AS DECIMAL(12,2)) AS discount,
               CAST(price * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(12,2)) AS tax
        FROM (SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 0.001 AS DECIMAL(12,2)) AS price FROM lineitem)""",
    "order_sums": """
        SELECT l_orderkey, sum(price) AS subtotal, sum(discount) AS discount, sum(tax) AS tax
        FROM line_money GROUP BY l_orderkey""",
    "orders_once": """
        SELECT order_guid AS order_id, location_id, business_date, order_guid, clock_text AS order_time,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'DELIVERY' WHEN '2-HIGH' THEN 'Take Out' WHEN '3-MEDIUM' THEN 'Dine In'
                    WHEN '4-NOT SPECIFIED' THEN 'UNKNOWN' ELSE CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'API' END END AS order_type,
               coalesce(s.subtotal, 0.00) AS sub, coalesce(s.discount, 0.00) AS disc, coalesce(s.tax, 0.00) AS tx,
               CASE WHEN o_orderstatus = 'F' THEN 0.00
                    ELSE CAST(CAST(coalesce(s.subtotal, 0.00) AS DECIMAL(12,2)) * 0.15 AS DECIMAL(12,2)) END AS tip,
               CASE WHEN o_totalprice < 3000 THEN -1 ELSE 1 END AS sgn,
               o_orderdate + INTERVAL 1 DAY AS created_at, o_orderstatus AS status
        FROM placed_time LEFT JOIN order_sums s ON o_orderkey = l_orderkey""",
    "raw_orders": """
        SELECT order_id, location_id, business_date, order_guid, order_time,
               CASE WHEN n = 1 THEN 'Takeout' ELSE order_type END AS order_type,
               CAST((sub - disc + tx + tip) * sgn AS DOUBLE) AS total_amount, CAST(sub AS DOUBLE) AS subtotal,
               CAST(tx AS DOUBLE) AS tax_amount, CASE WHEN n = 1 THEN 0.0 ELSE CAST(tip AS DOUBLE) END AS tip_amount,
               CAST(disc AS DOUBLE) AS discount_amount, created_at + n * INTERVAL 1 DAY AS created_at
        FROM orders_once, (VALUES (0), (1)) copies(n) WHERE n = 0 OR status = 'P'""",
    "part_items": """
        SELECT *, CASE WHEN p_type = 'PROMO' AND p_size = 13 THEN ''
                       WHEN sign IS NULL THEN p_name
                       WHEN p_size >= 40 THEN sign || ' ' || p_name || ' (8)'
                       WHEN p_size >= 20 THEN p_name || '  ⭐ ' || sign
                       WHEN p_size >= 3 THEN p_name || ' ' || sign
                       ELSE sign END AS item_name,
               CASE p_type WHEN 'SMALL' THEN 'Beverages' WHEN 'LARGE' THEN 'Wine' ELSE p_type END AS kind
        FROM (SELECT *, CASE split_part(p_name, ' ', 2) WHEN 'ring' THEN '环' WHEN 'gear' THEN '齿轮' WHEN 'bolt' THEN '螺栓' END AS sign FROM part)""",
    "lines": """
        SELECT m.*, p.p_size, p.p_retailprice, p.item_name, p.kind, o.order_guid, o.location_id, o.business_date,
               CASE WHEN l_linenumber = 7 AND l_linestatus = 'O' THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS quantity
        FROM line_money m JOIN part_items p ON l_partkey = p_partkey JOIN placed o ON l_orderkey = o_orderkey""",
    "raw_items": """
        SELECT order_guid, item_name, CASE WHEN l_returnflag = 'A' THEN '' ELSE kind END AS category, quantity,
               CAST(price AS DOUBLE) AS prediscount_total, CAST(price AS DOUBLE) AS total_price, location_id, business_date
        FROM lines""",
    "raw_payments": """
        SELECT order_guid, CASE c_mktsegment WHEN 'BUILDING' THEN 'CREDIT' WHEN 'AUTOMOBILE' THEN 'CASH'
                                WHEN 'MACHINERY' THEN 'GIFTCARD' ELSE 'UNKNOWN' END AS payment_method,
               CAST(CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 0.001 AS DECIMAL(12,2)) AS DOUBLE) AS amount,
               clock_text AS payment_date, location_id, business_date
        FROM placed_time""",
    "contacts": """
        SELECT c_custkey,
               CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN mail WHEN c_mktsegment = 'MACHINERY' THEN ' ' || upper(mail) || '  '
                    WHEN c_mktsegment = 'HOUSEHOLD' THEN '' END AS customer_email,
               CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'AUTOMOBILE') THEN '(555) ' || substr(digits, 1, 3) || '-' || substr(digits, 4, 4)
                    WHEN c_mktsegment = 'FURNITURE' THEN '  ' END AS customer_phone,
               CASE WHEN c_mktsegment <> 'FURNITURE' THEN 'Guest ' || c_custkey END AS first_name, CAST(NULL AS VARCHAR) AS last_name
        FROM (SELECT *, lower(replace(c_name, '#', '.')) || '@example.com' AS mail, lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS digits FROM customer)""",
    "raw_customers": """
        SELECT order_guid, location_id, business_date, customer_email, customer_phone, first_name, last_name
        FROM placed JOIN contacts USING (c_custkey)""",
    "raw_inventory": """
        SELECT location_id, item_name, CASE WHEN high >= 20 THEN category ELSE '' END AS category, stock AS current_stock,
               lvl AS reorder_level, unit_cost, CAST(NULL AS VARCHAR) AS last_ordered, snapshot_date,
               CASE WHEN stock <= 1 THEN 'critical' WHEN stock < lvl THEN 'low' ELSE 'good' END AS status
        FROM (
            SELECT *, CAST(low AS DOUBLE) - back AS stock, CAST(high AS DOUBLE) / 8 AS lvl,
                   CASE WHEN item_name NOT LIKE 'new%' THEN CAST(CAST(CAST(cost AS DECIMAL(12,2)) * 0.0004 AS DECIMAL(12,2)) AS DOUBLE) END AS unit_cost
            FROM (SELECT location_id, item_name, min(kind) AS category, min(p_size) AS low, max(p_size) AS high, min(p_retailprice) AS cost
                  FROM lines WHERE item_name <> '' GROUP BY location_id, item_name),
                 (VALUES ('20010701', 1.0::DOUBLE), ('20010801', 3.0::DOUBLE)) days(snapshot_date, back))""",
    "raw_reviews": """
        SELECT 'r' || d.doc_id AS review_id,
               CASE lang WHEN 'de' THEN 'demo_america' WHEN 'en' THEN 'demo_asia' WHEN 'es' THEN 'demo_middle_east' ELSE 'site_0' END AS location_id,
               CAST(d.doc_id AS VARCHAR) AS order_guid, strftime(DATE '2001-01-01' + CAST(n_chars % 200 AS INTEGER), '%Y%m%d') AS review_date,
               n_chars % 5 + 1 AS rating, text AS review_text,
               CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' WHEN quality = 0 THEN 'neutral' END AS sentiment,
               source AS category
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "raw_labor": """
        SELECT CASE event_type WHEN 'click' THEN 'demo_america' WHEN 'view' THEN 'demo_asia' WHEN 'purchase' THEN 'demo_middle_east'
                    WHEN 'signup' THEN 'site_0' ELSE 'site_3' END AS location_id,
               strftime(ts, '%Y%m%d') AS business_date, 'user_' || user_id AS employee_name, event_type AS job_title,
               strftime(ts, '%Y-%m-%d %H:%M:%S') AS clock_in_time, CAST(NULL AS VARCHAR) AS clock_out_time,
               CAST(worked AS DOUBLE) AS total_hours, CAST(worked AS DOUBLE) AS payable_hours,
               CAST(least(worked, 8.00) AS DOUBLE) AS regular_hours, CAST(worked - least(worked, 8.00) AS DOUBLE) AS overtime_hours,
               CAST(cash AS DOUBLE) AS cash_tips, CAST(card AS DOUBLE) AS non_cash_tips, CAST(0 AS DOUBLE) AS total_gratuity,
               CAST(cash + card AS DOUBLE) AS total_tips, CAST(15 AS DOUBLE) AS wage,
               CAST(trunc(CAST(worked AS DOUBLE) * 60) AS BIGINT) AS duration_minutes
        FROM (SELECT *, least(CAST(CAST(value AS DECIMAL(12,2)) * 0.1 AS DECIMAL(12,2)), CAST(14 AS DECIMAL(12,2))) AS worked,
                     CAST(CAST(value AS DECIMAL(12,2)) * 0.05 AS DECIMAL(12,2)) AS cash,
                     CAST(CAST(value AS DECIMAL(12,2)) * 0.10 AS DECIMAL(12,2)) AS card FROM events)""",
    "raw_import_log": """
        SELECT location_id || '-' || business_date || '-' || file_type AS import_id, location_id, business_date, file_type,
               file_type || '.orders' AS file_name, rows_imported, strptime(business_date, '%Y%m%d') + INTERVAL 1 DAY AS import_timestamp
        FROM (SELECT location_id, business_date, CASE WHEN o_orderstatus = 'F' THEN 'CSV' ELSE 'API' END AS file_type, count(*) AS rows_imported
              FROM placed GROUP BY ALL)""",
    "media_base": """
        SELECT CAST(doc_id AS VARCHAR) AS media_id, source AS account, lang, n_chars,
               text || CASE WHEN source LIKE '%1' THEN ' Lunch Special today #deal' WHEN source LIKE '%2' THEN ' New Location: grand opening'
                            WHEN source LIKE '%3' THEN ' Pork dumplings and milk tea #menu' ELSE '' END AS caption,
               CASE WHEN source LIKE '%1' THEN 'VIDEO' WHEN source LIKE '%2' THEN 'CAROUSEL_ALBUM' WHEN source LIKE '%4' THEN 'STORY' ELSE 'IMAGE' END AS media_type,
               CASE WHEN source LIKE '%5' THEN 'REELS' ELSE 'FEED' END AS media_product_type,
               DATE '1998-01-01' + CAST(n_chars % 500 AS INTEGER) AS posted
        FROM documents""",
    "media_stamped": """
        SELECT *, CASE lang WHEN 'de' THEN c || '+0000' WHEN 'en' THEN c || 'Z' WHEN 'es' THEN c || '+02:00'
                       ELSE CASE WHEN n_chars % 2 = 0 THEN 'not a time' ELSE c || '.125+0000' END END AS stamp,
               CASE lang WHEN 'de' THEN p WHEN 'en' THEN p WHEN 'es' THEN p - INTERVAL 2 HOUR
                         ELSE CASE WHEN n_chars % 2 = 1 THEN p END END AS moment
        FROM (SELECT *, strftime(posted, '%Y-%m-%d') || 'T10:15:00' AS c, CAST(posted AS TIMESTAMP) + INTERVAL 615 MINUTE AS p FROM media_base)""",
    "raw_media": """
        SELECT 'acct_' || account AS account_id, account AS account_label, account AS username, media_id,
               CASE WHEN lang = 'de' THEN '' ELSE caption END AS caption,
               CASE WHEN media_type = 'CAROUSEL_ALBUM' THEN 'CAROUSEL' ELSE media_type END AS media_type, media_product_type,
               stamp AS posted_at_raw, moment, CASE WHEN lang <> 'fr' OR n_chars % 2 = 1 THEN posted END AS posted_date,
               n_chars % 211 * n AS likes, n_chars % 17 + n AS comments_count,
               CASE WHEN lang <> 'fr' THEN n_chars % 1009 END AS views, CASE WHEN lang <> 'fr' THEN n_chars % 3001 END AS reach,
               n_chars % 7 AS saved, CASE WHEN lang <> 'es' THEN n_chars % 5 END AS shares,
               CASE WHEN lang = 'de' THEN n_chars % 211 * n + n_chars % 17 + n + 3 END AS total_interactions,
               'run-' || n AS source_run_id, TIMESTAMP '2001-08-01' + n * INTERVAL 1 DAY AS created_at
        FROM media_stamped, (VALUES (1), (2)) runs(n)""",
    "raw_profiles": """
        SELECT CAST(s_suppkey AS VARCHAR) AS account_id, s_name AS account_label, s_nationkey AS media_count,
               CAST(floor(s_acctbal) AS BIGINT) * n AS followers_count, snap AS snapshot_at, d AS snapshot_date, 'run-' || n AS source_run_id
        FROM supplier, (VALUES (1, TIMESTAMP '2001-08-02 01:30:00', DATE '2001-08-01'), (2, TIMESTAMP '2001-08-02 10:00:00', DATE '2001-08-02'),
                               (3, TIMESTAMP '2001-08-03 08:00:00', CAST(NULL AS DATE))) runs(n, snap, d)
        WHERE n < 3 OR s_acctbal > 0""",
    "asked": """
        SELECT conv_id, turn, lower(text || (['', ' What drives category share?', ' stock to reorder?', ' Average rating per review',
            ' repeat customers', ' delivery or dine in', ' sales by category', ' best dishes', ' what is our AOV', ' daily trend of revenue',
            ' delete all orders', ' select x from y', ' customer email list', ' show every order', ' Soup Dumplings (8pc) sold',
            ' top sellers by count', ' show stock status'])[length(text) % 17 + 1]) AS q
        FROM conversations WHERE role = 'user'""",
}


# Read several times by one query and costly to expand.
KEPT = {"e_features", "e_long", "e_corr", "e_peaks", "e_weights"}


def with_tables(body: str, extra: dict[str, str] | None = None) -> str:
    """`body` preceded by the definitions it needs, in order of dependence."""
    known = {**TABLES, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_0-9]+", text)):
            if word in known and word not in needed and text is not known[word]:
                visit(known[word])
                if word not in needed:
                    needed.append(word)

    visit(body)
    heads = ", ".join(f"{name} AS {'MATERIALIZED ' if name in KEPT else ''}({known[name].strip()})" for name in needed)
    body = body.strip()
    if not heads:
        return body
    if body.startswith("WITH "):
        return f"WITH {heads}, {body[5:]}"
    return f"WITH {heads} {body}"
