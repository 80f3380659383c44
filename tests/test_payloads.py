import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from saltcellar import schemas
from saltcellar.operators import coverage, payloads
from saltcellar.plans import samples
from saltcellar.sources import sample, sinks
from saltcellar.sources.files import parse_payload, read_payload

PLACE = "store_a"


def documents(spark, payloads_list, schema=schemas.ORDER_PAYLOAD):
    texts = spark.createDataFrame([(json.dumps(p),) for p in payloads_list], "document string")
    return parse_payload(texts, "document", schema)


ORDERS = [
    {
        "guid": "o1", "businessDate": 20240229, "openedDate": "2024-02-29T19:45:30.000+0000", "source": "KIOSK",
        "checks": [
            {
                "totalAmount": 41.75, "amount": 36.0, "taxAmount": 3.25,
                "payments": [{"type": "GIFTCARD", "amount": 41.75, "tipAmount": 4.5, "paidDate": "2024-02-29"}],
                "appliedDiscounts": [{"discountAmount": 2.0}, {"discountAmount": 0.75}],
                "selections": [
                    {"displayName": "Bao", "quantity": 2, "preDiscountPrice": 8.0, "price": 7.5, "salesCategory": {"name": "Food"},
                     "modifiers": [{"displayName": "hot"}]},
                    {"displayName": "Gone", "voided": True, "quantity": 1, "price": 3.0},
                    {"displayName": "Tea", "quantity": None, "price": None},
                    {"displayName": "Zero", "quantity": 0, "price": 1.0},
                ],
                "customer": {"email": " A@x.org ", "phone": "", "firstName": None, "lastName": "Li"},
                "employee": {"guid": "e1"},
            },
            {"voided": True, "totalAmount": 99.0, "amount": 99.0, "payments": [{"amount": 99.0}], "selections": [{"displayName": "No"}],
             "customer": {"email": "b@x.org"}},
            {"totalAmount": 8.5, "amount": 8.0, "taxAmount": 0.5, "appliedDiscounts": [{"discountAmount": 0.25}],
             "payments": [{"type": "CASH", "amount": 8.5, "tipAmount": 1.0, "paidDate": "2024-02-29"}]},
            {"totalAmount": None, "payments": [{"amount": None}], "customer": {"email": " ", "phone": None}},
        ],
    },
    {"guid": "o2", "voided": True, "businessDate": 20240229, "checks": [{"totalAmount": 5.0}]},
    {"businessDate": 20240229, "checks": [{"totalAmount": 7.0}]},
    {"guid": "o3", "businessDate": 20240301},
]


def test_orders_skip_voided_parts_and_rows_without_guid(spark, rows):
    got = rows(payloads.flatten_orders(documents(spark, ORDERS), F.lit(PLACE)), "order_guid")
    assert [r["order_guid"] for r in got] == ["o1", "o3"]
    first = got[0]
    assert (first["total_amount"], first["subtotal"], first["tax_amount"]) == (50.25, 44.0, 3.75)
    assert (first["tip_amount"], first["discount_amount"]) == (5.5, 3.0)
    assert first["order_type"] == "KIOSK" and first["business_date"] == "20240229" and first["location_id"] == PLACE
    assert got[1]["order_type"] == "UNKNOWN" and got[1]["total_amount"] == 0.0 and got[1]["order_time"] == ""


def test_items_fill_quantity_price_and_category(spark, rows):
    got = rows(payloads.flatten_order_items(documents(spark, ORDERS), F.lit(PLACE)), "item_name")
    assert [(r["item_name"], r["quantity"], r["total_price"], r["category"]) for r in got] == [
        ("Bao", 2, 7.5, "Food"), ("Tea", 1, 0.0, ""), ("Zero", 1, 1.0, ""),
    ]


def test_payments_have_defaults(spark, rows):
    got = rows(payloads.flatten_payments(documents(spark, ORDERS), F.lit(PLACE)), "payment_method")
    assert [(r["payment_method"], r["amount"], r["payment_date"]) for r in got] == [
        ("CASH", 8.5, "2024-02-29"), ("GIFTCARD", 41.75, "2024-02-29"), ("UNKNOWN", 0.0, ""),
    ]


def test_customers_need_one_contact(spark, rows):
    got = rows(payloads.flatten_customers(documents(spark, ORDERS), F.lit(PLACE)))
    assert len(got) == 1
    assert got[0]["customer_email"] == "A@x.org" and got[0]["customer_phone"] is None and got[0]["last_name"] == "Li"


def test_menus_as_list_or_single_menu(spark, rows):
    group = {"name": "Mains", "menuItems": [{"name": "Rice", "price": 4.5}, {"name": "", "price": 1.0}, {"price": 2.0}, {"name": "Soup"}]}
    menus = documents(spark, [{"menus": [{"menuGroups": [group]}]}, {"menuGroups": [group]}], schemas.MENU_PAYLOAD)
    got = rows(payloads.flatten_menus(menus, F.lit(PLACE), "20260410"), "item_name")
    assert [(r["item_name"], r["unit_cost"], r["category"], r["status"]) for r in got] == [
        ("Rice", 4.5, "Mains", "good"), ("Rice", 4.5, "Mains", "good"), ("Soup", 0.0, "Mains", "good"), ("Soup", 0.0, "Mains", "good"),
    ]


@pytest.mark.parametrize(
    "path, value",
    [
        ("checks[].payments[].type", "GIFTCARD"), ("checks[].appliedDiscounts[].discountAmount", 2.0), ("guid", "o1"),
        ("checks[].selections[].salesCategory.name", "Food"), ("diningOption.name", None), ("checks[].server.guid", None),
    ],
)
def test_first_nested(spark, path, value):
    got = documents(spark, ORDERS).filter("guid = 'o1'").select(payloads.first_nested(path).alias("v")).first()
    assert got["v"] == value


@pytest.mark.parametrize(
    "given, expected",
    [
        ("2026-04-10T12:00:00+0000", "2026-04-10T12:00:00+00:00"), ("2026-04-10T12:00:00Z", "2026-04-10T12:00:00+00:00"),
        ("2026-04-10T12:00:00.250-05:30", "2026-04-10T17:30:00+00:00"), ("2026-04-10", "2026-04-10T00:00:00+00:00"),
        ("yesterday", None), ("", None), (None, None), ("2026-13-40T00:00:00Z", None),
    ],
)
def test_timestamp_normalize(spark, given, expected):
    df = spark.createDataFrame([(given,)], "t string")
    assert df.select(payloads.timestamp_normalize(F.col("t")).alias("v")).first()["v"] == expected


def media(spark, items):
    return documents(spark, items, schemas.MEDIA_PAYLOAD)


def test_media_rows(spark, rows):
    items = [
        {
            "id": " m1 ", "caption": " hi ", "media_type": "CAROUSEL_ALBUM", "media_product_type": "FEED", "timestamp": "2026-04-10T23:30:00-0200",
            "like_count": "7", "comments_count": "", "views": "x",
            "children": {"data": [{"id": "c1", "media_type": "IMAGE", "timestamp": "2026-04-10T10:00:00+0000", "media_url": " "}]},
        },
        {"id": "m2", "media_type": "VIDEO", "media_product_type": "reels", "likes": "3", "children": {"data": []}},
        {"id": " ", "media_type": "IMAGE"},
    ]
    df = payloads.media_snapshots(media(spark, items), F.lit("a1"), F.lit("user"), F.lit(" "), F.lit("run"))
    first, second = rows(df, "media_id")
    assert first["media_type"] == "CAROUSEL" and first["posted_at_utc"] == "2026-04-11T01:30:00+00:00" and first["posted_date_utc"] == "20260411"
    assert first["likes"] == 7 and first["comments_count"] is None and first["views"] is None and first["account_label"] == "user"
    child = json.loads(first["children_json"])
    assert first["child_count"] == 1 and child[0]["posted_date_utc"] == "20260410" and child[0]["media_url"] is None
    assert second["media_type"] == "REEL" and second["likes"] == 3 and second["children_json"] is None and second["child_count"] == 0
    assert second["posted_at_utc"] is None


def test_insights(spark, rows):
    items = [
        {"id": "m1", "reach": "1", "insights": [
            {"name": "reach", "value": 5}, {"name": "saved", "values": [{"value": 2}, {"value": 9}]}, {"name": "shares"}, {"name": "reach", "value": 6}]},
        {"id": "m2", "reach": "1"},
    ]
    first, second = rows(payloads.insights_pivot(media(spark, items)).select("id", "reach", "saved", "shares"), "id")
    assert (first["reach"], first["saved"], first["shares"]) == ("6", "2", None)
    assert (second["reach"], second["saved"]) == ("1", None)


def test_media_window_keeps_undated_items(spark, rows):
    stamps = {"a": "2026-04-01T00:00:00+0000", "b": "2026-04-30T23:59:59.999Z", "c": "2026-05-01T00:00:00Z", "d": None, "e": "2026-03-31T23:59:59Z", "f": "2026-05-01T00:30:00+0100"}
    df = media(spark, [{"id": k, "timestamp": v} for k, v in stamps.items()])
    assert [r["id"] for r in rows(payloads.media_window(df, "2026-04-01", "2026-04-30"), "id")] == ["a", "b", "d", "f"]
    assert len(rows(payloads.media_window(df, end="2026-04-30"))) == 5


def test_profile_rows(spark, rows):
    items = [
        {"id": " 9 ", "username": " ", "name": "N", "followers_count": "12", "media_count": "1.5", "snapshot_at": "2026-04-10T23:30:00-0200"},
        {"id": "8", "username": "u", "snapshot_at": "soon-ish"},
        {"username": "no id"},
    ]
    df = documents(spark, items, schemas.PROFILE_PAYLOAD)
    eight, nine = rows(payloads.profile_snapshot(df, F.lit(" "), F.lit("run")), "account_id")
    assert nine["account_label"] == "9" and nine["followers_count"] == 12 and nine["media_count"] is None
    assert nine["snapshot_at"] == "2026-04-11T01:30:00+00:00" and nine["snapshot_date"] == "20260411"
    assert eight["account_label"] == "u" and eight["snapshot_at"] == "soon-ish" and eight["snapshot_date"] == "soonish"


def test_coverage(spark):
    df = documents(spark, ORDERS)
    assert coverage.payload_profile(df).first().asDict() == {"orders": 4, "checks": 6, "payments": 4, "selections": 5}
    seen = coverage.customer_coverage(df).first()
    assert (seen["checks"], seen["with_customer"], seen["with_email"], seen["with_name"], seen["distinct_emails"]) == (6, 3, 2, 1, 2)
    assert [r[0] for r in coverage.masked_email_sample(df).collect()] == ["A***@x.org", "b***@x.org"]
    assert coverage.modifier_coverage(df).first().asDict() == {"selections": 4, "with_modifiers": 1, "pct": 25.0}
    assert coverage.server_coverage(df).first()["with_server"] == 1
    assert coverage.dining_option_coverage(df).first()["pct"] == 0.0


def test_payload_files_by_line_and_by_array(spark, tmp_path):
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(o) for o in ORDERS))
    (tmp_path / "array.json").write_text(json.dumps(ORDERS, indent=1))
    for name, by_line in (("lines.json", True), ("array.json", False)):
        df = read_payload(spark, str(tmp_path / name), schemas.ORDER_PAYLOAD, by_line)
        assert payloads.flatten_orders(df, F.lit(PLACE)).count() == 2


def _star(spark, folder):
    """Small tables of the sample's columns: orders with and without lines, of keys that do not start at one."""
    tables = {
        "region": ([(0, "AFRICA"), (1, "ASIA")], "r_regionkey int, r_name string"),
        "nation": ([(0, 0), (1, 1)], "n_nationkey int, n_regionkey int"),
        "customer": ([(k, f"Customer#{k}", k % 2, ("BUILDING", "HOUSEHOLD", "MACHINERY")[k % 3]) for k in range(5)], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "part": ([(k, f"new ring{k}", "SMALL", 5 * k, 9.5 + k) for k in range(4)], "p_partkey long, p_name string, p_type string, p_size int, p_retailprice double"),
        "orders": ([(700 + k, k % 5, "FOP"[k % 3], 2500.0 + k, dt.datetime(2001, 1, 1 + k), "1-URGENT") for k in range(9)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": (
            [(700 + k, n % 4, n + 1, 2.0, 40_000.0 + n, 0.05, 0.02, "NRA"[n % 3], "FO"[n % 2]) for k in range(8) for n in range(k % 4 + 1)],
            "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string",
        ),
    }
    for name, (found, schema) in tables.items():
        spark.createDataFrame(found, schema).write.parquet(f"{folder}/{name}.parquet")


def test_order_payloads_land_in_shares_and_packed(spark, rows, tmp_path, monkeypatch):
    _star(spark, tmp_path)
    whole = rows(sample.order_payload(spark, str(tmp_path)), "guid")
    plain = lambda found: [(r["guid"], r["businessDate"], sorted((c["amount"], len(c["selections"])) for c in r["checks"])) for r in found]
    for lines, shares in ((2_000_000, 1), (5, 4)):  # 20 lines in all
        monkeypatch.setattr(samples, "SHARE_LINES", lines)
        monkeypatch.setattr(samples, "ORDER_SHARES", shares)
        path = str(tmp_path / f"landed-{shares}")
        samples.Samples(spark, str(tmp_path)).land_orders(path, "location_id")
        found = rows(read_payload(spark, path, schemas.ORDER_PAYLOAD), "guid")
        assert plain(found) == plain(whole) and len(found) == 9 and sum(len(r["checks"]) for r in found) > 9
        assert all(p.name.endswith(".json.gz") for p in (tmp_path / f"landed-{shares}").glob("part-*"))
        runs = {p.name.split("-", 2)[2].split("-c000")[0] for p in (tmp_path / f"landed-{shares}").glob("part-*")}
        assert len(runs) == shares


def test_views_of_lines_are_stored_in_shares(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(samples, "ORDER_SHARES", 3)
    found = {}
    for lines in (2_000_000, 5):
        monkeypatch.setattr(samples, "SHARE_LINES", lines)
        folder = tmp_path / str(lines)
        _star(spark, folder)
        t = samples.Samples(spark, str(folder))
        with monkeypatch.context() as m:
            written = []
            m.setattr(sinks, "write_table", lambda df, path, mode, *a, f=sinks.write_table, **k: written.append(mode) or f(df, path, mode, *a, **k))
            found[lines] = [rows(df) for df in (t.stored_items, t.stored_gold, t.kpis)]
        assert written.count("append") == (0 if lines > 5 else 4)  # two views, three shares each
        found[lines] = [sorted(map(str, r)) for r in found[lines]]
    whole, shared = found.values()
    assert whole == shared and len(whole[0]) == len(whole[1]) == 20 and len(whole[2]) == 4
