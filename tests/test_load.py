"""CSV ingest, load gates, data-quality checks and publishing."""

from __future__ import annotations

import os
from decimal import Decimal

from pyspark.sql import functions as F

from mercadia.operators import gates, quality
from mercadia.plans import star
from mercadia.sources import csv_ingest, publish
from tests.fixtures import marketplace

BOM = "﻿"

CSV = {
    "customers": BOM + "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n"
                 "c1,u1,01000,\"são paulo\",SP\n"
                 "c2,u2,,\"rio, de janeiro\",RJ\n"
                 "c1,u9,99999,duplicate,SP\n",
    "sellers": "seller_id,seller_zip_code_prefix,seller_city,seller_state\n"
               "s1,01000,curitiba,PR\n"
               "s2,01000,toolongstate,PRX\n",
    "products": "product_id,product_category_name,product_name_lenght,product_description_lenght,"
                "product_photos_qty,product_weight_g,product_length_cm,product_height_cm,product_width_cm\n"
                "p1,beleza_saude,10,100,1,500,,20,30\n"
                "p2,,10,100,1,,,,\n",
    "orders": "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
              "order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"
              "o1,c1,delivered,2017-10-02 10:56:33,2017-10-02 11:07:15,,2017-10-10 21:25:13,2017-10-18 00:00:00\n"
              "o2,c9,delivered,2017-10-03 10:00:00,,,,\n"
              "o3,c2,shipped,not a date,,,,\n",
    "order_items": "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
                   "o1,1,p1,s1,2017-10-06 11:07:15,29.99,8.72\n"
                   "o1,1,p1,s1,2017-10-06 11:07:15,1.00,1.00\n"
                   "o2,1,p1,s1,,10.00,1.00\n"
                   "o1,2,p2,s1,,abc,1.00\n",
    "order_payments": "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
                      "o1,1,credit_card,1,38.71\n",
    "order_reviews": "review_id,order_id,review_score,review_comment_title,review_comment_message,"
                     "review_creation_date,review_answer_timestamp\n"
                     "r1,o1,4,,\"great, \"\"really\"\"\nsecond line\",2017-10-11 00:00:00,2017-10-12 03:43:48\n"
                     "r1,o1,1,dup,later row,2017-10-11 00:00:00,\n",
}
TRANSLATION = BOM + "product_category_name,product_category_name_english\nbeleza_saude,health_beauty\n"


def write(folder, name, text):
    path = os.path.join(folder, f"{name}.csv")
    with open(path, "w", encoding="utf-8", newline="") as fh:
        fh.write(text)
    return path


def test_csv_load_and_gates(spark, scratch):
    paths = {k: write(scratch, k, v) for k, v in CSV.items()}
    tr = write(scratch, "translation", TRANSLATION)
    res = csv_ingest.load_marketplace(spark, paths, tr)
    t = res.tables
    cust = {r["customer_id"]: r for r in t.customers.collect()}
    assert cust["c1"]["customer_city"] == "são paulo"            # first row wins, accents kept
    assert cust["c2"]["customer_city"] == "rio, de janeiro"       # quoted comma
    assert cust["c2"]["customer_zip_code_prefix"] == ""           # blank text stays blank
    assert [r["seller_id"] for r in t.sellers.collect()] == ["s1"]  # state too long
    prods = {r["product_id"]: r for r in t.products.collect()}
    assert prods["p1"]["product_category_name_english"] == "health_beauty"
    assert prods["p1"]["product_length_cm"] is None and prods["p1"]["product_weight_g"] == 500
    assert prods["p2"]["product_category_name"] == ""            # blank category is not NULL
    assert prods["p2"]["product_category_name_english"] is None
    orders = {r["order_id"]: r for r in t.orders.collect()}
    assert set(orders) == {"o1"}                                  # o2 orphan, o3 bad date
    assert orders["o1"]["order_delivered_carrier_date"] is None
    items = t.items.collect()
    assert [(r["order_id"], r["order_item_id"], r["price"]) for r in items] == \
        [("o1", 1, Decimal("29.99"))]
    rev = t.reviews.collect()
    assert len(rev) == 1 and rev[0]["review_score"] == 4 and rev[0]["review_comment_title"] is None
    rej = {k: [r["reject_reason"] for r in v.collect()] for k, v in res.rejects.items()}
    assert rej["customers"] == ["duplicate_key"]
    assert rej["sellers"] == ["seller_state:too_long"]
    assert sorted(rej["orders"]) == ["missing_parent:customer_id",
                                     "order_purchase_timestamp:invalid"]
    assert sorted(rej["order_items"]) == ["duplicate_key", "missing_parent:order_id",
                                          "price:invalid"]
    assert rej["order_reviews"] == ["duplicate_key"]
    # accepted + rejected = input
    for name in CSV:
        raw = csv_ingest.read_raw(spark, paths[name], name).count()
        acc = {"customers": t.customers, "sellers": t.sellers, "products": t.products,
               "orders": t.orders, "order_items": t.items, "order_payments": t.payments,
               "order_reviews": t.reviews}[name].count()
        assert acc + len(rej[name]) == raw, name


def test_multiline_quote_decoding(spark, scratch):
    path = write(scratch, "order_reviews", CSV["order_reviews"])
    raw = csv_ingest.read_raw(spark, path, "order_reviews").collect()
    assert raw[0]["review_comment_message"] == 'great, "really"\nsecond line'
    assert len(raw) == 2


def test_pk_gate_first_wins(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 5, "x"), (1, 2, "b")],
                               "k int, pos int, v string")
    acc, rej = gates.pk_gate(df, ["k"], ["pos"])
    assert sorted(tuple(r) for r in acc.collect()) == [(1, 1, "a"), (2, 5, "x")]
    assert sorted(r["pos"] for r in rej.collect()) == [2, 3]


def test_fk_and_domain_gates(spark):
    child = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "fk int, v string")
    parent = spark.createDataFrame([(1,)], "id int")
    keep, rej = gates.fk_gate(child, parent, [("fk", "id")])
    assert [r["v"] for r in keep.collect()] == ["a"]
    assert sorted(r["v"] for r in rej.collect()) == ["b", "c"]
    df = spark.createDataFrame([("ok", 1), ("too-long", None)], "s string, n int")
    valid, bad = gates.domain_gate(df, {"s:too_long": F.length("s") > 3, "n:null": F.col("n").isNull()})
    assert [r["s"] for r in valid.collect()] == ["ok"]
    assert bad.first()["reject_reason"] == "s:too_long,n:null"


def test_quality_checks(spark):
    t = marketplace(spark)
    rep = {r["check"]: r["violations"] for r in quality.quality_report(t).collect()}
    assert rep == {"products_without_english_category": 3,
                   "delivered_orders_missing_delivery_date": 1,
                   "invalid_price_or_freight": 1,   # o3 item has price 0
                   "invalid_review_scores": 0, "orphan_order_items": 0}
    dist = [tuple(r) for r in quality.status_distribution(t.orders).collect()]
    assert dist[0] == ("delivered", 6)
    counts = {r["table_name"]: r["row_count"] for r in quality.row_counts(t).collect()}
    assert counts["order_items"] == 10 and counts["order_payments"] == 0


def test_publish_is_idempotent(spark, scratch):
    s = star.build_star(marketplace(spark))
    out = os.path.join(scratch, "star")
    publish.publish_star(s, out)
    publish.publish_star(s, out)
    back = spark.read.parquet(os.path.join(out, "fact_orders"))
    assert back.count() == 10
    assert sorted(r[0] for r in back.select("year").distinct().collect()) == [2017, 2018]
    assert spark.read.parquet(os.path.join(out, "dim_date")).count() == 730
    names = publish.register_views({"fact_orders_v": s.fact_orders})
    assert spark.sql(f"SELECT count(*) FROM {names[0]}").first()[0] == 10
    paths = publish.write_tables(marketplace(spark).as_dict(), os.path.join(scratch, "base"))
    publish.write_tables(marketplace(spark).as_dict(), os.path.join(scratch, "base"))
    assert spark.read.parquet(paths["order_items"]).count() == 10


def test_refresh_job(spark, scratch):
    from mercadia import jobs
    paths = {k: write(scratch, k, v) for k, v in CSV.items()}
    tr = write(scratch, "translation", TRANSLATION)
    out = os.path.join(scratch, "out")
    written = jobs.refresh(spark, paths, tr, out)
    again = jobs.refresh(spark, paths, tr, out)   # idempotent reload
    assert written.keys() == again.keys()
    for name in written:
        one, two = (spark.read.parquet(p[name]) for p in (written, again))
        assert one.schema == two.schema and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty(), name
    assert spark.read.parquet(written["base/order_items"]).count() == 1
    assert spark.read.parquet(written["rejects/order_items"]).count() == 3
    assert spark.read.parquet(written["marts/supplier_performance"]).count() == 1
    seg = spark.read.parquet(written["star/dim_seller"]).first()["segment_tier"]
    assert seg == "Regular Operation"  # score 4, on time 1.0, one order
    q = {r["check"]: r["violations"] for r in
         spark.read.parquet(written["quality/quality_report"]).collect()}
    assert q["orphan_order_items"] == 0


def test_source_collation_opt_in(spark, scratch):
    from mercadia.functions.expressions import SOURCE_COLLATION
    from mercadia.plans import logistics
    csv = dict(CSV)
    csv["customers"] = (CSV["customers"]
                        + "C1 ,u7,01000,Sao Paulo,sp\n"      # c1 but for case and a trailing space
                        + "c3,u3,01000,SÃO PAULO,sp\n")
    csv["orders"] = CSV["orders"] + "o4,c3,delivered,2017-10-05 10:00:00,,,2017-10-08 10:00:00,2017-10-18 00:00:00\n"
    csv["order_items"] = CSV["order_items"] + "o4,1,p1,s1,,5.00,1.00\n"
    paths = {k: write(scratch, k, v) for k, v in csv.items()}
    tr = write(scratch, "translation", TRANSLATION)
    binary = csv_ingest.load_marketplace(spark, paths, tr)
    coll = csv_ingest.load_marketplace(spark, paths, tr, collation=SOURCE_COLLATION)
    assert binary.tables.customers.count() == 4
    assert coll.tables.customers.count() == 3            # 'C1' duplicates 'c1'
    states = [(r["customer_state"].upper(), r["total_delivered_orders"])
              for r in logistics.logistics_regional(coll.tables).collect()]
    assert states == [("SP", 2)]                          # 'SP' and 'sp' are one state
    assert {r["region"] for r in logistics.logistics_regional(coll.tables).collect()} == {"Sudeste"}
    cities = coll.tables.customers.groupBy("customer_city").count().collect()
    assert sorted(r["count"] for r in cities) == [1, 2]   # 'são paulo' = 'SÃO PAULO'


def test_parse_rules_tell_blank_invalid_and_out_of_range(spark, scratch):
    from mercadia.operators.gates import domain_gate
    text = ("order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
            "o1,1,p1,s1,,1.005,0\n"                       # rounds half up to 1.01
            "o1,2,p1,s1,,,1.00\n"                          # blank required price
            "o1,3,p1,s1,,12.3.4,1.00\n"                    # not a number
            "o1,4,p1,s1,,123456789.00,1.00\n"              # beyond DECIMAL(10,2)
            "o1,99999999999,p1,s1,not a date,1.00,1.00\n")  # int overflow, bad date
    path = write(scratch, "order_items", text)
    raw = csv_ingest.read_raw(spark, path, "order_items")
    parsed = csv_ingest.parse(raw, "order_items")
    valid, bad = domain_gate(parsed, csv_ingest.parse_rules("order_items", raw.columns))
    ok = csv_ingest.declared(valid, "order_items").drop("__raw").collect()
    assert [(r["order_item_id"], r["price"]) for r in ok] == [(1, Decimal("1.01"))]
    reasons = {r["__raw"]["order_item_id"]: r["reject_reason"] for r in bad.collect()}
    assert reasons == {"2": "price:null", "3": "price:invalid", "4": "price:out_of_range",
                       "99999999999": "order_item_id:out_of_range,shipping_limit_date:invalid"}


def test_register_all_for_sql_users(spark):
    from mercadia.plans.thresholds import SupplierTiers
    t = marketplace(spark)
    names = publish.register_all(t, supplier_tiers=SupplierTiers(
        gold_score=3.5, gold_on_time=0.5, gold_min_orders=3, regular_score=2.5,
        regular_on_time=0.0))
    assert {"supplier_performance", "logistics_regional", "financial_health", "dim_date",
            "fact_orders", "fact_reviews"} <= set(names)
    seg = spark.sql("""SELECT supplier_segment, COUNT(*) AS sellers,
                              ROUND(AVG(total_revenue), 2) AS avg_revenue
                       FROM supplier_performance GROUP BY supplier_segment""").collect()
    assert {r["supplier_segment"]: r["sellers"] for r in seg} == \
        {"Gold Partner": 1, "Regular Operation": 1, "Operational Risk": 1}
    tiers = spark.sql("SELECT segment_tier, COUNT(*) AS n FROM dim_seller GROUP BY 1").collect()
    assert {r["segment_tier"]: r["n"] for r in tiers}["No Fulfilled Orders"] == 1
    n = spark.sql("SELECT COUNT(*) FROM fact_orders f JOIN dim_date d USING (date_key)").first()[0]
    assert n == 10


def test_refresh_job_with_collation(spark, scratch):
    from mercadia import jobs
    from mercadia.functions.expressions import SOURCE_COLLATION
    paths = {k: write(scratch, k, v) for k, v in CSV.items()}
    tr = write(scratch, "translation", TRANSLATION)
    out = jobs.refresh(spark, paths, tr, os.path.join(scratch, "out"),
                       collation=SOURCE_COLLATION)
    schema = spark.read.parquet(out["base/customers"]).schema
    assert "UNICODE_CI_AI_RTRIM" in schema["customer_state"].dataType.simpleString()
    assert spark.read.parquet(out["marts/logistics_regional"]).count() == 1


def test_refresh_command_line(spark, scratch):
    from mercadia import jobs
    paths = {k: write(scratch, k, v) for k, v in CSV.items()}
    args = [x for k, p in paths.items() for x in (f"--{k.replace('_', '-')}", p)]
    out = os.path.join(scratch, "cli")
    written = jobs.main(args + ["--translation", write(scratch, "tr", TRANSLATION),
                                "--out", out])
    assert spark.read.parquet(written["star/fact_orders"]).count() == 1
