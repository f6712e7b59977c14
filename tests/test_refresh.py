"""Published versions, bucketed base tables and counts taken while loading."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from mercadia import jobs
from mercadia.operators import quality
from mercadia.plans import star, supplier
from mercadia.sources import buckets, csv_ingest, versions
from tests.test_load import CSV, TRANSLATION, write


@pytest.fixture()
def sources(scratch):
    def put(texts=CSV):
        paths = {k: write(scratch, k, v) for k, v in texts.items()}
        return paths, write(scratch, "translation", TRANSLATION)
    return put


def rows(df):
    return sorted(map(repr, df.collect()))


def many(orders=400, hot=0):
    """Sources with more orders, items and reviews; ``hot`` items of one order."""
    rng = random.Random(5)
    out = dict(CSV)
    out["orders"] += "".join(
        f"x{k},c{1 + k % 2},{rng.choice(['delivered', 'shipped', 'canceled'])},2017-0{1 + k % 9}-02 10:00:00,,,"
        f"{'2017-11-20 00:00:00' if k % 3 else ''},2017-11-1{k % 9} 00:00:00\n" for k in range(orders))
    out["order_items"] += "".join(f"x{k},{j},p{1 + j % 2},s1,,{rng.randrange(1, 9999) / 100:.2f},1.50\n"
                                  for k in range(orders) for j in range(1, 2 + k % 3))
    out["order_items"] += "".join(f"x0,{j},p1,s1,,1.00,1.00\n" for j in range(10, 10 + hot))
    out["order_reviews"] += "".join(f'rx{k},x{k},{1 + k % 5},,"line\nbreak, ""and"" quotes",2017-12-01 00:00:00,\n'
                                    for k in range(orders) if k % 4)
    return out


def test_readers_follow_the_manifest_only(spark, scratch, sources, monkeypatch):
    out = os.path.join(scratch, "out")
    jobs.refresh(spark, *sources(), out)
    before = {n: rows(df) for n, df in jobs.read_tables(spark, out).as_dict().items()}
    facts = rows(star.read_star(spark, out).fact_orders)
    assert before == {n: rows(df) for n, df in jobs.read_tables(spark, f"{out}/base").as_dict().items()}
    # new sources, and a refresh that fails in its load, behind its checks and before its manifest
    later = {k: v.replace("29.99", "31.99") for k, v in many(20).items()}

    class Stopped(Exception):
        pass

    def stop(*a, **k):
        raise Stopped

    places = [(buckets, "write"), (jobs, "supplier_performance"), (versions.Version, "publish")]
    for module, name in places:
        with monkeypatch.context() as m:
            m.setattr(module, name, stop)
            with pytest.raises(Stopped):
                jobs.refresh(spark, *sources(later), out)
        assert {n: rows(df) for n, df in jobs.read_tables(spark, out).as_dict().items()} == before, name
        assert rows(star.read_star(spark, out).fact_orders) == facts
    jobs.refresh(spark, *sources(later), out)
    after = jobs.read_tables(spark, out)
    assert after.orders.count() == 21 and after.items.where("price = 31.99").count() == 1
    assert star.read_star(spark, f"{out}/star").fact_orders.count() == after.items.count()


def test_old_versions_go(spark, scratch, sources):
    out = os.path.join(scratch, "out")
    for _ in range(3):
        jobs.refresh(spark, *sources(), out)
    assert [int(n.split("-")[0]) for n in sorted(os.listdir(f"{out}/versions"))] == [2, 3]
    assert sorted(n for n in os.listdir(f"{out}/_manifests") if n[0] != ".") == ["000000000002.json", "000000000003.json"]
    published = versions.current(spark, out)
    assert published.number == 3 and csv_ingest.TAGGED not in os.listdir(published.path("base/orders") + "/..")


def test_two_refreshes_at_once(spark, scratch):
    first, second = (versions.Version(spark, scratch) for _ in range(2))
    for v in (first, second):
        spark.range(v.number).write.parquet(f"{v.folder}/base/orders")
    first.publish({"base/orders": f"{first.folder}/base/orders"})
    with pytest.raises(RuntimeError):
        second.publish({"base/orders": f"{second.folder}/base/orders"})
    assert versions.current(spark, scratch).path("base/orders") == f"{first.folder}/base/orders"
    assert versions.current(spark, f"{scratch}/nothing") is None


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning(order_id" in line]


def test_orders_join_without_a_shuffle(spark, scratch, sources):
    out = os.path.join(scratch, "out")
    jobs.refresh(spark, *sources(many()), out)
    layouts = {n: t.get("layout") for n, t in versions.current(spark, out).tables.items() if n.startswith("base/")}
    assert {n for n, x in layouts.items() if x} == {"base/orders", "base/order_items", "base/order_reviews"}
    t = jobs.read_tables(spark, out)
    plain = jobs._tables(lambda n: spark.read.parquet(versions.current(spark, out).path(f"base/{n}")), spark, None)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for plan in (supplier.seller_metrics, supplier.ranked_sellers, supplier.seller_orders, star.fact_orders,
                     star.fact_reviews, lambda x: star.order_min_seller(x.items)):
            assert exchanges(plan(t)) == [] and exchanges(plan(plain)) != []
            assert rows(plan(t)) == rows(plan(plain))
        assert rows(supplier.supplier_performance(t)) == rows(supplier.supplier_performance(plain))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_hot_order_is_not_bucketed(spark, scratch, sources, monkeypatch):
    items = spark.createDataFrame([("hot" if k % 3 == 0 else f"o{k}",) for k in range(3000)], "order_id string")
    assert buckets.even(items, "order_id", 64) and not buckets.even(items, "order_id", 64, few=100)
    assert buckets.even(items.where("order_id <> 'hot'"), "order_id", 64, few=10)
    assert buckets.even(items.limit(0), "order_id", 64)
    real = buckets.even
    monkeypatch.setattr(buckets, "even", lambda df, column, n: real(df, column, n, few=10))
    out = os.path.join(scratch, "out")
    jobs.refresh(spark, *sources(many(hot=3000)), out)
    tables = versions.current(spark, out).tables
    assert "layout" in tables["base/orders"] and "layout" not in tables["base/order_items"]
    assert star.fact_orders(jobs.read_tables(spark, out)).count() == jobs.read_tables(spark, out).items.count()


def test_quality_is_counted_while_loading(spark, scratch, sources, monkeypatch):
    texts = many(60)
    texts["orders"] += "y1,c1,delivered,2017-10-02 10:56:33,,,,\n"
    texts["order_items"] += "y1,1,p2,s1,,0.00,1.00\ny1,2,p2,s1,,1.00,-2.00\n"
    texts["order_reviews"] += "ry,y1,9,,,,\n"
    for extra in ("", "y2,c1,lost,2017-10-02 10:56:33,,,,\n"):
        out = os.path.join(scratch, f"out{len(extra)}")
        with monkeypatch.context() as m:
            if not extra:       # no reading of the base tables
                for name in ("quality_report", "row_counts", "status_distribution"):
                    m.setattr(quality, name, None)
            written = jobs.refresh(spark, *sources({**texts, "orders": texts["orders"] + extra}), out)
        t = jobs.read_tables(spark, out)
        for name, df in (("row_counts", quality.row_counts(t)), ("quality_report", quality.quality_report(t)),
                         ("status_distribution", quality.status_distribution(t.orders))):
            assert rows(spark.read.parquet(written[f"quality/{name}"])) == rows(df), name
    found = {r["check"]: r.violations for r in spark.read.parquet(written["quality/quality_report"]).collect()}
    assert found["invalid_price_or_freight"] == 2 and found["invalid_review_scores"] == 1
    assert spark.read.parquet(written["quality/status_distribution"]).where(F.col("order_status") == "lost").count() == 1
