"""Gates that lose nothing, ranks by range partitioning, quotients rounded once, published star."""

from __future__ import annotations

from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from mercadia.functions import measures
from mercadia.functions.expressions import ratio, with_region
from mercadia.operators import gates
from mercadia.plans import reports, star, supplier
from mercadia.session import checkpoint_dir, scale_conf
from mercadia.sources import csv_ingest, publish, testdata

SF = "/root/testdata/sf0.001"


def test_pk_gate_counts_exact_copies(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (2, 1, "x")], "k int, o int, v string")
    acc, rej = gates.pk_gate(df, ["k"], ["o"])
    assert sorted(tuple(r) for r in acc.collect()) == [(1, 1, "a"), (2, 1, "x")]
    assert sorted(tuple(r)[:3] for r in rej.collect()) == [(1, 1, "a"), (1, 2, "b")]


def test_ratio_rounds_once(spark):
    df = spark.range(1, 700, 1, 4).crossJoin(spark.range(1, 700).toDF("a")).where("a <= id")
    got = df.select("a", "id", ratio("a", "id", 4).alias("r")).collect()
    wrong = [(r.a, r.id) for r in got
             if r.r != (Decimal(r.a) / Decimal(r.id)).quantize(Decimal("0.0001"), ROUND_HALF_UP)]
    assert wrong == []
    one = spark.range(1).select(ratio(F.lit(50), F.lit(101), 4).alias("x"), ratio(F.lit(-1), F.lit(8), 2).alias("y"),
                                ratio(F.lit(1), F.lit(0), 2).alias("z")).first()
    assert (one.x, one.y, one.z) == (Decimal("0.4950"), Decimal("-0.13"), None)


def _csv(path, header, rows):
    with open(path, "w", encoding="utf-8") as f:
        f.write(header + "\n" + "".join(r + "\n" for r in rows))
    return path


def _sources(d, items, reviews, sellers=("s1,01000,x,SP",)):
    h = {t: ",".join(c) for t, c in __import__("mercadia.sources.schemas", fromlist=["x"]).RAW_COLUMNS.items()}
    return {
        "customers": _csv(f"{d}/c.csv", h["customers"], ["c1,u1,01000,x,SP"]),
        "sellers": _csv(f"{d}/s.csv", h["sellers"], sellers),
        "products": _csv(f"{d}/p.csv", h["products"], ["p1,cat,1,1,1,1,1,1,1"]),
        "orders": _csv(f"{d}/o.csv", h["orders"], [
            "o1,c1,delivered,2017-01-01 00:00:00,,,2017-01-05 00:00:00,2017-01-09 00:00:00"]),
        "order_items": _csv(f"{d}/i.csv", h["order_items"], items),
        "order_payments": _csv(f"{d}/y.csv", h["order_payments"], ["o1,1,card,1,10.00"]),
        "order_reviews": _csv(f"{d}/r.csv", h["order_reviews"], reviews)}


ITEM = "o1,{n},p1,s1,2017-01-02 00:00:00,{price},1.00"
REVIEW = '{id},{order},5,,"two\nlines",2017-01-06 00:00:00,2017-01-07 00:00:00'


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("load"))
    src = _sources(d, [ITEM.format(n=1, price="10.00"), ITEM.format(n="99999999999", price="10.00"),
                       ITEM.format(n=2, price="123456789012.00"), "o1,3,p1"],
                   [REVIEW.format(id="r1", order="oX"), REVIEW.format(id="r1", order="o1")],
                   ("s1,01000,x,SP", "s2,01000,x,SP,EXTRA,COLS", "s3"))
    return csv_ingest.load_marketplace(spark, src, stage_dir=f"{d}/base"), d


def test_foreign_key_before_primary_key(loaded):
    load, _ = loaded
    assert [r.order_id for r in load.tables.reviews.collect()] == ["o1"]
    assert [(r.order_id, r.reject_reason) for r in load.rejects["order_reviews"].collect()] == \
        [("oX", "missing_parent:order_id")]


def test_rejects_are_readable_and_writable(loaded):
    load, d = loaded
    publish.write_tables({"x": load.rejects["order_items"]}, f"{d}/rejects")
    why = Counter(r.reject_reason.split(",")[0] for r in load.rejects["order_items"].collect())
    assert why == {"order_item_id:out_of_range": 1, "price:out_of_range": 1, "row:malformed": 1}
    assert load.tables.items.count() == 1


def test_malformed_lines_are_rejected(loaded):
    load, _ = loaded
    assert [r.seller_id for r in load.tables.sellers.collect()] == ["s1"]
    assert {r.reject_reason.split(",")[0] for r in load.rejects["sellers"].collect()} == {"row:malformed"}


def test_staged_rejects_do_not_parse_csv_again(loaded):
    plan = loaded[0].rejects["order_items"]._jdf.queryExecution().executedPlan().toString()
    assert "csv" not in plan.lower().replace("_csv", "")


def test_split_csv_keeps_the_first_row(spark, tmp_path):
    rows = [f"s{k % 40000},{k:05d},{'x' * 60},SP" for k in range(80000)]
    path = _csv(f"{tmp_path}/s.csv", "seller_id,seller_zip_code_prefix,seller_city,seller_state", rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        raw = csv_ingest.read_raw(spark, path, "sellers")
        assert raw.rdd.getNumPartitions() > 1
        acc, rej = gates.pk_gate(csv_ingest.parse(raw, "sellers"), ["seller_id"], [csv_ingest.POS],
                                 row_id=csv_ingest.POS)
        assert (acc.count(), rej.count()) == (40000, 40000)
        assert acc.where(F.col("seller_zip_code_prefix").cast("int") >= 40000).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_checkpoint_dir_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://h:7077"}.get(key, default)

    class Session:
        conf = Conf()
    with pytest.raises(ValueError):
        checkpoint_dir(Session())


def test_scale_conf_has_no_cap():
    assert scale_conf(10 ** 15)["spark.sql.shuffle.partitions"] == str(-(-10 ** 15 // (1 << 30)))


def test_region_lookup_with_a_state_twice(spark):
    df = spark.createDataFrame([("a",)], "s string")
    lookup = spark.createDataFrame([("a", "R1"), ("a", "R2")], "state string, region string")
    assert [r.region for r in with_region(df, "s", lookup).collect()] == ["R1"]


def _scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_trimmed_plans(spark):
    t = testdata.load(spark, SF)
    for df in (supplier.seller_revenue(t), reports.dim_row_counts(star.build_star(t))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("lineitem.parquet") == (1 if "total_revenue" in df.columns else 0)
    from mercadia.operators.quality import quality_report
    plan = quality_report(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1


def test_published_star_measures_prune_years(spark, tmp_path):
    t = testdata.load(spark, SF)
    base = star.build_star(t)
    publish.publish_star(base, str(tmp_path))
    read = star.read_star(spark, str(tmp_path))
    names = measures.FINANCIAL + measures.LOGISTICS + measures.SELLERS
    for by, where in ((["year"], {}), (["category"], {"year": 1996}), (["customer_region"], {"segment_tier": "Operational Risk"}),
                      (["is_weekend"], {"category": ["category_11"]})):
        a, b = (sorted(tuple(r) for r in measures.measures(s, names, by, where).collect()) for s in (base, read))
        assert a == b and a
    plan = measures.measures(read, ["total_revenue"], ["category"], {"year": 1996})._jdf.queryExecution()
    assert "PartitionFilters: [isnotnull(year" in plan.executedPlan().toString() or \
        "PartitionFilters: [(year" in plan.executedPlan().toString()


def test_seller_counts_repeat_along_other_slices(spark):
    s = star.build_star(testdata.load(spark, SF))
    rows = measures.measures(s, ["total_sellers"], ["year"]).collect()
    assert len(rows) > 1 and len({r.total_sellers for r in rows}) == 1
    with pytest.raises(ValueError, match="unknown attributes"):
        measures.measures(s, ["total_revenue"], ["nope"])


def test_star_properties_run_nothing(spark):
    s = star.build_star(testdata.load(spark, SF))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    _ = s.dim_seller, s.fact_orders
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
