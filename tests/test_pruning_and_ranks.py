"""Published facts pruned by any calendar filter, seller counts by several dimensions, ranks from one table of keys."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from mercadia.functions import measures
from mercadia.operators.ranking import dense_ranks_by_lead, join_ranks, window_rank
from mercadia.plans import star, supplier
from mercadia.sources import publish, testdata

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stars(spark, tmp_path_factory):
    base = star.build_star(testdata.load(spark, SF))
    folder = str(tmp_path_factory.mktemp("star"))
    publish.publish_star(base, folder)
    return base, star.read_star(spark, folder)


def files_read(df):
    """Files that the scans of the executed plan have read, by fact."""
    df.collect()
    found, todo = {}, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if name == "FileSourceScanExec" and node.metrics().contains("numFiles"):
            place = node.relation().location().rootPaths().mkString(",").rsplit("/", 1)[-1]
            found[place] = max(found.get(place, 0), node.metrics().apply("numFiles").value())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return found


@pytest.mark.parametrize("where", [{"month": 3}, {"quarter": [2, 3]}, {"month_name": "March"}, {"is_weekend": 1},
                                   {"day_of_month": 31}, {"month": 3, "is_weekend": 0}, {"year": 1996, "month": 2}])
def test_calendar_filters_prune_the_fact(spark, stars, where):
    base, read = stars
    names = ["total_revenue", "total_orders", "delayed_orders"]
    one, two = (measures.measures(s, names, ["category"], where) for s in (base, read))
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    every = files_read(measures.measures(read, names, ["category"]))["fact_orders"]
    some = files_read(measures.measures(read, names, ["category"], where))["fact_orders"]
    assert some == every if set(where) == {"is_weekend"} else some < every


def test_reviews_are_pruned_too(spark, stars):
    base, read = stars
    one, two = (measures.measures(s, measures.QUALITY, ["seller_region"], {"month": [1, 2]}) for s in (base, read))
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    assert files_read(two)["fact_reviews"] < files_read(measures.measures(read, measures.QUALITY))["fact_reviews"]
    everything = [sorted(map(repr, measures.measures(s, measures.QUALITY, ["year"]).collect())) for s in stars]
    assert everything[0] == everything[1]


def test_seller_counts_by_two_other_dimensions(spark, stars):
    base, _ = stars
    sellers = measures.measures(base, ["total_sellers"]).first()[0]
    rows = measures.measures(base, ["total_sellers", "gold_partners"], ["year", "category"]).collect()
    want = {(r[0], r[1]) for r in measures.measures(base, ["total_orders"], ["year", "category"]).collect()}
    assert {(r.year, r.category) for r in rows} == want and {r.total_sellers for r in rows} == {sellers}
    # the same beside a fact measure
    both = measures.measures(base, ["total_sellers", "total_orders"], ["year", "category"]).collect()
    assert {(r.year, r.category, r.total_sellers) for r in both} == {(r.year, r.category, r.total_sellers) for r in rows}
    some = measures.measures(base, ["total_sellers"], ["year", "category", "seller_region"],
                             {"year": 1996, "category": "category_11"}).collect()
    by_region = {r[0]: r[1] for r in measures.measures(base, ["total_sellers"], ["seller_region"]).collect()}
    assert some and all((r.year, r.category) == (1996, "category_11") and r.total_sellers == by_region[r.seller_region]
                        for r in some)


def test_ranks_by_lead_equal_windows(spark):
    rng = random.Random(3)
    rows = [(k, None if k % 19 == 0 else rng.choice("abc"), Decimal(1 if k % 3 == 0 else rng.randrange(9)) / 4,
             Decimal(rng.randrange(7)) / 8) for k in range(2500)]
    df = spark.createDataFrame(rows, "id long, state string, score decimal(6,4), rate decimal(6,4)")
    order = [("score", False), ("rate", False)]
    want = window_rank(window_rank(df, order, "dense_rank", "r"), order, "dense_rank", "s", ["state"])
    ranks = dense_ranks_by_lead(df, "score", "rate", "state", "r", "s")
    got = join_ranks(df, ranks, ["state", "score", "rate"])
    assert got.count() == 2500 and got.select(want.columns).exceptAll(want).isEmpty()
    assert dense_ranks_by_lead(df.limit(0), "score", "rate", "state", "r", "s").count() == 0


def test_supplier_ranks_need_two_written_tables(spark, monkeypatch):
    from mercadia.operators import ranking
    written = []
    for module in (supplier, ranking):
        real = module.materialized
        monkeypatch.setattr(module, "materialized", lambda df, name, real=real: written.append(name) or real(df, name))
    df = supplier.supplier_performance(testdata.load(spark, SF))
    assert written == ["sellers", "rank"] and df.count() > 0


def scanned(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {n for n in ("fact_orders", "order_cells") if f"/{n}" in plan}


@pytest.mark.parametrize("by, where", [
    ([], {}), (["year"], {}), (["category"], {"month": 3}), (["segment_tier", "customer_region"], {}),
    (["seller_region", "is_weekend"], {"category": ["category_11", "category_22"]}),
    (["seller_state", "customer_state"], {"year": 1996, "segment_tier": "Operational Risk"}), (["date_key"], {})])
def test_order_counts_from_sets(spark, stars, by, where):
    from mercadia.functions import order_sets
    base, read = stars
    one, two = (measures.measures(s, order_sets.NAMES, by, where) for s in stars)
    assert scanned(two) == {"order_cells"}
    got = sorted(map(repr, two.collect()))
    assert got == sorted(map(repr, one.collect())) and (got or where)


def test_other_measures_and_slices_read_the_fact(spark, stars):
    _, read = stars
    assert scanned(measures.measures(read, ["total_orders", "total_revenue"], ["year"])) == {"fact_orders"}
    assert scanned(measures.measures(read, ["total_orders"], ["customer_city"])) == {"fact_orders"}
    mixed = measures.measures(read, ["total_orders", "avg_review_score", "total_sellers"], ["seller_region"])
    assert scanned(mixed) == {"order_cells"} and mixed.count() > 0
    from mercadia.functions import order_sets
    with pytest.raises(ValueError, match="customer_city"):
        order_sets.measures_of(read, read.order_cells, ["customer_city"], {})


def test_sets_of_an_order_in_many_cells(spark):
    """An order counts once in every union; words hold up to 64 orders; a missing date or state is a value too."""
    from mercadia.functions import order_sets
    rng = random.Random(1)
    rows = [(f"o{k % 700}", f"c{k % 700 % 9}", f"s{rng.randrange(5)}", f"p{rng.randrange(4)}",
             None if k % 700 % 50 == 0 else 20170101 + k % 700 % 3, k % 700 % 4 == 0, k % 700 % 7 == 0) for k in range(3000)]
    cast = "order_id string, customer_key string, seller_key string, product_key string, date_key int, "
    fact = spark.createDataFrame([(*r[:5], int(r[5]), int(r[6])) for r in rows], cast + "is_delayed int, is_cancelled int")

    class Small:
        fact_orders = fact
        dim_customer = spark.createDataFrame([(f"c{k}", None if k == 8 else f"S{k % 2}") for k in range(9)],
                                             "customer_key string, state string")
        dim_seller = spark.createDataFrame([(f"s{k}", f"S{k % 2}", f"tier{k % 3}") for k in range(5)],
                                           "seller_key string, state string, segment_tier string")
        dim_product = spark.createDataFrame([(f"p{k}", f"cat{k % 3}") for k in range(4)],
                                            "product_key string, category_name_en string")

    cells = order_sets.order_cells(Small)
    got = {(r.category, r.segment_tier): (r.total_orders, r.delayed_orders, r.cancelled_orders)
           for r in order_sets.measures_of(Small, cells, ["category", "segment_tier"], {}).collect()}
    want = {}
    for r in rows:
        key = (f"cat{int(r[3][1:]) % 3}", f"tier{int(r[2][1:]) % 3}")
        for name, on in zip("odc", (True, r[5], r[6])):
            if on:
                want.setdefault(key, {}).setdefault(name, set()).add(r[0])
    assert got == {k: tuple(len(v.get(n, ())) for n in "odc") for k, v in want.items()}
    whole = order_sets.measures_of(Small, cells, [], {}).first()
    assert (whole.total_orders, whole.delayed_orders, whole.cancelled_orders) == (700, 175, 100)
    assert order_sets.measures_of(Small, cells, ["customer_state"], {"date_key": 20170103}).count() == 3


def test_published_names_in_a_catalog(spark, tmp_path):
    from mercadia import jobs
    from tests.test_load import CSV, TRANSLATION, write
    paths = {k: write(str(tmp_path), k, v) for k, v in CSV.items()}
    out = str(tmp_path / "out")
    jobs.refresh(spark, paths, write(str(tmp_path), "translation", TRANSLATION), out)
    names = publish.register_published(spark, out, "market")
    assert {"market.orders", "market.supplier_performance", "market.fact_orders", "market.dim_date"} <= set(names)
    other = spark.newSession()      # stored objects, not temporary views of one session
    assert other.sql("SELECT count(*) FROM market.fact_orders JOIN market.dim_date USING (date_key)").first()[0] == 1
    paths["customers"] = write(str(tmp_path), "customers2", CSV["customers"] + "c7,u7,1,x,SP\n")
    jobs.refresh(spark, paths, write(str(tmp_path), "translation", TRANSLATION), out)
    publish.register_published(spark, out, "market")
    assert other.sql("SELECT count(*) FROM market.dim_customer").first()[0] == 3
    spark.sql("DROP DATABASE market CASCADE")
