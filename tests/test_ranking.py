"""Bucketed ranks equal plain window ranks, with ties, NULLs and a hot key."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from mercadia.operators.ranking import range_rank, window_rank, with_overall_means


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        hot = i % 3 == 0  # a third of all rows share one key
        a = 7 if hot else rng.randint(0, 40)
        b = None if rng.random() < 0.05 else Decimal(rng.randint(0, 30)) / 4
        p = rng.choice(["x", "y", "z", None])
        rows.append((i, a, b, p, float(rng.randint(0, 500))))
    return spark.createDataFrame(rows, "id long, a int, b decimal(10,2), p string, v double")


def same(left, right, cols):
    def rows(df):
        return sorted(tuple(r[c] for c in cols) for r in df.collect())
    return rows(left) == rows(right)


@pytest.mark.parametrize("method", ["rank", "dense_rank", "percent_rank"])
@pytest.mark.parametrize("order", [[("a", False), ("b", False)], [("a", True)],
                                   [("b", True), ("a", False)], [("v", False)]])
def test_global_ranks_match(data, method, order):
    exp = window_rank(data, order, method, "r")
    got = range_rank(data, order, method, "r", ranges=7)
    assert same(exp, got, ["id", "r"])


@pytest.mark.parametrize("method", ["rank", "dense_rank"])
def test_partitioned_ranks_match(data, method):
    order = [("a", False), ("b", False)]
    exp = window_rank(data, order, method, "r", ["p"])
    got = range_rank(data, order, method, "r", partition_by=["p"], ranges=5)
    assert same(exp, got, ["id", "r"])


@pytest.mark.parametrize("n", [3, 4, 7])
def test_ntile_and_row_number_match(data, n):
    order = [("a", False), ("id", True)]
    exp = window_rank(data, order, f"ntile:{n}", "r")
    got = range_rank(data, order, f"ntile:{n}", "r", unique=True, ranges=6)
    assert same(exp, got, ["id", "r"])
    exp = window_rank(data, order, "row_number", "r")
    got = range_rank(data, order, "row_number", "r", unique=True, ranges=6)
    assert same(exp, got, ["id", "r"])


def test_small_inputs(spark):
    one = spark.createDataFrame([(1, 5)], "id long, a int")
    assert range_rank(one, [("a", False)], "percent_rank", "r", ranges=4).first()["r"] == 0.0
    two = spark.createDataFrame([(1, 5), (2, 6)], "id long, a int")
    got = {r["id"]: r["r"] for r in
           range_rank(two, [("a", False), ("id", True)], "ntile:4", "r", unique=True).collect()}
    assert got == {2: 1, 1: 2}


def test_overall_means(spark):
    df = spark.createDataFrame([(Decimal("1.0"),), (Decimal("2.0"),), (Decimal("2.0"),)],
                               "x decimal(4,1)")
    r = with_overall_means(df, {"m": ("x", 1), "raw": ("x", 6)}).first()
    assert r["m"] == Decimal("1.7") and r["raw"] == Decimal("1.666667")
    assert df.select(F.lit(1)).count() == 3


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"),
                    reason="driver tables not present")
def test_supplier_mart_same_with_many_buckets(spark):
    from mercadia.plans import supplier
    from mercadia.sources import testdata
    t = testdata.load(spark, "/root/testdata/sf0.01")
    one = supplier.supplier_performance(t)
    many = supplier.supplier_performance(t, ranges=6)
    cols = ["seller_id", "quality_rank", "quality_rank_in_state", "revenue_quartile",
            "company_avg_review_score", "supplier_segment"]
    assert same(one, many, cols)
