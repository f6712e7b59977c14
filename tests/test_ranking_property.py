"""Property: bucketed ranks equal plain window ranks for any input."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from mercadia.operators.ranking import range_rank, window_rank

rows = st.lists(
    st.tuples(st.one_of(st.none(), st.integers(0, 6)),       # many ties
              st.one_of(st.none(), st.integers(-3, 3)),
              st.sampled_from(["a", "b", None])),
    min_size=1, max_size=60)


@settings(max_examples=12, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(data=rows, buckets=st.integers(1, 9), method=st.sampled_from(
    ["rank", "dense_rank", "percent_rank"]), partitioned=st.booleans(),
    asc=st.booleans())
def test_bucketed_equals_window(spark, data, buckets, method, partitioned, asc):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id long, x int, y int, p string")
    order = [("x", asc), ("y", False)]
    part = ["p"] if partitioned else []
    exp = {r["id"]: r["r"] for r in window_rank(df, order, method, "r", part).collect()}
    got = {r["id"]: r["r"] for r in
           range_rank(df, order, method, "r", part, ranges=buckets).collect()}
    assert got == exp


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(data=rows, buckets=st.integers(1, 9), tiles=st.integers(1, 7))
def test_bucketed_ntile_equals_window(spark, data, buckets, tiles):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id long, x int, y int, p string")
    order = [("x", False), ("id", True)]
    exp = {r["id"]: r["r"] for r in window_rank(df, order, f"ntile:{tiles}", "r").collect()}
    got = {r["id"]: r["r"] for r in range_rank(df, order, f"ntile:{tiles}", "r", unique=True,
                                                  ranges=buckets).collect()}
    assert got == exp
