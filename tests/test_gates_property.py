"""Properties of the load gates, checked against brute force on random inputs."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from mercadia.operators import gates

rows = st.lists(st.tuples(st.integers(0, 4),                      # key: many duplicates
                          st.one_of(st.none(), st.integers(0, 3)),  # order column with NULLs
                          st.text("ab", max_size=2)),
                min_size=1, max_size=40)

SETTINGS = dict(max_examples=10, deadline=None,
                suppress_health_check=[HealthCheck.function_scoped_fixture,
                                       HealthCheck.too_slow])


@settings(**SETTINGS)
@given(data=rows)
def test_pk_gate_keeps_first_row_per_key(spark, data):
    df = spark.createDataFrame(data, "k int, o int, v string")
    acc, rej = gates.pk_gate(df, ["k"], ["o"])

    def sort_key(r):  # ascending, NULLs first, then the other column
        return (r[1] is not None, r[1] if r[1] is not None else 0, r[2])
    first = {}
    for r in sorted(data, key=sort_key):
        first.setdefault(r[0], r)
    def canon(rs):
        return sorted(rs, key=lambda r: (r[0], *sort_key(r)))
    assert canon(tuple(r) for r in acc.collect()) == canon(first.values())
    rest = list(data)   # exact copies included: one of each winner is accepted
    for r in first.values():
        rest.remove(r)
    assert canon(tuple(r)[:3] for r in rej.collect()) == canon(rest)


@settings(**SETTINGS)
@given(child=st.lists(st.one_of(st.none(), st.integers(0, 6)), min_size=1, max_size=40),
       parent=st.lists(st.integers(0, 6), max_size=10))
def test_fk_gate_splits_by_parent_membership(spark, child, parent):
    c = spark.createDataFrame([(i, v) for i, v in enumerate(child)], "id int, fk int")
    p = spark.createDataFrame([(v,) for v in parent], "pk int")
    kept, rej = gates.fk_gate(c, p, [("fk", "pk")])
    keys = set(parent)
    assert sorted(r["id"] for r in kept.collect()) == \
        [i for i, v in enumerate(child) if v is not None and v in keys]
    assert sorted(r["id"] for r in rej.collect()) == \
        [i for i, v in enumerate(child) if v is None or v not in keys]
