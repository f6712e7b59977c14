"""One order holding a third of all items: results stay exact and AQE splits
the hot join partition instead of sending it through one task."""

from __future__ import annotations

from collections import defaultdict
from decimal import Decimal

import pytest

from mercadia.plans import financial, supplier
from tests.fixtures import tables

SKEW_CONF = {"spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
             "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture()
def skewed(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    orders = [(f"o{i}", "c1", "delivered", "2017-01-02 10:00:00",
               "2017-01-10 09:00:00" if i % 2 else "2017-01-25 09:00:00",
               "2017-01-20 00:00:00") for i in range(60)]
    items = [("o0", j, f"p{j % 3}", f"s{j % 7}", 10, 1) for j in range(3000)]          # hot order
    items += [(f"o{i}", j, f"p{j % 3}", f"s{(i + j) % 7}", 5, 1)
              for i in range(1, 60) for j in range(100)]
    reviews = [("r0", "o0", 5, None, None), ("r1", "o1", 2, None, None), ("r2", "o1", 4, None, None)]
    t = tables(spark, [("c1", "u1", None, None, "SP")],
               [(f"s{i}", None, None, "SP") for i in range(7)],
               [(f"p{i}", "x", f"cat{i}", None, None, None, None) for i in range(3)],
               orders, items, (), reviews)
    yield t, orders, items, reviews
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_hot_order_seller_metrics(skewed):
    t, orders, items, reviews = skewed
    df = supplier.seller_metrics(t)
    got = {r["seller_id"]: r for r in df.collect()}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan  # the hot order's partition was split
    n_rev = defaultdict(int)
    s_rev = defaultdict(int)
    for _, o, score, _, _ in reviews:
        n_rev[o] += 1
        s_rev[o] += score
    exp = defaultdict(lambda: {"items": 0, "orders": set(), "rev": Decimal(0), "kc": 0, "ks": 0})
    for o, _, _, s, price, _ in items:
        e = exp[s]
        e["items"] += 1
        e["orders"].add(o)
        e["rev"] += Decimal(price)
        e["kc"] += n_rev[o]
        e["ks"] += s_rev[o]
    assert set(got) == set(exp)
    for s, e in exp.items():
        r = got[s]
        assert (r["total_items_sold"], r["total_orders"], r["total_revenue"], r["total_reviews"]) \
            == (e["items"], len(e["orders"]), e["rev"], e["kc"])
        assert r["avg_review_score"] == round(Decimal(e["ks"]) / e["kc"], 4)


def test_hot_order_category_financials(skewed):
    t, orders, items, _ = skewed
    late = {o for o, _, _, _, d, est in orders if d > est}
    got = {r["category"]: r for r in financial.category_financials(t).collect()}
    for c in range(3):
        rows = [i for i in items if i[2] == f"p{c}"]
        r = got[f"cat{c}"]
        assert r["total_orders"] == len({i[0] for i in rows})
        assert r["total_revenue"] == sum(Decimal(i[4]) for i in rows)
        assert r["late_delivered_items"] == sum(1 for i in rows if i[0] in late)
        assert r["revenue_at_risk"] == sum(Decimal(i[4]) for i in rows if i[0] in late)
