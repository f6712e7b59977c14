"""Star schema and measures on hand fixtures."""

from __future__ import annotations

from decimal import Decimal

import pytest

from mercadia.functions.measures import FINANCIAL, LOGISTICS, QUALITY, SELLERS, measures
from mercadia.plans import star
from tests.fixtures import marketplace


@pytest.fixture(scope="module")
def s(spark):
    return star.build_star(marketplace(spark))


def test_dim_date_default_span(spark):
    dd = star.dim_date(spark)
    assert dd.count() == 1096
    first = dd.where("date_key = 20160101").first()
    assert (first["year"], first["quarter"], first["month"], first["month_name"],
            first["day_of_month"], first["day_name"], first["day_of_week"],
            first["is_weekend"]) == (2016, 1, 1, "January", 1, "Friday", 6, 0)
    sat = dd.where("date_key = 20160102").first()
    assert (sat["day_name"], sat["day_of_week"], sat["is_weekend"]) == ("Saturday", 7, 1)


def test_dim_date_covers_orders(s):
    keys = {r[0] for r in s.dim_date.select("date_key").collect()}
    assert 20170101 in keys and 20181231 in keys and 20161231 not in keys


def test_dimensions(s):
    geo = {r["state_key"]: r["region"] for r in s.dim_geography.collect()}
    assert geo == {"SP": "Sudeste", "RJ": "Sudeste", "AM": "Norte", "PR": "Sul", "XX": "Unknown"}
    seg = {r["seller_key"]: r["segment_tier"] for r in s.dim_seller.collect()}
    assert seg["s4"] == "No Fulfilled Orders" and seg["s1"] == "Operational Risk"
    cats = {r["product_key"]: r["category_name_en"] for r in s.dim_product.collect()}
    assert cats == {"p1": "health_beauty", "p2": "unknown", "p3": "unknown", "p4": "unknown"}


def test_facts(s):
    fo = s.fact_orders
    assert fo.count() == 10
    o3 = fo.where("order_id = 'o3'").first()
    assert (o3["date_key"], o3["is_delayed"], o3["is_cancelled"], o3["lead_time_days"]) == \
        (20170201, 1, 0, 9)
    fr = {r["review_id"]: r for r in s.fact_reviews.collect()}
    assert len(fr) == 5
    assert fr["r2"]["seller_key"] == "s1" and fr["r3"]["seller_key"] == "s1"  # lowest seller
    assert fr["r5"]["seller_key"] is None                                    # no items
    assert fr["r4"]["date_key"] is None and fr["r1"]["response_time_days"] == 1


def test_measures_global(s):
    m = measures(s, FINANCIAL + LOGISTICS + QUALITY + SELLERS).first().asDict()
    assert m["total_revenue"] == Decimal("460.00") and m["total_orders"] == 8
    assert m["avg_ticket"] == Decimal("57.500000")
    assert m["revenue_at_risk"] == Decimal("140.00")
    assert m["pct_revenue_at_risk"] == 140 / 460
    # order grain: mean of 8, 22, 9, 3, 8 (item grain would give 80/7)
    assert m["avg_lead_time_days"] == Decimal("10.000000")
    assert (m["delayed_orders"], m["cancelled_orders"]) == (2, 1)
    assert m["sla_pct"] == Decimal("0.750000")
    assert m["avg_review_score"] == Decimal("3.000000") and m["total_reviews"] == 5
    assert m["avg_response_time_days"] == Decimal("1.000000")
    assert (m["total_sellers"], m["gold_partners"], m["operational_risk_sellers"]) == (4, 0, 3)


def test_measures_sliced_sum_to_total(s):
    total = measures(s, ["total_revenue", "total_orders"]).first()
    by_cat = measures(s, ["total_revenue", "total_orders"], ["category"]).collect()
    assert sum(r["total_revenue"] for r in by_cat) == total["total_revenue"]
    # one order may touch several categories
    assert sum(r["total_orders"] for r in by_cat) >= total["total_orders"]
    by_year = {r["year"]: r.asDict() for r in
               measures(s, ["total_revenue", "total_reviews"], ["year"]).collect()}
    assert by_year[2017]["total_revenue"] == Decimal("380.00")
    assert by_year[None]["total_reviews"] == 1 and by_year[None]["total_revenue"] is None


def test_measures_where_and_unreachable(s):
    m = measures(s, ["total_revenue"], ["customer_region"],
                 where={"customer_region": ["Sudeste"]}).collect()
    assert [(r["customer_region"], r["total_revenue"]) for r in m] == [("Sudeste", Decimal("290.00"))]
    with pytest.raises(ValueError):
        measures(s, ["avg_review_score"], ["category"])


def test_measures_two_dimensions_and_range_filter(s):
    m = measures(s, ["total_revenue", "total_orders"], ["year", "seller_state"],
                 where={"year": range(2017, 2018)})
    got = {(r["year"], r["seller_state"]): (r["total_revenue"], r["total_orders"])
           for r in m.collect()}
    # 2017 items: s1 (SP) o1 150 + o2 80; s2 (RJ) o2 20, o3 0, o6 30; s3 (PR) o4 40, o5 60
    assert got == {(2017, "SP"): (Decimal("230.00"), 2), (2017, "RJ"): (Decimal("50.00"), 3),
                   (2017, "PR"): (Decimal("100.00"), 2)}
    seg = measures(s, ["avg_review_score", "total_reviews", "total_sellers"], ["seller_region"])
    rows = {r["seller_region"]: r for r in seg.collect()}
    assert rows["Sudeste"]["total_sellers"] == 3 and rows["Sul"]["total_sellers"] == 1
    assert rows["Sudeste"]["total_reviews"] == 4   # r1-r4; r5 has no seller
