
from __future__ import annotations

from decimal import Decimal

import pytest

from mercadia.plans import financial, logistics, supplier
from mercadia.plans.thresholds import FinancialTiers, LogisticsTiers, SupplierTiers
from tests.fixtures import marketplace


def by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def t(spark):
    return marketplace(spark)


def test_order_logistics_late_same_day_has_zero_delay(t):
    rows = by(logistics.order_logistics(t), "order_id")
    assert set(rows) == {"o1", "o2", "o3", "o7"}  # delivered with a date and with items
    assert rows["o3"]["is_delayed"] == 1 and rows["o3"]["delay_days"] == 0
    assert rows["o7"]["is_delayed"] == 0 and rows["o7"]["delay_days"] is None
    assert rows["o2"]["lead_time_days"] == 22 and rows["o2"]["delay_days"] == 2


def test_logistics_regional(t):
    rows = by(logistics.logistics_regional(t), "customer_state")
    sp, rj, unk = rows["SP"], rows["RJ"], rows[None]
    assert sp["region"] == "Sudeste" and unk["region"] == "Unknown"
    assert sp["total_delivered_orders"] == 2
    assert sp["avg_lead_time_days"] == Decimal("8.5")
    assert sp["avg_delay_days"] == Decimal("-5.0")
    assert sp["pct_delayed"] == Decimal("0.5000")
    assert sp["avg_freight_value"] == Decimal("8.00")
    assert sp["total_revenue"] == Decimal("150.00")
    # o3 has revenue 0: its ratio is NULL and skipped by the average
    assert sp["avg_freight_to_revenue_ratio"] == Decimal("0.1000")
    assert (unk["lead_time_rank"], sp["lead_time_rank"], rj["lead_time_rank"]) == (1, 2, 3)
    assert (sp["lead_time_rank_in_region"], rj["lead_time_rank_in_region"],
            unk["lead_time_rank_in_region"]) == (1, 2, 1)
    assert sp["national_avg_lead_time_days"] == Decimal("12.8")
    assert sp["national_avg_pct_delayed"] == Decimal("0.5000")
    assert sp["lead_time_vs_national_avg"] == Decimal("-4.3")
    assert rj["lead_time_vs_national_avg"] == Decimal("9.2")
    assert unk["logistics_risk_tier"] == "Efficient Region"
    assert sp["logistics_risk_tier"] == "High Risk Region"


def test_logistics_tiers_boundaries(t):
    tiers = LogisticsTiers(efficient_delay=0.5, efficient_lead=8.5, moderate_delay=1.0,
                           moderate_lead=22)
    rows = by(logistics.logistics_regional(t, tiers), "customer_state")
    assert rows["SP"]["logistics_risk_tier"] == "Efficient Region"   # exactly on both bounds
    assert rows["RJ"]["logistics_risk_tier"] == "Moderate Delay Region"


def test_financial_health(t):
    rows = by(financial.financial_health(t), "category")
    hb, unk = rows["health_beauty"], rows["unknown"]
    assert (hb["total_orders"], hb["total_revenue"], hb["total_freight"]) == (5, Decimal("280.00"),
                                                                           Decimal("28.00"))
    assert hb["avg_ticket"] == Decimal("56.00")
    assert hb["revenue_at_risk"] == Decimal("80.00")
    assert hb["pct_revenue_at_risk"] == Decimal("0.2857")
    assert (hb["cancelled_items"], hb["late_delivered_items"]) == (0, 1)
    # 'canceled' counts as cancelled; blank, NULL and untranslated categories are 'unknown'
    assert (unk["total_orders"], unk["revenue_at_risk"], unk["cancelled_items"],
            unk["late_delivered_items"]) == (5, Decimal("60.00"), 1, 2)
    assert (hb["revenue_rank"], unk["revenue_rank"]) == (1, 2)
    assert (hb["revenue_percentile"], unk["revenue_percentile"]) == (1.0, 0.0)
    assert (hb["revenue_quartile"], unk["revenue_quartile"]) == (1, 2)
    assert hb["company_avg_ticket"] == Decimal("46.00")
    assert hb["company_avg_pct_revenue_at_risk"] == Decimal("0.3095")
    assert hb["financial_health_tier"] == "High Financial Risk"
    tuned = by(financial.financial_health(t, FinancialTiers(high_risk=0.3333, moderate_risk=0.2857)),
               "category")
    assert tuned["unknown"]["financial_health_tier"] == "High Financial Risk"
    assert tuned["health_beauty"]["financial_health_tier"] == "Moderate Financial Risk"
    low = by(financial.financial_health(t, FinancialTiers(high_risk=0.9, moderate_risk=0.3)),
             "category")
    assert low["health_beauty"]["financial_health_tier"] == "Financially Healthy"


def test_category_sums_add_up(t):
    cf = financial.category_financials(t).agg({"total_revenue": "sum"}).first()[0]
    items = t.items.agg({"price": "sum"}).first()[0]
    assert cf == items


def test_supplier_performance(t):
    rows = by(supplier.supplier_performance(t), "seller_id")
    assert set(rows) == {"s1", "s2", "s3"}  # s4 has no items
    s1, s2, s3 = rows["s1"], rows["s2"], rows["s3"]
    assert (s1["total_orders"], s1["total_items_sold"], s1["total_revenue"]) == (3, 4, Decimal("300.00"))
    assert s1["avg_item_price"] == Decimal("75.000000")
    # item-weighted reviews: two items of s1 in o1 count its review twice
    assert (s1["avg_review_score"], s1["total_reviews"]) == (Decimal("3.5000"), 4)
    assert (s2["avg_review_score"], s2["total_reviews"]) == (Decimal("2.6667"), 3)
    assert (s3["avg_review_score"], s3["total_reviews"]) == (Decimal("0"), 0)
    assert s1["on_time_rate"] == Decimal("0.5000")
    assert s2["on_time_rate"] == Decimal("0.0000")
    # s3: 'canceled' o4 is SLA-eligible but undelivered -> no known outcome -> 0
    assert s3["on_time_rate"] == 0
    assert (s1["quality_rank"], s2["quality_rank"], s3["quality_rank"]) == (1, 2, 3)
    assert all(r["quality_rank_in_state"] == 1 for r in rows.values())
    assert (s1["revenue_quartile"], s3["revenue_quartile"], s2["revenue_quartile"]) == (1, 2, 3)
    assert s1["company_avg_review_score"] == Decimal("2.06")
    assert s1["company_avg_on_time_rate"] == Decimal("0.1667")
    assert {r["supplier_segment"] for r in rows.values()} == {"Operational Risk"}


def test_supplier_segments_every_branch(t):
    tiers = SupplierTiers(gold_score=3.5, gold_on_time=0.5, gold_min_orders=3,
                          regular_score=2.5, regular_on_time=0.0)
    rows = by(supplier.supplier_performance(t, tiers), "seller_id")
    assert rows["s1"]["supplier_segment"] == "Gold Partner"
    assert rows["s2"]["supplier_segment"] == "Regular Operation"
    assert rows["s3"]["supplier_segment"] == "Operational Risk"
    fewer = SupplierTiers(gold_score=3.5, gold_on_time=0.5, gold_min_orders=4,
                          regular_score=2.5, regular_on_time=0.0)
    assert by(supplier.supplier_performance(t, fewer), "seller_id")["s1"]["supplier_segment"] \
        == "Regular Operation"


def test_supplier_excluded_statuses_parameter(t):
    # spelling the exclusion like the data removes o4 from s3's SLA population
    base = by(supplier.seller_orders(t), "order_id")
    fixed = by(supplier.seller_orders(t, excluded=("canceled", "cancelled", "unavailable")),
               "order_id")
    assert "o4" in base and "o5" not in base and "o9" not in base
    assert "o4" not in fixed


def test_review_fanout_equals_item_join(spark, t):
    """sum(k*s)/sum(k*c) equals the literal item x review join."""
    from pyspark.sql import functions as F
    lit = (t.items.join(t.reviews, "order_id").groupBy("seller_id")
           .agg(F.count("review_id").alias("n"), F.sum("review_score").alias("s")))
    got = by(supplier.seller_reviews(t), "seller_id")
    for r in lit.collect():
        assert got[r["seller_id"]]["total_reviews"] == r["n"]
        assert got[r["seller_id"]]["avg_review_score"] == round(Decimal(r["s"]) / r["n"], 4)
