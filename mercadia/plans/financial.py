"""Category financial-health mart: one row per English category.

Plan shape: item rows get their category (join on ``product_id``) and their
order's status flags (join on ``order_id``), then collapse to one row per
``(order, category)`` while still partitioned by ``order_id`` (no extra
shuffle). Distinct orders per category are then plain row counts, so no
distinct-aggregate expansion is needed, and the final per-category aggregate
is partial. The category list is bounded (a translation list), so ranks use
plain windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercadia.fixed import STATUS_CANCELED, UNKNOWN_CATEGORY
from mercadia.functions.expressions import cancelled_flag, late_flag, ratio
from mercadia.model import Tables
from mercadia.operators.ranking import window_rank, with_overall_means
from mercadia.plans.thresholds import FinancialTiers



def order_category_base(t: Tables, cancelled: str = STATUS_CANCELED) -> DataFrame:
    """Item rows with category, price, freight and the order's two risk flags."""
    p = t.products.select(
        "product_id",
        F.coalesce(F.col("product_category_name_english"), F.lit(UNKNOWN_CATEGORY))
        .alias("category"))
    o = t.orders.select("order_id", cancelled_flag("order_status", cancelled).alias("is_cancelled"),
                        late_flag().alias("is_late"))
    return (t.items.select("order_id", "product_id", "price", "freight_value")
            .join(p, "product_id").join(o, "order_id")
            .select("order_id", "category", "price", "freight_value", "is_cancelled", "is_late"))


def order_category(base: DataFrame) -> DataFrame:
    """One row per (order, category): item count, revenue, freight, flags."""
    return base.groupBy("order_id", "category").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum("price").alias("revenue"),
        F.sum("freight_value").alias("freight"),
        F.max("is_cancelled").alias("is_cancelled"),
        F.max("is_late").alias("is_late"))


def category_financials(t: Tables, cancelled: str = STATUS_CANCELED) -> DataFrame:
    """Eight KPIs per category; revenue at risk is the price of items in
    cancelled or late orders."""
    oc = order_category(order_category_base(t, cancelled))
    at_risk = F.when((F.col("is_cancelled") == 1) | (F.col("is_late") == 1),
                     F.col("revenue")).otherwise(F.lit(0))
    agg = oc.groupBy("category").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum("revenue").alias("__rev"),
        F.sum("freight").alias("__fr"),
        F.sum(at_risk).alias("__risk"),
        F.sum(F.col("is_cancelled") * F.col("n_items")).alias("cancelled_items"),
        F.sum(F.col("is_late") * F.col("n_items")).alias("late_delivered_items"))
    return agg.select(
        "category", "total_orders",
        F.round("__rev", 2).alias("total_revenue"),
        F.round("__fr", 2).alias("total_freight"),
        ratio("__rev", "total_orders", 2, num_scale=2).alias("avg_ticket"),
        F.round("__risk", 2).alias("revenue_at_risk"),
        ratio("__risk", "__rev", 4, num_scale=2).alias("pct_revenue_at_risk"),
        "cancelled_items", "late_delivered_items")


COLUMNS = ["category", "total_orders", "total_revenue", "total_freight", "avg_ticket",
           "revenue_at_risk", "pct_revenue_at_risk", "cancelled_items",
           "late_delivered_items", "revenue_rank", "revenue_percentile", "revenue_quartile",
           "company_avg_ticket", "company_avg_pct_revenue_at_risk", "financial_health_tier"]


def financial_health(t: Tables, tiers: FinancialTiers = FinancialTiers(),
                     cancelled: str = STATUS_CANCELED) -> DataFrame:
    """The category financial-health mart: KPIs, revenue rank, percentile and
    quartile, company benchmarks and the health tier."""
    cf = category_financials(t, cancelled)
    # bounded: one row per category of the translation list (+ 'unknown')
    cf = window_rank(cf, [("total_revenue", False)], "rank", "revenue_rank")
    cf = window_rank(cf, [("total_revenue", True)], "percent_rank", "__pr")
    cf = cf.withColumn("revenue_percentile", F.round("__pr", 4))
    # NTILE ties are arbitrary in SQL; the category name makes them deterministic
    cf = window_rank(cf, [("total_revenue", False), ("category", True)], "ntile:4",
                     "revenue_quartile")
    cf = with_overall_means(cf, {"company_avg_ticket": ("avg_ticket", 2),
                                 "company_avg_pct_revenue_at_risk": ("pct_revenue_at_risk", 4)},
                            bounded=True)
    return cf.withColumn("financial_health_tier", tiers.tier()).select(*COLUMNS)


def top_categories(health: DataFrame, n: int = 10) -> DataFrame:
    """Top-n categories by revenue rank (the limit is the feature)."""
    return (health.orderBy("revenue_rank", "category").limit(n)
            .select("category", "total_revenue", "revenue_at_risk", "financial_health_tier"))
