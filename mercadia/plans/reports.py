"""Validation and dashboard summaries over the marts and the star schema.

All inputs here are already aggregated (one row per seller, state, category or
per dimension), so these are small final aggregates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercadia.functions.expressions import mean, ratio, with_scalars


def segment_summary(supplier: DataFrame) -> DataFrame:
    return (supplier.groupBy("supplier_segment")
            .agg(F.count(F.lit(1)).alias("sellers"),
                 mean("total_revenue", 2, scale=2).alias("avg_revenue"))
            .orderBy(F.desc("avg_revenue")))


def segment_share(supplier: DataFrame) -> DataFrame:
    """Sellers per segment and their share of all ranked sellers."""
    per = supplier.groupBy("supplier_segment").agg(F.count(F.lit(1)).alias("sellers"))
    total = supplier.agg(F.count(F.lit(1)).alias("__all"))  # one row
    return (with_scalars(per, total)
            .select("supplier_segment", "sellers",
                    ratio("sellers", "__all", 4).alias("share_of_sellers"))
            .orderBy(F.desc("sellers")))


def risk_tier_summary(logistics: DataFrame) -> DataFrame:
    return (logistics.groupBy("logistics_risk_tier")
            .agg(F.count(F.lit(1)).alias("states"),
                 mean("avg_lead_time_days", 1, scale=1).alias("avg_lead_time"))
            .orderBy(F.desc("avg_lead_time")))


def region_freight_ratio(logistics: DataFrame) -> DataFrame:
    return (logistics.groupBy("region")
            .agg(mean("avg_freight_to_revenue_ratio", 4, scale=4).alias("avg_freight_ratio"))
            .orderBy(F.desc("avg_freight_ratio")))


def health_tier_summary(health: DataFrame) -> DataFrame:
    return (health.groupBy("financial_health_tier")
            .agg(F.count(F.lit(1)).alias("categories"),
                 F.round(F.sum("total_revenue"), 2).alias("total_revenue"),
                 F.round(F.sum("revenue_at_risk"), 2).alias("total_revenue_at_risk"))
            .orderBy(F.desc("total_revenue")))


def dim_row_counts(star) -> DataFrame:
    # dim_seller has a row for every seller, whatever its segment
    frames = {"dim_date": star.dim_date, "dim_customer": star.dim_customer, "dim_seller": star.sellers,
              "dim_product": star.dim_product, "dim_geography": star.dim_geography}
    return reduce(DataFrame.unionAll, [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
        for n, df in frames.items()])


def seller_segment_counts(star) -> DataFrame:
    return star.dim_seller.groupBy("segment_tier").agg(F.count(F.lit(1)).alias("sellers"))


def fact_row_counts(star) -> DataFrame:
    fo = star.fact_orders.agg(F.count(F.lit(1)).alias("value")) \
        .select(F.lit("fact_orders_rows").alias("metric"), "value")
    fr = star.fact_reviews.agg(F.count(F.lit(1)).alias("rows"),
                               F.count_if(F.col("seller_key").isNull()).alias("nulls"))
    return fo.unionAll(fr.select(F.stack(
        F.lit(2), F.lit("fact_reviews_rows"), "rows", F.lit("fact_reviews_null_seller"), "nulls")
        .alias("metric", "value")))


def overall_delay_rate(star) -> DataFrame:
    return star.fact_orders.agg(
        ratio(F.sum("is_delayed"), F.count(F.lit(1)), 4).alias("overall_delay_rate"))
