"""Regional logistics mart: one row per customer state.

Plan shape: items are aggregated to order grain *before* any join (map-side
partial aggregation, one shuffle by ``order_id``); delivered orders join their
customer and that order-grain aggregate; the state aggregate is partial too,
so only ``#states x #partitions`` rows cross the last shuffle. The state table
is bounded by the country's states, so its ranks use plain windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercadia.fixed import STATUS_DELIVERED
from mercadia.functions.expressions import (days_between, late_flag, mean, ratio,
                                           with_region)
from mercadia.model import Tables
from mercadia.operators.ranking import window_rank, with_overall_means
from mercadia.plans.thresholds import LogisticsTiers


def order_freight(items: DataFrame) -> DataFrame:
    """Revenue and freight per order (item grain -> order grain)."""
    return items.groupBy("order_id").agg(
        F.sum("price").alias("order_revenue"),
        F.sum("freight_value").alias("order_freight_value"))


def order_logistics(t: Tables) -> DataFrame:
    """One row per delivered order with a delivery date: lead time, delay, late flag."""
    o = (t.orders
         .where((F.col("order_status") == STATUS_DELIVERED)
                & F.col("order_delivered_customer_date").isNotNull())
         .select("order_id", "customer_id", "order_purchase_timestamp",
                 "order_delivered_customer_date", "order_estimated_delivery_date"))
    c = t.customers.select("customer_id", "customer_state")
    joined = o.join(order_freight(t.items), "order_id").join(c, "customer_id")
    return joined.select(
        "order_id", "customer_state", "order_revenue", "order_freight_value",
        days_between("order_delivered_customer_date", "order_purchase_timestamp")
        .alias("lead_time_days"),
        days_between("order_delivered_customer_date", "order_estimated_delivery_date")
        .alias("delay_days"),
        late_flag().alias("is_delayed"))


def state_metrics(order_rows: DataFrame) -> DataFrame:
    """Seven KPIs per customer state, rounded as published."""
    # a ratio per order, kept to six decimals, is what the state's mean is taken of
    per_order_ratio = ratio("order_freight_value", "order_revenue", 6, num_scale=2)
    return order_rows.groupBy("customer_state").agg(
        F.count(F.lit(1)).alias("total_delivered_orders"),
        mean("lead_time_days", 1).alias("avg_lead_time_days"),
        mean("delay_days", 1).alias("avg_delay_days"),
        ratio(F.sum("is_delayed"), F.count(F.lit(1)), 4).alias("pct_delayed"),
        mean("order_freight_value", 2, scale=2).alias("avg_freight_value"),
        F.round(F.sum("order_revenue"), 2).alias("total_revenue"),
        mean(per_order_ratio, 4, scale=6).alias("avg_freight_to_revenue_ratio"))


COLUMNS = ["customer_state", "region", "total_delivered_orders", "avg_lead_time_days",
           "avg_delay_days", "pct_delayed", "avg_freight_value", "total_revenue",
           "avg_freight_to_revenue_ratio", "lead_time_rank", "lead_time_rank_in_region",
           "national_avg_lead_time_days", "national_avg_pct_delayed",
           "lead_time_vs_national_avg", "logistics_risk_tier"]


def logistics_regional(t: Tables, tiers: LogisticsTiers = LogisticsTiers()) -> DataFrame:
    """The regional logistics mart: state KPIs, macro-region, national and
    in-region lead-time ranks, national benchmarks and the risk tier."""
    sm = with_region(state_metrics(order_logistics(t)), "customer_state", t.region_lookup)
    lead = [("avg_lead_time_days", True)]
    # bounded: one row per state
    sm = window_rank(sm, lead, "dense_rank", "lead_time_rank")
    sm = window_rank(sm, lead, "dense_rank", "lead_time_rank_in_region", ["region"])
    sm = with_overall_means(sm, {
        "national_avg_lead_time_days": ("avg_lead_time_days", 1),
        "national_avg_pct_delayed": ("pct_delayed", 4)}, bounded=True)
    everywhere = Window.partitionBy()
    lead_sum = F.sum("avg_lead_time_days").over(everywhere)
    states = F.count("avg_lead_time_days").over(everywhere)
    # x - sum / n, rounded once: (n x - sum) / n
    sm = (sm.withColumn("lead_time_vs_national_avg",
                        ratio(F.col("avg_lead_time_days") * states - lead_sum, states, 1, num_scale=1))
          .withColumn("logistics_risk_tier", tiers.tier()))
    return sm.select(*COLUMNS)
