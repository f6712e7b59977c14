"""Supplier-performance mart: one row per seller that has item rows.

Plan shape. Revenue, SLA and reviews all derive from one shared
``(seller, order)`` grain built once:

* items join their order (``order_id`` shuffle; a LEFT join so revenue keeps
  every item whatever the order), collapse to ``(seller, order)`` while still
  partitioned by ``order_id``;
* reviews are aggregated to order grain (count ``c``, score sum ``s``) and
  joined on ``order_id`` again without re-shuffling the grain;
* one aggregate per seller yields all metrics. Reviews stay item-weighted as
  in the published definition (each item of a seller in an order repeats the
  order's reviews), computed as ``sum(k*s) / sum(k*c)`` instead of
  materialising the item x review fan-out.

Sellers grow with the data, so the revenue quartile uses range partitioning; the quality
ranks need only distinct scores and rates, whose number the domain bounds.
The seller-level metrics are checkpointed once (to the shared
``spark.checkpoint.dir``) because the ranks and two benchmarks read them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercadia.fixed import SLA_EXCLUDED_STATUSES
from mercadia.functions.expressions import on_time_flag, ratio
from mercadia.model import Tables
from mercadia.operators.ranking import dense_ranks_by_lead, join_ranks, rank_table, with_overall_means
from mercadia.plans.thresholds import SupplierTiers
from mercadia.session import materialized

# The published view excludes these statuses from the SLA. Note the spelling:
# the data says 'canceled', so cancelled orders are *not* excluded by default.
DEFAULT_EXCLUDED = SLA_EXCLUDED_STATUSES


def seller_order_grain(t: Tables, excluded: Sequence[str] = DEFAULT_EXCLUDED) -> DataFrame:
    """One row per (seller, order): items, revenue, freight, SLA eligibility, on-time flag.

    ``in_sla`` is 1 when the order exists and its status is not excluded;
    ``is_on_time`` is the three-valued flag (NULL when the outcome is unknown).
    """
    o = t.orders.select(
        "order_id",
        (~F.col("order_status").isin(*excluded)).cast("int").alias("__eligible"),
        on_time_flag().alias("__on_time"))
    it = t.items.select("order_id", "seller_id", "price", "freight_value")
    return (it.join(o, "order_id", "left")
            .groupBy("seller_id", "order_id")
            .agg(F.count(F.lit(1)).alias("n_items"),
                 F.sum("price").alias("revenue"),
                 F.sum("freight_value").alias("freight"),
                 F.coalesce(F.max("__eligible"), F.lit(0)).alias("in_sla"),
                 F.max("__on_time").alias("is_on_time")))


def review_order_grain(reviews: DataFrame) -> DataFrame:
    """Per order: number of reviews and sum of their scores."""
    return reviews.groupBy("order_id").agg(
        F.count("review_id").alias("n_reviews"),
        F.sum("review_score").alias("score_sum"))


def seller_metrics(t: Tables, excluded: Sequence[str] = DEFAULT_EXCLUDED) -> DataFrame:
    """All per-seller metrics from one aggregate over the shared grain."""
    g = seller_order_grain(t, excluded).join(review_order_grain(t.reviews), "order_id", "left")
    k = F.col("n_items")
    sla = F.when(F.col("in_sla") == 1, F.col("is_on_time"))
    m = g.groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum(k).alias("total_items_sold"),
        F.sum("revenue").alias("total_revenue"),
        F.sum("freight").alias("total_freight"),
        F.sum(k * F.col("n_reviews")).alias("__kc"),
        F.sum(k * F.col("score_sum")).alias("__ks"),
        F.count(sla).alias("orders_with_known_outcome"),
        F.sum(sla).alias("orders_on_time"))
    return m.select(
        "seller_id", "total_orders", "total_items_sold", "total_revenue", "total_freight",
        ratio("total_revenue", "total_items_sold", 6, num_scale=2).alias("avg_item_price"),
        ratio("__ks", "__kc", 4).alias("avg_review_score"),
        F.coalesce(F.col("__kc"), F.lit(0)).alias("total_reviews"),
        "orders_with_known_outcome", "orders_on_time",
        ratio("orders_on_time", "orders_with_known_outcome", 4).alias("on_time_rate"))


def seller_revenue(t: Tables) -> DataFrame:
    """Revenue per seller, from the item rows alone."""
    per_order = t.items.groupBy("seller_id", "order_id").agg(
        F.count(F.lit(1)).alias("k"), F.sum("price").alias("p"), F.sum("freight_value").alias("f"))
    return per_order.groupBy("seller_id").agg(
        F.sum("k").alias("total_items_sold"), F.count(F.lit(1)).alias("total_orders"),
        F.sum("p").alias("total_revenue"), F.sum("f").alias("total_freight")).select(
        "*", ratio("total_revenue", "total_items_sold", 6, num_scale=2).alias("avg_item_price"))


def seller_reviews(t: Tables) -> DataFrame:
    """Sellers with at least one review on their orders, item-weighted."""
    k = t.items.groupBy("seller_id", "order_id").agg(F.count(F.lit(1)).alias("k"))
    m = (k.join(review_order_grain(t.reviews), "order_id").groupBy("seller_id")
         .agg(F.sum(F.col("k") * F.col("score_sum")).alias("s"),
              F.sum(F.col("k") * F.col("n_reviews")).alias("total_reviews")))
    return (m.where(F.col("total_reviews") > 0)
            .select("seller_id", ratio("s", "total_reviews", 4).alias("avg_review_score"), "total_reviews"))


def seller_sla(t: Tables, excluded: Sequence[str] = DEFAULT_EXCLUDED) -> DataFrame:
    """Sellers with at least one SLA-eligible order."""
    g = seller_order_grain(t, excluded).where(F.col("in_sla") == 1)
    return g.groupBy("seller_id").agg(
        F.count("is_on_time").alias("orders_with_known_outcome"),
        F.sum("is_on_time").alias("orders_on_time"),
        ratio(F.sum("is_on_time"), F.count("is_on_time"), 4).alias("on_time_rate"))


def seller_orders(t: Tables, excluded: Sequence[str] = DEFAULT_EXCLUDED) -> DataFrame:
    """Distinct (seller, order) pairs eligible for the SLA, with the on-time flag."""
    return (seller_order_grain(t, excluded).where(F.col("in_sla") == 1)
            .select("seller_id", "order_id", "is_on_time"))


COLUMNS = ["seller_id", "seller_city", "seller_state", "total_orders", "total_items_sold",
           "total_revenue", "avg_item_price", "avg_review_score", "total_reviews",
           "on_time_rate", "quality_rank", "quality_rank_in_state", "revenue_quartile",
           "company_avg_review_score", "company_avg_on_time_rate", "supplier_segment"]


def ranked_sellers(t: Tables, excluded: Sequence[str] = DEFAULT_EXCLUDED) -> DataFrame:
    """One row per seller with item rows: the metrics the mart ranks and tiers.

    ``sellers LEFT JOIN metrics WHERE total_orders > 0`` is an inner join,
    since metrics exist only for sellers with items. Missing review score or
    SLA become 0, as published.
    """
    m = seller_metrics(t, excluded)
    s = t.sellers.select("seller_id", "seller_city", "seller_state")
    return s.join(m, "seller_id").select(
        "seller_id", "seller_city", "seller_state", "total_orders", "total_items_sold",
        "total_revenue", "avg_item_price",
        F.coalesce("avg_review_score", F.lit(0)).alias("avg_review_score"),
        "total_reviews",
        F.coalesce("on_time_rate", F.lit(0)).alias("on_time_rate"))


def supplier_segments(t: Tables, tiers: SupplierTiers = SupplierTiers(),
                      excluded: Sequence[str] = DEFAULT_EXCLUDED) -> DataFrame:
    """``(seller_id, supplier_segment)``: the mart's segment column without its
    ranks (a segment depends on score, SLA and orders only)."""
    return ranked_sellers(t, excluded).select("seller_id",
                                              tiers.segment().alias("supplier_segment"))


def supplier_performance(t: Tables, tiers: SupplierTiers = SupplierTiers(),
                         excluded: Sequence[str] = DEFAULT_EXCLUDED,
                         ranges: int | None = None) -> DataFrame:
    """The supplier-performance mart: one row per seller with item rows.

    Adds the global quality rank (dense, score then SLA, both descending), the
    same rank inside the seller's state, the revenue quartile, the company
    benchmarks and the segment. Both quality ranks come from one table of distinct keys. The
    seller rows, which every rank reads, are written to the shared folder first, and
    then range-partitioned for the quartile; ``ranges`` overrides its width.
    """
    sm = materialized(ranked_sellers(t, excluded), "sellers")
    base = sm
    # a score has four digits, and so a bounded number of values
    ranks = dense_ranks_by_lead(sm, "avg_review_score", "on_time_rate", "seller_state",
                                "quality_rank", "quality_rank_in_state")
    # NTILE ties are arbitrary in SQL; seller_id makes them deterministic
    sm = rank_table(sm, [("total_revenue", False), ("seller_id", True)], "ntile:4",
                    "revenue_quartile", unique=True, ranges=ranges)
    sm = join_ranks(sm, ranks, ["seller_state", "avg_review_score", "on_time_rate"])
    # the rank joins keep every seller row, so the benchmarks come from the base
    sm = with_overall_means(sm, {"company_avg_review_score": ("avg_review_score", 2),
                                 "company_avg_on_time_rate": ("on_time_rate", 4)},
                            source=base)
    return sm.withColumn("supplier_segment", tiers.segment()).select(*COLUMNS)
