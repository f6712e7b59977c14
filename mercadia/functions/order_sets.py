"""Distinct-order measures from published bitmaps instead of the fact.

A distinct count cannot be added up over slices, but sets can be united. Every order
gets a number, and a *cell* - date, customer state, seller state, seller
segment, category - keeps the set of its orders as bits: one row per cell and word of 64
numbers, with the bits of all its orders, of the delayed and of the cancelled ones. A slice unites the words
of its cells and counts bits, so the counts are exact for every combination of
the attributes in ``CELLS``, and an order in several cells of a slice counts once.

Orders are numbered along date, customer state and the cell of their smallest item, so that
neighbours share cells and words fill up: the more orders a cell has, the fewer rows
there are per order, down to one in 64. The union is a bit-wise aggregate, partial
before its shuffle; a hot cell is many words, and no row ever holds more than one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercadia.functions.expressions import quotient, with_region
from mercadia.session import materialized

if TYPE_CHECKING:
    from mercadia.plans.star import Star

NAMES = ["total_orders", "delayed_orders", "sla_pct", "delay_rate_pct", "cancelled_orders",
         "cancellation_rate_pct"]
DATE = ["date_key", "full_date", "year", "quarter", "month", "month_name", "day_of_month", "day_name",
        "day_of_week", "is_weekend"]
#: Attributes by the cell column they come from.
CELLS = {**dict.fromkeys(DATE, "date_key"),
         "customer_state": "customer_state", "customer_region": "customer_state",
         "seller_state": "seller_state", "seller_region": "seller_state",
         "segment_tier": "segment_tier", "category": "category"}
BITS = 64
SETS = ["orders", "delayed", "cancelled"]


def numbered_orders(rows: DataFrame) -> DataFrame:
    """``order_id``, ``order_no``: numbers along date, customer state and the smallest cell, written once."""
    cell = F.struct("category", "seller_state", "segment_tier")
    orders = rows.groupBy("order_id").agg(F.min("date_key").alias("d"), F.min("customer_state").alias("c"),
                                          F.min(cell).alias("cell"))
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    along = ["d", "c", "cell", "order_id"]
    return materialized(orders.repartitionByRange(width, *along).sortWithinPartitions(*along)
                        .select("order_id", F.monotonically_increasing_id().alias("order_no")), "order-numbers")


def order_cells(star: Star) -> DataFrame:
    """The cells of a star's orders: ``CELLS`` columns, ``word`` and the three sets of bits."""
    customers = star.dim_customer.select(F.col("customer_key").alias("__c"), F.col("state").alias("customer_state"))
    sellers = star.dim_seller.select(F.col("seller_key").alias("__s"), F.col("state").alias("seller_state"),
                                     "segment_tier")
    products = star.dim_product.select(F.col("product_key").alias("__p"), F.col("category_name_en").alias("category"))
    rows = (star.fact_orders.select("order_id", "customer_key", "seller_key", "product_key", "date_key",
                                    "is_delayed", "is_cancelled")
            .join(customers, F.col("customer_key") == F.col("__c"), "left")
            .join(sellers, F.col("seller_key") == F.col("__s"), "left")
            .join(products, F.col("product_key") == F.col("__p"), "left")
            .select("order_id", *dict.fromkeys(CELLS.values()), "is_delayed", "is_cancelled"))
    bit = F.expr(f"shiftleft(1L, CAST(pmod(order_no, {BITS}) AS INT))")

    def members(where: Column | None = None) -> Column:
        return F.coalesce(F.bit_or(bit if where is None else F.when(where, bit)), F.lit(0).cast("long"))

    return (rows.join(numbered_orders(rows), "order_id")
            .withColumn("word", F.floor(F.col("order_no") / BITS))
            .groupBy(*dict.fromkeys(CELLS.values()), "word")
            .agg(members().alias("orders"), members(F.col("is_delayed") == 1).alias("delayed"),
                 members(F.col("is_cancelled") == 1).alias("cancelled")))


def covers(attributes: Sequence[str]) -> bool:
    return set(attributes) <= set(CELLS)


def _attached(star: Star, cells: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Cells with the attributes that are no column of their own."""
    dates = [a for a in attributes if a in DATE and a != "date_key"]
    if dates:
        d = star.dim_date.select(F.col("date_key").alias("__d"), *dates)
        cells = cells.join(d, F.col("date_key") == F.col("__d"), "left").drop("__d")
    for side in ("customer", "seller"):
        if f"{side}_region" in attributes:
            cells = with_region(cells, f"{side}_state", star.region_lookup).withColumnRenamed("region", f"{side}_region")
    return cells


def measures_of(star: Star, cells: DataFrame, by: Sequence[str], where: Mapping[str, object]) -> DataFrame:
    """``NAMES`` for every combination of ``by``, from the cells alone."""
    from mercadia.functions.measures import _values
    attributes = list(dict.fromkeys([*by, *where]))
    if not covers(attributes):
        raise ValueError(f"order sets know {sorted(CELLS)}, not {sorted(set(attributes) - set(CELLS))}")
    rows = _attached(star, cells, attributes)
    for a, v in where.items():
        rows = rows.where(F.col(a).isin(*_values(v)))
    words = rows.groupBy(*by, "word").agg(*[F.bit_or(s).alias(s) for s in SETS])
    total, late, lost = (F.sum(F.bit_count(s)) for s in SETS)
    out = words.groupBy(*by).agg(total.alias("total_orders"), late.alias("delayed_orders"), lost.alias("cancelled_orders"))
    n = F.col("total_orders")
    return out.select(*by, "total_orders", "delayed_orders",
                      (F.lit(1) - quotient(F.col("delayed_orders"), n)).alias("sla_pct"),
                      quotient(F.col("delayed_orders"), n).alias("delay_rate_pct"), "cancelled_orders",
                      quotient(F.col("cancelled_orders"), n).alias("cancellation_rate_pct"))
