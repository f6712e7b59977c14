"""Star schema: five dimensions and two facts at different grains.

``fact_orders`` is item grain, ``fact_reviews`` review grain; both carry the
surrogate keys of the dimensions. Dimensions that grow with the data
(customer, seller, product) are joined by key and left to AQE to broadcast or
shuffle from their measured size; the calendar and geography dimensions are
small (days of a span, states of a country), which AQE sees at run time.
"""

from __future__ import annotations

from copy import copy
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.functions.expressions import (cancelled_flag, date_key, days_between,
                                           late_flag, with_region)
from mercadia.model import Tables
from mercadia.fixed import (DAY_NAME_PATTERN, MONTH_NAME_PATTERN, NO_FULFILLED_ORDERS,
                            STATUS_CANCELED, UNKNOWN_CATEGORY)
from mercadia.plans.supplier import supplier_segments
from mercadia.plans.thresholds import SupplierTiers
from mercadia.session import materialized



# --- dim_date ----------------------------------------------------------------------

def _calendar(bounds: DataFrame) -> DataFrame:
    """Expand a one-row ``(start, end)`` frame into one row per day, inclusive."""
    d = F.col("full_date")
    days = bounds.select(F.explode(F.sequence(F.col("start"), F.col("end"),
                                              F.expr("INTERVAL 1 DAY"))).alias("full_date"))
    return days.select(
        date_key(d).alias("date_key"), d,
        F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"),
        F.date_format(d, MONTH_NAME_PATTERN).alias("month_name"),
        F.dayofmonth(d).alias("day_of_month"),
        F.date_format(d, DAY_NAME_PATTERN).alias("day_name"),
        F.dayofweek(d).alias("day_of_week"),  # 1 = Sunday
        F.when(F.dayofweek(d).isin(1, 7), F.lit(1)).otherwise(F.lit(0)).alias("is_weekend"))


def dim_date(spark: SparkSession, start: str = "2016-01-01", end: str = "2018-12-31") -> DataFrame:
    """Calendar between two dates inclusive (1,096 rows for the default span)."""
    return _calendar(spark.range(1).select(F.to_date(F.lit(start)).alias("start"),
                                           F.to_date(F.lit(end)).alias("end")))


def dim_date_for(orders: DataFrame, ts: str = "order_purchase_timestamp") -> DataFrame:
    """Calendar covering whole years from the first to the last purchase."""
    b = orders.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    return _calendar(b.select(F.make_date(F.year("lo"), F.lit(1), F.lit(1)).alias("start"),
                              F.make_date(F.year("hi"), F.lit(12), F.lit(31)).alias("end")))


# --- other dimensions ------------------------------------------------------------

def dim_customer(t: Tables) -> DataFrame:
    """One row per customer key (a checkout, not a person)."""
    return t.customers.select(F.col("customer_id").alias("customer_key"), "customer_unique_id",
                              F.col("customer_city").alias("city"),
                              F.col("customer_state").alias("state"))


def dim_seller(t: Tables, supplier: DataFrame | None = None,
               tiers: SupplierTiers = SupplierTiers()) -> DataFrame:
    """Sellers with the segment of the supplier mart, or 'No Fulfilled Orders'.

    Pass the published mart as ``supplier`` to reuse it; otherwise only the
    segment column is computed (no ranks are needed for it).
    """
    seg = (supplier.select("seller_id", "supplier_segment") if supplier is not None
           else supplier_segments(t, tiers))
    return (t.sellers.join(seg, "seller_id", "left")
            .select(F.col("seller_id").alias("seller_key"),
                    F.col("seller_city").alias("city"), F.col("seller_state").alias("state"),
                    F.coalesce("supplier_segment", F.lit(NO_FULFILLED_ORDERS))
                    .alias("segment_tier")))


def dim_product(t: Tables) -> DataFrame:
    """Products with their English category, or 'unknown'."""
    return t.products.select(
        F.col("product_id").alias("product_key"),
        F.coalesce("product_category_name_english", F.lit(UNKNOWN_CATEGORY))
        .alias("category_name_en"))


def all_states(t: Tables) -> DataFrame:
    """Distinct non-NULL states seen at customers or sellers (SQL UNION)."""
    return (t.customers.select(F.col("customer_state").alias("state"))
            .union(t.sellers.select(F.col("seller_state").alias("state")))
            .distinct().where(F.col("state").isNotNull()))


def dim_geography(t: Tables) -> DataFrame:
    """States seen at customers or sellers with their macro-region."""
    g = with_region(all_states(t), "state", t.region_lookup)
    return g.select(F.col("state").alias("state_key"), "region")


# --- facts ----------------------------------------------------------------------

def fact_orders(t: Tables, cancelled: str = STATUS_CANCELED) -> DataFrame:
    """Item grain: dimension keys, purchase date key, money, the two risk
    flags and the lead time of the item's order."""
    o = t.orders.select(
        "order_id", F.col("customer_id").alias("customer_key"),
        date_key("order_purchase_timestamp").alias("date_key"),
        late_flag().alias("is_delayed"),
        cancelled_flag("order_status", cancelled).alias("is_cancelled"),
        days_between("order_delivered_customer_date", "order_purchase_timestamp")
        .alias("lead_time_days"))
    return (t.items.join(o, "order_id")
            .select("order_id", "order_item_id", F.col("product_id").alias("product_key"),
                    F.col("seller_id").alias("seller_key"), "customer_key", "date_key",
                    "price", "freight_value", "is_delayed", "is_cancelled", "lead_time_days"))


def order_min_seller(items: DataFrame) -> DataFrame:
    """Lowest seller of each order: one deterministic seller per review."""
    return items.groupBy("order_id").agg(F.min("seller_id").alias("seller_key"))


def fact_reviews(t: Tables) -> DataFrame:
    """Review grain: one seller per review (the order's lowest seller id),
    creation date key, score and response time."""
    r = t.reviews.join(order_min_seller(t.items), "order_id", "left")
    return r.select("review_id", "order_id", "seller_key",
                    date_key("review_creation_date").alias("date_key"), "review_score",
                    days_between("review_answer_timestamp", "review_creation_date")
                    .alias("response_time_days"))


# --- the bundle -------------------------------------------------------------------

class Star:
    """The star schema over base tables. Members are built on first access and
    nothing runs then; a measure that needs only ``fact_orders`` never plans the
    supplier mart. :meth:`stored` writes chosen members and gives a star that
    reads them; :func:`read_star` gives the published star."""

    NAMES = ("dim_date", "dim_customer", "dim_seller", "dim_product", "dim_geography",
             "fact_orders", "fact_reviews")

    def __init__(self, t: Tables, dates: DataFrame | None = None,
                 tiers: SupplierTiers = SupplierTiers(), supplier: DataFrame | None = None):
        self._t, self._dates, self._tiers, self._supplier = t, dates, tiers, supplier

    @cached_property
    def dim_date(self) -> DataFrame:
        return self._dates if self._dates is not None else dim_date_for(self._t.orders)

    @cached_property
    def dim_customer(self) -> DataFrame:
        return dim_customer(self._t)

    @cached_property
    def dim_seller(self) -> DataFrame:
        return dim_seller(self._t, self._supplier, self._tiers)

    @cached_property
    def dim_product(self) -> DataFrame:
        return dim_product(self._t)

    @cached_property
    def dim_geography(self) -> DataFrame:
        return dim_geography(self._t)

    @cached_property
    def fact_orders(self) -> DataFrame:
        return fact_orders(self._t)

    @cached_property
    def fact_reviews(self) -> DataFrame:
        return fact_reviews(self._t)

    @property
    def region_lookup(self) -> DataFrame:
        return self._t.region_lookup

    @property
    def sellers(self) -> DataFrame:
        """One row per seller of ``dim_seller``, without its segment."""
        return self._t.sellers.select(F.col("seller_id").alias("seller_key"))

    def as_dict(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in self.NAMES}

    def stored(self, *names: str) -> Star:
        """The same star with the named members written once to the shared folder."""
        out = copy(self)
        for n in names:
            out.__dict__[n] = materialized(getattr(self, n), n)
        return out


class PublishedStar(Star):
    """The star that ``publish.publish_star`` wrote to a folder, or the one of a refresh's current
    version; the facts are partitioned by ``year`` and ``year_month``."""

    def __init__(self, spark: SparkSession, folder: str):
        from mercadia.sources import versions
        published = versions.of_group(spark, folder, "star")
        for n in self.NAMES:
            self.__dict__[n] = (published.read(spark, f"star/{n}") if published
                                else spark.read.parquet(f"{folder.rstrip('/')}/{n}"))
        if published:
            self._cells = published.read(spark, "star/order_cells") if "order_cells" in published.names("star") else None
        else:
            self._cells = (spark.read.parquet(f"{folder.rstrip('/')}/order_cells")
                           if "order_cells" in versions.children(spark, folder) else None)

    @cached_property
    def order_cells(self) -> DataFrame | None:
        return self._cells

    @property
    def region_lookup(self) -> DataFrame:
        return self.dim_geography.select(F.col("state_key").alias("state"), "region")

    @property
    def sellers(self) -> DataFrame:
        return self.dim_seller.select("seller_key")


def read_star(spark: SparkSession, folder: str) -> Star:
    return PublishedStar(spark, folder)


def build_star(t: Tables, dates: DataFrame | None = None,
               tiers: SupplierTiers = SupplierTiers(),
               supplier: DataFrame | None = None) -> Star:
    return Star(t, dates, tiers, supplier)
