"""Map the driver's synthetic TPC-H-like tables onto the marketplace schema.

The mapping is deterministic arithmetic only, so that an independent SQL engine
computes the same relations (see FIXTURES.md, "Mapping onto the domain"). Keys
stay BIGINT. All relations are lazy: reading them costs nothing until a mart
consumes them, and Catalyst prunes the columns a mart does not use.
"""

from __future__ import annotations

import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.model import LazyTables
from mercadia.sources.enrich import enrich_category

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# --- Fixed values of the mapping (FIXTURES.md) ---------------------------------
UNTRANSLATED_BRAND = "Brand#13"
STATUS_BY_REMAINDER = {0: "canceled", 1: "unavailable", 2: "shipped"}  # else 'delivered'
# --- end of fixed values


# per-session memo: a stopped session's plans die with it
_READS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_LOADS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table. Memoised per session and path: opening a parquet
    source infers its schema with a small job, and the mapping reads some
    tables several times (a DataFrame is an immutable plan, so sharing it is
    safe)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    memo = _READS.setdefault(spark, {})
    if path not in memo:
        memo[path] = spark.read.parquet(path)
    return memo[path]


def _days_hours(days: Column, hours: Column) -> Column:
    return F.make_dt_interval(days=days.cast("int"), hours=hours.cast("int"))


def state_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nationkey, state) — the nation name plays the role of a state.

    Nation (25 rows) and region (5 rows) do not grow with the scale factor,
    so joins against them are broadcast.
    """
    return read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("state"))


def region_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    r = read(spark, sf_dir, "region")
    return (n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
            .select(F.col("n_name").alias("state"), F.col("r_name").alias("region")))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    st = state_names(spark, sf_dir)
    return (c.join(F.broadcast(st), c.c_nationkey == st.nationkey, "left")
            .select(F.col("c_custkey").alias("customer_id"),
                    F.col("c_name").alias("customer_unique_id"),
                    F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0")
                    .alias("customer_zip_code_prefix"),
                    F.col("c_mktsegment").alias("customer_city"),
                    F.col("state").alias("customer_state")))


def sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    st = state_names(spark, sf_dir)
    return (s.join(F.broadcast(st), s.s_nationkey == st.nationkey, "left")
            .select(F.col("s_suppkey").alias("seller_id"),
                    F.lpad((F.col("s_suppkey") % 100000).cast("string"), 5, "0")
                    .alias("seller_zip_code_prefix"),
                    F.col("s_name").alias("seller_city"),
                    F.col("state").alias("seller_state")))


def translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category translation lookup: one row per brand except the untranslated one."""
    p = read(spark, sf_dir, "part")
    return (p.select(F.col("p_brand").alias("product_category_name")).distinct()
            .where(F.col("product_category_name") != UNTRANSLATED_BRAND)
            .withColumn("product_category_name_english",
                        F.lower(F.replace(F.col("product_category_name"),
                                          F.lit("Brand#"), F.lit("category_")))))


def products_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("product_id"),
                    F.col("p_brand").alias("product_category_name"),
                    F.col("p_size").alias("product_weight_g"),
                    F.lit(None).cast("int").alias("product_length_cm"),
                    F.lit(None).cast("int").alias("product_height_cm"),
                    F.lit(None).cast("int").alias("product_width_cm"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich_category(products_raw(spark, sf_dir), translation(spark, sf_dir))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    k = F.col("o_orderkey")
    status = F.lit("delivered")
    for rem, name in sorted(STATUS_BY_REMAINDER.items(), reverse=True):
        status = F.when(k % 40 == rem, F.lit(name)).otherwise(status)
    delivered = F.when((k % 40).isin(1, 2, 3), F.lit(None)).otherwise(
        F.col("o_orderdate") + _days_hours(
            5 + (k * 7919) % 14 + (F.col("c_nationkey") * 3) % 13, (k * 5) % 24))
    estimated = F.when(k % 97 == 5, F.lit(None)).otherwise(
        F.col("o_orderdate") + _days_hours(16 + (k * 31) % 9, F.lit(0)))
    return (o.join(c, o.o_custkey == c.c_custkey, "left")
            .select(k.alias("order_id"),
                    F.col("o_custkey").alias("customer_id"),
                    status.alias("order_status"),
                    (F.col("o_orderdate") + _days_hours(F.lit(0), k % 24))
                    .alias("order_purchase_timestamp"),
                    F.lit(None).cast("timestamp_ntz").alias("order_approved_at"),
                    F.lit(None).cast("timestamp_ntz").alias("order_delivered_carrier_date"),
                    delivered.cast("timestamp_ntz").alias("order_delivered_customer_date"),
                    estimated.cast("timestamp_ntz").alias("order_estimated_delivery_date")))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(10,2)")
    # decimal times decimal, rounded: multiplying doubles first gives other cents
    freight = F.round(price * F.col("l_tax").cast("decimal(4,2)"), 2).cast("decimal(10,2)")
    return li.select(F.col("l_orderkey").alias("order_id"),
                     F.col("l_linenumber").alias("order_item_id"),
                     F.col("l_partkey").alias("product_id"),
                     F.col("l_suppkey").alias("seller_id"),
                     F.col("l_shipdate").alias("shipping_limit_date"),
                     price.alias("price"),
                     freight.alias("freight_value"))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("order_id"),
                    F.lit(1).alias("payment_sequential"),
                    F.lit("credit_card").alias("payment_type"),
                    F.lit(1).alias("payment_installments"),
                    F.col("o_totalprice").cast("decimal(12,2)").alias("payment_value"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    created = F.when(k % 97 == 5, F.lit(None)).otherwise(
        F.col("o_orderdate") + _days_hours(16 + (k * 31) % 9, F.lit(0))).cast("timestamp_ntz")
    return (o.where(k % 10 != 7)
            .select(k.alias("review_id"), k.alias("order_id"),
                    F.substring(F.col("o_orderpriority"), 1, 1).cast("int").alias("review_score"),
                    F.lit(None).cast("string").alias("review_comment_title"),
                    created.alias("review_creation_date"),
                    (created + _days_hours(k % 5, k % 24)).alias("review_answer_timestamp")))


def load(spark: SparkSession, sf_dir: str) -> LazyTables:
    """All domain relations for one scale-factor folder, planned on first use
    and shared by every query of the session (plans are immutable)."""
    key = sf_dir.rstrip("/")
    memo = _LOADS.setdefault(spark, {})
    if key not in memo:
        fns = {"customers": customers, "sellers": sellers, "products": products,
               "orders": orders, "items": items, "payments": payments, "reviews": reviews,
               "region_lookup": region_lookup}
        memo[key] = LazyTables({k: (lambda f=f: f(spark, sf_dir)) for k, f in fns.items()})
    return memo[key]
