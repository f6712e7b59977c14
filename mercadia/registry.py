"""

Each entry is ``(spark, sf_dir) -> DataFrame`` and reads the whole tables
through :mod:`mercadia.sources.testdata`, in a session whose shuffles are as wide as
these tables need (``session.sized_session``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercadia import fixed
from mercadia.functions import expressions, measures, order_sets
from mercadia.operators import gates, quality, ranking
from mercadia.plans import financial, logistics, reports, star, supplier
from mercadia.plans.thresholds import FinancialTiers, SupplierTiers
from mercadia.session import input_bytes, sized_session
from mercadia.sources import schemas, testdata

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        @wraps(fn)
        def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
            folder = sf_dir.rstrip("/")
            size = input_bytes(spark, [f"{folder}/{t}.parquet" for t in testdata.TABLES])
            return fn(sized_session(spark, folder, size), sf_dir)
        QUERIES[name] = sized
        return fn
    return deco


# Integer columns that hold NULLs in the driver data. Engines hand such
# columns to pandas differently (float NaN or a nullable integer), so for
# comparison they are DOUBLE on both sides; the values are unchanged.
NULLABLE_INTEGERS = {
    "delivery_flags": ["is_on_time", "lead_time_days", "delay_days"],
    "order_logistics": ["delay_days"],
    "seller_orders": ["is_on_time"],
    "fact_orders": ["lead_time_days"],
    "fact_reviews": ["seller_key", "date_key", "response_time_days"],
    "measures_by_year": ["year", "total_orders", "delayed_orders", "cancelled_orders",
                         "total_reviews"],
    "measures_by_seller_segment": ["total_orders", "delayed_orders", "cancelled_orders",
                                   "total_reviews", "total_sellers", "gold_partners",
                                   "operational_risk_sellers"],
}


def portable(df: DataFrame, as_double=()) -> DataFrame:
    """Normalise types for cross-engine comparison; values are unchanged."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        dt = f.dataType
        if f.name in as_double:
            c = c.cast("double")
        elif isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(dt, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(dt, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(dt, T.TimestampNTZType):
            # a direct cast: date_format would pass through the session time
            # zone and move wall times that fall in a daylight-saving gap
            c = c.cast("string")
        elif isinstance(dt, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(dt, T.BooleanType):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def tables(spark: SparkSession, sf_dir: str):
    return testdata.load(spark, sf_dir)


# --- regional logistics -----------------------------------------------------

@register("order_freight")
def _order_freight(spark, sf_dir):
    return logistics.order_freight(tables(spark, sf_dir).items)


@register("order_logistics")
def _order_logistics(spark, sf_dir):
    return logistics.order_logistics(tables(spark, sf_dir))


@register("state_metrics")
def _state_metrics(spark, sf_dir):
    return logistics.state_metrics(logistics.order_logistics(tables(spark, sf_dir)))


@register("logistics_regional")
def _logistics_regional(spark, sf_dir):
    return logistics.logistics_regional(tables(spark, sf_dir))


def _cols(fn, *cols):
    return lambda spark, sf_dir: fn(spark, sf_dir).select(*cols)


register("state_lead_time_rank")(_cols(_logistics_regional, "customer_state",
                                       "avg_lead_time_days", "lead_time_rank"))
register("state_rank_in_region")(_cols(_logistics_regional, "customer_state", "region",
                                       "avg_lead_time_days", "lead_time_rank_in_region"))

# --- supplier performance ----------------------------------------------------------

TUNED_SUPPLIER = SupplierTiers(gold_score=3.03, gold_on_time=0.67,
                               regular_score=2.97, regular_on_time=0.66)


@register("flt_status_not_in")
def _flt_status_not_in(spark, sf_dir):
    o = tables(spark, sf_dir).orders
    return (o.where(~F.col("order_status").isin(*supplier.DEFAULT_EXCLUDED))
            .select("order_id", "order_status"))


@register("join_items_orders")
def _join_items_orders(spark, sf_dir):
    t = tables(spark, sf_dir)
    return (t.items.join(t.orders, "order_id")
            .select("order_id", "order_item_id", "seller_id", "order_status", "price"))


@register("seller_orders")
def _seller_orders(spark, sf_dir):
    return supplier.seller_orders(tables(spark, sf_dir))


@register("seller_revenue")
def _seller_revenue(spark, sf_dir):
    return supplier.seller_revenue(tables(spark, sf_dir))


@register("seller_reviews")
def _seller_reviews(spark, sf_dir):
    return supplier.seller_reviews(tables(spark, sf_dir))


@register("seller_sla")
def _seller_sla(spark, sf_dir):
    return supplier.seller_sla(tables(spark, sf_dir))


@register("supplier_performance")
def _supplier_performance(spark, sf_dir):
    return supplier.supplier_performance(tables(spark, sf_dir))


@register("supplier_performance_tuned")
def _supplier_performance_tuned(spark, sf_dir):
    return supplier.supplier_performance(tables(spark, sf_dir), TUNED_SUPPLIER)


def _order_revenue(spark, sf_dir):
    return logistics.order_freight(tables(spark, sf_dir).items).select("order_id", "order_revenue")


@register("order_revenue_rank")
def _order_revenue_rank(spark, sf_dir):
    return ranking.range_rank(_order_revenue(spark, sf_dir), [("order_revenue", False)], "rank", "revenue_rank")


@register("order_revenue_quartile")
def _order_revenue_quartile(spark, sf_dir):
    return ranking.range_rank(_order_revenue(spark, sf_dir), [("order_revenue", False), ("order_id", True)],
                              "ntile:4", "revenue_quartile", unique=True)


register("supplier_quality_rank")(_cols(_supplier_performance, "seller_id", "avg_review_score",
                                        "on_time_rate", "quality_rank"))
register("supplier_rank_in_state")(_cols(_supplier_performance, "seller_id", "seller_state",
                                         "avg_review_score", "on_time_rate",
                                         "quality_rank_in_state"))
register("supplier_revenue_quartile")(_cols(_supplier_performance, "seller_id", "total_revenue",
                                            "revenue_quartile"))

# --- financial health --------------------------------------------------------------

TUNED_FINANCIAL = FinancialTiers(high_risk=0.36, moderate_risk=0.34)


@register("category_financials")
def _category_financials(spark, sf_dir):
    return financial.category_financials(tables(spark, sf_dir))


@register("financial_health")
def _financial_health(spark, sf_dir):
    return financial.financial_health(tables(spark, sf_dir))


@register("financial_health_tuned")
def _financial_health_tuned(spark, sf_dir):
    return financial.financial_health(tables(spark, sf_dir), TUNED_FINANCIAL)


register("category_revenue_rank")(_cols(_financial_health, "category", "total_revenue",
                                        "revenue_rank"))
register("category_revenue_percentile")(_cols(_financial_health, "category", "total_revenue",
                                              "revenue_percentile"))
register("category_revenue_quartile")(_cols(_financial_health, "category", "total_revenue",
                                            "revenue_quartile"))


@register("top_categories")
def _top_categories(spark, sf_dir):
    return financial.top_categories(financial.financial_health(tables(spark, sf_dir)))

# --- scalar expressions -------------------------------------------------------------


@register("date_key_and_parts")
def _date_key_and_parts(spark, sf_dir):
    o = tables(spark, sf_dir).orders
    ts = F.col("order_purchase_timestamp")
    return o.select(
        "order_id", expressions.date_key(ts).alias("date_key"),
        F.year(ts).alias("year"), F.quarter(ts).alias("quarter"), F.month(ts).alias("month"),
        F.date_format(ts, fixed.MONTH_NAME_PATTERN).alias("month_name"),
        F.dayofmonth(ts).alias("day_of_month"),
        F.date_format(ts, fixed.DAY_NAME_PATTERN).alias("day_name"),
        F.dayofweek(ts).alias("day_of_week"),
        F.date_add(F.to_date(ts), 30).alias("plus_30_days"))


@register("state_region")
def _state_region(spark, sf_dir):
    t = tables(spark, sf_dir)
    return expressions.with_region(t.customers.select("customer_id", "customer_state"),
                                   "customer_state", t.region_lookup)


@register("delivery_flags")
def _delivery_flags(spark, sf_dir):
    o = tables(spark, sf_dir).orders
    return o.select(
        "order_id", expressions.on_time_flag().alias("is_on_time"),
        expressions.late_flag().alias("is_late"),
        expressions.cancelled_flag().alias("is_cancelled"),
        expressions.days_between("order_delivered_customer_date", "order_purchase_timestamp")
        .alias("lead_time_days"),
        expressions.days_between("order_delivered_customer_date",
                                 "order_estimated_delivery_date").alias("delay_days"))


# --- star schema ---------------------------------------------------------------------

def _star(spark, sf_dir):
    return star.build_star(tables(spark, sf_dir))


for _name in star.Star.NAMES:
    register(_name)((lambda n: lambda spark, sf_dir: getattr(_star(spark, sf_dir), n))(_name))


@register("dim_date_published")
def _dim_date_published(spark, sf_dir):
    """The published calendar (2016 to 2018) with the purchases of each day; the
    driver's orders are 24 years older, so they are moved there."""
    o = tables(spark, sf_dir).orders
    per_day = (o.select(star.date_key(F.add_months(F.to_date("order_purchase_timestamp"), 24 * 12))
                        .alias("date_key"))
               .groupBy("date_key").agg(F.count(F.lit(1)).alias("purchases")))
    return (star.dim_date(spark).join(per_day, "date_key", "left")
            .withColumn("purchases", F.coalesce("purchases", F.lit(0))))


@register("order_min_seller")
def _order_min_seller(spark, sf_dir):
    return star.order_min_seller(tables(spark, sf_dir).items)


@register("union_states")
def _union_states(spark, sf_dir):
    return star.all_states(tables(spark, sf_dir))


# --- measures ---------------------------------------------------------------------------

def _measures(names, by=(), where=None):
    return lambda spark, sf_dir: measures.measures(_star(spark, sf_dir), names, by, where)


def _seller_measures(names, by):
    # the seller dimension is read by every fact: write it once
    return lambda spark, sf_dir: measures.measures(_star(spark, sf_dir).stored("dim_seller"), names, by)


M = measures
register("measures_financial")(_measures(M.FINANCIAL))
register("measures_logistics")(_measures(M.LOGISTICS))
register("measures_quality")(_measures(M.QUALITY))
register("measures_sellers")(_measures(M.SELLERS))
register("measures_by_year")(_measures(M.FINANCIAL + M.LOGISTICS + M.QUALITY, ["year"]))
register("measures_by_region")(_measures(M.FINANCIAL + M.LOGISTICS, ["customer_region"]))
register("measures_by_category")(_measures(M.FINANCIAL + M.LOGISTICS, ["category"]))
register("measures_by_date")(_measures(M.FINANCIAL, ["full_date"]))
register("measures_by_weekend")(_measures(M.FINANCIAL + M.LOGISTICS, ["is_weekend"]))
register("measures_sellers_by_year")(_seller_measures(["total_revenue"] + M.SELLERS, ["year"]))
register("measures_where_category")(_measures(
    M.FINANCIAL, ["year"], {"category": ["category_11", "category_22"]}))
register("measures_where_year")(_measures(M.FINANCIAL + M.LOGISTICS, ["customer_region"], {"year": 1996}))
register("measures_by_seller_segment")(_seller_measures(
    M.FINANCIAL + M.LOGISTICS + M.QUALITY + M.SELLERS, ["segment_tier"]))


def _order_sets(by=(), where=None):
    def run(spark, sf_dir):
        s = _star(spark, sf_dir).stored("fact_orders", "dim_seller")
        return order_sets.measures_of(s, order_sets.order_cells(s), list(by), dict(where or {})).select(
            *by, *order_sets.NAMES)
    return run


register("order_sets_total")(_order_sets())
register("order_sets_by_region")(_order_sets(["customer_region"]))
register("order_sets_by_category")(_order_sets(["category"]))
register("order_sets_by_weekend")(_order_sets(["is_weekend"]))
register("order_sets_where_category")(_order_sets(["year"], {"category": ["category_11", "category_22"]}))
register("order_sets_by_seller_segment")(_order_sets(["segment_tier"]))

# --- load gates ---------------------------------------------------------------------
# The driver tables have no bad rows, so these fixtures make some by arithmetic
# (FIXTURES.md): every row of the child table is still processed.

LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_ORDER = ["l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def _pk(spark, sf_dir):
    return gates.pk_gate(testdata.read(spark, sf_dir, "lineitem"), LINE_KEY, LINE_ORDER)


@register("gate_pk_first_wins")
def _gate_pk_first_wins(spark, sf_dir):
    return _pk(spark, sf_dir)[0]


@register("gate_pk_rejects")
def _gate_pk_rejects(spark, sf_dir):
    return _pk(spark, sf_dir)[1]


def _shifted(df, key):
    """Child fixture: every tenth key negated, so those rows have no parent."""
    return df.withColumn(key, F.when(F.col(key) % 10 == 0, -F.col(key)).otherwise(F.col(key)))


def _fk(spark, sf_dir):
    return gates.fk_gate(_shifted(testdata.read(spark, sf_dir, "lineitem"), "l_orderkey"),
                         testdata.read(spark, sf_dir, "orders"), [("l_orderkey", "o_orderkey")])


@register("gate_fk_keep")
def _gate_fk_keep(spark, sf_dir):
    return _fk(spark, sf_dir)[0]


@register("gate_fk_rejects")
def _gate_fk_rejects(spark, sf_dir):
    return _fk(spark, sf_dir)[1]


@register("gate_domain_rejects")
def _gate_domain_rejects(spark, sf_dir):
    # every rule of every item column is broken by some row
    it = tables(spark, sf_dir).items
    k = F.col("order_id")

    def broken(c, every, how, kind):
        return F.when(k % every == 0, how).otherwise(F.col(c)).cast(kind).alias(c)

    def text(c, null, long_):
        wide = F.lpad(F.col(c).cast("string"), 33, "0")
        return (F.when(k % null == 0, F.lit(None)).when(k % long_ == 0, wide)
                .otherwise(F.col(c).cast("string")).alias(c))

    money = [F.when(k % n == 0, F.lit(None)).when(k % big == 0, F.col(c).cast("decimal(38,2)") + 10 ** 8)
             .otherwise(F.col(c)).cast("decimal(38,2)").alias(c)
             for c, n, big in (("price", 101, 107), ("freight_value", 109, 113))]
    bad = it.select(k.alias("line_order"), F.col("order_item_id").alias("line_no"),
                    text("order_id", 127, 131), broken("order_item_id", 137, F.lit(None), "int"),
                    text("product_id", 139, 149), text("seller_id", 151, 103),
                    "shipping_limit_date", *money)
    rules = gates.domain_rules(schemas.ORDER_ITEMS.fields, schemas.MAX_LENGTH["order_items"])
    # the range rule compares with the declared decimal(10,2)
    _, rejected = gates.domain_gate(bad, rules)
    return rejected.select("line_order", "line_no", gates.REASON)


@register("gate_pk_exact_copies")
def _gate_pk_exact_copies(spark, sf_dir):
    return _pk_copies(spark, sf_dir)[0]


@register("gate_pk_exact_copies_rejects")
def _gate_pk_exact_copies_rejects(spark, sf_dir):
    return _pk_copies(spark, sf_dir)[1]


def _pk_copies(spark, sf_dir):
    """Every seventh order's lines occur twice more, equal in every column."""
    lines = testdata.read(spark, sf_dir, "lineitem")
    twin = lines.where(F.col("l_orderkey") % 7 == 0)
    return gates.pk_gate(lines.unionByName(twin).unionByName(twin), LINE_KEY, LINE_ORDER)


@register("gate_fk_then_pk")
def _gate_fk_then_pk(spark, sf_dir):
    """Every fifth order's lines also occur with an unknown supplier and sort first:
    the foreign key removes these before the primary key picks a winner."""
    lines = testdata.read(spark, sf_dir, "lineitem")
    orphan = (lines.where(F.col("l_orderkey") % 5 == 0)
              .withColumn("l_suppkey", -F.col("l_suppkey")).withColumn("l_partkey", -F.col("l_partkey")))
    valid, _ = gates.fk_gate(lines.unionByName(orphan), testdata.read(spark, sf_dir, "supplier"),
                             [("l_suppkey", "s_suppkey")])
    return gates.pk_gate(valid, LINE_KEY, LINE_ORDER)[0]


@register("enrich_category")
def _enrich_category(spark, sf_dir):
    return testdata.products(spark, sf_dir).select(
        "product_id", "product_category_name", "product_category_name_english")


# --- data quality ---------------------------------------------------------------------

@register("dq_row_counts")
def _dq_row_counts(spark, sf_dir):
    return quality.row_counts(tables(spark, sf_dir))


@register("dq_products_no_category")
def _dq_products_no_category(spark, sf_dir):
    return quality.products_without_english_category(tables(spark, sf_dir).products)


@register("dq_delivered_no_date")
def _dq_delivered_no_date(spark, sf_dir):
    return quality.delivered_missing_delivery_date(tables(spark, sf_dir).orders)


@register("dq_invalid_price_freight")
def _dq_invalid_price_freight(spark, sf_dir):
    it = tables(spark, sf_dir).items
    return quality.invalid_price_or_freight(it.withColumn("price", F.col("price") - 2000))


@register("dq_invalid_scores")
def _dq_invalid_scores(spark, sf_dir):
    r = tables(spark, sf_dir).reviews
    return quality.invalid_review_scores(r.withColumn("review_score", F.col("review_score") + 1))


@register("dq_orphan_items")
def _dq_orphan_items(spark, sf_dir):
    t = tables(spark, sf_dir)
    return quality.orphan_order_items(_shifted(t.items, "order_id"), t.orders)


@register("dq_status_distribution")
def _dq_status_distribution(spark, sf_dir):
    return quality.status_distribution(tables(spark, sf_dir).orders)


@register("dq_report")
def _dq_report(spark, sf_dir):
    return quality.quality_report(tables(spark, sf_dir))


# --- validation and dashboard queries -----------------------------------------------

@register("segment_summary")
def _segment_summary(spark, sf_dir):
    return reports.segment_summary(_supplier_performance_tuned(spark, sf_dir))


@register("segment_share")
def _segment_share(spark, sf_dir):
    return reports.segment_share(_supplier_performance_tuned(spark, sf_dir))


@register("risk_tier_summary")
def _risk_tier_summary(spark, sf_dir):
    return reports.risk_tier_summary(_logistics_regional(spark, sf_dir))


@register("region_freight_ratio")
def _region_freight_ratio(spark, sf_dir):
    return reports.region_freight_ratio(_logistics_regional(spark, sf_dir))


@register("health_tier_summary")
def _health_tier_summary(spark, sf_dir):
    return reports.health_tier_summary(_financial_health_tuned(spark, sf_dir))


@register("dim_row_counts")
def _dim_row_counts(spark, sf_dir):
    return reports.dim_row_counts(_star(spark, sf_dir))


@register("seller_segment_counts")
def _seller_segment_counts(spark, sf_dir):
    return reports.seller_segment_counts(_star(spark, sf_dir))


@register("fact_row_counts")
def _fact_row_counts(spark, sf_dir):
    return reports.fact_row_counts(_star(spark, sf_dir))


@register("overall_delay_rate")
def _overall_delay_rate(spark, sf_dir):
    return reports.overall_delay_rate(_star(spark, sf_dir))
