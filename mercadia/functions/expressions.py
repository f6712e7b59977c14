"""Shared column expressions.

Every helper returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.fixed import REGION_STATES, STATUS_CANCELED, UNKNOWN_REGION


def region_lookup(spark: SparkSession) -> DataFrame:
    """The default ``(state, region)`` lookup: 27 rows."""
    rows = [(s, r) for r, states in REGION_STATES.items() for s in states]
    return spark.createDataFrame(rows, "state string, region string")


def with_region(df: DataFrame, state_col: str, lookup: DataFrame,
                out: str = "region") -> DataFrame:
    """Attach the macro-region of ``state_col``; unmatched or NULL -> 'Unknown'.

    A state listed twice counts once (its smallest region), so no row multiplies; the
    planner broadcasts the lookup if its size allows it.
    """
    lk = lookup.groupBy(F.col("state").alias("__rg_state")).agg(F.min("region").alias("__rg_region"))
    joined = df.join(lk, F.col(state_col) == F.col("__rg_state"), "left")
    return (joined.withColumn(out, F.coalesce(F.col("__rg_region"), F.lit(UNKNOWN_REGION)))
            .drop("__rg_state", "__rg_region"))


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- delivery flags -------------------------------------------------------

def late_flag(delivered="order_delivered_customer_date",
              estimated="order_estimated_delivery_date") -> Column:
    """Two-valued lateness: 1 when delivered strictly after the estimate, else 0.

    Undelivered orders and orders without an estimate give 0 (the comparison is
    NULL and falls to the ELSE branch).
    """
    d, e = col_(delivered), col_(estimated)
    return F.when(d.isNotNull() & (d > e), F.lit(1)).otherwise(F.lit(0))


def on_time_flag(delivered="order_delivered_customer_date",
                 estimated="order_estimated_delivery_date") -> Column:
    """Three-valued punctuality: 1 on time, 0 late, NULL when the outcome is unknown."""
    d, e = col_(delivered), col_(estimated)
    return (F.when(d.isNotNull() & (d <= e), F.lit(1))
            .when(d.isNotNull() & (d > e), F.lit(0)))


def cancelled_flag(status="order_status", value: str = STATUS_CANCELED) -> Column:
    return F.when(col_(status) == F.lit(value), F.lit(1)).otherwise(F.lit(0))


def days_between(end, start) -> Column:
    """Whole calendar days from ``start`` to ``end``; time of day is ignored."""
    return F.datediff(col_(end), col_(start))


def date_key(ts) -> Column:
    """YYYYMMDD integer of a timestamp or date, by arithmetic (no string format)."""
    c = col_(ts)
    return F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)


#: Partition column of a published fact: year and month of its date key.
YEAR_MONTH = "year_month"


def year_month(key) -> Column:
    """YYYYMM of a YYYYMMDD key."""
    return F.floor(col_(key) / 100).cast("int")


# --- exact arithmetic -------------------------------------------------------
# A published ratio is rounded once, half away from zero, straight from the exact
# quotient: round(n / d, k) = (2 n 10^k + d) div (2 d) / 10^k, all in DECIMAL.

def dec(c, scale: int = 0) -> Column:
    return col_(c).cast(f"decimal(26,{scale})")


def ratio(num, den, digits: int, num_scale: int = 0) -> Column:
    """``round(num / nullif(den, 0), digits)``, rounded once; NULL on a zero denominator.

    ``num_scale`` is the decimal scale of ``num``; ``den`` may have up to six.
    """
    n, d = dec(num, num_scale), dec(F.nullif(col_(den), F.lit(0)), 6)
    twice = F.lit(Decimal(2 * 10 ** digits)).cast("decimal(10,0)")
    whole = F.call_function("div", F.abs(n) * twice + F.abs(d), F.abs(d) * F.lit(Decimal(2)))
    value = whole.cast("decimal(19,0)") * F.lit(Decimal(1).scaleb(-digits))
    return F.when((n < 0) != (d < 0), -value).otherwise(value).cast(f"decimal(26,{digits})")


def quotient(num, den) -> Column:
    """``num / den`` as a double, unrounded; NULL on a zero or missing denominator."""
    return col_(num).cast("double") / F.nullif(col_(den).cast("double"), F.lit(0.0))


def mean(c, digits: int, scale: int = 0, over=None) -> Column:
    """Aggregate: mean of the non-NULL values, rounded once; with ``over`` (a window)
    the same as a window expression."""
    x = col_(c)
    s, n = F.sum(x), F.count(x)
    if over is not None:
        s, n = s.over(over), n.over(over)
    return ratio(s, n, digits, scale)


# --- whole-table values -------------------------------------------------------------

def with_scalars(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach the columns of ``one``, a frame of exactly one row (a global
    aggregate), to every row of ``df`` as a scalar subquery: Spark computes it
    once, before ``df``'s stages, and inlines the values; no join is planned."""
    packed = one.select(F.struct(*[F.col(f"`{c}`") for c in one.columns]).alias("__s"))
    return df.withColumn("__s", packed.scalar()).select(
        "*", *[F.col(f"__s.`{c}`").alias(c) for c in one.columns]).drop("__s")


# --- text comparison --------------------------------------------------------------

SOURCE_COLLATION = "UNICODE_CI_AI_RTRIM"  # case- and accent-insensitive, trailing spaces ignored


def collate_strings(df: DataFrame, collation: str = SOURCE_COLLATION) -> DataFrame:
    """Give every top-level text column ``collation``.

    Grouping, joins, ``=``/``IN`` and DISTINCT then compare text as the source
    database did ('SP' = 'sp ', 'São Paulo' = 'Sao Paulo'). Every table that
    is joined on text must be collated the same way: Spark refuses to compare
    two different collations. Collation-aware hashing costs CPU, so it is an
    opt-in; binary comparison is the default.
    """
    from pyspark.sql import types as T
    cols = [F.col(f"`{f.name}`").cast(f"string collate {collation}").alias(f.name)
            if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
            for f in df.schema.fields]
    return df.select(*cols)
