"""Data-quality checks over the base tables.

Each check is a DataFrame; :func:`quality_report` stacks them into one
``(check, violations)`` frame, computing the checks of one table in a single
pass with ``count_if``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.fixed import ORDER_STATUSES, STATUS_DELIVERED
from mercadia.model import Tables


def _no_english() -> Column:
    return F.col("product_category_name_english").isNull()


def _no_delivery_date() -> Column:
    return (F.col("order_status") == STATUS_DELIVERED) & F.col("order_delivered_customer_date").isNull()


def _bad_price() -> Column:
    return (F.col("price") <= 0) | (F.col("freight_value") < 0)


def _bad_score() -> Column:
    return ~F.col("review_score").between(1, 5)


def row_counts(t: Tables) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(name).alias("table_name"), "row_count")
             for name, df in t.as_dict().items()]
    return reduce(DataFrame.unionAll, parts)


def products_without_english_category(products: DataFrame) -> DataFrame:
    return products.agg(F.count_if(_no_english())
                        .alias("products_without_english_category"))


def delivered_missing_delivery_date(orders: DataFrame) -> DataFrame:
    return orders.agg(F.count_if(_no_delivery_date())
                      .alias("delivered_orders_missing_delivery_date"))


def invalid_price_or_freight(items: DataFrame) -> DataFrame:
    return items.agg(F.count_if(_bad_price())
                     .alias("invalid_price_or_freight"))


def invalid_review_scores(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.count_if(_bad_score())
                       .alias("invalid_review_scores"))


def orphan_order_items(items: DataFrame, orders: DataFrame) -> DataFrame:
    orphans = items.join(orders.select("order_id"), "order_id", "left_anti")
    return orphans.agg(F.count(F.lit(1)).alias("orphan_order_items"))


def status_distribution(orders: DataFrame) -> DataFrame:
    return (orders.groupBy("order_status").agg(F.count(F.lit(1)).alias("total"))
            .orderBy(F.desc("total"), "order_status"))


def quality_report(t: Tables) -> DataFrame:
    """All single-number checks as ``(check, violations)``; every table is read once:
    items collapse to their order and meet it in one full outer join."""
    items = t.items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(_bad_price()).alias("bad"))
    orders = t.orders.select(F.col("order_id").alias("o"), "order_status", "order_delivered_customer_date")
    both = items.join(orders, F.col("order_id") == F.col("o"), "full").agg(
        F.count_if(_no_delivery_date()).alias("late"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
        F.coalesce(F.sum(F.when(F.col("o").isNull(), F.col("n"))), F.lit(0)).alias("orphans"))
    rows = both.select(F.stack(
        F.lit(3), F.lit("delivered_orders_missing_delivery_date"), "late",
        F.lit("invalid_price_or_freight"), "bad", F.lit("orphan_order_items"), "orphans")
        .alias("check", "violations"))

    def one(df: DataFrame) -> DataFrame:
        name = df.columns[0]
        return df.select(F.lit(name).alias("check"), F.col(name).alias("violations"))

    return reduce(DataFrame.unionAll, [one(products_without_english_category(t.products)), rows,
                                       one(invalid_review_scores(t.reviews))])


# -- the same numbers, counted while a table is written --------------------------------------

CHECKS = {"products": ("products_without_english_category", _no_english),
          "orders": ("delivered_orders_missing_delivery_date", _no_delivery_date),
          "order_items": ("invalid_price_or_freight", _bad_price),
          "order_reviews": ("invalid_review_scores", _bad_score)}


def observed(table: str) -> list[Column]:
    """Aggregates to observe on the rows of a table: its row count, its check and, for
    orders, the number of each status; a status outside ``ORDER_STATUSES`` is counted as other."""
    out = [F.count(F.lit(1)).alias("rows")]
    if table in CHECKS:
        name, rule = CHECKS[table]
        out.append(F.count_if(rule()).alias(name))
    if table == "orders":
        status = F.col("order_status")
        out += [F.count_if(status == s).alias(f"status:{s}") for s in ORDER_STATUSES]
        out.append(F.count_if(~status.isin(*ORDER_STATUSES)).alias("status:"))
    return out


def observed_reports(spark: SparkSession, seen: Mapping[str, Mapping[str, int]],
                     orders: Callable[[], DataFrame], collated: bool = False) -> dict[str, DataFrame]:
    """``row_counts``, ``quality_report`` and ``status_distribution`` from what was observed on
    the accepted rows of a load. Items whose order is missing never pass the load's foreign
    key, so there are none. Only if orders had a status that is not one of ``ORDER_STATUSES``,
    or statuses compare ``collated``, is their status column read again."""
    checks = [(name, int(seen[table][name])) for table, (name, _) in CHECKS.items()]
    status = {k.partition(":")[2]: int(n) for k, n in seen["orders"].items() if k.startswith("status:")}
    if status.pop("", 0) or collated:
        distribution = status_distribution(orders())
    else:
        found = sorted(((s, n) for s, n in status.items() if n), key=lambda x: (-x[1], x[0]))
        distribution = spark.createDataFrame(found, "order_status string, total long").coalesce(1)
    return {"row_counts": spark.createDataFrame([(t, int(c["rows"])) for t, c in seen.items()],
                                                "table_name string, row_count long").coalesce(1),
            "quality_report": spark.createDataFrame([*checks, ("orphan_order_items", 0)],
                                                    "check string, violations long").coalesce(1),
            "status_distribution": distribution}
