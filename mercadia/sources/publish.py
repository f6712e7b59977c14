"""Sinks: named views for SQL users and Parquet hand-off of tables and star.

Writes use ``overwrite`` so a reload is idempotent (running it twice leaves
the same rows). The facts are partitioned by year and month of their date, so readers that
slice by any attribute of the calendar prune whole folders; the calendar and geography dimensions are
bounded, so they are written as a single file each; every other output keeps
the parallelism of its plan.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercadia.functions.expressions import YEAR_MONTH, year_month
from mercadia.functions.order_sets import order_cells

#: Facts, and the key that spreads a month's rows.
FACTS = {"fact_orders": "order_id", "fact_reviews": "review_id"}
BOUNDED_DIMENSIONS = ("dim_date", "dim_geography")


def register_views(frames: Mapping[str, DataFrame]) -> list[str]:
    """``CREATE OR REPLACE TEMP VIEW name`` for each frame."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return list(frames)


def register_all(t, star=None, supplier_tiers=None, logistics_tiers=None,
                 financial_tiers=None) -> list[str]:
    """Publish the three marts, the five dimensions and the two facts as temp
    views, so SQL users query them by name (``spark.sql("SELECT ... FROM
    supplier_performance")``). Views are lazy, except that the
    supplier mart writes its seller rows and ranked keys first."""
    from mercadia.plans.financial import financial_health
    from mercadia.plans.logistics import logistics_regional
    from mercadia.plans.star import build_star
    from mercadia.plans.supplier import supplier_performance
    from mercadia.plans.thresholds import FinancialTiers, LogisticsTiers, SupplierTiers
    st = supplier_tiers or SupplierTiers()
    sp = supplier_performance(t, st)
    s = star if star is not None else build_star(t, tiers=st, supplier=sp)
    frames = {"supplier_performance": sp,
              "logistics_regional": logistics_regional(t, logistics_tiers or LogisticsTiers()),
              "financial_health": financial_health(t, financial_tiers or FinancialTiers()),
              **s.as_dict()}
    return register_views(frames)


def register_published(spark, folder: str, database: str) -> list[str]:
    """Catalog views of a refresh's current version: base tables, marts, dimensions and facts, each
    under its own name in ``database``. They are stored objects, so with a metastore they outlive the
    session; registering again after a refresh moves them to its version."""
    from mercadia.sources import versions
    published = versions.current(spark, folder)
    if published is None:
        raise ValueError(f"nothing is published in {folder}")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    names = []
    for name, path in published.paths().items():
        group, _, table = name.partition("/")
        if group in ("base", "marts", "star"):
            spark.sql(f"CREATE OR REPLACE VIEW `{database}`.`{table}` AS SELECT * FROM parquet.`{path}`")
            names.append(f"{database}.{table}")
    return names


def write_tables(frames: Mapping[str, DataFrame], out_dir: str) -> dict[str, str]:
    """Full reload of base tables: one Parquet folder per table, overwritten."""
    paths = {}
    for name, df in frames.items():
        path = f"{out_dir.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        paths[name] = path
    return paths


def publish_star(star, out_dir: str, sets: bool = True) -> dict[str, str]:
    """Write the five dimensions and two facts for a BI tool to import and, with ``sets``, the
    order sets from which distinct orders are counted (see ``order_sets``)."""
    paths: dict[str, str] = {}
    spark = star.fact_orders.sparkSession
    for name, df in star.as_dict().items():
        path = f"{out_dir.rstrip('/')}/{name}"
        w = df
        if name in BOUNDED_DIMENSIONS:
            w = df.coalesce(1)
        writer = w.write.mode("overwrite")
        if name in FACTS:
            # a month's rows go to a few tasks, more of them the wider the session is
            spread = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 64)
            w = (df.withColumn("year", (F.col("date_key") / 10000).cast("int"))
                 .withColumn(YEAR_MONTH, year_month("date_key"))
                 .repartition(YEAR_MONTH, F.pmod(F.xxhash64(FACTS[name]), F.lit(spread))))
            writer = w.write.mode("overwrite").partitionBy("year", YEAR_MONTH)
        writer.parquet(path)
        paths[name] = path
    if sets:
        # from the written star, so nothing before it is computed again
        from mercadia.plans.star import read_star
        path = f"{out_dir.rstrip('/')}/order_cells"
        cells = order_cells(read_star(spark, out_dir))
        cells.sortWithinPartitions("date_key").write.mode("overwrite").parquet(path)
        paths["order_cells"] = path
    return paths
