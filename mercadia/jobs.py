"""The full refresh as one batch job: ingest, gate, check, build, publish.

1. read the seven CSV sources, gate them parents first and enrich categories;
   each accepted table is written as Parquet, orders, items and reviews bucketed by
   order, and read back before its children are gated against it; the rejects are written next to it, and
   the data-quality counts are observed on the way;
2. read the written base tables back, so every later stage starts from files
   in the shared output folder rather than from the CSV lineage (a lost
   executor recomputes from Parquet, not from a CSV parse);
3. write the data-quality report, the three marts and the star schema;
4. publish: all of this went to a folder of its own, and a manifest written last makes it the current
   version (see ``versions``). Running twice gives the same rows, and a refresh that fails
   leaves the version before it in place.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from mercadia.functions.expressions import region_lookup
from mercadia.model import Tables
from mercadia.operators.quality import observed_reports
from mercadia.plans.financial import financial_health
from mercadia.plans.logistics import logistics_regional
from mercadia.plans.star import build_star
from mercadia.plans.supplier import supplier_performance
from mercadia.plans.thresholds import FinancialTiers, LogisticsTiers, SupplierTiers
from mercadia.sources import buckets, csv_ingest, publish, versions


def read_tables(spark: SparkSession, base_dir: str, region: DataFrame | None = None) -> Tables:
    """The base tables of the version published in ``base_dir`` (a refresh's output folder, or its
    ``base``), or of a plain folder with a Parquet folder for each."""
    published = versions.of_group(spark, base_dir, "base")
    if published is None:
        return _tables(lambda name: spark.read.parquet(f"{base_dir.rstrip('/')}/{name}"), spark, region)
    return _tables(lambda name: published.read(spark, f"base/{name}"), spark, region)


def _tables(rd: Callable[[str], DataFrame], spark: SparkSession, region: DataFrame | None) -> Tables:
    return Tables(customers=rd("customers"), sellers=rd("sellers"), products=rd("products"),
                  orders=rd("orders"), items=rd("order_items"), payments=rd("order_payments"),
                  reviews=rd("order_reviews"),
                  region_lookup=region if region is not None else region_lookup(spark))


def refresh(spark: SparkSession, csv_paths: Mapping[str, str | list[str]], translation_path: str,
            out_dir: str, supplier_tiers: SupplierTiers = SupplierTiers(),
            logistics_tiers: LogisticsTiers = LogisticsTiers(),
            financial_tiers: FinancialTiers = FinancialTiers(),
            collation: str | None = None) -> dict[str, str]:
    """Run the whole refresh; returns the paths of the published version by name.

    ``collation`` is passed to the load (see ``csv_ingest.load_marketplace``).
    """
    version = versions.Version(spark, out_dir)
    out = version.folder
    # each gated table is written to base/ and read back before its children
    loaded = csv_ingest.load_marketplace(spark, csv_paths, translation_path,
                                         collation=collation, stage_dir=f"{out}/base")
    paths = {f"base/{k}": f"{out}/base/{k}" for k in loaded.tables.as_dict()}
    paths.update({f"rejects/{k}": v for k, v in
                  publish.write_tables(loaded.rejects, f"{out}/rejects").items()})
    versions.remove(spark, f"{out}/base/{csv_ingest.TAGGED}")

    def base(name: str) -> DataFrame:
        path, layout = paths[f"base/{name}"], loaded.layouts.get(name)
        return buckets.read(spark, path, layout) if layout else spark.read.parquet(path)

    t = _tables(base, spark, loaded.tables.region_lookup)
    checks = observed_reports(spark, loaded.observed, lambda: t.orders, bool(collation))
    paths.update({f"quality/{k}": v for k, v in
                  publish.write_tables(checks, f"{out}/quality").items()})
    supplier = supplier_performance(t, supplier_tiers)
    marts = {"supplier_performance": supplier,
             "logistics_regional": logistics_regional(t, logistics_tiers),
             "financial_health": financial_health(t, financial_tiers)}
    paths.update({f"marts/{k}": v for k, v in
                  publish.write_tables(marts, f"{out}/marts").items()})
    star = build_star(t, tiers=supplier_tiers,
                      supplier=spark.read.parquet(paths["marts/supplier_performance"]))
    paths.update({f"star/{k}": v for k, v in publish.publish_star(star, f"{out}/star").items()})
    return version.publish(paths, {f"base/{k}": v for k, v in loaded.layouts.items()}).paths()


def main(argv: list[str] | None = None) -> dict[str, str]:
    """``python -m mercadia.jobs --customers F --sellers F ... --translation F --out DIR``"""
    import argparse
    import json

    from mercadia.functions.expressions import SOURCE_COLLATION
    from mercadia.session import build_session, checkpoint_dir, input_bytes, scale_conf
    from mercadia.sources import schemas

    ap = argparse.ArgumentParser(prog="python -m mercadia.jobs",
                                 description="Full marketplace refresh on Spark.")
    for table in schemas.LOAD_ORDER:
        ap.add_argument(f"--{table.replace('_', '-')}", required=True, nargs="+",
                        help=f"CSV file(s) of {table}")
    ap.add_argument("--translation", required=True, help="category translation CSV")
    ap.add_argument("--out", required=True, help="output folder (a shared file system)")
    ap.add_argument("--collate", action="store_true",
                    help=f"compare text as {SOURCE_COLLATION}")
    ap.add_argument("--least-partitions", type=int, default=200,
                    help="shuffle partitions at least (more for larger inputs)")
    a = ap.parse_args(argv)
    spark = build_session()
    paths = {t: getattr(a, t) for t in schemas.LOAD_ORDER}
    size = input_bytes(spark, [f for files in paths.values() for f in files])
    for key, value in scale_conf(size, least=a.least_partitions).items():
        spark.conf.set(key, value)
    checkpoint_dir(spark)
    written = refresh(spark, paths, a.translation, a.out,
                      collation=SOURCE_COLLATION if a.collate else None)
    print(json.dumps(written, indent=1))
    return written


if __name__ == "__main__":
    main()
