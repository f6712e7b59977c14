"""Tables bucketed and sorted by a key, so that joins and aggregates on it need no shuffle.

Spark knows a bucketed layout only through a table of the catalog. Files are written as an external
table that is forgotten at once; a reader describes them to its own session again, from the layout
kept in the manifest. Tables that share column and number of buckets join bucket by bucket.

A bucket is one task, which nothing can split. So a table is bucketed only if no bucket
is far above the mean: :func:`even` counts rows by bucket, one small row each, before
anything is written. A table with a hot key stays as it is, and joins on it shuffle, where AQE
splits the hot partition.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A bucket of so many rows is small, whatever the mean; a larger one has at most ``SKEW`` times the mean.
FEW, SKEW = 1_000_000, 4


def even(df: DataFrame, column: str, buckets: int, few: int = FEW) -> bool:
    """Whether rows spread evenly enough over ``buckets`` (one row a bucket is collected)."""
    rows = df.groupBy(F.pmod(F.hash(column), F.lit(buckets)).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    counts = [r.n for r in rows]
    return not counts or max(counts) <= max(few, SKEW * sum(counts) / buckets)


def write(df: DataFrame, path: str, column: str, buckets: int) -> dict:
    """Writes ``df`` to ``path``, one file a bucket, and gives its layout."""
    name = f"mercadia_write_{uuid.uuid4().hex}"
    (df.write.format("parquet").bucketBy(buckets, column).sortBy(column).mode("overwrite")
     .option("path", path).saveAsTable(name))
    df.sparkSession.sql(f"DROP TABLE {name}")       # external: the files stay
    return {"column": column, "buckets": buckets, "schema": df._jdf.schema().toDDL()}


def dealt(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """``df`` with the rows of one bucket in one partition."""
    return df.repartition(buckets, column)


def _table(path: str) -> str:
    return f"mercadia_{hashlib.md5(path.encode()).hexdigest()}"


def read(spark: SparkSession, path: str, layout: dict) -> DataFrame:
    name = _table(path)
    if not spark.catalog.tableExists(name):
        column, place = layout["column"], path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({layout['schema']}) USING parquet OPTIONS (path '{place}') "
                  f"CLUSTERED BY ({column}) SORTED BY ({column}) INTO {layout['buckets']} BUCKETS")
    return spark.table(name)


def forget(spark: SparkSession, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {_table(path)}")
