"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.session import checkpoint_dir, input_bytes
from mercadia.sources.versions import remove

#: Characters deleted or split on by the text contracts (space, \t \n \v \f \r).
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def widen(spark: SparkSession, path: str, bytes_a_partition: int = 256 << 20) -> None:
    """Raises the session's shuffle width to one partition per ``bytes_a_partition`` below ``path``,
    where that is more: explicit range partitionings are not split at run time."""
    parts = -(-input_bytes(spark, [path]) // bytes_a_partition)
    if parts > width(spark):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared ``spark.checkpoint.dir``."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


_scopes: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """Removes the scratch folders made inside at the end, those that are still in the list."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks it ran, not the stages
    before, and later readers get column pruning and size statistics.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def aside(df: DataFrame, made: list[str], keep: list[str] = ()) -> DataFrame:
    """``df`` with every column that bears a name of ``made`` renamed by trailing underscores.

    Names compare without case, as Spark resolves them, so an operator may add the
    columns ``made`` to any table. The columns ``keep``, which the operator is told to use, keep
    their names; one that is to be made as well is an error.
    """
    taken = {m.lower() for m in made}
    if taken & {c.lower() for c in keep}:
        raise ValueError(f"an output column of {made} has the name of a column that is read: {keep}")
    used = taken | {c.lower() for c in df.columns}
    out = []
    for c in df.columns:
        new = c
        while c.lower() in taken and new.lower() in used:
            new += "_"
        used.add(new.lower())
        out.append(new)
    return df.toDF(*out)


def keep_chars(text: Column, drop: str = BLANKS) -> Column:
    """``text`` without the characters of ``drop``; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for ch in drop:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def remainder(id_col: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor`` (null ids count as '')."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")),
                  F.lit(divisor))
