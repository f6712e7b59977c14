"""Exact dedup by content sort (DataFrame functions only).

Rows are range-partitioned on a bounded image of the normalised bytes (their
first ``PREFIX`` characters and a 64-bit hash, so that the splitters Spark
samples stay small however long texts are), sorted externally by the whole
normalised text, and every row is compared in full with its neighbour: a run of
equal neighbours is one group. Rows of a text whose copies would overfill a
partition are dealt over several range partitions by a salt that is part of the
sort key; each salted slice is reduced to one head per run, and the heads -
a bounded number, see ``hot_keys`` - are sorted and compared in full again to
join the slices.

Defined cases: a null text counts as empty, and empty texts equal each other;
a null id sorts first; rows that repeat id and text form one group of which
exactly one row is kept; an empty table gives an empty table; columns of the
input other than id and text are carried through untouched only by
:func:`deduplicate` and may have any name that does not start with ``__xd_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercadia.llm.common import keep_chars, staged, width

PREFIX = 32
KEY = ["__xd_prefix", "__xd_hash"]


def _keyed(df: DataFrame, text: str, normalise) -> DataFrame:
    norm = normalise(F.col(f"`{text}`"))
    return (df.withColumn("__xd_norm", norm)
            .withColumn("__xd_prefix", F.substring("__xd_norm", 1, PREFIX))
            .withColumn("__xd_hash", F.xxhash64("__xd_norm")).drop("__xd_norm"))


def hot_keys(keys: DataFrame, partitions: int) -> DataFrame:
    """Keys with more than half a partition's share of all rows, with the number
    of slices to deal them over. At most ``2 * partitions`` keys can have that
    many rows, whatever the table, so the result is small enough to broadcast;
    the slices of all hot keys together are at most ``4 * partitions``.
    """
    counts = keys.groupBy(*KEY).agg(F.count(F.lit(1)).alias("__xd_n"))
    share = keys.agg(F.count(F.lit(1)) / F.lit(2 * partitions)).scalar()
    return (counts.withColumn("__xd_share", share)
            .where(F.col("__xd_n") > F.greatest("__xd_share", F.lit(2.0)))
            .select(*KEY, F.ceil(F.col("__xd_n") / F.col("__xd_share")).cast("int").alias("__xd_slices")))


def groups(df: DataFrame, id_col: str, text: str, carry: list[str] = (),
           normalise=keep_chars) -> DataFrame:
    """One row per input row: the carried columns, ``keep_id``, ``group_size``,
    ``kept`` and ``text_sha256`` (of the normalised text).

    Of equal texts the row with the most code points in the original text stays,
    then the one with the smallest id.
    """
    spark = df.sparkSession
    parts = width(spark)
    cols = list(dict.fromkeys([id_col, text, *carry]))
    keyed = _keyed(df.select(*[F.col(f"`{c}`") for c in cols]), text, normalise)
    hot = staged(hot_keys(keyed.select(*KEY), parts), "xd-hot")
    dealt = (keyed.join(F.broadcast(hot), KEY, "left")
             .withColumn("__xd_salt", F.when(
                 F.col("__xd_slices").isNotNull(),
                 # by the row's place, which only spreads rows, those of one id too
                 F.pmod(F.monotonically_increasing_id(), F.col("__xd_slices")))
                 .otherwise(F.lit(0)).cast("int"))
             .repartitionByRange(parts, *KEY, "__xd_salt")
             .withColumn("__xd_norm", normalise(F.col(f"`{text}`")))
             .withColumn("__xd_len", F.coalesce(F.length(f"`{text}`"), F.lit(0))))
    order = [F.col("__xd_norm"), F.col("__xd_len").desc(), F.col(f"`{id_col}`")]
    slice_ = Window.partitionBy(*KEY, "__xd_salt").orderBy(*order)
    new = F.coalesce(F.lag("__xd_norm").over(slice_) != F.col("__xd_norm"), F.lit(True))
    keep_text = [text] if text in carry else []
    light = list(dict.fromkeys([id_col, *[c for c in carry if c != text], *keep_text]))
    runs = (dealt.withColumn("__xd_new", new)
            .withColumn("__xd_run", F.sum(F.col("__xd_new").cast("int")).over(slice_))
            .withColumn("text_sha256", F.sha2(F.col("__xd_norm"), 256))
            .withColumn("__xd_head", F.when(F.col("__xd_new") & F.col("__xd_slices").isNotNull(),
                                            F.col("__xd_norm")))
            .select(*[F.col(f"`{c}`") for c in light], "text_sha256", *KEY, "__xd_salt", "__xd_run",
                    "__xd_new", "__xd_len", "__xd_slices", "__xd_head"))
    run = Window.partitionBy(*KEY, "__xd_salt", "__xd_run")
    first = run.orderBy(F.col("__xd_len").desc(), F.col(f"`{id_col}`"))
    runs = (runs.withColumn("__xd_keep", F.first(f"`{id_col}`").over(first))
            .withColumn("__xd_size", F.count(F.lit(1)).over(run)))
    runs = staged(runs, "xd-runs")
    joined = _join_slices(runs)
    # one row per slice and run of a hot key: at most the slices of hot_keys, unless
    # different texts share a 64-bit hash and their first characters
    on = [*KEY, "__xd_salt", "__xd_run"]
    out = runs.join(F.broadcast(joined), on, "left")
    return out.select(
        *[F.col(f"`{c}`") for c in light],
        F.when(F.col("__xd_first").isNotNull(), F.col("__xd_all_keep")).otherwise(F.col("__xd_keep")).alias("keep_id"),
        F.coalesce("__xd_all_size", "__xd_size").alias("group_size"),
        (F.col("__xd_new") & F.coalesce("__xd_first", F.lit(True))).alias("kept"),
        "text_sha256")


def _join_slices(runs: DataFrame) -> DataFrame:
    """Heads of the slices of hot keys, compared in full with their neighbours."""
    heads = runs.where(F.col("__xd_head").isNotNull())
    near = Window.partitionBy(*KEY).orderBy("__xd_head", F.col("__xd_len").desc(), "__xd_keep", "__xd_salt")
    new = F.coalesce(F.lag("__xd_head").over(near) != F.col("__xd_head"), F.lit(True))
    heads = (heads.withColumn("__xd_first", new)
             .withColumn("__xd_group", F.sum(F.col("__xd_first").cast("int")).over(near)))
    whole = Window.partitionBy(*KEY, "__xd_group")
    ordered = whole.orderBy(F.col("__xd_len").desc(), "__xd_keep", "__xd_salt")
    return heads.select(*KEY, "__xd_salt", "__xd_run", "__xd_first",
                        F.first("__xd_keep").over(ordered).alias("__xd_all_keep"),
                        F.sum("__xd_size").over(whole).alias("__xd_all_size"))


def deduplicate(df: DataFrame, id_col: str, text: str, normalise=keep_chars) -> DataFrame:
    """The rows of ``df`` that stay, with all columns of ``df`` in their order."""
    held = [f"__xd_c{i}" for i in range(len(df.columns))]
    renamed = df.toDF(*held)
    at = {c: held[i] for i, c in enumerate(df.columns)}
    out = groups(renamed, at[id_col], at[text], held, normalise)
    return out.where("kept").select(*[F.col(h).alias(c) for h, c in zip(held, df.columns)])

