"""Ranking windows that scale.

``Window.orderBy`` without ``partitionBy`` moves every row into one task. That
is harmless for a bounded input (a country's states, a category list) and is
what :func:`window_rank` does. For inputs that grow with the data (sellers,
orders) :func:`range_rank` gives the same numbers while the work stays
spread over the cluster, the same way at every size:

1. collapse the input to its distinct sort keys with a multiplicity
   (map-side partial aggregation, so one very frequent key costs one row);
2. range-partition these keys (as wide as ``spark.sql.shuffle.partitions``),
   note each key's partition and write the result to the shared folder, so
   that it is the same for all later readers;
3. rank inside each partition with an ordinary window;
4. add the running totals of the partitions before: one row per partition, and
   per value of ``partition_by`` in it;
5. join the ranks back to the rows by key.

Equal keys are one row, so ties rank exactly as in the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercadia.session import materialized

OrderSpec = Sequence[tuple[str, bool]]  # (column, ascending)


def _sort_col(c: str, asc: bool) -> Column:
    # SQL default null placement: ASC -> NULLS FIRST, DESC -> NULLS LAST
    return F.col(c).asc_nulls_first() if asc else F.col(c).desc_nulls_last()


def _method(method: str) -> tuple[str, int | None]:
    if method.startswith("ntile:"):
        return "ntile", int(method.split(":", 1)[1])
    if method not in ("rank", "dense_rank", "row_number", "percent_rank"):
        raise ValueError(f"unknown rank method {method!r}")
    return method, None


def window_rank(df: DataFrame, order: OrderSpec, method: str, out: str,
                partition_by: Sequence[str] = ()) -> DataFrame:
    """Plain window ranking, for inputs whose size is bounded by the domain."""
    kind, n = _method(method)
    w = Window.partitionBy(*partition_by).orderBy(*[_sort_col(c, a) for c, a in order])
    fn = {"rank": F.rank(), "dense_rank": F.dense_rank(), "row_number": F.row_number(),
          "percent_rank": F.percent_rank()}.get(kind) if kind != "ntile" else F.ntile(n)
    col = fn.over(w)
    if kind != "percent_rank":
        col = col.cast("bigint")
    return df.withColumn(out, col)


def _key_struct(df: DataFrame, order: OrderSpec) -> Column:
    """A struct whose ascending order is the requested order (nulls as in SQL)."""
    fields = []
    for i, (c, asc) in enumerate(order):
        dt = df.schema[c].dataType
        if asc:
            fields += [F.col(c).isNotNull().alias(f"n{i}"), F.col(c).alias(f"v{i}")]
        else:
            if not isinstance(dt, T.NumericType):
                raise TypeError(f"descending bucketed rank needs a numeric column, got {c}: {dt}")
            fields += [F.col(c).isNull().alias(f"n{i}"), (-F.col(c)).alias(f"v{i}")]
    return F.struct(*fields)


def rank_table(df: DataFrame, order: OrderSpec, method: str, out: str,
               partition_by: Sequence[str] = (), unique: bool = False,
               ranges: int | None = None) -> DataFrame:
    """The rank of every distinct ``partition_by + order`` key, as a table.

    Returns ``(*partition_by, *order columns, out)``, one row per distinct key;
    with ``unique=True`` (the key identifies a row) it returns the rows of
    ``df`` with ``out`` added. See :func:`range_rank` for the parameters.
    """
    kind, n_tiles = _method(method)
    part = list(partition_by)
    keys = [c for c, _ in order]
    if unique:
        kc = df.withColumn("__n", F.lit(1).cast("bigint"))
    else:
        kc = df.groupBy(*part, *keys).agg(F.count(F.lit(1)).alias("__n"))
    kc = kc.withColumn("__k", _key_struct(kc, order))
    width = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kc = materialized(kc.repartitionByRange(width, *part, "__k")
                      .withColumn("__b", F.spark_partition_id()), "rank")

    # ranks inside each (partition value, range)
    w = Window.partitionBy(*part, "__b").orderBy("__k")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    local = (kc.withColumn("__rows_lo", F.coalesce(F.sum("__n").over(before), F.lit(0)))
             .withColumn("__keys_lo", F.row_number().over(w) - 1))
    # totals of each (partition value, range) and their running sums
    tot = kc.groupBy(*part, "__b").agg(F.sum("__n").alias("__rows"),
                                       F.count(F.lit(1)).alias("__keys"))
    wo_before = Window.partitionBy(*part).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(
        *[F.col(c).alias(f"__p{i}") for i, c in enumerate(part)],
        F.col("__b").alias("__pb"),
        F.coalesce(F.sum("__rows").over(wo_before), F.lit(0)).alias("__rows_off"),
        F.coalesce(F.sum("__keys").over(wo_before), F.lit(0)).alias("__keys_off"),
        F.sum("__rows").over(Window.partitionBy(*part)).alias("__total"))
    # partition values may be NULL, hence the NULL-safe match; the planner broadcasts
    # the totals when they are small
    cond = [F.col(c).eqNullSafe(F.col(f"__p{i}")) for i, c in enumerate(part)]
    kc = (local.join(tot, cond + [F.col("__b") == F.col("__pb")])
          .drop(*[f"__p{i}" for i in range(len(part))], "__pb"))

    rank = F.col("__rows_off") + F.col("__rows_lo") + 1
    if kind in ("rank", "row_number"):
        val = rank
    elif kind == "dense_rank":
        val = F.col("__keys_off") + F.col("__keys_lo") + 1
    elif kind == "percent_rank":
        nn = F.col("__total")
        val = F.when(nn > 1, (rank - 1).cast("double") / (nn - 1)).otherwise(F.lit(0.0))
    else:  # ntile over the row number: the first N % n tiles get one row more
        r, nn = rank, F.col("__total")
        q = F.floor(nn / n_tiles)
        rem = nn - q * n_tiles
        big = rem * (q + 1)
        val = F.when(r <= big, F.floor((r - 1) / (q + 1)) + 1) \
            .otherwise(rem + F.floor((r - 1 - big) / q) + 1)
    if kind != "percent_rank":
        val = val.cast("bigint")
    cols = df.columns if unique else part + keys
    return kc.select(*cols, val.alias(out))


def join_ranks(df: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """Attach a rank table to rows by its key columns (NULL-safe)."""
    on = list(on)
    t = table.select(*[F.col(c).alias(f"__j{i}") for i, c in enumerate(on)],
                     *[c for c in table.columns if c not in on])
    cond = [F.col(c).eqNullSafe(F.col(f"__j{i}")) for i, c in enumerate(on)]
    return df.join(t, cond, "inner").drop(*[f"__j{i}" for i in range(len(on))])


def dense_ranks_by_lead(df: DataFrame, lead: str, then: str, within: str, out: str, out_within: str) -> DataFrame:
    """Dense ranks by ``lead`` and ``then``, both descending, over all rows (``out``) and inside each
    value of ``within`` (``out_within``): one row for each distinct ``(within, lead, then)``.

    For a ``lead`` whose number of values the domain bounds (a mean score of so many digits). A
    key's rank is the number of keys with a higher lead, plus its rank among those of its own lead.
    Both ranks inside a lead come from one shuffle of the distinct keys by lead; the running
    totals are taken over leads, a bounded list. Nothing is range-partitioned, collected or written.
    """
    keys = df.select(within, lead, then).distinct()
    falls = F.col(then).desc_nulls_last()
    keys = (keys.withColumn("__all", F.dense_rank().over(Window.partitionBy(lead).orderBy(falls)))
            .withColumn("__in", F.dense_rank().over(Window.partitionBy(lead, within).orderBy(falls))))

    def before(counted: str, groups: list[str], name: str) -> DataFrame:
        upto = (Window.partitionBy(*groups).orderBy(F.col(lead).desc_nulls_last())
                .rowsBetween(Window.unboundedPreceding, -1))
        totals = keys.groupBy(*groups, lead).agg(F.max(counted).alias("__n"))
        return totals.select(*[F.col(g).alias(f"__g{k}") for k, g in enumerate(groups)], F.col(lead).alias("__lead"),
                             F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias(name))

    def joined(rows: DataFrame, totals: DataFrame, groups: list[str]) -> DataFrame:
        on = [F.col(lead).eqNullSafe(F.col("__lead"))] + [
            F.col(g).eqNullSafe(F.col(f"__g{k}")) for k, g in enumerate(groups)]
        return rows.join(totals, on).drop("__lead", *[f"__g{k}" for k in range(len(groups))])

    ranked = joined(joined(keys, before("__all", [], "__all0"), []), before("__in", [within], "__in0"), [within])
    return ranked.select(within, lead, then, (F.col("__all") + F.col("__all0")).cast("bigint").alias(out),
                         (F.col("__in") + F.col("__in0")).cast("bigint").alias(out_within))


def range_rank(df: DataFrame, order: OrderSpec, method: str, out: str,
               partition_by: Sequence[str] = (), unique: bool = False,
               ranges: int | None = None) -> DataFrame:
    """Exact rank / dense_rank / row_number / percent_rank / ntile:N over big inputs.

    ``unique=True`` promises that ``partition_by + order`` columns identify a
    row (needed for row_number and ntile to be deterministic); then the
    distinct-key step and the join back are skipped. ``ranges`` overrides the
    number of range partitions. The call writes the ranged keys (one job).
    """
    t = rank_table(df, order, method, out, partition_by, unique, ranges)
    if unique:
        return t
    return join_ranks(df, t, list(partition_by) + [c for c, _ in order])


def with_overall_means(df: DataFrame, means: dict[str, tuple[str, int]],
                       bounded: bool = False, source: DataFrame | None = None) -> DataFrame:
    """``ROUND(AVG(col) OVER (), digits)`` for each ``out -> (col, digits)``.

    For a domain-bounded input (``bounded=True``) this is the plain window over
    all rows. Otherwise the global aggregate, one row by construction, is a
    scalar subquery attached to every row, instead of moving all rows through
    a single-partition window. ``source`` is a frame with the same rows and
    averaged columns as ``df`` but a cheaper plan (e.g. before rank joins),
    to aggregate instead of ``df``.
    """
    from mercadia.functions.expressions import mean, with_scalars

    def scale(c: str) -> int:
        dt = df.schema[c].dataType
        return dt.scale if isinstance(dt, T.DecimalType) else 0

    if bounded:
        w = Window.partitionBy()
        return df.select("*", *[mean(c, d, scale(c), over=w).alias(o)
                                for o, (c, d) in means.items()])
    src = df if source is None else source
    one = src.agg(*[mean(c, d, scale(c)).alias(o) for o, (c, d) in means.items()])
    return with_scalars(df, one)
