"""Load gates: primary key, foreign key and domain rules, each splitting rows
into accepted and rejected DataFrames. Accepted and rejected rows together are
the input rows, copies included.

All of them tolerate a very frequent key: the primary-key winner is an aggregate
(map-side partial, so a hot key collapses before the shuffle); foreign keys are
semi/anti or left joins, which AQE splits when one key dominates a partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REASON = "reject_reason"


def pk_gate(df: DataFrame, keys: Sequence[str], order: Sequence[str],
            row_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Keep the first row of each key by ``order`` (ascending, NULLs first).

    ``order`` should make the order total (e.g. a file position column);
    otherwise ties are broken by the remaining columns. Of rows equal in every
    column one is accepted and the others are rejected. ``row_id`` names a column
    unique per row (such as the file position): rejects are then found by that
    column alone instead of by every column. Returns ``(accepted, rejected)``.

    The winner is ``min(struct(order..., rest...))`` per key. A struct buffer
    makes Spark plan a sort-based aggregate; it is still partial on the map
    side, so a duplicated key collapses before the shuffle (a window would
    send all of that key's rows to one task). Without ``row_id`` equal rows are
    counted first, so exact copies are one row from there on, and a reject is
    emitted as often as its row occurs beyond the one accepted.
    """
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys and c not in order]

    def first_of(rows: DataFrame) -> DataFrame:
        return (rows.groupBy(*keys)
                .agg(F.min(F.struct(*[F.col(c) for c in order + rest])).alias("__w"))
                .select(*keys, *[F.col(f"__w.{c}").alias(c) for c in order + rest])
                .select(*df.columns))

    if row_id:
        win = first_of(df)
        w = win.select(F.col(row_id).alias("__a"))
        rejected = df.join(w, F.col(row_id).eqNullSafe(F.col("__a")), "left_anti")
    else:
        counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
        win = first_of(counted)
        w = win.select(*[F.col(c).alias(f"__a{i}") for i, c in enumerate(df.columns)], F.lit(1).alias("__won"))
        cond = [F.col(c).eqNullSafe(F.col(f"__a{i}")) for i, c in enumerate(df.columns)]
        spare = F.col("__n") - F.coalesce("__won", F.lit(0))
        rejected = (counted.join(w, cond, "left").withColumn("__spare", spare).where("__spare > 0")
                    .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__spare"))))
                    .select(*df.columns))
    return win, rejected.withColumn(REASON, F.lit("duplicate_key"))


def fk_gate(child: DataFrame, parent: DataFrame,
            on: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Keep child rows whose ``(child_col, parent_col)`` pairs exist in the parent."""
    p = parent.select(*[F.col(pc).alias(f"__fk{i}") for i, (_, pc) in enumerate(on)])
    cond = [F.col(cc) == F.col(f"__fk{i}") for i, (cc, _) in enumerate(on)]
    kept = child.join(p, cond, "left_semi")
    names = ",".join(cc for cc, _ in on)
    rejected = child.join(p, cond, "left_anti").withColumn(REASON, F.lit(f"missing_parent:{names}"))
    return kept, rejected


def fk_tag(child: DataFrame, parent: DataFrame, on: Sequence[tuple[str, str]],
           out: str) -> DataFrame:
    """``child`` with ``out``: the reason string for rows without a parent, else NULL."""
    p = (parent.select(*[F.col(pc).alias(f"__fk{i}") for i, (_, pc) in enumerate(on)]).distinct()
         .withColumn("__found", F.lit(1)))
    cond = [F.col(cc) == F.col(f"__fk{i}") for i, (cc, _) in enumerate(on)]
    names = ",".join(cc for cc, _ in on)
    return (child.join(p, cond, "left")
            .withColumn(out, F.when(F.col("__found").isNull(), F.lit(f"missing_parent:{names}")))
            .drop("__found", *[f"__fk{i}" for i in range(len(on))]))


def domain_rules(schema_fields, max_length: Mapping[str, int] | None = None,
                 decimal_bound: bool = True) -> dict[str, Column]:
    """Violation predicates from a declared schema: NOT NULL, text length, DECIMAL range."""
    from pyspark.sql import types as T
    rules: dict[str, Column] = {}
    for f in schema_fields:
        c = F.col(f.name)
        if not f.nullable:
            rules[f"{f.name}:null"] = c.isNull()
        if isinstance(f.dataType, T.DecimalType) and decimal_bound:
            bound = 10 ** (f.dataType.precision - f.dataType.scale)
            rules[f"{f.name}:out_of_range"] = F.abs(c) >= F.lit(bound)
    for name, n in (max_length or {}).items():
        rules[f"{name}:too_long"] = F.char_length(F.col(name)) > F.lit(n)
    return rules


def domain_gate(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split rows on violation predicates; rejects carry every violated rule name.

    A predicate that evaluates to NULL does not count as a violation (NOT NULL
    rules catch missing values).
    """
    tagged = df.withColumn(REASON, domain_reasons(rules))
    valid = tagged.where(F.col(REASON) == "").drop(REASON)
    rejected = tagged.where(F.col(REASON) != "")
    return valid, rejected


def domain_reasons(rules: Mapping[str, Column]) -> Column:
    """Names of all violated rules, comma separated; empty when there is none."""
    return F.concat_ws(",", *[F.when(cond, F.lit(name)) for name, cond in rules.items()])
