"""URL filter rules by a sort-merge range join (DataFrame functions only).

A host is written with its labels reversed and each ended by a dot
(``a.example.org`` -> ``org.example.a.``), so a host and all its subdomains are
the strings with one common prefix: an interval of the sorted keys. The same
holds for the paths below a rule's path. Prefix intervals are nested or disjoint,
so when keys and interval starts are swept in sorted order, the intervals that
hold a key lie on the stack of the last start before it. :func:`stab` is that
sweep; it runs once over hosts (which rule hosts hold the url's host) and once
over ``rule host + path`` (which of that host's rules hold the url's path).

Defined cases: a null url, or one without ``://``, has an empty host and path
and fits no rule; a rule repeated with both verdicts blocks; of fitting rules
with equally many characters a block wins, then the smaller rule text; an empty
rule table gives every url the default verdict; repeated rows are judged each.
Input columns are carried through by position, so they may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercadia.llm.common import aside, staged, width

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = "/"     # a host holds no slash, so it ends the host part of a key


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def with_stacks(prefixes: DataFrame) -> DataFrame:
    """(prefix, value) rows, one per prefix, with the array of the intervals that
    hold the prefix's own interval, outermost first, itself last."""
    inner = prefixes.select(F.col("prefix").alias("inner"),
                            F.explode(F.sequence(F.lit(1), F.length("prefix"))).alias("n"))
    held = inner.select("inner", F.expr("substring(inner, 1, n)").alias("prefix"))
    return (held.join(prefixes, "prefix").groupBy("inner")
            .agg(F.array_sort(F.collect_list(F.struct("prefix", "value"))).alias("stack"))
            .withColumnRenamed("inner", "prefix"))


def stab(points: DataFrame, prefixes: DataFrame, name: str) -> DataFrame:
    """``points`` (key string, row long, anything else in ``rest``) with ``stack``:
    the (prefix, value) structs whose prefix the key starts with, shortest first
    (null or empty when there is none).

    Keys and interval starts are range-partitioned together; equal keys are told
    apart by ``row``, so a hot key spreads over partitions. The stack that is open
    at a partition's start is the last one of the partitions before it: one row
    per partition, which bounds the broadcast.
    """
    spark = points.sparkSession
    stacks = with_stacks(prefixes)
    kind = stacks.schema["stack"].dataType
    events = points.select("key", F.lit(1).alias("kind"), "row", "rest",
                           F.lit(None).cast(kind).alias("open")).unionByName(
        stacks.select(F.col("prefix").alias("key"), F.lit(0).alias("kind"),
                      F.lit(None).cast("long").alias("row"),
                      F.lit(None).cast(points.schema["rest"].dataType).alias("rest"),
                      F.col("stack").alias("open")))
    swept = staged(events.repartitionByRange(width(spark), "key", "kind", F.xxhash64("row"))
                   .withColumn("segment", F.spark_partition_id()), name)
    ends = swept.groupBy("segment").agg(
        F.max(F.when(F.col("kind") == 0, F.struct("key", "open"))).alias("last"))
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("segment", F.last("last", ignorenulls=True).over(before)["open"].alias("carried"))
    sweep = (Window.partitionBy("segment").orderBy("key", "kind")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (swept.withColumn("seen", F.last("open", ignorenulls=True).over(sweep))
            .where("kind = 1")
            .join(F.broadcast(carried), "segment", "left")
            .withColumn("stack", F.coalesce("seen", "carried"))
            .select("key", "row", "rest",
                    F.expr("filter(stack, s -> startswith(key, s.prefix))").alias("stack")))


def judge(df: DataFrame, url: str, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``df`` with columns host, path, rule and verdict; input columns of these names get
    trailing underscores.

    ``rules`` has host, path and verdict ('allow' or 'block'). A rule fits its host
    and all subdomains when the url's path starts with the rule's path; the fitting
    rule with the most characters wins; without one, rule is null and the verdict
    is ``default``.
    """
    df = aside(df, ["host", "path", "rule", "verdict"], keep=[url])
    held = [f"c{i}" for i in range(len(df.columns))]
    at = held[df.columns.index(url)]
    host, path = parts(F.col(at))
    rows = df.toDF(*held).withColumn("host", host).withColumn("path", path)
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "url-rows")

    clean = rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"),
                         F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> ''")
    clean = (clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))   # 'block' > 'allow'
             .withColumn("node", host_key(F.col("host"))))
    nodes = clean.select(F.col("node").alias("prefix"), F.lit(0).alias("value")).distinct()
    paths = clean.select(
        F.concat("node", F.lit(SPLIT), "path").alias("prefix"),
        F.struct("verdict", F.concat("host", "path").alias("rule")).alias("value"))

    hosts = rows.where("host <> ''").select(host_key(F.col("host")).alias("key"), "row",
                                            F.col("path").alias("rest"))
    active = stab(hosts, nodes, "url-hosts").select("row", "rest", F.explode("stack").alias("node"))
    keys = active.select(F.concat("node.prefix", F.lit(SPLIT), "rest").alias("key"), "row",
                         F.lit(0).alias("rest"))
    fits = stab(keys, paths, "url-paths").where(F.size("stack") > 0)
    # the last entry is the longest of this host; rule texts break ties between hosts
    best = fits.withColumn("top", F.element_at("stack", -1)).groupBy("row").agg(
        F.min(F.struct(-F.length("top.prefix"), F.when(F.col("top.value.verdict") == "block", 0).otherwise(1),
                       F.col("top.value.rule").alias("rule"),
                       F.col("top.value.verdict").alias("verdict"))).alias("best"))
    out = rows.join(best, "row", "left")
    return out.select(*[F.col(h).alias(c) for h, c in zip(held, df.columns)], "host", "path",
                      F.col("best.rule").alias("rule"),
                      F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark, rows: list[tuple[str, str, str]]) -> DataFrame:
    """A rule table from a short list of (host, path, verdict)."""
    items = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict"))
             for h, p, v in rows]
    return spark.range(1).select(F.inline(F.array(*items)))
