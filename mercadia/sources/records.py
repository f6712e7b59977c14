"""Records of delimited text, put together in parallel and split into fields.

The dialect is that of the source's load: comma separated, optionally enclosed in double
quotes, rows ended by a line feed (one carriage return before it is dropped), one
header line a file. Within an enclosed field a quote ends the field only before a
comma or the end of the row; a doubled quote is one quote, any other quote is itself.
A backslash escapes the next character: ``\\n \\t \\r \\b \\0 \\Z`` are the
control characters, ``\\N`` alone in a field and the bare word NULL are NULL, and any
other character is itself (``\\"``, ``\\\\``, ``\\,``, an escaped line break). With
``escapes=False`` a backslash is an ordinary character and there is no NULL.

Rows whose enclosed text holds line breaks need no reader that takes a file as one
piece. Lines are read in any number of splits. What a line does to the state "inside
an enclosed field" is a function of the two possible states before it, found from the
line alone by two patterns: it keeps the state, swaps it, or sets it. Running
compositions of these functions - swaps since the last line that sets the state - give
the state at every line of a split, one function a split; the same composition over
splits, one row each, carries the state across their borders. A row begins
where a line begins outside; the lines of a split before its first row belong to the
row that the splits before left open.

An escaped line break outside quotes does not continue a row; the row then has too few
fields. A quote that is never closed ends at the next line that sets the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercadia.session import materialized

POS = "__pos"
RECORD, VALUES = "__record", "__values"

# --- Fixed values: what a backslash makes of a character --------------------------------
ESCAPED = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}
# --- end of fixed values

#: Separates nothing: text files hold no noncharacter.
NO_SEPARATOR = "\uffff"


def _enclosed(escapes: bool) -> str:
    """Text of an enclosed field up to its closing quote. Possessive, so it never backtracks."""
    if escapes:
        return r'[^"\\]*+(?:(?:""|"(?!,|\z)|\\.)[^"\\]*+)*+'
    return r'[^"]*+(?:(?:""|"(?!,|\z))[^"]*+)*+'


def _field(escapes: bool) -> str:
    plain = r'(?!")[^,\\]*+(?:\\.[^,\\]*+)*+' if escapes else r'(?!")[^,]*+'
    return rf'(?:"{_enclosed(escapes)}"|{plain})(?=,|\z)'


def left_open(line: Column, inside: bool, escapes: bool = True) -> Column:
    """Whether an enclosed field is open behind ``line``, when one was (not) open before it."""
    opens = rf'(?:{_field(escapes)},)*+"{_enclosed(escapes)}\\?\z'
    if inside:
        pattern = rf'(?s)\A{_enclosed(escapes)}(?:\\?\z|",{opens})'
    else:
        pattern = rf"(?s)\A{opens}"
    return F.when(F.contains(line, F.lit('"')), line.rlike(pattern)).otherwise(F.lit(inside))


def _position() -> Column:
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                    F.monotonically_increasing_id().alias("row"))


def lines(spark: SparkSession, path: str | list[str], escapes: bool = True) -> DataFrame:
    """Rows with their values and positions, where a line is a row; blank lines are left out."""
    df = (spark.read.schema(f"{RECORD} string").option("header", True).option("sep", NO_SEPARATOR)
          .option("quote", "").option("escape", "").option("lineSep", "\n").option("encoding", "UTF-8")
          .option("mode", "PERMISSIVE").csv(path))
    line = F.regexp_replace(RECORD, r"\r\z", "")
    # the position keeps filters above this projection, so no row is split again to be filtered
    return df.where(F.trim(line) != "").select(line.alias(RECORD), values(line, escapes).alias(VALUES),
                                               _position().alias(POS))


def _after(open0: str, open1: str, order: Window) -> tuple[Column, Column]:
    """States behind the rows up to and with each row of ``order``, when the state before
    them all is outside, inside."""
    sets, swaps = F.col(open0) == F.col(open1), F.col(open0) & ~F.col(open1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    count = F.sum(swaps.cast("long")).over(upto)
    # swaps before and in the last row that sets the state, and the state it sets
    last = F.last(F.when(sets, F.struct(F.col(open0).alias("state"), F.col("__swaps").alias("swaps"))),
                  ignorenulls=True).over(upto)
    return count, last


def _states(df: DataFrame, open0: str, open1: str, order: Window, names: tuple[str, str]) -> DataFrame:
    count, last = _after(open0, open1, order)
    df = df.withColumn("__swaps", count).withColumn("__last", last)
    odd = (F.col("__swaps") - F.coalesce(F.col("__last.swaps"), F.lit(0))) % 2 == 1
    for name, before in zip(names, (False, True)):
        df = df.withColumn(name, F.coalesce(F.col("__last.state"), F.lit(before)) != odd)
    return df.drop("__swaps", "__last")


def multi_line_records(spark: SparkSession, path: str | list[str], escapes: bool = True) -> DataFrame:
    """Rows whose enclosed fields may hold line breaks, with their values and positions.

    The lines are written to the shared folder once, with their positions: splits are
    cut by the cluster's size at the moment of reading, so two readings might differ.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    line = F.regexp_replace("value", r"\r\z", "")
    df = raw.select(line.alias("line"), _position().alias(POS)).select(
        f"{POS}.*", "line", left_open(F.col("line"), False, escapes).alias("open0"),
        left_open(F.col("line"), True, escapes).alias("open1"))
    df = materialized(df, "csv-lines")
    in_split = Window.partitionBy("file", "split").orderBy("row")
    df = _states(df, "open0", "open1", in_split, ("after0", "after1"))
    for state, at_first in (("0", False), ("1", True)):
        df = df.withColumn(f"in{state}", F.lag(f"after{state}", 1, at_first).over(in_split))
    splits = df.groupBy("file", "split").agg(
        F.max_by("after0", "row").alias("open0"), F.max_by("after1", "row").alias("open1"), F.min("row").alias("first"),
        F.max(F.when(~F.col("in0"), F.col("row"))).alias("begun0"),
        F.max(F.when(~F.col("in1"), F.col("row"))).alias("begun1"))
    of_file = Window.partitionBy("file").orderBy("split")
    splits = _states(splits, "open0", "open1", of_file, ("after0", "after1"))
    before = F.lag("after0", 1, False).over(of_file)        # a file begins outside
    splits = splits.withColumn("inside", before).withColumn(
        "begun", F.when(F.col("inside"), F.col("begun1")).otherwise(F.col("begun0")))
    left = F.last(F.when(F.col("begun").isNotNull(), F.struct("split", F.col("begun").alias("row"))), ignorenulls=True)
    splits = splits.select("file", "split", "inside", "first", left.over(
        of_file.rowsBetween(Window.unboundedPreceding, -1)).alias("left"))
    begins = ~F.when(F.col("inside"), F.col("in1")).otherwise(F.col("in0"))
    own = F.last(F.when(begins, F.struct("split", "row")), ignorenulls=True).over(
        in_split.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.join(splits, ["file", "split"]).withColumn("of", F.coalesce(own, F.col("left")))
    header = (F.col("of.split") == 0) & (F.col("split") == 0) & (F.col("of.row") == F.col("first"))
    rows = rows.groupBy("file", F.col("of.split").alias("split0"), F.col("of.row").alias("row0")).agg(
        F.array_sort(F.collect_list(F.struct("split", "row", "line"))).alias("lines"),
        F.bool_or(header).alias("header"))
    return (rows.where(~F.col("header"))
            .select(F.array_join("lines.line", "\n").alias(RECORD),
                    F.struct("file", F.col("split0").alias("split"), F.col("row0").alias("row")).alias(POS))
            .where(F.trim(RECORD) != "").withColumn(VALUES, values(F.col(RECORD), escapes)))


def fields(record: Column, escapes: bool = True) -> Column:
    """Raw fields of a row, still enclosed and escaped; NULL where it cannot be split."""
    field = _field(escapes)
    special = F.contains(record, F.lit('"')) | (F.contains(record, F.lit("\\")) if escapes else F.lit(False))
    whole = record.rlike(rf"(?s)\A{field}(?:,{field})*+\z")
    found = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f"(?s),({field})"), F.lit(1))
    return F.when(~special, F.split(record, ",", -1)).when(whole, found)


def _unescaped(text: Column, enclosed: Column) -> Column:
    """``text`` with escapes carried out from left to right, and doubled quotes of enclosed text halved."""
    def plain(part: Column) -> Column:
        return F.when(enclosed, F.replace(part, F.lit('""'), F.lit('"'))).otherwise(part)

    parts = F.split(text, r"\\", -1)        # on single backslashes: an escaped one leaves an empty part
    control = F.create_map(*[F.lit(x) for pair in ESCAPED.items() for x in pair])
    start = F.struct(plain(F.get(parts, F.lit(0))).alias("out"), F.lit(False).alias("literal"))

    def step(so_far: Column, part: Column) -> Column:
        first = F.substring(part, 1, 1)
        rest = F.right(part, F.length(part) - 1)
        made = F.concat(F.coalesce(F.try_element_at(control, first), first), plain(rest))
        out = F.when(so_far["literal"], plain(part)).when(part == "", F.lit("\\")).otherwise(made)
        return F.struct(F.concat(so_far["out"], out).alias("out"), ((part == "") & ~so_far["literal"]).alias("literal"))

    return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), start, step, lambda s: s["out"])


def decoded(raw: Column, escapes: bool = True) -> Column:
    """The value of a raw field: quotes removed, escapes carried out, NULL where the dialect has it."""
    enclosed = (F.length(raw) >= 2) & F.startswith(raw, F.lit('"'))
    body = F.when(enclosed, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    simple = F.when(enclosed, F.replace(body, F.lit('""'), F.lit('"'))).otherwise(body)
    if not escapes:
        return simple
    null = (body == "\\N") | (~enclosed & (raw == "NULL"))
    return F.when(null, F.lit(None)).when(F.contains(body, F.lit("\\")), _unescaped(body, enclosed)).otherwise(simple)


def values(record: Column, escapes: bool = True) -> Column:
    """The values of a row's fields; NULL where it cannot be split."""
    return F.transform(fields(record, escapes), lambda raw: decoded(raw, escapes))
