"""CSV ingest: text in the declared raw column order -> typed, gated tables.

Format: comma separated, double-quote enclosure, doubled quotes or a backslash before
quotes inside, ``\\N`` for NULL, LF rows, one header line, UTF-8 (a leading byte-order mark is
dropped); see ``records`` for the dialect. Files are split, those of
the tables in ``schemas.MULTI_LINE`` too, whose quoted fields span lines. A line with too many or
too few fields is rejected as ``row:malformed``.

Empty fields stay empty strings except in the columns listed in
``schemas.BLANK_IS_NULL`` (numbers and dates), where they become NULL.
Numbers and dates are parsed with ``try_cast`` into wide types, keeping the
source text, so the domain gate can tell a blank required value (``:null``)
from text that does not parse (``:invalid``) and from a number outside the
declared type (``:out_of_range``); rejected rows carry the source text in
``__raw``. Accepted rows are cast to the declared schema; rejected rows too, where
their values fit, and hold NULL where they do not.

Gates run in the order of an insert with foreign keys on: domain, foreign keys,
primary key; a row that breaks an earlier gate cannot shadow a later valid one.
The first row of a duplicated key wins: rows are ordered by file name, split offset
and position in the split (``__pos``), which is deterministic on recomputation.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercadia.functions.expressions import collate_strings, region_lookup
from mercadia.model import Tables
from mercadia.operators import quality
from mercadia.operators.gates import REASON, domain_reasons, fk_tag, pk_gate
from mercadia.sources import buckets, records, schemas
from mercadia.sources.enrich import enrich_category
from mercadia.sources.records import POS

CORRUPT = "__corrupt"  # the whole line, where it has too many or too few fields


def read_raw(spark: SparkSession, path: str | list[str], table: str, escapes: bool = True) -> DataFrame:
    """All-text read in the raw column order, with a deterministic file position.

    ``escapes=False``: a backslash is an ordinary character, and no field is NULL.
    """
    cols = schemas.RAW_COLUMNS[table]
    read = records.multi_line_records if table in schemas.MULTI_LINE else records.lines
    rows = read(spark, path, escapes)
    right = F.coalesce(F.size(records.VALUES) == len(cols), F.lit(False))
    return rows.select(*[F.get(records.VALUES, F.lit(k)).alias(c) for k, c in enumerate(cols)],
                       F.when(~right, F.col(records.RECORD)).alias(CORRUPT), POS)


RAW = "__raw"  # struct with the source text of every converted column


def _wide(dt: T.DataType) -> T.DataType:
    """Parse numbers into a wide type first, so range rules can see them."""
    if isinstance(dt, T.DecimalType):
        return T.DecimalType(38, dt.scale)
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType)):
        return T.LongType()
    return dt


def _converted(raw: DataFrame, table: str) -> list[T.StructField]:
    return [f for f in schemas.SCHEMAS[table].fields
            if f.name in raw.columns and not isinstance(f.dataType, T.StringType)]


def parse(raw: DataFrame, table: str) -> DataFrame:
    """Raw text -> values in wide types, plus the source text of the converted
    columns in ``__raw`` when there are any (blank -> NULL where declared)."""
    blank_null = set(schemas.BLANK_IS_NULL.get(table, []))
    out = []
    for f in schemas.SCHEMAS[table].fields:
        if f.name not in raw.columns:  # filled later (the English category)
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = F.col(f.name)
        if f.name in blank_null:
            c = F.nullif(F.trim(c), F.lit(""))
        elif isinstance(f.dataType, T.StringType):
            # a malformed row has no further reason for the fields it lacks
            c = F.when(F.col(CORRUPT).isNotNull(), F.coalesce(c, F.lit(""))).otherwise(c)
        if not isinstance(f.dataType, T.StringType):
            c = c.try_cast(_wide(f.dataType))
        out.append(c.alias(f.name))
    raws = [F.col(f.name).alias(f.name) for f in _converted(raw, table)]
    extra = [F.struct(*raws).alias(RAW)] if raws else []  # all-text tables keep no copy
    return raw.select(*out, *extra, CORRUPT, POS)


def declared(df: DataFrame, table: str) -> DataFrame:
    """Cast parsed columns to the declared types; values outside them become NULL."""
    cols = []
    for f in schemas.SCHEMAS[table].fields:
        if f.name not in df.columns:
            continue
        # text keeps its type (and any collation given to it)
        cols.append(F.col(f.name) if isinstance(f.dataType, T.StringType)
                    else F.col(f.name).try_cast(f.dataType).alias(f.name))
    keep = [c for c in df.columns if c not in schemas.SCHEMAS[table].fieldNames()]
    return df.select(*cols, *keep)


def parse_rules(table: str, raw_columns: list[str]) -> dict[str, Column]:
    """Domain rules of a parsed table: blank where a value is required,
    unparseable text, values outside the declared type, text too long."""
    rules: dict[str, Column] = {"row:malformed": F.col(CORRUPT).isNotNull()}
    converted = {f.name for f in schemas.SCHEMAS[table].fields
                 if f.name in raw_columns and not isinstance(f.dataType, T.StringType)}
    for f in schemas.SCHEMAS[table].fields:
        c = F.col(f.name)
        if f.name in converted:
            r = F.col(f"{RAW}.{f.name}")
            blank = r.isNull() | (F.trim(r) == "")
            rules[f"{f.name}:invalid"] = ~blank & c.isNull()
            if not f.nullable:
                rules[f"{f.name}:null"] = blank
            if isinstance(f.dataType, T.DecimalType):
                bound = 10 ** (f.dataType.precision - f.dataType.scale)
                rules[f"{f.name}:out_of_range"] = F.abs(c) >= F.lit(bound)
            elif isinstance(f.dataType, T.IntegerType):
                rules[f"{f.name}:out_of_range"] = (c < -(2 ** 31)) | (c > 2 ** 31 - 1)
        elif not f.nullable:
            rules[f"{f.name}:null"] = c.isNull()
    for name, n in schemas.MAX_LENGTH.get(table, {}).items():
        rules[f"{name}:too_long"] = F.char_length(F.col(name)) > F.lit(n)
    return rules


def typed(raw: DataFrame, table: str) -> DataFrame:
    """Convert raw text to the declared schema without gating."""
    return declared(parse(raw, table), table).drop(RAW, CORRUPT)


def read_table(spark: SparkSession, path, table: str) -> DataFrame:
    return typed(read_raw(spark, path, table), table)


def read_translation(spark: SparkSession, path) -> DataFrame:
    raw = read_raw(spark, path, "category_translation")
    return raw.select(*[F.nullif(F.col(f.name), F.lit("")).cast(f.dataType).alias(f.name)
                        for f in schemas.CATEGORY_TRANSLATION.fields])


@dataclass(frozen=True)
class LoadResult:
    tables: Tables
    rejects: dict[str, DataFrame]  # table -> rejected rows with ``reject_reason``
    layouts: dict[str, dict] = field(default_factory=dict)      # written table -> its buckets
    observed: dict[str, dict] = field(default_factory=dict)     # written table -> counts taken while it was written


#: Written tables that are joined on the order: bucketed by it where it is spread evenly.
BUCKETED = {"orders": "order_id", "order_items": "order_id", "order_reviews": "order_id"}
TAGGED = "_tagged"


def load_marketplace(spark: SparkSession, paths: Mapping[str, str | list[str]],
                     translation_path: str | None = None,
                     region: DataFrame | None = None,
                     collation: str | None = None,
                     stage_dir: str | None = None) -> LoadResult:
    """Read, gate (domain -> foreign keys against the gated parents -> primary
    key) and enrich the seven tables, parents first.

    ``collation`` (e.g. ``expressions.SOURCE_COLLATION``) makes every text
    column, and the lookups, compare case- and accent-insensitively; keys that
    differ only in case then count as duplicates, as in the source database.

    Every row gets one reason column (domain, then one left join per parent), so
    accepted rows and rejects are two readings of one tagged table. With
    ``stage_dir`` (a shared folder) the tagged table is written to
    ``stage_dir/_tagged`` first - each CSV is parsed once - and each accepted
    table to ``stage_dir``, replacing what was there, bucketed where ``BUCKETED`` says so and
    the buckets are even; children are gated against
    what was written. The data-quality counts of an accepted table are observed on its
    way to the files (see ``quality.observed``).
    """
    layouts: dict[str, dict] = {}
    counts: dict[str, dict] = {}
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def stage(df: DataFrame, path: str) -> DataFrame:
        if not stage_dir:
            return df
        path = f"{stage_dir.rstrip('/')}/{path}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def stage_accepted(df: DataFrame, tagged: DataFrame, table: str) -> DataFrame:
        path = f"{stage_dir.rstrip('/')}/{table}"
        column = BUCKETED.get(table)
        spread = column and not collation and buckets.even(tagged, column, width)
        seen = Observation()
        # observed behind the last shuffle, where a lost executor makes no row count twice
        df = (buckets.dealt(df, column, width) if spread else df).observe(seen, *quality.observed(table))
        if spread:
            layouts[table] = buckets.write(df, path, column, width)
        else:
            df.write.mode("overwrite").parquet(path)
        counts[table] = seen.get
        return spark.read.schema(df.schema).parquet(path)

    def coll(df: DataFrame) -> DataFrame:
        return collate_strings(df, collation) if collation else df

    gated: dict[str, DataFrame] = {}
    rejects: dict[str, DataFrame] = {}
    for table in schemas.LOAD_ORDER:
        raw = read_raw(spark, paths[table], table)
        parsed = coll(parse(raw, table))
        tagged = declared(parsed.withColumn(REASON, domain_reasons(parse_rules(table, raw.columns))),
                          table)
        reasons = [F.nullif(F.col(REASON), F.lit(""))]
        for k, (child_col, parent, parent_col) in enumerate(schemas.FOREIGN_KEYS.get(table, [])):
            tagged = fk_tag(tagged, gated[parent], [(child_col, parent_col)], f"__fk_reason{k}")
            reasons.append(F.col(f"__fk_reason{k}"))
        tagged = tagged.withColumn(REASON, F.coalesce(*reasons)).drop(
            *[c for c in tagged.columns if c.startswith("__fk_reason")])
        tagged = stage(tagged, f"{TAGGED}/{table}")
        accepted, dup = pk_gate(tagged.where(F.col(REASON).isNull()).drop(REASON),
                                schemas.PRIMARY_KEYS[table], [POS], row_id=POS)
        rejects[table] = (tagged.where(F.col(REASON).isNotNull())
                          .unionByName(dup.select(*tagged.columns)))
        if table == "products" and translation_path:
            accepted = enrich_category(accepted,
                                       coll(read_translation(spark, translation_path)))
        accepted = accepted.drop(RAW, CORRUPT)
        gated[table] = stage_accepted(accepted.drop(POS), tagged, table) if stage_dir else accepted
    out = {k: v.drop(POS) if POS in v.columns else v for k, v in gated.items()}
    return LoadResult(
        tables=Tables(customers=out["customers"], sellers=out["sellers"],
                      products=out["products"], orders=out["orders"],
                      items=out["order_items"], payments=out["order_payments"],
                      reviews=out["order_reviews"],
                      region_lookup=coll(region if region is not None else region_lookup(spark))),
        rejects=rejects, layouts=layouts, observed=counts)
