"""A corpus pipeline over ``documents``: five operators, each on what the one before kept.

language ID -> exact dedup -> n-gram Jaccard join -> benchmark decontamination ->
byte BPE. The first four return the columns of ``documents``; the last gives the
token ids of the documents that are left with their predicted language, and digests of ids and
decoded text.

Defined cases: documents with a null or empty text, or without a letter, go in the first stage; of
rows that repeat or nearly repeat one stays, of equal ids any one; a null id is an id like others; null in
``lang``, ``source`` and ``n_chars`` changes nothing but what languages are learned from; very long
texts are taken whole; columns beyond those of ``documents`` are carried through the first four
stages, whatever their names; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.llm import byte_bpe, decontaminate, exact_dedup, language_id, ngram_join
from mercadia.llm.common import remainder, staged, table, temporary, widen
from mercadia.llm.queries import BYTE_BPE
from mercadia.sources.versions import remove


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets every document's ``lang`` to the predicted language, and rejects documents without
    one: null texts and texts without a letter. With no language to learn, ``lang`` stays."""
    held = [f"__p{k}" for k in range(len(docs.columns))]
    at = dict(zip(docs.columns, held))
    named = docs.toDF(*held)
    model = language_id.train(named, at["doc_id"], at["text"], at["lang"],
                              remainder(F.col(at["doc_id"]), 5) != 0)
    if not model.families:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.predict(named, at["text"], model, "__p_lang", "__p_score")
    return found.where(F.col("__p_lang") != language_id.UND).select(
        *[F.col("__p_lang" if c == "lang" else h).alias(c) for c, h in at.items()])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs, "doc_id", "text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.thin(docs, "doc_id", "text")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return decontaminate.clean(docs, "doc_id", "text", items, "item_id", "text")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = byte_bpe.round_trip(docs.select("doc_id", "lang", "text"), "text", BYTE_BPE)
    return out.select("doc_id", "lang", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("byte_bpe", encode),
]

#: Language prediction and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    widen(spark, f"{sf_dir}/documents.parquet")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with temporary(spark) as made:      # what a stage has written on its way goes when its result is stored
            docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
            after = made.pop()
        if before:
            remove(spark, before)
        before = after
    return STAGES[-1][1](spark, docs, sf_dir)
