"""The pipeline on a small fixture: each stage's decisions against brute force."""

from __future__ import annotations

import re

import corpus_pipeline
from mercadia.llm.common import scratch

LONG = "the river ran past the old mill and on to the sea where ships lay at rest {k} until dawn came {k} again"
LEAK = "which of these four towers stands nearest to the bridge that was built before the great fire of that year"


def test_stages_on_planted_rows(spark):
    near = " ".join(f"word{k}" for k in range(80))
    rows = [(1, "hello there good people of the town", "en"), (2, "hello  there good\npeople of the town ", "en"),
            (3, near, "en"), (4, near + " tail", "en"), (5, "intro. " + LEAK + " outro", "en"),
            (6, None, None), (7, "12345 !!", "en"), (8, "bonjour les gens de la ville", "fr"), (9, "", "fr")]
    rows += [(10 + k, LONG.replace("{k}", f"x{k}y{k}"), "en") for k in range(3)]
    sf = scratch(spark, "sf")
    (spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in rows],
                           "doc_id long, text string, lang string, source string, n_chars long")
     .coalesce(2).write.parquet(f"{sf}/documents.parquet"))
    spark.createDataFrame([(1, LEAK)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf).write.parquet(path)
        out = spark.read.parquet(path)
        assert out.columns == docs.columns
        docs = out
        left.append(sorted(r.doc_id for r in docs.collect()))
    letters = sorted(d for d, t, _ in rows if t and re.search(r"[^\W\d_]", t))
    assert left[0] == letters
    assert left[1] == [d for d in letters if d != 1]        # the longer original stays
    assert left[2] == [d for d in left[1] if d != 4]
    assert left[3] == [d for d in left[2] if d != 5]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted(r.doc_id for r in last) == left[3] and all(r.n_tokens == len(r.ids) for r in last)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == left[3]
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "lang", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def test_empty_documents(spark):
    sf = scratch(spark, "sf")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{sf}/documents.parquet")
    spark.createDataFrame([(1, LEAK)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_odd_documents(spark):
    """Nulls in every column, repeats, a very long text, and columns named as the operators' own."""
    sf = scratch(spark, "sf")
    long = " ".join(f"word{k} und so weiter" for k in range(60_000))
    rows = [(None, "a text without id, seen once only", None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0),
            (3, "the same row twice, as it is", "en", "s", 1), (3, "the same row twice, as it is", "en", "s", 1),
            (4, long, "de", "s", 1), (5, "½ ² ①", "en", "s", 1), (6, "une autre langue de la ville", None, "s", 1)]
    rows += [(10 + k, LONG.replace("{k}", f"p{k}q{k}"), "en", "s", 1) for k in range(3)]
    rows += [(20 + k, f"und der die das {k} ist nicht mit von zu {k} haus und hof", "de", "s", 1) for k in range(3)]
    names = ["row", "kept", "score", "ids", "lang_pred", "doc", "token", "node", "key"]
    (spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows],
                           "doc_id long, text string, lang string, source string, n_chars long, "
                           + ", ".join(f"{n} string" for n in names))
     .repartition(3).write.parquet(f"{sf}/documents.parquet"))
    spark.createDataFrame([(None, LEAK), (1, None), (2, "")], "item_id long, text string").write.parquet(
        f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
    out = corpus_pipeline.run(spark, sf).collect()
    # the short texts of one pattern differ in most of their shingles
    assert sorted((r.doc_id or 0) for r in out) == [0, 3, 4, 6, 10, 11, 12, 20, 21, 22]
    assert {r.doc_id: r.lang for r in out}[4] == "de" and all(r.lang in ("de", "en") for r in out)


def test_stages_leave_no_scratch_behind(spark):
    import os
    from mercadia.session import checkpoint_dir
    sf = scratch(spark, "sf")
    spark.createDataFrame([(k, f"text number {k} of some words", "en", "s", 1) for k in range(20)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{sf}/documents.parquet")
    spark.createDataFrame([(1, LEAK)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before} == {"pipeline-decontaminate"}
