"""Personal data, spelling variants and hard negatives against brute force, and on odd input."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mercadia.llm import hard_negatives, pii, spelling
from mercadia.llm.common import aside
from mercadia.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"

# -- 11 personal data ----------------------------------------------------------------

BASE = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
        "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(digits[::-1])) % 10 == 0


def holds(kind, found):
    digits = re.sub("[^0-9]", "", found)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in found.split(".")),
            "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def brute_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in p.finditer(text or "") if holds(k, m.group())]


PIECES = ["0", "1", "9", "255", "256", "1.2.3.4", "4111 1111 1111 1111", "4111-1111", "+1 (171) 555-2028", "+", "-", " ",
          ".", "..", "@", "a", "b.c", "é", "日", "\U0001F600", "://", "(", ")", "x@y.z", "_%", "\n"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    assert [s for s in pii.spans(text, pii.automaton().iter) if s[0] in pii.BASE] == brute_spans(text)


@pytest.mark.parametrize("text, want", [
    ("IBAN: DE89 3704 0044 0532 0130 00 and on", ("iban", "DE89 3704 0044 0532 0130 00")),
    ("iban DE89370400440532013001", None),
    ("My SSN is 123-45-6789.", ("ssn", "123-45-6789")), ("SSN 123-00-6789", None), ("123-45-6789", None),
    ("ACCOUNT NUMBER: 00123456789", ("account", "00123456789")), ("account no. 123", None),
    ("see https://bob:secret@example.org/x", ("login", "https://bob:secret@example.org")),
    ("see https://example.org/x", None), ("at İ the account no 12345678", ("account", "12345678"))])
def test_spans_beside_the_base(text, want):
    added = [(k, text[a:b]) for k, a, b in pii.spans(text, pii.automaton().iter) if k in pii.ADDED]
    assert added == ([want] if want else [])


@pytest.mark.parametrize("piece", ["1", "1 ", "1.", "@", "+1", "a@b.", "://", "+1-", "iban "])
def test_long_texts_take_linear_steps(piece):
    text = piece * 200_000
    assert len(pii.spans(text, pii.automaton().iter)) <= 200_000


def test_pii_query_on_documents_and_odd_rows(spark):
    import hashlib
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op11_pii"](spark, SF).collect()
    assert len(got) == len(docs) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 20
    for r in got:
        want = brute_spans(docs[r.doc_id])
        assert [r[f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in want) for k in BASE]
        joined = ",".join("%s:%d:%d" % s for s in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)
    odd = spark.createDataFrame([(1, None, "a", 1), (2, "", "b", 2), (3, "x@y.z " * 50_000, "c", 3),
                                 (3, "x@y.z", "c", 4), (3, "x@y.z", "c", 4)],
                                "doc_id long, text string, spans string, Spans_ int")
    found = pii.find(odd, "text")
    assert found.columns == ["doc_id", "text", "spans__", "Spans_", "spans"]
    assert sorted(len(r[4]) for r in found.collect()) == [0, 0, 1, 1, 50_000]
    assert pii.find(odd.limit(0), "text").count() == 0


def test_columns_of_an_output_name_step_aside(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, B int, b_ int")
    assert aside(df, ["b"]).columns == ["a", "B__", "b_"] and aside(df, ["c"], keep=["B"]).columns == df.columns
    with pytest.raises(ValueError):
        aside(df, ["b"], keep=["B"])


# -- 12 spelling variants --------------------------------------------------------------

def one_edit(a, b):
    """Whether one inserted, deleted or replaced code point makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_variants(counts):
    near = {w: [v for v in counts if one_edit(v, w)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(((-counts[v], v) for v in found), default=None)
        form[w] = best[1] if best and -best[0] >= 5 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def brute_counts(rows, least_length=6, least_n=5, drop_every=0):
    out = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if drop_every and h % drop_every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= least_length and n >= least_n}


@pytest.mark.parametrize("most", [2, 7, 128])
def test_variants_of_random_words(spark, most):
    """Few letters, so words crowd in tiles; lengths from one letter on; ties in counts."""
    rng = random.Random(most)
    words = {"".join(rng.choice("abé") for _ in range(rng.choice((1, 2, 5, 6, 7, 8)))) for _ in range(500)}
    words |= {"z" * k for k in (30, 31, 32)} | {"y" * 400, "y" * 399 + "x", "y" * 399}
    counts = {w: rng.choice((1, 2, 5, 10, 25, 60, 125, 700)) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = sorted((tuple(r) for r in spelling.variants(df, most).collect()), key=lambda r: r[0])
    assert got == brute_variants(counts)


def test_a_hot_tile_is_halved(spark):
    """Words that agree but for two places far apart share one tile of each half at first."""
    words = [("prefix" + a + "middle" + b + "suffix", 1) for a in "abcdefghij" for b in "abcdefghij"]
    tiles = spelling.tiles(spark.createDataFrame(words, "word string, n long"), most=12)
    sizes = tiles.groupBy(*spelling.KEY).count().collect()
    assert max(r["count"] for r in sizes) == 10


def test_words_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_counts([(r.doc_id, r.text) for r in docs.collect()], drop_every=199)
    got = {r.word: r.n for r in spelling.word_counts(docs, "doc_id", "text", drop_every=199).collect()}
    assert got == want and len(want) > 1000
    rows = {r.word: r for r in QUERIES["op12_spelling"](spark, SF).collect()}
    assert set(rows) == set(want) and sum(r.form is not None for r in rows.values()) > 100
    rng = random.Random(0)
    for w in rng.sample(sorted(want), 60):
        assert rows[w].n_near == sum(one_edit(w, v) for v in want)


def test_words_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 1 << 20)
    rows = [(1, None), (2, ""), (None, "straße straße ÀÉÎ"), (3, "Wörter×wörter " * 90_000), (3, "x" * 2_100_000),
            (4, "ABC×def"), (4, "ABC×def")]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], DOCS + ", word string, n int")
    for every in (0, 2):
        got = {r.word: r.n for r in spelling.word_counts(df, "doc_id", "text", 1, 1, every).collect()}
        assert got == brute_counts(rows, 1, 1, every)
    assert spelling.variants(spelling.word_counts(df.limit(0), "doc_id", "text")).count() == 0


# -- 13 hard negatives --------------------------------------------------------------------

def brute_negatives(rows, is_anchor, scale=256, positives=5, negatives=10, low=30, high=90):
    kept = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((i, label, [int(np.floor(scale * float(x))) for x in v]))
    out = []
    for i, label, v in kept:
        if not is_anchor(i):
            continue
        def score(w):
            return sum(x * y for x, y in zip(v, w))
        same = sorted((-score(w), j) for j, m, w in kept if m == label and j != i)[:positives]
        for p, j in same:
            found = sorted((-score(w), k) for k, m, w in kept if m != label)
            found = [(s, k) for s, k in found if low * -p <= 100 * -s <= high * -p][:negatives]
            out += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(found, 1)]
    return sorted(out)


VECTORS = "id long, label int, v array<float>"


def mined(df, is_anchor=lambda i: i % 10 == 0, **kw):
    return sorted(tuple(r) for r in hard_negatives.mine(df, "id", "v", "label", is_anchor, **kw).collect())


@pytest.mark.parametrize("block, chunk, step", [(4096, 256, 512), (16, 4, 5), (7, 2, 3)])
def test_negatives_in_many_blocks(spark, monkeypatch, block, chunk, step):
    """Clustered vectors with ties, in blocks that the bounds prune and in single ones."""
    for name, value in (("BLOCK", block), ("CHUNK", chunk), ("STEP", step)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(6, 8))
    rows = [(k, int(rng.integers(0, 4)), (centres[k % 6] + 0.2 * rng.normal(size=8)).round(1).tolist()) for k in range(240)]
    rows += [(300 + k, 1, [0.5] * 8) for k in range(80)]            # one vector with a quarter of all rows
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 200 and mined(df, lambda i: i % 10 == 0) == want


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [1.0, 1.0]), (2, 2, [0.5, 0.5]), (3, 2, [0.4, 0.7, 9.0]), (4, 2, []), (5, 1, [0.0, 0.0]),
            (6, None, [1.0, 1.0]), (7, 2, None), (8, 2, [1.0, None]), (9, 2, [nan, 1.0]), (11, 2, [inf, 1.0]),
            (None, 2, [0.5, 0.5]), (10, 2, [-1.0, 2.0]), (20, 3, [0.0, 0.0]), (30, 7, [3.0, 3.0]), (12, 2, [0.5, 0.5])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS + ", chunk string, rank int")
    assert mined(df) == brute_negatives(rows, lambda i: i % 10 == 0)
    assert mined(df.limit(0)) == [] and mined(df, lambda i: i < 0) == []
    twice = spark.createDataFrame(rows + rows[:1], VECTORS)         # an anchor that repeats mines twice, by equal scores
    assert mined(twice) == sorted(brute_negatives(rows, lambda i: i % 10 == 0)
                                  + brute_negatives(rows, lambda i: i == 0))
    large = [(k, k % 3, [3e5 * ((k * j) % 7 - 3) + j for j in range(6)]) for k in range(60)]    # scores above 2 ** 53
    assert mined(spark.createDataFrame(large, VECTORS)) == brute_negatives(large, lambda i: i % 10 == 0)


def test_negatives_parameters(spark):
    rng = np.random.default_rng(3)
    rows = [(k, k % 3, rng.normal(size=4).round(2).tolist()) for k in range(100)]
    df = spark.createDataFrame([(i, m, list(map(float, np.float32(v)))) for i, m, v in rows], VECTORS)
    rows = [(i, m, [float(np.float32(x)) for x in v]) for i, m, v in rows]
    got = mined(df, scale=1000, positives=2, negatives=3, low=0, high=100)
    assert got == brute_negatives(rows, lambda i: i % 10 == 0, 1000, 2, 3, 0, 100)


def test_walk_ends_early(spark, monkeypatch):
    """Rows far from the cluster are not scored once the bounds certify the end."""
    rng = np.random.default_rng(0)
    x = np.concatenate([np.tile([1000, 0], (50, 1)), np.tile([0, 1000], (5000, 1))]) + rng.integers(-9, 9, (5050, 2))
    block = {"size": len(x), "ids": np.arange(len(x)).tobytes(), "labels": np.zeros(len(x), np.int64).tobytes(),
             "vectors": x.astype(np.int32).tobytes()}
    chunk = {"size": 1, "ids": np.array([9999]).tobytes(), "labels": np.ones(1, np.int64).tobytes(),
             "vectors": np.array([[1000, 0]], np.int32).tobytes(), "mean": [1.0, 0.0], "spread": 0.0,
             "asks": [0], "low": [-(1 << 62)], "high": [1 << 62], "floor": [-(1 << 62)]}
    scored = []
    products = hard_negatives._products
    monkeypatch.setattr(hard_negatives, "_products", lambda a, b: scored.append(len(b)) or products(a, b))
    ask, score, ids = hard_negatives.walk(chunk, block, 10, False)
    want = sorted(((-int(s), k) for k, s in enumerate(x[:, 0] * 1000)))[:10]
    assert sorted(zip((-score).tolist(), ids.tolist())) == want and sum(scored) < 1500
