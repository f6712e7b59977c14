"""Every operator against brute force, and on nulls, empty texts, ties, repeats, empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from mercadia.llm import (
    bits, byte_bpe, decontaminate, exact_dedup, language_id, lm_score, ngram_join, quality, token_files,
    url_rules, warc)
from mercadia.llm.common import remainder, scratch
from mercadia.llm.queries import BYTE_BPE, WORD_BPE

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "plain words here, twice."), (4, "plain words here, twice."),
       (None, "no id"), (6, "x" * 30000), (7, "é ́ 日本語 🎉 <|endoftext|> it's\x1c\x85 a  b "), (8, "word " * 6000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows as a stored table, with extra columns that clash with inner names."""
    path = scratch(spark, "odd")
    (spark.createDataFrame(ODD, DOCS).repartition(2).withColumn("row", F.lit("mine")).withColumn("kept", F.lit(1))
     .withColumn("node", F.lit(None).cast("string")).write.parquet(path))
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def key(r):
    return tuple((v is not None, v) for v in r)


# -- 2 exact dedup ---------------------------------------------------------------

def brute_dedup(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is not None, d))
    out = []
    for body, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        for k, m in enumerate(members):
            out.append((m[2], members[0][2], len(members), k == 0, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=key)


def test_exact_dedup_with_hot_groups_in_slices(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a b", "ab", " ab\n", "a  b "]) if k % 3 == 0 else f"text {k % 400}") for k in range(3000)]
    got = exact_dedup.groups(spark.createDataFrame(rows, DOCS), "doc_id", "text").drop("text")
    got = got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted((tuple(r) for r in got), key=key) == brute_dedup(rows)


def test_exact_dedup_odd_rows(odd, none):
    got = exact_dedup.groups(odd, "doc_id", "text").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=key) == brute_dedup(ODD)
    kept = exact_dedup.deduplicate(odd, "doc_id", "text")
    assert kept.columns == odd.columns and kept.count() == len({re.sub(r"\s", "", t or "") for _, t in ODD})
    assert exact_dedup.groups(none, "doc_id", "text").count() == 0


def test_hot_keys_are_bounded(spark):
    keys = spark.range(10000).select(F.lit("p").alias("__xd_prefix"), (F.col("id") % 50).alias("__xd_hash"))
    hot = exact_dedup.hot_keys(keys, 40).collect()
    assert len(hot) == 50 and all(r["__xd_slices"] <= 2 for r in hot)


# -- 4 url rules -------------------------------------------------------------------

def brute_rule(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    path = re.match(r"[^?#]*", rest[len(raw):])[0]
    fit = [(-len(h + p), v != "block", h + p, v) for h, p, v in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *((min(fit)[2], min(fit)[3]) if fit and host else (None, "allow"))


def test_url_rules_against_brute_force(spark):
    rng = random.Random(2)
    hosts = ["org", "example.org", "a.example.org", "b.a.example.org", "xexample.org", "com", "x.COM", "org.", "a..org"]
    paths = ["", "/", "/es", "/es/", "/es/x", "/en/1", "/en/12?q#f", "#es/", "?x=/es/"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)] + [None, "", "no scheme", "x://", "://org/"]
    rules = [(h.lower(), p, v) for h in hosts[:6] for p in ("/", "/es/", "/en/1") for v in ("allow", "block")
             if rng.random() < 0.4]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string")
    got = url_rules.judge(df, "url", url_rules.rule_table(spark, rules)).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute_rule(r.url, rules), r


def test_url_rules_empty_tables(spark):
    df = spark.createDataFrame([(1, "http://a.org/")], "row long, url string")
    empty = url_rules.rule_table(spark, [("a", "b", "allow")]).where("false")
    assert [tuple(r) for r in url_rules.judge(df, "url", empty).collect()] == [(1, "http://a.org/", "a.org", "/", None, "allow")]
    assert url_rules.judge(df.where("false"), "url", url_rules.rule_table(spark, [("org", "/", "block")])).count() == 0


# -- 6 byte BPE, 8 token files --------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(BYTE_BPE), Tokenizer.from_file(WORD_BPE)


def test_byte_bpe_equals_the_library(odd, none, library):
    rows = byte_bpe.round_trip(odd.select("doc_id", "text", F.col("text").alias("again")), "text", BYTE_BPE).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        want = library[0].encode(r.again or "", add_special_tokens=False).ids
        assert list(r.ids) == want and r.decoded == library[0].decode(want, skip_special_tokens=False) == (r.again or "")
    assert byte_bpe.round_trip(none, "text", BYTE_BPE).count() == 0
    two = byte_bpe.decode_ids(byte_bpe.with_ids(odd, "text", BYTE_BPE), "ids", BYTE_BPE).collect()
    assert all(r.decoded == (r.text or "") for r in two)


def test_words_side_by_side_equal_the_library(library):
    bpe, rng = byte_bpe.load(BYTE_BPE), random.Random(7)
    parts = ["ing", "tion", "th", "auré", "é", "er", "ou", "\U0001f600", "4", "x", "wh", "ß", "中"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, n))) for n in (12, 12, 12, 90) for _ in range(700)]
    raw = [w.encode().decode("latin-1") for w in words]
    flat, counts = bpe.words(["", *raw])
    assert counts[0] == 0
    got = [list(map(int, v)) for v in np.split(flat, np.cumsum(counts))][1:-1]
    assert got == [bpe.word(w) for w in raw]
    texts = [" ".join(words[k:k + 40]) + rng.choice([".\nOf", "\n", " \n x", ",\nÉa, b", "<|endoftext|>", "\n\nno"])
             for k in range(0, len(words), 40)]
    flat, counts = bpe.encode(texts)
    assert [list(map(int, v)) for v in np.split(flat, np.cumsum(counts))][:-1] == [
        library[0].encode(t, add_special_tokens=False).ids for t in texts]


def held_mb(job) -> tuple[float, float]:
    """Memory kept by and at most taken by ``job``."""
    tracemalloc.start()
    try:
        kept = job()
        now, peak = tracemalloc.get_traced_memory()
        return now / 1e6, peak / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_the_encoder_and_of_language_features():
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(250)) for _ in range(80)]

    def encoder():
        bpe = byte_bpe.ByteBpe(BYTE_BPE)
        for k in range(0, len(texts), 20):
            bpe.encode(texts[k:k + 20])
        return bpe

    assert held_mb(encoder)[0] < 45
    assert held_mb(lambda: language_id.features(["a short text"] * 1024))[1] < 30     # the result is 8


def test_pair_verdicts_equal_merging():
    bpe = byte_bpe.load(BYTE_BPE)
    rng, text = random.Random(3), {i: t for t, i in bpe.id_of.items()}
    ids = [i for i, n in enumerate(bpe.length) if n]
    for _ in range(4000):
        a, b = rng.choice(ids), rng.choice(ids)
        assert bpe.compatible(a, b) == (bpe.merged(text[a] + text[b]) == [text[a], text[b]])


def test_simple_8b_round_trip():
    rng = np.random.default_rng(0)
    for trial in range(100):
        counts = rng.integers(0, 300, rng.integers(0, 9))
        v = rng.integers(0, 2 ** 63, counts.sum()).astype(np.uint64) * np.uint64(2)
        v >>= rng.integers(0, 64, counts.sum()).astype(np.uint64) if trial % 3 else np.uint64(50)
        words, per, raw, raw_per = token_files.pack(v, counts)
        assert (token_files.unpack(words, per, counts, raw, raw_per) == v).all()


def test_blocks_avoid_the_mark():
    mark = np.frombuffer((token_files.MARK + " " * 1).encode()[:24], np.uint64)
    data = token_files.block(0, 0, [None, 5], [1, 2], [mark.tobytes(), b""], [b"", b""])
    assert token_files.MARK.encode() not in data and data[:4] == token_files.MAGIC


def test_token_files_equal_the_library(spark, odd, none, library):
    folder = scratch(spark, "tf")
    token_files.write(odd, "doc_id", "text", WORD_BPE, folder, 1)
    got = token_files.index(token_files.read(spark, folder)).orderBy("start").collect()
    assert len(got) == len(ODD) and [r.doc_id for r in got] == sorted((d for d, _ in ODD), key=lambda d: (d is not None, d))
    start = 0
    for r in got:
        ids = np.frombuffer(r.ids_le, "<u4").tolist()
        assert r.start == start and r.n_tokens == len(ids)
        assert ids in [library[1].encode(t or "", add_special_tokens=False).ids + [1] for d, t in ODD if d == r.doc_id]
        start += len(ids)
    folder = scratch(spark, "tf")
    token_files.write(none, "doc_id", "text", WORD_BPE, folder, 1)
    assert token_files.index(token_files.read(spark, folder)).count() == 0


# -- 3 WARC --------------------------------------------------------------------------

PAGES = [(k, f"http://h/{k} x", ("<p>\r\n\r\nWARC/1.0\r\n" + "y" * 1500) if k % 2 else f"short {k}\n") for k in range(12)] + [
    (20, None, None), (21, "", ""), (None, "http://n/", "z" * 2000), (22, "http://z/", "z" * 2000),
    (3, "http://h/3", "same" * 400), (3, "http://h/3", "same" * 400)]


def test_pages_through_archives(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    got = warc.through_archives(df, "page_id", "url", "html").collect()
    assert len(got) == len(PAGES)
    seen = sorted((r.doc_id is not None, r.doc_id, r.payload_bytes, r.payload_digest) for r in got)
    assert seen == sorted((p is not None, p, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest())
                          for p, _, h in PAGES)
    by = {}
    for r in got:
        by.setdefault(r.payload_digest, []).append(r)
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", r.record_id)
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", r.date)
    assert len({r.record_id for r in got}) == len(got)
    for group in by.values():
        kinds = [r.record_type for r in group]
        if len(group) == 1 or group[0].payload_bytes < 1000:
            assert set(kinds) == {"response"}
        else:
            (first,) = [r for r in group if r.record_type == "response"]
            assert first.doc_id == max(r.doc_id for r in group if r.doc_id is not None)
            assert all(r.refers_to == first.doc_id and r.refers_to_id == first.record_id and r.payload == b""
                       for r in group if r is not first)
    assert warc.through_archives(df.where("false"), "page_id", "url", "html").count() == 0


def test_arc_versions_and_bad_lengths():
    for version, extra in ((1, ""), (2, " 200 - - 0 a.arc")):
        text = f"{version} 0 x\n{warc.ARC_FIELDS[version]}\n"
        body = "HTTP/1.0 200 OK\r\nX-Document-Id: 7\r\n\r\nab\n\ncd"
        data = (f"filedesc://a 0.0.0.0 20010101000000 text/plain{extra} {len(text)}\n{text}\n"
                f"http://u/ 1.2.3.4 2001 text/html{extra} {len(body)}\n{body}\ndns:u 1.2.3.4 20010101 text/dns{extra} 0\n\n")
        reader = warc.ArcReader("a")
        found = [r for r in map(reader.feed, data.encode().split(b"\n")[:-1]) if r]
        reader.close()
        assert [(r["kind"], r["version"], r["payload"]) for r in found] == [
            ("warcinfo", version, text.encode()), ("response", version, b"ab\n\ncd"), ("resource", version, b"")]
        assert found[1]["doc_id"] == 7
    reader = warc.ArcReader("a")
    reader.feed(b"http://u/ 1.2.3.4 2001 text/html 99")
    with pytest.raises(ValueError):
        reader.close()


# -- 7 n-gram join --------------------------------------------------------------------

def brute_near(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    part = list(range(len(rows)))

    def top(x):
        while part[x] != x:
            x = part[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                part[top(a)] = top(b)
    best = {}
    for k, (d, _) in enumerate(rows):
        best[top(k)] = min([best.get(top(k), (True, 0)), (d is None, d or 0)])
    return sorted(((d, len(sets[k]), None if best[top(k)][0] else best[top(k)][1]) for k, (d, _) in enumerate(rows)), key=key)


def near_rows():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    shared = rng.sample(words, 40)
    rows = []
    for g in range(12):
        base = rng.choices(words, k=rng.choice([3, 5, 30, 120]))
        for _ in range(rng.choice([1, 2, 40])):      # long lists: chains of edited copies
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text).title()))
    for _ in range(30):                              # a passage in unrelated texts
        rows.append((len(rows), " ".join(rng.choices(words, k=60) + shared)))
    return rows + [rows[0], (900, rows[1][1]), (901, None), (902, " \n")]


def test_near_duplicates_against_brute_force(spark):
    rows = near_rows()
    path = scratch(spark, "near")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    got = ngram_join.near_duplicates(df, "doc_id", "text").collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == brute_near(rows)
    thin = ngram_join.thin(df, "doc_id", "text").collect()
    assert len(thin) == sum(r.kept for r in got) and {r.doc_id for r in thin} >= {901, 902}


def test_near_duplicates_odd_rows(odd, none):
    got = ngram_join.near_duplicates(odd, "doc_id", "text").collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == brute_near(ODD)
    assert ngram_join.thin(odd, "doc_id", "text").columns == odd.columns
    assert ngram_join.near_duplicates(none, "doc_id", "text").count() == 0


def test_prefixes_keep_similar_pairs():
    """Sets with similarity t share min(l, l') elements of their prefixes, whatever the order."""
    rng = np.random.default_rng(5)
    levels = rng.integers(0, 60, 1 << ngram_join.SKETCH_LOG2).astype(np.uint8)
    for _ in range(200):
        base = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
        a, b = np.unique(base[:rng.integers(60, 80)]), np.unique(base[rng.integers(0, 12):])
        if not ngram_join.similar(len(np.intersect1d(a, b)), len(a), len(b)):
            continue
        h, _, _, match, prefix, _ = ngram_join.ordered(np.concatenate([a, b]), np.array([len(a), len(b)]), levels, 10)
        x, y = h[:len(a)], h[len(a):]
        assert len(np.intersect1d(x[:prefix[0]], y[:prefix[1]])) >= match.min()


def test_lists_led_by_either_side_are_counted_together(spark):
    """Two families whose shared lists are led alternately: 10 by one and 10 by the other, 12 needed."""
    a, b = range(1, 13), range(101, 113)
    lists = [(t, [1, 101, *(a if t % 2 else b)[2:]]) for t in range(20)]
    lists += [(20 + t, [2, 102, *(a if t % 2 else b)[2:]]) for t in range(11)]
    postings = spark.createDataFrame(sorted({(t, x, 12, 40) for t, xs in lists for x in xs}),
                                     "token long, node long, matches long, n long")
    comps = spark.createDataFrame([(x, x // 100) for x in [*a, *b]], "node long, comp long")
    met: dict = {}
    for r in ngram_join.open_blocks(postings, comps).collect():
        met.setdefault((r.block, r.slot), ([], []))[r.role].append(r.node)
    assert {tuple(sorted((x, y))) for xs, ys in met.values() for x in xs for y in ys} == {(1, 101)}


# -- 5 decontamination ------------------------------------------------------------------

ITEMS = [(1, "A train leaves Paris at 9 with 120 km to go, and it needs 3 hours; how fast must it run on its way?"),
         (2, "The quick brown fox jumps over the lazy dog near the old river bank today."), (3, None), (4, "a b")]
CASES = [(10, "Intro text. " + ITEMS[1][1] + " More text.", {2}), (11, ITEMS[1][1].upper(), {2}),
         (12, "A train leaves Rome at 7 with 250 km to go, and it needs 5 hours; how fast must it run on its way?", {1}),
         (13, "Nothing of the kind stands in this text, which is about other matters and long enough.", set()),
         (14, None, set()), (15, "", set()), (None, ITEMS[1][1], {2}), (17, "A train leaves Paris.", set())]


def test_decontamination(spark, odd):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([c[:2] for c in CASES], DOCS).coalesce(1)
    found = decontaminate.leaks(docs, "doc_id", "text", items, "item_id", "text").collect()
    assert sorted(((r.doc, r.item) for r in found), key=key) == sorted(((d, i) for d, _, s in CASES for i in s), key=key)
    assert {r.doc: r.slots_changed for r in found}[12] and not {r.doc: r.slots_changed for r in found}[10]
    left = decontaminate.clean(docs, "doc_id", "text", items, "item_id", "text")
    assert sorted(r.doc_id for r in left.collect()) == [13, 14, 15, 17]
    assert decontaminate.leaks(docs, "doc_id", "text", items.where("false"), "item_id", "text").count() == 0
    assert decontaminate.clean(odd, "doc_id", "text", items, "item_id", "text").count() == len(ODD)


def test_slots_must_map_consistently(spark):
    items = spark.createDataFrame([(1, "add 5 apples to 5 pears then take 5 plums from the green basket here")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "add 8 apples to 8 pears then take 8 plums from the green basket here"),
                                  (2, "add 8 apples to 3 pears then take 9 plums from the green basket here")], DOCS)
    found = decontaminate.leaks(docs, "doc_id", "text", items, "item_id", "text").collect()
    assert [r.doc for r in found] == [1]


def leaked(spark, items, docs):
    """(doc, item) of all leaks, by place in the lists."""
    items, docs = (spark.createDataFrame(list(enumerate(x)), DOCS).coalesce(1) for x in (items, docs))
    found = decontaminate.leaks(docs, "doc_id", "text", items, "doc_id", "text").collect()
    return sorted((r.doc, r.item) for r in found)


def test_short_items_and_items_of_values_are_found_verbatim(spark):
    items = ["Compute 12 + 7 * 3", "Who wrote Faust?", "In 1815 1816 1817 Alice Bob Carol met Dave Erin 1818 1819", "Yes no"]
    docs = [f"Some text stands before it. {t} And more text." for t in items] + ["yes, no", "Compute 12 + 8 * 3"]
    assert leaked(spark, items, docs) == [(0, 0), (1, 1), (2, 2), (4, 3), (5, 0)]


def test_calculations_with_other_numbers_are_found(spark):
    items = ["Compute 12 + 7 * 3", "What is 5 - 5 + 9 ?", "( 2 + 3 ) * 4 ="]
    docs = ["First, compute 40 + 8 * 2 on paper.", "compute 40 * 8 + 2", "What is 7 - 7 + 1 ?", "What is 7 - 6 + 1 ?",
            "so ( 9 + 8 ) * 7 = 119", "compute 4 + 8", "12 + 7 * 3"]
    assert leaked(spark, items, docs) == [(0, 0), (2, 1), (4, 2)]       # 7 - 6 does not stand for 5 - 5


def test_names_and_number_words_are_slots(spark):
    item = "the farm of old {} keeps {} sheep and a dog near the long river bank"
    docs = [item.format(n, k) for n, k in (("O'Brien", "seven"), ("Jean-Luc", "12"), ("Smith", "thirty"))]
    assert leaked(spark, [item.format("McDonald", "nine")], docs) == [(0, 0), (1, 0), (2, 0)]
    kinds = [decontaminate.kind(w) for w in ("McDonald", "O'Brien", "Jean-Luc", "iPhone", "seven", "a", "A", "Él", "NASA")]
    assert kinds[:3] == [decontaminate.NAME] * 3 and kinds[3] == decontaminate.LITERAL and kinds[4] == decontaminate.NUMBER


def test_one_edited_value_leaves_the_equal_windows(spark):
    item = "the box holds 12 red pens and lid number four " + " ".join(f"word{chr(97 + k)}" for k in range(30)) + " so 12 pens in all"
    assert leaked(spark, [item], [item.replace("so 12", "so 13")]) == [(0, 0)]


def test_items_behind_other_text(spark):
    items = ["Count the apples that 12 boys took", "Where does old Mister Anton Keller live now"]
    docs = ["Title line\nCount the apples that 15 boys took", items[1].lower(), "- " + items[0], "title " + items[1]]
    assert leaked(spark, items, docs) == [(0, 0), (1, 1), (2, 0), (3, 1)]


def test_bits_hold_what_was_put_in(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("h"))
    mask = bits.build(df, F.col("h"))
    h = np.array([r.h for r in df.collect()], np.int64)
    assert bits.holds(mask, h).all() and bits.holds(mask, h + 7919).mean() < 0.05


# -- 1 quality, 9 LM, 10 language --------------------------------------------------------

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark, odd, none):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, "doc_id", "text", labels, "doc_id", "quality", remainder(F.col("doc_id"), 3) != 1)
    rows = (quality.score(docs.select("doc_id", "text"), "text", model).join(labels, "doc_id")
            .where(remainder(F.col("doc_id"), 3) == 1).collect())
    assert np.mean([(r.score >= 0.5) == r.quality for r in rows]) > 0.9
    got = quality.score(odd, "text", model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(none, "text", model).count() == 0
    blank = quality.train(docs, "doc_id", "text", labels.where("false"), "doc_id", "quality", F.lit(True))
    assert {r.score for r in quality.score(odd, "text", blank).collect()} == {0.5}


def test_quality_tables_add_up():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, len(quality.NAMES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)     # an interaction only
    model = quality.fit(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) >= 0.5) == y).mean() > 0.9
    bins = model.bins(x)
    total = model.intercept + sum(model.tables[k][bins[:, k]] for k in range(x.shape[1])) + sum(
        model.pair_tables[p][bins[:, a], bins[:, b]] for p, (a, b) in enumerate(model.pairs))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-total)))


def test_language_held_out(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs, "doc_id", "text", "lang", remainder(F.col("doc_id"), 5) != 0)
    rows = language_id.predict(docs, "text", model).where(remainder(F.col("doc_id"), 5) == 0).collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95
    got = {r.doc_id: r for r in language_id.predict(odd, "text", model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert got[4].lang_pred != "und"
    assert language_id.predict(none, "text", model).count() == 0
    blank = language_id.train(docs.where("false"), "doc_id", "text", "lang", F.lit(True))
    assert {r.lang_pred for r in language_id.predict(odd, "text", blank).collect()} == {"und"}


def test_unknown_languages_are_families():
    x = np.vstack([language_id.features([f"{w} {w}a {w}b"] * 5) for w in ("kaa", "loo", "mii")])
    model = language_id.fit(x, ["xx"] * 5 + ["en"] * 5 + ["de"] * 5)
    assert model.families == ["germanic", "xx"] and model.predict(x)[0] == ["xx"] * 5 + ["en"] * 5 + ["de"] * 5


def test_lm_scores(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lm_score.score(docs, "doc_id", "text").collect()
    assert len(rows) == docs.count()
    n, total = sum(r.n_tokens for r in rows), sum(r.log_likelihood for r in rows)
    seen = Counter(w for r in docs.select("text").collect() for w in lm_score.words_of(r.text))
    assert sum(seen.values()) == n
    alone = sum(k * np.log(k / n) for k in seen.values()) / n
    assert total / n > alone + 0.7          # nats a token above the words' own frequencies
    got = {r.doc_id: r for r in lm_score.score(odd, "doc_id", "text").collect()}
    assert got[1].n_tokens == 0 and got[1].log_likelihood == 0 and got[1].mean_log_likelihood is None
    assert lm_score.score(none, "doc_id", "text").count() == 0


def test_lm_scores_do_not_depend_on_files(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD", 1 << 16)         # several shards on the small table
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = []
    for files in (1, 16):
        path = scratch(spark, "layout")
        docs.repartition(files).write.parquet(path)
        rows = lm_score.score(spark.read.parquet(path), "doc_id", "text").collect()
        found.append({r.doc_id: r.log_likelihood for r in rows})
    assert max(abs(found[0][d] - found[1][d]) for d in found[0]) < 1e-5


def test_lm_words_are_split_and_found_by_column():
    """Words and ids of whole columns are those of one text and word after the other."""
    import pyarrow as pa
    texts = [" a  b ", "", None, "x\x0b\x0cY\x1f\x1cz\x85\u00c9\u2003q\u00a0", "\t\r\n", "a\0B b\na", "\u0130 I"]
    for column in (pa.array(texts), pa.array(["", *texts]).slice(1), pa.array([], pa.string())):
        words, sizes = lm_score.column_words(column)
        want = [lm_score.words_of(t) for t in column.to_pylist()]
        assert sizes.tolist() == [len(w) for w in want] and words.to_pylist() == [x for w in want for x in w]
    size = lm_score.WORDS - lm_score.GROUP
    top = [(b"w%d" % k, size + 9 - k) for k in range(size + 5)]
    totals = np.full(lm_score.GROUP, 1e6)
    asked = [b"w0", b"new", b"w%d" % (size + 2), b"w7", b"new", b"other"]
    for listed in (top, top[:3], []):
        ids, inner, hashes = lm_score.Ids(listed, totals)(pa.array(asked, pa.binary()))
        at = {w: k for k, (w, _) in enumerate(listed)}
        for k, w in enumerate(asked):
            known, rare = at.get(w, size) < size, w in at and at[w] >= size
            assert ids[k] == (lm_score.GROUP + at[w] if known else lm_score.entry(w))
            assert inner[k] == (np.log(float(listed[at[w]][1])) - np.log(1e6) if rare else 0)
            assert hashes[k] == (0 if w in at else lm_score.word_hashes([w])[0])


def test_lm_scores_word_by_word(spark):
    """A small table's scores from the trained weights, one word after the other."""
    rng = random.Random(4)
    texts = {k: " ".join(rng.choice(["aa", "bb", "cc dd", "ee", f"own{rng.randrange(90)}"]) for _ in range(60))
             for k in range(80)}
    texts |= {100: "aa", 101: "", 102: "bb never-seen-twice aa"}
    df = spark.createDataFrame(list(texts.items()), DOCS)
    got = {r.doc_id: r.log_likelihood for r in lm_score.score(df, "doc_id", "text").collect()}
    counts = Counter(w for t in texts.values() for w in lm_score.words_of(t))
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    ids = {w: lm_score.GROUP + k for k, (w, _) in enumerate(top)}
    model = lm_score.fit(df, "doc_id", "text")
    w = lm_score.Network(model.weights).w
    for d, text in texts.items():
        flat = [ids[x] for x in lm_score.words_of(text)]
        total = 0.0
        for k, target in enumerate(flat):
            h = w["bias"].astype(float)
            for place, o in enumerate(lm_score.OFFSETS):
                near = flat[k + o] if 0 <= k + o < len(flat) else lm_score.PAD
                h = h + w["embed"][near] * w["place"][place]
            h = np.tanh(h)
            g, m = divmod(target, lm_score.GROUP)
            for logits, at in ((h @ w["group"] + w["group_bias"], g),
                               (h @ w["member"][g] + w["member_bias"][g], m)):
                total += logits[at] - np.log(np.exp(logits).sum())
        assert abs(got[d] - total) < 1e-3 * max(1, len(flat))


def test_lm_words_outside_the_vocabulary_count_as_words(spark, monkeypatch):
    """A rarer word of the same entry costs its share of the entry, listed in tasks or joined."""
    common = [b"w%dx" % k for k in range(lm_score.WORDS - lm_score.GROUP)]
    twin = next((a, b) for a in range(100, 999) for b in range(a + 1, 999)
                if lm_score.entry(b"q%dz" % a) == lm_score.entry(b"q%dz" % b))
    a, b = ("q%dz" % k for k in twin)
    lines = [" ".join(w.decode() for w in common)] * 60
    rows = [*enumerate(lines, 10), (1, a), (2, b), *((100 + k, a) for k in range(39))]
    df = spark.createDataFrame(rows, DOCS).coalesce(2)
    for listed in (1 << 16, 1, 0):
        monkeypatch.setattr(lm_score, "LISTED", listed)
        got = {r.doc_id: r.log_likelihood for r in lm_score.score(df, "doc_id", "text").collect()}
        assert abs(got[1] - got[2] - np.log(40)) < 1e-6


def test_lm_every_position_is_a_target_once(spark, monkeypatch):
    """Targets of all rounds together: every position of every document, also when rows are dealt anew."""
    import pyarrow as pa
    from pyspark import TaskContext
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})()))
    met: list = []
    monkeypatch.setattr(lm_score.Network, "gradient", lambda self, near, target: met.extend(target.tolist()) or {})
    sizes = [1, 2, 5, 40, 700, 3, 0, 33]
    first = np.cumsum([0, *sizes])
    data = [np.arange(a, a + k, dtype="<u2").tobytes() for a, k in zip(first, sizes)]
    for turn in range(lm_score.ROUNDS):
        cut = 3 + turn
        batches = [pa.record_batch([pa.array(d, pa.binary())], names=["ids"]) for d in (data[:cut], data[cut:])]
        list(lm_score.steps(lm_score.Network.start(), turn)(iter(batches)))
    assert sorted(met) == list(range(sum(sizes)))


def test_lm_gradient_is_the_slope():
    rng = np.random.default_rng(1)
    net = lm_score.Network(lm_score.Network.start())
    near, target = rng.integers(0, 200, (4, 50)), rng.integers(0, 200, 50)
    grad = net.gradient(near, target)
    for name, at in (("group", (3, 1)), ("bias", (2,)), ("place", (1, 4)), ("member", (0, 5, 7)),
                     ("embed", (int(near[2, 3]), 5)), ("member_bias", (1, 2)), ("group_bias", (2,))):
        old = net.w[name][at]
        up, down = [], []
        for step, out in ((1e-2, up), (-1e-2, down)):
            net.w[name][at] = old + step
            out.append(-net.fix().log_chance(near, target).astype(float).mean())
        net.w[name][at] = old
        assert abs((up[0] - down[0]) / 2e-2 - grad[name][at]) < 2e-3


# -- columns named as the operators' own -------------------------------------------------

def test_output_names_as_input_columns(spark):
    rows = spark.createDataFrame([(1, "some plain words", "https://example.org/es/1", "x")],
                                 "doc_id long, text string, url string, extra string")
    model = language_id.fit(language_id.features(["some plain words", "der die das"]), ["en", "de"])
    plain = quality.Model()
    cases = [(lambda d: quality.score(d, "text", plain), ["score"]),
             (lambda d: language_id.predict(d, "text", model), ["lang_pred", "score"]),
             (lambda d: byte_bpe.round_trip(d, "text", BYTE_BPE), ["ids", "decoded"]),
             (lambda d: byte_bpe.with_ids(d, "text", BYTE_BPE), ["ids"]),
             (lambda d: url_rules.judge(d, "url", url_rules.rule_table(spark, [("org", "/", "allow")])),
              ["host", "path", "rule", "verdict"])]
    for run, names in cases:
        want = run(rows).drop("extra").first()
        for name in names:
            clash = rows.withColumnRenamed("extra", name)
            out = run(clash)
            got = out.first().asDict()
            assert got[name + "_"] == "x" and all(got[n] == want[n] for n in names)
            assert out.select(*names).count() == 1
    with pytest.raises(ValueError):
        quality.score(rows.withColumnRenamed("text", "score"), "score", plain)


def test_letters_are_those_of_the_language_contract():
    assert not any(map(language_id.has_letter, ["½ ² ① Ⅷ 12 !", "", "_"])) and language_id.has_letter("١٢ ب")


def test_every_language_is_learned(spark):
    """Seven frequent languages and a rare one: the rare one gives all its rows."""
    words = {f"l{k}": [f"{a}{b}{k}q" for a in "bdfg" for b in "aeio"] for k in range(8)}
    rng = random.Random(0)
    rows = [(n, " ".join(rng.choice(words[lang]) for _ in range(6)), lang)
            for n, lang in enumerate([f"l{k}" for k in range(7) for _ in range(900)] + ["l7"] * 15)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    fit = language_id.fit
    language_id.fit = lambda x, langs: seen.extend(langs) or fit(x, langs)
    try:
        language_id.train(df.union(df.where("lang = 'l7'")), "doc_id", "text", "lang", F.lit(True), most=400)
        count = Counter(seen)
        assert count["l7"] == 30 and set(count.values()) == {30, 50}
    finally:
        language_id.fit = fit


def test_repeated_rows_are_spread(spark):
    """Rows with one id and one text fill many slices, not one."""
    rows = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    seen = []
    real = exact_dedup.staged
    exact_dedup.staged = lambda df, name: seen.append(real(df, name)) or seen[-1]
    try:
        out = exact_dedup.groups(rows, "doc_id", "text")
        assert out.count() == 20_000 and out.where("kept").count() == 1
        assert out.select("group_size").distinct().first()[0] == 20_000
    finally:
        exact_dedup.staged = real
    salts = [r["count"] for r in seen[1].groupBy("__xd_salt").count().collect()]
    assert len(salts) >= 8 and max(salts) < 4 * min(salts)


def test_warc_reader_is_linear_in_marks():
    payload = b"x" + warc.WARC_MARK.encode() * 900_000
    head = (b"WARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n"
            b"WARC-Target-URI: http://a/\r\nContent-Length: %d\r\n\r\n" % len(payload))
    reader = warc.WarcReader("f")
    records = [r for r in map(reader.feed, (b"" + warc.WARC_MARK.encode() + head + payload + b"\r\n\r\n")
                              .split(warc.WARC_MARK.encode())) if r]
    reader.close()
    assert len(records) == 1 and records[0]["payload"] == payload


# -- a cluster that changes between readings -------------------------------------------

def test_splits_cut_anew_at_every_reading(spark, monkeypatch):
    """Each write and each collect finds the table cut into splits otherwise, as in a cluster that grows."""
    from mercadia.llm import common
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    path = scratch(spark, "regrouped")
    docs.repartition(3).write.parquet(path)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")

    def results():
        table = spark.read.parquet(path)
        return (sorted((r.doc_id, r.component_id) for r in ngram_join.near_duplicates(table, "doc_id", "text").collect()),
                sorted(r.doc_id for r in ngram_join.thin(table, "doc_id", "text").collect()),
                sorted(r.doc_id for r in decontaminate.clean(table, "doc_id", "text", items, "item_id", "text").collect()))

    want = results()
    assert want == results()
    writes = iter(range(10 ** 6))
    staged = common.staged

    def regrouped(df, name):
        spark.conf.set("spark.sql.files.minPartitionNum", str((1, 7, 40)[next(writes) % 3]))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        return staged(df, name)

    for module in (ngram_join, decontaminate):
        monkeypatch.setattr(module, "staged", regrouped)
    try:
        assert results() == want
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_common_footer_makes_nobody_meet(spark, monkeypatch):
    """Short texts of own words and one footer: no pair is similar, and none is looked at."""
    footer = " ".join(f"footer{k}" for k in range(12))
    rows = [(k, " ".join(f"own{k}x{j}" for j in range(12)) + " " + footer) for k in range(400)]
    pairs = []
    met = ngram_join.met

    def counted(askers, listed):
        out = met(askers, listed)
        pairs.append(out.agg(F.sum(F.size("xs") * F.size("ys"))).first()[0] or 0)
        return out

    monkeypatch.setattr(ngram_join, "met", counted)
    path = scratch(spark, "footer")
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(path)
    out = ngram_join.near_duplicates(spark.read.parquet(path), "doc_id", "text").collect()
    assert len(out) == 400 and all(r.component_id == r.doc_id for r in out) and pairs == [0]


def test_prefix_elements_that_fall_together_lower_the_need():
    h = np.array([1 << 40, (1 << 40) + 1, 2 << 40, 1 << 40, 3 << 40], np.uint64)
    assert ngram_join.fallen_together(h, np.array([0, 0, 0, 1, 1]), 2, 32).tolist() == [1, 0]


def test_crc_remainder(spark):
    got = spark.createDataFrame([(1,), (None,)], "doc_id long").select(remainder(F.col("doc_id"), 5).alias("r")).collect()
    assert [r.r for r in got] == [zlib.crc32(b"1") % 5, 0]
    assert public_tokenizers.path("byte_bpe_50k.json") == BYTE_BPE
