"""Benchmark decontamination by templates.

Texts are cut at white space, words lose punctuation at their ends and A-Z case.
Numbers, also as words, units behind a number and capitalised words inside a sentence (names, also
like McDonald, O'Brien, Jean-Luc) become typed placeholders. Windows of ``size`` template words are hashed; windows
of documents that may be in the benchmark (a fixed-size bit set says which
cannot) are hash-joined with the benchmark's windows. An item's
capitalised first word is a plain word and, in a second window, a name, as it may
stand behind any text. Windows with
the same values always count. Along one alignment of a document and an item, the
values of the others must map consistently: equal values in the item stand against
equal values in the document. A re-parameterised
question still aligns; an unrelated text of the same form does not. A document
is contaminated by an item when consistent alignments cover at least ``share`` of
the item's windows.

Template windows need as many plain words as placeholders and ``LEAST`` words.
Beside them the plain words of every window are hashed and joined, so verbatim
copies are found whatever a window holds; a document is also contaminated when
windows of both kinds cover ``share`` of all the item's positions. An item shorter
than ``size`` words is one window of its own length; one of less than ``ANYWHERE``
words is found where it is a document's whole text. An item of up to ``FORM`` words that is mostly
numbers (a calculation) has no usable window; its form as a whole, numbers replaced and signs kept, is
joined instead. Null and empty texts have no window;
null ids are kept as null; rows that repeat are judged each; empty tables give
an empty result. Only the named columns are read.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercadia.llm import bits
from mercadia.llm.common import staged
from mercadia.llm.tokens import slices

SIZE = 8
LEAST = 4
#: Shorter items stand in unrelated texts by chance.
ANYWHERE = 3
SHARE = 0.5
CACHE_WORDS = 200_000
# Units that count as such behind a number.
UNITS = frozenset(
    "kg g mg lb lbs oz t ton tons km m cm mm mi mile miles ft foot feet in inch inches yd l ml liter liters "
    "litre litres gal s sec second seconds min minute minutes h hr hour hours day days week weeks month months "
    "year years % percent $ dollar dollars usd eur euro euros gbp pound pounds cent cents mph kmh c f k w kw v a "
    "hz khz mhz ghz b kb mb gb tb".split())
# Number words, and signs that stand alone between the numbers of an expression.
NUMBERS = frozenset(
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
OPERATORS = frozenset("+ - * / = < > ^ x × ÷ · − ≤ ≥ ( ) ?".split())
#: Longest item that is one form as a whole.
FORM = 24
LITERAL, NUMBER, UNIT, NAME, EMPTY = range(5)
JOINTS = re.compile("['’-]")
EDGES = re.compile(r"^[^\w%$]+|[^\w%$]+$")
NUMERIC = re.compile(r"[+-]?[$]?\d[\d.,:/]*[%$]?")
ENDS = re.compile(r"[.!?:][\"')\]]*$")
MIX, PART = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
PLACEHOLDER = np.array([0, 0xA5A5A5A5A5A5A5A5, 0xC3C3C3C3C3C3C3C3, 0x9696969696969696, 0], np.uint64)
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_hash(words: list[str]) -> np.ndarray:
    """64-bit hashes of words that are the same in every process."""
    from xxhash import xxh3_64_intdigest
    return np.fromiter((xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


class Words:
    """What a raw word is: hash, kind (a capitalised word is NAME for now), sentence end."""

    def __init__(self):
        self.reset()

    def reset(self):
        self.index: dict[str, int] = {}
        self.hash = np.zeros(0, np.uint64)
        self.kind = np.zeros(0, np.int8)
        self.ends = np.zeros(0, bool)
        self.sign = np.zeros(0, bool)

    def look(self, raw: list[str]) -> np.ndarray:
        if len(self.index) > CACHE_WORDS:
            self.reset()
        at = np.fromiter(map(self.index.get, raw, repeat(-1)), np.int64, len(raw))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = list(dict.fromkeys([raw[k] for k in missing]))
            bare = [EDGES.sub("", w) for w in new]
            first = len(self.index)
            self.index.update(zip(new, range(first, first + len(new))))
            self.hash = np.concatenate([self.hash, word_hash([w.translate(UPPER) for w in bare])])
            self.kind = np.concatenate([self.kind, np.array([kind(w) for w in bare], np.int8)])
            self.ends = np.concatenate([self.ends, np.array([ENDS.search(w) is not None for w in new], bool)])
            sign = np.array([not b and w in OPERATORS for w, b in zip(new, bare)], bool)
            self.sign = np.concatenate([self.sign, sign])
            self.hash[first:][sign] = word_hash([w for w, s in zip(new, sign) if s])
            at[missing] = np.fromiter((self.index[raw[k]] for k in missing), np.int64, len(missing))
        return at


def mixed(word: str) -> bool:
    """Letters in parts, each with capitals that stand alone: McDonald, O'Brien, Jean-Luc."""
    parts = JOINTS.split(word)
    return (all(p.isalpha() and p[0].isupper() for p in parts) and not word.isupper()
            and not any(a.isupper() and b.isupper() for p in parts for a, b in zip(p, p[1:])))


def kind(word: str) -> int:
    if not word:
        return EMPTY
    if NUMERIC.fullmatch(word) or word.lower() in NUMBERS:
        return NUMBER
    if word.lower() in UNITS:
        return UNIT
    if word[0].isupper() and (word[1:].islower() or mixed(word)):
        return NAME     # Paris, McDonald, O'Brien, Jean-Luc
    return LITERAL


def templates(words: Words, texts: list[str], behind: bool = False):
    """Kept words of all texts: text number, template hash, plain hash, slot kind (0: none),
    raw words; ``behind``: texts do not open a sentence."""
    split = [t.split() for t in texts]
    raw = [w for s in split for w in s]
    doc = np.repeat(np.arange(len(texts)), [len(s) for s in split])
    at = words.look(raw)
    kinds, ends = words.kind[at], words.ends[at]
    opens = np.ones(len(raw), bool)
    new = doc[1:] != doc[:-1]
    opens[1:] = ends[:-1] & ~new if behind else ends[:-1] | new
    opens[:1] &= not behind
    kept = np.flatnonzero(kinds != EMPTY)
    doc, kinds, opens = doc[kept], kinds[kept].copy(), opens[kept]
    after = np.zeros(len(kept), bool)
    after[1:] = (kinds[:-1] == NUMBER) & (doc[1:] == doc[:-1])
    kinds[(kinds == UNIT) & ~after] = LITERAL
    kinds[(kinds == NAME) & opens] = LITERAL
    plain = words.hash[at[kept]]
    return doc, np.where(kinds == LITERAL, plain, PLACEHOLDER[kinds]), plain, kinds, [raw, kept]


def forms(words: Words, texts: list[str], sizes: list[int] | None, mask: np.ndarray | None):
    """Rows like those of :func:`windows` for items that are mostly numbers and signs, as a whole:
    all their words and placeholders with the signs between them. Such an item has no usable
    window. Sizes are negative, and an item's position is -1, apart from those of windows."""
    if sizes is not None and not sizes:     # no such item
        return []
    split = [t.split() for t in texts]
    raw = [w for s in split for w in s]
    if not raw:
        return []
    doc = np.repeat(np.arange(len(texts)), [len(s) for s in split])
    at = words.look(raw)
    kinds, sign = words.kind[at].copy(), words.sign[at]
    kinds[np.isin(kinds, (UNIT, NAME))] = LITERAL
    kept = np.flatnonzero((kinds != EMPTY) | sign)
    doc, kinds, sign = doc[kept], np.where(sign[kept], LITERAL, kinds[kept]), sign[kept]
    code = np.where(kinds == LITERAL, words.hash[at[kept]], PLACEHOLDER[kinds])
    length = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(length) - length
    slots, signs = (np.concatenate([[0], np.cumsum(x)]) for x in (kinds != LITERAL, sign))
    out = []
    for size in sorted(set(length.tolist())) if sizes is None else [-s for s in sizes]:
        if not LEAST <= size <= FORM or len(code) < size:
            continue
        n = len(code) - size + 1
        some = doc[:n] == doc[size - 1:]
        held, between = slots[size:] - slots[:n], signs[size:] - signs[:n]
        some &= (held > 1) & (between > 0) & (2 * held > size - between)
        if sizes is None:
            some &= length[doc[:n]] == size
        h = window_hashes(code, size)
        if mask is not None:
            some &= bits.holds(mask, h)
        for p in np.flatnonzero(some).tolist():
            values = [EDGES.sub("", raw[kept[q]]).translate(UPPER) for q in range(p, p + size) if kinds[q] != LITERAL]
            out.append((int(doc[p]), -size, int(h[p].astype(np.int64)),
                        -1 if sizes is None else p - int(first[doc[p]]), values, True))
    return out


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a run from the hashes of its two parts, in this order."""
    h = left * MIX
    h += right
    h ^= h >> np.uint64(29)
    h *= PART
    return h


def window_hashes(code: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` codes, put together from runs of 1, 2, 4, ... codes."""
    run, length, out, done = code, 1, None, 0
    while size:
        if size & 1:
            out = run if out is None else joined(out[:len(run) - done], run[done:])
            done += length
        size >>= 1
        if size:
            run, length = joined(run[:-length], run[length:]), 2 * length
    return out


def windows(words: Words, texts: list[str], sizes: list[int] | None, mask: np.ndarray | None, behind: bool = False):
    """Rows (text, size, hash, position, slot values, usable as template); with ``sizes`` None a
    text's size is ``SIZE`` or its length, if shorter; with ``mask`` only windows whose bit is set.

    Every window has a row of its plain words, without slot values; a usable one with slots
    has a row of its template too. Without slots the two hashes are the same. With ``sizes``
    None, first windows have another row in which the text stands behind others (``behind``
    gives only these)."""
    doc, code, plain, kinds, (raw, kept) = templates(words, texts, behind)
    length = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(length) - length
    slots = np.concatenate([[0], np.cumsum(kinds != LITERAL)])
    out = windows(words, texts, None, mask, True) if sizes is None and not behind else []
    for size in sizes if sizes is not None else sorted(set(np.minimum(length, SIZE).tolist())):
        if size < 1 or len(code) < size:
            continue
        n = len(code) - size + 1
        good = doc[:n] == doc[size - 1:]
        if size < ANYWHERE:
            good &= length[doc[:n]] == size
        if sizes is None:
            good &= np.minimum(length, SIZE)[doc[:n]] == size
        if behind:
            good &= (np.arange(n) == first[doc[:n]]) & (kinds[:n] == NAME)
        held = slots[size:] - slots[:n]
        usable = (2 * held <= size) & (size >= LEAST)
        for codes, some in ((plain, good), (code, good & usable & (held > 0))):
            h = window_hashes(codes, size)
            if mask is not None:
                some = some & bits.holds(mask, h)
            for p in np.flatnonzero(some).tolist():
                values = [] if codes is plain else [
                    EDGES.sub("", raw[kept[q]]).translate(UPPER) for q in range(p, p + size) if kinds[q] != LITERAL]
                out.append((int(doc[p]), size, int(h[p].astype(np.int64)), p - int(first[doc[p]]), values,
                            bool(usable[p]) and not behind))
    return out


def window_rows(df: DataFrame, ident: str, text: str, name: str, sizes=None, mask=None) -> DataFrame:
    """The rows of ``windows``: ``row`` id, ident, size, hash, position, slot values, usable."""
    schema = T.StructType([
        T.StructField(f"{name}_row", T.LongType()), T.StructField(name, df.schema[ident].dataType),
        T.StructField("size", T.IntegerType()), T.StructField("hash", T.LongType()),
        T.StructField(f"{name}_at", T.LongType()), T.StructField(f"{name}_slots", T.ArrayType(T.StringType())),
        T.StructField(f"{name}_usable", T.BooleanType())])

    def run(batches):
        words = Words()
        for batch in batches:
            for part in slices(batch, 2):
                texts = [t or "" for t in part.column(2).to_pylist()]
                found = windows(words, texts, sizes and [s for s in sizes if s > 0], mask)
                found += forms(words, texts, sizes and [s for s in sizes if s < 0], mask)
                if not found:
                    continue
                at, size, h, pos, values, usable = zip(*found)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(size, pa.int32()),
                     pa.array(h, pa.int64()), pa.array(pos, pa.int64()),
                     pa.array(values, pa.list_(pa.string())), pa.array(usable, pa.bool_())], names=schema.names)

    source = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{ident}`").alias("ident"),
                       F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(run, schema)


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str,
          share: float = SHARE) -> DataFrame:
    """Rows (doc_row, doc, item, windows, matched, coverage, slots_changed), one per document
    and item it leaks; ``doc_row`` is the document's monotonically_increasing_id."""
    known = staged(window_rows(items, item_id, item_text, "item"), "leak-items")
    sizes = [r.size for r in known.select("size").distinct().collect()]    # at most SIZE values
    mask = bits.build(known, F.col("hash"))
    found = window_rows(docs, doc_id, text, "doc", sizes, mask)
    total = known.groupBy("item_row").agg(
        F.countDistinct(F.when(F.col("item_at") >= 0, F.col("item_at"))).alias("all"),
        F.collect_set(F.when(F.col("item_usable"), F.col("item_at"))).alias("usable"))
    pairs = found.join(known, ["size", "hash"])
    differs = F.col("item_slots") != F.col("doc_slots")
    aligned = (pairs.groupBy("doc_row", "doc", "item_row", "item", (F.col("doc_at") - F.col("item_at")).alias("shift"),
                             differs.alias("differs"))
               .agg(F.collect_set("item_at").alias("places"),
                    F.array_distinct(F.flatten(F.collect_set(F.arrays_zip(
                        F.col("item_slots").alias("a"), F.col("doc_slots").alias("b"))))).alias("slots")))
    one_value = F.size(F.array_distinct(F.transform("slots", lambda s: s["a"]))) == F.size("slots")
    covered = (aligned.where(~F.col("differs") | one_value)
               .groupBy("doc_row", "doc", "item_row", "item")
               .agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
                    F.max(F.exists("slots", lambda s: s["a"] != s["b"])).alias("slots_changed")))
    # of the usable windows or of all positions, whichever are covered better
    in_windows = F.size(F.filter("places", lambda p: p >= 0))
    of_all = F.struct((in_windows / F.col("all")).alias("coverage"), F.col("all").alias("windows"),
                      in_windows.cast("long").alias("matched"))
    of_usable = F.size(F.array_intersect("places", "usable"))
    of_usable = F.when(F.size("usable") > 0, F.struct(
        (of_usable / F.size("usable")).alias("coverage"), F.size("usable").cast("long").alias("windows"),
        of_usable.cast("long").alias("matched")))
    return (covered.join(total, "item_row")
            .withColumn("best", F.greatest(of_all, of_usable))
            .select("doc_row", "doc", "item", "best.*", "slots_changed")
            .where(F.col("coverage") >= share)
            .select("doc_row", "doc", "item", "windows", "matched", "coverage", "slots_changed"))


def clean(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    held = [f"__dc{i}" for i in range(len(docs.columns))]
    at = {c: h for c, h in zip(docs.columns, held)}
    # a document is known by a digest of its id and text, which every reading gives alike: equal rows
    # get equal verdicts, and how the table is cut into splits, which may change between readings, does not matter
    ident = F.coalesce(F.concat(F.lit("="), F.col(at[doc_id]).cast("string")), F.lit(""))
    named = docs.toDF(*held).withColumn("__dc_key", F.md5(F.concat(
        ident, F.lit("\0"), F.coalesce(F.col(at[text]), F.lit("")))))
    bad = staged(leaks(named, "__dc_key", at[text], items, item_id, item_text)
                 .select(F.col("doc").alias("__dc_key")).distinct(), "leak-docs")
    return named.join(bad, "__dc_key", "left_anti").select(*[F.col(h).alias(c) for h, c in zip(held, docs.columns)])
