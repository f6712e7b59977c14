"""Token ids in word-aligned Simple-8b files.

A 64-bit word holds a 4-bit selector and as many ids of one bit width as fit in
the other 60 (``SELECTORS``); an id of 2^60 or more is an escape: its word holds
an index into the document's list of raw 64-bit values. Every document starts at
a word border. Documents go, in ascending id order, into blocks of about
``BLOCK_WORDS`` words; a block lists its documents' ids, id counts and word
offsets, so any document is decoded without the ones before it and a whole block
with a few numpy operations. A file is a sequence of blocks, each followed by
``MARK``; a block's body is xor-ed with the first byte value for which it does
not hold ``MARK``, so files can be split and read in parallel at the marks.

Files are written and read by Spark's text source, byte for byte, so they can be
on any store that Spark reaches. File ``part-NNNNN`` holds the N-th range of ids.

Defined cases: a null text counts as empty and has the end id alone; a null doc
id sorts first; rows that repeat an id are all written, ordered by a hash
of the text; an empty table gives no block and reads back as an empty table. Only the
two named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercadia.llm.byte_bpe import byte_chars
from mercadia.llm.common import staged, width
from mercadia.llm.tokens import PieceIds, slices

#: (ids per word, bits per id) by selector; selector 0 is the escape.
SELECTORS = [(1, 60), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10),
             (5, 12), (4, 15), (3, 20), (2, 30), (1, 60), (240, 0)]
COUNT = np.array([c for c, _ in SELECTORS], np.int64)
BITS = np.array([b for _, b in SELECTORS], np.int64)
POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)
SMALL_BITS = np.searchsorted(POWERS, np.arange(1 << 16, dtype=np.uint64), "right").astype(np.uint8)
#: Tried in this order: most ids first.
BY_COUNT = sorted(range(1, 16), key=lambda s: -SELECTORS[s][0])
MARK = "<<simple-8b block end>>"
MAGIC = b"S8B1"
BLOCK_WORDS = 1 << 16
CACHE_PIECES = 800_000


def pack(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of every run of ``counts`` values, words per run, escaped values, escapes per run."""
    values = values.astype(np.uint64)
    size = len(values)
    ends = np.repeat(np.cumsum(counts), counts)
    at = np.arange(size, dtype=np.int64)
    choice = np.zeros(size, np.int8)
    step = np.ones(size, np.int64)
    open_ = np.ones(size, bool)
    most = int(values.max()) if size else 0
    need = SMALL_BITS[values] if most < len(SMALL_BITS) else np.searchsorted(POWERS, values, "right").astype(np.uint8)
    for s in BY_COUNT:
        many, bits = SELECTORS[s]
        if most >> bits == 0:       # every value fits: this selector takes all that is left
            low = np.flatnonzero(open_)
            reach = np.minimum(low + many, ends[low])
            choice[low], step[low] = s, reach - low
            open_[low] = False
            break
        low = np.flatnonzero(open_ & (need <= bits))
        if not len(low):
            continue
        # the first place behind each that is decided or too large for the selector
        last = np.flatnonzero(np.append(np.diff(low) != 1, True))
        stop = np.repeat(low[last] + 1, np.diff(last, prepend=-1))
        reach = np.minimum(low + many, ends[low])
        fits = stop >= reach
        low, reach = low[fits], reach[fits]
        choice[low] = s
        step[low] = reach - low
        open_[low] = False
    follow = (at + step).tolist()
    starts, p = [], 0
    while p < size:
        starts.append(p)
        p = follow[p]
    starts = np.array(starts, np.int64)
    used = choice[starts] if size else np.zeros(0, np.int8)
    words = used.astype(np.uint64)
    run_ends = np.cumsum(counts)
    run_of = np.searchsorted(run_ends, starts, "right")
    padded = np.concatenate([values, np.zeros(240, np.uint64)])
    for s in np.unique(used):
        many, bits = SELECTORS[s]
        if s == 0 or bits == 0:
            continue
        where = np.flatnonzero(used == s)
        column = np.arange(many, dtype=np.int64)
        ids = padded[starts[where][:, None] + column]
        ids[column >= step[starts[where]][:, None]] = 0
        words[where] |= np.bitwise_or.reduce(ids << (4 + column * bits).astype(np.uint64), axis=1)
    escapes = np.flatnonzero(used == 0)
    per_run = np.bincount(run_of[escapes], minlength=len(counts))
    first = np.cumsum(per_run) - per_run
    words[escapes] |= (np.arange(len(escapes)) - first[run_of[escapes]]).astype(np.uint64) << np.uint64(4)
    return words, np.bincount(run_of, minlength=len(counts)), values[starts[escapes]], per_run


def unpack(words: np.ndarray, per_run: np.ndarray, counts: np.ndarray,
           escapes: np.ndarray, escapes_per_run: np.ndarray) -> np.ndarray:
    """The values of all runs; the inverse of :func:`pack`."""
    selector = (words & np.uint64(15)).astype(np.int64)
    full = COUNT[selector]
    run_of = np.repeat(np.arange(len(per_run)), per_run)
    before = np.cumsum(full) - full
    edge = np.cumsum(per_run) - per_run
    first = before[edge[run_of]] if len(words) else before
    out_start = np.cumsum(counts) - counts
    inside = before - first
    take = np.minimum(full, counts[run_of] - inside)
    to = out_start[run_of] + inside
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(selector):
        many, bits = SELECTORS[s]
        if bits == 0:
            continue
        where = np.flatnonzero(selector == s)
        if s == 0:
            base = np.cumsum(escapes_per_run) - escapes_per_run
            out[to[where]] = escapes[base[run_of[where]] + (words[where] >> np.uint64(4)).astype(np.int64)]
            continue
        column = np.arange(many, dtype=np.int64)
        ids = (words[where][:, None] >> (4 + column * bits).astype(np.uint64)) & np.uint64((1 << bits) - 1)
        valid = column < take[where][:, None]
        out[(to[where][:, None] + column)[valid]] = ids[valid]
    return out


def block(seq: int, start: int, ids: list, counts, words: list[bytes], escapes: list[bytes]) -> bytes:
    """One block: header, then per document id, null flag, id count, words and escapes."""
    n = len(ids)
    body = b"".join([
        np.array([seq, start, n], "<i8").tobytes(),
        np.array([0 if i is None else i for i in ids], "<i8").tobytes(),
        np.array([i is None for i in ids], np.uint8).tobytes(),
        np.array(counts, "<u4").tobytes(),
        np.cumsum([0, *[len(w) // 8 for w in words]]).astype("<u4").tobytes(),
        np.array([len(e) // 8 for e in escapes], "<u4").tobytes(),
        *words, *escapes])
    mark, raw = MARK.encode(), np.frombuffer(body, np.uint8)
    for key in range(256):
        masked = (raw ^ np.uint8(key)).tobytes() if key else body
        if mark not in masked:
            return MAGIC + bytes([key]) + masked
    raise ValueError("every mask gives the mark")


def parse(data: bytes):
    """Sequence number, ids before the block, doc ids (None: null), counts, flat ids."""
    if data[:4] != MAGIC:
        raise ValueError("not a block")
    body = (np.frombuffer(data, np.uint8, offset=5) ^ np.uint8(data[4])).tobytes()
    seq, start, n = np.frombuffer(body, "<i8", 3).tolist()
    at = 24
    ids = np.frombuffer(body, "<i8", n, at)
    null = np.frombuffer(body, np.uint8, n, at + 8 * n)
    at += 9 * n
    counts = np.frombuffer(body, "<u4", n, at).astype(np.int64)
    offsets = np.frombuffer(body, "<u4", n + 1, at + 4 * n).astype(np.int64)
    escapes = np.frombuffer(body, "<u4", n, at + 8 * n + 4).astype(np.int64)
    at += 12 * n + 4
    words = np.frombuffer(body, "<u8", int(offsets[-1]), at)
    raw = np.frombuffer(body, "<u8", int(escapes.sum()), at + 8 * int(offsets[-1]))
    flat = unpack(words, np.diff(offsets), counts, raw, escapes)
    return seq, start, [None if z else int(i) for i, z in zip(ids, null)], counts, flat


# Python's str.split also cuts at these, which are not white space to the tokenizers.
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACES = re.compile("[ \n\t]+")


# Up to here NFC changes nothing and lower case is one rule; no special token starts so.
PLAIN = re.compile("[^\0-\x1b\x20-\u024f]|<")


class WordTokens:
    """Ids of whole texts from the tokenizers library; white space always ends a
    pre-token, so texts are cut there and each distinct piece is encoded once.
    Lower-case words of plain letters are one pre-token each and go straight to
    the library's model; all else takes its whole path."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.to_chars = str.maketrans({b: c for c, b in byte_chars().items()})
        self.ends = {end: self._word(end) for end in ",."}
        self.cache = PieceIds(self._pieces, CACHE_PIECES)

    def _word(self, word: str) -> list[int]:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.to_chars)
        return [t.id for t in self.model.tokenize(word)]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found: list[list[int] | None] = [None] * len(pieces)
        rest = []
        for k, piece in enumerate(pieces):
            end = piece[-1]
            if end == "," or end == ".":
                word, ids = piece[:-1], self.ends[end]
            else:
                word, ids = piece, []
            if word.isalpha() and word.islower() and (word.isascii() or not PLAIN.search(word)):
                found[k] = self._word(word) + ids
            else:
                rest.append(k)
        if rest:
            flat, counts = self._whole([pieces[k] for k in rest])
            for k, ids in zip(rest, np.split(flat, np.cumsum(counts)[:-1])):
                found[k] = ids.tolist()
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())), counts

    def _whole(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = self.tokenizer.encode(" ".join(pieces), add_special_tokens=False)
        begin = np.fromiter((a for a, _ in out.offsets), np.int64, len(out.ids))
        starts = np.cumsum(sizes + 1) - sizes - 1
        counts = np.bincount(np.searchsorted(starts, begin, "right") - 1, minlength=len(pieces))
        return np.array(out.ids, np.int32), counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces: list[str] = []
        sizes = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if not PLAIN.search(text):
                found = text.lower().split()
            elif SEPARATORS.search(text):
                found = [p for p in SPACES.split(text) if p]
            else:
                found = text.split()
            pieces += found
            sizes[k] = len(found)
        return self.cache.ids(pieces, sizes)


@lru_cache(maxsize=4)
def load(path: str) -> WordTokens:
    return WordTokens(path)


def binary(values: np.ndarray, per_row: np.ndarray, size: int = 8) -> pa.Array:
    edges = (np.concatenate([[0], np.cumsum(per_row)]) * size).astype(np.int64)
    data = np.ascontiguousarray(values).view(np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(per_row),
                                 [None, pa.py_buffer(edges), pa.py_buffer(data)]).cast(pa.binary())


def write(df: DataFrame, doc_id: str, text: str, path: str, folder: str, end_id: int) -> None:
    """Encode every text, append ``end_id`` and write the files of ``folder`` in id order.

    The texts are range-partitioned and sorted before they are encoded, so the
    sample for the ranges reads ids only and every text is encoded once.
    """
    spark = df.sparkSession

    def blocks(batches):
        tokens = load(path)
        seq = start = held = 0
        rows: list[tuple] = []

        def flush():
            nonlocal seq, start, held, rows
            ids, counts, words, escapes = zip(*rows)
            out = block(seq, start, list(ids), counts, list(words), list(escapes))
            seq, start, held, rows = seq + 1, start + sum(counts), 0, []
            return pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], names=["block"])

        for batch in batches:
            for part in slices(batch, 1):
                flat, counts = tokens.encode([t or "" for t in part.column(1).to_pylist()])
                flat = np.insert(flat.astype(np.int64), np.cumsum(counts), end_id)
                counts = counts + 1
                words, per_doc, raw, raw_per_doc = pack(flat, counts)
                for row in zip(part.column(0).to_pylist(), counts.tolist(), binary(words, per_doc).to_pylist(),
                               binary(raw, raw_per_doc).to_pylist()):
                    rows.append(row)
                    held += len(row[2]) // 8
                    if held >= BLOCK_WORDS:
                        yield flush()
        if rows:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("text").asc()]
    (df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
     .repartitionByRange(width(spark), *order[:2]).sortWithinPartitions(*order)
     .mapInArrow(blocks, "block binary")
     .select(F.col("block").cast("string").alias("value"))
     .write.option("lineSep", MARK).text(folder))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (file, seq, pos, doc_id, before, n_tokens, ids_le) of the files' documents;
    ``before``: ids before the document in its file; ``ids_le``: little-endian uint32s."""
    found = spark.read.option("lineSep", MARK).text(folder).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias("file"),
        F.col("value").cast("binary").alias("block"))

    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                seq, start, ids, counts, flat = parse(data.as_py())
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, file), pa.int32()), pa.array(np.full(n, seq), pa.int64()),
                     pa.array(np.arange(n), pa.int64()), pa.array(ids, pa.int64()),
                     pa.array(start + np.cumsum(counts) - counts, pa.int64()), pa.array(counts, pa.int64()),
                     binary(flat.astype("<u4"), counts, 4)],
                    names=["file", "seq", "pos", "doc_id", "before", "n_tokens", "ids_le"])

    return found.mapInArrow(run, "file int, seq long, pos long, doc_id long, before long, "
                                 "n_tokens long, ids_le binary")


def index(docs: DataFrame) -> DataFrame:
    """Rows of :func:`read` (any columns beside file, before and n_tokens) with
    ``start``, the ids of all documents before; the files' sizes are one row each."""
    docs = staged(docs, "token-index")
    sizes = docs.groupBy("file").agg(F.sum("n_tokens").alias("size"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    return docs.join(F.broadcast(offsets), "file").withColumn("start", F.col("offset") + F.col("before"))
