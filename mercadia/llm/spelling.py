"""Spelling variant grouping: words of a corpus one edit apart, and the root of each.

Words are counted in the tasks (one bounded dictionary each, summed by Spark).
Two words are near when one inserted, deleted or replaced code point turns one
into the other, which is so exactly when common prefix and common suffix
together reach the longer length minus one. That is tested on padded code-point
matrices, one aligned left and one aligned right, for all pairs of words that lie in
one *tile*.

A tile is a window [a, b) of positions where the edit lies: its words agree on the
first ``a`` and on the last ``L - b`` code points, L being the length of the shorter
word of a pair. The windows of one L cut [0, L] into parts and the edit counts at
the end of the common prefix, so every near pair is in exactly one tile, and each
word needs one row per window and not one per other word. Tiles of more
than ``TILE`` words are halved, window by window, until they are small or the window
is one position wide; then at most the square of the alphabet's size can share it.
No pair leaves its task: a tile hands on, for each word, how many
near words it has there and the most frequent of them.

Defined cases: null and empty texts have no words; a null id counts as ''; a text
longer than ``SLICE`` is cut between words; rows that repeat an id add up; equal
counts give the smallest word in code-point order; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercadia.llm.common import staged, width

RUN = re.compile("[A-Za-zÀ-ÿ]+")
GAP = re.compile("[^A-Za-zÀ-ÿ]")
#: Code points of a text that are looked at together.
SLICE = 1 << 20
#: Distinct words a task holds before it hands its counts on.
HELD = 400_000
#: Words of a tile that are compared all with all.
TILE = 128
#: Pairs times code points compared at once.
CELLS = 4 << 20
#: A variant's form is at least so many times as frequent; chains of forms are thus
#: at most 27 long (5 ** 27.5 > 2 ** 63), and five doublings reach their ends.
RATIO = 5
DOUBLINGS = 5


# -- words and their counts ------------------------------------------------------

def _runs(text: str) -> Iterator[list[str]]:
    """Runs of letters, ASCII-lower-cased; long texts in slices cut between runs."""
    at = 0
    while at < len(text):
        cut = GAP.search(text, at + SLICE) if len(text) - at > SLICE else None
        end = cut.start() if cut else len(text)
        # bytes.lower() changes A-Z alone
        yield RUN.findall(text[at:end].encode("utf-8").lower().decode("utf-8"))
        at = end


def _counter(drop_every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def hand_on():
            words = [w for w in held if w]
            out = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])
            held.clear()
            for k in range(0, out.num_rows, 50_000):
                yield out.slice(k, 50_000)

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                if not text:
                    continue
                seen: Counter = Counter()
                for words in _runs(text):
                    seen.update(words)
                start = zlib.crc32(f"{ids[k].as_py() or ''}:".encode())
                for w, n in seen.items():
                    if drop_every:
                        h = zlib.crc32(w.encode(), start)
                        if h % drop_every == 0:
                            h %= len(w)
                            w = w[:h] + w[h + 1:]
                    held[w] = held.get(w, 0) + n
                if len(held) > HELD:
                    yield from hand_on()
        yield from hand_on()
    return run


def word_counts(docs: DataFrame, id_col: str, text: str, least_length: int = 6, least_n: int = 5,
                drop_every: int = 0) -> DataFrame:
    """``word``, ``n``: the words of all texts with their number of occurrences.

    ``drop_every`` plants misspellings: where it divides the crc32 of
    ``<id>:<word>``, the code point at that crc32 modulo the word's length is deleted.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text}`").cast("string"))
    counted = rows.mapInArrow(_counter(drop_every), "word string, n long")
    return (counted.where(F.length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least_n))


# -- tiles ---------------------------------------------------------------------------

KEY = ["short", "a", "b", "tile"]


def _halves(rows: DataFrame) -> DataFrame:
    """Each word twice, in the tiles of both halves of its window [a, b).

    Equal hashes of different tiles only add words to compare.
    """
    half = F.expr("(a + b) div 2").cast("int")
    parts = F.explode(F.array(F.struct("a", half.alias("b")), F.struct(half.alias("a"), F.col("b"))))
    rows = rows.select("word", "n", "short", parts.alias("part")).select("word", "n", "short", "part.a", "part.b")
    tail = F.expr("CASE WHEN short > b THEN right(word, short - b) ELSE '' END")
    return rows.withColumn("tile", F.xxhash64(F.expr("substring(word, 1, a)"), tail))


def tiles(words: DataFrame, most: int = TILE) -> DataFrame:
    """``word``, ``n`` by tile (``KEY``), tiles of one word left out."""
    pairs_as = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("short")
    rows = _halves(words.select("word", "n", pairs_as).where("short > 0")
                   .withColumns({"a": F.lit(0), "b": F.col("short")}))
    done = None
    while True:     # as many rounds as a window of the longest crowded word has halvings
        size = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sized = staged(rows.join(size, KEY).withColumn(
            "crowded", (F.col("size") > most) & (F.col("b") - F.col("a") > 1)).drop("size"), "sp-tiles")
        fine = sized.where("not crowded").drop("crowded")
        done = fine if done is None else done.unionByName(fine)
        crowded = sized.where("crowded").drop("crowded")
        if crowded.isEmpty():
            return done
        rows = _halves(crowded.drop("tile"))


# -- near words -----------------------------------------------------------------------

def _matrix(words: list[str], size: int) -> np.ndarray:
    """Code points of the words, a row each, padded on the right with 0."""
    points = np.array(words, f"<U{size}").view(np.uint32).reshape(len(words), size)
    return points.astype(np.uint8) if points.max(initial=0) < 256 else points


def _pairs(starts: np.ndarray, sizes: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of the pairs number ``first`` to ``last`` of all tiles, a tile's n(n-1)/2 pairs in a row."""
    count = sizes * (sizes - 1) // 2
    ends = np.cumsum(count)
    k = np.arange(first, last, dtype=np.int64)
    tile = np.searchsorted(ends, k, side="right")
    k -= ends[tile] - count[tile]
    right = ((1 + np.sqrt(8.0 * k + 1)) / 2).astype(np.int64)
    right -= right * (right - 1) // 2 > k      # the square root may be off by one
    right += right * (right + 1) // 2 <= k
    return starts[tile] + k - right * (right - 1) // 2, starts[tile] + right


def _near(words: list[str], n: np.ndarray, short: np.ndarray, a: np.ndarray, b: np.ndarray,
          starts: np.ndarray, sizes: np.ndarray):
    """For each row with a near word in its tile: row, number of near words, row of the best of them."""
    size = max(map(len, words))
    left, right = _matrix(words, size), _matrix([w[::-1] for w in words], size)
    long = np.fromiter(map(len, words), np.int64, len(words))
    total = int((sizes * (sizes - 1) // 2).sum())
    step = max(1, CELLS // size)
    found = []
    for k in range(0, total, step):
        i, j = _pairs(starts, sizes, k, min(total, k + step))
        one = (long[i] == short[i]) | (long[j] == short[j])     # else a pair of the next length's tiles
        i, j = i[one], j[one]
        prefix = (left[i] != left[j]).argmax(axis=1)            # words differ, so there is a place
        suffix = (right[i] != right[j]).argmax(axis=1)
        at = np.minimum(prefix, short[i] - 1)                   # an added last code point counts to the last window
        near = (prefix + suffix >= np.maximum(long[i], long[j]) - 1) & (a[i] <= at) & (at < b[i])
        found.append(np.stack([i[near], j[near]]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    i, j = np.concatenate(found, axis=1)
    of, other = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.argsort(np.array(words, f"<U{size}"), kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    by = np.lexsort((rank[other], -n[other], of))
    of, other = of[by], other[by]
    rows, first, count = np.unique(of, return_index=True, return_counts=True)
    return rows, count, other[first]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of each row within its tile; tiles come whole and one after the other.

    A tile's last rows may be in the next batch, so the last tile of a batch waits.
    """
    held = None
    for batch in _then_none(batches):
        if batch is None:
            table = held
        else:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
        if table is None or not table.num_rows:
            continue
        key = np.stack([table.column(c).to_numpy() for c in KEY])
        new = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
        cut = table.num_rows if batch is None else int(new[-1])
        held = table.slice(cut)
        starts = new[new < cut]
        sizes = np.diff(np.append(starts, cut))
        if not cut:
            continue
        words, n = table.column("word").slice(0, cut).to_pylist(), table.column("n").to_numpy()[:cut]
        rows, count, best = _near(words, n, key[0][:cut], key[1][:cut], key[2][:cut], starts, sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array([words[r] for r in rows.tolist()], pa.string()), pa.array(count.astype(np.int64)),
             pa.array(n[best].astype(np.int64)), pa.array([words[r] for r in best.tolist()], pa.string())],
            ["word", "n_near", "best_n", "best"])


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_words(words: DataFrame, most: int = TILE) -> DataFrame:
    """For each word that has near words: their number, the most frequent one (ties: the
    smallest) and its count. ``words`` has one row a word."""
    rows = (tiles(words, most).select("word", "n", *KEY)
            .repartition(width(words.sparkSession), *KEY).sortWithinPartitions(*KEY))
    found = rows.mapInArrow(_compared, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best")))


# -- forms and roots --------------------------------------------------------------------

def variants(words: DataFrame, most: int = TILE, ratio: int = RATIO) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for each row of
    ``words`` (``word`` unique, ``n``).

    A word's form is its most frequent near word when that is at least ``ratio``
    times as frequent; its root is where following forms ends.
    """
    words = staged(words.select("word", "n"), "sp-words")
    fits = F.col("best_n") >= ratio * F.col("n")
    out = staged(words.join(near_words(words, most), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")), "sp-forms")
    moves = out.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        then = moves.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = moves.join(then, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        further = staged(further, "sp-roots")
        moves = further.drop("moved")
        if further.where("moved").isEmpty():
            break
    return out.join(moves, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
