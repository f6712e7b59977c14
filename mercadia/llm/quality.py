"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few whole-text measures (``NAMES``). Training bins every
measure at quantiles and boosts shallow trees in a cycle over the measures, one
at a time, so that each measure ends up with one lookup table (its bins'
summed leaf values); the pairs whose joint table would still lower the loss most
are then boosted the same way with trees that split on both measures. A score is
the logistic of the intercept plus one table entry per measure and pair.

The tables are fitted with numpy on the driver on at most ``most`` labelled rows,
the ones with the smallest hash of their id (the documented bound of the fit).

Defined cases: a null text counts as empty and is scored like any other; null
labels are not learned from, of several labels of one id the smallest counts;
with no label, or one class only, the score is the smoothed share of label 1;
rows that repeat are scored each; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercadia.llm.common import aside
from mercadia.llm.tokens import slices

NAMES = ["log_chars", "upper", "digits", "symbols", "exclaims", "bars", "stops", "blanks", "newlines",
         "non_ascii", "word_length", "short_words", "distinct_words", "distinct_pairs", "distinct_lines"]
BINS = 32
COARSE = 8
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 60, 8
RATE, RIDGE = 0.1, 1.0

# byte classes: 0 other letter byte, 1 upper, 2 digit, 3 symbol, 4 !?, 5 |, 6 .,;:, 7 space, 8 newline,
# 9 lower, 10 first byte of a longer character, 11 its further bytes
CLASS = np.full(256, 3, np.int64)
CLASS[65:91], CLASS[97:123], CLASS[48:58] = 1, 9, 2
for _c in "!?":
    CLASS[ord(_c)] = 4
CLASS[ord("|")] = 5
for _c in ".,;:":
    CLASS[ord(_c)] = 6
for _c in " \t\r\x0b\x0c":
    CLASS[ord(_c)] = 7
CLASS[10] = 8
CLASS[128:192], CLASS[192:] = 11, 10


def features(texts: list[str]) -> np.ndarray:
    data = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    raw = np.frombuffer(b"".join(data), np.uint8)
    doc = np.repeat(np.arange(len(data)) * 12, sizes)
    n = np.bincount(doc + CLASS[raw], minlength=12 * len(data)).reshape(len(data), 12).astype(np.float64)
    chars = n.sum(axis=1) - n[:, 11]
    letters = n[:, 1] + n[:, 9] + n[:, 10]
    out = np.zeros((len(data), len(NAMES)))
    out[:, 0] = np.log1p(chars)
    out[:, 1] = n[:, 1] / np.maximum(letters, 1)
    for k, c in ((2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8), (9, 10)):
        out[:, k] = n[:, c] / np.maximum(chars, 1)
    for k, text in enumerate(texts):
        words = text.split()
        lines = text.split("\n")
        many = max(1, len(words))
        sizes_ = np.fromiter(map(len, words), np.int64, len(words))
        out[k, 10] = sizes_.sum() / many
        out[k, 11] = (sizes_ <= 3).sum() / many
        out[k, 12] = len(set(words)) / many
        out[k, 13] = len(set(zip(words, words[1:]))) / many
        out[k, 14] = len(set(lines)) / len(lines)
    return out


@dataclass
class Model:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: np.ndarray | None = None                # measure x bin
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: np.ndarray | None = None           # pair x bin x bin

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.intercept)
        for k in range(bins.shape[1]):
            total += self.tables[k][bins[:, k]]
        for p, (a, b) in enumerate(self.pairs):
            total += self.pair_tables[p][bins[:, a], bins[:, b]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.full(len(x), 1 / (1 + np.exp(-self.intercept)))
        return 1 / (1 + np.exp(-self.raw(self.bins(x))))


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of ordered bins with gradient and curvature sums."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl ** 2 / (hl + RIDGE) + (g.sum() - gl) ** 2 / (h.sum() - hl + RIDGE)
    if not len(gain):
        return 0.0, 0
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return RATE * g.sum() / (h.sum() + RIDGE)


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two over the bins of one measure, as a table."""
    out = np.zeros(len(g))
    _, at = _cut(g, h)
    for a, b in ((0, at), (at, len(g))):
        if b - a > 1:
            _, inner = _cut(g[a:b], h[a:b])
            out[a:a + inner] = _leaf(g[a:a + inner], h[a:a + inner])
            out[a + inner:b] = _leaf(g[a + inner:b], h[a + inner:b])
        elif b > a:
            out[a:b] = _leaf(g[a:b], h[a:b])
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The better tree that splits on one measure, then each side on the other."""
    best, most = np.zeros_like(g), -1.0
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        _, at = _cut(gg.sum(axis=1), hh.sum(axis=1))
        table, gain = np.zeros_like(gg), 0.0
        for rows in (slice(0, at), slice(at, None)):
            gs, hs = gg[rows].sum(axis=0), hh[rows].sum(axis=0)
            side, inner = _cut(gs, hs)
            gain += side
            table[rows, :inner] = _leaf(gs[:inner], hs[:inner])
            table[rows, inner:] = _leaf(gs[inner:], hs[inner:])
        if gain > most:
            best, most = (table.T if flip else table), gain
    return best, most


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    model = Model()
    ones = float(y.sum()) if len(y) else 0.0
    share = (ones + 0.5) / (len(y) + 1.0)
    model.intercept = float(np.log(share / (1 - share)))
    if not 0 < ones < len(y):
        return model
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    model.edges = [np.unique(np.quantile(x[:, k], quantiles)) for k in range(x.shape[1])]
    bins = model.bins(x)
    model.tables = np.zeros((x.shape[1], BINS))
    raw = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(x.shape[1]):
            g, h = slopes()
            table = shallow_tree(np.bincount(bins[:, k], g, BINS), np.bincount(bins[:, k], h, BINS))
            model.tables[k] += table
            raw += table[bins[:, k]]
    g, h = slopes()
    width = BINS // COARSE
    gains = []
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            cell = (bins[:, a] // width) * COARSE + bins[:, b] // width
            grid = [np.bincount(cell, v, COARSE * COARSE).reshape(COARSE, COARSE) for v in (g, h)]
            gains.append((-pair_tree(*grid)[1], a, b))
    model.pairs = [(a, b) for _, a, b in sorted(gains)[:PAIRS]]
    model.pair_tables = np.zeros((len(model.pairs), BINS, BINS))
    for _ in range(PAIR_ROUNDS):
        for p, (a, b) in enumerate(model.pairs):
            g, h = slopes()
            cell = bins[:, a] * BINS + bins[:, b]
            grid = [np.bincount(cell, v, BINS * BINS).reshape(BINS, BINS) for v in (g, h)]
            table, _ = pair_tree(*grid)
            model.pair_tables[p] += table
            raw += table[bins[:, a], bins[:, b]]
    return model


def train(df: DataFrame, doc_id: str, text: str, labels: DataFrame, label_id: str, label: str,
          rows: Column, most: int = 20_000) -> Model:
    """The model of at most ``most`` labelled rows; ``rows`` is a condition on ``label_id``."""
    chosen = (labels.where(rows & F.col(label).isNotNull() & F.col(label_id).isNotNull())
              .groupBy(F.col(label_id).alias("doc_id")).agg(F.min(label).cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    source = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 0):
                x = features(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["label", "x"])

    # ``most`` rows at most
    found = (source.join(F.broadcast(chosen), "doc_id").select("text", "label")
             .mapInArrow(run, "label int, x array<double>").limit(most).collect())
    found.sort(key=lambda r: (r.x, r.label))
    return fit(np.array([r.x for r in found]).reshape(len(found), len(NAMES)),
               np.array([r.label for r in found], np.float64))


def score(df: DataFrame, text: str, model: Model, score_out: str = "score", drop_text: bool = False) -> DataFrame:
    """``df`` with the probability of label 1; an input column of that name gets a trailing underscore."""
    df = aside(df, [score_out], keep=[text])
    rest = [c for c in df.columns if not (drop_text and c == text)]
    source = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias("__q_text"))
    schema = T.StructType([*[df.schema[c] for c in rest], T.StructField(score_out, T.DoubleType(), False)])

    def run(batches):
        for batch in batches:
            for part in slices(batch, len(rest)):
                x = features([t or "" for t in part.column(len(rest)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(model.score(x))],
                                                 names=schema.names)

    return source.mapInArrow(run, schema)
