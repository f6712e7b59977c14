"""Language identification in two steps: family first, then one-versus-one.

Texts become hashed letter bigram and trigram frequencies (square root, unit
length) over the whole text. Linear support vector machines, trained with numpy
on the driver, first tell language families apart (one machine per family
against the rest); within the winning family one machine per pair of languages
votes. A language that the table of families does not know is a family itself.

The machines are fitted on at most ``per_lang`` rows a language and ``most`` rows
in all, the same number for every language (see :func:`train`), the ones with the smallest
hash of their id: a bounded sample (the documented bound of the fit); every row is
scored, on its whole text.

Defined cases: a text that is null or has no letter (``str.isalpha``) is ``und`` with score 0; so
is every text when there is no row to learn from; with one language, that one is
predicted; ties go to the language that sorts first; rows that repeat are scored
each; an empty table gives an empty table. Other columns are carried through.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercadia.llm.common import aside
from mercadia.llm.tokens import slices

# Common languages by family (ISO 639-1 codes).
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca"],
    "slavic": ["ru", "uk", "pl", "cs", "bg", "sr"],
}
BUCKETS = 2048
UND = "und"
#: Steepness of the logistic curve that turns margins into scores.
STEEP = 4.0
#: Texts whose n-grams are counted at once, in several arrays of 16 KiB a text.
ROWS = 128


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(texts: list[str]) -> np.ndarray:
    """Unit-length hashed n-gram vectors, a row per text."""
    out = np.empty((len(texts), BUCKETS), np.float32)
    for k in range(0, len(texts), ROWS):
        out[k:k + ROWS] = _counted(texts[k:k + ROWS])
    return out


def _counted(texts: list[str]) -> np.ndarray:
    data = [t.lower().encode("utf-8", "replace") for t in texts]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    raw = np.frombuffer(b"".join(data), np.uint8)
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    code = np.where(letter, raw, 32).astype(np.uint32)
    doc = np.repeat(np.arange(len(data)), sizes)
    out = np.zeros(len(data) * BUCKETS, np.float64)
    for n in (2, 3):
        if len(code) < n:
            continue
        gram = np.full(len(code) - n + 1, n, np.uint32)
        for k in range(n):
            gram = gram * np.uint32(0x9E3779B1) + code[k:len(code) - n + 1 + k]
        bucket = (gram * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 11)
        start = doc[:len(gram)]
        whole = start == doc[n - 1:]
        out += np.bincount((start * BUCKETS + bucket)[whole], minlength=len(out))
    out = np.sqrt(out.reshape(len(data), BUCKETS))
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights (bias last) of a linear machine with squared hinge loss; y is +-1.

    Classes weigh the same however many rows they have. Accelerated gradient steps.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    ahead = w
    rate = 1.0 / (2 * 2.0 + penalty)        # rows have norm sqrt(2) with the bias
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - rate * (penalty * ahead - 2 * x.T @ (weight * slack * y))
        ahead = new + (k / (k + 3)) * (new - w)
        w = new
    return w


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    members: list[list[str]] = field(default_factory=list)
    family_w: np.ndarray | None = None
    #: family -> {(a, b): weights}; positive margins speak for member a
    pair_w: dict[int, dict[tuple[int, int], np.ndarray]] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.families:
            return [UND] * len(x), np.zeros(len(x))
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        margins = x @ self.family_w.T
        chance = np.exp(STEEP * (margins - margins.max(axis=1, keepdims=True)))
        chance /= chance.sum(axis=1, keepdims=True)
        winner = margins.argmax(axis=1)
        score = chance[np.arange(len(x)), winner].astype(np.float64)
        lang = np.empty(len(x), object)
        for f in np.unique(winner):
            rows = np.flatnonzero(winner == f)
            names = self.members[f]
            votes = np.zeros((len(rows), len(names)))
            trust = np.zeros((len(rows), len(names)))
            for (a, b), w in self.pair_w[f].items():
                p = 1 / (1 + np.exp(-STEEP * (x[rows] @ w)))
                votes[:, a] += p >= 0.5
                votes[:, b] += p < 0.5
                trust[:, a] += p
                trust[:, b] += 1 - p
            best = (votes + trust / (len(names) + 1)).argmax(axis=1)
            lang[rows] = [names[k] for k in best]
            if len(names) > 1:
                score[rows] *= trust[np.arange(len(rows)), best] / (len(names) - 1)
        return lang.tolist(), np.clip(score, 0.0, 1.0)


def fit(x: np.ndarray, langs: list[str]) -> Model:
    known = {lang: fam for fam, members in FAMILIES.items() for lang in members}
    model = Model()
    if not len(x):
        return model
    langs = np.array(langs, object)
    by_family: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        by_family.setdefault(known.get(lang, lang), []).append(lang)
    model.families = sorted(by_family)
    model.members = [by_family[f] for f in model.families]
    family = np.array([known.get(v, v) for v in langs], object)
    model.family_w = np.stack([
        svm(x, np.where(family == f, 1.0, -1.0).astype(np.float32)) if len(model.families) > 1
        else np.zeros(x.shape[1] + 1, np.float32) for f in model.families])
    for k, names in enumerate(model.members):
        model.pair_w[k] = {}
        for a in range(len(names)):
            for b in range(a + 1, len(names)):
                rows = (langs == names[a]) | (langs == names[b])
                y = np.where(langs[rows] == names[a], 1.0, -1.0).astype(np.float32)
                model.pair_w[k][a, b] = svm(x[rows], y)
    return model


def train(df: DataFrame, doc_id: str, text: str, lang: str, rows: Column,
          per_lang: int = 1000, most: int = 6000, least: int = 20) -> Model:
    """The model of the rows where ``rows`` holds and ``lang`` is not null.

    Every language gives as many rows as any other, if it has them: ``most`` divided by their
    number, at most ``per_lang`` and at least ``least``. Of more than ``most / least``
    languages the rarest are not learned.
    """
    source = df.where(rows & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    ids = source.select("doc_id", "lang")
    known = (ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("n"), "lang").limit(max(1, most // least)).collect())
    each = min(per_lang, max(least, most // max(1, len(known))))
    # by the draw first, twice as many as needed, so that few rows of a language come together
    share = df.sparkSession.createDataFrame([(r.lang, 2.0 * each / r.n) for r in known],
                                            T.StructType([source.schema["lang"], T.StructField("share", T.DoubleType())]))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    first = Window.partitionBy("lang").orderBy(draw, "doc_id")
    drawn = (ids.join(F.broadcast(share), "lang").where(draw < F.col("share")).select("doc_id", "lang").distinct()
             .withColumn("place", F.row_number().over(first)).where(F.col("place") <= each).select("doc_id", "lang"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 0):
                x = features(part.column(0).to_pylist()).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(2), pa.array([r.tobytes() for r in x], pa.binary())],
                    names=["doc_id", "lang", "x"])

    # at most ``each`` ids a language
    sample = (source.join(F.broadcast(drawn), ["doc_id", "lang"], "left_semi").select("text", "doc_id", "lang")
              .mapInArrow(run, T.StructType([source.schema["doc_id"], source.schema["lang"],
                                             T.StructField("x", T.BinaryType())])))
    # an id that repeats may bring more rows: as many of each language again
    few = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "x")
    sample = sample.withColumn("place", F.row_number().over(few)).where(F.col("place") <= each)
    found = sorted(sample.collect(), key=lambda r: (str(r.doc_id), r.lang, r.x))
    x = np.array([np.frombuffer(r.x, np.float16) for r in found], np.float32)
    return fit(x, [r.lang for r in found])


def predict(df: DataFrame, text: str, model: Model, lang_out: str = "lang_pred",
            score_out: str = "score", drop_text: bool = False) -> DataFrame:
    """``df`` with the predicted language and its score (0 to 1); input columns of these names get
    trailing underscores."""
    df = aside(df, [lang_out, score_out], keep=[text])
    at = df.columns.index(text)
    rest = [k for k in range(len(df.columns)) if not (drop_text and k == at)]
    schema = T.StructType([*[df.schema[k] for k in rest], T.StructField(lang_out, T.StringType(), False),
                           T.StructField(score_out, T.DoubleType(), False)])

    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                texts = [t or "" for t in part.column(at).to_pylist()]
                lang, score = model.predict(features(texts))
                bare = np.array([not has_letter(t) for t in texts], bool)
                lang = [UND if b else v for b, v in zip(bare, lang)]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k) for k in rest], pa.array(lang, pa.string()),
                     pa.array(np.where(bare, 0.0, score))], names=schema.names)

    return df.mapInArrow(run, schema)
