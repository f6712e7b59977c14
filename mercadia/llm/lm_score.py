"""Masked pseudo-likelihood scores from a bidirectional window network.

Every word of a document is predicted from the words on both sides of it; the
sum of these conditional log-probabilities is the document's score. The network
adds position-weighted embeddings of the ``SIDE`` words before and behind,
applies tanh, and predicts the word in two steps (group, then word in its group),
so a prediction costs two softmaxes over 64 and not one over all words.

The vocabulary comes from the counts of all words of all documents; other words
share the 64 entries of the first group by a hash of their ending, and such a word
adds, beside its entry's log-probability, that of the word within the entry: its
count among the counts of all words of the entry and one unseen word. Tasks know the
``LISTED`` most frequent of these words; the others are joined with the counts by
64-bit hash. Training is
numpy inside Spark tasks: the first weights give every word its frequency; documents are dealt
over shards by hashes of their ids and words; in every round each shard starts from the same weights
and takes gradient steps on masked positions of its documents, one of ``MASK``
masks after the other, and the shards' weights are averaged, each embedding and each group's members
by the positions that used them, so that a word which few shards have moves as far as any other. The ``ROUNDS``
share the masks, so every position is a target once. Number and content of the shards come from
the documents alone: files, tasks and executors do not change the scores. What is counted,
shuffled and averaged grows with the input; only the most frequent words and one set of weights,
both of fixed size, reach the driver.

Defined cases: a null text counts as empty; an empty text has no token, score 0.0
and a null mean; with an empty vocabulary all words are in the first group; rows
that repeat are scored each; an empty table gives an empty table. Only id and text
are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercadia.llm.common import staged
from mercadia.llm.tokens import slices

GROUP = 64
WORDS = GROUP * GROUP           # with the first group for other words
PAD = WORDS
WIDTH = 24
SIDE = 2
OFFSETS = [k for k in range(-SIDE, SIDE + 1) if k]
ROUNDS, MASK = 2, 8
#: Words beyond the vocabulary whose counts every task holds.
LISTED = 1 << 18
#: Joined log-probabilities are added as whole numbers, in any order.
UNIT = 1e9
BATCH, RATE, START = 6144, 0.15, 1e-6
SCORED = 1 << 13
#: Tokens of a shard.
SHARD = 1 << 22
#: Words counted together in a task.
FLUSH_WORDS = 2_000_000
#: Bytes and rows of text whose words are looked up together: a lookup lays out the listed words anew.
WORD_BYTES, WORD_ROWS = 8 << 20, 1 << 14
#: Weight sets averaged in one task at a time, in pieces of PIECE numbers.
FAN_IN, PIECE = 256, 8192


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def column_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, as :func:`words_of` gives them, and how many each text has."""
    import pyarrow.compute as pc
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = split.flatten()
    full = pc.greater(pc.binary_length(words), 0)       # space at a text's ends leaves empty pieces
    text = np.repeat(np.arange(len(split)), split.value_lengths().to_numpy(zero_copy_only=False))
    sizes = np.bincount(text[full.to_numpy(zero_copy_only=False)], minlength=len(split))
    return words.filter(full).cast(pa.binary()), sizes


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, n) of all words of all texts."""
    def counted(parts):
        words, counts = pa.chunked_array(parts, pa.binary()).value_counts().flatten()
        return pa.RecordBatch.from_arrays([words, counts], names=["word", "n"])

    def count(batches):
        parts, held = [], 0
        for batch in batches:
            for part in slices(batch, 0):
                parts.append(column_words(part.column(0))[0])
                held += len(parts[-1])
                if held > FLUSH_WORDS:
                    yield counted(parts)
                    parts, held = [], 0
        if held:
            yield counted(parts)

    return staged(df.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "word binary, n long")
                  .groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")


def frequent(counts: DataFrame, size: int) -> list[tuple[bytes, int]]:
    """The most frequent words and their counts, most frequent first."""
    # the count that the last of these words has, from the number of words by count; so
    # only these words, and not the best of every task, are sorted together
    above = (counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
             .withColumn("words", F.sum("words").over(Window.orderBy(F.col("n").desc()))))
    least = above.where(F.col("words") >= size).agg(F.max("n")).scalar()
    top = (counts.where(F.col("n") >= F.coalesce(least, F.lit(0)))
           .orderBy(F.col("n").desc(), "word").limit(size))
    return [(bytes(r.word), r.n) for r in top.collect()]


def entries(words: list[bytes]) -> np.ndarray:
    """The entry of the first group that each word outside the vocabulary shares."""
    letters = np.frombuffer(b"\0" + b"".join(words), np.uint8).astype(np.int32)
    sizes = np.fromiter(map(len, words), np.int32, len(words))
    last = np.cumsum(sizes)         # a byte stands before the first word
    before = np.where(sizes > 1, letters[last - 1], 0)
    return (letters[last] * 31 + before * 7 + np.minimum(sizes, 12)) % GROUP


def entry(word: bytes) -> int:
    return int(entries([word])[0])


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes, signed, whose last bits are the words' entries."""
    from xxhash import xxh3_64_intdigest
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    return (h // np.uint64(GROUP) * np.uint64(GROUP) + entries(words).astype(np.uint64)).view(np.int64)


def other_words(counts: DataFrame, vocab: list[bytes]) -> DataFrame:
    """(hash, n) of the words outside the vocabulary."""
    def run(batches):
        inside = set(vocab)
        for batch in batches:
            words, n = (c.to_pylist() for c in batch.columns)
            keep = [k for k, w in enumerate(words) if w not in inside]
            yield pa.RecordBatch.from_arrays([pa.array(word_hashes([words[k] for k in keep])),
                                              pa.array([n[k] for k in keep], pa.int64())], names=["hash", "n"])

    return counts.select("word", "n").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def entry_totals(others: DataFrame) -> np.ndarray:
    """Counts of all words of every entry, and one for an unseen word."""
    out = np.ones(GROUP)
    for r in others.groupBy(F.pmod("hash", F.lit(GROUP)).alias("k")).agg(F.sum("n").alias("n")).collect():
        out[r.k] += r.n
    return out


class Ids:
    """A word's id, log-probability within its entry (0 in the vocabulary), and its hash when
    that log-probability is still to be joined (0 otherwise)."""

    def __init__(self, top: list[tuple[bytes, int]], totals: np.ndarray):
        size = WORDS - GROUP
        self.listed = pa.array([w for w, _ in top], pa.binary())
        others = entries([w for w, _ in top[size:]])
        n = np.array([n for _, n in top[size:]], float)
        known = min(size, len(top))
        # the last place is that of a word which is not listed
        self.ids = np.concatenate([GROUP + np.arange(known), others, [0]]).astype(np.int32)
        self.inner = np.concatenate([np.zeros(known), np.log(n) - np.log(totals[others]), [0]])

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        import pyarrow.compute as pc
        at = pc.fill_null(pc.index_in(words, value_set=self.listed), len(self.listed)).to_numpy()
        ids, inner, hashes = self.ids[at], self.inner[at], np.zeros(len(at), np.int64)
        missing = np.flatnonzero(at == len(self.listed))
        if len(missing):
            rest = words.take(pa.array(missing)).dictionary_encode()
            new, each = rest.dictionary.to_pylist(), rest.indices.to_numpy()
            ids[missing], hashes[missing] = entries(new)[each], word_hashes(new)[each]
        return ids, inner, hashes


def token_ids(df: DataFrame, doc_id: str, text: str, top: list[tuple[bytes, int]], totals: np.ndarray) -> DataFrame:
    """(row, doc_id, ids, inner, rare): word ids as 16-bit numbers, the sum of the known
    log-probabilities within entries, and the hashes of words whose own are to be joined."""
    source = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"),
                       F.col(f"`{text}`").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        ids = Ids(top, totals)
        for batch in batches:
            for part in slices(batch, 2, WORD_BYTES, WORD_ROWS):
                words, sizes = column_words(part.column(2))
                flat, inner, hashes = ids(words)
                flat = flat.astype("<u2")
                doc = np.repeat(np.arange(len(sizes)), sizes)
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                rare = np.flatnonzero(hashes)
                edge = np.searchsorted(rare, cuts)
                hashes = hashes[rare]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1),
                     pa.array([flat[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                     pa.array(np.bincount(doc, inner, len(sizes))),
                     pa.array([hashes[a:b].tobytes() if b > a else None for a, b in zip(edge[:-1], edge[1:])],
                              pa.binary())], names=["row", "doc_id", "ids", "inner", "rare"])

    return source.mapInArrow(run, f"row long, doc_id {kind}, ids binary, inner double, rare binary")


def joined(ids: DataFrame, others: DataFrame, totals: np.ndarray) -> DataFrame:
    """(row, rare_sum): the log-probabilities within entries of each row's ``rare`` words."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                data = part.column(1).to_pylist()
                counts = np.fromiter((len(d) // 8 for d in data), np.int64, len(data))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column(0).to_numpy(), counts)),
                     pa.array(np.frombuffer(b"".join(data), np.int64))], names=["row", "hash"])

    of_entry = F.array(*[F.lit(float(x)) for x in np.log(totals)])
    chance = F.log(F.coalesce("n", F.lit(1))) - F.element_at(of_entry, (F.pmod("hash", F.lit(GROUP)) + 1).cast("int"))
    return (ids.where("rare is not null").select("row", "rare").mapInArrow(run, "row long, hash long")
            .join(others, "hash", "left").select("row", F.round(chance * UNIT).cast("long").alias("c"))
            .groupBy("row").agg(F.sum("c").alias("rare_sum")))


class Network:
    SHAPES = {"embed": (WORDS + 1, WIDTH), "place": (len(OFFSETS), WIDTH), "bias": (WIDTH,),
              "group": (WIDTH, GROUP), "group_bias": (GROUP,),
              "member": (GROUP, WIDTH, GROUP), "member_bias": (GROUP, GROUP)}

    def __init__(self, flat: np.ndarray):
        self.w, at = {}, 0
        for name, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            self.w[name] = flat[at:at + size].reshape(shape).copy()
            at += size

    @classmethod
    def start(cls, n: np.ndarray | None = None) -> np.ndarray:
        """First weights; with the counts ``n`` of all ids they give every id its frequency."""
        rng = np.random.default_rng(7)
        n = np.ones(WORDS) if n is None else np.maximum(n, 1.0)
        groups = n.reshape(GROUP, GROUP)
        parts = []
        for name, shape in cls.SHAPES.items():
            if name == "place":
                parts.append(np.ones(shape))
            elif name == "group_bias":
                parts.append(np.log(groups.sum(axis=1) / n.sum()))
            elif name == "member_bias":
                parts.append(np.log(groups / groups.sum(axis=1, keepdims=True)))
            elif name == "bias":
                parts.append(np.zeros(shape))
            else:
                parts.append(rng.normal(0, 0.1, shape))
        return np.concatenate([p.ravel() for p in parts]).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[n].ravel() for n in self.SHAPES])

    def hidden(self, near: np.ndarray) -> np.ndarray:
        """Rows of the window's sum behind tanh; ``tables`` holds one product table per offset."""
        near = near.astype(np.intp)
        total = self.tables[0].take(near[0], 0)
        for k in range(1, len(OFFSETS)):
            total += self.tables[k].take(near[k], 0)
        return np.tanh(total, out=total)

    def fix(self) -> Network:
        """Prepares :meth:`log_chance`; the weights must not change afterwards."""
        self.tables = [self.w["embed"] * p for p in self.w["place"]]
        self.tables[0] = self.tables[0] + self.w["bias"]
        return self

    def two_steps(self, h: np.ndarray, cuts: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of the group, and of the word in its group, for rows sorted by group."""
        outer = h @ self.w["group"]
        outer += self.w["group_bias"]
        inner = np.empty((len(h), GROUP), np.float32)
        for g, a, b in zip(present.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
            np.matmul(h[a:b], self.w["member"][g], out=inner[a:b])
            inner[a:b] += self.w["member_bias"][g]
        return outer, inner

    def log_chance(self, near: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target between its neighbours (a row of ``near`` each offset)."""
        order, group, member, cuts, present = by_group(target)
        found = np.zeros(len(target))
        for logits, at in zip(self.two_steps(self.hidden(near[:, order]), cuts, present), (group, member)):
            found += lowered(logits)[np.arange(len(at)), at]
            found -= np.log(exponentials(logits))
        out = np.empty_like(found)
        out[order] = found
        return out

    def gradient(self, near: np.ndarray, target: np.ndarray) -> dict:
        """Gradient of the mean negative log-probability."""
        scale = np.float32(1 / len(target))
        order, group, member, cuts, present = by_group(target)
        near = near[:, order].astype(np.intp)
        parts = [self.w["embed"].take(ids, 0) for ids in near]
        h = parts[0] * self.w["place"][0]
        for part, place in zip(parts[1:], self.w["place"][1:]):
            h += part * place
        h += self.w["bias"]
        np.tanh(h, out=h)
        row = np.arange(len(h))
        p, q = self.two_steps(h, cuts, present)
        for chance, at in ((p, group), (q, member)):
            chance *= (scale / exponentials(lowered(chance)))[:, None]
            chance[row, at] -= scale
        out = {n: np.zeros(self.SHAPES[n], np.float32) for n in ("member", "member_bias", "place", "embed")}
        ones = np.ones(len(h), np.float32)
        out["group"], out["group_bias"] = h.T @ p, ones @ p
        dh = p @ self.w["group"].T
        for g, a, b in zip(present.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
            part = q[a:b]
            np.matmul(h[a:b].T, part, out=out["member"][g])
            np.matmul(ones[:b - a], part, out=out["member_bias"][g])
            dh[a:b] += part @ self.w["member"][g].T
        dh *= 1 - h * h
        out["bias"] = ones @ dh
        back = np.ascontiguousarray(dh.T, np.float64)
        pieces = np.empty((WIDTH, near.size))
        for k, part in enumerate(parts):
            out["place"][k] = np.einsum("ij,ij->j", dh, part)
            np.multiply(back, self.w["place"][k][:, None], out=pieces[:, k * len(dh):(k + 1) * len(dh)])
        ids, sums = near.ravel(), np.empty((WIDTH, WORDS + 1))
        for c in range(WIDTH):
            sums[c] = np.bincount(ids, pieces[c], WORDS + 1)
        out["embed"][:] = sums.T
        return out


ONES = np.ones(GROUP, np.float32)


def lowered(logits: np.ndarray) -> np.ndarray:
    """The rows, less their largest value where an exponential could leave the range of floats."""
    if logits.size and max(logits.max(), -logits.min()) > 60:
        logits -= logits.max(axis=1, keepdims=True)
    return logits


def exponentials(logits: np.ndarray) -> np.ndarray:
    """Exponentiates the rows in place and gives their sums."""
    return np.exp(logits, out=logits) @ ONES


def by_group(target: np.ndarray):
    """Order of the targets by group; group and member in that order; where groups begin and end; groups."""
    group = (target // GROUP).astype(np.uint8)
    order = np.argsort(group, kind="stable")        # few bits: a radix sort
    group = group[order]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    return order, group, target[order] % GROUP, np.append(first, len(group)), group[first]


def padded(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids with PAD around each document, and where each id then stands."""
    out = np.full(len(flat) + SIDE * (len(counts) + 1), PAD, np.uint16)
    at = np.arange(len(flat)) + SIDE * (1 + np.repeat(np.arange(len(counts)), counts))
    out[at] = flat
    return out, at


def neighbours(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ids around the places ``at`` of :func:`padded`, a row each offset."""
    return np.stack([ids[at + o] for o in OFFSETS])


def batch_ids(column) -> tuple[np.ndarray, np.ndarray]:
    data = column.to_pylist()
    return (np.frombuffer(b"".join(data), "<u2"),
            np.fromiter((len(d) // 2 for d in data), np.int64, len(data)))


def shard_count(tokens: int) -> int:
    """Shards to train on: one per ``SHARD`` tokens at first, then growing as the square root, so
    that neither a shard's work nor the weights sent for all shards run away with the input."""
    m = -(-tokens // SHARD)
    return max(1, math.isqrt(m * min(m, 1024)))


def train(ids: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Rounds over shards of the documents. A document's shard and place in it come from hashes
    of its id and words, not from files or tasks, so the layout does not change the result."""
    shards = shard_count((ids.agg(F.sum(F.length("ids"))).first()[0] or 0) // 2)
    own = F.xxhash64(F.col("doc_id"), F.col("ids"))
    dealt = (ids.select(F.pmod(own, F.lit(shards)).cast("int").alias("shard"), own.alias("own"), "ids")
             .repartitionById(shards, F.col("shard")).sortWithinPartitions("own", "ids").select("ids"))
    for turn in range(ROUNDS):
        weights = average(dealt.mapInArrow(steps(weights, turn), "part long, piece int, w binary"), shards, weights)
    return weights


def mask_of(counts: np.ndarray) -> np.ndarray:
    """Every position's mask, from its place in its document and the document's length, so
    the same in every round however rows are dealt into batches."""
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(counts, counts)
    return (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(MASK)


def steps(weights: np.ndarray, turn: int):
    """A shard's gradient steps (Adagrad) over the masked positions of its documents.

    Gives the weights times their uses, and the uses, in pieces: an embedding is used by every
    position beside it, a group's members by every target in it, the rest by all targets.
    """
    def run(batches):
        from pyspark import TaskContext
        net, used = Network(weights), np.zeros(UNITS)
        grown = {n: np.full(s, START, np.float32) for n, s in Network.SHAPES.items()}
        for batch in batches:
            for part in slices(batch, 0):
                flat, counts = batch_ids(part.column(0))
                ids, at = padded(flat, counts)
                place = mask_of(counts)
                for mask in range(turn, MASK, ROUNDS):
                    masked = np.flatnonzero(place == mask)
                    near, targets = neighbours(ids, at[masked]), flat[masked]
                    used += uses(near, targets)
                    for a in range(0, len(masked), BATCH):
                        for name, g in net.gradient(near[:, a:a + BATCH], targets[a:a + BATCH]).items():
                            grown[name] += g * g
                            net.w[name] -= RATE * g / np.sqrt(grown[name])
        if used[-1]:
            all_w = np.concatenate([net.flat().astype(np.float64) * spread(used), used])
            cuts = range(0, len(all_w), PIECE)
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()] * len(cuts), pa.int64()), pa.array(range(len(cuts)), pa.int32()),
                 pa.array([all_w[a:a + PIECE].tobytes() for a in cuts])], names=["part", "piece", "w"])

    return run


#: Parts of the weights that are averaged by uses of their own: embeddings, groups, the rest.
UNITS = WORDS + 1 + GROUP + 1


def uses(near: np.ndarray, targets: np.ndarray) -> np.ndarray:
    return np.concatenate([np.bincount(near.ravel(), minlength=WORDS + 1),
                           np.bincount(targets // GROUP, minlength=GROUP), [len(targets)]])


def spread(used: np.ndarray) -> np.ndarray:
    """The uses of every single weight."""
    words, groups, rest = np.split(used, [WORDS + 1, WORDS + 1 + GROUP])
    by = {"embed": words, "member": groups, "member_bias": groups}
    return np.concatenate([np.repeat(by[n], int(np.prod(s[1:]))) if n in by else np.full(int(np.prod(s)), rest[0])
                           for n, s in Network.SHAPES.items()])


def average(sums: DataFrame, parts: int, old: np.ndarray) -> np.ndarray:
    """Mean of the shards' weights by their uses, added up ``FAN_IN`` at a time; unused weights stay."""
    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        w = sum(np.frombuffer(x.as_py(), np.float64) for x in group.column("w"))
        return pa.table({"part": pa.array([group.column("part")[0].as_py() // FAN_IN], pa.int64()),
                         "piece": group.column("piece").slice(0, 1), "w": pa.array([w.tobytes()])})

    while True:
        sums = (sums.groupBy("piece", F.floor(F.col("part") / FAN_IN)).applyInArrow(
            add, "part long, piece int, w binary"))
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            break
    rows = sorted(sums.collect(), key=lambda r: r.piece)        # one row a piece
    if not rows:
        return old
    total, used = np.split(np.concatenate([np.frombuffer(r.w, np.float64) for r in rows]), [len(old)])
    used = spread(used)
    return np.where(used > 0, total / np.maximum(used, 1), old).astype(np.float32)


def scores(ids: DataFrame, weights: np.ndarray) -> DataFrame:
    kind = ids.schema["doc_id"].dataType.simpleString()

    def run(batches):
        net = Network(weights).fix()
        for batch in batches:
            for part in slices(batch, 2, 1 << 19):
                flat, counts = batch_ids(part.column(2))
                total = np.zeros(len(flat))
                ids, at = padded(flat, counts)
                for a in range(0, len(flat), SCORED):
                    total[a:a + SCORED] = net.log_chance(neighbours(ids, at[a:a + SCORED]), flat[a:a + SCORED])
                doc = np.repeat(np.arange(len(counts)), counts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(counts),
                     pa.array(np.bincount(doc, total, len(counts)) + part.column(3).to_numpy())],
                    names=["row", "doc_id", "n_tokens", "log_likelihood"])

    return ids.select("row", "doc_id", "ids", "inner").mapInArrow(
        run, f"row long, doc_id {kind}, n_tokens long, log_likelihood double")


@dataclass
class Model:
    """What a corpus taught: the most frequent words, counts by entry, weights; and tables of it."""
    top: list[tuple[bytes, int]]
    totals: np.ndarray
    weights: np.ndarray
    others: DataFrame       # words outside the vocabulary
    ids: DataFrame          # of the corpus itself


def fit(df: DataFrame, doc_id: str, text: str) -> Model:
    counts = word_counts(df, text)
    top = frequent(counts, WORDS - GROUP + LISTED)
    others = staged(other_words(counts, [w for w, _ in top[:WORDS - GROUP]]), "lm-others")
    totals = entry_totals(others)
    ids = staged(token_ids(df, doc_id, text, top, totals), "lm-ids")
    n = np.concatenate([totals, [k for _, k in top[:WORDS - GROUP]], np.ones(max(0, WORDS - GROUP - len(top)))])
    return Model(top, totals, train(ids, Network.start(n)), others, ids)


def score(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) of every row."""
    model = fit(df, doc_id, text)
    found = (scores(model.ids, model.weights).join(joined(model.ids, model.others, model.totals), "row", "left")
             .withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("rare_sum", F.lit(0)) / UNIT))
    return found.select("doc_id", "n_tokens", "log_likelihood", F.when(
        F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean_log_likelihood"))
