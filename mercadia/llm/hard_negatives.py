"""Hard-negative mining: exact bounded inner-product search over anchor clusters.

The search walks shared lists, as MAXIMUS does. Anchors are put into clusters
(spherical k-means) and every cluster is a chunk of at most ``CHUNK`` members. All rows
are packed into blocks of at most ``BLOCK`` rows, by label, region (nearest
centroid) and id. For a chunk and a block the rows are sorted once by their
angular upper bound ``|x| cos(max(0, angle(x, centroid) - spread))``, ``spread`` being the
chunk's largest angle to its centroid; every member walks that one list, in steps of
``STEP`` rows, until its k-th best score so far is above its own bound for all
rows that follow: from there on nothing can enter, which certifies the end.

Two rounds make the ends early. The first walks, for each chunk, only the block
with the highest bound. The k-th best scores found there are floors for the second
round, where a chunk meets a block only if the block's bound (from its mean
direction, spread and norms) reaches the least floor of the chunk's members. Thus the
floors only save work; every row that could be among the results is scored.

Searches: the positives (same label, the ``positives`` best), then for each positive the
``negatives`` best rows of other labels whose score lies in the positive's window.

Chunks and blocks are met in a join on that bound, one packed row each (a stated query
set against all rows, in blocks); a task holds one chunk and one block at a time.
A label or vector with a third of all rows fills many blocks and no single task. The
centroids are fitted on the driver on at most ``SAMPLE`` anchors.

Scores are exact integers: components are taken as ``floor(scale * x)`` and multiplied as
doubles while every partial sum stays below 2 ** 53, else as 64-bit integers.

Defined cases: rows with a null label, vector or component, or a component that is not finite,
take no part; nor do rows without an id, and rows whose scaled vector is 2 ** 31
long or longer, as their scores may not fit a long. Vectors of different lengths count as padded
with zeros; zero vectors score 0. An anchor's own id is never its positive. Rows that repeat an
id are candidates each, and repeated anchors mine each for itself, all by equal scores and
ids in the result. Ties go to the smaller id. An anchor without positives, and
a positive without negatives, have no rows. An empty table gives an empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercadia.llm.common import staged, width

CHUNK = 256
BLOCK = 4096
STEP = 512
SAMPLE = 8192
MOST_CLUSTERS = 256
SLACK = 1e-6        # radians, and relative: far above the rounding of any bound

BLOCK_TYPE = ("block long, ids binary, labels binary, vectors binary, size int, low_label long, high_label long, "
              "mean array<double>, spread double, low_norm double, high_norm double")
CHUNK_TYPE = ("chunk long, ids binary, labels binary, vectors binary, size int, low_label long, high_label long, "
              "mean array<double>, spread double, members array<long>, lengths array<double>")
HIT_TYPE = "chunk long, ask int, score long, id long"


# -- packing -------------------------------------------------------------------------

def usable(df: DataFrame, id_col: str, vector: str, label: str, scale: float) -> DataFrame:
    """``id``, ``label``, ``v`` (scaled integers) of the rows that take part."""
    ok = F.forall(F.col("x"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"),
                     F.col(f"`{vector}`").cast("array<double>").alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(ok)
    rows = rows.select("id", "label", F.transform("x", lambda x: F.floor(x * F.lit(float(scale)))
                                                  .cast("double")).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return rows.where(square < F.lit(2.0 ** 62)).select(
        "id", "label", F.transform("v", lambda x: x.cast("int")).alias("v"))


def _flat(column: pa.ListArray) -> np.ndarray:
    """Rows of integers as a matrix, padded with zeros."""
    lens = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lens), int(lens.max(initial=0))), np.int32)
    out[np.arange(out.shape[1]) < lens[:, None]] = column.flatten().to_numpy()
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    return np.divide(v, norm[:, None], out=np.zeros_like(v), where=norm[:, None] > 0)


def _angles(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Angle of each row to the direction ``c``; a zero row has angle 0."""
    u, d = _unit(v), min(v.shape[1], len(c))
    cos = u[:, :d] @ c[:d]
    return np.where(u.any(axis=1), np.arccos(np.clip(cos, -1, 1)), 0.0)


def _packer(most: int, chunks: bool):
    """Runs of sorted rows as one row each; chunks also end where the region does."""
    def packed(number: int, rows: pa.Table):
        ids, labels = (rows.column(c).to_numpy().astype(np.int64) for c in ("id", "label"))
        v = _flat(rows.column("v").combine_chunks())
        f = v.astype(np.float64)
        mean = _unit(_unit(f).sum(axis=0, keepdims=True))[0]
        norm = np.sqrt(np.einsum("ij,ij->i", f, f))
        out = [number, ids.tobytes(), labels.tobytes(), v.tobytes(), len(ids), int(labels.min()), int(labels.max()),
               mean.tolist(), float(_angles(f, mean).max() if mean.any() else np.pi)]
        return out + ([ids.tolist(), norm.tolist()] if chunks else [float(norm.min()), float(norm.max())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = (TaskContext.get().partitionId() << 33) - 1
        names = [c.split()[0] for c in (CHUNK_TYPE if chunks else BLOCK_TYPE).split(", ")]
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables(
                [held, pa.Table.from_batches([batch])])
            while held.num_rows > most:
                cut = _end(held, most, chunks)
                number += 1
                yield _row(packed(number, held.slice(0, cut)), names)
                held = held.slice(cut)
        while held is not None and held.num_rows:
            cut = _end(held, most, chunks)
            number += 1
            yield _row(packed(number, held.slice(0, cut)), names)
            held = held.slice(cut)
    return run


def _end(rows: pa.Table, most: int, chunks: bool) -> int:
    cut = min(most, rows.num_rows)
    if chunks:
        region = rows.column("region").to_numpy()[:cut]
        cut = int(np.argmax(region != region[0])) or cut
    return cut


def _row(values: list, names: list[str]) -> pa.RecordBatch:
    types = {"block": pa.int64(), "chunk": pa.int64(), "ids": pa.binary(), "labels": pa.binary(),
             "vectors": pa.binary(), "size": pa.int32(), "low_label": pa.int64(), "high_label": pa.int64(),
             "mean": pa.list_(pa.float64()), "members": pa.list_(pa.int64()), "lengths": pa.list_(pa.float64())}
    return pa.RecordBatch.from_arrays([pa.array([v], types.get(n, pa.float64())) for v, n in zip(values, names)], names)


def centroids(anchors: DataFrame, members: int = CHUNK, rounds: int = 8) -> np.ndarray:
    """Directions of the clusters, fitted on at most ``SAMPLE`` anchors (those of the smallest id hash)."""
    total = anchors.count()
    rows = anchors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    if not rows.num_rows:
        return np.zeros((1, 1))
    u = _unit(_flat(rows.column("v").combine_chunks()).astype(np.float64))
    k = max(1, min(MOST_CLUSTERS, total // members, len(u) // 8))
    rng = np.random.default_rng(0)
    c = u[rng.choice(len(u), k, replace=False)]
    for _ in range(rounds):
        near = (u @ c.T).argmax(axis=1)
        c = _unit(np.stack([u[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(k)]))
    return c


def _regions(rows: DataFrame, c: np.ndarray) -> DataFrame:
    """``rows`` with ``region``: the nearest of the centroids (at most ``MOST_CLUSTERS``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _flat(batch.column(2)).astype(np.float64)
            d = min(v.shape[1], c.shape[1])
            near = (v[:, :d] @ c[:, :d].T).argmax(axis=1) if len(v) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))],
                                             [*batch.schema.names, "region"])
    return rows.mapInArrow(run, "id long, label long, v array<int>, region int")


# -- the walk --------------------------------------------------------------------------

def _matrix(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = row["size"]
    return (np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64),
            np.frombuffer(row["vectors"], np.int32).reshape(n, -1))


def _products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all rows of both, as 64-bit integers."""
    d = min(a.shape[1], x.shape[1])
    fa, fx = a.astype(np.float64), x.astype(np.float64)
    most = np.sqrt(max(np.einsum("ij,ij->i", fa, fa).max(initial=0) * np.einsum("ij,ij->i", fx, fx).max(initial=0), 0))
    if most < 2.0 ** 52:     # bounds every partial sum, in any order
        return (fa[:, :d] @ fx[:, :d].T).astype(np.int64)
    return a[:, :d].astype(np.int64) @ x[:, :d].astype(np.int64).T


def walk(chunk: dict, block: dict, k: int, same: bool) -> np.ndarray:
    """Ask, score and id (rows of the result) of the rows of ``block`` that may be among an ask's ``k`` best.

    An ask is a member (``asks``), a window of scores (``low`` to ``high``) and a ``floor``: the
    k-th best score known already. ``same``: rows of the member's label, else of other labels.
    """
    a_ids, a_labels, a = _matrix(chunk)
    x_ids, x_labels, x = _matrix(block)
    asks = np.asarray(chunk["asks"], np.int64)
    low, high = np.asarray(chunk["low"], np.int64), np.asarray(chunk["high"], np.int64)
    least = np.maximum(np.asarray(chunk["floor"], np.int64), low)
    fx, fa = x.astype(np.float64), a.astype(np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", fx, fx))
    length = np.sqrt(np.einsum("ij,ij->i", fa, fa))
    apart = _angles(fx, np.asarray(chunk["mean"])) - chunk["spread"] - 2 * SLACK
    bound = norm * np.cos(np.maximum(apart, 0))
    order = np.argsort(-bound, kind="stable")
    found: list[np.ndarray] = [np.zeros((3, 0), np.int64)]
    live = np.arange(len(asks))
    for at in range(0, len(order), STEP):
        # certified end: no later row can reach the least score that still counts
        reach = length[asks[live]] * bound[order[at]]
        live = live[reach + SLACK * np.abs(reach) + 1 >= least[live]]
        if not len(live):
            break
        rows = order[at:at + STEP]
        members, of = np.unique(asks[live], return_inverse=True)
        score = _products(a[members], x[rows])
        fits = (a_labels[members][:, None] == x_labels[rows][None, :]) == same
        if same:
            fits &= a_ids[members][:, None] != x_ids[rows][None, :]
        s = score[of]
        ask, row = np.nonzero(fits[of] & (s >= least[live][:, None]) & (s <= high[live][:, None]))
        found.append(np.stack([live[ask], s[ask, row], x_ids[rows[row]]]))
        found = [best_of(np.concatenate(found, axis=1), k, least)]
    return found[0] if len(found) == 1 else best_of(np.concatenate(found, axis=1), k, least)


def best_of(hits: np.ndarray, k: int, least: np.ndarray) -> np.ndarray:
    """The ``k`` best of each ask among ``hits`` (ask, score, id); raises ``least`` to the k-th scores."""
    hits = hits[:, np.lexsort((hits[2], -hits[1], hits[0]))]
    place = np.arange(hits.shape[1]) - np.searchsorted(hits[0], hits[0])
    hits, place = hits[:, place < k], place[place < k]
    np.maximum.at(least, hits[0, place == k - 1], hits[1, place == k - 1])
    return hits


#: Chunks whose hits a task holds, so that later blocks meet higher floors and add to one list.
HELD = 32


def _walker(k: int, same: bool):
    def handed(chunk: int, hits: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(hits.shape[1], chunk)), pa.array(hits[0].astype(np.int32)), pa.array(hits[1]),
             pa.array(hits[2])], ["chunk", "ask", "score", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                block = {c[2:]: v for c, v in row.items() if c.startswith("b_")}
                known, floor = held.pop(row["chunk"], (np.zeros((3, 0), np.int64), np.array(row["floor"], np.int64)))
                hits = walk(row | {"floor": floor}, block, k, same)
                held[row["chunk"]] = best_of(np.concatenate([known, hits], axis=1), k, floor), floor
                if len(held) > HELD:
                    first = next(iter(held))
                    yield handed(first, held.pop(first)[0])
        for chunk, (hits, _) in held.items():
            yield handed(chunk, hits)
    return run


# -- the search ----------------------------------------------------------------------

def _bound() -> Column:
    """Largest inner product of a unit vector of the chunk and a row of the block."""
    dot = F.aggregate(F.zip_with("mean", "b_mean", lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0))),
                      F.lit(0.0), lambda s, x: s + x)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) - F.col("spread") - F.col("b_spread")
    cos = F.cos(F.greatest(F.lit(0.0), F.least(apart - F.lit(2 * SLACK), F.lit(np.pi))))
    high = F.when(cos >= 0, F.col("b_high_norm")).otherwise(F.col("b_low_norm")) * cos
    # without a direction (all rows zero, or balanced) nothing is known of the angle
    known = F.exists("mean", lambda x: x != 0) & F.exists("b_mean", lambda x: x != 0)
    return F.when(known, high + F.abs(high) * SLACK).otherwise(F.col("b_high_norm")) + F.lit(SLACK)


def _meets(same: bool) -> Column:
    """Whether labels of chunk and block can make a pair."""
    if same:
        return (F.col("low_label") <= F.col("b_high_label")) & (F.col("b_low_label") <= F.col("high_label"))
    return ~((F.col("low_label") == F.col("high_label")) & (F.col("b_low_label") == F.col("b_high_label"))
             & (F.col("low_label") == F.col("b_low_label")))


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best hits of each ask with their ``place``; Spark cuts to k before it shuffles, too."""
    by = Window.partitionBy("chunk", "ask").orderBy(F.desc("score"), "id")
    return hits.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)


def search(chunks: DataFrame, blocks: DataFrame, k: int, same: bool) -> DataFrame:
    """``chunk``, ``ask``, ``place``, ``score``, ``id``: the ``k`` best rows of each ask.

    ``chunks`` carries ``asks`` (member of each ask), ``low`` and ``high``; ``least`` is the
    lowest score over the member's length that any of its asks still takes.
    """
    brief = ["block", "low_label", "high_label", "mean", "spread", "low_norm", "high_norm"]
    named = blocks.select(*[F.col(c).alias(f"b_{c}") for c in blocks.columns])
    summary = named.select(*[f"b_{c}" for c in brief])
    light = chunks.select("chunk", "mean", "spread", "low_label", "high_label", "least")
    met = light.join(summary, _meets(same) & (_bound() >= F.col("least")))
    heads = staged(met.groupBy("chunk").agg(F.max_by("b_block", F.struct(_bound(), "b_block")).alias("head")),
                   "hn-heads")
    walker = _walker(k, same)
    none = F.transform("asks", lambda _: F.lit(-(1 << 62)).cast("long"))
    first = chunks.join(heads, "chunk").withColumn("floor", none).join(named, F.col("head") == F.col("b_block"))
    start = staged(_best(first.mapInArrow(walker, HIT_TYPE), k), "hn-head")
    floors = (start.where(F.col("place") == k).groupBy("chunk")
              .agg(F.map_from_entries(F.collect_list(F.struct("ask", "score"))).alias("floors")))
    rest = staged(_with_least(
        chunks.join(heads, "chunk").join(floors, "chunk", "left").withColumn("floor", F.transform(
            "asks", lambda _, j: F.coalesce(F.element_at("floors", j.cast("int")), F.lit(-(1 << 62)).cast("long"))))
        .drop("floors", "least")), "hn-rest")
    pairs = rest.join(named, _meets(same) & (F.col("head") != F.col("b_block")) & (_bound() >= F.col("least")))
    return _best(pairs.mapInArrow(walker, HIT_TYPE).unionByName(start.drop("place")), k)


def _with_least(chunks: DataFrame) -> DataFrame:
    """Adds ``least``: the lowest bound that some ask needs, from its ``low`` and ``floor``.

    A member of length 0 scores 0 with every row, so its asks need any bound, or none.
    """
    each = F.transform("asks", lambda m, j: F.struct(
        F.greatest(F.get("low", j), F.get("floor", j)).cast("double").alias("s"), F.get("lengths", m).alias("l")))
    need = F.transform(each, lambda e: F.when(e["l"] > 0, (e["s"] - 1) / e["l"]).when(
        e["s"] <= 0, F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    return chunks.withColumn("least", F.array_min(need))


def mine(df: DataFrame, id_col: str, vector: str, label: str, anchor: Callable[[Column], Column],
         scale: float = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``anchor`` tells from the id whether a row is an anchor. For each anchor and each of its
    ``positives`` best other rows of its label: the ``negatives`` best rows of other labels that
    score ``low`` to ``high`` percent of the positive's score.
    """
    spark = df.sparkSession
    rows = staged(usable(df, id_col, vector, label, scale), "hn-rows")
    c = centroids(rows.where(anchor(F.col("id"))))
    placed = _regions(rows, c)

    def sorted_by(part: DataFrame, *key: str) -> DataFrame:
        # the place only spreads rows of one id over partitions
        return (part.withColumn("place", F.monotonically_increasing_id())
                .repartitionByRange(width(spark), *key, "place").sortWithinPartitions(*key).drop("place"))

    blocks = staged(sorted_by(placed, "label", "region", "id").mapInArrow(_packer(BLOCK, False), BLOCK_TYPE),
                    "hn-blocks")
    chunks = staged(sorted_by(placed.where(anchor(F.col("id"))), "region", "id")
                    .mapInArrow(_packer(CHUNK, True), CHUNK_TYPE), "hn-chunks")
    none = F.lit(-(1 << 62)).cast("long")
    every = chunks.withColumns({
        "asks": F.transform("members", lambda _, j: j), "low": F.transform("members", lambda _: none),
        "high": F.transform("members", lambda _: -none), "least": F.lit(float("-inf"))})
    best = search(every, blocks, positives, True)

    window = F.col("score").cast("decimal(20,0)")
    asks = best.withColumns({"low": F.ceil(window * low / 100).cast("long"),
                             "high": F.floor(window * high / 100).cast("long")}).where("low <= high")
    asks = staged(asks.groupBy("chunk").agg(F.array_sort(F.collect_list(      # at most CHUNK x positives
        F.struct("ask", "place", "id", "score", "low", "high"))).alias("each")), "hn-asks")
    narrowed = chunks.join(asks, "chunk").withColumns({
        "asks": F.col("each.ask"), "low": F.col("each.low"), "high": F.col("each.high"),
        "floor": F.transform("each", lambda _: none)})
    narrowed = staged(_with_least(narrowed).drop("each", "floor"), "hn-narrowed")
    found = search(narrowed, blocks, negatives, False)
    named = (asks.join(chunks.select("chunk", "members"), "chunk")
             .select("chunk", "members", F.posexplode("each").alias("ask", "of"))
             .select("chunk", "ask", F.get("members", F.col("of.ask")).alias("anchor_id"),
                     F.col("of.id").alias("positive_id"), F.col("of.score").alias("positive_score")))
    return found.join(named, ["chunk", "ask"]).select(
        "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
