"""Per-batch token ids through a cache of space-delimited pieces.

Tokenizers split text before they merge, and never inside a piece between two
spaces, so the ids of a text are the ids of its pieces in a row. Words repeat:
each Python worker keeps the ids of the pieces it has met (a bounded cache,
emptied when full; it only saves time) and gathers a batch's ids with numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once in a Python worker; one longer text is alone.
SLICE_BYTES = 1 << 20
#: Rows handled at once, however short they are.
SLICE_ROWS = 1024
CACHE_PIECES = 400_000
#: Longer pieces are encoded but not kept.
CACHE_CHARS = 64


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every (start, len) range in a row."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES,
           rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with about ``limit`` bytes in ``column`` and ``rows`` rows at most."""
    import pyarrow.compute as pc
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size.astype(np.int64)) // limit
    cuts = np.unique(np.concatenate([np.flatnonzero(np.diff(part)) + 1, np.arange(0, len(size), rows),
                                     [len(size)]]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(int(a), int(b - a))


class PieceIds:
    """Ids of pieces; ``encode(pieces)`` gives (flat ids, count per piece)."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
                 capacity: int = CACHE_PIECES):
        self.encode, self.capacity = encode, capacity
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int32)
        self.n = self.used = 0

    def _put(self, pieces: list[str]) -> None:
        ids, counts = self.encode(pieces)
        for name, need in (("flat", self.used + len(ids)), ("start", self.n + len(pieces)),
                           ("count", self.n + len(pieces))):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(max(need - len(old), len(old)), old.dtype)]))
        self.flat[self.used:self.used + len(ids)] = ids
        ends = np.cumsum(counts)
        self.start[self.n:self.n + len(pieces)] = self.used + ends - counts
        self.count[self.n:self.n + len(pieces)] = counts
        self.index.update(zip(pieces, range(self.n, self.n + len(pieces))))
        self.n += len(pieces)
        self.used += len(ids)

    def ids(self, pieces: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all pieces, and ids per text; ``sizes``: pieces per text."""
        if self.n > self.capacity:
            self._reset()
        at = np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            unknown = [pieces[i] for i in missing.tolist()]
            new = list(dict.fromkeys(unknown))
            self._put(new)
            at[missing] = np.fromiter(map(self.index.__getitem__, unknown), np.int64, len(missing))
            for p in new:
                if len(p) > CACHE_CHARS:
                    del self.index[p]
        lens = self.count[at]
        ids = self.flat[ragged(self.start[at], lens.astype(np.int64))]
        ends = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
        edge = np.concatenate([[0], np.cumsum(sizes)])
        return ids, ends[edge[1:]] - ends[edge[:-1]]
