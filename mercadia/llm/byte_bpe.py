"""Byte-level BPE by backtracking, and decoding through an offset table.

Encoding a word: an Aho-Corasick pass finds the longest vocabulary token at
every byte; from the left, the longest token that is *compatible* with the one
before it is taken, shorter prefixes are tried next, and a position from which
no choice leads on is marked dead and left for good. Two tokens are compatible
when merging their joined bytes gives back just these two, which the merges along
the seam decide (:meth:`ByteBpe.compatible`); a sequence whose neighbours are all compatible is the exact result of the merges, whatever the
length, so every position is entered once and the work is linear. The words of a
batch go side by side in arrays, a token of every word at each step; very long words, and
the last few of a batch, are walked alone. Verdicts on pairs are kept in a table of fixed size. Decoding gathers every id's bytes from one blob by
its offset table.

Defined cases: a null text counts as empty; an empty text has no ids and decodes
to the empty text; strings of special tokens in a text become their ids, as in
the tokenizers library with ``add_special_tokens=False``; bytes that are not
UTF-8 after decoding become U+FFFD; ids outside the vocabulary fail. Rows are
independent: repeats, ties and extra columns are carried through untouched.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_left
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mercadia.llm.common import aside
from mercadia.llm.tokens import CACHE_CHARS, PieceIds, ragged, slices

#: Slots (a power of two) of the table of verdicts on pairs; a pair takes the place of the one in its slot.
PAIR_SLOTS = 1 << 19
#: Bytes of words that are matched at once, and the bytes from which a word is walked alone.
CHUNK_BYTES = 1 << 17
LONG_WORD = 256
#: So few words are walked one by one.
FEW_WORDS = 8
#: Pieces whose ids a worker keeps before it starts over.
PIECE_TABLE = 200_000
#: Stands between words where many are matched at once; no byte.
BETWEEN_WORDS = "\u0100"
#: One pre-token of letters, and a full stop or comma; all letters of these blocks. The same once more after a line break.
PLAIN_WORD = re.compile("( ?{0}+)([.,]?)(?:(\n)({0}+)([.,]?))?".format("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"))


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Odd multiplier that spreads pairs over their slots by the top bits of the product.
PAIR_MIX = 0x9E3779B97F4A7C15


class Steps:
    """Steps of symbols by token id, in flat arrays: a token's run ends at the merge that never comes."""

    def __init__(self, size: int):
        self.start = array("i", [-1]) * size
        self.symbol, self.taken = array("i"), array("i")

    def put(self, token: int, steps: list[tuple[int, int]]) -> None:
        self.start[token] = len(self.symbol)
        for x, r in steps:
            self.symbol.append(x)
            self.taken.append(r)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.frombuffer(v, np.int32) for v in (self.start, self.symbol, self.taken))


class ByteBpe:
    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_chars()

        def raw(token: str) -> str:     # one latin-1 character per byte
            return "".join(chr(to_byte[c]) for c in token)

        vocab = spec["model"]["vocab"]
        names = {t: raw(t) for t in vocab}
        self.id_of = {names[t]: i for t, i in vocab.items()}
        self.rank = {(names.get(a) or raw(a), names.get(b) or raw(b)): r
                     for r, (a, b) in enumerate(spec["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.split = re.compile("(" + "|".join(
            re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        size = 1 + max([*vocab.values(), *self.special.values()])
        # the steps of a token's last and first symbol, from its place in ``last`` and ``first``: symbol, merge that
        # takes it up
        symbols: dict[str, int] = {}
        self.last, self.first = Steps(size), Steps(size)
        # tokens that their own bytes do not merge to can never come out of the merges
        whole: dict[str, int] = {}
        for t, i in self.id_of.items():
            parts, first, last = self._merge(t)
            if parts == [t]:
                whole[t] = i
                self.first.put(i, [(symbols.setdefault(x, len(symbols)), r) for x, r in first])
                self.last.put(i, [(symbols.setdefault(x, len(symbols)), r) for x, r in last])
        self.n_symbols = len(symbols)
        seams = sorted((symbols[x] * len(symbols) + symbols[y], r) for (x, y), r in self.rank.items()
                       if x in symbols and y in symbols)
        self.seams, self.seam_rank = array("q", [k for k, _ in seams]), array("i", [r for _, r in seams])
        # tokens of one and of two bytes, by their bytes (256: a place between words); longer ones in the automaton
        self.short = np.full((257, 257), -1, np.int32)
        self.automaton = ahocorasick.Automaton()
        self.automaton.add_word("\u0101", 0)       # never met; an automaton is not empty
        for t, i in whole.items():
            if len(t) == 1:
                row = self.short[ord(t)]
                row[row < 0] = i
            elif len(t) == 2:
                self.short[ord(t[0]), ord(t[1])] = i
        for t, i in whole.items():
            if len(t) > 2:
                self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.length, self.shorter = array("i", [0]) * size, array("i", [-1]) * size     # by id
        for t, i in whole.items():
            cut = len(t) - 1
            while cut and t[:cut] not in whole:
                cut -= 1
            self.shorter[i] = whole[t[:cut]] if cut else -1
            self.length[i] = len(t)
        self.pair = np.full(PAIR_SLOTS, -1, np.int64)
        self.verdict = np.zeros(PAIR_SLOTS, bool)
        blobs = [b""] * size
        for t, i in self.id_of.items():
            blobs[i] = t.encode("latin-1")
        for t, i in self.special.items():
            blobs[i] = t.encode("utf-8")
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64)
        self.cache = PieceIds(self._pieces, PIECE_TABLE)

    def merged(self, text: str) -> list[str]:
        """The merges applied one by one, lowest rank first (for single tokens)."""
        return self._merge(text)[0]

    def _merge(self, text: str):
        """The merged parts, and the (symbol, rank of the merge that takes it up)
        steps of the leftmost and of the rightmost symbol."""
        parts, rank, never = list(text), self.rank, len(self.rank)
        left, right = [], []
        while len(parts) > 1:
            ranks = [rank.get(pair, never) for pair in zip(parts, parts[1:])]
            lowest = min(ranks)
            if lowest == never:
                break
            k = ranks.index(lowest)
            if k == 0:
                left.append((parts[0], lowest))
            if k == len(parts) - 2:
                right.append((parts[-1], lowest))
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts, [*left, (parts[0], never)], [*right, (parts[-1], never)]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges keep ``left`` and ``right`` apart when they meet.

        Merges run in rank order, as a symbol takes part only in merges learned
        after it. So the last symbol of ``left`` and the first of ``right`` are
        followed through their own merges; the tokens join if at some point the
        two symbols at the seam merge before either is taken up on its own side.
        Of equal ranks the one further left goes first.
        """
        key = left << 32 | right
        slot = key * PAIR_MIX % (1 << 64) >> 45
        if self.pair[slot] == key:
            return bool(self.verdict[slot])
        return self._apart(left, right)

    def _apart(self, left: int, right: int) -> bool:
        i, j = self.last.start[left], self.first.start[right]
        lasts, firsts = self.last, self.first
        never = len(self.rank)
        while True:
            taken_x, taken_y = lasts.taken[i], firsts.taken[j]
            key = lasts.symbol[i] * self.n_symbols + firsts.symbol[j]
            at = bisect_left(self.seams, key)
            if at < len(self.seams) and self.seams[at] == key:
                seam = self.seam_rank[at]
                if seam < taken_x and seam <= taken_y:
                    return False
            if taken_x <= taken_y:
                if taken_x == never:
                    return True
                i += 1
            else:
                j += 1

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """:meth:`compatible` for many pairs."""
        key = left.astype(np.int64) << 32 | right
        slot = (key.astype(np.uint64) * np.uint64(PAIR_MIX) >> np.uint64(45)).astype(np.int64)
        out = self.verdict[slot]
        miss = np.flatnonzero(self.pair[slot] != key)
        if len(miss):
            new, at = np.unique(key[miss], return_inverse=True)
            found = self._all_apart(new >> 32, new & 0xFFFFFFFF)
            out[miss] = found[at]
            slot = (new.astype(np.uint64) * np.uint64(PAIR_MIX) >> np.uint64(45)).astype(np.int64)
            slot, one = np.unique(slot, return_index=True)
            self.pair[slot], self.verdict[slot] = new[one], found[one]
        return out

    def _all_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """:meth:`_apart` for many pairs."""
        never, seams = len(self.rank), np.frombuffer(self.seams, np.int64)
        seam_rank = np.frombuffer(self.seam_rank, np.int32)
        (last, x_of, x_taken), (first, y_of, y_taken) = self.last.arrays(), self.first.arrays()
        out = np.zeros(len(left), bool)
        at, i, j = np.arange(len(left)), last[left], first[right]
        while len(at):
            taken_x, taken_y = x_taken[i], y_taken[j]
            seam = np.full(len(at), never, np.int64)
            if len(seams):
                key = x_of[i].astype(np.int64) * self.n_symbols + y_of[j]
                place = np.minimum(np.searchsorted(seams, key), len(seams) - 1)
                seam = np.where(seams[place] == key, seam_rank[place], never)
            joined = (seam < taken_x) & (seam <= taken_y)
            ahead = taken_x <= taken_y
            apart = ~joined & ahead & (taken_x == never)
            out[at[apart]] = True
            go = np.flatnonzero(~joined & ~apart)
            at, i, j = at[go], (i + ahead)[go], (j + ~ahead)[go]
        return out

    def word(self, text: str) -> list[int]:
        """Ids of one word given as latin-1 characters, one per byte."""
        known = self.id_of.get(text)
        if known is not None and self.length[known]:
            return [known]
        size, length, shorter = len(text), self.length, self.shorter
        verdicts: dict[tuple[int, int], bool] = {}
        longest = self._longest(text).tolist()
        out: list[int] = []
        dead: set[int] = set()
        at, token = 0, longest[0]
        while True:
            if token < 0:       # nothing leads on from here
                if not out:
                    raise ValueError("a byte is missing from the vocabulary")
                dead.add(at)
                last = out.pop()
                at -= length[last]
                token = shorter[last]
                continue
            to = at + length[token]
            fits = to not in dead
            if fits and out:
                pair = (out[-1], token)
                fits = verdicts.get(pair)
                if fits is None:
                    fits = verdicts[pair] = self.compatible(*pair)
            if fits:
                out.append(token)
                at = to
                if at == size:
                    return out
                token = longest[at]
            else:
                token = shorter[token]

    def _longest(self, text: str) -> np.ndarray:
        """The longest token at every place of ``text`` and at its end, -1 for none."""
        codes = np.frombuffer((text + BETWEEN_WORDS).encode("utf-16-le"), np.uint16)
        out = np.full(len(codes), -1, np.int32)
        out[:-1] = self.short[codes[:-1], codes[1:]]
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        # ends come in order: the last is the longest
        out[found[:, 0] - np.frombuffer(self.length, np.int32)[found[:, 1]] + 1] = found[:, 1]
        return out

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of many words (:meth:`word`), and ids per word."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        part = np.cumsum(sizes) // CHUNK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        done = [self._side_by_side(texts[a:b], sizes[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]
        if not done:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])

    def _side_by_side(self, texts: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length, shorter = np.frombuffer(self.length, np.int32), np.frombuffer(self.shorter, np.int32)
        joined = BETWEEN_WORDS.join(texts)
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        # by place in the joined words: the longest token, the token taken, the place of the one before it, whether it
        # still holds, and whether no choice leads on
        longest = self._longest(joined)
        chosen, back = np.full(len(joined) + 1, -1, np.int32), np.full(len(joined) + 1, -1, np.int32)
        holds, dead = np.zeros(len(joined) + 1, bool), np.zeros(len(joined) + 1, bool)
        word = np.flatnonzero((sizes > 0) & (sizes < LONG_WORD))
        alone = np.flatnonzero(sizes >= LONG_WORD).tolist()
        at, end = starts[word], ends[word]
        token, before = longest[at], np.full(len(word), -1, np.int64)
        while len(word) > FEW_WORDS:
            stuck = np.flatnonzero(token < 0)
            if len(stuck):      # nothing leads on from here
                last = before[stuck]
                if last.min() < 0:
                    raise ValueError("a byte is missing from the vocabulary")
                dead[at[stuck]], holds[last] = True, False
                at[stuck], before[stuck], token[stuck] = last, back[last], shorter[chosen[last]]
            to = at + length[token]
            fits = (token >= 0) & ~dead[to]
            later = np.flatnonzero(fits & (before >= 0))
            fits[later] = self._compatible(chosen[before[later]], token[later])
            take = np.flatnonzero(fits)
            here = at[take]
            chosen[here], back[here], holds[here] = token[take], before[take], True
            other = np.flatnonzero(~fits & (token >= 0))
            token[other] = shorter[token[other]]
            before[take], at[take] = here, to[take]
            token[take] = longest[at[take]]
            on = np.flatnonzero(at < end)
            if len(on) < len(word):
                word, at, end, token, before = word[on], at[on], end[on], token[on], before[on]
        for k in [*alone, *word.tolist()]:
            ids = np.array(self.word(texts[k]), np.int32)
            place = starts[k] + np.cumsum(length[ids]) - length[ids]
            holds[starts[k]:ends[k]] = False
            holds[place], chosen[place] = True, ids
        upto = np.concatenate([[0], np.cumsum(holds)])
        return chosen[holds], upto[ends] - upto[starts]

    def _words(self, piece: str) -> list[str]:
        if piece[0] == " " and piece.isascii() and piece[1:].isalpha():
            return [piece]
        plain = PLAIN_WORD.fullmatch(piece)
        if plain:
            return [w if w.isascii() else w.encode().decode("latin-1") for w in plain.groups() if w]
        return ["".join(map(self._raw, w)) for w, _ in self.pre.pre_tokenize_str(piece)]

    _raw = staticmethod({c: chr(b) for c, b in byte_chars().items()}.__getitem__)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        index: dict[str, int] = {}      # the different words; a special token is one too, in its own name
        at: list[int] = []
        sizes = np.zeros(len(pieces), np.int64)
        for k, piece in enumerate(pieces):
            before = len(at)
            if piece in self.special:
                at.append(-1 - self.special[piece])
            elif piece:
                for w in self._words(piece):
                    at.append(index.setdefault(w, len(index)))
            sizes[k] = len(at) - before
        flat, counts = self.words(list(index))
        # special tokens come after the words
        named = np.array(at, np.int64)
        special = np.flatnonzero(named < 0)
        start = np.concatenate([np.cumsum(counts) - counts, len(flat) + np.arange(len(special))])
        flat = np.concatenate([flat, (-1 - named[special]).astype(np.int32)])
        counts = np.concatenate([counts, np.ones(len(special), np.int64)])
        named[special] = len(index) + np.arange(len(special))
        lens = counts[named]
        edge = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(sizes)])]
        return flat[ragged(start[named], lens)], np.diff(edge)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and ids per text."""
        pieces: list[str] = []
        sizes = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            before = len(pieces)
            for part in self.split.split(text) if self.split and any(s in text for s in self.special) else (text,):
                if part in self.special:
                    pieces.append(part)
                else:
                    pieces += space_pieces(part)
            sizes[k] = len(pieces) - before
        return self.cache.ids(pieces, sizes)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The text of each run of ``counts`` ids."""
        lens = self.offset[ids + 1] - self.offset[ids]
        data = self.blob[ragged(self.offset[ids], lens)]
        ends = np.concatenate([[0], np.cumsum(lens)])
        edge = ends[np.concatenate([[0], np.cumsum(counts)])]
        raw = pa.Array.from_buffers(pa.large_binary(), len(counts),
                                    [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(data)])
        try:
            return raw.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string())


AROUND = re.compile(r" \s|\s ")
BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def space_pieces(text: str) -> list[str]:
    """``text`` cut before every single space that stands between non-spaces; the
    pre-tokenizer never joins across such a place."""
    if not text:
        return []
    if text[0] == " " or text[-1] == " " or AROUND.search(text):
        first, *rest = BETWEEN.split(text)
    else:
        first, *rest = text.split(" ")
    return [first, *[" " + p for p in rest]]


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    """The encoder of a vocabulary file, once per Python worker."""
    return ByteBpe(path)


def round_trip(df: DataFrame, text: str, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` without ``text``, with its token ids and the text decoded from them; input columns of
    these names get trailing underscores."""
    df = aside(df, [ids, decoded], keep=[text])
    rest = [c for c in df.columns if c != text]
    schema = T.StructType([*[df.schema[c] for c in rest],
                           T.StructField(ids, T.ArrayType(T.IntegerType(), False), False),
                           T.StructField(decoded, T.StringType(), False)])

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for part in slices(batch, 0):
                flat, counts = bpe.encode([t or "" for t in part.column(0).to_pylist()])
                edges = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.ListArray.from_arrays(edges, pa.array(flat, pa.int32())),
                     bpe.decode(flat, counts)], names=schema.names)

    return df.select(text, *rest).mapInArrow(run, schema)


def with_ids(df: DataFrame, text: str, path: str, ids: str = "ids") -> DataFrame:
    """``df`` with the token ids of ``text`` in one more column."""
    df = aside(df, [ids], keep=[text])
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])
    at = df.columns.index(text)

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for part in slices(batch, at):
                flat, counts = bpe.encode([t or "" for t in part.column(at).to_pylist()])
                edges = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(edges, pa.array(flat, pa.int32()))],
                    names=schema.names)

    return df.mapInArrow(run, schema)


def decode_ids(df: DataFrame, ids: str, path: str, decoded: str = "decoded") -> DataFrame:
    """``df`` with the text of its ``ids`` in one more column."""
    df = aside(df, [decoded], keep=[ids])
    schema = T.StructType([*df.schema.fields, T.StructField(decoded, T.StringType(), False)])
    at = df.columns.index(ids)

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                lists = part.column(at).fill_null([]) if part.column(at).null_count else part.column(at)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, bpe.decode(flat, counts)], names=schema.names)

    return df.mapInArrow(run, schema)
