"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, ``://``,
a plus before a digit, a digit before a dot, two digits that touch or have
one blank or hyphen between them, and identifier cues. A parser of each kind
expands an anchor to both sides as far as its characters go, and validates what it
found. A parser never looks at text behind the end of its last find again, so
the work is linear in the text, however it is made.

Base kinds, leftmost and without overlap within a kind (a find that fails its
validation is used up all the same):

* ``email``: ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ``ip``: four runs of digits between dots, each at most 255
* ``card``: digits with at most one blank or hyphen between two of them, 13 to 19, Luhn sum
* ``phone``: ``+``, a digit, then digits, blanks, dots, hyphens and parentheses up to a digit; 9 to 15 digits

Kinds that the anchors add beside them, outside the base digest:

* ``login``: ``scheme://user[:password]@host``, the whole up to the host's end
* ``iban``: behind its cue, country, check digits and number with a right remainder by 97
* ``ssn``: behind its cue, ``ddd-dd-dddd`` without a group of zeros
* ``account``: behind a cue of account numbers, 6 to 17 digits

Offsets are code points, ends exclusive. Cues match ASCII letters of any case.

Defined cases: null and empty texts have no spans; texts of any length are taken whole;
repeated rows get equal spans; an empty table gives an empty table; all columns are
carried through, one that bears the output's name gets a trailing underscore.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercadia.llm.common import aside
from mercadia.llm.tokens import slices

BASE = ["email", "ip", "card", "phone"]
ADDED = ["login", "iban", "ssn", "account"]
KINDS = BASE + ADDED
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                  T.StructField("end", T.IntegerType())]), False)

CUES = {"iban": ["iban"], "ssn": ["ssn", "social security"],
        "account": ["account no", "account number", "acct", "a/c no"]}
DIGITS = "0123456789"

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_scheme = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_label = re.compile("[A-Za-z0-9-]+").match
_digits = re.compile("[0-9]+").match
_dialled = re.compile(r"[ ().0-9-]+").match
_user = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=:-]+@").match
_between = re.compile(r"[ :#=.\-]{0,4}(?:(?:no|number|is)\b[ :#=.]{0,3})?", re.ASCII | re.IGNORECASE).match
_iban = re.compile("[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}").match
_ssn = re.compile("([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])").match
_account = re.compile("[0-9]{6,17}(?![0-9])").match


def anchors() -> dict[str, str]:
    """The automaton's patterns and the parser that each wakes."""
    out = {"@": "email", "://": "login"}
    for d in DIGITS:
        out["+" + d] = "phone"
        out[d + "."] = "ip"
        for e in DIGITS:
            for between in ("", " ", "-"):
                out[d + between + e] = "card"
    out.update((cue, kind) for kind, cues in CUES.items() for cue in cues)
    return out


def automaton():
    import ahocorasick
    found = ahocorasick.Automaton()
    for pattern, kind in anchors().items():
        found.add_word(pattern, (kind, len(pattern)))
    found.make_automaton()
    return found


def domain(text: str, at: int, least: int) -> int:
    """End of labels with dots between them from ``at``, or 0 with fewer than ``least``."""
    end, labels = 0, 0
    while m := _label(text, at):
        end, labels = m.end(), labels + 1
        if text[end:end + 1] != ".":
            break
        at = end + 1
    return end if labels >= least else 0


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d)
        total += v if k % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def email(text: str, start: int, end: int, done: int) -> tuple[int, int, bool] | None:
    """Start, end and validity of the find at the anchor text[start:end]; None: no find.

    ``done`` is the end of the last find of the kind, as in the parsers below.
    """
    first = start
    while first > done and text[first - 1] in _local:
        first -= 1
    stop = domain(text, end, 2) if first < start else 0
    return (first, stop, True) if stop else None


def ip(text: str, start: int, end: int, done: int) -> tuple[int, int, bool] | None:
    first = start
    while first > done and text[first - 1] in DIGITS:
        first -= 1
    at, parts = first, []
    for _ in range(4):
        m = _digits(text, at)
        if not m:
            return None
        parts.append(m.group())
        at = m.end()
        if len(parts) < 4:
            if text[at:at + 1] != ".":
                return None
            at += 1
    tail = [p.lstrip("0") for p in parts]
    return first, at, all(len(p) < 4 and int(p or 0) <= 255 for p in tail)


def card(text: str, start: int, end: int, done: int) -> tuple[int, int, bool] | None:
    at, parts, total = start, [], 0
    while m := _digits(text, at):
        at = m.end()
        total += at - m.start()
        if total <= 19:
            parts.append(m.group())
        if text[at:at + 1] not in (" ", "-") or text[at + 1:at + 2] not in DIGITS or at + 1 >= len(text):
            break
        at += 1
    return start, at, 13 <= total <= 19 and luhn("".join(parts))


def phone(text: str, start: int, end: int, done: int) -> tuple[int, int, bool] | None:
    m = _dialled(text, end)
    body = m.group().rstrip(" ().-") if m else ""
    if len(body) < 2:
        return None
    return start, end + len(body), 9 <= 1 + sum(map(body.count, DIGITS)) <= 15


def login(text: str, start: int, end: int, done: int) -> tuple[int, int, bool] | None:
    m = _user(text, end)
    stop = domain(text, m.end(), 1) if m else 0
    first = start
    while first > done and text[first - 1] in _scheme:
        first -= 1
    return (first, stop, True) if stop and first < start else None


def iban(text: str, start: int, end: int, done: int) -> tuple[int, int, bool] | None:
    m = _iban(text, _between(text, end).end())
    while m:
        number = m.group().replace(" ", "").upper()
        if int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1:
            return m.start(), m.end(), True
        shorter = m.end() - 1       # a following word may have been taken as its last group
        while shorter > m.start() and text[shorter] == " ":
            shorter -= 1
        m = _iban(text, m.start(), shorter)
    return None


def ssn(text: str, start: int, end: int, done: int) -> tuple[int, int, bool] | None:
    m = _ssn(text, _between(text, end).end())
    return (m.start(), m.end(), all(map(int, m.groups()))) if m else None


def account(text: str, start: int, end: int, done: int) -> tuple[int, int, bool] | None:
    m = _account(text, _between(text, end).end())
    return (m.start(), m.end(), True) if m else None


PARSERS: dict[str, Callable] = {"email": email, "ip": ip, "card": card, "phone": phone,
                                "login": login, "iban": iban, "ssn": ssn, "account": account}


def spans(text: str, hits) -> list[tuple[str, int, int]]:
    """All (kind, start, end) of a text by kind as in ``KINDS``, then by start."""
    # bytes.lower() changes A-Z alone, so offsets stay
    found: dict[str, list] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    for last, (kind, size) in hits(text.encode("utf-8").lower().decode("utf-8")):
        start = last + 1 - size
        if start < done[kind]:
            continue
        find = PARSERS[kind](text, start, last + 1, done[kind])
        if find:
            done[kind] = find[1]
            if find[2]:
                found[kind].append((kind, find[0], find[1]))
    return [s for k in KINDS for s in found[k]]


def find(df: DataFrame, text: str, out: str = "spans") -> DataFrame:
    """``df`` with ``out``: array of (kind, start, end), base kinds first."""
    df = aside(df, [out], keep=[text])
    names = df.columns
    held = df.toDF(*[f"c{k}" for k in range(len(names))])
    at, target = names.index(text), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()),
                                                        ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = automaton().iter
        for whole in batches:
            for batch in slices(whole, at):
                rows = [[dict(zip(("kind", "start", "end"), s)) for s in spans(t, hits)] if t else []
                        for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, target)],
                                                 [*batch.schema.names, "out"])

    schema = T.StructType([*held.schema.fields, T.StructField("out", SPANS)])
    return held.mapInArrow(run, schema).toDF(*names, out)


def listed(found: Column, kinds: list[str] = KINDS) -> Column:
    """``kind:start:end`` of the spans of the given kinds, comma-joined."""
    some = F.filter(found, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def number(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
