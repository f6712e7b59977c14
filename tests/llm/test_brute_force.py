"""Decontamination and language ID against plain loops over tuples, without hashes, bit sets or Spark."""

from __future__ import annotations

import random

import numpy as np

from mercadia.llm import decontaminate as D
from mercadia.llm import language_id

DOCS = "doc_id long, text string"


def tokens(text, behind=False):
    """(plain word, kind) of the kept words of a text, and the same with signs between them."""
    out, signs, opens, before = [], [], not behind, None
    for raw in text.split():
        bare = D.EDGES.sub("", raw)
        kind = D.kind(bare)
        if kind != D.EMPTY:
            form = D.LITERAL if kind in (D.UNIT, D.NAME) else kind
            signs.append((bare.translate(D.UPPER), form, False))
            if kind == D.UNIT and before != D.NUMBER or kind == D.NAME and opens:
                kind = D.LITERAL
            out.append((bare.translate(D.UPPER), kind))
            before = D.kind(bare)
        elif raw in D.OPERATORS:
            signs.append((raw, D.LITERAL, True))
        opens = D.ENDS.search(raw) is not None
    return out, signs


def all_windows(text, sizes=None, behind=False):
    """(size, key, position, values, usable) of a text; ``sizes`` None: as an item."""
    words, signs = tokens(text, behind)
    found = []
    for size in [min(len(words), D.SIZE)] if sizes is None else [s for s in sizes if s > 0]:
        for p in range(len(words) - size + 1) if size else ():
            part = words[p:p + size]
            slots = [w for w, k in part if k != D.LITERAL]
            usable = 2 * len(slots) <= size and size >= D.LEAST
            if size < D.ANYWHERE and len(words) != size or behind and (p or part[0][1] != D.NAME):
                continue
            found.append((size, tuple(w for w, _ in part), p, [], usable and not behind))
            if usable and slots:
                found.append((size, tuple(w if k == D.LITERAL else (k,) for w, k in part), p, slots, usable and not behind))
    if not behind:
        for size in [len(signs)] if sizes is None else [-s for s in sizes if s < 0]:
            for p in range(len(signs) - size + 1):
                part = signs[p:p + size]
                slots, between = [w for w, k, _ in part if k != D.LITERAL], sum(s for _, _, s in part)
                if D.LEAST <= size <= D.FORM and len(slots) > 1 and between and 2 * len(slots) > size - between:
                    found.append((-size, tuple(w if k == D.LITERAL else (k,) for w, k, _ in part),
                                  -1 if sizes is None else p, slots, True))
        if sizes is None:
            found += all_windows(text, None, True)
    return found


def brute_leaks(items, docs):
    known = [all_windows(t) for t in items]
    sizes = sorted({w[0] for item in known for w in item})
    out = set()
    for d, text in enumerate(docs):
        here = all_windows(text, sizes)
        for i, item in enumerate(known):
            aligned: dict = {}
            for size, key, at, values, _ in item:
                for s, k, p, found, _ in here:
                    if (s, k) == (size, key):
                        places, pairs = aligned.setdefault((p - at, values != found), (set(), set()))
                        places.add(at)
                        pairs.update(zip(values, found))
            covered = set()
            for (_, differs), (places, pairs) in aligned.items():
                if not differs or len({a for a, _ in pairs}) == len(pairs):
                    covered |= places
            usable = {w[2] for w in item if w[4]}
            every = {w[2] for w in item if w[2] >= 0}
            shares = [len({p for p in covered if p >= 0}) / len(every)] if every else []
            shares += [len(covered & usable) / len(usable)] if usable else []
            if covered and max(shares, default=0) >= D.SHARE:
                out.add((d, i))
    return sorted(out)


PLAIN = ["farm", "sheep", "river", "keeps", "old", "the", "near", "box", "so", "with"]
SLOT = ["12", "7", "3.5", "seven", "km", "Paris", "McDonald", "O'Brien", "+", "*", "="]


def test_leaks_equal_brute_force(spark):
    rng = random.Random(11)

    def text(n, slots):
        return " ".join(rng.choice(SLOT if rng.random() < slots else PLAIN) + rng.choice(["", "", "", ".", ","])
                        for _ in range(n))

    items = [text(rng.choice((2, 3, 5, 6, 8, 9, 12, 20)), rng.choice((0, 0.2, 0.5, 0.8))) for _ in range(40)]
    docs = []
    for k in range(160):
        words = rng.choice(items).split()
        for _ in range(rng.choice((0, 0, 1, 2, 4))):
            at = rng.randrange(len(words))
            words[at] = rng.choice(SLOT + PLAIN)
        docs.append(" ".join([text(rng.randrange(0, 6), 0.2), *words, text(rng.randrange(0, 6), 0.2)]))
    frame = [spark.createDataFrame(list(enumerate(x)), DOCS).coalesce(2) for x in (items, docs)]
    got = sorted((r.doc, r.item) for r in D.leaks(frame[1], "doc_id", "text", frame[0], "doc_id", "text").collect())
    want = brute_leaks(items, docs)
    assert got == want
    assert 40 < len(want) < 160 * 40 / 2


def slow_features(text):
    """Counts of hashed letter pairs and triples of a text, by definition."""
    codes = [b if 97 <= b <= 122 or b >= 128 else 32 for b in text.lower().encode("utf-8", "replace")]
    out = [0.0] * language_id.BUCKETS
    for n in (2, 3):
        for p in range(len(codes) - n + 1):
            h = n
            for c in codes[p:p + n]:
                h = (h * 0x9E3779B1 + c) % (1 << 32)
            out[(h * 0x85EBCA6B) % (1 << 32) >> 21] += 1
    norm = sum(out) ** 0.5
    return [v ** 0.5 / norm if norm else 0.0 for v in out]


def test_language_votes_equal_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang is not null and text is not null")
    model = language_id.train(docs, "doc_id", "text", "lang", docs.doc_id >= 0)
    rows = language_id.predict(docs.limit(25), "text", model).collect()
    assert len(model.families) > 1 and any(model.pair_w.values())
    for r in rows:
        x = np.array([*slow_features(r.text), 1.0])
        margins = [float(x @ w) for w in model.family_w]
        f = int(np.argmax(margins))
        share = np.exp(language_id.STEEP * (np.array(margins) - max(margins)))
        score = float(share[f] / share.sum())
        names, wins, trust = model.members[f], {}, {}
        for (a, b), w in model.pair_w[f].items():
            p = 1 / (1 + np.exp(-language_id.STEEP * float(x @ w)))
            for side, chance in ((a, p), (b, 1 - p)):
                wins[side] = wins.get(side, 0) + (chance >= 0.5)
                trust[side] = trust.get(side, 0.0) + chance
        best = max(range(len(names)), key=lambda k: (wins.get(k, 0) + trust.get(k, 0.0) / (len(names) + 1)))
        if len(names) > 1:
            score *= trust[best] / (len(names) - 1)
        assert r.lang_pred == names[best] and abs(r.score - score) < 1e-4
