from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tallymark.llm import runs

DOCS = "doc_id long, text string, n_runs int, start string"


def lyndon(t):
    return [max(j - i for j in range(i + 1, len(t) + 1) if all(t[i:j] < t[i + k : j] for k in range(1, j - i))) for i in range(len(t))]


def plain_runs(t, least):
    """Every stretch that keeps a period, by definition: one period after another."""
    out = set()
    for q in range(1, len(t) // 2 + 1):
        same = [t[i] == t[i + q] for i in range(len(t) - q)] + [False]
        start = None
        for i, yes in enumerate(same):
            if yes and start is None:
                start = i
            elif not yes and start is not None:
                size = i - start + q
                smaller = any(all(t[k] == t[k + d] for k in range(start, start + size - d)) for d in range(1, q))
                if size >= max(least, 2 * q) and not smaller:
                    out.add((start, size, q))
                start = None
    return sorted(out)


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and w:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = plain_runs(w, 12)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = {i for s, z, q in found for i in range(s + q, s + z)}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *first, digest("".join(f"{s},{z},{q}\n" for s, z, q in found)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def babble(rnd, most):
    w = []
    while len(w) < most:
        w += [rnd.choice("abcdefgh"[: rnd.choice([1, 2, 3, 8])]) for _ in range(rnd.randrange(1, 9))] * rnd.choice([1, 1, 2, 3, 9])
    return w[:most]


def test_grouping_gives_the_lyndon_array_of_each_string():
    rnd = random.Random(1)
    for _ in range(300):
        parts = [[rnd.randrange(rnd.choice([1, 2, 3])) for _ in range(rnd.randrange(1, 12))] for _ in range(3)]
        first = np.cumsum([0] + [len(p) for p in parts[:-1]])
        got = runs.lyndon_lengths(np.array(sum(parts, []), np.int64), first)
        assert got.tolist() == [x for p in parts for x in lyndon(p)]


@pytest.mark.parametrize("least", [2, 5, 12, 13])
def test_runs_equal_their_definition(least):
    rnd = random.Random(least)
    for _ in range(150):
        texts = [[x.encode() for x in babble(rnd, rnd.randrange(0, 90))] for _ in range(4)]
        got = list(zip(*(x.tolist() for x in runs.runs_of(texts, least)), strict=True))
        assert got == [(k, *r) for k, t in enumerate(texts) for r in plain_runs(t, least)]


@pytest.mark.parametrize("unit", ["a", "a b", "a b b", "a b a c"])
def test_deep_periods_and_fibonacci_words(unit):
    x, y = ["a"], ["a", "b"]
    while len(y) < 250:
        x, y = y, y + x
    thue = [str(bin(i).count("1") % 2) for i in range(256)]
    for t in (unit.split() * 60, y, thue + thue, ["z"] + unit.split() * 9 + ["z"]):
        got = list(zip(*(v.tolist() for v in runs.runs_of([[w.encode() for w in t]], 12)), strict=True))
        assert got == [(0, *r) for r in plain_runs(t, 12)]


def test_query_columns_equal_a_plain_version(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(babble(rnd, rnd.randrange(0, 70)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \t\n\x0b\x0c\r "), (None, "x y " * 20), (7, rows[7][1]), (7, "other text"), (63, " é  ü " * 15), (64, "one"), (65, "a\u0085b " * 12)]
    docs = spark.createDataFrame([(i, t, 5, "clash") for i, t in rows], DOCS).repartition(3)
    got = sorted((tuple(r) for r in runs.collapse(docs, 12, runs.planted).collect()), key=repr)
    assert got == sorted((plain_row(i, t) for i, t in rows), key=repr)
    assert runs.collapse(docs.limit(0)).collect() == []


def test_slices_of_a_batch_do_not_matter(spark, monkeypatch):
    rnd = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(babble(rnd, 60)), 0, "") for i in range(30)], DOCS).coalesce(1)
    want = sorted(map(tuple, runs.collapse(docs).collect()))
    monkeypatch.setattr(runs, "SLICE", 100)
    assert sorted(map(tuple, runs.collapse(docs).collect())) == want


def test_a_long_text_is_linear(spark):
    text = " ".join(["p q r s t"] * 60_000)
    row = runs.collapse(spark.createDataFrame([(1, text, 0, "")], DOCS)).first()
    assert (row.n_runs, row.start, row.length, row.period) == (1, 0, 300_000, 5)
