"""Runs of words against all periods tried one by one."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import invented
from wirecorpus.llm import periodic

WHITE = " \t\n\x0b\x0c\r"


def brute_runs(words):
    """Every period in turn: the stretches of places equal to the one a period further on."""
    names = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids, found = np.array([names[w] for w in words], dtype=np.int64), {}
    for q in range(1, len(words) // 3 + 1):
        same = np.concatenate([[False], ids[:-q] == ids[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1]).tolist()
        for start, stop in zip(edges[::2], edges[1::2]):
            if stop - start + q >= max(24, 3 * q):
                found.setdefault((start, stop - start + q), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def brute_row(doc_id, text, plant):
    words, current = [], ""
    for c in (text or "") + " ":
        if c in WHITE:
            if current:
                words.append(current)
            current = ""
        else:
            current += c
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and n and h % 10 == 0:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    left = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]
    lines = "".join("%d,%d,%d\n" % r for r in runs)
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(left).encode()).hexdigest())


def periodic_words(rnd):
    words = []
    for _ in range(rnd.randint(1, 5)):
        period = [rnd.randint(0, rnd.choice([0, 1, 2, 5])) for _ in range(rnd.randint(1, 40))]
        words += (period * rnd.randint(1, 12))[: rnd.randint(1, 200)] + [rnd.randint(0, 9)] * rnd.randint(0, 9)
    return words


def nested_words(rnd):
    inner = [rnd.randint(0, 1) for _ in range(rnd.randint(1, 4))] * rnd.randint(1, 9) + [2] * rnd.randint(0, 2)
    return ((inner * rnd.randint(1, 6) + [3] * rnd.randint(0, 1)) * rnd.randint(1, 5))[rnd.randint(0, 5):]


@pytest.mark.parametrize("make", [
    periodic_words, nested_words, lambda rnd: [rnd.randint(0, 1) for _ in range(rnd.randint(0, 120))],
    lambda rnd: [int(i == rnd.randint(0, 199)) for i in range(rnd.randint(0, 200))],
])
def test_runs_against_all_periods(make):
    rnd = random.Random(4)
    for _ in range(250):
        words = make(rnd)
        found = periodic.find_runs(np.array(words, dtype=np.int64))
        assert list(zip(*(f.tolist() for f in found))) == brute_runs(words), words


def test_range_successor():
    rng = np.random.default_rng(2)
    values = rng.permutation(200)
    ask = periodic.RangeSuccessor(values)
    lo = rng.integers(0, 150, 300)
    hi = lo + rng.integers(1, 50, 300)
    bound = rng.integers(0, 300, 300)
    below = ask.below(lo, hi, bound)
    assert below.tolist() == [int((values[a:b] < x).sum()) for a, b, x in zip(lo, hi, bound)]
    rank = np.minimum(below, hi - lo - 1)
    assert ask.ranked(lo, hi, rank).tolist() == [int(np.sort(values[a:b])[k]) for a, b, k in zip(lo, hi, rank)]


@pytest.mark.parametrize("plant", [False, True])
def test_rows_against_brute_force(spark, docs, none, plant):
    rnd = random.Random(9)
    more = [(1000 + k, " ".join(map(str, periodic_words(rnd))), None, k, None, 0) for k in range(60)]
    more += [(2000 + k, invented(rnd, rnd.randint(1, 90)), None, k, None, 0) for k in range(60)]
    rows = docs.union(spark.createDataFrame(more, docs.schema))
    got = periodic.measure(rows, plant=plant, keep=True)
    want = Counter(brute_row(r.doc_id, r.text, plant) for r in rows.select("doc_id", "text").collect())
    assert Counter(tuple(r) for r in got.drop("runs", "collapsed").collect()) == want
    assert sum(n for row, n in want.items() if row[1]) > 20
    for r in got.collect():
        assert r.collapsed_sha256 == hashlib.sha256(r.collapsed.encode()).hexdigest() and len(r.runs) == r.n_runs
    assert periodic.measure(none).collect() == []


def test_a_text_above_a_slice(spark):
    """A text of over a megabyte with one long period, and one of equal words."""
    rnd = random.Random(3)
    period = invented(rnd, 52_000).split()
    text = " ".join((["first"] + period * 4)[:159_000]).replace(" ", " \n ")
    assert len(text) > 1 << 20
    rows = spark.createDataFrame([(1, text), (2, "a " * 300_000)], "doc_id long, text string")
    found = {r.doc_id: r for r in periodic.measure(rows).collect()}
    assert [tuple(x) for x in found[1].runs] == [(1, 158_999, 52_000)] and found[1].collapsed.count(" ") == 52_000
    assert [tuple(x) for x in found[2].runs] == [(0, 300_000, 1)] and found[2].collapsed == "a"
