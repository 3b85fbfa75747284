"""Runs of words: maximal periodic stretches, found by internal pattern matching.

A run of period q and three periods or more holds, next to its start, a block of words that begins
at a multiple of its length 2**k and occurs again q words further on. So at each dyadic length the
aligned blocks ask where they occur in the neighbouring window. The suffixes that begin with a block
are an interval of the suffix array; a wavelet matrix over the array answers which places of the
interval fall into a window: how many, the first and the second. Places of a block in a window no
longer than itself stand in arithmetic progression, so these three tell all of them. One or two are
candidate periods as they are; of a longer progression only the first one, and the two shifts that carry the ends or the starts of the
block's own run onto each other, can be the least period of a longer run. Each candidate is extended to both sides by the names of the dyadic factors, which are exact.

A document whose blocks of the least length are all different has no run and needs no suffix array;
this is seen from rolling hashes of all its places, where equal blocks have equal hashes.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wirecorpus.llm.common import by_slice

# a run has at least so many words, and so many periods
LEAST_WORDS, LEAST_PERIODS = 24, 3
# the shortest block: a run of 24 words holds an aligned one of 8 and its next occurrence
BLOCK = 8
# words whose suffixes are sorted together, one document at least
SORTED_WORDS = 150_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


class RangeSuccessor:
    """Wavelet matrix of a sequence of integers: order statistics inside intervals, many at a time."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(int(values.max(initial=0)).bit_length(), 1)
        self.ones, self.zeros = [], []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            count = np.zeros(len(values) + 1, dtype=np.int32)
            np.cumsum(one, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(values) - int(count[-1]))
            values = np.concatenate([values[~one], values[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of each interval [lo, hi) are less than the bound."""
        found = np.where(bound >= 1 << self.bits, hi - lo, 0)
        lo, hi = lo.copy(), np.where(bound >= 1 << self.bits, lo, hi)
        for level, (count, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = (bound >> (self.bits - 1 - level) & 1).astype(bool)
            ones_lo, ones_hi = count[lo], count[hi]
            found += np.where(one, (hi - lo) - (ones_hi - ones_lo), 0)
            lo = np.where(one, zeros + ones_lo, lo - ones_lo)
            hi = np.where(one, zeros + ones_hi, hi - ones_hi)
        return found

    def ranked(self, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of each rank (from 0) in the order of the interval's values; ranks must exist."""
        lo, hi, rank = lo.copy(), hi.copy(), rank.copy()
        value = np.zeros(len(lo), dtype=np.int64)
        for count, zeros in zip(self.ones, self.zeros):
            ones_lo, ones_hi = count[lo], count[hi]
            small = (hi - lo) - (ones_hi - ones_lo)
            one = rank >= small
            rank = np.where(one, rank - small, rank)
            value = value << 1 | one
            lo = np.where(one, zeros + ones_lo, lo - ones_lo)
            hi = np.where(one, zeros + ones_hi, hi - ones_hi)
        return value


class Factors:
    """Names of the dyadic factors of a sequence, its suffix array, and what is asked of them."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        _, names = np.unique(symbols, return_inverse=True)
        self.n, self.names = n, [np.append(names.astype(np.int64), -1)]
        while True:
            name, width = self.names[-1], 1 << (len(self.names) - 1)
            if width >= n or name.max() == n - 1:
                break
            follow = np.full(n, -1, dtype=np.int64)
            follow[: n - width] = name[width:n]
            _, longer = np.unique(name[:n] * (n + 2) + follow + 1, return_inverse=True)
            self.names.append(np.append(longer.astype(np.int64), -1))
        # names follow the order of the factors, and the last ones are of all suffixes
        self.suffixes = np.argsort(self.names[-1][:n], kind="stable")
        self.place = np.empty(n, dtype=np.int64)
        self.place[self.suffixes] = np.arange(n)
        self.successor = RangeSuccessor(self.suffixes)

    def interval(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place, the interval of the suffix array that begins with its factor of 2**level."""
        ordered = self.names[level][self.suffixes]
        edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        which = np.searchsorted(edges, self.place, side="right") - 1
        return edges[which], edges[which + 1]

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal symbols from a and from b on."""
        a, b, found = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            name, width = self.names[level], 1 << level
            while True:
                same = (b + width <= self.n) & (a + width <= self.n)
                same &= name[np.minimum(a, self.n)] == name[np.minimum(b, self.n)]
                if not same.any():
                    break
                step = np.where(same, width, 0)
                a, b, found = a + step, b + step, found + step
                if level < len(self.names) - 1:
                    break  # twice this width was different
        return found

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal symbols that end before a and before b, a being the lesser."""
        a, b, found = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            name, width = self.names[level], 1 << level
            while True:
                same = a >= width
                same &= name[np.maximum(a - width, 0)] == name[np.maximum(b - width, 0)]
                if not same.any():
                    break
                step = np.where(same, width, 0)
                a, b, found = a - step, b - step, found + step
                if level < len(self.names) - 1:
                    break
        return found


def _candidates(factors: Factors, width: int, blocks: np.ndarray, near: int, far: int, lo, hi):
    """(place, shift) pairs among which the least period of every run over a block is found.

    ``blocks`` are places, and the window of their next occurrence begins ``near`` and ends before
    ``far`` words further on.
    """
    ask = factors.successor
    before = ask.below(lo, hi, blocks + near)
    many = ask.below(lo, hi, blocks + far) - before
    some = many > 0
    blocks, lo, hi, before, many = blocks[some], lo[some], hi[some], before[some], many[some]
    if not len(blocks):
        return blocks, blocks
    first = ask.ranked(lo, hi, before)
    second = np.where(many > 1, ask.ranked(lo, hi, before + np.minimum(many - 1, 1)), first)
    few = many <= 2
    at, shift = [blocks, blocks[few]], [first - blocks, (second - blocks)[few]]
    # of a progression, the first shift, which may be the block's own least period, and those that
    # carry the block's run of that period onto the other one
    blocks, first, step = blocks[~few], first[~few], (second - first)[~few]
    ends = (first + factors.forward(first, first + step)) - (blocks + factors.forward(blocks, blocks + step))
    starts = (first - factors.backward(first, first + step)) - (blocks - factors.backward(blocks, blocks + step))
    for moved in (ends, starts):
        fits = (moved >= near) & (moved < far)
        at.append(blocks[fits])
        shift.append(moved[fits])
    return np.concatenate(at), np.concatenate(shift)


def find_runs(
    symbols: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of the sequence, by start, then period.

    A run has its least period q, at least ``max(least, periods * q)`` symbols, and cannot be
    extended keeping q. ``least`` is 24 or more and ``periods`` 3 or more.
    """
    n = len(symbols)
    if n < least:
        return (np.zeros(0, dtype=np.int64),) * 3
    factors = Factors(symbols)
    at, shift = [], []
    level = BLOCK.bit_length() - 1
    while level < len(factors.names) and 3 << level <= n:
        width = 1 << level
        lo, hi = factors.interval(level)
        blocks = np.arange(0, n - width + 1, width)
        lo, hi = lo[blocks], hi[blocks]
        again = hi - lo > 1
        blocks, lo, hi = blocks[again], lo[again], hi[again]
        for near, far in [(width, 2 * width)] + [(1, width)] * (width == BLOCK):
            for found, into in zip(_candidates(factors, width, blocks, near, far, lo, hi), (at, shift)):
                into.append(found)
        level += 1
    at = np.concatenate(at) if at else np.zeros(0, dtype=np.int64)
    shift = np.concatenate(shift) if shift else at
    left = factors.backward(at, at + shift)
    length = left + shift + factors.forward(at, at + shift)
    start = at - left
    long = length >= np.maximum(least, periods * shift)
    found = np.unique(np.stack([start[long], length[long], shift[long]], axis=1), axis=0)
    # one stretch is also found with multiples of its least period, which come after it
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[new]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return found[:, 0], found[:, 1], found[:, 2]


def repeated_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) where the words from a on repeat the p words at a, for one id in ten; see ``measure``."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _may_repeat(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each document, whether a block of least length may occur twice in it."""
    count = np.diff(first)
    owner = np.repeat(np.arange(len(count)), count)
    hashes = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    hashes ^= hashes >> np.uint64(29)
    width = 1
    while width < BLOCK:
        longer = hashes * np.uint64(0xBF58476D1CE4E5B9)
        longer[:-width] += hashes[width:]
        longer ^= longer >> np.uint64(31)
        hashes, width = longer * _MIX, 2 * width
    whole = np.arange(len(ids)) + BLOCK <= np.repeat(first[1:], count)
    keys, owner = (hashes ^ (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB))[whole], owner[whole]
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    flags = np.zeros(len(count), dtype=bool)
    if len(twice):
        at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        flags[owner[twice[at] == keys]] = True
    return flags


def _word_runs(words: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each document, documents handled together by about so many words."""
    known: dict[bytes, int] = {}
    count = np.array([len(w) for w in words], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    ids = np.fromiter((known.setdefault(w, len(known)) for each in words for w in each), dtype=np.int64, count=int(first[-1]))
    found: list[list[tuple[int, int, int]]] = [[] for _ in words]
    pending = np.flatnonzero(_may_repeat(ids, first) & (count >= LEAST_WORDS)).tolist() if len(ids) else []
    while pending:
        group, size = [], 0
        while pending and (not group or size + count[pending[0]] <= SORTED_WORDS):
            group.append(pending.pop(0))
            size += count[group[-1]]
        # words of different documents are different symbols, so nothing is equal across documents
        symbols = np.concatenate([ids[first[d]: first[d + 1]] + k * len(known) for k, d in enumerate(group)])
        begins = np.concatenate([[0], np.cumsum(count[group])])
        starts, lengths, periods = find_runs(symbols)
        owner = np.searchsorted(begins, starts, side="right") - 1
        for k, s, length, q in zip(owner.tolist(), (starts - begins[owner]).tolist(), lengths.tolist(), periods.tolist()):
            found[group[k]].append((s, length, q))
    return found


def measure(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plant: bool = False, keep: bool = True,
) -> DataFrame:
    """Runs of words of every row, and the text without its repetitions.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of at least 24 words and
    three periods that cannot be extended keeping its least period. Columns: doc_id, n_runs; start,
    length, period and exponent_milli (1000 * length / period, cut) of the run with the greatest
    length / period (ties: least start, then period; null without runs); runs_sha256 over
    ``start,length,period`` lines of all runs by start, then period; collapsed_sha256 over the
    words that are left when each run keeps its first period, with single spaces between; and with
    ``keep`` the runs (array of structs) and the collapsed text themselves.

    With ``plant``, the words of one document in ten are first replaced from a place a on by
    repetitions of the p words there; place and length come from the crc32 of the id, so that each
    corpus has known runs. A null text has no words, and nothing is planted without an id or a
    word. Nothing is shuffled; repeated rows give repeated rows, no row gives no row, other columns
    are not read.
    """
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            idents = batch.column(0).to_pylist()
            words = [(t or b"").split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            if plant:
                for k, (ident, each) in enumerate(zip(idents, words)):
                    tail = repeated_tail(ident, len(each))
                    if tail:
                        a, p = tail
                        period = each[a: a + p]
                        words[k] = (each[:a] + period * ((len(each) - a) // p + 1))[: len(each)]
            out: dict[str, list] = {f: [] for f in (
                "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed")}
            for each, runs in zip(words, _word_runs(words)):
                best = None
                for run in runs:  # by start, then period: only a greater exponent replaces
                    if best is None or run[1] * best[2] > best[1] * run[2]:
                        best = run
                stay = bytearray(b"\1") * len(each)
                for s, length, q in runs:
                    stay[s + q: s + length] = bytes(length - q)
                collapsed = b" ".join(itertools.compress(each, stay) if runs else each)
                lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
                out["n_runs"].append(len(runs))
                for name, value in zip(("start", "length", "period"), best or (None,) * 3):
                    out[name].append(value)
                out["exponent_milli"].append(best and 1000 * best[1] // best[2])
                out["runs_sha256"].append(hashlib.sha256(lines.encode()).hexdigest())
                out["collapsed_sha256"].append(hashlib.sha256(collapsed).hexdigest())
                if keep:
                    out["runs"].append([{"start": s, "length": length, "period": q} for s, length, q in runs])
                    out["collapsed"].append(collapsed.decode())
            run_type = pa.struct([(f, pa.int64()) for f in ("start", "length", "period")])
            types = {"runs_sha256": pa.string(), "collapsed_sha256": pa.string(), "runs": pa.list_(run_type), "collapsed": pa.string()}
            names = [f for f in out if keep or f not in ("runs", "collapsed")]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(out[f], types.get(f, pa.int64())) for f in names)], ["doc_id", *names])
        return work

    schema = (
        "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string"
        + ", runs array<struct<start:long,length:long,period:long>>, collapsed string" * keep)
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(by_slice(make, "text"), schema)
