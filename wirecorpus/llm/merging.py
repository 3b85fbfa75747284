"""Merges of adjacent symbols, for many units of text at once.

The agenda of a unit always gives its best pair next, the leftmost of equal ones. Units do not touch
each other, so in every round the best pair of each unit is merged, all units of a slice together;
a unit whose agenda is empty leaves. Pairs are looked up in hash tables held as arrays.
"""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int32).max
_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class PairTable:
    """(left, right) -> rank, for non-negative symbols below 2**31; ranks are those of the merged symbol."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> None:
        """``merged`` is the symbol of each rank."""
        self.merged = merged.astype(np.int64)
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        self.levels, bits = [], max(int(4 * len(keys)).bit_length(), 4)
        while len(keys):
            factor, shift = _FACTORS[len(self.levels) % 4], np.uint64(64 - bits)
            slot = ((keys ^ keys >> np.uint64(29)) * factor >> shift).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            table, ranks = np.full(1 << bits, np.iinfo(np.uint64).max, dtype=np.uint64), np.full(1 << bits, NONE, dtype=np.int32)
            table[slot[first]], ranks[slot[first]] = keys[first], rank[first]
            self.levels.append((factor, shift, table, ranks))
            rest = np.ones(len(keys), dtype=bool)
            rest[first] = False
            keys, rank, bits = keys[rest], rank[rest], max(bits - 2, 4)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NONE`` where there is none."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        found, at = np.full(len(keys), NONE, dtype=np.int32), None
        for factor, shift, table, ranks in self.levels:
            slot = ((keys ^ keys >> np.uint64(29)) * factor >> shift).astype(np.int64)
            there = table[slot]
            same = there == keys
            if at is None:
                found = np.where(same, ranks[slot], NONE)
                at = np.flatnonzero(~same & (there != np.iinfo(np.uint64).max))
            else:
                found[at[same]] = ranks[slot[same]]
                at = at[~same & (there != np.iinfo(np.uint64).max)]
            if not len(at):
                break
            keys = (left[at].astype(np.uint64) << np.uint64(32)) | right[at].astype(np.uint64)
        return found


def merge(table: PairTable, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, lengths) of all units, one after the other, when nothing can be merged any more.

    Units have one symbol at least.
    """
    symbols = symbols.astype(np.int64)
    many = len(lengths)
    unit = np.repeat(np.arange(many), lengths)
    rank = np.full(len(symbols), NONE, dtype=np.int32)  # of each symbol and the next one in its unit
    inner = np.flatnonzero(unit[1:] == unit[:-1])
    rank[inner] = table.rank(symbols[inner], symbols[inner + 1])
    out_symbols, out_unit = [], []
    while len(symbols):
        first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        size = np.diff(np.append(first, len(symbols)))
        best = np.minimum.reduceat(rank, first)
        done = best == NONE
        if done.any():
            gone = np.repeat(done, size)
            out_symbols.append(symbols[gone])
            out_unit.append(unit[gone])
            symbols, unit, rank, size, best = symbols[~gone], unit[~gone], rank[~gone], size[~done], best[~done]
            if not len(symbols):
                break
        hits = np.flatnonzero(rank == np.repeat(best, size))
        at = hits[np.concatenate([[True], unit[hits[1:]] != unit[hits[:-1]]])]
        symbols[at] = table.merged[best]
        stay = np.ones(len(symbols), dtype=bool)
        stay[at + 1] = False
        symbols, unit, rank = symbols[stay], unit[stay], rank[stay]
        at = at - np.arange(len(at))  # one symbol less for each unit before
        rank[at] = NONE
        right = at[at + 1 < len(symbols)]
        right = right[unit[right + 1] == unit[right]]
        left = at[at > 0] - 1
        left = left[unit[left] == unit[left + 1]]
        fresh = np.concatenate([left, right])
        rank[fresh] = table.rank(symbols[fresh], symbols[fresh + 1])
    if not out_symbols:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    unit = np.concatenate(out_unit)
    order = np.argsort(unit, kind="stable")
    return np.concatenate(out_symbols)[order], np.bincount(unit, minlength=many)


def encoded(table: PairTable, symbols: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """The merged symbols of each unit as little-endian unsigned 32-bit octets."""
    merged, lengths = merge(table, symbols, lengths)
    raw, ends = merged.astype("<u4").tobytes(), (4 * np.cumsum(lengths)).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]
