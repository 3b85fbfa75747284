"""Fingerprints by locally consistent parsing with deterministic coin tossing.

A text is a run of symbols, first its code points. One level of parsing:

* a run of equal symbols becomes one symbol, named by the symbol and the run's length;
* every symbol gets the place and value of the lowest bit in which it differs from the one before
  it, three times over, which leaves a handful of labels of which neighbours still differ;
* symbols whose label is greater than both neighbours' begin a block; each block is named by the
  hash of its symbols, and the names are the next level's symbols.

Where a block begins depends on a few symbols around it only, so equal substrings have the same
blocks inside, wherever they stand. The names of all levels together are the text's phrases; the
least of their hashes are its fingerprint, and the share of the least hashes of two fingerprints
that both have estimates how many phrases they share.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from wirecorpus.llm.superminhash import mix
from wirecorpus.session import stage

LEVELS, KEEP = 5, 48
# octets of text parsed at a time
PARSE = 1 << 19

_G = np.uint64(0x9E3779B97F4A7C15)
# place of the lowest bit of a power of two, by the 64-bit de Bruijn product
_BRUIJN = np.uint64(0x03F79D71B4CB0A89)


def _bit_places() -> np.ndarray:
    table = np.zeros(64, dtype=np.uint8)
    for k in range(64):
        table[((1 << k) * int(_BRUIJN) & 0xFFFFFFFFFFFFFFFF) >> 58] = k
    return table


def _next_labels(width: int) -> np.ndarray:
    """Label of a small symbol after another one, as a flat table over (before, symbol)."""
    out = np.zeros((width, width), dtype=np.uint8)
    for before in range(width):
        for symbol in range(width):
            low = (before ^ symbol) & -(before ^ symbol)
            if low:
                k = low.bit_length() - 1
                out[before, symbol] = 2 * k + (symbol >> k & 1)
    return out.reshape(-1)


PLACES, TABLE = _bit_places(), _next_labels(128)


def _collapse(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal symbols of one text as single symbols."""
    new = np.ones(len(symbols), dtype=bool)
    new[1:] = (symbols[1:] != symbols[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(symbols))).astype(np.uint64)
    names = np.where(lengths > 1, mix(symbols[starts] + lengths * _G), symbols[starts])
    return names, owner[starts]


def _parse(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the blocks and their texts. Neighbours in a text must differ."""
    n = len(symbols)
    first = np.ones(n, dtype=bool)
    first[1:] = owner[1:] != owner[:-1]
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[first] = ~symbols[first]
    differ = symbols ^ before
    low = differ & (~differ + np.uint64(1))
    place = PLACES[(low * _BRUIJN) >> np.uint64(58)]
    label = 2 * place + ((symbols & low) != 0)
    for _ in range(2):
        came = np.empty_like(label)
        came[1:] = label[:-1]
        came[first] = label[first] ^ 1
        label = TABLE[came.astype(np.int32) * 128 + label]
    rise = np.zeros(n, dtype=bool)
    rise[1:] = label[1:] > label[:-1]
    fall = np.ones(n, dtype=bool)
    fall[:-1] = (label[:-1] > label[1:]) | first[1:]
    # the last symbol of a text begins no block
    end = np.ones(n, dtype=bool)
    end[:-1] = first[1:]
    begins = first | (rise & fall & ~end)
    starts = np.flatnonzero(begins)
    lengths = np.diff(np.append(starts, n))
    inside = (np.arange(n) - np.repeat(starts, lengths)).astype(np.uint64)
    names = mix(np.add.reduceat(mix(symbols + (inside + np.uint64(1)) * _G), starts) + lengths.astype(np.uint64))
    return names, owner[starts]


def phrases(texts: list[str], levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of all phrases of all levels, ordered by text."""
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in texts])
    found, owners = [], []
    for level in range(1, levels + 1):
        if not len(symbols):
            break
        symbols, owner = _collapse(symbols, owner)
        symbols, owner = _parse(symbols, owner)
        found.append(mix(symbols + np.uint64(level)) >> np.uint64(32))
        owners.append(owner)
        counts = np.bincount(owner, minlength=len(texts))
        more = counts[owner] > 1  # a text that has become one symbol is done
        symbols, owner = symbols[more], owner[more]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    values, whose = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(whose, kind="stable")
    return values[order], whose[order]


def fingerprints(texts: list[str], levels: int = LEVELS, keep: int = KEEP) -> list[np.ndarray]:
    """The least distinct phrase hashes of each text, ascending; an empty text has none."""
    values, owner = phrases(texts, levels)
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        own = values[a:b]
        if len(own) > 16 * keep:  # the least of them, unless repeats leave too few
            few = np.unique(np.partition(own, 4 * keep)[: 4 * keep])
            out.append(few[:keep] if len(few) >= keep else np.unique(own)[:keep])
        else:
            out.append(np.unique(own)[:keep])
    return out


def likeness(a: np.ndarray, b: np.ndarray, keep: int = KEEP) -> float:
    """Estimated share of phrases in common: of the least hashes of both together, those both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:keep]
    return float(np.isin(union, np.intersect1d(a, b)).mean())


def as_text(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many, or all, of another text."""
    share = len(text) // 3
    return text[: len(text) - share] + following[:share]


_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_NAMES = re.findall(r"(\w+) \w+(?:,|$)", _RESULT)


def _compare(ids: list, texts: list[str], following: list[str]) -> list[pa.Array]:
    """Result columns of texts, each with the one that follows it."""
    out: list[list] = [[] for _ in _NAMES]
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) < PARSE):
            size += len(texts[stop])
            stop += 1
        own, after = texts[start:stop], following[start:stop]
        other = [edited(t, f) for t, f in zip(own, after)]
        # a text that follows is as a rule the next one, parsed once
        distinct = list(dict.fromkeys([*own, *other, *after]))
        prints = dict(zip(distinct, fingerprints(distinct)))
        for i, t, e, f in zip(ids[start:stop], own, other, after):
            row = (
                i, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), as_text(prints[t]), as_text(prints[e]),
                likeness(prints[t], prints[e]), likeness(prints[t], prints[f]),
            )
            for column, value in zip(out, row):
                column.append(value)
        start = stop
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return [pa.array(column, kind) for column, kind in zip(out, kinds)]


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of the text edited with the next one in descending id order.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). After
    the last row comes the first. A null text counts as empty, whose fingerprint is empty and alike
    (1.0) only to another empty one. Null ids come last; rows of equal ids follow each other by
    their text. Repeated rows give repeated rows. No row gives no row.

    Texts are sorted into ranges once. Only the last row of a range lacks its neighbour; it and the
    first row of each range are put down and met afterwards.
    """
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    ranged = picked.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def edge(kind: int, i, t: str) -> pa.RecordBatch:
            blank = [pa.nulls(1, c) for c in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int64()), *blank, pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([t])],
                [*_NAMES, "kind", "part", "text"])

        held = None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not texts:
                continue
            if held is None:
                yield edge(1, ids[0], texts[0])
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = ids.pop(), texts[-1]
            columns = _compare(ids, texts[:-1], texts[1:])
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([0] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string())],
                [*_NAMES, "kind", "part", "text"])
        if held is not None:
            yield edge(2, *held)

    rows = stage(ranged.mapInArrow(run, f"{_RESULT}, kind int, part int, text string"))
    # one row for each range that has rows, without its text
    parts = rows.where("kind = 1").select("part").distinct()
    follows = parts.select(
        "part", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy(F.lit(0)))).alias("next"))
    tails = rows.where("kind = 2").select("doc_id", "part", "text").join(follows, "part")
    heads = rows.where("kind = 1").select(F.col("part").alias("next"), F.col("text").alias("after"))
    met = tails.join(heads, "next").select("doc_id", "text", "after")

    def finish(batches):
        for batch in batches:
            ids, texts, after = (batch.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays(_compare(ids, texts, after), _NAMES)

    return rows.where("kind = 0").select(*_NAMES).unionByName(met.mapInArrow(finish, _RESULT))
