"""Files that are one JSON array each, read in parts: an array of any size is cut by many tasks.

The text source cuts files into byte ranges, and here into pieces that end with ``}``, so no row is
longer than what lies between two closing braces. Whether a range begins inside a string, and how
deep, is not known to the task that reads it. A first pass therefore sums up each range for both
cases: parity of its quotes, change of depth, and commas by depth. Ranges of a file in order then
tell with which state each one begins. A second pass cuts the elements. Those that lie within one
range stay where they are; only the first and the last stretch of a range meet those of its
neighbours.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

END = "}"
SUMMARY = "file STRING, block BIGINT, quotes INT, depth ARRAY<INT>, commas ARRAY<MAP<INT, BIGINT>>"
STRETCHES = "file STRING, at BIGINT, block BIGINT, whole BOOLEAN, text STRING"

# the rest of a string, and what counts outside of strings; an escape is one unit in either state. Runs
# without quote and backslash are taken whole and never given back, so a long string costs one loop
_INSIDE = r'[^"\\]*+(?:\\.[^"\\]*+)*+"'
_REST = re.compile(_INSIDE, re.DOTALL)
_MARK = re.compile(rf'"{_INSIDE}|\\.|["\[\]{{}},]', re.DOTALL)


class Scanner:
    """State over the pieces of a range: inside a string or not, and the depth."""

    def __init__(self, inside: bool = False, depth: int = 0) -> None:
        self.inside, self.depth, self.quotes = inside, depth, 0

    def commas(self, piece: str) -> Iterator[tuple[int, int, int]]:
        """(place, depth before, depth after) of each comma and bracket of a piece that is outside of strings."""
        at = 0
        if self.inside:
            rest = _REST.match(piece)
            if rest is None:
                return
            at, self.inside, self.quotes = rest.end(), False, self.quotes + 1
        for mark in _MARK.finditer(piece, at):
            first = mark.group()[0]
            if first == '"':
                whole = mark.end() - mark.start() > 1
                self.quotes += 1 + whole
                if not whole:
                    self.inside = True
                    return
            elif first != "\\":
                before = self.depth
                self.depth += (first in "[{") - (first in "]}")
                yield mark.start(), before, self.depth


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """((file, block), pieces) of successive rows, each piece with its end."""
    for batch in batches:
        run, pieces = None, []
        for value, file, block in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != run:
                if pieces:
                    yield run, pieces
                run, pieces = (file, block), []
            pieces.append(value + END)
        if pieces:
            yield run, pieces


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    states: dict[tuple[str, int], tuple] = {}
    for key, pieces in _ranges(batches):
        if key not in states:
            states[key] = (Scanner(False), Scanner(True)), (Counter(), Counter())
        for scanner, found in zip(*states[key]):
            for piece in pieces:
                found.update(before for _, before, after in scanner.commas(piece) if before == after)
    if states:
        yield pa.RecordBatch.from_pylist([
            {"file": file, "block": block, "quotes": scanners[0].quotes % 2, "depth": [s.depth for s in scanners],
             "commas": [list(f.items()) for f in found]}
            for (file, block), (scanners, found) in states.items()
        ], schema=pa.schema([
            ("file", pa.string()), ("block", pa.int64()), ("quotes", pa.int32()), ("depth", pa.list_(pa.int32())),
            ("commas", pa.list_(pa.map_(pa.int32(), pa.int64())))]))


def _starts(pieces: DataFrame) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """(inside a string, depth, number of the element) at the begin of each range.

    One short row per input split comes to the driver, which has listed these splits already.
    """
    starts, state, last = {}, (False, 0, 0), None

    def closed() -> None:
        # the end given to every piece closes what the last piece of a file never opened
        if last is not None and state[:2] != (False, -1):
            raise ValueError(f"not one whole JSON array: {last}")

    for r in sorted(pieces.mapInArrow(_summaries, SUMMARY).collect(), key=lambda r: (r.file, r.block)):
        if r.file != last:
            closed()
            last, state = r.file, (False, 0, 0)
        inside, depth, at = starts[r.file, r.block] = state
        state = inside != bool(r.quotes), depth + r.depth[inside], at + r.commas[inside].get(1 - depth, 0)
    closed()
    return starts


def _cut(starts: dict, whole: bool):
    """A function that yields the elements inside one range, or the stretches at its two ends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple[str, int], list] = {}
        for key, pieces in _ranges(batches):
            if key not in states:
                inside, depth, at = starts[key]
                # scanner, number of the element, whether it began before, its text so far
                states[key] = [Scanner(inside, depth), at, True, []]
            state, out = states[key], []
            scanner = state[0]
            for piece in pieces:
                begin = 0
                for place, before, after in scanner.commas(piece):
                    if before == 0:
                        if (after == 1 and piece[place] != "[") or piece[begin:place].strip():
                            raise ValueError(f"not one whole JSON array: {key[0]}")
                        begin, state[2] = place + 1, False
                    elif before == 1 and after < 2:  # a comma between elements, or the end of the array
                        state[3].append(piece[begin:place])
                        if whole != state[2]:
                            out.append((*key, state[1], not state[2], "".join(state[3])))
                        state[1:], begin = [state[1] + 1, False, []], place + 1
                if scanner.depth > 0 or scanner.inside:
                    state[3].append(piece[begin:])
            yield _rows(out)
        if not whole:
            yield _rows([(*key, at, False, "".join(text)) for key, (_, at, _, text) in states.items() if text])

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """The stretches (file, block, at, whole, text) as a batch."""
    file, block, at, whole, text = zip(*rows) if rows else ((),) * 5
    return pa.RecordBatch.from_arrays([
        pa.array(file, pa.string()), pa.array(at, pa.int64()), pa.array(block, pa.int64()),
        pa.array(whole, pa.bool_()), pa.array(text, pa.string())], ["file", "at", "block", "whole", "text"])


def read_elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, at, text) of the elements of each file's array, ``at`` from 0.

    A file that is not one whole array is an error that names it; an empty one has no elements.
    """
    pieces = spark.read.option("lineSep", END).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    starts = _starts(pieces)
    inner = pieces.mapInArrow(_cut(starts, True), STRETCHES).select("file", "at", "text")
    edges = pieces.mapInArrow(_cut(starts, False), STRETCHES)
    listed = F.array_sort(F.collect_list(F.struct("block", "text")))
    joined = edges.groupBy("file", "at").agg(F.array_join(F.transform(listed, lambda s: s["text"]), "").alias("text"))
    return inner.union(joined).where(F.col("text").rlike(r"\S"))
