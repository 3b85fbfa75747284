"""Best-fit decreasing packing of token pieces into sequences of a fixed capacity.

A piece goes into the open sequence with the least room that still holds it. A segment tree over
the possible rooms (0 to capacity) finds that sequence in logarithmic time.

Packing is done in groups of about ``GROUP_TOKENS`` tokens, dealt by a hash of the row's place in
the staged table, so no key can be hot. Sequences a group could not fill are opened again and their
pieces packed together with those of other groups, until one group is left or this stops paying.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wirecorpus.llm.common import by_slice, kept
from wirecorpus.llm.memo import TokenMemo
from wirecorpus.session import stage

# tokens packed in one task: about a thousand sequences of 4096
GROUP_TOKENS = 4 << 20
# a sequence filled less than this is opened again with those of other groups
FULL = 0.995


class Rooms:
    """Segment tree over the rooms 0 to capacity: which of them have an open sequence."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        at = room + self.leaves
        while at and not self.some[at]:
            self.some[at] = 1
            at >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """(room, sequence) of the tightest open sequence that holds the length."""
        some, at = self.some, length + self.leaves
        if not some[at]:
            while True:  # up to the first subtree on the right that has an open sequence
                if at & (at + 1) == 0:
                    return None
                if not at & 1 and some[at + 1]:
                    at += 1
                    break
                at >>= 1
            while at < self.leaves:
                at = 2 * at if some[2 * at] else 2 * at + 1
        room = at - self.leaves
        sequence = self.open[room].pop()
        if not self.open[room]:
            while at and not (at < self.leaves and (some[2 * at] or some[2 * at + 1])):
                some[at] = 0
                at >>= 1
        return room, sequence


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, taken as given (descending), and each sequence's fill."""
    rooms, fills = Rooms(capacity), []
    sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    for i, length in enumerate(lengths.tolist()):
        found = rooms.take(length)
        if found is None:
            room, number = capacity, len(fills)
            fills.append(0)
        else:
            room, number = found
        sequence[i], offset[i] = number, capacity - room
        fills[number] += length
        if room > length:
            rooms.put(room - length, number)
    return sequence, offset, np.array(fills, dtype=np.int64)


def token_pieces(
    docs: DataFrame, path: str, end_id: int, capacity: int, doc_id: str = "doc_id", text: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 [, ids]) of each document's tokens and its end id.

    Only a document of more tokens than the capacity is cut. A null text counts as empty: its one
    piece is the end id. Repeated rows give repeated pieces, no row gives no piece, and other columns
    are not read.
    """
    tail = np.array([end_id], dtype="<u4").tobytes()
    width = 4 * capacity

    def make():
        memo = kept(("tokens", path), lambda: TokenMemo(path))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            owner, piece, crc, length, ids = [], [], [], [], []
            for at, raw in enumerate(memo.encode(batch.column(1))):
                raw += tail
                for number, begin in enumerate(range(0, len(raw), width)):
                    part = raw[begin: begin + width]
                    owner.append(at)
                    piece.append(number)
                    crc.append(zlib.crc32(part))
                    length.append(len(part) // 4)
                    if keep_ids:
                        ids.append(np.frombuffer(part, dtype="<i4"))
            number = pa.array(piece, pa.int32())
            columns = [
                batch.column(0).take(pa.array(owner, pa.int64())), number,
                pa.array(np.array(piece, dtype=np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            return pa.RecordBatch.from_arrays(columns, names)
        return work

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(by_slice(make, "text"), schema)


def pack(pieces: DataFrame, capacity: int, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to capacity.

    Inside a sequence pieces follow without gaps from offset 0. A piece of full length is a sequence
    of its own, with a negative number. Equal rows are packed as different pieces. No row gives no
    row; a length outside 1 to capacity is an error. Columns named ``sequence_id``, ``offset`` or
    with a leading ``_pack`` are replaced.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset") and not c.startswith("_pack")]
    rows = stage(pieces.select(*names))
    bad = F.raise_error(F.concat(F.lit("length outside the capacity: "), F.col("length").cast("string")))
    whole = F.when(F.col("length").between(1, capacity), F.col("length") == capacity).otherwise(bad.cast("boolean"))
    full = rows.where(whole).withColumns({
        "sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"),
    })
    done = [full]
    rest = rows.where(~whole)
    begin, before = 0, None
    while True:
        tokens = rest.agg(F.sum("length")).first()[0] or 0
        if not tokens:
            break
        groups = -(-tokens // group_tokens)
        last = groups == 1 or before is not None and tokens > before // 2
        placed = stage(_pack_groups(rest, capacity, groups, begin))
        if last:
            done.append(placed.drop("_pack_fill"))
            break
        filled = F.col("_pack_fill") >= FULL * capacity
        done.append(placed.where(filled).drop("_pack_fill"))
        rest = placed.where(~filled).select(*names)
        begin, before = begin + groups * (capacity + group_tokens), tokens
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _pack_groups(rest: DataFrame, capacity: int, groups: int, begin: int) -> DataFrame:
    """Pack inside each of so many groups. Numbers: ``begin`` + group + groups * number in the group.

    A group could open as many sequences as it has pieces; in tokens, at most one per two sequences
    is half empty, so ``groups * (capacity + group_tokens)`` numbers are more than are used.
    """
    names = rest.columns
    place = F.xxhash64(F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    dealt = rest.withColumn("_pack_group", F.pmod(place, F.lit(groups)))

    def run(key, table):
        lengths = table["length"].to_numpy()
        keys = [np.nan_to_num(table[c].to_pandas().to_numpy(dtype=float), nan=-1.0) for c in ("start", "doc_id") if c in names]
        order = np.lexsort([*keys, -lengths])
        sequence, offset, fills = best_fit(lengths[order], capacity)
        out = table.select(names).take(pa.array(order))
        return (
            out.append_column("sequence_id", pa.array(begin + key[0].as_py() + groups * sequence))
            .append_column("offset", pa.array(offset))
            .append_column("_pack_fill", pa.array(fills[sequence]))
        )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return dealt.groupBy("_pack_group").applyInArrow(run, f"{fields}, sequence_id long, offset long, _pack_fill long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of rows packed with their ``ids``; a sequence is bounded by the capacity."""
    listed = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(listed, lambda p: p["ids"])).alias("ids"))
