"""Captures and prompts that arrive continuously."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from wirecorpus.operators.catalog import FLOW_PACKETS, PACKET_MARK
from wirecorpus.operators.metrics import class_counts as metric_counts, precision_recall_f1
from wirecorpus.operators.routing import Model, dual_stage
from wirecorpus.session import checkpoint_base

REQUEST_SCHEMA = "request_id STRING, human_instruction STRING, traffic_data STRING"
KEY_NAMES = ["capture", "ip_proto", "end_a", "end_b"]


# --- prompt scoring ----------------------------------------------------------------------------

def request_stream(spark: SparkSession, folder: str, files_per_batch: int = 10) -> DataFrame:
    """Requests dropped into a folder as JSON; the rate limit is a number of files per batch."""
    return spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


def score_requests(
    requests: DataFrame, registry: DataFrame, router: Callable[[str | None], Model],
    expert: Callable[[str | None], Model], variant: str = "service",
) -> DataFrame:
    """Requests to task_response, final_response and status; stateless, so batch and stream agree."""
    return dual_stage(requests, registry, router, expert, variant)


# --- flow assembly -----------------------------------------------------------------------------

PART_SCHEMA = (
    "capture STRING, ip_proto INT, end_a STRING, end_b STRING, first_us BIGINT, last_us BIGINT, n_packets BIGINT, "
    "times ARRAY<BIGINT>, orders ARRAY<BIGINT>, pieces ARRAY<STRING>")
FLOW_SCHEMA = (
    "capture STRING, ip_proto INT, end_a STRING, end_b STRING, first_us BIGINT, last_us BIGINT, n_packets BIGINT, "
    "flow_text STRING")
# an open session: its bounds, its count and its first pieces
OPEN_SCHEMA = "first_us BIGINT, last_us BIGINT, n_packets BIGINT, times ARRAY<BIGINT>, orders ARRAY<BIGINT>, pieces ARRAY<STRING>"
# open sessions are kept together in so many buckets of flows, each read and written in one step
FLOW_BUCKETS = 4096
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def joined_sessions(parts: list[tuple], gap_us: int, k: int) -> list[tuple]:
    """Sessions (``OPEN_SCHEMA``) of one flow, those less than the gap apart joined; k pieces are kept of each."""
    out: list[list] = []
    for first, last, n, times, orders, pieces in sorted(parts, key=lambda p: p[0]):
        listed = list(zip(times, orders, pieces))
        if out and first - out[-1][1] < gap_us:
            one = out[-1]
            one[1], one[2] = max(one[1], last), one[2] + n
            one[3] = sorted(one[3] + listed, key=lambda p: p[:2])[:k]
        else:
            out.append([first, last, n, sorted(listed, key=lambda p: p[:2])[:k]])
    return [(first, last, n, *(list(x) for x in zip(*listed))) for first, last, n, listed in out]


def session_parts(packets: DataFrame, gap_us: int, k: int) -> DataFrame:
    """``PART_SCHEMA``: the sessions that the packets of one input slice make up by themselves.

    This comes before the shuffle, so a flow that holds most of the packets sends on a few rows per
    slice, each with at most k pieces.
    """
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            flow = rows.groupby(KEY_NAMES, sort=False, dropna=False).ngroup().to_numpy()
            order = np.lexsort((rows["order_no"].to_numpy(), rows["ts_us"].to_numpy(), flow))
            rows, flow = rows.iloc[order], flow[order]
            times, orders, pieces = rows["ts_us"].to_numpy(), rows["order_no"].to_numpy(), rows["piece"].to_numpy()
            opens = np.ones(len(rows), dtype=bool)
            opens[1:] = (flow[1:] != flow[:-1]) | (times[1:] - times[:-1] >= gap_us)
            start = np.flatnonzero(opens)
            end = np.append(start[1:], len(rows))
            out = rows.iloc[start][KEY_NAMES].reset_index(drop=True)
            heads = list(zip(start.tolist(), np.minimum(end, start + k).tolist()))
            lists = {name: [c[i:j] for i, j in heads] for name, c in (("times", times), ("orders", orders), ("pieces", pieces))}
            bounds = {"first_us": times[start], "last_us": times[end - 1] if len(rows) else times, "n_packets": end - start}
            yield out.assign(**bounds, **{name: pd.Series(c, dtype=object) for name, c in lists.items()})

    timed = packets.where("ts_us IS NOT NULL").select(*KEY_NAMES, "ts_us", "order_no", "piece")
    return timed.mapInPandas(cut, PART_SCHEMA)


class FlowSessions(StatefulProcessor):
    """Open sessions of a bucket of flows.

    A session goes out when the watermark has passed its last packet by the gap. Calls to the state
    cost far more than the sessions in it, so a bucket is read, joined with what came, and written as
    one list, and has one timer, that of its first session to close.
    """

    def __init__(self, gap_us: int, k: int) -> None:
        self.gap_us, self.k = gap_us, k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", f"capture STRING, ip_proto INT, end_a STRING, end_b STRING, {OPEN_SCHEMA}")

    def _until_ms(self, session: tuple) -> int:
        return -(-(session[1] + self.gap_us) // 1000)

    def _settle(self, flows: dict[tuple, list[tuple]], watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Put off what is still open, with a timer, and yield what is closed."""
        listed = [(key, s, self._until_ms(s)) for key, sessions in flows.items() for s in sessions]
        closed = [(key, s) for key, s, until in listed if until <= watermark_ms]
        left = [(*key, *s) for key, s, until in listed if until > watermark_ms]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if left:
            self.open.put(left)
            self.handle.registerTimer(min(until for _, _, until in listed if until > watermark_ms))
        else:
            self.open.clear()
        if closed:
            names = [field.split()[0] for field in FLOW_SCHEMA.split(", ")]
            yield pd.DataFrame(
                [(*key, *s[:3], PACKET_MARK + PACKET_MARK.join(p for p in s[5] if p is not None)) for key, s in closed], columns=names)

    def _kept(self) -> dict[tuple, list[tuple]]:
        flows: dict[tuple, list[tuple]] = {}
        for row in self.open.get():
            flows.setdefault(tuple(row[:4]), []).append((*row[4:7], *map(list, row[7:])))
        return flows

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        flows = self._kept()
        came: dict[tuple, list[tuple]] = {}
        for part in rows:
            proto = [None if pd.isna(p) else int(p) for p in part["ip_proto"]]
            numbers = (part[name].tolist() for name in ("first_us", "last_us", "n_packets"))
            lists = ([[*map(int, x)] for x in part[name]] for name in ("times", "orders"))
            each = zip(part["capture"], proto, part["end_a"], part["end_b"], *numbers, *lists, map(list, part["pieces"]))
            for row in each:
                came.setdefault(row[:4], []).append(row[4:])
        for flow, parts in came.items():
            parts = flows.get(flow, []) + parts
            flows[flow] = joined_sessions(parts, self.gap_us, self.k) if len(parts) > 1 else parts
        yield from self._settle(flows, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(self._kept(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_flows(
    packets: DataFrame, gap_seconds: int, delay: str, k: int = FLOW_PACKETS, buckets: int = FLOW_BUCKETS
) -> DataFrame:
    """First ``k`` payload pieces per flow session, emitted once the session has been idle.

    Input: flow key columns, ``ts_us``, ``order_no`` (breaks ties of time) and ``piece``; packets
    without a time are passed over, null pieces are counted but not shown. The watermark
    follows the packets' own times. A packet is too late when it is older than the watermark and no
    packet of its session that came with it is in time. State holds, per open session, its bounds,
    its count and at most k cut pieces, however long it stays open. ``buckets`` is part of the state:
    a running stream keeps its number.
    """
    packets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    gap_us = gap_seconds * 1_000_000
    timed = session_parts(packets, gap_us, k).withColumn("ts", F.timestamp_micros("last_us")).withWatermark("ts", delay)
    bucket = F.pmod(F.xxhash64(*KEY_NAMES), F.lit(buckets)).cast("int")
    return timed.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(
        FlowSessions(gap_us, k), FLOW_SCHEMA, "Append", "EventTime")


# --- duplicates, counts, running evaluation ----------------------------------------------------

def drop_redelivered(frames: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """Frames of captures that are delivered again within the delay."""
    return frames.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["capture", "frame_no"])


def class_counts(df: DataFrame, window: str, slide: str | None = None, ts: str = "ts",
                 label: str = "label", delay: str | None = None) -> DataFrame:
    """Rows per class in tumbling or sliding windows; with ``delay`` the input is a stream."""
    rows = df.withWatermark(ts, delay) if delay else df
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    counts = rows.groupBy(span.alias("w"), label).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), label, "n")


def count_batches(table: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: confusion counts of a batch under its own number.

    A batch that runs again replaces its own counts, so totals stay right.
    """
    def store(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("true_id", "predicted_id").agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{table}/batch={number}")
    return store


def accumulated_counts(spark: SparkSession, table: str) -> DataFrame:
    """(true_id, predicted_id, n) over all batches so far."""
    rows = spark.read.schema("true_id INT, predicted_id INT, n BIGINT, batch BIGINT").parquet(table)
    return rows.groupBy("true_id", "predicted_id").agg(F.sum("n").alias("n"))


def accumulated_metrics(spark: SparkSession, table: str, average: str | None = None) -> DataFrame:
    """Precision, recall and F1 over all batches so far; per class with the support by default."""
    return precision_recall_f1(metric_counts(accumulated_counts(spark, table), weight="n"), average)


def running_evaluation(scored: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Start counting a stream of (true_id, predicted_id) rows; stops when the input is drained."""
    return (
        scored.writeStream.foreachBatch(count_batches(table))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def drain(stream: DataFrame) -> DataFrame:
    """Run a stream over what is there into a table, and read the table."""
    return drain_counted(stream)[0]


def drain_counted(stream: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The table of a drained stream, and the number of its batches and of rows that came too late.

    Late rows are those that stateful steps passed over as older than the watermark.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_base(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").option("path", f"{base}/rows")
        .option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    )
    late: dict[int, int] = {}
    done = False
    while not done:  # progress of the last batches only is kept, so it is looked at on the way
        done = query.awaitTermination(2)
        for progress in query.recentProgress:
            late[progress.batchId] = sum(o.numRowsDroppedByWatermark for o in progress.stateOperators)
    counts = {"batches": len(late), "late": sum(late.values())}
    return spark.read.schema(stream.schema).parquet(f"{base}/rows"), counts
