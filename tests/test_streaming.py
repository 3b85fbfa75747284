"""Streams drained from folders give the batch results."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from wirecorpus.plans.keyword_model import KeywordModel
from wirecorpus.operators import routing
from wirecorpus.streaming import jobs

HOUR = 3_600_000_000


def test_requests_from_a_folder(spark, tmp_path):
    asks = [("1", "find malware", "<packet>: a"), ("2", "", "x"), ("3", "sing", "<packet>: b")]
    for i, (r, h, t) in enumerate(asks):
        (tmp_path / f"{i}.json").write_text(json.dumps({"request_id": r, "human_instruction": h, "traffic_data": t}))
    model = lambda path: KeywordModel([("malware", "Malware Traffic Detection")], "other")
    registry = routing.published_registry(spark)
    stream = jobs.score_requests(jobs.request_stream(spark, str(tmp_path), 1), registry, model, model)
    batch = jobs.score_requests(spark.read.schema(jobs.REQUEST_SCHEMA).json(str(tmp_path)), registry, model, model)
    key = lambda df: sorted(map(tuple, df.select("request_id", "task_response", "final_response", "status").fillna("").collect()))
    assert key(jobs.drain(stream)) == key(batch)
    assert [r[3] for r in key(batch)] == ["success", "empty prompt", "unknown task"]


def packets(rows):
    return [(c, 6, "a", "b", t, o, p) for c, t, o, p in rows]


def test_sessions_over_many_batches(spark, tmp_path):
    schema = "capture STRING, ip_proto INT, end_a STRING, end_b STRING, ts_us BIGINT, order_no BIGINT, piece STRING"
    batches = [
        [("x", 0, 1, "p1"), ("x", HOUR, 3, "p3")],
        [("x", HOUR // 2, 2, "p2"), ("y", HOUR // 4, 1, "q1")],     # late, but inside the delay
        [("x", 9 * HOUR, 4, "p4"), ("z", 20 * HOUR, 1, "flush")],
        [("z", 60 * HOUR, 2, "flush")],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(packets(rows), schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
    for i in range(len(batches)):
        os.utime(next((tmp_path / f"b{i}").glob("*.parquet")), (1000 + i, 1000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "b*"))
    rows = jobs.drain(jobs.stream_flows(stream, gap_seconds=4 * 3600, delay="2 hours", k=2)).collect()
    got = sorted((r.capture, r.first_us, r.last_us, r.n_packets, r.flow_text) for r in rows)
    assert got == [
        ("x", 0, HOUR, 3, "<pck>p1<pck>p2"), ("x", 9 * HOUR, 9 * HOUR, 1, "<pck>p4"), ("y", HOUR // 4, HOUR // 4, 1, "<pck>q1"),
        ("z", 20 * HOUR, 20 * HOUR, 1, "<pck>flush"),
    ]


def batch_flows(rows, gap, k):
    """(capture, first, last, n, text) of the sessions of (capture, ts, order, piece) rows, by plain loops."""
    flows = {}
    for c, t, o, p in sorted(rows, key=lambda r: r[:3]):
        sessions = flows.setdefault(c, [])
        if not sessions or t - sessions[-1][-1][0] >= gap:
            sessions.append([])
        sessions[-1].append((t, p))
    return sorted(
        (c, s[0][0], s[-1][0], len(s), "".join("<pck>" + p for _, p in s[:k])) for c, sessions in flows.items() for s in sessions)


@pytest.mark.parametrize("partitions", [1, 7, 32])
def test_an_endless_flow_keeps_a_bounded_state(spark, tmp_path, partitions):
    """One flow that never pauses holds a third of all packets; state has k pieces of each session."""
    gap, k = 1000 * 1_000_000, 3
    rnd = random.Random(partitions)
    rows = [("endless", 500_000 * i, i, f"e{i}") for i in range(4000)]
    rows += [(f"f{rnd.randint(0, 40)}", rnd.randrange(0, 20_000) * 100_000, i, f"p{i}") for i in range(8000)]
    rows.append(("last", 10 * gap, 1, "x"))
    schema = "capture STRING, ip_proto INT, end_a STRING, end_b STRING, ts_us BIGINT, order_no BIGINT, piece STRING"
    rnd.shuffle(rows)
    spark.createDataFrame(packets(rows), schema).repartition(partitions).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = jobs.drain(jobs.stream_flows(stream, 1000, "0 seconds", k)).collect()
    want = [r for r in batch_flows(rows, gap, k) if r[0] != "last"]
    assert sorted((r.capture, r.first_us, r.last_us, r.n_packets, r.flow_text) for r in got) == want
    # what reaches the state: at most k pieces a session and slice, and k pieces a session once joined
    parts = jobs.session_parts(spark.createDataFrame(packets(rows), schema).repartition(partitions), gap, k).collect()
    assert max(len(r.pieces) for r in parts) <= k and sum(r.n_packets for r in parts) == len(rows)
    endless = [tuple(r)[4:] for r in parts if r.capture == "endless"]
    assert len(endless) <= max(partitions, 2)
    (session,) = jobs.joined_sessions(endless, gap, k)
    assert session[:3] == (0, 500_000 * 3999, 4000) and session[5] == ["e0", "e1", "e2"]


def test_state_is_called_per_bucket_and_not_per_flow(spark, tmp_path):
    """300 flows in two buckets over three batches: a bucket has one list and one timer for all its flows."""
    gap = 1000 * 1_000_000
    rnd = random.Random(5)
    rows = [(f"f{rnd.randint(0, 299)}", rnd.randrange(0, 30_000) * 100_000, i, f"p{i}") for i in range(3000)]
    rows.append(("last", 100 * gap, 9000, "x"))
    rows.sort(key=lambda r: r[1])
    schema = "capture STRING, ip_proto INT, end_a STRING, end_b STRING, ts_us BIGINT, order_no BIGINT, piece STRING"
    for i in range(3):
        part = packets(rows[1000 * i: 1000 * (i + 1) + (i == 2)])
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        os.utime(next((tmp_path / f"b{i}").glob("*.parquet")), (1000 + i, 1000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "b*"))
    flows = jobs.stream_flows(stream, 1000, "0 seconds", k=3, buckets=2)
    query = (
        flows.writeStream.format("parquet").option("path", str(tmp_path / "rows"))
        .option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    timers = [p.stateOperators[0].customMetrics["numRegisteredTimers"] for p in query.recentProgress]
    assert 0 < max(timers) <= 2
    got = spark.read.schema(jobs.FLOW_SCHEMA).parquet(str(tmp_path / "rows")).collect()
    want = [r for r in batch_flows(rows, gap, 3) if r[0] != "last"]
    assert sorted((r.capture, r.first_us, r.last_us, r.n_packets, r.flow_text) for r in got) == want


def test_a_repeated_batch_replaces_its_counts(spark, tmp_path):
    store = jobs.count_batches(str(tmp_path / "c"))
    rows = spark.createDataFrame([(0, 0), (0, 1), (0, 0)], "true_id INT, predicted_id INT")
    store(rows, 0)
    store(rows, 1)
    store(rows, 1)
    total = {(r.true_id, r.predicted_id): r.n for r in jobs.accumulated_counts(spark, str(tmp_path / "c")).collect()}
    assert total == {(0, 0): 4, (0, 1): 2}


def test_running_evaluation(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0), (1, 0)], "true_id INT, predicted_id INT")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    jobs.running_evaluation(stream, str(tmp_path / "c"), str(tmp_path / "log")).awaitTermination()
    assert jobs.accumulated_counts(spark, str(tmp_path / "c")).agg(F.sum("n")).first()[0] == 2


def test_late_rows_are_counted(spark, tmp_path):
    """Copies over three batches are dropped once; rows older than the watermark are counted, not lost unseen."""
    schema = "capture STRING, frame_no BIGINT, ts TIMESTAMP"
    batches = [[("x", 1, 0), ("x", 2, HOUR)], [("x", 1, 0), ("x", 3, 9 * HOUR)], [("x", 3, 9 * HOUR), ("x", 2, HOUR)], [("x", 9, 0), ("x", 4, 20 * HOUR)]]
    for i, rows in enumerate(batches):
        frames = spark.createDataFrame(rows, "capture STRING, frame_no BIGINT, us BIGINT").selectExpr("capture", "frame_no", "timestamp_micros(us + 86400000000) AS ts")
        frames.coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        os.utime(next((tmp_path / f"b{i}").glob("*.parquet")), (1000 + i, 1000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "b*"))
    rows, counts = jobs.drain_counted(jobs.drop_redelivered(stream, "2 hours"))
    assert sorted(r.frame_no for r in rows.collect()) == [1, 2, 3, 4]
    # frame 9 comes when the watermark is behind it; frame 2 comes again while it is still known
    assert counts["batches"] >= 4 and counts["late"] == 1
