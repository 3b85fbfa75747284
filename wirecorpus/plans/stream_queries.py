"""Streaming jobs over the event table, drained into tables and compared with batch results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wirecorpus.operators import metrics, routing
from wirecorpus.operators.packets import flow_ends
from wirecorpus.plans import fixtures as fx
from wirecorpus.plans.corpus_queries import label_ids
from wirecorpus.plans.metric_queries import ENCODED_SQL
from wirecorpus.plans.registry import Registry
from wirecorpus.plans.routing_queries import EXPERT_RULES, ROUTED_SQL, _prompt_sql, expert, router, rules_sql
from wirecorpus.session import checkpoint_base
from wirecorpus.streaming import jobs

R = Registry()
GAP_SECONDS, DELAY_SECONDS = 6 * 3600, 3600


@R.add("s1_score_requests", f"""WITH {ROUTED_SQL}, p AS (SELECT *, {_prompt_sql('service')} AS task_prompt FROM fx_routed)
SELECT packet_id, task_response, CASE WHEN task_prompt IS NOT NULL THEN {rules_sql(EXPERT_RULES, 'benign', 'task_prompt')} END AS final_response,
  CASE WHEN code IS NULL THEN 'unknown task' ELSE 'success' END AS status FROM p""")
def _(spark, sf):
    arriving = fx.requests_of(fx.samples_of(fx.packet_stream(spark, sf)))
    done = jobs.score_requests(routing.split_prompt(arriving), routing.published_registry(spark), router, expert)
    return jobs.drain(done.select("packet_id", "task_response", "final_response", "status"))


def flow_packets(df):
    named = df.withColumns({
        "ip_proto": F.col("proto"), "ip_src": F.col("src"), "ip_dst": F.col("dst"),
        "tcp_srcport": F.when(F.col("proto") == 6, F.col("sport")), "tcp_dstport": F.when(F.col("proto") == 6, F.col("dport")),
        "udp_srcport": F.when(F.col("proto") == 17, F.col("sport")), "udp_dstport": F.when(F.col("proto") == 17, F.col("dport")),
    })
    return flow_ends(named.filter("proto IN (6, 17)")).select(
        "capture", "ip_proto", "end_a", "end_b", "ts_us", F.col("packet_id").alias("order_no"),
        F.substring("payload_hex", 1, 256).alias("piece"))


@R.add("s2_stream_flows", f"""WITH {fx.WIRE_SQL}, g AS (
  SELECT *, CASE WHEN ts_us - lag(ts_us) OVER k < {GAP_SECONDS}::BIGINT * 1000000 THEN 0 ELSE 1 END AS opens FROM fx_ends
  WINDOW k AS (PARTITION BY capture, proto, end_a, end_b ORDER BY ts_us, packet_id)
), s AS (
  SELECT *, sum(opens) OVER (PARTITION BY capture, proto, end_a, end_b ORDER BY ts_us, packet_id) AS session FROM g
), r AS (
  SELECT *, row_number() OVER (PARTITION BY capture, proto, end_a, end_b, session ORDER BY ts_us, packet_id) AS rn FROM s
), closed AS (
  SELECT capture, proto AS ip_proto, end_a, end_b, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS n_packets,
    '<pck>' || string_agg(substr(payload_hex, 1, 256), '<pck>' ORDER BY rn) FILTER (rn <= 10) AS flow_text
  FROM r GROUP BY capture, proto, end_a, end_b, session
)
SELECT * FROM closed WHERE last_us + {GAP_SECONDS}::BIGINT * 1000000
  <= ((SELECT max(ts_us) // 1000 FROM fx_ends) - {DELAY_SECONDS}::BIGINT * 1000) * 1000""")
def _(spark, sf):
    arriving = flow_packets(fx.packet_stream(spark, sf))
    return jobs.drain(jobs.stream_flows(arriving, GAP_SECONDS, f"{DELAY_SECONDS} seconds"))


# every frame is delivered again by a later batch; more batches than parts of the time
@R.add("s3_drop_redelivered", "SELECT event_type AS capture, event_id AS frame_no FROM events")
def _(spark, sf):
    e = fx.table(spark, sf, "events")
    frames = e.select(F.col("event_type").alias("capture"), F.col("event_id").alias("frame_no"), F.col("ts").cast("timestamp").alias("ts"))
    bounds = frames.selectExpr("percentile_approx(unix_micros(ts), array(0.33, 0.67)) AS b").first()["b"]
    part = F.when(F.unix_micros("ts") <= bounds[0], 0).when(F.unix_micros("ts") <= bounds[1], 1).otherwise(2)
    base = f"{checkpoint_base(spark).rstrip('/')}/delivered-{uuid.uuid4().hex}"
    for delivery in range(4):  # the files of a delivery are older than those of the next
        frames.where(part.isin(delivery, delivery - 1)).write.parquet(f"{base}/{delivery}")
    files = len(spark.read.parquet(f"{base}/*").inputFiles())
    arriving = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", max(1, files // 5)).parquet(f"{base}/*")
    rows, counts = jobs.drain_counted(jobs.drop_redelivered(arriving, "40 days"))
    if counts["batches"] < 3:
        raise ValueError("copies are to arrive in later batches")
    return rows.select("capture", "frame_no")


def _events(spark, sf):
    return fx.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("label"))


def _micros(df):
    return df.select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "label", "n")


@R.add("s4_class_counts_tumbling", """SELECT epoch_us(time_bucket(INTERVAL '1 day', ts)) AS start_us, epoch_us(time_bucket(INTERVAL '1 day', ts)) + 86400000000 AS end_us,
  event_type AS label, count(*) AS n FROM events GROUP BY ALL""")
def _(spark, sf):
    return _micros(jobs.class_counts(_events(spark, sf), "1 day"))


@R.add("s4_class_counts_sliding", """SELECT s AS start_us, s + 86400000000 AS end_us, label, count(*) AS n FROM (
  SELECT event_type AS label, (epoch_us(ts) // 21600000000 - k) * 21600000000 AS s FROM events, (SELECT unnest(range(0, 4)) AS k)) GROUP BY ALL""")
def _(spark, sf):
    return _micros(jobs.class_counts(_events(spark, sf), "1 day", "6 hours"))


@R.add("s4_class_counts_stream", """WITH w AS (SELECT time_bucket(INTERVAL '1 day', ts) AS d, event_type AS label, count(*) AS n FROM events GROUP BY ALL)
SELECT epoch_us(d) AS start_us, epoch_us(d) + 86400000000 AS end_us, label, n FROM w WHERE (epoch_us(d) + 86400000000) // 1000 <= (SELECT max(epoch_us(ts)) // 1000 FROM events) - 3600000""")
def _(spark, sf):
    arriving = fx.event_stream(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("label"))
    return _micros(jobs.drain(jobs.class_counts(arriving, "1 day", delay="1 hour")))


@R.add("s5_running_evaluation", f"WITH {ENCODED_SQL} SELECT true_id, predicted_id, count(*) AS n FROM fx_scored GROUP BY ALL")
def _(spark, sf):
    return jobs.accumulated_counts(spark, _evaluated(spark, sf))


@R.add("s5_running_metrics", f"WITH {ENCODED_SQL} SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM fx_classes")
def _(spark, sf):
    rows = jobs.accumulated_metrics(spark, _evaluated(spark, sf))
    return rows.select("cls", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def _evaluated(spark, sf):
    """Run the stream of predictions into counts per batch; the folder of the counts."""
    arriving = fx.predictions_of(fx.event_stream(spark, sf))
    labels = label_ids(spark, sf)
    base = f"{checkpoint_base(spark).rstrip('/')}/evaluation-{uuid.uuid4().hex}"

    # labels are looked up inside the batch, where the label table is an ordinary join
    def store(batch, number):
        rows = metrics.scorable(metrics.encode_labels(batch, labels))
        jobs.count_batches(f"{base}/counts")(rows.select("true_id", "predicted_id"), number)

    query = (
        metrics.response_labels(arriving).writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return f"{base}/counts"
