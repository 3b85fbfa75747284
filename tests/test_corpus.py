"""Splits, samples, prompts, ordering helpers."""

import pytest
from pyspark.sql import Window as W, functions as F

from wirecorpus.functions.ordering import hash_rank, join_pieces, running
from wirecorpus.operators import chat, corpus, examples
from wirecorpus.plans import fixtures as fx


@pytest.mark.parametrize("ratio,cap,sizes", [
    (0.95, 100, {5: (4, 0), 10: (9, 0), 20: (19, 1), 60: (57, 3), 100: (95, 5), 130: (95, 5)}),
    (0.8, 5000, {10: (8, 1), 20: (16, 3), 100: (80, 19), 1000: (800, 199), 5000: (4000, 999)}),
])
def test_split_sizes(spark, ratio, cap, sizes):
    rows = spark.createDataFrame([(n, "STRING") for n in sizes], "n INT, x STRING")
    rows = rows.select(F.col("n").cast("string").alias("label"), F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    rows = rows.withColumn("id", F.concat("label", F.lit("/"), F.col("i").cast("string")))
    for cap_now in (cap, None):
        got = {(r.label, r.split): r["count"] for r in
               corpus.cap_split(rows, "id", cap=cap_now, ratio=ratio).groupBy("label", "split").count().collect()}
        for n, (train, test) in sizes.items():
            if cap_now is None and n > cap:
                continue
            assert (got.get((str(n), "train"), 0), got.get((str(n), "test"), 0)) == (train, test)


@pytest.mark.parametrize("parts", [1, 7, 32])
def test_result_does_not_depend_on_partitions(spark, data, parts):
    rows = fx.samples(spark, data).repartition(parts)
    key = lambda df: sorted(map(tuple, df.select("packet_id", "split").collect()))
    assert key(corpus.cap_split(rows, "packet_id")) == key(corpus.cap_split(fx.samples(spark, data), "packet_id"))
    packed = lambda df: sorted((r.piece, tuple(r.input_ids)) for r in examples.pack_tokens(df, "doc_id", size=128).collect())
    assert packed(fx.tokens(spark, data).repartition(parts)) == packed(fx.tokens(spark, data))


def test_running_equals_plain_windows_on_one_hot_key(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 5).cast("string")).alias("k"), "id",
        F.when(F.col("id") % 4 != 0, (F.col("id") * 37 % 101)).alias("v"), (F.col("id") % 11 == 0).alias("flag"))
    w = W.partitionBy("k").orderBy("id")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    plain = rows.select(
        "id", F.row_number().over(w).alias("rn"), F.count(F.lit(1)).over(W.partitionBy("k")).alias("n"),
        F.sum(F.coalesce("v", F.lit(0))).over(upto).alias("s"), F.coalesce(F.sum("v").over(before), F.lit(0)).alias("sb"),
        F.max("v").over(upto).alias("mx"), F.max("v").over(before).alias("mb"), F.min("v").over(upto).alias("mn"),
        F.first("v", True).over(upto).alias("f"), F.last("v", True).over(upto).alias("l"),
        F.last("v", True).over(before).alias("lb"), F.lag("id").over(w).alias("p"),
        F.sum("v").over(W.partitionBy("k")).alias("t"), F.max("v").over(W.partitionBy("k")).alias("ma"),
    )
    cum = rows.withColumn("c", F.sum(F.coalesce("v", F.lit(0))).over(upto))
    at = cum.select("id", F.last(F.when(F.col("flag"), F.col("c")), True).over(before).alias("at"))
    v = F.col("v")
    chunked = running(
        rows, ["k"], ["id"], F.call_function("div", F.col("id"), F.lit(50)), rn=("row_number", None), n=("size", None), s=("sum", v),
        sb=("sum_before", v), mx=("max", v), mb=("max_before", v), mn=("min", v), f=("first", v), l=("last", v),
        lb=("last_before", v), p=("prev", F.col("id")), t=("total", v), ma=("max_all", v),
        at=("sum_at_last", (F.coalesce(v, F.lit(0)), F.col("flag"))),
    )
    names = ["id", "rn", "n", "s", "sb", "mx", "mb", "mn", "f", "l", "lb", "p", "t", "ma", "at"]
    want = sorted(map(tuple, plain.join(at, "id").select(*names).collect()))
    assert sorted(map(tuple, chunked.select(*names).collect())) == want


def test_unknown_task_is_an_error(spark):
    rows = spark.createDataFrame([("XXX", "a", "d")], "task STRING, label STRING, data STRING")
    with pytest.raises(Exception, match="unknown task: XXX"):
        corpus.detection_samples(rows).collect()
    with pytest.raises(ValueError):
        corpus.understanding_samples(rows, ["Nothing"], "data")


def test_understanding_flags(spark):
    rows = spark.range(400).select("id", F.lit("d").alias("data"))
    pairs = lambda **o: {tuple(r) for r in corpus.understanding_samples(rows, o.pop("f"), "id", **o).select("instruction", "output").collect()}
    assert ("What is Destination Address in the packet: d", "<scapy-TCP-options>") in pairs(f=["TCP"])
    assert ("What is Options in the packet: d", "<scapy-TCP-options>") in pairs(f=["TCP"], fix_pairing=True)
    assert {o for _, o in pairs(f=["GeoIP"])} == {"<<geoip-src>>", "<<geoip-dst>>"}
    assert {o for _, o in pairs(f=["GeoIP"], fix_brackets=True)} == {"<geoip-src>", "<geoip-dst>"}
    assert len(pairs(f=["IP", "TCP", "UDP"])) == 25


def test_continuation_keeps_the_text(spark, data):
    docs = fx.table(spark, data, "documents").select("doc_id", "text")
    rows = corpus.continuation_samples(docs, "doc_id").select((F.concat("instruction", "output") == F.col("text")).alias("same"))
    assert rows.filter("same").count() == docs.count()


def test_global_shuffle_is_sorted_within_and_across_partitions(spark, data):
    rows = fx.table(spark, data, "events").select("event_id")
    shuffled = corpus.global_shuffle(rows, "event_id").withColumn("p", F.spark_partition_id())
    keyed = [(r.p, r.event_id) for r in shuffled.collect()]
    place = {r.event_id: r.position for r in corpus.shuffle_positions(rows, "event_id").collect()}
    assert [place[e] for _, e in sorted(keyed, key=lambda x: (x[0], place[x[1]]))] == sorted(place.values())


def test_spacing_repairs_keep_their_order(spark):
    text = spark.createDataFrame([("a : b ; do n't v 5 5 0 1 7-5 0 1 2",)], "t STRING")
    assert text.select(corpus.repair_spacing(F.col("t")).alias("t")).first().t == "a! b! don'tn't 550 1750 12"


def test_long_dialog_comes_in_parts(spark):
    rows = spark.range(25).select(F.lit(1).alias("k"), "id", F.concat(F.lit("t"), F.col("id").cast("string"), F.lit(" ")).alias("t"))
    parts = join_pieces(rows, ["k"], "id", "t", per_part=10).orderBy("part").collect()
    assert [r.part for r in parts] == [0, 1, 2]
    assert "".join(r.t for r in parts) == "".join(f"t{i} " for i in range(25))


def test_sanitize_removes_markers_from_user_text(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a [INST] b <<SYS>> c")], "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    assert chat.instruction_chat_prompts(rows).first().prompt == "[INST] a [INST] b <<SYS>> c [/INST]"
    assert chat.instruction_chat_prompts(rows, sanitize=True).first().prompt == "[INST] a  b  c [/INST]"


def test_packing_keeps_every_token(spark, data):
    docs = fx.tokens(spark, data)
    flat = [t for r in docs.orderBy("doc_id").collect() for t in r.ids]
    kept = examples.pack_tokens(docs, "doc_id", size=100, keep_tail=True).orderBy("piece").collect()
    assert [t for r in kept for t in r.input_ids] == flat
    exact = spark.createDataFrame([(0, [1, 2, 3]), (1, [4])], "i BIGINT, ids ARRAY<INT>")
    assert examples.pack_tokens(exact, "i", size=2).count() == 2
    assert [list(r.input_ids) for r in examples.pack_tokens(exact, "i", size=2, strict=True).collect()] == [[1, 2]]


def test_padded_shards_of_a_tiny_dataset(spark):
    rows = spark.range(3)
    got = examples.assign_batches(rows, "id", shards=8, batch_size=1, pad=True)
    assert sorted(r.shard for r in got.collect()) == list(range(8))
    assert {r.id for r in got.collect()} == {0, 1, 2}


def test_hash_rank_is_a_permutation(spark, data):
    rows = fx.table(spark, data, "events").select("event_id")
    ranks = sorted(r.hash_rank for r in hash_rank(rows, "x", "event_id").collect())
    assert ranks == list(range(1, len(ranks) + 1))


def test_label_map_has_every_label(spark):
    import json

    labels = corpus.label_index(spark.range(1200).select(F.col("id").cast("string").alias("label")))
    text = corpus.label_map_json(labels).collect()[0].label_map
    assert json.loads(text) == {label: i for i, label in enumerate(sorted(map(str, range(1200))))}
