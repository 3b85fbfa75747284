"""Plans whose work per row must not grow with the length of the row or be done twice."""

import re
import time

from pyspark.sql import functions as F

from wirecorpus.functions import ordering
from wirecorpus.functions.octets import quotient
from wirecorpus.operators import examples, packets
from wirecorpus.plans import fixtures as fx
from wirecorpus.sources import json_arrays


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_masked_examples_cut_once_per_row(spark):
    long = list(range(1, 400))
    rows = spark.createDataFrame([(1, [1, 2], [1, 2, 3]), (2, long[:20], long)], "id INT, prompt_ids ARRAY<INT>, example_ids ARRAY<INT>")
    made = examples.masked_examples(rows, 9, 6)
    assert "size(slice" not in plan(made)
    got = {r.id: r for r in made.collect()}
    assert got[1].input_ids == [1, 2, 3, 9, 0, 0] and got[1].labels == [-100, -100, 3, 9, -100, -100]
    assert got[1].attention_mask == [1.0] * 4 + [0.0] * 2
    assert got[2].input_ids == long[:6] and got[2].labels == [-100] * 6


def test_headers_are_cut_out_of_octets(spark):
    head = "ffffffffffff0200000000010800" + "4500002c00070000400600000a000105ac100102"
    tcp = "9c4001bb" + "00000001" + "00000002" + "6002" + "0400" + "0000" + "0000" + "02040506"
    frames = spark.createDataFrame([("a/1.pcap", 1, bytearray.fromhex(head + tcp))], "capture STRING, frame_no BIGINT, frame BINARY")
    decoded = packets.decode_headers(frames)
    text = plan(decoded)
    assert "substr(lower" not in text and text.count("conv(") < 60
    ends = packets.flow_ends(decoded)
    assert "format_string" not in plan(ends) and "transform(" not in plan(ends)
    row = ends.collect()[0]
    assert (row.end_a, row.end_b, row.from_a) == ("010.000.001.005:40000", "172.016.001.002:00443", True)
    assert (row.eth_src, row.ip_id, row.tcp_ack_raw, row.tcp_hdr_len) == ("02:00:00:00:00:01", 7, 2, 24)


def test_ends_of_odd_addresses(spark):
    rows = spark.createDataFrame(
        [(6, None, "1.2", 80, None), (17, "2001:0db8::1", "", None, None)],
        "ip_proto INT, ip_src STRING, ip_dst STRING, tcp_srcport INT, tcp_dstport INT").withColumns(
        {"udp_srcport": F.when(F.col("ip_proto") == 17, 5), "udp_dstport": F.lit(70)})
    got = [(r.end_a, r.end_b, r.from_a) for r in packets.flow_ends(rows).orderBy("ip_proto").collect()]
    assert got == [("001.002:00070", "null:00080", False), ("000:00070", "2001:0db8::1:00005", False)]


def test_samples_are_not_numbered_by_capture(spark, tmp_path):
    events = spark.range(40).selectExpr(
        "id AS event_id", "CASE WHEN id <> 3 THEN timestamp_micros(id) END AS ts", "CASE WHEN id <> 5 THEN id % 4 END AS user_id",
        "CASE WHEN id <> 7 THEN 'click' END AS event_type", "0.5D AS value", "'{}' AS props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    made = fx.samples(spark, str(tmp_path))
    assert "Join" not in plan(made) and "Window" not in plan(made)
    numbered = fx.samples_of(fx.packets(spark, str(tmp_path)))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, numbered.collect()))
    # dealt out after the numbering, so that texts are made in many tasks
    assert "RepartitionByExpression" in plan(fx.numbered_samples(spark, str(tmp_path))).split("Window")[0]
    places = [r.row_no for r in fx.numbered_samples(spark, str(tmp_path)).orderBy("packet_id").collect()]
    assert places == list(range(1, 38))


def test_a_long_string_is_scanned_in_one_loop():
    text = '[{"a": "' + "0a, 1b" * 300_000 + '"}]'

    def least(work):
        times = []
        for _ in range(5):
            begin = time.perf_counter()
            work()
            times.append(time.perf_counter() - begin)
        return min(times)

    plain = re.compile(r'[^"\\]*')
    assert least(lambda: list(json_arrays.Scanner().commas(text))) < 8 * least(lambda: plain.match(text, 8))
    # a string that does not end in the piece, begun in it or before
    assert least(lambda: list(json_arrays.Scanner().commas(text[:-3]))) < 8 * least(lambda: plain.match(text, 8))
    assert least(lambda: list(json_arrays.Scanner(True, 2).commas(text[8:-3]))) < 8 * least(lambda: plain.match(text, 8))


def test_only_long_groups_are_numbered_by_chunks(spark, tmp_path, monkeypatch):
    """Short captures are numbered whole: no chunks are summed up and joined back, and texts are repeated as hex."""
    rows = [(k, f"{k % 5}", None if k % 11 == 0 else k % 2, None if k % 13 == 0 else k * 7 % 40) for k in range(120)]
    df = spark.createDataFrame(rows + rows[:9], "id INT, kind STRING, user INT, at INT").replace("4", None, ["kind"])
    given = df, ["kind", "user"], ["at", "id"], quotient(F.col("at"), 10)
    want = sorted(ordering.number_rows(*given).collect())
    made = ordering.number_by_size(*given)
    assert "Join" not in plan(made) and made.columns == ["id", "kind", "user", "at", "row_no"]
    assert sorted(made.collect()) == want and made.schema["row_no"].dataType.simpleString() == "bigint"
    monkeypatch.setattr(ordering, "FRAMES_PER_CHUNK", 11)
    mixed = ordering.number_by_size(*given)
    assert "Join" in plan(mixed) and sorted(mixed.collect()) == want
    spark.sql("SELECT id AS event_id, timestamp_ntz'2024-01-01 00:00:00' AS ts, id AS user_id, 'view' AS event_type, 1.0D AS value, '{}' AS props FROM range(9)").write.parquet(f"{tmp_path}/events.parquet")
    text = plan(fx.packets(spark, str(tmp_path)))
    assert "Join" not in text and "hex(encode(repeat" not in text
