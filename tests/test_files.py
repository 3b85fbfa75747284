"""Sources and sinks: round trips in a temporary folder."""

import json
import os
import pickle
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wirecorpus.operators import chat, corpus, metrics
from wirecorpus.operators.catalog import PACKET_FIELDS
from wirecorpus.operators.flows import flow_bytes
from wirecorpus.operators.packets import decode_headers
from wirecorpus.plans import fixtures as fx
from wirecorpus.sources import captures, files, json_arrays, sinks


def pcap(frames, order="<", magic=0xA1B2C3D4, unit=1, cut=0):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 262144, 1)
    for ts_ns, frame in frames:
        seconds, rest = divmod(ts_ns, 1_000_000_000)
        out += struct.pack(order + "IIII", seconds, rest // unit, len(frame), len(frame)) + frame
    return out[:len(out) - cut] if cut else out


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)


def frames_of(n, size=60, seed=1):
    return [(1_700_000_000_000_000_000 + i * 1_000_000 + i, bytes([(i * 7 + j * seed) % 251 for j in range(size + i % 5)]))
            for i in range(n)]


def test_capture_byte_orders_and_resolutions(spark, tmp_path):
    frames = frames_of(5)
    for name, order, magic, unit in [("a", "<", 0xA1B2C3D4, 1000), ("b", ">", 0xA1B2C3D4, 1000),
                                     ("c", "<", 0xA1B23C4D, 1), ("d", ">", 0xA1B23C4D, 1)]:
        put(tmp_path / "web" / f"{name}.pcap", pcap(frames, order, magic, unit))
    rows = captures.read_captures(spark, str(tmp_path)).collect()
    assert len(rows) == 20
    for name in "abcd":
        mine = sorted((r for r in rows if r.capture == f"web/{name}.pcap"), key=lambda r: r.frame_no)
        assert [r.frame_no for r in mine] == [1, 2, 3, 4, 5]
        assert [bytes(r.frame) for r in mine] == [f for _, f in frames]
        assert [r.ts_us for r in mine] == [t // 1000 for t, _ in frames]
        assert {r.label for r in mine} == {"web"}
    assert str([r.ts_epoch for r in rows if r.capture == "web/c.pcap" and r.frame_no == 2][0]) == "1700000000.001000001"


def test_truncated_record_is_dropped_and_counted(spark, tmp_path):
    put(tmp_path / "web" / "cut.pcap", pcap(frames_of(4), cut=3))
    put(tmp_path / "web" / "whole.pcap", pcap(frames_of(4)))
    assert captures.read_captures(spark, str(tmp_path)).groupBy("capture").count().collect() and {
        r.capture: r["count"] for r in captures.read_captures(spark, str(tmp_path)).groupBy("capture").count().collect()
    } == {"web/cut.pcap": 3, "web/whole.pcap": 4}
    cut = captures.truncated_records(spark, str(tmp_path)).collect()
    assert [(r.capture, r.n_truncated) for r in cut] == [("web/cut.pcap", 1)]


def test_large_file_is_split_without_loss(spark, tmp_path, monkeypatch):
    frames = frames_of(600)
    # a capture carried inside frames must not be taken for the file's own records
    inner = pcap(frames_of(20, 40))[24:]
    frames = [(t, inner if i % 50 == 0 else f) for i, (t, f) in enumerate(frames)]
    put(tmp_path / "web" / "big.pcap", pcap(frames, unit=1000))
    scan = captures.read_captures(spark, str(tmp_path), split_octets=5000)
    assert captures.scan_captures(spark, str(tmp_path), split_octets=5000).rdd.getNumPartitions() > 5
    rows = sorted(scan.collect(), key=lambda r: r.frame_no)
    assert [bytes(r.frame) for r in rows] == [f for _, f in frames]
    assert [r.frame_no for r in rows] == list(range(1, 601))


def test_two_levels_and_label_pruning(spark, tmp_path):
    put(tmp_path / "Benign" / "mail" / "x.pcap", pcap(frames_of(2)))
    put(tmp_path / "Malware" / "bot" / "y.pcap", pcap(frames_of(3)))
    rows = captures.read_captures(spark, str(tmp_path), levels=2)
    got = {(r.super_label, r.label, r["count"]) for r in rows.groupBy("super_label", "label").count().collect()}
    assert got == {("benign", "mail", 2), ("malware", "bot", 3)}
    only = captures.scan_captures(spark, str(tmp_path), levels=2).filter("label = 'bot'")
    assert only.rdd.getNumPartitions() == 1 and only.count() == 3


def test_not_a_capture(spark, tmp_path):
    put(tmp_path / "web" / "text.pcap", b"hello, this is no capture at all")
    with pytest.raises(Exception, match="not a capture file"):
        captures.read_captures(spark, str(tmp_path)).collect()


def test_empty_capture_gives_the_bare_mark(spark, tmp_path):
    put(tmp_path / "web" / "empty.pcap", pcap([]))
    put(tmp_path / "web" / "one.pcap", pcap(frames_of(1, 4)))
    texts = flow_bytes(captures.read_captures(spark, str(tmp_path)), captures=captures.list_captures(spark, str(tmp_path)))
    got = {r.capture: r.flow_text for r in texts.collect()}
    assert got == {"web/empty.pcap": "<pck>", "web/one.pcap": "<pck>" + frames_of(1, 4)[0][1].hex()}


@pytest.mark.parametrize("frames_per_part", [None, 4])
def test_capture_round_trip(spark, data, tmp_path, frames_per_part):
    rows = fx.frames(spark, data)
    captures.write_captures(rows, str(tmp_path / "out"), frames_per_part=frames_per_part)
    back = captures.read_captures(spark, str(tmp_path / "out"), split_octets=3_000)
    columns = ["capture", "frame_no", "label", "ts_us", "frame"]
    key = lambda df: sorted((*tuple(r)[:4], bytes(r.frame)) for r in df.select(*columns).collect())
    assert key(back) == key(rows)
    listed = captures.list_captures(spark, str(tmp_path / "out"))
    assert {r.capture for r in listed.collect()} == {r.capture for r in rows.select("capture").distinct().collect()}
    assert decode_headers(back).filter("ip_proto = 6").count() == fx.packets(spark, data).filter("proto = 6").count()
    with pytest.raises(Exception):
        captures.write_captures(rows, str(tmp_path / "out"), frames_per_part=frames_per_part)
    # overwriting leaves nothing of before
    some = rows.filter("label = 'view'")
    captures.write_captures(some, str(tmp_path / "out"), mode="overwrite", frames_per_part=frames_per_part)
    assert key(captures.read_captures(spark, str(tmp_path / "out"))) == key(some)
    assert not [f for f in (tmp_path / "out").rglob(".*.part")]


def test_a_wrong_boundary_fails_for_any_columns(spark, tmp_path):
    put(tmp_path / "web" / "one.pcap", pcap(frames_of(40), unit=1000))
    whole = captures.scan_captures(spark, str(tmp_path), split_octets=400, counts=True)
    assert captures.split_counts(whole).count() > 2
    with pytest.raises(Exception, match="do not join up"):  # the end of the file is not reached
        captures.split_counts(whole.filter("start < 1200"))
    shifted = whole.withColumn("first", F.col("first") + F.when(F.col("start") == 400, 1).otherwise(0))
    with pytest.raises(Exception, match="do not join up"):
        captures.split_counts(shifted)


def test_small_captures_share_tasks_and_are_read_once(spark, tmp_path):
    for i in range(300):
        put(tmp_path / "web" / f"{i}.pcap", pcap(frames_of(1 + i % 3), unit=1000))
    put(tmp_path / "web" / "long.pcap", pcap(frames_of(200), unit=1000))
    assert captures.scan_captures(spark, str(tmp_path)).rdd.getNumPartitions() == 1
    counted = captures.scan_captures(spark, str(tmp_path), split_octets=4_000, counts=True, several=True)
    assert {r.capture for r in counted.collect()} == {"web/long.pcap"}
    rows = captures.read_captures(spark, str(tmp_path), split_octets=4_000).collect()
    numbers = {}
    for r in rows:
        numbers.setdefault(r.capture, []).append(r.frame_no)
    want = {f"web/{i}.pcap": list(range(1, 2 + i % 3)) for i in range(300)} | {"web/long.pcap": list(range(1, 201))}
    assert {c: sorted(n) for c, n in numbers.items()} == want


def test_counts_of_splits_are_those_of_their_records(spark, tmp_path):
    put(tmp_path / "web" / "one.pcap", pcap(frames_of(300), unit=1000))
    put(tmp_path / "web" / "cut.pcap", pcap(frames_of(50), cut=3))
    put(tmp_path / "web" / "none.pcap", pcap([]))
    for octets in (300, 2000, 10 ** 6):
        rows = captures.scan_captures(spark, str(tmp_path), split_octets=octets)
        behind = F.when(F.col("truncated"), F.col("file_end")).otherwise(F.col("offset") + 16 + F.col("cap_len"))
        want = rows.groupBy("capture", "start").agg(
            F.count_if(~F.col("truncated")).alias("n"), F.min("offset").alias("first"), F.max(behind).alias("behind"), F.max("file_end"))
        got = captures.scan_captures(spark, str(tmp_path), split_octets=octets, counts=True)
        assert sorted(got.collect()) == sorted(want.collect())


IP_PACKET = bytes.fromhex("4500002a00010000400600000a0000010a000002" "0050c350000000010000000250180100000000006869")
IP6_PACKET = bytes.fromhex("60000000000c1140" + "20010db8000000000000000000000001" + "20010db8000000000000000000000002" + "00351388000c0000" "61626364")


def test_link_types(spark, tmp_path):
    """Ethernet, raw IP and cooked captures give the same packets; another link type is an error that names the file."""
    def file(link, frames):
        body = bytearray(pcap([(k, f) for k, f in enumerate(frames)]))
        body[20:24] = link.to_bytes(4, "little")
        return bytes(body)

    ethernet = [bytes(12) + b"\x08\x00" + IP_PACKET, bytes(12) + b"\x86\xdd" + IP6_PACKET]
    cooked = [bytes(14) + b"\x08\x00" + IP_PACKET, bytes(14) + b"\x86\xdd" + IP6_PACKET]
    forms = {1: ethernet, 101: [IP_PACKET, IP6_PACKET], 12: [IP_PACKET, IP6_PACKET], 113: cooked}
    for link, frames in forms.items():
        put(tmp_path / "web" / f"l{link}.pcap", file(link, frames))
    rows = decode_headers(captures.read_captures(spark, str(tmp_path))).collect()
    assert len(rows) == 8
    for r in rows:
        assert (r.l4_proto, r.tcp_dstport, r.udp_dstport, bytes(r.payload)) in {(6, 50000, None, b"hi"), (17, None, 5000, b"abcd")}
        assert r.l3_src in {"10.0.0.1", "2001:0db8:0000:0000:0000:0000:0000:0001"}
        link = int(r.capture.removeprefix("web/l").removesuffix(".pcap"))
        assert (r.eth_src is not None) == (link == 1) and r.frame_encap_type == {1: 1, 113: 25}.get(link, 7)
    assert {r.frame_protocols for r in rows if r.tcp_dstport} == {"eth:ethertype:ip:tcp:data", "raw:ip:tcp:data", "sll:ethertype:ip:tcp:data"}
    put(tmp_path / "web" / "wifi.pcap", file(105, [b"x" * 60]))
    with pytest.raises(Exception, match="link type 105 of web/wifi.pcap"):
        captures.read_captures(spark, str(tmp_path)).collect()


def test_overwriting_spares_what_no_job_wrote(spark, tmp_path):
    put(tmp_path / "out" / "notes" / "readme.txt", b"mine")
    rows = spark.createDataFrame([("web/a.pcap", k, k, b"frame%d" % k) for k in range(1, 4)], "capture STRING, frame_no BIGINT, ts_us BIGINT, frame BINARY")
    captures.write_captures(rows, str(tmp_path / "out"))
    put(tmp_path / "out" / "web" / "byhand.pcap", pcap(frames_of(2)))
    captures.write_captures(rows.limit(1).withColumn("capture", F.lit("web/b.pcap")), str(tmp_path / "out"), mode="overwrite")
    assert (tmp_path / "out" / "notes" / "readme.txt").read_bytes() == b"mine"
    assert sorted(p.name for p in (tmp_path / "out" / "web").iterdir()) == ["b.pcap", "byhand.pcap"]


def test_a_commit_is_one_rename(spark, tmp_path):
    """Before the manifest is there the old state is read, after it the new one, renamed or not."""
    root = tmp_path / "out"
    rows = spark.createDataFrame([("web/a.pcap", k, k, b"old%d" % k) for k in range(1, 4)], "capture STRING, frame_no BIGINT, ts_us BIGINT, frame BINARY")
    captures.write_captures(rows, str(root))
    put(root / ".feed-token-0.part", pcap([(0, b"new")]))
    read = lambda: sorted(bytes(r.frame) for r in captures.read_captures(spark, str(root)).collect())
    assert read() == [b"old1", b"old2", b"old3"]
    store, path = captures._filesystem(str(root))
    captures.Manifests(store, path).commit("feed", True, [(f"{path}/.feed-token-0.part", "web/a.pcap")])
    assert read() == [b"new"]
    os.replace(root / ".feed-token-0.part", root / "web" / "a.pcap")
    assert read() == [b"new"]


def written(spark, root, n, job=None, overwrite=False):
    """A task's message after writing ``n`` captures of two frames."""
    names = [f"web/{k // 2}.pcap" for k in range(2 * n)]
    rows = pa.RecordBatch.from_pydict({
        "capture": names, "frame_no": [1 + k % 2 for k in range(2 * n)], "ts_us": list(range(2 * n)), "wire_len": [5] * (2 * n), "frame": [b"frame"] * (2 * n)})
    writer = captures.CaptureWriter(str(root), overwrite, job)
    return writer, writer.write(iter([rows]))


def test_the_driver_gets_no_names_of_captures(spark, tmp_path):
    """Neither what a writing task tells the driver nor the partitions of a scan grow with the captures."""
    root = tmp_path / "out"
    writer, message = written(spark, root, 2_000)
    assert len(pickle.dumps(message)) < 1_000
    writer.commit([message])
    lists = captures.list_splits(spark, str(root), 1, 128 << 20)
    made = captures.CaptureReader(str(root), 1, 128 << 20, lists=lists).partitions()
    assert len(pickle.dumps(made)) < 2_000
    rows = captures.read_captures(spark, str(root))
    assert rows.count() == 4_000 and rows.select("capture").distinct().count() == 2_000


def test_small_captures_share_batches(spark, tmp_path):
    for i in range(300):
        put(tmp_path / "web" / f"{i}.pcap", pcap(frames_of(1 + i % 3), unit=1000))
    reader = captures.CaptureReader(str(tmp_path), 1, 128 << 20)
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert len(batches) == 1 and batches[0].num_rows == 600


@pytest.mark.parametrize("overwrite", [False, True])
def test_parts_are_read_before_and_after_they_get_their_names(spark, tmp_path, overwrite):
    root = tmp_path / "out"
    before = spark.createDataFrame([("web/old.pcap", 1, 1, b"old"), ("web/0.pcap", 1, 1, b"old")], "capture STRING, frame_no BIGINT, ts_us BIGINT, frame BINARY")
    captures.write_captures(before if overwrite else before.limit(1), str(root))
    put(root / "web" / "byhand.pcap", pcap(frames_of(1)))
    read = lambda: sorted((r.capture, r.frame_no) for r in captures.read_captures(spark, str(root)).collect())
    old = read()
    job = "a" * 32
    writer, message = written(spark, root, 3, job, overwrite)
    assert read() == old  # not committed yet
    writer.commit([message])
    want = sorted([(f"web/{k}.pcap", n) for k in range(3) for n in (1, 2)] + [("web/byhand.pcap", 1)] + [("web/old.pcap", 1)] * (not overwrite))
    assert read() == want and not (root / "web" / "1.pcap").exists()
    captures.settle(spark, str(root), job)
    assert read() == want and (root / "web" / "1.pcap").exists()
    assert (root / "web" / "old.pcap").exists() == (not overwrite)
    assert not [f for f in root.rglob(".*.part")] and len([f for f in root.glob(".captures-*.json")]) == 2 - overwrite


def test_frame_limit_is_the_files_own(spark, tmp_path):
    body = bytearray(pcap([(0, b"x" * 300_000), (1, b"y" * 50)]))
    body[16:20] = (400_000).to_bytes(4, "little")
    put(tmp_path / "web" / "big.pcap", bytes(body))
    rows = captures.read_captures(spark, str(tmp_path), split_octets=100_000).orderBy("frame_no").collect()
    assert [(r.frame_no, len(r.frame)) for r in rows] == [(1, 300_000), (2, 50)]


def test_fields_tsv(spark, tmp_path):
    values = {"frame.encap_type": "1", "tcp.payload": "ab" * 700, "ip.src": '"quoted"', "tcp.flags.str": "·······A····"}
    line = "\t".join(values.get(f, "") for f in PACKET_FIELDS)
    bare = "\t".join("" for _ in PACKET_FIELDS)
    (tmp_path / "f.tsv").write_text(line + "\n" + bare + "\n", encoding="utf-8")
    rows = files.words_of_fields(files.read_fields_tsv(spark, str(tmp_path / "f.tsv"))).select("words").collect()
    assert rows[0].words == 'frame.encap_type: 1, ip.src: "quoted", tcp.flags.str: ·······A····, tcp.payload: ' + ("ab" * 700)[:1000]
    assert rows[1].words == "frame.encap_type: "


def test_json_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"instruction":"a\\nb","output":"c"}\nbroken\n{"instruction":"d","output":"e"}\n')
    with pytest.raises(Exception, match="Malformed|MALFORMED"):
        files.read_samples(spark, str(tmp_path / "s.json")).collect()
    kept = files.read_samples(spark, str(tmp_path / "s.json"), broken="keep").collect()
    assert [(r.instruction, r.output) for r in kept] == [("a\nb", "c"), (None, None), ("d", "e")]
    assert [tuple(r) for r in files.sample_rejects(spark, str(tmp_path / "s.json")).collect()] == [("broken", 1, 0)]
    assert [r[files.CORRUPT] for r in kept] == [None, "broken", None]
    (tmp_path / "l.json").write_text(json.dumps([{"instruction": "i", "input": "", "output": "o"}], indent=4))
    assert files.read_sample_array(spark, str(tmp_path / "l.json")).collect()[0].asDict() == {"instruction": "i", "input": "", "output": "o"}
    (tmp_path / "labels.json").write_text('{\n "a": 0,\n "b": 1\n}')
    assert {r.label: r.id for r in files.read_label_map(spark, str(tmp_path / "labels.json")).collect()} == {"a": 0, "b": 1}
    (tmp_path / "d.json").write_text(json.dumps([[{"role": "user", "content": "x"}, {"role": "assistant", "content": "y"}], [{"role": "user", "content": "z"}]]))
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "d.json").write_text(json.dumps([[{"role": "user", "content": "w"}]]))
    dialogs = files.read_dialogs(spark, [str(tmp_path / "d.json"), str(tmp_path / "more" / "d.json")]).collect()
    assert [(r.conv_id.rpartition("#")[2], r.turn, r.role, r.text) for r in dialogs if "more" not in r.file] == [
        ("0", 0, "user", "x"), ("0", 1, "assistant", "y"), ("1", 0, "user", "z")]
    assert len({r.conv_id for r in dialogs}) == 3
    with pytest.raises(ValueError):
        files.read_messages(spark, str(tmp_path / "m.json"))


def test_registry_source(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({
        "model_path": "m/", "peft_path": "p/", "peft_set": {"NLP": "n/", "A": "a/", "G": ["h/", "b/"]},
        "tasks": {"Task A": "A", "Make G": "G", "Lost": "X"}}))
    rows = {r.name: (r.code, r.paths) for r in files.read_registry(spark, str(tmp_path / "c.json")).collect()}
    assert rows == {"Task A": ("A", ["a/"]), "Make G": ("G", ["h/", "b/"]), "Lost": ("X", None)}


def test_split_loader(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"instruction":"a","output":"b"}\n')
    (tmp_path / "v.csv").write_text('instruction,output\n"say ""hi""\nnow",d\n')
    rows = files.read_splits(spark, {"train": str(tmp_path / "t.json"), "validation": str(tmp_path / "v.csv")}).collect()
    assert {(r.split, r.instruction, r.output) for r in rows} == {("train", "a", "b"), ("validation", 'say "hi"\nnow', "d")}
    with pytest.raises(ValueError):
        files.read_splits(spark, {"test": str(tmp_path / "x.parquet")})


def test_corpus_and_messages_sinks(spark, data, tmp_path):
    rows = corpus.cap_split(fx.corpus(spark, data), "packet_id")
    path = sinks.write_corpus(rows, str(tmp_path), "cap", "detection", "packet", "packet_id")
    assert os.path.basename(path) == "cap_detection_packet"
    back = spark.read.schema(files.SAMPLE_SCHEMA + ", split STRING").json(path)
    key = lambda df: sorted(map(tuple, df.select("split", "instruction", "output").collect()))
    assert key(back) == key(rows)
    sinks.write_messages(chat.to_messages(rows), str(tmp_path), "cap")
    with_label = files.read_messages(spark, str(tmp_path / "chat_cap_test_with_label.jsonl")).collect()
    masked = files.read_messages(spark, str(tmp_path / "chat_cap_test.jsonl")).collect()
    assert len(with_label) == len(masked) == rows.filter("split = 'test'").count()
    assert {r.messages[2].content for r in masked} == {"-"} and "-" not in {r.messages[2].content for r in with_label}
    text = "".join(p.read_text() for p in (tmp_path / "chat_cap_test.jsonl").glob("part-*"))
    assert "\\u" not in text


def test_text_sinks(spark, data, tmp_path):
    rows = spark.createDataFrame([("a\nb\\n",), ("c",)], "text STRING")
    sinks.write_texts(rows, str(tmp_path / "t"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect())
    assert lines == ["a\\nb\\\\n", "c"]
    pairs = spark.createDataFrame([('say "hi"\nthere, you', "x"), ("plain ", " y")], "input STRING, target STRING")
    sinks.write_pairs(pairs, str(tmp_path / "p"))
    assert sorted(map(tuple, files.read_pairs(spark, str(tmp_path / "p")).collect())) == sorted(map(tuple, pairs.collect()))
    preds = spark.createDataFrame([(" a ", "b\n")], "target STRING, response STRING")
    sinks.write_predictions(preds, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).collect()[0].asDict() == {"labels": "a", "predict": "b"}
    labels = corpus.label_index(fx.samples(spark, data))
    sinks.write_label_map(corpus.label_map_json(labels), str(tmp_path / "m"))
    back = {r.label: r.id for r in files.read_label_map(spark, str(tmp_path / "m")).collect()}
    assert back == {r.label: r.id for r in labels.collect()}


def test_report_and_metrics_sinks(spark, data, tmp_path):
    labels = corpus.label_index(fx.samples(spark, data))
    rows = metrics.scorable(metrics.encode_labels(metrics.response_labels(fx.predictions(spark, data)), labels))
    counts = metrics.class_counts(rows)
    sinks.write_report(
        str(tmp_path / "report"), mistakes=metrics.mistakes(rows, labels, "sample_id"),
        metrics=metrics.accuracy(rows), matrix=metrics.confusion_matrix(rows), report=metrics.classification_report(counts))
    assert spark.read.json(str(tmp_path / "report" / "matrix")).count() == 36
    lists = metrics.generation_lists(metrics.generated_by_label(fx.predictions(spark, data), "sample_id"), per_row=100)
    sinks.write_generation_lists(lists, str(tmp_path / "g"))
    back = spark.read.schema("label STRING, part BIGINT, texts ARRAY<STRING>").json(str(tmp_path / "g"))
    assert back.agg(F.sum(F.size("texts"))).first()[0] == 1000 and back.agg(F.max(F.size("texts"))).first()[0] == 100
    sinks.write_run_metrics(metrics.run_metrics_json(metrics.epoch_losses(fx.train_log(spark, data))), str(tmp_path / "k"))
    one = json.loads(spark.read.text(str(tmp_path / "k")).first().value)
    assert set(one) == {"epochs", "train_losses", "eval_losses", "current_epoch", "timestamp"}


def odd_value(rnd, deep=2):
    texts = ["", "}", '"', "\\", 'a"}],[{"b', "],", "é\\\\", "x" * rnd.randint(0, 40), "{[", "tab\tnew\nline", "日本}"]
    kind = rnd.randint(0, 5 if deep else 2)
    if kind < 3:
        return rnd.choice([rnd.choice(texts), rnd.randint(-9, 9), None, True, 1.5])
    if kind == 3:
        return [odd_value(rnd, deep - 1) for _ in range(rnd.randint(0, 3))]
    return {rnd.choice(texts) + str(i): odd_value(rnd, deep - 1) for i in range(rnd.randint(0, 3))}


@pytest.mark.parametrize("part_octets", [7, 64, 1000, 10 ** 7])
def test_arrays_are_cut_anywhere(spark, tmp_path, part_octets):
    """Elements of any shape, in byte ranges that end in strings, escapes and between braces."""
    rnd = random.Random(part_octets)
    wanted = {}
    for k, (many, indent) in enumerate([(40, None), (40, 2), (0, None), (1, None), (300, None)]):
        listed = [odd_value(rnd) for _ in range(many)]
        (tmp_path / f"f{k}.json").write_text(json.dumps(listed, indent=indent, ensure_ascii=k % 2 == 0))
        wanted |= {(f"f{k}.json", at): e for at, e in enumerate(listed)}
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in before:
            spark.conf.set(c, part_octets)
        rows = json_arrays.read_elements(spark, str(tmp_path))
        got = {(os.path.basename(r.file), r.at): json.loads(r.text) for r in rows.collect()}
        assert rows.count() == len(got)
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
    assert got == wanted


@pytest.mark.parametrize("text", ['[{"a": 1}', '[{"a": "x}]', '{"a": [1]}', '[1, 2]]', "1"])
def test_a_file_that_is_no_whole_array_is_an_error(spark, tmp_path, text):
    (tmp_path / "broken.json").write_text(text)
    with pytest.raises(Exception, match="broken.json"):
        json_arrays.read_elements(spark, str(tmp_path)).collect()


def test_one_large_array_is_read_by_many_tasks(spark, tmp_path):
    """One array of one class that holds most samples: parts of a file of 25 MB in several tasks."""
    listed = [{"instruction": f"i{k} " + "x} " * 60, "input": "", "output": f"o{k}"} for k in range(120_000)]
    (tmp_path / "big.json").write_text(json.dumps(listed))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4 << 20)
    try:
        rows = files.read_sample_array(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 4
        assert rows.selectExpr("count(*)", "count(distinct output)", "sum(length(instruction))").first() == (
            120_000, 120_000, sum(len(e["instruction"]) for e in listed))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
