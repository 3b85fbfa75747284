"""Golden frames and properties of packet decode, flows and synthesis."""

import pytest
from pyspark.sql import functions as F

from wirecorpus.operators import flows, packets, synthesis
from wirecorpus.operators.catalog import PACKET_FIELDS, SERVER_FIELDS
from wirecorpus.plans import fixtures as fx

# The published header text and payload, and the frame they make (below).
HEADER = "{'src': '147.32.84.165', 'dst': '212.117.171.138', 'proto': 6, 'sport': 2167, 'dport': 65500}"
PAYLOAD = "20" * 136


def frame_rows(spark, hexes, ts=None):
    rows = [("a/x.pcap", "a", i + 1, (ts or range(len(hexes)))[i], bytes.fromhex(h)) for i, h in enumerate(hexes)]
    return spark.createDataFrame(rows, "capture STRING, label STRING, frame_no BIGINT, ts_us BIGINT, frame BINARY")


def build(spark, **columns):
    base = {"src": "10.0.0.1", "dst": "10.0.0.2", "proto": 6, "sport": 1000, "dport": 80, "payload_hex": ""}
    base.update(columns)
    kinds = {"src": "STRING", "dst": "STRING", "payload_hex": "STRING", "options_hex": "STRING", "seq": "BIGINT", "ack": "BIGINT"}
    schema = ", ".join(f"{k} {kinds.get(k, 'INT')}" for k in base)
    return spark.createDataFrame([tuple(base.values())], schema)


def test_field_lists():
    assert len(PACKET_FIELDS) == 73 and len(SERVER_FIELDS) == 71
    assert len(set(PACKET_FIELDS)) == 73


def test_published_frame(spark):
    rows = spark.createDataFrame([(HEADER, PAYLOAD)], "header STRING, payload_hex STRING")
    built = synthesis.build_frames(synthesis.parse_headers(rows), eth_src="3cecef059ece").first()
    frame = bytes(built.frame)
    assert len(frame) == 190
    assert frame[:54].hex() == (
        "ffffffffffff3cecef059ece0800" "4500009800010000400612" "9a932054a5d475ab8a"
        "0877ffdc0000000000000000500220001f590000")
    assert frame[54:].hex() == PAYLOAD


def test_published_frame_decodes_to_its_segment_length(spark):
    rows = spark.createDataFrame([(HEADER, PAYLOAD)], "header STRING, payload_hex STRING")
    got = packets.decode_headers(synthesis.build_frames(synthesis.parse_headers(rows))).first()
    assert (got.frame_len, got.ip_len, got.tcp_len, got.tcp_window_size_value) == (190, 152, 112, 8192)
    assert (got.ip_checksum, got.tcp_checksum) == (0x129A, 0x1F59)
    assert got.tcp_flags_str == "··········S·"


@pytest.mark.parametrize("header", [
    "{'src': '1.2.3.4', 'dst': '1.2.3.5', 'proto': 6, 'sport': 1", "no header", "{'src': '1.2.3.4'}",
    "{'src': '1.2.3.400', 'dst': '1.2.3.5', 'proto': 6, 'sport': 1, 'dport': 2}",
    "{'src': '1.2.3.4', 'dst': '1.2.3.5', 'proto': 6, 'sport': 1, 'dport': 99999}",
])
def test_bad_headers_are_marked(spark, header):
    rows = spark.createDataFrame([(header, "")], "header STRING, payload_hex STRING")
    assert synthesis.parse_headers(rows).first().header_ok is False


def ones_complement_ok(data):
    total = sum(int.from_bytes(data[i:i + 2], "big") for i in range(0, len(data), 2))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return total == 0xFFFF


def test_checksums_verify_on_all_fixture_frames(spark, data):
    rows = fx.frames(spark, data).join(fx.packets(spark, data).select("packet_id", "proto"), "packet_id").collect()
    for r in rows:
        frame = bytes(r.frame)
        assert ones_complement_ok(frame[14:34])
        if r.proto in (6, 17):
            head = frame[34:34 + (8 if r.proto == 17 else (frame[46] >> 4) * 4)]
            length = int.from_bytes(frame[16:18], "big") - 20
            assert ones_complement_ok(frame[26:34] + bytes([0, r.proto]) + length.to_bytes(2, "big") + head)


def test_published_packet_as_words(spark):
    """Bytes put together by hand give the printed words, apart from vendor names and zone."""
    head = ("00e0b187f594" "001125bbcea1" "0800" "4500002877d140008006" "1429" "c0a80166" "4b7f6148")
    tcp = "0b2d0050" "00000063" "00000064" "5010" "2da0" "33aa" "0000"
    rows = frame_rows(spark, [head + tcp + "000000000000"], [1276367824282112])
    words = packets.traffic_words(packets.packet_fields(rows)).first().words
    for piece in (
        "frame.encap_type: 1, frame.time: Jun 12, 2010 18:37:04.282112000 UTC, frame.offset_shift: 0.000000000, "
        "frame.time_epoch: 1276367824.282112000",
        "frame.len: 60, frame.marked: 0, frame.protocols: eth:ethertype:ip:tcp, eth.dst: 00:e0:b1:87:f5:94",
        "eth.type: 0x00000800, ip.version: 4, ip.hdr_len: 20, ip.dsfield: 0x00000000, ip.dsfield.dscp: 0, "
        "ip.dsfield.ecn: 0, ip.len: 40, ip.id: 0x000077d1, ip.flags: 0x00004000, ip.flags.rb: 0, ip.flags.df: 1, "
        "ip.flags.mf: 0, ip.frag_offset: 0, ip.ttl: 128, ip.proto: 6, ip.checksum: 0x00001429, "
        "ip.checksum.status: 2, ip.src: 192.168.1.102, ip.dst: 75.127.97.72, tcp.srcport: 2861, tcp.dstport: 80, "
        "tcp.stream: 0, tcp.len: 0, tcp.seq: 0",
        "tcp.hdr_len: 20, tcp.flags: 0x00000010, tcp.flags.res: 0, tcp.flags.ns: 0, tcp.flags.cwr: 0, "
        "tcp.flags.ecn: 0, tcp.flags.urg: 0, tcp.flags.ack: 1, tcp.flags.push: 0, tcp.flags.reset: 0, "
        "tcp.flags.syn: 0, tcp.flags.fin: 0, tcp.flags.str: ·······A····, tcp.window_size: 11680, "
        "tcp.window_size_scalefactor: -2, tcp.checksum: 0x000033aa, tcp.checksum.status: 2, tcp.urgent_pointer: 0",
    ):
        assert piece in words
    assert "tcp.payload" not in words and "udp." not in words


def test_vlan_and_short_frames(spark):
    plain = bytes(synthesis.build_frames(build(spark, payload_hex="aabb"), compat_len=False).first().frame).hex()
    tagged = plain[:24] + "81000005" + plain[24:]
    fragment = plain[:40] + "0001" + plain[44:]
    arp = "ff" * 12 + "0806" + "00" * 28
    got = packets.decode_headers(frame_rows(spark, [tagged, plain[:60], fragment, arp, "ff"])).orderBy("frame_no").collect()
    assert (got[0].frame_protocols, got[0].tcp_dstport, bytes(got[0].payload).hex()) == ("eth:ethertype:vlan:ethertype:ip:tcp:data", 80, "aabb")
    assert (got[1].ip_src, got[1].tcp_srcport) == (None, None)
    assert (got[2].ip_frag_offset, got[2].tcp_srcport, got[2].ip_proto) == (8, None, 6)
    assert (got[3].eth_type, got[3].ip_proto, got[3].frame_protocols) == (0x0806, None, "eth:ethertype")
    assert got[4].eth_type is None


def test_window_scale_and_handshake(spark):
    up = dict(src="10.0.0.1", dst="10.0.0.2", sport=1000, dport=80)
    down = dict(src="10.0.0.2", dst="10.0.0.1", sport=80, dport=1000)
    steps = [
        dict(**up, seq=100, ack=0, flags=2, window=1000, options_hex="020405b401030307"),
        dict(**down, seq=900, ack=101, flags=18, window=2000, options_hex="020405b401030302"),
        dict(**up, seq=101, ack=901, flags=16, window=10, options_hex=""),
        dict(**up, seq=101, ack=901, flags=24, window=10, options_hex="", payload_hex="aabbcc"),
        dict(**down, seq=901, ack=104, flags=16, window=20, options_hex=""),
        dict(**up, seq=104, ack=901, flags=24, window=10, options_hex="", payload_hex="dd"),
    ]
    hexes = [bytes(synthesis.build_frames(build(spark, **s), compat_len=False).first().frame).hex() for s in steps]
    rows = packets.packet_fields(frame_rows(spark, hexes, [0, 10, 20, 30, 40, 50])).orderBy("frame_no").collect()
    assert [r.tcp_seq for r in rows] == [0, 0, 1, 1, 1, 4]
    assert [r.tcp_ack for r in rows] == [0, 1, 1, 1, 4, 1]
    assert [r.tcp_nxtseq for r in rows] == [1, 1, 1, 4, 1, 5]
    assert [r.tcp_window_size_scalefactor for r in rows] == [128, 4, 128, 128, 4, 128]
    assert [r.tcp_window_size for r in rows] == [1000, 2000, 1280, 1280, 80, 1280]
    assert [r.tcp_analysis_bytes_in_flight for r in rows] == [None, None, None, 3, None, 1]
    assert [r.tcp_analysis_push_bytes_sent for r in rows] == [None, None, None, 3, None, 1]
    assert [r.tcp_time_delta for r in rows] == [0, 10, 10, 10, 10, 10]
    assert {r.tcp_stream for r in rows} == {0}


def test_chunk_size_does_not_change_stream_features(spark, data, monkeypatch):
    """Features of streams cut into many chunks equal those of whole streams."""
    one = fx.decoded(spark, data).withColumn("capture", F.lit("all/one.pcap")).withColumn("frame_no", F.col("packet_id") + 1)
    columns = ["packet_id", "tcp_stream", "tcp_seq", "tcp_ack", "tcp_time_delta", "tcp_time_relative",
               "tcp_analysis_bytes_in_flight", "tcp_analysis_push_bytes_sent", "frame_time_delta"]

    def run(size):
        monkeypatch.setattr(packets, "frame_chunk", lambda c: F.call_function("div", c, F.lit(size)))
        rows = packets.stream_features(packets.stream_ids(packets.keep_tcp_udp(packets.frame_features(one))))
        return sorted(map(tuple, rows.select(*columns).collect()), key=str)

    assert run(10_000_000) == run(37)


def test_flow_split_inverts_flow_bytes(spark, data):
    texts = flows.flow_bytes(fx.frames(spark, data))
    again = flows.split_flow(texts).groupBy("capture").agg(
        F.array_sort(F.collect_list(F.struct("packet_index", "packet_hex"))).alias("p")
    ).select("capture", F.concat(F.lit("<pck>"), F.array_join(F.transform("p", lambda x: x["packet_hex"]), "<pck>")).alias("t"))
    assert {tuple(r) for r in again.collect()} == {(r.capture, r.flow_text) for r in texts.collect()}


def test_words_skip_rule(spark):
    row = spark.createDataFrame([(None, "", "x")], "frame_encap_type STRING, ip_src STRING, ip_dst STRING")
    got = packets.traffic_words(row, ["frame.encap_type", "ip.src", "ip.dst"]).first().words
    assert got == "frame.encap_type: , ip.dst: x"


def test_five_tuple_ip_for_udp(spark):
    udp = packets.decode_headers(synthesis.build_frames(build(spark, proto=17)))
    plain, full = (packets.five_tuple(udp, ip_for_udp=flag).first().five_tuple_text for flag in (False, True))
    assert plain == "{'sport': 1000, 'dport': 80}"
    assert full == "{'src': '10.0.0.1', 'dst': '10.0.0.2', 'proto': 17, 'sport': 1000, 'dport': 80}"


def test_vendor_names(spark):
    rows = packets.decode_headers(synthesis.build_frames(build(spark)), spark.createDataFrame(
        [("02:00:00", "Lab")], "prefix STRING, vendor STRING")).first()
    assert (rows.eth_src_resolved, rows.eth_dst_resolved) == ("Lab_00:00:01", "ff:ff:ff:ff:ff:ff")


def test_ipv6_frames_are_kept(spark):
    ether, tail = "ff" * 6 + "11" * 6, "0050" "1f90" "000c" "0000" "61626364"
    fixed = lambda length, following: f"60000000{length:04x}{following}40" + "20010db8" + "00" * 11 + "01" + "20010db8" + "00" * 11 + "02"
    frames = [
        ether + "86dd" + fixed(12, "11") + tail,                                          # plain
        ether + "8100000a" + "86dd" + fixed(20, "00") + "1100010400000000" + tail,         # a tag, hop-by-hop options
        ether + "86dd" + fixed(20, "2c") + "1100000100000001" + tail,                      # first fragment
        ether + "86dd" + fixed(20, "2c") + "1100000900000001" + tail,                      # a later one has no ports
        ether + "86dd" + fixed(12, "3a") + tail,                                          # no TCP or UDP
    ]
    rows = packets.decode_headers(frame_rows(spark, frames)).orderBy("frame_no").collect()
    assert [r.udp_srcport for r in rows] == [80, 80, 80, None, None]
    assert [r.l4_proto for r in rows] == [17, 17, 17, 17, 58]
    assert {r.l3_src for r in rows} == {"2001:0db8:0000:0000:0000:0000:0000:0001"} and {r.ip_src for r in rows} == {None}
    assert [bytes(r.payload or b"") for r in rows] == [b"abcd"] * 3 + [b""] * 2
    assert rows[1].frame_protocols == "eth:ethertype:vlan:ethertype:ipv6:udp:data"
