"""Packet decode, features and flow texts over the packet fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirecorpus.operators import flows, packets, synthesis
from wirecorpus.operators.catalog import PACKET_FIELDS, SERVER_FIELDS
from wirecorpus.plans import fixtures as fx
from wirecorpus.plans.registry import Registry
from wirecorpus.session import stage

R = Registry()

B2_COLUMNS = [
    "eth_type", "frame_len", "ip_version", "ip_hdr_len", "ip_len", "ip_id", "ip_ttl", "ip_proto",
    "ip_src", "ip_dst", "tcp_srcport", "tcp_dstport", "tcp_len", "tcp_hdr_len", "tcp_flags",
    "tcp_flags_syn", "tcp_flags_ack", "tcp_flags_push", "tcp_flags_fin", "tcp_flags_str", "tcp_seq_raw",
    "tcp_ack_raw", "tcp_window_size_value", "tcp_window_shift", "udp_srcport", "udp_dstport",
    "udp_length", "data_len", "frame_protocols", "eth_dst", "eth_src_resolved",
]

FLAGS_STR = "".join(
    f"|| CASE WHEN flags & {1 << (8 - i)} > 0 THEN '{c}' ELSE '·' END" for i, c in enumerate("NCEUAPRSF")
)


@R.add("b1_keep_tcp_udp", f"WITH {fx.PACKETS_SQL} SELECT packet_id, proto AS ip_proto FROM fx_packets WHERE proto IN (6, 17)")
def _(spark, sf):
    return packets.keep_tcp_udp(fx.decoded(spark, sf)).select("packet_id", "ip_proto")


@R.add("b2_decode_headers", f"""WITH {fx.WIRE_SQL}
SELECT packet_id, 2048 AS eth_type, 14 + ip_len AS frame_len, 4 AS ip_version, 20 AS ip_hdr_len, ip_len,
  ip_id, 64 AS ip_ttl, proto AS ip_proto, src AS ip_src, dst AS ip_dst,
  CASE WHEN proto = 6 THEN sport END AS tcp_srcport, CASE WHEN proto = 6 THEN dport END AS tcp_dstport,
  CASE WHEN proto = 6 THEN n_payload END AS tcp_len, CASE WHEN proto = 6 THEN 20 + n_options END AS tcp_hdr_len,
  CASE WHEN proto = 6 THEN flags END AS tcp_flags, CASE WHEN proto = 6 THEN (flags & 2) // 2 END AS tcp_flags_syn,
  CASE WHEN proto = 6 THEN (flags & 16) // 16 END AS tcp_flags_ack,
  CASE WHEN proto = 6 THEN (flags & 8) // 8 END AS tcp_flags_push, CASE WHEN proto = 6 THEN flags & 1 END AS tcp_flags_fin,
  CASE WHEN proto = 6 THEN '···' {FLAGS_STR} END AS tcp_flags_str,
  CASE WHEN proto = 6 THEN seq END AS tcp_seq_raw, CASE WHEN proto = 6 THEN ack END AS tcp_ack_raw,
  CASE WHEN proto = 6 THEN "window" END AS tcp_window_size_value, CASE WHEN proto = 6 AND flags = 2 THEN 7 END AS tcp_window_shift,
  CASE WHEN proto = 17 THEN sport END AS udp_srcport, CASE WHEN proto = 17 THEN dport END AS udp_dstport,
  CASE WHEN proto = 17 THEN 8 + n_payload END AS udp_length,
  CASE WHEN proto IN (6, 17) AND n_payload > 0 THEN n_payload END AS data_len,
  'eth:ethertype:ip:' || CASE proto WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' ELSE 'icmp' END
    || CASE WHEN proto <> 1 AND n_payload > 0 THEN ':data' ELSE '' END AS frame_protocols,
  'ff:ff:ff:ff:ff:ff' AS eth_dst, '02:00:00:00:00:01' AS eth_src_resolved
FROM fx_wire""")
def _(spark, sf):
    return fx.decoded(spark, sf).select("packet_id", *B2_COLUMNS)


@R.add("b3_frame_features", f"""WITH {fx.PACKETS_SQL}
SELECT packet_id, frame_no AS frame_number, ts_us AS frame_time_epoch,
  ts_us - coalesce(lag(ts_us) OVER w, ts_us) AS frame_time_delta,
  ts_us - first_value(ts_us) OVER w AS frame_time_relative
FROM fx_packets WINDOW w AS (PARTITION BY capture ORDER BY frame_no)""")
def _(spark, sf):
    return packets.frame_features(fx.packets(spark, sf)).select(
        "packet_id", "frame_number", "frame_time_epoch", "frame_time_delta", "frame_time_relative"
    )


STREAMS_SQL = fx.WIRE_SQL + """, fx_streams AS (
  SELECT e.*, dense_rank() OVER (PARTITION BY capture, proto ORDER BY f) - 1 AS stream FROM (
    SELECT *, min(frame_no) OVER (PARTITION BY capture, proto, end_a, end_b) AS f FROM fx_ends) e
)"""


@R.add("b4_stream_ids", f"""WITH {STREAMS_SQL}
SELECT packet_id, CASE WHEN proto = 6 THEN stream END AS tcp_stream, CASE WHEN proto = 17 THEN stream END AS udp_stream
FROM fx_streams""")
def _(spark, sf):
    rows = packets.keep_tcp_udp(fx.decoded(spark, sf)).select(
        "packet_id", "capture", "frame_no", "ip_proto", "ip_src", "ip_dst", "tcp_srcport", "tcp_dstport",
        "udp_srcport", "udp_dstport")
    return packets.stream_ids(stage(rows)).select("packet_id", "tcp_stream", "udp_stream")


STREAM_FEATURES_SQL = STREAMS_SQL + """, fx_tcp AS (
  SELECT s.*, seq + n_payload + CASE WHEN flags & 3 > 0 THEN 1 ELSE 0 END AS nxt,
    CASE WHEN flags & 16 > 0 THEN ack END AS acked,
    CASE WHEN flags & 2 > 0 THEN 7 END AS wshift
  FROM fx_streams s WHERE proto = 6
), fx_run AS (
  SELECT t.*, first_value(seq) OVER mine AS base, first_value(acked IGNORE NULLS) OVER mine AS ack0,
    max(nxt) OVER mine AS top, last_value(wshift IGNORE NULLS) OVER mine AS sh,
    sum(n_payload) OVER mine AS sent, ts_us - first_value(ts_us) OVER st AS rel,
    ts_us - coalesce(lag(ts_us) OVER st, ts_us) AS delta,
    first_value(CASE WHEN from_a THEN seq END IGNORE NULLS) OVER st AS base_a,
    first_value(CASE WHEN NOT from_a THEN seq END IGNORE NULLS) OVER st AS base_b,
    max(CASE WHEN from_a THEN acked END) OVER st AS ack_a, max(CASE WHEN NOT from_a THEN acked END) OVER st AS ack_b
  FROM fx_tcp t
  WINDOW mine AS (PARTITION BY capture, stream, from_a ORDER BY frame_no),
    st AS (PARTITION BY capture, stream ORDER BY frame_no)
), fx_features AS (
  SELECT r.*, max(CASE WHEN flags & 8 > 0 THEN sent END) OVER (PARTITION BY capture, stream, from_a ORDER BY frame_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pushed,
    top - coalesce(CASE WHEN from_a THEN ack_b ELSE ack_a END, base) AS flight
  FROM fx_run r
)"""


@R.add("b5_stream_features", f"""WITH {STREAM_FEATURES_SQL}
SELECT packet_id, stream AS tcp_stream, seq - base AS tcp_seq, nxt - base AS tcp_nxtseq,
  coalesce(acked - coalesce(CASE WHEN from_a THEN base_b ELSE base_a END, ack0), 0) AS tcp_ack,
  rel AS tcp_time_relative, delta AS tcp_time_delta,
  coalesce(CAST(power(2, sh) AS INT), -2) AS tcp_window_size_scalefactor,
  "window" * CASE WHEN flags & 2 > 0 THEN 1 ELSE coalesce(CAST(power(2, sh) AS INT), 1) END AS tcp_window_size,
  CASE WHEN n_payload > 0 AND flight > 0 THEN flight END AS tcp_analysis_bytes_in_flight,
  CASE WHEN n_payload > 0 THEN CAST(sent AS BIGINT) - coalesce(pushed, 0) END AS tcp_analysis_push_bytes_sent
FROM fx_features""")
def _(spark, sf):
    rows = packets.packet_fields(fx.frames(spark, sf))
    return rows.filter(F.col("tcp_stream").isNotNull()).select(
        "packet_id", "tcp_stream", "tcp_seq", "tcp_nxtseq", "tcp_ack", "tcp_time_relative",
        "tcp_time_delta", "tcp_window_size_scalefactor", "tcp_window_size",
        "tcp_analysis_bytes_in_flight", "tcp_analysis_push_bytes_sent",
    )


def _secs(x: str) -> str:
    return f"(({x}) // 1000000)::VARCHAR || '.' || lpad((({x}) % 1000000)::VARCHAR, 6, '0') || '000'"


def _hex8(x: str) -> str:
    return f"'0x' || lpad(lower(to_hex(({x})::BIGINT)), 8, '0')"


def words_sql(fields: list[str]) -> str:
    """Words of a decoded packet, from SQL values by field name."""
    tcp = lambda x: f"CASE WHEN w.proto = 6 THEN ({x})::VARCHAR END"
    udp = lambda x: f"CASE WHEN w.proto = 17 THEN ({x})::VARCHAR END"
    flag = lambda i: tcp(f"(w.flags >> {8 - i}) & 1")
    ip_sum = "substr(w.frame_hex, 49, 4)"
    l4_sum = "CASE w.proto WHEN 6 THEN substr(w.frame_hex, 101, 4) ELSE substr(w.frame_hex, 81, 4) END"
    values = {
        "frame.encap_type": "'1'",
        "frame.time": "strftime(make_timestamp(w.ts_us), '%b ') || lpad(day(make_timestamp(w.ts_us))::VARCHAR, 2, ' ')"
                      " || strftime(make_timestamp(w.ts_us), ', %Y %H:%M:%S.') || lpad((w.ts_us % 1000000)::VARCHAR, 6, '0') || '000 UTC'",
        "frame.offset_shift": "'0.000000000'",
        "frame.time_epoch": _secs("w.ts_us"),
        "frame.time_delta": _secs("w.fdelta"),
        "frame.time_relative": _secs("w.frel"),
        "frame.number": "w.frame_no::VARCHAR",
        "frame.len": "(14 + w.ip_len)::VARCHAR",
        "frame.marked": "'0'",
        "frame.protocols": "'eth:ethertype:ip:' || CASE w.proto WHEN 6 THEN 'tcp' ELSE 'udp' END"
                           " || CASE WHEN w.n_payload > 0 THEN ':data' ELSE '' END",
        "eth.dst": "'ff:ff:ff:ff:ff:ff'", "eth.dst_resolved": "'ff:ff:ff:ff:ff:ff'",
        "eth.src": "'02:00:00:00:00:01'", "eth.src_resolved": "'02:00:00:00:00:01'",
        "eth.type": "'0x00000800'",
        "ip.version": "'4'", "ip.hdr_len": "'20'", "ip.dsfield": "'0x00000000'", "ip.dsfield.dscp": "'0'",
        "ip.dsfield.ecn": "'0'", "ip.len": "w.ip_len::VARCHAR", "ip.id": _hex8("w.ip_id"),
        "ip.flags": "'0x00000000'", "ip.flags.rb": "'0'", "ip.flags.df": "'0'", "ip.flags.mf": "'0'",
        "ip.frag_offset": "'0'", "ip.ttl": "'64'", "ip.proto": "w.proto::VARCHAR",
        "ip.checksum": f"'0x0000' || {ip_sum}", "ip.checksum.status": "'2'",
        "ip.src": "w.src", "ip.dst": "w.dst",
        "tcp.srcport": tcp("w.sport"), "tcp.dstport": tcp("w.dport"), "tcp.stream": tcp("w.stream"),
        "tcp.len": tcp("w.n_payload"), "tcp.seq": tcp("f.seq - f.base"), "tcp.nxtseq": tcp("f.nxt - f.base"),
        "tcp.ack": tcp("coalesce(f.acked - coalesce(CASE WHEN f.from_a THEN f.base_b ELSE f.base_a END, f.ack0), 0)"),
        "tcp.hdr_len": tcp("20 + w.n_options"), "tcp.flags": tcp(_hex8("w.flags")),
        "tcp.flags.res": tcp("0"), "tcp.flags.ns": flag(0), "tcp.flags.cwr": flag(1), "tcp.flags.ecn": flag(2),
        "tcp.flags.urg": flag(3), "tcp.flags.ack": flag(4), "tcp.flags.push": flag(5), "tcp.flags.reset": flag(6),
        "tcp.flags.syn": flag(7), "tcp.flags.fin": flag(8),
        "tcp.flags.str": tcp("'···' " + FLAGS_STR.replace("flags", "w.flags")),
        "tcp.window_size": tcp('w."window" * CASE WHEN w.flags & 2 > 0 THEN 1 ELSE coalesce(CAST(power(2, f.sh) AS INT), 1) END'),
        "tcp.window_size_scalefactor": tcp("coalesce(CAST(power(2, f.sh) AS INT), -2)"),
        "tcp.checksum": tcp(f"'0x0000' || {l4_sum}"), "tcp.checksum.status": tcp("2"),
        "tcp.urgent_pointer": tcp("0"), "tcp.time_relative": tcp(_secs("f.rel")), "tcp.time_delta": tcp(_secs("f.delta")),
        "tcp.analysis.bytes_in_flight": tcp("CASE WHEN w.n_payload > 0 AND f.flight > 0 THEN f.flight END"),
        "tcp.analysis.push_bytes_sent": tcp("CASE WHEN w.n_payload > 0 THEN CAST(f.sent AS BIGINT) - coalesce(f.pushed, 0) END"),
        "tcp.segment": "NULL", "tcp.segment.count": "NULL", "tcp.reassembled.length": "NULL",
        "tcp.payload": tcp("substr(w.payload_hex, 1, 1000)"),
        "udp.srcport": udp("w.sport"), "udp.dstport": udp("w.dport"), "udp.length": udp("8 + w.n_payload"),
        "udp.checksum": udp(f"'0x0000' || {l4_sum}"), "udp.checksum.status": udp("2"), "udp.stream": udp("w.stream"),
        "data.len": "CASE WHEN w.n_payload > 0 THEN w.n_payload::VARCHAR END",
    }
    first, *rest = fields
    pieces = [f"'{first}: ' || {values[first]}"] + [
        f"CASE WHEN ({values[n]}) <> '' THEN '{n}: ' || ({values[n]}) END" for n in rest
    ]
    return "concat_ws(', ', " + ",\n    ".join(pieces) + ")"


WORDS_SOURCE_SQL = STREAM_FEATURES_SQL + ", fx_frames AS " + fx.frame_sql(
    "fx_wire", "ip_len", "8 + n_payload", raw_icmp=True, extra=True
) + """, fx_all AS (
  SELECT f.*, s.stream, f.ts_us - coalesce(lag(f.ts_us) OVER c, f.ts_us) AS fdelta,
    f.ts_us - first_value(f.ts_us) OVER c AS frel
  FROM fx_frames f LEFT JOIN fx_streams s ON f.packet_id = s.packet_id
  WINDOW c AS (PARTITION BY f.capture ORDER BY f.frame_no)
)"""


@R.add("b6_traffic_words", f"""WITH {WORDS_SOURCE_SQL}
SELECT w.packet_id, {words_sql(PACKET_FIELDS)} AS words
FROM fx_all w LEFT JOIN fx_features f ON w.packet_id = f.packet_id WHERE w.proto IN (6, 17)""")
def _(spark, sf):
    return packets.traffic_words(packets.packet_fields(fx.frames(spark, sf))).select("packet_id", "words")


@R.add("b7_server_words", f"""WITH {WORDS_SOURCE_SQL}
SELECT w.capture, {words_sql(SERVER_FIELDS)} AS words
FROM fx_all w LEFT JOIN fx_features f ON w.packet_id = f.packet_id WHERE w.proto IN (6, 17)
QUALIFY row_number() OVER (PARTITION BY w.capture ORDER BY w.frame_no) = 1""")
def _(spark, sf):
    return packets.server_words(packets.packet_fields(fx.frames(spark, sf))).select("capture", "words")


@R.add("b8_packet_hex", f"WITH {fx.FRAMES_SQL} SELECT packet_id, substr(frame_hex, 1, 1024) AS packet_hex FROM fx_frames")
def _(spark, sf):
    return packets.packet_hex(fx.frames(spark, sf)).select("packet_id", "packet_hex")


TUPLE_SQL = """CASE proto
  WHEN 6 THEN '{''src'': ''' || src || ''', ''dst'': ''' || dst || ''', ''proto'': 6, ''sport'': ' || sport || ', ''dport'': ' || dport || '}'
  WHEN 17 THEN '{''sport'': ' || sport || ', ''dport'': ' || dport || '}' ELSE '{}' END"""


@R.add("b9_five_tuple", f"WITH {fx.PACKETS_SQL} SELECT packet_id, substr({TUPLE_SQL}, 1, 1024) AS five_tuple_text FROM fx_packets")
def _(spark, sf):
    return packets.five_tuple(fx.decoded(spark, sf)).select("packet_id", "five_tuple_text")


@R.add("b10_five_tuple_hex", f"WITH {fx.FRAMES_SQL} SELECT packet_id, substr({TUPLE_SQL} || ' ' || frame_hex, 1, 1024) AS five_tuple_hex FROM fx_frames")
def _(spark, sf):
    return packets.five_tuple_hex(fx.decoded(spark, sf)).select("packet_id", "five_tuple_hex")


@R.add("b11_layer_summary", f"""WITH {fx.WIRE_SQL}
SELECT packet_id, '<Ether dst=ff:ff:ff:ff:ff:ff src=02:00:00:00:00:01 type=IPv4 |<IP version=4 ihl=5 tos=0x0 len=' || ip_len
  || ' id=' || ip_id || ' ttl=64 proto=' || CASE proto WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' ELSE '1' END
  || ' src=' || src || ' dst=' || dst
  || CASE proto WHEN 6 THEN ' |<TCP sport=' || sport || ' dport=' || dport || ' seq=' || seq || ' ack=' || ack || ' flags='
       || CASE flags WHEN 2 THEN 'S' WHEN 16 THEN 'A' WHEN 24 THEN 'PA' WHEN 17 THEN 'FA' END || ' window=' || "window"
     WHEN 17 THEN ' |<UDP sport=' || sport || ' dport=' || dport || ' len=' || (8 + n_payload) ELSE '' END
  || CASE WHEN proto <> 1 AND n_payload > 0 THEN ' |<Raw load=' || payload_hex ELSE '' END
  || repeat(' |>', 2 + CASE WHEN proto <> 1 THEN 1 ELSE 0 END + CASE WHEN proto <> 1 AND n_payload > 0 THEN 1 ELSE 0 END) AS layers
FROM fx_wire""")
def _(spark, sf):
    return packets.layer_summary(fx.decoded(spark, sf)).select("packet_id", "layers")


@R.add("b12_payload_packets", f"""WITH {fx.PACKETS_SQL}
SELECT packet_id, capture, frame_no, substr(payload_hex, 1, 1024) AS payload_hex FROM fx_packets WHERE proto = 6 AND payload_hex <> ''""")
def _(spark, sf):
    return packets.payload_packets(fx.decoded(spark, sf)).select("packet_id", "capture", "frame_no", "payload_hex")


FLOW_BYTES_SQL = """SELECT capture, label, '<pck>' || string_agg(substr(frame_hex, 1, 256), '<pck>' ORDER BY frame_no) AS flow_text
FROM fx_frames WHERE frame_no <= 10 GROUP BY ALL"""


@R.add("f1_flow_bytes", f"WITH {fx.FRAMES_SQL} {FLOW_BYTES_SQL}")
def _(spark, sf):
    return flows.flow_bytes(fx.frames(spark, sf))


@R.add("f2_flow_lengths", f"""WITH {fx.WIRE_SQL}
SELECT capture, proto AS ip_proto, end_a, end_b, label, string_agg(ip_len::VARCHAR, ' ' ORDER BY frame_no) AS lengths
FROM (SELECT *, row_number() OVER (PARTITION BY capture, proto, end_a, end_b ORDER BY frame_no) AS rn FROM fx_ends)
WHERE rn <= 10 GROUP BY ALL""")
def _(spark, sf):
    return flows.flow_lengths(fx.decoded(spark, sf))


@R.add("f2_flow_lengths_signed", f"""WITH {fx.WIRE_SQL}
SELECT capture, proto AS ip_proto, end_a, end_b, label,
  string_agg((CASE WHEN from_a = opener THEN ip_len ELSE -ip_len END)::VARCHAR, ' ' ORDER BY frame_no) AS lengths
FROM (SELECT *, row_number() OVER w AS rn, first_value(from_a) OVER w AS opener FROM fx_ends
      WINDOW w AS (PARTITION BY capture, proto, end_a, end_b ORDER BY frame_no))
WHERE rn <= 10 GROUP BY ALL""")
def _(spark, sf):
    return flows.flow_lengths(fx.decoded(spark, sf), signed=True)


def _flow_payload_sql(protocols: str) -> str:
    return f"""WITH {fx.WIRE_SQL}
SELECT capture, proto AS ip_proto, end_a, end_b, label,
  '<pck>' || string_agg(substr(payload_hex, 1, 256), '<pck>' ORDER BY frame_no) AS flow_text
FROM (SELECT *, row_number() OVER (PARTITION BY capture, proto, end_a, end_b ORDER BY frame_no) AS rn
      FROM fx_ends WHERE payload_hex <> '' AND proto IN ({protocols}))
WHERE rn <= 10 GROUP BY ALL"""


@R.add("f3_flow_payload", _flow_payload_sql("6, 17"))
def _(spark, sf):
    return flows.flow_payload(fx.decoded(spark, sf))


# addresses as eight groups of four digits: a fixed prefix and the version 4 address
_SIX = "'2001:0db8:0000:0000:0000:0000:' || printf('%02x%02x:%02x%02x', " + ", ".join(
    "string_split({0}, '.')[" + str(i) + "]::INT" for i in (1, 2, 3, 4)) + ")"
IPV6_SQL = fx.WIRE_SQL + f""", fx_six AS (
  SELECT w.* EXCLUDE (src, dst), {_SIX.format('src')} AS src, {_SIX.format('dst')} AS dst FROM fx_wire w WHERE proto IN (6, 17)
), fx_six_ends AS (
  SELECT *, least(e_src, e_dst) AS end_a, greatest(e_src, e_dst) AS end_b FROM (
    SELECT *, src || ':' || lpad(sport::VARCHAR, 5, '0') AS e_src, dst || ':' || lpad(dport::VARCHAR, 5, '0') AS e_dst FROM fx_six)
)"""


@R.add("b1_keep_tcp_udp_ipv6", f"""WITH {IPV6_SQL}
SELECT packet_id, NULL::INT AS ip_proto, proto AS l4_proto, src AS l3_src, dst AS l3_dst, coalesce(CASE WHEN proto = 6 THEN sport END, -1) AS tcp_srcport,
  coalesce(CASE WHEN proto = 17 THEN dport END, -1) AS udp_dstport, CASE WHEN payload_hex <> '' THEN payload_hex END AS payload FROM fx_six""")
def _(spark, sf):
    kept = packets.keep_tcp_udp(packets.decode_headers(fx.frames_ipv6(spark, sf)))
    return kept.select(
        "packet_id", "ip_proto", "l4_proto", "l3_src", "l3_dst", F.coalesce("tcp_srcport", F.lit(-1)).alias("tcp_srcport"),
        F.coalesce("udp_dstport", F.lit(-1)).alias("udp_dstport"), F.lower(F.hex("payload")).alias("payload"))


@R.add("f3_flow_payload_ipv6", f"""WITH {IPV6_SQL}
SELECT capture, proto AS ip_proto, end_a, end_b, label,
  '<pck>' || string_agg(substr(payload_hex, 1, 256), '<pck>' ORDER BY frame_no) AS flow_text
FROM (SELECT *, row_number() OVER (PARTITION BY capture, proto, end_a, end_b ORDER BY frame_no) AS rn
      FROM fx_six_ends WHERE payload_hex <> '')
WHERE rn <= 10 GROUP BY ALL""")
def _(spark, sf):
    return flows.flow_payload(packets.decode_headers(fx.frames_ipv6(spark, sf)))


@R.add("f3_flow_payload_tcp_only", _flow_payload_sql("6"))
def _(spark, sf):
    return flows.flow_payload(fx.decoded(spark, sf), udp=False)


@R.add("f4_split_flow", f"""WITH {fx.FRAMES_SQL}
SELECT capture, label, (frame_no - 1)::INT AS packet_index, substr(frame_hex, 1, 256) AS packet_hex FROM fx_frames WHERE frame_no <= 10""")
def _(spark, sf):
    return flows.split_flow(flows.flow_bytes(fx.frames(spark, sf)))


HEADER_TEXT_SQL = "'{''src'': ''' || src || ''', ''dst'': ''' || dst || ''', ''proto'': ' || proto || ', ''sport'': ' || sport || ', ''dport'': ' || dport || CASE WHEN packet_id % 11 = 0 THEN '' ELSE '}' END"


def _header_text(df):
    closing = F.when(F.col("packet_id") % 11 == 0, "").otherwise("}")
    return df.withColumn("header", F.concat(
        F.lit("{'src': '"), "src", F.lit("', 'dst': '"), "dst", F.lit("', 'proto': "), F.col("proto").cast("string"),
        F.lit(", 'sport': "), F.col("sport").cast("string"), F.lit(", 'dport': "), F.col("dport").cast("string"), closing,
    ))


@R.add("g1_parse_headers", f"""WITH {fx.PACKETS_SQL}
SELECT packet_id, src, dst, proto, sport, dport FROM fx_packets WHERE packet_id % 11 <> 0""")
def _(spark, sf):
    texts = _header_text(fx.packets(spark, sf)).select("packet_id", "header")
    return synthesis.parse_headers(texts).filter("header_ok").drop("header", "header_ok")


@R.add("g1_header_rejects", f"WITH {fx.PACKETS_SQL} SELECT packet_id FROM fx_packets WHERE packet_id % 11 = 0")
def _(spark, sf):
    texts = _header_text(fx.packets(spark, sf)).select("packet_id", "header")
    return synthesis.parse_headers(texts).filter(~F.col("header_ok")).select("packet_id")


@R.add("g2_build_frames", f"""WITH {fx.PACKETS_SQL}, built AS {fx.frame_sql('fx_packets', '16 + length(payload_hex) // 2', '8', False, False)}
SELECT packet_id, frame_hex FROM built""")
def _(spark, sf):
    rows = fx.packets(spark, sf).select("packet_id", "src", "dst", "proto", "sport", "dport", "payload_hex")
    return synthesis.build_frames(rows).select("packet_id", F.lower(F.hex("frame")).alias("frame_hex"))


@R.add("g3_build_flow_frames", f"""WITH {fx.FRAMES_SQL}, flow_packets AS (
  SELECT capture, (frame_no - 1)::INT AS packet_index, substr(frame_hex, 1, 256) AS payload_hex,
    first_value(src) OVER w AS src, first_value(dst) OVER w AS dst, first_value(proto) OVER w AS proto,
    first_value(sport) OVER w AS sport, first_value(dport) OVER w AS dport
  FROM (SELECT * FROM fx_frames WHERE frame_no <= 10) WINDOW w AS (PARTITION BY capture ORDER BY frame_no)
), built AS {fx.frame_sql('flow_packets', '16 + length(payload_hex) // 2', '8', False, False)}
SELECT capture, packet_index, frame_hex FROM built""")
def _(spark, sf):
    heads = fx.packets(spark, sf).filter("frame_no = 1").select("capture", "src", "dst", "proto", "sport", "dport")
    texts = flows.flow_bytes(fx.frames(spark, sf)).select("capture", "flow_text").join(heads, "capture")
    return synthesis.build_flow_frames(texts).select(
        "capture", "packet_index", F.lower(F.hex("frame")).alias("frame_hex")
    )
