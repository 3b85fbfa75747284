"""Packet decode and features: native column expressions over ``frame BINARY``.

Field columns are named like the extracted fields with ``.`` replaced by ``_``. Times are kept
as microseconds (BIGINT) and rendered as decimal seconds only in ``traffic_words``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wirecorpus.functions.octets import bit, ipv4_text, mac_text, once, part_of, quotient, seconds_text, uint_at, words_at
from wirecorpus.functions.ordering import frame_chunk, number_rows, running
from wirecorpus.functions.strings import fill
from wirecorpus.session import stage
from wirecorpus.operators.catalog import (
    HEX_FIELDS, PACKET_FIELDS, PACKET_HEX_CHARS, SECONDS_FIELDS, SERVER_FIELDS, TCP_PAYLOAD_CHARS,
)

TCP, UDP, ICMP = 6, 17, 1
# fixed values: link types of captures, and the numbers of their encapsulation
RAW_IP, COOKED = 101, 113
ENCAP_RAW_IP, ENCAP_COOKED = 7, 25
ETHERTYPE_IP, ETHERTYPE_IPV6 = 0x0800, 0x86DD
ETHERTYPE_VLANS = (0x8100, 0x88A8)
# IPv6 headers that may stand before the transport header: hop-by-hop, routing, fragment,
# authentication, destination options (which may come twice)
EXTENSION_HEADERS, FRAGMENT_HEADER, AUTHENTICATION_HEADER, MOST_EXTENSIONS = (0, 43, 44, 51, 60), 44, 51, 8
# other well-known TCP options, so that a window-scale option behind them is found
WINDOW_SCALE = r"^(?:01|0204.{4}|0402|080a.{16}|050a.{16}|0512.{32}|051a.{48}|0522.{64})*0303(..)"
FLAG_LETTERS = "NCEUAPRSF"
NO_WINDOW_SCALE = -2


def keep_tcp_udp(df: DataFrame, proto: str = "ip_proto") -> DataFrame:
    """Display filter ``tcp or udp``; apply after frame numbers and deltas are there.

    Frames of IP version 6 have no ``ip_*`` fields; their transport is in ``l4_proto``.
    """
    return df.filter(transport(df, proto).isin(TCP, UDP))


def transport(df: DataFrame, proto: str = "ip_proto") -> Column:
    """Transport protocol of either IP version, where the headers were decoded here."""
    return F.coalesce(F.col("l4_proto"), F.col(proto)) if "l4_proto" in df.columns else F.col(proto)


def _ipv6_transport(head: Column, octets: Column, at: Column, following: Column) -> Column:
    """(kind, at, first) of the transport header behind the IPv6 header that ends at ``at``."""
    start = F.struct(following.cast("int").alias("kind"), at.cast("int").alias("at"), F.lit(True).alias("first"))

    def step(state: Column, _: Column) -> Column:
        known = state["kind"].isin(*EXTENSION_HEADERS) & (octets >= state["at"] + 8)
        size = uint_at(head, state["at"] + 1, 1)
        length = (
            F.when(state["kind"] == FRAGMENT_HEADER, 8).when(state["kind"] == AUTHENTICATION_HEADER, (size + 2) * 4)
            .otherwise((size + 1) * 8)
        )
        part = uint_at(head, state["at"] + 2, 2).bitwiseAND(F.lit(0xFFF8))
        whole = F.when(state["kind"] == FRAGMENT_HEADER, part == 0).otherwise(F.lit(True))
        return F.when(known, F.struct(
            uint_at(head, state["at"], 1).cast("int").alias("kind"), (state["at"] + length).cast("int").alias("at"),
            (state["first"] & whole).alias("first"))).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_EXTENSIONS)), start, step)


def decode_headers(df: DataFrame, oui: DataFrame | None = None) -> DataFrame:
    """Add Ethernet, IP, TCP and UDP header columns.

    The ``ip_*`` columns are of version 4 and null otherwise. ``l3_src``, ``l3_dst``, ``l3_len`` and
    ``l4_proto`` are of both versions, and transport columns and payload are decoded behind either.

    With a ``link_type`` column, frames of raw IP and of cooked captures are decoded from their own
    network header on, and have no Ethernet fields; without it, all frames are Ethernet.

    ``oui(prefix, vendor)`` names vendors for the ``*_resolved`` columns; without it they repeat
    the address.
    """
    linked = "link_type" in df.columns
    raw, cooked = ((F.col("link_type") == t) if linked else None for t in (RAW_IP, COOKED))

    def by_link(ethernet: Column, if_raw: Column, if_cooked: Column) -> Column:
        return F.when(raw, if_raw).when(cooked, if_cooked).otherwise(ethernet) if linked else ethernet

    wire_len = F.col("wire_len") if "wire_len" in df.columns else F.length("frame")
    # octets are cut out of the frame itself, and each word of a header is read once
    head, octets = F.col("frame"), F.col("_octets")
    outer = by_link(F.when(F.length("frame") >= 14, uint_at(head, 12, 2)), F.lit(None), F.lit(None))
    base = once(df, _octets=F.length("frame"), eth_type=outer.cast("int"))
    # behind up to two tags
    tagged = F.col("eth_type").isin(*ETHERTYPE_VLANS) & (octets >= 18)
    base = once(base, _vlan=F.coalesce(tagged, F.lit(False)), _inner=F.when(tagged, uint_at(head, 16, 2)))
    twice = F.col("_inner").isin(*ETHERTYPE_VLANS) & (octets >= 22)
    version = F.when(octets >= 1, F.shiftright(uint_at(head, 0, 1), 4))
    base = once(
        base, _l3=by_link(F.when(twice, 22).when(F.col("_vlan"), 18).otherwise(14), F.lit(0), F.lit(16)),
        _kind=by_link(
            F.when(twice, uint_at(head, 20, 2)).when(F.col("_vlan"), F.col("_inner")).otherwise(F.col("eth_type")),
            F.when(version == 4, ETHERTYPE_IP).when(version == 6, ETHERTYPE_IPV6),
            F.when(octets >= 16, uint_at(head, 14, 2))),
    )
    l3, kind = F.col("_l3"), F.col("_kind")
    base = once(
        base, _vihl=F.when((kind == ETHERTYPE_IP) & (octets >= l3 + 20), uint_at(head, l3, 1)).cast("int"),
        _v6=F.coalesce((kind == ETHERTYPE_IPV6) & (octets >= l3 + 40) & (uint_at(head, l3, 1).between(0x60, 0x6F)), F.lit(False)),
    )
    base = once(base, _far=F.when(F.col("_v6"), _ipv6_transport(head, octets, l3 + 40, uint_at(head, l3 + 6, 1))))
    # version 4 and at least the fixed header
    ihl = F.when(F.col("_vihl").between(0x45, 0x4F), F.col("_vihl").bitwiseAND(F.lit(15)) * 4)
    base = once(base, _ihl=ihl, **words_at("_ip", head, l3, 5, ihl.isNotNull()))
    ip = lambda start, n: part_of("_ip", start, n).cast("int")
    base = once(
        base, ip_len=ip(2, 2), _frag=ip(6, 2), ip_proto=ip(9, 1),
        _l4=F.when(F.col("_v6"), F.col("_far.at")).otherwise(l3 + F.col("_ihl")),
        l4_proto=F.when(F.col("_v6"), F.col("_far.kind")).otherwise(ip(9, 1)),
        l3_len=F.when(F.col("_v6"), (uint_at(head, l3 + 4, 2) + 40).cast("int")).otherwise(ip(2, 2)),
    )
    is_ip = F.col("_ihl").isNotNull()
    address = lambda start: F.when(is_ip, ipv4_text(part_of("_ip", start, 4)))
    # eight groups of four digits, so that text order is numeric order
    long_address = lambda start: F.when(F.col("_v6"), F.rtrim(F.regexp_replace(
        F.lower(F.hex(F.substr(head, l3 + start + 1, F.lit(16)))), "(.{4})(?=.)", "$1:")))
    whole = F.when(F.col("_v6"), F.col("_far.first")).otherwise(F.col("_frag").bitwiseAND(F.lit(0x1FFF)) == 0)
    has = lambda proto, n: F.coalesce(
        whole & (F.col("l4_proto") == proto) & (octets >= F.col("_l4") + n), F.lit(False)
    )
    base = once(
        base, _tcp=has(TCP, 20), _udp=has(UDP, 8),
        **words_at("_in_tcp", head, F.col("_l4"), 5, has(TCP, 20)), **words_at("_in_udp", head, F.col("_l4"), 2, has(UDP, 8)),
    )
    tcp = lambda start, n: part_of("_in_tcp", start, n)
    udp = lambda start, n: part_of("_in_udp", start, n).cast("int")
    base = once(base, _offset_flags=tcp(12, 2).cast("int"), udp_length=udp(4, 2), _src=address(12), _dst=address(16))
    base = base.withColumns({
        "frame_encap_type": by_link(F.lit(1), F.lit(ENCAP_RAW_IP), F.lit(ENCAP_COOKED)),
        "frame_len": wire_len.cast("int"),
        "frame_marked": F.lit(0),
        "eth_dst": by_link(mac_text(head), F.lit(None), F.lit(None)),
        "eth_src": by_link(mac_text(F.substring(head, 7, 6)), F.lit(None), F.lit(None)),
        "ip_version": F.when(is_ip, F.lit(4)),
        "ip_hdr_len": F.col("_ihl"),
        "ip_dsfield": ip(1, 1),
        "ip_dsfield_dscp": F.shiftright(ip(1, 1), 2),
        "ip_dsfield_ecn": ip(1, 1).bitwiseAND(F.lit(3)),
        "ip_id": ip(4, 2),
        "ip_flags": F.col("_frag").bitwiseAND(F.lit(0xE000)),
        "ip_flags_rb": bit(F.col("_frag"), 15),
        "ip_flags_df": bit(F.col("_frag"), 14),
        "ip_flags_mf": bit(F.col("_frag"), 13),
        "ip_frag_offset": F.col("_frag").bitwiseAND(F.lit(0x1FFF)) * 8,
        "ip_ttl": ip(8, 1),
        "ip_checksum": ip(10, 2),
        "ip_checksum_status": F.when(is_ip, F.lit(2)),
        "ip_src": F.col("_src"),
        "ip_dst": F.col("_dst"),
        "l3_src": F.coalesce(F.col("_src"), long_address(8)),
        "l3_dst": F.coalesce(F.col("_dst"), long_address(24)),
        "tcp_srcport": tcp(0, 2).cast("int"),
        "tcp_dstport": tcp(2, 2).cast("int"),
        "tcp_seq_raw": tcp(4, 4),
        "tcp_ack_raw": tcp(8, 4),
        "tcp_hdr_len": F.shiftright("_offset_flags", 12) * 4,
        "tcp_flags": F.col("_offset_flags").bitwiseAND(F.lit(0x0FFF)),
        "tcp_window_size_value": tcp(14, 2).cast("int"),
        "tcp_checksum": tcp(16, 2).cast("int"),
        "tcp_checksum_status": F.when(F.col("_tcp"), F.lit(2)),
        "tcp_urgent_pointer": tcp(18, 2).cast("int"),
        "udp_srcport": udp(0, 2),
        "udp_dstport": udp(2, 2),
        "udp_checksum": udp(6, 2),
        "udp_checksum_status": F.when(F.col("_udp"), F.lit(2)),
    })
    flag_names = ["ns", "cwr", "ecn", "urg", "ack", "push", "reset", "syn", "fin"]
    flags = {f"tcp_flags_{n}": bit(F.col("tcp_flags"), 8 - i) for i, n in enumerate(flag_names)}
    letters = [
        F.when(F.col(f"tcp_flags_{n}") == 1, F.lit(letter)).otherwise(F.lit("·"))
        for n, letter in zip(flag_names, FLAG_LETTERS)
    ]
    reserved = [
        F.when(bit(F.col("tcp_flags"), p) == 1, F.lit("R")).otherwise(F.lit("·")) for p in (11, 10, 9)
    ]
    options = F.lower(F.hex(F.substr(head, F.col("_l4") + 21, F.greatest(F.col("tcp_hdr_len") - 20, F.lit(0)))))
    base = base.withColumns({
        **flags,
        "tcp_flags_res": F.shiftright("tcp_flags", 9),
        "tcp_len": F.when(
            F.col("_tcp"),
            F.greatest(F.col("l3_len") - (F.col("_l4") - F.col("_l3")) - F.col("tcp_hdr_len"), F.lit(0)),
        ),
    }).withColumns({
        "tcp_flags_str": F.when(F.col("_tcp"), F.concat(*reserved, *letters)),
        "tcp_window_shift": F.when(
            (F.col("tcp_flags_syn") == 1) & options.rlike(WINDOW_SCALE),
            F.conv(F.regexp_extract(options, WINDOW_SCALE, 1), 16, 10).cast("int"),
        ),
        "_payload_at": F.col("_l4") + F.when(F.col("_tcp"), F.col("tcp_hdr_len")).otherwise(F.lit(8)),
        "_payload_len": F.when(F.col("_tcp"), F.col("tcp_len")).when(
            F.col("_udp"), F.greatest(F.col("udp_length") - 8, F.lit(0))
        ),
    })
    payload = F.substr("frame", F.col("_payload_at") + 1, F.col("_payload_len"))
    app = F.when(F.coalesce(F.col("_payload_len"), F.lit(0)) > 0, F.lit("data"))
    base = base.withColumns({
        # binary, so that nothing is rendered before it is cut
        "payload": F.when(F.col("_payload_len") > 0, payload),
        "data_len": F.when(F.col("_payload_len") > 0, F.col("_payload_len")),
        "frame_protocols": F.concat_ws(
            ":", by_link(F.lit("eth:ethertype"), F.lit("raw"), F.lit("sll:ethertype")), F.when(F.col("_vlan"), F.lit("vlan:ethertype")),
            F.when(is_ip, F.lit("ip")).when(F.col("_v6"), F.lit("ipv6")),
            F.when(F.col("_tcp"), F.lit("tcp")).when(F.col("_udp"), F.lit("udp"))
            .when(F.col("ip_proto") == ICMP, F.lit("icmp")),
            app,
        ),
    })
    base = _resolve(base, "eth_dst", oui)
    base = _resolve(base, "eth_src", oui)
    return base.drop(*[c for c in base.columns if c.startswith("_")])


def _resolve(df: DataFrame, address: str, oui: DataFrame | None) -> DataFrame:
    if oui is None:
        return df.withColumn(f"{address}_resolved", F.col(address))
    vendors = oui.select(F.col("prefix").alias("_prefix"), F.col("vendor").alias("_vendor"))
    joined = df.join(vendors, F.substring(address, 1, 8) == F.col("_prefix"), "left")
    named = F.concat("_vendor", F.lit("_"), F.substring(address, 10, 8))
    return joined.withColumn(f"{address}_resolved", F.coalesce(named, F.col(address))).drop("_prefix", "_vendor")


def frame_features(df: DataFrame) -> DataFrame:
    """Frame number and times relative to the capture; over all frames, before any filter."""
    timed = running(
        df, ["capture"], ["frame_no"], frame_chunk(F.col("frame_no")),
        _first=("first", F.col("ts_us")), _prev=("prev", F.col("ts_us")),
    )
    return timed.withColumns({
        "frame_number": F.col("frame_no"),
        "frame_time": F.col("ts_us"),
        "frame_time_epoch": F.col("ts_us"),
        "frame_offset_shift": F.lit(0).cast("bigint"),
        "frame_time_delta": F.col("ts_us") - F.coalesce("_prev", "ts_us"),
        "frame_time_relative": F.col("ts_us") - F.col("_first"),
    }).drop("_first", "_prev")


def flow_ends(df: DataFrame) -> DataFrame:
    """Direction-insensitive flow key: ``end_a <= end_b``, and ``from_a`` for the direction."""
    port = lambda side: F.coalesce(F.col(f"tcp_{side}port"), F.col(f"udp_{side}port"))
    # fixed width, so that text order is numeric order
    layer = "l3" if "l3_src" in df.columns else "ip"
    # an address of version 4 has four parts; missing ones are left out
    part = lambda parts, i: F.lpad(F.get(F.col(parts), i), 3, "0")
    wide = lambda addr, parts: F.when(F.col(parts).isNull(), F.col(addr)).otherwise(
        F.concat_ws(".", *[part(parts, i) for i in range(4)]))
    digits = lambda side: F.lpad(port(side).cast("string"), 5, "0")
    end = lambda addr, parts, side: F.concat(
        F.coalesce(wide(addr, parts), F.lit("null")), F.lit(":"), F.coalesce(digits(side), F.lit(" null")))
    known = transport(df).isin(TCP, UDP) & port("src").isNotNull()
    split = lambda addr: F.when(known & ~F.contains(F.col(addr), F.lit(":")), F.split(addr, r"\."))
    ends = once(df, _src_parts=split(f"{layer}_src"), _dst_parts=split(f"{layer}_dst"))
    ends = once(
        ends, _src=F.when(known, end(f"{layer}_src", "_src_parts", "src")),
        _dst=F.when(known, end(f"{layer}_dst", "_dst_parts", "dst")))
    return ends.withColumns({
        "end_a": F.least("_src", "_dst"),
        "end_b": F.greatest("_src", "_dst"),
        "from_a": F.col("_src") <= F.col("_dst"),
    }).drop("_src", "_dst", "_src_parts", "_dst_parts")


def stream_ids(df: DataFrame) -> DataFrame:
    """Add ``tcp_stream``/``udp_stream``: 0-based per capture and protocol, by first appearance.

    Streams are numbered on the list of streams, and handed back per (stream, frame chunk), so a
    stream or capture holding most frames is neither numbered nor joined in one task.
    """
    key = ["capture", "_transport", "end_a", "end_b"]
    packets = flow_ends(df).withColumns({"_part": frame_chunk(F.col("frame_no")), "_transport": transport(df)})
    parts = (
        packets.filter(F.col("end_a").isNotNull())
        .groupBy(*key, "_part").agg(F.min("frame_no").alias("_first"))
    )
    streams = parts.groupBy(*key).agg(F.min("_first").alias("_first"))
    numbered = number_rows(
        streams, ["capture", "_transport"], ["_first"], frame_chunk(F.col("_first")), "_stream"
    ).select(*key, (F.col("_stream") - 1).alias("_stream"))
    tags = parts.drop("_first").join(numbered, key)
    tagged = packets.join(tags, [*key, "_part"], "left")
    return tagged.withColumns({
        "tcp_stream": F.when(F.col("_transport") == TCP, F.col("_stream")),
        "udp_stream": F.when(F.col("_transport") == UDP, F.col("_stream")),
    }).drop("_stream", "_part", "_transport")


def stream_features(df: DataFrame) -> DataFrame:
    """Sequence and timing features of TCP streams; input has ``stream_ids`` columns.

    Other rows keep nulls. ``tcp_segment*`` and ``tcp_reassembled_length`` need reassembly and
    stay null.
    """
    has_stream = F.col("tcp_stream").isNotNull()
    # rows of no stream form groups by their own frame number, so they do not pile up
    framed = df.withColumns({
        "_group": F.when(has_stream, F.col("tcp_stream")).otherwise(-F.col("frame_no")),
        "_part": frame_chunk(F.col("frame_no")),
        "_nxt": F.col("tcp_seq_raw") + F.col("tcp_len")
        + F.when((F.col("tcp_flags_syn") == 1) | (F.col("tcp_flags_fin") == 1), 1).otherwise(0),
        "_acked": F.when(F.col("tcp_flags_ack") == 1, F.col("tcp_ack_raw")),
    })
    by_direction = {}
    for side, mine in (("a", F.col("from_a")), ("b", ~F.col("from_a"))):
        only = lambda c, mine=mine: F.when(has_stream & mine, c)
        by_direction.update({
            f"_base_{side}": ("first", only(F.col("tcp_seq_raw"))),
            f"_ack0_{side}": ("first", only(F.col("_acked"))),
            f"_ack_{side}": ("max", only(F.col("_acked"))),
            f"_top_{side}": ("max", only(F.col("_nxt"))),
            f"_sent_{side}": ("sum", only(F.col("tcp_len").cast("bigint"))),
            f"_shift_{side}": ("last", only(F.col("tcp_window_shift"))),
        })
        by_direction[f"_pushed_{side}"] = (
            "sum_at_last",
            (F.coalesce(only(F.col("tcp_len").cast("bigint")), F.lit(0)), only(F.col("tcp_flags_push") == 1)),
        )
    rows = running(
        framed, ["capture", "_group"], ["frame_no"], F.col("_part"),
        _t0=("first", F.col("ts_us")), _t1=("prev", F.col("ts_us")), **by_direction,
    )
    mine = lambda name: F.when(F.col("from_a"), F.col(f"_{name}_a")).otherwise(F.col(f"_{name}_b"))
    theirs = lambda name: F.when(F.col("from_a"), F.col(f"_{name}_b")).otherwise(F.col(f"_{name}_a"))
    base = mine("base")
    carries = has_stream & (F.col("tcp_len") > 0)
    flight = mine("top") - F.coalesce(theirs("ack"), base)
    return rows.withColumns({
        "tcp_seq": F.when(has_stream, F.col("tcp_seq_raw") - base),
        "tcp_nxtseq": F.when(has_stream, F.col("_nxt") - base),
        "tcp_ack": F.when(
            has_stream,
            F.coalesce(F.col("_acked") - F.coalesce(theirs("base"), mine("ack0")), F.lit(0)),
        ),
        "tcp_time_relative": F.when(has_stream, F.col("ts_us") - F.col("_t0")),
        "tcp_time_delta": F.when(has_stream, F.col("ts_us") - F.coalesce("_t1", "ts_us")),
        "tcp_window_size_scalefactor": F.when(
            has_stream,
            F.coalesce(F.pow(F.lit(2), mine("shift")).cast("int"), F.lit(NO_WINDOW_SCALE)),
        ),
        # the window of a SYN itself is never scaled
        "tcp_window_size": F.when(
            has_stream,
            F.col("tcp_window_size_value").cast("bigint")
            * F.when(F.col("tcp_flags_syn") == 1, F.lit(1)).otherwise(
                F.coalesce(F.pow(F.lit(2), mine("shift")).cast("int"), F.lit(1))
            ),
        ),
        "tcp_analysis_bytes_in_flight": F.when(carries & (flight > 0), flight),
        "tcp_analysis_push_bytes_sent": F.when(
            carries, mine("sent") - F.coalesce(mine("pushed"), F.lit(0))
        ),
        "tcp_segment": F.lit(None).cast("string"),
        "tcp_segment_count": F.lit(None).cast("int"),
        "tcp_reassembled_length": F.lit(None).cast("int"),
    }).drop(*[c for c in rows.columns if c.startswith("_")])


# what frame and stream features are made from; all else stays where it was decoded
FEATURE_SOURCES = [
    "capture", "frame_no", "ts_us", "ip_proto", "l4_proto", "l3_src", "l3_dst", "tcp_srcport", "tcp_dstport", "udp_srcport",
    "udp_dstport", "tcp_seq_raw", "tcp_ack_raw", "tcp_len", "tcp_flags_syn", "tcp_flags_fin", "tcp_flags_ack", "tcp_flags_push",
    "tcp_window_shift", "tcp_window_size_value",
]


def packet_fields(df: DataFrame, oui: DataFrame | None = None) -> DataFrame:
    """All extracted fields of TCP and UDP frames, with the payload cut to what is rendered.

    Decoded headers are staged as a table, and frames are decoded once. The features of frames and
    streams are made from a few narrow columns of it; payload and the other fields meet them at the
    end, in one join by capture and frame number.
    """
    decoded = stage(decode_headers(df, oui).withColumn(
        "payload", F.substring("payload", 1, TCP_PAYLOAD_CHARS // 2)).drop("frame"))
    timed = keep_tcp_udp(frame_features(decoded.select(*FEATURE_SOURCES)))
    features = stream_features(stage(stream_ids(timed)))
    made = [c for c in features.columns if c not in FEATURE_SOURCES]
    return decoded.join(features.select("capture", "frame_no", *made), ["capture", "frame_no"])


def _field_text(field: str) -> Column:
    column = F.col(field.replace(".", "_"))
    if field == "frame.time":
        stamp = F.timestamp_micros(column)
        day = F.lpad(F.day(stamp).cast("string"), 2, " ")
        part = F.concat(F.lpad(F.pmod(column, F.lit(1_000_000)).cast("string"), 6, "0"), F.lit("000"))
        return F.concat(
            F.date_format(stamp, "MMM "), day, F.date_format(stamp, ", yyyy HH:mm:ss."), part,
            F.lit(" UTC"),
        )
    if field == "tcp.payload":
        head = F.substring("payload", 1, TCP_PAYLOAD_CHARS // 2)
        return F.when(F.col("tcp_srcport").isNotNull(), F.lower(F.hex(head)))
    if field in SECONDS_FIELDS:
        return seconds_text(column)
    if field in HEX_FIELDS:
        return F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(column.cast("bigint")), 8, "0")))
    return column.cast("string")


def field_texts(fields: list[str] | None = None) -> list[Column]:
    """The text of each extracted field, empty where there is none."""
    return [F.coalesce(_field_text(f), F.lit("")).alias(f.replace(".", "_")) for f in fields or PACKET_FIELDS]


def traffic_words(df: DataFrame, fields: list[str] | None = None, out: str = "words") -> DataFrame:
    """``"field: value"`` joined by ``", "``; the first field stays even when empty."""
    first, *rest = fields or PACKET_FIELDS
    pieces = [F.concat(F.lit(f"{first}: "), F.coalesce(_field_text(first), F.lit("")))]
    for field in rest:
        text = _field_text(field)
        pieces.append(F.when(text != "", F.concat(F.lit(f"{field}: "), text)))
    return df.withColumn(out, F.concat_ws(", ", *pieces))


def server_words(df: DataFrame, out: str = "words") -> DataFrame:
    """Words of the first TCP or UDP frame of each capture, without the two addresses."""
    first = df.groupBy("capture").agg(F.min("frame_no").alias("frame_no"))
    return traffic_words(df.join(first, ["capture", "frame_no"]), SERVER_FIELDS, out)


def hex_head(frame: Column, chars: int) -> Column:
    """Hex text of at most ``chars`` characters; octets are cut before they are rendered."""
    octets = (chars + 1) // 2
    return F.substring(F.lower(F.hex(F.substring(frame, 1, octets))), 1, chars)


def packet_hex(df: DataFrame, max_chars: int = PACKET_HEX_CHARS, out: str = "packet_hex") -> DataFrame:
    return df.withColumn(out, hex_head(F.col("frame"), max_chars))


def five_tuple_text(ip_for_udp: bool = False) -> Column:
    """Dictionary text; the addresses and protocol appear for TCP only unless ``ip_for_udp``."""
    tcp, udp = F.col("tcp_srcport").isNotNull(), F.col("udp_srcport").isNotNull()
    address = fill("'src': '{src}', 'dst': '{dst}', 'proto': {proto}",
                   src=F.col("l3_src"), dst=F.col("l3_dst"), proto=F.col("l4_proto").cast("string"))
    ports = fill("'sport': {s}, 'dport': {d}",
                 s=F.coalesce("tcp_srcport", "udp_srcport").cast("string"),
                 d=F.coalesce("tcp_dstport", "udp_dstport").cast("string"))
    shown = tcp | (udp & F.lit(ip_for_udp))
    return F.concat(F.lit("{"), F.concat_ws(", ", F.when(shown, address), F.when(tcp | udp, ports)), F.lit("}"))


def five_tuple(df: DataFrame, ip_for_udp: bool = False, max_chars: int = PACKET_HEX_CHARS) -> DataFrame:
    columns = {
        "src": F.col("l3_src"), "dst": F.col("l3_dst"), "proto": F.col("l4_proto"),
        "sport": F.coalesce("tcp_srcport", "udp_srcport"),
        "dport": F.coalesce("tcp_dstport", "udp_dstport"),
    }
    return df.withColumns({
        "five_tuple": F.struct(*[c.alias(n) for n, c in columns.items()]),
        "five_tuple_text": F.substring(five_tuple_text(ip_for_udp), 1, max_chars),
    })


def five_tuple_hex(df: DataFrame, ip_for_udp: bool = False, max_chars: int = PACKET_HEX_CHARS) -> DataFrame:
    """Dictionary text, a blank and the frame hex, cut after joining."""
    joined = F.concat(five_tuple_text(ip_for_udp), F.lit(" "), hex_head(F.col("frame"), max_chars))
    return df.withColumn("five_tuple_hex", F.substring(joined, 1, max_chars))


def layer_summary(df: DataFrame, out: str = "layers") -> DataFrame:
    """Layers in angle brackets, nested in order, built from the decoded columns."""
    ether = fill("<Ether dst={d} src={s} type=", d=F.col("eth_dst"), s=F.col("eth_src"))
    kind = F.when(F.col("eth_type") == ETHERTYPE_IP, F.lit("IPv4")).when(F.col("eth_type") == ETHERTYPE_IPV6, F.lit("IPv6")).otherwise(
        F.format_string("0x%x", F.col("eth_type"))
    )
    ip = F.when(F.col("ip_version").isNotNull(), fill(
        " |<IP version={v} ihl={i} tos=0x{t} len={l} id={id} ttl={ttl} proto={p} src={s} dst={d}",
        v=F.col("ip_version").cast("string"), i=quotient(F.col("ip_hdr_len"), 4).cast("string"),
        t=F.lower(F.hex("ip_dsfield")), l=F.col("ip_len").cast("string"),
        id=F.col("ip_id").cast("string"), ttl=F.col("ip_ttl").cast("string"),
        p=F.when(F.col("ip_proto") == TCP, "tcp").when(F.col("ip_proto") == UDP, "udp")
        .otherwise(F.col("ip_proto").cast("string")),
        s=F.col("ip_src"), d=F.col("ip_dst"),
    ))
    six = F.when(F.col("l3_src").contains(":"), fill(
        " |<IPv6 version=6 len={l} src={s} dst={d}",
        l=(F.col("l3_len") - 40).cast("string"), s=F.col("l3_src"), d=F.col("l3_dst")))
    ip = F.coalesce(ip, six)
    letters = F.regexp_replace(F.reverse("tcp_flags_str"), "·", "")
    tcp = F.when(F.col("tcp_srcport").isNotNull(), fill(
        " |<TCP sport={s} dport={d} seq={q} ack={a} flags={f} window={w}",
        s=F.col("tcp_srcport").cast("string"), d=F.col("tcp_dstport").cast("string"),
        q=F.col("tcp_seq_raw").cast("string"), a=F.col("tcp_ack_raw").cast("string"),
        f=letters, w=F.col("tcp_window_size_value").cast("string"),
    ))
    udp = F.when(F.col("udp_srcport").isNotNull(), fill(
        " |<UDP sport={s} dport={d} len={l}",
        s=F.col("udp_srcport").cast("string"), d=F.col("udp_dstport").cast("string"),
        l=F.col("udp_length").cast("string"),
    ))
    raw = F.when(F.col("payload").isNotNull(), fill(" |<Raw load={x}", x=F.lower(F.hex("payload"))))
    layers = [ip, tcp, udp, raw]
    depth = F.lit(1)
    for layer in layers:
        depth = depth + F.when(layer.isNotNull(), 1).otherwise(0)
    text = F.concat(ether, kind, *[F.coalesce(l, F.lit("")) for l in layers], F.repeat(F.lit(" |>"), depth))
    return df.withColumn(out, text)


def payload_packets(df: DataFrame, max_chars: int = PACKET_HEX_CHARS, out: str = "payload_hex") -> DataFrame:
    """Cut hex payload of every TCP packet that has one; flows with none drop out."""
    return df.filter((transport(df) == TCP) & F.col("payload").isNotNull()).withColumn(
        out, hex_head(F.col("payload"), max_chars)
    )
