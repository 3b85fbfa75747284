"""Header parsing and frame synthesis as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wirecorpus.functions.octets import (
    address_words, halves, hex_digits, internet_checksum, ipv4_hex, once, quotient, udp_checksum, words_sum,
)
from wirecorpus.operators.flows import split_flow

HEADER_SCHEMA = "src STRING, dst STRING, proto INT, sport INT, dport INT"
TCP, UDP = 6, 17
IP_HEADER, TCP_HEADER, UDP_HEADER = 20, 20, 8
# fixed values: header defaults of synthesised frames
ETH_DST = "ffffffffffff"
ETH_SRC = "020000000001"
DEFAULTS = {"ip_id": 1, "ttl": 64, "seq": 0, "ack": 0, "flags": 0x02, "window": 8192}


def parse_headers(df: DataFrame, text: str = "header") -> DataFrame:
    """Header text to columns; ``header_ok`` is false for text that does not give a full header."""
    parsed = F.from_json(F.replace(F.col(text), F.lit("'"), F.lit('"')), HEADER_SCHEMA)
    fields = df.withColumn("_h", parsed)
    complete = F.lit(True)
    for name in ("src", "dst", "proto", "sport", "dport"):
        complete = complete & F.col(f"_h.{name}").isNotNull()
    octet = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
    dotted = rf"^{octet}(\.{octet}){{3}}$"
    port_ok = F.col("_h.sport").between(0, 65535) & F.col("_h.dport").between(0, 65535)
    complete = complete & F.col("_h.src").rlike(dotted) & F.col("_h.dst").rlike(dotted) & port_ok
    return fields.select(*df.columns, "_h.*", F.coalesce(complete, F.lit(False)).alias("header_ok"))


def _input(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(DEFAULTS[name])


def build_frames(
    df: DataFrame, compat_len: bool = True, other: str = "udp", eth_src: str = ETH_SRC
) -> DataFrame:
    """Add ``frame BINARY`` from ``src, dst, proto, sport, dport, payload_hex``.

    ``compat_len`` writes the published IP length of 16 + payload octets instead of the true one.
    Checksums cover the headers only, with the written length in the pseudo header. Protocols
    besides TCP become UDP, or a bare IP payload with ``other='raw'``. Optional columns:
    ``ip_id, ttl, seq, ack, flags, window, options_hex``.
    """
    tcp = F.col("proto") == TCP
    bare = ~F.col("proto").isin(TCP, UDP) & F.lit(other == "raw")
    has_options = "options_hex" in df.columns
    options = F.coalesce(F.col("options_hex"), F.lit("")) if has_options else F.lit("")
    option_octets = quotient(F.length(options), 2).cast("int")
    octets = quotient(F.col("_digits"), 2).cast("int")
    header_len = (
        F.when(tcp, F.lit(TCP_HEADER) + option_octets)
        .when(bare, F.lit(0))
        .otherwise(F.lit(UDP_HEADER))
    )
    parted = df
    if has_options:
        # on its own: a generator with a function over an array is interpreted, whatever else it makes
        parted = once(df, _option_sum=F.when(options == "", F.lit(0).cast("bigint")).otherwise(words_sum(options)))
    # digits are counted once, which takes as long as the text
    parted = once(parted, _digits=F.length("payload_hex"), _src=F.split("src", r"\."), _dst=F.split("dst", r"\."))
    base = once(
        parted,
        _octets=octets,
        _ip_proto=F.when(tcp | bare, F.col("proto")).otherwise(F.lit(UDP)).cast("bigint"),
        _ip_len=(F.lit(16) + octets if compat_len else F.lit(IP_HEADER) + header_len + octets).cast("bigint"),
        _udp_len=(F.lit(UDP_HEADER) if compat_len else F.lit(UDP_HEADER) + octets).cast("bigint"),
        _offset_flags=((F.lit(5) + quotient(option_octets, 4)) * 4096 + _input(df, "flags")).cast("bigint"),
        _addresses=address_words(F.col("_src")) + address_words(F.col("_dst")),
    )
    ip_len, proto = F.col("_ip_len"), F.col("_ip_proto")
    ip_id, ttl = _input(df, "ip_id").cast("bigint"), _input(df, "ttl").cast("bigint")
    seq, ack, window = _input(df, "seq"), _input(df, "ack"), _input(df, "window")
    ports = F.col("sport").cast("bigint") + F.col("dport")
    ip_sum = F.lit(0x4500) + ip_len + ip_id + ttl * 256 + proto + F.col("_addresses")
    pseudo = F.col("_addresses") + proto + ip_len - IP_HEADER + ports
    tcp_sum = pseudo + halves(seq.cast("bigint")) + halves(ack.cast("bigint")) + F.col("_offset_flags") + window
    if has_options:
        tcp_sum = tcp_sum + F.col("_option_sum")
    udp_sum = pseudo + F.col("_udp_len")

    port_hex = F.concat(hex_digits(F.col("sport"), 2), hex_digits(F.col("dport"), 2))
    tcp_head = F.concat(
        port_hex, hex_digits(seq, 4), hex_digits(ack, 4), hex_digits(F.col("_offset_flags"), 2), hex_digits(window, 2),
        hex_digits(internet_checksum(tcp_sum), 2), F.lit("0000"), options,
    )
    udp_head = F.concat(port_hex, hex_digits(F.col("_udp_len"), 2), hex_digits(udp_checksum(udp_sum), 2))
    frame_hex = F.concat(
        F.lit(ETH_DST + eth_src + "08004500"), hex_digits(ip_len, 2), hex_digits(ip_id, 2), F.lit("0000"),
        hex_digits(ttl, 1), hex_digits(proto, 1), hex_digits(internet_checksum(ip_sum), 2),
        ipv4_hex(F.col("_src")), ipv4_hex(F.col("_dst")),
        F.when(tcp, tcp_head).when(bare, F.lit("")).otherwise(udp_head),
        # whole octets; a text of even length needs no cut, which would count its characters
        F.when(F.col("_digits") % 2 == 0, F.col("payload_hex")).otherwise(
            F.substr("payload_hex", F.lit(1), F.col("_octets") * 2)),
    )
    return once(base, frame=F.unhex(frame_hex)).select(*df.columns, "frame")


def build_flow_frames(df: DataFrame, text: str = "flow_text", compat_len: bool = True) -> DataFrame:
    """One frame per packet of a flow text; every packet keeps the header of its flow."""
    packets = split_flow(df, text).withColumnRenamed("packet_hex", "payload_hex")
    return build_frames(packets, compat_len=compat_len).drop("payload_hex")
