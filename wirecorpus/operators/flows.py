"""Flow texts: first packets of a capture or of a bidirectional flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wirecorpus.operators.catalog import FLOW_PACKET_CHARS, FLOW_PACKETS, PACKET_MARK
from wirecorpus.operators.packets import TCP, UDP, flow_ends, hex_head, transport

FLOW_KEY = ["capture", "ip_proto", "end_a", "end_b"]


def _flow_rows(df: DataFrame, protocols: list[int]) -> DataFrame:
    """Packets of these protocols with their flow's ends; ``ip_proto`` is the transport of either IP version."""
    named = flow_ends(df).withColumn("ip_proto", transport(df))
    return named.filter(F.col("ip_proto").isin(*protocols))


def _in_order(value: str) -> Column:
    """Values of a group in frame order; the group is already cut to its first packets."""
    listed = F.array_sort(F.collect_list(F.struct("frame_no", value)))
    return F.transform(listed, lambda p: p[value])


def _first_packets(df: DataFrame, k: int) -> DataFrame:
    """First ``k`` rows per flow; the rank limit is applied map-side before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*FLOW_KEY).orderBy("frame_no"))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def _marked(texts: Column) -> Column:
    return F.concat(F.lit(PACKET_MARK), F.array_join(texts, PACKET_MARK))


def flow_bytes(
    df: DataFrame, k: int = FLOW_PACKETS, width: int = FLOW_PACKET_CHARS,
    captures: DataFrame | None = None,
) -> DataFrame:
    """One text per capture from its first ``k`` frames, each cut to ``width`` characters.

    Frame numbers are dense, so the cut is a plain filter. With ``captures`` (the file list) a
    capture without frames gives the bare mark.
    """
    keys = ["capture", "label"]
    cut = df.filter(F.col("frame_no") <= k).select(
        *keys, "frame_no", hex_head(F.col("frame"), width).alias("piece")
    )
    texts = cut.groupBy(*keys).agg(_marked(_in_order("piece")).alias("flow_text"))
    if captures is None:
        return texts
    return captures.select(*keys).join(texts, keys, "left").withColumn(
        "flow_text", F.coalesce("flow_text", F.lit(PACKET_MARK))
    )


def flow_lengths(df: DataFrame, k: int = FLOW_PACKETS, signed: bool = False) -> DataFrame:
    """First ``k`` IP packet lengths per flow; ``signed`` negates the second party's packets."""
    packets = _flow_rows(df, [TCP, UDP])
    length = "l3_len" if "l3_len" in df.columns else "ip_len"
    packets = packets.select(*FLOW_KEY, "label", "frame_no", "from_a", F.col(length).alias("piece"))
    first = _first_packets(packets, k)
    if signed:
        # the party that sent the first packet is positive
        opener = F.first("from_a").over(W.partitionBy(*FLOW_KEY).orderBy("frame_no"))
        first = first.withColumn("_open", opener).withColumn(
            "piece", F.when(F.col("from_a") == F.col("_open"), F.col("piece")).otherwise(-F.col("piece"))
        )
    lengths = F.transform(_in_order("piece"), lambda n: n.cast("string"))
    return first.groupBy(*FLOW_KEY, "label").agg(F.array_join(lengths, " ").alias("lengths"))


def flow_payload(
    df: DataFrame, k: int = FLOW_PACKETS, width: int = FLOW_PACKET_CHARS, udp: bool = True
) -> DataFrame:
    """First ``k`` payloads per flow, cut and marked; flows without payload drop out."""
    protocols = [TCP, UDP] if udp else [TCP]
    packets = _flow_rows(df.filter(F.col("payload").isNotNull()), protocols)
    cut = packets.select(*FLOW_KEY, "label", "frame_no", hex_head(F.col("payload"), width).alias("piece"))
    return _first_packets(cut, k).groupBy(*FLOW_KEY, "label").agg(
        _marked(_in_order("piece")).alias("flow_text")
    )


def split_flow(df: DataFrame, text: str = "flow_text") -> DataFrame:
    """Flow text to (packet_index, packet_hex) rows; the inverse of joining."""
    pieces = F.split(F.substr(F.col(text), F.lit(len(PACKET_MARK) + 1)), PACKET_MARK)
    return df.select(
        *[c for c in df.columns if c != text], F.posexplode(pieces).alias("packet_index", "packet_hex")
    )
