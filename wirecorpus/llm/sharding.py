"""Shards of near equal size by longest-processing-time scheduling.

Rows of equal text form a group and stay together. Groups are taken in descending size, each into
the shard with the least load so far, which a heap gives.

The list that is scheduled is bounded whatever the corpus: a group above a share of a shard is an
item of its own (there can be only so many), smaller groups are bundled by hash. Half of the hash
range is cut into wide bundles, a quarter into bundles of half that width, and so on, so the last
items placed are tiny and level the loads.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, functions as F

from wirecorpus.functions.ordering import hash_chunk, number_rows

# a group of over 1/SHARE of a mean shard is scheduled on its own
SHARE = 64
# bundles of one width per shard, and widths, each half of the one before
BUNDLES, WIDTHS = 16, 11


def schedule(items: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Item to shard: largest first, ties by name, into the least loaded shard (the lowest of equals)."""
    heap = [(0, s) for s in range(shards)]
    placed: dict[str, int] = {}
    for name, size in sorted(items, key=lambda item: (-item[1], item[0])):
        load, at = heapq.heappop(heap)
        placed[name] = at
        heapq.heappush(heap, (load + size, at))
    return placed


def _bundle(shards: int):
    """Name of the bundle of a group key."""
    draw = F.xxhash64("_group", F.lit(1)).bitwiseAND(F.lit((1 << 40) - 1)) + 1
    width = F.least(F.floor(F.lit(40.0) - F.log2(draw.cast("double"))), F.lit(WIDTHS - 1)).cast("string")
    place = F.pmod(F.xxhash64("_group", F.lit(2)), F.lit(BUNDLES * shards)).cast("string")
    return F.concat_ws("_", F.lit("bundle"), width, place)


def shard_by_size(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    ``size`` is the text's octets plus 8, ``slot`` numbers the rows of a shard from 0 without gaps,
    ``law`` is ``bytes`` and ``grown_shard`` null. A null text counts as empty and groups with the
    empty ones. A group larger than a shard is still one shard's; the others share the rest.
    Repeated rows are kept and get slots of their own. No row gives no row. Other columns are not
    carried, so their names do not matter.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.md5(body).alias("_group"),
    )
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_octets"))
    total = groups.agg(F.sum("_octets")).first()[0] or 0
    own = F.col("_octets") * (shards * SHARE) > total
    items = (
        groups.select(F.when(own, F.col("_group")).otherwise(_bundle(shards)).alias("_item"), "_octets")
        .groupBy("_item").agg(F.sum("_octets").alias("_octets"))
    )
    # at most shards * (SHARE + BUNDLES * WIDTHS) rows
    sizes = [(r[0], r[1]) for r in items.collect()]
    placed = schedule(sizes, shards)
    plan = spark.createDataFrame(list(placed.items()), "_item string, shard int")
    large = spark.createDataFrame([(n,) for n, _ in sizes if not n.startswith("bundle")], "_group string")
    placed_rows = (
        rows.join(F.broadcast(large.withColumn("_item", F.col("_group"))), "_group", "left")
        .withColumn("_item", F.coalesce("_item", _bundle(shards)))
        .join(F.broadcast(plan), "_item")
        .withColumn("_order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    )
    numbered = number_rows(
        placed_rows, ["shard"], ["_order", "doc_id", "text_crc32", "size"], hash_chunk(F.col("_order"), 3), "slot"
    )
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("slot") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
