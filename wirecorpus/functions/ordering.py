"""Stable order keys, and running values over groups too large for one task.

A window partitioned only by a group puts the whole group into one task. ``running`` splits
each group into chunks that follow its order, summarises every chunk (map-side combined),
carries the summaries forward over the short chunk list, and finishes with a window inside
``(group, chunk)``. A chunk key must be a non-decreasing function of the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wirecorpus.functions.octets import quotient
from wirecorpus.session import stage

# frames per chunk when a dense frame number is the order
FRAMES_PER_CHUNK = 65_536
# groups whose bounds may be handed to every task; beyond it they are joined like any table
SHARED_GROUPS = 100_000
# leading hex digits of an md5 key used as its chunk
HASH_CHUNK_DIGITS = 4


def stable_key(purpose: str, ident: Column, seed: int = 42) -> Column:
    """Pseudo-random order that depends on the row alone, never on partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}|{purpose}|"), ident.cast("string")))


def stable_pick(purpose: str, ident: Column, n: Column, seed: int = 42) -> Column:
    """Index in [0, n) drawn from the stable key."""
    draw = F.conv(F.substring(stable_key(purpose, ident, seed), 1, 8), 16, 10).cast("bigint")
    return F.pmod(draw, n.cast("bigint"))


def hash_chunk(key: Column, digits: int = HASH_CHUNK_DIGITS) -> Column:
    return F.substring(key, 1, digits)


def frame_chunk(frame_no: Column, size: int = FRAMES_PER_CHUNK) -> Column:
    return quotient(frame_no, size)


def _ordered(order: list[Column], value: Column) -> Column:
    """(order, value) where the value is set, null elsewhere; min/max give first/last set value."""
    fields = [o.alias(f"o{i}") for i, o in enumerate(order)]
    return F.when(value.isNotNull(), F.struct(*fields, value.alias("v")))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    **features: tuple,
) -> DataFrame:
    """Add running values per ``keys`` in ``order``.

    Key and order columns must not be null. Each feature is ``name=(kind, value)``. Kinds: ``row_number``; ``size`` of the
    group, and ``total`` and ``max_all`` over the whole group; ``sum``, ``max``, ``min``,
    ``first``, ``last`` up to and including the row (first/last skip nulls); ``sum_before``,
    ``max_before``, ``last_before`` up to the row before; ``prev`` for the value on the row before;
    ``sum_at_last`` with a pair (value, flag): the running sum of the value on the last flagged
    row before this one.
    """
    order_cols = [F.col(o) for o in order]
    source = df.withColumn("_chunk", chunk)
    for name, (kind, value) in features.items():
        if kind == "sum_at_last":
            local_sum = F.sum(value[0]).over(
                W.partitionBy(*keys, "_chunk").orderBy(*order_cols)
                .rowsBetween(W.unboundedPreceding, W.currentRow)
            )
            source = source.withColumns({f"_in_{name}": value[0], f"_cum_{name}": F.when(value[1], local_sum)})
        elif value is not None:
            source = source.withColumn(f"_in_{name}", value)

    summaries, carries, stacked, finals = [], [], [], []
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order_cols)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    strictly = inside.rowsBetween(W.unboundedPreceding, -1)
    for name, (kind, _) in features.items():
        value, total, carry = F.col(f"_in_{name}"), f"_total_{name}", f"_carry_{name}"
        if kind == "row_number":
            summaries.append(F.count(F.lit(1)).alias(total))
            carries.append(F.sum(total).over(before).alias(carry))
            final = F.row_number().over(inside) + F.coalesce(F.col(carry), F.lit(0))
        elif kind == "size":
            summaries.append(F.count(F.lit(1)).alias(total))
            carries.append(F.sum(total).over(W.partitionBy(*keys)).alias(carry))
            final = F.col(carry)
        elif kind in ("total", "max_all"):
            agg = F.sum if kind == "total" else F.max
            summaries.append(agg(value).alias(total))
            carries.append(agg(total).over(W.partitionBy(*keys)).alias(carry))
            final = F.col(carry)
        elif kind in ("sum", "sum_before"):
            summaries.append(F.sum(value).alias(total))
            carries.append(F.sum(total).over(before).alias(carry))
            local = F.sum(value).over(upto if kind == "sum" else strictly)
            final = F.coalesce(local, F.lit(0)) + F.coalesce(F.col(carry), F.lit(0))
        elif kind in ("max", "max_before", "min"):
            agg, pick = (F.min, F.least) if kind == "min" else (F.max, F.greatest)
            summaries.append(agg(value).alias(total))
            carries.append(agg(total).over(before).alias(carry))
            local = agg(value).over(strictly if kind == "max_before" else upto)
            final = pick(local, F.col(carry))
        elif kind == "first":
            summaries.append(F.min(_ordered(order_cols, value)).getField("v").alias(total))
            carries.append(F.first(total, ignorenulls=True).over(before).alias(carry))
            final = F.coalesce(F.col(carry), F.first(value, ignorenulls=True).over(upto))
        elif kind == "sum_at_last":
            flagged = F.col(f"_cum_{name}")
            summaries += [F.sum(value).alias(total), F.max(_ordered(order_cols, flagged)).getField("v").alias(f"_at_{name}")]
            carries.append(F.coalesce(F.sum(total).over(before), F.lit(0)).alias(carry))
            stacked.append(F.last(F.col(f"_at_{name}") + F.col(carry), ignorenulls=True).over(before).alias(f"_at_{name}"))
            local = F.last(flagged, ignorenulls=True).over(strictly)
            final = F.coalesce(local + F.col(carry), F.col(f"_at_{name}"))
            carries.append(F.col(f"_at_{name}"))
        elif kind in ("last", "last_before", "prev"):
            summaries.append(F.max(_ordered(order_cols, value)).getField("v").alias(total))
            carries.append(F.last(total, ignorenulls=True).over(before).alias(carry))
            if kind == "prev":
                local = F.lag(value).over(inside)
            else:
                local = F.last(value, ignorenulls=True).over(upto if kind == "last" else strictly)
            final = F.coalesce(local, F.col(carry))
        else:
            raise ValueError(f"unknown running kind {kind!r}")
        finals.append(final.alias(name))

    pieces = source.groupBy(*keys, "_chunk").agg(*summaries)
    carried = pieces.select(*keys, "_chunk", *carries)
    if stacked:
        names = {f"_at_{n}" for n, (kind, _) in features.items() if kind == "sum_at_last"}
        carried = carried.select(*[c for c in carried.columns if c not in names], *stacked)
    kept = [c for c in df.columns if c not in features]
    return source.join(carried, [*keys, "_chunk"]).select(*kept, *finals)


def number_rows(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, out: str = "row_no"
) -> DataFrame:
    """1-based ``row_number`` without a whole group in one task."""
    return running(df, keys, order, chunk, **{out: ("row_number", None)}).withColumn(
        out, F.col(out).cast("bigint")
    )


def number_by_size(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, out: str = "row_no"
) -> DataFrame:
    """``number_rows`` that cuts into chunks only the groups that are longer than a chunk of frames.

    Groups of a few rows are sorted whole: chunks of them would be as many as the rows. Those that are
    longer are found in a pass of their own, combined map-side, and are few by their size.
    """
    rows = df.withColumn("_chunk", chunk)
    for key in keys:
        rows = rows.filter(F.col(key).isNotNull())
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    long = stage(sizes.filter(F.col("_n") > FRAMES_PER_CHUNK).select(*keys))
    few = long.count()
    if few:
        long = F.broadcast(long) if few <= SHARED_GROUPS else long
    short = rows.join(long, keys, "left_anti") if few else rows
    # as among chunks: rows without one come first, and are left out once they are counted
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("_chunk").isNotNull(), *order)).cast("bigint").alias(out)
    kept = [c for c in df.columns if c != out]
    short = short.select(*kept, "_chunk", place).filter(F.col("_chunk").isNotNull()).drop("_chunk")
    if not few:
        return short
    return short.unionByName(number_rows(rows.join(long, keys, "left_semi").drop("_chunk"), keys, order, chunk, out))


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``_range``, a chunk of their order of even size whatever the values look like.

    The range partitions are staged, so the number of a row's range is fixed.
    """
    return stage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def number_sorted(df: DataFrame, order: list[str], out: str = "row_no") -> DataFrame:
    """1-based place of each row in the order of all rows."""
    return number_rows(in_ranges(df, order), [], order, F.col("_range"), out).drop("_range")


def prune_to_cap(df: DataFrame, key: str, group: str, cap: int) -> DataFrame:
    """Drop rows that cannot be among the first ``cap`` of their group in the order of a hash key.

    Rows are counted by group and leading digits of the key, combined map-side. The bound of a group
    is the digits at which its count reaches the cap, so what is left of any group is the cap and
    the rows of one more prefix, however many tasks read it. The exact rank follows on what is left.
    """
    prefix = hash_chunk(F.col(key))
    counts = df.groupBy(F.col(group).alias("_group"), prefix.alias("_prefix")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_group").orderBy("_prefix").rowsBetween(W.unboundedPreceding, -1))
    reached = counts.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < cap)
    bounds = stage(reached.groupBy("_group").agg(F.max("_prefix").alias("_bound")))
    few = bounds.count() <= SHARED_GROUPS
    joined = df.join(F.broadcast(bounds) if few else bounds, F.col(group).eqNullSafe(F.col("_group")))
    return joined.filter(prefix <= F.col("_bound")).drop("_group", "_bound")


def hash_rank(
    df: DataFrame, purpose: str, ident: str, keys: list[str] | None = None, seed: int = 42,
    out: str = "hash_rank",
) -> DataFrame:
    """1-based rank in stable-key order, per ``keys`` or over the whole dataset."""
    keyed = df.withColumn("_key", stable_key(purpose, F.col(ident), seed))
    return number_rows(keyed, keys or [], ["_key", ident], hash_chunk(F.col("_key")), out).drop("_key")


def join_pieces(
    df: DataFrame, keys: list[str], position: str, text: str, per_part: int = 10_000
) -> DataFrame:
    """Concatenate the texts of a group in order, in parts of at most ``per_part`` pieces.

    ``position`` is 0-based and dense. A group within the limit gives one row, part 0; a longer
    one gives further parts whose concatenation is the whole text.
    """
    parted = df.withColumn("part", quotient(F.col(position), per_part).cast("int"))
    listed = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(text).alias("t"))))
    return parted.groupBy(*keys, "part").agg(
        F.array_join(F.transform(listed, lambda x: x["t"]), "").alias(text)
    )
