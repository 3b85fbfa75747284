"""Token examples of fixed shape, packing, padding, shards and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wirecorpus.functions.octets import once, quotient
from wirecorpus.functions.ordering import hash_chunk, in_ranges, running, stable_key
from wirecorpus.operators.catalog import IGNORE_ID

MAX_SOURCE, MAX_TARGET = 1024, 32
PACK_SIZE, STRICT_PACK_SIZE = 2048, 4096


def _padded(ids: Column, size: Column | int, fill: int) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    return F.concat(ids, F.array_repeat(F.lit(fill), F.greatest(size - F.size(ids), F.lit(0)).cast("int")))


def _ignore(ids: Column, pad_id: int) -> Column:
    return F.transform(ids, lambda t: F.when(t == pad_id, F.lit(IGNORE_ID)).otherwise(t))


def supervised_examples(
    df: DataFrame, eos_id: int, pad_id: int, source: str = "source_ids", target: str = "target_ids",
    max_source: int = MAX_SOURCE, max_target: int = MAX_TARGET, ignore_pad: bool = True,
) -> DataFrame:
    """Source, target and end, padded to a fixed length; no loss over source and padding."""
    length = max_source + max_target + 1
    a, b = F.slice(source, 1, max_source), F.slice(target, 1, max_target)
    tail = F.concat(b, F.array(F.lit(eos_id)))
    labels = _padded(F.concat(F.array_repeat(F.lit(pad_id), F.size(a)), tail), length, pad_id)
    return df.withColumns({
        "input_ids": _padded(F.concat(a, tail), length, pad_id),
        "labels": _ignore(labels, pad_id) if ignore_pad else labels,
    })


def evaluation_examples(
    df: DataFrame, pad_id: int, source: str = "source_ids", target: str = "target_ids",
    max_source: int = MAX_SOURCE, max_target: int = MAX_TARGET, ignore_pad: bool = True,
) -> DataFrame:
    labels = F.slice(target, 1, max_target)
    return df.withColumns({
        "input_ids": F.slice(source, 1, max_source),
        "labels": _ignore(labels, pad_id) if ignore_pad else labels,
    })


def masked_examples(
    df: DataFrame, eos_id: int, max_words: int, prompt: str = "prompt_ids", example: str = "example_ids"
) -> DataFrame:
    """Fixed-length example; no loss over prompt and padding, zeros in ids and mask over padding."""
    cut = F.slice(F.concat(F.slice(example, 1, max_words), F.array(F.lit(eos_id))), 1, max_words)
    # what is asked for each of the words is made once per row, never inside the function of a word
    rows = once(df, _whole=cut, _n_prompt=F.size(prompt))
    rows = once(rows, _n=F.size("_whole"))
    real = F.sequence(F.lit(0), F.lit(max_words - 1))
    return rows.withColumns({
        "input_ids": _padded(F.col("_whole"), max_words, 0),
        "labels": F.transform(_padded(F.col("_whole"), max_words, IGNORE_ID), lambda t, i: F.when(
            (i < F.col("_n_prompt")), F.lit(IGNORE_ID)).otherwise(t)),
        "attention_mask": F.transform(real, lambda i: F.when(i < F.col("_n"), 1.0).otherwise(0.0).cast("float")),
    }).drop("_whole", "_n_prompt", "_n")


def pack_tokens(
    df: DataFrame, order: str, ids: str = "ids", size: int = PACK_SIZE, strict: bool = False,
    keep_tail: bool = False,
) -> DataFrame:
    """Concatenate token arrays in order and cut them into full pieces of ``size`` tokens.

    Offsets are running sums, so a piece is cut out of the rows that overlap it without a global
    window over all rows. ``strict`` emits a piece only when more tokens follow it. ``order`` need
    not be dense: rows are dealt into ranges of even size.
    """
    counted = df.filter(F.size(ids) > 0).withColumn("_n", F.size(ids).cast("bigint"))
    rows = running(
        in_ranges(counted, [order]), [], [order], F.col("_range"),
        _start=("sum_before", F.col("_n")), _total=("total", F.col("_n")),
    )
    first = quotient(F.col("_start"), size)
    last = quotient(F.col("_start") + F.col("_n") - 1, size)
    cut = rows.select("*", F.explode(F.sequence(first, last)).alias("piece"))
    begin = F.greatest(F.col("piece") * size - F.col("_start"), F.lit(0))
    end = F.least((F.col("piece") + 1) * size - F.col("_start"), F.col("_n"))
    part = F.slice(ids, (begin + 1).cast("int"), (end - begin).cast("int"))
    # each part has at least one token, so a group has at most ``size`` parts
    listed = F.array_sort(F.collect_list(F.struct(F.col("_start").alias("s"), F.col("_part").alias("p"))))
    packed = cut.withColumn("_part", part).groupBy("piece").agg(
        F.flatten(F.transform(listed, lambda x: x["p"])).alias("input_ids"),
        F.max("_total").alias("_total"),
    )
    end_of_piece = (F.col("piece") + 1) * size
    if not keep_tail:
        whole = F.col("_total") > end_of_piece if strict else F.col("_total") >= end_of_piece
        packed = packed.filter(whole)
    return packed.select(
        "piece", "input_ids", F.array_repeat(F.lit(1), F.size("input_ids")).alias("attention_mask"),
        F.col("input_ids").alias("labels"),
    )


def pad_batches(
    df: DataFrame, pad_id: int, ids: str = "output_ids", batch: str = "batch", multiple: int | None = None
) -> DataFrame:
    """Right-pad to the longest of the batch, rounded up to a multiple."""
    longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("_longest"))
    step = multiple or 1
    size = quotient(F.col("_longest") + step - 1, step) * step
    return df.join(longest, batch).withColumn(ids, _padded(F.col(ids), size, pad_id)).drop("_longest")


def left_pad(
    df: DataFrame, pad_id: int, max_length: int, ids: str = "input_ids", multiple: int | None = None
) -> DataFrame:
    """Left-pad ids, attention mask and position ids; a longer row stays as it is."""
    if multiple and max_length % multiple:
        max_length = (max_length // multiple + 1) * multiple
    n = F.size(ids)
    missing = F.greatest(F.lit(max_length) - n, F.lit(0))
    zeros = F.array_repeat(F.lit(0), missing)
    positions = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return df.withColumns({
        ids: F.concat(F.array_repeat(F.lit(pad_id), missing), F.col(ids)),
        "attention_mask": F.concat(zeros, F.array_repeat(F.lit(1), n)),
        "position_ids": F.concat(zeros, positions),
    })


def assign_batches(
    df: DataFrame, ident: str, shards: int, batch_size: int, seed: int = 42, pad: bool = False
) -> DataFrame:
    """Shuffle, deal every ``shards``-th row to a shard, and cut shards into full batches.

    ``pad`` repeats the first rows so that all shards have the same number of rows.
    """
    keyed = df.withColumn("_key", stable_key("batches", F.col(ident), seed))
    ranked = running(
        keyed, [], ["_key", ident], hash_chunk(F.col("_key")),
        _rank=("row_number", None), _size=("size", None),
    ).drop("_key").withColumn("_rank", F.col("_rank") - 1)
    if pad:
        missing = F.pmod(-F.col("_size"), F.lit(shards))
        # a dataset smaller than the shard count is repeated more than once
        copies = F.sequence(F.lit(0), quotient(missing - 1 - F.col("_rank"), F.col("_size")))
        again = ranked.filter(F.col("_rank") < missing).select("*", F.explode(copies).alias("_copy"))
        again = again.withColumn("_rank", F.col("_size") * (F.col("_copy") + 1) + F.col("_rank")).drop("_copy")
        ranked = ranked.unionByName(again).withColumn("_size", F.col("_size") + missing)
    shard = F.pmod(F.col("_rank"), F.lit(shards))
    in_shard = quotient(F.col("_size") - shard + shards - 1, shards)
    batch = quotient(quotient(F.col("_rank"), shards), batch_size)
    return ranked.withColumns({"shard": shard, "batch": batch}).filter(
        F.col("batch") < quotient(in_shard, batch_size)
    ).drop("_rank", "_size")
