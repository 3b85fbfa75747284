"""Overlap of generated and reference texts: ROUGE and BLEU over whole texts.

A score needs one row only, so nothing is shuffled: n-grams of all rows of an Arrow batch are counted
together as numbers, and everything after the counts is column arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

BLEU_ORDER = 4
# octets of both texts that are counted at a time, one row at least
SLICE_OCTETS = 2 << 20


def tokens_of(text: Column, level: str = "word") -> Column:
    """Blank-separated words, or characters."""
    if level == "word":
        return F.filter(F.split(text, r"\s+"), lambda w: w != "")
    if level == "char":
        return F.filter(F.split(text, ""), lambda c: c != "")
    raise ValueError(f"unknown level {level!r}")


def _codes(texts: pa.Array, words: bool) -> tuple[pa.Array | np.ndarray, np.ndarray]:
    """The tokens of all texts, one after the other, and the number of each text's."""
    import pyarrow.compute as pc

    if not words:
        count = pc.utf8_length(texts).to_numpy()
        return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), dtype="<u4").astype(np.int64), count
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    some = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(some)])[split.offsets.to_numpy()]
    return flat.filter(pa.array(some)), np.diff(ends)


def _gram_overlaps(left: pa.Array, right: pa.Array, orders: list[int], words: bool, distinct: bool) -> list[np.ndarray]:
    """(overlap, n-grams of left, n-grams of right) of all rows, for each order."""
    (one, count_one), (two, count_two) = _codes(left, words), _codes(right, words)
    if words:
        both = pa.concat_arrays([one, two]).dictionary_encode()
        base, values = both.indices.to_numpy().astype(np.int64), len(both.dictionary)
    else:
        values, base = np.unique(np.concatenate([one, two]), return_inverse=True)
        values = len(values)
    rows, count = len(left), np.concatenate([count_one, count_two])
    owner = np.repeat(np.arange(2 * rows), count)
    ends = np.repeat(np.cumsum(count), count)
    at, gram, size, out = np.arange(len(base)), base, max(values, 1), []
    for n in range(1, max(orders) + 1):
        if n > 1:
            whole = at + n <= ends[at]
            at = at[whole]
            if size * values * rows >= 1 << 62:  # number the n-grams so far anew
                known, gram = np.unique(gram, return_inverse=True)
                size = max(len(known), 1)
            gram = gram[whole] * values + base[at + n - 1]
            size *= max(values, 1)
        if n in orders:
            side, row = owner[at] >= rows, owner[at] % max(rows, 1)
            sides = [np.unique(row[s] * size + gram[s], return_counts=True) for s in (~side, side)]
            (a, many_a), (b, many_b) = sides
            common, in_a, in_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
            clipped = np.ones(len(common), np.int64) if distinct else np.minimum(many_a[in_a], many_b[in_b])
            totals = [
                np.bincount(keys // size, weights=None if distinct else many, minlength=rows).astype(np.int64)
                for keys, many in sides]
            out += [np.bincount(common // size, weights=clipped, minlength=rows).astype(np.int64), *totals]
    return out


def ngram_counts(
    df: DataFrame, orders: list[int], level: str = "word", distinct: bool = False,
    response: str = "response", target: str = "target",
) -> DataFrame:
    """Add ``overlap_n``, ``response_n`` and ``target_n`` per order ``n``.

    Counts clip at the smaller side; ``distinct`` counts each n-gram once. All rows of a slice are
    counted together.
    """
    if level not in ("word", "char"):
        raise ValueError(f"unknown level {level!r}")
    kept = df.columns
    names = [f"{side}_{n}" for n in sorted(orders) for side in ("overlap", "response", "target")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            texts = [pc.fill_null(batch.column(batch.num_columns - k).cast(pa.large_string()), "") for k in (2, 1)]
            ends = np.cumsum(sum(pc.binary_length(t).to_numpy() for t in texts))
            start = 0
            while start < batch.num_rows:
                room = (ends[start - 1] if start else 0) + SLICE_OCTETS
                stop = max(start + 1, int(np.searchsorted(ends, room, side="right")))
                part = [t.slice(start, stop - start) for t in texts]
                counts = _gram_overlaps(*part, sorted(orders), level == "word", distinct)
                columns = batch.slice(start, stop - start).columns[:-2]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, counts)], [*kept, *names])
                start = stop

    schema = StructType([*df.schema.fields, *(StructField(n, LongType()) for n in names)])
    return df.select("*", F.col(response).alias("_left"), F.col(target).alias("_right")).mapInArrow(count, schema)


def f_score(overlap: Column, response_n: Column, target_n: Column) -> Column:
    """Harmonic mean of precision and recall, x 100, rounded to 4; 0 without overlap."""
    return F.when(overlap == 0, F.lit(0.0)).otherwise(
        F.round(F.try_divide(200.0 * overlap, response_n + target_n), 4)
    )


def rouge_n(df: DataFrame, ident: str, orders: list[int] = [1, 2], level: str = "word",
            distinct: bool = True, **columns: str) -> DataFrame:
    """(ident, rouge_1, rouge_2, ...) per row."""
    counts = ngram_counts(df, orders, level, distinct, **columns)
    score = lambda n: f_score(F.col(f"overlap_{n}"), F.col(f"response_{n}"), F.col(f"target_{n}"))
    return counts.select(ident, *[score(n).alias(f"rouge_{n}") for n in orders])


def _common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, one machine word of columns at a time."""
    places: dict = {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        match = places.get(token, 0)
        taken = row & match
        row = ((row + taken) | (row - taken)) & full
    return len(a) - row.bit_count()


def rouge_l(df: DataFrame, ident: str, level: str = "word", response: str = "response",
            target: str = "target") -> DataFrame:
    """(ident, rouge_l) from the longest common subsequence of the whole texts."""

    @F.pandas_udf("int")
    def common(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in pairs:
            yield pd.Series([_common_subsequence(list(a), list(b)) for a, b in zip(left, right)], dtype="int32")

    tokens = df.select(
        ident, tokens_of(F.coalesce(response, F.lit("")), level).alias("r"),
        tokens_of(F.coalesce(target, F.lit("")), level).alias("t"),
    )
    return tokens.withColumn("lcs", common("r", "t")).select(
        ident, "lcs", f_score(F.col("lcs"), F.size("r"), F.size("t")).alias("rouge_l")
    )


def bleu(df: DataFrame, ident: str, level: str = "char", scaled: bool = True, **columns: str) -> DataFrame:
    """(ident, bleu_4): sentence BLEU with geometric smoothing of empty orders.

    The k-th order without a match counts 1 / (2^k * its n-grams). No match of single tokens
    gives 0. ``scaled`` gives percent rounded to 4.
    """
    wide = ngram_counts(df, list(range(1, BLEU_ORDER + 1)), level, False, **columns)
    empty_before = F.lit(0)
    logs = []
    for n in range(1, BLEU_ORDER + 1):
        overlap = F.col(f"overlap_{n}").cast("double")
        total = F.greatest(F.col(f"response_{n}"), F.lit(1)).cast("double")
        empty_before = empty_before + F.when(overlap == 0, 1).otherwise(0)
        logs.append(F.when(overlap == 0, -F.log(F.pow(F.lit(2.0), empty_before) * total))
                    .otherwise(F.log(F.greatest(overlap, F.lit(1.0)) / total)))
    mean = reduce(lambda a, b: a + b, logs) / BLEU_ORDER
    length, wanted = F.col("response_1"), F.col("target_1")
    brevity = F.when(length > wanted, F.lit(0.0)).otherwise(F.lit(1.0) - F.try_divide(wanted, length))
    value = F.when(F.col("overlap_1") == 0, F.lit(0.0)).otherwise(F.exp(brevity + mean))
    return wide.select(ident, (F.round(value * 100, 4) if scaled else value).alias("bleu_4"))


def mean_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in columns])
