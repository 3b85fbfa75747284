"""Token files: Parquet list columns in document order, written and read by Spark.

One row per document: the id, its number of tokens, and the tokens as a list of 32-bit integers.
Tokens are dictionary encoded (a vocabulary is a small dictionary, indexes take as many bits as
the row group needs). Ids and lengths are delta encoded. Row groups and pages have set sizes, and
the files carry page indexes, so a reader of some documents or of the lengths alone reads only
those pages. Files are numbered in the order of the ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from wirecorpus.llm.common import by_slice, kept
from wirecorpus.llm.memo import TOGETHER, TokenMemo

TOKENS = "doc_id long, n_tokens long, ids array<int>"


def writer_options(row_group: int = 32 << 20, page: int = 256 << 10) -> dict[str, str]:
    """Parquet writer settings. The second page format writes delta encoded integers."""
    return {
        "parquet.block.size": str(row_group),
        "parquet.page.size": str(page),
        "parquet.page.row.count.limit": "5000",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": "true",
        "compression": "snappy",
    }


def tokenize(docs: DataFrame, path: str, end_id: int | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) of each document, whole text, in the rows' order. Null text: empty."""
    tail = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def make():
        memo = kept(("tokens", path), lambda: TokenMemo(path))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            coded = [raw + tail for raw in memo.encode(batch.column(1))]
            ends = np.zeros(len(coded) + 1, dtype=np.int64)
            np.cumsum([len(raw) // 4 for raw in coded], out=ends[1:])
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(coded))])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(ends)), lists], ["doc_id", "n_tokens", "ids"]
            )
        return work

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(by_slice(make, "text", TOGETHER), TOKENS)


def write_tokens(
    docs: DataFrame, out: str, path: str, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text",
    **options,
) -> None:
    """Write the tokens of all documents to the folder ``out`` in ascending id order.

    The texts are sorted, not the tokens: they are smaller. Null ids come first; rows of one id are
    ordered by their text. An empty table gives a folder that reads as an empty table.
    """
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ranged = picked.repartitionByRange(*order).sortWithinPartitions(*order)
    tokenize(ranged, path, end_id).write.options(**writer_options(**options)).option("maxRecordsPerFile", "0").parquet(out)


def read_tokens(spark: SparkSession, out: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Documents of the files, only these columns, only the row groups and pages that may match."""
    df = spark.read.schema(TOKENS).parquet(out)
    df = df if where is None else df.where(where)
    return df.select(*columns) if columns else df


def located(spark: SparkSession, out: str) -> DataFrame:
    """Every document with its place in the stream of all ids and the checksum of its own.

    ``file_no`` and ``row_no`` are its place in the files. Places come from the number of tokens per
    file, carried over the list of files, and a running sum inside each file.
    """
    rows = read_tokens(spark, out).select(
        "doc_id", "n_tokens", "ids",
        F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long").alias("file_no"),
        F.col("_metadata.row_index").alias("row_no"),
    )

    def sums(batches):
        for batch in batches:
            lists = batch.column(2)
            raw = memoryview(lists.values.to_numpy(zero_copy_only=True).astype("<i4", copy=False)).cast("B")
            ends = lists.offsets.to_numpy()
            crcs = [zlib.crc32(raw[4 * a: 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(crcs, pa.int64()), batch.column(3), batch.column(4)],
                ["doc_id", "n_tokens", "ids_crc32", "file_no", "row_no"],
            )

    summed = rows.mapInArrow(sums, "doc_id long, n_tokens long, ids_crc32 long, file_no long, row_no long")
    before = W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)
    files = (
        read_tokens(spark, out).select(
            "n_tokens", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long").alias("file_no"))
        .groupBy("file_no").agg(F.sum("n_tokens").alias("total"))
        .select("file_no", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    )
    inside = W.partitionBy("file_no").orderBy("row_no").rowsBetween(W.unboundedPreceding, -1)
    return (
        summed.join(files, "file_no")
        .withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .select("doc_id", "start", "n_tokens", "ids_crc32", "file_no", "row_no")
    )
