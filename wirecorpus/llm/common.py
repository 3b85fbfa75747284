"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# octets of text that are handled at a time inside one task
SLICE_OCTETS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker process.

    Functions are sent to the workers by value, with fresh module globals each time, so what should
    outlive a task (loaded models, remembered words) is kept under a module of its own.
    """
    name = "_wirecorpus_worker_store"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def kept(key: tuple, make: Callable):
    """What ``make`` returns, made once per worker process."""
    store = worker_store()
    if key not in store:
        store[key] = make()
    return store[key]


def give_back() -> None:
    """Hand memory that is free inside this process back to the machine.

    A worker serves one stage after another, and what the allocators hold from an earlier stage
    would count on top of what the next one needs.
    """
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only some C libraries have it
        pass


def slices(batch: pa.RecordBatch, column: str, octets: int = SLICE_OCTETS) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows, each of about so many octets of text, one row at least."""
    if batch.num_rows == 0:
        return
    texts = batch.column(batch.schema.get_field_index(column))
    lengths = [n or 0 for n in pa.compute.binary_length(texts).to_pylist()]
    start = size = 0
    for at, n in enumerate(lengths):
        if at > start and size + n > octets:
            yield batch.slice(start, at - start)
            start, size = at, 0
        size += n
    yield batch.slice(start)


def runs(texts: list[str], characters: int = SLICE_OCTETS) -> Iterator[list[str]]:
    """The texts in runs of about so many characters, one text at least."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > characters:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def by_slice(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], column: str, octets: int = SLICE_OCTETS):
    """A ``mapInArrow`` function: ``make()`` once per task, its result on each slice.

    Memory is given back before and after, so that a worker starts a stage without what earlier ones left.
    """
    def run(batches):
        import pyarrow.compute  # noqa: F401  the workers may not have loaded it

        give_back()
        work = make()
        for batch in batches:
            for part in slices(batch, column, octets):
                yield work(part)
        del work
        give_back()
    return run


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 when divided by three."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, doc_id: str = "doc_id", text: str = "text"):
    """(texts, labels) of at most so many labelled documents with label 0, and with label 1.

    They are the first by md5 of their id, so the choice does not depend on the partitioning, and
    the two classes are bounded apart. Rows without id, label or text are passed over. Ids are
    chosen before any text moves; a repeated id counts each of its rows up to the bound.
    """
    named = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label"))
    order = [F.md5(F.col("_id").cast("string")), F.col("_id")]
    picked = None
    for value in (0, 1):
        some = named.where(F.col("_label") == value).orderBy(*order).limit(per_class)
        picked = some if picked is None else picked.union(some)
    ids = [(r[0], r[1]) for r in picked.collect()]
    chosen = docs.sparkSession.createDataFrame(ids, "_id long, _label int").distinct()
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    rows = texts.join(F.broadcast(chosen), "_id").orderBy(*order, F.xxhash64("_text")).limit(2 * per_class).collect()
    return [r["_text"] for r in rows], [r["_label"] for r in rows]


def logistic(x, y, steps: int = 100, ridge: float = 1e-3):
    """Weights (with the constant last) of a logistic model fitted by Newton steps."""
    import numpy as np

    design = np.column_stack([x, np.ones(len(y))])
    weights = np.zeros(design.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (p - y) + ridge * weights
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(weights))
        step = np.linalg.solve(hessian, gradient)
        weights -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return weights
