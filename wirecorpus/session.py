"""Session settings the jobs rely on."""

from __future__ import annotations

import os
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import wirecorpus

# workers get the few Python functions by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(wirecorpus)

# Runtime SQL settings. None of them fixes a partition count: that belongs to the cluster.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # per-class caps go up to 20,000 rows; the default of 1000 would leave them unpruned
    "spark.sql.optimizer.windowGroupLimitThreshold": "20200",
    "spark.sql.python.filterPushdown.enabled": "true",
    # rows are narrow when they are shuffled and grow afterwards (frames, texts, words), so small
    # shuffle partitions are worth keeping apart; large ones are not affected
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_base(spark: SparkSession) -> str:
    """Shared folder for cut lineage: the cluster's own, or one in the warehouse where none is named."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoint-{context.applicationId}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base


# tables staged by this process and not dropped yet
_STAGED: list[str] = []


def drop_paths(spark: SparkSession, paths: list[str]) -> int:
    """Delete staged tables that nothing reads any more."""
    conf = spark._jsc.hadoopConfiguration()
    dropped = 0
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        dropped += path.getFileSystem(conf).delete(path, True)
        if name in _STAGED:
            _STAGED.remove(name)
    return dropped


def drop_staged(spark: SparkSession) -> int:
    """Delete the tables staged so far; call it when the results that read them are written."""
    return drop_paths(spark, list(_STAGED))


def stage(df: DataFrame) -> DataFrame:
    """Write a table that several later steps read, and read it back.

    The steps then scan only the columns they need, nothing is recomputed, and a lost executor
    costs no more than its own tasks.
    """
    return stage_at(df)[0]


def staged_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, dropped with the staged tables."""
    path = f"{checkpoint_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def stage_at(df: DataFrame) -> tuple[DataFrame, str]:
    """A staged table and its path, for ``drop_paths``."""
    spark = df.sparkSession
    path = staged_path(spark, "staged")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan of fewer splits than task slots, for work that is heavy per row.

    A large table has more splits than slots and stays as it is.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)


def local_session(name: str = "wirecorpus", cpus: str | None = None) -> SparkSession:
    """A local session for tests and the bench."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("WIRECORPUS_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
