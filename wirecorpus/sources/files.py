"""Text and JSON sources with fixed schemas."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from wirecorpus.operators.catalog import PACKET_FIELDS
from wirecorpus.sources.json_arrays import read_elements

SAMPLE_SCHEMA = "instruction STRING, output STRING"
LEGACY_SCHEMA = "instruction STRING, input STRING, output STRING"
MESSAGES_SCHEMA = "messages ARRAY<STRUCT<role: STRING, content: STRING>>"
CORRUPT = "_corrupt_record"
LOADABLE = ("json", "jsonl", "csv")


def read_fields_tsv(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """Extracted fields as text, tab-separated and unquoted; names with ``.`` become ``_``.

    Lines are split as they are: a CSV reader would skip a line of empty fields.
    """
    values = F.split("value", "\t", -1)
    names = [f.replace(".", "_") for f in fields or PACKET_FIELDS]
    return spark.read.text(path).select(*[F.get(values, i).alias(n) for i, n in enumerate(names)])


def words_of_fields(df: DataFrame, fields: list[str] | None = None, out: str = "words") -> DataFrame:
    """Words of extracted text fields: first field always, empty ones skipped, payload cut."""
    first, *rest = fields or PACKET_FIELDS
    pieces = [F.concat(F.lit(f"{first}: "), F.coalesce(F.col(first.replace(".", "_")), F.lit("")))]
    for field in rest:
        text = F.col(field.replace(".", "_"))
        if field == "tcp.payload":
            text = F.substring(text, 1, 1000)
        pieces.append(F.when(text != "", F.concat(F.lit(f"{field}: "), text)))
    return df.withColumn(out, F.concat_ws(", ", *pieces))


def read_samples(spark: SparkSession, path: str, broken: str = "fail") -> DataFrame:
    """Instruction samples, one JSON object per line.

    A broken line is an error; with ``broken="keep"`` it is a row of nulls with the line in
    ``_corrupt_record``. ``sample_rejects`` counts and lists them, so nothing is lost unseen.
    """
    if broken not in ("fail", "keep"):
        raise ValueError(f"broken lines fail or are kept, not {broken!r}")
    schema = SAMPLE_SCHEMA + (f", {CORRUPT} STRING" if broken == "keep" else "")
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE" if broken == "keep" else "FAILFAST")
    return reader.option("columnNameOfCorruptRecord", CORRUPT).json(path)


def sample_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(line, n, n_partial) of the broken lines of a sample file; partial ones still had an instruction."""
    broken = read_samples(spark, path, "keep").filter(F.col(CORRUPT).isNotNull())
    return broken.groupBy(F.col(CORRUPT).alias("line")).agg(
        F.count(F.lit(1)).alias("n"), F.count("instruction").alias("n_partial"))


def read_sample_array(spark: SparkSession, path: str, schema: str = LEGACY_SCHEMA) -> DataFrame:
    """Samples of files that are one JSON array each; a large file is read by many tasks."""
    sample = F.from_json("text", schema, {"mode": "FAILFAST"})
    return read_elements(spark, path).select(sample.alias("s")).select("s.*")


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """(label, id) of a JSON object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "MAP<STRING, INT>")).alias("label", "id"))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    if not path.rstrip("/").endswith(".jsonl"):
        raise ValueError(f"messages are read from .jsonl only: {path}")
    return spark.read.schema(MESSAGES_SCHEMA).json(path)


def read_splits(spark: SparkSession, paths: dict[str, str], schema: str = SAMPLE_SCHEMA) -> DataFrame:
    """Named parts (train, validation, test) by the extension of each path, with a ``split`` column."""
    parts = []
    for split, path in paths.items():
        kind = os.path.splitext(path.rstrip("/"))[1].lstrip(".")
        if kind not in LOADABLE:
            raise ValueError(f"cannot load {path}: only json or csv")
        reader = spark.read.schema(schema)
        if kind == "csv":
            part = reader.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
        else:
            part = reader.json(path)
        parts.append(part.withColumn("split", F.lit(split)))
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part)
    return joined


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(input, target) rows of a CSV file with a header."""
    reader = spark.read.schema("input STRING, target STRING").option("header", True)
    return reader.option("escape", '"').option("multiLine", True).csv(path)


def read_dialogs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Ordered turns (file, conv_id, turn, role, text) of JSON lists of dialogs.

    ``conv_id`` is the file and the place of the dialog in it, so dialogs of different files stay
    apart. A large file is read by many tasks.
    """
    turns = F.from_json("text", "ARRAY<STRUCT<role: STRING, content: STRING>>", {"mode": "FAILFAST"})
    dialogs = read_elements(spark, path).select("file", "at", F.posexplode(turns).alias("turn", "m"))
    return dialogs.select(
        "file", F.concat_ws("#", "file", "at").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        "m.role", F.col("m.content").alias("text"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(name, code, paths) of a task registry; a model is one path or a list of paths."""
    text = spark.read.text(path, wholetext=True)
    schema = "model_path STRING, peft_path STRING, peft_set MAP<STRING, STRING>, tasks MAP<STRING, STRING>"
    config = text.select(F.from_json("value", schema).alias("c"))
    tasks = config.select(F.explode("c.tasks").alias("name", "code"), F.col("c.peft_set").alias("models"))
    model = F.try_element_at("models", F.col("code"))
    # a list arrives as its JSON text
    listed = F.from_json(model, "ARRAY<STRING>")
    paths = F.when(model.startswith("["), listed).when(model.isNotNull(), F.array(model))
    return tasks.select("name", "code", paths.alias("paths"))
