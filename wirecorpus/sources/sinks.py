"""Text and JSON sinks. Every sink writes with all tasks; a file name becomes a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wirecorpus.functions.strings import strip
from wirecorpus.operators.chat import convertible, mask_answers
from wirecorpus.operators.corpus import global_shuffle
from wirecorpus.session import stage

CHAT_PREFIX = "chat_"


def corpus_folder(name: str, task: str, granularity: str) -> str:
    return f"{name}_{task}_{granularity}"


def write_corpus(df: DataFrame, root: str, name: str, task: str, granularity: str, ident: str) -> str:
    """Shuffled samples as JSON lines under ``<name>_<task>_<granularity>/split=<split>/``."""
    path = f"{root}/{corpus_folder(name, task, granularity)}"
    columns = [c for c in ("instruction", "input", "output") if c in df.columns]
    global_shuffle(df, ident).select("split", *columns).write.partitionBy("split").json(path)
    return path


def write_messages(df: DataFrame, root: str, name: str) -> None:
    """Messages of train rows; of test rows the labelled form and its masked twin."""
    chosen = stage(convertible(df).select("split", "messages"))
    write = lambda rows, part: rows.select("messages").write.json(f"{root}/{CHAT_PREFIX}{name}_{part}.jsonl")
    test = chosen.filter("split = 'test'")
    write(chosen.filter("split = 'train'"), "train")
    write(test, "test_with_label")
    write(mask_answers(test), "test")


def write_texts(df: DataFrame, path: str, text: str = "text") -> None:
    """One text per line; line ends inside a text are written as ``\\n``."""
    escaped = F.replace(F.replace(F.replace(F.col(text), F.lit("\\"), F.lit("\\\\")), F.lit("\r"), F.lit("\\r")),
                        F.lit("\n"), F.lit("\\n"))
    df.select(escaped.alias("value")).write.text(path)


def write_predictions(df: DataFrame, path: str, target: str = "target", response: str = "response") -> None:
    """JSON lines ``labels, predict``, both stripped."""
    df.select(strip(F.col(target)).alias("labels"), strip(F.col(response)).alias("predict")).write.json(path)


def write_label_map(label_map: DataFrame, path: str) -> None:
    """The one-row label map as JSON text."""
    label_map.select(F.col("label_map").alias("value")).coalesce(1).write.text(path)


def write_generation_lists(lists: DataFrame, path: str) -> None:
    """(label, part, texts) rows as JSON lines."""
    lists.write.json(path)


def write_pairs(df: DataFrame, path: str) -> None:
    """(input, target) as CSV with a header; blanks at the ends of a text are kept."""
    write_csv(df.select("input", "target"), path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


def write_report(path: str, **tables: DataFrame) -> None:
    """Evaluation tables (mistakes, metrics, matrix, report), one folder each."""
    for name, table in tables.items():
        table.write.json(f"{path}/{name}")


def write_run_metrics(metrics: DataFrame, path: str) -> None:
    """One JSON object per run with its finish time."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    body = F.expr("substring(metrics, 1, length(metrics) - 1)")
    metrics.select("run", F.concat(body, F.lit(',"timestamp":"'), stamp, F.lit('"}')).alias("value")).write.partitionBy(
        "run").text(path)
