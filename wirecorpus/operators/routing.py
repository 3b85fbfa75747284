"""Prompt splitting, task routing, batch scoring, response clean-up, screening, classifier."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import PandasUDFType

from wirecorpus.functions.octets import quotient
from wirecorpus.functions.ordering import stable_key
from wirecorpus.functions.strings import lookup, present, replace_all, strip
from wirecorpus.operators.catalog import (
    CUTOFF_PLACEHOLDER, CUTOFF_TEXT, DATA_MARK, EMPTY_PROMPT_STATUS, PROMPT_VARIANTS,
    REGISTRY_PATHS, REGISTRY_TASKS, SCREEN_MAX_CHARS, SCREEN_WARN_TOKENS, SEVERITIES,
)
from wirecorpus.operators.metrics import class_counts, precision_recall_f1
from wirecorpus.session import stage

Model = Callable[[list[str], dict], list[str]]
# sampling settings a scored row may carry
SETTINGS = ["top_p", "temperature", "max_length"]


def split_prompt(df: DataFrame, prompt: str = "prompt", variant: str = "cli") -> DataFrame:
    """Instruction before the first data marker, and the data behind it with the marker.

    ``cli`` keeps all that follows; ``agent`` keeps only the text up to the next marker.
    """
    parts = F.split(F.col(prompt), DATA_MARK)
    if variant == "cli":
        rest = F.array_join(F.slice(parts, F.lit(2), F.size(parts)), DATA_MARK)
    elif variant == "agent":
        rest = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    else:
        raise ValueError(f"unknown variant {variant!r}")
    return df.withColumns({
        "human_instruction": parts[0], "traffic_data": F.concat(F.lit(DATA_MARK), rest),
    })


# --- registry ----------------------------------------------------------------------------------

def published_registry(spark: SparkSession) -> DataFrame:
    """Registry rows (name, code, paths) of the published tasks."""
    rows = [(name, code, REGISTRY_PATHS[code]) for name, code in REGISTRY_TASKS.items()]
    return spark.createDataFrame(rows, "name STRING, code STRING, paths ARRAY<STRING>")


def models_of(registry: DataFrame) -> DataFrame:
    """One row per model part (code, part, path)."""
    return registry.select("code", F.posexplode("paths").alias("part", "path")).distinct()


def register_tasks(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Add tasks; a name that is already there, or there twice, is an error."""
    named = registry.select("name", F.lit(True).alias("_known")).union(_repeated(new)).groupBy("name").agg(F.first("_known").alias("_known"))
    clash = F.raise_error(F.concat(F.lit("task already registered: "), F.col("name"))).cast("boolean")
    checked = new.join(named, "name", "left").filter(F.when(F.col("_known"), clash).otherwise(True))
    return registry.unionByName(checked.drop("_known"))


def _repeated(df: DataFrame) -> DataFrame:
    """(name, true) of the names that come more than once."""
    return df.groupBy("name").count().filter("count > 1").select("name", F.lit(True))


def update_tasks(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace the entries of known tasks; a name that is not there, or changed twice, is an error."""
    known = registry.select("name", F.lit(True).alias("_known")).distinct()
    twice = _repeated(changes).toDF("name", "_twice")
    wrong = F.raise_error(F.concat(
        F.when(F.col("_twice"), "task changed twice: ").otherwise("task not registered: "), F.col("name"))).cast("boolean")
    checked = changes.join(known, "name", "left").join(twice, "name", "left").filter(
        F.when(F.col("_known") & F.col("_twice").isNull(), True).otherwise(wrong))
    return registry.join(changes.select("name"), "name", "left_anti").unionByName(checked.drop("_known", "_twice"))


def route(df: DataFrame, registry: DataFrame, answer: str = "task_response") -> DataFrame:
    """Add ``code`` and ``paths`` of the answered task; unknown answers keep nulls."""
    tasks = registry.select(F.col("name").alias(answer), "code", "paths")
    return df.join(tasks, answer, "left")


def routed(df: DataFrame) -> DataFrame:
    return df.filter(F.col("code").isNotNull())


def route_rejects(df: DataFrame, ident: str) -> DataFrame:
    """Requests whose answer names no task; keeps id and reason only."""
    return df.filter(F.col("code").isNull()).select(ident, F.lit("unknown task").alias("reason"))


def task_prompts(df: DataFrame, data: str = "traffic_data", variant: str = "cli", out: str = "task_prompt") -> DataFrame:
    """Second-stage prompt of a code; codes without a template give null.

    The ``cli`` variant strips the data marker for the attack task.
    """
    template = lookup(PROMPT_VARIANTS[variant], F.col("code"))
    text = F.col(data)
    if variant == "cli":
        bare = F.try_element_at(F.split(text, f"{DATA_MARK}:"), F.lit(2))
        text = F.when(F.col("code") == "AAD", F.coalesce(bare, text)).otherwise(text)
    return df.withColumn(out, F.concat(template, text))


# --- scoring -----------------------------------------------------------------------------------

def score(
    df: DataFrame, load_model: Callable[[str | None], Model], prompt: str = "prompt",
    out: str = "response", path: str | None = None, batch_size: int = 256,
) -> DataFrame:
    """Add a model's answer to every prompt.

    ``load_model`` gets the value of the ``path`` column. A worker process loads a model once and
    keeps it for later tasks of the same call. Only prompt, path and settings go to the workers.
    Settings columns that the rows carry (top_p, temperature, max_length) reach the model; rows
    with the same path and settings are answered in batches. Null prompts give null.
    """
    settings = [c for c in SETTINGS if c in df.columns]
    columns = [prompt, *settings, *([path] if path else [])]
    call = uuid.uuid4().hex

    def answer(batches):
        # functions reach a worker with fresh globals, so what outlives a task is kept in a module
        store = sys.modules.setdefault("_wirecorpus_models", types.ModuleType("_wirecorpus_models")).__dict__
        loaded = store.setdefault(call, {})
        for batch in batches:
            batch = batch if isinstance(batch, tuple) else (batch,)
            frame = pd.concat(batch, axis=1, keys=range(len(batch)))
            answers = pd.Series([None] * len(frame), index=frame.index, dtype=object)
            asked = frame[frame[0].notna()]
            by = list(range(1, len(batch)))
            for key, rows in asked.groupby(by, dropna=False, sort=False) if by else [((), asked)]:
                values = list(key if isinstance(key, tuple) else (key,))
                where = values.pop() if path else None
                where = None if pd.isna(where) else where
                if where not in loaded:
                    loaded[where] = load_model(where)
                for at in range(0, len(rows), batch_size):
                    part = rows.iloc[at:at + batch_size]
                    answers.loc[part.index] = loaded[where](part[0].tolist(), dict(zip(settings, values)))
            yield answers

    ask = F.pandas_udf(answer, "string", PandasUDFType.SCALAR_ITER)
    # a model may be asked once only, whatever the plan does with the column
    return df.withColumn(out, ask.asNondeterministic()(*[F.col(c) for c in columns]))


def dual_stage(
    df: DataFrame, registry: DataFrame, router: Callable[[str | None], Model],
    expert: Callable[[str | None], Model], variant: str = "cli",
) -> DataFrame:
    """Requests (human_instruction, traffic_data) to task_response, final_response and status."""
    empty = ~present(F.col("human_instruction")) | ~present(F.col("traffic_data"))
    asked = df.withColumn("_ask", F.when(~empty, F.col("human_instruction")))
    first = route(score(asked, router, "_ask", "task_response"), registry)
    prompted = task_prompts(first, variant=variant).withColumn("_path", F.col("paths")[0])
    answered = score(prompted, expert, "task_prompt", "final_response", path="_path")
    status = (
        F.when(empty, EMPTY_PROMPT_STATUS).when(F.col("code").isNull(), "unknown task")
        .when(F.col("task_prompt").isNull(), "no prompt for task").otherwise("success")
    )
    return answered.withColumn("status", status).drop("_ask", "_path", "paths", "task_prompt")


def two_part_generation(headers: DataFrame, payloads: DataFrame, ident: str = "sample_id") -> DataFrame:
    """Join separately produced header and payload texts of the same sample.

    Both sides have a row per sample. Payloads are long and compress well, so the size of their files
    tells nothing about them; the hint keeps Spark from sending them to all tasks by it.
    """
    return headers.join(payloads.hint("merge"), ident)


# --- responses ---------------------------------------------------------------------------------

def clean_response(text: Column, reasoning: bool = False) -> Column:
    """Strip and fill the cut-off placeholder; ``reasoning`` keeps what follows the last ``>``."""
    cleaned = replace_all(strip(text), [(CUTOFF_PLACEHOLDER, CUTOFF_TEXT)])
    return F.element_at(F.split(cleaned, ">"), -1) if reasoning else cleaned


def infill(text: Column, produced: Column, mark: str = "<FILL_ME>") -> Column:
    return F.replace(text, F.lit(mark), produced)


# --- screening ---------------------------------------------------------------------------------

def _centred(text: Column, width: int = 10) -> Column:
    left = quotient(F.greatest(F.lit(width) - F.length(text), F.lit(0)), 2).cast("int")
    padded = F.concat(F.repeat(F.lit(" "), left), text)
    return F.rpad(padded, F.greatest(F.lit(width), F.length(padded)), F.lit(" "))


def check(name: str, safe: Column, report: Column) -> Column:
    """A screening check: name, verdict, and the report of an unsafe verdict."""
    return F.struct(
        F.lit(name).alias("name"), safe.alias("safe"), F.when(safe, "").otherwise(report).alias("report")
    )


def severity_check(name: str, severities: dict[str, Column], threshold: int = 0) -> Column:
    """Safe when every category is at most the threshold; the report is a two-line table."""
    safe = F.lit(True)
    for value in severities.values():
        safe = safe & (value <= threshold)
    levels = {str(k): v for k, v in SEVERITIES.items()}
    line = lambda cells: F.concat(F.lit("|"), F.concat_ws("|", *[_centred(c) for c in cells]), F.lit("|\n"))
    report = F.concat(
        line([F.lit(k) for k in severities]),
        line([F.coalesce(lookup(levels, v.cast("string")), F.lit("")) for v in severities.values()]),
    )
    return check(name, safe, report)


def screen(df: DataFrame, checks: list[Column], text: str = "text") -> DataFrame:
    """Add ``checks``, ``is_safe``, ``too_long`` and ``warn_long``; safe means all checks are.

    A text over the character limit is an error for the checks and never counts as safe.
    """
    found = df.withColumn("checks", F.array(*checks))
    too_long = F.length(text) > SCREEN_MAX_CHARS
    return found.withColumns({
        "too_long": too_long,
        "warn_long": F.size(F.split(text, r"\s+")) > SCREEN_WARN_TOKENS,
        "is_safe": F.forall("checks", lambda c: c["safe"]) & ~too_long,
        "report": F.array_join(F.transform(F.filter("checks", lambda c: ~c["safe"]), lambda c: c["report"]), ""),
    })


def gate_prompts(screened: DataFrame) -> DataFrame:
    """Only safe prompts go on to scoring."""
    return screened.filter("is_safe")


def withhold(screened: DataFrame, text: str = "text") -> DataFrame:
    """Unsafe output is replaced by null."""
    return screened.withColumn(text, F.when(F.col("is_safe"), F.col(text)))


# --- classifier --------------------------------------------------------------------------------

def fit_classifier(
    train: DataFrame, text: str = "text", label: str = "label_id", weight: str | None = None,
    features: int = 4096, iterations: int = 20,
):
    """Text to class id: hashed word counts and a multinomial linear model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+")
    counts = HashingTF(inputCol="_words", outputCol="_features", numFeatures=features)
    model = LogisticRegression(
        featuresCol="_features", labelCol=label, predictionCol="predicted_id", maxIter=iterations,
        regParam=0.01, **({"weightCol": weight} if weight else {}),
    )
    return Pipeline(stages=[words, counts, model]).fit(train)


def classify(model, df: DataFrame) -> DataFrame:
    predicted = model.transform(df)
    return predicted.select(*df.columns, F.col("predicted_id").cast("int").alias("predicted_id"))


@dataclass
class LinearText:
    """Class scores of a text: the mean of the rows of its hashed words, and a constant."""

    table: np.ndarray  # (words, classes)
    constant: np.ndarray

    def scores(self, words: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Scores of texts with ``count`` words each, whose word numbers follow one another."""
        owner = np.repeat(np.arange(len(count)), count)
        sums = np.zeros((len(count), len(self.constant)))
        np.add.at(sums, owner, self.table[words])
        return sums / np.maximum(count, 1)[:, None] + self.constant


def hashed_words(text: Column, features: int) -> Column:
    """Numbers below ``features`` of the words of a text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int"))


def _listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _gradient(rows: DataFrame, model: LinearText, summing: int = 8) -> tuple[np.ndarray, float, float]:
    """Summed gradient and loss over the rows, and their weight.

    A task adds up its rows and sends one matrix of the model's size; these are added up by a few
    tasks, so the driver gets a few however many tasks there are.
    """
    classes = len(model.constant)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, weight = np.zeros((len(model.table) + 1, classes)), 0.0, 0.0
        for batch in batches:
            words, count = _listed(batch.column(0))
            label, each = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            scores = model.scores(words, count)
            scores -= scores.max(axis=1, keepdims=True)
            share = np.exp(scores)
            share /= share.sum(axis=1, keepdims=True)
            at = np.arange(len(label))
            loss -= float((each * np.log(np.maximum(share[at, label], 1e-300))).sum())
            share[at, label] -= 1
            share *= each[:, None]
            np.add.at(total, words, np.repeat(share / np.maximum(count, 1)[:, None], count, axis=0))
            total[-1] += share.sum(axis=0)
            weight += float(each.sum())
        yield pa.RecordBatch.from_pylist([{"total": total.tobytes(), "loss": loss, "weight": weight}], schema=parts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, weight = np.zeros((len(model.table) + 1, classes)), 0.0, 0.0
        for batch in batches:
            for r in batch.to_pylist():
                total += np.frombuffer(r["total"]).reshape(total.shape)
                loss, weight = loss + r["loss"], weight + r["weight"]
        yield pa.RecordBatch.from_pylist([{"total": total.tobytes(), "loss": loss, "weight": weight}], schema=parts)

    parts = pa.schema([("total", pa.binary()), ("loss", pa.float64()), ("weight", pa.float64())])
    schema = "total BINARY, loss DOUBLE, weight DOUBLE"
    found = rows.select("_words", "_label", "_weight").mapInArrow(part, schema).repartition(summing).mapInArrow(add, schema).collect()
    total = sum(np.frombuffer(r["total"]).reshape(len(model.table) + 1, classes) for r in found)
    return total, sum(r["loss"] for r in found), sum(r["weight"] for r in found)


def fit_epochs(
    train: DataFrame, ident: str, classes: int, epochs: int, text: str = "text", label: str = "label_id",
    weight: str | None = None, features: int = 4096, batches: int = 4, rate: float = 2.0, seed: int = 42,
) -> Iterator[tuple[int, LinearText, float]]:
    """(epoch, model, mean loss) after each round over all rows, from which training goes on.

    A round takes the rows in ``batches`` parts, dealt by a hash of their id, and makes one step for
    each part. Class ids are 0 to ``classes`` - 1; rows without text or label are passed over.
    """
    part = F.conv(F.substring(stable_key("batch", F.col(ident), seed), 1, 8), 16, 10).cast("bigint") % batches
    each = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = stage(train.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(
        hashed_words(F.col(text), features).alias("_words"), F.col(label).cast("int").alias("_label"),
        each.alias("_weight"), part.cast("int").alias("_part")))
    model = LinearText(np.zeros((features, classes)), np.zeros(classes))
    steps = np.full((features + 1, classes), 1e-8)
    for epoch in range(1, epochs + 1):
        loss = weights = 0.0
        for number in range(batches):
            total, some, seen = _gradient(rows.where(F.col("_part") == number), model)
            if seen:
                gradient = total / seen
                steps += gradient ** 2
                moved = rate * gradient / np.sqrt(steps)
                model = LinearText(model.table - moved[:-1], model.constant - moved[-1])
            loss, weights = loss + some, weights + seen
        yield epoch, model, loss / weights if weights else 0.0


def classify_linear(model: LinearText, df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``predicted_id``; a null text has none."""
    @F.pandas_udf("int")
    def best(words: pd.Series) -> pd.Series:
        some = words[words.notna()]
        count = some.map(len).to_numpy(dtype=np.int64)
        flat = np.concatenate([np.asarray(w, dtype=np.int64) for w in some]) if len(some) else np.zeros(0, np.int64)
        found = pd.Series(model.scores(flat, count).argmax(axis=1), index=some.index)
        return found.reindex(words.index).astype("Int32")

    return df.withColumn("predicted_id", best(hashed_words(F.col(text), len(model.table))))


def epoch_metrics(
    train: DataFrame, test: DataFrame, ident: str, classes: int, epochs: int, label: str = "label_id", **options,
) -> DataFrame:
    """(epoch, loss, precision, recall, f1): loss on the training rows, macro metrics on the test rows."""
    found = []
    for epoch, model, loss in fit_epochs(train, ident, classes, epochs, label=label, **options):
        judged = classify_linear(model, test, options.get("text", "text"))
        scores = precision_recall_f1(class_counts(judged, label, "predicted_id"), average="macro")
        found.append(scores.select(F.lit(epoch).alias("epoch"), F.lit(loss).alias("loss"), "precision", "recall", "f1"))
    return reduce(DataFrame.union, found)
