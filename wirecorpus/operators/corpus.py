"""Instruction corpora: samples, caps and splits, label maps, text pairs, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wirecorpus.functions.ordering import (
    hash_chunk, hash_rank, number_sorted, prune_to_cap, running, stable_key, stable_pick,
)
from wirecorpus.functions.strings import fill, lookup, present, replace_all
from wirecorpus.operators.catalog import (
    ANALYZE_FAMILIES, CORRECTION_PROMPT, DATASET_TASKS, DEFAULT_TASK, DETECTION_TEMPLATES,
    GENERATION_TEMPLATE, LEGACY_MALWARE_OUTPUT, LEGACY_TEMPLATES, PROMPT_NO_INPUT,
    PROMPT_WITH_INPUT, SENTENCE_OUTPUT, SENTENCE_TASKS, SPACING_REPAIRS, SUMMARY_PROMPT,
    TCP_NINTH_QUESTION_FIXED, UNDERSTANDING,
)

CAP, RATIO = 100, 0.95
LEGACY_CAP, LEGACY_RATIO = 5000, 0.8
CLASSIFIER_CHARS = 512


# --- samples ---------------------------------------------------------------------------------

def _template(table: dict[str, str], task: Column, granularity: str) -> Column:
    filled = {code: text.replace("{g}", granularity) for code, text in table.items()}
    unknown = F.raise_error(F.concat(F.lit("unknown task: "), F.coalesce(task, F.lit("null"))))
    return F.coalesce(lookup(filled, task), unknown.cast("string"))


def dispatch_task(df: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Task code of a dataset name."""
    return df.withColumn("task", F.coalesce(lookup(DATASET_TASKS, F.col(dataset)), F.lit(DEFAULT_TASK)))


def detection_samples(df: DataFrame, granularity: str = "packet", data: str = "data") -> DataFrame:
    """Add instruction and output from ``task``, ``label`` and the data text."""
    lead = _template(DETECTION_TEMPLATES, F.col("task"), granularity)
    sentence = fill(SENTENCE_OUTPUT, label=F.col("label"))
    return df.withColumns({
        "instruction": F.concat(lead, F.lit(f"\n<{granularity}>: "), F.col(data)),
        "output": F.when(F.col("task").isin(*SENTENCE_TASKS), sentence).otherwise(F.col("label")),
    })


def generation_samples(df: DataFrame, granularity: str = "packet", data: str = "data") -> DataFrame:
    template = GENERATION_TEMPLATE.replace("{g}", granularity)
    return df.withColumns({
        "instruction": fill(template, label=F.col("label")), "output": F.col(data),
    })


def understanding_samples(
    df: DataFrame, families: list[str], ident: str, data: str = "data", seed: int = 42,
    fix_pairing: bool = False, fix_brackets: bool = False,
) -> DataFrame:
    """Ask for one field of the chosen families; the pick depends on the row alone."""
    unknown = set(families) - set(UNDERSTANDING)
    if unknown:
        raise ValueError(f"unknown field families: {sorted(unknown)}")
    entries = []
    for family, items in UNDERSTANDING.items():
        if family not in families:
            continue
        for i, (question, call) in enumerate(items):
            if fix_pairing and family == "TCP" and i == 8:
                question = TCP_NINTH_QUESTION_FIXED
            if fix_brackets:
                call = call.strip("<>")
            entries.append((question, call))
    index = stable_pick("field", F.col(ident), F.lit(len(entries)), seed).cast("int") + 1
    question = F.element_at(F.array(*[F.lit(q) for q, _ in entries]), index)
    call = F.element_at(F.array(*[F.lit(c) for _, c in entries]), index)
    analyze = any(f in ANALYZE_FAMILIES for f in families)
    lead = "Please analyze the " if analyze else "What is "
    return df.withColumns({
        "instruction": F.concat(F.lit(lead), question, F.lit(" in the packet: "), F.col(data)),
        "output": F.concat(F.lit("<"), call, F.lit(">")),
    })


def understanding_caps(
    df: DataFrame, ident: str, train_cap: int = 20_000, test_cap: int = 200, seed: int = 42
) -> DataFrame:
    """Keep the first rows of each split in shuffled order; the rest is pruned before the shuffle."""
    keyed = df.withColumn("_key", stable_key("understanding", F.col(ident), seed))
    left = prune_to_cap(keyed, "_key", "split", max(train_cap, test_cap))
    order = W.partitionBy("split").orderBy("_key", ident)
    ranked = left.withColumn("_rank", F.row_number().over(order)).drop("_key")
    return ranked.filter(
        F.col("_rank") <= F.when(F.col("split") == "train", train_cap).otherwise(test_cap)
    ).drop("_rank")


def legacy_samples(df: DataFrame, granularity: str = "packet", data: str = "data") -> DataFrame:
    """Three-column samples: data in ``input``."""
    malware = fill(LEGACY_MALWARE_OUTPUT.replace("{g}", granularity),
                   super=F.col("super_label"), label=F.col("label"))
    short = fill(SENTENCE_OUTPUT, label=F.col("label"))
    return df.withColumns({
        "instruction": _template(LEGACY_TEMPLATES, F.col("task"), granularity),
        "input": F.col(data),
        "output": F.when(F.col("task") == "EMD", malware).otherwise(short),
    })


def legacy_generation_samples(df: DataFrame, granularity: str = "packet", data: str = "data") -> DataFrame:
    return generation_samples(df, granularity, data).withColumn("input", F.lit(""))


def continuation_samples(df: DataFrame, ident: str, text: str = "text", seed: int = 42) -> DataFrame:
    """Cut each text at a drawn index in [0, length); the prefix may be empty, empty texts drop out."""
    cut = stable_pick("cut", F.col(ident), F.length(text), seed).cast("int")
    rows = df.filter(F.length(text) > 0).withColumn("_cut", cut)
    return rows.withColumns({
        "instruction": F.substr(F.col(text), F.lit(1), F.col("_cut")),
        "output": F.substr(F.col(text), F.col("_cut") + 1),
    }).drop("_cut")


# --- caps, splits, labels --------------------------------------------------------------------

def cap_split(
    df: DataFrame, ident: str, label: str = "label", cap: int | None = CAP, ratio: float = RATIO,
    seed: int = 42,
) -> DataFrame:
    """Per class: shuffle, cap, and add ``split`` train/test; rows in neither part drop out.

    The part sizes truncate like floating-point arithmetic does, and both parts truncate.
    """
    if cap is None:
        keyed = df.withColumn("_key", stable_key("split", F.col(ident), seed))
        ranked = running(
            keyed, [label], ["_key", ident], hash_chunk(F.col("_key")),
            _rank=("row_number", None), _size=("size", None),
        ).drop("_key")
    else:
        keyed = df.withColumn("_key", stable_key("split", F.col(ident), seed))
        order = W.partitionBy(label).orderBy("_key", ident)
        # what is left of a class counts min(cap, n)
        ranked = prune_to_cap(keyed, "_key", label, cap).withColumn("_rank", F.row_number().over(order))
        ranked = ranked.filter(F.col("_rank") <= cap).drop("_key")
        ranked = ranked.withColumn("_size", F.count(F.lit(1)).over(W.partitionBy(label)))
    train = (F.col("_size") * F.lit(ratio)).cast("int")
    test = (F.col("_size") * F.lit(1 - ratio)).cast("int")
    split = F.when(F.col("_rank") <= train, "train").when(F.col("_rank") <= train + test, "test")
    return ranked.withColumn("split", split).filter(F.col("split").isNotNull()).drop("_rank", "_size")


def label_index(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, id): sorted distinct labels numbered from 0; one row per class after the distinct."""
    distinct = df.select(label).filter(F.col(label).isNotNull()).distinct()
    numbered = number_sorted(distinct, [label], "_n")
    return numbered.select(F.col(label).alias("label"), (F.col("_n") - 1).cast("int").alias("id"))


def label_map_json(labels: DataFrame) -> DataFrame:
    """One JSON object label -> id. It is one text by its nature; ``label_index`` has it as rows."""
    rows = labels.agg(F.sort_array(F.collect_list(F.struct("label", "id"))).alias("e"))
    return rows.select(F.to_json(F.map_from_entries("e")).alias("label_map"))


def global_shuffle(df: DataFrame, ident: str, seed: int = 42) -> DataFrame:
    """Rows in stable-key order across and inside partitions."""
    keyed = df.withColumn("_key", stable_key("shuffle", F.col(ident), seed))
    return keyed.repartitionByRange("_key", ident).sortWithinPartitions("_key", ident).drop("_key")


def shuffle_positions(df: DataFrame, ident: str, seed: int = 42) -> DataFrame:
    """The same order as explicit 1-based positions."""
    return hash_rank(df, "shuffle", ident, seed=seed, out="position")


def validation_split(df: DataFrame, ident: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Split train rows into train/validation by stable rank; other splits pass through."""
    keyed = df.withColumns({
        "_key": stable_key("validation", F.col(ident), seed), "_train": F.col("split") == "train",
    })
    ranked = running(
        keyed, ["_train"], ["_key", ident], hash_chunk(F.col("_key")),
        _rank=("row_number", None), _size=("size", None),
    )
    cut = F.floor(F.col("_size") * F.lit(share))
    return ranked.withColumn(
        "split", F.when(F.col("_train") & (F.col("_rank") > cut), "validation").otherwise(F.col("split"))
    ).drop("_key", "_train", "_rank", "_size")


def classification_rows(df: DataFrame, labels: DataFrame, max_chars: int = CLASSIFIER_CHARS) -> DataFrame:
    """Last line of the instruction, cut, with the label id; unknown labels give a null id."""
    lines = F.split("instruction", "\n")
    ids = labels.select(F.col("label").alias("output"), F.col("id").alias("label_id"))
    return df.withColumn("text", F.substring(F.element_at(lines, -1), 1, max_chars)).join(ids, "output", "left")


# --- limits and filters ----------------------------------------------------------------------

def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def last_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(F.col(order).desc()).limit(n)


def nonempty(df: DataFrame, prompt: str = "instruction", response: str = "output") -> DataFrame:
    return df.filter(present(F.col(prompt)) & present(F.col(response)))


def take_union(df: DataFrame, other: DataFrame, ident: str, n: int = 10_000, seed: int = 42) -> DataFrame:
    """First ``n`` rows in stable order, together with all rows of another dataset."""
    taken = df.orderBy(stable_key("take", F.col(ident), seed), ident).limit(n)
    return taken.unionByName(other)


# --- text pairs and prompts ------------------------------------------------------------------

def repair_spacing(text: Column) -> Column:
    return replace_all(text, SPACING_REPAIRS)


def explode_corrections(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per (sentence, correction), both repaired; pairs with an empty side drop out."""
    rows = df.select(*(keep or []), "sentence", F.explode("corrections").alias("correction"))
    pairs = rows.select(
        *(keep or []), repair_spacing(F.col("sentence")).alias("input"),
        repair_spacing(F.col("correction")).alias("target"),
    )
    return pairs.filter(present(F.col("input")) & present(F.col("target")))


def summary_prompt(dialog: Column, summary: Column, eos: str = "</s>") -> Column:
    return fill(SUMMARY_PROMPT, dialog=dialog, summary=summary, eos=F.lit(eos))


def correction_prompt(source: Column, target: Column) -> Column:
    return fill(CORRECTION_PROMPT, input=source, target=target)


def task_prompt(instruction: Column, source: Column) -> Column:
    """With-input or no-input prompt, by whether the input is missing or empty."""
    short = fill(PROMPT_NO_INPUT, instruction=instruction)
    long = fill(PROMPT_WITH_INPUT, instruction=instruction, input=F.coalesce(source, F.lit("")))
    return F.when(present(source), long).otherwise(short)


def vocabulary_corpus(df: DataFrame, ident: str) -> DataFrame:
    """Instruction, then output, as one text each."""
    return df.select(ident, F.posexplode(F.array("instruction", "output")).alias("part", "text"))


def http_samples(
    df: DataFrame, template: str, method: str = "GET", words: dict[str, str] | None = None
) -> DataFrame:
    """Prompt of a web request given as JSON with method, URL and body.

    ``words`` gives the word the template asks for where it is not the label itself.
    """
    request = F.to_json(F.struct(
        F.lit(method).alias("method"), F.concat("path", "query").alias("URL"), F.lit("").alias("body"),
    ))
    answer = F.coalesce(lookup(words, F.col("label")), F.col("label")) if words else F.col("label")
    return df.withColumns({"instruction": F.concat(F.lit(template), request), "output": answer})


# --- statistics ------------------------------------------------------------------------------

def class_weights(df: DataFrame, label: str = "label", classes: int | None = 2) -> DataFrame:
    """n / (classes * count); ``classes=None`` uses the number of classes seen."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # one row per class from here on
    everything = W.partitionBy()
    k = F.lit(classes) if classes else F.count(F.lit(1)).over(everything)
    return counts.select(label, "n", (F.sum("n").over(everything) / (k * F.col("n"))).alias("weight"))


def corpus_profile(df: DataFrame, texts: list[str]) -> DataFrame:
    """Row count, and per text column nulls, longest text and most words, in one pass."""
    aggregates = [F.count(F.lit(1)).alias("n_rows")]
    for t in texts:
        aggregates += [
            F.count_if(F.col(t).isNull()).alias(f"{t}_nulls"),
            F.max(F.length(t)).alias(f"{t}_max_chars"),
            F.max(F.regexp_count(F.col(t), F.lit(r"\S+"))).alias(f"{t}_max_words"),
        ]
    return df.agg(*aggregates)


def corpus_statistics(df: DataFrame) -> DataFrame:
    return df.groupBy("task", "dataset", "label", "split").agg(F.count(F.lit(1)).alias("n_samples"))
