"""Classification metrics, reports, grouped generation, training-log summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wirecorpus.functions.octets import quotient
from wirecorpus.functions.ordering import in_ranges, running
from wirecorpus.functions.strings import drop_last_char, last_word
from wirecorpus.operators.catalog import FULL_STOP

AVERAGES = ("micro", "macro", "weighted")


# --- responses to labels -----------------------------------------------------------------------

def response_labels(
    df: DataFrame, variant: str = "main", response: str = "response", target: str = "target"
) -> DataFrame:
    """Add ``response_label`` and ``target_label``.

    ``main``: a full stop both texts contain is dropped; a response without blanks is taken
    whole, else both give their last word minus its last character. ``legacy`` always takes the
    last word minus its last character, ``r1`` the last word uncut, ``exact`` the whole text.
    """
    r, t = F.col(response), F.col(target)
    if variant in ("main", "r1"):
        both = r.contains(FULL_STOP) & t.contains(FULL_STOP)
        r, t = F.when(both, drop_last_char(r)).otherwise(r), F.when(both, drop_last_char(t)).otherwise(t)
        cut = drop_last_char if variant == "main" else (lambda c: c)
        sentence = r.contains(" ")
        pick = lambda c: F.when(sentence, cut(last_word(c))).otherwise(c)
    elif variant == "legacy":
        pick = lambda c: drop_last_char(last_word(c))
    elif variant == "exact":
        pick = lambda c: c
    else:
        raise ValueError(f"unknown variant {variant!r}")
    return df.withColumns({"response_label": pick(r), "target_label": pick(t)})


def encode_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``predicted_id`` and ``true_id``; an unknown response gets the number of labels.

    Rows with an unknown target keep a null ``true_id``: see ``target_rejects``.
    """
    ids = lambda label, out: labels.select(F.col("label").alias(label), F.col("id").alias(out))
    joined = df.join(ids("target_label", "true_id"), "target_label", "left").join(
        ids("response_label", "predicted_id"), "response_label", "left"
    )
    n_labels = labels.agg(F.count(F.lit(1)).cast("int").alias("n")).scalar()
    return joined.withColumn("predicted_id", F.coalesce(F.col("predicted_id"), n_labels))


def scorable(df: DataFrame) -> DataFrame:
    return df.filter(F.col("true_id").isNotNull())


def target_rejects(df: DataFrame, ident: str) -> DataFrame:
    return df.filter(F.col("true_id").isNull()).select(ident, F.lit("unknown target label").alias("reason"))


def mistakes(df: DataFrame, labels: DataFrame, ident: str) -> DataFrame:
    """Responses outside the label set, with their row."""
    known = labels.select(F.col("label").alias("response_label"))
    return df.join(known, "response_label", "left_anti").select(ident, "response_label")


def repair_unknown(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Replace an unknown prediction by the smallest seen class that is not the true one.

    The row stays wrong without adding a class; with a single seen class there is none: null.
    """
    n_labels = labels.agg(F.count(F.lit(1)).cast("int").alias("n")).scalar()
    least = df.agg(F.min("true_id")).scalar()
    second = df.filter(F.col("true_id") > least).agg(F.min("true_id")).scalar()
    other = F.when(F.col("true_id") != least, least).otherwise(second)
    return df.withColumn(
        "predicted_id", F.when(F.col("predicted_id") == n_labels, other).otherwise(F.col("predicted_id"))
    )


# --- per-class counts and averages -------------------------------------------------------------

def _weight(weight: str | None) -> Column:
    return F.col(weight).cast("double") if weight else F.lit(1.0)


def accuracy(
    df: DataFrame, true: str = "true_id", predicted: str = "predicted_id", weight: str | None = None,
    normalize: bool = True,
) -> DataFrame:
    w = _weight(weight)
    hits = F.sum(F.when(F.col(true) == F.col(predicted), w).otherwise(0.0))
    return df.agg((F.try_divide(hits, F.sum(w)) if normalize else hits).alias("accuracy"))


def class_counts(
    df: DataFrame, true: str = "true_id", predicted: str = "predicted_id", weight: str | None = None
) -> DataFrame:
    """(cls, tp, predicted, support) over the union of true and predicted classes.

    Rows collapse to one per (true, predicted) pair before anything else.
    """
    pairs = df.groupBy(F.col(true).alias("t"), F.col(predicted).alias("p")).agg(
        F.sum(_weight(weight)).alias("w")
    )
    sides = F.array(
        F.struct(F.col("t").alias("cls"), F.when(F.col("t") == F.col("p"), F.col("w")).otherwise(0.0).alias("tp"),
                 F.lit(0.0).alias("predicted"), F.col("w").alias("support")),
        F.struct(F.col("p").alias("cls"), F.lit(0.0).alias("tp"),
                 F.col("w").alias("predicted"), F.lit(0.0).alias("support")),
    )
    return pairs.select(F.inline(sides)).groupBy("cls").agg(
        F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("support").alias("support")
    )


def _ratio(top: Column, bottom: Column, zero: float) -> Column:
    return F.when(bottom == 0, F.lit(float(zero))).otherwise(F.try_divide(top, bottom))


def per_class(counts: DataFrame, zero_division: float = 0, keep: list[str] | None = None) -> DataFrame:
    tp = F.col("tp")
    return counts.select(
        "cls", *(keep or []), _ratio(tp, F.col("predicted"), zero_division).alias("precision"),
        _ratio(tp, F.col("support"), zero_division).alias("recall"),
        _ratio(2 * tp, F.col("predicted") + F.col("support"), zero_division).alias("f1"), "support",
    )


def precision_recall_f1(
    counts: DataFrame, average: str | None = "weighted", pos_label=1, labels: list | None = None,
    zero_division: float = 0,
) -> DataFrame:
    """Precision, recall and F1 as ``binary`` (of ``pos_label``), ``micro``, ``macro``, ``weighted``,
    or per class with ``average=None``. ``labels`` restricts and completes the classes."""
    if labels is not None:
        wanted = counts.sparkSession.createDataFrame([(c,) for c in labels], counts.select("cls").schema)
        counts = wanted.join(counts, "cls", "left").na.fill(0.0)
    if average is None:
        return per_class(counts, zero_division)
    if average == "binary":
        one = counts.filter(F.col("cls") == pos_label)
        sums = one.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("tp", "predicted", "support")])
        return per_class(sums.withColumn("cls", F.lit(pos_label)), zero_division).drop("cls", "support")
    if average == "micro":
        sums = counts.agg(*[F.sum(c).alias(c) for c in ("tp", "predicted", "support")])
        return per_class(sums.withColumn("cls", F.lit(0)), zero_division).drop("cls", "support")
    if average not in AVERAGES:
        raise ValueError(f"unknown average {average!r}")
    rows = per_class(counts, zero_division)
    if average == "macro":
        return rows.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    total = F.sum("support")
    return rows.agg(*[
        _ratio(F.sum(F.col(c) * F.col("support")), total, zero_division).alias(c)
        for c in ("precision", "recall", "f1")
    ])


def multilabel_metrics(
    df: DataFrame, true: str = "true_labels", predicted: str = "predicted_labels", zero_division: float = 0
) -> DataFrame:
    """Averages over rows of set precision, recall and F1, and the share of rows that match whole."""
    t, p = F.array_distinct(true), F.array_distinct(predicted)
    rows = df.select(
        F.size(F.array_intersect(t, p)).alias("tp"), F.size(p).alias("predicted"), F.size(t).alias("support"),
        (F.array_sort(t) == F.array_sort(p)).cast("double").alias("same"),
    )
    both = rows.select(
        _ratio(F.col("tp"), F.col("predicted"), zero_division).alias("precision"),
        _ratio(F.col("tp"), F.col("support"), zero_division).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support"), zero_division).alias("f1"), "same",
    )
    return both.agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
        F.avg("same").alias("subset_accuracy"),
    )


def classification_report(counts: DataFrame, digits: int = 2) -> DataFrame:
    """Rows per class, then accuracy, macro and weighted averages, from one pass over the counts.

    Every class contributes to its own row and to the three summary rows.
    """
    scores = ("precision", "recall", "f1")
    rows = per_class(counts.withColumn("_tp", F.col("tp")), keep=["_tp"])
    names = F.array(F.col("cls").cast("string"), F.lit("accuracy"), F.lit("macro avg"), F.lit("weighted avg"))
    spread = rows.select("*", F.posexplode(names).alias("_part", "name"))
    support = F.sum("support")
    sums = spread.groupBy("_part", "name").agg(
        F.try_divide(F.sum("_tp"), support).alias("accuracy"), support.alias("support"),
        *[F.avg(c).alias(f"{c}_mean") for c in scores],
        *[F.try_divide(F.sum(F.col(c) * F.col("support")), support).alias(f"{c}_weighted") for c in scores],
    )
    part = F.col("_part")

    def shown(c: str) -> Column:
        accuracy = F.col("accuracy") if c == "f1" else F.lit(None).cast("double")
        value = F.when(part == 1, accuracy).when(part == 3, F.col(f"{c}_weighted")).otherwise(F.col(f"{c}_mean"))
        return F.round(value, digits).alias(c)

    return sums.select("name", *[shown(c) for c in scores], "support")


def confusion_matrix(
    df: DataFrame, true: str = "true_id", predicted: str = "predicted_id"
) -> DataFrame:
    """(true, predicted, n) for every pair of seen classes, zeros included.

    The matrix is as large as the class list squared. Its rows are dealt out by true class before
    the other side is put next to each, so no task makes the whole of it.
    """
    pairs = df.groupBy(F.col(true).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    classes = pairs.select(F.explode(F.array("t", "p")).alias("c")).distinct()
    listed = classes.agg(F.sort_array(F.collect_list("c")).alias("c")).scalar()
    grid = classes.select(F.col("c").alias("t"), F.explode(listed).alias("p"))
    return grid.join(pairs, ["t", "p"], "left").select(
        F.col("t").alias("true_id"), F.col("p").alias("predicted_id"), F.coalesce("n", F.lit(0)).alias("n")
    )


# --- generated texts by label ------------------------------------------------------------------

def prompt_label(prompt: Column, pattern: str | None = None) -> Column:
    """Second-last blank-separated word, or the first group of a pattern for labels with blanks."""
    if pattern:
        return F.regexp_extract(prompt, pattern, 1)
    return F.try_element_at(F.split(prompt, " "), F.lit(-2))


def generated_by_label(
    df: DataFrame, ident: str, prompt: str = "prompt", response: str = "response",
    pattern: str | None = None,
) -> DataFrame:
    """(label, position, text): each label's list as rows with their 0-based place in it.

    A label may hold a large share of all rows, so the list is not put into one row.
    ``ident`` gives the order; it need not be dense.
    """
    labelled = df.withColumn("label", prompt_label(F.col(prompt), pattern)).filter(F.col("label").isNotNull())
    ranged = in_ranges(labelled.select(ident, "label", response), [ident])
    rows = running(ranged, ["label"], [ident], F.col("_range"), _n=("row_number", None))
    return rows.select("label", (F.col("_n") - 1).cast("bigint").alias("position"), F.col(response).alias("text"))


def generation_lists(generated: DataFrame, per_row: int = 1000) -> DataFrame:
    """(label, part, texts): the lists in order, in parts of at most ``per_row`` texts."""
    parted = generated.withColumn("part", quotient(F.col("position"), per_row))
    texts = F.array_sort(F.collect_list(F.struct("position", "text")))
    return parted.groupBy("label", "part").agg(F.transform(texts, lambda x: x["text"]).alias("texts"))


# --- training logs -----------------------------------------------------------------------------

def epoch_losses(df: DataFrame) -> DataFrame:
    """Mean loss and perplexity per run, epoch and phase; NaN steps count only in the divisor."""
    total = F.sum(F.when(~F.isnan("loss"), F.col("loss")).otherwise(0.0))
    return df.groupBy("run", "epoch", "phase").agg(
        (total / F.count(F.lit(1))).alias("loss"), F.sum("seconds").alias("seconds"),
    ).withColumn("perplexity", F.exp("loss"))


def best_so_far(epochs: DataFrame, phase: str = "eval") -> DataFrame:
    """Running minimum of the validation loss, and whether an epoch is strictly better."""
    # one row per run and epoch
    upto = W.partitionBy("run").orderBy("epoch").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy("run").orderBy("epoch").rowsBetween(W.unboundedPreceding, -1)
    best = F.min("loss").over(before)
    return epochs.filter(F.col("phase") == phase).select(
        "run", "epoch", "loss", F.min("loss").over(upto).alias("best_loss"),
        (best.isNull() | (F.col("loss") < best)).alias("is_checkpoint"),
    )


def run_summary(epochs: DataFrame) -> DataFrame:
    """Averages over the epochs of a run."""
    side = lambda phase, c: F.avg(F.when(F.col("phase") == phase, F.col(c)))
    return epochs.groupBy("run").agg(
        side("train", "loss").alias("train_loss"), side("train", "perplexity").alias("train_perplexity"),
        side("eval", "loss").alias("eval_loss"), side("eval", "perplexity").alias("eval_perplexity"),
        side("train", "seconds").alias("epoch_seconds"), side("eval", "seconds").alias("checkpoint_seconds"),
    )


def epoch_evaluations(predictions: DataFrame, losses: DataFrame, cumulative: bool = True) -> DataFrame:
    """Accuracy per epoch with the mean evaluation loss, which is 0 without samples; a NaN is none.

    ``cumulative`` scores the predictions of all epochs so far, as published.
    """
    hit = F.when(F.col("true_id") == F.col("predicted_id"), 1).otherwise(0)
    scored = predictions.groupBy("epoch").agg(F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("n"))
    if cumulative:
        upto = W.partitionBy().orderBy("epoch").rowsBetween(W.unboundedPreceding, W.currentRow)
        # one row per epoch
        scored = scored.select("epoch", F.sum("hits").over(upto).alias("hits"), F.sum("n").over(upto).alias("n"))
    loss = losses.groupBy("epoch").agg(F.avg(F.when(~F.isnan("loss"), F.col("loss"))).alias("eval_loss"))
    return scored.join(loss, "epoch", "left").select(
        "epoch", "n", (F.col("hits") / F.col("n")).alias("accuracy"),
        F.coalesce("eval_loss", F.lit(0.0)).alias("eval_loss"),
    )


def run_metrics_json(epochs: DataFrame) -> DataFrame:
    """One JSON object per run: epochs, losses and the last epoch. One row per epoch feeds it."""
    wide = epochs.groupBy("run", "epoch").agg(
        F.max(F.when(F.col("phase") == "train", F.col("loss"))).alias("train"),
        F.max(F.when(F.col("phase") == "eval", F.col("loss"))).alias("eval"),
    )
    rows = F.array_sort(F.collect_list(F.struct("epoch", "train", "eval")))
    listed = wide.groupBy("run").agg(rows.alias("r"))
    return listed.select("run", F.to_json(F.struct(
        F.transform("r", lambda x: x["epoch"]).alias("epochs"),
        F.transform("r", lambda x: x["train"]).alias("train_losses"),
        F.transform("r", lambda x: x["eval"]).alias("eval_losses"),
        F.element_at("r", -1)["epoch"].alias("current_epoch"),
    )).alias("metrics"))
