"""Published metric examples, overlap scores, screening, scoring."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wirecorpus.plans.keyword_model import KeywordModel
from wirecorpus.operators import metrics, overlap, routing


def counts(spark, true, predicted, weights=None):
    rows = [(t, p, float(w)) for t, p, w in zip(true, predicted, weights or [1.0] * len(true))]
    df = spark.createDataFrame(rows, "true_id INT, predicted_id INT, w DOUBLE")
    return df, metrics.class_counts(df, weight="w")


SIX = ([0, 1, 2, 0, 1, 2], [0, 1, 1, 2, 1, 0])
THREE = ([0, 1, 2, 0, 1, 2], [0, 2, 1, 0, 0, 1])
PRECISION = ([0, 1, 0, 1, 0], [0, 0, 1, 1, 0])
RECALL = ([0, 0, 1, 1, 1], [0, 1, 0, 1, 1])


def test_accuracy_examples(spark):
    df, _ = counts(spark, *SIX, [0.5, 2, 0.7, 0.5, 9, 0.4])
    assert metrics.accuracy(df).first()[0] == 0.5
    assert metrics.accuracy(df, normalize=False).first()[0] == 3.0
    assert metrics.accuracy(df, weight="w").first()[0] == pytest.approx(0.8778625954198473)


def get(spark, data, metric, average, weights=None, **options):
    _, c = counts(spark, *data, weights)
    return metrics.precision_recall_f1(c, average, **options).first()[metric]


@pytest.mark.parametrize("metric,data,weights,options,want", [
    ("precision", PRECISION, None, {}, 0.5), ("precision", PRECISION, None, {"pos_label": 0}, 0.67),
    ("precision", PRECISION, [0.9, 0.5, 3.9, 1.2, 0.3], {}, 0.24),
    ("recall", RECALL, None, {}, 0.67), ("recall", RECALL, None, {"pos_label": 0}, 0.5),
    ("recall", RECALL, [0.9, 0.2, 0.9, 0.3, 0.8], {}, 0.55),
    ("f1", PRECISION, None, {}, 0.5), ("f1", PRECISION, None, {"pos_label": 0}, 0.67),
    ("f1", PRECISION, [0.9, 0.5, 3.9, 1.2, 0.3], {}, 0.35),
])
def test_binary_examples(spark, metric, data, weights, options, want):
    assert round(get(spark, data, metric, "binary", weights, **options), 2) == want


@pytest.mark.parametrize("metric,average,want", [
    ("precision", "macro", 0.22), ("precision", "micro", 0.33), ("precision", "weighted", 0.22),
    ("recall", "macro", 0.33), ("recall", "micro", 0.33), ("recall", "weighted", 0.33),
    ("f1", "macro", 0.27), ("f1", "micro", 0.33), ("f1", "weighted", 0.27),
])
def test_average_examples(spark, metric, average, want):
    assert round(get(spark, THREE, metric, average), 2) == want


def test_per_class_examples(spark):
    _, c = counts(spark, *THREE)
    rows = metrics.precision_recall_f1(c, None).orderBy("cls").collect()
    assert [round(r.precision, 2) for r in rows] == [0.67, 0, 0]
    assert [r.recall for r in rows] == [1, 0, 0]
    assert [round(r.f1, 2) for r in rows] == [0.8, 0, 0]


def test_single_class_repair_gives_null(spark):
    labels = spark.createDataFrame([("a", 0)], "label STRING, id INT")
    rows = spark.createDataFrame([("zzz", "a"), ("a", "a")], "response_label STRING, target_label STRING")
    fixed = metrics.repair_unknown(metrics.encode_labels(rows, labels), labels).collect()
    assert sorted((r.response_label, r.predicted_id) for r in fixed) == [("a", 0), ("zzz", None)]


def test_matrix_has_all_pairs(spark):
    df = spark.range(30).select(F.col("id").cast("int").alias("true_id"), F.col("id").cast("int").alias("predicted_id"))
    rows = metrics.confusion_matrix(df).collect()
    assert len(rows) == 900 and {(r.true_id, r.predicted_id) for r in rows if r.n == 1} == {(i, i) for i in range(30)}


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_rouge_l_equals_the_table(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abcde") for _ in range(n))
    rows = [(i, text(rng.randrange(0, 150)), text(rng.randrange(0, 150))) for i in range(60)]
    got = {r.i: r.lcs for r in overlap.rouge_l(spark.createDataFrame(rows, "i INT, response STRING, target STRING"), "i").collect()}
    assert got == {i: lcs(a.split(), b.split()) for i, a, b in rows}


def bleu_by_hand(hyp, ref):
    logs, empties = 0.0, 0
    for n in range(1, 5):
        a, b = (Counter(tuple(x[i:i + n]) for i in range(len(x) - n + 1)) for x in (hyp, ref))
        hit, total = sum((a & b).values()), max(sum(a.values()), 1)
        if n == 1 and hit == 0:
            return 0.0
        if hit == 0:
            empties += 1
        logs += math.log(hit / total if hit else 1 / (2 ** empties * total))
    brevity = 0.0 if len(hyp) > len(ref) else 1 - len(ref) / len(hyp)
    return round(100 * math.exp(brevity + logs / 4), 4)


def test_bleu_by_hand(spark):
    rows = [(0, "the cat sat", "the cat sat on it"), (1, "abcd", "abcd"), (2, "xyz", "abc"), (3, "ab", "abab"), (4, "", "a"), (5, "abxcd", "abcd")]
    got = {r.i: r.bleu_4 for r in overlap.bleu(spark.createDataFrame(rows, "i INT, response STRING, target STRING"), "i").collect()}
    assert got == {i: pytest.approx(bleu_by_hand(a, b) if a else 0.0, abs=1e-4) for i, a, b in rows}


def test_empty_texts_keep_their_rows(spark):
    rows = spark.createDataFrame([(1, "", ""), (2, None, "a b")], "i INT, response STRING, target STRING")
    assert sorted(map(tuple, overlap.rouge_n(rows, "i").collect())) == [(1, 0.0, 0.0), (2, 0.0, 0.0)]


def test_model_is_loaded_once_per_path_and_task(spark, tmp_path):
    def load(path):
        with open(tmp_path / "loads", "a") as log:
            log.write(f"{path}\n")
        return lambda prompts, settings: [f"{path}:{settings.get('top_p')}:{p}" for p in prompts]

    rows = spark.range(40).select(
        "id", F.when(F.col("id") % 7 != 0, F.col("id").cast("string")).alias("prompt"),
        F.when(F.col("id") % 2 == 0, "m1").otherwise("m2").alias("path"), F.lit(0.5).alias("top_p")).repartition(1)
    got = {r.id: r.response for r in routing.score(rows, load, path="path").collect()}
    assert got == {i: None if i % 7 == 0 else f"{'m1' if i % 2 == 0 else 'm2'}:0.5:{i}" for i in range(40)}
    assert sorted((tmp_path / "loads").read_text().split()) == ["m1", "m2"]


def test_registry_conflicts(spark):
    registry = routing.published_registry(spark)
    again = registry.limit(1)
    with pytest.raises(Exception, match="task already registered"):
        routing.register_tasks(registry, again).collect()
    with pytest.raises(Exception, match="task not registered"):
        routing.update_tasks(registry, again.withColumn("name", F.lit("New"))).collect()
    # the checks do not depend on the columns that are read
    with pytest.raises(Exception, match="already registered"):
        routing.register_tasks(registry, again).select("paths").collect()
    fresh = again.withColumn("name", F.lit("New"))
    with pytest.raises(Exception, match="already registered"):
        routing.register_tasks(registry, fresh.union(fresh)).select("name").collect()
    with pytest.raises(Exception, match="changed twice"):
        routing.update_tasks(registry, again.union(again)).select("name").collect()


def test_dual_stage_reports_empty_prompts(spark):
    rows = spark.createDataFrame([(1, "", "d"), (2, "find malware", ""), (3, "find malware", "<packet>: x")],
                                 "id INT, human_instruction STRING, traffic_data STRING")
    model = lambda path: KeywordModel([("malware", "Malware Traffic Detection")], path or "?")
    got = routing.dual_stage(rows, routing.published_registry(spark), model, model).orderBy("id").collect()
    assert [r.status for r in got] == ["empty prompt", "empty prompt", "success"]
    # the second stage was answered by the model of the task's own path
    assert got[2].final_response == "ustc-tfc-2016-detection-packet/checkpoint-10000/"


def test_payloads_are_not_sent_to_all_tasks(spark):
    # both sides look small by their estimates
    headers = spark.sql("SELECT * FROM VALUES (1L, 'a'), (2L, 'b'), (2L, 'c') AS t(packet_id, header)")
    payloads = spark.sql("SELECT * FROM VALUES (1L, '00'), (2L, '01'), (3L, '02'), (NULL, '03') AS t(packet_id, payload_hex)")
    joined = routing.two_part_generation(headers, payloads, "packet_id")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, joined.collect())) == [(1, "a", "00"), (2, "b", "01"), (2, "c", "01")]


def test_classifier_learns_separable_texts(spark):
    rows = spark.range(200).select(
        "id", (F.col("id") % 2).cast("int").alias("label_id"),
        F.when(F.col("id") % 2 == 0, "alpha beta").otherwise("gamma delta").alias("text"))
    model = routing.fit_classifier(rows, features=64, iterations=10)
    assert routing.classify(model, rows).filter("label_id <> predicted_id").count() == 0


def test_epochs_go_on_from_one_another(spark):
    """Loss falls over the epochs, a step is that of the summed gradient, and partitions do not matter."""
    rows = [(i, f"word{i % 3} other{i % 5} {'x' * (i % 4)}", i % 3) for i in range(200)] + [(900, None, 1), (901, "word1", None)]
    docs = spark.createDataFrame(rows, "id INT, text STRING, label_id INT")
    runs = []
    for many in (1, 6):
        found = list(routing.fit_epochs(docs.repartition(many), "id", 3, 3, features=64, batches=2))
        assert [epoch for epoch, _, _ in found] == [1, 2, 3]
        losses = [loss for _, _, loss in found]
        assert losses == sorted(losses, reverse=True) and losses[-1] < 0.2 * np.log(3)
        runs.append(found[-1][1].table)
    assert np.allclose(runs[0], runs[1])
    table = routing.epoch_metrics(docs, docs.filter("id < 200"), "id", 3, 2, features=64).orderBy("epoch").collect()
    assert [(r.epoch, r.f1) for r in table] == [(1, 1.0), (2, 1.0)]


def test_gradient_is_that_of_plain_sums(spark):
    rng = np.random.default_rng(1)
    model = routing.LinearText(rng.normal(size=(8, 3)), rng.normal(size=3))
    rows = [([1, 2, 2], 0, 1.0), ([], 2, 0.5), ([7], 1, 2.0), ([0, 3, 5, 5], 2, 1.0)]
    docs = spark.createDataFrame(rows, "_words ARRAY<INT>, _label INT, _weight DOUBLE").repartition(3)
    total, loss, weight = routing._gradient(docs, model)
    want, want_loss = np.zeros((9, 3)), 0.0
    for words, label, w in rows:
        scores = model.constant + (sum(model.table[k] for k in words) / len(words) if words else 0)
        share = np.exp(scores) / np.exp(scores).sum()
        want_loss -= w * np.log(share[label])
        error = w * (share - np.eye(3)[label])
        want[8] += error
        for k in words:
            want[k] += error / len(words)
    assert np.allclose(total, want) and np.isclose(loss, want_loss) and weight == 4.5
