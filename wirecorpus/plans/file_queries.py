"""Sources and sinks: rows of the given tables written to files and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wirecorpus.functions.octets import quotient
from wirecorpus.functions.ordering import number_sorted
from wirecorpus.operators import chat, corpus, metrics, packets
from wirecorpus.plans import fixtures as fx
from wirecorpus.plans.corpus_queries import (
    CORPUS_SQL, CORRECTIONS_SQL, LABELS_SQL, LEGACY_TASK, SENTENCE, _split_sql, label_ids, template_case,
)
from wirecorpus.operators.catalog import LEGACY_TEMPLATES, PACKET_FIELDS
from wirecorpus.plans.metric_queries import ENCODED_SQL, GENERATED_SQL, encoded, six
from wirecorpus.plans.packet_queries import WORDS_SOURCE_SQL, words_sql
from wirecorpus.plans.registry import Registry
from wirecorpus.plans.token_queries import MESSAGES_SQL, MIXED_SQL, flat
from wirecorpus.session import checkpoint_base
from wirecorpus.sources import captures, files, sinks

R = Registry()


def folder(spark, name: str) -> str:
    return f"{checkpoint_base(spark).rstrip('/').removeprefix('file:')}/{name}-{uuid.uuid4().hex}"


@R.add("a1_read_captures", f"WITH {fx.FRAMES_SQL} SELECT capture, label, frame_no, ts_us, 14 + ip_len AS wire_len, frame_hex FROM fx_frames")
def _(spark, sf):
    root = folder(spark, "captures")
    captures.write_captures(fx.frames(spark, sf), root)
    return captures.read_captures(spark, root).select(
        "capture", "label", "frame_no", "ts_us", "wire_len", F.lower(F.hex("frame")).alias("frame_hex"))


@R.add("a2_read_captures_two_levels", f"WITH {fx.FRAMES_SQL} SELECT super_label || '/' || capture AS capture, super_label, label, frame_no, frame_hex FROM fx_frames")
def _(spark, sf):
    root = folder(spark, "captures")
    rows = fx.frames(spark, sf).withColumn("capture", F.concat("super_label", F.lit("/"), "capture"))
    captures.write_captures(rows, root)
    return captures.read_captures(spark, root, levels=2).select(
        "capture", "super_label", "label", "frame_no", F.lower(F.hex("frame")).alias("frame_hex"))


@R.add("a3_read_fields_tsv", f"""WITH {WORDS_SOURCE_SQL}
SELECT {words_sql(PACKET_FIELDS)} AS words
FROM fx_all w LEFT JOIN fx_features f ON w.packet_id = f.packet_id WHERE w.proto IN (6, 17)""")
def _(spark, sf):
    path = folder(spark, "fields")
    texts = packets.packet_fields(fx.frames(spark, sf)).select(F.concat_ws("\t", *packets.field_texts()).alias("value"))
    texts.write.text(path)
    return files.words_of_fields(files.read_fields_tsv(spark, path)).select("words")


@R.add("k1_write_corpus", f"WITH {CORPUS_SQL} SELECT split, instruction, output FROM {_split_sql('fx_corpus', 'packet_id', 100, 0.95)}")
def _(spark, sf):
    rows = corpus.cap_split(fx.corpus(spark, sf), "packet_id")
    path = sinks.write_corpus(rows, folder(spark, "corpus"), "mine", "detection", "packet", "packet_id")
    return files.read_samples(spark, path).select("split", "instruction", "output")


@R.add("k2_write_legacy_corpus", f"""WITH {fx.SAMPLES_SQL}
SELECT split, {template_case(LEGACY_TEMPLATES, 'packet', LEGACY_TASK)} AS instruction, data AS input,
  CASE WHEN super_label = 'malware' THEN 'This might be a ' || super_label
    || ' traffic packet. The category is likely to be recognized as ' || label || '.' ELSE {SENTENCE} END AS output
FROM {_split_sql('fx_samples', 'packet_id', 5000, 0.8)}""")
def _(spark, sf):
    split = corpus.cap_split(fx.samples(spark, sf), "packet_id", cap=corpus.LEGACY_CAP, ratio=corpus.LEGACY_RATIO)
    rows = corpus.legacy_samples(split.withColumn("task", F.expr(LEGACY_TASK)))
    path = sinks.write_corpus(rows, folder(spark, "corpus"), "old", "detection", "packet", "packet_id")
    return spark.read.schema(files.LEGACY_SCHEMA + ", split STRING").json(path)


@R.add("a6_read_label_map", LABELS_SQL)
def _(spark, sf):
    path = folder(spark, "labels")
    sinks.write_label_map(corpus.label_map_json(label_ids(spark, sf)), path)
    return files.read_label_map(spark, path)


def _messages_sql(answer: str, split: str = "test") -> str:
    return f"""WITH {MESSAGES_SQL}, parts AS (
  SELECT packet_id FROM {_split_sql('fx_corpus', 'packet_id', 100, 0.8)} WHERE split = '{split}')
SELECT system, user_text, {answer} AS assistant FROM fx_messages WHERE packet_id IN (SELECT packet_id FROM parts)"""


def _messages(part: str):
    def query(spark, sf):
        rows = corpus.cap_split(fx.corpus(spark, sf), "packet_id", ratio=0.8).withColumn("instruction", F.expr(MIXED_SQL))
        root = folder(spark, "messages")
        sinks.write_messages(chat.to_messages(rows), root, "mine")
        back = files.read_messages(spark, f"{root}/{sinks.CHAT_PREFIX}mine_{part}.jsonl")
        return flat(back.withColumn("packet_id", F.lit(0))).drop("packet_id")
    return query


R.add("k4_write_messages", _messages_sql("assistant"))(_messages("test_with_label"))
R.add("k4_write_messages_train", _messages_sql("assistant", "train"))(_messages("train"))
R.add("k4_write_messages_masked", _messages_sql("'-'"))(_messages("test"))


@R.add("a8_read_splits", f"""WITH {CORPUS_SQL}
SELECT CASE split WHEN 'train' THEN 'train' ELSE 'validation' END AS split, instruction, output FROM {_split_sql('fx_corpus', 'packet_id', 100, 0.8)}""")
def _(spark, sf):
    rows = corpus.cap_split(fx.corpus(spark, sf), "packet_id", ratio=0.8)
    root = folder(spark, "splits")
    columns = ["instruction", "output"]
    rows.filter("split = 'train'").select(columns).write.json(f"{root}/train.json")
    sinks.write_csv(rows.filter("split = 'test'").select(columns), f"{root}/validation.csv")
    return files.read_splits(spark, {"train": f"{root}/train.json", "validation": f"{root}/validation.csv"})


@R.add("k9_write_pairs", f"WITH {CORRECTIONS_SQL} SELECT input, target FROM fx_corrections")
def _(spark, sf):
    path = folder(spark, "pairs")
    sinks.write_pairs(corpus.explode_corrections(fx.pairs(spark, sf)), path)
    return files.read_pairs(spark, path)


@R.add("k5_write_texts", r"SELECT replace(replace(replace(text, '\', '\\'), chr(13), '\r'), chr(10), '\n') AS value FROM documents")
def _(spark, sf):
    path = folder(spark, "texts")
    sinks.write_texts(fx.table(spark, sf, "documents").select("text"), path)
    return spark.read.text(path)


@R.add("k7_write_predictions", f"WITH {fx.PREDICTIONS_SQL} SELECT trim(target) AS labels, trim(response) AS predict FROM fx_predictions")
def _(spark, sf):
    path = folder(spark, "predictions")
    padded = fx.predictions(spark, sf).select(
        F.concat(F.lit(" "), "target", F.lit("\n")).alias("target"), F.concat("response", F.lit(" \t")).alias("response"))
    sinks.write_predictions(padded, path)
    return spark.read.schema("labels STRING, predict STRING").json(path)


REPORT_SQL = f"""WITH {ENCODED_SQL}
SELECT cls::VARCHAR AS name, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM fx_classes
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 4), sum(support) FROM fx_counts
UNION ALL SELECT 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), sum(support) FROM fx_classes
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 4), round(sum(recall * support) / sum(support), 4),
  round(sum(f1 * support) / sum(support), 4), sum(support) FROM fx_classes"""
REPORT_TABLES = {
    "report": ("name STRING, precision DOUBLE, recall DOUBLE, f1 DOUBLE, support DOUBLE", REPORT_SQL),
    "matrix": ("true_id INT, predicted_id INT, n BIGINT", f"""WITH {ENCODED_SQL}, c AS (SELECT true_id AS c FROM fx_scored UNION SELECT predicted_id FROM fx_scored)
SELECT a.c AS true_id, b.c AS predicted_id, (SELECT count(*) FROM fx_scored s WHERE s.true_id = a.c AND s.predicted_id = b.c) AS n FROM c a, c b"""),
    "mistakes": ("sample_id BIGINT, response_label STRING", f"WITH {ENCODED_SQL} SELECT sample_id, response_label FROM fx_encoded WHERE response_label NOT IN (SELECT label FROM fx_labels)"),
    "metrics": ("precision DOUBLE, recall DOUBLE, f1 DOUBLE", f"""WITH {ENCODED_SQL} SELECT round(sum(precision * support) / sum(support), 6) AS precision,
  round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM fx_classes"""),
}


def _report(name: str):
    def query(spark, sf):
        path = folder(spark, "report")
        rows = encoded(spark, sf)
        good = metrics.scorable(rows)
        counts = metrics.class_counts(good)
        sinks.write_report(
            path, report=metrics.classification_report(counts, 4), matrix=metrics.confusion_matrix(good),
            mistakes=metrics.mistakes(rows, label_ids(spark, sf), "sample_id"),
            metrics=six(metrics.precision_recall_f1(counts, "weighted")))
        return spark.read.schema(REPORT_TABLES[name][0]).json(f"{path}/{name}")
    return query


for _name, (_, _sql) in REPORT_TABLES.items():
    R.add(f"k10_write_{_name}", _sql)(_report(_name))


@R.add("k8_generation_lists", f"WITH {GENERATED_SQL} SELECT label, position // 1000 AS part, string_agg(text, '|' ORDER BY position) AS texts FROM fx_generated GROUP BY ALL")
def _(spark, sf):
    path = folder(spark, "generations")
    sinks.write_generation_lists(metrics.generation_lists(metrics.generated_by_label(fx.predictions(spark, sf), "sample_id")), path)
    back = spark.read.schema("label STRING, part BIGINT, texts ARRAY<STRING>").json(path)
    return back.select("label", "part", F.array_join("texts", "|").alias("texts"))


@R.add("k11_run_metrics", f"""WITH {fx.LOG_SQL}, c AS (SELECT run, epoch, max(step) FILTER (phase = 'train')::DOUBLE AS tr, max(step) FILTER (phase = 'eval')::DOUBLE AS ev FROM fx_log GROUP BY 1, 2)
SELECT run, '{{"epochs":[' || string_agg(epoch::VARCHAR, ',' ORDER BY epoch) || '],"train_losses":[' || string_agg(tr::BIGINT || '.0', ',' ORDER BY epoch)
  || '],"eval_losses":[' || string_agg(ev::BIGINT || '.0', ',' ORDER BY epoch) || '],"current_epoch":' || max(epoch) || '}}' AS metrics FROM c GROUP BY 1""")
def _(spark, sf):
    path = folder(spark, "runs")
    rows = fx.train_log(spark, sf).groupBy("run", "epoch", "phase").agg(F.max("step").cast("double").alias("loss"))
    sinks.write_run_metrics(metrics.run_metrics_json(rows), path)
    # the time a run was written at differs from run to run
    body = F.regexp_replace("value", r',"timestamp":"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d"\}$', "}")
    return spark.read.schema("value STRING, run INT").text(path).select("run", body.alias("metrics"))


# samples of an array file, dialogs of a list, and tasks of a registry, so that files stay of bounded size
PER_FILE = 500


# one JSON array per class and so many of its samples, each in a file of its own
@R.add("a5_read_sample_array", f"""WITH {CORPUS_SQL} SELECT instruction, '' AS input, output FROM fx_corpus""")
def _(spark, sf):
    root = folder(spark, "arrays")
    sample = F.struct("instruction", F.lit("").alias("input"), "output")
    placed = fx.corpus_of(fx.numbered_samples(spark, sf))
    arrays = placed.groupBy("label", quotient(F.col("row_no") - 1, PER_FILE).alias("part")).agg(
        F.to_json(F.collect_list(sample)).alias("value"))
    arrays.write.partitionBy("label", "part").text(root)
    return files.read_sample_array(spark, root).select("instruction", "input", "output")


@R.add("a10_read_dialogs", f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS at_turn FROM conversations),
p AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS at FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT p.at // {PER_FILE} AS bucket, p.at % {PER_FILE} AS at, at_turn AS turn, role, text FROM d JOIN p USING (conv_id)""")
def _(spark, sf):
    root = folder(spark, "dialogs")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    dialogs = fx.table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("turns"))
    placed = number_sorted(dialogs, ["conv_id"])
    listed = F.array_sort(F.collect_list(F.struct("conv_id", "turns")))
    text = F.to_json(F.transform(listed, lambda d: d["turns"]))
    lists = placed.groupBy(quotient(F.col("row_no") - 1, PER_FILE).alias("bucket")).agg(text.alias("value"))
    lists.write.partitionBy("bucket").text(root)
    return files.read_dialogs(spark, root).select(
        F.regexp_extract("file", r"bucket=(\d+)", 1).cast("bigint").alias("bucket"),
        F.substring_index("conv_id", "#", -1).cast("bigint").alias("at"), "turn", "role", "text")


@R.add("a11_read_registry", """SELECT p_name || ' ' || p_partkey AS name, 'N' || p_partkey AS code,
  CASE p_partkey % 3 WHEN 0 THEN 'models/' || p_partkey WHEN 1 THEN 'head/' || p_partkey || ',body/' || p_partkey END AS paths FROM part""")
def _(spark, sf):
    path = folder(spark, "registry")
    key = F.col("p_partkey").cast("string")
    code = F.concat(F.lit('"N'), key, F.lit('": '))
    one = F.concat(code, F.lit('"models/'), key, F.lit('"'))
    two = F.concat(code, F.lit('["head/'), key, F.lit('", "body/'), key, F.lit('"]'))
    model = F.when(F.col("p_partkey") % 3 == 0, one).when(F.col("p_partkey") % 3 == 1, two)
    task = F.concat(F.lit('"'), F.concat_ws(" ", "p_name", key), F.lit('": "N'), key, F.lit('"'))
    joined = lambda c: F.array_join(F.collect_list(c), ", ")
    text = F.concat(F.lit('{"model_path": "m", "peft_path": "p", "peft_set": {'), joined(model), F.lit('}, "tasks": {'), joined(task), F.lit("}}"))
    registries = fx.table(spark, sf, "part").groupBy(quotient(F.col("p_partkey"), PER_FILE).alias("part")).agg(text.alias("value"))
    registries.write.partitionBy("part").text(path)
    return files.read_registry(spark, path).select("name", "code", F.array_join("paths", ",").alias("paths"))
