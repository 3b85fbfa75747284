"""Metrics over the prediction, log and text-pair fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirecorpus.operators import metrics, overlap
from wirecorpus.plans import fixtures as fx
from wirecorpus.plans.corpus_queries import LABELS_SQL, label_ids
from wirecorpus.plans.registry import Registry

R = Registry()

BOTH = "contains(response, '。') AND contains(target, '。')"
CUT = lambda c: f"substr({c}, 1, greatest(length({c}) - 1, 0))"
LAST = lambda c: f"string_split({c}, ' ')[-1]"
STOPPED = f"""(SELECT *, CASE WHEN {BOTH} THEN {CUT('response')} ELSE response END AS r,
  CASE WHEN {BOTH} THEN {CUT('target')} ELSE target END AS t FROM fx_predictions)"""
LABEL_VARIANTS = {
    "main": f"SELECT *, CASE WHEN contains(r, ' ') THEN {CUT(LAST('r'))} ELSE r END AS response_label, CASE WHEN contains(r, ' ') THEN {CUT(LAST('t'))} ELSE t END AS target_label FROM {STOPPED}",
    "legacy": f"SELECT *, {CUT(LAST('response'))} AS response_label, {CUT(LAST('target'))} AS target_label FROM fx_predictions",
    "r1": f"SELECT *, CASE WHEN contains(r, ' ') THEN {LAST('r')} ELSE r END AS response_label, CASE WHEN contains(r, ' ') THEN {LAST('t')} ELSE t END AS target_label FROM {STOPPED}",
    "exact": "SELECT *, response AS response_label, target AS target_label FROM fx_predictions",
}


def _labels(variant: str):
    def query(spark, sf):
        return metrics.response_labels(fx.predictions(spark, sf), variant).select(
            "sample_id", "response_label", "target_label")
    return query


for _variant, _sql in LABEL_VARIANTS.items():
    R.add(f"e1_response_labels_{_variant}", f"WITH {fx.PREDICTIONS_SQL} SELECT sample_id, response_label, target_label FROM ({_sql})")(_labels(_variant))

ENCODED_SQL = fx.PREDICTIONS_SQL + f""", fx_labels AS ({LABELS_SQL}), fx_encoded AS (
  SELECT e.*, t.id AS true_id, coalesce(p.id, (SELECT count(*) FROM fx_labels))::INT AS predicted_id
  FROM ({LABEL_VARIANTS['main']}) e LEFT JOIN fx_labels t ON e.target_label = t.label LEFT JOIN fx_labels p ON e.response_label = p.label
), fx_scored AS (SELECT * FROM fx_encoded WHERE true_id IS NOT NULL),
fx_counts AS (
  SELECT cls, sum(tp) AS tp, sum(p) AS predicted, sum(s) AS support FROM (
    SELECT true_id AS cls, CASE WHEN true_id = predicted_id THEN 1.0::DOUBLE ELSE 0 END AS tp, 0.0::DOUBLE AS p, 1.0::DOUBLE AS s FROM fx_scored
    UNION ALL SELECT predicted_id, 0, 1, 0 FROM fx_scored) GROUP BY 1
), fx_weighted_counts AS (
  SELECT cls, sum(tp) AS tp, sum(p) AS predicted, sum(s) AS support FROM (
    SELECT true_id AS cls, CASE WHEN true_id = predicted_id THEN weight ELSE 0 END AS tp, 0.0::DOUBLE AS p, weight AS s FROM fx_scored
    UNION ALL SELECT predicted_id, 0, weight, 0 FROM fx_scored) GROUP BY 1
), fx_classes AS (
  SELECT cls, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
    CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * tp / (predicted + support) END AS f1, support FROM fx_counts
)"""


def encoded(spark, sf, variant="main"):
    rows = metrics.response_labels(fx.predictions(spark, sf), variant)
    return metrics.encode_labels(rows, label_ids(spark, sf))


def scored(spark, sf):
    return metrics.scorable(encoded(spark, sf))


def six(df, *columns):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@R.add("e2_encode_labels", f"WITH {ENCODED_SQL} SELECT sample_id, true_id, predicted_id FROM fx_encoded")
def _(spark, sf):
    return encoded(spark, sf).select("sample_id", "true_id", "predicted_id")


@R.add("e2_target_rejects", f"""WITH {fx.PREDICTIONS_SQL}, fx_labels AS ({LABELS_SQL})
SELECT sample_id, 'unknown target label' AS reason FROM ({LABEL_VARIANTS['legacy']}) WHERE target_label NOT IN (SELECT label FROM fx_labels)""")
def _(spark, sf):
    return metrics.target_rejects(encoded(spark, sf, "legacy"), "sample_id")


@R.add("e3_accuracy", f"WITH {ENCODED_SQL} SELECT avg(CASE WHEN true_id = predicted_id THEN 1.0 ELSE 0 END) AS accuracy FROM fx_scored")
def _(spark, sf):
    return metrics.accuracy(scored(spark, sf))


@R.add("e3_accuracy_weighted", f"WITH {ENCODED_SQL} SELECT sum(CASE WHEN true_id = predicted_id THEN weight ELSE 0 END) / sum(weight) AS accuracy FROM fx_scored")
def _(spark, sf):
    return metrics.accuracy(scored(spark, sf), weight="weight")


@R.add("e3_accuracy_count", f"WITH {ENCODED_SQL} SELECT count(*) FILTER (true_id = predicted_id)::DOUBLE AS accuracy FROM fx_scored")
def _(spark, sf):
    return metrics.accuracy(scored(spark, sf), normalize=False)


PRF = {"e4_precision": "precision", "e5_recall": "recall", "e6_f1": "f1"}
MICRO = {"precision": "sum(tp) / sum(predicted)", "recall": "sum(tp) / sum(support)", "f1": "2 * sum(tp) / sum(predicted + support)"}


def _average(metric: str, average: str | None, **options):
    def query(spark, sf):
        counts = metrics.class_counts(scored(spark, sf))
        rows = metrics.precision_recall_f1(counts, average, **options)
        return six(rows.select(*(["cls"] if average is None else []), metric))
    return query


for _name, _metric in PRF.items():
    R.add(f"{_name}_macro", f"WITH {ENCODED_SQL} SELECT round(avg({_metric}), 6) AS {_metric} FROM fx_classes")(_average(_metric, "macro"))
    R.add(f"{_name}_micro", f"WITH {ENCODED_SQL} SELECT round({MICRO[_metric]}, 6) AS {_metric} FROM fx_counts")(_average(_metric, "micro"))
    R.add(f"{_name}_weighted", f"WITH {ENCODED_SQL} SELECT round(sum({_metric} * support) / sum(support), 6) AS {_metric} FROM fx_classes")(_average(_metric, "weighted"))
    R.add(f"{_name}_per_class", f"WITH {ENCODED_SQL} SELECT cls, round({_metric}, 6) AS {_metric} FROM fx_classes")(_average(_metric, None))
    R.add(f"{_name}_binary", f"WITH {ENCODED_SQL} SELECT round({_metric}, 6) AS {_metric} FROM fx_classes WHERE cls = 1")(_average(_metric, "binary", pos_label=1))


@R.add("e4_precision_sample_weight", f"WITH {ENCODED_SQL} SELECT cls, round(CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END, 6) AS precision FROM fx_weighted_counts")
def _(spark, sf):
    counts = metrics.class_counts(scored(spark, sf), weight="weight")
    return six(metrics.per_class(counts).select("cls", "precision"))


@R.add("e5_recall_label_subset", f"WITH {ENCODED_SQL} SELECT round((SELECT sum(recall) FROM fx_classes WHERE cls IN (0, 2)) / 3 + 1.0/3, 6) AS recall")
def _(spark, sf):
    counts = metrics.class_counts(scored(spark, sf))
    return six(metrics.precision_recall_f1(counts, "macro", labels=[0, 2, 99], zero_division=1).select("recall"))


@R.add("e7_multilabel_metrics", """WITH s AS (
  SELECT list_distinct([event_type, 'c' || (event_id % 3)]) AS t, list_distinct([CASE WHEN event_id % 4 = 0 THEN 'view' ELSE event_type END, 'c' || (event_id % 2)]) AS p FROM events
), m AS (SELECT len(list_intersect(t, p)) AS tp, len(p) AS np, len(t) AS nt, list_sort(t) = list_sort(p) AS same FROM s)
SELECT round(avg(tp / np), 6) AS precision, round(avg(tp / nt), 6) AS recall, round(avg(2.0 * tp / (np + nt)), 6) AS f1,
  round(avg(CASE WHEN same THEN 1.0 ELSE 0 END), 6) AS subset_accuracy FROM m""")
def _(spark, sf):
    e = fx.table(spark, sf, "events")
    c = lambda n: F.concat(F.lit("c"), (F.col("event_id") % n).cast("string"))
    rows = e.select(
        F.array("event_type", c(3)).alias("true_labels"),
        F.array(F.when(F.col("event_id") % 4 == 0, "view").otherwise(F.col("event_type")), c(2)).alias("predicted_labels"))
    return six(metrics.multilabel_metrics(rows))


@R.add("e8_classification_report", f"""WITH {ENCODED_SQL}
SELECT cls::VARCHAR AS name, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM fx_classes
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 4), sum(support) FROM fx_counts
UNION ALL SELECT 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), sum(support) FROM fx_classes
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 4), round(sum(recall * support) / sum(support), 4),
  round(sum(f1 * support) / sum(support), 4), sum(support) FROM fx_classes""")
def _(spark, sf):
    return metrics.classification_report(metrics.class_counts(scored(spark, sf)), 4)


@R.add("e9_confusion_matrix", f"""WITH {ENCODED_SQL}, c AS (SELECT true_id AS c FROM fx_scored UNION SELECT predicted_id FROM fx_scored)
SELECT a.c AS true_id, b.c AS predicted_id, (SELECT count(*) FROM fx_scored s WHERE s.true_id = a.c AND s.predicted_id = b.c) AS n FROM c a, c b""")
def _(spark, sf):
    return metrics.confusion_matrix(scored(spark, sf))


@R.add("e10_repair_unknown", f"""WITH {ENCODED_SQL}
SELECT sample_id, true_id, CASE WHEN predicted_id = (SELECT count(*) FROM fx_labels)
  THEN (SELECT min(c.true_id) FROM (SELECT DISTINCT true_id FROM fx_scored) c WHERE c.true_id <> s.true_id) ELSE predicted_id END AS predicted_id FROM fx_scored s""")
def _(spark, sf):
    return metrics.repair_unknown(scored(spark, sf), label_ids(spark, sf)).select("sample_id", "true_id", "predicted_id")


@R.add("e11_mistakes", f"""WITH {ENCODED_SQL} SELECT sample_id, response_label FROM fx_encoded WHERE response_label NOT IN (SELECT label FROM fx_labels)""")
def _(spark, sf):
    return metrics.mistakes(metrics.response_labels(fx.predictions(spark, sf)), label_ids(spark, sf), "sample_id")


def _grams_sql(n: int, level: str) -> str:
    """(doc_id, n, side, gram, count) of one order."""
    def one(side: str) -> str:
        tokens = f"list_filter(string_split_regex({side}, '\\s+'), lambda x: x <> '')" if level == "word" else f"regexp_extract_all({side}, '(?s).')"
        parts = " || chr(1) || ".join(f"w[i + {k}]" for k in range(n))
        return f"""SELECT doc_id, {n} AS n, '{side}' AS side, {parts} AS g FROM (
  SELECT doc_id, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM (SELECT doc_id, {tokens} AS w FROM fx_text_pairs))"""
    return one("response") + " UNION ALL " + one("target")


def _overlap_sql(orders, level: str, distinct: bool) -> str:
    grams = " UNION ALL ".join(_grams_sql(n, level) for n in orders)
    clip = "least(1, {0})" if distinct else "{0}"
    r, t = clip.format("count(*) FILTER (side = 'response')"), clip.format("count(*) FILTER (side = 'target')")
    return fx.TEXT_PAIRS_SQL + f""", counted AS (
  SELECT doc_id, n, g, {r} AS r, {t} AS t FROM ({grams}) GROUP BY ALL
), overlap AS (
  SELECT d.doc_id, o.n, coalesce(sum(least(r, t)), 0) AS ov, coalesce(sum(r), 0) AS rn, coalesce(sum(t), 0) AS tn
  FROM documents d CROSS JOIN (SELECT unnest({list(orders)}) AS n) o LEFT JOIN counted c ON c.doc_id = d.doc_id AND c.n = o.n GROUP BY ALL
)"""


def _rouge_sql(distinct: bool) -> str:
    f = "CASE WHEN ov = 0 THEN 0.0 ELSE round(200.0::DOUBLE * ov / (rn + tn), 4) END"
    return f"""WITH {_overlap_sql([1, 2], 'word', distinct)}
SELECT doc_id, max({f}) FILTER (n = 1) AS rouge_1, max({f}) FILTER (n = 2) AS rouge_2 FROM overlap GROUP BY 1"""


@R.add("e12_rouge_n", _rouge_sql(True))
def _(spark, sf):
    return overlap.rouge_n(fx.text_pairs(spark, sf), "doc_id")


@R.add("e12_rouge_n_counted", _rouge_sql(False))
def _(spark, sf):
    return overlap.rouge_n(fx.text_pairs(spark, sf), "doc_id", distinct=False)


# a longest common subsequence is a table per pair of texts; tests compare it with that table
@R.add("e12_rouge_l")
def _(spark, sf):
    return overlap.rouge_l(fx.text_pairs(spark, sf), "doc_id")


def _bleu_sql(level: str, scaled: bool) -> str:
    value = "CASE WHEN ov1 = 0 THEN 0.0 ELSE exp(CASE WHEN rn1 > tn1 THEN 0.0 ELSE 1 - tn1 / rn1::DOUBLE END + lg / 4) END"
    out = f"round(100 * {value}, 4)" if scaled else f"round({value}, 6)"
    return f"""WITH {_overlap_sql([1, 2, 3, 4], level, False)}, k AS (
  SELECT *, sum(CASE WHEN ov = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS empties FROM overlap
), l AS (
  SELECT doc_id, sum(CASE WHEN ov = 0 THEN -ln(power(2.0, empties) * greatest(rn, 1)) ELSE ln(ov::DOUBLE / rn) END) AS lg,
    max(ov) FILTER (n = 1) AS ov1, max(rn) FILTER (n = 1) AS rn1, max(tn) FILTER (n = 1) AS tn1 FROM k GROUP BY 1
) SELECT doc_id, {out} AS bleu_4 FROM l"""


@R.add("e13_bleu_char", _bleu_sql("char", True))
def _(spark, sf):
    return overlap.bleu(fx.text_pairs(spark, sf), "doc_id")


@R.add("e13_bleu_word", _bleu_sql("word", False))
def _(spark, sf):
    return six(overlap.bleu(fx.text_pairs(spark, sf), "doc_id", level="word", scaled=False))


GENERATED_SQL = fx.PREDICTIONS_SQL + """, fx_generated AS (
  SELECT string_split(prompt, ' ')[-2] AS label, row_number() OVER (PARTITION BY string_split(prompt, ' ')[-2] ORDER BY sample_id) - 1 AS position, response AS text
  FROM fx_predictions
)"""


@R.add("e14_generated_by_label", f"WITH {GENERATED_SQL} SELECT * FROM fx_generated")
def _(spark, sf):
    return metrics.generated_by_label(fx.predictions(spark, sf), "sample_id")


EPOCHS_SQL = fx.LOG_SQL + """, fx_epochs AS (
  SELECT run, epoch, phase, sum(CASE WHEN isnan(loss) THEN 0 ELSE loss END) / count(*) AS loss, sum(seconds) AS seconds,
    exp(sum(CASE WHEN isnan(loss) THEN 0 ELSE loss END) / count(*)) AS perplexity
  FROM fx_log GROUP BY ALL
)"""


@R.add("e15_epoch_losses", f"WITH {EPOCHS_SQL} SELECT run, epoch, phase, round(loss, 6) AS loss, round(seconds, 6) AS seconds, round(perplexity, 6) AS perplexity FROM fx_epochs")
def _(spark, sf):
    return six(metrics.epoch_losses(fx.train_log(spark, sf)))


@R.add("e16_best_so_far", f"""WITH {EPOCHS_SQL}
SELECT run, epoch, round(loss, 6) AS loss, round(min(loss) OVER (PARTITION BY run ORDER BY epoch), 6) AS best_loss,
  coalesce(loss < min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_checkpoint
FROM fx_epochs WHERE phase = 'eval'""")
def _(spark, sf):
    return six(metrics.best_so_far(metrics.epoch_losses(fx.train_log(spark, sf))))


@R.add("e17_run_summary", f"""WITH {EPOCHS_SQL} SELECT run, {', '.join(
    f"round(avg({c}) FILTER (phase = '{p}'), 6) AS {n}" for n, p, c in [
        ('train_loss', 'train', 'loss'), ('train_perplexity', 'train', 'perplexity'), ('eval_loss', 'eval', 'loss'),
        ('eval_perplexity', 'eval', 'perplexity'), ('epoch_seconds', 'train', 'seconds'), ('checkpoint_seconds', 'eval', 'seconds')])}
FROM fx_epochs GROUP BY 1""")
def _(spark, sf):
    return six(metrics.run_summary(metrics.epoch_losses(fx.train_log(spark, sf))))


def _epoch_eval_sql(cumulative: bool) -> str:
    hits, n = ("sum(h) OVER (ORDER BY epoch)", "sum(n) OVER (ORDER BY epoch)") if cumulative else ("h", "n")
    return f"""WITH {ENCODED_SQL}, {fx.LOG_SQL}, s AS (
  SELECT epoch, sum(CASE WHEN true_id = predicted_id THEN 1 ELSE 0 END) AS h, count(*) AS n FROM fx_scored GROUP BY 1
), l AS (SELECT epoch, avg(loss) FILTER (NOT isnan(loss)) AS l FROM fx_log WHERE phase = 'eval' GROUP BY 1)
SELECT epoch, ({n})::BIGINT AS n, round(({hits}) / ({n}), 6) AS accuracy, round(coalesce(l, 0), 6) AS eval_loss FROM s LEFT JOIN l USING (epoch)"""


def _epoch_eval(cumulative: bool):
    def query(spark, sf):
        losses = fx.train_log(spark, sf).filter("phase = 'eval'")
        return six(metrics.epoch_evaluations(scored(spark, sf), losses, cumulative))
    return query


R.add("e18_epoch_evaluations", _epoch_eval_sql(True))(_epoch_eval(True))
R.add("e18_epoch_evaluations_single", _epoch_eval_sql(False))(_epoch_eval(False))
