"""Corpus building over the sample, document, page and conversation fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirecorpus.operators import corpus, packets
from wirecorpus.operators.catalog import (
    HTTP_SERVICE_WORDS,
    ANALYZE_FAMILIES, DETECTION_TEMPLATES, LEGACY_TEMPLATES, PACKET_FIELDS, PROMPT_NO_INPUT,
    PROMPT_VARIANTS, PROMPT_WITH_INPUT, SPACING_REPAIRS, UNDERSTANDING,
)
from wirecorpus.plans import fixtures as fx
from wirecorpus.plans.packet_queries import WORDS_SOURCE_SQL, words_sql
from wirecorpus.plans.registry import Registry, sql_text
from wirecorpus.session import stage

R = Registry()


def template_case(table: dict[str, str], granularity: str, column: str = "task") -> str:
    arms = " ".join(f"WHEN '{k}' THEN {sql_text(v.replace('{g}', granularity))}" for k, v in table.items())
    return f"CASE {column} {arms} END"


def key_sql(purpose: str, ident: str) -> str:
    return f"md5('42|{purpose}|' || {ident})"


def pick_sql(purpose: str, ident: str, n: str) -> str:
    return f"(('0x' || substr({key_sql(purpose, ident)}, 1, 8))::BIGINT % ({n}))"


SENTENCE = "'The traffic category is likely to be recognized as ' || label || '.'"
INSTRUCTION = template_case(DETECTION_TEMPLATES, "packet") + " || chr(10) || '<packet>: ' || data"
OUTPUT = f"CASE WHEN task = 'MDD' THEN {SENTENCE} ELSE label END"
CORPUS_SQL = fx.SAMPLES_SQL + f""", fx_corpus AS (
  SELECT *, {INSTRUCTION} AS instruction, {OUTPUT} AS output FROM fx_samples
)"""


@R.add("c1_detection_samples", f"WITH {CORPUS_SQL} SELECT packet_id, task, instruction, output FROM fx_corpus")
def _(spark, sf):
    return fx.corpus(spark, sf).select("packet_id", "task", "instruction", "output")


@R.add("c1_detection_samples_flow", f"""WITH {fx.FRAMES_SQL}
SELECT capture, {template_case(DETECTION_TEMPLATES, 'flow', "'EVD'")} || chr(10) || '<flow>: ' || '<pck>'
  || string_agg(substr(frame_hex, 1, 256), '<pck>' ORDER BY frame_no) AS instruction, label AS output
FROM fx_frames WHERE frame_no <= 10 GROUP BY capture, label""")
def _(spark, sf):
    from wirecorpus.operators.flows import flow_bytes

    rows = flow_bytes(fx.frames(spark, sf)).withColumn("task", F.lit("EVD"))
    return corpus.detection_samples(rows, "flow", "flow_text").select("capture", "instruction", "output")


@R.add("c2_dispatch_task", f"WITH {fx.SAMPLES_SQL} SELECT packet_id, dataset, task FROM fx_samples")
def _(spark, sf):
    return corpus.dispatch_task(fx.samples(spark, sf)).select("packet_id", "dataset", "task")


@R.add("c3_generation_samples", f"""WITH {fx.SAMPLES_SQL}
SELECT packet_id, 'Please generate a packet of ' || label || ' traffic.' AS instruction, data AS output FROM fx_samples""")
def _(spark, sf):
    return corpus.generation_samples(fx.samples(spark, sf)).select("packet_id", "instruction", "output")


def _understanding_sql(families: list[str]) -> str:
    entries = [e for f, items in UNDERSTANDING.items() if f in families for e in items]
    questions = "[" + ", ".join(sql_text(q) for q, _ in entries) + "]"
    calls = "[" + ", ".join(sql_text(c) for _, c in entries) + "]"
    lead = "Please analyze the " if any(f in ANALYZE_FAMILIES for f in families) else "What is "
    i = pick_sql("field", "packet_id", str(len(entries))) + " + 1"
    return f"""WITH {fx.SAMPLES_SQL}
SELECT packet_id, '{lead}' || ({questions})[{i}] || ' in the packet: ' || data AS instruction,
  '<' || ({calls})[{i}] || '>' AS output FROM fx_samples"""


def _understanding(families):
    def query(spark, sf):
        return corpus.understanding_samples(fx.samples(spark, sf), families, "packet_id").select(
            "packet_id", "instruction", "output")
    return query


for _name, _families in {
    "c4_understanding_tcp": ["TCP"],
    "c4_understanding_layers": ["IP", "UDP", "TLS", "DNS", "http.HTTPRequest", "http.HTTPResponse"],
    "c4_understanding_fingerprints": ["GeoIP", "JA3"],
}.items():
    R.add(_name, _understanding_sql(_families))(_understanding(_families))


def _split_sql(source: str, ident: str, cap: int | None, ratio: float) -> str:
    m = f"least(n, {cap})" if cap else "n"
    return f"""(SELECT * FROM (SELECT s.*, CASE WHEN rn <= trunc({m} * {ratio}::DOUBLE) THEN 'train'
    WHEN rn <= trunc({m} * {ratio}::DOUBLE) + trunc({m} * (1 - {ratio}::DOUBLE)) THEN 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {key_sql('split', ident)}, {ident}) AS rn,
          count(*) OVER (PARTITION BY label) AS n FROM {source}) s) WHERE split IS NOT NULL)"""


@R.add("c5_understanding_caps", f"""WITH {fx.SAMPLES_SQL}
SELECT packet_id, split FROM (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY {key_sql('understanding', 'packet_id')}, packet_id) AS r
  FROM {_split_sql('fx_samples', 'packet_id', None, 0.95)})
WHERE r <= CASE WHEN split = 'train' THEN 20000 ELSE 200 END""")
def _(spark, sf):
    split = corpus.cap_split(fx.samples(spark, sf), "packet_id", cap=None)
    return corpus.understanding_caps(split, "packet_id").select("packet_id", "split")


LEGACY_TASK = "CASE WHEN super_label = 'malware' THEN 'EMD' ELSE 'EAC' END"


@R.add("c6_legacy_samples", f"""WITH {fx.SAMPLES_SQL}
SELECT packet_id, {template_case(LEGACY_TEMPLATES, 'packet', LEGACY_TASK)} AS instruction, data AS input,
  CASE WHEN super_label = 'malware' THEN 'This might be a ' || super_label
    || ' traffic packet. The category is likely to be recognized as ' || label || '.' ELSE {SENTENCE} END AS output
FROM fx_samples""")
def _(spark, sf):
    rows = fx.samples(spark, sf).withColumn("task", F.expr(LEGACY_TASK))
    return corpus.legacy_samples(rows).select("packet_id", "instruction", "input", "output")


@R.add("c6_legacy_generation", f"""WITH {fx.SAMPLES_SQL}
SELECT packet_id, 'Please generate a packet of ' || label || ' traffic.' AS instruction, '' AS input, data AS output FROM fx_samples""")
def _(spark, sf):
    return corpus.legacy_generation_samples(fx.samples(spark, sf)).select(
        "packet_id", "instruction", "input", "output")


CUT = pick_sql("cut", "doc_id", "length(text)")


@R.add("c7_continuation_samples", f"""SELECT doc_id, substr(text, 1, {CUT}) AS instruction, substr(text, {CUT} + 1) AS output
FROM documents WHERE length(text) > 0""")
def _(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    return corpus.continuation_samples(docs, "doc_id").select("doc_id", "instruction", "output")


@R.add("c8_cap_split", f"WITH {fx.SAMPLES_SQL} SELECT packet_id, label, split FROM {_split_sql('fx_samples', 'packet_id', 100, 0.95)}")
def _(spark, sf):
    return corpus.cap_split(fx.samples(spark, sf), "packet_id").select("packet_id", "label", "split")


@R.add("c8_cap_split_legacy", f"WITH {fx.SAMPLES_SQL} SELECT packet_id, label, split FROM {_split_sql('fx_samples', 'packet_id', 5000, 0.8)}")
def _(spark, sf):
    return corpus.cap_split(
        fx.samples(spark, sf), "packet_id", cap=corpus.LEGACY_CAP, ratio=corpus.LEGACY_RATIO
    ).select("packet_id", "label", "split")


@R.add("c9_uncapped_split", f"WITH {fx.SAMPLES_SQL} SELECT packet_id, label, split FROM {_split_sql('fx_samples', 'packet_id', None, 0.95)}")
def _(spark, sf):
    return corpus.cap_split(fx.samples(spark, sf), "packet_id", cap=None).select("packet_id", "label", "split")


LABELS_SQL = "SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS id FROM (SELECT DISTINCT event_type AS label FROM events)"


@R.add("c10_label_index", LABELS_SQL)
def label_index(spark, sf):
    return corpus.label_index(fx.table(spark, sf, "events").select(F.col("event_type").alias("label")))


def label_ids(spark, sf):
    """The label table as later steps read it: a small table of its own."""
    return stage(label_index(spark, sf))


@R.add("c10_label_index_many", "SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS id FROM (SELECT DISTINCT c_name AS label FROM customer)")
def _(spark, sf):
    return corpus.label_index(fx.table(spark, sf, "customer").select(F.col("c_name").alias("label")))


@R.add("k3_label_map_json", f"""SELECT '{{' || string_agg('"' || label || '":' || id, ',' ORDER BY label) || '}}' AS label_map FROM ({LABELS_SQL})""")
def _(spark, sf):
    return corpus.label_map_json(label_ids(spark, sf))


@R.add("c11_global_shuffle", f"SELECT event_id, row_number() OVER (ORDER BY {key_sql('shuffle', 'event_id')}, event_id) AS position FROM events")
def _(spark, sf):
    return corpus.shuffle_positions(fx.table(spark, sf, "events").select("event_id"), "event_id")


@R.add("c14_classification_rows", f"""WITH {CORPUS_SQL}
SELECT packet_id, substr(string_split(instruction, chr(10))[-1], 1, 512) AS text, l.id AS label_id
FROM fx_corpus c LEFT JOIN ({LABELS_SQL}) l ON c.output = l.label""")
def _(spark, sf):
    return corpus.classification_rows(fx.corpus(spark, sf), label_ids(spark, sf)).select(
        "packet_id", "text", "label_id")


@R.add("c15_validation_split", f"""WITH {fx.SAMPLES_SQL}, s AS (SELECT * FROM {_split_sql('fx_samples', 'packet_id', None, 0.95)}),
r AS (SELECT packet_id, split, row_number() OVER (PARTITION BY split ORDER BY {key_sql('validation', 'packet_id')}, packet_id) AS k,
  count(*) OVER (PARTITION BY split) AS m FROM s)
SELECT packet_id, CASE WHEN split = 'train' AND k > floor(m * 0.8::DOUBLE) THEN 'validation' ELSE split END AS split FROM r""")
def _(spark, sf):
    split = corpus.cap_split(fx.samples(spark, sf), "packet_id", cap=None).select("packet_id", "split")
    return corpus.validation_split(split, "packet_id")


def _repair_sql(text: str) -> str:
    for old, new in SPACING_REPAIRS:
        text = f"replace({text}, {sql_text(old)}, {sql_text(new)})"
    return text


# the words of the given texts, spaced the way the repairs expect
SPACED = "replace(replace(replace({0}, '.', ' .'), ',', ' ,'), '1', '1 ')"
SPACED_SQL = f"SELECT doc_id, {_repair_sql(SPACED.format('text'))} AS text FROM documents"


@R.add("c16_repair_spacing", SPACED_SQL)
def _(spark, sf):
    docs = fx.documents(spark, sf, "doc_id", "text")
    return docs.select("doc_id", corpus.repair_spacing(F.expr(SPACED.format("text"))).alias("text"))


CORRECTIONS_SQL = fx.PAIRS_SQL + f""", fx_corrections AS (
  SELECT doc_id, input, target FROM (
    SELECT doc_id, {_repair_sql('sentence')} AS input, {_repair_sql('correction')} AS target
    FROM (SELECT doc_id, sentence, unnest(corrections) AS correction FROM fx_pairs)) q
  WHERE input <> '' AND target <> ''
)"""


@R.add("c17_explode_corrections", f"WITH {CORRECTIONS_SQL} SELECT * FROM fx_corrections")
def _(spark, sf):
    return corpus.explode_corrections(fx.pairs(spark, sf), ["doc_id"])


@R.add("c18_take_union", f"""SELECT * FROM (SELECT doc_id, lang AS input, source AS target FROM documents ORDER BY {key_sql('take', 'doc_id')}, doc_id LIMIT 300)
UNION ALL SELECT item_id, text, '' FROM benchmark""")
def _(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("input"), F.col("source").alias("target"))
    bench = fx.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("doc_id"), F.col("text").alias("input"), F.lit("").alias("target"))
    return corpus.take_union(docs, bench, "doc_id", 300)


@R.add("c19_summary_prompt", """SELECT doc_id, 'Summarize this dialog:' || chr(10) || text || chr(10) || '---' || chr(10) || 'Summary:' || chr(10) || source || '</s>' AS prompt FROM documents""")
def _(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", corpus.summary_prompt(F.col("text"), F.col("source")).alias("prompt"))


@R.add("c20_correction_prompt", f"""WITH {CORRECTIONS_SQL}
SELECT doc_id, 'Correct this to standard English: ' || input || chr(10) || '---' || chr(10) || 'Corrected: ' || target AS prompt FROM fx_corrections""")
def _(spark, sf):
    pairs = corpus.explode_corrections(fx.pairs(spark, sf), ["doc_id"])
    return pairs.select("doc_id", corpus.correction_prompt(F.col("input"), F.col("target")).alias("prompt"))


def _fill_sql(template: str, **values: str) -> str:
    text = sql_text(template)
    for name, value in values.items():
        text = text.replace("{" + name + "}", f"' || {value} || '")
    return text


@R.add("c21_task_prompt", f"""SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0
  THEN {_fill_sql(PROMPT_NO_INPUT, instruction='event_type')}
  ELSE {_fill_sql(PROMPT_WITH_INPUT, instruction='event_type', input='props')} END AS prompt FROM events""")
def _(spark, sf):
    e = fx.table(spark, sf, "events")
    source = F.when(F.col("event_id") % 3 == 0, F.lit(None)).when(F.col("event_id") % 5 == 0, "").otherwise(F.col("props"))
    return e.select("event_id", corpus.task_prompt(F.col("event_type"), source).alias("prompt"))


@R.add("c22_first_rows", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 1000")
def _(spark, sf):
    return corpus.first_rows(fx.table(spark, sf, "events").select("event_id", "event_type"), "event_id", 1000)


@R.add("c22_last_rows", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 200")
def _(spark, sf):
    return corpus.last_rows(fx.table(spark, sf, "events").select("event_id", "event_type"), "event_id", 200)


@R.add("c23_vocabulary_corpus", f"""WITH {CORPUS_SQL}
SELECT packet_id, 0 AS part, instruction AS text FROM fx_corpus UNION ALL SELECT packet_id, 1, output FROM fx_corpus""")
def _(spark, sf):
    return corpus.vocabulary_corpus(fx.corpus(spark, sf), "packet_id")


@R.add("c24_nonempty", f"WITH {fx.PACKETS_SQL} SELECT packet_id FROM fx_packets WHERE payload_hex <> '' AND options_hex <> ''")
def _(spark, sf):
    return corpus.nonempty(fx.packets(spark, sf), "payload_hex", "options_hex").select("packet_id")


def _http(template: str, words: dict[str, str] | None = None):
    answer = f"CASE label {' '.join(f'WHEN {sql_text(a)} THEN {sql_text(b)}' for a, b in words.items())} ELSE label END" if words else "label"
    sql = f"""WITH {fx.HTTP_SQL}
SELECT request_id, {sql_text(template)} || json_object('method', 'GET', 'URL', path || query, 'body', '')::VARCHAR AS instruction, {answer} AS output FROM fx_http"""

    def query(spark, sf):
        return corpus.http_samples(fx.http_requests(spark, sf), template, words=words).select("request_id", "instruction", "output")
    return sql, query


for _variant in ("cli", "service"):
    _sql, _query = _http(PROMPT_VARIANTS[_variant]["WAD"], HTTP_SERVICE_WORDS if _variant == "service" else None)
    R.add(f"c25_http_samples_{_variant}", _sql)(_query)


@R.add("c26_class_weights", "SELECT event_type AS label, count(*) AS n, (SELECT count(*) FROM events) / (2.0 * count(*)) AS weight FROM events GROUP BY 1")
def _(spark, sf):
    return corpus.class_weights(fx.table(spark, sf, "events").select(F.col("event_type").alias("label")))


@R.add("c26_class_weights_balanced", "SELECT source AS label, count(*) AS n, (SELECT count(*) / count(DISTINCT source)::DOUBLE FROM documents) / count(*) AS weight FROM documents GROUP BY 1")
def _(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("source").alias("label"))
    return corpus.class_weights(docs, classes=None)


@R.add("c27_corpus_profile", r"""SELECT count(*) AS n_rows,
  count(*) FILTER (text IS NULL) AS text_nulls, max(length(text))::INT AS text_max_chars, max(len(regexp_extract_all(text, '\S+')))::INT AS text_max_words,
  count(*) FILTER (source IS NULL) AS source_nulls, max(length(source))::INT AS source_max_chars, max(len(regexp_extract_all(source, '\S+')))::INT AS source_max_words
FROM documents""")
def _(spark, sf):
    return corpus.corpus_profile(fx.table(spark, sf, "documents"), ["text", "source"])


@R.add("c28_corpus_statistics", f"""WITH {fx.SAMPLES_SQL}
SELECT task, dataset, label, split, count(*) AS n_samples FROM {_split_sql('fx_samples', 'packet_id', 100, 0.95)} GROUP BY ALL""")
def _(spark, sf):
    rows = corpus.cap_split(corpus.dispatch_task(fx.samples(spark, sf)), "packet_id")
    return corpus.corpus_statistics(rows)


# the whole detection build: frames -> fields -> words -> capped split -> samples -> sizes per class
@R.add("packet_corpus_by_class", f"""WITH {WORDS_SOURCE_SQL}, fx_words AS (
  SELECT w.packet_id, w.label, {words_sql(PACKET_FIELDS)} AS data
  FROM fx_all w LEFT JOIN fx_features f ON w.packet_id = f.packet_id WHERE w.proto IN (6, 17)
), built AS (
  SELECT label, split, {template_case(DETECTION_TEMPLATES, 'packet', "'EMD'")} || chr(10) || '<packet>: ' || data AS instruction
  FROM {_split_sql('fx_words', 'packet_id', 100, 0.95)}
)
SELECT label, split, count(*) AS n_samples, sum(length(instruction))::BIGINT AS n_chars FROM built GROUP BY ALL""")
def packet_corpus_by_class(spark, sf):
    # read twice: by class and key for the caps, and for what is kept
    fields = stage(packets.packet_fields(fx.frames(spark, sf)))
    kept = corpus.cap_split(fields, "packet_id")
    words = packets.traffic_words(kept, out="data").withColumn("task", F.lit("EMD"))
    return corpus.detection_samples(words).groupBy("label", "split").agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum(F.length("instruction")).alias("n_chars")
    )
