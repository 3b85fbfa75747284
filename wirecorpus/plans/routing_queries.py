"""Prompt splitting, routing, scoring, screening and generation over the request fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirecorpus.operators import corpus, metrics, routing, synthesis
from wirecorpus.operators.catalog import PROMPT_VARIANTS, REGISTRY_PATHS, REGISTRY_TASKS
from wirecorpus.plans import fixtures as fx
from wirecorpus.plans.corpus_queries import label_ids, template_case
from wirecorpus.plans.keyword_model import KeywordModel
from wirecorpus.plans.registry import Registry, sql_text

R = Registry()

ROUTER_RULES = [
    ("malware", "Malware Traffic Detection"), ("botnet", "Botnet Detection"),
    ("web request", "Web Attack Detection"), ("APT", "APT Attack Detection"),
    ("Tor", "Tor Behavior Detection"),
]
EXPERT_RULES = [("tcp.payload", "malicious"), ("ip.proto: 17", "normal")]
router = lambda path: KeywordModel(ROUTER_RULES, "Small Talk")
expert = lambda path: KeywordModel(EXPERT_RULES, "benign")


def rules_sql(rules, default: str, text: str) -> str:
    arms = " ".join(f"WHEN contains({text}, {sql_text(k)}) THEN {sql_text(a)}" for k, a in rules)
    return f"CASE {arms} ELSE {sql_text(default)} END"


ROUTED_SQL = fx.REQUESTS_SQL + f""", fx_answered AS (
  SELECT *, {rules_sql(ROUTER_RULES, 'Small Talk', 'human_instruction')} AS task_response FROM fx_asked
), fx_routed AS (
  SELECT *, CASE task_response {' '.join(f"WHEN '{n}' THEN '{c}'" for n, c in REGISTRY_TASKS.items())} END AS code FROM fx_answered
)"""


def asked(spark, sf):
    return routing.split_prompt(fx.requests(spark, sf))


def answered(spark, sf):
    first = routing.score(asked(spark, sf), router, "human_instruction", "task_response")
    return routing.route(first, routing.published_registry(spark))


@R.add("r1_split_prompt", f"WITH {fx.REQUESTS_SQL} SELECT packet_id, human_instruction, traffic_data FROM fx_asked")
def _(spark, sf):
    return asked(spark, sf).select("packet_id", "human_instruction", "traffic_data")


@R.add("r1_split_prompt_agent", f"""WITH {fx.REQUESTS_SQL}
SELECT packet_id, split_part(prompt, '<packet>', 1) AS human_instruction, '<packet>' || split_part(prompt, '<packet>', 2) AS traffic_data FROM fx_requests""")
def _(spark, sf):
    return routing.split_prompt(fx.requests(spark, sf), variant="agent").select(
        "packet_id", "human_instruction", "traffic_data")


PATH_CASE = " ".join(f"WHEN '{c}' THEN '{p[0]}'" for c, p in REGISTRY_PATHS.items())


@R.add("r2_route", f"""WITH {ROUTED_SQL}
SELECT packet_id, task_response, code, CASE code {PATH_CASE} END AS path FROM fx_routed WHERE code IS NOT NULL""")
def _(spark, sf):
    return routing.routed(answered(spark, sf)).select(
        "packet_id", "task_response", "code", F.col("paths")[0].alias("path"))


@R.add("r2_route_rejects", f"WITH {ROUTED_SQL} SELECT packet_id, 'unknown task' AS reason FROM fx_routed WHERE code IS NULL")
def _(spark, sf):
    return routing.route_rejects(answered(spark, sf), "packet_id")


def _prompt_sql(variant: str) -> str:
    bare = "CASE WHEN contains(traffic_data, '<packet>:') THEN split_part(traffic_data, '<packet>:', 2) ELSE traffic_data END"
    data = f"CASE WHEN code = 'AAD' THEN {bare} ELSE traffic_data END" if variant == "cli" else "traffic_data"
    return f"{template_case(PROMPT_VARIANTS[variant], '', 'code')} || {data}"


def _task_prompts(variant: str):
    def query(spark, sf):
        return routing.task_prompts(routing.routed(answered(spark, sf)), variant=variant).select("packet_id", "code", "task_prompt")
    return query


for _variant in ("cli", "service"):
    R.add(f"r3_task_prompts_{_variant}", f"""WITH {ROUTED_SQL}
SELECT packet_id, code, {_prompt_sql(_variant)} AS task_prompt FROM fx_routed WHERE code IS NOT NULL""")(_task_prompts(_variant))


def customer_registry(spark, sf):
    c = fx.table(spark, sf, "customer")
    return c.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("code"), F.array("c_mktsegment").alias("paths"))


@R.add("r4_register_tasks", """SELECT c_name AS name, c_mktsegment AS code FROM customer UNION ALL SELECT s_name, 'SUPPLY' FROM supplier""")
def _(spark, sf):
    new = fx.table(spark, sf, "supplier").select(
        F.col("s_name").alias("name"), F.lit("SUPPLY").alias("code"), F.array(F.lit("supply")).alias("paths"))
    return routing.register_tasks(customer_registry(spark, sf), new).select("name", "code")


@R.add("r4_update_tasks", """SELECT c_name AS name, CASE WHEN c_custkey % 10 = 0 THEN 'RETUNED' ELSE c_mktsegment END AS code FROM customer""")
def _(spark, sf):
    changes = fx.table(spark, sf, "customer").filter(F.col("c_custkey") % 10 == 0).select(
        F.col("c_name").alias("name"), F.lit("RETUNED").alias("code"), F.array(F.lit("new")).alias("paths"))
    return routing.update_tasks(customer_registry(spark, sf), changes).select("name", "code")


@R.add("r5_score", f"WITH {fx.SAMPLES_SQL} SELECT packet_id, {rules_sql(EXPERT_RULES, 'benign', 'data')} AS response FROM fx_samples")
def _(spark, sf):
    rows = fx.samples(spark, sf).select("packet_id", "data").withColumns(
        {"top_p": F.lit(0.8), "temperature": F.when(F.col("packet_id") % 2 == 0, 0.2).otherwise(0.9)})
    return routing.score(rows, expert, "data").select("packet_id", "response")


@R.add("r5_dual_stage", f"""WITH {ROUTED_SQL}, p AS (SELECT *, {_prompt_sql('cli')} AS task_prompt FROM fx_routed)
SELECT packet_id, task_response, CASE WHEN task_prompt IS NOT NULL THEN {rules_sql(EXPERT_RULES, 'benign', 'task_prompt')} END AS final_response,
  CASE WHEN code IS NULL THEN 'unknown task' ELSE 'success' END AS status FROM p""")
def _(spark, sf):
    done = routing.dual_stage(asked(spark, sf), routing.published_registry(spark), router, expert)
    return done.select("packet_id", "task_response", "final_response", "status")


# a fitted model is not a statement; tests hold it to properties
@R.add("r6_fit_classifier")
def _(spark, sf):
    rows = corpus.classification_rows(fx.corpus(spark, sf), label_ids(spark, sf)).filter(F.col("label_id").isNotNull())
    weights = corpus.class_weights(rows, "label_id", None).select("label_id", "weight")
    split = corpus.cap_split(rows.join(weights, "label_id"), "packet_id", "label_id", cap=None, ratio=0.8)
    train = split.filter("split = 'train'").select("packet_id", "text", "label_id", "weight")
    model = routing.fit_classifier(train, weight="weight", features=1024, iterations=5)
    test = routing.classify(model, split.filter("split = 'test'").select("packet_id", "text", "label_id"))
    return metrics.precision_recall_f1(
        metrics.class_counts(test, "label_id", "predicted_id"), average="macro")


# texts that name their class are told apart from the first round on, whatever the arithmetic
@R.add("r6_epoch_metrics", """SELECT epoch::INT AS epoch, count(*) AS n_test, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1
FROM events, range(1, 4) r(epoch) WHERE event_id % 5 = 0 GROUP BY ALL""")
def _(spark, sf):
    e = fx.table(spark, sf, "events")
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]
    label = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("event_type")).cast("int") - 1
    rows = e.select("event_id", label.alias("label_id"), F.concat_ws(" ", F.lit("kind"), "event_type", (F.col("event_id") % 7).cast("string")).alias("text"))
    train, test = rows.filter("event_id % 5 != 0"), rows.filter("event_id % 5 = 0")
    found = routing.epoch_metrics(train, test, "event_id", len(kinds), 3, batches=10)
    n = test.agg(F.count(F.lit(1)).alias("n_test"))
    return found.join(F.broadcast(n)).select("epoch", "n_test", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


RAW = "'  ' || event_type || ' <b> [[训练时间]] ' || props || chr(10)"


@R.add("r7_clean_response", rf"SELECT event_id, replace(regexp_replace({RAW}, '^\s+|\s+$', '', 'g'), '[[训练时间]]', '2023年') AS response FROM events")
def _(spark, sf):
    e = fx.table(spark, sf, "events")
    return e.select("event_id", routing.clean_response(F.expr(RAW.replace("chr(10)", "'\\n'"))).alias("response"))


@R.add("r7_clean_reasoning", rf"SELECT event_id, string_split(replace(regexp_replace({RAW}, '^\s+|\s+$', '', 'g'), '[[训练时间]]', '2023年'), '>')[-1] AS response FROM events")
def _(spark, sf):
    e = fx.table(spark, sf, "events")
    return e.select("event_id", routing.clean_response(F.expr(RAW.replace("chr(10)", "'\\n'")), True).alias("response"))


def screened(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "text")
    level = lambda m: (F.col("doc_id") % m).cast("int") * 2
    quiet = F.when(F.col("doc_id") % 3 == 0, level(4)).otherwise(F.lit(0))
    checks = [
        routing.severity_check("Content", {"Violence": quiet, "Hate": F.when(F.col("doc_id") % 5 == 0, level(3)).otherwise(F.lit(0))}),
        routing.check("Sensitive Topics", ~F.col("text").contains("@"), F.lit("has an address\n")),
    ]
    return routing.screen(d, checks)


SCREEN_SQL = r"""WITH s AS (
  SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 4) * 2 ELSE 0 END AS v, CASE WHEN doc_id % 5 = 0 THEN (doc_id % 3) * 2 ELSE 0 END AS h FROM documents
), r AS (SELECT *, v <= 0 AND h <= 0 AS calm, NOT contains(text, '@') AS clean FROM s),
names AS (SELECT * FROM (VALUES (0, '   Safe   '), (2, '   Low    '), (4, '  Medium  '), (6, '   High   ')) n(k, w)),
screened AS (SELECT doc_id, text, calm AND clean AND length(text) <= 1000 AS is_safe, length(text) > 1000 AS too_long, len(regexp_split_to_array(text, '\s+')) > 512 AS warn_long,
  CASE WHEN calm THEN '' ELSE '| Violence |   Hate   |' || chr(10) || '|' || (SELECT w FROM names WHERE k = v) || '|' || (SELECT w FROM names WHERE k = h) || '|' || chr(10) END
    || CASE WHEN clean THEN '' ELSE 'has an address' || chr(10) END AS report FROM r)"""


@R.add("r8_screen", SCREEN_SQL + " SELECT doc_id, is_safe, too_long, warn_long, report FROM screened")
def _(spark, sf):
    return screened(spark, sf).select("doc_id", "is_safe", "too_long", "warn_long", "report")


@R.add("r8_gate_prompts", SCREEN_SQL + " SELECT doc_id, text FROM screened WHERE is_safe")
def _(spark, sf):
    return routing.gate_prompts(screened(spark, sf)).select("doc_id", "text")


@R.add("r8_withhold", SCREEN_SQL + " SELECT doc_id, CASE WHEN is_safe THEN text END AS text FROM screened")
def _(spark, sf):
    return routing.withhold(screened(spark, sf)).select("doc_id", "text")


@R.add("r9_infill", "SELECT event_id, 'def ' || event_type || '(): ' || props || ' # ' || props AS text FROM events")
def _(spark, sf):
    e = fx.table(spark, sf, "events")
    hole = F.concat(F.lit("def "), "event_type", F.lit("(): <FILL_ME> # <FILL_ME>"))
    return e.select("event_id", routing.infill(hole, F.col("props")).alias("text"))


@R.add("r10_two_part_generation", f"""WITH {fx.PACKETS_SQL}, built AS {fx.frame_sql('fx_packets', '16 + length(payload_hex) // 2', '8', False, False)}
SELECT packet_id, frame_hex FROM built""")
def _(spark, sf):
    from wirecorpus.plans.packet_queries import _header_text

    p = fx.packets(spark, sf)
    headers = _header_text(p).select("packet_id", F.regexp_replace("header", r"\}?$", "}").alias("header"))
    payloads = p.select("packet_id", "payload_hex")
    parts = routing.two_part_generation(headers, payloads, "packet_id")
    parsed = synthesis.parse_headers(parts).filter("header_ok")
    return synthesis.build_frames(parsed).select("packet_id", F.lower(F.hex("frame")).alias("frame_hex"))
