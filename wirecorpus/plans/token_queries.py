"""Chat formats, token examples, packing and vocabulary over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirecorpus.functions.octets import quotient
from wirecorpus.operators import chat, examples, vocabulary
from wirecorpus.operators.catalog import SPECIAL_TOKENS
from wirecorpus.plans import fixtures as fx
from wirecorpus.plans.corpus_queries import CORPUS_SQL, key_sql
from wirecorpus.plans.registry import Registry

R = Registry()
EOS, PAD = 2, 0


def joined(name: str):
    """An array column as blank-separated text, so that both engines give the same value."""
    return F.array_join(F.transform(name, lambda x: x.cast("string")), " ").alias(name)


# rows without the marker: every seventh instruction is a flow sample
MIXED_SQL = "CASE WHEN packet_id % 7 = 0 THEN replace(instruction, '<packet>:', '<flow>:') ELSE instruction END"
MESSAGES_SQL = CORPUS_SQL + f""", fx_mixed AS (
  SELECT packet_id, {MIXED_SQL} AS instruction, output FROM fx_corpus
), fx_messages AS (
  SELECT packet_id, split_part(instruction, chr(10) || '<packet>:', 1) AS system,
    '<packet>:' || split_part(split_part(instruction, chr(10) || '<packet>:', 2), ', tcp.payload:', 1) || '.' AS user_text,
    output AS assistant
  FROM fx_mixed WHERE contains(instruction, chr(10) || '<packet>:')
)"""


def mixed(spark, sf):
    return chat.to_messages(fx.corpus(spark, sf).withColumn("instruction", F.expr(MIXED_SQL)))


def flat(df):
    content = lambda i: F.col("messages")[i]["content"]
    return df.select("packet_id", content(0).alias("system"), content(1).alias("user_text"), content(2).alias("assistant"))


@R.add("c12_to_messages", f"WITH {MESSAGES_SQL} SELECT * FROM fx_messages")
def _(spark, sf):
    return flat(chat.convertible(mixed(spark, sf)))


@R.add("c12_message_rejects", f"WITH {MESSAGES_SQL} SELECT packet_id, 'no data marker' AS reason FROM fx_mixed WHERE packet_id NOT IN (SELECT packet_id FROM fx_messages)")
def _(spark, sf):
    return chat.message_rejects(mixed(spark, sf), "packet_id")


@R.add("c13_mask_answers", f"WITH {MESSAGES_SQL} SELECT packet_id, system, user_text, '-' AS assistant FROM fx_messages")
def _(spark, sf):
    return flat(chat.mask_answers(chat.convertible(mixed(spark, sf))))


@R.add("t4_fertility", f"""WITH {CORPUS_SQL}, texts AS (SELECT instruction AS text FROM fx_corpus UNION ALL SELECT output FROM fx_corpus)
SELECT count(*) AS n_texts, avg(len(string_split(text, ' '))) AS by_space, avg(length(text)) AS by_char FROM texts WHERE length(text) + 1 >= 10""")
def _(spark, sf):
    from wirecorpus.operators.corpus import vocabulary_corpus

    texts = vocabulary_corpus(fx.corpus(spark, sf), "packet_id")
    return vocabulary.fertility(texts, {"by_space": F.split("text", " "), "by_char": F.split("text", "")})


@R.add("t4_fertility_first_lines", """SELECT count(*) AS n_texts, avg(len(string_split(text, ' '))) AS by_space, avg(length(text)) AS by_char
FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 100) WHERE length(text) + 1 >= 10""")
def _(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    return vocabulary.fertility(
        docs, {"by_space": F.split("text", " "), "by_char": F.split("text", "")}, order="doc_id", first=100)


@R.add("t5_with_specials", f"""WITH base AS (SELECT piece, row_number() OVER (ORDER BY piece) - 1 AS id
  FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS piece FROM documents))
SELECT piece, id, 'base' AS kind FROM base
UNION ALL SELECT s.piece, (SELECT max(id) FROM base) + s.i, 'special'
FROM (VALUES {', '.join(f"({i + 1}, '{t}')" for i, t in enumerate(SPECIAL_TOKENS))}) s(i, piece)""")
def _(spark, sf):
    words = fx.table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("piece"))
    return vocabulary.with_specials(vocabulary.number_pieces(words))


@R.add("t6_round_prompts", """WITH t AS (
  SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS r
  FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, 0 AS part, string_agg(CASE WHEN role = 'user'
  THEN '[Round ' || r || ']' || chr(10) || chr(10) || '问：' || text || chr(10) || chr(10) || '答：'
  ELSE text || chr(10) || chr(10) END, '' ORDER BY turn) AS prompt
FROM t GROUP BY conv_id""")
def _(spark, sf):
    return chat.round_prompts(fx.dialogs(spark, sf))


PAIR_TOKENS_SQL = fx.TOKENS_SQL + ", fx_pair_tokens AS (SELECT doc_id, ids AS source_ids, ids[3:] AS target_ids FROM fx_tokens)"


def pair_tokens(spark, sf):
    return fx.tokens(spark, sf).select(
        "doc_id", F.col("ids").alias("source_ids"),
        F.slice("ids", F.lit(3), F.greatest(F.size("ids") - 2, F.lit(0))).alias("target_ids"))


@R.add("t7_supervised_examples", f"""WITH {PAIR_TOKENS_SQL}, cut AS (SELECT doc_id, source_ids[:1024] AS a, target_ids[:32] AS b FROM fx_pair_tokens)
SELECT doc_id,
  array_to_string(list_concat(a, b, [2], list_transform(range(0, 1056 - len(a) - len(b)), lambda i: 0)), ' ') AS input_ids,
  array_to_string(list_concat(list_transform(a, lambda i: -100), list_transform(b, lambda i: CASE WHEN i = 0 THEN -100 ELSE i END), [2],
    list_transform(range(0, 1056 - len(a) - len(b)), lambda i: -100)), ' ') AS labels FROM cut""")
def _(spark, sf):
    return examples.supervised_examples(pair_tokens(spark, sf), EOS, PAD).select("doc_id", joined("input_ids"), joined("labels"))


@R.add("t8_evaluation_examples", f"""WITH {PAIR_TOKENS_SQL}
SELECT doc_id, array_to_string(source_ids[:1024], ' ') AS input_ids,
  array_to_string(list_transform(target_ids[:32], lambda i: CASE WHEN i = 0 THEN -100 ELSE i END), ' ') AS labels FROM fx_pair_tokens""")
def _(spark, sf):
    return examples.evaluation_examples(pair_tokens(spark, sf), PAD).select("doc_id", joined("input_ids"), joined("labels"))


@R.add("t9_masked_examples", f"""WITH {fx.TOKENS_SQL}, e AS (SELECT doc_id, list_concat(ids, [2])[:224] AS w, least(len(ids), 20) AS p FROM fx_tokens)
SELECT doc_id, array_to_string(list_concat(w, list_transform(range(0, 224 - len(w)), lambda i: 0)), ' ') AS input_ids,
  array_to_string(list_concat(list_transform(w[:p], lambda i: -100), w[p + 1:], list_transform(range(0, 224 - len(w)), lambda i: -100)), ' ') AS labels,
  len(w) AS n_real FROM e""")
def _(spark, sf):
    rows = fx.tokens(spark, sf).select("doc_id", F.slice("ids", 1, 20).alias("prompt_ids"), F.col("ids").alias("example_ids"))
    made = examples.masked_examples(rows, EOS, 224)
    real = F.aggregate("attention_mask", F.lit(0.0), lambda a, x: a + x).cast("bigint")
    return made.select("doc_id", joined("input_ids"), joined("labels"), real.alias("n_real"))


def _pack_sql(size: int, strict: bool) -> str:
    keep = ">" if strict else ">="
    return f"""WITH {fx.TOKENS_SQL}, s AS (
  SELECT t, row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, count(*) OVER () AS n
  FROM (SELECT doc_id, unnest(ids) AS t, generate_subscripts(ids, 1) AS i FROM fx_tokens))
SELECT pos // {size} AS piece, string_agg(t::VARCHAR, ' ' ORDER BY pos) AS input_ids, count(*) AS n_tokens
FROM s GROUP BY 1, n HAVING n {keep} (pos // {size} + 1) * {size}"""


def _pack(size: int, strict: bool):
    def query(spark, sf):
        packed = examples.pack_tokens(fx.tokens(spark, sf), "doc_id", size=size, strict=strict)
        return packed.select("piece", joined("input_ids"), F.size("labels").cast("bigint").alias("n_tokens"))
    return query


R.add("t10_pack_tokens", _pack_sql(2048, False))(_pack(2048, False))
R.add("t11_pack_tokens_strict", _pack_sql(4096, True))(_pack(4096, True))

LIMIT = 60 + 20 + 1


def _loss_sql(label: str) -> str:
    return f"""WITH {fx.DIALOG_TOKENS_SQL}, ends AS (
  SELECT conv_id, max(pos) + 1 AS e, max(CASE WHEN t = 151337 THEN pos END) AS m FROM fx_stream GROUP BY 1
), all_tokens AS (
  SELECT conv_id, pos, t, role FROM fx_stream
  UNION ALL SELECT conv_id, e, 151336, NULL FROM ends
  UNION ALL SELECT conv_id, 0, 151331, NULL FROM ends UNION ALL SELECT conv_id, 1, 151333, NULL FROM ends
), shifted AS (
  SELECT a.*, m, lag(role) OVER (PARTITION BY a.conv_id ORDER BY pos) AS before FROM all_tokens a JOIN ends USING (conv_id)
)
SELECT conv_id, string_agg(t::VARCHAR, ' ' ORDER BY pos) AS input_ids,
  string_agg((CASE WHEN {label} THEN t ELSE -100 END)::VARCHAR, ' ' ORDER BY pos) AS labels
FROM shifted WHERE pos < {LIMIT} GROUP BY conv_id"""


@R.add("t12_chat_loss_examples", _loss_sql("before = 'assistant'"))
def _(spark, sf):
    return chat.chat_loss_examples(fx.dialog_tokens(spark, sf), 60, 20).select("conv_id", joined("input_ids"), joined("labels"))


@R.add("t12_chat_loss_combined", _loss_sql("pos - 1 > m"))
def _(spark, sf):
    return chat.chat_loss_examples(fx.dialog_tokens(spark, sf), 60, 20, combine=True).select(
        "conv_id", joined("input_ids"), joined("labels"))


TURNS_SQL = fx.DIALOG_TOKENS_SQL + """, turns AS (
  SELECT conv_id, turn, role, min(pos) AS first_pos, list(t ORDER BY pos) AS ids FROM fx_stream GROUP BY ALL
)"""


@R.add("t13_multi_turn_examples", f"""WITH {TURNS_SQL}
SELECT x.conv_id, x.turn,
  '151331 151333 ' || coalesce((SELECT string_agg(c.t::VARCHAR, ' ' ORDER BY c.pos) FROM fx_stream c WHERE c.conv_id = x.conv_id AND c.turn < x.turn) || ' ', '')
    || x.ids[1] AS input_ids,
  array_to_string(list_concat(x.ids[2:], [151336])[:40], ' ') AS output_ids
FROM turns x WHERE role = 'assistant' AND first_pos < 200""")
def _(spark, sf):
    return chat.multi_turn_examples(fx.dialog_tokens(spark, sf), 200, 40).select(
        "conv_id", "turn", joined("input_ids"), joined("output_ids"))


@R.add("t13_combined_examples", f"""WITH {TURNS_SQL}, l AS (SELECT conv_id, max(pos) AS last FROM fx_stream WHERE t = 151337 GROUP BY 1)
SELECT conv_id, array_to_string(list_concat(list_concat([151331, 151333], list(t ORDER BY pos))[:200], [151331]), ' ') AS input_ids,
  array_to_string(list_concat(coalesce(list(t ORDER BY pos) FILTER (pos >= last), []), [151336])[:40], ' ') AS output_ids
FROM fx_stream JOIN l USING (conv_id) GROUP BY conv_id""")
def _(spark, sf):
    return chat.combined_examples(fx.dialog_tokens(spark, sf), 200, 40).select(
        "conv_id", joined("input_ids"), joined("output_ids"))


@R.add("t13_multi_turn_dropped", f"WITH {TURNS_SQL} SELECT conv_id, turn, first_pos AS context_tokens FROM turns WHERE role = 'assistant' AND first_pos >= 200")
def _(spark, sf):
    return chat.multi_turn_dropped(fx.dialog_tokens(spark, sf), 200)


@R.add("t14_clean_tool_schemas", """SELECT event_id,
  CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'kind=' || event_type ELSE 'kind=' || event_type || ',note=' || props END ELSE '' END AS system_tools,
  0 AS user_tools, CASE WHEN event_id % 2 = 0 THEN 'finds|kind' ELSE '' END AS kept FROM events""")
def _(spark, sf):
    e = fx.table(spark, sf, "events")
    note = F.when(F.col("event_id") % 3 != 0, F.col("props"))
    properties = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("note"), note).alias("properties")
    parameters = F.struct(F.lit("object").alias("type"), properties, F.array(F.lit("kind")).alias("required"))
    function = F.struct(F.lit("lookup").alias("name"), F.lit("finds").alias("description"), parameters.alias("parameters"))
    tool = F.array(F.struct(F.lit("function").alias("type"), function.alias("function")))
    role = F.when(F.col("event_id") % 2 == 0, "system").otherwise("observation")
    messages = F.array(
        F.struct(role.alias("role"), F.lit("tools").alias("content"), tool.alias("tools")),
        F.struct(F.lit("user").alias("role"), F.lit("ask").alias("content"), tool.alias("tools")))
    cleaned = chat.clean_tool_schemas(e.select("event_id", messages.alias("messages")))
    called = F.col("messages")[0]["tools"][0]["function"]
    entries = F.map_entries(called["parameters"]["properties"])
    text = F.array_join(F.transform(F.array_sort(entries), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    count = F.coalesce(F.size(F.col("messages")[1]["tools"]), F.lit(0))
    return cleaned.select("event_id", F.coalesce(text, F.lit("")).alias("system_tools"),
                          F.greatest(count, F.lit(0)).alias("user_tools"),
                          F.concat_ws("|", called["description"], called["parameters"]["required"][0]).alias("kept"))


INST_SQL = r"""WITH t AS (
  SELECT *, first_value(role) OVER w AS lead_role, first_value(text) OVER w AS lead_text, row_number() OVER w AS n,
    count(*) OVER (PARTITION BY conv_id) AS m FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), p AS (SELECT *, n - 1 - CASE WHEN lead_role = 'system' THEN 1 ELSE 0 END AS pos FROM t),
c AS (SELECT conv_id, CASE WHEN bool_or(pos >= 0 AND role <> CASE WHEN pos % 2 = 0 THEN 'user' ELSE 'assistant' END)
  THEN 'roles do not alternate from user' WHEN bool_or(n = m AND role <> 'user') THEN 'does not end with user' END AS reason FROM p GROUP BY 1)"""


@R.add("t15_instruction_chat", INST_SQL + r"""
SELECT p.conv_id, 0 AS part, string_agg(CASE WHEN role = 'user' THEN '[INST] ' || regexp_replace(
    CASE WHEN pos = 0 AND lead_role = 'system' THEN '<<SYS>>' || chr(10) || lead_text || chr(10) || '<</SYS>>' || chr(10) || chr(10) ELSE '' END || text,
    '^\s+|\s+$', '', 'g') || ' [/INST]'
  ELSE ' ' || regexp_replace(text, '^\s+|\s+$', '', 'g') || ' ' END, '' ORDER BY turn) AS prompt
FROM p JOIN c USING (conv_id) WHERE reason IS NULL AND pos >= 0 GROUP BY 1""")
def _(spark, sf):
    return chat.instruction_chat_prompts(fx.dialogs(spark, sf))


@R.add("t15_instruction_chat_rejects", INST_SQL + " SELECT conv_id, reason FROM c WHERE reason IS NOT NULL")
def _(spark, sf):
    return chat.instruction_chat_rejects(fx.dialogs(spark, sf))


@R.add("t16_pad_batches", f"""WITH {fx.TOKENS_SQL}, m AS (SELECT *, doc_id // 8 AS batch, (max(len(ids)) OVER (PARTITION BY doc_id // 8) + 15) // 16 * 16 AS n FROM fx_tokens)
SELECT doc_id, batch, array_to_string(list_concat(ids, list_transform(range(0, n - len(ids)), lambda i: 0)), ' ') AS ids FROM m""")
def _(spark, sf):
    rows = fx.tokens(spark, sf).withColumn("batch", quotient(F.col("doc_id"), 8))
    return examples.pad_batches(rows, PAD, ids="ids", multiple=16).select("doc_id", "batch", joined("ids"))


@R.add("t17_left_pad", f"""WITH {fx.TOKENS_SQL}, m AS (SELECT *, greatest(304 - len(ids), 0) AS n FROM fx_tokens)
SELECT doc_id, array_to_string(list_concat(list_transform(range(0, n), lambda i: 0), ids), ' ') AS ids,
  array_to_string(list_concat(list_transform(range(0, n), lambda i: 0), list_transform(ids, lambda i: 1)), ' ') AS attention_mask,
  array_to_string(list_concat(list_transform(range(0, n), lambda i: 0), range(0, len(ids))), ' ') AS position_ids FROM m""")
def _(spark, sf):
    return examples.left_pad(fx.tokens(spark, sf), PAD, 300, ids="ids", multiple=16).select(
        "doc_id", joined("ids"), joined("attention_mask"), joined("position_ids"))


@R.add("t18_assign_batches", f"""WITH r AS (SELECT event_id, row_number() OVER (ORDER BY {key_sql('batches', 'event_id')}, event_id) - 1 AS k, count(*) OVER () AS n FROM events),
s AS (SELECT event_id, k % 7 AS shard, k // 7 // 16 AS batch, (n - k % 7 + 6) // 7 AS in_shard FROM r)
SELECT event_id, shard, batch FROM s WHERE batch < in_shard // 16""")
def _(spark, sf):
    return examples.assign_batches(fx.table(spark, sf, "events").select("event_id"), "event_id", 7, 16)


@R.add("t18_assign_batches_padded", f"""WITH r AS (SELECT event_id, row_number() OVER (ORDER BY {key_sql('batches', 'event_id')}, event_id) - 1 AS k, count(*) OVER () AS n FROM events),
p AS (SELECT event_id, k, (n + 6) // 7 * 7 AS n FROM r UNION ALL SELECT event_id, n + k, (n + 6) // 7 * 7 FROM r WHERE k < (n + 6) // 7 * 7 - n),
s AS (SELECT event_id, k % 7 AS shard, k // 7 // 16 AS batch, n // 7 AS in_shard FROM p)
SELECT event_id, shard, batch FROM s WHERE batch < in_shard // 16""")
def _(spark, sf):
    return examples.assign_batches(fx.table(spark, sf, "events").select("event_id"), "event_id", 7, 16, pad=True)


# learning a vocabulary is iterative; brute force on a small corpus is the check (tests)
@R.add("t1_train_vocabulary")
def _(spark, sf):
    docs = fx.documents(spark, sf, "text")
    vocab, _ = vocabulary.train_vocabulary(docs, vocab_size=240)
    return vocab


@R.add("t2_encode")
def _(spark, sf):
    docs = fx.documents(spark, sf, "doc_id", "text")
    vocab, merges = vocabulary.train_vocabulary(docs, vocab_size=160)
    return vocabulary.encode(docs, vocab, merges).select("doc_id", joined("ids"))


# decoding what was encoded gives the texts back with single blanks
@R.add("t3_decode", r"SELECT doc_id, regexp_replace(trim(text), '\s+', ' ', 'g') AS text FROM documents")
def _(spark, sf):
    docs = fx.documents(spark, sf, "doc_id", "text")
    vocab, merges = vocabulary.train_vocabulary(docs, vocab_size=160)
    return vocabulary.decode(vocabulary.encode(docs, vocab, merges).select("doc_id", "ids"), vocab).select("doc_id", "text")
