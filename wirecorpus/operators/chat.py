"""Chat messages, prompt formats of dialogs, and token examples of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wirecorpus.functions.ordering import frame_chunk, join_pieces, running
from wirecorpus.functions.strings import replace_all, strip
from wirecorpus.operators.catalog import (
    CHAT_ASSISTANT_ID, CHAT_EOS_ID, CHAT_PREFIX_IDS, IGNORE_ID, INST_CLOSE, INST_OPEN,
    ROUND_OPEN, SYS_CLOSE, SYS_OPEN,
)

DATA_START = "\n<packet>:"
PAYLOAD_START = ", tcp.payload:"
MASKED_ANSWER = "-"


# --- instruction rows to messages --------------------------------------------------------------

def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def to_messages(df: DataFrame) -> DataFrame:
    """Add ``messages`` (system, user, assistant); rows without the data marker get none."""
    parts = F.split("instruction", DATA_START)
    data = F.split(F.try_element_at(parts, F.lit(2)), PAYLOAD_START)[0]
    user = F.concat(F.lit(DATA_START[1:]), data, F.lit("."))
    messages = F.array(
        _message("system", parts[0]), _message("user", user), _message("assistant", F.col("output"))
    )
    return df.withColumn("messages", F.when(data.isNotNull(), messages))


def convertible(df: DataFrame) -> DataFrame:
    return df.filter(F.col("messages").isNotNull())


def message_rejects(df: DataFrame, ident: str) -> DataFrame:
    """Rows that cannot be converted; keeps the id and the reason, not the content."""
    return df.filter(F.col("messages").isNull()).select(ident, F.lit("no data marker").alias("reason"))


def mask_answers(df: DataFrame, answer: str = MASKED_ANSWER) -> DataFrame:
    """Replace the third message's content, which is the answer."""
    masked = F.transform("messages", lambda m, i: F.struct(
        m["role"].alias("role"), F.when(i == 2, F.lit(answer)).otherwise(m["content"]).alias("content"),
    ))
    return df.withColumn("messages", masked)


def clean_tool_schemas(df: DataFrame, messages: str = "messages") -> DataFrame:
    """Drop null tool parameters in system messages, and tools in any other message.

    Messages carry ``tools: ARRAY<STRUCT<function: STRUCT<parameters: STRUCT<properties: MAP>>>>``;
    all other fields of messages, tools, functions and parameters stay as they are.
    """
    stated = lambda tool: tool.withField(
        "function.parameters.properties",
        F.map_filter(tool["function"]["parameters"]["properties"], lambda _, v: v.isNotNull()))
    return df.withColumn(messages, F.transform(messages, lambda m: m.withField(
        "tools", F.when(m["role"] == "system", F.transform(m["tools"], stated)))))


# --- dialog rows to prompts --------------------------------------------------------------------
# Dialogs are rows (conv_id, turn, role, text). A prompt is rendered turn by turn, so a dialog of
# any length is spread over tasks; only the joining of bounded parts collects.

def round_prompts(df: DataFrame) -> DataFrame:
    """Numbered rounds of questions and answers; a question without an answer stays open."""
    turns = df.filter(F.col("role").isin("user", "assistant"))
    asked = F.when(F.col("role") == "user", 1).otherwise(0)
    rows = running(
        turns, ["conv_id"], ["turn"], frame_chunk(F.col("turn")),
        round=("sum", asked), position=("row_number", None),
    )
    head, tail = ROUND_OPEN.replace("{i}", "%d").split("{q}")
    question = F.concat(F.format_string(head, F.col("round")), F.col("text"), F.lit(tail.replace("{a}", "")))
    answer = F.concat(F.col("text"), F.lit("\n\n"))
    pieces = rows.select(
        "conv_id", (F.col("position") - 1).alias("position"),
        F.when(F.col("role") == "user", question).otherwise(answer).alias("prompt"),
    )
    return join_pieces(pieces, ["conv_id"], "position", "prompt")


def instruction_chat(df: DataFrame, sanitize: bool = False) -> DataFrame:
    """Rows with the piece each turn adds to the prompt, and the dialog's validity.

    A leading system text is folded into the first user turn. A dialog is valid when roles then
    alternate from user and end with user. ``sanitize`` removes the markers from user text.
    """
    base = running(
        df, ["conv_id"], ["turn"], frame_chunk(F.col("turn")),
        _n=("row_number", None), _rows=("size", None), _first=("first", F.col("role")),
        _lead=("first", F.col("text")),
    )
    folded = F.when(F.col("_first") == "system", 1).otherwise(0)
    base = base.withColumn("position", F.col("_n") - 1 - folded)
    expected = F.when(F.col("position") % 2 == 0, "user").otherwise("assistant")
    wrong = (F.col("position") >= 0) & (F.col("role") != expected)
    last_open = (F.col("_n") == F.col("_rows")) & (F.col("role") != "user")
    base = base.withColumns({"_wrong": wrong.cast("int"), "_ends_badly": last_open.cast("int")})
    base = running(
        base, ["conv_id"], ["turn"], frame_chunk(F.col("turn")),
        _bad_order=("total", F.col("_wrong")), _bad_end=("total", F.col("_ends_badly")),
    )
    reason = (
        F.when(F.col("_bad_order") > 0, "roles do not alternate from user")
        .when(F.col("_bad_end") > 0, "does not end with user")
    )
    clean = lambda c: replace_all(
        c, [(m, "") for m in (INST_OPEN, INST_CLOSE, SYS_OPEN.strip(), SYS_CLOSE.strip())]
    ) if sanitize else c
    content = clean(F.col("text"))
    system = F.when(
        (F.col("position") == 0) & (folded == 1), F.concat(F.lit(SYS_OPEN), "_lead", F.lit(SYS_CLOSE))
    ).otherwise("")
    ask = F.concat(F.lit(INST_OPEN + " "), strip(F.concat(system, content)), F.lit(" " + INST_CLOSE))
    reply = F.concat(F.lit(" "), strip(F.col("text")), F.lit(" "))
    return base.select(
        "conv_id", "position", F.when(F.col("role") == "user", ask).otherwise(reply).alias("prompt"),
        reason.alias("reason"),
    ).filter(F.col("position") >= 0)


def instruction_chat_prompts(df: DataFrame, sanitize: bool = False) -> DataFrame:
    valid = instruction_chat(df, sanitize).filter(F.col("reason").isNull())
    return join_pieces(valid, ["conv_id"], "position", "prompt")


def instruction_chat_rejects(df: DataFrame) -> DataFrame:
    return instruction_chat(df).filter(F.col("reason").isNotNull()).groupBy("conv_id").agg(
        F.max("reason").alias("reason")
    )


# --- token examples of conversations -----------------------------------------------------------
# Input rows are (conv_id, turn, role, ids). Token offsets come first, so that only tokens inside
# the length limit are ever collected.

def _token_rows(df: DataFrame, limit: int) -> DataFrame:
    prefix = len(CHAT_PREFIX_IDS)
    marker_back = F.array_position(F.reverse("ids"), F.lit(CHAT_ASSISTANT_ID))
    sized = df.filter(F.size("ids") > 0).withColumns({
        "_n": F.size("ids"), "_marker": F.when(marker_back > 0, F.size("ids") - marker_back),
    })
    rows = running(
        sized, ["conv_id"], ["turn"], frame_chunk(F.col("turn")),
        _start=("sum_before", F.col("_n")),
    )
    rows = rows.withColumn("_at", F.lit(prefix) + F.col("_start"))
    return rows.withColumns({
        "_marker_at": F.col("_at") + F.col("_marker"),
        "_kept": F.slice("ids", F.lit(1), F.greatest(F.lit(limit) - F.col("_at"), F.lit(1)).cast("int")),
    })


def chat_loss_examples(
    df: DataFrame, max_input: int, max_output: int, combine: bool = False
) -> DataFrame:
    """Token ids and labels of a conversation, cut to ``max_input + max_output + 1``.

    Loss falls on assistant messages, or with ``combine`` on all behind the last assistant marker.
    The mask is one position to the right of the tokens it was made for, as published.
    """
    limit = max_input + max_output + 1
    rows = _token_rows(df, limit)
    if combine:
        rows = running(
            rows, ["conv_id"], ["turn"], frame_chunk(F.col("turn")),
            _last_marker=("max_all", F.col("_marker_at")),
        )
        loss = F.transform("_kept", lambda _, i: F.col("_at") + i > F.col("_last_marker"))
    else:
        loss = F.transform("_kept", lambda _: ~F.col("role").isin("system", "user", "observation"))
    # a kept message has a token inside the limit, so a group has at most ``limit`` of them
    kept = rows.filter(F.col("_at") < limit).select("conv_id", "turn", "_kept", loss.alias("_loss"))
    listed = F.array_sort(F.collect_list(F.struct("turn", "_kept", "_loss")))
    grouped = kept.groupBy("conv_id").agg(listed.alias("_m"))
    prefix = F.array(*[F.lit(i) for i in CHAT_PREFIX_IDS])
    ids = F.concat(prefix, F.flatten(F.transform("_m", lambda m: m["_kept"])), F.array(F.lit(CHAT_EOS_ID)))
    mask = F.concat(
        F.array_repeat(F.lit(False), 1 + len(CHAT_PREFIX_IDS)),
        F.flatten(F.transform("_m", lambda m: m["_loss"])),
    )
    both = grouped.select("conv_id", F.slice(ids, 1, limit).alias("input_ids"), mask.alias("_mask"))
    labels = F.transform(
        "input_ids", lambda t, i: F.when(F.get("_mask", i), t).otherwise(F.lit(IGNORE_ID))
    )
    return both.select("conv_id", "input_ids", labels.alias("labels"))


def multi_turn_examples(df: DataFrame, max_input: int, max_output: int) -> DataFrame:
    """One example per assistant turn whose context fits, with everything before as context.

    The tokens of a conversation, up to the limit, are put together once; a context is their
    beginning.
    """
    rows = _token_rows(df, max_input).filter(F.col("_at") < max_input)
    output = F.slice(F.concat(F.slice("ids", F.lit(2), F.size("ids")), F.array(F.lit(CHAT_EOS_ID))), 1, max_output)
    turn = F.struct("turn", "_at", F.slice("ids", 1, 1).alias("first"), output.alias("output_ids"))
    grouped = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "_kept"))).alias("_m"),
        F.collect_list(F.when(F.col("role") == "assistant", turn)).alias("_turns"))
    stream = _stream(F.col("_m"))
    examples = grouped.select("conv_id", stream.alias("_ids"), F.explode("_turns").alias("e"))
    context = F.slice("_ids", F.lit(1), F.col("e._at").cast("int"))
    return examples.select(
        "conv_id", "e.turn", F.concat(context, "e.first").alias("input_ids"), F.col("e.output_ids").alias("output_ids"))


def _stream(pieces: Column) -> Column:
    prefix = F.array(*[F.lit(i) for i in CHAT_PREFIX_IDS])
    return F.concat(prefix, F.flatten(F.transform(pieces, lambda m: m["_kept"])))


def combined_examples(df: DataFrame, max_input: int, max_output: int) -> DataFrame:
    """One example per conversation with an assistant marker: what is from the last marker on is the output.

    As published, the input is the whole conversation cut to ``max_input`` with its first token once
    more behind it, so it holds the output where it fits.
    """
    rows = running(
        _token_rows(df, max_input), ["conv_id"], ["turn"], frame_chunk(F.col("turn")),
        _last=("max_all", F.col("_marker_at")))
    at, last = F.col("_at"), F.col("_last")
    begin = F.greatest(last - at, F.lit(0))
    wanted = F.least(F.size("ids") - begin, last + max_output - at - begin)
    piece = F.slice("ids", (begin + 1).cast("int"), F.greatest(wanted, F.lit(0)).cast("int"))
    # only tokens of the input or of the output are collected
    needed = rows.filter(last.isNotNull() & ((at < max_input) | ((at + F.size("ids") > last) & (at < last + max_output))))
    listed = F.array_sort(F.collect_list(F.struct(
        "turn", F.when(at < max_input, F.col("_kept")).otherwise(F.slice("ids", 1, 0)).alias("_kept"), piece.alias("_out"))))
    grouped = needed.groupBy("conv_id").agg(listed.alias("_m"))
    output = F.concat(F.flatten(F.transform("_m", lambda m: m["_out"])), F.array(F.lit(CHAT_EOS_ID)))
    return grouped.select(
        "conv_id",
        F.concat(F.slice(_stream(F.col("_m")), 1, max_input), F.array(F.lit(CHAT_PREFIX_IDS[0]))).alias("input_ids"),
        F.slice(output, 1, max_output).alias("output_ids"))


def multi_turn_dropped(df: DataFrame, max_input: int) -> DataFrame:
    """Assistant turns whose context is too long to make an example."""
    rows = _token_rows(df, max_input)
    return rows.filter((F.col("role") == "assistant") & (F.col("_at") >= max_input)).select(
        "conv_id", "turn", F.col("_at").alias("context_tokens")
    )
