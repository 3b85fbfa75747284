"""Views over the given tables that have the shape of packets, predictions, logs and requests.

Each view exists twice, as a DataFrame and as SQL text of a common table expression, so that a
query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wirecorpus.functions.octets import once, quotient
from wirecorpus.functions.ordering import FRAMES_PER_CHUNK, number_by_size, number_rows
from wirecorpus.operators.packets import decode_headers
from wirecorpus.operators.synthesis import build_frames
from wirecorpus.session import configure, spread

# events of one capture are numbered in chunks of ten minutes of event time
CHUNK_MICROS = 600_000_000
FLAG_CYCLE = [2, 16, 24, 17, 16]
SYN_OPTIONS = "020405b401030307"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Document columns for work that is heavy per text."""
    return spread(table(spark, sf_dir, "documents").select(*columns))


def _pick(key: Column, values: list, default=None) -> Column:
    expr = None
    for i, v in enumerate(values):
        expr = F.when(key == i, F.lit(v)) if expr is None else expr.when(key == i, F.lit(v))
    return expr if default is None else expr.otherwise(F.lit(default))


def _with_time(events: DataFrame) -> DataFrame:
    return events.withColumn("ts_us", F.unix_micros(F.col("ts").cast("timestamp")))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = number_by_size(
        _with_time(table(spark, sf_dir, "events")), ["event_type", "user_id"], ["ts_us", "event_id"],
        quotient(F.col("ts_us"), CHUNK_MICROS), "frame_no",
    )
    made = _packet_columns(numbered, ["frame_no"])
    return made.withColumns({
        "seq": F.lit(1000) + F.col("frame_no") * 10,
        "ack": F.when(F.col("flags") == 2, F.lit(0)).otherwise(F.lit(990) + F.col("frame_no") * 5).cast("bigint"),
        "options_hex": F.when(F.col("flags") == 2, F.lit(SYN_OPTIONS)).otherwise(F.lit("")),
    })


def packet_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same packets as they arrive, without a place in their capture."""
    return _packet_columns(_with_time(event_stream(spark, sf_dir)), [])


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _packet_columns(e: DataFrame, extra: list[str]) -> DataFrame:
    i, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    client = F.concat(F.lit("10.0."), (u % 200).cast("string"), F.lit(".5"))
    server = F.concat(F.lit("172.16."), (i % 3).cast("string"), F.lit(".10"))
    client_port = (F.lit(40000) + u % 1000).cast("int")
    server_port = (
        F.when(kind == "view", 80).when(kind == "click", 443).when(kind == "purchase", 8443)
        .when(kind == "signup", 22).when(kind == "error", 6667)
    )
    outward = i % 2 == 0
    text = F.concat(kind, F.lit(":"), F.col("props"), F.lit(";"))
    made = once(
        e, proto=F.when(i % 10 == 0, 1).when(i % 10 <= 3, 17).otherwise(6),
        src=F.when(outward, client).otherwise(server), dst=F.when(outward, server).otherwise(client),
        sport=F.when(outward, client_port).otherwise(server_port),
        dport=F.when(outward, server_port).otherwise(client_port), flags=_pick(i % 5, FLAG_CYCLE).cast("int"),
        payload_hex=F.when(i % 7 == 0, "").otherwise(
            F.repeat(F.lower(F.hex(F.encode(text, "UTF-8"))), (F.lit(1) + i % 60).cast("int"))
        ),
    )
    return made.select(
        i.alias("packet_id"),
        kind.alias("label"),
        F.when(kind == "error", "malware").otherwise("benign").alias("super_label"),
        F.concat(kind, F.lit("/"), u.cast("string"), F.lit(".pcap")).alias("capture"),
        *extra, "ts_us", "proto", "src", "dst", "sport", "dport", "payload_hex", "flags",
        (F.lit(1024) + u % 1000).cast("int").alias("window"),
        (i % 65536).cast("int").alias("ip_id"),
    )


PACKETS_SQL = f"""fx_packets AS (
  SELECT b.*, 1000 + frame_no * 10 AS seq,
    CASE WHEN flags = 2 THEN 0 ELSE 990 + frame_no * 5 END AS ack,
    CASE WHEN flags = 2 THEN '{SYN_OPTIONS}' ELSE '' END AS options_hex
  FROM (
    SELECT event_id AS packet_id, event_type AS label,
      CASE WHEN event_type = 'error' THEN 'malware' ELSE 'benign' END AS super_label,
      event_type || '/' || user_id || '.pcap' AS capture,
      row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS frame_no,
      epoch_us(ts) AS ts_us,
      CASE WHEN event_id % 10 = 0 THEN 1 WHEN event_id % 10 <= 3 THEN 17 ELSE 6 END AS proto,
      CASE WHEN event_id % 2 = 0 THEN '10.0.' || (user_id % 200) || '.5'
           ELSE '172.16.' || (event_id % 3) || '.10' END AS src,
      CASE WHEN event_id % 2 = 1 THEN '10.0.' || (user_id % 200) || '.5'
           ELSE '172.16.' || (event_id % 3) || '.10' END AS dst,
      CASE WHEN event_id % 2 = 0 THEN (40000 + user_id % 1000)::INT ELSE sp END AS sport,
      CASE WHEN event_id % 2 = 1 THEN (40000 + user_id % 1000)::INT ELSE sp END AS dport,
      CASE WHEN event_id % 7 = 0 THEN ''
           ELSE lower(hex(encode(repeat(event_type || ':' || props || ';', 1 + event_id % 60)))) END AS payload_hex,
      ([2, 16, 24, 17, 16])[(event_id % 5 + 1)::INT]::INT AS flags,
      (1024 + user_id % 1000)::INT AS "window",
      (event_id % 65536)::INT AS ip_id
    FROM (SELECT *, CASE event_type WHEN 'view' THEN 80 WHEN 'click' THEN 443 WHEN 'purchase' THEN 8443
                 WHEN 'signup' THEN 22 WHEN 'error' THEN 6667 END::INT AS sp FROM events)
  ) b
)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets with frames of true length; ICMP packets carry the payload alone."""
    built = build_frames(packets(spark, sf_dir), compat_len=False, other="raw")
    return built.select("packet_id", "label", "super_label", "capture", "frame_no", "ts_us", "frame")


def frames_ipv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The TCP and UDP frames carried by IP version 6: tags by packet id, some with extension headers."""
    h = F.lower(F.hex("frame"))
    ident = F.col("packet_id")
    transport = F.substr(h, F.lit(2 * 34 + 1))
    # hop-by-hop options of 8 and destination options of 16 octets, by turns
    kind = F.substring(h, 2 * 23 + 1, 2)
    one = F.concat(kind, F.lit("00010400000000"))
    two = F.concat(F.lit("3c00010400000000"), kind, F.lit("010104000000000104000000000000"))
    extension = F.when(ident % 3 == 0, one).when(ident % 3 == 1, two).otherwise("")
    first = F.when(ident % 3 == 2, kind).otherwise("00")
    tags = F.when(ident % 4 == 0, "8100000a").when(ident % 4 == 1, "88a8000a8100000b").otherwise("")
    address = lambda at: F.concat(F.lit("20010db80000000000000000"), F.substring(h, 2 * at + 1, 8))
    body = F.concat(extension, transport)
    head = F.concat(F.lit("60000000"), F.lpad(F.lower(F.hex(quotient(F.length(body), 2))), 4, "0"), first, F.lit("40"))
    whole = F.concat(F.substring(h, 1, 24), tags, F.lit("86dd"), head, address(26), address(30), body)
    return frames(spark, sf_dir).filter(kind.isin("06", "11")).withColumn("frame", F.unhex(whole))


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_headers(frames(spark, sf_dir))


# what a decoder must find in the frames above, worked out from the packet columns alone
WIRE_SQL = PACKETS_SQL + """, fx_wire AS (
  SELECT p.*, length(payload_hex) // 2 AS n_payload, length(options_hex) // 2 AS n_options,
    CASE proto WHEN 6 THEN 20 + length(options_hex) // 2 WHEN 17 THEN 8 ELSE 0 END AS l4_len,
    20 + CASE proto WHEN 6 THEN 20 + length(options_hex) // 2 WHEN 17 THEN 8 ELSE 0 END
      + length(payload_hex) // 2 AS ip_len
  FROM fx_packets p
), fx_ends AS (
  SELECT w.*, least(e_src, e_dst) AS end_a, greatest(e_src, e_dst) AS end_b, e_src <= e_dst AS from_a
  FROM (SELECT *,
    array_to_string(list_transform(string_split(src, '.'), lambda o: lpad(o, 3, '0')), '.')
      || ':' || lpad(sport::VARCHAR, 5, '0') AS e_src,
    array_to_string(list_transform(string_split(dst, '.'), lambda o: lpad(o, 3, '0')), '.')
      || ':' || lpad(dport::VARCHAR, 5, '0') AS e_dst
    FROM fx_wire WHERE proto IN (6, 17)) w
)"""

# the whole frame as hex, put together arithmetically
_HX = "lower(lpad(to_hex(({0})::BIGINT), {1}, '0'))"


def hx(expr: str, digits: int) -> str:
    return _HX.format(expr, digits)


def _ip_hex(col: str) -> str:
    return "||".join(hx(f"string_split({col}, '.')[{i}]::INT", 2) for i in range(1, 5))


def _ip_words(col: str) -> str:
    o = lambda i: f"string_split({col}, '.')[{i}]::BIGINT"
    return f"({o(1)}*256+{o(2)}+{o(3)}*256+{o(4)})"


def frame_sql(source: str, ip_len: str, udp_len: str, raw_icmp: bool, extra: bool) -> str:
    """SQL of (all columns of source, frame_hex); ``extra`` uses ip_id, seq, ack, flags and options."""
    ip_id, seq, ack, flags, window, options = (
        ("ip_id", "seq", "ack", "flags", '"window"', "options_hex") if extra
        else ("1", "0", "0", "2", "8192", "''")
    )
    proto = "proto" if raw_icmp else "CASE WHEN proto = 6 THEN 6 ELSE 17 END"
    fold = "65535 - ((({0}) & 65535) + (({0}) >> 16) & 65535) - (((({0}) & 65535) + (({0}) >> 16)) >> 16)"
    word = lambda x: f"({x})"
    option_words = (
        "coalesce(list_sum(list_transform(range(0, length(o)//4), "
        "lambda i: ('0x' || substr(o, i*4+1, 4))::BIGINT)), 0)"
    )
    return f"""(
  SELECT *, lower(
    'ffffffffffff0200000000010800' || '4500' || {hx('ipl', 4)} || {hx('idn', 4)} || '0000' || '40' || {hx('ptc', 2)}
    || {hx('ipsum', 4)} || {_ip_hex('src')} || {_ip_hex('dst')}
    || CASE WHEN ptc = 6 THEN {hx('sport', 4)} || {hx('dport', 4)} || {hx('sq', 8)} || {hx('ak', 8)}
         || {hx('(5 + length(o)//8)*4096 + fl', 4)} || {hx('wd', 4)} || {hx('tcpsum', 4)} || '0000' || o
       WHEN ptc = 17 THEN {hx('sport', 4)} || {hx('dport', 4)} || {hx('ul', 4)} || {hx('udpsum', 4)}
       ELSE '' END || payload_hex) AS frame_hex
  FROM (SELECT *, {fold.format('ip_total')} AS ipsum, {fold.format('tcp_total')} AS tcpsum,
          CASE WHEN ({fold.format('udp_total')}) = 0 THEN 65535 ELSE {fold.format('udp_total')} END AS udpsum
    FROM (SELECT *, 17664 + ipl + idn + 16384 + ptc + addr AS ip_total,
            addr + ptc + ipl - 20 + sport + dport + (sq >> 16) + (sq & 65535) + (ak >> 16) + (ak & 65535)
              + (5 + length(o)//8)*4096 + fl + wd + {option_words} AS tcp_total,
            addr + ptc + ipl - 20 + sport + dport + ul AS udp_total
      FROM (SELECT s.*, ({ip_len})::BIGINT AS ipl, ({udp_len})::BIGINT AS ul, ({ip_id})::BIGINT AS idn,
              ({seq})::BIGINT AS sq, ({ack})::BIGINT AS ak, ({flags})::BIGINT AS fl, ({window})::BIGINT AS wd,
              {options} AS o, ({proto})::BIGINT AS ptc, {_ip_words('src')} + {_ip_words('dst')} AS addr
            FROM {source} s))))"""


FRAMES_SQL = WIRE_SQL + ", fx_frames AS " + frame_sql(
    "fx_wire", "ip_len", "8 + n_payload", raw_icmp=True, extra=True
)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions_of(table(spark, sf_dir, "events"))


def predictions_of(e: DataFrame) -> DataFrame:
    h = F.md5(F.concat(F.lit("p|"), F.col("event_id").cast("string")))
    second, first = F.substring(h, 2, 1), F.substring(h, 1, 1)
    kind = F.col("event_type")
    guess = (
        F.when(second.isin("0", "1"), "view").when(second.isin("2", "3"), "error")
        .when(second == "4", "unseen").otherwise(kind)
    )
    dress = lambda c: (
        F.when(first == "f", F.concat(F.lit("The traffic category is likely to be recognized as "), c, F.lit(".")))
        .when(first == "e", F.concat(c, F.lit("。"))).otherwise(c)
    )
    return e.select(
        F.col("event_id").alias("sample_id"),
        F.concat(F.lit("Please generate a packet of "), kind, F.lit(" traffic.")).alias("prompt"),
        dress(kind).alias("target"),
        dress(guess).alias("response"),
        (F.col("event_id") % 4).cast("int").alias("epoch"),
        (F.lit(1.0) + F.col("event_id") % 3).cast("double").alias("weight"),
    )


PREDICTIONS_SQL = """fx_predictions AS (
  SELECT event_id AS sample_id, 'Please generate a packet of ' || event_type || ' traffic.' AS prompt,
    CASE f WHEN 'f' THEN 'The traffic category is likely to be recognized as ' || event_type || '.'
           WHEN 'e' THEN event_type || '。' ELSE event_type END AS target,
    CASE f WHEN 'f' THEN 'The traffic category is likely to be recognized as ' || g || '.'
           WHEN 'e' THEN g || '。' ELSE g END AS response,
    (event_id % 4)::INT AS epoch, (1.0 + event_id % 3)::DOUBLE AS weight
  FROM (SELECT *, substr(md5('p|' || event_id), 1, 1) AS f,
          CASE WHEN substr(md5('p|' || event_id), 2, 1) IN ('0', '1') THEN 'view'
               WHEN substr(md5('p|' || event_id), 2, 1) IN ('2', '3') THEN 'error'
               WHEN substr(md5('p|' || event_id), 2, 1) = '4' THEN 'unseen'
               ELSE event_type END AS g
        FROM events)
)"""


def train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        (F.col("user_id") % 5).cast("int").alias("run"),
        (i % 4).cast("int").alias("epoch"),
        i.alias("step"),
        F.when(i % 3 == 0, "eval").otherwise("train").alias("phase"),
        F.when(i % 50 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 100).alias("loss"),
        (F.col("value") / 10).alias("seconds"),
    )


LOG_SQL = """fx_log AS (
  SELECT (user_id % 5)::INT AS run, (event_id % 4)::INT AS epoch, event_id AS step,
    CASE WHEN event_id % 3 = 0 THEN 'eval' ELSE 'train' END AS phase,
    CASE WHEN event_id % 50 = 0 THEN 'NaN'::DOUBLE ELSE value / 100 END AS loss,
    value / 10 AS seconds
  FROM events
)"""


def http_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    part = lambda i: F.regexp_extract("url", r"^https?://([^/?#]+)([^?#]*)(\?[^#]*)?", i)
    return p.select(
        F.col("page_id").alias("request_id"),
        part(1).alias("host"),
        part(2).alias("path"),
        part(3).alias("query"),
        F.when(F.col("page_id") % 5 == 0, "malicious").otherwise("benign").alias("label"),
    )


HTTP_SQL = """fx_http AS (
  SELECT page_id AS request_id,
    regexp_extract(url, '^https?://([^/?#]+)([^?#]*)(\\?[^#]*)?', 1) AS host,
    regexp_extract(url, '^https?://([^/?#]+)([^?#]*)(\\?[^#]*)?', 2) AS path,
    regexp_extract(url, '^https?://([^/?#]+)([^?#]*)(\\?[^#]*)?', 3) AS query,
    CASE WHEN page_id % 5 = 0 THEN 'malicious' ELSE 'benign' END AS label
  FROM pages
)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as token ids: one id per blank-separated word."""
    d = documents(spark, sf_dir, "doc_id", "text")
    ids = F.transform(
        F.split("text", " "), lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int")
    )
    return d.select("doc_id", ids.alias("ids"))


TOKENS_SQL = """fx_tokens AS (
  SELECT doc_id, list_transform(string_split(text, ' '), lambda w: ('0x' || substr(md5(w), 1, 4))::INT) AS ids
  FROM documents
)"""


def dialogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line of a document as the sentence, the other lines as its corrections."""
    d = documents(spark, sf_dir, "doc_id", "text")
    lines = F.split("text", "\n")
    return d.select("doc_id", lines[0].alias("sentence"),
                    F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))).alias("corrections"))


PAIRS_SQL = """fx_pairs AS (
  SELECT doc_id, string_split(text, chr(10))[1] AS sentence, string_split(text, chr(10))[2:] AS corrections
  FROM documents
)"""


# dataset names by label; the last one is not in the task table
SAMPLE_DATASETS = {
    "click": "ustc-tfc-2016", "error": "iscx-botnet", "purchase": "dohbrw-2020",
    "signup": "iscx-tor-2016", "view": "open-captures",
}


def known_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that ``packets`` numbers: those with a capture and a time."""
    return _with_time(table(spark, sf_dir, "events")).dropna(subset=["event_type", "user_id", "ts_us"])


def _dealt(events: DataFrame) -> DataFrame:
    """Events dealt out before texts many times as long are made of them, however few tasks they came from."""
    return events.repartition("event_id")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets with a short data text. No place in the capture is in it, so nothing is numbered for it."""
    return samples_of(_packet_columns(_dealt(known_events(spark, sf_dir)), []))


def numbered_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with ``row_no``, their place in the class; numbered before the long texts are made."""
    numbered = number_rows(
        known_events(spark, sf_dir), ["event_type"], ["event_id"], quotient(F.col("event_id"), FRAMES_PER_CHUNK))
    return samples_of(_packet_columns(_dealt(numbered), ["row_no"]), "row_no")


def samples_of(p: DataFrame, *extra: str) -> DataFrame:
    name = _pick_text(F.col("label"), SAMPLE_DATASETS)
    payload = F.when(F.col("proto") == 6, F.concat(F.lit(", tcp.payload: "), "payload_hex")).otherwise("")
    data = F.concat(
        F.lit("ip.proto: "), F.col("proto").cast("string"), F.lit(", ip.src: "), "src",
        F.lit(", ip.dst: "), "dst", payload,
    )
    return p.select("packet_id", "label", "super_label", name.alias("dataset"), data.alias("data"), *extra)


def _pick_text(key: Column, values: dict[str, str]) -> Column:
    expr = F.lit(None).cast("string")
    for k, v in values.items():
        expr = F.when(key == k, F.lit(v)).otherwise(expr)
    return expr


_DATASETS_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SAMPLE_DATASETS.items())
SAMPLES_SQL = PACKETS_SQL + f""", fx_samples AS (
  SELECT packet_id, label, super_label, CASE label {_DATASETS_SQL} END AS dataset,
    'ip.proto: ' || proto || ', ip.src: ' || src || ', ip.dst: ' || dst
      || CASE WHEN proto = 6 THEN ', tcp.payload: ' || payload_hex ELSE '' END AS data,
    CASE label WHEN 'click' THEN 'EMD' WHEN 'error' THEN 'BND' WHEN 'purchase' THEN 'MDD'
      WHEN 'signup' THEN 'TBD' ELSE 'EAC' END AS task
  FROM fx_packets
)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection samples of all packets, uncut."""
    return corpus_of(samples(spark, sf_dir))


def corpus_of(s: DataFrame) -> DataFrame:
    from wirecorpus.operators.corpus import detection_samples, dispatch_task

    return detection_samples(dispatch_task(s))


# fixed values: role markers of the chat format
ROLE_IDS = {"system": 151335, "user": 151336, "assistant": 151337}


def dialog_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns as a role marker followed by one id per word."""
    d = dialogs(spark, sf_dir)
    words = F.transform(
        F.split("text", " "), lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int")
    )
    marker = _pick_text(F.col("role"), {k: str(v) for k, v in ROLE_IDS.items()}).cast("int")
    return d.select("conv_id", "turn", "role", F.concat(F.array(marker), words).alias("ids"))


DIALOG_TOKENS_SQL = """fx_dialog_tokens AS (
  SELECT conv_id, turn, role,
    list_concat([CASE role WHEN 'system' THEN 151335 WHEN 'user' THEN 151336 ELSE 151337 END],
      list_transform(string_split(text, ' '), lambda w: ('0x' || substr(md5(w), 1, 4))::INT)) AS ids
  FROM conversations
), fx_stream AS (
  SELECT conv_id, turn, role, t, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) + 1 AS pos
  FROM (SELECT conv_id, turn, role, unnest(ids) AS t, generate_subscripts(ids, 1) AS i FROM fx_dialog_tokens)
)"""


# fixed values: what the fixture asks per label; the last question names no task
ASKS = {
    "click": "Find malware in this capture. ", "error": "Is this a botnet? ",
    "purchase": "Check the web request. ", "signup": "Which Tor behavior is this? ",
    "view": "Say something nice. ",
}


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with a data part; every ninth holds a second marker, every tenth no data at all."""
    return requests_of(samples(spark, sf_dir))


def requests_of(s: DataFrame) -> DataFrame:
    i = F.col("packet_id")
    ask = F.when(i % 13 == 0, "Look for an APT attack. ").otherwise(_pick_text(F.col("label"), ASKS))
    data = F.when(i % 10 == 0, "").otherwise(F.concat(
        F.lit("<packet>: "), "data", F.when(i % 9 == 0, " <packet>: tail").otherwise("")))
    return s.select("packet_id", "label", F.concat(ask, data).alias("prompt"))


_ASKS_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ASKS.items())
REQUESTS_SQL = SAMPLES_SQL + f""", fx_requests AS (
  SELECT packet_id, label, (CASE WHEN packet_id % 13 = 0 THEN 'Look for an APT attack. ' ELSE CASE label {_ASKS_SQL} END END)
    || CASE WHEN packet_id % 10 = 0 THEN '' ELSE '<packet>: ' || data
       || CASE WHEN packet_id % 9 = 0 THEN ' <packet>: tail' ELSE '' END END AS prompt
  FROM fx_samples
), fx_asked AS (
  SELECT packet_id, label, prompt, split_part(prompt, '<packet>', 1) AS human_instruction,
    CASE WHEN contains(prompt, '<packet>') THEN substr(prompt, strpos(prompt, '<packet>')) ELSE '<packet>' END AS traffic_data
  FROM fx_requests
)"""


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as references, and an altered copy with one word repeated as responses."""
    d = documents(spark, sf_dir, "doc_id", "text")
    return d.select(
        "doc_id", F.col("text").alias("target"),
        F.concat(F.translate(F.replace("text", F.lit("en"), F.lit("on")), ".", "!"), F.lit(" la la")).alias("response"),
    )


TEXT_PAIRS_SQL = """fx_text_pairs AS (
  SELECT doc_id, text AS target, translate(replace(text, 'en', 'on'), '.', '!') || ' la la' AS response FROM documents
)"""
