"""Queries for readers, writers and text expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweir.catalog.base import HDFS_MASKED, K, register
from logweir.functions import sequences as S, text as T
from logweir.operators import dictionaries as D, features as FE, parsing as P, sessions as SE, splits as SP
from logweir.operators.ordering import dense_position, with_neighbours
from logweir.plans import views as V
from logweir.session import fresh_path
from logweir.sources import readers as R, writers as W

FIELDS = ["Label", "Epoch", "Date", "Time", "Node", "Content"]
FIELD_SQL = "label AS \"Label\", epoch AS \"Epoch\", date_ AS \"Date\", time_ AS \"Time\", node AS \"Node\", content AS \"Content\""


def joined(col) -> F.Column:
    return F.array_join(col, "|")


# --- sources and sinks -------------------------------------------------------------------------


@register("read_log_lines", "l1", "SELECT row_number() OVER (ORDER BY line_no) - 1 AS line_no, line FROM l1")
def read_log_lines(spark, sf):
    path = W.write_log_text(V.raw_lines(spark, sf), fresh_path(spark, "lines"))
    return R.read_log_lines(spark, path)


@register("parse_log_format", "l1p", f"SELECT line_no, line_id, {FIELD_SQL} FROM l1p")
def parse_log_format(spark, sf):
    return V.structured_log(spark, sf)


@register("read_structured_csv", "l1p", f"SELECT {FIELD_SQL} FROM l1p")
def read_structured_csv(spark, sf):
    path = W.write_structured_csv(V.matched_log(spark, sf).select(*FIELDS), fresh_path(spark, "structured-csv"))
    return R.read_structured_csv(spark, path, FIELDS)


@register("read_label_table", "s1h", "SELECT session_id, label FROM s1h")
def read_label_table(spark, sf):
    path = W.write_label_table(SE.session_heads(V.sessions(spark, sf)), fresh_path(spark, "labels"))
    return R.read_label_table(spark, path)


SEQ_SQL = """SELECT dense_rank() OVER (ORDER BY first_line, session_id) - 1 AS session_id, pos, event,
    CASE WHEN pos = 0 THEN 0.0 ELSE CAST(ts_sec - lag(ts_sec) OVER (PARTITION BY s1.session_id ORDER BY pos) AS DOUBLE) END AS dt, n_events FROM s1"""


def timed_sessions(spark, sf):
    near = with_neighbours(V.sessions(spark, sf), ["session_id"], "pos", {"_before": ("ts_sec", -1)})
    return near.withColumn("dt", F.coalesce((F.col("ts_sec") - F.col("_before")).cast("double"), F.lit(0.0))).drop("_before")


@register("read_sequences", "s1", SEQ_SQL)
def read_sequences(spark, sf):
    path = W.write_sequence_text(timed_sessions(spark, sf), ["event", "dt"], fresh_path(spark, "sequences"), ["first_line"])
    return R.read_sequences(spark, path)


@register("write_sequences", "s1", "SELECT session_id, CAST(0 AS BIGINT) AS part, string_agg(event, ' ' ORDER BY pos) AS line FROM s1 GROUP BY session_id")
def write_sequences(spark, sf):
    return R.read_table(spark, W.write_sequences(V.sessions(spark, sf), ["event"], fresh_path(spark, "sequence-table")))


@register("write_structured", "l1m", "SELECT line_no, content, template, substr(md5(template), 1, 8) AS event_id FROM l1m")
def write_structured(spark, sf):
    lines = V.masked_log(spark, sf).select("line_no", F.col("Content").alias("content"), "template")
    lines = lines.withColumn("event_id", T.template_id(F.col("template")))
    folder = fresh_path(spark, "structured")
    path, _ = W.write_structured(lines, D.template_occurrences(lines, line="line_no"), folder)
    return R.read_table(spark, path)


@register("write_session_tables", "s1", "SELECT session_id, pos, event, line_id FROM s1")
def write_session_tables(spark, sf):
    a, b = W.write_session_tables(V.sessions(spark, sf), fresh_path(spark, "sessions"))
    return SE.zip_parallel_sequences(R.read_table(spark, a), R.read_table(spark, b))


@register("write_content_corpus", "l1p", "SELECT line_id - 1 AS line_idx, content FROM l1p")
def write_content_corpus(spark, sf):
    log = V.structured_log(spark, sf).withColumn("line_idx", F.col("line_id") - 1)
    return R.read_table(spark, W.write_content_corpus(log, fresh_path(spark, "corpus")))


@register("write_model_tables", "l1m", """SELECT event_id, row_number() OVER (ORDER BY occurrences DESC, event_id) AS event_rank, occurrences
    FROM (SELECT substr(md5(template), 1, 8) AS event_id, count(*) AS occurrences FROM l1m GROUP BY ALL)""")
def write_model_tables(spark, sf):
    ranks = D.event_rank(D.template_occurrences(V.masked_log(spark, sf), line="line_no"))
    paths = W.write_model_tables({"ranks": ranks}, fresh_path(spark, "model"))
    return R.read_table(spark, paths["ranks"]).select("event_id", "event_rank", "occurrences")


@register("write_results", "s1h", "SELECT session_id, n_events AS total_logkey, label AS deepsvdd_label FROM s1h")
def write_results(spark, sf):
    heads = SE.session_heads(V.sessions(spark, sf))
    out = heads.select("session_id", F.col("n_events").alias("total_logkey"), F.col("label").alias("deepsvdd_label"))
    return R.read_table(spark, W.write_results(out, fresh_path(spark, "results")))


# --- text expressions --------------------------------------------------------------------------


@register("replace_non_ascii", "d1", r"SELECT doc_id, line_pos, regexp_replace(msg, '[^\x00-\x7F]+', '<NASCII>', 'g') AS msg FROM d1")
def replace_non_ascii(spark, sf):
    return V.messages(spark, sf).withColumn("msg", T.replace_non_ascii(F.col("msg")))


@register("mask_variables", "l1p", f"SELECT line_no, {HDFS_MASKED} AS masked FROM l1p")
def mask_variables(spark, sf):
    return V.matched_log(spark, sf).select("line_no", T.mask_variables(F.col("Content"), T.HDFS_MASKS).alias("masked"))


@register("mask_variables_bgl", "l1p", r"""SELECT line_no, regexp_replace(regexp_replace(regexp_replace(content, '(0x)[0-9a-fA-F]+', '<*>', 'g'),
    '\d+.\d+.\d+.\d+', '<*>', 'g'), '\d+', '<*>', 'g') AS masked FROM l1p""")
def mask_variables_bgl(spark, sf):
    return V.matched_log(spark, sf).select("line_no", T.mask_variables(F.col("Content"), T.BGL_MASKS).alias("masked"))


@register("mask_variables_thunderbird", "d1", r"""SELECT doc_id, line_pos, regexp_replace(regexp_replace(regexp_replace(regexp_replace(msg,
    '(0x)[0-9a-fA-F]+', '<*>', 'g'), '\d+\.\d+\.\d+\.\d+', '<*>', 'g'),
    '(Warning: we failed to resolve data source name )[\w\s]+', '\1<*>', 'g'), '\d+', '<*>', 'g') AS masked FROM d1""")
def mask_variables_thunderbird(spark, sf):
    return V.messages(spark, sf).select("doc_id", "line_pos", T.mask_variables(F.col("msg"), T.THUNDERBIRD_MASKS).alias("masked"))


@register("tokenize_ws", "d1t", "SELECT doc_id, line_pos, array_to_string(toks, '|') AS tokens, len(toks) AS n FROM d1t")
def tokenize_ws(spark, sf):
    toks = T.tokenize_ws(F.col("msg"))
    return V.messages(spark, sf).select("doc_id", "line_pos", joined(toks).alias("tokens"), F.size(toks).cast("bigint").alias("n"))


PUNCT_SQL = r"""list_filter(regexp_split_to_array(msg, '[!"#$%&''()+,\-./:;=?@\[\]^_`{|}~]'), lambda x: trim(x) <> '')"""


@register("tokenize_punct", "d1", f"SELECT doc_id, line_pos, array_to_string({PUNCT_SQL}, chr(1)) AS tokens FROM d1")
def tokenize_punct(spark, sf):
    return V.messages(spark, sf).select("doc_id", "line_pos", F.array_join(T.tokenize_punct(F.col("msg")), "\x01").alias("tokens"))


@register("constant_tokens", "l1m", r"SELECT line_no, array_to_string(list_filter(string_split(template, ' '), lambda x: x <> '<*>'), '|') AS constants FROM l1m")
def constant_tokens(spark, sf):
    log = V.masked_log(spark, sf)
    return log.select("line_no", joined(T.constant_tokens(T.tokenize_ws(F.col("template")))).alias("constants"))


@register("has_number", "d1t", r"SELECT doc_id, line_pos, len(list_filter(toks, lambda x: regexp_matches(x, '\d'))) AS numbered FROM d1t")
def has_number(spark, sf):
    return V.messages(spark, sf).select(
        "doc_id", "line_pos", F.size(F.filter(T.tokenize_ws(F.col("msg")), T.has_number)).cast("bigint").alias("numbered")
    )


@register("template_id", "d1", "SELECT doc_id, line_pos, substr(md5(msg), 1, 8) AS event_id FROM d1")
def template_id(spark, sf):
    return V.messages(spark, sf).select("doc_id", "line_pos", T.template_id(F.col("msg")).alias("event_id"))


@register("collapse_wildcards", "l1m", r"""SELECT line_no, regexp_replace(t, '(<\*>)+', '<*>', 'g') AS collapsed,
    regexp_replace(regexp_replace(t, '(<\*>)+', '<*>', 'g'), '(<\*> )+<\*>', '<*>', 'g') AS merged
    FROM (SELECT line_no, replace(template, '<*>:', '<*><*> <*>') AS t FROM l1m)""")
def collapse_wildcards(spark, sf):
    log = V.masked_log(spark, sf).withColumn("t", F.replace("template", F.lit("<*>:"), F.lit("<*><*> <*>")))
    return log.select("line_no", T.collapse_wildcards(F.col("t")).alias("collapsed"), T.collapse_wildcards(F.col("t"), True).alias("merged"))


@register("placeholder_to_unk", "l1m", r"""SELECT line_no, replace(hdfs_template, '<*>', '[UNK]') AS every,
    replace(replace(replace(hdfs_template, 'blk_<*>', chr(1)), '<*>', '[UNK]'), chr(1), 'blk_<*>') AS kept FROM l1m""")
def placeholder_to_unk(spark, sf):
    log = V.masked_log(spark, sf, T.HDFS_MASKS)
    return log.select("line_no", T.placeholder_to_unk(F.col("template")).alias("every"), T.placeholder_to_unk(F.col("template"), True).alias("kept"))


@register("extract_session_keys", "l1k", "SELECT line_no, session_id FROM l1k")
def extract_session_keys(spark, sf):
    return V.matched_log(spark, sf).select("line_no", F.explode(T.extract_session_keys(F.col("Content"))).alias("session_id"))


@register("binarize_label", "l1p", "SELECT line_no, CAST(label <> '-' AS INTEGER) AS y FROM l1p")
def binarize_label(spark, sf):
    return V.matched_log(spark, sf).select("line_no", T.binarize_label(F.col("Label")).alias("y"))


@register("parse_log_time", "l1p", "SELECT line_no, CAST(epoch AS BIGINT) AS ts_sec FROM l1p")
def parse_log_time(spark, sf):
    stamp = F.concat_ws(" ", "Date", "Time")
    return V.matched_log(spark, sf).select("line_no", T.parse_log_time(stamp, "yyyy.MM.dd HH:mm:ss").alias("ts_sec"))


# Every line's values are known from the event it was built from; suffixes add one block id each.
PARAMS_SQL = r"""SELECT l1m.line_no, concat_ws('|', CASE event_type
      WHEN 'click' THEN {click} WHEN 'view' THEN {view} WHEN 'signup' THEN {signup} WHEN 'purchase' THEN {purchase} ELSE {error} END,
      CASE WHEN l1m.line_no % 50 = 0 THEN {mirror} END, CASE WHEN l1m.line_no % 60 = 0 THEN {u} END) AS params
    FROM l1m JOIN (SELECT event_id AS line_no, user_id AS u, {k} AS k, event_type FROM events) USING (line_no)"""
LITERAL_SQL = PARAMS_SQL.format(
    k=K, u="u || ''", mirror="(u + 1) || ''", click="u || '|10.0.0.' || k || '|' || (5000 + line_no % 1000) || '|10.0.1.' || k || '|50010'",
    view="u || '|10.0.0.' || k", signup="'10.0.0.' || k || '|50010|' || u || '|' || (100 * k)", purchase="(k % 3) || '|' || u",
    error="u || '|/data/dir' || (k % 5) || '/f' || k",
)
# The pattern form removes block digits, and two wildcards one character apart are one value.
PATTERN_SQL = PARAMS_SQL.format(
    k=K, u="''", mirror="''", click="'|10.0.0.' || k || ':' || (5000 + line_no % 1000) || '|10.0.1.' || k || ':50010'",
    view="'|10.0.0.' || k", signup="'10.0.0.' || k || ':50010||' || (100 * k)", purchase="(k % 3) || '|'",
    error="'|/data/dir' || (k % 5) || '/f' || k",
)


@register("extract_params_literal", "l1m", LITERAL_SQL)
def extract_params_literal(spark, sf):
    return V.masked_log(spark, sf).select("line_no", joined(T.extract_params_literal(F.col("Content"), F.col("template"))).alias("params"))


@register("extract_params_regex", "l1m", PATTERN_SQL)
def extract_params_regex(spark, sf):
    return V.masked_log(spark, sf).select("line_no", joined(T.extract_params_regex(F.col("Content"), F.col("template"))).alias("params"))


@register("param_arity_check", "l1m", r"""SELECT line_no, len(string_split(template, '<*>')) - 1 AS slots,
    len(string_split(regexp_replace(template, '<\*>:<\*>', '<*>', 'g'), '<*>')) - 1 AS found FROM l1m WHERE contains(template, '<*>:<*>')""")
def param_arity_check(spark, sf):
    log = V.masked_log(spark, sf)
    log = log.select("line_no", "template", T.extract_params_regex(F.col("Content"), F.col("template")).alias("params"))
    bad = P.param_arity_check(log)
    return bad.select("line_no", T.placeholder_count(F.col("template")).cast("bigint").alias("slots"), F.size("params").cast("bigint").alias("found"))


PAIR_VIEW = """WITH pairs AS (SELECT a.doc_id, a.line_pos, a.toks AS a, b.toks AS b FROM d1t a JOIN d1t b
    ON a.doc_id = b.doc_id AND b.line_pos = a.line_pos + 1)"""


def message_pairs(spark, sf, cut: bool = False):
    """Each message with the next one of its text; ``cut`` brings both to the shorter length."""
    m = V.messages(spark, sf).withColumn("toks", T.tokenize_ws(F.col("msg")))
    nxt = m.select("doc_id", (F.col("line_pos") - 1).alias("line_pos"), F.col("toks").alias("b"))
    pairs = m.select("doc_id", "line_pos", F.col("toks").alias("a")).join(nxt, ["doc_id", "line_pos"])
    if cut:
        n = F.least(F.size("a"), F.size("b"))
        pairs = pairs.where(n > 0).withColumns({"a": F.slice("a", F.lit(1), n), "b": F.slice("b", F.lit(1), n)})
    return pairs


CUT_VIEW = PAIR_VIEW + """, cut AS (SELECT doc_id, line_pos, a[1:least(len(a), len(b))] AS a, b[1:least(len(a), len(b))] AS b FROM pairs
    WHERE least(len(a), len(b)) > 0)"""


@register("template_similarity", "d1t", CUT_VIEW + """ SELECT doc_id, line_pos,
    round(len(list_filter(list_zip(a, b), lambda p: p[1] = p[2] AND p[1] <> '<*>')) / CAST(len(a) AS DOUBLE), 6) AS similarity,
    len(list_filter(a, lambda x: x = '<*>')) AS wildcards FROM cut""")
def template_similarity(spark, sf):
    p = message_pairs(spark, sf, cut=True)
    return p.select(
        "doc_id", "line_pos", F.round(S.template_similarity(F.col("a"), F.col("b")), 6).alias("similarity"),
        S.wildcard_count(F.col("a")).cast("bigint").alias("wildcards"),
    )


@register("merge_template", "d1t", CUT_VIEW + """ SELECT doc_id, line_pos,
    array_to_string(list_transform(list_zip(a, b), lambda p: CASE WHEN p[1] = p[2] THEN p[1] ELSE '<*>' END), ' ') AS merged FROM cut""")
def merge_template(spark, sf):
    p = message_pairs(spark, sf, cut=True)
    return p.select("doc_id", "line_pos", F.array_join(S.merge_template(F.col("a"), F.col("b")), " ").alias("merged"))


@register("token_overlap", "d1t", PAIR_VIEW + """ SELECT doc_id, line_pos, len(list_intersect(a, b)) AS shared,
    CAST(len(list_intersect(a, b)) >= 0.5 * len(a) AS INTEGER) AS candidate FROM pairs""")
def token_overlap(spark, sf):
    p = message_pairs(spark, sf).withColumn("shared", S.token_overlap(F.col("a"), F.col("b")).cast("bigint"))
    return p.select("doc_id", "line_pos", "shared", (F.col("shared") >= 0.5 * F.size("a")).cast("int").alias("candidate"))


@register("tokens_contained", "d1t", PAIR_VIEW + """ SELECT doc_id, line_pos, CAST(len(a) >= 0.5 * len(b) AND
    len(list_filter(a, lambda x: x <> '<*>' AND NOT list_contains(b, x))) = 0 AS INTEGER) AS contained FROM pairs""")
def tokens_contained(spark, sf):
    p = message_pairs(spark, sf)
    return p.select("doc_id", "line_pos", S.tokens_contained(F.col("a"), F.col("b")).cast("int").alias("contained"))


@register("is_number_token", "d1t", r"""SELECT doc_id, line_pos, len(list_filter(toks, lambda x: regexp_matches(x,
    '^[+-]?((\d+(_\d+)*\.?|\d+(_\d+)*\.\d+(_\d+)*|\.\d+(_\d+)*)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$'))) AS floats,
    len(list_filter(toks, lambda x: regexp_matches(x, '^[+-]?(\d+(_\d+)*\.?|\d+(_\d+)*\.\d+(_\d+)*|\.\d+(_\d+)*)([eE][+-]?\d+)?$')
      AND try_cast(replace(x, '_', '') AS DOUBLE) = floor(try_cast(replace(x, '_', '') AS DOUBLE)))) AS ints FROM d1t""")
def is_number_token(spark, sf):
    toks = T.tokenize_ws(F.col("msg"))
    return V.messages(spark, sf).select(
        "doc_id", "line_pos", F.size(F.filter(toks, T.is_float)).cast("bigint").alias("floats"), F.size(F.filter(toks, T.is_int)).cast("bigint").alias("ints")
    )


# --- order and dictionaries --------------------------------------------------------------------


@register("line_index", "l1p", "SELECT line_no, line_id - 1 AS line_idx FROM l1p")
def line_index(spark, sf):
    return P.line_index(V.matched_log(spark, sf).select("line_no"))


@register("take_prefix", "l1p", "SELECT line_no, line_id - 1 AS line_idx FROM l1p WHERE line_id - 1 < floor((SELECT count(*) FROM l1p) * CAST(0.25 AS DOUBLE))")
def take_prefix(spark, sf):
    numbered = dense_position(V.matched_log(spark, sf).select("line_no"), ["line_no"], (), "line_idx", "total")
    return SP.take_prefix(numbered, ratio=0.25, size="total").drop("total")


@register("prefix_anomaly_rate", "l1p", """SELECT count(*) AS lines, round(avg(CAST(label <> '-' AS INTEGER)), 6) AS abnormal_rate
    FROM l1p WHERE line_id - 1 < 5000""")
def prefix_anomaly_rate(spark, sf):
    log = P.line_index(V.matched_log(spark, sf).select("line_no", T.binarize_label(F.col("Label")).alias("label")))
    return FE.prefix_anomaly_rate(log, 5000).withColumn("abnormal_rate", F.round("abnormal_rate", 6))


@register("template_occurrences", "l1m", """SELECT template AS event_template, count(*) AS occurrences, min(line_no) AS first_line,
    substr(md5(template), 1, 8) AS event_id FROM l1m GROUP BY template""")
def template_occurrences(spark, sf):
    return D.template_occurrences(V.masked_log(spark, sf), line="line_no")


RANK_SQL = """WITH ranks AS (SELECT event, row_number() OVER (ORDER BY n DESC, event) AS event_rank
    FROM (SELECT event, count(*) AS n FROM e1 WHERE label = 0 GROUP BY event) WHERE n > 1)
    SELECT line_id, coalesce(event_rank, -1) AS event_rank FROM e1 LEFT JOIN ranks USING (event)"""


@register("event_rank", "e1", RANK_SQL)
def event_rank(spark, sf):
    e = V.timed_events(spark, sf)
    counts = e.where(F.col("label") == 0).groupBy("event").agg(F.count(F.lit(1)).alias("occurrences")).where(F.col("occurrences") > 1)
    ranks = D.event_rank(counts, "event")
    return D.apply_event_rank(e, ranks, "event").select("line_id", "event_rank")


@register("distinct_events", "e1", "SELECT event, count(*) AS n FROM e1 GROUP BY event")
def distinct_events(spark, sf):
    return D.distinct_events(V.timed_events(spark, sf))


@register("sessionize_by_key", "l1k", """SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY line_no) - 1 AS pos, line_no,
    substr(md5(template), 1, 8) AS event_id, count(*) OVER (PARTITION BY session_id) AS n_events FROM l1k""")
def sessionize_by_key(spark, sf):
    log = V.masked_log(spark, sf).withColumn("event_id", T.template_id(F.col("template")))
    found = SE.sessionize_by_key(log.select("line_no", "Content", "event_id"), "Content", "line_no")
    return found.select("session_id", "pos", "line_no", "event_id", "n_events")


@register("gather_content", "l1k", "SELECT k.session_id, k.line_no, p.content FROM l1k k JOIN l1p p USING (line_no)")
def gather_content(spark, sf):
    log = V.matched_log(spark, sf).select("line_no", F.col("Content").alias("content"))
    keyed = log.select("line_no", F.explode(T.extract_session_keys(F.col("content"))).alias("session_id"))
    return SE.gather_content(keyed, log, "line_no").select("session_id", "line_no", "content")
