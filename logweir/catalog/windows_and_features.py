"""Queries for windows, dictionaries, features, splits and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweir.catalog.base import VIEWS, register
from logweir.detectors import context_counts as C
from logweir.functions import sequences as S
from logweir.functions.vectors import sigmoid_nonzero
from logweir.operators import candidates as CA, dictionaries as D, evaluation as E, features as FE, ordering as O, sessions as SE, splits as SP, windows as W
from logweir.plans import flows, views as V
from logweir.session import materialise

WINDOW, STEP = 3600, 900


def text_of(col) -> F.Column:
    return F.array_join(F.transform(col, lambda x: x.cast("string")), " ")


def r6(col) -> F.Column:
    return F.round(col, 6)


# --- order -------------------------------------------------------------------------------------


@register("delta_time", "e1", "SELECT line_id, CAST(ts_sec - coalesce(lag(ts_sec) OVER (ORDER BY line_id), ts_sec) AS DOUBLE) AS delta_t FROM e1")
def delta_time(spark, sf):
    return W.delta_time(V.timed_events(spark, sf)).select("line_id", "delta_t")


@register("running_max_time", "e1u", "SELECT line_id, max(ts_sec) OVER (ORDER BY line_id ROWS UNBOUNDED PRECEDING) AS time_so_far FROM e1u")
def running_max_time(spark, sf):
    return O.running_max(V.unsorted_events(spark, sf), "ts_sec", ["line_id"], "time_so_far").select("line_id", "time_so_far")


# --- time windows ------------------------------------------------------------------------------


def sliding_sql(view: str) -> str:
    return f"""WITH m AS (SELECT *, row_number() OVER (ORDER BY line_id) - 1 AS idx,
      max(ts_sec) OVER (ORDER BY line_id ROWS UNBOUNDED PRECEDING) AS m FROM {view}),
    b AS (SELECT min_by(ts_sec, line_id) AS t0, max(ts_sec) AS t1 FROM {view}),
    ks AS (SELECT unnest(generate_series(0, greatest(0, CAST(floor((t1 - t0 - {WINDOW}) / {STEP}.0) AS BIGINT) + 1))) AS k, t0 FROM b),
    w AS (SELECT k, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n_events, max(label) AS label
      FROM ks JOIN m ON m.m >= t0 + k * {STEP} AND m.m < t0 + k * {STEP} + {WINDOW} GROUP BY k),
    u AS (SELECT min(k) AS k, first_idx, last_idx, any_value(n_events) AS n_events, any_value(label) AS label FROM w GROUP BY first_idx, last_idx)
    """


@register("sliding_time_window", "e1", sliding_sql("e1") + "SELECT * FROM u")
def sliding_time_window(spark, sf):
    return W.sliding_time_windows(V.timed_events(spark, sf), WINDOW, STEP)


@register("sliding_time_window_unsorted", "e1u", sliding_sql("e1u") + "SELECT * FROM u")
def sliding_time_window_unsorted(spark, sf):
    return W.sliding_time_windows(V.unsorted_events(spark, sf), WINDOW, STEP)


@register("sliding_time_window_events", "e1", sliding_sql("e1") + """SELECT k AS session_id, m.idx - first_idx AS pos, n_events, u.label AS session_label, line_id, event,
    CAST(CASE WHEN m.idx = first_idx THEN 0 ELSE ts_sec - prev END AS DOUBLE) AS delta_t
    FROM u JOIN (SELECT *, lag(ts_sec) OVER (ORDER BY line_id) AS prev FROM m) m ON m.idx BETWEEN first_idx AND last_idx""")
def sliding_time_window_events(spark, sf):
    w = W.sliding_time_window_events(V.timed_events(spark, sf), WINDOW, STEP)
    return w.select("session_id", "pos", "n_events", "session_label", "line_id", "event", "delta_t")


@register("tumbling_time_window", "e1", """WITH b AS (SELECT (ts_sec // 60) * 60 AS bin_start, count(*) AS n_events, max(label) AS label FROM e1 GROUP BY 1)
    SELECT g.bin_start, coalesce(n_events, 0) AS n_events, label
    FROM (SELECT unnest(generate_series((SELECT min(bin_start) FROM b), (SELECT max(bin_start) FROM b), 60)) AS bin_start) g LEFT JOIN b USING (bin_start)""")
def tumbling_time_window(spark, sf):
    return W.tumbling_time_windows(V.timed_events(spark, sf), 60)


@register("tumbling_time_window_events", "e1", """SELECT (ts_sec // 3600) * 3600 AS bin_start, row_number() OVER (PARTITION BY ts_sec // 3600 ORDER BY line_id) - 1 AS pos,
    count(*) OVER (PARTITION BY ts_sec // 3600) AS n_events, line_id, event FROM e1""")
def tumbling_time_window_events(spark, sf):
    return W.tumbling_time_window_events(V.timed_events(spark, sf), 3600).select("bin_start", "pos", "n_events", "line_id", "event")


COUNT_SQL = f"""WITH m AS (SELECT *, row_number() OVER (ORDER BY line_id) - 1 AS idx,
      max(ts_sec) OVER (ORDER BY line_id ROWS UNBOUNDED PRECEDING) AS m FROM e1u),
    b AS (SELECT min_by(ts_sec, line_id) AS t0, max(ts_sec) AS t1 FROM e1u),
    e AS (SELECT t0, t1, (SELECT max_by(ts_sec, line_id) FROM m, b WHERE m < t0 + {WINDOW}) AS e0 FROM b),
    ks AS (SELECT k, CASE WHEN k = 0 THEN t0 + {WINDOW} ELSE greatest(t0 + {WINDOW}, e0 + k * {STEP}) END AS hi, t0 + k * {STEP} AS lo0
      FROM e, (SELECT unnest(generate_series(0, (SELECT (t1 - e0) // {STEP} + 1 FROM e))) AS k) WHERE t1 >= t0 + {WINDOW}),
    kw AS (SELECT k, hi, least(lo0, coalesce(lag(hi) OVER (ORDER BY k), lo0)) AS lo FROM ks)
    """


@register("window_event_count_matrix", "e1u", COUNT_SQL + "SELECT k, event, count(*) AS n FROM kw JOIN m ON m.m >= lo AND m.m < hi GROUP BY k, event")
def window_event_count_matrix(spark, sf):
    return W.window_event_counts(V.unsorted_events(spark, sf), WINDOW, STEP)[1]


@register("window_event_count_labels", "e1u", COUNT_SQL + "SELECT k, coalesce(max(label), 0) AS label FROM kw LEFT JOIN m ON m.m >= lo AND m.m < hi GROUP BY k")
def window_event_count_labels(spark, sf):
    return W.window_event_counts(V.unsorted_events(spark, sf), WINDOW, STEP)[0]


# --- windows over sessions ---------------------------------------------------------------------

NEXT_VIEW = """WITH nx AS (SELECT session_id, pos, label, n_events, event AS a,
    coalesce(lead(event, 1) OVER s, '#Pad') AS b, coalesce(lead(event, 2) OVER s, '#Pad') AS c, coalesce(lead(event, 3) OVER s, '#Pad') AS next_event
    FROM s1 WINDOW s AS (PARTITION BY session_id ORDER BY pos)),
    win AS (SELECT * FROM nx WHERE pos <= greatest(0, n_events - 3))"""


@register("next_event_windows", "s1", NEXT_VIEW + " SELECT session_id, pos, a || ' ' || b || ' ' || c AS ctx, next_event, label FROM win")
def next_event_windows(spark, sf):
    w = W.next_event_windows(V.sessions(spark, sf), 3)
    return w.select("session_id", "pos", F.array_join("ctx", " ").alias("ctx"), "next_event", "label")


FIRST_SEEN = """SELECT token, row_number() OVER (ORDER BY first_line, session_id, pos) - 1 + {start} AS idx, freq FROM
    (SELECT event AS token, first_line, session_id, pos, count(*) OVER (PARTITION BY event) AS freq,
       row_number() OVER (PARTITION BY event ORDER BY first_line, session_id, pos) AS rn FROM s1) WHERE rn = 1"""


@register("build_vocab_first_seen", "s1", f"""SELECT 'PAD' AS token, 0 AS idx, NULL AS freq UNION ALL SELECT 'UNK', 1, NULL
    UNION ALL SELECT * FROM ({FIRST_SEEN.format(start=2)})""")
def build_vocab_first_seen(spark, sf):
    return D.build_vocab_first_seen(V.sessions(spark, sf))


VOCAB = """(SELECT event AS token, row_number() OVER (ORDER BY count(*) DESC, event) + 4 AS idx, count(*) AS freq FROM {src} GROUP BY event)"""
SPECIAL_ROWS = "SELECT * FROM (VALUES ('<pad>', 0), ('<unk>', 1), ('<eos>', 2), ('<sos>', 3), ('<mask>', 4)) t(token, idx)"


@register("build_vocab", "s1", f"SELECT token, idx, NULL AS freq FROM ({SPECIAL_ROWS}) UNION ALL SELECT * FROM {VOCAB.format(src='s1')} WHERE freq >= 3 AND idx < 5 + 15")
def build_vocab(spark, sf):
    return D.build_vocab(V.sessions(spark, sf), max_size=15, min_freq=3)


@register("extend_vocab", "s1", f"""WITH n AS (SELECT * FROM s1 WHERE label = 1), base AS {VOCAB.format(src='n')[:-1]} LIMIT 7),
    other AS {VOCAB.format(src='s1')} SELECT token, idx FROM ({SPECIAL_ROWS}) UNION ALL SELECT token, idx FROM base UNION ALL
    SELECT token, row_number() OVER (ORDER BY token) - 1 + 5 + (SELECT count(*) FROM base) FROM other WHERE token NOT IN (SELECT token FROM base)""".replace("GROUP BY event LIMIT", "GROUP BY event ORDER BY 2 LIMIT"))
def extend_vocab(spark, sf):
    s = V.sessions(spark, sf)
    base = D.build_vocab(s.where(F.col("label") == 1), max_size=7)
    return D.extend_vocab(base, D.build_vocab(s), sort=True).select("token", "idx")


ENC = f"WITH v AS (SELECT * FROM {VOCAB.format(src='s1')} WHERE idx < 17)"


@register("encode_sequence", "s1", ENC + """, ids AS (SELECT session_id, pos + 1 AS pos, coalesce(idx, 1) AS idx, n_events + 2 AS origin_len FROM s1 LEFT JOIN v ON event = token
    UNION ALL SELECT session_id, 0, 3, n_events + 2 FROM s1h UNION ALL SELECT session_id, n_events + 1, 2, n_events + 2 FROM s1h
    UNION ALL SELECT session_id, unnest(generate_series(n_events + 2, 19)), 0, n_events + 2 FROM s1h WHERE n_events + 2 < 20)
    SELECT * FROM ids WHERE pos < 20""".replace("s1h", "(SELECT DISTINCT session_id, n_events FROM s1)"))
def encode_sequence(spark, sf):
    s = V.sessions(spark, sf)
    return D.encode_sequence(s, D.build_vocab(s, max_size=12), 20, with_eos=True, with_sos=True)


@register("decode_sequence", "s1", ENC + """ SELECT session_id, pos, CASE WHEN pos % 5 = 0 THEN '<' || (99 + pos) || '>' ELSE coalesce(v.token, '<unk>') END AS token
    FROM s1 LEFT JOIN v ON event = v.token""")
def decode_sequence(spark, sf):
    s = V.sessions(spark, sf)
    vocab = D.build_vocab(s, max_size=12)
    ids = D.encode_events(s, vocab).withColumn("idx", F.when(F.col("pos") % 5 == 0, F.col("pos") + 99).otherwise(F.col("idx")))
    return D.decode_sequence(ids, vocab).select("session_id", "pos", "token")


@register("next_event_features", "s1", f"""WITH v AS ({FIRST_SEEN.format(start=2)}), e AS (SELECT s1.*, v.idx FROM s1 JOIN v ON event = token),
    nx AS (SELECT session_id, pos, n_events, idx AS a, coalesce(lead(idx, 1) OVER s, 0) AS b, coalesce(lead(idx, 2) OVER s, 0) AS c, coalesce(lead(idx, 3) OVER s, 0) AS next_idx,
      ts_sec AS p0, coalesce(lead(ts_sec, 1) OVER s, 0) AS p1, coalesce(lead(ts_sec, 2) OVER s, 0) AS p2 FROM e WINDOW s AS (PARTITION BY session_id ORDER BY pos))
    SELECT session_id, pos, a || ' ' || b || ' ' || c AS sequential, (SELECT string_agg(x || ':' || n, ' ' ORDER BY x)
      FROM (SELECT x, count(*) AS n FROM (SELECT unnest([a, b, c]) AS x) GROUP BY x)) AS quantitative, p0 + p1 + p2 AS parameter_sum, next_idx
    FROM nx WHERE pos <= greatest(0, n_events - 3)""")
def next_event_features(spark, sf):
    s = materialise(V.sessions(spark, sf))
    enc = D.encode_events(s, D.build_vocab_first_seen(s)).withColumn("t", F.col("ts_sec").cast("double"))
    f = W.next_event_features(enc, 3, param="t")
    pairs = F.array_join(F.transform("quantitative", lambda c: F.concat_ws(":", c["item"].cast("string"), c["n"].cast("string"))), " ")
    total = F.aggregate("parameters", F.lit(0.0), lambda a, x: a + x).cast("bigint")
    return f.select("session_id", "pos", text_of("sequential").alias("sequential"), pairs.alias("quantitative"), total.alias("parameter_sum"), "next_idx")


SF_SQL = f"""WITH v AS ({FIRST_SEEN.format(start=2)}), e AS (SELECT s1.*, v.idx FROM s1 JOIN v ON event = token WHERE pos < 10),
    l AS (SELECT session_id, max(label) AS label, list_resize(list(idx ORDER BY pos), 10, 0) AS seq FROM e GROUP BY session_id)"""


@register("session_features", "s1", SF_SQL + """ SELECT session_id, label, array_to_string(seq, ' ') AS sequential,
    array_to_string([len(list_filter(seq, lambda x: x = c)) for c in generate_series(0, 28)], ' ') AS quantitative FROM l""")
def session_features(spark, sf):
    s = V.sessions(spark, sf)
    f = W.session_features(D.encode_events(s, D.build_vocab_first_seen(s)), 10, 29)
    return f.select("session_id", "label", text_of("sequential").alias("sequential"), text_of("quantitative").alias("quantitative"))


@register("session_semantics", "s1", SF_SQL + """ SELECT session_id, p - 1 AS pos, d - 1 AS dim, CASE WHEN seq[p] = 0 THEN -1.0 ELSE round(CAST(e.embedding[d] AS DOUBLE), 6) END AS semantic
    FROM (SELECT *, unnest(generate_series(1, 10)) AS p FROM l) x LEFT JOIN embeddings e ON e.vec_id = x.seq[p] - 1,
        (SELECT unnest(generate_series(1, 64)) AS d) WHERE seq[p] = 0 OR e.embedding IS NOT NULL""")
def session_semantics(spark, sf):
    s = V.sessions(spark, sf)
    f = W.session_features(D.encode_events(s, D.build_vocab_first_seen(s)), 10, 29)
    sem = W.session_semantics(f, V.vectors(spark, sf), 64, "vec_id", "embedding")
    return sem.select("session_id", "pos", F.posexplode("semantic").alias("dim", "semantic")).withColumn("semantic", r6("semantic"))


@register("chunk_sequence", "s1", "SELECT session_id, pos // 7 AS chunk, pos % 7 AS chunk_pos, event, line_id FROM s1 WHERE n_events >= 10 AND pos < 20")
def chunk_sequence(spark, sf):
    return W.chunk_sequence(V.sessions(spark, sf), 7, seq_len=20, min_len=10).select("session_id", "chunk", "chunk_pos", "event", "line_id")


@register("chunk_sequence_adaptive", "s1", "SELECT session_id, 0 AS chunk, pos AS chunk_pos, event FROM s1 WHERE n_events >= 10 AND pos < 20")
def chunk_sequence_adaptive(spark, sf):
    return W.chunk_sequence(V.sessions(spark, sf), adaptive=True, seq_len=20, min_len=10).select("session_id", "chunk", "chunk_pos", "event")


@register("truncate_or_pad", "s1", """SELECT session_id, array_to_string(list_resize(list(event ORDER BY pos), 12, '0')[1:12], ' ') AS fixed FROM s1 GROUP BY session_id""")
def truncate_or_pad(spark, sf):
    s = V.sessions(spark, sf).where(F.col("pos") < 12)
    seq = F.transform(F.array_sort(F.collect_list(F.struct("pos", "event"))), lambda r: r["event"])
    g = s.groupBy("session_id").agg(seq.alias("seq"))
    return g.select("session_id", F.array_join(S.truncate_or_pad(F.col("seq"), 12, F.lit("0")), " ").alias("fixed"))


@register("pad_sequences", "s1", f"""WITH v AS ({FIRST_SEEN.format(start=2)}), e AS (SELECT s1.*, v.idx, CAST(split_part(session_id, '_', 2) AS BIGINT) AS batch FROM s1 JOIN v ON event = token),
    w AS (SELECT batch, least(max(n_events), 22) AS width FROM e GROUP BY batch),
    h AS (SELECT DISTINCT session_id, batch, n_events FROM e)
    SELECT session_id, batch, pos, idx, width FROM e JOIN w USING (batch) WHERE pos < width
    UNION ALL SELECT session_id, batch, unnest(generate_series(n_events, width - 1)), 0, width FROM h JOIN w USING (batch) WHERE n_events < width""")
def pad_sequences(spark, sf):
    s = V.sessions(spark, sf)
    enc = D.encode_events(s, D.build_vocab_first_seen(s)).withColumn("batch", F.split_part("session_id", F.lit("_"), F.lit(2)).cast("bigint"))
    return W.pad_sequences(enc, "batch", seq_len=22)


# --- counts and weights ------------------------------------------------------------------------

FIT = """WITH tr AS (SELECT * FROM s1 WHERE label = 0), te AS (SELECT * FROM s1 WHERE label = 1),
    fit AS (SELECT event, count(DISTINCT session_id) AS df FROM tr GROUP BY event),
    big AS (SELECT event, df FROM fit WHERE df > (SELECT median(df) FROM fit)), N AS (SELECT count(DISTINCT session_id) AS n FROM tr),
    cells AS (SELECT session_id, event, count(*) AS n FROM te GROUP BY session_id, event)"""


def train_and_test(spark, sf):
    s = materialise(V.sessions(spark, sf))
    return s.where(F.col("label") == 0), s.where(F.col("label") == 1)


def _common_columns(train):
    """Columns above the median document frequency, so that the rest plays the unknown events."""
    columns = FE.fit_event_columns(train)
    cut = columns.table.agg(F.median("df")).first()[0]
    table = columns.table.where(F.col("df") > cut)
    return FE.EventColumns(table, columns.sessions, table.count())


@register("event_count_vector", "s1c", "SELECT session_id, event, n FROM s1c")
def event_count_vector(spark, sf):
    return FE.event_counts(V.sessions(spark, sf))


@register("event_columns", "s1", f"""SELECT token AS event, idx AS col, df FROM ({FIRST_SEEN.format(start=0)})
    JOIN (SELECT event AS token, count(DISTINCT session_id) AS df FROM s1 GROUP BY event) USING (token)""")
def event_columns(spark, sf):
    return FE.fit_event_columns(V.sessions(spark, sf)).table.select("event", "col", "df")


@register("align_to_training_events", "s1", FIT + " SELECT session_id, event, cells.n FROM cells JOIN big USING (event)")
def align_to_training_events(spark, sf):
    train, test = train_and_test(spark, sf)
    return FE.align_to_training_events(FE.event_counts(test), _common_columns(train)).select("session_id", "event", "n")


@register("oov_feature", "s1", FIT + " SELECT session_id, count(*) FILTER (big.event IS NULL) AS oov FROM cells LEFT JOIN big USING (event) GROUP BY session_id")
def oov_feature(spark, sf):
    train, test = train_and_test(spark, sf)
    return FE.oov_feature(FE.event_counts(test), _common_columns(train))


@register("tfidf_weight", "s1", FIT + """ SELECT session_id, event, round(cells.n * ln(CAST((SELECT n FROM N) AS DOUBLE) / (df + CAST(1e-8 AS DOUBLE))), 6) AS weight
    FROM cells JOIN fit USING (event)""")
def tfidf_weight(spark, sf):
    train, test = train_and_test(spark, sf)
    columns = FE.fit_event_columns(train)
    cells = FE.align_to_training_events(FE.event_counts(test), columns)
    return FE.tfidf_weight(cells, columns.sessions).select("session_id", "event", r6("weight").alias("weight"))


@register("zero_mean", "s1", f"""WITH tr AS (SELECT * FROM s1 WHERE label = 0), te AS (SELECT * FROM s1 WHERE label = 1),
    cols AS ({FIRST_SEEN.format(start=0).replace('FROM s1)', 'FROM tr)')}), mean AS (SELECT event, count(*) / CAST((SELECT count(DISTINCT session_id) FROM tr) AS DOUBLE) AS m FROM tr GROUP BY event),
    grid AS (SELECT DISTINCT session_id, token, idx FROM te, cols)
    SELECT g.session_id, g.idx AS col, round(coalesce(c.n, 0) - m, 6) AS value FROM grid g JOIN mean ON mean.event = g.token
    LEFT JOIN (SELECT session_id, event, count(*) AS n FROM te GROUP BY ALL) c ON c.session_id = g.session_id AND c.event = g.token""")
def zero_mean(spark, sf):
    train, test = train_and_test(spark, sf)
    vectors = FE.fit_count_features(train, normalization="zero-mean").vectors(test)
    return vectors.select("session_id", F.posexplode("features").alias("col", "value")).withColumn("value", r6("value"))


@register("sigmoid_nonzero", "s1c", "SELECT session_id, event, round(1 / (1 + exp(-CAST(n AS DOUBLE))), 6) AS value FROM s1c")
def sigmoid_of_counts(spark, sf):
    c = FE.event_counts(V.sessions(spark, sf))
    return c.select("session_id", "event", r6(sigmoid_nonzero(F.col("n").cast("double"))).alias("value"))


DT = "(SELECT line_id, CAST(ts_sec - coalesce(lag(ts_sec) OVER (ORDER BY line_id), ts_sec) AS DOUBLE) AS d FROM e1)"


@register("scale_times", "e1", f"SELECT line_id, round((d - (SELECT min(d) FROM {DT})) / (SELECT max(d) - min(d) FROM {DT}), 6) AS scaled_t FROM {DT}")
def scale_times(spark, sf):
    t = materialise(W.delta_time(V.timed_events(spark, sf)).select("line_id", "delta_t"))
    return FE.scale_times(t, t).select("line_id", r6("scaled_t").alias("scaled_t"))


@register("scale_times_standard", "e1", f"SELECT line_id, round((d - (SELECT avg(d) FROM {DT})) / (SELECT stddev_pop(d) FROM {DT}), 6) AS scaled_t FROM {DT}")
def scale_times_standard(spark, sf):
    t = materialise(W.delta_time(V.timed_events(spark, sf)).select("line_id", "delta_t"))
    return FE.scale_times(t, t, method="standard").select("line_id", r6("scaled_t").alias("scaled_t"))


VIEWS["s1s"] = (("s1h",), """SELECT *, CASE WHEN label = 1 THEN 'test_abnormal' WHEN rk < floor(n * CAST(0.6 AS DOUBLE)) THEN 'train' ELSE 'test_normal' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('20:' || session_id)) - 1 AS rk, count(*) OVER (PARTITION BY label) AS n FROM s1h)""")


def split_heads(spark, sf, sessions=None):
    heads = SE.session_heads(V.sessions(spark, sf) if sessions is None else sessions).select("session_id", "label", "n_events", "first_line")
    return materialise(SP.split_normal_abnormal(materialise(heads), 0.6, 20))


@register("dataset_summary", "s1s", """SELECT coalesce(split, 'all') AS split, count(*) AS total, count(*) FILTER (label = 1) AS anomalies, count(*) FILTER (label = 0) AS normals
    FROM s1s GROUP BY ROLLUP (split)""")
def dataset_summary(spark, sf):
    return FE.dataset_summary(split_heads(spark, sf))


@register("unknown_event_count", "s1", """WITH known AS (SELECT event FROM s1 WHERE label = 0 GROUP BY event ORDER BY count(*) DESC, event LIMIT 12)
    SELECT count(*) FILTER (event NOT IN (SELECT event FROM known)) AS unknown_events FROM s1 WHERE label = 1""")
def unknown_event_count(spark, sf):
    train, test = train_and_test(spark, sf)
    return FE.unknown_event_count(D.encode_events(test, D.build_vocab(train, max_size=12)), unknown=D.UNK)


@register("sequence_length_distribution", "s1h", "SELECT label, n_events, count(*) AS sessions FROM s1h GROUP BY label, n_events")
def sequence_length_distribution(spark, sf):
    return FE.sequence_length_distribution(SE.session_heads(V.sessions(spark, sf)))


# --- joins, splits, samples --------------------------------------------------------------------


@register("join_session_labels", "s1h", "SELECT session_id, n_events, CASE WHEN n_events % 3 <> 0 THEN label END AS label FROM s1h")
def join_session_labels(spark, sf):
    heads = SE.session_heads(V.sessions(spark, sf))
    labels = heads.where(F.col("n_events") % 3 != 0).select("session_id", "label")
    return SE.join_session_labels(heads.select("session_id", "n_events"), labels)


@register("zip_parallel_sequences", "s1", "SELECT session_id, pos, event, line_id FROM s1")
def zip_parallel_sequences(spark, sf):
    s = V.sessions(spark, sf)
    return SE.zip_parallel_sequences(s.select("session_id", "pos", "event"), s.select("session_id", "pos", "line_id"))


@register("seeded_shuffle", "s1h", "SELECT session_id, row_number() OVER (ORDER BY md5('88:' || session_id)) - 1 AS shuffle_rank FROM s1h")
def seeded_shuffle(spark, sf):
    heads = SE.session_heads(V.sessions(spark, sf)).select("session_id")
    return SP.seeded_shuffle(heads, ["session_id"], 88)


@register("split_normal_abnormal", "s1s", "SELECT session_id, label, split FROM s1s")
def split_normal_abnormal(spark, sf):
    return split_heads(spark, sf).select("session_id", "label", "split")


@register("split_stratified", "s1h", """SELECT session_id, label, CASE WHEN rk < floor(n * CAST(0.5 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM (SELECT *,
    row_number() OVER (PARTITION BY label ORDER BY first_line, session_id) - 1 AS rk, count(*) OVER (PARTITION BY label) AS n FROM s1h)""")
def split_stratified(spark, sf):
    heads = SE.session_heads(V.sessions(spark, sf)).select("session_id", "label", "first_line")
    return SP.split_stratified(heads, 0.5).select("session_id", "label", "split")


@register("split_sequential", "s1h", """SELECT session_id, CASE WHEN row_number() OVER (ORDER BY first_line, session_id) - 1 <
    floor((SELECT count(*) FROM s1h) * CAST(0.3 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM s1h""")
def split_sequential(spark, sf):
    heads = SE.session_heads(V.sessions(spark, sf)).select("session_id", "first_line")
    return SP.split_sequential(heads, 0.3).select("session_id", "split")


@register("split_holdout", "s1h", """SELECT session_id, CASE WHEN row_number() OVER (ORDER BY md5('1234:' || session_id)) - 1 <
    floor((SELECT count(*) FROM s1h) * CAST(0.1 AS DOUBLE)) THEN 'valid' ELSE 'train' END AS split FROM s1h""")
def split_holdout(spark, sf):
    heads = SE.session_heads(V.sessions(spark, sf)).select("session_id")
    return SP.split_holdout(heads, ["session_id"], 0.1, 1234)


@register("mix_abnormal_into_train", "s1s", """SELECT session_id, CAST(split = 'test_abnormal' AS INTEGER) AS y, CASE WHEN split = 'train' OR (split = 'test_abnormal' AND
    r < least((SELECT count(*) FROM s1s WHERE split = 'train') // 2, floor((SELECT count(*) FROM s1s WHERE split = 'test_abnormal') * CAST(0.4 AS DOUBLE))))
    THEN 'train' ELSE 'test' END AS side FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('88:' || session_id)) - 1 AS r FROM s1s)""")
def mix_abnormal_into_train(spark, sf):
    return SP.mix_abnormal_into_train(split_heads(spark, sf), 88).select("session_id", "y", "side")


@register("sample_without_replacement", "s1h", "SELECT session_id, label FROM s1h ORDER BY md5('7:' || session_id) LIMIT (SELECT CAST(floor(count(*) * CAST(0.35 AS DOUBLE)) AS BIGINT) FROM s1h)")
def sample_without_replacement(spark, sf):
    heads = SE.session_heads(V.sessions(spark, sf)).select("session_id", "label")
    return SP.sample_without_replacement(heads, ["session_id"], 0.35, 7)


@register("sort_by_length", "s1h", "SELECT session_id, n_events FROM s1h ORDER BY n_events DESC, session_id")
def sort_by_length(spark, sf):
    return SP.sort_by_length(SE.session_heads(V.sessions(spark, sf)).select("session_id", "n_events"))


@register("event_set_difference", "s1", """SELECT event FROM s1 WHERE label = 0 EXCEPT SELECT event FROM s1 WHERE label = 1 AND pos < 1 AND n_events < 8""")
def event_set_difference(spark, sf):
    train, test = train_and_test(spark, sf)
    return CA.event_set_difference(train, test.where((F.col("pos") < 1) & (F.col("n_events") < 8)))


# --- candidates, verdicts, metrics -------------------------------------------------------------

BIGRAM = """WITH big AS (SELECT session_id, pos, label, event AS prev, lead(event) OVER (PARTITION BY session_id ORDER BY pos) AS event FROM s1),
    cand AS (SELECT prev, event, n AS score, row_number() OVER (PARTITION BY prev ORDER BY n DESC, event) AS rank
      FROM (SELECT prev, event, count(*) AS n FROM big WHERE label = 0 AND event IS NOT NULL GROUP BY prev, event)),
    miss AS (SELECT session_id, max(label) AS label, count(*) AS masked, count(*) FILTER (c.rank IS NULL) AS undetected
      FROM big LEFT JOIN (SELECT * FROM cand WHERE rank <= 3) c USING (prev, event) WHERE event IS NOT NULL GROUP BY session_id)"""


def bigrams(sessions):
    near = O.with_neighbours(sessions, ["session_id"], "pos", {"_next": ("event", 1)})
    return near.where(F.col("_next").isNotNull()).select("session_id", "pos", "label", F.col("event").alias("prev"), F.col("_next").alias("event"))


def bigram_scores(pairs):
    return pairs.where(F.col("label") == 0).groupBy("prev", "event").agg(F.count(F.lit(1)).alias("score"))


def bigram_misses(spark, sf):
    s = materialise(V.sessions(spark, sf))
    pairs = bigrams(s)
    lists = CA.candidate_lists(bigram_scores(pairs), 3, ["prev"])
    missed = CA.not_in_top_g(pairs, lists, ["prev"], "event")
    return missed.join(SE.session_heads(s).select("session_id", "label"), "session_id")


@register("top_g_candidates", "s1", BIGRAM + " SELECT prev, event, score, rank FROM cand WHERE rank <= 3")
def top_g_candidates(spark, sf):
    return CA.top_g_candidates(bigram_scores(bigrams(V.sessions(spark, sf))), 3, ["prev"])


@register("not_in_top_g", "s1", BIGRAM + " SELECT session_id, label, masked, undetected FROM miss")
def not_in_top_g(spark, sf):
    return bigram_misses(spark, sf).select("session_id", "label", "masked", "undetected")


@register("session_verdict", "s1", BIGRAM + " SELECT session_id, label, CAST(undetected > masked * 0.6 AS INTEGER) AS pred, CAST(undetected > 7 AS INTEGER) AS by_count FROM miss")
def session_verdict(spark, sf):
    v = E.session_verdict(E.session_verdict(bigram_misses(spark, sf), 0.6), 7, ratio=False, out="by_count")
    return v.select("session_id", "label", "pred", "by_count")


@register("session_rollup", "s1", NEXT_VIEW + """ SELECT session_id, max(CAST(next_event = '#Pad' AND c LIKE 'view%' AS INTEGER)) AS pred, max(label) AS truth FROM win GROUP BY session_id""")
def session_rollup(spark, sf):
    w = W.next_event_windows(V.sessions(spark, sf), 3)
    hit = ((F.col("next_event") == W.PAD_EVENT) & F.get("ctx", F.lit(2)).startswith("view")).cast("int")
    return E.session_rollup(w.withColumn("anomaly", hit))


@register("window_accuracy", "s1", BIGRAM + """ SELECT round(avg(CAST(b.event = c.event AS DOUBLE)), 6) AS window_acc, count(*) AS windows
    FROM big b JOIN (SELECT * FROM cand WHERE rank = 1) c USING (prev) WHERE b.event IS NOT NULL""")
def window_accuracy(spark, sf):
    pairs = bigrams(materialise(V.sessions(spark, sf)))
    best = CA.top_g_candidates(bigram_scores(pairs), 1, ["prev"]).select("prev", F.col("event").alias("pred_event"))
    acc = E.window_accuracy(O.lookup(pairs, best, ["prev"], "inner"), target="event")
    return acc.withColumn("window_acc", r6("window_acc"))


SCORES = """round({p}, 4) AS precision, round({r}, 4) AS recall, round(2 * {p} * {r} / nullif({p} + {r}, 0), 4) AS f1"""


@register("classification_metrics", "s1", BIGRAM + """, c AS (SELECT count(*) FILTER (p = 1 AND label = 1) AS tp, count(*) FILTER (p = 1 AND label = 0) AS fp,
    count(*) FILTER (p = 0 AND label = 0) AS tn, count(*) FILTER (p = 0 AND label = 1) AS fn FROM (SELECT label, CAST(undetected > 7 AS INTEGER) AS p FROM miss))
    SELECT tp, fp, tn, fn, """ + SCORES.format(p="100.0 * tp / (tp + fp + CAST(1e-8 AS DOUBLE))", r="100.0 * tp / (tp + fn + CAST(1e-8 AS DOUBLE))") + " FROM c")
def classification_metrics(spark, sf):
    return E.classification_metrics(E.session_verdict(bigram_misses(spark, sf), 7, ratio=False), "pred", "label")


SWEEP = BIGRAM + """, t AS (SELECT threshold, count(*) FILTER (undetected > threshold AND label = 1) AS tp, count(*) FILTER (undetected > threshold AND label = 0) AS fp,
    count(*) FILTER (undetected <= threshold AND label = 0) AS tn, count(*) FILTER (undetected <= threshold AND label = 1) AS fn
    FROM miss, (SELECT unnest(generate_series(0, 9)) AS threshold) GROUP BY threshold),
    sw AS (SELECT threshold, tp, fp, tn, fn, """ + SCORES.format(p="CAST(100.0 * tp AS DOUBLE) / (tp + fp)", r="CAST(100.0 * tp AS DOUBLE) / (tp + fn)") + " FROM t WHERE tp > 0)"


@register("threshold_sweep", "s1", SWEEP + " SELECT * FROM sw")
def threshold_sweep(spark, sf):
    return E.threshold_sweep(bigram_misses(spark, sf))


@register("best_threshold", "s1", SWEEP + " SELECT * FROM sw ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(spark, sf):
    return E.best_threshold(E.threshold_sweep(bigram_misses(spark, sf)))


# --- context-count detectors -------------------------------------------------------------------

NEXT_FIT = NEXT_VIEW + """, spl AS (SELECT session_id, split FROM s1s), w AS (SELECT win.*, split FROM win JOIN spl USING (session_id)),
    keys AS (SELECT *, [ '', c, b || ' ' || c, a || ' ' || b || ' ' || c ] AS ks FROM w),
    fit AS (SELECT k, ks[k + 1] AS key, next_event AS event, count(*) AS n FROM keys, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE split = 'train' AND next_event <> '#Pad' GROUP BY ALL),
    top AS (SELECT k, key, list(event ORDER BY r) AS cand FROM (SELECT *, row_number() OVER (PARTITION BY k, key ORDER BY n DESC, event) AS r FROM fit) WHERE r <= 6 GROUP BY k, key),
    sc AS (SELECT x.session_id, x.label, x.next_event, coalesce(t3.cand, t2.cand, t1.cand, t0.cand) AS cand FROM keys x
      LEFT JOIN top t3 ON t3.k = 3 AND t3.key = ks[4] LEFT JOIN top t2 ON t2.k = 2 AND t2.key = ks[3]
      LEFT JOIN top t1 ON t1.k = 1 AND t1.key = ks[2] LEFT JOIN top t0 ON t0.k = 0 WHERE x.split <> 'train')
    SELECT session_id, count(*) FILTER (NOT list_contains(cand, next_event)) AS logkey_anomaly, count(*) AS predicted_logkey, max(label) AS label FROM sc GROUP BY session_id"""


def split_sessions(spark, sf):
    s = materialise(V.sessions(spark, sf))
    split = split_heads(spark, sf, s).select("session_id", "split", "n_events")
    both = materialise(O.spread_join(s.drop("n_events"), split, ["session_id"], "pos", "n_events"))
    return both.where(F.col("split") == "train"), both.where(F.col("split") != "train")


@register("next_event_detector", "s1 s1s", NEXT_FIT)
def next_event_detector(spark, sf):
    train, test = split_sessions(spark, sf)
    return C.next_event_detector(train, test, 3, 6)


MASK_SQL = "CAST('0x' || substr(md5('5:' || session_id || ':' || pos), 1, 8) AS BIGINT) / 4294967296.0 < 0.4"


@register("mask_events", "s1", f"""SELECT session_id, pos + 1 AS pos, CASE WHEN {MASK_SQL} THEN '<mask>' ELSE event END AS token, CASE WHEN {MASK_SQL} THEN event ELSE '<pad>' END AS target FROM s1
    UNION ALL SELECT DISTINCT session_id, 0, '<sos>', '<pad>' FROM s1""")
def mask_events(spark, sf):
    return C.with_start(C.mask_events(V.sessions(spark, sf), 0.4, 5)).select("session_id", "pos", "token", "target")


@register("masked_event_detector", "s1 s1s", f"""WITH x AS (SELECT s1.*, split, {MASK_SQL.replace('session_id', 's1.session_id')} AS masked FROM s1 JOIN (SELECT session_id, split FROM s1s) USING (session_id)),
    tr AS (SELECT event, coalesce(lag(event) OVER s, '<sos>') AS p, lead(event) OVER s AS q FROM x WHERE split = 'train' WINDOW s AS (PARTITION BY session_id ORDER BY pos)),
    fit AS (SELECT 3 AS k, p || '>' || q AS key, event, count(*) AS n FROM tr WHERE q IS NOT NULL GROUP BY ALL UNION ALL SELECT 2, p, event, count(*) FROM tr GROUP BY ALL
      UNION ALL SELECT 1, q, event, count(*) FROM tr WHERE q IS NOT NULL GROUP BY ALL UNION ALL SELECT 0, '', event, count(*) FROM tr GROUP BY ALL),
    top AS (SELECT k, key, list(event) AS cand FROM (SELECT *, row_number() OVER (PARTITION BY k, key ORDER BY n DESC, event) AS r FROM fit) WHERE r <= 5 GROUP BY k, key),
    te AS (SELECT session_id, pos, event, masked, CASE WHEN pos = 0 THEN '<sos>' WHEN NOT lag(masked) OVER s THEN lag(event) OVER s END AS p,
      CASE WHEN NOT lead(masked) OVER s THEN lead(event) OVER s END AS q FROM x WHERE split <> 'train' WINDOW s AS (PARTITION BY session_id ORDER BY pos)),
    sc AS (SELECT session_id, event, coalesce(t3.cand, t2.cand, t1.cand, t0.cand) AS cand FROM te LEFT JOIN top t3 ON t3.k = 3 AND t3.key = p || '>' || q
      LEFT JOIN top t2 ON t2.k = 2 AND t2.key = p LEFT JOIN top t1 ON t1.k = 1 AND t1.key = q LEFT JOIN top t0 ON t0.k = 0 WHERE masked)
    SELECT h.session_id, coalesce(m, 0) AS masked_tokens, coalesce(u, 0) AS undetected_tokens, h.n_events + 1 AS total_logkey, h.label FROM s1s h LEFT JOIN
      (SELECT session_id, count(*) AS m, count(*) FILTER (NOT list_contains(cand, event)) AS u FROM sc GROUP BY session_id) USING (session_id) WHERE h.split <> 'train'""")
def masked_event_detector(spark, sf):
    train, test = split_sessions(spark, sf)
    return C.masked_event_detector(train, test, 5, 0.4, 5)


# --- whole flow --------------------------------------------------------------------------------

FLOW = """WITH ev AS (SELECT event, row_number() OVER (ORDER BY n DESC, event) AS rk FROM (SELECT substr(md5(template), 1, 8) AS event, count(*) AS n FROM l1m GROUP BY 1)),
    ss AS (SELECT session_id, line_no, CAST(rk AS VARCHAR) AS event, max(CAST(label <> '-' AS INTEGER)) OVER (PARTITION BY session_id) AS label
      FROM l1k JOIN ev ON event = substr(md5(template), 1, 8)),
    big AS (SELECT * FROM (SELECT session_id, label, event AS prev, lead(event) OVER (PARTITION BY session_id ORDER BY line_no) AS event FROM ss) WHERE event IS NOT NULL),
    cnt AS (SELECT prev, event, count(*) AS n FROM big WHERE label = 0 GROUP BY ALL),
    top AS (SELECT prev, event FROM (SELECT *, row_number() OVER (PARTITION BY prev ORDER BY n DESC, event) AS r FROM cnt) WHERE r <= 3),
    uni AS (SELECT event FROM (SELECT event, row_number() OVER (ORDER BY sum(n) DESC, event) AS r FROM cnt GROUP BY event) WHERE r <= 3),
    res AS (SELECT session_id, max(label) AS label, count(*) AS predicted_logkey, sum(CASE WHEN prev IN (SELECT prev FROM top) THEN
        CAST((prev, event) NOT IN (SELECT (prev, event) FROM top) AS INTEGER) ELSE CAST(event NOT IN (SELECT event FROM uni) AS INTEGER) END)::BIGINT AS logkey_anomaly
      FROM big GROUP BY session_id),
    verdict AS (SELECT session_id, logkey_anomaly, predicted_logkey, label, CAST(logkey_anomaly > predicted_logkey * CAST(0.5 AS DOUBLE) AS INTEGER) AS pred FROM res)"""


@register("unusual_successor_sessions", "l1k", FLOW + " SELECT * FROM verdict")
def unusual_successor_sessions(spark, sf):
    return flows.unusual_successors(flows.ranked_sessions(V.raw_lines(spark, sf), V.LOG_FORMAT, V.NUMBER_MASKS))


@register("unusual_successor_metrics", "l1k", FLOW + """, c AS (SELECT count(*) FILTER (pred = 1 AND label = 1) AS tp, count(*) FILTER (pred = 1 AND label = 0) AS fp,
    count(*) FILTER (pred = 0 AND label = 0) AS tn, count(*) FILTER (pred = 0 AND label = 1) AS fn FROM verdict)
    SELECT tp, fp, tn, fn, """ + SCORES.format(p="100.0 * tp / (tp + fp + CAST(1e-8 AS DOUBLE))", r="100.0 * tp / (tp + fn + CAST(1e-8 AS DOUBLE))") + " FROM c")
def unusual_successor_metrics(spark, sf):
    return flows.flow_metrics(unusual_successor_sessions(spark, sf))
