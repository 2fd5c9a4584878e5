"""Queries for vectors, template mining and fitted detectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from logweir.catalog import mining_sql as Q
from logweir.catalog.base import register
from logweir.catalog.sources_and_text import PAIR_VIEW, PUNCT_SQL, message_pairs
from logweir.catalog.windows_and_features import r6, split_sessions
from logweir.detectors import boundary, clustering, forest, linear_space as L, supervised as SV
from logweir.functions import text as T, vectors as VE
from logweir.operators import dictionaries as D, features as FE, matching as M, mining as MI, sessions as SE
from logweir.operators.ordering import ordinal
from logweir.operators.splits import split_stratified
from logweir.operators.windows import session_features
from logweir.plans import views as V
from logweir.session import materialise

def dist_sql(a: str, b: str) -> str:
    d = f"1 - list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])) + CAST(1e-8 AS DOUBLE))"
    return f"CASE WHEN {d} < 1e-8 THEN 0.0 ELSE {d} END"


# --- vectors -----------------------------------------------------------------------------------


@register("cosine_distance", "", f"""SELECT a.vec_id, round({dist_sql('a.embedding', 'b.embedding')}, 6) AS distance
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_distance(spark, sf):
    v = V.vectors(spark, sf).select("vec_id", "embedding")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(nxt, "vec_id").select("vec_id", r6(VE.cosine_distance(F.col("embedding"), F.col("other"))).alias("distance"))


@register("adaptive_avg_pool", "", """SELECT vec_id, i AS bin, round(list_avg(embedding[CAST(floor(i * 64 / 24.0) AS BIGINT) + 1 : CAST(ceil((i + 1) * 64 / 24.0) AS BIGINT)]::DOUBLE[]), 6) AS pooled
    FROM (SELECT vec_id, embedding, unnest(generate_series(0, 23)) AS i FROM embeddings)""")
def adaptive_avg_pool(spark, sf):
    v = V.vectors(spark, sf).select("vec_id", F.posexplode(VE.adaptive_avg_pool(F.col("embedding"), 24)).alias("bin", "pooled"))
    return v.withColumn("pooled", r6("pooled"))


@register("mean_vector_by_key", "", """SELECT label, i - 1 AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean
    FROM (SELECT label, embedding, unnest(generate_series(1, 64)) AS i FROM embeddings) GROUP BY label, i""")
def mean_vector_by_key(spark, sf):
    m = FE.mean_vector_by_key(V.vectors(spark, sf), "label", "embedding", 64)
    return m.select("label", F.posexplode("mean_vector").alias("dim", "mean")).withColumn("mean", r6("mean"))


HAT = """WITH c AS (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT embedding, unnest(generate_series(1, 64)) AS i FROM embeddings WHERE label < 8) GROUP BY i),
    cl AS (SELECT list(m ORDER BY i) AS c FROM c),
    d AS (SELECT vec_id, label, sqrt(list_sum([pow(CAST(embedding[i] AS DOUBLE) - c[i], 2) for i in generate_series(1, 64)])) AS distance FROM embeddings, cl),
    r AS (SELECT quantile_cont(distance, 0.75) AS radius FROM d WHERE label < 8)"""


@register("hypersphere_fit", "", HAT + " SELECT i - 1 AS dim, round(radius, 6) AS radius, round(m, 6) AS center FROM r, c")
def hypersphere_fit(spark, sf):
    model = L.fit_hypersphere(V.vectors(spark, sf).where(F.col("label") < 8))
    rows = spark.createDataFrame([(i, model.radius, c) for i, c in enumerate(model.center)], "dim bigint, radius double, center double")
    return rows.select("dim", r6("radius").alias("radius"), r6("center").alias("center"))


@register("hypersphere_score", "", HAT + " SELECT vec_id, round(distance, 6) AS distance, CAST(distance > radius AS INTEGER) AS pred FROM d, r")
def hypersphere_score(spark, sf):
    v = V.vectors(spark, sf)
    scored = L.score_hypersphere(v, L.fit_hypersphere(v.where(F.col("label") < 8)))
    return scored.select("vec_id", r6("distance").alias("distance"), "pred")


REPS = """WITH c AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT label, embedding, unnest(generate_series(1, 64)) AS i FROM embeddings WHERE label < 8) GROUP BY label, i),
    reps AS (SELECT label AS rep, list(m ORDER BY i) AS v FROM c GROUP BY label), """ + f"""
    pairs AS (SELECT vec_id, rep, {dist_sql('embedding', 'v')} AS d FROM embeddings, reps),
    near AS (SELECT vec_id, arg_min(rep, (d, rep)) AS rep, min(d) AS distance FROM pairs GROUP BY vec_id)"""


def label_means(spark, sf) -> np.ndarray:
    means = FE.mean_vector_by_key(V.vectors(spark, sf).where(F.col("label") < 8), "label", "embedding", 64).orderBy("label").collect()
    return np.array([r["mean_vector"] for r in means])


@register("nearest_representative", "", REPS + " SELECT vec_id, rep, round(distance, 6) AS distance FROM near")
def nearest_representative(spark, sf):
    near = M.nearest_representative(V.vectors(spark, sf).select("vec_id", "embedding"), label_means(spark, sf), "embedding")
    return near.select("vec_id", "rep", r6("distance").alias("distance"))


@register("log_clustering_score", "", REPS + " SELECT vec_id, round(distance, 6) AS distance, CAST(distance > 0.3 AS INTEGER) AS pred FROM near")
def log_clustering_score(spark, sf):
    scored = clustering.score_log_clustering(V.vectors(spark, sf).select("vec_id", "embedding"), label_means(spark, sf), 0.3, "embedding")
    return scored.select("vec_id", r6("distance").alias("distance"), "pred")


@register("line_context_vector", "", """WITH lines_ AS (SELECT event_id AS line_id, user_id, event_type, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 10 WHEN 'purchase' THEN 20 ELSE NULL END AS base FROM events),
    n AS (SELECT *, CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END AS slots FROM lines_),
    ph AS (SELECT line_id, base + s AS tv, user_id + s AS pv, slots FROM n, (SELECT unnest([0, 1, 2]) AS s) WHERE s < slots),
    dims AS (SELECT line_id, i, avg((CAST(t.embedding[i] AS DOUBLE) + CAST(p.embedding[i] AS DOUBLE)) / 2) AS x FROM ph JOIN embeddings t ON t.vec_id = tv JOIN embeddings p ON p.vec_id = pv,
      (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY line_id, i)
    SELECT n.line_id, slots AS placeholders, b.bin, round(b.x, 6) AS context FROM n LEFT JOIN
      (SELECT line_id, (i - 1) // 8 AS bin, avg(x) AS x FROM dims GROUP BY ALL) b USING (line_id)""")
def line_context_vector(spark, sf):
    e = V.table(spark, sf, "events")
    slots = F.when(F.col("event_type") == "click", 3).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "purchase", 1).otherwise(0)
    base = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 10).when(F.col("event_type") == "purchase", 20)
    ph = e.select(
        F.col("event_id").alias("line_id"), base.cast("bigint").alias("event_id"), "user_id",
        F.explode_outer(F.when(slots > 0, F.sequence(F.lit(0), slots - 1))).alias("slot"),
    ).withColumn("param", F.col("user_id") + F.col("slot"))
    v = V.vectors(spark, sf).select("vec_id", F.col("embedding").alias("vector"))
    owners = F.array(*[F.struct(F.lit(b).cast("bigint").alias("event_id"), (F.col("vec_id") - b).cast("int").alias("slot")) for b in (0, 10, 20)])
    tv = v.select(F.explode(owners).alias("o"), "vector").select("o.event_id", "o.slot", "vector").where(F.col("slot").between(0, 9))
    out = FE.line_context_vector(ph.drop("user_id"), tv, v.withColumnRenamed("vec_id", "param"), 64, 8)
    return out.select("line_id", "placeholders", F.posexplode_outer("context").alias("bin", "context")).withColumn("context", r6("context"))


@register("text_vectorizer")
def text_vectorizer(spark, sf):
    v = SV.text_vectorizer(V.messages(spark, sf))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return v.select("doc_id", "line_pos", F.size("vector").alias("dims"), r6(total).alias("total"))


# --- templates ---------------------------------------------------------------------------------


def tokenised_log(spark, sf, patterns=V.NUMBER_MASKS):
    log = V.masked_log(spark, sf, patterns).select(F.col("line_no").alias("line_id"), "Content", F.col("template").alias("masked"))
    return log.withColumn("tokens", T.tokenize_ws(F.col("masked")))


@register("drain_templates", "l1m", Q.drain_sql("hdfs_template", 5, 0.5) + Q.LINES)
def drain_templates(spark, sf):
    mined = MI.drain_templates(tokenised_log(spark, sf, T.HDFS_MASKS), 5, 0.5)
    return mined.select("line_id", "cluster", F.array_join("cluster_template", " ").alias("template"))


@register("drain_templates_exact", "l1m", Q.drain_sql("hdfs_template", 5, 0.5) + Q.LINES)
def drain_templates_exact(spark, sf):
    mined = MI.drain_templates(tokenised_log(spark, sf, T.HDFS_MASKS), 5, 0.5, exact=True)
    return mined.select("line_id", "cluster", F.array_join("cluster_template", " ").alias("template"))


@register("drain_templates_shallow", "l1m", Q.drain_sql("template", 3, 0.3) + Q.LINES)
def drain_templates_shallow(spark, sf):
    mined = MI.drain_templates(tokenised_log(spark, sf), 3, 0.3, 1000)
    return mined.select("line_id", "cluster", F.array_join("cluster_template", " ").alias("template"))


@register("drain_result", "l1m", Q.drain_sql("hdfs_template", 5, 0.5) + Q.DICTIONARY)
def drain_result(spark, sf):
    mined = MI.drain_templates(tokenised_log(spark, sf, T.HDFS_MASKS), 5, 0.5)
    return MI.mining_result(mined)[1].select("event_id", "event_template", "occurrences", "first_line")


@register("drain_result_parameters", "l1m", Q.drain_sql("template", 3, 0.3) + Q.PARAMETERS)
def drain_result_parameters(spark, sf):
    mined = MI.drain_templates(tokenised_log(spark, sf), 3, 0.3)
    lines, _ = MI.mining_result(mined, across_spaces=True)
    params = T.extract_params_literal(F.col("Content"), F.col("template"))
    return lines.select("line_id", "event_id", "template", F.array_join(params, "|").alias("params"))


def punctuated_log(spark, sf):
    return tokenised_log(spark, sf, T.HDFS_MASKS).withColumn("tokens", T.tokenize_punct(F.col("masked")))


SPELL_SQL = f"""SELECT line_no AS line_id, array_to_string(toks, '|') AS message, 1 AS in_order, 1 AS covered
    FROM (SELECT line_no, {PUNCT_SQL.replace("msg", "hdfs_template")} AS toks FROM l1m)"""


@register("spell_templates", "l1m", SPELL_SQL)
def spell_templates(spark, sf):
    """Each line against its template: the template's constants stand in the line in their order, and what both have in common covers half of the line."""
    mined = MI.spell_templates(punctuated_log(spark, sf), 0.5)
    one = F.struct(F.col("tokens"), F.filter("cluster_template", lambda t: t != T.WILDCARD).alias("constants"))

    def found(acc, t):  # constants found so far
        return acc + F.when(F.get(one["constants"], acc) == t, 1).otherwise(0)

    in_order = F.aggregate("tokens", F.lit(0), found) == F.size(one["constants"])
    shared = F.size(F.filter("cluster_template", lambda t: F.array_contains("tokens", t)))
    return mined.select(
        "line_id", F.array_join("tokens", "|").alias("message"), in_order.cast("int").alias("in_order"), (2 * shared >= F.size("tokens")).cast("int").alias("covered")
    )


@register("spell_result", "l1m", """SELECT count(*) AS lines, min(line_no) AS first_line, 1 AS ids_are_of_texts, 1 AS few, 1 AS no_text_twice FROM l1m""")
def spell_result(spark, sf):
    """The dictionary as a whole: all lines are counted once, under at most 15 templates."""
    found = MI.mining_result(MI.spell_templates(punctuated_log(spark, sf), 0.5), collapse=False)[1]
    return found.agg(
        F.sum("occurrences").alias("lines"),
        F.min("first_line").alias("first_line"),
        F.min((F.col("event_id") == T.template_id(F.col("event_template"))).cast("int")).alias("ids_are_of_texts"),
        (F.count(F.lit(1)) <= 15).cast("int").alias("few"),
        (F.count(F.lit(1)) == F.count_distinct("event_template")).cast("int").alias("no_text_twice"),
    )


def masked_dictionary(spark, sf):
    """Dictionary: the distinct masked log templates, most frequent first."""
    counts = V.masked_log(spark, sf).groupBy("template").agg(F.count(F.lit(1)).alias("n"))
    return ordinal(counts, [F.desc("n"), F.asc("template")], "template_no").select("template_no", T.tokenize_ws(F.col("template")).alias("template"))


MATCH_SQL = r"""WITH dict AS (SELECT template, row_number() OVER (ORDER BY count(*) DESC, template) - 1 AS template_no FROM l1m GROUP BY template),
    dt AS (SELECT template_no, string_split(template, ' ') AS t FROM dict),
    lt AS (SELECT line_no, string_split(hdfs_template, ' ') AS m FROM l1m),
    c AS (SELECT line_no, template_no, len(list_filter(list_zip(t, m), lambda p: p[1] = p[2] AND p[1] <> '<*>')) / CAST(len(m) AS DOUBLE) AS s, len(list_filter(t, lambda x: x = '<*>')) AS w
      FROM lt JOIN dt ON len(t) = len(m)),
    b AS (SELECT *, row_number() OVER (PARTITION BY line_no ORDER BY s DESC, w DESC, template_no) AS r FROM c WHERE s >= 0.5)
    SELECT line_no, template_no, round(s, 6) AS similarity FROM lt LEFT JOIN (SELECT * FROM b WHERE r = 1) USING (line_no)"""


@register("match_templates", "l1m", MATCH_SQL)
def match_templates(spark, sf):
    log = V.masked_log(spark, sf, T.HDFS_MASKS).select("line_no", T.tokenize_ws(F.col("template")).alias("tokens"))
    found = M.match_templates(log, masked_dictionary(spark, sf), 0.5)
    return found.select("line_no", "template_no", r6("similarity").alias("similarity"))


@register("match_templates_lcs", "l1m", Q.MATCH_LCS)
def match_templates_lcs(spark, sf):
    log = V.masked_log(spark, sf, T.HDFS_MASKS).select("line_no", T.tokenize_ws(F.col("template")).alias("tokens"))
    return M.match_templates_lcs(log, masked_dictionary(spark, sf), 0.5).select("line_no", "template_no", "common")


def message_subsequences(spark, sf):
    return message_pairs(spark, sf).withColumn("_s", M.common_subsequence("a", "b"))


@register("lcs_tokens", "d1t", f"{PAIR_VIEW}, {Q.SUBSEQUENCES} SELECT doc_id, line_pos, array_to_string(common, ' ') AS common FROM walked")
def lcs_tokens(spark, sf):
    return message_subsequences(spark, sf).select("doc_id", "line_pos", F.array_join("_s.common", " ").alias("common"))


@register("lcs_template", "d1t", f"{PAIR_VIEW}, {Q.SUBSEQUENCES}, {Q.TEMPLATES}")
def lcs_template(spark, sf):
    return message_subsequences(spark, sf).select("doc_id", "line_pos", F.array_join("_s.template", " ").alias("template"))


# --- fitted detectors on event counts ----------------------------------------------------------


def count_vectors(spark, sf, **options):
    """Count vectors of training and test sessions, with label and order columns."""
    train, test = split_sessions(spark, sf)
    fitted = FE.fit_count_features(train, **options)
    keep = ["session_id", "label", "first_line"]
    return [materialise(fitted.vectors(s).join(SE.session_heads(s).select(*keep), "session_id")) for s in (train, test)]


def mixed_vectors(spark, sf):
    """For supervised models: all sessions, half of each class in order for training."""
    s = materialise(V.sessions(spark, sf))
    heads = split_stratified(SE.session_heads(s).select("session_id", "label", "first_line"), 0.5)
    both = materialise(FE.fit_count_features(s).vectors(s).join(heads, "session_id"))
    return both.where(F.col("split") == "train"), both.where(F.col("split") == "test")


@register("pca_detector")
def pca_detector(spark, sf):
    train, test = count_vectors(spark, sf, weighting="tf-idf", normalization="zero-mean")
    return L.score_pca(test, L.fit_pca(train)).select("session_id", "label", r6("spe").alias("spe"), "pred")


@register("invariants_detector")
def invariants_detector(spark, sf):
    train, test = count_vectors(spark, sf)
    model = L.fit_invariants(train, percentage=0.6, epsilon=1.0, longest=3)
    return L.score_invariants(test, model).select("session_id", "label", r6("violation").alias("violation"), "pred")


@register("invariants_score", "s1", f"""WITH n AS (SELECT session_id, count(*) FILTER (event LIKE 'click%') AS a, count(*) FILTER (event LIKE 'view%') AS b,
    count(*) FILTER (event LIKE 'signup%') AS c, max(label) AS label FROM s1 GROUP BY session_id)
    SELECT session_id, label, CAST(abs(a - b) + abs(a - 2 * c) AS DOUBLE) AS violation, CAST(abs(a - b) + abs(a - 2 * c) > 1e-6 AS INTEGER) AS pred FROM n""")
def invariants_score(spark, sf):
    """Relations taken as given: clicks = views, clicks = 2 signups."""
    s = V.sessions(spark, sf)
    kinds = [F.sum(F.col("event").startswith(k).cast("double")) for k in ("click", "view", "signup")]
    x = s.groupBy("session_id").agg(F.array(*kinds).alias("features"), F.max("label").alias("label"))
    model = L.Invariants({(0, 1): [1.0, -1.0], (0, 2): [1.0, -2.0]}, 3, 2)
    return L.score_invariants(x, model).select("session_id", "label", r6("violation").alias("violation"), "pred")


@register("log_clustering_fit")
def log_clustering_fit(spark, sf):
    train, test = count_vectors(spark, sf, weighting="tf-idf")
    model = clustering.fit_log_clustering(train, bootstrap=100)
    return clustering.score_log_clustering(test, model.representatives).select("session_id", "label", r6("distance").alias("distance"), "pred")


@register("isolation_forest")
def isolation_forest(spark, sf):
    train, test = count_vectors(spark, sf)
    model = forest.fit_isolation_forest(train)
    return forest.score_isolation_forest(test, model).select("session_id", "label", r6("score").alias("score"), "pred")


@register("one_class_svm")
def one_class_svm(spark, sf):
    train, test = count_vectors(spark, sf)
    model = boundary.fit_one_class_svm(train)
    return boundary.score_one_class_svm(test, model).select("session_id", "label", r6("score").alias("score"), "pred")


@register("logistic_regression")
def logistic_regression(spark, sf):
    train, test = mixed_vectors(spark, sf)
    return SV.logistic_regression(train, test).select("session_id", "label", r6("probability").alias("probability"), "pred")


@register("linear_svm")
def linear_svm(spark, sf):
    train, test = mixed_vectors(spark, sf)
    return SV.linear_svm(train, test).select("session_id", "label", "pred")


@register("decision_tree")
def decision_tree(spark, sf):
    train, test = mixed_vectors(spark, sf)
    return SV.decision_tree(train, test).select("session_id", "label", "pred")


@register("supervised_session_classifier")
def supervised_session_classifier(spark, sf):
    s = materialise(V.sessions(spark, sf))
    f = session_features(D.encode_events(s, D.build_vocab_first_seen(s)))
    both = f.select("session_id", "label", F.col("quantitative").cast("array<double>").alias("features"))
    first = s.where(F.col("pos") == 0).select("session_id", "first_line")
    parts = materialise(split_stratified(both.join(first, "session_id"), 0.5))
    out = SV.session_classifier(parts.where(F.col("split") == "train"), parts.where(F.col("split") == "test"))
    return out.select("session_id", "label", r6("normal_probability").alias("normal_probability"), "pred")
