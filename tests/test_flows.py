"""Whole flows on a few hand-made lines."""

from dataclasses import replace

from pyspark.sql import functions as F

from logweir.detectors import linear_space
from logweir.operators.sessions import session_heads, sessionize
from logweir.plans import flows


def hdfs_lines(spark, n=40):
    rows = []
    for i in range(n):
        for step, text in enumerate([f"Receiving block blk_{i} src: /10.0.0.{i}:50", f"Served block blk_{i} to /10.0.0.{i}", f"PacketResponder {i % 3} for block blk_{i} terminating"]):
            rows.append(f"081109 2035{step} {i} INFO dfs.DataNode$X: {text}")
    rows.insert(7, "no format here")
    return spark.createDataFrame(list(enumerate(rows)), "line_no bigint, line string").repartition(5)


def test_keyed_flow(spark):
    structured, dictionary = flows.mined_log(hdfs_lines(spark), flows.HDFS)
    assert {r.event_template for r in dictionary.collect()} == {
        "Receiving block blk_<*> src: /<*>:50", "Served block blk_<*> to /<*>", "PacketResponder <*> for block blk_<*> terminating"
    }
    labels = spark.createDataFrame([(f"blk_{i}", int(i >= 30)) for i in range(39)], "session_id string, label int")
    sessions = flows.keyed_sessions(structured, labels, flows.HDFS)
    heads = {r.session_id: (r.split, r.n_events) for r in sessions.where("pos = 0").collect()}
    assert "blk_39" not in heads and {n for _, n in heads.values()} == {3}
    kinds = [s for s, _ in heads.values()]
    assert (kinds.count("train"), kinds.count("test_normal"), kinds.count("test_abnormal")) == (24, 6, 9)
    assert all(heads[f"blk_{i}"][0] == "test_abnormal" for i in range(30, 39))
    verdicts = flows.masked_event_verdicts(sessions, 3, 0.85, 0.0, min_len=1)
    assert {r.pred for r in verdicts.collect()} == {0}


def test_detectors_on_count_vectors(spark):
    rows, labels = [], []
    for i in range(60):
        bad = i >= 40
        steps = ["open", "read", "close"] + (["failure", "failure", "abort"] if bad else ["read"] * (i % 2))
        rows += [(f"s{i:02d}", 100 * i + k, e, int(bad)) for k, e in enumerate(steps)]
    lines = spark.createDataFrame(rows, "session_id string, line_id bigint, event string, y int").repartition(3)
    found = sessionize(lines, totals={"label": ("max", "y")}).drop("y")
    sessions = flows._with_split(found.drop("label"), session_heads(found).select("session_id", "n_events", "label"), replace(flows.HDFS, train=0.5))
    names = ["residual", "clusters", "forest", "logistic", "margin", "tree"]
    got = {r.detector: r for r in flows.detector_metrics(sessions, names).collect()}
    assert list(got) == names
    assert all(got[d].f1 == 100 for d in ("logistic", "margin", "tree"))
    train, test = flows.mixed_count_vectors(sessions)
    kinds = {(r.label, r["count"]) for r in train.groupBy("label").count().collect()}
    assert kinds == {(0, 20), (1, 8)} and test.count() == 32


def test_residuals_of_a_log_without_normal_sessions(spark):
    """Nothing is trained, so no event is known and every session stays with a residual of 0."""
    rows = [(f"s{i}", 10 * i + k, e, 1) for i in range(4) for k, e in enumerate(["open", "read", "close"])]
    lines = spark.createDataFrame(rows, "session_id string, line_id bigint, event string, y int").repartition(3)
    sessions = sessionize(lines, totals={"label": ("max", "y")}).withColumn("split", F.lit("test_abnormal"))
    train, test = flows.count_vectors(sessions)
    got = linear_space.score_pca(test, linear_space.fit_pca(train, 0.8, threshold=1.0)).collect()
    assert sorted((r.session_id, r.label, r.spe, r.pred) for r in got) == [(f"s{i}", 1, 0.0, 0) for i in range(4)]


def test_timed_flow_and_prefix(spark):
    rows = [f"{'ERR' if i == 50 else '-'} 1131566461 2005.11.09 adm Nov 9 12:{i // 60:02d}:{i % 60:02d} adm/adm ntpd[{i}]: synchronized to 10.1.1.{i}" for i in range(120)]
    lines = spark.createDataFrame(list(enumerate(rows)), "line_no bigint, line string").repartition(3)
    preset = replace(flows.THUNDERBIRD, prefix_lines=100, train=2)
    structured, dictionary = flows.mined_log(lines, preset)
    assert structured.count() == 100 and dictionary.count() == 1
    sessions = flows.timed_sessions(structured, preset)
    heads = sorted((r.session_id, r.n_events, r.label, r.split) for r in sessions.where("pos = 0").collect())
    assert [(k, n, y) for k, n, y, _ in heads] == [(0, 60, 1), (1, 60, 1), (2, 40, 0)]
    assert {s for *_, s in heads} == {"train", "test_abnormal"}
    sweep = flows.next_event_sweep(sessions, 2, 1, min_len=1).collect()
    assert {r.threshold for r in sweep} <= set(range(10))


def test_flagship_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.count() > 0 and "pred" in rows.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
