"""Fitted detectors against numpy and hand-made cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir.detectors import boundary, clustering, context_counts as C, forest, linear_space as L, supervised as SV
from logweir.operators import candidates as CA, evaluation as E, features as FE, matching as M, splits as SP


def vectors(spark, x, name="features", label=None):
    rows = [(f"s{i:04d}", i, [float(v) for v in row], int(label[i]) if label is not None else 0) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, f"session_id string, first_line bigint, {name} array<double>, label int").repartition(5)


def counts(seed=0, n=200, width=6):
    rng = np.random.default_rng(seed)
    return rng.poisson(rng.uniform(0.3, 4, width), (n, width)).astype(float)


def test_metrics_example(spark):
    df = spark.createDataFrame(list(zip([1, 1, 1, 0, 0, 0], [1, 0, 1, 1, 0, 0])), "pred int, truth int")
    r = E.classification_metrics(df).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (2, 1, 2, 1)
    assert (r.precision, r.recall, r.f1) == (66.6667, 66.6667, 66.6667)


def test_metrics_without_hits_are_null(spark):
    df = spark.createDataFrame([(0, 0), (0, 1)], "pred int, truth int")
    assert E.classification_metrics(df, guarded=False).first().f1 is None


def test_verdict_without_tried_positions_is_normal(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 4, 0), (0, 4, 1)], "undetected int, masked int, far int")
    assert [r.pred for r in E.session_verdict(df, 0.0, hypersphere="far").collect()] == [0, 1, 1]


def test_sweep_keeps_the_first_best(spark):
    df = spark.createDataFrame([(3, 1), (3, 1), (0, 0), (0, 0)], "undetected int, label int")
    best = E.best_threshold(E.threshold_sweep(df)).first()
    assert (best.threshold, best.f1) == (0, 100.0)


@pytest.mark.parametrize("n_components", [0.8, 0.95, 2])
def test_pca_against_numpy(spark, n_components):
    x = counts()
    model = L.fit_pca(vectors(spark, x), n_components)
    values, basis = np.linalg.eigh(x.T @ x / len(x))
    values, basis = values[::-1], basis[:, ::-1]
    k = n_components if n_components >= 1 else int(np.argmax(np.cumsum(values) / values.sum() >= n_components)) + 1
    rest = x - x @ basis[:, :k] @ basis[:, :k].T
    got = {r.session_id: r.spe for r in L.score_pca(vectors(spark, x), model).collect()}
    assert [got[f"s{i:04d}"] for i in range(len(x))] == pytest.approx((rest**2).sum(1).tolist(), abs=1e-6)
    p1, p2, p3 = ((values[k:] ** i).sum() for i in (1, 2, 3))
    h = 1 - 2 * p1 * p3 / (3 * p2 * p2)
    assert model.threshold == pytest.approx(p1 * (3.2905 * np.sqrt(2 * p2 * h * h) / p1 + 1 + p2 * h * (h - 1) / p1**2) ** (1 / h))


def test_pca_without_training_rows(spark):
    x = np.array([[1.0, 2.0], [0.0, 0.0]])
    model = L.fit_pca(vectors(spark, x).limit(0), 0.8, threshold=1.0)
    got = sorted((r.spe, r.pred) for r in L.score_pca(vectors(spark, x), model).collect())
    assert got == [(0.0, 0), (5.0, 1)]


def test_invariants_are_found_and_broken(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 9, 120), rng.integers(1, 9, 120)
    x = np.stack([a, 2 * a, b, a + b, np.zeros(120)], 1).astype(float)
    model = L.fit_invariants(vectors(spark, x))
    assert model.dimension == 3 and model.weights[(4,)] == [1.0]
    assert (0, 1) in model.weights and len(model.weights) == 3
    for cols, w in model.weights.items():
        assert np.abs(x[:, cols] @ np.array(w)).max() < 1e-9
    bad = x.copy()
    bad[0, 1] += 1
    got = {r.session_id: r.pred for r in L.score_invariants(vectors(spark, bad), model).collect()}
    assert got["s0000"] == 1 and sum(got.values()) == 1


def test_hypersphere_against_numpy(spark):
    x = np.random.default_rng(2).normal(size=(103, 5))
    model = L.fit_hypersphere(vectors(spark, x, "embedding"), 0.25)
    d = np.linalg.norm(x - x.mean(0), axis=1)
    assert model.center == pytest.approx(x.mean(0).tolist()) and model.radius == pytest.approx(np.quantile(d, 0.75))
    assert L.score_hypersphere(vectors(spark, x, "embedding"), model).agg(F.sum("pred")).first()[0] == int((d > model.radius).sum())


def cosine(x, y):
    d = 1 - x @ y / (np.linalg.norm(x) * np.linalg.norm(y) + 1e-8)
    return 0.0 if d < 1e-8 else d


def test_complete_linkage_keeps_clusters_tight():
    x = counts(3, 60, 4) + 0.1
    means, sizes = clustering.complete_linkage(x, 0.2)
    assert sizes.sum() == 60 and 1 < len(means) < 60
    two = np.array([[1, 0.0], [2, 0], [0, 3], [0, 1]])
    means, sizes = clustering.complete_linkage(two, 0.3)
    assert sorted(map(tuple, means.tolist())) == [(0.0, 2.0), (1.5, 0.0)] and sizes.tolist() == [2, 2]


@pytest.mark.parametrize("bootstrap", [20, 1000])
def test_clustering_covers_training_rows(spark, bootstrap):
    x = counts(4, 150, 4)
    model = clustering.fit_log_clustering(vectors(spark, x), 0.3, bootstrap=bootstrap)
    assert model.sizes.sum() == 150
    got = clustering.score_log_clustering(vectors(spark, x), model.representatives, 0.3).collect()
    for r in got:
        assert r.distance == pytest.approx(min(cosine(np.array(r.features), c) for c in model.representatives), abs=1e-9)


def sequential_representatives(x, start, max_dist):
    reps, sizes = [list(c) for c in start[0]], list(start[1])
    for v in x:
        d = [cosine(v, np.array(c)) for c in reps]
        k = int(np.argmin(d))
        if d[k] <= max_dist:
            sizes[k] += 1
            reps[k] = np.array(reps[k]) + (v - np.array(reps[k])) / sizes[k]
        else:
            reps.append(v)
            sizes.append(1)
    return [np.array(c) for c in reps]


def test_clustering_verdicts_agree_with_row_by_row(spark):
    rng = np.random.default_rng(5)
    base = np.array([[5, 0, 1, 0], [0, 4, 0, 1], [1, 1, 6, 0.0]])
    x = np.vstack([base[rng.integers(0, 3, 160)] + rng.integers(0, 2, (160, 4)), [[0, 0, 0, 9.0]] * 4])
    model = clustering.fit_log_clustering(vectors(spark, x[:120]), 0.3, bootstrap=30)
    row_by_row = sequential_representatives(x[30:120], clustering.complete_linkage(x[:30], 0.3), 0.3)
    got = {r.session_id: r.pred for r in clustering.score_log_clustering(vectors(spark, x), model.representatives, 0.3).collect()}
    want = [int(min(cosine(v, c) for c in row_by_row) > 0.3) for v in x]
    assert np.mean([got[f"s{i:04d}"] == w for i, w in enumerate(want)]) > 0.95
    assert all(got[f"s{i:04d}"] == 1 for i in range(160, 164))


@pytest.mark.parametrize("chunk", [1, 2, 50])
def test_nearest_representative_chunks(spark, chunk):
    x, reps = counts(6, 40, 3) + 0.5, counts(7, 5, 3) + 0.5
    got = M.nearest_representative(vectors(spark, x), reps, chunk=chunk).collect()
    for r in got:
        d = [cosine(np.array(r.features), c) for c in reps]
        assert r.rep == int(np.argmin(d)) and r.distance == pytest.approx(min(d), abs=1e-9)


@pytest.mark.parametrize("trees", [20, 2])
def test_forest_flags_outliers(spark, trees):
    x = np.vstack([np.random.default_rng(8).normal(size=(300, 3)), [[9, 9, 9], [-8, 9, -9]]])
    model = forest.fit_isolation_forest(vectors(spark, x), trees=trees, max_samples=64, contamination=0.02)
    got = {r.session_id: (r.score, r.pred) for r in forest.score_isolation_forest(vectors(spark, x), model).collect()}
    assert all(-1 <= s <= 0 for s, _ in got.values())
    assert got["s0300"][1] == 1 and got["s0301"][1] == 1
    assert sum(p for _, p in got.values()) <= 0.02 * 302 + 1
    again = forest.fit_isolation_forest(vectors(spark, x).repartition(5), trees=trees, max_samples=64, contamination=0.02)
    assert all((a == b).all() for a, b in zip(model.trees, again.trees, strict=True)) and len(model.trees) == trees
    assert forest.expected_path(2)[0] == 1 and forest.expected_path(256)[0] == pytest.approx(10.244, abs=0.01)


def test_boundary_separates_far_rows(spark):
    x = np.vstack([np.random.default_rng(9).normal(size=(200, 2)), [[12, 12], [-12, 11]]])
    model = boundary.fit_one_class_svm(vectors(spark, x[:200]), nu=0.2)
    got = {r.session_id: r.pred for r in boundary.score_one_class_svm(vectors(spark, x), model).collect()}
    assert got["s0200"] == 1 and got["s0201"] == 1
    assert 0.1 < np.mean([got[f"s{i:04d}"] for i in range(200)]) < 0.3


@pytest.mark.parametrize("fit", [SV.logistic_regression, SV.linear_svm, SV.decision_tree])
def test_supervised(spark, fit):
    rng = np.random.default_rng(10)
    y = rng.integers(0, 2, 120)
    x = rng.normal(size=(120, 3)) + 4 * y[:, None]
    got = fit(vectors(spark, x, label=y), vectors(spark, x, label=y)).collect()
    assert np.mean([r.pred == r.label for r in got]) > 0.95


def test_session_classifier_and_text_vectors(spark):
    y = np.array([0, 1] * 30)
    x = np.random.default_rng(11).normal(size=(60, 2)) + 5 * y[:, None]
    got = SV.session_classifier(vectors(spark, x, label=y), vectors(spark, x, label=y)).collect()
    assert np.mean([r.pred == r.label for r in got]) > 0.9
    v = SV.text_vectorizer(spark.createDataFrame([("a b a",), ("",)], "msg string")).collect()
    assert [len(r.vector) for r in v] == [256, 256] and sum(v[1].vector) == 0 and sum(v[0].vector) > 0


def sessions(spark, seqs, label=0):
    rows = [(f"s{i}", p, e, len(s), label, i) for i, s in enumerate(seqs) for p, e in enumerate(s)]
    return spark.createDataFrame(rows, "session_id string, pos bigint, event string, n_events bigint, label int, first_line bigint")


@pytest.mark.parametrize("small", [0, 1000])
def test_next_event_backs_off(spark, small):
    train = sessions(spark, [list("abcabc"), list("abcd")])
    test = sessions(spark, [list("abcx"), list("zbc")], 1)
    got = {r.session_id: (r.logkey_anomaly, r.predicted_logkey) for r in C.next_event_detector(train, test, 2, 1, small=small).collect()}
    # s0: a b -> c known; b c -> x missed; the padded end is missed. s1: z b backs off to b -> c; padded end missed.
    assert got == {"s0": (2, 3), "s1": (1, 2)}
    plain = {r.session_id: r.logkey_anomaly for r in C.next_event_detector(train, test, 2, 1, False, small).collect()}
    assert plain == {"s0": 1, "s1": 0}


@pytest.mark.parametrize("small", [0, 1000])
def test_masked_events(spark, small):
    train = sessions(spark, [list("abc")] * 3 + [list("axc")])
    test = sessions(spark, [list("abc"), list("aqc")], 1)
    full = C.masked_event_detector(train, test, 1, 1.1, 5, small)
    assert {(r.session_id, r.masked_tokens, r.total_logkey) for r in full.collect()} == {("s0", 3, 4), ("s1", 3, 4)}
    none = C.masked_event_detector(train, test, 1, 0.0, 5, small).collect()
    assert {(r.masked_tokens, r.undetected_tokens) for r in none} == {(0, 0)}


def test_not_in_top_g_without_context(spark):
    targets = spark.createDataFrame([("s", "a", "x"), ("s", "q", "x")], "session_id string, ctx string, e string")
    lists = spark.createDataFrame([("a", ["x"])], "ctx string, candidates array<string>")
    r = CA.not_in_top_g(targets, lists, ["ctx"], "e").first()
    assert (r.masked, r.undetected) == (2, 1)


def test_count_features_against_numpy(spark):
    train, test = sessions(spark, [list("aab"), list("bc"), list("a")]), sessions(spark, [list("abz"), list("zz"), list("zy")])

    def rows(fitted, df):
        return {r.session_id: [round(v, 6) for v in r.features] for r in fitted.vectors(df).collect()}

    plain = FE.fit_count_features(train)
    assert rows(plain, test) == {"s0": [1, 1, 0], "s1": [0, 0, 0], "s2": [0, 0, 0]}
    oov = FE.fit_count_features(train, oov=True, min_count=2)
    assert rows(oov, train) == {"s0": [2, 1, 0], "s1": [0, 1, 1], "s2": [1, 0, 0]}
    assert rows(oov, test) == {"s0": [1, 1, 1], "s1": [0, 0, 1], "s2": [0, 0, 2]}
    x = np.array([[2, 1, 0], [0, 1, 1], [1, 0, 0.0]]) * np.log(3 / (np.array([2, 2, 1]) + 1e-8))
    weighted = FE.fit_count_features(train, weighting="tf-idf", normalization="zero-mean")
    got = rows(weighted, train)
    assert np.array([got[f"s{i}"] for i in range(3)]) == pytest.approx(x - x.mean(0), abs=1e-5)
    sig = FE.fit_count_features(train, normalization="sigmoid")
    assert rows(sig, test)["s0"] == [round(1 / (1 + np.exp(-1)), 6)] * 2 + [0]


def test_splits_by_count_and_missing_label(spark):
    df = spark.createDataFrame([(f"s{i}", None if i == 9 else int(i > 6)) for i in range(10)], "session_id string, label int")
    got = [r.split for r in SP.split_normal_abnormal(df, 3, 1).collect()]
    assert (got.count("train"), got.count("test_normal"), got.count("test_abnormal")) == (3, 4, 2)
    assert SP.sample_without_replacement(df, ["session_id"], 4, 1).count() == 4


def test_models_are_stored_and_read_back(spark, tmp_path):
    from logweir.detectors.forest import Forest
    from logweir.sources.models import read_model, write_model

    models = [
        L.ResidualModel(np.arange(6.0).reshape(3, 2), 0.5),
        L.Invariants({(0, 2): [1.0, -2.0], (1,): [1.0]}, 3, 2),
        L.Hypersphere([0.1, 0.2], 1.5),
        Forest([np.eye(5), np.ones((2, 5))], 256, -0.5),
    ]
    for k, model in enumerate(models):
        back = read_model(spark, write_model(spark, model, str(tmp_path / str(k))), type(model))
        assert str(back) == str(model)
