"""Quality ledger, URL rules, the language model and the pipeline."""

import math
import zlib
from collections import Counter

import cases
import compare
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from logweir.llm import maxent_lm, quality_rules, url_filters
from logweir.llm.queries import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles()))
def test_query_gives_the_rows_of_its_sql(spark, name):
    rows, same, note = compare.compare(spark, compare.connect(SF), name, queries()[name], oracles()[name], SF)
    assert same, note
    assert rows > 0


def plain_measures(text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {p + k for p, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_ledger_measures_and_ablations(spark):
    rows = cases.odd_rows()
    docs = cases.odd(spark).select(F.struct("*").alias("doc"), "text")
    ledger = quality_rules.quality_ledger(docs, keep=["doc"])
    got = ledger.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert Counter(tuple(r) for r in got) == Counter((i, *plain_measures(t)) for i, t in rows)
    bits = [r.fail_bits for r in ledger.select("fail_bits").collect()]
    policy = quality_rules.mask("full-1")
    for r in quality_rules.ablations(ledger, ["full-1"]).collect():
        rule = quality_rules.mask([r.rule])
        assert r.n_rejected == sum(b & policy != 0 for b in bits)
        assert r.n_failed == sum(b & rule != 0 for b in bits)
        assert r.n_rejected_by_it_alone == sum(b & policy == rule for b in bits)
    assert quality_rules.quality_ledger(cases.empty(spark).select("doc_id", "text")).count() == 0


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/de/", "block")]


def test_urls_are_judged_by_host_rules_then_by_mined_ones(spark):
    links = ["http://a.EXAMPLE.org/es/1?x=1", "https://example.org/en", "http://forexample.org/es/2", "http://x.com/de/1", "http://x.com/DE/1", None, "no scheme", "", "http://x.com", "http://y.net/a#b/c", "x://y://z/p"]
    rows = [(i, u) for i, u in enumerate(links)]
    rows += [(100 + i, f"http://{'casino' if i % 3 == 0 else 'plain'}.net/{'win' if i % 2 else 'page'}/{i}") for i in range(120)]
    rows += [(None, "http://casino.net/win/5"), (1, "https://example.org/en")]
    pages = spark.createDataFrame([(i, u, "clash", True) for i, u in rows], "page_id long, url string, tokens string, bad boolean")
    labels = spark.createDataFrame([(100 + i, i % 6 == 3) for i in range(100)] + [(None, True)], "page_id long, bad boolean")
    got = url_filters.judge_urls(pages, labels, RULES).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    assert [(by_id[i].host, by_id[i].path, by_id[i].rule, by_id[i].verdict) for i in range(11)] == [
        ("a.example.org", "/es/1", "example.org/es/", "block"),
        ("example.org", "/en", "org/", "allow"),
        ("forexample.org", "/es/2", "org/", "allow"),
        ("x.com", "/de/1", "com/de/", "block"),
        ("x.com", "/DE/1", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("x.com", "", None, "allow"),
        ("y.net", "/a", None, "allow"),
        ("y:", "//z/p", None, "allow"),
    ]
    for i in range(120):
        assert by_id[100 + i].verdict == ("block" if i % 6 == 3 else "allow")
    assert by_id[None].verdict == "block"
    assert url_filters.judge_urls(pages.limit(0), labels, RULES).count() == 0
    assert {r.verdict for r in url_filters.judge_urls(pages.where("page_id > 99"), labels.limit(0), RULES).collect()} == {"allow"}


def test_pruned_rules_and_the_inverted_index(spark):
    rows = [(["a", "b", str(i % 5)], True) for i in range(40)] + [(["a", str(i % 5)], False) for i in range(40)] + [(["b", "c"], False) for _ in range(40)]
    mined = url_filters.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.05, 0.8)
    assert [tuple(r.antecedent) for r in mined.collect()] == [("a", "b")]
    sets = spark.createDataFrame([(["a", "b"],), (["a"],), (["b", "x", "a"],), (["b", "c"],)], "tokens array<string>")
    assert {tuple(r.tokens) for r in url_filters.blocked_sets(sets, mined).collect()} == {("a", "b"), ("b", "x", "a")}


def test_scores_have_the_stated_base_and_sum_to_one(spark):
    rows = cases.odd_rows() + [(100 + i, cases.prose(i % 9, 80)) for i in range(60)]
    got = maxent_lm.score_documents(cases.with_clashes(spark, rows)).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in maxent_lm.tokens_of(t))
    total, words = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in rows:
        tokens = maxent_lm.tokens_of(t)
        base = sum(math.log10((counts[w] + 1) / (total + words + 1)) for w in tokens)
        want[i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), total, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    assert maxent_lm.score_documents(cases.empty(spark)).count() == 0


def test_class_shares_are_probabilities(spark):
    docs = cases.with_clashes(spark, [(i, cases.prose(i, 200) + f" once{i}") for i in range(20)])
    counts = maxent_lm.count_tokens(docs)
    words = maxent_lm.Vocabulary(counts)
    sums = Counter()
    for c, share in zip(words.top_class, 10**words.top_within):
        sums[c] += share
    assert all(abs(s - 1) < 1e-9 for s in sums.values())
    assert all(words.rare_total[c] >= words.rare_once[c] > 0 for c in words.rare_total)


def test_steps_and_shares_are_those_of_the_softmax():
    r = np.random.default_rng(5)
    n = 3000
    scores, wanted = r.normal(0, 9, (n, 16)).astype(np.float32), r.integers(0, 16, n)
    shares = np.exp(scores.astype(float) - scores.max(axis=1, keepdims=True))
    shares /= shares.sum(axis=1, keepdims=True)
    slope = np.eye(16)[wanted] - shares
    assert np.allclose(maxent_lm._log_shares(scores, wanted), np.log(shares[np.arange(n), wanted]), atol=1e-4)
    assert np.allclose(maxent_lm._slopes(scores, wanted), slope, atol=1e-5)
    for rows in (np.zeros(n, int), r.integers(0, 16, n), r.integers(0, 500, n), r.zipf(1.3, n) % 9000, r.permutation(n)):
        order = np.argsort(rows, kind="stable")
        used, starts = np.unique(rows[order], return_index=True)
        want = np.stack([slope[rows == u].sum(axis=0) for u in used])
        assert np.allclose(maxent_lm._summed(slope.astype(np.float32), order, starts), want, atol=2e-3)


def test_words_keep_their_numbers_hashes_and_classes():
    class Words:
        top, top_class = [b"a", b"b"], np.array([0, 1], np.int32)

    reader = maxent_lm._Reader(Words)
    first, _, _ = reader.read(["a x B y x", None])
    again, hashes, classes = reader.read(["y z a"])
    assert [x.tolist() for x in first] == [[0, 2, 1, 3, 2, 4], [4]] and [x.tolist() for x in again] == [[3, 5, 0, 4]]
    assert reader.number.names == [b"a", b"b", b"x", b"y", b"\n", b"z"]
    assert hashes.tolist() == [xxhash.xxh64_intdigest(t) for t in reader.number.names]
    assert classes.tolist() == [0, 1] + [248 + xxhash.xxh64_intdigest(t, 1) % 8 for t in reader.number.names[2:]]


def test_pipeline_stages(spark):
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) for r in cases.odd_rows()], "doc_id long, text string, lang string, source string, n_chars long")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "pack"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = Counter(r.doc_id for r in docs.collect())
    assert ids[1] == 1 and ids[8] == 1 and ids[9] == 1 and ids[10] == 1 and not any(ids[i] for i in (4, 5, 6, 7, 11, 12))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == set(ids)
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    assert corpus_pipeline.run(spark, SF).count() > 0
