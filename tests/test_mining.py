"""Template mining against straightforward sequential folds written for the test."""

import random

import pytest
from pyspark.sql import functions as F

from logweir.functions.lcs import lcs_length, lcs_template, lcs_tokens
from logweir.operators import matching as M, mining as MI


def similarity(template, tokens):
    same = sum(a == b and a != "<*>" for a, b in zip(template, tokens))
    return same / len(tokens), template.count("<*>")


class NaiveTree:
    """Nested dictionaries, one list of clusters per leaf."""

    def __init__(self, depth, st, max_child):
        self.levels, self.short, self.st, self.max_child = depth - 3, depth - 2, st, max_child
        self.roots, self.clusters = {}, []

    def add(self, tokens):
        if len(tokens) < self.short or not tokens:
            self.clusters.append(list(tokens))
            return len(self.clusters) - 1
        node, leaf = self.roots.setdefault(len(tokens), {}), None
        for t in tokens[: self.levels]:
            node = node.get(t) or node.get("<*>")
            if node is None:
                break
        else:
            leaf = node.get("#leaf") if isinstance(node, dict) else None
        best = None
        for c in leaf or []:
            key = similarity(self.clusters[c], tokens)
            if best is None or key > best[0]:
                best = (key, c)
        if best and best[0][0] >= self.st:
            c = best[1]
            self.clusters[c] = [a if a == b else "<*>" for a, b in zip(self.clusters[c], tokens)]
            return c
        node = self.roots[len(tokens)]
        for t in tokens[: self.levels]:
            if t not in node:
                if any(ch.isdigit() for ch in t):
                    t = "<*>"
                elif "<*>" in node and len(node) >= self.max_child:
                    t = "<*>"
                elif "<*>" not in node and len(node) + 1 >= self.max_child:
                    t = "<*>"
            node = node.setdefault(t, {})
        self.clusters.append(list(tokens))
        node.setdefault("#leaf", []).append(len(self.clusters) - 1)
        return len(self.clusters) - 1


def lines_of(seed, n=150):
    rng = random.Random(seed)
    words = ["open", "close", "read", "write", "user", "file", "ok", "fail", "n1", "n2", "x9", "<*>"]
    return [[rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 4, 6]))] for _ in range(n)]


def frame(spark, lines):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(lines)], "line_id bigint, tokens array<string>").repartition(7)


@pytest.mark.parametrize("depth,st,max_child,block", [(5, 0.5, 100, 10**6), (3, 0.3, 1000, 10**6), (4, 0.4, 3, 10**6), (5, 0.5, 4, 9), (4, 0.6, 100, 4)])
def test_exact_mining_is_the_sequential_fold(spark, depth, st, max_child, block):
    lines = lines_of(depth + max_child)
    naive = NaiveTree(depth, st, max_child)
    joined = [naive.add(t) for t in lines]
    want = [" ".join(naive.clusters[c]) for c in joined]
    got = MI.drain_templates(frame(spark, lines), depth, st, max_child, exact=True, block_messages=block).collect()
    assert [" ".join(r.cluster_template) for r in sorted(got, key=lambda r: r.line_id)] == want
    by_cluster = {}
    for r in got:
        by_cluster.setdefault(r.cluster, set()).add(joined[r.line_id - 1])
    assert all(len(s) == 1 for s in by_cluster.values()) and len(by_cluster) == len(set(joined))


@pytest.mark.parametrize("seed", [0, 1])
def test_units_of_branches_are_the_sequential_tree(spark, seed):
    """Plain tokens and tokens with digits in all orders, few and many branches: each unit folds alone."""
    rng = random.Random(seed)
    firsts = ["a", "b", "c", "d", "e", "n1", "<*>", "x\u00b2"] if seed % 2 else ["a", "b", "c", "d", "e", "f", "g"]
    lines = [[rng.choice(firsts), rng.choice(firsts[:5] + ["7"]), rng.choice("pq"), rng.choice("rs")] for _ in range(160)]
    for depth, max_child in ((5, 3), (6, 5)):
        naive = NaiveTree(depth, 0.6, max_child)
        joined = [naive.add(t) for t in lines]
        got = MI.drain_templates(frame(spark, lines), depth, 0.6, max_child).collect()
        assert [" ".join(r.cluster_template) for r in sorted(got, key=lambda r: r.line_id)] == [" ".join(naive.clusters[c]) for c in joined]
        founder = {}
        for line, c in enumerate(joined, 1):
            founder.setdefault(c, str(line))
        assert {r.line_id: r.cluster for r in got} == {line: founder[c] for line, c in enumerate(joined, 1)}


def test_one_length_is_many_units(spark):
    lines = [f"verb{'abcdefghijklmnopqrstuvwxyz'[i % 26]} object{'abcd'[i % 4]} number{i} done".replace(f"number{i}", "x") .split() for i in range(520)]
    rows = frame(spark, lines).select(F.col("line_id").alias("msg_id"), F.lit(4).cast("bigint").alias("n"), F.slice("tokens", 1, 2).alias("head"))
    sizes = rows.join(MI.leaf_units(rows, 2, 100), ["n", "head"]).groupBy("grp").count().collect()
    assert max(r["count"] for r in sizes) <= 520 // 20


@pytest.mark.parametrize("block", [5, 10**6])
def test_distinct_mining_folds_first_occurrences(spark, block):
    lines = lines_of(77)
    first = list(dict.fromkeys(tuple(t) for t in lines))
    naive = NaiveTree(4, 0.5, 100)
    cluster = {t: naive.add(list(t)) for t in first}
    got = MI.drain_templates(frame(spark, lines), 4, 0.5, exact=False, block_messages=block).collect()
    assert all(r.cluster_template == naive.clusters[cluster[tuple(r.tokens)]] for r in got) and len(got) == len(lines)


def test_two_messages_merge(spark):
    lines = ["conn from a ok".split(), "conn from b ok".split()]
    mined = MI.drain_templates(frame(spark, lines), 3, 0.3)
    out, dictionary = MI.mining_result(mined)
    assert {r.template for r in out.collect()} == {"conn from <*> ok"}
    assert [(r.event_template, r.occurrences) for r in dictionary.collect()] == [("conn from <*> ok", 2)]


def test_short_lines_stay_apart_but_share_a_text(spark):
    mined = MI.drain_templates(frame(spark, [["x"], ["x"]]), 5, 0.5)
    assert len({r.cluster for r in mined.collect()}) == 2
    assert [(r.event_template, r.occurrences) for r in MI.mining_result(mined)[1].collect()] == [("x", 2)]


class NaiveSubsequences:
    """Containment and subsequence search only over a list; the index walk is a plain recursion."""

    def __init__(self, tau):
        self.tau, self.t, self.root = tau, [], {}

    @staticmethod
    def lcs(a, b):
        best = [[[] for _ in range(len(b) + 1)] for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + [a[i]] if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1], key=len)
        return best[-1][-1]


def test_lcs_helpers():
    assert lcs_tokens(list("abcbb"), list("bc")) == ["b", "c"]
    rng = random.Random(5)
    for _ in range(200):
        a = [rng.choice("abcd") for _ in range(rng.randrange(9))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(9))]
        want = NaiveSubsequences.lcs(a, b)
        got = lcs_tokens(a, b)
        assert len(got) == len(want) == lcs_length(a, b)
        for side in (a, b):
            it = iter(side)
            assert all(t in it for t in got)
    assert lcs_template(["b"], list("abc")) == ["<*>", "b", "<*>"]
    assert lcs_template([], list("abc")) == []


def same_sets(rows):
    """Messages that share a template, and the template."""
    sets = {}
    for r in rows:
        sets.setdefault(r.cluster, (tuple(r.cluster_template), set()))[1].add(tuple(r.tokens))
    return {(t, frozenset(m)) for t, m in sets.values()}


def is_subsequence(part, whole):
    rest = iter(whole)
    return all(t in rest for t in part)


def test_subsequence_mining_depends_on_contents_only(spark):
    lines = [t for t in lines_of(3, 50) if t]
    found = []
    for seed, parts in ((1, 1), (2, 9)):
        shuffled = lines * 2
        random.Random(seed).shuffle(shuffled)
        got = MI.spell_templates(frame(spark, shuffled).repartition(parts), 0.5).collect()
        assert len(got) == len(shuffled)
        found.append(same_sets(got))
    assert found[0] == found[1]
    for r in got:
        held = [t for t in r.cluster_template if t in r.tokens]
        constants = [t for t in r.cluster_template if t != "<*>"]
        assert is_subsequence(constants, r.tokens) and 2 * len(held) >= len(r.tokens)


def test_masked_parts_count_on_both_sides(spark):
    """Messages with more masked parts than constants, that differ in one token: masked parts are in common as constants are."""
    receive = [f"Receiving block blk_ <*> src <*> {5000 + i} dest <*> 50010" + (" mirror blk_ <*>" if i % 20 == 0 else "") for i in range(150)]
    serve = ["Served block blk_ <*> to <*>", "Served block blk_ <*> to <*> retry blk_ <*>"]
    rare = ["unheard of trouble", "disk <*> failed", "disk <*> failed hard"]
    got = MI.spell_templates(frame(spark, [t.split() for t in receive + serve + rare]), 0.5).collect()
    texts = {" ".join(r.cluster_template) for r in got}
    assert len(texts) == 4 and not any(str(5000 + i) in t.split() for t in texts for i in range(150))
    assert {" ".join(r.tokens) for r in got if r.cluster_template[:2] == ["Receiving", "block"]} == set(receive)


def test_leaders_of_many_groups(spark):
    lines = [f"open file f{i} ok".split() for i in range(12)] + [f"user u{i} left the room".split() for i in range(12)] + [[], ["x"], ["x"]]
    lines += [f"kind{k} of event number n{i} done".replace("number", f"no{k}").split() for k in range(9) for i in range(8)]
    random.Random(1).shuffle(lines)
    got = MI.spell_templates(frame(spark, lines), 0.6).collect()
    assert {"open file <*> ok", "user <*> left the room", "", "x"} <= {" ".join(r.cluster_template) for r in got}
    assert len(got) == len(lines)


def test_followers_that_would_empty_a_template_wait(spark):
    """Links in a chain: the ends have nothing in common, so they cannot share a template."""
    lines = ["a b c d".split(), "a b x y".split(), "u v c d".split(), "u v w z".split()]
    for r in MI.spell_templates(frame(spark, lines), 0.5).collect():
        constants = [t for t in r.cluster_template if t != "<*>"]
        assert len(constants) >= 2 and is_subsequence(constants, r.tokens)


def test_template_matching(spark):
    dictionary = spark.createDataFrame(
        [(0, "a b c".split()), (1, "a <*> c".split()), (2, "a b <*>".split()), (3, "q".split())], "template_no bigint, template array<string>"
    )
    lines = ["a b c", "a x c", "a b x", "q", "z", "a b", "x y z"]
    got = M.match_templates(frame(spark, [t.split() for t in lines]), dictionary, 0.5).collect()
    assert [r.template_no for r in sorted(got, key=lambda r: r.line_id)] == [0, 1, 2, 3, None, None, None]


def test_subsequence_matching(spark):
    dictionary = spark.createDataFrame(
        [(0, "a b c d".split()), (1, "a b c".split()), (2, "c b a".split())], "template_no bigint, template array<string>"
    )
    got = M.match_templates_lcs(frame(spark, [t.split() for t in ["a b c", "a b c d", "x y", "c b x"]]), dictionary, 0.5).collect()
    assert [(r.template_no, r.common) for r in sorted(got, key=lambda r: r.line_id)] == [(1, 3), (0, 4), (None, None), (2, 2)]


def test_lines_match_their_own_template(spark):
    lines = [t for t in lines_of(8) if len(t) >= 3]
    for r in MI.drain_templates(frame(spark, lines), 4, 0.4, exact=True).collect():
        assert len(r.tokens) == len(r.cluster_template)
        assert all(a in ("<*>", b) for a, b in zip(r.cluster_template, r.tokens))


@pytest.mark.parametrize("st", [0.0, 0.34, 0.5, 1.0])
def test_matching_by_index_is_matching_by_all(spark, st):
    """Every template compared with every message; messages and templates with wildcards, repeats and tokens the other side lacks."""
    rng = random.Random(11)
    words = ["a", "b", "c", "d", "e", "f", "<*>"]
    templates = [[rng.choice(words) for _ in range(rng.randrange(1, 6))] for _ in range(60)]
    lines = [[rng.choice(words + ["u", "v"]) for _ in range(rng.randrange(0, 6))] for _ in range(120)] + [["a"] * 4] * 30
    dictionary = spark.createDataFrame(list(enumerate(templates)), "template_no bigint, template array<string>").repartition(4)

    def equal(t, m):
        return sum(a == b and a != "<*>" for a, b in zip(t, m)) / len(m)

    want = []
    for m in lines:
        fits = [(equal(t, m), t.count("<*>"), -i) for i, t in enumerate(templates) if m and len(t) == len(m)]
        best = max((f for f in fits if f[0] >= st), default=None)
        want.append((-best[2], best[0]) if best else (None, None))
    got = sorted(M.match_templates(frame(spark, lines), dictionary, st).collect(), key=lambda r: r.line_id)
    assert [(r.template_no, r.similarity) for r in got] == want
    if st == 0:
        return
    want = []
    for m in lines:
        fits = [(lcs_length(m, t), -len(t), -i) for i, t in enumerate(templates) if m and len(set(m) & set(t)) >= 0.5 * len(m)]
        best = max(fits, default=None)
        want.append((-best[2], best[0]) if best and best[0] >= st * len(m) else (None, None))
    got = sorted(M.match_templates_lcs(frame(spark, lines), dictionary, st).collect(), key=lambda r: r.line_id)
    assert [(r.template_no, r.common) for r in got] == want
