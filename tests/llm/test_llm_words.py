"""Ranked search and spelling variants against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import cases
import numpy as np
import pytest

from logweir.llm import lexical_search, spelling, term_tree
from logweir.llm.word_automaton import Acceptor, OneEdit

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def ranked(rows, items, most):
    vectors = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    n, total = len(vectors), sum(sum(v.values()) for _, v in vectors)
    df = Counter(t for _, v in vectors for t in v)
    found = []
    for item, text in set(items):
        asked, scored = Counter(terms(text)), []
        for k, (i, v) in enumerate(vectors):
            m = 75 + (25 * sum(v.values()) * n) // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * v[t] // (1000 * v[t] + 12 * m)) for t, q in asked.items() if v[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, k, i))
        found += [(item, r, i, -s) for r, (s, _, _, _, i) in enumerate(sorted(scored)[:most], 1)]
    return Counter(found)


ITEMS = [
    (1, cases.prose(2, 300, 12)[:200]),
    (2, "bab BAB deno nothing-else"),
    (3, None),
    (4, ""),
    (5, "unheard of"),
    (6, "日本語 ñandú x"),
    (6, "bab"),
    (2, "bab BAB deno nothing-else"),
    (None, "kunte tolu"),
    (7, "bab"),
]


def search_rows():
    rows = cases.odd_rows() + [(400 + i, cases.prose(i, 3 + i % 60)) for i in range(300)]
    return rows + [(900 - i, cases.prose(5, 40)) for i in range(150)]


@pytest.mark.parametrize("block,group,most", [(1 << 14, 1 << 20, 20), (64, 300, 20), (64, 1 << 20, 3)])
def test_best_documents(spark, block, group, most, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "GROUP_BYTES", group)
    monkeypatch.setattr(lexical_search, "_searcher", _with_block(lexical_search._searcher, block))
    items = spark.createDataFrame([(*i, "x", 1) for i in ITEMS], "item_id long, text string, key string, rank int")
    rows = search_rows()
    got = lexical_search.best_documents(cases.with_clashes(spark, rows), items, most=most).collect()
    assert Counter(map(tuple, got)) == ranked(rows, ITEMS, most)


def _with_block(make, block):
    """The block size as the workers see it."""

    def made(*args):
        run = make(*args)

        def inside(batches, shared):
            from logweir.llm import lexical_search as there

            there.BLOCK = block
            return run(batches, shared)

        return inside

    return made


def test_tables_without_rows(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.best_documents(cases.empty(spark), items).count() == 0
    assert lexical_search.best_documents(cases.odd(spark), items.limit(0)).count() == 0
    assert spelling.spelling_variants(cases.empty(spark)).count() == 0


def test_trees_bound_every_document():
    r = np.random.default_rng(4)
    for n, vocabulary in ((0, 5), (1, 5), (40, 3), (700, 12), (1500, 300)):
        sizes = r.integers(0, min(vocabulary, 40) + 1, n)
        ranks = np.concatenate([r.choice(vocabulary, s, replace=False, p=_zipf(vocabulary)) for s in sizes] or [np.empty(0, np.int64)]).astype(np.int64)
        tfs, m, ids = r.integers(1, 5, len(ranks)), r.integers(75, 300, n), r.permutation(n)
        offsets = np.r_[0, np.cumsum(sizes)]
        tree = term_tree.TermTree(offsets, ranks, tfs, m, vocabulary)
        seen = Counter()
        for k, c in enumerate(tree.children):
            if c == (0, 0):
                seen.update(range(tree.first[k], tree.after[k]))
                assert tree.after[k] - tree.first[k] <= term_tree.LEAF
        assert seen == Counter(range(n))
        dense = np.zeros((n, vocabulary), np.int64)
        dense[np.repeat(np.arange(n), sizes), ranks] = tfs
        for _ in range(30):
            asked = r.choice(vocabulary, int(r.integers(1, min(vocabulary, 8) + 1)), replace=False)
            weights = r.integers(1, 9000, len(asked))
            scores = (term_tree.term_share(dense[:, asked], m[:, None]) * weights).sum(axis=1)
            order = [i for i in np.lexsort((ids, -scores)) if scores[i] > 0]
            found, got = tree.best(asked, weights, ids, 7)
            assert found.tolist() == order[:7] and got.tolist() == scores[order[:7]].tolist()
            if len(order) >= 7:
                assert tree.best(asked, weights, ids, 7, int(scores[order[6]]))[0].tolist() == order[:7]


def _zipf(n):
    p = 1 / np.arange(1, n + 1)
    return p / p.sum()


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_composition_accepts_each_pair_once():
    r = random.Random(3)
    for letters, count, most in (("a", 9, 9), ("ab", 40, 6), ("abc", 150, 5), ("abcdefgh", 200, 4)):
        for _ in range(20):
            words = sorted({"".join(r.choice(letters) for _ in range(r.randrange(most))) for _ in range(count)})
            machine = Acceptor(words)
            got = Counter(frozenset(p) for p in OneEdit(machine).pairs())
            assert got == Counter(frozenset((a, b)) for a in words for b in words if a < b and near(a, b))
    machine = Acceptor(sorted(a + b for a in ("x", "yy", "z") for b in ("ing", "ion", "able")))
    assert len(machine.arcs) < 12
    assert Counter(map(frozenset, OneEdit(Acceptor(["a" * 30_000, "a" * 15_000 + "b" * 15_000, "a" * 15_000 + "b" * 14_999, "c" * 9])).pairs())).total() == 1


def variants(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    close = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, xs in close.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(close[w]), words.get(form[w])) for w, n in words.items()}


def variant_rows():
    r = random.Random(8)
    base = ["".join(r.choice("abéÿ×") for _ in range(r.randrange(7, 10))) for _ in range(12)] + ["aaaaaaa", "aaaaaaaa", "Aaaaaaaab", "bbbbbbbb", "thousand"]
    rows = cases.odd_rows()
    for k, word in enumerate(base):
        rows += [(1000 + 40 * k + i, f"{word} " * (300 if i % 5 == 0 else 2)) for i in range(8)]
        for _ in range(12):
            at = r.randrange(len(word) + 1)
            other = r.choice([word[:at] + r.choice("abé") + word[at:], word[:at] + word[at + 1 :], word[:at] + r.choice("abz") + word[at + 1 :]])
            rows.append((r.randrange(5000), " ".join([other] * r.choice([2, 3, 25]))))
    return rows + [(8000, "q" * 300 + " " + "q" * 299 + "w " + "q" * 300 + "-" + "q" * 299 + "w"), (None, "thousand thousend Thousand thousend")]


@pytest.mark.parametrize("part", [30_000, 3])
def test_spelling_variants(spark, part, monkeypatch):
    monkeypatch.setattr(spelling.near_words, "__defaults__", (part,))
    rows = variant_rows() + [(50_000 + i, "zzyzzyx " * 2000) for i in range(1)]
    got = spelling.spelling_variants(cases.with_clashes(spark, rows)).collect()
    assert len(got) == len({r.word for r in got})
    assert {tuple(r) for r in got} == variants(rows)
