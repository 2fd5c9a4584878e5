"""Near-duplicates, benchmark passages, long matches and line chunks against brute force."""

import hashlib
from collections import Counter
from itertools import combinations

import cases
import numpy as np
import pytest

from logweir.llm import components as C, decontamination, line_chunks, long_matches, near_duplicates
from logweir.llm.run_index import SEPARATOR, RunIndex

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = [w.decode() for w in (text or "").translate(LOWER).encode().split()]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def component_ids(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    label = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            old, new = label[b], label[a]
            label = [new if x == old else x for x in label]
    first = {}
    for (i, _), x in zip(rows, label):
        if i is not None:
            first[x] = min(i, first.get(x, i))
    return Counter((i, len(s), first.get(x, i)) for (i, _), s, x in zip(rows, sets, label))


def near_rows():
    """Odd rows, a large group of near copies of which some are too far off, and a passage that many texts share."""
    r = np.random.default_rng(3)
    rows, base = cases.odd_rows(), cases.prose(77, 150).split()
    for i in range(60):
        words = list(base)
        for at in r.choice(len(words), int(r.integers(0, 9)), replace=False):
            words[at] = f"w{r.integers(0, 40)}"
        rows.append((100 + i, " ".join(words)))
    passage = cases.prose(78, 50)
    rows += [(300 + i, cases.prose(400 + i, 70) + " " + passage) for i in range(60)]
    return rows


@pytest.mark.parametrize("size,short", [(4, 32), (4, 3), (5, 3)])
def test_components_of_near_copies(spark, size, short, monkeypatch):
    monkeypatch.setattr(near_duplicates, "SHORT", short)
    rows = near_rows()
    got = near_duplicates.near_duplicates(cases.with_clashes(spark, rows), size=size).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == component_ids(rows, size, 80)


def test_rounds_do_not_grow_with_copies_that_are_too_far_off(spark, monkeypatch):
    """A group of copies of one text, of which half have room for no other: they are no pivots, so few rounds are left."""
    r = np.random.default_rng(9)
    rows, base = [], cases.prose(79, 200).split()
    for i in range(240):
        words = list(base)
        for at in r.choice(len(words), int(r.integers(0, 12)), replace=False):
            words[at] = f"w{i}x{at}"
        rows.append((i, " ".join(words)))
    rounds, write = [], near_duplicates.stored
    monkeypatch.setattr(near_duplicates, "stored", lambda df, name: rounds.append(name) or write(df, name))
    monkeypatch.setattr(near_duplicates, "ROUND_PAIRS", 1)
    got = near_duplicates.near_duplicates(cases.with_clashes(spark, rows), size=4).collect()
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == component_ids(rows, 4, 80)
    assert 1 <= rounds.count("near-pivots") <= 3


def test_links_of_whole_sketches_with_truncated_ones(spark):
    """Sets of about a sketch's size with appended words, or with first words dropped as well, sharing nothing with other sets."""
    rows = []
    for small in range(45, 53):
        for large in range(small, 63):
            for cut in (0, 1, 2):
                words = [f"p{len(rows)}w{i}" for i in range(large + 3)]
                rows += [(len(rows), " ".join(words[: small + 3])), (len(rows) + 1, " ".join(words[cut : large + 3]))]
    got = near_duplicates.near_duplicates(cases.with_clashes(spark, rows), size=4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == component_ids(rows, 4, 80)


def test_one_document_of_a_group_stays(spark):
    rows = cases.odd_rows()
    kept = near_duplicates.without_near_duplicates(cases.with_clashes(spark, rows))
    assert kept.columns == cases.odd(spark).columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and not ids[2] and not ids[3] and ids[11] == 1 and all(ids[i] for i in (4, 5, 6, 7, 8))
    assert near_duplicates.near_duplicates(cases.empty(spark)).count() == 0


def test_chains_and_stars_are_components(spark):
    r = np.random.default_rng(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(int(a), int(b)) for a, b in r.integers(200, 260, (40, 2))]
    label = {v: v for e in links for v in e}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = C.components(spark.createDataFrame(links, "a long, b long")).collect()
    loops = {a for a, b in links if a == b} - {v for a, b in links if a != b for v in (a, b)}
    assert {(r.v, r.label) for r in got} == {(v, x) for v, x in label.items() if v not in loops}


def test_contained_items(spark):
    items = [(1, cases.prose(50, 20)), (2, cases.prose(51, 300)), (2, cases.prose(52, 9)), (3, None), (4, ""), (5, "one two"), (1, cases.prose(50, 20))]
    cut = " ".join(items[1][1].split()[:270])
    rows = cases.odd_rows() + [
        (50, cases.prose(60, 3000) + " " + items[0][1].upper() + "\n" + cases.prose(61, 2000)),
        (51, cases.prose(62, 30) + " " + cut + " x " + cases.prose(63, 10)),
        (52, " ".join(items[1][1].split()[:200])),
        (53, items[2][1]),
        (53, items[0][1]),
    ]
    table = spark.createDataFrame([(i, t, "x", 3) for i, t in items], "item_id long, text string, part string, n long")
    docs = cases.with_clashes(spark, rows)
    want = set()
    for i, t in rows:
        whole = shingles(t, 5)
        for k, x in items:
            s = shingles(x, 5)
            if s and 100 * len(s & whole) >= 80 * len(s):
                want.add((i, k, len(s), len(s & whole)))
    got = decontamination.contained_items(docs, table).collect()
    assert {(r.doc_id, r.item_id, r.item_shingles, r.shared) for r in got} == want and len(got) == len(want)
    clean = decontamination.without_items(docs, table)
    assert Counter(r.doc_id for r in clean.collect()) == Counter(i for i, t in rows if i not in (7, 12, 50, 51, 53))
    assert clean.columns == docs.columns
    assert decontamination.contained_items(docs, table.limit(0)).count() == 0
    assert decontamination.contained_items(cases.empty(spark), table).count() == 0


def test_run_index_finds_repeated_windows():
    r = np.random.default_rng(2)
    for _ in range(60):
        length, letters = int(r.choice([8, 12, 20, 40])), int(r.choice([1, 2, 4]))
        base = r.integers(97, 97 + letters, int(r.integers(2, 300))).astype(np.uint8)
        parts = []
        for _ in range(int(r.integers(1, 6))):
            a, b = sorted(r.integers(0, len(base) + 1, 2))
            parts.append(np.r_[base[a:b], np.uint8(SEPARATOR)].astype(np.uint8))
        text = np.concatenate(parts)
        index, data = RunIndex(text, length), text.tobytes()
        seen = Counter(data[i : i + length] for i in range(len(data) - length + 1))
        lengths = index.match_lengths()
        for i in range(len(data) - length + 1):
            if SEPARATOR not in data[i : i + length]:
                assert (lengths[i] >= length) == (seen[data[i : i + length]] > 1)


@pytest.mark.parametrize("length,hot", [(400, 2000), (60, 2000), (60, 1)])
def test_long_matches(spark, length, hot, monkeypatch):
    monkeypatch.setattr(long_matches, "HOT_GROUP", hot)
    monkeypatch.setattr(long_matches, "PIECE", 5000)
    rows = cases.odd_rows() + [(60, "é" * 500), (61, "x" + "é" * 350), (62, cases.prose(9, 40) * 3)]
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    want = Counter()
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for at in range(len(b) - length + 1):
            if seen[b[at : at + length]] > 1:
                gone[at : at + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int(np.count_nonzero(np.diff(np.r_[0, gone.astype(np.int8)]) == 1))
        want[i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    got = long_matches.without_long_matches(cases.with_clashes(spark, rows), length=length).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert long_matches.without_long_matches(cases.empty(spark)).count() == 0


def test_periodic_text_makes_few_marks(spark):
    """Its stretch starts in every period; the marks of a text that touch are one row."""
    rows = [(7, bytearray(b"0123456789" * 41), bytearray([i]), [*range(0, 5000, 10), 9000]) for i in range(3)]
    found = spark.createDataFrame(rows, "hash long, stretch binary, digest binary, starts array<long>")
    for marks in (long_matches._index_marks(found.repartition("hash"), 400), long_matches._counted_marks(found, 400)):
        assert sorted((*r.digest, r.start, r.last) for r in marks.collect()) == [(i, *x) for i in range(3) for x in ((0, 5000), (9000, 9010))]


def test_hot_anchors_name_only_windows_whose_core_occurs_again(spark, monkeypatch):
    """A common line in many surroundings; pairs of texts share 399 to 420 bytes around it."""
    monkeypatch.setattr(long_matches, "HOT_GROUP", 10)
    kept, store = {}, long_matches.stored
    monkeypatch.setattr(long_matches, "stored", lambda df, name: kept.setdefault(name, store(df, name)))
    line = " ".join(f"zq{i}" for i in range(55))
    texts = [cases.prose(800 + i, 90) + line + cases.prose(900 + i, 90) for i in range(40)]
    before, after = texts[0].split(line)
    for k, size in enumerate([399, 400, 401, 420]):
        left = 30 + 20 * k
        shared = (before[-left:] + line + after)[:size]
        texts += [cases.prose(1000 + 2 * k, 90) + "<" + shared + ">", cases.prose(1001 + 2 * k, 90) + "(" + shared + ")"]
    texts = texts[1:]
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    want = {}
    for i, t in enumerate(texts):
        gone = {k for at in range(len(t) - 399) if seen[t[at : at + 400]] > 1 for k in range(at, at + 400)}
        want[i] = len(gone)
    got = long_matches.without_long_matches(cases.with_clashes(spark, list(enumerate(texts)))).collect()
    assert {r.doc_id: r.n_removed for r in got} == want and sum(want.values()) > 2000
    windows = kept["hot-distinct"].selectExpr("sum(octet_length(stretch) - 399)").first()[0]
    assert kept["hot-windows"].count() < 0.5 * windows


def plain_chunks(text):
    lines, found, start, last = text.split("\n"), [], 0, 0
    for i, line in enumerate(lines):
        h = int(hashlib.md5(line.encode()).hexdigest()[:8], 16)
        rolled = ((last * 31 + h) % 2**32 * line_chunks.MIXER % 2**32 >> 16) % line_chunks.MODULUS == 0
        if i == len(lines) - 1 or (rolled and i - start >= 1 and len(lines) - 1 - i >= 2):
            found.append((start, lines[start : i + 1]))
            start = i + 1
        last = h
    assert len(lines) == 1 or all(len(c) > 1 for _, c in found)
    return found


def test_line_chunks(spark):
    rows = cases.odd_rows() + [(500 + i, "\n".join(cases.prose(600 + k, 4) for k in range(i % 9))) for i in range(40)] + [(540, "\n\n\n"), (541, "a\n\n")]
    first, want = {}, Counter()
    for i, t in sorted(((i, t) for i, t in set(rows) if t is not None), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(f"{'-' if r[0] is None else r[0]}\0{r[1]}".encode()).digest())):
        for start, lines in plain_chunks(t):
            if len(lines) > 1 and "".join(lines).strip(" \t\n\r\x0b\x0c"):
                first.setdefault("\n".join(lines), (i, t, start))
    for i, t in rows:
        if t is None:
            want[i, None, 0, 0, 0] += 1
            continue
        kept, gone = [], []
        for start, lines in plain_chunks(t):
            mine = first.get("\n".join(lines), (i, t, start)) == (i, t, start) or len(lines) == 1
            kept += lines if mine else []
            gone += [] if mine else [len(lines)]
        want[i, "\n".join(kept), len(t.split("\n")), sum(gone), len(gone)] += 1
    got = line_chunks.dedup_lines(cases.with_clashes(spark, rows)).collect()
    assert Counter((r.doc.doc_id, r.kept, r.n_lines, r.removed_lines, r.removed_chunks) for r in got) == want
    assert line_chunks.dedup_lines(cases.empty(spark)).count() == 0


def test_equally_hashed_chunks_of_other_bytes_stay(spark):
    rows = spark.createDataFrame([("a\nb", [(0, 2, b"h", True)]), ("c\nd", [(0, 2, b"h", False)]), ("a\nb", [(0, 2, b"i", True)])], "text string, marks array<struct<start:int,lines:int,hash:binary,first:boolean>>")
    assert [bytes(r.hash) for r in line_chunks._different(rows, rows.text).collect()] == [b"h"]
