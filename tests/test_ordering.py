"""Blocked order operators against plain Python, with tiny blocks and many partitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir.operators import ordering as O, windows as W
from logweir.session import materialise

BLOCKS = [1, 3, 1 << 20]


def frame(spark, rows, schema, parts=4):
    rows = list(rows)
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, schema).repartition(parts)


@pytest.mark.parametrize("block", BLOCKS)
@pytest.mark.parametrize("parts", [1, 4, 37])
def test_dense_position_with_a_hot_key(spark, block, parts):
    rng = random.Random(1)
    rows = [(i * 2, "hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", rng.randrange(9)) for i in range(120)]
    got = O.dense_position(frame(spark, rows, "id bigint, k string, v int", parts), ["id"], ["k"], "pos", "n", {"top": ("max", "v"), "s": ("sum", "v")}, block)
    by_key = {}
    for i, k, v in sorted(rows):
        by_key.setdefault(k, []).append((i, v))
    want = {(i, k): (p, len(m), max(v for _, v in m), sum(v for _, v in m)) for k, m in by_key.items() for p, (i, _) in enumerate(m)}
    assert {(r.id, r.k): (r.pos, r.n, r.top, r.s) for r in got.collect()} == want


@pytest.mark.parametrize("block", BLOCKS)
def test_scans(spark, block):
    rng = random.Random(2)
    rows = [(i, rng.randrange(50)) for i in range(60)]
    df = frame(spark, rows, "id bigint, v bigint")
    tops = {r.id: r.m for r in O.running_max(df, "v", ["id"], "m", block_rows=block).collect()}
    assert tops == {i: max(v for _, v in rows[: i + 1]) for i in range(60)}
    before = {r.id: r.p for r in O.previous_value(df, "v", "id", "p", block_rows=block).collect()}
    assert before == {i: rows[i - 1][1] if i else None for i in range(60)}
    scan = {r.id: (r.line_idx, r.prev_time, r.time_so_far) for r in O.scan_log(df.withColumn("id", F.col("id") * 5), "id", "v", block).collect()}
    assert scan == {i * 5: (i, before[i], tops[i]) for i in range(60)}


@pytest.mark.parametrize("block", [2, 3, 1 << 20])
def test_neighbours_cross_blocks(spark, block):
    rows = [(s, p, f"{s}{p}") for s, n in (("a", 11), ("b", 1), ("c", 4)) for p in range(n)]
    df = frame(spark, rows, "session_id string, pos bigint, e string")
    got = O.with_neighbours(df, ["session_id"], "pos", {"prev": ("e", -1), "next2": ("e", 2)}, block)
    have = {(s, p): e for s, p, e in rows}
    assert {(r.session_id, r.pos): (r.prev, r.next2) for r in got.collect()} == {
        (s, p): (have.get((s, p - 1)), have.get((s, p + 2))) for s, p, _ in rows
    }


def test_hash_rank_is_a_permutation_per_class(spark):
    df = frame(spark, [(f"s{i}", i % 2) for i in range(101)], "id string, y int")
    got = O.hash_rank(df, ["id"], 5, ["y"], "r", "n").collect()
    for y, n in ((0, 51), (1, 50)):
        assert sorted(r.r for r in got if r.y == y) == list(range(n))
        assert {r.n for r in got if r.y == y} == {n}


@pytest.mark.parametrize("small", [0, 10_000])
def test_ordinal_small_and_range_sorted(spark, small):
    df = frame(spark, [(f"t{i:03d}", i % 7) for i in range(90)], "t string, n int")
    got = {r.t: r.idx for r in O.ordinal(df, [F.desc("n"), F.asc("t")], "idx", 5, small).collect()}
    order = sorted(range(90), key=lambda i: (-(i % 7), i))
    assert got == {f"t{i:03d}": at + 5 for at, i in enumerate(order)}


@pytest.mark.parametrize("small", [0, 10_000])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_broadcast_and_salted(spark, small, how):
    facts = frame(spark, [(i, "hot" if i % 3 else f"k{i}") for i in range(60)], "i int, k string")
    table = spark.createDataFrame([("hot", 1), ("k3", 2)], "k string, v int")
    got = {(r.i, r.v) for r in O.lookup(facts, table, ["k"], how, small).collect()}
    full = {(i, 1 if i % 3 else (2 if i == 3 else None)) for i in range(60)}
    assert got == (full if how == "left" else {(i, v) for i, v in full if v})


@pytest.mark.parametrize("block", [2, 1 << 20])
def test_spread_join(spark, block):
    rows = [(s, p) for s, n in (("a", 9), ("b", 2)) for p in range(n)]
    facts = frame(spark, rows, "session_id string, pos bigint")
    heads = spark.createDataFrame([("a", 9, "x"), ("b", 2, "y")], "session_id string, n bigint, tag string")
    got = O.spread_join(facts, heads, ["session_id"], "pos", "n", block)
    assert {(r.session_id, r.pos, r.tag) for r in got.collect()} == {(s, p, {"a": "x", "b": "y"}[s]) for s, p in rows}


@pytest.mark.parametrize("exact_rows,bins", [(100_000, 4096), (3, 4), (1, 2)])
def test_exact_quantile(spark, exact_rows, bins):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(size=200), np.zeros(50), [1e6]])
    df = materialise(spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5))
    for q in (0.0, 0.25, 0.5, 0.731, 1.0):
        assert O.exact_quantile(df, "v", q, exact_rows=exact_rows, bins=bins) == pytest.approx(np.quantile(values, q), abs=1e-9)


def walk(times, window, step):
    """Windows as index pairs, by moving a start and an end index forward."""
    n, out, k = len(times), [], 0
    lo = hi = 0
    while True:
        a, b = times[0] + k * step, times[0] + k * step + window
        while lo < n and times[lo] < a:
            lo += 1
        while hi < n and times[hi] < b:
            hi += 1
        if lo != hi and (lo, hi) not in out:
            out.append((lo, hi))
        if hi >= n:
            return out
        k += 1


@pytest.mark.parametrize("seed", range(4))
def test_sliding_windows_follow_the_index_walk(spark, seed):
    rng = random.Random(seed)
    times = [rng.randrange(60) for _ in range(40)]
    if seed % 2:
        times.sort()
    window, step = [(4, 2), (10, 3), (5, 5), (7, 1)][seed]
    df = frame(spark, [(i, t, 0, f"e{i}") for i, t in enumerate(times)], "line_id bigint, ts_sec bigint, label int, event string")
    got = W.sliding_time_windows(df, window, step, block_rows=3)
    assert sorted((r.first_idx, r.last_idx + 1) for r in got.collect()) == sorted(walk(times, window, step))
    events = W.sliding_time_window_events(df, window, step, block_rows=3).collect()
    assert len(events) == sum(b - a for a, b in walk(times, window, step))


def test_sliding_window_example(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate([0, 1, 5, 9])], "line_id bigint, ts_sec bigint, label int")
    got = W.sliding_time_windows(df, 4, 2).collect()
    assert sorted((r.first_idx, r.last_idx + 1) for r in got) == [(0, 2), (2, 3), (3, 4)]


def test_next_event_windows_examples(spark):
    df = spark.createDataFrame([("a", 0, "A", 3), ("a", 1, "B", 3), ("a", 2, "C", 3), ("b", 0, "A", 1)], "session_id string, pos bigint, event string, n_events bigint")
    got = {(r.session_id, tuple(r.ctx), r.next_event) for r in W.next_event_windows(df, 2).collect()}
    assert got == {("a", ("A", "B"), "C"), ("a", ("B", "C"), "#Pad"), ("b", ("A", "#Pad"), "#Pad")}


def test_chunks_of_one_event(spark):
    df = spark.createDataFrame([("a", 0, 1), ("b", 0, 2), ("b", 1, 2)], "session_id string, pos bigint, n_events bigint")
    got = {(r.session_id, r.chunk, r.chunk_pos) for r in W.chunk_sequence(df, 1).collect()}
    assert got == {("a", 0, 0), ("b", 0, 0), ("b", 1, 0)}


def moving_hours(times, window, step):
    """Count windows with the end moved from the last time of the first window."""
    n, out = len(times), []
    hi = 0
    while hi < n and times[hi] < times[0] + window:
        hi += 1
    if hi == n:
        return out
    begin, end, lo = times[0], times[hi - 1], 0
    out.append((lo, hi))
    while hi < n:
        begin, end, old = begin + step, end + step, hi
        while lo < old and times[lo] < begin:
            lo += 1
        while hi < n and times[hi] < end:
            hi += 1
        out.append((lo, hi))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_count_windows_follow_the_index_walk(spark, seed):
    rng = random.Random(seed + 10)
    times = [rng.randrange(80) for _ in range(30)]
    if seed % 2:
        times.sort()
    df = frame(spark, [(i, t, int(t % 11 == 0), f"e{i % 3}") for i, t in enumerate(times)], "line_id bigint, ts_sec bigint, label int, event string")
    windows, counts = W.window_event_counts(df, 8, 3, block_rows=4)
    want = moving_hours(times, 8, 3)
    assert {r.k: r.label for r in windows.collect()} == {k: int(any(t % 11 == 0 for t in times[a:b])) for k, (a, b) in enumerate(want)}
    cells = {}
    for k, (a, b) in enumerate(want):
        for i in range(a, b):
            cells[(k, f"e{i % 3}")] = cells.get((k, f"e{i % 3}"), 0) + 1
    assert {(r.k, r.event): r.n for r in counts.collect()} == cells


def test_count_windows_that_fit_the_first_window(spark):
    df = spark.createDataFrame([(0, 5, 0, "a"), (1, 6, 1, "b")], "line_id bigint, ts_sec bigint, label int, event string")
    assert W.window_event_counts(df, 100, 10)[0].count() == 0
    assert W.window_event_counts(df, 100, 10, strict_reference=False)[0].count() == 1
