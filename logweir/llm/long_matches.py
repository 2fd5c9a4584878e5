"""Removal of long byte strings that occur more than once, by run-length indexes over blocks of repetitive text.

Every window of ``length`` bytes has an anchor: the leftmost of its 32-byte strings with the smallest hash, so equal windows have equal
anchors at equal places. Anchors that occur once are dropped. The stretch of text whose windows share an anchor goes
to that anchor's group; a task joins groups to blocks of a few MB, builds each block's run-compressed Burrows-Wheeler index
(``run_index``), streams match lengths through it and marks the windows that start in two places. Equal stretches are put in
an index once.

Groups of more than ``HOT_GROUP`` stretches are not sent to one task: there every window is named by 128 bits of hashes, counted over all
tasks, and marked if it is counted twice, which is the same rule. Marks that touch leave a task as one, so periodic text, which has
an anchor in every period, makes few.

Equal texts are looked at once; if there are several, all their windows are marked. Null texts are empty. Texts below
``length`` bytes lose nothing. Repeated rows are copies like any others. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from logweir.llm.common import mixed, stored, text_key
from logweir.llm.run_index import SEPARATOR, RunIndex

ANCHOR = 32
#: Bytes of stretches that one index holds.
BLOCK = 2 << 20
HOT_GROUP = 2_000
#: Long texts are anchored piece by piece; pieces overlap by a window.
PIECE = 4 << 20
SMALL_ROWS = 500_000

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _rolling(data: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of every run of ``length`` bytes, put together from runs of powers of two."""
    power, width = base, 1
    level = data.astype(np.uint64) + np.uint64(1)
    total, covered = None, 0
    with np.errstate(over="ignore"):
        while True:
            if length & width:
                if total is None:
                    total = level
                else:
                    n = len(data) - covered - width + 1
                    total = level[:n] * scale + total[width : width + n]  # noqa: F821
                covered += width
                scale = power if covered == width else scale * power  # noqa: F821
            if width * 2 > length:
                return total
            level = level[:-width] * power + level[width:]
            power, width = power * power, width * 2


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last): windows that start at first..last share the anchor with this hash."""
    if len(data) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    names = mixed(_rolling(data, ANCHOR, _BASES[0]))
    low = np.uint64((1 << 24) - 1)
    keys = (names & ~low) | np.arange(len(names), dtype=np.uint64)
    width = length - ANCHOR + 1
    spare = -len(keys) % width
    blocks = np.r_[keys, np.full(spare, ~np.uint64(0))].reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - length + 1
    least = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return names[least[first]], first, np.r_[first[1:] - 1, n - 1]


def _text_anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = [(at, *anchors(data[at : at + PIECE + length - 1], length)) for at in range(0, max(1, len(data) - length + 1), PIECE)]
    return np.concatenate([h for _, h, _, _ in found]), np.concatenate([a + f for a, _, f, _ in found]), np.concatenate([a + e for a, _, _, e in found])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


def _placed(starts: np.ndarray, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges of a stretch at each of its starts in a text, as few as cover them: periodic text has a start in every period."""
    if len(starts) == 1:
        return [(int(starts[0]) + a, int(starts[0]) + b) for a, b in ranges]
    firsts, lasts = (np.add.outer(np.sort(starts), [r[k] for r in ranges]).ravel() for k in (0, 1))
    order = np.argsort(firsts, kind="stable")
    firsts, lasts = firsts[order], np.maximum.accumulate(lasts[order])
    fresh = np.r_[True, firsts[1:] > lasts[:-1] + 1]
    return list(zip(firsts[fresh].tolist(), lasts[np.r_[fresh[1:], True]].tolist(), strict=True))


def marked_windows(stretches: list[bytes], copies: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each of some distinct stretches the ranges of its windows that start in another place of the block too."""
    marks: list[list[tuple[int, int]]] = [[] for _ in stretches]
    joined = np.frombuffer(bytes([SEPARATOR]).join(stretches) + bytes([SEPARATOR]), np.uint8)
    repeated = RunIndex(joined, length).match_lengths() >= length
    at = 0
    for k, (s, n) in enumerate(zip(stretches, copies, strict=True)):
        windows = len(s) - length + 1
        marks[k] = [(0, windows - 1)] if n > 1 else _runs(repeated[at : at + windows])
        at += len(s) + 1
    return marks


def _index_marks(groups: DataFrame, length: int) -> DataFrame:
    """Marks (digest, start, last) from rows (hash, stretch, digest, starts) in which all of a hash are in one partition, sorted."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, list] = {}
        size, previous = 0, None

        def flush() -> pd.DataFrame:
            stretches = list(held)
            found = marked_windows(stretches, [sum(len(at) for _, at in held[s]) for s in stretches], length)
            rows = [(d, a, b) for s, ranges in zip(stretches, found, strict=True) if ranges for d, at in held[s] for a, b in _placed(at, ranges)]
            return pd.DataFrame(rows, columns=["digest", "start", "last"])

        for batch in batches:
            for name, stretch, digest, starts in zip(batch["hash"], batch["stretch"], batch["digest"], batch["starts"], strict=True):
                if name != previous and size >= BLOCK:
                    yield flush()
                    held, size = {}, 0
                previous = name
                places = held.get(stretch)
                if places is None:
                    held[stretch] = places = []
                    size += len(stretch) + 1
                places.append((digest, starts))
        if held:
            yield flush()

    return groups.mapInPandas(search, "digest binary, start long, last long")


def _counted_marks(stretches: DataFrame, length: int) -> DataFrame:
    """The same marks for stretches of hot anchors: windows are counted by name over all tasks.

    Equal windows hold the anchor at equal places. Those that hold it within ``ANCHOR`` places of one another (a bucket) share all but so many
    of their bytes, the bucket's core; windows are named only if their core occurs again.
    """
    width = length - ANCHOR + 1

    def joined(some: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Stretches as one text; where each begins, its number of windows and its anchor's place, which is that of its first window's least hash."""
        text = np.frombuffer(bytes([SEPARATOR]).join(some["stretch"]), np.uint8)
        counts = np.array([len(x) - length + 1 for x in some["stretch"]])
        begins = np.r_[0, np.cumsum(counts + length)[:-1]]
        hashes = mixed(_rolling(text, ANCHOR, _BASES[0])) & ~np.uint64((1 << 24) - 1)
        return text, counts, begins, hashes[begins[:, None] + np.arange(width)].argmin(axis=1)

    def core(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in range(0, len(batch), 1024):
                some = batch.iloc[part : part + 1024]
                text, counts, begins, anchor = joined(some)
                low, high = np.maximum(anchor - counts + 1, 0) // ANCHOR, anchor // ANCHOR
                which = np.repeat(np.arange(len(some)), high - low + 1)
                bucket = np.arange(len(which)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1) - low, high - low + 1)
                at = begins[which] + anchor[which] - ANCHOR * bucket
                a, b = (_rolling(text, width, base).view(np.int64)[at] for base in _BASES)
                ids, n = (some[c].to_numpy()[which] for c in ("id", "n"))
                yield pd.DataFrame({"a": a, "b": b, "bucket": bucket.astype(np.int32), "id": ids, "n": n})

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in range(0, len(batch), 1024):
                some = batch.iloc[part : part + 1024]
                # all stretches at once; windows that meet a separator are left out
                text, counts, begins, anchor = joined(some)
                wanted = np.zeros((len(some), width // ANCHOR + 1), bool)
                wanted[np.repeat(np.arange(len(some)), [len(x) for x in some["buckets"]]), np.concatenate(list(some["buckets"]))] = True
                shift = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                which = np.repeat(np.arange(len(some)), counts)
                chosen = wanted[which, (anchor[which] - shift) // ANCHOR]
                which, shift = which[chosen], shift[chosen]
                a, b = (_rolling(text, length, base).view(np.int64)[begins[which] + shift] for base in _BASES)
                ids, n = (some[c].to_numpy()[which] for c in ("id", "n"))
                yield pd.DataFrame({"a": a, "b": b, "id": ids, "shift": shift.astype(np.int32), "n": n})

    # Equal stretches of all texts are named once. One with several places is marked as a whole; it still counts for the others.
    held = stored(stretches.withColumn("name", F.unhex(F.md5("stretch"))), "hot-stretches")
    one = held.groupBy("name").agg(F.first("stretch").alias("stretch"), F.sum(F.size("starts")).alias("n"))
    numbered = stored(one.withColumn("id", F.monotonically_increasing_id()), "hot-distinct")
    distinct = numbered.select("id", "stretch", "n")
    cores = stored(distinct.mapInPandas(core, "a long, b long, bucket int, id long, n long"), "hot-cores")
    again = cores.groupBy("a", "b", "bucket").agg(F.sum("n").alias("total"), F.min("n").alias("least")).where("total > 1 AND least = 1")
    buckets = cores.join(again.select("a", "b", "bucket"), ["a", "b", "bucket"]).groupBy("id").agg(F.collect_list("bucket").alias("buckets"))
    fixed = stored(distinct.join(buckets, "id").mapInPandas(name, "a long, b long, id long, shift int, n long"), "hot-windows")
    twice = fixed.groupBy("a", "b").agg(F.sum("n").alias("total")).where("total > 1").select("a", "b")
    found = fixed.where("n = 1").join(twice, ["a", "b"]).groupBy("id").agg(F.collect_list("shift").alias("shifts"))
    whole = F.when(F.col("n") > 1, F.octet_length("stretch") - length).otherwise(-1).alias("whole")
    shifts = numbered.join(found, "id", "left").select("name", whole, "shifts").where("whole >= 0 OR shifts IS NOT NULL")
    places = held.select("name", "digest", "starts").join(shifts, "name")

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for digest, starts, whole, shifts in zip(*(batch[c] for c in ("digest", "starts", "whole", "shifts")), strict=True):
                if whole < 0:
                    flags = np.zeros(int(max(shifts)) + 1, bool)
                    flags[shifts] = True
                rows += [(digest, a, b) for a, b in _placed(starts, [(0, whole)] if whole >= 0 else _runs(flags))]
            yield pd.DataFrame(rows, columns=["digest", "start", "last"])

    return places.select("digest", "starts", "whole", "shifts").mapInPandas(ranges, "digest binary, start long, last long")


def without_long_matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (null unless bytes were removed from a text that stays in part)."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_key(F.col(f"`{text}`")).alias("digest"), body.alias("text"))
    facts = stored(
        rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole")),
        "match-facts",
    )
    # Texts of which one row is enough; the rows that only repeat them are few or many, and leave by join either way.
    firsts = facts.where(F.col("n_bytes") >= length).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"))
    several = stored(firsts.where("copies > 1"), "match-copies")
    extra = facts.join(several, "digest").where(F.col("doc_id") != F.col("first")).select(F.col("digest").alias("d"), F.col("doc_id").alias("i")).distinct()
    extra = stored(extra, "match-extra")
    few = extra.count() <= SMALL_ROWS
    long_rows = rows.where(F.octet_length("text") >= length)
    texts = long_rows.join(F.broadcast(extra) if few else extra, (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("i")), "left_anti")

    def anchor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            digests, hashes, firsts, lasts = [], [], [], []
            for digest, text in zip(batch["digest"], batch["text"], strict=True):
                h, f, e = _text_anchors(np.frombuffer(text.encode(), np.uint8), length)
                digests += [digest] * len(h)
                hashes.append(h.view(np.int64))
                firsts.append(f)
                lasts.append(e)
            if digests:
                yield pd.DataFrame({"digest": digests, "hash": np.concatenate(hashes), "first": np.concatenate(firsts), "last": np.concatenate(lasts)})

    found = stored(texts.select("digest", "text").mapInPandas(anchor, "digest binary, hash long, first long, last long"), "anchors")
    counts = stored(found.groupBy("hash").agg(F.count(F.lit(1)).alias("places")).where("places > 1"), "anchor-counts")
    # At most one hot hash for HOT_GROUP anchors: they are sent to all tasks, so that the places of one don't meet in one task.
    hot_hashes = F.broadcast(counts.where(F.col("places") > HOT_GROUP).select("hash"))
    any_hot = not hot_hashes.isEmpty()
    rest = found.join(hot_hashes, "hash", "left_anti") if any_hot else found
    repeated = rest.join(counts.select("hash"), "hash").withColumn("hot", F.lit(False))
    if any_hot:
        repeated = repeated.unionByName(found.join(hot_hashes, "hash").withColumn("hot", F.lit(True)))
    by_text = repeated.groupBy("digest").agg(F.collect_list(F.struct("hash", "first", "last", "hot")).alias("anchors"))
    repetitive = stored(texts.select("digest", "text").join(by_text, "digest").dropDuplicates(["digest"]), "repetitive")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["hash", "stretch", "digest", "starts"]
        for batch in batches:
            rows, size = [], 0
            for digest, text, hashes, firsts, lasts in zip(*(batch[c] for c in ("digest", "text", "hash", "first", "last")), strict=True):
                data = text.encode()
                own: dict[tuple, list] = {}  # periodic text repeats its stretches
                for h, first, last in zip(hashes.tolist(), firsts.tolist(), lasts.tolist(), strict=True):
                    own.setdefault((h, data[first : last + length]), []).append(first)
                for (h, stretch), at in own.items():
                    rows.append((h, stretch, digest, at))
                    size += len(stretch)
                    if size > 4 << 20:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
            yield pd.DataFrame(rows, columns=columns)

    def stretches(hot: bool) -> DataFrame:
        chosen = repetitive.select("digest", "text", F.filter("anchors", lambda a: a["hot"] == hot).alias("anchors")).where(F.size("anchors") > 0)
        apart = chosen.select("digest", "text", "anchors.hash", "anchors.first", "anchors.last")
        return apart.mapInPandas(cut, "hash long, stretch binary, digest binary, starts array<long>")

    marks = _index_marks(stretches(False).repartition("hash").sortWithinPartitions("hash"), length)
    if any_hot:
        marks = marks.unionByName(_counted_marks(stretches(True), length))
    by_digest = marks.groupBy("digest").agg(F.collect_list(F.struct("start", "last")).alias("marks"))
    by_digest = by_digest.select("digest", F.col("marks.start").alias("starts"), F.col("marks.last").alias("lasts"))
    partly = by_digest.join(several.select("digest"), "digest", "left_anti")

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for digest, text, starts, lasts in zip(*(batch[c] for c in ("digest", "text", "starts", "lasts")), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                steps = np.zeros(len(data) + 1, np.int64)
                np.add.at(steps, starts, 1)
                np.add.at(steps, lasts + length, -1)
                gone = np.cumsum(steps[:-1]) > 0
                kept = data[~gone].tobytes()
                out.append((digest, int(gone.sum()), len(_runs(gone)), hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(out, columns=["digest", "n_removed", "n_spans", "sha", "kept"])

    changed = stored(
        repetitive.select("digest", "text").join(partly, "digest").mapInPandas(remove, "digest binary, n_removed long, n_spans long, sha string, kept binary"),
        "matches-removed",
    )
    nothing = hashlib.sha256(b"").hexdigest()
    gone = several.select("digest", F.lit(True).alias("all_gone"))
    return facts.join(changed, "digest", "left").join(gone, "digest", "left").select(
        "doc_id",
        "n_bytes",
        F.when(F.col("all_gone"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("all_gone"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("all_gone"), F.lit(nothing)).otherwise(F.coalesce("sha", "whole")).alias("kept_sha256"),
        F.when(F.col("all_gone"), F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
