"""Near-duplicates by bottom-k sketches from one hash function, confirmed on full shingle sets.

A document's sketch holds the ``K`` smallest hashes of its shingle set. Documents with equal sets form one class at
once; only classes are compared.

1. Inverted lists of retained values. Values are ordered by the number of classes that retain them; a class is listed
   under its rarest ones only, as many as two linked classes cannot all miss (``_prefix``): exact where one of the two sketches is
   the whole set, five standard deviations otherwise. Passages that many documents share are common values, so they list nothing.
2. Lists of up to ``SHORT`` classes give their pairs. Classes of longer lists (big groups of near copies) are listed once more by
   their full sets, again under the rarest shingles that a linked pair cannot all miss, which is exact.
3. Lists that are still long are searched from pivots: first the class with the fewest rarer shingles, which gathers the
   group into one component, then in rounds the classes outside the list's largest component. Only pairs of different
   components are compared, and only where what the two sets have besides rarer shingles leaves room for a link. Classes that
   have such room with no other component leave the list before each round (``_open``), so that rounds do not grow with them. A list
   is done when no pair is left, so no link between components is lost and pairs inside a component are not listed.
4. Pairs are filtered by the similarity that the smallest hashes of the union of both sketches estimate (six standard
   deviations below the threshold), then verified on the full sets. Components of the links follow in ``components``.

Null and empty texts (and texts without words) have no shingles and link with nothing. Rows with equal ids are one
document only if their texts are equal too. A null id takes part in links; a component's id is its smallest id that is not
null. Words are split at ASCII white space with A-Z lowered. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from logweir.llm.common import carried, document_key, numbered, shingle_set, stored, without_keys
from logweir.llm.components import components

K = 48
SHORT = 32
#: Pairs that one round asks of a long list, about.
ROUND_PAIRS = 1 << 20
#: Ids up to which a set of wanted documents is sent to all tasks.
SMALL_IDS = 500_000

SKETCH = "key binary, doc_id string, n_shingles long, cls binary, sketch binary"


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """Set size, a 128-bit hash of the set and its smallest hashes, for rows ``key, doc_id, text``."""

    def one(text: str | None) -> tuple:
        s = shingle_set(text, size)
        return len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, s[:K].tobytes()

    def batches_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([one(t) for t in batch["text"]], columns=["n_shingles", "cls", "sketch"])
            out["key"] = batch["key"].to_numpy()
            out["doc_id"] = batch["doc_id"].to_numpy()
            yield out

    return numbered(carried(docs, "doc_id").mapInPandas(batches_of, SKETCH), "doc_id")


def _prefix(n: Column, percent: int) -> Column:
    """How many of its rarest retained values a class of ``n`` shingles is listed under.

    A whole sketch may meet a truncated one: a union of two linked sets has ``100 * n / percent`` shingles at most, and the
    truncated sketch lacks what the union has beyond ``K``. So many places make such pairs exact too (above 50 percent).
    """
    miss = 1 - percent / 100
    sampled = math.ceil(K * miss + 5 * math.sqrt(K * miss * (1 - miss))) + 1
    whole = n - F.ceil(n * percent / 100) + 1
    beyond = F.floor(n * 100 / percent) - K + 1
    near = F.when(n * percent <= K * 100, F.least(F.lit(K), F.greatest(whole, F.lit(sampled))))
    return F.when(n <= K, F.greatest(whole, beyond)).otherwise(F.coalesce(near, F.lit(min(K, sampled)))).cast("int")


def _values(packed: Column) -> Column:
    """The 8-byte values of a packed array, as binary pieces."""
    at = F.sequence(F.lit(0), (F.octet_length(packed) / 8).cast("int") - 1)
    return F.transform(at, lambda i: F.substring(packed, i * 8 + 1, 8))


def _rare_lists(held: DataFrame, places: Column) -> DataFrame:
    """(value, vid, n, pos): each set under its rarest shared elements.

    ``held`` has vid, n (set size), held (elements at hand) and one element ``value`` per row; ``places`` says how many of its rarest
    elements a set is listed under. Elements of only one set are the rarest: they list nothing but use up places. ``pos`` is
    how many rarer elements the set has. A set's list of shared elements is as long as the set at most.
    """
    counts = held.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    by_set = held.join(counts, "value").groupBy("vid", "n", "held").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared"))
    own = (F.col("held") - F.size("shared")).cast("int")
    left = F.greatest(F.lit(0), places - own)
    return by_set.select("vid", "n", own.alias("own"), F.posexplode(F.slice("shared", F.lit(1), left)).alias("at", "e")).select(
        F.col("e.value").alias("value"), "vid", "n", (F.col("own") + F.col("at")).alias("pos")
    )


def _room(percent: int, whole: bool) -> Column:
    """Whether sets ``x`` and ``y`` can be linked if the value at hand is the rarest that they share.

    Sizes must agree; if the lists cover whole sets, what comes after the rarer elements must be enough for a link.
    """
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    fits = small * 100 >= large * percent
    if whole:
        most = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
        fits &= most * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n"))
    return fits


def _pairs_of(lists: DataFrame, percent: int, whole: bool) -> DataFrame:
    x, y = lists.alias("x"), lists.alias("y")
    met = x.join(y, (F.col("x.value") == F.col("y.value")) & (F.col("x.vid") < F.col("y.vid")) & _room(percent, whole))
    return met.select(F.col("x.vid").alias("a"), F.col("y.vid").alias("b")).distinct()


def _split(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Short and long lists; lists of one are dropped."""
    sizes = lists.groupBy("value").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    sized = stored(lists.join(sizes, "value"), "near-lists")
    return sized.where(F.col("members") <= SHORT), sized.where(F.col("members") > SHORT)


class _Verifier:
    """Estimates pairs from their classes' sketches and confirms them on full sets."""

    def __init__(self, docs: DataFrame, classes: DataFrame, size: int, percent: int):
        self.docs, self.classes, self.size, self.percent = docs, classes, size, percent

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(vid, n, shingles) of the wanted classes (one column vid), read from one document of each."""
        size = self.size
        chosen = stored(self.classes.join(wanted, "vid").select("vid", "doc_id", F.col("cls").alias("wanted_cls")), "near-wanted")
        few = chosen.count() <= SMALL_IDS
        ids = chosen.select(F.col("doc_id").alias("wanted_id"), "vid", "wanted_cls")
        met = self.docs.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")))

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for vid, cls, text in zip(batch["vid"], batch["wanted_cls"], batch["text"], strict=True):
                    s = shingle_set(text, size)
                    if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == bytes(cls):
                        rows.append((vid, len(s), s.tobytes()))
                yield pd.DataFrame(rows, columns=["vid", "n", "shingles"])

        found = met.select("vid", "wanted_cls", "text").mapInPandas(read, "vid long, n long, shingles binary")
        return stored(found.dropDuplicates(["vid"]), "near-sets")

    def _within(self, rows: DataFrame, pairs: DataFrame) -> DataFrame:
        """The ``rows`` of classes that occur in ``pairs``; as long as these are few, no other row is shuffled."""
        ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("vid")).distinct(), "near-ids")
        return rows.join(F.broadcast(ids), "vid", "left_semi") if ids.count() <= SMALL_IDS else rows

    def estimated(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose estimated similarity is within six standard deviations of the threshold."""
        percent = self.percent
        pairs = stored(pairs, "near-pairs")
        held = self._within(self.classes, pairs)
        least = percent / 100 - 6 * math.sqrt(percent / 100 * (1 - percent / 100) / K)

        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                keep = []
                for n, m, x, y in zip(batch["an"], batch["bn"], batch["x"], batch["y"], strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    union = np.sort(np.concatenate([x, y]))
                    twice = union[1:][union[1:] == union[:-1]]
                    union = np.unique(union)
                    if max(n, m) <= K:
                        keep.append(100 * len(twice) >= percent * len(union))
                    else:
                        union = union[: min(K, len(union))]
                        keep.append(np.count_nonzero(twice <= union[-1]) >= least * len(union))
                yield batch.loc[np.asarray(keep, bool), ["a", "b"]]

        side = lambda v, n, s: held.select(F.col("vid").alias(v), F.col("n").alias(n), F.col("sketch").alias(s))
        found = pairs.join(side("a", "an", "x"), "a").join(side("b", "bn", "y"), "b").mapInPandas(judge, "a long, b long")
        return stored(found, "near-likely")

    def confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of the stored ``pairs`` that are links."""
        percent = self.percent
        held = self._within(sets, pairs)

        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                keep = []
                for x, y in zip(batch["x"], batch["y"], strict=True):
                    both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]))
                    shared = np.count_nonzero(both[1:] == both[:-1])
                    keep.append(100 * shared >= percent * (len(both) - shared))
                yield batch.loc[np.asarray(keep, bool), ["a", "b"]]

        side = lambda v, s: held.select(F.col("vid").alias(v), F.col("shingles").alias(s))
        return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").mapInPandas(judge, "a long, b long")


def _label(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.select(F.col("v").alias("vid"), "label"), "vid", "left").withColumn("label", F.coalesce("label", "vid"))


def _open(rows: DataFrame, percent: int) -> DataFrame:
    """The rows of lists that have room for a link with some row of another component in their list.

    Of the rows of a list that have one size, those with the fewest rarer shingles in each of two components decide this for
    every other row. So a row is held against the sizes in its list, however many rows these have.
    """
    best = rows.groupBy("value", "n").agg(F.min(F.struct("pos", "label")).alias("best"))
    others = rows.join(best, ["value", "n"]).where("label <> best.label").groupBy("value", "n").agg(F.min(F.struct("pos", "label")).alias("best"))
    x, y = rows.alias("x"), best.unionByName(others).select("value", "n", "best.pos", "best.label").alias("y")
    return x.join(y, (F.col("x.value") == F.col("y.value")) & (F.col("x.label") != F.col("y.label")) & _room(percent, True), "left_semi")


def _merged(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the labels that their components have once ``links`` between them are added."""
    names = rows.select("vid", "label").distinct()
    side = lambda v: names.select(F.col("vid").alias(v), F.col("label").alias(f"{v}_label"))
    between = links.join(side("a"), "a").join(side("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
    moved = components(between).select(F.col("v").alias("label"), F.col("label").alias("to"))
    return rows.join(moved, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")


def _long_lists(lists: DataFrame, links: DataFrame, verifier: _Verifier, sets: DataFrame) -> DataFrame:
    """Links that connect all components which pairs of the long lists connect; ``links`` are those known before."""
    percent = verifier.percent
    # The first pivots of a list come from an aggregate, so that a list is never one task's window.
    first = lists.groupBy("value").agg(F.min(F.struct(F.col("pos") / F.col("n"), "vid")).alias("f"))
    pivots = lists.join(first.select("value", F.col("f.vid").alias("first")), "value").where("vid = first")
    rows = stored(_label(lists.select("value", "vid", "n", "pos"), components(links)), "near-placed")
    while True:
        chosen = stored(pivots.select("value", "vid"), "near-pivots")
        x, y = rows.join(chosen, ["value", "vid"]).alias("x"), rows.alias("y")
        met = x.join(y, (F.col("x.value") == F.col("y.value")) & (F.col("x.label") != F.col("y.label")) & _room(percent, True))
        pairs = met.select(F.least("x.vid", "y.vid").alias("a"), F.greatest("x.vid", "y.vid").alias("b")).distinct()
        found = stored(verifier.confirmed(verifier.estimated(pairs), sets), "near-found")
        if not found.isEmpty():
            links = stored(links.unionByName(found), "near-links")
            rows = _merged(rows, found)
        # A pivot has met its whole list, and a row without room for another component gets none when components grow.
        rows = stored(_open(rows.join(chosen, ["value", "vid"], "left_anti"), percent), "near-placed")
        if rows.isEmpty():
            return links
        tally = rows.groupBy("value", "label").agg(F.count(F.lit(1)).alias("rows"))
        main = tally.groupBy("value").agg(F.max(F.struct("rows", "label")).alias("main"), F.sum("rows").alias("members"))
        outside = rows.join(main.select("value", F.col("main.label").alias("main"), "members"), "value").where("label <> main")
        share = F.greatest(F.lit(16), F.floor(F.lit(ROUND_PAIRS) / F.col("members")))
        # A hashed share of those outside, about as many as the round's pairs allow, and the first of them for sure.
        left = outside.groupBy("value").agg(F.count(F.lit(1)).alias("left"), F.min("vid").alias("least"))
        part = F.pmod(F.xxhash64("vid"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        pivots = outside.join(left, "value").where((part * F.col("left") < share) | (F.col("vid") == F.col("least")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """key, doc_id, n_shingles, component_id and first_key for every row of ``docs``.

    ``key`` stands for id and text; ``first_key`` is the key of the component's document with the smallest id.
    """
    name, body = F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")
    named = docs.select(document_key(name, body).alias("key"), name.alias("doc_id"), body.alias("text"))
    facts = stored(sketches(named, size), "near-sketches")
    grouped = (
        facts.where("n_shingles > 0")
        .groupBy("cls")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("best"),
            F.first("n_shingles").alias("n"),
            F.first("sketch").alias("sketch"),
            F.count(F.lit(1)).alias("copies"),
        )
        .withColumn("doc_id", F.col("best.doc_id"))
    )
    classes = stored(grouped.withColumn("vid", F.monotonically_increasing_id()), "near-classes")
    verifier = _Verifier(named, classes, size, percent)

    retained = classes.select("vid", "n", F.least("n", F.lit(K)).alias("held"), F.explode(_values(F.col("sketch"))).alias("value"))
    short, long = _split(_rare_lists(retained, _prefix(F.col("n"), percent)))
    likely = verifier.estimated(_pairs_of(short, percent, False))
    grouped_ids = stored(long.select("vid").distinct(), "near-grouped")
    wanted = likely.select(F.explode(F.array("a", "b")).alias("vid")).unionByName(grouped_ids).distinct()
    sets = verifier.sets(wanted)
    links = stored(verifier.confirmed(likely, sets), "near-links")

    if not grouped_ids.isEmpty():
        inside = sets.join(grouped_ids, "vid").select("vid", "n", F.col("n").alias("held"), F.explode(_values(F.col("shingles"))).alias("value"))
        whole = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
        short, long = _split(_rare_lists(inside, whole.cast("int")))
        more = verifier.confirmed(verifier.estimated(_pairs_of(short, percent, True)), sets)
        links = stored(links.unionByName(more), "near-links")
        if not long.isEmpty():
            links = _long_lists(long, links, verifier, sets)

    labels = _label(classes.drop("sketch"), components(links))
    ids = labels.groupBy("label").agg(F.min("best").alias("first"), F.sum("copies").alias("size")).where("size > 1")
    by_class = labels.join(ids, "label").select("cls", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("first_key"))
    return facts.join(by_class, "cls", "left").select(
        "key",
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("first_key", "key").alias("first_key"),
    )


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One document of every component: the one with the smallest id. Of rows equal in id and text one stays, unless they have no words."""
    found = stored(near_duplicates(docs, doc_id, text, size, percent), "near-found")
    kept = without_keys(docs, found.where("key <> first_key").select("key"), doc_id, text)
    twice = stored(found.where("n_shingles > 0").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-rows")
    if twice.isEmpty():
        return kept
    here = document_key(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`"))
    marked = kept.withColumn("_key", here).join(twice.select(F.col("key").alias("_key"), "n"), "_key", "left")
    once, more = marked.where(F.col("n").isNull()), marked.where(F.col("n").isNotNull()).dropDuplicates(["_key"])
    return once.unionByName(more).select(*[F.col(f"`{c}`") for c in docs.columns])
