"""Minimax contiguous sharding: the smallest feasible shard capacity over ordered atomic groups.

Native DataFrame code. Groups (rows with equal texts) stay whole. They are ordered by the first 60 bits of
their text's md5. A capacity is feasible if greedy filling, group after group, needs no more than the wanted number of
shards; binary search finds the smallest one, and the shards are cut where greedy filling with it stops.

The groups themselves never reach the driver. It sees at most ``ATOMS`` sums over ranges of the order. A
range is cut finer, by another Spark aggregate, only where some capacity that is still possible may put a cut inside it;
this ends with ranges of one group wherever a cut can fall, so the result is exact at every size.

A group above an even share of what is left gets a shard of its own first (less than the number of shards
of them can exist), so that one huge group of copies does not set the capacity for all others.

Null texts count as no bytes and share the group of the empty text. Repeated rows get slots of their own,
in either order. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from logweir.llm.common import stored

ORDER_BITS = 60
ATOMS = 1 << 16
OVERHEAD = 16
SLOT_ROWS = 1 << 17

Atom = tuple[int, int, int, int]  # first order value, bits below it, bytes, groups


def _fill(ends: list[int], starts: list[int], capacity: int, shards: int) -> list[int] | None:
    """Where greedy filling stops: index of the atom after each shard; None if the shards do not suffice."""
    cuts, at = [], 0
    for _ in range(shards):
        if at == len(ends):
            break
        after = bisect_right(ends, starts[at] + capacity)
        if after == at:
            return None
        cuts.append(after)
        at = after
    return cuts if at == len(ends) else None


def _least(low: int, high: int, feasible) -> int:
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid + 1, high)
    return low


def _reach(ends: list[int], atoms: list[Atom], capacity: int, shards: int) -> list[int]:
    """As ``_fill`` if a range of several groups could be cut anywhere: places, in bytes, that no real cut passes."""
    places, place = [], 0
    for _ in range(shards):
        place = min(place + capacity, ends[-1])
        k = bisect_right(ends, place)
        if k < len(atoms) and atoms[k][3] == 1:
            place = ends[k] - atoms[k][2]
        places.append(place)
    return places


def _cut_atoms(groups: DataFrame, shards: int) -> list[int]:
    """First order value of every shard but the first."""
    top = ORDER_BITS - ATOMS.bit_length() + 1

    def summed(rows: DataFrame, bits: int) -> list[Atom]:
        found = rows.groupBy(F.shiftright("ord", bits).alias("b")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
        return [(r["b"] << bits, bits, r["s"], r["n"]) for r in found.collect()]

    atoms = sorted(summed(groups, top))
    if not atoms:
        return []
    largest = groups.agg(F.max("size")).first()[0]
    while True:
        ends = list(accumulate(a[2] for a in atoms))
        starts = [e - a[2] for e, a in zip(ends, atoms, strict=True)]
        low = max(largest, -(-ends[-1] // shards))
        low = _least(low, ends[-1], lambda c: _reach(ends, atoms, c, shards)[-1] == ends[-1])  # noqa: B023
        high = _least(low, ends[-1], lambda c: _fill(ends, starts, c, shards) is not None)  # noqa: B023
        split: set[int] = set()
        if low < high:
            near, far, at = 0, _reach(ends, atoms, high, shards), 0
            for place in far:
                # real cuts of capacities in [low, high] lie from `near` to `place`
                near = max(near, bisect_right(ends, (starts[at] if at < len(ends) else ends[-1]) + low))
                split.update(k for k in range(near, min(len(atoms), bisect_right(ends, place) + 1)) if atoms[k][3] > 1)
                at = near
        if not split:
            cuts = _fill(ends, starts, high, shards)
            return [atoms[k][0] for k in cuts[:-1]]
        bits_of = {atoms[k][1] for k in split}
        finer: list[Atom] = []
        for bits in bits_of:
            parents = [atoms[k][0] >> bits for k in split if atoms[k][1] == bits]
            step = min(bits, max(1, (ATOMS // len(parents)).bit_length() - 1))
            chosen = groups.sparkSession.createDataFrame([(p,) for p in parents], "b long")
            inside = groups.join(F.broadcast(chosen), F.shiftright("ord", bits) == F.col("b"), "left_semi")
            finer += summed(inside, bits - step)
        atoms = sorted([a for k, a in enumerate(atoms) if k not in split] + finer)


def minimax_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in its shard) for every row of ``docs``."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    facts = stored(
        docs.select(
            F.col(f"`{doc_id}`").alias("doc_id"),
            (F.octet_length(whole) + OVERHEAD).cast("long").alias("size"),
            F.crc32(whole.cast("binary")).alias("text_crc32"),
            F.conv(F.substring(F.md5(whole.cast("binary")), 1, ORDER_BITS // 4), 16, 10).cast("long").alias("ord"),
        ),
        "shard-facts",
    )
    groups = stored(facts.groupBy("ord").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")), "shard-groups")
    total, rows = groups.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    alone: list[int] = []
    left = total
    for r in groups.where(F.col("size") * shards > total).orderBy(F.desc("size"), "ord").collect():  # fewer than `shards` rows
        if len(alone) + 1 < shards and r["size"] * (shards - len(alone)) > left:
            alone.append(r["ord"])
            left -= r["size"]
    rest = groups.where(~F.col("ord").isin(alone)) if alone else groups
    cuts = _cut_atoms(rest, shards - len(alone))

    shard: Column = F.lit(len(alone))
    for c in cuts:
        shard = shard + (F.col("ord") >= c).cast("int")
    for k, o in enumerate(alone):
        shard = F.when(F.col("ord") == o, F.lit(k)).otherwise(shard)
    return numbered(facts.withColumn("shard", shard.cast("int")), rows, shards).drop("ord")


def numbered(facts: DataFrame, rows: int, shards: int) -> DataFrame:
    """``slot``: a gapless number in each shard. A shard is numbered in blocks of its rows, spread by their ids."""
    blocks = max(8, -(-rows // (shards * SLOT_ROWS)))
    placed = facts.withColumn("block", F.pmod(F.xxhash64("doc_id", "ord"), F.lit(blocks)))
    counts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "ord", "size")
    return (
        placed.withColumn("at", F.row_number().over(inside) - 1)
        .join(first, ["shard", "block"])
        .withColumn("slot", (F.col("first") + F.col("at")).cast("long"))
        .drop("block", "at", "first")
    )
