"""Best-fit packing of tokenized documents into sequences, as bulk-synchronous rounds over sorted runs.

Documents longer than a sequence are cut into whole sequences and a rest; everything else stays whole. Pieces sorted by
length form runs (pieces of one length are alike to packing), and so do open gaps. A round takes the longest
unplaced run and sweeps it over the gaps from the smallest that fits upwards: the piece of rank i takes the gap of rank i, so
no two pieces ask for the same gap; what found no gap opens new sequences, each filled with as many pieces of the run as fit.
The gaps are then updated and the next round begins. There are at most as many runs as tokens in a sequence, at every size of
the table; Spark counts the runs, ranks the pieces in them and places each piece by its rank.

Null and empty texts have just the end token. Repeated rows are packed one by one. An empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from logweir.llm.cell_table import encoder
from logweir.llm.common import carried, numbered, stored

PIECES = "doc_id string, piece int, start long, length long, ids_crc32 long"
RANK_ROWS = 1 << 17
#: Rows of the plan above which it is joined by shuffle rather than sent to the tasks.
PLAN_ROWS = 200_000

def token_pieces(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece of each document: where it starts in the document's ids, its length and the checksum of its ids."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer, end_id)
        for batch in batches:
            names, rows = iter(batch["doc_id"]), []
            for ids, ends in encode.encode([t or "" for t in batch["text"]]):
                whole, at = memoryview(ids.astype("<u4")).cast("B"), 0
                for end in ends.tolist():
                    name = next(names)
                    for k, start in enumerate(range(at, end, most)):
                        length = min(most, end - start)
                        rows.append((name, k, start - at, length, zlib.crc32(whole[4 * start : 4 * (start + length)])))
                    at = end
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return numbered(carried(docs, "doc_id").mapInPandas(cut, PIECES), "doc_id")


def best_fit_plan(runs: dict[int, int], most: int = 2048) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, after rank, first sequence, pieces per sequence, offset).

    Piece i of a row goes to sequence first + i // pieces, at offset + length * (i % pieces).
    """
    plan: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # size of the gap: ranges of sequences
    sizes: list[int] = []
    opened = 0

    def leave(gap: int, first: int, after: int) -> None:
        if gap > 0:
            if gap not in gaps:
                bisect.insort(sizes, gap)
                gaps[gap] = []
            gaps[gap].append((first, after))

    for length in sorted(runs, reverse=True):
        rank, n = 0, runs[length]
        while rank < n:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                break
            gap = sizes[at]
            # A sequence that would still be the best fit after this piece takes as many as fit, ahead of larger gaps.
            each = gap // length
            first, after = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], sizes[at]
            whole = min(after - first, (n - rank) // each)
            if whole:
                plan.append((length, rank, rank + whole * each, first, each, most - gap))
                rank += whole * each
                leave(gap - each * length, first, first + whole)
                first += whole
            if first < after and rank < n:
                rest = n - rank if n - rank < each else 0
                if rest:
                    plan.append((length, rank, n, first, each, most - gap))
                    rank = n
                    leave(gap - rest * length, first, first + 1)
                    first += 1
            if first < after:
                leave(gap, first, after)
        if rank < n:
            each = most // length
            whole, rest = divmod(n - rank, each)
            plan.append((length, rank, n, opened, each, 0))
            if whole:
                leave(most - each * length, opened, opened + whole)
            if rest:
                leave(most - rest * length, opened + whole, opened + whole + 1)
            opened += whole + (rest > 0)
    return plan


def ranked(pieces: DataFrame, rows: int) -> DataFrame:
    """``rank``: a gapless number among the pieces of equal length, counted in blocks that spread a common length."""
    blocks = max(16, -(-rows // RANK_ROWS))
    placed = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    counts = placed.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    return (
        placed.withColumn("at", F.row_number().over(inside) - 1)
        .join(first, ["length", "block"])
        .withColumn("rank", F.col("first") + F.col("at"))
        .drop("block", "at", "first")
    )


def pack(pieces: DataFrame, most: int = 2048) -> DataFrame:
    """``sequence_id`` and ``offset`` for rows with a ``length`` of 1 to ``most``."""
    spark = pieces.sparkSession
    fixed = stored(pieces, "pieces")
    runs = {r["length"]: r["n"] for r in fixed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `most` rows
    plan = best_fit_plan(runs, most)
    columns = ["length", "from", "to", "first", "each", "base"]
    table = spark.createDataFrame(pd.DataFrame(plan, columns=columns).astype("int64"), ", ".join(f"`{c}` long" for c in columns))
    # Each plan row is also keyed by the blocks of ranks that it meets, so that a piece meets only rows near its rank.
    span = 1 << 12
    keyed = table.withColumn("near", F.explode(F.expr(f"sequence(`from` div {span}, (`to` - 1) div {span})")))
    facts = ranked(fixed, sum(runs.values())).withColumn("near", F.expr(f"rank div {span}"))
    placed = facts.join(F.broadcast(keyed) if len(plan) <= PLAN_ROWS else keyed, ["length", "near"]).where(
        (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to"))
    )
    step = F.col("rank") - F.col("from")
    return placed.select(
        *fixed.columns,
        (F.col("first") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + F.col("length") * (step % F.col("each"))).cast("long").alias("offset"),
    )
