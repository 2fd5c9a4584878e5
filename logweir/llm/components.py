"""Connected components of a graph given as links, by rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logweir.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(v, label): for every vertex in ``links`` (a, b) the smallest vertex that it can reach.

    Each round joins every vertex to the smallest of its neighbours; links stay as many as they were at most. Rounds are stored, so
    that lineage stays short. A vertex with very many links is only ever a join key, never one task's group.
    """

    def stamp(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    links = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    last = stamp(links)
    if last[0] == 0:
        return links.select(F.col("a").alias("v"), F.col("b").alias("label"))
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(down, "a")
            .select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        links = stored(small, "links")
        now = stamp(links)
        if now == last:
            break
        last = now
    roots = links.select(F.col("b").alias("v")).distinct()
    return links.select(F.col("a").alias("v"), F.col("b").alias("label")).unionByName(roots.select("v", F.col("v").alias("label")))
