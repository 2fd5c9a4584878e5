"""Template mining by a tree of fixed depth, as Spark jobs, and the dictionary of mined templates.

Which branch of the tree a message takes is settled for all messages at once, level by level, from the lines in which tokens are first seen
(``leaf_units``). What remains order-dependent, the clusters of one leaf, is folded per leaf in blocks of at most ``block_messages`` lines: the blocks of a leaf run in line order,
each starting from the state its predecessor stored; different leaves run side by side.
"""

from __future__ import annotations

import functools
import pickle
import re
import sys
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from logweir.functions.folds import FixedDepthFold
from logweir.functions.text import WILDCARD, collapse_wildcards, template_id
from logweir.operators.dictionaries import template_occurrences
from logweir.operators.ordering import dense_position, lookup
from logweir.operators.subsequences import spell_templates  # noqa: F401
from logweir.session import materialise

BLOCK_MESSAGES = 100_000
FOLDED = "grp string, msg_id bigint, cluster bigint, template array<string>, state binary"


@functools.cache
def _digits() -> str:
    """A pattern for the characters that Python counts as digits: the decimal ones and those of other number systems."""
    others = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isdigit() and not c.isdecimal()]
    return r"[\p{Nd}" + "".join(map(re.escape, others)) + "]"


def leaf_units(messages: DataFrame, levels: int, max_child: int) -> DataFrame:
    """``n, head, grp, skip, taken`` for each token count and first ``levels`` tokens of ``msg_id, n, head``.

    At a node of the tree, a token without digits has a branch of its own if it is seen before any token with digits or wildcard and before
    the branches are used up; nothing that comes later changes its way. All other tokens share the wildcard branch, if none of them could
    still get a branch of its own. Where one could, these messages meet in one leaf or the other depending on earlier clusters, so they
    stay together in one unit from this node on, which knows how many branches are ``taken`` by others.
    """
    none = F.array().cast("array<string>")
    heads = messages.groupBy("n", "head").agg(F.min("msg_id").alias("first"))
    units = materialise(heads.select("n", "head", "first", none.alias("path"), F.lit(levels).alias("skip"), F.lit(0).alias("taken")))
    for level in range(levels):
        token = F.element_at("head", level + 1)
        at = units.where(F.col("skip") == levels).withColumn("token", token)
        wild = (F.col("token") == WILDCARD) | F.col("token").rlike(_digits())
        tokens = materialise(at.groupBy("n", "path", "token").agg(F.min("first").alias("first")).withColumn("wild", wild))
        in_order = F.row_number().over(Window.partitionBy("n", "path").orderBy("first"))
        plain = tokens.where(~F.col("wild")).withColumn("rank", in_order).where(F.col("rank") <= max(1, max_child))
        end = F.min(F.when(F.col("wild") | (F.col("rank") >= max_child), F.col("first"))).alias("end")
        ends = tokens.where("wild").withColumn("rank", F.lit(0)).unionByName(plain).groupBy("n", "path").agg(end)
        own = materialise(
            plain.join(ends, ["n", "path"]).where((F.col("rank") < max_child) & (F.col("end").isNull() | (F.col("first") < F.col("end")))).select("n", "path", "token")
        )
        late = tokens.where(~F.col("wild")).join(own, ["n", "path", "token"], "left_anti").select("n", "path").distinct()
        own_counts = own.groupBy("n", "path").agg(F.count(F.lit(1)).cast("int").alias("own_branches"))
        marked = (
            units.withColumn("token", token)
            .join(own.withColumn("own", F.lit(True)), ["n", "path", "token"], "left")
            .join(late.withColumn("late", F.lit(True)), ["n", "path"], "left")
            .join(own_counts, ["n", "path"], "left")
        )
        going, mixed = F.col("skip") == levels, F.col("own").isNull() & F.col("late").isNotNull()
        step = F.when(F.col("own").isNotNull(), F.col("token")).otherwise(F.lit(WILDCARD))
        units = materialise(
            marked.select(
                "n",
                "head",
                "first",
                F.when(going & ~mixed, F.concat("path", F.array(step))).otherwise(F.col("path")).alias("path"),
                F.when(going & mixed, F.lit(level)).otherwise(F.col("skip")).alias("skip"),
                F.when(going & mixed, F.coalesce("own_branches", F.lit(0))).otherwise(F.col("taken")).alias("taken"),
            )
        )
    return units.select("n", "head", F.to_json(F.struct("n", "skip", "path")).alias("grp"), "skip", "taken")


def fold_units(messages: DataFrame, levels: int, st: float, max_child: int, block_messages: int = BLOCK_MESSAGES) -> tuple[DataFrame, DataFrame]:
    """Fold ``grp, skip, taken, msg_id, tokens`` in ``msg_id`` order per unit.

    Returns ``(grp, msg_id, cluster)`` and ``(grp, cluster, template)``; a cluster is named by the message that founded it.
    """
    largest = messages.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    rounds = -(-largest // block_messages)
    columns = ["grp", "msg_id", "cluster", "template", "state"]

    def run(pdf: pd.DataFrame, grp: str, stored: bytes | None) -> pd.DataFrame:
        state = pickle.loads(stored) if stored is not None else None
        fold = FixedDepthFold(levels, st, max_child, state, int(pdf["skip"].iloc[0]), int(pdf["taken"].iloc[0]))
        pdf = pdf.sort_values("msg_id")
        names = pdf["msg_id"].tolist()
        joined = [fold.add(tokens, name) for tokens, name in zip(pdf["tokens"], names)]
        found = fold.templates()
        rows = [(grp, m, c, None, None) for m, c in zip(names, joined)]
        rows += [(grp, None, c, template, None) for c, template in found.items()]
        if rounds > 1:
            rows.append((grp, None, None, None, pickle.dumps(fold.state())))
        return pd.DataFrame(rows, columns=columns, dtype=object)

    def first(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return run(pdf, key[0], None)

    def later(key: tuple, before: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=columns)
        return run(pdf, key[0], None if before.empty else before["state"].iloc[0])

    if rounds <= 1:
        outputs = [materialise(messages.groupBy("grp").applyInPandas(first, FOLDED))]
    else:
        placed = materialise(dense_position(messages, ["msg_id"], ["grp"], "_at"))
        outputs = []
        for r in range(rounds):
            block = placed.where(F.floor(F.col("_at") / block_messages) == r).select(*messages.columns)
            if r == 0:
                out = block.groupBy("grp").applyInPandas(first, FOLDED)
            else:
                state = outputs[-1].where(F.col("state").isNotNull()).select("grp", "state")
                out = state.groupBy("grp").cogroup(block.groupBy("grp")).applyInPandas(later, FOLDED)
            outputs.append(materialise(out))
    everything = reduce(DataFrame.unionByName, [o.withColumn("_round", F.lit(i)) for i, o in enumerate(outputs)])
    members = everything.where(F.col("msg_id").isNotNull()).select("grp", "msg_id", "cluster")
    templates = (
        everything.where(F.col("template").isNotNull()).groupBy("grp", "cluster").agg(F.max_by("template", "_round").alias("template"))
    )
    return members, templates


def drain_templates(
    lines: DataFrame,
    depth: int,
    st: float,
    max_child: int = 100,
    line: str = "line_id",
    exact: bool = True,
    block_messages: int = BLOCK_MESSAGES,
) -> DataFrame:
    """Add ``cluster`` (the line that founded it, as text) and ``cluster_template`` (token array) to lines with a ``tokens`` column.

    The result is that of folding all lines in order. With ``exact=False`` only the first line of each distinct message is folded, which is
    less work; a repeated message may then miss a better cluster founded after its first line. Messages with fewer than ``depth - 2`` tokens
    never merge and keep their own text.
    """
    levels = max(0, depth - 3)
    sized = lines.withColumns({"_n": F.size("tokens").cast("bigint"), "_head": F.slice("tokens", 1, levels) if levels else F.array().cast("array<string>")})
    long = sized.where(F.col("_n") >= max(depth - 2, 1))
    if exact:
        messages = long.select(F.col(line).alias("msg_id"), F.col("_n").alias("n"), F.col("_head").alias("head"), "tokens")
    else:
        messages = long.groupBy("tokens", F.col("_n").alias("n"), F.col("_head").alias("head")).agg(F.min(line).alias("msg_id"))
    messages = materialise(messages)
    units = leaf_units(messages, levels, max_child)
    placed = materialise(lookup(messages, units, ["n", "head"], "inner").select("grp", "skip", "taken", "msg_id", "tokens"))
    members, templates = fold_units(placed, levels, st, max_child, block_messages)
    named = lookup(members, templates, ["grp", "cluster"], "inner").select(
        "msg_id", F.col("cluster").cast("string").alias("cluster"), F.col("template").alias("cluster_template")
    )
    if exact:
        out = sized.join(named.withColumnRenamed("msg_id", line), line, "left")
    else:
        out = lookup(sized, placed.select("msg_id", "tokens").join(named, "msg_id").drop("msg_id"), ["tokens"])
    return out.withColumns(
        {"cluster": F.coalesce("cluster", F.col(line).cast("string")), "cluster_template": F.coalesce("cluster_template", "tokens")}
    ).drop("_n", "_head")


def mining_result(mined: DataFrame, line: str = "line_id", collapse: bool = True, across_spaces: bool = False) -> tuple[DataFrame, DataFrame]:
    """Structured log and dictionary: template text, id of the text, and a fresh count by text."""
    text = F.array_join("cluster_template", " ")
    text = collapse_wildcards(text, across_spaces) if collapse else text
    lines = mined.withColumn("template", text).withColumn("event_id", template_id(F.col("template")))
    return lines, template_occurrences(lines, "template", line)
