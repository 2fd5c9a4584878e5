"""Templates by common subsequence, mined in rounds around leading messages.

Distinct messages are ordered by a hash of their tokens. Two messages are linked if their longest common subsequence covers the part ``tau`` of the longer one;
masked parts are tokens like any other, on both sides. In a round

1. a hashed share of the messages that have no template yet are candidates, ``FIRST`` in the first round and four times as many in each later one: large groups
   find their leader while there are few candidates, so that no round compares many messages of one group with each other;
2. a candidate that is linked with no candidate before it leads;
3. every message without a template is compared with the leaders that share enough of its tokens (``overlaps``) and follows the one it has most in common with;
4. the leader's tokens that all its followers have become the template; if these cover less than ``tau`` of the leader, those that half of them have.
   Followers that lack a token of the template, or of which it covers less than ``tau``, wait for the next round.

Counts of matched places decide, so that contents alone matter: not the order of the lines, blocks or partitions. No step gathers a group in one task. At
least the first candidate gets its template in a round.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from logweir.functions.lcs import lcs_template
from logweir.operators.ordering import lookup
from logweir.operators.overlaps import common_length, common_places, numbered_tokens, sharing, token_key
from logweir.session import materialise

FIRST = 64
#: Messages sent back by one leader that may be candidates in one round.
RETURNED = 64


def _covered(n: Column, tau: float) -> Column:
    """The least number of tokens that covers ``tau`` of ``n``, one at least."""
    return F.greatest(F.lit(1), F.ceil(n * F.lit(tau) - F.lit(1e-9))).cast("int")


def _longer(tau: float) -> Column:
    return _covered(F.greatest(F.size("l.tokens"), F.size("r.tokens")), tau)


def _leaders(waiting: DataFrame, wanted: int, rows: int, least: bytes, tau: float) -> DataFrame:
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, wanted / rows) * (1 << 30))
    chosen = waiting.where(part | (F.col("id") == F.lit(least)))
    back = F.row_number().over(Window.partitionBy("sent_by").orderBy("id"))
    fresh, returned = chosen.where(F.col("sent_by").isNull()), chosen.where(F.col("sent_by").isNotNull())
    few = returned.withColumn("_back", back).where(F.col("_back") <= RETURNED).drop("_back")
    some = materialise(fresh.unionByName(few).select("id", "tokens", "elements"))
    before = sharing(some, some, _covered(F.size("tokens"), tau), (F.col("l.id") > F.col("r.id")) & (F.col("shared") >= _longer(tau)))
    linked = before.where(common_length("l.tokens", "r.tokens") >= _longer(tau)).select(F.col("l.id").alias("id")).distinct()
    return materialise(some.join(linked, "id", "left_anti"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _template(tokens: pd.Series, kept: pd.Series) -> pd.Series:
    return pd.Series([lcs_template([row[i] for i in sorted(places)], list(row)) for row, places in zip(tokens, kept)])


def _round(waiting: DataFrame, leaders: DataFrame, tau: float) -> tuple[DataFrame, DataFrame]:
    """``id, template`` of the messages that got a template, and the messages that go on waiting."""
    met = sharing(waiting, leaders, _covered(F.size("tokens"), tau), F.col("shared") >= _longer(tau))
    placed = met.withColumn("places", common_places("l.tokens", "r.tokens")).where(F.size("places") >= _longer(tau))
    best = F.min(F.struct((-F.size("places")).alias("a"), F.size("r.tokens").alias("b"), F.col("r.id").alias("leader"), "places"))
    followers = materialise(placed.groupBy(F.col("l.id").alias("id"), F.size("l.tokens").alias("n")).agg(best.alias("f")).select("id", "n", "f.leader", "f.places"))
    members = followers.groupBy("leader").agg(F.count(F.lit(1)).alias("members"))
    support = followers.select("leader", F.explode("places").alias("place")).groupBy("leader", "place").agg(F.count(F.lit(1)).alias("n"))
    sums = support.join(members, "leader").groupBy("leader").agg(
        F.sort_array(F.collect_list(F.when(F.col("n") == F.col("members"), F.col("place")))).alias("by_all"),
        F.sort_array(F.collect_list(F.when(2 * F.col("n") >= F.col("members"), F.col("place")))).alias("by_half"),
    )
    enough = lambda c: F.size(c) >= _covered(F.size("tokens"), tau)
    whole = F.sequence(F.lit(0), F.size("tokens") - 1)
    kept = F.when(enough("by_all"), F.col("by_all")).when(enough("by_half"), F.col("by_half")).otherwise(whole)
    templates = materialise(
        leaders.withColumnRenamed("id", "leader").join(sums, "leader").withColumn("kept", kept).select("leader", "kept", _template("tokens", "kept").alias("template"))
    )
    joined = lookup(followers, templates, ["leader"], "inner")
    holds = (F.size(F.array_intersect("places", "kept")) == F.size("kept")) & (F.size("kept") >= _covered(F.col("n"), tau))
    judged = materialise(joined.select("id", "leader", F.when(holds, F.col("template")).alias("template")))
    found = judged.where(F.col("template").isNotNull()).select("id", "template")
    sent = judged.where(F.col("template").isNull()).select("id", F.col("leader").alias("now_by"))
    left = waiting.join(found.select("id"), "id", "left_anti").join(sent, "id", "left")
    return found, left.withColumn("sent_by", F.coalesce("now_by", "sent_by")).drop("now_by")


def message_templates(messages: DataFrame, tau: float) -> DataFrame:
    """``id, template`` for distinct messages ``id, tokens``; a message without tokens is its own template."""
    rows = messages.where(F.size("tokens") > 0).select("id", "tokens", numbered_tokens("tokens").alias("elements"))
    waiting = materialise(rows.withColumn("sent_by", F.lit(None).cast("binary")))
    found, wanted = [messages.where(F.size("tokens") == 0).select("id", F.col("tokens").alias("template"))], FIRST
    while True:
        n, least = waiting.agg(F.count(F.lit(1)), F.min("id")).first()
        if not n:
            return reduce(DataFrame.unionByName, found)
        leaders = _leaders(waiting, wanted, n, bytes(least), tau)
        now, left = _round(waiting, leaders, tau)
        found.append(now)
        waiting, wanted = materialise(left), 4 * wanted


def spell_templates(lines: DataFrame, tau: float, line: str = "line_id") -> DataFrame:
    """Add ``cluster`` and ``cluster_template`` to lines with a ``tokens`` column, by common subsequence."""
    keyed = lines.withColumn("_key", token_key(F.col("tokens")))
    messages = materialise(keyed.where(F.col("tokens").isNotNull()).groupBy(F.col("_key").alias("id")).agg(F.first("tokens").alias("tokens")))
    named = materialise(message_templates(messages, tau))
    result = named.select(F.col("id").alias("_key"), F.hex(token_key(F.col("template"))).alias("cluster"), F.col("template").alias("cluster_template"))
    return lookup(keyed, result, ["_key"], rows=named.count()).drop("_key")
