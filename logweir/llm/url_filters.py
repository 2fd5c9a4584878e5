"""URL filtering by association rules: FP-growth over URL tokens and labels, rules matched by an inverted index.

Native DataFrame code. A URL becomes a set of tokens (scheme, host names and parts, path words, query keys,
fragment). Spark's FP-growth mines token sets that go with the label ``bad`` from labelled URLs; rules below the wanted
support or confidence are pruned, and so are rules that a shorter rule with at least their confidence implies. Each rule is
indexed under one token, its rarest; a URL's token set looks its rules up by join and is blocked if all tokens of
a rule are in it. Equal token sets are matched once.

Null URLs and URLs without ``://`` have empty host and path and are judged by no host rule. Repeated rows are judged
alike. An empty table, or one without labels, gives no rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from logweir.functions.binding import let

LABEL = "label=bad"
HostRule = tuple[str, str, str]  # host, path prefix, verdict


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule(host: Column, path: Column, rules: Sequence[HostRule]) -> tuple[Column, Column]:
    """Name and verdict of the longest given rule that fits the host or a parent domain and the start of the path; else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for domain, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        name = F.when(fits, F.lit(domain + start)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens. Path words made of digits are told by their length alone."""
    digits = lambda w: F.when(w.rlike(r"^\d+$"), F.concat(F.lit("#"), F.length(w).cast("string"))).otherwise(w)
    labels = F.split(host, r"\.")
    words = F.filter(F.split(lower_ascii(path), r"[/._-]+"), lambda w: w != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda q: q != ""), lambda q: F.concat(F.lit("query:"), F.substring_index(q, "=", 1)))
    fragment = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)#(.*)$", 1)
    scheme = lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?)://", 1))
    tokens = F.concat(
        F.transform(labels, lambda w: F.concat(F.lit("host:"), w)),
        let(words, lambda ws: F.transform(ws, lambda w: F.concat(F.lit("path:"), digits(w)))),
        keys,
        F.array(F.concat(F.lit("site:"), host), F.concat(F.lit("scheme:"), scheme)),
        F.when(fragment != "", F.array(F.concat(F.lit("fragment:"), fragment))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_sort(F.array_distinct(tokens))


def mine_rules(labelled: DataFrame, support: float = 0.002, confidence: float = 0.8, lift: float = 1.5, least: int = 10) -> DataFrame:
    """Rules (``antecedent`` array, ``confidence``, ``support``) that say bad, from rows ``tokens, bad``.

    A rule needs the share ``support`` of the labelled rows and at least ``least`` of them. The frequent token sets are
    bounded by the support, not by the number of rows.
    """
    label = F.when(F.col("bad"), F.array(F.lit(LABEL))).otherwise(F.array().cast("array<string>"))
    baskets = labelled.where(F.col("tokens").isNotNull()).select(F.concat("tokens", label).alias("items"))
    support = max(support, least / max(least, baskets.count()))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where((F.col("consequent") == F.array(F.lit(LABEL))) & (F.col("lift") >= lift)).select(
        F.array_sort("antecedent").alias("antecedent"), "confidence", "support"
    )
    longer, shorter = rules.alias("l"), rules.withColumn("key", F.explode("antecedent")).alias("s")
    implied = (
        longer.withColumn("key", F.explode("l.antecedent"))
        .join(shorter, "key")
        .where(
            (F.size("l.antecedent") > F.size("s.antecedent"))
            & (F.size(F.array_except("s.antecedent", "l.antecedent")) == 0)
            & (F.col("s.confidence") >= F.col("l.confidence"))
        )
        .select(F.col("l.antecedent").alias("antecedent"))
        .distinct()
    )
    return rules.join(implied, "antecedent", "left_anti")


def blocked_sets(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of ``token_sets`` (distinct column ``tokens``) that hold all tokens of some rule."""
    seen = rules.select(F.explode("antecedent").alias("token")).distinct()
    counts = token_sets.select(F.explode("tokens").alias("token")).join(seen, "token", "left_semi").groupBy("token").count()
    rarest = (
        rules.select("antecedent", F.explode("antecedent").alias("token"))
        .join(counts, "token")
        .groupBy("antecedent")
        .agg(F.min_by("token", F.struct("count", "token")).alias("token"))
    )
    return (
        token_sets.withColumn("token", F.explode("tokens"))
        .join(rarest, "token")
        .where(F.size(F.array_except("antecedent", "tokens")) == 0)
        .select("tokens")
        .distinct()
    )


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[HostRule],
    page_id: str = "page_id",
    url: str = "url",
    support: float = 0.002,
    confidence: float = 0.8,
) -> DataFrame:
    """page_id, host, path, rule, verdict for every row; ``labels`` has ``page_id`` and boolean ``bad``.

    A given host rule decides where one fits; otherwise a URL is blocked if a mined rule fits it and allowed if none does.
    """
    link = F.col(f"`{url}`")
    parts = pages.select(F.col(f"`{page_id}`").alias("page_id"), link.alias("url"), url_host(link).alias("host"), url_path(link).alias("path"))
    name, verdict = host_rule(F.col("host"), F.col("path"), rules)
    judged = parts.select(
        "page_id", "host", "path", name.alias("rule"), verdict.alias("given"), url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")
    )
    known = labels.where(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    mined = mine_rules(judged.join(known, "page_id").select("tokens", "bad"), support, confidence)
    hit = blocked_sets(judged.where(F.col("given").isNull()).select("tokens").distinct(), mined)
    return (
        judged.join(hit.withColumn("hit", F.lit(True)), "tokens", "left")
        .withColumn("verdict", F.coalesce("given", F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow"))))
        .select("page_id", "host", "path", "rule", "verdict")
    )
