"""Column expressions on token and event arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from logweir.functions.binding import let
from logweir.functions.text import WILDCARD, constant_tokens


def template_similarity(template: Column, tokens: Column) -> Column:
    """Share of equal constant positions of two arrays of one length; wildcards never count as equal."""
    same = F.zip_with(template, tokens, lambda a, b: F.when((a != WILDCARD) & (a == b), 1).otherwise(0))
    hits = F.aggregate(same, F.lit(0), lambda acc, x: acc + x)
    return F.when(F.size(template) == 0, None).otherwise(hits.cast("double") / F.size(template))


def wildcard_count(template: Column) -> Column:
    return F.size(F.filter(template, lambda t: t == WILDCARD))


def merge_template(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.when(x == y, x).otherwise(WILDCARD))


def tokens_contained(template: Column, tokens: Column, share: float = 0.5) -> Column:
    """The containment test used before any subsequence search."""
    long_enough = F.size(template) >= share * F.size(tokens)
    return long_enough & (F.size(F.array_except(constant_tokens(template), tokens)) == 0)


def token_overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def truncate_or_pad(items: Column, n: int, fill: Column) -> Column:
    return F.slice(F.concat(items, F.array_repeat(fill, n)), 1, n)


def pad_to(items: Column, n: Column, fill: Column) -> Column:
    return F.slice(F.concat(items, F.array_repeat(fill, n)), F.lit(1), n)


def count_by_item(items: Column) -> Column:
    """Sparse count vector of a small array: ``[(item, n)]`` ordered by item."""
    return let(
        items,
        lambda xs: F.transform(
            F.array_sort(F.array_distinct(xs)),
            lambda x: F.struct(x.alias("item"), F.size(F.filter(xs, lambda y: y == x)).alias("n")),
        ),
    )
