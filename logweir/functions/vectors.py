"""Column expressions on numeric arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from logweir.functions.binding import let

# Fixed value: the guard added to norms and denominators.
TINY = 1e-8


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    d = 1 - dot(a, b) / (norm(a) * norm(b) + TINY)
    return F.when(d < TINY, 0.0).otherwise(d)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))))


def sigmoid_nonzero(x: Column) -> Column:
    return F.when(x != 0, 1 / (1 + F.exp(-x))).otherwise(x)


def adaptive_avg_pool(vector: Column, bins: int) -> Column:
    """Mean over ``bins`` spans; span i is ``[floor(i L / m), ceil((i + 1) L / m))``."""

    def pooled(v: Column) -> Column:
        size = F.size(v)

        def one(i: Column) -> Column:
            lo = F.floor(i * size / bins).cast("int")
            hi = F.ceil((i + 1) * size / bins).cast("int")
            return _sum(F.slice(v, lo + 1, hi - lo)) / (hi - lo)

        return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), one)

    return let(vector.cast("array<double>"), pooled)
