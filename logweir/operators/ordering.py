"""Order-dependent building blocks that never place an unbounded group in one task.

Every function works on blocks of the order key. A block holds at most ``block_rows`` distinct order
values of one key, so a key that owns a third of all rows is spread over many tasks; only one small
row per block travels to the step that joins the blocks up.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from logweir.session import materialise

BLOCK_ROWS = 1 << 20
BROADCAST_ROWS = 200_000
SALTS = 16


def _block(order: str, block_rows: int) -> Column:
    return F.floor(F.col(order) / F.lit(block_rows)).cast("bigint")


def dense_position(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (),
    out: str = "pos",
    size: str | None = None,
    totals: Mapping[str, tuple[str, str]] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Number rows 0..n-1 per key in ``order``; the first order column is a number.

    ``size`` adds the rows per key. ``totals`` adds other per-key values in the same pass, as
    ``{out: (function, column)}`` with function ``min``, ``max`` or ``sum``.
    """
    keys, order, totals = list(keys), list(order), dict(totals or {})
    blocked = df.withColumn("_block", _block(order[0], block_rows))
    partial = [F.count(F.lit(1)).alias("_rows")]
    partial += [getattr(F, fn)(col).alias(f"_part_{name}") for name, (fn, col) in totals.items()]
    blocks = blocked.groupBy(*keys, "_block").agg(*partial)
    of_key = Window.partitionBy(*keys)
    earlier = of_key.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start")]
    if size:
        carried.append(F.sum("_rows").over(of_key).alias(size))
    carried += [getattr(F, fn)(f"_part_{name}").over(of_key).alias(name) for name, (fn, _) in totals.items()]
    starts = blocks.select(*keys, "_block", *carried)
    in_block = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (
        blocked.join(starts, [*keys, "_block"])
        .withColumn(out, (F.col("_start") + F.row_number().over(in_block) - 1).cast("bigint"))
        .drop("_block", "_start")
    )


def running_max(
    df: DataFrame, value: str, order: Sequence[str], out: str, keys: Sequence[str] = (), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Largest ``value`` so far in ``order``, the current row included."""
    keys, order = list(keys), list(order)
    blocked = df.withColumn("_block", _block(order[0], block_rows))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        blocked.groupBy(*keys, "_block").agg(F.max(value).alias("_top")).select(*keys, "_block", F.max("_top").over(earlier).alias("_carry"))
    )
    so_far = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocked.join(carry, [*keys, "_block"])
        .withColumn(out, F.greatest(F.max(value).over(so_far), F.col("_carry")))
        .drop("_block", "_carry")
    )


def scan_log(df: DataFrame, order: str, time: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One pass over a timed log: dense ``line_idx``, time of the line before, and largest time so far."""
    blocked = df.withColumn("_block", _block(order, block_rows))
    across = Window.orderBy("_block")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        blocked.groupBy("_block")
        .agg(F.count(F.lit(1)).alias("_rows"), F.max(time).alias("_top"), F.max_by(time, order).alias("_last"))
        .select(
            "_block",
            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"),
            F.max("_top").over(earlier).alias("_top"),
            F.lag("_last").over(across).alias("_last"),
        )
    )
    inside = Window.partitionBy("_block").orderBy(order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocked.join(carry, "_block")
        .select(
            *df.columns,
            (F.col("_start") + F.row_number().over(inside) - 1).cast("bigint").alias("line_idx"),
            F.coalesce(F.lag(time).over(inside), F.col("_last")).alias("prev_time"),
            F.greatest(F.max(time).over(so_far), F.col("_top")).alias("time_so_far"),
        )
    )


def previous_value(
    df: DataFrame, value: str, order: str, out: str, keys: Sequence[str] = (), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``value`` of the row before, NULL on the first row of a key."""
    keys = list(keys)
    blocked = df.withColumn("_block", _block(order, block_rows))
    across = Window.partitionBy(*keys).orderBy("_block")
    carry = (
        blocked.groupBy(*keys, "_block").agg(F.max_by(value, order).alias("_last")).select(*keys, "_block", F.lag("_last").over(across).alias("_carry"))
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    return (
        blocked.join(carry, [*keys, "_block"])
        .withColumn(out, F.coalesce(F.lag(value).over(inside), F.col("_carry")))
        .drop("_block", "_carry")
    )


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    columns: Mapping[str, tuple[str, int]],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add values of rows at fixed distances along a dense position: ``{out: (column, offset)}``.

    The few rows next to a block border are copied to the block beyond it, so one bounded window per
    block answers every offset with a single shuffle.
    """
    before = max([0] + [-o for _, o in columns.values()])
    after = max([0] + [o for _, o in columns.values()])
    if max(before, after) > block_rows:
        raise ValueError("offset larger than a block")
    keys = list(keys)
    home = _block(pos, block_rows)
    within = F.pmod(F.col(pos), F.lit(block_rows))
    targets = F.filter(
        F.array(
            home,
            F.when(within < after, home - 1),
            F.when(within >= block_rows - before, home + 1),
        ),
        lambda b: b.isNotNull() & (b >= 0),
    )
    spread = df.withColumn("_block", F.explode(targets))
    line = Window.partitionBy(*keys, "_block").orderBy(pos)
    found = [
        (F.lead(col, offset) if offset >= 0 else F.lag(col, -offset)).over(line).alias(out)
        for out, (col, offset) in columns.items()
    ]
    return spread.select("*", *found).where(F.col("_block") == home).drop("_block")


def hash_rank(
    df: DataFrame, ids: Sequence[str], seed: int, by: Sequence[str] = (), out: str = "shuffle_rank", size: str | None = None
) -> DataFrame:
    """Deterministic random order: rank by ``md5(seed:id)``, per class of ``by``.

    Hash prefixes of unique ids are spread evenly, so each of the 65,536 prefixes is a small group.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat_ws(":", F.lit(str(seed)), *ids))).withColumn(
        "_prefix", F.conv(F.substring("_hash", 1, 4), 16, 10).cast("bigint")
    )
    ranked = dense_position(hashed, ["_prefix", "_hash", *ids], by, out, size, block_rows=1)
    return ranked.drop("_hash", "_prefix")


def hash_sample(df: DataFrame, ids: Sequence[str], wanted: Column, seed: int, out: str = "shuffle_rank") -> DataFrame:
    """The first ``wanted`` rows in the order of ``hash_rank``; ``wanted`` may use ``_total``, the row count.

    The counts of the hash prefixes show which prefix holds the last wanted row, so rows beyond it are
    dropped before anything is shuffled.
    """
    prefix = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *ids)), 1, 4), 16, 10).cast("bigint")
    counts = df.groupBy(prefix.alias("_prefix")).agg(F.count(F.lit(1)).alias("_rows"))
    upto = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
    table = counts.select("_prefix", F.sum("_rows").over(upto).alias("_upto"), F.sum("_rows").over(Window.partitionBy()).alias("_total"))
    enough = table.select("_prefix", "_upto", wanted.cast("bigint").alias("_wanted"))
    limits = enough.agg(
        F.coalesce(F.min(F.when(F.col("_upto") >= F.col("_wanted"), F.col("_prefix"))), F.lit(1 << 16)).alias("cut"),
        F.max("_wanted").alias("wanted"),
    )
    cut, n = limits.first()
    return hash_rank(df.where(prefix <= cut), ids, seed, (), out).where(F.col(out) < (n or 0))


def ordinal(table: DataFrame, order: Sequence[Column], out: str, start: int = 0, small: int = BROADCAST_ROWS) -> DataFrame:
    """Number a dictionary table in ``order``.

    The table is materialised first. Up to ``small`` rows one window is enough; beyond that the rows
    are range-sorted, and each sorted part gets the row count of the parts before it.
    """
    fixed = materialise(table)
    if fixed.count() <= small:
        return fixed.withColumn(out, (F.row_number().over(Window.orderBy(*order)) - 1 + start).cast("bigint"))
    tagged = materialise(fixed.orderBy(*order).withColumn("_tag", F.monotonically_increasing_id()))
    part = F.shiftright("_tag", 33)
    counts = tagged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    local = F.col("_tag").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        tagged.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(out, (F.col("_start") + local + start).cast("bigint"))
        .drop("_tag", "_part", "_start")
    )


def lookup(
    facts: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left", small: int = BROADCAST_ROWS, rows: int | None = None
) -> DataFrame:
    """Join facts to a dictionary with unique keys ``on``.

    A dictionary of at most ``small`` rows is broadcast. A larger one is shuffled, with each of its
    rows copied to every salt so that a hot key in the facts spreads over several tasks.
    """
    on = list(on)
    if rows is None:
        table = materialise(table)
        n, most = table.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
        if most > 1:
            raise ValueError(f"the dictionary has several rows for one value of {on}")
    else:
        n = rows
    if n <= small:
        return facts.join(F.broadcast(table), on, how)
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*facts.columns), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def spread_join(facts: DataFrame, per_key: DataFrame, keys: Sequence[str], pos: str, size: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Join per-key values (one row per key, with the key's row count ``size``) to positioned facts.

    Each key's row is copied once per position block, so a long session is joined by many tasks.
    """
    keys = list(keys)
    blocks = per_key.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(size) - 1) / block_rows))))
    return facts.withColumn("_block", _block(pos, block_rows)).join(blocks, [*keys, "_block"]).drop("_block")


def exact_quantile(df: DataFrame, value: str, q: float, exact_rows: int = 100_000, bins: int = 4096) -> float:
    """Linear-interpolated quantile, as in the SQL continuous percentile, without sorting all rows.

    Histograms narrow the range around the wanted rank until at most ``exact_rows`` values are left;
    only those reach the driver. Each histogram is a small map-side combined aggregate.
    """
    inside = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    n, lo, hi = inside.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if n == 0:
        raise ValueError("no values")
    at = (n - 1) * q
    want = int(at)
    share, after = at - want, hi
    while lo < hi:
        if n <= exact_rows:
            values = sorted(r["v"] for r in inside.collect())
            low, after = values[want], values[want + 1] if want + 1 < len(values) else after
            return low + (after - low) * share
        slot = F.least(F.floor((F.col("v") - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
        table = (
            inside.groupBy(slot.alias("slot"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .orderBy("slot")
            .collect()
        )
        for i, row in enumerate(table):
            if want < row["n"]:
                break
            want -= row["n"]
        if i + 1 < len(table):
            after = table[i + 1]["lo"]
        lo, hi, n = row["lo"], row["hi"], row["n"]
        inside = inside.where((F.col("v") >= lo) & (F.col("v") <= hi))
    return lo if want + 1 < n else lo + (after - lo) * share
