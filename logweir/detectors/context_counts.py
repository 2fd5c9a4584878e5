"""Next-event and masked-event detectors scored by context counts with back-off.

The fitted model is one table per context kind, ``context key -> candidates``. Any other scorer can
take its place: a table of (context, event, score) rows turned into lists by ``candidate_lists``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from logweir.operators.candidates import candidate_lists
from logweir.operators.dictionaries import SPECIALS
from logweir.operators.ordering import BROADCAST_ROWS, lookup, with_neighbours
from logweir.operators.windows import PAD_EVENT, next_event_windows
from logweir.session import materialise

MARK = "\x1f"
SOS_TOKEN, MASK_TOKEN, PAD_TOKEN = SPECIALS[3], SPECIALS[4], SPECIALS[0]


@dataclass
class ContextModel:
    """Candidate lists by context kind, most specific kind first."""

    table: DataFrame
    kinds: list[int]
    rows: dict[int, int]


def _fit(counted: DataFrame, kinds: list[int], g: int) -> ContextModel:
    scores = counted.groupBy("kind", "ctx_key", "event").agg(F.count(F.lit(1)).alias("score"))
    table = materialise(candidate_lists(scores, g, ["kind", "ctx_key"]))
    rows = {r["kind"]: r["count"] for r in table.groupBy("kind").count().collect()}
    return ContextModel(table, kinds, rows)


def _with_candidates(rows: DataFrame, model: ContextModel, keys: dict[int, Column], small: int) -> DataFrame:
    """Attach the candidates of the most specific context the model knows."""
    out = rows.withColumns({f"_key{k}": key for k, key in keys.items()})
    for k in model.kinds:
        part = model.table.where(F.col("kind") == k).select(F.col("ctx_key").alias(f"_key{k}"), F.col("candidates").alias(f"_cand{k}"))
        if k == 0:  # one row without context: a value, not a join
            out = out.withColumn("_cand0", part.select("_cand0").scalar())
        else:
            out = lookup(out, part, [f"_key{k}"], small=small, rows=model.rows.get(k, 0))
    best = F.coalesce(*[F.col(f"_cand{k}") for k in model.kinds])
    return out.withColumn("candidates", best).drop(*[f"_key{k}" for k in model.kinds], *[f"_cand{k}" for k in model.kinds])


def _suffix_key(ctx: Column, width: int, k: int) -> Column:
    return F.array_join(F.slice(ctx, width - k + 1, k), MARK) if k else F.lit("")


def fit_next_event(windows: DataFrame, width: int, g: int) -> ContextModel:
    """Counts of (last k events, next event) for k = width .. 0; padded targets do not train."""
    kinds = list(range(width, -1, -1))
    keyed = F.array(*[F.struct(F.lit(k).alias("kind"), _suffix_key(F.col("ctx"), width, k).alias("ctx_key")) for k in kinds])
    counted = (
        windows.where(F.col("next_event") != PAD_EVENT)
        .select(F.explode(keyed).alias("_c"), F.col("next_event").alias("event"))
        .select("_c.kind", "_c.ctx_key", "event")
    )
    return _fit(counted, kinds, g)


def score_next_event(windows: DataFrame, model: ContextModel, width: int, count_pad_target: bool = True, small: int = BROADCAST_ROWS) -> DataFrame:
    """``anomaly`` 1 on windows whose next event is not a candidate, and the best candidate as ``pred_event``."""
    tried = windows if count_pad_target else windows.where(F.col("next_event") != PAD_EVENT)
    keys = {k: _suffix_key(F.col("ctx"), width, k) for k in model.kinds}
    found = _with_candidates(tried, model, keys, small)
    missed = ~F.coalesce(F.array_contains("candidates", F.col("next_event")), F.lit(False))
    return found.withColumn("anomaly", missed.cast("int")).withColumn("pred_event", F.get("candidates", F.lit(0))).drop("candidates")


def next_event_results(scored: DataFrame) -> DataFrame:
    return scored.groupBy("session_id").agg(
        F.sum("anomaly").alias("logkey_anomaly"), F.count(F.lit(1)).alias("predicted_logkey"), F.max("label").alias("label")
    )


def next_event_detector(train: DataFrame, test: DataFrame, width: int, g: int, count_pad_target: bool = True, small: int = BROADCAST_ROWS) -> DataFrame:
    """Per test session: windows tried and windows whose next event is unexpected."""
    model = fit_next_event(next_event_windows(train, width), width, g)
    return next_event_results(score_next_event(next_event_windows(test, width), model, width, count_pad_target, small))


def uniform(seed: int, *ids: Column) -> Column:
    """A number in [0, 1) fixed by the seed and ids."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mask_events(events: DataFrame, mask_ratio: float, seed: int) -> DataFrame:
    """``token`` (event or mask) and ``target`` (event at masked positions, else pad) per position."""
    masked = uniform(seed, F.col("session_id"), F.col("pos")) < mask_ratio
    return events.withColumn("token", F.when(masked, MASK_TOKEN).otherwise(F.col("event"))).withColumn(
        "target", F.when(masked, F.col("event")).otherwise(PAD_TOKEN)
    )


def with_start(masked: DataFrame) -> DataFrame:
    """The same rows one position later, behind a start token without target."""
    shifted = masked.withColumn("pos", F.col("pos") + 1)
    heads = masked.where(F.col("pos") == 0)
    starts = heads.withColumns({"token": F.lit(SOS_TOKEN), "target": F.lit(PAD_TOKEN)})
    return shifted.unionByName(starts)


def _sides(events: DataFrame, token: str) -> DataFrame:
    near = with_neighbours(events, ["session_id"], "pos", {"prev_token": (token, -1), "next_token": (token, 1)})
    return near.withColumn("prev_token", F.coalesce("prev_token", F.lit(SOS_TOKEN)))


def fit_masked_event(train: DataFrame, g: int) -> ContextModel:
    """Counts of events given both sides (3), the side before (2), the side after (1), nothing (0)."""
    near = _sides(train, "event")
    keyed = F.array(
        F.struct(F.lit(3).alias("kind"), F.when(F.col("next_token").isNotNull(), F.concat_ws(MARK, "prev_token", "next_token")).alias("ctx_key")),
        F.struct(F.lit(2).alias("kind"), F.col("prev_token").alias("ctx_key")),
        F.struct(F.lit(1).alias("kind"), F.col("next_token").alias("ctx_key")),
        F.struct(F.lit(0).alias("kind"), F.lit("").alias("ctx_key")),
    )
    counted = near.select(F.explode(keyed).alias("_c"), "event").select("_c.kind", "_c.ctx_key", "event").where(F.col("ctx_key").isNotNull())
    return _fit(counted, [3, 2, 1, 0], g)


def score_masked_event(masked: DataFrame, model: ContextModel, small: int = BROADCAST_ROWS) -> DataFrame:
    """``miss`` for every masked position; a masked neighbour counts as missing, so back-off applies."""
    near = _sides(masked, "token").where(F.col("token") == MASK_TOKEN)
    before = F.when(F.col("prev_token") != MASK_TOKEN, F.col("prev_token"))
    after = F.when(F.col("next_token") != MASK_TOKEN, F.col("next_token"))
    both = F.when(before.isNotNull() & after.isNotNull(), F.concat_ws(MARK, before, after))
    found = _with_candidates(near, model, {3: both, 2: before, 1: after, 0: F.lit("")}, small)
    missed = ~F.coalesce(F.array_contains("candidates", F.col("target")), F.lit(False))
    return found.withColumn("miss", missed.cast("int")).drop("candidates")


def masked_event_results(masked: DataFrame, scored: DataFrame) -> DataFrame:
    """Per session: masked and undetected positions, sequence length with the start token, label."""
    counts = scored.groupBy("session_id").agg(F.count(F.lit(1)).alias("masked_tokens"), F.sum("miss").alias("undetected_tokens"))
    heads = masked.where(F.col("pos") == 0).select("session_id", (F.col("n_events") + 1).alias("total_logkey"), "label")
    zero = F.lit(0).cast("bigint")
    return heads.join(counts, "session_id", "left").select(
        "session_id",
        F.coalesce("masked_tokens", zero).alias("masked_tokens"),
        F.coalesce("undetected_tokens", zero).alias("undetected_tokens"),
        "total_logkey",
        "label",
    )


def masked_event_detector(train: DataFrame, test: DataFrame, g: int, mask_ratio: float, seed: int, small: int = BROADCAST_ROWS) -> DataFrame:
    masked = mask_events(test, mask_ratio, seed)
    return masked_event_results(masked, score_masked_event(masked, fit_masked_event(train, g), small))
