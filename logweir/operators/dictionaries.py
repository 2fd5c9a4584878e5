"""Event dictionaries: ranks, vocabularies, encoding and decoding.

Sequences are in long form, one row per event: ``session_id, pos, event, n_events, ...``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from logweir.functions.text import template_id
from logweir.operators.ordering import BROADCAST_ROWS, lookup, ordinal

# Special tokens and their ids.
SPECIALS = ("<pad>", "<unk>", "<eos>", "<sos>", "<mask>")
PAD, UNK, EOS, SOS, MASK = range(5)
FIRST_SEEN_SPECIALS = ("PAD", "UNK")
WINDOW_SPECIALS = ("#OOV", "#Pad")
UNKNOWN_RANK = -1


def _constants(df: DataFrame, tokens: tuple[str, ...]) -> DataFrame:
    return df.sparkSession.createDataFrame([(t, i, None) for i, t in enumerate(tokens)], "token string, idx bigint, freq bigint")


def distinct_events(sessions: DataFrame, event: str = "event") -> DataFrame:
    """The different events with the number of their occurrences."""
    return sessions.groupBy(event).agg(F.count(F.lit(1)).alias("n"))


def template_occurrences(lines: DataFrame, template: str = "template", line: str = "line_id") -> DataFrame:
    """Distinct templates with id, count and first line."""
    return (
        lines.groupBy(F.col(template).alias("event_template"))
        .agg(F.count(F.lit(1)).alias("occurrences"), F.min(line).alias("first_line"))
        .withColumn("event_id", template_id(F.col("event_template")))
    )


def event_rank(occurrences: DataFrame, event: str = "event_id", small: int = BROADCAST_ROWS) -> DataFrame:
    """``event -> 1..n`` by occurrences; equal counts by event id. Texts that share an id count together."""
    return ordinal(
        occurrences.groupBy(event).agg(F.sum("occurrences").alias("occurrences")), [F.desc("occurrences"), F.asc(event)], "event_rank", start=1, small=small
    )


def apply_event_rank(lines: DataFrame, ranks: DataFrame, event: str = "event_id", small: int = BROADCAST_ROWS) -> DataFrame:
    joined = lookup(lines, ranks.select(event, "event_rank"), [event], small=small)
    return joined.withColumn("event_rank", F.coalesce("event_rank", F.lit(UNKNOWN_RANK).cast("bigint")))


def build_vocab(events: DataFrame, event: str = "event", max_size: int | None = None, min_freq: int = 1, small: int = BROADCAST_ROWS) -> DataFrame:
    """``token, idx, freq``: specials first, then by frequency, then alphabetically."""
    counts = (
        events.where(~F.col(event).isin(*SPECIALS))
        .groupBy(F.col(event).alias("token"))
        .agg(F.count(F.lit(1)).alias("freq"))
        .where(F.col("freq") >= max(min_freq, 1))
    )
    words = ordinal(counts, [F.desc("freq"), F.asc("token")], "idx", start=len(SPECIALS), small=small)
    if max_size is not None:
        words = words.where(F.col("idx") < len(SPECIALS) + max_size)
    return _constants(events, SPECIALS).unionByName(words)


def extend_vocab(vocab: DataFrame, other: DataFrame, sort: bool = False, small: int = BROADCAST_ROWS) -> DataFrame:
    """Append the tokens of ``other`` that ``vocab`` lacks, in their own order or alphabetically."""
    size = vocab.agg((F.max("idx") + 1).alias("n")).first()["n"]
    unseen = other.join(vocab.select("token"), "token", "left_anti").withColumnRenamed("idx", "_old")
    order = [F.asc("token")] if sort else [F.asc("_old")]
    added = ordinal(unseen, order, "idx", start=size, small=small).drop("_old")
    return vocab.unionByName(added)


def build_vocab_first_seen(
    events: DataFrame,
    event: str = "event",
    specials: tuple[str, ...] = FIRST_SEEN_SPECIALS,
    order: tuple[str, ...] = ("first_line", "session_id", "pos"),
    small: int = BROADCAST_ROWS,
) -> DataFrame:
    """Ids by first appearance after the specials."""
    seen = (
        events.where(~F.col(event).isin(*specials))
        .groupBy(F.col(event).alias("token"))
        .agg(F.min(F.struct(*order)).alias("_seen"), F.count(F.lit(1)).alias("freq"))
    )
    words = ordinal(seen, [F.asc("_seen")], "idx", start=len(specials), small=small).drop("_seen")
    return _constants(events, specials).unionByName(words)


def encode_events(events: DataFrame, vocab: DataFrame, event: str = "event", out: str = "idx", unknown: int = UNK, small: int = BROADCAST_ROWS) -> DataFrame:
    ids = vocab.select(F.col("token").alias(event), F.col("idx").alias(out))
    return lookup(events, ids, [event], small=small).withColumn(out, F.coalesce(out, F.lit(unknown).cast("bigint")))


def encode_sequence(
    events: DataFrame,
    vocab: DataFrame,
    seq_len: int | None = None,
    with_eos: bool = False,
    with_sos: bool = False,
    small: int = BROADCAST_ROWS,
) -> DataFrame:
    """Long-form ids ``session_id, pos, idx, origin_len`` with optional markers, cut or padded to ``seq_len``."""
    shift = int(with_sos)
    length = (F.col("n_events") + shift + int(with_eos)).alias("origin_len")
    body = encode_events(events, vocab, small=small).select("session_id", (F.col("pos") + shift).alias("pos"), "idx", length)
    heads = events.where(F.col("pos") == 0)

    def marker(at: Column, idx: int) -> DataFrame:
        return heads.select("session_id", at.cast("bigint").alias("pos"), F.lit(idx).cast("bigint").alias("idx"), length)

    pieces = [body]
    if with_sos:
        pieces.append(marker(F.lit(0), SOS))
    if with_eos:
        pieces.append(marker(F.col("n_events") + shift, EOS))
    if seq_len is not None:
        short = heads.where(F.col("n_events") + shift + int(with_eos) < seq_len)
        pieces.append(
            short.select(
                "session_id",
                F.explode(F.sequence(F.col("n_events") + shift + int(with_eos), F.lit(seq_len - 1).cast("bigint"))).alias("pos"),
                F.lit(PAD).cast("bigint").alias("idx"),
                length,
            )
        )
    out = reduce(DataFrame.unionByName, pieces)
    return out if seq_len is None else out.where(F.col("pos") < seq_len)


def decode_sequence(ids: DataFrame, vocab: DataFrame, drop_pad: bool = False, small: int = BROADCAST_ROWS) -> DataFrame:
    """Ids back to tokens; an id outside the vocabulary reads ``<id>``."""
    kept = ids.where(F.col("idx") != PAD) if drop_pad else ids
    joined = lookup(kept, vocab.select("idx", "token"), ["idx"], small=small)
    return joined.withColumn("token", F.coalesce("token", F.concat(F.lit("<"), F.col("idx").cast("string"), F.lit(">"))))
