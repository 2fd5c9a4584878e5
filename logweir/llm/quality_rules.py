"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations read the bits.

Native DataFrame code. A row of the ledger holds the measurements of one document and ``fail_bits``, in
which bit k is set where rule k of ``RULE_NAMES`` rejects the document. A policy is a named, versioned set of rules; it rejects a
document whose bits meet the policy's mask. Neither a new policy nor an ablation reads a text again.

Null and empty texts measure as zero words and fail ``few_words``. Repeated rows are judged alike. An
empty table gives an empty ledger. Texts of any length are measured whole, in their own row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from logweir.functions.binding import let
from logweir.llm.common import WORD

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_marks", "n_capitals")


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice: equal windows are neighbours once sorted."""

    def covered(at: Column) -> Column:
        widths = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1), p + 3) - p))
        return F.aggregate(widths, F.lit(0), lambda a, x: a + x)

    def repeated(windows: Column) -> Column:
        return F.sort_array(
            F.filter(
                F.transform(
                    windows,
                    lambda w, i: F.when((w["t"] == F.get(windows, i - 1)["t"]) | (w["t"] == F.get(windows, i + 1)["t"]), w["p"]),
                ),
                lambda p: p.isNotNull(),
            )
        )

    def window(p: Column) -> Column:
        return F.struct(F.concat_ws(" ", F.get(words, p), F.get(words, p + 1), F.get(words, p + 2)).alias("t"), p.alias("p"))

    windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), window))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(windows, lambda w: let(repeated(w), covered)))


def measurements(text: Column) -> Column:
    """One struct with every count that a rule needs, as longs."""
    whole = F.coalesce(text, F.lit(""))

    def from_words(words: Column) -> Column:
        lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD))
        fields = {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")),
            "n_marks": F.length(F.regexp_replace(whole, r"[^!?]+", "")),
            "n_capitals": F.length(F.regexp_replace(whole, r"\P{Lu}+", "")),
            "n_repeat_words": _repeat_words(words),
        }
        counts = F.struct(*[c.cast("long").alias(n) for n, c in fields.items()])
        return F.struct(
            counts.alias("counts"),
            let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct"))).alias("lines"),
        )

    return let(F.regexp_extract_all(whole, F.lit(f"({WORD}+)"), F.lit(1)), from_words)


def _rules() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "few_words": n < 50,
        "repeated_windows": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > 3 * n,
        "duplicate_lines": (F.col("n_lines") >= 4) & (2 * F.col("n_dup_lines") > F.col("n_lines")),
        "exclamations": 10 * F.col("n_marks") > 5 * n,
        "capitals": 10 * F.col("n_capitals") > 6 * F.col("word_chars"),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 25 * n),
    }


#: In bit order; a rule keeps its bit for good, new ones are added at the end.
RULE_NAMES = ("few_words", "repeated_windows", "symbols", "duplicate_lines", "exclamations", "capitals", "word_length")
POLICIES: dict[str, Sequence[str]] = {
    "base-1": ("few_words", "repeated_windows"),
    "full-1": RULE_NAMES,
}


def mask(policy: str | Sequence[str]) -> int:
    """The bits of a policy, given by its version name or as rule names."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(1 << RULE_NAMES.index(n) for n in names)


def quality_ledger(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The kept columns of ``docs`` (all, unless named), the measurements and ``fail_bits``.

    Columns of ``docs`` that are named like a measurement must not be among the kept ones. The counts leave
    a generator, so that filters on the bits do not evaluate the texts once more.
    """
    kept = list(docs.columns if keep is None else keep)
    found = docs.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(measurements(F.col(f"`{text}`")))))
    wide = found.select(
        *[F.col(f"`{c}`") for c in kept],
        F.col("counts.*"),
        F.col("lines.n").cast("long").alias("n_lines"),
        (F.col("lines.n") - F.col("lines.distinct")).cast("long").alias("n_dup_lines"),
    )
    rules = _rules()
    bits = F.lit(0)
    for k, name in enumerate(RULE_NAMES):
        bits = bits.bitwiseOR(F.when(rules[name], F.lit(1 << k)).otherwise(0))
    return wide.select(*[F.col(f"`{c}`") for c in kept], *MEASURES, bits.cast("long").alias("fail_bits"))


def passes(policy: str | Sequence[str], bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy))) == 0


def ablations(ledger: DataFrame, policies: Sequence[str]) -> DataFrame:
    """For each policy and each of its rules: documents that the policy rejects, that the rule fails, that only this rule rejects.

    The ledger is first counted by its bits (at most two to the number of rules, whatever the table's size).
    """
    by_bits = ledger.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rows = [(p, r, mask(p), mask([r])) for p in policies for r in POLICIES[p]]
    wanted = ledger.sparkSession.createDataFrame(rows, "policy string, rule string, policy_mask long, rule_mask long")
    hit = F.col("fail_bits").bitwiseAND(F.col("policy_mask"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return (
        wanted.join(by_bits, (F.col("fail_bits").bitwiseAND(F.col("policy_mask")) != 0), "left")
        .groupBy("policy", "rule")
        .agg(
            total(hit != 0)("n_rejected"),
            total(F.col("fail_bits").bitwiseAND(F.col("rule_mask")) != 0)("n_failed"),
            total(hit == F.col("rule_mask"))("n_rejected_by_it_alone"),
        )
    )
