"""Column expressions on log text: masking, tokenising, template ids, parameters, timestamps."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from logweir.functions.binding import let

# The wildcard, the variable patterns per public log collection, and punctuation.
WILDCARD = "<*>"
NON_ASCII = "<NASCII>"
HDFS_MASKS = (r"(?<=blk_)[-\d]+", r"\d+\.\d+\.\d+\.\d+", r"(/[-\w]+)+")
BGL_MASKS = (r"(0x)[0-9a-fA-F]+", r"\d+.\d+.\d+.\d+", r"\d+")
BGL_MASKS_ESCAPED = (r"(0x)[0-9a-fA-F]+", r"\d+\.\d+\.\d+\.\d+", r"\d+")
THUNDERBIRD_MASKS = (
    r"(0x)[0-9a-fA-F]+",
    r"\d+\.\d+\.\d+\.\d+",
    r"(?<=Warning: we failed to resolve data source name )[\w\s]+",
    r"\d+",
)
HDFS_FORMAT = "<Date> <Time> <Pid> <Level> <Component>: <Content>"
BGL_FORMAT = "<Label> <Id> <Date> <Code1> <Time> <Code2> <Component1> <Component2> <Level> <Content>"
THUNDERBIRD_FORMAT = "<Label> <Id> <Date> <Admin> <Month> <Day> <Time> <AdminAddr> <Content>"
BLOCK_KEY = r"(blk_-?\d+)"
# ASCII punctuation without the wildcard's own characters; the backslash does not separate tokens.
PUNCTUATION_CLASS = r"[!\"#$%&'()+,\-./:;=?@\[\]^_`{|}~]"
STRIP_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0        "
    "        　"
)
# Number texts a scripting-language float() accepts.
FLOAT_TEXT = r"(?i)^\s*[+-]?((\d+(_\d+)*\.?|\d+(_\d+)*\.\d+(_\d+)*|\.\d+(_\d+)*)(e[+-]?\d+)?|inf(inity)?|nan)\s*$"
FIELD_MARK = "\x1f"


def format_fields(log_format: str) -> list[str]:
    return re.findall(r"<([^<>]+)>", log_format)


def format_pattern(log_format: str) -> str:
    """One whole-line Java pattern with a lazy positional group per field.

    Literal text between fields is part of the pattern as written, and a run of blanks stands for
    any run of white space.
    """
    out = []
    for literal, field in re.findall(r"([^<>]*)(?:<([^<>]+)>)?", log_format):
        out.append(re.sub(" +", r"\\s+", literal))
        if field:
            out.append("(.*?)")
    return r"(?sU)\A" + "".join(out) + r"\z"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def match_groups(text: Column, pattern: str, groups: int) -> Column:
    """The groups of a whole-text match as an array, NULL without a match, from one regex pass per row.

    Each group is written behind a mark; a text that holds the mark itself is read group by group.
    """
    marks = "".join(f"{FIELD_MARK}${i}" for i in range(1, groups + 1))

    def cut(t: Column) -> Column:
        by_group = F.when(t.rlike(pattern), F.array(*[F.regexp_extract(t, pattern, i) for i in range(1, groups + 1)]))
        one_pass = let(F.regexp_replace(t, pattern, marks), lambda m: F.when(F.startswith(m, F.lit(FIELD_MARK)), F.slice(F.split(m, FIELD_MARK), 2, groups)))
        return F.when(F.contains(t, F.lit(FIELD_MARK)), by_group).otherwise(one_pass)

    return let(text, cut)


def mask_variables(text: Column, patterns: Sequence[str]) -> Column:
    """Each pattern in order becomes the wildcard; classes like ``\\d`` and ``\\w`` cover all scripts."""
    for pattern in patterns:
        text = F.regexp_replace(text, f"(?sU){pattern}", WILDCARD)
    return text


def replace_non_ascii(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]+", NON_ASCII)


def tokenize_ws(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda t: t != "")


def tokenize_punct(text: Column) -> Column:
    return F.filter(F.split(text, PUNCTUATION_CLASS), lambda t: strip(t) != "")


def constant_tokens(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t != WILDCARD)


def has_number(token: Column) -> Column:
    return token.rlike(r"(?U)\d")


def template_id(template: Column) -> Column:
    return F.substring(F.md5(template), 1, 8)


def collapse_wildcards(template: Column, across_spaces: bool = False) -> Column:
    out = F.regexp_replace(template, r"(<\*>)+", WILDCARD)
    if across_spaces:
        out = F.regexp_replace(out, r"(<\*> )+<\*>", WILDCARD)
    return out


def placeholder_to_unk(template: Column, keep_after_block: bool = False) -> Column:
    pattern = r"(?<!blk_)<\*>" if keep_after_block else r"<\*>"
    return F.regexp_replace(template, pattern, "[UNK]")


def placeholder_count(template: Column) -> Column:
    return F.size(F.split(template, r"<\*>")) - 1


def extract_session_keys(text: Column, pattern: str = BLOCK_KEY) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def binarize_label(label: Column, normal: str = "-") -> Column:
    return (label != normal).cast("int")


def parse_log_time(text: Column, pattern: str) -> Column:
    """Wall-clock text to whole epoch seconds, independent of the session time zone."""
    stamp = F.to_timestamp_ntz(text, F.lit(pattern))
    return epoch_seconds(stamp)


def epoch_seconds(stamp_ntz: Column) -> Column:
    micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), stamp_ntz)
    return F.floor(micros / F.lit(1_000_000)).cast("bigint")


def is_float(token: Column) -> Column:
    return token.rlike(FLOAT_TEXT)


def is_int(token: Column) -> Column:
    value = F.regexp_replace(token, "_", "").try_cast("double")
    whole = F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))) & (value == F.floor(value)), F.lit(False))
    return is_float(token) & whole


def extract_params_regex(content: Column, template: Column, mask_blocks: bool = True, loose: bool = False) -> Column:
    """Text under each wildcard of ``template``, by an anchored pattern built per row.

    ``mask_blocks`` removes block digits first; ``loose`` lets any run of other characters stand
    for blanks and strips punctuation from the values.
    """
    near = r"\s<.{1,5}>\s" if loose else r"<.{1,5}>"
    blank = r"[^A-Za-z0-9]+" if loose else r"\\s+"
    marked = F.regexp_replace(template, near, WILDCARD)
    parts = F.transform(
        F.split(marked, r"<\*>"),
        lambda p: F.regexp_replace(
            F.regexp_replace(p, r"([^A-Za-z0-9 ])", r"\\$1"), " +" if loose else " ", blank
        ),
    )
    text = F.regexp_replace(content, r"blk_-?\d+", "blk_") if mask_blocks else content
    none = F.array().cast("array<string>")

    def values(row: Column) -> Column:
        arity = F.size(row["parts"]) - 1
        pattern = F.concat(F.lit("^"), F.array_join(row["parts"], "(.*?)"), F.lit(r"\z"))
        refs = F.array_join(F.transform(F.sequence(F.lit(1), arity), lambda i: F.concat(F.lit("$"), i.cast("string"))), FIELD_MARK)
        found = F.split(F.regexp_replace(row["text"], pattern, refs), FIELD_MARK)
        if loose:
            found = F.transform(found, lambda v: F.btrim(F.btrim(v, F.lit(STRIP_PUNCTUATION)), F.lit(" ")))
        return F.when(arity < 1, none).when(F.rlike(row["text"], pattern), found).otherwise(none)

    return let(F.struct(parts.alias("parts"), text.alias("text")), values)


def extract_params_literal(content: Column, template: Column) -> Column:
    """Text between the template's constants, located left to right; any miss gives an empty array."""
    bound = F.struct(content.alias("content"), F.split(template, r"<\*>").alias("parts"))
    return let(bound, lambda row: _between(row["content"], row["parts"]))


def _between(content: Column, parts: Column) -> Column:
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(1).alias("at"), F.lit(True).alias("ok"), none.alias("out"))
    last = F.size(parts) - 1

    def find(part: Column, at: Column) -> Column:
        return F.call_function("locate", part, content, at)

    def step(acc: Column, i: Column) -> Column:
        part = F.element_at(parts, i + 1)
        hit = F.when(part == "", acc["at"]).otherwise(find(part, acc["at"]))
        begin = F.when(hit == 0, 0).otherwise(hit + F.length(part))
        upcoming = F.when(i < last, F.element_at(parts, F.least(i + 2, last + 1)))
        end = F.when(upcoming.isNull(), begin).when(upcoming == "", F.length(content) + 1).otherwise(find(upcoming, begin))
        ok = acc["ok"] & (hit > 0) & (end > 0)
        value = F.call_function("substr", content, begin, end - begin)
        grown = F.when(i < last, F.concat(acc["out"], F.array(value))).otherwise(acc["out"])
        return F.struct(end.alias("at"), ok.alias("ok"), grown.alias("out"))

    walked = F.aggregate(F.sequence(F.lit(0), last), start, step)
    return F.when(last > 0, let(walked, lambda w: F.when(w["ok"], w["out"]).otherwise(none))).otherwise(none)
