"""Registered queries of the filtering operators: quality rules, URL filters, line dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweir.llm import line_chunks, quality_rules, url_filters
from logweir.llm.common import table
from logweir.llm.registry import register


@register(
    "op8_quality_rules",
    sql=r"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    words AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM w),
    pos AS (SELECT r, generate_subscripts(ws, 1) AS p, ws FROM words WHERE len(ws) >= 3),
    tri AS (SELECT r, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS t FROM pos WHERE p <= len(ws) - 2),
    twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, t) AS n FROM tri) WHERE n > 1),
    rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY r),
    lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
    m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(list_aggregate(ws, 'string_agg', '')) AS BIGINT) AS chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(length(regexp_replace(text, '[^!?]+', '', 'g')) AS BIGINT) AS n_marks,
        CAST(length(regexp_replace(text, '\P{Lu}+', '', 'g')) AS BIGINT) AS n_capitals,
        CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
        FROM w JOIN words USING (r) JOIN lines USING (r) LEFT JOIN rep USING (r)),
    f AS (SELECT * EXCLUDE (chars), coalesce(chars, 0) AS word_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT (base_failed OR 10 * n_symbols > 3 * n_words OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines) OR 10 * n_marks > 5 * n_words
            OR 10 * n_capitals > 6 * word_chars OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept,
        CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
            + 8 * (n_lines >= 4 AND 2 * n_dup_lines > n_lines)::INT + 16 * (10 * n_marks > 5 * n_words)::INT
            + 32 * (10 * n_capitals > 6 * word_chars)::INT + 64 * (word_chars < 2 * n_words OR word_chars > 25 * n_words)::INT AS BIGINT) AS fail_bits
    FROM f""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality_rules.quality_ledger(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return ledger.select(
        "doc_id",
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
        (~quality_rules.passes("base-1")).alias("base_failed"),
        quality_rules.passes("full-1").alias("kept"),
        "fail_bits",
    )


HOST_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@register("op7_url_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled by the row of ``labels`` with its id: bad if of low quality or toxic."""
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), labels, HOST_RULES)


@register(
    "op6_line_chunks",
    sql=r"""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS line, len(ls) AS n
            FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
        h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM l),
        o AS (SELECT *, i > 0 AND i < n - 2 AND ((coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) * 31 + h) % 4294967296 * 40503 % 4294967296 >> 16) % 3 = 0 AS open FROM h),
        u AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, open ORDER BY i) AS run FROM o),
        e AS (SELECT *, open AND (i - min(i) OVER (PARTITION BY doc_id, open, run)) % 2 = 0 AS is_end FROM u),
        c AS (SELECT *, coalesce(sum(is_end::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM e),
        g AS (SELECT doc_id, chunk, min(i) AS start, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS body FROM c GROUP BY doc_id, chunk),
        r AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, start) AS place FROM g
            WHERE lines > 1 AND regexp_matches(body, '[^\x20\x09-\x0D]')),
        kept AS (SELECT g.doc_id, string_agg(g.body, chr(10) ORDER BY g.start) AS text FROM g LEFT JOIN r USING (doc_id, chunk)
            WHERE coalesce(r.place, 1) = 1 GROUP BY g.doc_id),
        gone AS (SELECT doc_id, CAST(sum(lines) AS BIGINT) AS lines, count(*) AS chunks FROM r WHERE place > 1 GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text,
        CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
        CAST(coalesce(gone.lines, 0) AS BIGINT) AS removed_lines, CAST(coalesce(gone.chunks, 0) AS BIGINT) AS removed_chunks
    FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_chunks.dedup_lines(docs).select("doc.doc_id", F.col("kept").alias("text"), "n_lines", "removed_lines", "removed_chunks")
