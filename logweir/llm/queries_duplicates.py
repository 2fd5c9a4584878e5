"""Registered queries of the operators that find repeated content: near-duplicates, benchmark passages, long matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweir.llm import decontamination, long_matches, near_duplicates
from logweir.llm.common import table
from logweir.llm.registry import register

_SETS = r"""t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {k} THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - {k} + 2), lambda i: array_to_string(ws[i:i + {k} - 1], ' ')) END) AS g FROM t)"""


@register(
    "op9_bottom_k_near_duplicates",
    sql="WITH RECURSIVE "
    + _SETS.format(k=4)
    + """, n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
    r AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
    SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.b AS component_id, t.doc_id = m.b AS kept
    FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = t.doc_id""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


@register(
    "op2_benchmark_passages",
    sql=f"""WITH {_SETS.format(k=5)},
    {_SETS.format(k=5).replace("doc_id", "item_id").replace("FROM documents", "FROM benchmark").replace("t AS", "bt AS").replace("s AS", "bs AS").replace("FROM t)", "FROM bt)")},
    n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
    SELECT doc_id, item_id, CAST(n AS BIGINT) AS item_shingles, count(*) AS shared
    FROM s JOIN bs USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 80 * n""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=5, percent=80).drop("key")


@register("op3_run_index_matches")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_matches.without_long_matches(table(spark, sf_dir, "documents"), length=400).drop("kept")
