"""Registered queries over the words of documents: ranked search, spelling variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweir.llm import lexical_search, spelling
from logweir.llm.common import table
from logweir.llm.registry import register


@register(
    "op11_term_tree_search",
    sql=r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
        q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
        s AS (SELECT count(*) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d WHERE len(ts) > 0),
        tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
        w AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY t, n),
        m AS (SELECT r, doc_id, 100 - 25 + ((25 * CAST(len(ts) AS BIGINT) * n) // l) AS m FROM d, s WHERE len(ts) > 0),
        x AS (SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
            FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (r) GROUP BY item_id, r),
        k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
            FROM x JOIN m USING (r) WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), most=20)


@register(
    "op12_edit_composition",
    sql=r"""WITH RECURSIVE runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
            FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
        tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
            FROM (SELECT unnest(range(256)) AS i)),
        bytes AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs WHERE length(run) >= 7),
        crc AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
            lambda c, b: xor(c >> 8, tab[CAST(1 + (xor(c, b) & 255) AS BIGINT)])), 4294967295) AS h FROM bytes, tab),
        w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM crc)
            WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
        p AS (SELECT x.word, y.word AS near, y.n AS k FROM cut x JOIN cut y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
            UNION SELECT c.word, w.word, w.n FROM cut c JOIN w ON c.rest = w.word UNION SELECT w.word, c.word, c.n FROM cut c JOIN w ON c.rest = w.word),
        best AS (SELECT word, count(*) AS n_near, max(k) AS k, arg_min(near, struct_pack(k := -k, near := near)) AS near FROM p GROUP BY word),
        f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN k >= 10 * n THEN near END AS form, CASE WHEN k >= 10 * n THEN k END AS form_n FROM w LEFT JOIN best USING (word)),
        r AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT r.word, r.next, f.form FROM r JOIN f ON f.word = r.next)
    SELECT f.word, f.form, r.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM f JOIN r ON r.word = f.word AND r.next IS NULL""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))
