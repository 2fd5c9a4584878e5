"""SQL twins of the template miners and of the common subsequence: folds over ordered lists."""

from __future__ import annotations

CLUSTERS = "CAST([] AS STRUCT(id BIGINT, t VARCHAR[])[])"


def drain_sql(masked: str, depth: int, st: float) -> str:
    """Views up to ``mined`` (line_id, content, cluster, template): every leaf folds its lines in order; s.c are its clusters, s.a the lines' clusters.

    Valid where no level mixes tokens with and without digits under one parent and branches are not used up, as in l1.
    """
    empty = f"{{'c': {CLUSTERS}, 'a': CAST([] AS BIGINT[]), 'id': CAST(0 AS BIGINT), 't': CAST([] AS VARCHAR[])}}"
    return rf"""WITH m AS (SELECT line_no AS line_id, content, string_split({masked}, ' ') AS toks FROM l1m),
    h AS (SELECT line_id, toks, len(toks) AS n, list_transform(toks[1:{depth - 3}], lambda t: CASE WHEN regexp_matches(t, '\d') THEN '<*>' ELSE t END) AS head FROM m),
    leaves AS (SELECT list(line_id ORDER BY line_id) AS ids, list({{'c': {CLUSTERS}, 'a': CAST([] AS BIGINT[]), 'id': line_id, 't': toks}} ORDER BY line_id) AS steps
        FROM h WHERE n >= {depth - 2} GROUP BY n, head),
    folded AS (SELECT ids, list_reduce(list_prepend({empty}, steps),
        lambda s, x: list_transform([list_max(list_transform(s.c, lambda c, i: {{'same': len(list_filter(list_zip(c.t, x.t), lambda p: p[1] = p[2] AND p[1] <> '<*>')),
                'wild': len(list_filter(c.t, lambda w: w = '<*>')), 'late': -i}}))], lambda b: CASE WHEN b IS NOT NULL AND b.same >= {st} * len(x.t)
            THEN {{'c': list_transform(s.c, lambda c, i: CASE WHEN i = -b.late THEN {{'id': c.id, 't': list_transform(list_zip(c.t, x.t), lambda p: CASE WHEN p[1] = p[2] THEN p[1] ELSE '<*>' END)}} ELSE c END),
                'a': list_append(s.a, s.c[-b.late].id), 'id': x.id, 't': x.t}}
            ELSE {{'c': list_append(s.c, {{'id': x.id, 't': x.t}}), 'a': list_append(s.a, x.id), 'id': x.id, 't': x.t}} END)[1]) AS s FROM leaves),
    named AS (SELECT unnest(ids) AS line_id, unnest(s.a) AS cluster FROM folded),
    clusters AS (SELECT c.id AS cluster, array_to_string(c.t, ' ') AS template FROM (SELECT unnest(s.c) AS c FROM folded)),
    mined AS (SELECT line_id, content, CAST(coalesce(cluster, line_id) AS VARCHAR) AS cluster, coalesce(template, array_to_string(toks, ' ')) AS template
        FROM m LEFT JOIN named USING (line_id) LEFT JOIN clusters USING (cluster))"""


LINES = " SELECT line_id, cluster, template FROM mined"
DICTIONARY = r""", d AS (SELECT line_id, regexp_replace(template, '(<\*>)+', '<*>', 'g') AS event_template FROM mined)
    SELECT substr(md5(event_template), 1, 8) AS event_id, event_template, count(*) AS occurrences, min(line_id) AS first_line FROM d GROUP BY event_template"""
# s.at is where the search for the next part starts; x.p is a part between wildcards and x.u the one after it.
PARAMETERS = r""", d AS (SELECT line_id, content, regexp_replace(regexp_replace(template, '(<\*>)+', '<*>', 'g'), '(<\*> )+<\*>', '<*>', 'g') AS template FROM mined),
    p AS (SELECT line_id, content, template, string_split(template, '<*>') AS parts FROM d),
    w AS (SELECT line_id, template, len(parts) AS n, list_reduce(list_prepend({'at': CAST(1 AS BIGINT), 'ok': TRUE, 'out': CAST([] AS VARCHAR[]), 'p': '', 'u': CAST(NULL AS VARCHAR)},
        list_transform(parts, lambda p, i: {'at': CAST(0 AS BIGINT), 'ok': TRUE, 'out': CAST([] AS VARCHAR[]), 'p': p, 'u': parts[i + 1]})),
        lambda s, x: list_transform([CASE WHEN x.p = '' THEN s.at WHEN instr(substr(content, s.at), x.p) > 0 THEN instr(substr(content, s.at), x.p) + s.at - 1 ELSE 0 END], lambda hit:
          list_transform([CASE WHEN hit = 0 THEN 0 ELSE hit + length(x.p) END], lambda beg:
            list_transform([CASE WHEN x.u IS NULL THEN beg WHEN x.u = '' THEN length(content) + 1 WHEN instr(substr(content, beg), x.u) > 0 THEN instr(substr(content, beg), x.u) + beg - 1 ELSE 0 END], lambda fin:
              {'at': CAST(fin AS BIGINT), 'ok': s.ok AND hit > 0 AND fin > 0, 'out': CASE WHEN x.u IS NULL THEN s.out ELSE list_append(s.out, substr(content, beg, fin - beg)) END, 'p': x.p, 'u': x.u})[1])[1])[1]) AS s FROM p)
    SELECT line_id, substr(md5(template), 1, 8) AS event_id, template, CASE WHEN n > 1 AND s.ok THEN array_to_string(s.out, '|') ELSE '' END AS params FROM w"""


def lcs_rows(a: str, b: str) -> str:
    """The dynamic programme's table for two lists: row 1 is that of the empty list, entry j + 1 of a row that of the first j tokens of ``b``."""
    zeros = f"list_transform(range(len({b}) + 1), lambda z: CAST(0 AS BIGINT))"
    grown = f"list_transform({b}, lambda y, j: CASE WHEN y = x.t THEN s.r[-1][j] + 1 ELSE s.r[-1][j + 1] END)"
    return f"""list_reduce(list_prepend({{'r': [{zeros}], 't': ''}}, list_transform({a}, lambda t: {{'r': CAST([] AS BIGINT[][]), 't': t}})),
        lambda s, x: {{'r': list_append(s.r, list_transform([{grown}], lambda g: list_prepend(CAST(0 AS BIGINT), list_transform(g, lambda v, j: list_max(g[1:j]))))[1]), 't': x.t}}).r"""


# The walk back shortens a first, then b.
SUBSEQUENCES = f"""tab AS (SELECT doc_id, line_pos, a, b, {lcs_rows('a', 'b')} AS r FROM pairs),
    walked AS (SELECT doc_id, line_pos, b, list_reduce(list_prepend({{'i': len(a), 'j': len(b), 'o': CAST([] AS VARCHAR[])}},
        list_transform(range(len(a) + len(b)), lambda k: {{'i': CAST(0 AS BIGINT), 'j': CAST(0 AS BIGINT), 'o': CAST([] AS VARCHAR[])}})),
        lambda s, x: CASE WHEN s.i = 0 OR s.j = 0 THEN s
            WHEN r[s.i + 1][s.j + 1] = r[s.i][s.j + 1] THEN {{'i': s.i - 1, 'j': s.j, 'o': s.o}}
            WHEN r[s.i + 1][s.j + 1] = r[s.i + 1][s.j] THEN {{'i': s.i, 'j': s.j - 1, 'o': s.o}}
            ELSE {{'i': s.i - 1, 'j': s.j - 1, 'o': list_prepend(a[s.i], s.o)}} END).o AS common FROM tab)"""
TEMPLATES = """filled AS (SELECT doc_id, line_pos, b, common, list_reduce(list_prepend({'k': CAST(0 AS BIGINT), 'o': CAST([] AS VARCHAR[]), 't': ''},
        list_transform(b, lambda t: {'k': CAST(0 AS BIGINT), 'o': CAST([] AS VARCHAR[]), 't': t})),
        lambda s, x: CASE WHEN s.k = len(common) THEN s WHEN x.t = common[s.k + 1] THEN {'k': s.k + 1, 'o': list_append(s.o, x.t), 't': ''}
            ELSE {'k': s.k, 'o': list_append(s.o, '<*>'), 't': ''} END).o AS o FROM walked)
    SELECT doc_id, line_pos, array_to_string(CASE WHEN len(common) > 0 AND len(o) < len(b) THEN list_append(o, '<*>') ELSE o END, ' ') AS template FROM filled"""

MATCH_LCS = f"""WITH dict AS (SELECT template, row_number() OVER (ORDER BY count(*) DESC, template) - 1 AS template_no FROM l1m GROUP BY template),
    dt AS (SELECT template_no, string_split(template, ' ') AS b FROM dict), msg AS (SELECT DISTINCT hdfs_template, string_split(hdfs_template, ' ') AS a FROM l1m),
    c AS (SELECT hdfs_template, a, b, template_no FROM msg JOIN dt ON len(list_intersect(a, b)) >= 0.5 * len(a)),
    s AS (SELECT hdfs_template, template_no, len(a) AS n, len(b) AS size, list_max({lcs_rows('a', 'b')}[-1]) AS common FROM c),
    f AS (SELECT *, row_number() OVER (PARTITION BY hdfs_template ORDER BY common DESC, size, template_no) AS k FROM s)
    SELECT line_no, template_no, common FROM l1m LEFT JOIN (SELECT * FROM f WHERE k = 1 AND common >= 0.5 * n) USING (hdfs_template)"""
