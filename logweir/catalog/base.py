"""Registry of queries with their SQL twins, and the shared SQL views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

K = "CAST(regexp_extract(props, '\"k\": (\\d+)', 1) AS INTEGER)"
FORMAT_RE = r"^(.*?)\s+(.*?)\s+(.*?)\s+(.*?)\s+(.*?):\s+(.*?)$"
HDFS_MASKED = (
    r"regexp_replace(regexp_replace(regexp_replace(content, '(blk_)[-\d]+', '\1<*>', 'g'),"
    r" '\d+\.\d+\.\d+\.\d+', '<*>', 'g'), '(/[-\w]+)+', '<*>', 'g')"
)
NUMBER_MASKED = rf"regexp_replace({HDFS_MASKED}, '\d+', '<*>', 'g')"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "e1": ((), f"""SELECT event_id AS line_id, epoch_us(ts) // 1000000 AS ts_sec, CAST(value > 200 AS INTEGER) AS label,
        event_type || CAST({K} // 25 AS VARCHAR) AS event, user_id FROM events"""),
    "e1u": (("e1",), "SELECT line_id, ts_sec - CASE WHEN line_id % 13 = 12 THEN 7200 ELSE 0 END AS ts_sec, label, event, user_id FROM e1"),
    "l1": ((), f"""SELECT i AS line_no, CASE WHEN i % 97 = 0 THEN 'corrupt line ' || i ELSE
        (CASE WHEN value > 200 THEN 'ERR' ELSE '-' END) || ' ' || (epoch_us(ts) // 1000000) || ' ' || strftime(ts, '%Y.%m.%d') || ' '
        || strftime(ts, '%H:%M:%S') || ' node' || (k % 8) || ': ' ||
        (CASE event_type
          WHEN 'click' THEN 'Receiving block blk_' || u || ' src: /10.0.0.' || k || ':' || (5000 + i % 1000) || ' dest: /10.0.1.' || k || ':50010'
          WHEN 'view' THEN 'Served block blk_' || u || ' to /10.0.0.' || k
          WHEN 'signup' THEN 'BLOCK* NameSystem.addStoredBlock: blockMap updated: 10.0.0.' || k || ':50010 is added to blk_' || u || ' size ' || (100 * k)
          WHEN 'purchase' THEN 'PacketResponder ' || (k % 3) || ' for block blk_' || u || ' terminating'
          ELSE 'Exception in receiveBlock for block blk_' || u || ' java.io.IOException: Connection reset by peer /data/dir' || (k % 5) || '/f' || k END)
        || (CASE WHEN i % 50 = 0 THEN ' mirror blk_' || (u + 1) ELSE '' END)
        || (CASE WHEN i % 60 = 0 THEN ' retry blk_' || u ELSE '' END) END AS line
        FROM (SELECT event_id AS i, user_id AS u, {K} AS k, event_type, value, ts FROM events)"""),
    "l1p": (("l1",), rf"""SELECT line_no, row_number() OVER (ORDER BY line_no) AS line_id,
        regexp_extract(line, '{FORMAT_RE}', 1) AS label, regexp_extract(line, '{FORMAT_RE}', 2) AS epoch,
        regexp_extract(line, '{FORMAT_RE}', 3) AS date_, regexp_extract(line, '{FORMAT_RE}', 4) AS time_,
        regexp_extract(line, '{FORMAT_RE}', 5) AS node, regexp_extract(line, '{FORMAT_RE}', 6) AS content
        FROM l1 WHERE regexp_matches(line, '{FORMAT_RE}')"""),
    "l1m": (("l1p",), f"SELECT *, {NUMBER_MASKED} AS template, {HDFS_MASKED} AS hdfs_template FROM l1p"),
    "l1k": (("l1m",), r"""SELECT DISTINCT session_id, line_no, line_id, template, label FROM
        (SELECT *, unnest(regexp_extract_all(content, '(blk_-?\d+)', 1)) AS session_id FROM l1m)"""),
    "s1": (("e1",), """SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY line_id) - 1 AS pos, line_id, event, ts_sec,
        max(line_label) OVER (PARTITION BY session_id) AS label, count(*) OVER (PARTITION BY session_id) AS n_events,
        min(line_id) OVER (PARTITION BY session_id) AS first_line
        FROM (SELECT line_id, ts_sec, label AS line_label, event,
              user_id || '_' || ((ts_sec - (SELECT min(ts_sec) FROM e1)) // 604800) AS session_id FROM e1)"""),
    "s1h": (("s1",), "SELECT session_id, label, n_events, first_line FROM s1 WHERE pos = 0"),
    "s1c": (("s1",), "SELECT session_id, event, count(*) AS n, max(label) AS label FROM s1 GROUP BY session_id, event"),
    "d1": ((), """SELECT doc_id, generate_subscripts(parts, 1) - 1 AS line_pos, unnest(parts) AS msg
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)"""),
    "d1t": (("d1",), r"""SELECT doc_id, line_pos, msg,
        list_filter(regexp_split_to_array(msg, '\s+'), lambda x: x <> '') AS toks FROM d1"""),
}


def oracle(views: str, body: str) -> str:
    """``body`` behind the named views and those they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in VIEWS[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for view in views.split():
        visit(view)
    heads = [f"{name} AS ({VIEWS[name][1]})" for name in ordered]
    body = body.strip()
    if body.upper().startswith("WITH "):
        heads.append(body[5:])
        return "WITH " + ",\n".join(heads)
    return ("WITH " + ",\n".join(heads) + "\n" if heads else "") + body


def register(name: str, views: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(views, sql)
        return fn

    return keep
