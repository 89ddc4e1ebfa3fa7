"""Queries over session logs and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions as s
from ..sources import adapters as a
from .base import query
from .text_queries import TOKENS

EVENTS = """ev AS (SELECT user_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ln, ts, event_type AS tool,
  CASE event_type WHEN 'signup' THEN 'boundary' WHEN 'view' THEN 'explore' WHEN 'click' THEN 'explore' WHEN 'purchase' THEN 'write' ELSE 'user' END AS kind,
  'f' || json_extract_string(props, '$.k') AS file, event_type || ' report ' || event_type AS text FROM events),
w AS (SELECT *, coalesce(sum((kind = 'boundary')::INT) OVER (PARTITION BY session_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS seq FROM ev)"""


@query(
    "window_segments",
    "F1 F2 F3 DM4 L7",
    f"""WITH {EVENTS} SELECT session_id, seq, min(ln) AS start_line, max(ln) AS end_line, min(ts) AS start_time, coalesce(max(ts) FILTER (kind = 'boundary'), max(ts)) AS end_time,
  CASE WHEN seq = 0 THEN 'session_start' ELSE 'compact' END AS boundary_type FROM w GROUP BY session_id, seq""",
)
def window_segments(spark, sf_dir):
    return s.windows(a.session_events(spark, sf_dir))


@query(
    "window_files_last_tool",
    "E20",
    f"""WITH {EVENTS} SELECT session_id, seq, file, arg_max(tool, ln) AS tool, min(ln) AS first_line FROM w WHERE kind IN ('explore', 'write') AND file IS NOT NULL GROUP BY ALL""",
)
def window_files_last_tool(spark, sf_dir):
    return s.window_files(a.session_events(spark, sf_dir))


@query(
    "decisions",
    "F4 E8",
    f"""WITH {EVENTS}, p AS (SELECT *, kind IN ('explore', 'write') AND file IS NOT NULL AS acts FROM w),
l AS (SELECT *, last_value(CASE WHEN acts THEN kind END IGNORE NULLS) OVER (PARTITION BY session_id, seq ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM p),
c AS (SELECT *, (acts AND kind = 'write' AND coalesce(prev = 'explore', false)) AS closes FROM l),
b AS (SELECT *, coalesce(sum(closes::INT) OVER (PARTITION BY session_id, seq ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS block FROM c),
t AS (SELECT session_id, seq, block, ln, unnest({TOKENS}) AS term, generate_subscripts({TOKENS}, 1) AS k FROM b WHERE kind = 'user'),
n AS (SELECT session_id, seq, block, term, count(*) AS n, min(ln * 1000 + k) AS p FROM t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, seq, block ORDER BY n DESC, p, term) AS rank FROM n),
s AS (SELECT session_id, seq, block, string_agg(term, ',' ORDER BY rank) AS terms FROM r WHERE rank <= 8 GROUP BY ALL),
g AS (SELECT session_id, seq, block, min(ln) AS start_line, max(ln) AS end_line, bool_or(closes) AS closed, string_agg(file, ',' ORDER BY ln) FILTER (acts AND kind = 'write') AS anchors FROM b GROUP BY ALL)
SELECT session_id, seq, block, start_line, end_line, coalesce(terms, '') AS terms, coalesce(anchors, '') AS anchors, CASE WHEN anchors IS NULL THEN 'parked' ELSE 'decided' END AS status
FROM g LEFT JOIN s USING (session_id, seq, block) WHERE closed OR terms IS NOT NULL""",
)
def decisions(spark, sf_dir):
    d = s.decisions(a.session_events(spark, sf_dir)).drop("summary")
    return d.withColumns({c: F.array_join(c, ",") for c in ("terms", "anchors")})


@query(
    "compact_transcript",
    "F5 K10 C17 I17",
    """WITH m AS (SELECT conv_id::VARCHAR AS session_id, turn AS ln, role AS side FROM conversations WHERE role IN ('user', 'assistant') AND length(trim(text)) > 0),
t AS (SELECT *, coalesce(sum((side = 'user')::INT) OVER (PARTITION BY session_id ORDER BY ln), 0)::INT AS turn_no FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn_no, side ORDER BY ln) AS k FROM t)
SELECT session_id, turn_no, coalesce(max(ln) FILTER (side = 'user'), -1) AS user_ln, coalesce(min(ln) FILTER (side = 'assistant' AND k = 1), -1) AS assistant_ln, count(*) FILTER (side = 'assistant' AND k > 1) AS more,
  coalesce(min(ln) FILTER (side = 'assistant' AND k > 1), -1) AS more_first, coalesce(max(ln) FILTER (side = 'assistant' AND k > 1), -1) AS more_last FROM k GROUP BY session_id, turn_no""",
)
def compact_transcript(spark, sf_dir):
    return s.compact_transcript(a.messages(spark, sf_dir)).fillna(-1)


@query(
    "merge_chunks",
    "E21",
    """SELECT conv_id::VARCHAR AS session_id, turn // 2 AS request, min(turn) AS first_ln, max(turn) AS ln, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text
FROM conversations WHERE role = 'assistant' GROUP BY ALL HAVING string_agg(text, '') <> ''""",
)
def merge_chunks(spark, sf_dir):
    m = a.messages(spark, sf_dir).where("side = 'assistant'").withColumn("request", F.floor(F.col("ln") / 2))
    return s.merge_chunks(m, "request")


SESSIONS = "se AS (SELECT user_id::VARCHAR AS session_id, min(ts) AS start_time, max(ts) AS end_time, count(*) AS n_lines FROM events GROUP BY ALL)"


@query("recent_sessions", "G1 G6 T7", f"WITH {SESSIONS} SELECT * FROM se ORDER BY start_time DESC, session_id LIMIT 10")
def recent_sessions(spark, sf_dir):
    return s.recent(s.sessions(a.session_events(spark, sf_dir)), 10)


@query(
    "recent_for_project",
    "F7 G2 G3 D10",
    """WITH se AS (SELECT user_id::VARCHAR AS session_id, event_type AS project, max(max(ts)) OVER (PARTITION BY user_id) AS end_time FROM events GROUP BY user_id, event_type)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY end_time DESC, session_id)::INT AS rank FROM se) WHERE rank <= 3""",
)
def recent_for_project(spark, sf_dir):
    rows = a.session_events(spark, sf_dir)
    found = rows.groupBy("session_id").agg(F.max("ts").alias("end_time"), F.collect_set("tool").alias("projects"))
    return s.recent_per_project(found).select("session_id", "project", "end_time", "rank")


@query(
    "project_context",
    "E9 E10 F6 F7",
    f"""WITH {EVENTS}, c AS (SELECT tool AS project, file, count(*) AS n, min(ts) AS seen FROM w GROUP BY ALL)
SELECT project, file, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, file)::INT AS rank FROM c) WHERE rank <= 8""",
)
def project_context(spark, sf_dir):
    from pyspark.sql import Window

    n = a.session_events(spark, sf_dir).groupBy(F.col("tool").alias("project"), "file").agg(F.count("*").alias("n"))
    order = Window.partitionBy("project").orderBy(F.desc("n"), "file")
    return n.withColumn("rank", F.row_number().over(order)).where("rank <= 8")


@query(
    "session_project_match",
    "D12",
    r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS file_path FROM pages), names AS (SELECT DISTINCT lang AS project FROM documents)
SELECT page_id, file_path, project, list_aggregate(string_split(file_path, '/')[k + 1:], 'string_agg', '/') AS relative
FROM (SELECT *, unnest(string_split(file_path, '/')) AS project, generate_subscripts(string_split(file_path, '/'), 1) AS k, len(string_split(file_path, '/')) AS n FROM p)
WHERE k > 1 AND k < n AND project IN (SELECT project FROM names)""",
)
def session_project_match(spark, sf_dir):
    paths = a.table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("file_path"))
    return s.touches(paths, a.table(spark, sf_dir, "documents").select(F.col("lang").alias("project")))


@query(
    "decision_slice",
    "K9 C7",
    f"""WITH {EVENTS}, o AS (SELECT *, ln - min(ln) OVER (PARTITION BY session_id, seq) + 1 AS pos FROM w) SELECT session_id, seq, ln, pos, tool FROM o WHERE pos BETWEEN 2 AND 4""",
)
def decision_slice(spark, sf_dir):
    return s.window_slice(a.session_events(spark, sf_dir), 2, 4).select("session_id", "seq", "ln", "pos", "tool")
