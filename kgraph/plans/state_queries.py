"""Queries over stored state: signals and forces, test alerts, reconciliation, scan state, sessions by prefix."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..extract.tables import extract_files
from ..functions import text as x
from ..operators import search as s
from ..operators import state as st
from ..sources import adapters as a
from ..sources.files import session_rows
from .base import GRAPH, LABELS, query
from .text_queries import LINES


def _forces(spark, sf_dir):
    t = a.table(spark, sf_dir, "supplier")
    return t.select(
        F.col("s_suppkey").alias("id"), F.concat(F.lit("f"), (F.col("s_suppkey") % 40).cast("string")).alias("name"),
        F.lit("d").alias("description"), (F.col("s_suppkey") % 101).cast("int").alias("score"), (F.col("s_suppkey") % 7 == 0).alias("archived"),
    )


@query(
    "force_reinforcement",
    "L11",
    """WITH f AS (SELECT s_suppkey AS id, 'f' || (s_suppkey % 40) AS name, (s_suppkey % 101)::INT AS score, s_suppkey % 7 = 0 AS archived FROM supplier),
m AS (SELECT 'f' || (c_custkey % 60) AS name, count(*) AS n FROM customer WHERE c_custkey % 60 < 30 GROUP BY ALL), t AS (SELECT name, max(id) AS id FROM f WHERE NOT archived GROUP BY ALL)
SELECT f.id, f.name, CASE WHEN n IS NULL THEN score ELSE least(100, score + 5 * n) END::INT AS score, archived FROM f LEFT JOIN (SELECT t.id, n FROM t JOIN m USING (name)) g ON g.id = f.id""",
)
def force_reinforcement(spark, sf_dir):
    name = F.concat(F.lit("f"), (F.col("c_custkey") % 60).cast("string")).alias("name")
    return st.reinforce(_forces(spark, sf_dir), a.table(spark, sf_dir, "customer").where("c_custkey % 60 < 30").select(name)).drop("description")


def _signals(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in (*st.SIGNAL_TYPES, "unknown")])
    return a.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("long").alias("id"), F.get(kinds, (F.col("p_partkey") % 5).cast("int")).alias("type"), (F.col("p_size") * 3 - 10).cast("int").alias("weight"),
        F.when(F.col("p_partkey") % 3 == 0, "-").otherwise("+").alias("polarity"), F.col("p_name").alias("label"), F.col("p_type").alias("description"),
        (F.col("p_partkey") % 11 == 0).alias("archived"),
    )


SIGNALS = """sg AS (SELECT p_partkey::BIGINT AS id, (['amygdala', 'nucleus_accumbens', 'prefrontal', 'hippocampus', 'unknown'])[1 + p_partkey % 5] AS type, (p_size * 3 - 10)::INT AS weight,
  CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE '+' END AS polarity, p_name AS label, p_type AS description, p_partkey % 11 = 0 AS archived FROM part)"""


@query(
    "signal_writes",
    "M10 A14",
    f"""WITH {SIGNALS}, top AS (SELECT max(id) AS top FROM sg WHERE id % 2 = 0), n AS (SELECT * FROM sg WHERE id % 2 = 1 AND type <> 'unknown' AND weight BETWEEN 0 AND 100),
e AS (SELECT * FROM sg WHERE id % 2 = 0 UNION ALL SELECT top + row_number() OVER (ORDER BY label, type, weight), type, weight, polarity, label, description, archived FROM n, top)
SELECT id, type, CASE WHEN id % 10 = 0 AND NOT archived THEN least(100, greatest(0, id % 300)) ELSE weight END::INT AS weight, archived OR id % 9 = 0 AS archived FROM e""",
)
def signal_writes(spark, sf_dir):
    """Odd parts are added to even ones; every tenth gets a weight, every ninth goes to the archive."""
    signals = _signals(spark, sf_dir)
    now = st.add_signals(signals.where("id % 2 = 0"), signals.where("id % 2 = 1").drop("id"))
    weights = now.where("id % 10 = 0").select("id", (F.col("id") % 300).alias("weight"), F.lit(1).alias("ordinal"))
    return st.archive(st.reweigh(now, weights), now.where("id % 9 = 0")).select("id", "type", "weight", "archived")


@query(
    "signal_review",
    "E14",
    f"""WITH {SIGNALS}, w AS (SELECT type, len(list_filter(regexp_split_to_array(label, '\\s+'), lambda t: t <> '')) + len(list_filter(regexp_split_to_array(description, '\\s+'), lambda t: t <> '')) AS words FROM sg WHERE NOT archived)
SELECT type, count(*) AS n, sum(ceil(words * 1.3))::BIGINT AS tokens FROM w GROUP BY ALL""",
)
def signal_review(spark, sf_dir):
    return st.signal_review(_signals(spark, sf_dir))


@query(
    "migrated_signals",
    "A16",
    """SELECT CASE WHEN p_partkey % 2 = 0 THEN 'nucleus_accumbens' ELSE 'amygdala' END AS type, coalesce(CASE WHEN p_size > 5 THEN p_size END, 50)::INT AS weight, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS polarity,
  CASE WHEN p_partkey % 4 < 2 THEN p_name WHEN p_partkey % 4 = 2 THEN p_brand ELSE 'Migrated signal' END AS label, CASE WHEN p_partkey % 5 < 3 THEN p_type END AS description, 'passive' AS trigger FROM part WHERE p_partkey % 7 <> 0""",
)
def migrated_signals(spark, sf_dir):
    k = F.col("p_partkey")
    return st.migrated_signals(
        a.table(spark, sf_dir, "part").select(
            F.when(k % 2 == 0, "positive").otherwise("negative").alias("polarity"), F.when(F.col("p_size") > 5, F.col("p_size")).alias("initial_weight"),
            F.when(k % 4 < 2, F.col("p_name")).alias("title"), F.when(k % 4 == 2, F.col("p_brand")).otherwise("").alias("summary"),
            F.when(k % 5 == 0, F.col("p_type")).alias("entry_text"), F.when(k % 5 < 3, F.col("p_type")).alias("correction_text"), F.when(k % 7 == 0, "archived").otherwise("active").alias("status"),
        )
    )


@query("seed_signals", "A15", f"WITH {SIGNALS} SELECT id, type FROM sg WHERE id % 4 = 0")
def seed_signals(spark, sf_dir):
    """Into empty tables; a second time nothing is taken."""
    signals, forces = _signals(spark, sf_dir), _forces(spark, sf_dir)
    seeds = signals.where("id % 4 = 0")
    first, scores, _ = st.seeded(signals.where("false"), forces.where("false"), seeds, forces)
    return st.seeded(first, scores, signals, forces)[0].select("id", "type")


def _findings(spark, sf_dir):
    o = a.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.col("o_orderpriority").alias("project"), F.concat(F.lit("o/"), k.cast("string")).alias("source_file"), F.when(k % 2 == 0, "stale_pair").otherwise("missing_test").alias("kind"),
        F.when(k % 2 == 0, F.concat(F.lit("t/"), k.cast("string"))).alias("test_file"), F.lit("abcdef0123456789").alias("first_seen_sha"), (k % 5).alias("seen_count"),
        F.when(k % 3 == 0, "bbb").when(k % 7 == 0, "aaa").alias("resolved_sha"), k.alias("k"),
    )


FINDINGS = """fi AS (SELECT o_orderpriority AS project, 'o/' || o_orderkey AS source_file, CASE WHEN o_orderkey % 2 = 0 THEN 'stale_pair' ELSE 'missing_test' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 't/' || o_orderkey END AS test_file,
  o_orderkey % 5 AS seen_count, CASE WHEN o_orderkey % 3 = 0 THEN 'bbb' WHEN o_orderkey % 7 = 0 THEN 'aaa' END AS resolved_sha, o_orderkey AS k FROM orders)"""


@query("finding_counts", "E16", f"WITH {FINDINGS} SELECT project, count(*) FILTER (resolved_sha IS NULL) AS open, count(*) FILTER (resolved_sha = 'bbb') AS resolved FROM fi GROUP BY ALL")
def finding_counts(spark, sf_dir):
    return st.finding_counts(_findings(spark, sf_dir), "bbb")


@query(
    "resolved_findings",
    "Q4 L10",
    f"""WITH {FINDINGS} SELECT source_file, kind FROM fi WHERE resolved_sha IS NULL AND (k % 11 = 0 OR kind = 'stale_pair' AND k % 13 = 0 OR kind = 'missing_test' AND k % 5 = 0)""",
)
def resolved_findings(spark, sf_dir):
    f = _findings(spark, sf_dir)
    open_ = f.where("resolved_sha IS NULL")
    name = lambda p: F.concat(F.lit(p), F.col("k").cast("string"))
    pairs = f.where("k % 5 = 0").select(F.col("source_file").alias("file"), name("t/").alias("test_file"))
    return st.resolved_findings(open_, f.where("k % 11 = 0").select(name("o/").alias("file")), f.where("k % 13 = 0").select(name("t/").alias("file")), pairs).select("source_file", "kind")


@query("audited_findings", "Q4 L10", f"WITH {FINDINGS} SELECT source_file, kind FROM fi WHERE resolved_sha IS NULL AND (k % 4 = 0 OR k % 9 = 0)")
def audited_findings(spark, sf_dir):
    f = _findings(spark, sf_dir)
    there = f.where("k % 9 <> 0").select(F.col("source_file").alias("file"))
    return st.audited_findings(f.where("resolved_sha IS NULL"), f.where("k % 4 <> 0"), there).select("source_file", "kind")


@query(
    "alert_report",
    "Q6 I20",
    f"""WITH {FINDINGS} SELECT project, CASE WHEN resolved_sha = 'bbb' THEN 'resolved' WHEN kind = 'stale_pair' THEN 'stale' ELSE 'missing' END AS section,
  source_file || coalesce(' -> ' || test_file, '') || ' since abcdef0' AS line FROM fi WHERE resolved_sha IS NULL OR resolved_sha = 'bbb'""",
)
def alert_report(spark, sf_dir):
    return st.alert_report(_findings(spark, sf_dir), "bbb")


@query(
    "alert_snapshot",
    "Q7 Q5",
    f"""WITH {FINDINGS}, o AS (SELECT project, string_agg('{{"source_file":"' || source_file || '","kind":"' || kind || '","test_file":"' || coalesce(test_file, '') || '","seen_count":' || seen_count || '}}', ',' ORDER BY source_file, kind) AS j, count(*) AS n FROM fi WHERE resolved_sha IS NULL GROUP BY ALL),
r AS (SELECT project, count(*) FILTER (resolved_sha = 'bbb') AS resolved_count FROM fi GROUP BY ALL)
SELECT project, 'bbb' AS sha, 'audit' AS mode, '[' || coalesce(j, '') || ']' AS findings_json, coalesce(n, 0) AS open_count, resolved_count FROM r LEFT JOIN o USING (project)""",
)
def alert_snapshot(spark, sf_dir):
    f = _findings(spark, sf_dir)
    return st.alert_snapshot(st.baseline(f, "aaa"), "bbb", "audit").unionByName(st.alert_snapshot(st.baseline(f, None), "bbb", "audit"))


def _reconcile(spark, sf_dir):
    now = a.files(spark, sf_dir).select("project", "file", F.sha2(F.col("content").cast("binary"), 256).alias("hash"), "doc_id")
    known = now.where("doc_id % 7 <> 0").withColumn("hash", F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.col("hash")))
    states = now.select("project").distinct().select(
        "project", F.when(F.col("project") != "src1", F.concat(F.lit("/w/"), "project")).alias("root_path"), (F.col("project") != "src2").alias("root_exists"), F.lit("aaa").alias("last_scan_sha")
    )
    return states, st.reconcile(states, now.where("doc_id % 11 <> 0"), known, x.excluded(F.col("file"), ["de/"]))


RECONCILE = """ac AS (SELECT source AS project, lang || '/' || doc_id AS file, doc_id % 7 <> 0 AS known, doc_id % 11 <> 0 AS there, doc_id % 5 = 0 AS other, lang = 'de' AS gone FROM documents WHERE source NOT IN ('src1', 'src2')),
ax AS (SELECT project, file, CASE WHEN known AND (NOT there OR gone) THEN 'purge' WHEN there AND NOT gone AND (NOT known OR other) THEN 'extract' END AS action FROM ac)"""


@query("reconcile_files", "L4 L5", f"WITH {RECONCILE} SELECT project, file, action FROM ax WHERE action IS NOT NULL")
def reconcile_files(spark, sf_dir):
    return _reconcile(spark, sf_dir)[1]


@query(
    "reconcile_projects",
    "L4 M7",
    f"""WITH {RECONCILE}, n AS (SELECT project, count(*) FILTER (action = 'purge') AS purged, count(*) FILTER (action = 'extract') AS reextracted FROM ax GROUP BY ALL), p AS (SELECT DISTINCT source AS project FROM documents)
SELECT project, CASE WHEN project = 'src1' THEN 'no_root' WHEN project = 'src2' THEN 'root_missing' WHEN coalesce(reextracted, 0) = 0 THEN 'skipped' ELSE 'done' END AS status, coalesce(purged, 0) AS purged, coalesce(reextracted, 0) AS reextracted,
  CASE WHEN coalesce(reextracted, 0) > 0 THEN 'bbb' ELSE 'aaa' END AS last_scan_sha FROM p LEFT JOIN n USING (project)""",
)
def reconcile_projects(spark, sf_dir):
    states, actions = _reconcile(spark, sf_dir)
    return st.reconciled_states(states, actions, states.select("project", F.lit("bbb").alias("sha")))


@query(
    "scan_stats",
    "E22",
    f"""WITH {GRAPH}, {LABELS} SELECT (SELECT count(*) FROM documents WHERE lang <> 'de') AS scanned, (SELECT count(*) FROM documents WHERE lang = 'de') AS skipped, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges,
  (SELECT count(*) FROM node_labels) AS labels, (SELECT count(DISTINCT detector_id) FROM node_labels) AS detectors""",
)
def scan_stats(spark, sf_dir):
    files = a.files(spark, sf_dir).select(F.col("file").startswith("de/").alias("skipped"))
    return st.scan_stats(files, a.graph_nodes(spark, sf_dir), a.graph_edges(spark, sf_dir), a.labels(spark, sf_dir))


@query(
    "body_hash_update",
    "M12",
    """SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN sha256(text) ELSE 'old' END AS body_hash FROM documents""",
)
def body_hash_update(spark, sf_dir):
    nodes = a.document_nodes(spark, sf_dir).withColumn("body_hash", F.lit("old"))
    new = a.files(spark, sf_dir).where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.sha2(F.col("content").cast("binary"), 256).alias("body_hash"))
    return st.with_body_hashes(nodes, new).select("id", "body_hash")


@query(
    "window_prefix_lookup",
    "C8",
    """WITH w AS (SELECT DISTINCT user_id::VARCHAR AS session_id, (event_id % 4)::INT AS seq FROM events), q AS (SELECT DISTINCT s_suppkey::VARCHAR AS query, (s_suppkey % 5)::INT AS seq FROM supplier),
e AS (SELECT q.query, q.seq, w.session_id FROM q JOIN w ON w.session_id = q.query AND w.seq = q.seq)
SELECT * FROM e UNION ALL SELECT q.query, q.seq, min(w.session_id) FROM q JOIN w ON starts_with(w.session_id, q.query) AND w.seq = q.seq WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.query = q.query AND e.seq = q.seq) GROUP BY ALL""",
)
def window_prefix_lookup(spark, sf_dir):
    windows = a.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), (F.col("event_id") % 4).cast("int").alias("seq"))
    asked = a.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("query"), (F.col("s_suppkey") % 5).cast("int").alias("seq")).distinct()
    return st.find_window(windows, asked)


@query("oriented_once", "L13", "SELECT user_id::VARCHAR AS session_id, event_type AS project, min(ts) AS at FROM events GROUP BY ALL")
def oriented_once(spark, sf_dir):
    return st.oriented(a.session_events(spark, sf_dir).select("session_id", F.col("tool").alias("project"), F.col("ts").alias("at")))


@query(
    "path_projects",
    "N5",
    """WITH p AS (SELECT 'w/' || c_nationkey || '/src/' || c_custkey AS path, c_nationkey AS n, c_custkey AS k FROM customer) SELECT path, CASE WHEN n % 3 = 0 THEN 'inner' || n ELSE 'outer' || n END AS project FROM p WHERE n % 5 <> 4 OR n % 3 = 0""",
)
def path_projects(spark, sf_dir):
    paths = a.table(spark, sf_dir, "customer").select(F.concat(F.lit("w/"), F.col("c_nationkey").cast("string"), F.lit("/src/"), F.col("c_custkey").cast("string")).alias("path"))
    n, k = a.table(spark, sf_dir, "nation"), F.col("n_nationkey").cast("string")
    outer = n.where("n_nationkey % 5 <> 4").select(F.concat(F.lit("outer"), k).alias("project"), F.concat(F.lit("w/"), k).alias("root_path"))
    inner = n.where("n_nationkey % 3 = 0").select(F.concat(F.lit("inner"), k).alias("project"), F.concat(F.lit("w/"), k, F.lit("/src")).alias("root_path"))
    return st.project_of(paths, outer.unionByName(inner))


@query(
    "grep_totals",
    "E12",
    rf"""WITH {LINES}, h AS (SELECT project, file, row_number() OVER (PARTITION BY project, file ORDER BY line_no) AS n FROM lines WHERE regexp_matches(text, 'token|[Ii]ng the ')) SELECT project, count(*) AS matches, count(DISTINCT file) AS files FROM h WHERE n <= 20 GROUP BY ALL""",
)
def grep_totals(spark, sf_dir):
    return st.grep_totals(s.grep(s.lines(a.files(spark, sf_dir)), "token|[Ii]ng the "))


@query(
    "time_and_path_forms",
    "I13 I19 I25",
    """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%b ') || day(ts) AS month_day, strftime(ts, '%H:%M') AS clock, '-u-' || user_id || '-x' AS folder, (user_id % 50)::INT AS first_line, (user_id % 50 + event_id % 3)::INT AS last_line FROM events""",
)
def time_and_path_forms(spark, sf_dir):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    line = F.concat(F.lit("L"), (F.col("user_id") % 50).cast("string"), F.lit("-L"), (F.col("user_id") % 50 + F.col("event_id") % 3).cast("string"))
    first, last = x.line_range(line)
    cwd = F.concat(F.lit("/u/"), F.col("user_id").cast("string"), F.lit("/x"))
    return a.table(spark, sf_dir, "events").select(
        "event_id", x.date_prefix(text).alias("day"), x.month_day(F.col("ts")).alias("month_day"), x.clock(text).alias("clock"), x.folder_name(cwd).alias("folder"), first.alias("first_line"), last.alias("last_line")
    )


@query(
    "extracted_scripts",
    "B1 B2 B6 B10 B13 R1 R2 R3",
    """SELECT 'f' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '.js' ELSE '.ts' END AS file, k AS kind, CASE k WHEN 'module' THEN 'f' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '.js' ELSE '.ts' END WHEN 'function' THEN n_name ELSE 'POST /' || n_name END AS name, l AS line
  FROM nation, (VALUES ('module', 1), ('function', 2), ('route', 5)) t(k, l) UNION ALL SELECT 'f' || n_nationkey || '.js', 'express-middleware', n_name, 2 FROM nation WHERE n_nationkey % 2 = 0""",
)
def extracted_scripts(spark, sf_dir):
    """A script made from each nation; its nodes, and the labels of its function."""
    n = a.table(spark, sf_dir, "nation")
    content = F.concat(F.lit("const fs = require('./fs');\nfunction "), "n_name", F.lit("(req, res, next) {\n  next();\n}\nrouter.post('/"), "n_name", F.lit("', handler);\n"))
    end = F.when(F.col("n_nationkey") % 2 == 0, ".js").otherwise(".ts")
    files = n.select(F.lit("p").alias("project"), F.concat(F.lit("f"), F.col("n_nationkey").cast("string"), end).alias("file"), content.alias("content"))
    return extract_files(files).where("kind IN ('node', 'label')").select("file", F.col("type").alias("kind"), "name", "line")


@query(
    "extracted_markdown",
    "B4 F13",
    """SELECT 'd' || n_nationkey || '.md' AS file, k AS kind, CASE k WHEN 'doc_section' THEN n_name ELSE n_name END AS source, CASE k WHEN 'references' THEN 'src/' || n_name || '.js' ELSE '/' || lower(n_name) || '-go' END AS target
  FROM nation, (VALUES ('references'), ('triggers')) t(k)""",
)
def extracted_markdown(spark, sf_dir):
    """A document made from each nation, whose section names a file and a command."""
    n = a.table(spark, sf_dir, "nation").withColumn("n_name", F.col("n_name"))
    content = F.concat(F.lit("intro\n## "), "n_name", F.lit("\nSee `src/"), "n_name", F.lit(".js` and\nrun `/"), F.lower(F.regexp_replace("n_name", "_", "_")), F.lit("-go`.\n"))
    files = n.select(F.lit("p").alias("project"), F.concat(F.lit("d"), F.col("n_nationkey").cast("string"), F.lit(".md")).alias("file"), content.alias("content"))
    return extract_files(files).where("kind = 'edge'").select("file", F.col("type").alias("kind"), F.col("name").alias("source"), "target")


@query(
    "session_log_rows",
    "A7 B14 B15 I21",
    """SELECT 's' || user_id AS session_id, event_id AS ln, CASE event_type WHEN 'view' THEN 'explore' WHEN 'purchase' THEN 'write' ELSE 'tool' END AS kind, 'f' || event_id AS file, '' AS text FROM events WHERE event_id % 3 = 0
UNION ALL SELECT 's' || user_id, event_id, 'assistant', '', 'said ' || event_id FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 's' || user_id, event_id, 'user', '', 'asked ' || event_id FROM events WHERE event_id % 3 = 1""",
)
def session_log_rows(spark, sf_dir):
    """Events as lines of JSON logs: messages with text and tools, plain questions, and every third line malformed."""
    e = a.table(spark, sf_dir, "events")
    number = F.col("event_id").cast("string")
    tool = F.when(F.col("event_type") == "view", "Read").when(F.col("event_type") == "purchase", "Edit").otherwise("Other")
    blocks = F.concat(F.lit('[{"type":"text","text":"said '), number, F.lit('"},{"type":"tool_use","name":"'), tool, F.lit('","input":{"file_path":"f'), number, F.lit('"}}]'))
    session = F.concat(F.lit('"session_id":"s'), F.col("user_id").cast("string"), F.lit('"'))
    line = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"type":"assistant",'), session, F.lit(',"message":{"role":"assistant","content":'), blocks, F.lit("}}")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"type":"user",'), session, F.lit(',"message":{"role":"user","content":"asked '), number, F.lit('"}}')))
        .otherwise(F.lit('{"type": broken'))
    )
    lines = e.select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("file"), F.col("event_id").cast("long").alias("ln"), line.alias("line"))
    return session_rows(lines).select("session_id", "ln", "kind", "file", "text").fillna("", ["file", "text"])


