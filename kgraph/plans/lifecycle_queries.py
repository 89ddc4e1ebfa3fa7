"""Queries over stored state: incremental work, rules, findings, audits, policies, clusters, documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..extract import languages
from ..functions import text as x
from ..operators import graph as g
from ..operators import lifecycle as c
from ..operators import search as s
from ..sources import adapters as a
from .base import GRAPH, LABELS, query
from .text_queries import LINES


def _hashes(spark, sf_dir):
    """What was stored: every seventh file is unknown, every fifth has another hash; and three files that are gone."""
    now = a.files(spark, sf_dir).select("project", "file", F.sha2(F.col("content").cast("binary"), 256).alias("hash"), "doc_id")
    known = now.where("doc_id % 7 <> 0").withColumn("hash", F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.col("hash")))
    gone = spark.createDataFrame([("src0", f"en/-{k}", "x", -1) for k in (1, 2, 3)], "project string, file string, hash string, doc_id long")
    return now, known.unionByName(gone)


@query(
    "incremental_worklist",
    "L1 L2 L3 D21 O5",
    """SELECT source AS project, lang || '/' || doc_id AS file, CASE WHEN doc_id % 7 = 0 THEN 'new' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'same' END AS status FROM documents
UNION ALL SELECT 'src0', 'en/-' || k, 'missing' FROM (VALUES (1), (2), (3)) t(k)""",
)
def incremental_worklist(spark, sf_dir):
    return c.worklist(*_hashes(spark, sf_dir))


@query(
    "purge_cascade",
    "M5 N4 E13 C18",
    f"""WITH {GRAPH}, kept AS (SELECT id FROM nodes WHERE NOT (type = 'supplier' AND id % 3 = 0)) SELECT type, count(*) AS edges FROM edges WHERE source_id IN (SELECT id FROM kept) AND target_id IN (SELECT id FROM kept) GROUP BY ALL""",
)
def purge_cascade(spark, sf_dir):
    kept = a.graph_nodes(spark, sf_dir).where("NOT (type = 'supplier' AND id % 3 = 0)")
    return c.cascade(a.graph_edges(spark, sf_dir), kept, ["source_id", "target_id"]).groupBy("type").agg(F.count("*").alias("edges"))


@query(
    "label_staleness",
    "M6 L5",
    f"""WITH {LABELS}, l AS (SELECT l.id, node_id, CASE WHEN l.id % 4 = 0 THEN 'other' WHEN l.id % 4 <> 1 THEN sha256(content) END AS made_for, sha256(content) AS hash FROM node_labels l JOIN docs d ON d.id = l.node_id)
SELECT id, node_id, made_for IS NOT NULL AND made_for <> hash AS is_stale FROM l""",
)
def label_staleness(spark, sf_dir):
    nodes = a.files(spark, sf_dir).select(F.col("doc_id").alias("id"), F.sha2(F.col("content").cast("binary"), 256).alias("body_hash"))
    labels = a.labels(spark, sf_dir).join(nodes.select(F.col("id").alias("node_id"), "body_hash"), "node_id")
    made = F.when(F.col("id") % 4 == 0, F.lit("other")).when(F.col("id") % 4 != 1, F.col("body_hash"))
    return c.stale_labels(labels.withColumn("body_hash_at_label", made).drop("body_hash"), nodes).select("id", "node_id", "is_stale")


@query(
    "findings_merge",
    "D14 L9 M8 H5",
    """WITH o AS (SELECT source AS project, lang || '/' || doc_id AS source_file, doc_id FROM documents)
SELECT project, source_file, 'stale_pair' AS kind, CASE WHEN doc_id % 2 = 0 THEN 't' END AS test_file, CASE WHEN doc_id % 3 = 0 THEN 'aaa' ELSE 'bbb' END AS first_seen_sha,
  CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN 'aaa' ELSE 'bbb' END AS last_seen_sha, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 = 0 AND doc_id % 30 <> 0 THEN 2 ELSE 1 END::BIGINT AS seen_count,
  NULL::VARCHAR AS resolved_sha FROM o WHERE (doc_id % 3 = 0 OR doc_id % 5 = 0) AND doc_id % 30 <> 0
UNION ALL SELECT project, source_file, 'stale_pair', 't', 'aaa', 'aaa', 1, 'bbb' FROM o WHERE doc_id % 30 = 0
UNION ALL SELECT project, source_file, 'stale_pair', 't', 'bbb', 'bbb', 1, NULL FROM o WHERE doc_id % 30 = 0""",
)
def findings_merge(spark, sf_dir):
    base = a.files(spark, sf_dir).select(
        "project", F.col("file").alias("source_file"), F.lit("stale_pair").alias("kind"), F.when(F.col("doc_id") % 2 == 0, F.lit("t")).alias("test_file"), "doc_id"
    )
    old = base.where("doc_id % 3 = 0").selectExpr(
        "project", "source_file", "kind", "test_file", "'aaa' AS first_seen_sha", "'aaa' AS last_seen_sha", "1L AS seen_count", "CAST(NULL AS STRING) AS resolved_sha"
    )
    return c.merge_findings(old, base.where("doc_id % 5 = 0"), base.where("doc_id % 30 = 0"), "bbb")


@query(
    "stopword_state",
    "L8 G8",
    """WITH f AS (SELECT event_id AS ordinal, 't' || (user_id % 40) AS term, CASE event_type WHEN 'error' THEN 'relevant' ELSE 'noise' END AS kind FROM events WHERE event_type IN ('view', 'error') AND (event_type = 'view' OR user_id % 40 > 20)),
l AS (SELECT term, max(ordinal) FILTER (kind = 'relevant') AS lr, count(*) FILTER (kind = 'relevant') AS relevant_count FROM f GROUP BY term)
SELECT term, count(*) FILTER (kind = 'noise' AND (lr IS NULL OR ordinal > lr)) AS noise_count, any_value(relevant_count) AS relevant_count,
  count(*) FILTER (kind = 'noise' AND (lr IS NULL OR ordinal > lr)) >= 5 AND any_value(relevant_count) = 0 AS promoted FROM f JOIN l USING (term) GROUP BY term""",
)
def stopword_state(spark, sf_dir):
    e = a.table(spark, sf_dir, "events").where("event_type IN ('view', 'error') AND (event_type = 'view' OR user_id % 40 > 20)")
    f = e.select(F.concat(F.lit("T"), (F.col("user_id") % 40).cast("string")).alias("term"), F.col("event_id").alias("ordinal"), F.when(F.col("event_type") == "error", "relevant").otherwise("noise").alias("kind"))
    return c.stopword_state(f)


@query(
    "upsert_nodes",
    "M1 M4 M9",
    """SELECT user_id, event_type, arg_min(value, event_id) AS first_value, arg_max(props, event_id) FILTER (props IS NOT NULL AND event_id % 2 = 0) AS last_props, min(event_id) AS event_id FROM events GROUP BY ALL""",
)
def upsert_nodes(spark, sf_dir):
    e = a.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.col("value").alias("first_value"), F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("last_props"))
    return c.upsert(e, ["user_id", "event_type"], "event_id", ["last_props"])


@query("edge_type_first_wins", "M3 R6", "SELECT event_type, arg_min(user_id, event_id) AS user_id, arg_min(value, event_id) AS value FROM events GROUP BY ALL")
def edge_type_first_wins(spark, sf_dir):
    return c.first_wins(a.table(spark, sf_dir, "events").select("event_type", "event_id", "user_id", "value"), "event_type", "event_id")


def _signals(spark, sf_dir):
    t = a.table(spark, sf_dir, "part")
    return t.select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_size").alias("weight"), F.lit("+").alias("polarity"),
        F.col("p_name").alias("label"), F.col("p_brand").alias("description"), F.concat(F.lit("*/"), F.col("p_partkey").cast("string"), F.lit("?")).alias("file_pattern"),
        F.when(F.col("p_partkey") % 2 == 0, "passive").otherwise("pre_write").alias("trigger"), (F.col("p_partkey") % 11 == 0).alias("archived"),
        F.expr("TIMESTAMP '2025-01-01 00:00:00' + make_interval(0, 0, 0, p_size * 10)").alias("updated_at"),
    )


SIGNALS = """sg AS (SELECT p_partkey AS id, p_type AS type, p_size AS weight, p_name AS label, p_brand AS description, p_partkey % 2 = 0 AS passive, p_partkey % 11 = 0 AS archived,
  TIMESTAMP '2025-01-01' + to_days((p_size * 10)::INT) AS updated_at FROM part)"""


@query("signals_active", "C9 C10", f"WITH {SIGNALS} SELECT id, weight FROM sg WHERE NOT archived AND weight >= 30 AND passive")
def signals_active(spark, sf_dir):
    return c.active_signals(_signals(spark, sf_dir), "on_start", 30).select("id", "weight")


def _customer_paths(spark, sf_dir):
    return a.table(spark, sf_dir, "customer").select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("path"))


# a pattern is "*/<id>?": it matches a path that ends in "/<id>" and one more character
MATCHED = f"""WITH {SIGNALS}, paths AS (SELECT 'customer/' || c_custkey AS path FROM customer),
pairs AS (SELECT path, sg.*, suffix(left(path, length(path) - 1), '/' || id) AS matched, contains('*/' || id || '?', path) AS named FROM paths, sg)"""


@query("signals_for_paths", "C13 I24", f"{MATCHED} SELECT path, id FROM pairs WHERE matched OR named")
def signals_for_paths(spark, sf_dir):
    return c.signals_for(_signals(spark, sf_dir), _customer_paths(spark, sf_dir)).select("path", "id")


@query("project_signals", "C11 C13 I24", f"{MATCHED} SELECT path, id FROM pairs WHERE NOT archived AND (matched OR named)")
def project_signals(spark, sf_dir):
    return c.project_signals(_signals(spark, sf_dir), _customer_paths(spark, sf_dir)).select("path", "id")


@query("pre_write_signals", "C12 I24", f"{MATCHED} SELECT path, id FROM pairs WHERE NOT archived AND NOT passive AND matched")
def pre_write_signals(spark, sf_dir):
    return c.pre_write_signals(_signals(spark, sf_dir), _customer_paths(spark, sf_dir)).select("path", "id")


@query("stale_signals", "L12", f"WITH {SIGNALS} SELECT id, weight FROM sg WHERE NOT archived AND weight < 30 AND updated_at < TIMESTAMP '2026-01-01' - INTERVAL 180 DAYS")
def stale_signals(spark, sf_dir):
    return c.stale_signals(_signals(spark, sf_dir), "2026-01-01 00:00:00").select("id", "weight")


CLUSTERS = """pairs AS (SELECT a.s_suppkey AS u, b.s_suppkey AS v FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND a.s_nationkey = b.s_nationkey AND a.s_suppkey % 7 = b.s_suppkey % 7),
labels_ AS (SELECT s_suppkey AS id, min(s_suppkey) OVER (PARTITION BY s_nationkey, s_suppkey % 7) AS cluster, s_name, s_nationkey, s_acctbal FROM supplier)"""


@query("overlap_clusters", "H7 J8", f"WITH {CLUSTERS} SELECT id, cluster FROM labels_ WHERE id IN (SELECT u FROM pairs UNION SELECT v FROM pairs)")
def overlap_clusters(spark, sf_dir):
    t = a.table(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws("-", "s_nationkey", F.col("s_suppkey") % 7).alias("k"))
    chain = t.groupBy("k").agg(F.min("s_suppkey").alias("u"))
    return c.clusters(t.join(chain, "k").where("s_suppkey <> u").select("u", F.col("s_suppkey").alias("v")))


@query(
    "consolidate",
    "E19",
    """SELECT s_nationkey::BIGINT AS cluster, count(*) AS n, arg_max(s_name, (length(s_name), -s_suppkey)) AS label, max(s_acctbal) AS weight, arg_max(s_suppkey, (s_acctbal, -s_suppkey)) AS polarity,
  arg_max(s_name, (s_acctbal, -s_suppkey)) AS type, string_agg(s_name, ' | ' ORDER BY s_suppkey) AS description FROM supplier GROUP BY ALL""",
)
def consolidate(spark, sf_dir):
    t = a.table(spark, sf_dir, "supplier")
    signals = t.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), F.col("s_acctbal").alias("weight"), F.col("s_suppkey").alias("polarity"), F.col("s_name").alias("type"), F.col("s_name").alias("description"))
    return c.consolidate(signals, t.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("cluster")))


@query(
    "audit_all",
    "O1 O4 O5 O7 D7 D9 A17",
    f"""WITH {GRAPH}, ends AS (SELECT source_id AS id FROM edges UNION SELECT target_id FROM edges)
SELECT 'edge_types' AS "check", 'error' AS severity, 'unregistered edge type ' || t AS message, NULL::VARCHAR AS file, 0 AS line FROM (VALUES ('imports'), ('calls')) x(t) WHERE t <> 'imports'
UNION ALL SELECT 'orphans', 'warning', 'no edges: ' || name, file, coalesce(line, 0) FROM nodes WHERE id NOT IN (SELECT id FROM ends)
UNION ALL SELECT 'hashes', 'warning', 'content changed', lang || '/' || doc_id, 0 FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 = 0
UNION ALL SELECT 'hashes', 'warning', 'file gone', 'en/-' || k, 0 FROM (VALUES (1), (2), (3)) t(k)""",
)
def audit_all(spark, sf_dir):
    nodes, edges = a.graph_nodes(spark, sf_dir), a.graph_edges(spark, sf_dir)
    types = a.edge_types(spark).where("name <> 'calls'")
    return c.audit([c.audit_edge_types(edges.where("type <> 'queries_table'"), types), c.audit_orphans(nodes, edges), c.audit_hashes(*_hashes(spark, sf_dir))]).fillna(0, ["line"])


@query(
    "stale_doc_edges",
    "O3 D6",
    """SELECT 'documents' AS "check", 'error' AS severity, 'points to missing file en/' || doc_id AS message, 'en/' || doc_id AS file, 1 AS line FROM documents WHERE lang = 'en' AND doc_id % 9 = 0""",
)
def stale_doc_edges(spark, sf_dir):
    nodes = a.document_nodes(spark, sf_dir)
    edges = nodes.where("file LIKE 'en/%'").select(F.lit(0).alias("source_id"), F.col("id").alias("target_id"), F.lit("documentary").alias("category"))
    return c.audit_documents(edges, nodes, nodes.where("id % 9 <> 0").select("file"))


@query(
    "orphan_docs",
    "O6 D13",
    """SELECT 'sections' AS "check", 'warning' AS severity, 'describes unknown file x/' || doc_id AS message, 'docs.md' AS file, 7 AS line FROM documents WHERE doc_id % 10 = 0""",
)
def orphan_docs(spark, sf_dir):
    d = a.document_nodes(spark, sf_dir).select("id", "project", "file", "name", "type", "line")
    one = spark.createDataFrame([(-1, "docs", "docs.md", "Intro", "doc_section", 7)], d.schema)
    nodes = d.where("id % 10 <> 0").unionByName(d.where("id % 10 = 0").withColumns({"type": F.lit("stub"), "file": F.concat(F.lit("x/"), F.col("id").cast("string"))})).unionByName(one)
    edges = d.select(F.lit(-1).cast("long").alias("source_id"), F.col("id").alias("target_id"), F.lit("documentary").alias("category"))
    return c.audit_sections(nodes, edges)


@query(
    "policy_levels",
    "N1 N2 E17",
    f"""WITH {GRAPH}, r AS (SELECT target_file AS file, count(DISTINCT source_file) AS radius FROM file_edges WHERE follows GROUP BY ALL), f AS (SELECT file, radius, file LIKE 'supplier/%7' AS generated, file LIKE '%3' AS documented FROM r)
SELECT file, concat_ws(',', CASE WHEN radius >= 5 THEN 'high_blast_radius' END, CASE WHEN generated THEN 'generated_files' END, CASE WHEN documented THEN 'documented_files' END) AS categories,
  CASE WHEN generated THEN 'ask' WHEN radius >= 5 THEN 'warn' ELSE 'inform' END AS level FROM f WHERE radius >= 5 OR generated OR documented""",
)
def policy_levels(spark, sf_dir):
    hops = g.file_edges(a.graph_nodes(spark, sf_dir), a.graph_edges(spark, sf_dir), a.edge_types(spark))
    r = hops.groupBy(F.col("target_file").alias("file")).agg(F.countDistinct("source_file").alias("radius"))
    return c.policy(r.withColumns({"generated": F.col("file").like("supplier/%7"), "documented": F.col("file").like("%3")}))


@query(
    "exclusion_match",
    "C14 N3 I8",
    """SELECT lang || '/' || doc_id AS file, (lang = 'fr' AND doc_id % 10 <> 4) OR (doc_id BETWEEN 10 AND 19) OR lang = 'de' AND doc_id::VARCHAR LIKE '5%' AS excluded FROM documents""",
)
def exclusion_match(spark, sf_dir):
    rules = ["# comment", "fr/", "!fr/*4", "1?", "/de/5*", *x.BUILTIN_IGNORES]
    return a.files(spark, sf_dir).select("file", x.excluded(F.col("file"), rules).alias("excluded"))


@query(
    "test_pairs",
    "D15 D16 Q1",
    """SELECT lang || '/' || doc_id AS file, lang || '/' || coalesce(a, b) AS test_file FROM (SELECT lang, doc_id, (SELECT min(e.doc_id) FROM documents e WHERE e.lang = d.lang AND e.doc_id = d.doc_id + 1) AS a,
  (SELECT min(e.doc_id) FROM documents e WHERE e.lang = d.lang AND e.doc_id = d.doc_id + 2) AS b FROM documents d WHERE doc_id % 4 <> 0) WHERE coalesce(a, b) IS NOT NULL
UNION ALL SELECT lang || '/' || doc_id, 'named' FROM documents WHERE doc_id % 4 = 0""",
)
def test_pairs(spark, sf_dir):
    f = a.files(spark, sf_dir)
    name = lambda k: F.concat(F.element_at(F.split("file", "/"), 1), F.lit("/"), (F.col("doc_id") + k).cast("string"))
    return c.test_pairs(f.select("file", F.array(name(1), name(2)).alias("candidates")), f, f.where("doc_id % 4 = 0").select("file", F.lit("named").alias("test_file")))


@query(
    "stale_pairs_audit",
    "Q3",
    """SELECT 'o/' || a.o_orderkey AS file, 'o/' || b.o_orderkey AS test_file FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderdate > b.o_orderdate""",
)
def stale_pairs_audit(spark, sf_dir):
    o = a.table(spark, sf_dir, "orders")
    name = lambda k: F.concat(F.lit("o/"), (F.col("o_orderkey") + k).cast("string"))
    return c.outdated_pairs(o.select(name(0).alias("file"), name(1).alias("test_file")), o.select(name(0).alias("file"), F.col("o_orderdate").alias("updated_at")))


@query(
    "file_collisions",
    "D17 P3 P4 E18 F12",
    """WITH t AS (SELECT 'p' || l_partkey AS path, l_suppkey AS doc, l_linenumber * 10 AS first, l_linenumber * 10 + (l_suppkey % 12) AS last FROM lineitem),
pairs AS (SELECT DISTINCT a.path, a.doc AS u, b.doc AS v FROM t a JOIN t b ON a.path = b.path AND a.doc < b.doc), clash AS (SELECT DISTINCT path FROM pairs WHERE NOT v = u + 1),
o AS (SELECT *, coalesce(lag(last) OVER (PARTITION BY path ORDER BY first NULLS FIRST, last, doc) < first, true) AS apart FROM t WHERE path IN (SELECT path FROM clash))
SELECT path, count(DISTINCT doc) AS docs, CASE WHEN bool_and(apart) THEN 'soft' ELSE 'hard' END AS severity FROM o GROUP BY ALL""",
)
def file_collisions(spark, sf_dir):
    t = a.table(spark, sf_dir, "lineitem")
    first = F.col("l_linenumber") * 10
    touched = t.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"), F.col("l_suppkey").alias("doc"), first.alias("first"), (first + F.col("l_suppkey") % 12).alias("last"))
    docs = touched.select("doc").distinct()
    return c.overlaps(touched, docs.select("doc", (F.col("doc") + 1).alias("target")))


@query(
    "dangling_subscribes",
    "D18 P5",
    """SELECT 'n' || c_nationkey AS name, string_agg(DISTINCT 'd' || (c_custkey % 9), ',' ORDER BY 'd' || (c_custkey % 9)) AS docs FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0) GROUP BY ALL""",
)
def dangling_subscribes(spark, sf_dir):
    name = lambda col: F.concat(F.lit("n"), F.col(col).cast("string")).alias("name")
    waits = a.table(spark, sf_dir, "customer").select(name("c_nationkey"), F.concat(F.lit("d"), (F.col("c_custkey") % 9).cast("string")).alias("doc"))
    return c.dangling(waits, a.table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(name("s_nationkey")))


@query(
    "double_emits",
    "P6",
    """SELECT 'n' || c_nationkey AS name, c_mktsegment AS from_file, count(DISTINCT c_custkey % 3) AS n, string_agg(DISTINCT (c_custkey % 3)::VARCHAR, ',' ORDER BY (c_custkey % 3)::VARCHAR) AS docs FROM customer GROUP BY ALL HAVING count(DISTINCT c_custkey % 3) > 1""",
)
def double_emits(spark, sf_dir):
    t = a.table(spark, sf_dir, "customer")
    return c.double_emits(t.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("name"), F.col("c_mktsegment").alias("from_file"), (F.col("c_custkey") % 3).cast("string").alias("doc")))


@query(
    "dependency_order",
    "D19 P7",
    """WITH d AS (SELECT s_suppkey AS doc, ['draft', 'approved', 'implementing', 'implemented', 'archived'][1 + s_nationkey % 5] AS status, s_nationkey % 5 AS r FROM supplier),
p AS (SELECT doc, doc + 4 AS target, r FROM d) SELECT p.doc, p.target, CASE WHEN t.doc IS NULL THEN 'missing' ELSE 'behind' END AS issue, CASE WHEN t.doc IS NULL THEN 'warning' ELSE 'info' END AS severity
FROM p LEFT JOIN d t ON t.doc = p.target WHERE t.doc IS NULL OR t.r < p.r""",
)
def dependency_order(spark, sf_dir):
    states = F.array(*[F.lit(v) for v in c.STATES])
    docs = a.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"), F.get(states, F.col("s_nationkey") % 5).alias("status"))
    return c.dependency_issues(docs, docs.select("doc", (F.col("doc") + 4).alias("target")))


@query(
    "chunk_ranges",
    "F11 P8",
    f"""WITH {LINES}, m AS (SELECT *, regexp_matches(text, '^[TE]') AS h, regexp_matches(text, '^[AI]') AS e, max(line_no) OVER (PARTITION BY file) AS total FROM lines),
x AS (SELECT *, coalesce(lead(line_no) OVER (PARTITION BY file ORDER BY line_no) - 1, total)::INT AS end_line FROM m WHERE h OR e)
SELECT file, row_number() OVER (PARTITION BY file ORDER BY line_no)::INT AS n, line_no AS start_line, end_line, text FROM x WHERE h""",
)
def chunk_ranges(spark, sf_dir):
    return c.chunk_ranges(s.lines(a.files(spark, sf_dir)).drop("project"), "^[TE]", "^[AI]")


@query("schema_scout", "A9")
def schema_scout(spark, sf_dir):
    tables = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()
    rows = [(t, f.name, f.dataType.simpleString(), f.nullable, k) for t in tables for k, f in enumerate(a.table(spark, sf_dir, t).schema)]
    return spark.createDataFrame(rows, "table string, column string, type string, nullable boolean, ordinal int")


@query(
    "test_candidates",
    "B17 R4",
    """SELECT 'src/m' || n_nationkey || '.js' AS file, t || '/m' || n_nationkey || '.test.js' AS test_file FROM nation, (VALUES ('src'), ('src/__tests__'), ('test'), ('tests')) x(t)
UNION ALL SELECT 'src/m' || n_nationkey || '.js', t FROM nation, LATERAL (VALUES ('src/m' || n_nationkey || '.spec.js'), ('src/__tests__/m' || n_nationkey || '.spec.js'), ('test/src/m' || n_nationkey || '.js'), ('tests/src/m' || n_nationkey || '.js'),
  ('test/src-m' || n_nationkey || '.test.js'), ('tests/src-m' || n_nationkey || '.test.js')) x(t)""",
)
def test_candidates(spark, sf_dir):
    files = a.table(spark, sf_dir, "nation").select(F.concat(F.lit("src/m"), F.col("n_nationkey").cast("string"), F.lit(".js")).alias("file"))

    def work(batches):
        for batch in batches:
            yield batch.assign(test_file=[languages.test_candidates(f) for f in batch["file"]]).explode("test_file")

    return files.mapInPandas(work, "file string, test_file string").distinct()


@query(
    "stale_pairs",
    "Q2",
    """WITH p AS (SELECT 'o/' || o_orderkey AS file, 't/' || o_orderkey AS test_file, o_orderkey AS k FROM orders) SELECT file, test_file, 'stale_pair' AS kind FROM p WHERE k % 3 = 0 AND k % 2 = 0 AND k % 5 <> 0
UNION ALL SELECT file, '', 'missing_test' FROM p WHERE k % 3 = 0 AND k % 2 <> 0""",
)
def stale_pairs(spark, sf_dir):
    o = a.table(spark, sf_dir, "orders")
    name = lambda p: F.concat(F.lit(p), F.col("o_orderkey").cast("string"))
    pairs = o.where("o_orderkey % 2 = 0").select(name("o/").alias("file"), name("t/").alias("test_file"))
    changed = o.where("o_orderkey % 3 = 0").select(name("o/").alias("file")).unionByName(o.where("o_orderkey % 5 = 0").select(name("t/").alias("file")))
    # a test that changed is no source of a pair
    return c.stale_pairs(pairs, changed).where("file LIKE 'o/%'").fillna("", ["test_file"])


@query(
    "import_candidates",
    "J9 I7",
    """SELECT 'a/b/f' || n_nationkey || '.js' AS file, 'a/c/m' || n_nationkey || t AS candidate FROM nation, (VALUES (''), ('.js'), ('/index.js'), ('.ts'), ('.tsx'), ('/index.ts'), ('.py'), ('/__init__.py'), ('.svelte')) x(t)""",
)
def import_candidates(spark, sf_dir):
    k = F.col("n_nationkey").cast("string")
    n = a.table(spark, sf_dir, "nation").select(F.concat(F.lit("a/b/f"), k, F.lit(".js")).alias("file"), F.concat(F.lit("../c/./m"), k).alias("target"))
    return n.select("file", F.explode(x.import_candidates(F.col("file"), F.col("target"))).alias("candidate"))
