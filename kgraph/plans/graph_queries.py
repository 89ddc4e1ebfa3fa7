"""Queries over the relational graph and over labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..sources import adapters as a
from .base import BEST, GRAPH, LABELS, query


def _graph(spark, sf_dir):
    return a.graph_nodes(spark, sf_dir), a.graph_edges(spark, sf_dir)


def _blast(roots: str) -> str:
    return f"""WITH {GRAPH}, roots AS (SELECT project AS rp, file AS root FROM nodes WHERE {roots}),
hop1 AS (SELECT DISTINCT rp, root, source_file AS file, source_project AS project FROM roots JOIN file_edges ON target_project = rp AND target_file = root WHERE follows AND source_file <> root),
hop2 AS (SELECT DISTINCT rp, root, e.source_file AS file, e.source_project AS project FROM hop1 JOIN file_edges e ON e.target_project = rp AND e.target_file = hop1.file WHERE follows AND e.source_file <> root),
hop3 AS (SELECT DISTINCT rp, root, e.source_file AS file, e.source_project AS project FROM hop2 JOIN file_edges e ON e.target_project = rp AND e.target_file = hop2.file WHERE follows AND e.source_file <> root)
SELECT rp AS root_project, root, file, min(project) AS project, min(depth)::INT AS depth FROM (
  SELECT *, 1 AS depth FROM hop1 UNION ALL SELECT *, 2 FROM hop2 UNION ALL SELECT *, 3 FROM hop3) GROUP BY ALL"""


@query("blast_radius_3hop", "J1 D1", _blast("file = 'region/0'"))
def blast_radius_3hop(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    hops = g.file_edges(nodes, edges, a.edge_types(spark))
    return g.blast_radius(nodes.where("file = 'region/0'"), hops).select("root_project", "root", "file", "project", "depth")


@query("blast_radius_all_roots", "J1 D1", _blast("true"))
def blast_radius_all_roots(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return g.blast_radius(nodes, g.file_edges(nodes, edges, a.edge_types(spark), once=False)).select("root_project", "root", "file", "project", "depth")


@query(
    "direct_dependents",
    "J2",
    f"""WITH {GRAPH}, pairs AS (SELECT DISTINCT target_project, target_file, source_project, source_file FROM file_edges
  WHERE NOT (target_project = source_project AND target_file = source_file)),
o AS (SELECT source_project AS project, source_file AS file, count(*) AS imports FROM pairs GROUP BY ALL),
i AS (SELECT target_project AS project, target_file AS file, count(*) AS imported_by FROM pairs GROUP BY ALL)
SELECT project, file, coalesce(imports, 0) AS imports, coalesce(imported_by, 0) AS imported_by FROM o FULL JOIN i USING (project, file)""",
)
def direct_dependents(spark, sf_dir):
    return g.direct_dependencies(g.file_edges(*_graph(spark, sf_dir)))


@query(
    "walk_flow",
    "J3",
    f"""WITH RECURSIVE {GRAPH}, step AS (SELECT DISTINCT source_id, target_id FROM edges),
walk AS (SELECT id AS root, id, 0 AS depth FROM nodes
  UNION ALL SELECT root, target_id, depth + 1 FROM walk JOIN step ON source_id = id WHERE depth < 8),
least AS (SELECT root, id, min(depth)::INT AS depth FROM walk GROUP BY ALL)
SELECT l.root, l.id, l.depth, coalesce(min(p.id), -1) AS parent FROM least l LEFT JOIN (SELECT p.root, p.id, p.depth, s.target_id FROM least p JOIN step s ON s.source_id = p.id) p
  ON p.root = l.root AND p.target_id = l.id AND p.depth = l.depth - 1 GROUP BY ALL""",
)
def walk_flow(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return g.walk_flow(nodes, edges).fillna(-1, ["parent"])


@query(
    "file_flow",
    "J4",
    f"""WITH {GRAPH} SELECT 'outbound' AS direction, source_id, target_id, type FROM edges WHERE source_id IN (SELECT id FROM nodes WHERE file = 'supplier/1')
UNION ALL SELECT 'inbound', source_id, target_id, type FROM edges WHERE target_id IN (SELECT id FROM nodes WHERE file = 'supplier/1')""",
)
def file_flow(spark, sf_dir):
    return g.file_flow(*_graph(spark, sf_dir), "supplier/1")


@query(
    "trace",
    "J5 G9 H4",
    f"""WITH {GRAPH}, node AS (SELECT min(id) AS node_id FROM nodes WHERE name = 'EUROPE')
SELECT node_id, 'out' AS direction, source_id, target_id, type FROM edges, node WHERE source_id = node_id
UNION ALL SELECT node_id, 'in', source_id, target_id, type FROM edges, node WHERE target_id = node_id""",
)
def trace(spark, sf_dir):
    return g.trace(*_graph(spark, sf_dir), "EUROPE")


@query(
    "node_bundle",
    "J6 D2",
    f"""WITH {GRAPH}, {LABELS}, {BEST}, near AS (SELECT source_id AS id, 'out' AS direction, type, target_id AS other_id FROM edges UNION ALL SELECT target_id, 'in', type, source_id FROM edges)
SELECT near.id, direction, near.type, other_id, n.name AS other_name, n.type AS other_type, coalesce(best.term, '') AS label FROM near JOIN nodes n ON n.id = other_id LEFT JOIN best ON best.node_id = other_id""",
)
def node_bundle(spark, sf_dir):
    """Labels are those of the document whose ID is the neighbour's."""
    out = g.node_bundle(*_graph(spark, sf_dir), a.labels(spark, sf_dir)).fillna("", ["label"])
    return out.select("id", "direction", "type", "other_id", "other_name", "other_type", "label")


@query(
    "neighborhood_size",
    "J7 H6",
    f"""WITH {GRAPH}, near AS (SELECT id AS anchor, id FROM nodes UNION SELECT source_id, target_id FROM edges UNION SELECT target_id, source_id FROM edges)
SELECT anchor, count(*) AS size FROM near GROUP BY ALL""",
)
def neighborhood_size(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return g.neighbourhood(nodes, edges).groupBy("anchor").agg(F.count("*").alias("size"))


@query(
    "project_map",
    "E1",
    f"""WITH {LABELS} SELECT project, file, count(*) AS n, string_agg(coalesce(line, -1) || ':' || type || ':' || name, ',' ORDER BY coalesce(line, -1), type, name) AS entries FROM docs GROUP BY ALL""",
)
def project_map(spark, sf_dir):
    return g.project_map(a.document_nodes(spark, sf_dir))


@query(
    "overview_purpose",
    "E2",
    f"""WITH {GRAPH} SELECT project, file, coalesce(string_agg(type || ':' || name, ', ' ORDER BY type || ':' || name), '') AS purpose FROM nodes GROUP BY ALL""",
)
def overview_purpose(spark, sf_dir):
    return g.overview(a.graph_nodes(spark, sf_dir))


@query(
    "status_totals",
    "E3 T13",
    f"""WITH {GRAPH} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(DISTINCT file) FROM nodes) AS files, (SELECT count(DISTINCT project) FROM nodes) AS projects,
  (SELECT count(*) FROM edges) AS edges, (SELECT strftime(max(o_orderdate), '%Y-%m-%d') FROM orders) AS last_update""",
)
def status_totals(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    hashes = a.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("updated_at"))
    return g.status_totals(nodes, edges, hashes).withColumn("last_update", F.date_format("last_update", "yyyy-MM-dd"))


@query(
    "labels_by_source",
    "E4",
    f"""WITH {LABELS} SELECT count(*) FILTER (source = 'heuristic') AS heuristic, count(*) FILTER (source = 'llm') AS llm, count(*) FILTER (source = 'manual') AS manual FROM node_labels""",
)
def labels_by_source(spark, sf_dir):
    return g.labels_by_source(a.labels(spark, sf_dir))


@query(
    "per_project_status",
    "E5 D5 D20",
    f"""WITH {LABELS}, per AS (SELECT project, count(*) AS labels FROM node_labels l JOIN docs d ON d.id = l.node_id GROUP BY ALL)
SELECT project, count(DISTINCT file) AS files, count(*) AS nodes, coalesce(any_value(labels), 0) AS labels FROM docs LEFT JOIN per USING (project) GROUP BY project""",
)
def per_project_status(spark, sf_dir):
    return g.per_project(a.document_nodes(spark, sf_dir), a.labels(spark, sf_dir))


def _coverage(by: str) -> str:
    return f"""WITH {LABELS}, flags AS (SELECT node_id AS id, max((source = 'heuristic')::INT) AS by_heuristic, max((source = 'llm')::INT) AS by_llm, max((source = 'manual')::INT) AS by_manual
  FROM node_labels WHERE NOT is_stale GROUP BY ALL)
SELECT {by}, count(*) AS total, count(by_llm) AS labelled, floor(count(by_llm) * 10000.0::DOUBLE / count(*) + 0.5) / 100.0::DOUBLE AS percent,
  coalesce(sum(by_heuristic), 0)::BIGINT AS by_heuristic, coalesce(sum(by_llm), 0)::BIGINT AS by_llm, coalesce(sum(by_manual), 0)::BIGINT AS by_manual
FROM docs LEFT JOIN flags USING (id) GROUP BY {by}"""


@query("label_coverage_project", "E7 E6 I16", _coverage("project"))
def label_coverage_project(spark, sf_dir):
    return g.coverage(a.document_nodes(spark, sf_dir), a.labels(spark, sf_dir), ["project"])


@query("label_coverage_file", "E7", _coverage("project, file"))
def label_coverage_file(spark, sf_dir):
    return g.coverage(a.document_nodes(spark, sf_dir), a.labels(spark, sf_dir), ["project", "file"])


@query("best_label", "G4 C16", f"WITH {LABELS}, {BEST} SELECT node_id, id, term, source, confidence FROM best")
def best_label(spark, sf_dir):
    return g.best_labels(a.labels(spark, sf_dir)).select("node_id", "id", "term", "source", "confidence")


@query(
    "find_nodes",
    "C4 I6",
    f"""WITH {GRAPH}, ask AS (SELECT unnest(['EUROPE', 'customer#00000001', 'nation_1', 'nothing']) AS query),
hits AS (SELECT query, (name <> query)::INT AS tier, id, project, file, name, type FROM nodes, ask WHERE name = query OR starts_with(lower(name), lower(query)))
SELECT * FROM (SELECT *, min(tier) OVER (PARTITION BY query) AS best FROM hits) WHERE tier = best""".replace("SELECT * FROM (SELECT *, min", "SELECT query, tier, id, project, file, name, type FROM (SELECT *, min"),
)
def find_nodes(spark, sf_dir):
    return g.find_nodes(a.graph_nodes(spark, sf_dir), ["EUROPE", "customer#00000001", "nation_1", "nothing"])


@query(
    "structure",
    "C1 C2",
    f"WITH {GRAPH} SELECT id, name, type, coalesce(line, 0) AS line FROM nodes WHERE file = 'nation/3'",
)
def structure(spark, sf_dir):
    return g.structure(a.graph_nodes(spark, sf_dir), "nation/3")


@query("schema_nodes", "C3", f"WITH {GRAPH} SELECT id, project, name, type FROM nodes WHERE type IN ('region', 'nation')")
def schema_nodes(spark, sf_dir):
    return a.graph_nodes(spark, sf_dir).where(F.col("type").isin("region", "nation")).select("id", "project", "name", "type")


@query(
    "list_projects",
    "C5 D5 H6",
    f"WITH {GRAPH} SELECT project, coalesce(n, 0) AS parts FROM (SELECT DISTINCT project FROM nodes) LEFT JOIN (SELECT 'PARTS' AS project, count(*) AS n FROM part) USING (project)",
)
def list_projects(spark, sf_dir):
    projects = a.graph_nodes(spark, sf_dir).select("project").distinct()
    state = a.table(spark, sf_dir, "part").groupBy(F.lit("PARTS").alias("project")).agg(F.count("*").alias("parts"))
    return projects.join(state, "project", "left").fillna(0, ["parts"])


@query(
    "edge_resolution",
    "D3 D4",
    f"""WITH {GRAPH}, firsts AS (SELECT project, file, min(id) AS first_id FROM nodes GROUP BY ALL), names AS (SELECT project, name, min(id) AS id FROM nodes GROUP BY ALL),
own AS (SELECT project, file, name, min(id) AS id FROM nodes GROUP BY ALL),
raw AS (SELECT project, file, name AS source, CASE WHEN id % 3 = 0 THEN 'nation/' || (id // 8 % 30) ELSE 'customer/' || (id // 8 % 30) END AS target, 'imports' AS type FROM nodes WHERE type = 'supplier'
  UNION ALL SELECT project, file, 'nobody', CASE WHEN id % 2 = 0 THEN project ELSE name END, 'calls' FROM nodes WHERE type IN ('supplier', 'nation')),
tries AS (SELECT project, file, source, target, type, k, CASE k WHEN 0 THEN target || '.x' WHEN 1 THEN target ELSE target || '/index' END AS try FROM raw, range(3) t(k) WHERE type = 'imports'),
hit AS (SELECT t.project, t.file, t.source, t.target, arg_min(first_id, k) AS import_id FROM tries t JOIN firsts f ON f.project = t.project AND f.file = t.try GROUP BY ALL)
SELECT r.project, r.file, r.type, coalesce(s.id, f.first_id) AS source_id, coalesce(CASE WHEN r.type = 'imports' THEN h.import_id ELSE coalesce(i.id, p.id) END, -1) AS found_id, r.target,
  (CASE WHEN r.type = 'imports' THEN h.import_id ELSE coalesce(i.id, p.id) END) IS NOT NULL AS resolved
FROM raw r LEFT JOIN hit h ON h.project = r.project AND h.file = r.file AND h.source = r.source AND h.target = r.target AND r.type = 'imports'
LEFT JOIN own i ON i.project = r.project AND i.file = r.file AND i.name = r.target LEFT JOIN names p ON p.project = r.project AND p.name = r.target
LEFT JOIN own s ON s.project = r.project AND s.file = r.file AND s.name = r.source LEFT JOIN firsts f ON f.project = r.project AND f.file = r.file""",
)
def edge_resolution(spark, sf_dir):
    nodes = a.graph_nodes(spark, sf_dir)
    key = F.floor(F.col("id") / 8)
    place = F.concat(F.when(F.col("id") % 3 == 0, "nation/").otherwise("customer/"), (key % 30).cast("string"))
    imports = nodes.where("type = 'supplier'").select(
        "project", "file", F.col("name").alias("source"), place.alias("target"), F.lit("imports").alias("type"),
        F.array(F.concat(place, F.lit(".x")), place, F.concat(place, F.lit("/index"))).alias("candidates"),
    )
    calls = nodes.where("type IN ('supplier', 'nation')").select(
        "project", "file", F.lit("nobody").alias("source"), F.when(F.col("id") % 2 == 0, F.col("project")).otherwise(F.col("name")).alias("target"),
        F.lit("calls").alias("type"), F.array().cast("array<string>").alias("candidates"),
    )
    out = g.resolve_edges(imports.unionByName(calls), nodes)
    return out.withColumn("found_id", F.when(F.col("resolved"), F.col("target_id")).otherwise(F.lit(-1))).drop("target_id")
