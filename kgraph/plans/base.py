"""Where named queries are gathered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Query name -> IDs of the operators that it shows.
OPERATORS: dict[str, tuple[str, ...]] = {}


def query(name: str, operators: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        OPERATORS[name] = tuple(operators.split())
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


#: The graph of sources.adapters in DuckDB SQL.
GRAPH = """
nodes AS (
  SELECT r_regionkey::BIGINT * 8 AS id, r_name AS project, 'region/' || r_regionkey AS file, r_name AS name, 'region' AS type, NULL::INT AS line FROM region
  UNION ALL SELECT n_nationkey::BIGINT * 8 + 1, r_name, 'nation/' || n_nationkey, n_name, 'nation', n_regionkey + 1 FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT c_custkey * 8 + 2, r_name, 'customer/' || c_custkey, c_name, 'customer', c_nationkey + 1
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT s_suppkey * 8 + 3, r_name, 'supplier/' || s_suppkey, s_name, 'supplier', s_nationkey + 1
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT p_partkey * 8 + 4, 'PARTS', 'part/' || p_partkey, p_name, 'part', p_size FROM part
  UNION ALL SELECT o_orderkey * 8 + 5, r_name, 'orders/' || o_orderkey, o_orderpriority, 'orders', NULL
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), edges AS (
  SELECT n_nationkey::BIGINT * 8 + 1 AS source_id, n_regionkey::BIGINT * 8 AS target_id, 'imports' AS type, 'structural' AS category, true AS follows FROM nation
  UNION ALL SELECT c_custkey * 8 + 2, c_nationkey::BIGINT * 8 + 1, 'imports', 'structural', true FROM customer
  UNION ALL SELECT s_suppkey * 8 + 3, s_nationkey::BIGINT * 8 + 1, 'imports', 'structural', true FROM supplier
  UNION ALL SELECT o_orderkey * 8 + 5, o_custkey * 8 + 2, 'imports', 'structural', true FROM orders
  UNION ALL SELECT l_orderkey * 8 + 5, l_partkey * 8 + 4, 'calls', 'structural', true FROM lineitem
  UNION ALL SELECT l_orderkey * 8 + 5, l_suppkey * 8 + 3, 'queries_table', 'data_flow', false FROM lineitem
), file_edges AS (
  SELECT DISTINCT t.project AS target_project, t.file AS target_file, s.project AS source_project, s.file AS source_file, e.follows
  FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id
)"""

LABELS = """
docs AS (SELECT doc_id AS id, source AS project, lang || '/' || doc_id AS file, lang || '/' || doc_id AS name, 'module' AS type, 1 AS line, text AS content FROM documents),
node_labels AS (
  SELECT doc_id * 2 AS id, doc_id AS node_id, 'quality' AS detector_id, CASE WHEN quality = 1 THEN 'validation' ELSE 'error-handler' END AS term,
    CASE WHEN toxic = 1 THEN 'manual' WHEN doc_id % 3 = 0 THEN 'llm' ELSE 'heuristic' END AS source,
    CASE WHEN quality = 1 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS confidence, quality = 0 AS is_stale
  FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT doc_id * 2 + 1, doc_id, 'toxic', 'middleware', 'heuristic', 0.8::DOUBLE, false FROM labels JOIN documents USING (doc_id) WHERE doc_id % 2 = 0
)"""

BEST = """
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY CASE source WHEN 'manual' THEN 0 WHEN 'llm' THEN 1 ELSE 2 END,
    confidence DESC, id DESC) AS n FROM node_labels WHERE NOT is_stale) WHERE n = 1
)"""
