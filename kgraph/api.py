"""One method per verb.  Methods return DataFrames; errors are typed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .extract import tables
from .operators import graph as g
from .operators import lifecycle, search, sessions
from .schemas import EDGE_TYPES, SEED_EDGE_TYPES


class GraphError(Exception):
    """A request that cannot be answered."""


class BadRequest(GraphError):
    pass


class UnknownProject(GraphError):
    pass


class AmbiguousNode(GraphError):
    """Several nodes of that name in the file: a line is needed."""


class KnowledgeGraph:
    """nodes, edges (with source_id, target_id, type, category), labels, and, for recall, rows of session logs."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, labels: DataFrame | None = None, edge_types: DataFrame | None = None, log: DataFrame | None = None, files: DataFrame | None = None):
        spark = nodes.sparkSession
        self.spark, self.nodes, self.edges, self.log, self.files = spark, nodes, edges, log, files
        self.labels = labels
        self.edge_types = edge_types if edge_types is not None else spark.createDataFrame(SEED_EDGE_TYPES, EDGE_TYPES)

    @classmethod
    def scan(cls, spark: SparkSession, files: DataFrame, log: DataFrame | None = None) -> KnowledgeGraph:
        nodes, edges, labels = tables.scan(files)
        named = nodes.select(F.col("id").alias("node_id"), "project", "file", "name", "line")
        found = labels.join(named, ["project", "file", "name", "line"]).withColumns({"source": F.lit("heuristic"), "is_stale": F.lit(False), "id": F.xxhash64("node_id", "detector_id")})
        return cls(nodes, edges, found, log=log, files=files)

    def _project(self, project: str) -> DataFrame:
        own = self.nodes.where(F.col("project") == project)
        if own.isEmpty():
            raise UnknownProject(project)
        return own

    def projects(self) -> DataFrame:
        return self.nodes.select("project").distinct().orderBy("project")

    def map(self, project: str) -> DataFrame:
        return g.project_map(self._project(project))

    def find(self, *names: str) -> DataFrame:
        if not names or not all(names):
            raise BadRequest("a name is needed")
        return g.find_nodes(self.nodes, list(names))

    def structure(self, project: str, file: str) -> DataFrame:
        return g.structure(self._project(project), file)

    def blast_radius(self, project: str, file: str, depth: int = 3) -> DataFrame:
        roots = self._project(project).where(F.col("file") == file)
        return g.blast_radius(roots, g.file_edges(self.nodes, self.edges, self.edge_types), depth)

    def dependents(self) -> DataFrame:
        return g.direct_dependencies(g.file_edges(self.nodes, self.edges))

    def flow(self, file: str) -> DataFrame:
        return g.file_flow(self.nodes, self.edges, file)

    def trace(self, name: str) -> DataFrame:
        return g.trace(self.nodes, self.edges, name)

    def node(self, project: str, file: str, name: str, line: int | None = None) -> DataFrame:
        found = self._project(project).where((F.col("file") == file) & (F.col("name") == name))
        found = found if line is None else found.where(F.col("line") == line)
        if line is None and found.limit(2).count() > 1:
            raise AmbiguousNode(f"{file}: {name}")
        return found

    def walk(self, project: str, file: str, name: str, depth: int = 8) -> DataFrame:
        return g.walk_flow(self.node(project, file, name), self.edges, depth)

    def bundle(self, project: str, file: str, name: str, line: int | None = None) -> DataFrame:
        ids = self.node(project, file, name, line).select("id")
        return g.node_bundle(self.nodes, self.edges, self._labels()).join(ids, "id", "left_semi")

    def _labels(self) -> DataFrame:
        if self.labels is None:
            raise BadRequest("no labels were given")
        return self.labels

    def coverage(self, by: list[str]) -> DataFrame:
        return g.coverage(self.nodes, self._labels(), by)

    def status(self) -> DataFrame:
        return g.per_project(self.nodes, self._labels())

    def grep(self, pattern: str, context: int = 3, max_per_file: int = 20) -> DataFrame:
        if self.files is None:
            raise BadRequest("no files were given")
        return search.grep(search.lines(self.files), pattern, context, max_per_file)

    def classify(self, variants: dict[str, str]) -> DataFrame:
        if self.files is None:
            raise BadRequest("no files were given")
        return search.classify(search.lines(self.files), variants)

    def audit(self) -> DataFrame:
        return lifecycle.audit([lifecycle.audit_edge_types(self.edges, self.edge_types), lifecycle.audit_orphans(self.nodes, self.edges)])

    def _log(self) -> DataFrame:
        if self.log is None:
            raise BadRequest("no session log was given")
        return self.log

    def windows(self) -> DataFrame:
        return sessions.windows(self._log())

    def decisions(self) -> DataFrame:
        return sessions.decisions(self._log())

    def search(self, clusters: list[list[str]], limit: int = 10, promoted: DataFrame | None = None) -> DataFrame:
        """Windows that match, newest first; the index is built from the log where there is none."""
        w = sessions.with_windows(self._log())
        key = F.concat_ws("#", "session_id", F.col("seq").cast("string"))
        index = search.full_index(w.where("text IS NOT NULL").select(key.alias("window_id"), "ln", "text"), ["window_id"])
        times = sessions.windows(self._log()).select(key.alias("window_id"), "end_time")
        found = search.search(index, clusters, promoted).join(times, "window_id")
        return found.orderBy(F.desc("score"), F.desc_nulls_last("end_time"), "window_id").limit(limit)

    def recent(self, n: int = 10) -> DataFrame:
        return sessions.recent(sessions.sessions(self._log()), n)
