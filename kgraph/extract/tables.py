"""Extraction over tables of files, and the graph build (scan)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as x
from ..functions.cut import cut
from ..operators.graph import resolve_edges
from .languages import body_by_braces, body_by_indent, default_registry, detect

RAW = (
    "kind string, project string, file string, name string, type string, line int, body_hash string, category string, target string, "
    "confidence double, descriptors string"
)


def extract_files(files: DataFrame) -> DataFrame:
    """files: project, file, content.  One row per node, edge and label found (kind says which)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        registry = default_registry()
        for batch in batches:
            rows = []
            for project, path, content in zip(batch["project"], batch["file"], batch["content"]):
                if not isinstance(content, str) or "\0" in content:
                    continue
                found = registry.extract(content, path)
                decorated: dict[str, list[str]] = {}
                for kind, _, source, target in found.edges:
                    if kind == "decorates":
                        decorated.setdefault(source, []).append(target)
                for name, kind, line in found.nodes:
                    code = kind in ("function", "method", "class")
                    body = (body_by_indent if path.endswith(".py") else body_by_braces)(content, line) if code else None
                    digest = hashlib.sha256(body.encode()).hexdigest() if body else None
                    rows.append(("node", project, path, name, kind, line, digest, None, None, None, None))
                    for detector, category, term, confidence, words in detect(path, content, name, body, decorated.get(name, [])):
                        rows.append(("label", project, path, name, detector, line, digest, category, term, confidence, ",".join(words)))
                for kind, category, source, target in found.edges:
                    rows.append(("edge", project, path, source, kind, None, None, category, target, None, None))
            names = [c.split()[0] for c in RAW.split(", ")]
            frame = pd.DataFrame(rows, columns=names)
            frame["line"] = frame["line"].astype("Int32")
            yield frame

    return files.select("project", "file", "content").mapInPandas(work, RAW)


def scan(files: DataFrame, rules: list[str] = tuple(x.BUILTIN_IGNORES)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and labels of a source tree.  Excluded files are not read; ids are hashes of
    the natural key, smaller ones of a file's earlier lines being found by line; targets that are nowhere become stubs."""
    kept = files.where(~x.excluded(F.col("file"), list(rules)))
    raw = cut(extract_files(kept))
    key = F.xxhash64("project", "file", "name", "type", F.coalesce("line", F.lit(-1)))
    nodes = raw.where("kind = 'node'").select(key.alias("key"), "project", "file", "name", "type", "line", "body_hash").dropDuplicates(["key"])
    # "first node" rules go by line, so ids order by file and line
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("project", "file").orderBy(F.col("line").asc_nulls_first(), F.col("type") != "module", "type", "name"))
    nodes = nodes.withColumn("ordinal", order)
    nodes = nodes.select(F.expr("shiftleft(xxhash64(project, file) & 17592186044415, 18) + ordinal").alias("id"), "project", "file", "name", "type", "line", "body_hash")
    edges = raw.where("kind = 'edge'").select("project", "file", F.col("name").alias("source"), "target", "type", "category")
    candidates = F.when(F.col("type") == "imports", x.import_candidates(F.col("file"), F.col("target"))).otherwise(F.array().cast("array<string>"))
    resolved = resolve_edges(edges.withColumn("candidates", candidates), nodes)
    stubs = resolved.where("NOT resolved").select(
        F.col("target_id").alias("id"), "project", F.col("target").alias("file"), F.col("target").alias("name"),
        F.when(F.col("type") == "queries_table", "table").otherwise("stub").alias("type"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("body_hash"),
    ).dropDuplicates(["id"])
    labels = raw.where("kind = 'label'").select("project", "file", "name", "line", F.col("type").alias("detector_id"), "category", F.col("target").alias("term"), "confidence", "descriptors", F.col("body_hash").alias("body_hash_at_label"))
    return nodes.unionByName(stubs), resolved, labels
