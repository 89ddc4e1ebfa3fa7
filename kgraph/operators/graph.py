"""Graph operators: traversal, lookup, coverage, overview.

Traversals are set at a time: a level is one join for all roots together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cut import cut, drop_shuffles, store

#: Followed edge types, at most: they become a list of literals, so that tables of other types are not read.
MOST_EDGE_TYPES = 10_000
#: Roots are taken in so many slices, if there are so many of them for each: what is shuffled at a time is a slice's.
SLICES, SLICE_ROOTS = 8, 1_000_000


def _slices(count: int) -> int:
    return min(SLICES, 1 + count // SLICE_ROOTS)


def _slice(df: DataFrame, by: list[str], k: int, of: int) -> DataFrame:
    """The k-th of slices by those columns; all rows are in one of them."""
    return df if of == 1 else df.where(F.pmod(F.xxhash64(*by), F.lit(of)) == k)


def file_edges(nodes: DataFrame, edges: DataFrame, edge_types: DataFrame | None = None, once: bool = True) -> DataFrame:
    """target_project, target_file, source_project, source_file of distinct (followed) edges; not once: for callers that group
    them anyway, as often as there are edges."""
    if edge_types is not None:
        followed = [r.name for r in edge_types.where("follows").select("name").distinct().limit(MOST_EDGE_TYPES + 1).collect()]
        if len(followed) > MOST_EDGE_TYPES:
            raise ValueError(f"more than {MOST_EDGE_TYPES} followed edge types")
        edges = edges.where(F.col("type").isin(sorted(followed)))
    ends = nodes.select("id", "project", "file")
    source = ends.select(F.col("id").alias("source_id"), F.col("project").alias("source_project"), F.col("file").alias("source_file"))
    target = ends.select(F.col("id").alias("target_id"), F.col("project").alias("target_project"), F.col("file").alias("target_file"))
    # the target first: a filter of targets then leaves less for the second join
    joined = edges.select("source_id", "target_id").join(target, "target_id").join(source, "source_id")
    out = joined.select("target_project", "target_file", "source_project", "source_file")
    return out.distinct() if once else out


def blast_radius(roots: DataFrame, hops: DataFrame, depth: int = 3) -> DataFrame:
    """Roots: project, file.  hops: file_edges of followed types.  Returns root, file, project, depth: all files that
    depend on the root within depth hops, at their least depth.

    As the definition has it, files are visited by name, the root itself never, and a level expands within the root's
    project only, though a file found is named with its own.
    """
    key = ["root_project", "root"]
    start = roots.select(F.col("project").alias("root_project"), F.col("file").alias("root")).distinct()
    slices = _slices(start.count())
    edges = hops.select(F.col("target_project").alias("root_project"), F.col("target_file").alias("root"), F.col("source_file").alias("file"), F.col("source_project").alias("project"))

    def pointing(k: int) -> DataFrame:
        """What points to a file, and whether that file is a root; both sides of the join lie by key."""
        into = _slice(edges, key, k, slices).repartition(*key).groupBy(*key, "file").agg(F.min("project").alias("project"))
        return into.join(_slice(start, key, k, slices).withColumn("asked", F.lit(True)), key, "left")

    into = [store(pointing(k), "inbound") for k in range(slices)]
    inbound = reduce(DataFrame.unionByName, into)
    # a level goes on from files only that are pointed to and point to others
    passed = inbound.select(*key).distinct().join(inbound.select("root_project", F.col("file").alias("root")), key, "left_semi")
    onward = store(inbound.drop("asked").join(passed, key, "left_semi").withColumnRenamed("root", "at").withColumnRenamed("file", "next"), "onward")
    levels = []
    for part in into:
        found = part.where("asked AND file <> root").drop("asked")
        visited = found.select(*key, "file")
        levels.append(found.withColumn("depth", F.lit(1)))
        for level in range(2, depth + 1):
            frontier = found.select(*key, F.col("file").alias("at"))
            found = frontier.join(onward.withColumnRenamed("project", "via"), ["root_project", "at"]).where("next <> root")
            found = found.groupBy(*key, F.col("next").alias("file")).agg(F.min("via").alias("project"))
            found = store(found.join(visited, [*key, "file"], "left_anti"), "level")
            visited = visited.unionByName(found.select(*key, "file"))
            levels.append(found.withColumn("depth", F.lit(level)))
    return reduce(DataFrame.unionByName, levels)


def direct_dependencies(hops: DataFrame) -> DataFrame:
    """For each file, how many other files it points to and is pointed to by, over all edge types; hops are distinct."""
    other = hops.where("NOT (target_project = source_project AND target_file = source_file)")
    out = other.groupBy(F.col("source_project").alias("project"), F.col("source_file").alias("file")).agg(F.count("*").alias("imports"))
    into = other.groupBy(F.col("target_project").alias("project"), F.col("target_file").alias("file")).agg(F.count("*").alias("imported_by"))
    return out.join(into, ["project", "file"], "full_outer").fillna(0, ["imports", "imported_by"])


def walk_flow(roots: DataFrame, edges: DataFrame, depth: int = 8) -> DataFrame:
    """Roots: id.  Outbound walk over all edge types: root, id, depth, parent (the node it was first reached from: the
    smallest, which stands for queue order).  Nodes beyond the depth are not given; see ``truncated``."""
    step = edges.select(F.col("source_id").alias("at"), F.col("target_id").alias("next"))
    own = roots.select(F.col("id").alias("root"), "id").withColumn("depth", F.lit(0)).withColumn("parent", F.lit(None).cast("long"))
    return own.unionByName(_walk(roots.select("id"), step, depth))


def _walk(roots: DataFrame, step: DataFrame, depth: int) -> DataFrame:
    """walk_flow without the roots themselves.

    Where few nodes are passed through and all of these are roots, their walks are made first, and a root's is put together from
    those of the nodes it points to: each edge is shuffled to its target once, and what is found to its root once."""
    count = roots.count() if depth > 1 else 0
    inner = _passed(roots, step, count // 2) if count > 1 else None
    if inner is None:
        return _walk_by_level(roots, step, depth)
    onward = cut(step.join(inner.withColumnRenamed("id", "at"), "at", "left_semi").distinct())
    inner_walk = _walk(inner, onward, depth - 1)
    inner_walk = cut(inner_walk.select(F.col("root").alias("next"), "id", (F.col("depth") + 1).alias("depth"), "parent"))
    drop_shuffles(roots.sparkSession)
    slices = _slices(count)

    def walked(k: int) -> DataFrame:
        from_root, own = _slice(step, ["at"], k, slices), _slice(roots, ["id"], k, slices)
        # a parent at depth 1 is the root: it need not be shuffled
        direct = from_root.select(F.col("at").alias("root"), F.col("next").alias("id"), F.lit(1).alias("depth"), F.lit(None).cast("long").alias("parent"))
        through = from_root.join(inner_walk, "next").select(F.col("at").alias("root"), "id", "depth", "parent")
        found = direct.unionByName(through).where("root <> id").repartition("root")
        found = found.join(own.select(F.col("id").alias("root")), "root", "left_semi")
        least = found.groupBy("root", "id").agg(F.min(F.struct("depth", "parent")).alias("least"))
        return least.select("root", "id", "least.depth", F.coalesce("least.parent", "root").alias("parent"))

    return walked(0) if slices == 1 else reduce(DataFrame.unionByName, [store(walked(k), "walk") for k in range(slices)])


def _passed(roots: DataFrame, step: DataFrame, most: int) -> DataFrame | None:
    """id: the nodes that have edges in and out, if they are no more than most and all of them roots."""
    into, out = step.select(F.col("next").alias("id")).distinct(), step.select(F.col("at").alias("id")).distinct()
    inner = cut(into.join(out, "id", "left_semi"))
    return inner if inner.count() <= most and inner.join(roots, "id", "left_anti").isEmpty() else None


def _walk_by_level(roots: DataFrame, step: DataFrame, depth: int) -> DataFrame:
    step = cut(step.distinct())
    seen = roots.select(F.col("id").alias("root"), "id")
    frontier, levels = seen, []
    for level in range(1, depth + 1):
        found = frontier.select("root", F.col("id").alias("at")).join(step, "at")
        found = found.groupBy("root", F.col("next").alias("id")).agg(F.min("at").alias("parent"))
        found = found.join(seen, ["root", "id"], "left_anti").withColumn("depth", F.lit(level))
        found = cut(found.select("root", "id", "depth", "parent"))
        levels.append(found)
        if found.isEmpty():
            break
        seen = seen.unionByName(found.select("root", "id"))
        frontier = found
    return reduce(DataFrame.unionByName, levels)


def truncated(walk: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Root, truncated: does an unvisited node lie one step beyond the depth?"""
    step = edges.select(F.col("source_id").alias("at"), F.col("target_id").alias("id")).distinct()
    last = walk.where(F.col("depth") == depth).select("root", F.col("id").alias("at"))
    beyond = last.join(step, "at").join(walk.select("root", "id"), ["root", "id"], "left_anti").select("root").distinct()
    return walk.select("root").distinct().join(beyond.withColumn("truncated", F.lit(True)), "root", "left").fillna(False, ["truncated"])


def file_flow(nodes: DataFrame, edges: DataFrame, file: str) -> DataFrame:
    """Edges of a file's nodes, by direction; an edge within the file shows in both."""
    own = nodes.where(F.col("file") == file).select("id")
    out = edges.join(own.withColumnRenamed("id", "source_id"), "source_id", "left_semi").withColumn("direction", F.lit("outbound"))
    into = edges.join(own.withColumnRenamed("id", "target_id"), "target_id", "left_semi").withColumn("direction", F.lit("inbound"))
    columns = ["direction", "source_id", "target_id", "type"]
    return out.select(columns).unionByName(into.select(columns))


def trace(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """The first node (smallest id) of that name with all its edges; a self-loop shows twice."""
    node = nodes.where(F.col("name") == name).agg(F.min("id").alias("node_id"))
    out = edges.join(node, F.col("source_id") == F.col("node_id")).withColumn("direction", F.lit("out"))
    into = edges.join(node, F.col("target_id") == F.col("node_id")).withColumn("direction", F.lit("in"))
    columns = ["node_id", "direction", "source_id", "target_id", "type"]
    return out.select(columns).unionByName(into.select(columns))


def best_labels(labels: DataFrame, every: bool = False, multi: bool = False) -> DataFrame:
    """A node's label of the best source (manual, llm, heuristic), confidence and id; stale ones only if every."""
    from ..schemas import LABEL_SOURCES

    rank = reduce(lambda c, k: c.when(F.col("source") == LABEL_SOURCES[k], k), range(len(LABEL_SOURCES)), F).otherwise(9)
    order = Window.partitionBy("node_id").orderBy(rank, F.desc("confidence"), F.desc("id"))
    kept = labels if every else labels.where(~F.col("is_stale"))
    ranked = kept.withColumn("n", F.row_number().over(order))
    return ranked.drop("n") if multi else ranked.where("n = 1").drop("n")


def node_bundle(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Each node's neighbours in one hop, with the counterpart's name, type and best label."""
    top = best_labels(labels).select(F.col("node_id").alias("other_id"), F.col("term").alias("label"))
    out = edges.select(F.col("source_id").alias("id"), F.lit("out").alias("direction"), "type", F.col("target_id").alias("other_id"))
    into = edges.select(F.col("target_id").alias("id"), F.lit("in").alias("direction"), "type", F.col("source_id").alias("other_id"))
    other = nodes.select(F.col("id").alias("other_id"), F.col("name").alias("other_name"), F.col("type").alias("other_type"))
    return out.unionByName(into).join(other, "other_id").join(top, "other_id", "left")


def ambiguous(nodes: DataFrame) -> DataFrame:
    """(project, file, name) of several nodes, which need a line to be told apart."""
    return nodes.groupBy("project", "file", "name").agg(F.count("*").alias("n")).where("n > 1")


def neighbourhood(anchors: DataFrame, edges: DataFrame) -> DataFrame:
    """Anchor, id: the anchor, what it points to and what points to it, once each."""
    a = anchors.select(F.col("id").alias("anchor"))
    out = a.join(edges, F.col("source_id") == F.col("anchor")).select("anchor", F.col("target_id").alias("id"))
    into = a.join(edges, F.col("target_id") == F.col("anchor")).select("anchor", F.col("source_id").alias("id"))
    return a.select("anchor", F.col("anchor").alias("id")).unionByName(out).unionByName(into).distinct()


def percent(part: Column, whole: Column) -> Column:
    """I16: to two decimals, halves up; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.floor(part * 10000.0 / whole + 0.5) / 100.0)


def coverage(scope: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """Scope: id and the columns of by.  Nodes, labelled nodes, percent, and labelled nodes per source, stale ones
    left out."""
    live = labels.where(~F.col("is_stale")).select(F.col("node_id").alias("id"), "source").distinct()
    per_node = live.groupBy("id").agg(*[F.max((F.col("source") == s).cast("int")).alias(f"by_{s}") for s in ("heuristic", "llm", "manual")])
    joined = scope.select("id", *by).distinct().join(per_node, "id", "left")
    flags = [f"by_{s}" for s in ("heuristic", "llm", "manual")]
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in flags]
    labelled = F.count(F.col("by_llm"))
    return joined.groupBy(*by).agg(F.count("*").alias("total"), labelled.alias("labelled"), percent(labelled, F.count("*")).alias("percent"), *sums)


def project_map(nodes: DataFrame) -> DataFrame:
    """Project, file, entries: "line:type:name" in order of line (null first), type, name."""
    entries = F.sort_array(F.collect_list(F.struct(F.coalesce("line", F.lit(-1)).alias("l"), "type", "name")))
    text = F.array_join(F.transform(entries, lambda x: F.concat_ws(":", x["l"].cast("string"), x["type"], x["name"])), ",")
    return nodes.groupBy("project", "file").agg(F.count("*").alias("n"), text.alias("entries"))


def overview(nodes: DataFrame) -> DataFrame:
    """A file's purpose: its "type:name" list without modules."""
    own = F.sort_array(F.collect_list(F.when(F.col("type") != "module", F.concat_ws(":", "type", "name"))))
    return nodes.groupBy("project", "file").agg(F.array_join(own, ", ").alias("purpose"))


def status_totals(nodes: DataFrame, edges: DataFrame, hashes: DataFrame) -> DataFrame:
    """One row; files are counted by name over projects."""
    a = nodes.agg(F.count("*").alias("nodes"), F.countDistinct("file").alias("files"), F.countDistinct("project").alias("projects"))
    b = edges.agg(F.count("*").alias("edges"))
    c = hashes.agg(F.max("updated_at").alias("last_update"))
    one = lambda d: d.withColumn("k", F.lit(1))
    return one(a).join(one(b), "k").join(one(c), "k").drop("k")


def labels_by_source(labels: DataFrame) -> DataFrame:
    """One row, a count per source, zero where there is none."""
    count = lambda s: F.count(F.when(F.col("source") == s, 1)).alias(s)
    return labels.agg(*[count(s) for s in ("heuristic", "llm", "manual")])


def per_project(nodes: DataFrame, labels: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Files, nodes and labels of each project, with its scan state if there is one."""
    own = nodes.groupBy("project").agg(F.countDistinct("file").alias("files"), F.count("*").alias("nodes"))
    per = labels.select(F.col("node_id").alias("id")).join(nodes.select("id", "project"), "id").groupBy("project").agg(F.count("*").alias("labels"))
    out = own.join(per, "project", "left").fillna(0, ["labels"])
    return out.join(scans, "project", "left") if scans is not None else out


def find_nodes(nodes: DataFrame, wanted: list[str]) -> DataFrame:
    """C4: for each name, the nodes called exactly so; only where there is none, those that begin so, whatever the case.

    Both tiers are equalities: of the name, and of as many of its first characters as a wanted name has."""
    ask = nodes.sparkSession.createDataFrame([(w,) for w in sorted(set(wanted))], "query string")
    columns = ["query", "tier", "id", "project", "file", "name", "type"]
    exact = nodes.join(F.broadcast(ask), F.col("name") == F.col("query")).withColumn("tier", F.lit(0)).select(columns)
    lengths = sorted({len(w) for w in wanted})
    heads = F.explode(F.array(*[F.lower(F.substring("name", 1, n)) for n in lengths])).alias("head")
    begun = nodes.select("id", "project", "file", "name", "type", heads).distinct()
    rest = ask.join(exact.select("query").distinct(), "query", "left_anti").withColumn("head", F.lower("query"))
    found = begun.join(F.broadcast(rest), "head").withColumn("tier", F.lit(1)).select(columns)
    return exact.unionByName(found.distinct())


def structure(nodes: DataFrame, file: str) -> DataFrame:
    """A file's nodes by line, none first."""
    return nodes.where(F.col("file") == file).select("id", "name", "type", F.coalesce("line", F.lit(0)).alias("line")).orderBy("line", "id")


def resolve_edges(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """Raw: project, file, source, target, type, candidates (ordered files, for imports; else empty).

    An import's target is the first node of the first candidate file there is; another's is the node of that name in the
    same file, else the first of that name in the project; what is found nowhere becomes a stub.  A source that the file
    does not name is the file's first node.  Returns project, file, type, source_id, target_id, target, resolved.
    """
    first_of_file = nodes.groupBy("project", "file").agg(F.min("id").alias("first_id"))
    by_file = nodes.groupBy("project", "file", "name").agg(F.min("id").alias("in_file"))
    by_project = nodes.groupBy("project", "name").agg(F.min("id").alias("in_project"))
    keyed = raw.withColumn("edge", F.xxhash64("project", "file", "source", "target", "type"))
    tries = keyed.select("edge", "project", F.posexplode("candidates").alias("ordinal", "file")).distinct()
    hit = tries.join(first_of_file, ["project", "file"]).groupBy("edge").agg(F.min_by("first_id", "ordinal").alias("import_id"))
    out = (
        keyed.join(hit, "edge", "left")
        .join(by_file.withColumnRenamed("name", "target").withColumnRenamed("in_file", "target_in_file"), ["project", "file", "target"], "left")
        .join(by_project.withColumnRenamed("name", "target").withColumnRenamed("in_project", "target_in_project"), ["project", "target"], "left")
        .join(by_file.withColumnRenamed("name", "source").withColumnRenamed("in_file", "source_in_file"), ["project", "file", "source"], "left")
        .join(first_of_file, ["project", "file"], "left")
    )
    target = F.when(F.col("type") == "imports", F.col("import_id")).otherwise(F.coalesce("target_in_file", "target_in_project"))
    stub = F.xxhash64("project", "target", F.lit("stub"))
    return out.select(
        "project",
        "file",
        "type",
        F.coalesce("source_in_file", "first_id").alias("source_id"),
        F.coalesce(target, stub).alias("target_id"),
        "target",
        target.isNotNull().alias("resolved"),
    )
