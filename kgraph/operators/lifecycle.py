"""Incremental work, stored state as snapshots, rules, findings, audits, policies, clusters, documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..functions.cut import cut


def worklist(current: DataFrame, known: DataFrame, forced: list[str] = ()) -> DataFrame:
    """Current, known: project, file, hash.  new, changed, forced, missing or same, for every file."""
    both = current.select("project", "file", F.col("hash").alias("now")).join(known.select("project", "file", F.col("hash").alias("then")), ["project", "file"], "full_outer")
    status = (
        F.when(F.col("now").isNull(), "missing")
        .when(F.col("then").isNull(), "new")
        .when(F.col("now") != F.col("then"), "changed")
        .when(F.col("file").isin(list(forced)), "forced")
        .otherwise("same")
    )
    return both.select("project", "file", status.alias("status"))


def newer(current: DataFrame, known: DataFrame, diff: DataFrame) -> DataFrame:
    """H3, L3: files that git names or whose time is later than the stored one, once each."""
    late = current.join(known, ["project", "file"]).where(F.col("modified_at") > F.col("updated_at")).select("project", "file")
    return late.union(diff.select("project", "file")).distinct()


def cascade(rows: DataFrame, survivors: DataFrame, keys: list[str], key: str = "id") -> DataFrame:
    """M5: rows all of whose keys survive."""
    for k in keys:
        rows = rows.join(survivors.select(F.col(key).alias(k)).distinct(), k, "left_semi")
    return rows


def upsert(rows: DataFrame, key: list[str], ordinal: str, last: list[str]) -> DataFrame:
    """M1, M4, M9: one row per key: the first row's columns, but of the columns in last the last that is not null."""
    others = [c for c in rows.columns if c not in {*key, *last, ordinal}]
    aggs = [F.min_by(c, ordinal).alias(c) for c in others]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ordinal))).alias(c) for c in last]
    return rows.groupBy(*key).agg(*aggs, F.min(ordinal).alias(ordinal))


def first_wins(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The first registration of each key."""
    rest = [c for c in rows.columns if c not in (key, ordinal)]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), ordinal).alias("r")).select(key, "r.*")


def merge_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keyed by (node_id, detector_id, source): new labels replace old ones, old manual and llm labels stay."""
    key = ["node_id", "detector_id", "source"]
    kept = old.join(new.select(*key), key, "left_anti").where("source <> 'heuristic'")
    return new.unionByName(kept, allowMissingColumns=True)


def stale_labels(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """With is_stale: was the label made for another body?"""
    joined = labels.drop("is_stale").join(nodes.select(F.col("id").alias("node_id"), "body_hash"), "node_id", "left")
    stale = F.col("body_hash_at_label").isNotNull() & ~F.col("body_hash_at_label").eqNullSafe(F.col("body_hash"))
    return joined.withColumn("is_stale", stale).drop("body_hash")


def merge_findings(old: DataFrame, current: DataFrame, resolved: DataFrame, sha: str) -> DataFrame:
    """The next snapshot.  old: project, source_file, kind, test_file, first_seen_sha, last_seen_sha,
    seen_count, resolved_sha.  current and resolved: the key.  A resolved row stays; found again, it opens a new one."""
    key = ["project", "source_file", "kind", "test"]
    keyed = lambda d: d.withColumn("test", F.coalesce("test_file", F.lit("")))
    closed, open_ = old.where("resolved_sha IS NOT NULL"), keyed(old.where("resolved_sha IS NULL"))
    now = keyed(current).select(*key, F.lit(True).alias("is_now")).distinct()
    gone = keyed(resolved).select(*key, F.lit(True).alias("is_gone")).distinct()
    merged = open_.join(gone, key, "left").withColumn("live", F.col("is_gone").isNull())
    seen = merged.join(now, key, "left").withColumn("again", F.col("live") & F.col("is_now").isNotNull())
    kept = seen.select(
        "project", "source_file", "kind", "test_file", "first_seen_sha",
        F.when(F.col("again"), F.lit(sha)).otherwise(F.col("last_seen_sha")).alias("last_seen_sha"),
        (F.col("seen_count") + F.col("again").cast("long")).alias("seen_count"),
        F.when(F.col("live"), F.lit(None).cast("string")).otherwise(F.lit(sha)).alias("resolved_sha"),
    )
    fresh = now.join(merged.where("live").select(*key), key, "left_anti").select(
        "project", "source_file", "kind", F.nullif("test", F.lit("")).alias("test_file"), F.lit(sha).alias("first_seen_sha"),
        F.lit(sha).alias("last_seen_sha"), F.lit(1).cast("long").alias("seen_count"), F.lit(None).cast("string").alias("resolved_sha"),
    )
    return closed.select(kept.columns).unionByName(kept).unionByName(fresh)


def stopword_state(feedback: DataFrame, least: int = 5) -> DataFrame:
    """Feedback: term, ordinal, kind (noise, relevant, demote).  relevant resets the noise count and demotes; noise
    promotes from ``least`` on if the term was never relevant; demote unmakes what came before it."""
    t = feedback.withColumn("term", F.lower(F.trim("term"))).where("term <> ''")
    mark = lambda k: F.max(F.when(F.col("kind") == k, F.col("ordinal")))
    last = t.groupBy("term").agg(mark("relevant").alias("last_relevant"), mark("demote").alias("last_demote"), mark("noise").alias("last_noise"), F.count(F.when(F.col("kind") == "relevant", 1)).alias("relevant_count"))
    noise = t.where("kind = 'noise'").join(last, "term").where("last_relevant IS NULL OR ordinal > last_relevant").groupBy("term").agg(F.count("*").alias("noise_count"))
    out = last.join(noise, "term", "left").fillna(0, ["noise_count"])
    again = F.col("last_demote").isNull() | (F.coalesce("last_noise", F.lit(-1)) > F.col("last_demote"))
    promoted = (F.col("noise_count") >= least) & (F.col("relevant_count") == 0) & again
    return out.where("last_noise IS NOT NULL OR relevant_count > 0").select("term", "noise_count", "relevant_count", promoted.alias("promoted"))


def active_signals(signals: DataFrame, trigger: str, threshold: int) -> DataFrame:
    """C9, C10."""
    kept = signals.where(~F.col("archived") & (F.col("weight") >= threshold) & F.col("trigger").isin(trigger, "passive"))
    return kept.orderBy(F.desc("weight"), "id")


def _substrings(rows: DataFrame, column: str, lengths: DataFrame, name: str) -> DataFrame:
    """column with each of its substrings that has one of the lengths."""
    j = rows.join(F.broadcast(lengths), F.col("length") <= F.length(column))
    starts = F.sequence(F.lit(1), F.length(column) - F.col("length") + 1)
    return j.select(column, F.explode(starts).alias("at"), "length").select(column, F.substr(F.col(column), F.col("at"), F.col("length")).alias(name)).distinct()


def _glob_pairs(patterns: DataFrame, paths: DataFrame) -> DataFrame:
    """path, file_pattern (both distinct) where the glob matches.  Candidates have the glob's longest literal run as a
    substring, by equality; only globs without a literal are held against every path."""
    runs = F.transform(F.split("file_pattern", r"[*?]"), lambda r: F.struct((-F.length(r)).alias("n"), r.alias("run")))
    keyed = patterns.withColumn("run", F.array_min(runs)["run"])
    lengths = keyed.select(F.length("run").alias("length")).where("length > 0").distinct()
    tried = _substrings(paths, "path", lengths, "run").join(keyed.where("run <> ''"), "run").select("path", "file_pattern")
    every = paths.crossJoin(keyed.where("run = ''").select("file_pattern"))
    return tried.unionByName(every).where(x.glob_matches(F.col("path"), F.col("file_pattern")))


def _distinct_ends(signals: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    return signals.select("file_pattern").where("file_pattern IS NOT NULL").distinct(), paths.select("path").where("path IS NOT NULL").distinct()


def signals_for(signals: DataFrame, paths: DataFrame) -> DataFrame:
    """Each path with all signals whose pattern names or matches it."""
    patterns, asked = _distinct_ends(signals, paths)
    lengths = asked.select(F.length("path").alias("length")).distinct()
    named = _substrings(patterns, "file_pattern", lengths, "path").join(asked, "path").select("path", "file_pattern")
    pairs = named.unionByName(_glob_pairs(patterns, asked)).distinct()
    return paths.join(pairs, "path").join(signals, "file_pattern")


def project_signals(signals: DataFrame, projects: DataFrame) -> DataFrame:
    """C11: projects: path (the project's name).  Its active signals: those whose pattern names or matches it."""
    return signals_for(signals.where(~F.col("archived")), projects.where("path <> ''"))


def pre_write_signals(signals: DataFrame, paths: DataFrame) -> DataFrame:
    """Each file with its active pre-write signals; one without a pattern is for every file."""
    active, files = signals.where(~F.col("archived") & (F.col("trigger") == "pre_write")), paths.where("path <> ''")
    scoped, unscoped = active.where("file_pattern <> ''"), active.where("file_pattern IS NULL OR file_pattern = ''")
    found = files.join(_glob_pairs(*_distinct_ends(scoped, files)), "path").join(scoped, "file_pattern")
    return found.unionByName(files.crossJoin(unscoped).select(found.columns))


def stale_signals(signals: DataFrame, now: str, months: int = 6, below: int = 30) -> DataFrame:
    """Weak and not touched for so many months of 30 days."""
    cutoff = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {months * 30} DAYS")
    return signals.where(~F.col("archived") & (F.col("weight") < below) & (F.col("updated_at") < cutoff))


def similar_pairs(signals: DataFrame, least: float = 0.5) -> DataFrame:
    """U < v of one type that share a pattern, or whose labels' words are alike.  Pairs come from shared words."""
    w = signals.select("id", "type", "file_pattern", x.label_words(F.col("label")).alias("words"))
    by_word = w.select("id", "type", F.explode("words").alias("word"))
    pair = lambda d, on: d.alias("a").join(d.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on] + [F.col("a.id") < F.col("b.id")])
    tried = pair(by_word, ["type", "word"]).select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct()
    left, right = (w.select(F.col("id").alias(k), F.col("words").alias(f"{k}_words")) for k in ("u", "v"))
    alike = tried.join(left, "u").join(right, "v").where(x.jaccard(F.col("u_words"), F.col("v_words")) >= least).select("u", "v")
    same = pair(w.where("file_pattern IS NOT NULL").select("id", "type", "file_pattern"), ["type", "file_pattern"])
    return alike.unionByName(same.select(F.col("a.id").alias("u"), F.col("b.id").alias("v"))).distinct()


def clusters(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """Id, cluster (its smallest id), of ids that have a pair.  Labels spread and jump until nothing changes."""
    both = cut(pairs.select("u", "v").union(pairs.select("v", "u")))
    state = cut(both.select(F.col("u").alias("id")).distinct().withColumn("cluster", F.col("id")))
    for _ in range(rounds):
        near = both.join(state.select(F.col("id").alias("v"), "cluster"), "v").groupBy(F.col("u").alias("id")).agg(F.min("cluster").alias("low"))
        low = state.join(near, "id").select("id", F.least("cluster", "low").alias("cluster"))
        jump = low.select(F.col("id").alias("cluster"), F.col("cluster").alias("root"))
        following = cut(low.join(jump, "cluster").select("id", F.col("root").alias("cluster")))
        changed = following.join(state.withColumnRenamed("cluster", "old"), "id").where("cluster <> old").limit(1).count()
        state = following
        if not changed:
            return state
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def consolidate(signals: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per cluster: longest label, greatest weight with its polarity and type, descriptions joined."""
    j = signals.join(groups, "id")
    lead = F.struct("weight", -F.col("id"))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "description"))), lambda p: p["description"]), " | ")
    return j.groupBy("cluster").agg(
        F.count("*").alias("n"), F.max_by("label", F.struct(F.length("label"), -F.col("id"))).alias("label"), F.max("weight").alias("weight"),
        F.max_by("polarity", lead).alias("polarity"), F.max_by("type", lead).alias("type"), texts.alias("description"),
    )


def finding(rows: DataFrame, check: str, severity: str, message: Column, file: Column, line: Column | None = None) -> DataFrame:
    line = F.lit(None) if line is None else line
    return rows.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), message.alias("message"), file.alias("file"), line.cast("int").alias("line"))


def audit_edge_types(edges: DataFrame, types: DataFrame) -> DataFrame:
    """O1, D9, H5."""
    missing = edges.select("type").distinct().join(types.select(F.col("name").alias("type")), "type", "left_anti")
    return finding(missing, "edge_types", "error", F.concat(F.lit("unregistered edge type "), "type"), F.lit(None).cast("string"))


def audit_annotations(annotations: DataFrame, nodes: DataFrame) -> DataFrame:
    """O2, D8, C6."""
    lost = annotations.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti")
    return finding(lost, "annotations", "error", F.concat(F.lit("annotation of missing node "), F.col("node_id").cast("string")), F.lit(None).cast("string"))


def audit_documents(edges: DataFrame, nodes: DataFrame, existing: DataFrame) -> DataFrame:
    """Documentary and informational edges to files that are gone."""
    target = nodes.select(F.col("id").alias("target_id"), F.col("file").alias("target_file"), F.col("line").alias("target_line"))
    doc = edges.where(F.col("category").isin("documentary", "informational")).join(target, "target_id")
    lost = doc.join(existing.select(F.col("file").alias("target_file")).distinct(), "target_file", "left_anti")
    return finding(lost, "documents", "error", F.concat(F.lit("points to missing file "), "target_file"), F.col("target_file"), F.col("target_line"))


def audit_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge; two ends in one column make it a hash join."""
    ends = edges.select(F.col("source_id").alias("id")).union(edges.select(F.col("target_id").alias("id"))).distinct()
    return finding(nodes.join(ends, "id", "left_anti"), "orphans", "warning", F.concat(F.lit("no edges: "), "name"), F.col("file"), F.col("line"))


def audit_hashes(current: DataFrame, known: DataFrame) -> DataFrame:
    """O5, D21."""
    w = worklist(current, known).where(F.col("status").isin("missing", "changed"))
    return finding(w, "hashes", "warning", F.when(F.col("status") == "missing", "file gone").otherwise("content changed"), F.col("file"))


def audit_sections(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Document sections whose documentary target's file has no node of its own but stubs."""
    doc = nodes.where("type = 'doc_section'").select(F.col("id").alias("source_id"), F.col("file").alias("doc_file"), F.col("line").alias("doc_line"))
    target = nodes.select(F.col("id").alias("target_id"), "project", "file")
    known = nodes.where("type <> 'stub'").select("project", "file").distinct()
    lost = edges.where("category = 'documentary'").join(doc, "source_id").join(target, "target_id").join(known, ["project", "file"], "left_anti")
    return finding(lost, "sections", "warning", F.concat(F.lit("describes unknown file "), "file"), F.col("doc_file"), F.col("doc_line"))


def audit(parts: list[DataFrame]) -> DataFrame:
    """Errors first."""
    return reduce(DataFrame.unionByName, parts).orderBy("severity", "check", "file", "line", "message")


# Names of databases, secrets and configuration (N1), and the levels of categories.
POLICY = {
    "database_files": r"\.(db|sqlite|sqlite3)(\.|$)|\.db-(wal|shm)$",
    "secret_files": r"^.*\.(env|key|pem|secret)$|^\.env(\.|$)|^(credentials|secrets)\.json$",
    "config_files": r"^(config\.json|caddyfile|docker-compose\.ya?ml)$|\.config\.(js|ts|cjs|mjs)$",
}
POLICY_LEVELS = {
    "database_files": "block", "secret_files": "block", "config_files": "warn", "high_blast_radius": "warn", "generated_files": "ask",
    "documented_files": "inform",
}


def policy(files: DataFrame, levels: dict[str, str] = POLICY_LEVELS, least_radius: int = 5) -> DataFrame:
    """Files: file, radius (may be null), generated, documented.  Categories, and the highest level of any."""
    from ..schemas import LEVELS

    name = F.lower(x.basename(F.col("file")))
    tests = {c: name.rlike(p) for c, p in POLICY.items()}
    tests |= {"high_blast_radius": F.coalesce("radius", F.lit(0)) >= least_radius, "generated_files": F.col("generated"), "documented_files": F.col("documented")}
    found = F.array_compact(F.array(*[F.when(t, F.lit(c)) for c, t in tests.items()]))
    rank = F.greatest(*[F.when(t, F.lit(LEVELS.index(levels[c]))).otherwise(F.lit(0)) for c, t in tests.items()])
    level = F.get(F.array(*[F.lit(v) for v in LEVELS]), rank)
    out = files.withColumns({"categories": found, "level": level}).where(F.size("categories") > 0)
    return out.select("file", F.array_join("categories", ",").alias("categories"), "level")


def test_pairs(sources: DataFrame, existing: DataFrame, annotated: DataFrame) -> DataFrame:
    """Sources: file, candidates (ordered).  annotated: test_file, file.  A source's tests are those that name
    it, else its first candidate that there is."""
    named = annotated.select("file", "test_file")
    tries = sources.join(named.select("file").distinct(), "file", "left_anti").select("file", F.posexplode("candidates").alias("k", "test_file"))
    first = tries.join(existing.select(F.col("file").alias("test_file")).distinct(), "test_file").groupBy("file").agg(F.min_by("test_file", "k").alias("test_file"))
    return named.join(sources.select("file"), "file", "left_semi").unionByName(first)


def stale_pairs(pairs: DataFrame, changed: DataFrame) -> DataFrame:
    """Q2: changed sources whose test is unchanged, and changed sources without a test."""
    c = changed.select("file").distinct()
    paired = pairs.join(c, "file", "left_semi")
    stale = paired.join(c.withColumnRenamed("file", "test_file"), "test_file", "left_anti").select("file", "test_file", F.lit("stale_pair").alias("kind"))
    missing = c.join(pairs, "file", "left_anti").select("file", F.lit(None).cast("string").alias("test_file"), F.lit("missing_test").alias("kind"))
    return stale.unionByName(missing)


def outdated_pairs(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """Q3: pairs whose source is newer than the test."""
    times = hashes.select("file", "updated_at")
    test = times.select(F.col("file").alias("test_file"), F.col("updated_at").alias("test_at"))
    return pairs.join(times, "file").join(test, "test_file").where("updated_at > test_at").select("file", "test_file")


def overlaps(touched: DataFrame, implements: DataFrame) -> DataFrame:
    """Touched: path, doc, first, last (line range, null for all).  Paths that documents which do
    not implement one another share; soft if all have ranges that are apart, in order of start, else hard."""
    docs = touched.select("path", "doc").distinct()
    pair = docs.alias("a").join(docs.alias("b"), (F.col("a.path") == F.col("b.path")) & (F.col("a.doc") < F.col("b.doc")))
    pair = pair.select(F.col("a.path").alias("path"), F.col("a.doc").alias("u"), F.col("b.doc").alias("v"))
    related = implements.select(F.least("doc", "target").alias("u"), F.greatest("doc", "target").alias("v")).distinct()
    clash = pair.join(related, ["u", "v"], "left_anti").select("path").distinct()
    order = Window.partitionBy("path").orderBy(F.col("first").asc_nulls_first(), "last", "doc")
    apart = F.col("first").isNotNull() & F.coalesce(F.lag("last").over(order) < F.col("first"), F.lit(True))
    found = touched.join(clash, "path", "left_semi").withColumn("apart", apart).groupBy("path")
    return found.agg(F.countDistinct("doc").alias("docs"), F.when(F.bool_and("apart"), "soft").otherwise("hard").alias("severity"))


def dangling(subscribes: DataFrame, emits: DataFrame) -> DataFrame:
    """Events that someone waits for and no one emits, with the documents that do."""
    lost = subscribes.join(emits.select("name").distinct(), "name", "left_anti")
    return lost.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("doc")), ",").alias("docs"))


def double_emits(emits: DataFrame) -> DataFrame:
    """P6."""
    found = emits.select("name", "from_file", "doc").distinct().groupBy("name", "from_file")
    return found.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("doc")), ",").alias("docs")).where("n > 1")


# Order of a document's states.
STATES = ["draft", "approved", "implementing", "implemented", "archived"]


def dependency_issues(docs: DataFrame, depends: DataFrame) -> DataFrame:
    """A dependency that is missing (warning) or behind the document that needs it (info)."""
    rank = lambda c: reduce(lambda w, k: w.when(F.col(c) == STATES[k], k), range(len(STATES)), F).otherwise(-1)
    own = docs.select("doc", rank("status").alias("own_rank"))
    target = docs.select(F.col("doc").alias("target"), rank("status").alias("target_rank"))
    j = depends.join(own, "doc").join(target, "target", "left")
    issue = F.when(F.col("target_rank").isNull(), "missing").when(F.col("target_rank") < F.col("own_rank"), "behind")
    severity = F.when(F.col("target_rank").isNull(), "warning").otherwise("info")
    return j.select("doc", "target", issue.alias("issue"), severity.alias("severity")).where("issue IS NOT NULL")


def chunk_ranges(rows: DataFrame, heading: str, terminal: str) -> DataFrame:
    """Rows: file, line_no, text.  From each heading to the line before the next heading or terminal heading."""
    marks = rows.withColumns({"is_head": F.col("text").rlike(heading), "is_end": F.col("text").rlike(terminal)})
    total = rows.groupBy("file").agg(F.max("line_no").alias("total"))
    order = Window.partitionBy("file").orderBy("line_no")
    cuts = marks.where("is_head OR is_end").join(total, "file").withColumn("end_line", F.coalesce(F.lead("line_no").over(order) - 1, F.col("total")))
    n = F.row_number().over(Window.partitionBy("file").orderBy("line_no"))
    return cuts.where("is_head").withColumn("n", n).select("file", "n", F.col("line_no").alias("start_line"), "end_line", "text")
