"""Stored state as snapshots: signals and forces, test alerts, reconciliation, scan state.  Every function takes the old
rows and gives the next ones; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..schemas import SIGNAL_TYPES

# What a mention adds to a force, the greatest score and weight, and the weight of what is migrated without one.
REINFORCEMENT, MOST, UNKNOWN_WEIGHT = 5, 100, 50


def valid_signal(type: Column, weight: Column, polarity: Column, label: Column) -> Column:
    """May a signal be stored?  False, never null, for missing values."""
    ok = type.isin(SIGNAL_TYPES) & weight.between(0, MOST) & polarity.isin("+", "-") & (F.length(F.trim(label)) > 0)
    return F.coalesce(ok, F.lit(False))


def add_signals(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows and those of new (without id) that are valid, with ids after the greatest there is, in order of label,
    type, weight, then of the other columns by name: only rows that are equal throughout tie, so the same rows get the same ids.
    New rows are few against old ones: their numbering is one window."""
    kept = new.where(valid_signal(F.col("type"), F.col("weight"), F.col("polarity"), F.col("label")))
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    first = ["label", "type", "weight"]
    order = Window.orderBy(*first, *sorted(set(kept.columns) - set(first)))
    numbered = kept.crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + F.row_number().over(order)).drop("top")
    return old.unionByName(numbered, allowMissingColumns=True)


def reweigh(signals: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates: id, weight (several: the last by ordinal).  Rounded, then held within 0 and 100; archived rows stay."""
    last = updates.groupBy("id").agg(F.max_by("weight", "ordinal").alias("to"))
    to = F.least(F.lit(MOST), F.greatest(F.lit(0), F.round("to").cast("int")))
    out = signals.join(last, "id", "left").withColumn("weight", F.when(F.col("to").isNotNull() & ~F.col("archived"), to).otherwise(F.col("weight")))
    return out.select(signals.columns)


def archive(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is named become archived."""
    named = ids.select("id").distinct().withColumn("named", F.lit(True))
    return rows.join(named, "id", "left").withColumn("archived", F.col("archived") | F.coalesce("named", F.lit(False))).select(rows.columns)


def reinforce(forces: DataFrame, mentions: DataFrame) -> DataFrame:
    """Mentions: name, a row each time.  The newest active force of that name gains 5 a mention, up to 100."""
    newest = forces.where(~F.col("archived")).groupBy("name").agg(F.max("id").alias("id"))
    gain = mentions.groupBy("name").agg(F.count("*").alias("n")).join(newest, "name").select("id", "n")
    score = F.least(F.lit(MOST), F.round("score").cast("int") + REINFORCEMENT * F.coalesce("n", F.lit(0)))
    out = forces.join(gain, "id", "left")
    return out.withColumn("score", F.when(F.col("n").isNotNull(), score).otherwise(F.col("score")).cast("int")).select(forces.columns)


def seeded(signals: DataFrame, forces: DataFrame, seed_signals: DataFrame, seed_forces: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """The seeds if both tables are empty, else what there is; and whether seeds were taken."""
    empty = signals.isEmpty() and forces.isEmpty()
    return (seed_signals, seed_forces, True) if empty else (signals, forces, False)


def migrated_signals(lessons: DataFrame) -> DataFrame:
    """Rows of the older layout (polarity, initial_weight, title, summary, entry_text, correction_text, status)."""
    positive = F.coalesce(F.col("polarity") == "positive", F.lit(False))
    return lessons.where("status <> 'archived'").select(
        F.when(positive, "nucleus_accumbens").otherwise("amygdala").alias("type"),
        F.coalesce("initial_weight", F.lit(UNKNOWN_WEIGHT)).cast("int").alias("weight"),
        F.when(positive, "+").otherwise("-").alias("polarity"),
        F.coalesce(F.nullif("title", F.lit("")), F.nullif("summary", F.lit("")), F.lit("Migrated signal")).alias("label"),
        F.coalesce(F.nullif("entry_text", F.lit("")), F.nullif("correction_text", F.lit(""))).alias("description"),
        F.lit("passive").alias("trigger"),
    )


def signal_review(signals: DataFrame) -> DataFrame:
    """Of each type's active signals the count, and an estimate of their tokens: 1.3 a word, rounded up for each."""
    words = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))
    tokens = F.ceil((words("label") + words("description")) * 1.3)
    return signals.where(~F.col("archived")).groupBy("type").agg(F.count("*").alias("n"), F.sum(tokens).cast("long").alias("tokens"))


# ---- test alerts -----------------------------------------------------------------------------------------------------


def resolved_findings(open_: DataFrame, deleted: DataFrame, changed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Q4, incremental: open findings whose source is deleted, whose stale test was changed, or whose source has a test now.
    deleted, changed: file.  pairs: file, test_file."""
    gone = open_.join(deleted.select(F.col("file").alias("source_file")).distinct(), "source_file", "left_semi")
    rest = open_.join(deleted.select(F.col("file").alias("source_file")).distinct(), "source_file", "left_anti")
    touched = rest.where("kind = 'stale_pair'").join(changed.select(F.col("file").alias("test_file")).distinct(), "test_file", "left_semi")
    paired = rest.where("kind = 'missing_test'").join(pairs.select(F.col("file").alias("source_file")).distinct(), "source_file", "left_semi")
    return gone.unionByName(touched).unionByName(paired)


def audited_findings(open_: DataFrame, current: DataFrame, files: DataFrame) -> DataFrame:
    """Q4, audit: open findings that are no longer found, or whose source is no longer there."""
    key = ["source_file", "kind", "test"]
    keyed = lambda d: d.withColumn("test", F.coalesce("test_file", F.lit("")))
    there = keyed(open_).join(files.select(F.col("file").alias("source_file")).distinct().withColumn("there", F.lit(True)), "source_file", "left")
    found = there.join(keyed(current).select(key).distinct().withColumn("found", F.lit(True)), key, "left")
    return found.where("there IS NULL OR found IS NULL").select(open_.columns)


def baseline(findings: DataFrame, prior_sha: str | None, diff_ok: bool = True) -> DataFrame:
    """Q5: without an earlier commit, or without a diff from it, there are no findings: the run only sets the mark."""
    return findings if prior_sha and diff_ok else findings.where("false")


def finding_counts(findings: DataFrame, sha: str) -> DataFrame:
    """Per project: open findings, and those that this run resolved."""
    return findings.groupBy("project").agg(F.count(F.when(F.col("resolved_sha").isNull(), 1)).alias("open"), F.count(F.when(F.col("resolved_sha") == sha, 1)).alias("resolved"))


def alert_report(findings: DataFrame, sha: str) -> DataFrame:
    """Q6: rows of the report: stale pairs, missing tests, what this run resolved; each section in order of file."""
    section = F.when(F.col("resolved_sha") == sha, "resolved").when(F.col("resolved_sha").isNull(), F.when(F.col("kind") == "stale_pair", "stale").otherwise("missing"))
    line = F.concat("source_file", F.when(F.col("test_file").isNull(), "").otherwise(F.concat(F.lit(" -> "), "test_file")), F.lit(" since "), x.short_sha(F.col("first_seen_sha")))
    return findings.select("project", section.alias("section"), line.alias("line")).where("section IS NOT NULL")


def alert_snapshot(findings: DataFrame, sha: str, mode: str) -> DataFrame:
    """Q7: a row per project for the run's log: counts, and the open findings as JSON in order.  Findings of one project are one
    row's array, as the log wants it."""
    live = F.when(F.col("resolved_sha").isNull(), F.struct("source_file", "kind", F.coalesce("test_file", F.lit("")).alias("test_file"), "seen_count"))
    out = findings.groupBy("project").agg(F.sort_array(F.collect_list(live)).alias("rows"), F.count(F.when(F.col("resolved_sha") == sha, 1)).alias("resolved_count"))
    return out.select("project", F.lit(sha).alias("sha"), F.lit(mode).alias("mode"), F.to_json("rows").alias("findings_json"), F.size("rows").cast("long").alias("open_count"), "resolved_count")


# ---- reconciliation --------------------------------------------------------------------------------------------------


def reconcile(states: DataFrame, current: DataFrame, known: DataFrame, excluded: Column) -> DataFrame:
    """L4: project, file, action for every file that needs one.  states: project, root_path, root_exists.  current, known:
    project, file, hash.  Projects without a root, or whose root is gone, are skipped whole.  Files that are gone, or excluded
    and known, are purged; new and changed ones that are not excluded are extracted again."""
    ready = states.where(F.col("root_path").isNotNull() & F.col("root_exists")).select("project").distinct()
    now = current.select("project", "file", F.col("hash").alias("now"))
    then = known.select("project", "file", F.col("hash").alias("then"))
    both = now.join(then, ["project", "file"], "full_outer").join(ready, "project", "left_semi").withColumn("out", excluded)
    action = F.when(F.col("then").isNotNull() & (F.col("now").isNull() | F.col("out")), "purge").when(
        F.col("now").isNotNull() & ~F.col("out") & (F.col("then").isNull() | (F.col("now") != F.col("then"))), "extract"
    )
    return both.select("project", "file", action.alias("action")).where("action IS NOT NULL")


def reconciled_states(states: DataFrame, actions: DataFrame, head: DataFrame) -> DataFrame:
    """L4, M7: project, status, purged, reextracted, last_scan_sha.  The commit moves on (head: project, sha) only where
    something was extracted again."""
    n = lambda a: F.count(F.when(F.col("action") == a, 1))
    counts = actions.groupBy("project").agg(n("purge").alias("purged"), n("extract").alias("reextracted"))
    out = states.join(counts, "project", "left").fillna(0, ["purged", "reextracted"]).join(head, "project", "left")
    status = F.when(F.col("root_path").isNull(), "no_root").when(~F.col("root_exists"), "root_missing").when(F.col("reextracted") == 0, "skipped").otherwise("done")
    sha = F.when(F.col("reextracted") > 0, F.coalesce("sha", "last_scan_sha")).otherwise(F.col("last_scan_sha"))
    return out.select("project", status.alias("status"), "purged", "reextracted", sha.alias("last_scan_sha"))


def scan_stats(files: DataFrame, nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: files scanned and skipped (files: skipped), nodes, edges, labels, detectors that fired."""
    a = files.agg(F.count(F.when(~F.col("skipped"), 1)).alias("scanned"), F.count(F.when(F.col("skipped"), 1)).alias("skipped"))
    b, c = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    d = labels.agg(F.count("*").alias("labels"), F.countDistinct("detector_id").alias("detectors"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d)


def with_body_hashes(nodes: DataFrame, hashes: DataFrame) -> DataFrame:
    """Nodes with the body_hash that hashes (id, body_hash) has for them, others as they are."""
    new = hashes.select("id", F.col("body_hash").alias("new_hash"))
    return nodes.join(new, "id", "left").withColumn("body_hash", F.coalesce("new_hash", "body_hash")).select(nodes.columns)


# ---- sessions and paths ----------------------------------------------------------------------------------------------


def find_window(windows: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked: query, seq.  The window of the session called so, else of the first, by name, that begins so.  The exact tier is
    an equality; the other joins by the first characters, as many as a query has."""
    key = windows.select("session_id", "seq").distinct()
    exact = asked.join(key, (F.col("query") == F.col("session_id")) & (asked["seq"] == key["seq"])).select("query", asked["seq"], "session_id")
    rest = asked.join(exact.select("query", "seq"), ["query", "seq"], "left_anti").withColumn("n", F.length("query"))
    lengths = rest.select("n").distinct()
    heads = key.join(F.broadcast(lengths), F.length("session_id") >= F.col("n")).select("session_id", "seq", F.expr("left(session_id, n)").alias("query"))
    begun = rest.drop("n").join(heads, ["query", "seq"]).groupBy("query", "seq").agg(F.min("session_id").alias("session_id"))
    return exact.unionByName(begun)


def oriented(events: DataFrame) -> DataFrame:
    """session_id, project, at: the first time that a session meets a project, which is when it is told of it."""
    return events.groupBy("session_id", "project").agg(F.min("at").alias("at"))


def expired(files: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Files (path, modified_at) that are older than so many hours."""
    return files.where(F.col("modified_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS"))


def project_of(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Paths: path.  roots: project, root_path.  The project whose root is the longest folder that holds the path: every
    folder of a path is joined by equality."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    each = paths.select("path").distinct().select("path", F.explode(folders).alias("root_path"))
    return each.join(roots, "root_path").groupBy("path").agg(F.max_by("project", F.length("root_path")).alias("project"))


def grep_totals(hits: DataFrame) -> DataFrame:
    """Hits: project, file, line_no.  Matches and files of each project."""
    return hits.groupBy("project").agg(F.count("*").alias("matches"), F.countDistinct("file").alias("files"))
