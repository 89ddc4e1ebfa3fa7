"""Session logs: windows, files, decisions, transcripts, recent activity.

rows: session_id, ln (from 1), ts, kind (boundary, explore, write, user or other), file, text, tool.  All of it is window
logic on one partitioning by session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as x
from .search import top_terms


def with_windows(rows: DataFrame) -> DataFrame:
    """with seq, the number of boundaries strictly before; a boundary belongs to the window that it closes."""
    before = Window.partitionBy("session_id").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("seq", F.coalesce(F.sum((F.col("kind") == "boundary").cast("int")).over(before), F.lit(0)).cast("int"))


def windows(rows: DataFrame) -> DataFrame:
    """F1-F3, DM4: start and end line and time of each window, and what opened it.  A window ends with its boundary's own
    time, the last one with its last; the first starts with the session's first time."""
    end = F.coalesce(F.max(F.when(F.col("kind") == "boundary", F.col("ts"))), F.max("ts"))
    w = with_windows(rows).groupBy("session_id", "seq").agg(
        F.min("ln").alias("start_line"), F.max("ln").alias("end_line"), F.min("ts").alias("start_time"), end.alias("end_time")
    )
    return w.withColumn("boundary_type", F.when(F.col("seq") == 0, "session_start").otherwise("compact"))


def window_files(rows: DataFrame) -> DataFrame:
    """Each file that a window touches, the last tool that did, and the line of first touch."""
    touched = with_windows(rows).where(F.col("kind").isin("explore", "write") & F.col("file").isNotNull())
    return touched.groupBy("session_id", "seq", "file").agg(F.max_by("tool", "ln").alias("tool"), F.min("ln").alias("first_line"))


def decisions(rows: DataFrame) -> DataFrame:
    """A write closes a block if the last explore or write before it in the window was an explore.  Blocks that
    are closed, and the last one if its users said a term, are decisions: decided if they wrote, else parked."""
    acts = F.col("kind").isin("explore", "write") & F.col("file").isNotNull()
    order = Window.partitionBy("session_id", "seq").orderBy("ln")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    w = with_windows(rows).withColumn("last_act", F.last(F.when(acts, F.col("kind")), ignorenulls=True).over(before))
    w = w.withColumn("closes", acts & (F.col("kind") == "write") & F.coalesce(F.col("last_act") == "explore", F.lit(False)))
    w = w.withColumn("block", F.coalesce(F.sum(F.col("closes").cast("int")).over(before), F.lit(0)).cast("int"))
    keys = ["session_id", "seq", "block"]
    said = w.where((F.col("kind") == "user") & (F.trim("text") != ""))
    terms = top_terms(said, keys).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda t: t["term"]).alias("terms"))
    writes = F.sort_array(F.collect_list(F.when(acts & (F.col("kind") == "write"), F.struct("ln", "file"))))
    blocks = w.groupBy(*keys).agg(
        F.min("ln").alias("start_line"), F.max("ln").alias("end_line"), F.max("closes").alias("closed"), F.transform(writes, lambda f: f["file"]).alias("anchors")
    )
    out = blocks.join(terms, keys, "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    out = out.where(F.col("closed") | (F.size("terms") > 0))
    return out.select(
        *keys,
        "start_line",
        "end_line",
        "terms",
        "anchors",
        F.when(F.size("anchors") > 0, "decided").otherwise("parked").alias("status"),
        decision_summary(F.col("terms"), F.col("anchors")).alias("summary"),
    )


def decision_summary(terms: Column, anchors: Column) -> Column:
    """Four terms, a dash, the files' names once each."""
    said = F.array_join(F.slice(terms, 1, 4), ", ")
    names = F.array_join(F.array_distinct(F.transform(anchors, x.basename)), ", ")
    alone = F.when(said == "", "(discussion)").otherwise(said)
    return F.when(F.size(anchors) == 0, alone).otherwise(F.concat(F.when(said == "", "").otherwise(F.concat(said, F.lit(" — "))), names))


# What a message begins with that no one said (C17), and tags that are cut from messages.
NOT_SAID = (
    "[Request interrupted", "<command-name>", "<local-command", "Caveat:", "This session is being continued", "<task-notification>", "Stop hook",
    "<system-reminder>",
)
CUT_TAGS = ("system-reminder", "command-message", "command-name", "command-args", "local-command-stdout", "ide_selection")


def cleaned(text: Column) -> Column:
    """I17."""
    for tag in CUT_TAGS:
        text = F.regexp_replace(text, rf"(?s)<{tag}>.*?</{tag}>", "")
    return F.trim(text)


def conversational(text: Column) -> Column:
    """C17."""
    out = F.length(F.trim(text)) > 0
    for prefix in NOT_SAID:
        out &= ~text.startswith(prefix)
    return out


def compact_transcript(messages: DataFrame) -> DataFrame:
    """Messages: session_id, ln, side, text.  Each user message, and of the assistant's up to the next the first
    in full and the rest as a count with first and last line."""
    order = Window.partitionBy("session_id").orderBy("ln")
    said = messages.where(F.col("side").isin("user", "assistant") & conversational(cleaned(F.col("text"))))
    turn = F.sum((F.col("side") == "user").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    within = Window.partitionBy("session_id", "turn_no", "side").orderBy("ln")
    numbered = said.withColumn("turn_no", turn.cast("int")).withColumn("k", F.row_number().over(within))
    rest = (F.col("side") == "assistant") & (F.col("k") > 1)
    return numbered.groupBy("session_id", "turn_no").agg(
        F.max(F.when(F.col("side") == "user", F.col("ln"))).alias("user_ln"),
        F.min(F.when((F.col("side") == "assistant") & (F.col("k") == 1), F.col("ln"))).alias("assistant_ln"),
        F.count(F.when(rest, 1)).alias("more"),
        F.min(F.when(rest, F.col("ln"))).alias("more_first"),
        F.max(F.when(rest, F.col("ln"))).alias("more_last"),
    )


def merge_chunks(messages: DataFrame, request: str) -> DataFrame:
    """Chunks of one request become one message: texts joined by blank lines in order, with the last line number."""
    parts = F.sort_array(F.collect_list(F.struct("ln", "text")))
    texts = F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n")
    return messages.groupBy("session_id", request).agg(F.min("ln").alias("first_ln"), F.max("ln").alias("ln"), texts.alias("text")).where("text <> ''")


def sessions(rows: DataFrame) -> DataFrame:
    """First and last time of each session."""
    return rows.groupBy("session_id").agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count("*").alias("n_lines"))


def recent(found: DataFrame, n: int = 10) -> DataFrame:
    """The newest by start."""
    return found.orderBy(F.desc("start_time"), "session_id").limit(max(1, n))


def recent_per_project(found: DataFrame, n: int = 3) -> DataFrame:
    """Found: session_id, projects, end_time.  The n newest of each project."""
    each = found.select("session_id", "end_time", F.explode(F.array_distinct("projects")).alias("project"))
    order = Window.partitionBy("project").orderBy(F.desc("end_time"), "session_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def touches(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """Paths that have a project's name as a segment, with the path below it.  Segments are joined by equality, so
    that no pair is tried that does not match."""
    segments = F.split("file_path", "/")
    each = paths.select("*", F.posexplode(segments).alias("k", "project")).where((F.col("k") > 0) & (F.col("k") < F.size(segments) - 1))
    rest = F.array_join(F.slice(segments, F.col("k") + 2, F.size(segments)), "/")
    return each.join(projects.select("project").distinct(), "project").select(*paths.columns, "project", rest.alias("relative"))


def window_slice(rows: DataFrame, first: int, last: int) -> DataFrame:
    """K9: lines first to last of each window, counted within it."""
    w = with_windows(rows)
    start = F.min("ln").over(Window.partitionBy("session_id", "seq"))
    return w.withColumn("pos", F.col("ln") - start + 1).where(F.col("pos").between(first, last))
