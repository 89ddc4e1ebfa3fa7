"""File sources and sinks."""

from __future__ import annotations

import json
import os
import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as x

# Files that mark a project, endings of code and of text.
MARKERS = ("package.json", "go.mod", "setup.py", "Cargo.toml", "pubspec.yaml")
CODE = ("js", "mjs", "cjs", "ts", "tsx", "py", "md", "svelte")
TEXT = (*CODE, "json", "yaml", "yml", "toml", "html", "css", "sql", "sh", "txt", "go", "rs", "java", "c", "h", "cpp", "rb", "php")


def read_tree(spark: SparkSession, root: str, project: str, extensions: tuple[str, ...] = CODE, rules: list[str] = tuple(x.BUILTIN_IGNORES)) -> DataFrame:
    """A1, A2, DM2: project, file (relative), content, modified_at.  Excluded files are dropped by path, before any is read."""
    base = re.sub(r"^file:/*", "/", root.rstrip("/"))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.substring(F.regexp_replace("path", "^[a-z]+:/*", "/"), len(base) + 2, 1 << 30)
    kept = raw.select("*", relative.alias("file")).where(F.regexp_extract(F.col("file"), r"\.([A-Za-z0-9]+)$", 1).isin(list(extensions)) & ~x.excluded(F.col("file"), list(rules)))
    return kept.select(F.lit(project).alias("project"), "file", F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified_at"))


def discover_projects(listing: DataFrame) -> DataFrame:
    """A4: listing: file.  Folders that hold a marker file."""
    parts = F.split("file", "/")
    return listing.where((F.size(parts) == 2) & F.get(parts, F.lit(1)).isin(list(MARKERS))).select(F.get(parts, F.lit(0)).alias("project")).distinct()


def watched_name(path: str) -> str:
    """A5: of a watched folder: its last two segments."""
    return "-".join([p for p in path.split("/") if p][-2:])


def ignore_rules(root: str, own: str = ".kgraphignore", gitignore: bool = False, extra: list[str] = ()) -> list[str]:
    """Built-in rules, nested .gitignore files anchored where they lie, the tree's own file, extra ones."""

    def lines(path: Path) -> list[str]:
        return [t for raw in path.read_text().splitlines() if (t := raw.strip()) and not t.startswith("#")] if path.exists() else []

    rules = list(x.BUILTIN_IGNORES)
    if gitignore:
        skip = {r.rstrip("/") for r in rules if r.endswith("/")}
        for folder, names, files in os.walk(root):
            names[:] = sorted(n for n in names if n not in skip)
            if ".gitignore" in files:
                rules += [anchored(r, os.path.relpath(folder, root)) for r in lines(Path(folder, ".gitignore"))]
    return rules + lines(Path(root, own)) + list(extra)


def anchored(rule: str, folder: str) -> str:
    """I8."""
    if folder == ".":
        return rule
    mark, body = ("!", rule[1:]) if rule.startswith("!") else ("", rule)
    inner = body.rstrip("/")
    return mark + (f"{folder}{body}" if body.startswith("/") else f"{folder}/{body}" if "/" in inner else f"{folder}/**/{body}")


def policy_hash(rules: list[str]) -> str:
    """I5."""
    import hashlib

    return hashlib.sha256(json.dumps(rules, sort_keys=True).encode()).hexdigest()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A6, DM3: file, ln (from 1), line: whole files are read so that line numbers are theirs."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\n")).alias("k", "line")).select("file", (F.col("k") + 1).cast("long").alias("ln"), "line").where(F.trim("line") != "")


EVENT = (
    "type string, subtype string, timestamp string, session_id string, cwd string, name string, input struct<file_path:string,path:string>, "
    "message struct<role:string,content:string>, compactMetadata struct<trigger:string>, requestId string, uuid string"
)
BLOCKS = "array<struct<type:string,text:string,name:string,input:struct<file_path:string,path:string>>>"


def session_rows(lines: DataFrame) -> DataFrame:
    """Lines of session logs as rows of operators.sessions; malformed lines have a null type and are
    left out.  Tools within an assistant's message come as rows of their own at the message's line."""
    e = lines.withColumn("e", F.from_json("line", EVENT)).where("e.type IS NOT NULL")
    blocks = F.from_json("e.message.content", BLOCKS)
    said = F.filter(blocks, lambda b: b["type"] == "text")
    text = F.when(F.startswith(F.ltrim("e.message.content"), F.lit("[")), F.array_join(F.transform(said, lambda b: b["text"]), " ")).otherwise(F.col("e.message.content"))
    e = e.withColumns({"text": text, "tools": F.filter(blocks, lambda b: b["type"] == "tool_use")})
    session = F.coalesce(F.max("e.session_id").over(Window.partitionBy("file")), x.basename(F.col("file")))
    e = e.withColumn("session_id", session)

    def kind(tool, event, subtype):
        explore, write = tool.isin("Read", "Grep", "Glob", "Bash"), tool.isin("Write", "Edit")
        boundary = (event == "system") & (subtype == "compact_boundary")
        return F.when(explore, "explore").when(write, "write").when(boundary, "boundary").when(event.isin("user", "human"), "user").otherwise(event)

    path = lambda c: F.coalesce(c["file_path"], c["path"])
    top = e.select("session_id", "ln", F.col("e.timestamp").alias("ts"), kind(F.col("e.name"), F.col("e.type"), F.col("e.subtype")).alias("kind"), path(F.col("e.input")).alias("file"), "text", F.col("e.name").alias("tool"))
    nested = e.where("e.type = 'assistant'").select("session_id", "ln", F.col("e.timestamp").alias("ts"), F.explode("tools").alias("t"))
    nested = nested.select("session_id", "ln", "ts", kind(F.col("t.name"), F.lit("tool"), F.lit("")).alias("kind"), path(F.col("t.input")).alias("file"), F.lit(None).cast("string").alias("text"), F.col("t.name").alias("tool"))
    return top.unionByName(nested)


def changed_files(repo: str, since: str, until: str = "HEAD") -> list[tuple[str, str]]:
    """A10: (status, path) between two commits; a rename deletes the old name and adds the new one."""
    out = subprocess.run(["git", "-C", repo, "diff", "--name-status", "-z", since, until], capture_output=True, text=True, check=True).stdout
    return parse_name_status(out)


def parse_name_status(out: str) -> list[tuple[str, str]]:
    fields, rows = iter(out.split("\0")), []
    for status in fields:
        if not status:
            continue
        path = next(fields)
        if status[0] in "RC":
            rows += [("deleted", path), ("added", next(fields))]
        else:
            rows.append(({"A": "added", "D": "deleted"}.get(status[0], "modified"), path))
    return rows


def parse_git_log(text: str) -> list[dict]:
    """Of `git log --format=%H%x09%cI%x09%s --shortstat`."""
    rows: list[dict] = []
    for line in text.splitlines():
        parts = line.split("\t", 2)
        if len(parts) == 3 and re.fullmatch(r"[0-9a-f]{7,40}", parts[0]):
            rows.append({"sha": parts[0], "at": parts[1], "subject": parts[2], "files": 0, "insertions": 0, "deletions": 0})
        elif rows and "changed" in line:
            for key, pattern in (("files", r"(\d+) files?"), ("insertions", r"(\d+) insertion"), ("deletions", r"(\d+) deletion")):
                rows[-1][key] = int(m[1]) if (m := re.search(pattern, line)) else 0
    return rows


def add_missing(into: dict, defaults: dict, at: str = "") -> list[str]:
    """A19, DM9: puts in what is missing; lists are leaves.  Returns the dotted paths that were added."""
    added = []
    for k, v in defaults.items():
        path = f"{at}.{k}" if at else k
        if k not in into:
            into[k] = v
            added.append(path)
        elif isinstance(v, dict) and isinstance(into[k], dict):
            added += add_missing(into[k], v, path)
    return added


def write_snapshot(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces only the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_report(path: str, text: str) -> None:
    """Written beside it, then renamed."""
    temporary = Path(f"{path}.tmp")
    temporary.write_text(text)
    temporary.rename(path)
