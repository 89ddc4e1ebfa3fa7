"""Specification documents: front matter, its checks, collisions, chunks, payloads."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import SPEC
from . import lifecycle as c

# Document types, states and modes.
DOC_TYPES = ["spec", "plan"]
MODES = ["create", "modify", "delete"]
REQUIRED = ["id", "doc_type", "date", "status", "feature_area"]


def render_template(doc_type: str) -> str:
    """P1."""
    if doc_type not in DOC_TYPES:
        raise ValueError(f"unknown document type {doc_type}")
    return (
        f"---\nid: \ndoc_type: {doc_type}\ndate: \nstatus: draft\nfeature_area: \n" + ("implements: \n" if doc_type == "plan" else "")
        + "touches:\n  files: []\n  schema: []\n  events:\n    emits: []\n    subscribes: []\ndepends_on: []\n---\n"
    )


class YamlError(ValueError):
    pass


def parse_yaml(text: str):
    """Maps, lists and plain or quoted strings by indentation; comments; [] and {} in line.  All leaves are strings or
    null."""
    lines = []
    for raw in text.split("\n"):
        body = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if "\t" in raw[: len(raw) - len(raw.lstrip())]:
            raise YamlError("tab in indentation")
        if body.strip():
            lines.append((len(body) - len(body.lstrip()), body.strip()))

    def scalar(s: str):
        s = s.strip()
        if s in ("", "null", "~"):
            return None
        if s == "[]":
            return []
        if s == "{}":
            return {}
        if len(s) > 1 and s[0] == s[-1] and s[0] in "'\"":
            return s[1:-1]
        if s.startswith("[") and s.endswith("]"):
            return [scalar(p) for p in s[1:-1].split(",")]
        return s

    def block(at: int, indent: int):
        if lines[at][1].startswith("- ") or lines[at][1] == "-":
            out: list = []
            while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("-"):
                item = lines[at][1][1:].strip()
                inner = indent + 2
                if re.match(r"^[\w.-]+:(\s|$)", item):
                    lines[at] = (inner, item)
                    value, at = block(at, inner)
                else:
                    value, at = scalar(item), at + 1
                out.append(value)
            return out, at
        found: dict = {}
        while at < len(lines) and lines[at][0] == indent:
            m = re.match(r"^([\w.-]+):(?:\s+(.*))?$", lines[at][1])
            if not m:
                raise YamlError(f"no key in {lines[at][1]!r}")
            at += 1
            if m[2] is None and at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("-"))):
                found[m[1]], at = block(at, lines[at][0])
            else:
                found[m[1]] = scalar(m[2] or "")
        if at < len(lines) and lines[at][0] > indent:
            raise YamlError(f"unexpected indentation at {lines[at][1]!r}")
        return found, at

    if not lines:
        return {}
    value, at = block(0, lines[0][0])
    if at != len(lines):
        raise YamlError(f"unexpected {lines[at][1]!r}")
    return value


def front_matter(text: str) -> tuple[str | None, str | None]:
    """(JSON, None), or (null, code of what is wrong)."""
    if not text.startswith("---\n"):
        return None, "HEADERLESS"
    end = text.find("\n---", 4)
    if end < 0:
        return None, "UNTERMINATED"
    try:
        found = parse_yaml(text[4:end])
    except (YamlError, IndexError):
        return None, "YAML_ERROR"
    return (json.dumps(found), None) if isinstance(found, dict) else (None, "YAML_ERROR")


def parse_specs(files: DataFrame) -> DataFrame:
    """Files: file, content.  file, code (null where it can be read) and spec, the nested document."""

    @F.pandas_udf("json string, code string")
    def parse(texts):
        import pandas as pd

        return pd.DataFrame([front_matter(t or "") for t in texts], columns=["json", "code"])

    parsed = files.select("file", parse("content").alias("p"))
    return parsed.select("file", F.col("p.code").alias("code"), F.from_json("p.json", SPEC).alias("spec"), F.col("p.json").alias("json"))


def validate(specs: DataFrame) -> DataFrame:
    """File, code, message: one filter per rule."""
    ok = specs.where("code IS NULL")
    s = lambda p: F.col(f"spec.{p}")

    def issue(rows: DataFrame, code: str, message) -> DataFrame:
        return rows.select("file", F.lit(code).alias("code"), message.alias("message"))

    checks = [issue(specs.where("code IS NOT NULL"), "", F.lit("")).select("file", F.lit("").alias("code"), "message").where("false")]
    checks.append(specs.where("code IS NOT NULL").select("file", "code", F.lit("front matter").alias("message")))
    checks += [issue(ok.where(s(f).isNull()), "MISSING_FIELD", F.lit(f)) for f in REQUIRED]
    checks.append(issue(ok.where(~s("doc_type").isin(DOC_TYPES)), "INVALID_ENUM", F.lit("doc_type")))
    checks.append(issue(ok.where(~s("status").isin(c.STATES)), "INVALID_ENUM", F.lit("status")))
    checks.append(issue(ok.where(s("date").isNotNull() & (~s("date").rlike(r"^\d{4}-\d{2}-\d{2}$") | F.try_to_date(s("date")).isNull())), "INVALID_DATE", s("date")))
    checks.append(issue(ok.where(s("id").isNotNull() & ~s("id").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$")), "INVALID_ID", s("id")))
    typed = F.get_json_object("json", "$.touches")
    checks.append(issue(ok.where(typed.isNotNull() & ~typed.startswith("{")), "INVALID_TYPE", F.lit("touches")))
    checks += [issue(ok.where(s(f"touches.{f}").isNull()), "MISSING_ARRAY", F.lit(f"touches.{f}")) for f in ("files", "schema")]
    each = ok.select("file", F.explode("spec.touches.files").alias("f"))
    checks.append(issue(each.where("f.path IS NULL"), "MISSING_ITEM_FIELD", F.lit("touches.files.path")))
    checks.append(issue(each.where(F.col("f.mode").isNotNull() & ~F.col("f.mode").isin(MODES)), "INVALID_ENUM", F.col("f.mode")))
    checks.append(issue(each.where(F.col("f.source_lines").isNotNull() & ~F.col("f.source_lines").rlike(r"^L?\d+(-L?\d+)?$")), "INVALID_LINE_REF", F.col("f.source_lines")))
    emits = ok.select("file", F.explode("spec.touches.events.emits").alias("e"), F.col("spec.touches.files.path").alias("paths"))
    checks.append(issue(emits.where("e.name IS NULL"), "MISSING_ITEM_FIELD", F.lit("emits.name")))
    listed = F.coalesce(F.array_contains("paths", F.col("e.from_file")), F.lit(False))
    checks.append(issue(emits.where(F.col("e.from_file").isNotNull() & ~listed), "EMIT_FILE_NOT_LISTED", F.col("e.from_file")))
    return reduce(DataFrame.unionByName, checks)


def collisions(specs: DataFrame, known_events: DataFrame | None = None) -> DataFrame:
    """Check, subject, severity, detail over all documents."""
    from ..functions.text import line_range

    d = specs.where("code IS NULL").select(F.col("spec.id").alias("doc"), "spec")
    implements = d.select("doc", F.col("spec.implements").alias("target")).where("target IS NOT NULL")
    files = d.select("doc", F.explode("spec.touches.files").alias("f"))
    first, last = line_range(F.col("f.source_lines"))
    touched = files.select(F.col("f.path").alias("path"), "doc", first.alias("first"), last.alias("last"))
    none = F.lit(None).cast("int")
    tables = d.select("doc", F.explode("spec.touches.schema").alias("t")).select(F.col("t.table").alias("path"), "doc", none.alias("first"), none.alias("last"))
    emits = d.select("doc", F.explode("spec.touches.events.emits").alias("e")).select(F.col("e.name").alias("name"), F.col("e.from_file").alias("from_file"), "doc")
    waits = d.select("doc", F.explode("spec.touches.events.subscribes").alias("e")).select(F.col("e.name").alias("name"), "doc")
    known = emits.select("name") if known_events is None else emits.select("name").union(known_events.select("name"))
    depends = d.select("doc", F.explode("spec.depends_on").alias("x")).select("doc", F.col("x.doc").alias("target"))
    row = lambda rows, check, subject, severity, detail: rows.select(F.lit(check).alias("check"), subject.alias("subject"), severity.alias("severity"), detail.alias("detail"))
    n = F.col("docs").cast("string")
    parts = [
        row(c.overlaps(touched, implements), "file", F.col("path"), F.col("severity"), n),
        row(c.overlaps(tables, implements), "schema", F.col("path"), F.lit("hard"), n),
        row(c.dangling(waits, known), "subscribe", F.col("name"), F.lit("warning"), F.col("docs")),
        row(c.double_emits(emits), "emit", F.col("name"), F.lit("hard"), F.col("docs")),
        row(c.dependency_issues(d.select("doc", F.col("spec.status").alias("status")), depends), "dependency", F.col("doc"), F.col("severity"), F.concat_ws(" ", "issue", "target")),
    ]
    return reduce(DataFrame.unionByName, parts)


def exit_code(issues: list) -> int:
    """1 if anything is hard or an error."""
    return int(any(i["severity"] in ("hard", "error") for i in issues))


def chunk_texts(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """The text of each chunk: file, n, body."""
    inside = lines.join(ranges.select("file", "n", "start_line", "end_line"), "file").where("line_no BETWEEN start_line AND end_line")
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "text")))
    return inside.groupBy("file", "n").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("body"))


def created_files(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """File, n, path: what chunk n finds created by the chunks before it."""
    path = F.regexp_extract("text", r"^\s*-\s*Create:\s*`([^`]+)`", 1)
    made = lines.withColumn("path", path).where("path <> ''").join(ranges.select("file", F.col("n").alias("by"), "start_line", "end_line"), "file")
    made = made.where("line_no BETWEEN start_line AND end_line").select("file", "by", "path")
    return ranges.select("file", "n").join(made, "file").where("by < n").select("file", "n", "path").distinct()


def payloads(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """File, n, payload: what stands before the first chunk, what was created before, and the chunk."""
    first = ranges.groupBy("file").agg(F.min("start_line").alias("first"))
    head = lines.join(first, "file").where("line_no < first").groupBy("file")
    head = head.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("header"))
    prior = created_files(lines, ranges).groupBy("file", "n").agg(F.concat(F.lit("Created before:\n"), F.array_join(F.array_sort(F.collect_set("path")), "\n")).alias("prior"))
    return chunk_texts(lines, ranges).join(head, "file", "left").join(prior, ["file", "n"], "left").select("file", "n", F.concat_ws("\n\n", "header", "prior", "body").alias("payload"))
