import json

import pytest

from kgraph.operators import lifecycle as c
from kgraph.operators import sessions, specs
from kgraph.sources import files

DOC = """---
id: {id}
doc_type: spec
date: 2025-01-02
status: {status}
feature_area: x
touches:
  files:
    - path: a.js
      mode: modify
      source_lines: {lines}
    - path: {id}.js
  schema: []
  events:
    emits:
      - name: saved
        from_file: a.js
    subscribes:
      - name: lost  # never sent
depends_on:
  - doc: other
---
body
"""


def test_yaml():
    assert specs.parse_yaml("a: 1\nb:\n  - x: 'y'\n    z:\n  - plain\nc: [p, q]\nd: {}\n# no\n") == {"a": "1", "b": [{"x": "y", "z": None}, "plain"], "c": ["p", "q"], "d": {}}
    for bad in ("\ta: 1", "a: 1\n   b: 2", "just words"):
        with pytest.raises(specs.YamlError):
            specs.parse_yaml(bad)
    assert "implements" in specs.render_template("plan")
    with pytest.raises(ValueError):
        specs.render_template("x")


def test_specs(spark):
    docs = [("1.md", DOC.format(id="one", status="draft", lines="L1-L5")), ("2.md", DOC.format(id="two", status="approved", lines="L6")), ("3.md", "no header"), ("4.md", "---\nid: a")]
    docs += [("5.md", "---\nid: '*'\ndoc_type: poem\ndate: 2025-13-40\nstatus: draft\ntouches:\n  files:\n    - mode: burn\n      source_lines: x\n---\n"), ("6.md", "---\na\n---\n")]
    parsed = specs.parse_specs(spark.createDataFrame(docs, "file string, content string"))
    got = {(r.file, r.code) for r in specs.validate(parsed).collect()}
    assert {("3.md", "HEADERLESS"), ("4.md", "UNTERMINATED"), ("6.md", "YAML_ERROR"), ("5.md", "INVALID_ENUM"), ("5.md", "INVALID_DATE"), ("5.md", "INVALID_ID")} <= got
    assert {("5.md", "MISSING_FIELD"), ("5.md", "MISSING_ARRAY"), ("5.md", "MISSING_ITEM_FIELD"), ("5.md", "INVALID_LINE_REF")} <= got
    assert not any(f in ("1.md", "2.md") for f, _ in got)
    found = {(r.check, r.subject): r.severity for r in specs.collisions(parsed.where("file IN ('1.md', '2.md')")).collect()}
    assert found["file", "a.js"] == "soft" and found["emit", "saved"] == "hard" and found["subscribe", "lost"] == "warning" and found["dependency", "one"] == "warning"


def test_chunks(spark):
    text = "intro\n## Chunk 1\n- Create: `a.js`\n## Chunk 2\nuse it\n## End\nrest"
    lines = spark.createDataFrame([("p.md", k, t) for k, t in enumerate(text.split("\n"), 1)], "file string, line_no int, text string")
    ranges = c.chunk_ranges(lines, "^## Chunk", "^## End")
    assert [(r.n, r.start_line, r.end_line) for r in ranges.orderBy("n").collect()] == [(1, 2, 3), (2, 4, 5)]
    pay = {r.n: r.payload for r in specs.payloads(lines, ranges).collect()}
    assert pay[2] == "intro\n\nCreated before:\na.js\n\n## Chunk 2\nuse it" and "Created" not in pay[1]


def test_files(spark, tmp_path):
    (tmp_path / "p/lib").mkdir(parents=True)
    (tmp_path / "p/node_modules/q").mkdir(parents=True)
    for name, text in {"p/package.json": "{}", "p/lib/a.js": "x", "p/lib/.gitignore": "/b.js\n*.md\n!keep.md", "p/node_modules/q/i.js": "no", "p/k.pem": "no"}.items():
        (tmp_path / name).write_text(text)
    got = files.read_tree(spark, str(tmp_path / "p"), "p").collect()
    assert [(r.file, r.content) for r in got] == [("lib/a.js", "x")]
    rules = files.ignore_rules(str(tmp_path / "p"), gitignore=True)
    assert rules[-3:] == ["lib/b.js", "lib/**/*.md", "!lib/**/keep.md"]
    listing = spark.createDataFrame([("p/package.json",), ("q/x/package.json",), ("r/a.js",)], "file string")
    assert [r.project for r in files.discover_projects(listing).collect()] == ["p"]
    assert files.parse_name_status("M\0a\0R100\0b\0c\0D\0d\0") == [("modified", "a"), ("deleted", "b"), ("added", "c"), ("deleted", "d")]
    assert files.parse_git_log("abcdef1\t2025\ts\n\n 2 files changed, 3 insertions(+)\n")[0]["insertions"] == 3
    config = {"a": {"b": 1}, "l": []}
    assert files.add_missing(config, {"a": {"b": 2, "c": 3}, "l": [1], "n": 0}) == ["a.c", "n"] and config["a"] == {"b": 1, "c": 3}


def test_session_logs(spark, tmp_path):
    tool = lambda name, path: {"type": "tool_use", "name": name, "input": {"file_path": path}}
    log = [
        {"type": "user", "timestamp": "t1", "session_id": "s", "message": {"role": "user", "content": "please repair parser"}},
        {"type": "assistant", "timestamp": "t2", "message": {"role": "assistant", "content": [{"type": "text", "text": "ok"}, tool("Read", "/w/p/a.js")]}},
        tool("Edit", "/w/p/a.js") | {"timestamp": "t3"},
        {"type": "system", "subtype": "compact_boundary", "timestamp": "t4"},
        {"type": "user", "timestamp": "t5", "message": {"role": "user", "content": [{"type": "text", "text": "discuss design"}]}},
    ]
    (tmp_path / "s.jsonl").write_text("\n".join([*map(json.dumps, log), "{broken"]))
    rows = files.session_rows(files.read_lines(spark, str(tmp_path / "s.jsonl")))
    w = sessions.windows(rows).orderBy("seq").collect()
    assert [(r.seq, r.start_line, r.end_line, r.end_time, r.boundary_type) for r in w] == [(0, 1, 4, "t4", "session_start"), (1, 5, 5, "t5", "compact")]
    d = sessions.decisions(rows).orderBy("seq").collect()
    assert [(r.status, r.summary) for r in d] == [("decided", "please, repair, parser — a.js"), ("parked", "discuss, design")]
