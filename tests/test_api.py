import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kgraph.api import AmbiguousNode, BadRequest, KnowledgeGraph, UnknownProject
from kgraph.operators import graph as g
from kgraph.operators import lifecycle as c
from kgraph.operators.redact import redact

FILES = [
    ("p", "index.js", "const u = require('./lib/utils');\nfunction main(a, b) {\n  fetch('/api/x');\n}\nfunction main() {\n}\nmodule.exports = { main };"),
    ("p", "lib/utils.js", "function helper() {\n  x.prepare('SELECT a FROM t WHERE b = ?').get();\n}\n"),
]


def test_facade(spark):
    files = spark.createDataFrame(FILES, "project string, file string, content string")
    log = spark.createDataFrame([("s", 1, "t1", "user", None, "fix parser", None), ("s", 2, "t2", "boundary", None, None, None), ("s", 3, "t3", "user", None, "other words", None)], "session_id string, ln long, ts string, kind string, file string, text string, tool string")
    k = KnowledgeGraph.scan(spark, files, log)
    assert [r.file for r in k.blast_radius("p", "lib/utils.js").collect()] == ["index.js"]
    assert k.grep("fetch").first().line_no == 3 and k.classify({"api": "/api"}).first().direction == "client"
    assert {r.window_id for r in k.search([["parser", "none"]]).collect()} == {"s#0"} and k.search([["parser"], ["other"]]).collect() == []
    assert k.find("hel").first().tier == 1 and k.coverage(["project"]).first().labelled == 1
    with pytest.raises(AmbiguousNode):
        k.node("p", "index.js", "main")
    assert k.node("p", "index.js", "main", 2).count() == 1
    with pytest.raises(UnknownProject):
        k.map("nope")
    with pytest.raises(BadRequest):
        k.find("")


def test_blast_radius_against_search_file_by_file(spark):
    rng = random.Random(3)
    nodes = [(i, f"p{i % 2}", f"f{i}") for i in range(40)]
    edges = list({(rng.randrange(40), rng.randrange(40)) for _ in range(90)})
    df = spark.createDataFrame(nodes, "id long, project string, file string")
    hops = g.file_edges(df, spark.createDataFrame(edges, "source_id long, target_id long"))
    got = {(r.root, r.file): r.depth for r in g.blast_radius(df, hops).collect()}
    want = {}
    for root in range(40):
        project, frontier, seen = root % 2, {root}, {root}
        for depth in (1, 2, 3):
            found = {s for s, t in edges if t in frontier and t % 2 == project} - seen
            seen |= found
            for f in found:
                want[f"f{root}", f"f{f}"] = depth
            frontier = found
    assert got == want


def test_findings_reopen_as_new_rows(spark):
    schema = "project string, source_file string, kind string, test_file string, first_seen_sha string, last_seen_sha string, seen_count long, resolved_sha string"
    key = "project string, source_file string, kind string, test_file string"
    one = spark.createDataFrame([("p", "a.js", "stale_pair", None)], key)
    none = spark.createDataFrame([], key)
    s = c.merge_findings(spark.createDataFrame([], schema), one, none, "s1")
    s = c.merge_findings(s, one, none, "s2")
    s = c.merge_findings(s, none, one, "s3")
    s = c.merge_findings(s, one, none, "s4")
    assert sorted((r.first_seen_sha, r.last_seen_sha, r.seen_count, r.resolved_sha) for r in s.collect()) == [("s1", "s2", 2, "s3"), ("s4", "s4", 1, None)]


def test_redaction():
    key = "AKIA" + "A1B2C3D4E5F6G7H8"
    text, found = redact(f"id {key}\nghp_{'a1' * 18} tail")
    assert text == "id [REDACTED:aws_access_key]\n[REDACTED:github_token] tail" and [f[1] for f in found] == [1, 2]
    secret = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789+/", k=60))
    assert "high_entropy" in redact(f"password: {secret}")[0] and "high_entropy" not in redact("\n" * 9 + secret)[0]
    assert "high_entropy" not in redact("token\n" + "\n" * 6 + secret)[0]
    assert redact(f"x {key}yy", [("longer", "AKIA[0-9A-Z]{16}yy", 0)])[0] == "x [REDACTED:longer]"
    assert redact("a.b.c")[1] == [] and redact("x" * (5 * 1024 * 1024 + 1))[1][0][0] == "oversize"


@settings(deadline=None, max_examples=80)
@given(st.text(alphabet="AKI0123456789_ghp.-\n token", max_size=300))
def test_redaction_spans_are_apart(text):
    out, found = redact(text)
    assert len(out) == len(text) + sum(len(f"[REDACTED:{k}]") - n for k, _, n in found)
