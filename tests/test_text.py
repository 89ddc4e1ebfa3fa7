from pyspark.sql import functions as F

from kgraph.functions import text as x
from kgraph.operators import lifecycle as c
from kgraph.operators import search as s


def one(spark, expression, *values):
    row = spark.range(1).select(*[F.lit(v).alias(f"c{k}") for k, v in enumerate(values)])
    return row.select(expression(*[F.col(f"c{k}") for k in range(len(values))]).alias("v")).first().v


def test_scalars(spark):
    assert one(spark, x.tokens, "<b>The parser_core</b> reads 2024 it's été Parser") == ["parser_core", "reads", "2024", "parser"]
    assert one(spark, lambda t: F.trim(x.without_reminders(t)), "a <system-reminder>\nx</system-reminder>b") == "a b"
    assert abs(one(spark, x.entropy, "aabb") - 1.0) < 1e-9 and one(spark, x.entropy, "") == 0
    assert one(spark, x.normalized, "src/./a/../lib//b.js") == "src/lib/b.js"
    assert one(spark, lambda f, t: F.slice(x.import_candidates(f, t), 1, 3), "src/a/x.js", "../b") == ["src/b", "src/b.js", "src/b/index.js"]
    assert [one(spark, f, "a/b.c/d.tar.gz") for f in (x.basename, x.dirname, x.extname)] == ["d.tar.gz", "a/b.c", ".gz"]
    assert one(spark, x.line_of, "a\nb\nc", 4) == 3 and one(spark, x.slug, "Big  Name!") == "big-name"
    assert [one(spark, lambda t, k=k: x.line_range(t)[k], "L10-L20") for k in (0, 1)] == [10, 20] and one(spark, lambda t: x.line_range(t)[1], "7") == 7
    assert [one(spark, lambda t, k=k: x.short_stat(t)[k], " 2 files changed, 1 deletion(-)") for k in range(3)] == [2, 0, 1]
    assert one(spark, x.format_bytes, 2048) == "2.0 KB" and one(spark, x.body_hash, "") is None
    assert one(spark, x.clamp_confidence, 1.7) == 1.0


def test_globs_and_ignore_rules(spark):
    cases = [("a/b.js", "*.js", True), ("a.js", "?.js", True), ("ab.js", "?.js", False), ("a+b", "a+b", True), ("x(1)", "x(1)", True), ("axjs", "a.js", False)]
    df = spark.createDataFrame(cases, "path string, glob string, want boolean")
    assert df.where(x.glob_matches(F.col("path"), F.col("glob")) != F.col("want")).count() == 0
    rules = ["*.log", "!keep.log", "/top.txt", "doc/", "a/**/z", "# no", ""]
    want = {"x.log": True, "d/x.log": True, "keep.log": False, "top.txt": True, "d/top.txt": False, "doc/a": True, "x/doc/b": True, "doc": False, "a/z": True, "a/b/c/z": True, "../out": True, "x.md": False}
    got = {r.f: r.e for r in spark.createDataFrame([(k,) for k in want], "f string").select("f", x.excluded(F.col("f"), rules).alias("e")).collect()}
    assert got == want


def test_search_ignores_promoted_terms_and_empty_clusters(spark):
    index = spark.createDataFrame([("w1", "auth"), ("w1", "login"), ("w2", "schema")], "window_id string, term string")
    hits = lambda clusters, promoted=None: sorted(r.window_id for r in s.search(index, clusters, promoted).collect())
    assert hits([["auth", "schema"]]) == ["w1", "w2"] and hits([["auth"], ["login"]]) == ["w1"] and hits([["auth"], ["schema"]]) == []
    assert hits([["schema"], ["auth"]], spark.createDataFrame([("auth",)], "term string")) == ["w2"] and hits([[]]) == []


def test_stopwords_promote_reset_and_demote(spark):
    events = [("Noise ", k, "noise") for k in range(5)] + [("kept", 0, "relevant")] + [("kept", k, "noise") for k in range(1, 9)]
    events += [("back", k, "noise") for k in range(6)] + [("back", 9, "demote")]
    got = {r.term: (r.noise_count, r.promoted) for r in c.stopword_state(spark.createDataFrame(events, "term string, ordinal long, kind string")).collect()}
    assert got == {"noise": (5, True), "kept": (8, False), "back": (6, False)}


def test_similar_signals_cluster(spark):
    rows = [(1, "a", "review pull request carefully", None, 50), (2, "a", "review pull request thoroughly", None, 60), (3, "a", "write tests", "x/*", 40), (4, "a", "never mind", "x/*", 40), (5, "b", "review pull request carefully", None, 1), (6, "a", "alone", None, 1)]
    signals = spark.createDataFrame(rows, "id long, type string, label string, file_pattern string, weight int").withColumns({"polarity": F.lit("+"), "description": F.col("label")})
    groups = c.clusters(c.similar_pairs(signals))
    assert {r.id: r.cluster for r in groups.collect()} == {1: 1, 2: 1, 3: 3, 4: 3}
    assert {r.cluster: (r.n, r.label, r.weight) for r in c.consolidate(signals, groups).collect()}[1] == (2, "review pull request thoroughly", 60)
