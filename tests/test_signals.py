import re

import duckdb

from kgraph import registry
from kgraph.operators import lifecycle as c
from kgraph.operators import state as st

PATHS = ["app", "src/app/a.js", "src/app/b.js", "lib/x.py", "web", "app", "a+b"]
GLOBS = ["src/app/*", "*.js", "src/?pp/a.js", "*", "??b", "projects/app/*", "lib/x.py", "a+b", "*/b.*", None, "", "w*b"]


def matches(glob, path):
    return re.fullmatch("".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in glob), path) is not None


def test_whole_signals_against_brute_force(spark):
    rows = [(k, g, t, z) for k, (g, t, z) in enumerate((g, t, z) for g in GLOBS for t in ("pre_write", "passive") for z in (False, True))]
    signals = spark.createDataFrame(rows, "id long, file_pattern string, trigger string, archived boolean")
    paths = spark.createDataFrame([(p,) for p in PATHS], "path string")
    get = lambda f: sorted((r.path, r.id) for r in f(signals, paths).collect())
    named = lambda g, p: g is not None and (p in g or matches(g, p))
    assert get(c.signals_for) == sorted((p, k) for p in PATHS for k, g, _, _ in rows if named(g, p))
    assert get(c.project_signals) == sorted((p, k) for p in PATHS for k, g, _, z in rows if not z and named(g, p))
    assert get(c.pre_write_signals) == sorted((p, k) for p in PATHS for k, g, t, z in rows if not z and t == "pre_write" and (not g or matches(g, p)))


def test_more_than_ten_thousand_signals(spark):
    signals = spark.range(10_050).selectExpr("id", "concat('f/', id) AS file_pattern")
    paths = spark.range(10_050).selectExpr("concat('f/', id) AS path")
    assert c.signals_for(signals, paths).selectExpr("path", "id").where("path = concat('f/', id)").count() == 10_050


def test_ids_of_added_signals_do_not_follow_the_order_of_arrival(spark):
    schema = "type string, weight int, polarity string, label string, description string, archived boolean"
    rows = [("amygdala", 50, p, "same", d, z) for p in "+-" for d in ("x", None, "y") for z in (True, False)]
    old = spark.createDataFrame([(7, "amygdala", 1, "+", "old", None, False)], f"id long, {schema}")
    added = lambda new: {tuple(r) for r in st.add_signals(old, spark.createDataFrame(new, schema).coalesce(1)).collect()}
    assert len(added(rows)) == 13 and added(rows) == added(rows[::-1]) == added(rows[5:] + rows[:5])


def test_signal_writes_is_the_sql_with_its_ties_settled(spark):
    """The SQL leaves ties of label, type and weight open, and DuckDB's answers differ; with them settled there is one answer."""
    sql, order = registry.ORACLE_SQL["signal_writes"], "ORDER BY label, type, weight"
    assert sql.count(order) == 1
    con = duckdb.connect()
    con.execute("CREATE VIEW part AS SELECT * FROM '/root/testdata/sf0.01/part.parquet'")
    want = con.execute(sql.replace(order, f"{order}, archived, description, polarity")).fetchall()
    got = registry.QUERIES["signal_writes"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got)) == sorted(want)
