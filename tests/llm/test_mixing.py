import hashlib
import re
from collections import defaultdict

import duckdb
import pytest

from kgraph.llm.mixing import SQL, mix, mixed_documents

SCHEMA = "doc_id long, text string, source string, size long, copies string"


def targets(sizes):
    """By resharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        free -= over
    return out


def make(n=120):
    rows = []
    for i in range(n):
        source = ["a", "é", None, "B", "empty", "", "zz", "a"][i % 8]
        text = None if i % 17 == 0 else " \n".join(["w"] * (i % 23) * (5 if source == "zz" else 1)) + " "
        rows.append((i, "" if source == "empty" else text, source, 7, "x"))
    return rows


def test_against_brute_force_and_sql(spark):
    rows = make()
    got = {r.doc_id: r for r in mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0d]+", r[1] or "")) for r in rows}
    sums = defaultdict(int)
    for r in rows:
        sums[r[2]] += size[r[0]]
    want = targets(sums)
    assert abs(sum(want.values()) - 1.5 * sum(sums.values())) < 1e-6
    for r in rows:
        g = got[r[0]]
        rate = want[r[2]] / sums[r[2]] if sums[r[2]] else 0.0
        u = int(hashlib.md5(f"mix-1:{r[0]}".encode()).hexdigest()[:12], 16) / 2**48
        assert g.size == size[r[0]] and g.source_size == sums[r[2]] and g.target == pytest.approx(want[r[2]])
        if abs(u - rate % 1) > 1e-9 and abs(rate - round(rate)) > 1e-9:
            assert g.taken == g.size * (int(rate) + (u < rate % 1))
        assert g.taken <= 2 * g.size
    con = duckdb.connect()
    import pandas as pd

    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source", "size", "copies"])[["doc_id", "text", "source"]])
    sql = {r[0]: r[6] for r in con.execute(SQL).fetchall()}
    assert sql == {k: g.taken for k, g in got.items()}


def test_taken_comes_near_target(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 4}", 0, "") for i in range(4000)]
    got = mix(spark.createDataFrame(rows, SCHEMA)).groupBy("source", "target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] / r.target - 1) < 0.05 for r in got)


def test_documents_are_repeated(spark):
    docs = spark.createDataFrame(make(), SCHEMA)
    want = {r.doc_id: r.copies for r in mix(docs).collect()}
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    seen = defaultdict(int)
    for r in out.collect():
        seen[r.doc_id] += 1
    assert {k: v for k, v in want.items() if v} == dict(seen)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mix(empty).collect() == [] and mixed_documents(empty).collect() == []
    only = mix(spark.createDataFrame([(1, None, None, 1, None), (2, "", None, 1, None)], SCHEMA)).collect()
    assert [r.taken for r in only] == [0, 0]
