"""Walks and dependents of all roots: against brute force, in slices, and what they hold on disk."""

import random
import threading
from pathlib import Path

import pytest

from kgraph.operators import graph as g
from kgraph.registry import QUERIES

SF = "/root/testdata/sf0.01"


def graphs():
    """Layers that few nodes join; a cycle, with ends that are no roots."""
    r = random.Random(5)
    yield list(range(60)), [(a, 40 + r.randrange(6)) for a in range(40)] + [(40 + a, 50 + r.randrange(3)) for a in range(6)] + [(50, 55), (51, 55), (52, 55), (3, 50)]
    yield [0, 1, 2, 3, 4, 5, 6, 9], [(0, 5), (1, 5), (2, 5), (5, 6), (6, 5), (5, 70), (70, 71), (80, 5), (6, 9), (9, 0), (9, 9), (0, 5)]


def walks(roots, edges, depth):
    for root in roots:
        seen, front = {root: (0, None)}, [root]
        for level in range(1, depth + 1):
            found = {}
            for a in sorted(front, reverse=True):
                found |= {b: a for x, b in edges if x == a and b not in seen}
            seen |= {b: (level, a) for b, a in found.items()}
            front = list(found)
        yield from ((root, b, *at) for b, at in seen.items())


def test_walks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(g, "_slices", lambda count: 2)
    for nodes, pairs in graphs():
        edges = spark.createDataFrame(pairs, "source_id long, target_id long")
        got = g.walk_flow(spark.createDataFrame([(n,) for n in nodes], "id long"), edges, 4).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, walks(nodes, pairs, 4)))


def test_dependents_in_slices(spark, monkeypatch):
    rows = lambda: sorted(map(tuple, QUERIES["blast_radius_all_roots"](spark, "/root/testdata/sf0.001").collect()))
    whole = rows()
    monkeypatch.setattr(g, "_slices", lambda count: 3)
    assert rows() == whole


@pytest.mark.parametrize("name, most", [("walk_flow", 40), ("blast_radius_all_roots", 80)])
def test_bytes_on_disk(spark, monkeypatch, name, most):
    monkeypatch.setattr(g, "_slices", lambda count: 4, raising=False)
    blocks, shared, over, peak = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).parent, threading.Event(), [0]
    folders = [Path(f.getPath()) for f in blocks.localDirs()]

    def used():
        total = 0
        for top in (*folders, shared):
            for p in top.rglob("*"):
                try:
                    total += p.stat().st_size
                except OSError:  # removed meanwhile
                    pass
        return total

    def watch():
        while not over.wait(0.5):
            peak[0] = max(peak[0], used())

    spark._jvm.System.gc()
    over.wait(1)
    before, watcher = used(), threading.Thread(target=watch)
    watcher.start()
    rows = QUERIES[name](spark, SF)
    rows.write.format("noop").mode("overwrite").save()
    over.set()
    watcher.join()
    assert peak[0] - before < most * rows.count()
