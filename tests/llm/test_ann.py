import numpy as np

from kgraph.llm.ann import AnnParams, balanced_parts, learn, nearest, search, visited

SCHEMA = "vec_id long, embedding array<float>, label int, vec string, part string"
DATA = "/root/testdata/sf0.1"


def brute(rows, ask, k=10):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    out = {}
    for q in ask:
        v = x[ids == q][0]
        d = np.sqrt(((x - v) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def collected(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.vec_id, r.score))
    return got


def test_recall_on_test_data(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got = collected(search(table, table.where("vec_id % 20 = 0")))
    want = brute(rows, [r[0] for r in rows if r[0] % 20 == 0])
    assert set(got) == set(want)
    score = {(q, v): s for q, found in got.items() for v, s in found}
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    assert all(abs(score[q, v] - s) < 1e-12 for q, found in want.items() for v, s in found if (q, v) in score)


def test_ties_bad_vectors_and_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(4).astype(np.float32)]) for i in range(1, 150)]
    rows += [(200 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(60)]
    bad = [(900, None), (901, [0.0] * 4), (902, [1.0, None, 2.0, 3.0]), (903, [float("nan")] * 4), (904, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (906, [])]
    table = spark.createDataFrame([(*r, 1, "v", "p") for r in rows + bad], SCHEMA)
    got = collected(search(table, table, AnnParams(max_sample=40, block=16)))
    want = brute(rows, [r[0] for r in rows])
    assert set(got) == set(want)
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]]
    few = spark.createDataFrame([(*r, 1, "v", "p") for r in rows[:4]], SCHEMA)
    assert {len(v) for v in collected(search(few, few)).values()} == {3}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert search(empty, empty).collect() == []


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((8, 16)) * 6
    x = np.concatenate([c + rng.standard_normal((100, 16)) for c in centres])
    graph = nearest(x, 10)
    part = balanced_parts(graph, 8, rng)
    assert np.bincount(part).max() - np.bincount(part).min() <= 3
    assert (part[graph] == part[:, None]).mean() > 0.9
    index = learn(x, len(x), AnnParams(epochs=10))
    assert index.parts == 25 and len(index.probed(x)[0]) < 8 * len(x)


def test_queries_of_small_parts_get_k_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.standard_normal(8).astype(np.float32)]) for i in range(200)]
    table = spark.createDataFrame([(*r, 1, "v", "p") for r in rows], SCHEMA)
    got = collected(search(table, table, AnnParams(part_rows=8, recall=0.01, block=64)))
    assert set(got) == {r[0] for r in rows} and {len(v) for v in got.values()} == {10}
    want = brute(rows, [r[0] for r in rows])
    assert sum(got[q] == want[q] for q in want) > 20


def test_structure_is_pruned(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((60, 16)) * 5
    rows = [(i, [float(v) for v in centres[i % 60] + rng.standard_normal(16)]) for i in range(6000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = table.where("vec_id % 20 = 0")
    got, x = collected(search(table, ask)), np.array([r[1] for r in rows])
    hits = 0
    for q in got:
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & {v for v, _ in got[q]})
    assert len(got) == 300 and hits >= 0.9 * 3000
    assert visited(table, ask) < 0.15


def test_wide_and_small_vectors(spark):
    rng = np.random.default_rng(9)
    wide = [(i, [float(v) * 1e200 for v in rng.standard_normal(4)]) for i in range(80)]
    small = [(100 + i, [float(v) * 1e-170 for v in rng.standard_normal(4)]) for i in range(40)]
    plain = [(200 + i, [float(v) for v in rng.standard_normal(4)]) for i in range(40)]
    rows = wide + small + plain
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collected(search(table, table, AnnParams(part_rows=1000)))
    assert set(got) == {r[0] for r in rows} and {len(v) for v in got.values()} == {10}
    scaled = np.array([r[1] for r in wide]) / 1e200
    for q in range(80):
        d = np.sqrt(((scaled - scaled[q]) ** 2).sum(axis=1))
        # all that are not wide are as near as zero is
        near = sorted([(d[j], j) for j in range(80) if j != q])[:10]
        zero = float(np.sqrt((scaled[q] ** 2).sum()))
        if near[-1][0] < zero:
            assert [v for v, _ in got[q]] == [j for _, j in near]
            assert np.allclose([x / 1e200 for _, x in got[q]], [x for x, _ in near])
    for q in range(100, 140):
        assert all(100 <= v < 140 for v, _ in got[q]) and 0 < got[q][0][1] < 1e-168
    learned = collected(search(table, table, AnnParams(part_rows=16)))
    assert set(learned) == set(got) and {len(v) for v in learned.values()} == {10}


def test_queries_that_repeat_and_unlike_lengths(spark):
    rng = np.random.default_rng(10)
    rows = [(i, [float(v) for v in rng.standard_normal(4)]) for i in range(60)]
    rows += [(100 + i, [float(v) for v in rng.standard_normal(3)]) for i in range(30)] + [(300, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collected(search(table, table.unionByName(table)))
    assert set(got) == {r[0] for r in rows} - {300}
    for q, found in got.items():
        assert len({v for v, _ in found}) == 10 and all((v < 100) == (q < 100) for v, _ in found)
