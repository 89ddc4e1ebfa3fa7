import random

from kgraph.llm.near_copies import SLICE, keep_first_copy, near_copy_groups, shingle_sets
from kgraph.llm.simhash import SimHashParams

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)] = min(r[0], ids.get(find(i), r[0]))
    return [(r[0], ids.get(find(i))) for i, r in enumerate(rows)]


def make():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    line = rng.choices(words, k=40)
    texts = [None, "", " \n", "One", "one", "a b"]
    for _ in range(40):
        base = rng.choices(words, k=rng.choice([12, 60, 300]))
        texts.append(" ".join(base + line))
        # similarities on both sides of 0.8
        for share in (0.005, 0.015, 0.02, 0.025, 0.03, 0.05):
            copy = [rng.choice(words) if rng.random() < share else w for w in base + line]
            texts.append(" ".join(copy))
    return [(5000 - i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, "only here", "en", "s", 1), (None, texts[6], "en", "s", 1)]


PARAMS = SimHashParams(shingle=5, threshold=6)


def test_groups_are_those_of_brute_force(spark):
    rows = make()
    want = groups(rows)
    found = near_copy_groups(spark.createDataFrame(rows, SCHEMA).repartition(5), PARAMS).collect()
    assert len(found) == len(rows)
    least = {}
    for r in found:
        if r.doc_id is not None:
            least[r.component] = min(r.doc_id, least.get(r.component, r.doc_id))
    assert sorted(((r.doc_id, least.get(r.component)) for r in found), key=repr) == sorted(want, key=repr)
    kept = sorted((r.doc_id for r in keep_first_copy(spark.createDataFrame(rows, SCHEMA), PARAMS).collect()), key=repr)
    # the copy without an id goes, the text that only a row without one has stays
    assert kept == sorted([d for d, g in want if d == g and d is not None] + [None], key=repr)


def test_one_row_stays_of_rows_that_repeat_under_clashing_names(spark):
    schema = "doc_id long, text string, kept_id long, row string, digest long, component long"
    rows = [(7, "one text of six words here", 1, "a", 2, 3)] * 3 + [(7, "another text of six other words", 1, "b", 2, 3), (9, "one text of six words here", 1, "c", 2, 3)]
    got = sorted(keep_first_copy(spark.createDataFrame(rows, schema).repartition(3), PARAMS).collect())
    assert got == sorted([rows[0], rows[3]]) and got[0].__fields__ == [c.split()[0] for c in schema.split(", ")]
    empty = spark.createDataFrame([], schema)
    assert keep_first_copy(empty, PARAMS).collect() == [] and keep_first_copy(empty, PARAMS).columns == empty.columns


def test_sets_of_long_texts_are_whole():
    words = " ".join(f"w{i}" for i in range(SLICE // 4))
    assert len(words) > SLICE
    (long,), both = shingle_sets([words]), shingle_sets(["x", words, "a b c d e f"])
    assert len(long) == SLICE // 4 - 4 and (both[1] == long).all() and len(both[2]) == 2
