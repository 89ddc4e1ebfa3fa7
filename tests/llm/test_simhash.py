import random
import re
from collections import Counter

import xxhash

from kgraph.llm.components import connected_components
from kgraph.llm.simhash import SimHashParams, fingerprint, simhash_groups

SCHEMA = "doc_id long, text string, fp string, component string, anchor int"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    votes, n = Counter(), len(shingles)
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        votes.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > n)


def groups(fps):
    parent = {k: k for k in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in fps}


def make():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["É", "Ünd", "ABC", "x y"]
    texts = [None, "", "  \n", "One", "one", "a b", "A  B", "A\x0bb "]
    for _ in range(60):
        base = rng.choices(words, k=rng.choice([4, 80, 400]))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append("\n".join(copy).upper())
    return [(1000 - i, t, "f", "c", 1) for i, t in enumerate(texts)]


def test_against_brute_force(spark):
    rows = make()
    rows += [(r[0] - 5000, *r[1:]) for r in rows[10:14]]
    fps = {r[0]: plain(r[1]) for r in rows}
    want = groups(fps)
    for block in (8192, 3):
        got = simhash_groups(spark.createDataFrame(rows, SCHEMA), SimHashParams(block=block)).collect()
        assert {r.doc_id: r.fingerprint for r in got} == {k: f"{v:016x}" for k, v in fps.items()}
        assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    assert len(set(want.values())) < len(want) - 20


def test_many_fingerprints_lose_no_link(spark):
    from kgraph.llm import simhash

    rng = random.Random(4)
    fps = set()
    while len(fps) < 3000:
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            fps.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    values = {x - (1 << 64) if x >> 63 else x: x for x in fps}
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r.node: r.component for r in connected_components(simhash.links(nodes)).collect()}
    want = groups(values)
    assert {k: got.get(k, k) for k in values} == want


def test_nulls_ties_and_empty(spark):
    rows = [(None, "a b c d", None, None, None), (5, "a b c d", None, None, None), (5, "a b c d", None, None, None), (None, "z", None, None, None)]
    got = sorted((r.doc_id is None, r.component_id) for r in simhash_groups(spark.createDataFrame(rows, SCHEMA)).collect() if r.component_id)
    assert got == [(False, 5), (False, 5), (True, 5)]
    assert simhash_groups(spark.createDataFrame([], SCHEMA)).collect() == []
    assert fingerprint("x") == xxhash.xxh64_intdigest(b"x", 42)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {400: 400, 500: 400}


def test_very_long_texts_are_whole():
    words = [f"w{i}" for i in range(60_000)] + [f"v{i % 7}" for i in range(140_000)]
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert fingerprint(" ".join(words)) == want != fingerprint(" ".join(words[:60_000]))
