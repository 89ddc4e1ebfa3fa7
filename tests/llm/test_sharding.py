import zlib
from collections import defaultdict

from kgraph.llm import sharding
from kgraph.llm.sharding import SlotMap, load_map, rebalanced, shard, uniform_map

SCHEMA = "doc_id long, text string, size string, shard int, slot string"


def make(n=3000):
    texts = [None, "", "same", "é" * 50] + [f"text {i} " + "x" * (i * 37 % 400) for i in range(n)]
    return [(i, texts[(i % 4) if i % 5 == 0 else i % len(texts)], "s", 3, "t") for i in range(n)]


def test_contract(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANK_ROWS", 50)
    rows = make()
    got = shard(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    place, total, numbers, of_text = {r.doc_id: r for r in got}, defaultdict(int), defaultdict(list), defaultdict(set)
    for doc_id, text, *_ in rows:
        b, g = (text or "").encode(), place[doc_id]
        assert g["size"] == len(b) + 1 and g.text_crc32 == zlib.crc32(b)
        total[g.shard] += g["size"]
        numbers[g.shard].append(g.slot)
        of_text[text or ""].add(g.shard)
    assert all(sorted(v) == list(range(len(v))) for v in numbers.values())
    assert all(len(v) == 1 for v in of_text.values())
    assert set(total) == set(range(8)) and max(total.values()) < 1.02 * min(total.values())
    again = shard(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in got}


def test_repeated_rows_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 2)
    rows = [(1, "a", "", 0, "")] * 5 + [(None, None, None, None, None)] * 2
    got = shard(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.shard, r.slot) for r in got if r.doc_id == 1) == [(got_shard, k) for got_shard in {r.shard for r in got if r.doc_id == 1} for k in range(5)]
    assert len(got) == 7 and shard(spark.createDataFrame([], SCHEMA)).collect() == []


def test_versions_are_stored_and_edited(spark, tmp_path):
    path = str(tmp_path / "map")
    assert load_map(spark, path) is None
    docs = spark.createDataFrame(make(), SCHEMA)
    first = {r.doc_id: r for r in shard(docs, path=path).collect()}
    assert load_map(spark, path, 1) == uniform_map(4096, 8) and load_map(spark, path).version == 2
    assert {r.map_version for r in first.values()} == {2}
    assert {tuple(r) for r in shard(docs, path=path).collect()} == {tuple(r) for r in first.values()}  # no third version
    grown = {r.doc_id: r for r in shard(docs, 9, path=path).collect()}
    assert {r.map_version for r in grown.values()} == {3} and {r.shard for r in grown.values()} == set(range(9))
    moved = [d for d in grown if grown[d].shard != first[d].shard]
    assert moved and len(moved) < 0.2 * len(grown) and sum(grown[d].shard == 8 for d in moved) > 0.9 * len(moved)
    assert all(grown[d].virtual_slot == first[d].virtual_slot for d in grown)


def test_very_long_texts_and_clashing_names(spark):
    rows = [(1, "é" * 2_000_000, "1"), (2, "short", "2")]
    got = {r.doc_id: r for r in shard(spark.createDataFrame(rows, "doc_id long, text string, virtual_slot string")).collect()}
    assert got[1]["size"] == 4_000_001 and got[1].text_crc32 == zlib.crc32(rows[0][1].encode()) and got[1].shard != got[2].shard


def test_rebalancing_edits_the_map():
    size = {k: 1 + k * k % 97 for k in range(4096)}
    first = rebalanced(uniform_map(4096, 8), size, 8)
    grown = rebalanced(first, size, 9)
    moved = [k for k in range(4096) if first.shard_of[k] != grown.shard_of[k]]
    assert grown.version == 3 and sum(grown.shard_of[k] == 8 for k in moved) > 0.98 * len(moved)
    per = [sum(size[k] for k in range(4096) if grown.shard_of[k] == s) for s in range(9)]
    assert max(per) < 1.002 * min(per) and sum(size[k] for k in moved) < 1.1 * sum(size.values()) / 9
    shrunk = rebalanced(grown, size, 7)
    assert set(shrunk.shard_of) == set(range(7)) and SlotMap.from_json(shrunk.to_json()) == shrunk
