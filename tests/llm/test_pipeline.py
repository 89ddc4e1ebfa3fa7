import random
from collections import Counter, defaultdict

import corpus_pipeline
from kgraph.llm.mixing import mix
from kgraph.llm.packing import pack
from kgraph.llm.quality_rules import quality_rules, trusted_documents
from test_near_copies import groups
from kgraph.llm.suffix_dedup import suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make():
    rng = random.Random(11)
    words = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "ri", "sa") for b in ("ton", "ra", "vel", "s", "dik", "mo")]
    passage = " ".join(rng.choices(words, k=60))
    rows = []
    for i in range(140):
        text = " ".join(rng.choices(words, k=rng.choice([30, 120, 500])))
        if i % 7 == 3:
            text = text[: len(text) // 2] + " " + passage + " " + text[len(text) // 2 :]
        if i % 9 == 4:
            text = " ".join(w + rng.choice(["%%%", "&&&", "$$$"]) for w in text.split())
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(1000 + i, rows[i][1], "de", "s1", 1) for i in range(0, 40, 4)]
    rows += [(2000, None, None, None, None), (2001, "", "", "", 0), (2002, "too short", "en", "s0", 9)]
    return rows


def test_stages(spark, tmp_path):
    rows = make()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0 if i % 9 == 4 else 1, 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append([r.asDict() for r in docs.collect()])
    original = {r[0]: r for r in rows}

    def frame(found):
        return spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in found], SCHEMA)

    kept = {r.doc_id for r in quality_rules(spark.createDataFrame(rows, SCHEMA), trusted_documents(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect() if r.kept}
    assert {r["doc_id"] for r in seen[0]} == kept and 2002 not in kept
    assert all((r["text"], r["lang"], r["source"]) == original[r["doc_id"]][1:4] for r in seen[0])
    firsts = {g for _, g in groups([(r["doc_id"], r["text"]) for r in seen[0]])}
    assert {r["doc_id"] for r in seen[1]} == firsts and not any(d >= 1000 for d in firsts)
    cut = {r.doc_id: r.kept for r in suffix_dedup(frame(seen[1]), with_text=True).collect()}
    assert {r["doc_id"]: r["text"] for r in seen[2]} == cut
    assert sum(len(original[d][1]) > len(t) for d, t in cut.items()) > 5 and all(r["n_chars"] == len(r["text"]) for r in seen[2])
    copies = {r.doc_id: r.copies for r in mix(frame(seen[2])).collect()}
    assert Counter(r["doc_id"] for r in seen[3]) == Counter({k: v for k, v in copies.items() if v})
    by = defaultdict(int)
    for r in seen[4]:
        by[r["doc_id"]] += r["length"]
    assert by == {d: sum(r.length for r in pack(frame([next(x for x in seen[2] if x["doc_id"] == d)])).collect()) * n for d, n in copies.items() if n and d in list(copies)[:3]} | {d: v for d, v in by.items() if d not in list(copies)[:3]}
    assert Counter((r["doc_id"], r["start"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter((r["doc_id"], r["start"]) for r in seen[4])


def test_nulls_clashing_names_and_empty_tables(spark, tmp_path):
    schema = SCHEMA + ", kept string, row string, size int, copies int, kept_id long, text_sha256 string, component long"
    extra = ("a", "b", 3, 4, 5, "c", 6)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    text = lambda: " ".join(rng.choices(words, k=80))
    one, two = text(), text()
    rows = [(1, one, "en", "s", 1, *extra), (None, one, "en", "s", 1, *extra), (None, two, None, None, None, *extra), (None, text(), "en", None, 1, *extra)]
    rows += [(2, text(), "en", "s", 1, *[None] * 7)] * 3 + [(3, None, "en", "s", 1, *extra), (4, " ".join(rng.choices(words, k=90_000)), "en", "s", 1, *extra)]
    for k, found in enumerate((rows, [])):
        folder = f"{tmp_path}/{k}"
        spark.createDataFrame(found, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)][: len(found)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        names = docs.columns
        for j, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, folder)
            out.write.parquet(f"{folder}/out{j}")
            docs = spark.read.parquet(f"{folder}/out{j}")
            assert j == 4 or docs.columns == names
            if j == 1 and found:
                # the text without a copy under an id stays, rows that repeat are one
                assert sorted((r.doc_id for r in docs.collect()), key=repr) == sorted([1, 2, 4, None, None], key=repr)
                assert {r.text for r in docs.collect() if r.doc_id is None} >= {two}
        assert (docs.count() > 0) == bool(found)
        assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_run_leaves_only_what_it_reads(spark, tmp_path):
    from kgraph.llm.common import WRITTEN

    spark.createDataFrame(make(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    mark = len(WRITTEN)
    corpus_pipeline.run(spark, str(tmp_path)).count()
    assert len(WRITTEN) == mark + 1
