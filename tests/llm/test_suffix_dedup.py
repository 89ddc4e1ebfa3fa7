import hashlib
import random

import numpy as np
import pandas as pd

from kgraph.llm import suffix_dedup as sd
from kgraph.llm.suffix_dedup import SuffixParams, Suffixes, deduplicated, minimizer_runs, suffix_dedup

SCHEMA = "doc_id long, text string, doc string, tag string, kept int"


def brute(rows, length):
    """rows: (doc_id, text), distinct ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        out[doc_id] = (len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def check(spark, rows, params):
    docs = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], SCHEMA).repartition(3)
    got = suffix_dedup(docs, params).collect()
    assert len(got) == len(rows)
    want = brute(rows, params.length)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
    return want


def make(rng, n, alphabet):
    rows = []
    passages = ["".join(rng.choices(alphabet, k=rng.randint(30, 500))) for _ in range(6)]
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.4:
                parts.append("".join(rng.choices(alphabet, k=rng.randint(1, 300))))
            elif kind < 0.8:
                p = rng.choice(passages)
                a = rng.randint(0, len(p) // 2)
                parts.append(p[a : a + rng.randint(20, 400)])
            elif rows and rows[-1][1]:
                parts.append(rng.choice(rows)[1] or "")
            else:
                parts.append("ab" * rng.randint(1, 150))
        rows.append((rng.choice([-1, 1]) * (n - i) * 7 + i % 3, "".join(parts)))
    rows = list({r[0]: r for r in rows}.values())
    return rows + [(10**6, None), (10**6 + 1, ""), (None, rows[0][1]), (10**6 + 2, "é" * 300), (10**6 + 3, "é" * 300 + "x"), (10**6 + 4, "z" * 99), (10**6 + 5, "z" * 100), (10**6 + 6, "z" * 101)]


def test_against_brute_force(spark):
    rng = random.Random(5)
    want = check(spark, make(rng, 90, "abcdefgh \né"), SuffixParams())
    assert sum(v[1] > 0 for v in want.values()) > 30


LINE = "one line that very many of the documents share, and that is long enough to be found as a repeat by itself. "


def test_short_alphabet_and_hot_minimizers(spark):
    rng = random.Random(6)
    rows = make(rng, 60, "ab")
    rows += [(20_000 + i, f"{rng.random()} {LINE * rng.randint(1, 2)}{rng.random()}") for i in range(60)]
    check(spark, rows, SuffixParams())
    check(spark, rows, SuffixParams(hot_runs=3))
    check(spark, rows, SuffixParams(length=60, gram=16, hot_runs=20))


def test_runs_whose_hashes_meet_by_chance(spark):
    rng = random.Random(12)
    rows = make(rng, 40, "abcdefgh ")
    rows += [(20_000 + i, f"{rng.random()} {LINE}{rng.random()}") for i in range(20)]
    # equal lines under other minimizers' hashes: one bit tells runs of a minimizer apart
    check(spark, rows, SuffixParams(bits=1))


def test_texts_in_slices_and_small_batches(monkeypatch):
    monkeypatch.setattr(sd, "CHUNK", 700)
    monkeypatch.setattr(sd, "RUNS", 60)
    rng = random.Random(13)
    rows = [(d, t) for d, t in make(rng, 30, "abc") if d is not None]
    frame = pd.DataFrame({"doc": [d for d, _ in rows], "text": [t for _, t in rows]})
    params = SuffixParams()
    out = pd.concat(list(sd._runs(params)(iter([frame]))))
    spans = out[out["span"]]
    want = brute(rows, 100)
    raw = {d: (t or "").encode() for d, t in rows}
    seen = set()
    for d in sorted(raw):
        for i in range(len(raw[d]) - 99):
            seen.add(raw[d][i : i + 100])
    for doc, start, place in zip(spans["doc"], spans["d"], spans["place"]):
        end = int(place) & ((1 << 48) - 1)
        assert want[doc][1] >= end - start >= 100 and raw[doc][start : start + 100] in seen
    assert len(spans)


def test_runs_cover_all_windows_once():
    rng = random.Random(7)
    texts = [bytes(rng.choices(b"abc", k=k)) for k in (0, 99, 100, 101, 400, 5, 1000)]
    end = np.cumsum([len(t) for t in texts])
    begin = end - [len(t) for t in texts]
    text, first, last, p, h, d = minimizer_runs(np.frombuffer(b"".join(texts), np.uint8), begin, end, SuffixParams())
    got = [i for a, b in zip(first, last) for i in range(a, b + 1)]
    assert got == [i for a, b in zip(begin, end) for i in range(a, b - 99)]
    assert all(q <= m and m + 32 <= q + 100 for a, b, m in zip(first, last, p) for q in (a, b))
    assert [begin[t] <= a and b + 100 <= end[t] for t, a, b in zip(text, first, last)].count(False) == 0


def test_suffix_sort_and_common_extensions():
    rng = random.Random(8)
    raw = bytes(rng.choices(b"ab", k=3000)) + b"abcabc" * 100 + b"x" * 40
    data = np.frombuffer(raw, np.uint8)
    s = Suffixes(data, 40)
    start = np.array(rng.choices(range(len(raw) - 40), k=900))
    bucket = np.sort(np.array(rng.choices(range(30), k=900)))
    order = s.sort(start, bucket)
    want = sorted(range(900), key=lambda k: (bucket[k], raw[start[k] : start[k] + 40], k))
    assert order.tolist() == want
    a, b = np.array(rng.choices(start, k=500)), np.array(rng.choices(start, k=500))
    for x, y, n in zip(a, b, s.common(a, b)):
        m = next((i for i in range(40) if raw[x + i] != raw[y + i]), 40)
        assert n == m


def test_rows_that_repeat(spark):
    text = "".join(random.Random(9).choices("abcdefgh", k=300))
    rows = [(1, text, "", "", 0)] * 3 + [(1, "other " + text, "", "", 0), (None, None, None, None, None), (2, text, "", "", 0)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    one = {x for x in got if x[:2] == (1, 300)}
    assert len(got) == 6 and len(one) == 1 and got[0] == (0, 0, 0) and got[-1] == (2, 300, 300)
    assert sorted([next(iter(one))[2], next(x for x in got if x[1] == 306)[2]]) in ([0, 300], [0, 300])
    assert suffix_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rows_without_ids_are_documents_of_their_own(spark):
    rng = random.Random(14)
    shared = "".join(rng.choices("abcdefgh", k=200))
    rows = [(None, f"{k} {shared}{rng.random()}", "", "", 0) for k in range(50)] + [(1, shared, "", "", 0)]
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    gone = sorted(r.n_removed for r in got if r.doc_id is None)
    # the first of them keeps the passage, whichever it is
    assert len(got) == 51 and gone[0] == 0 and gone[1] >= 200 and [r.n_removed for r in got if r.doc_id == 1] == [200]


def test_clashing_names_and_nulls(spark):
    text = "".join(random.Random(15).choices("abcdefgh", k=150))
    schema = "doc_id long, text string, kept string, row_of string, text_digest int, n_chars int"
    rows = [(1, text, "k", "r", 5, 150), (2, text + "x", "l", None, None, 151), (3, None, None, None, None, None), (3, None, None, None, None, None)]
    got = sorted(deduplicated(spark.createDataFrame(rows, schema)).collect(), key=str)
    assert sorted((r.doc_id, r.text, r.kept, r.row_of, r.text_digest, r.n_chars) for r in got[:2]) == [(1, text, "k", "r", 5, 150), (2, "x", "l", None, None, 1)]
    assert [(r.doc_id, r.text, r.n_chars) for r in got[2:]] == [(3, "", 0)] * 2
    empty = spark.createDataFrame([], schema)
    assert deduplicated(empty).collect() == [] and deduplicated(empty).columns == empty.columns
