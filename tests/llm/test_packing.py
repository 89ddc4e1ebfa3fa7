import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kgraph.llm.packing import PackParams, fill, minimum_bin_slack, pack
from kgraph.llm.tokens import Encoder, default_vocabulary

SCHEMA = "doc_id long, text string, start string, length string, group int, offset int"


def reference():
    return Tokenizer.from_file(default_vocabulary())


def test_ids_are_the_tokenizers():
    t, e = reference(), Encoder(default_vocabulary())
    rng = random.Random(1)
    alphabet = list("ab Z9'\n\t\r é漢😀.,!-_s") + ["'ll", "  ", "<|endoftext|>", " ", "\x1c", "\x85", "ß"]
    for text in ["", " ", "a", "<|endoftext|>", "it's we'll  go\n\n now "] + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(3000)]:
        assert e.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.integers(1, 30), min_size=0, max_size=9), st.integers(0, 60))
def test_fill_is_best(items, capacity):
    counts = Counter(items)
    used = fill(capacity, sorted(counts, reverse=True), counts)
    assert not Counter(used) - counts
    best = max(sum(c) for k in range(len(items) + 1) for c in combinations(items, k) if sum(c) <= capacity)
    assert sum(used) == best


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_windows_use_everything_once(items):
    seen = Counter()
    for pattern, times in minimum_bin_slack(dict(Counter(items)), 64):
        assert 0 < sum(pattern) <= 64
        for x in pattern:
            seen[x] += times
    assert seen == Counter(items)


def test_pack(spark):
    rng = random.Random(2)
    words = ["the", "and", "Haus", "été", "x1", "\n", "  ", "</s>", "<|endoftext|>"]
    texts = [None, "", " "] + [" ".join(rng.choices(words, k=rng.choice([5, 30, 200, 3000]))) for _ in range(150)]
    rows = [(i, t, "s", "l", 1, 2) for i, t in enumerate(texts)] + [(7000, "same", "", "", 0, 0)] * 3
    got = pack(spark.createDataFrame(rows, SCHEMA), PackParams(group_docs=60)).collect()
    t = reference()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in enumerate(texts):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert len(pieces[7000]) == 3
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    used = sum(r.length for r in got)
    assert used / (2048 * len(sequences)) > 0.9


def test_ids_of_special_strings(spark):
    t, e = reference(), Encoder(default_vocabulary())
    for text in ["<|endoftext|>", "<|endoftext|> hi", "a<|endoftext|><|endoftext|>  b\n\n c", "<|endoftext|", "x <|endoftext|>"]:
        assert e.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids
    assert e.encode("<|endoftext|> hi")[0] == t.token_to_id("<|endoftext|>")


def test_rows_that_repeat_share_no_group(spark):
    rows = [(None, "the same words " * 40, "s", "l", 1, 2)] * 1200
    got = pack(spark.createDataFrame(rows, SCHEMA).repartition(3), PackParams(group_docs=100)).collect()
    sizes = Counter(r.sequence_id >> 32 for r in got)
    assert sum(sizes.values()) == 1200 and len(sizes) > 8 and max(sizes.values()) < 250


def test_long_texts_are_whole(spark):
    text = "one two " * 60_000
    got = pack(spark.createDataFrame([(1, text, "s", "l", 1, 2)], SCHEMA)).collect()
    ids = reference().encode(text, add_special_tokens=False).ids
    assert sum(r.length for r in got) == len(ids) + 1 == got[0].doc_tokens


def test_empty(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).collect() == []
