import hashlib
import json
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kgraph.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, record string, k int"
ALPHABET = st.lists(st.sampled_from(["\\", "<", "|", ">", "<|", "<|end|>", "<|turn|>", "<|text|>", "[INST]", "[/INST]", "</s>", "a", "\n", "é", "😀", " "]), max_size=12).map("".join)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), ALPHABET), ALPHABET), max_size=4))
def test_round_trip(turns):
    output, spans = chat.format_record({"messages": [{"role": r, "content": t} for r, t in turns]})
    assert chat.read_turns(output) == turns
    assert [chat.unescape(output[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert output.count(chat.TURN) == len(turns)
    for r, t in turns:
        assert not any(c in chat.escape(t) for c in chat.CONTROL)


def test_layouts():
    want = [("user", "q\n\nmore"), ("assistant", "a")]
    for record in (
        {"instruction": "q", "input": "more", "output": "a"},
        {"messages": [{"role": "user", "content": "q\n\nmore"}, {"content": "a", "role": "assistant"}]},
        {"conversations": [{"from": "human", "value": "q\n\nmore"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q\n\nmore", "completion": "a"},
        {"response": "a", "prompt": "q\n\nmore"},
        {"question": "q\n\nmore", "answer": "a"},
    ):
        assert chat.canonical_turns(record) == want
    assert chat.canonical_turns({"system": "s", "instruction": "q", "output": None}) == [("system", "s"), ("user", "q"), ("assistant", "")]
    assert chat.canonical_turns({"messages": []}) == []
    assert chat.schema_fingerprint({"a": {"b": ["x", "y"]}}) == chat.schema_fingerprint({"a": {"b": ["z"]}})
    with pytest.raises(chat.UnknownLayout):
        chat.canonical_turns({"title": "x"})


def test_against_brute_force(spark):
    ok = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", ok, "r", 1), (-7, 1, "assistant", ok, "r", 1)]
    for c in range(40):
        rows += [(c, t, ["user", "assistant", "system", None][(c + t) % 4], [None, "", f"tê\\xt <|end|> {t}\n"][(c * t) % 3], "", 0) for t in range(c % 7)]
    rows += [(3, 1, "user", "b", "", 0), (3, 1, "user", "a", "", 0), (3, 1, "user", "a", "", 0), (3, None, "assistant", "late", "", 0)]
    rows += [(None, 1, "assistant", "nobody", "", 0), (None, 0, "user", "x", "", 0)]
    rows += [(99, t, "assistant", f"turn {t}", "", 0) for t in range(3000)]
    got = chat.digest(chat.format_rows(spark.createDataFrame(rows, SCHEMA).repartition(5))).collect()
    convs = defaultdict(list)
    for conv_id, turn, role, text, *_ in rows:
        convs[conv_id].append((turn is None, turn or 0, role or "", text or ""))
    assert len(got) == len(convs)
    for r in got:
        turns = [(role, text) for _, _, role, text in sorted(convs[r.conv_id])]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.format_turn(a, b)[0]) for a, b in turns)


def test_records_of_several_layouts(spark):
    said = [("user", "a </s> question"), ("assistant", "an [INST] answer")]
    records = [
        {"messages": [{"role": r, "content": t} for r, t in said]},
        {"conversations": [{"from": {"user": "human", "assistant": "gpt"}[r], "value": t} for r, t in said]},
        {"prompt": said[0][1], "completion": said[1][1]},
        {"instruction": "a </s> question", "input": "", "output": "an [INST] answer"},
        {"question": said[0][1], "answer": said[1][1]},
    ]
    schema = "conv_id long, turn long, by struct<role:string,text:string>, record string"
    rows = [(k, 0, ("", ""), json.dumps(r)) for k, r in enumerate(records)]
    # one conversation of records in two layouts, one without turns
    rows += [(9, 0, ("", ""), json.dumps({"role": "user", "text": said[0][1]})), (9, 1, ("", ""), json.dumps({"messages": [{"role": said[1][0], "content": said[1][1]}]}))]
    rows += [(10, 0, ("", ""), json.dumps({"messages": []}))]
    got = chat.digest(chat.format_records(spark.createDataFrame(rows, schema))).collect()
    assert sorted(r.conv_id for r in got) == [0, 1, 2, 3, 4, 9] and len({tuple(r)[1:] for r in got}) == 1
    want = "".join(f"{r}\n{t}\n" for r, t in said)
    assert got[0].n_turns == 2 and got[0].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_written_output_and_very_long_texts(spark, tmp_path):
    rows = [(1, t, "assistant" if t % 2 else "user", "x<|end|>\\" * (400_000 if t == 1 else t), "", 0) for t in range(40)]
    made = chat.format_rows(spark.createDataFrame(rows, SCHEMA))
    want = chat.digest(made).collect()
    made.repartition(7).write.parquet(f"{tmp_path}/formatted")
    assert chat.digest(spark.read.parquet(f"{tmp_path}/formatted")).collect() == want
    assert want[0].loss_chars == sum(len(r[3]) for r in rows if r[2] == "assistant")


def test_empty(spark):
    assert chat.digest(chat.format_rows(spark.createDataFrame([], SCHEMA))).collect() == []
