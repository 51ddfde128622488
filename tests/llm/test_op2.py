import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadmill.llm import op2_chat as op

CHARS = st.text(alphabet=st.sampled_from("\\<>/turn \nauser#é😀:"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), CHARS), CHARS), max_size=5))
def test_reads_back(turns):
    formatted, spans = op.render(turns)
    assert op.parse(formatted) == turns
    assert [op.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


@pytest.mark.parametrize("record,layout,turns", [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, "messages", [("user", "a"), ("assistant", "b")]),
    ({"system": "s", "messages": [{"role": "user", "content": "a"}]}, "messages", [("system", "s"), ("user", "a")]),
    ({"id": "1", "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "conversations", [("user", "a"), ("assistant", "b")]),
    ({"instruction": "do", "input": "x", "output": "y"}, "instruction", [("user", "do\n\nx"), ("assistant", "y")]),
    ({"instruction": "do", "output": "y", "input": None}, "instruction", [("user", "do"), ("assistant", "y")]),
    ({"prompt": "p", "response": "r"}, "prompt_response", [("user", "p"), ("assistant", "r")]),
    ({"prompt": "p", "completion": "r"}, "prompt_completion", [("user", "p"), ("assistant", "r")]),
    ({"question": "p", "answer": "r"}, "question_answer", [("user", "p"), ("assistant", "r")]),
    ({"role": "user", "text": "t"}, "row", [("user", "t")]),
    ({"role": "assistant"}, "row", [("assistant", "")]),
    ({"odd": 1}, None, []), ({"prompt": 3, "response": "x"}, None, []), ({"messages": []}, None, []),
])
def test_layouts(record, layout, turns):
    assert op.turns_of(json.dumps(record)) == (layout, turns)


def test_not_a_record():
    for x in (None, "", "{", "[1]", "3"):
        assert op.turns_of(x) == (None, [])


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((t, r is not None, r or "", x is not None, x or "") for c, t, r, x in rows if c == conv)
        turns = [(r, x) for _, _, r, _, x in turns]
        loss = "".join(x for r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss), len(op.render(turns)[0]))
    return out


def test_rows(spark):
    rows = [(1, 0, "user", "hi <b>\\"), (1, 1, "assistant", None), (1, 1, "assistant", "é😀"), (2, 0, None, "x"), (2, 0, None, "x"), (None, 5, "assistant", "</turn>\n<turn user>\n")]
    rows += [(3, i, "assistant" if i % 2 else "user", f"t{i}" * 50) for i in range(3000)]
    df = spark.createDataFrame([(*r, "n") for r in rows], "conv_id long, turn long, role string, text string, record string")
    got = {r.conv_id: tuple(r)[1:] for r in op.of(spark, df).collect()}
    assert got == brute(rows + [(-7, 0, "user", op.ADDED), (-7, 1, "assistant", op.ADDED)])
    assert op.of(spark, df.limit(0)).count() == 1


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in op.of(spark, df).collect()}
    assert got == brute(rows + [(-7, 0, "user", op.ADDED), (-7, 1, "assistant", op.ADDED)])


@pytest.mark.parametrize("record,layout,turns", [
    ({"source": "web", "messages": [{"role": "user", "content": "a"}]}, "messages", [("user", "a")]),
    ({"id": 5, "messages": [{"role": "user", "content": "a", "weight": 1, "meta": {"x": [1]}}]}, "messages", [("user", "a")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, "messages_parts", [("user", "a\nb")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}]}, {"role": "assistant", "content": "c"}], "n": 2}, "messages_parts", [("user", "a"), ("assistant", "c")]),
    ({"messages": [{"role": "user", "content": [{"type": "image", "url": "u"}, {"type": "text", "text": "what"}]}]}, "messages_parts", [("user", "\nwhat")]),
    ({"messages": [], "prompt": "p", "response": "r"}, "prompt_response", [("user", "p"), ("assistant", "r")]),
    ({"system": "s", "id": 1, "score": 0.5, "conversations": [{"from": "human", "value": "a"}]}, "conversations", [("system", "s"), ("user", "a")]),
    ({"instruction": "do", "output": "y", "tags": ["a"]}, "instruction", [("user", "do"), ("assistant", "y")]),
    ({"role": "user", "text": "t", "lang": "en"}, "row", [("user", "t")]),
    ({"text": "a page", "url": "u"}, None, []), ({"role": 3, "text": "t"}, None, []), ({"messages": [3], "x": 1}, None, []), ({"prompt": 3, "response": "x", "y": 1}, None, []),
])
def test_layouts_beside_other_fields(record, layout, turns):
    assert op.turns_of(json.dumps(record)) == (layout, turns)


def test_clashing_names(spark):
    df = spark.createDataFrame([('{"role": "user", "text": "t"}', 1, "x")], "record string, turns int, _formatted string")
    got = op.format_records(df).first()
    assert got.turns[0].text == "t" and got._formatted == "x" and got.layout == "row"
