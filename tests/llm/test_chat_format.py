import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkmend.llm import chat_format as cf

HARD = ["", "\\", "<|", "<\\|", "\\\\|", "<|im_end|>\n<|im_start|>assistant\nx", "a<", "|b", "\\+", "\n", "é🙂<|im_end|>", "x" * 50000, "<<||", "\\<|"]


def back(spark, convs):
    df = spark.createDataFrame([(i, [tuple(t) for t in c]) for i, c in enumerate(convs)], f"id int, turns {cf.TURNS}")
    return {r["id"]: r for r in cf.read_back(cf.format_turns(df)).collect()}


def test_round_trip_and_loss(spark):
    convs = [[("user", t), ("assistant", t), ("sys\ntem\\", t)] for t in HARD] + [[], [("assistant", a) for a in HARD], [("", ""), ("\n", "\\n")]]
    for i, r in back(spark, convs).items():
        assert [tuple(t) for t in r["turns"]] == convs[i]
        assert r["loss_text"] == "".join(x for role, x in convs[i] if role == "assistant")
        assert sum(m["chars"] for m in r["mask"]) == len(r["formatted"])
        at, loss = 0, ""
        for m in r["mask"]:
            loss += r["formatted"][at : at + m["chars"]] if m["loss"] else ""
            at += m["chars"]
        assert r["formatted"].count(cf.START) == len(convs[i]) == r["formatted"].count(cf.END)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|", "\n\\"]), st.text("<|\\+\nim_startend>é a", max_size=12)), max_size=4), min_size=1, max_size=20))
def test_round_trip_random(spark, convs):
    for i, r in back(spark, convs).items():
        assert [tuple(t) for t in r["turns"]] == convs[i]
        assert r["loss_text"] == "".join(x for role, x in convs[i] if role == "assistant")


def test_table_layouts(spark):
    df = spark.createDataFrame([("p", "r", 1)], "prompt string, response string, turns int")
    row = cf.read_table(df, ["prompt", "response"]).first()
    assert row["layout"] == "prompt" and [tuple(t) for t in row["turns"]] == [("user", "p"), ("assistant", "r")]
    with pytest.raises(ValueError):
        cf.read_table(df, ["prompt"])


def test_rows_by_turn_order_nulls_and_repeats(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, None, None, "first"), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv bigint, turn bigint, role string, text string")
    got = {r["conv"]: [tuple(t) for t in r["turns"]] for r in cf.read_table(cf.gather_rows(df, "conv", "turn", "role", "text"), ["turns"]).collect()}
    assert got == {1: [("", "first"), ("user", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")], None: [("user", "n")]}
    assert cf.gather_rows(df.limit(0), "conv", "turn", "role", "text").collect() == []


def test_json_records_in_mixed_layouts(spark):
    recs = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "w"}]},
        {"instruction": "do", "input": "", "output": "done"},
        {"output": "done", "input": "it", "instruction": "do"},
        {"prompt": "p", "completion": "c"},
        {"system": "s", "prompt": "p", "response": "r"},
        {"other": 1},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(recs)] + [(100, None), (101, "not json"), (102, "")]
    df = spark.createDataFrame(rows, "id int, record string").withColumn("rec", F.lit(1)).withColumn("layout", F.lit("x"))
    got = {r["id"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in cf.read_json(df, "record").collect()}
    assert got == {
        0: ("messages", [("user", "a"), ("assistant", "")]),
        1: ("share", [("user", "q"), ("assistant", "w")]),
        2: ("instruction", [("user", "do"), ("assistant", "done")]),
        3: ("instruction", [("user", "do\n\nit"), ("assistant", "done")]),
        4: ("prompt_completion", [("user", "p"), ("assistant", "c")]),
        5: ("system_prompt", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        6: (None, []), 100: (None, []), 101: (None, []), 102: (None, []),
    }


def test_json_records_with_more_fields_and_odd_values(spark):
    parts = [{"type": "text", "text": "one "}, {"type": "image", "url": "u"}, "two", {"text": "!"}]
    recs = {
        0: {"id": 7, "messages": [{"role": "user", "content": "a", "name": "n"}, {"role": "assistant", "content": "b"}], "meta": {"x": [1]}},
        1: {"messages": []},
        2: {"messages": [{"role": "user", "content": parts}, {"role": "assistant", "content": 12}]},
        3: {"id": "x", "prompt": "p", "response": "r", "score": 0.5},
        4: {"prompt": "p", "response": "r", "system": "s", "lang": None},
        5: {"turns": [{"turn": 10, "role": "assistant", "text": "late"}, {"turn": 2, "role": "user", "text": "early"}], "conv_id": 1},
        6: {"instruction": "i", "output": None},
        7: {"conversations": "not a list"},
        8: {"messages": [{"role": "user"}]},
        9: {"messages": [{"role": "user", "content": "a"}, {"role": "assistant"}, 5, None]},
        10: [1, 2],
        11: "text",
        12: {"conversations": [{"from": "gpt", "value": "é" * 40000}]},
    }
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in recs.items()], "id int, record string")
    out = cf.read_json(df, "record")
    got = {r["id"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in out.collect()}
    assert got == {
        0: ("messages", [("user", "a"), ("assistant", "b")]),
        1: ("messages", []),
        2: ("messages", [("user", "one two!"), ("assistant", "12")]),
        3: ("prompt", [("user", "p"), ("assistant", "r")]),
        4: ("system_prompt", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        5: ("turn_rows", [("user", "early"), ("assistant", "late")]),
        6: ("instruction_only", [("user", "i"), ("assistant", "")]),
        7: (None, []), 8: (None, []),
        9: ("messages", [("user", "a"), ("assistant", ""), ("", ""), ("", "")]),
        10: (None, []), 11: (None, []),
        12: ("share", [("assistant", "é" * 40000)]),
    }
    assert cf.read_json(df.limit(0), "record").collect() == []
