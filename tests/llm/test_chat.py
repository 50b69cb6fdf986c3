import json
from collections import Counter

from frameprobe.llm import chat

SCHEMAS = {"add": {"a": ("integer", True, 0), "b": ("number", False, 0), "note": ("string", False, 2)}}
CALLS = "conv_id long, call_id string, position long, name string, arguments string, after array<string>"
RESULTS = "conv_id long, call_id string, position long, content string"


def test_links_order_and_validation(spark):
    calls = [(1, "x", 0, "add", '{"b": 1.5, "a": 2}', []), (1, "y", 1, "add", '{"a": "2"}', ["x"]), (1, "z", 2, "none", "{}", []),
             (2, "p", 0, "add", '{"a":1,"note":"k"}', ["q"]), (2, "q", 1, "add", '{"a":1,"note":"kk"}', ["r"]), (2, "r", 2, "add", "[1]", []),
             (3, "u", 0, "add", "no json", ["v"]), (3, "v", 1, "add", None, ["u"]), (3, "w", 2, "add", '{"a":null}', ["v"]),
             (4, "s", 0, "add", '{"a":1}', ["gone"]), (None, None, None, None, None, None)]
    results = [(1, "x", 5, "late"), (1, "x", 3, "first"), (1, "nobody", 4, "o"), (2, None, 1, "n")]
    got = chat.linked(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    rows = {(r.conv_id, r.call_id, r.status == "orphan"): r for r in got}
    assert len(got) == len(calls) + 2
    assert rows[1, "x", False].json == '{"arguments":{"a":2,"b":1.5},"id":"x","name":"add","result":"first"}'
    assert [rows[1, c, False].valid for c in "xyz"] == [True, False, False]
    assert [rows[1, c, False].status for c in "xyz"] == ["linked", "unanswered", "unanswered"]
    assert [rows[2, c, False].seq for c in "rqp"] == [1, 2, 3]
    assert [rows[2, c, False].valid for c in "pqr"] == [False, True, False]
    assert [rows[3, c, False].status for c in "uvw"] == ["cyclic"] * 3 and rows[3, "u", False].seq is None
    assert rows[4, "s", False].seq == 1 and rows[1, "nobody", True].result_position == 4 and rows[2, None, True].status == "orphan"


def test_numbers_by_value_and_arguments_that_are_no_json(spark):
    texts = ['{"a":1.0}', '{"a":1e0}', '{"a":1}', '{"a":1.50}', '{"a":123456789012345678901234567890}', '{"a":1,"a":2}', '{"a":', None,
             '{"a":2,"note":"v1.0, \\"x\\":3.0}"}', '{"a":-4.0,"b":[1.0,2.5,{"c":10.0}]}', '{"a":"1.0"}']
    calls = spark.createDataFrame([(1, f"{i:02}", i, "add", t, []) for i, t in enumerate(texts)], CALLS)
    got = chat.linked(calls, spark.createDataFrame([], RESULTS), SCHEMAS).orderBy("call_id").collect()
    assert [r.valid for r in got] == [True, True, True, False, True, False, False, False, True, False, False]
    assert [r.json.split(',"id"')[0] for r in got[:5]] == [
        '{"arguments":{"a":1}', '{"arguments":{"a":1}', '{"arguments":{"a":1}', '{"arguments":{"a":1.5}', '{"arguments":{"a":123456789012345678901234567890}']
    assert [json.loads(got[i].json).get("raw") for i in (5, 6, 7)] == texts[5:8]
    assert json.loads(got[8].json)["arguments"] == {"a": 2, "note": 'v1.0, "x":3.0}'}
    assert got[9].json.startswith('{"arguments":{"a":-4,"b":[1,2.5,{"c":10}]}')


def test_order_of_calls_that_wait_for_later_ones(spark):
    """Any order that ``seq`` gives respects ``after``; the least position comes first among free calls of a level."""
    calls = [(c, f"k{i}", i, "add", '{"a":1}', [f"k{j}" for j in ((i * 7 + 3 + c) % 9, (i * 5 + 1) % 9) if (j * 4 + c) % 9 < (i * 4 + c) % 9])
             for c in range(20) for i in range(9)]
    got = chat.linked(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), SCHEMAS).collect()
    seq = {(r.conv_id, r.call_id): r.seq for r in got}
    assert all(seq[c, d] < seq[c, k] for c, k, _, _, _, after in calls for d in after)
    assert all(sorted(seq[c, f"k{i}"] for i in range(9)) == list(range(1, 10)) for c in range(20))


def test_every_turn_without_rows_and_with_clashing_columns(spark):
    schema = "conv_id long, turn long, role string, text string, call_id string, position string, json long, status long"
    rows = [(1, 0, "user", "q" * 100_000, "x", "y", 1, 2), (1, 1, "assistant", None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    assert chat.every_turn(df.limit(0)).count() == 0
    assert sorted(r.status for r in chat.every_turn(df).collect()) == ["linked", "other"]


def test_plain_turns(spark):
    turns = [(1, 0, "assistant", "hi"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", ""), (2, 0, "user", None), (None, 0, "user", "n")]
    calls, results = chat.turns_as_calls(spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, after string"))
    got = {(r.conv_id, r.call_id): r for r in chat.linked(calls, results, chat.REPLY).collect()}
    assert got[1, "1:1"].status == "linked" and got[1, "1:3"].valid is False and got[1, None].status == "orphan"
    assert got[2, "2:0"].valid is False and (None, "null:0") in got


def test_every_turn_has_a_place(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "assistant", "b"), (1, 3, "assistant", "b"),
             (1, 4, "tool", "t"), (1, 5, None, "no role"), (1, 6, "user", "r"), (2, 0, "assistant", "early"), (2, 1, "assistant", None),
             (None, 0, "system", "s"), (None, 1, "user", "n"), (None, 2, "assistant", "m"), (None, 3, "assistant", "o")]
    got = chat.every_turn(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    found = Counter()
    for r in got:
        held = json.loads(r.json)
        if r.position is not None:
            found[r.conv_id, r.position, held["arguments"]["text"] if "arguments" in held else held["text"]] += 1
        if r.result_position is not None:
            found[r.conv_id, r.result_position, held.get("result")] += 1
    assert found == Counter((c, n, t) for c, n, _, t in turns)
    states = Counter(r.status for r in got)
    assert states == {"system": 2, "other": 2, "linked": 1, "duplicate": 2, "unanswered": 2, "orphan": 4}
    assert {(r.result_position, r.call_id) for r in got if r.status == "duplicate"} == {(3, "1:1")}


def test_no_turns(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.linked(*chat.turns_as_calls(turns), chat.REPLY).count() == 0
