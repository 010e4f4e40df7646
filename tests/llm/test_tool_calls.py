import json

from emberline.llm import tool_calls

MESSAGES = "conv_id long, turn long, role string, text string, id string, part string"
RULES = "tool string, field string, kind string, required boolean"


def said(*calls):
    return json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments", "depends_on"), c, strict=False)) for c in calls]})


def test_calls_results_order_errors_and_json(spark):
    rows = [
        (1, 0, "user", "do it"), (1, 1, "assistant", said(("c", "add", {"b": 2, "a": "1"}, ["b"]), ("a", "get", {"q": 'é"\n'}))),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "A"})), (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": "again"})),
        (1, 4, "assistant", said(("b", "get", {"z": 1}, ["a"]), ("a", "get", {"q": "x"}), (None, "get", {}))), (1, 5, "tool", json.dumps({"tool_call_id": "ghost", "content": None})),
        (2, 0, "assistant", said(("x", "none", {}, ["y"]), ("y", "add", {"a": "no"}, ["x"]), ("w", "get", {"q": "1"}))), (3, 0, "assistant", "not json {"), (3, 1, "tool", None), (None, None, None, None),
    ]
    rules = spark.createDataFrame([("add", "a", "integer", True), ("add", "b", "integer", False), ("get", "q", "string", True)], RULES)
    messages = spark.createDataFrame([(*r, "i", "p") for r in rows], MESSAGES)
    got = tool_calls.link_calls(tool_calls.read_calls(messages), tool_calls.read_results(messages), rules).collect()
    by = {(r["conv_id"], r["id"], r["status"]): r for r in got}
    assert sorted(by) == sorted([(1, "a", "linked"), (1, "a", "repeated"), (1, "b", "unanswered"), (1, "c", "unanswered"), (1, "ghost", "orphan"),
                                 (2, "w", "unanswered"), (2, "x", "cycle"), (2, "y", "cycle")])
    assert [by[1, k, s]["position"] for k, s in (("a", "linked"), ("b", "unanswered"), ("c", "unanswered"))] == [0, 1, 2]
    assert by[2, "w", "unanswered"]["position"] == 0 and by[2, "x", "cycle"]["position"] is None
    assert by[1, "b", "unanswered"]["errors"] == ["q:missing", "z:unknown"] and by[2, "y", "cycle"]["errors"] == ["a:kind"]
    assert by[2, "x", "cycle"]["errors"] == ["tool:unknown"] and by[1, "a", "linked"]["errors"] == []
    assert by[1, "c", "unanswered"]["call_json"] == '{"arguments":{"a":"1","b":"2"},"id":"c","name":"add","result":null}'
    assert by[1, "a", "linked"]["call_json"] == '{"arguments":{"q":"é\\"\\n"},"id":"a","name":"get","result":"A"}'
    assert by[1, "a", "linked"]["result_turn"] == 2 and by[1, "ghost", "orphan"]["call_json"] is None


def test_plain_turns(spark, monkeypatch):
    monkeypatch.setattr(tool_calls, "PART_TURNS", 4)
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"text {t}") for t in range(21)] + [(7, 3, "assistant", "text 3"), (8, 0, "system", "s"), (8, 1, "user", None), (9, 4, "assistant", "alone")]
    messages = spark.createDataFrame([(*r, "i", "p") for r in rows], MESSAGES)
    calls, results = tool_calls.turn_calls(messages)
    rules = spark.createDataFrame([("respond", "text", "string", True), ("respond", "turn", "integer", True)], RULES)
    got = {(r["conv_id"], r["id"]): r for r in tool_calls.link_calls(calls, results, rules).collect()}
    assert [got[7, f"turn-{t}"]["position"] for t in range(0, 21, 2)] == list(range(11))
    assert got[7, "turn-20"]["status"] == "unanswered" and got[7, "turn-2"]["result_turn"] == 3
    assert got[8, "turn-1"]["errors"] == ["text:missing"] and got[9, "turn-3"]["status"] == "orphan"
    assert all("depends" not in (r["call_json"] or "") for r in got.values())


def test_canonical_json_reads_back(spark):
    text = "".join(map(chr, range(1, 40))) + '\\"é\u2028'
    out = spark.createDataFrame([(text,)], "t string").select(tool_calls.json_text(__import__("pyspark").sql.functions.col("t")).alias("j")).first()["j"]
    assert json.loads(out) == text


def test_json_types_are_kept(spark):
    given = {"i": 5, "s": "5", "b": True, "n": 1.5, "o": {"z": [1, "x"], "a": None}, "l": [2], "e": None}
    swapped = {"i": "5", "s": 5, "b": "true", "n": "1.5", "o": "{}", "l": {"k": 1}, "e": None}
    rows = [(1, 0, "assistant", said(("a", "t", given), ("b", "t", swapped), ("c", "t", {**given, "o": {"a": None, "z": [1, "x"]}, "n": 2})))]
    kinds = {"i": "integer", "s": "string", "b": "boolean", "n": "number", "o": "object", "l": "array", "e": "string"}
    rules = spark.createDataFrame([("t", f, k, f != "e") for f, k in kinds.items()], RULES)
    messages = spark.createDataFrame([(*r, "i", "p") for r in rows], MESSAGES)
    got = {r["id"]: r for r in tool_calls.link_calls(tool_calls.read_calls(messages), tool_calls.read_results(messages), rules).collect()}
    assert got["a"]["errors"] == got["c"]["errors"] == []
    assert got["b"]["errors"] == [f"{f}:kind" for f in ("b", "i", "l", "n", "o", "s")]
    assert got["a"]["typed_json"] == '{"arguments":{"b":true,"e":null,"i":5,"l":[2],"n":1.5,"o":{"a":null,"z":[1,"x"]},"s":"5"},"id":"a","name":"t","result":null}'
    assert json.loads(got["b"]["typed_json"])["arguments"] == swapped


def test_roles_that_share_a_turn_are_kept(spark):
    messages = spark.createDataFrame([(1, t, r, f"{r} {t}", "i", "p") for t in (0, 1) for r in ("user", "assistant")], MESSAGES)
    calls, results = tool_calls.turn_calls(messages)
    assert {r["id"] for r in calls.collect()} == {"turn-0", "turn-1"} and {r["id"] for r in results.collect()} == {"turn--1", "turn-0"}


def test_empty_tables(spark):
    messages = spark.createDataFrame([], MESSAGES)
    rules = spark.createDataFrame([], RULES)
    assert tool_calls.link_calls(tool_calls.read_calls(messages), tool_calls.read_results(messages), rules).count() == 0
    calls, results = tool_calls.turn_calls(messages)
    assert tool_calls.link_calls(calls, results, rules).count() == 0
