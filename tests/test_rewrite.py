"""Rewritten bodies, decisions that wait, gates, and what the optimiser refuses."""

import json

from pyspark.sql import functions as F

from traceloom.operators import evaluate, optimize, rewrite
from traceloom.sources import requests

ROWS = json.dumps([{"id": i, "name": f"record {i}", "kind": "file"} for i in range(60)])


def bodies(spark, *values):
    return spark.createDataFrame([(i, v if isinstance(v, str) or v is None else json.dumps(v)) for i, v in enumerate(values)], "request_id long, body string")


def result(content, id_="a"):
    return {"type": "tool_result", "tool_use_id": id_, "content": content}


def test_a_string_that_reads_like_a_list_is_kept(spark):
    got = requests.blocks(bodies(spark, {"messages": [{"role": "user", "content": [result("[1, 2]"), result([{"type": "text", "text": "x"}, {"type": "image"}]), result(None), result([])]}]}))
    assert [(r["raw"], r["plain"]) for r in got.orderBy("sub").collect()] == [("[1, 2]", True), ("x\n[image]", False), ("", True), ("", True)]


def test_rewritten_bodies(spark):
    plain = {"messages": [{"role": "user", "content": [result(ROWS), result([{"type": "text", "text": ROWS}]), result([{"type": "text", "text": ROWS}, {"type": "image"}])]}], "n": 1}
    twice = '{"n":1,"n":2,' + json.dumps(plain)[1:]
    b = bodies(spark, plain, twice, '{ "messages": [] }', "no json", None)
    done = rewrite.decide(b, optimize.Config(offload="off"))
    assert {(r["sub"], r["outcome"], r["first_seen"]) for r in done.where("request_id = 0").collect()} == {(0, "inline", True), (1, "inline", False)}
    out = {r["request_id"]: r["body"] for r in rewrite.bodies(b, done).collect()}
    assert out[1] == twice and out[2] == '{ "messages": [] }' and out[3] == "no json" and out[4] is None
    parts = json.loads(out[0])["messages"][0]["content"]
    assert len(parts[0]["content"]) < len(ROWS) and parts[1]["content"] == [{"type": "text", "text": parts[0]["content"]}]
    assert parts[2] == plain["messages"][0]["content"][2] and out[0].endswith('"n":1}')
    back = rewrite.restored(bodies(spark, out[0]), optimize.to_store(done, 0)).where("tool_use_id = 'a'").collect()
    assert json.loads(back[0]["text"]) == json.loads(ROWS)


def test_stubs_need_a_resolver_and_wait(spark):
    turns = [{"role": "assistant", "content": "k"}] * 3
    body = {"messages": [{"role": "user", "content": [result(ROWS)]}, *turns]}
    b = bodies(spark, body | {"tools": [{"name": "resolve"}]}, body)
    always = optimize.Config(offload="always")
    outcome = lambda hold, **k: [(r["outcome"], r["kept_reason"]) for r in rewrite.decide(b, always, hold, **k).orderBy("request_id").collect()]
    assert outcome(3) == [("offload", None), ("inline", None)]
    assert outcome(4) == [("verbatim", "held"), ("inline", None)]
    assert outcome(0, resolver="own") == [("offload", None), ("offload", None)]


def test_a_number_changed_under_a_key_is_refused():
    assert optimize._same_numbers("port = 80\nhost: 1", "port = 80")
    assert not optimize._same_numbers("port = 80\nhost: 1", "port = 81")
    assert optimize._same_numbers("a=1 a=2", "a=3") and optimize._same_numbers("a=1", "")


def test_a_policy_keeps_blocks_from_being_stored(spark):
    schema = "trace_id long, turn_index int, seg_index int, role string, kind string, tool_name string, tool_use_id string, original string, effective string, context_tokens long"
    word = "identifier_of_record_59_only"
    body = "\n".join(f"paragraph {i} tells about {word if i == 59 else 'matters'}" for i in range(120))
    s = spark.createDataFrame([(1, 0, 0, "user", "text", None, None, None, "look", None), (1, 1, 0, "assistant", "tool-call", "Read", "a", None, "{}", 7), (1, 2, 0, "user", "tool-result", "Read", "a", None, body, None), (1, 3, 0, "assistant", "text", None, None, None, f"found {word}", 9)], schema)
    always = optimize.Config(offload="always")
    got = evaluate.evaluate(s, always).collect()
    assert [(r["class"], r["outcome"], r["faithful"], r["prompt"], r["turns_after"], r["context_tokens"]) for r in got] == [("Read", "offload", True, "look", 1, 9)]
    assert got[0]["reopened"] is True
    # what the model was not shown cannot be missed: turns count by their effective text
    cut = s.withColumns({"original": F.when(F.col("kind") == "tool-result", F.col("effective")), "effective": F.when(F.col("kind") == "tool-result", "cut").otherwise(F.col("effective"))})
    assert [r["reopened"] for r in evaluate.evaluate(cut, always).collect()] == [False]
    for rate, outcome in ((0.9, False), (0.1, True)):
        policy = spark.createDataFrame([(None, None, 50, 0.2), ("Read", None, 50, rate)], "class string, band string, n long, rate double")
        assert [r["outcome"] == "offload" for r in evaluate.evaluate(s, always, policy).collect()] == [outcome]
