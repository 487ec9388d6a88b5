"""Decisions, agreement, caches, certificates, tenants and widths on small cases."""

import os

from pyspark.sql import functions as F

from traceloom.functions import text as tx
from traceloom.operators import optimize, replay
from traceloom.sources import requests


def test_cache_split_against_brute_force(spark):
    bodies = [None, "", "aé" * 40, "aé" * 40, "aé" * 39 + "b", "x" * 5000, "x" * 4999 + "y", "x"]
    rows = spark.createDataFrame([(1, i, b) for i, b in enumerate(bodies)], "trace_id int, turn_index int, body string")
    got = {r.turn_index: (r.read, r.created) for r in replay.cache_split(rows, least=3).collect()}
    last = ""
    for i, b in enumerate(bodies):
        b = b or ""
        read = len(os.path.commonprefix([b, last]).encode()) // 4
        read = read if read >= 3 else 0
        assert got[i] == (read, len(b.encode()) // 4 - read)
        last = b
    assert replay.cache_split(rows.limit(0)).count() == 0


def test_decisions_need_a_call_after_a_stored_block(spark):
    seg = "trace_id string, turn_index int, seg_index int, role string, kind string, tool_name string, original string, effective string"
    rows = spark.createDataFrame([
        ("a", 0, 0, "assistant", "tool-call", "first", None, "1234"), ("a", 1, 0, "user", "tool-result", "first", "x" * 400, "gone"),
        ("a", 2, 1, "assistant", "tool-call", "later", None, "12"), ("a", 2, 0, "assistant", "tool-call", "sooner", None, None), ("a", 3, 0, "assistant", "text", None, None, "bye"),
        ("b", 0, 0, "user", "tool-result", None, "x", "x"), ("b", 1, 0, "assistant", "tool-call", "t", None, "x"),
    ], seg)
    done = spark.createDataFrame([("a", 1, "offload", 400, 40), ("b", 0, "inline", 1, 1)], "trace_id string, turn_index int, outcome string, raw int, sent int")
    assert [tuple(r) for r in replay.decisions(rows, done).collect()] == [("a", 2, "sooner", 101, 11)]
    assert replay.decisions(rows.limit(0), done).count() == 0


def test_agreement_and_changes(spark):
    r = lambda tool, calls=0, bad=False: (tool, calls, 10, 1, bad)
    rows = spark.createDataFrame([
        ("t", r("t"), r("t"), r("t", 2)), ("t", r("t"), r("u"), r("u")), ("t", r(None), r(None), r(None)), ("t", r("t"), r("t"), r("t", 1, True)), ("t", None, r("t"), r("t")),
    ], f"truth string, baseline {replay.REPLY}, control {replay.REPLY}, treatment {replay.REPLY}")
    got = replay.agreement(rows).first().asDict()
    assert got == {"decisions": 4, "errors": 1, "baseline_match": 2, "treatment_match": 2, "same_choice": 2, "same_baseline": 2, "resolved": 1, "input_tokens": 140, "output_tokens": 14}
    assert replay.changed(rows).count() == 2
    assert replay.agreement(rows.limit(0)).first().input_tokens == 0


def test_certificates(spark):
    rows = spark.createDataFrame([('{"b": 1, "a": [1.0]}', '{"a":[1.0],"b":1}', True), ('{"a":1}', '{"a":2}', False), ("plain text", "plain text", True), ("plain text", "plain  text", False), (None, "x", None), ("", "", True)], "raw string, wire string, ok boolean")
    got = rows.select("ok", optimize.verified(F.col("wire"), optimize.certify(F.col("raw"))).alias("got")).collect()
    assert all(r.got == r.ok for r in got)
    raw = "[" + ",".join(f'{{"id":{i},"name":"record {i}"}}' for i in range(60)) + "]"
    one = optimize.optimize(spark.createDataFrame([(raw,)], "raw string"), optimize.Config(offload="off"))
    row = one.select("outcome", optimize.verified(F.col("wire"), optimize.certify(F.col("raw"))).alias("ok")).first()
    assert tuple(row) == ("inline", True)


def test_tenant(spark):
    rows = spark.createDataFrame([(1, {"X-TENANT": " a "}), (2, {"x-tenant": " "}), (3, {}), (4, None), (5, {"x-tenant": "b", "X-Tenant": "a"})], "request_id int, headers map<string,string>")
    assert {r.request_id: r.tenant for r in requests.tenant(rows).collect()} == {1: "a", 2: "", 3: "", 4: "", 5: "a"}


def test_dominant_width(spark):
    rows = spark.createDataFrame([("a b\nc d\ne f g",), ("a b\nc d e",), ("a\nb",), ("",), (None,), ("a b\r\n c\td \n",)], "t string")
    assert [r[0] for r in rows.select(tx.dominant_width("t")).collect()] == [2, 2, None, None, None, 2]
