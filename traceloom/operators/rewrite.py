"""Request bodies whose tool outputs are replaced by what the optimiser chose for them.

A decision follows from the block's text and from whether the request has a resolver, and from nothing else. So a
block that a conversation sends again gets the same bytes each time, without state, and what was sent before stays
as it was. Without a resolver nothing is stored away, as nobody could ask for it. Answers of the resolver itself,
empty outputs and those with more than text in them stay as they are."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions import jsontext as js
from traceloom.operators import optimize
from traceloom.shipping import ship
from traceloom.sources import requests as src

HOLD_TURNS = 4


def held(age, hold_turns: int = HOLD_TURNS):
    """A stub is held back while fewer than hold_turns model turns follow the block."""
    return F.col(age) < hold_turns if isinstance(age, str) else age < hold_turns


def decide(requests: DataFrame, config: optimize.Config = optimize.Config(), hold_turns: int = 0, resolver: str | None = None) -> DataFrame:
    """Of requests (request_id, body) each block that may be rewritten: request_id, shape, pos, sub, tool_use_id, age,
    has_resolver, the choice (outcome, codec, wire, id, kept_reason, units, sent), canonical, key, and first_seen.

    resolver: one that the requests have without naming it. hold_turns: see held(). first_seen: of the rewritten
    blocks with a text, and likewise of those kept, the first in order of request_id and place."""
    asked = requests.select("request_id", F.lit(resolver).alias("resolver")) if resolver else src.resolver(requests)
    blocks = src.without_exempt(src.blocks(requests), src.calls(requests), asked)
    has = asked.select("request_id", F.lit(True).alias("has_resolver"))
    blocks = blocks.where("plain and raw <> ''").drop("plain").join(has, "request_id", "left").withColumn("has_resolver", F.coalesce("has_resolver", F.lit(False)))
    both = optimize.candidates(blocks, config).withColumn("may_store", F.explode(F.array(F.lit(True), F.lit(False))))
    choices = optimize.choose(both, config).withColumnRenamed("may_store", "has_resolver")
    rows = blocks.join(choices, ["raw", "has_resolver"])
    wait = (F.col("outcome") == "offload") & held("age", hold_turns)
    instead = {"codec": F.lit(None), "id": F.lit(None), "kept_reason": F.lit("held"), "sent": F.col("units"), "wire": F.col("raw"), "outcome": F.lit("verbatim")}
    rows = rows.withColumns({c: F.when(wait, v).otherwise(F.col(c)) for c, v in instead.items()})
    rows = rows.withColumn("key", optimize.content_id(F.col("raw"))).withColumn("__done", F.col("outcome") != "verbatim")
    place = F.struct("request_id", "pos", "sub")
    first = rows.groupBy("key", "__done").agg(F.min(place).alias("__first"))
    return rows.join(first, ["key", "__done"]).withColumn("first_seen", place == F.col("__first")).drop("__done", "__first", "certificate", "atoms")


def _put(body: str, shape: str, edits) -> str:
    value, ok = js.try_parse(body)
    if not ok or js.has_duplicate_keys(body):
        return body
    for e in edits:
        at, wire = value["input" if shape == "responses" else "messages"][e["pos"]], e["wire"]
        if shape == "responses":
            at["output"] = wire
        elif shape == "converse":
            at["content"][e["sub"]]["toolResult"]["content"] = [{"text": wire}]
        else:
            at = at if shape == "chat" else at["content"][e["sub"]]
            at["content"] = [{"type": "text", "text": wire}] if isinstance(at["content"], list) else wire
    return js.dump(value)


def bodies(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """requests with the decided wires in their bodies. A body that has none to take, or repeats a key in an object, stays
    as it is, byte by byte; others are written compactly, with their keys in order and numbers by their text."""
    ship(requests.sparkSession)

    @F.pandas_udf("string")
    def put(body: pd.Series, shape: pd.Series, edits: pd.Series) -> pd.Series:
        return pd.Series([b if e is None else _put(b, s, e) for b, s, e in zip(body, shape, edits)])

    edits = decisions.where("outcome <> 'verbatim'").groupBy("request_id").agg(F.first("shape").alias("__shape"), F.collect_list(F.struct("pos", "sub", "wire")).alias("__edits"))
    return requests.join(edits, "request_id", "left").withColumn("body", put("body", "__shape", "__edits")).drop("__shape", "__edits")


def restored(requests: DataFrame, store: DataFrame) -> DataFrame:
    """request_id, tool_use_id, text: the blocks of rewritten bodies as they were: wires decoded, markers looked up in the store."""
    from traceloom.functions.text import marker_id

    ship(requests.sparkSession)
    rows = src.blocks(requests).select("request_id", "tool_use_id", "raw").withColumn("id", marker_id("raw"))
    kept = store.select("id", F.col("raw").alias("__stored"))
    return rows.join(kept, "id", "left").select("request_id", "tool_use_id", F.coalesce("__stored", optimize.decoded("raw")).alias("text"))
