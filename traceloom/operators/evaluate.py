"""The optimiser over recorded sessions: what each tool result would have become, and whether it was missed later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions import commands
from traceloom.functions import text as tx
from traceloom.operators import optimize, pairing, reopen


def evaluate(segments: DataFrame, config: optimize.Config = optimize.Config(), policy: DataFrame | None = None, threshold: float = reopen.THRESHOLD) -> DataFrame:
    """segments: trace_id, turn_index, seg_index, role, kind, tool_name, tool_use_id, original, effective, context_tokens.

    A row for each tool result with a body (original, else effective): trace_id, turn_index, seg_index, tool, class,
    shape, outcome, raw, sent (bytes), reopened, faithful, prompt, context_tokens, turns_after, preview. Under a policy,
    a block whose predicted reopen rate is at the threshold or above is not stored away. Blocks are compared within
    their trace only. reopen.tally() sums the rows, reopen.learn() makes a policy of them."""
    place = ["trace_id", "turn_index", "seg_index"]
    body = F.coalesce("original", "effective")
    results = segments.where((F.col("kind") == "tool-result") & (F.coalesce(body, F.lit("")) != "")).select(*place, "tool_use_id", F.col("tool_name").alias("tool"), body.alias("raw"))
    calls = segments.where("kind = 'tool-call' and tool_use_id is not null").select("trace_id", "tool_use_id", F.col("effective").alias("input"), F.struct("turn_index", "seg_index").alias("pos"))
    blocks = pairing.with_call(results, calls).withColumn("class", commands.class_of(F.col("tool"), F.col("input"))).drop("input", "tool_use_id").withColumn("may_store", F.lit(True))
    if policy is not None:
        sized = blocks.withColumnRenamed("raw", "__body").withColumn("raw", F.octet_length("__body"))
        blocks = reopen.predict(sized, policy, threshold).withColumn("may_store", F.col("allows_offload")).drop("raw", "predicted", "allows_offload").withColumnRenamed("__body", "raw")
    both = optimize.candidates(blocks, config).withColumn("may_store", F.explode(F.array(F.lit(True), F.lit(False))))
    got = blocks.join(optimize.choose(both, config), ["raw", "may_store"])
    got = optimize.faithful(got, optimize.to_store(got, 0))

    stubs = got.where("outcome = 'offload'").select("trace_id", "turn_index", F.col("seg_index").alias("block"), F.col("raw").alias("body"), F.col("wire").alias("preview"))
    missed = reopen.reopened(stubs, segments).where("reopened").select("trace_id", "turn_index", F.col("block").alias("seg_index"), "reopened")
    prompt = F.when((F.col("kind") == "text") & (F.trim("effective") != ""), F.struct("seg_index", "effective"))
    turns = segments.groupBy("trace_id", "turn_index").agg(F.first("role").alias("role"), F.coalesce(F.min(prompt)["effective"], F.lit("")).alias("effective"), F.max("context_tokens").alias("context_tokens"))
    beside = reopen.turn_context(turns).withColumnRenamed("next_context", "context_tokens")
    rows = got.join(missed, place, "left").join(beside, ["trace_id", "turn_index"])
    return rows.select(
        *place, "tool", "class", tx.shape("raw").alias("shape"), "outcome", F.col("units").alias("raw"), "sent", F.coalesce("reopened", F.lit(False)).alias("reopened"), "faithful",
        "prompt", "context_tokens", "turns_after", F.when(F.col("outcome") == "offload", tx.preview_kind("wire")).otherwise("").alias("preview"),
    )
