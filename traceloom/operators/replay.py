"""Recorded replays: which turns of a session put a choice to the model, whether it chose the same over the rewritten
context, and what a provider's prefix cache would have billed. Asking a model is not part of this; its replies are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BYTES_A_TOKEN = 4
#: Tokens that a shared prefix needs to be cached. Fixed value.
LEAST_CACHED = 1024
REPLY = "struct<tool: string, resolve_calls: bigint, input_tokens: bigint, output_tokens: bigint, errored: boolean>"


def decisions(segments: DataFrame, outcomes: DataFrame) -> DataFrame:
    """trace_id, turn_index, truth (the tool that the assistant's turn called first), tokens, sent_tokens: of the turns
    that call a tool after some block was stored away.

    segments: trace_id, turn_index, seg_index, role, kind, tool_name, original, effective. outcomes: of evaluate().
    Both token counts are of everything before the turn, by bytes: as it was, and with the blocks' wires in place."""
    size = F.coalesce(F.octet_length(F.coalesce("original", "effective")), F.lit(0)).cast("long")
    call = F.when((F.col("role") == "assistant") & (F.col("kind") == "tool-call") & F.col("tool_name").isNotNull(), F.struct("seg_index", "tool_name"))
    turns = segments.groupBy("trace_id", "turn_index").agg(F.min(call)["tool_name"].alias("truth"), F.sum(size).alias("__size"))
    saved = outcomes.groupBy("trace_id", "turn_index").agg(F.sum(F.col("raw") - F.col("sent")).cast("long").alias("__saved"), F.max(F.col("outcome") == "offload").alias("__stored"))
    before = Window.partitionBy("trace_id").orderBy("turn_index").rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.join(saved, ["trace_id", "turn_index"], "left")
    rows = rows.withColumns({
        "__all": F.sum("__size").over(before), "__less": F.coalesce(F.sum("__saved").over(before), F.lit(0)), "__any": F.coalesce(F.max("__stored").over(before), F.lit(False)),
    })
    return rows.where("truth is not null and __any").select("trace_id", "turn_index", "truth", F.expr(f"__all div {BYTES_A_TOKEN}").alias("tokens"), F.expr(f"(__all - __less) div {BYTES_A_TOKEN}").alias("sent_tokens"))


def _failed():
    return F.coalesce(F.col("baseline.errored") | F.col("control.errored") | F.col("treatment.errored"), F.lit(False))


def agreement(replies: DataFrame) -> DataFrame:
    """One row over replies (truth; baseline, control and treatment, each a REPLY).

    A decision with an error in one of its three replies counts in errors and tokens only. control answers the
    baseline's request once more: same_baseline is the agreement that chance leaves, to hold same_choice against."""
    fine = ~_failed()
    tool = lambda a: F.col(f"{a}.tool")
    n = lambda test: F.count_if(fine & test)
    tokens = lambda which: F.coalesce(F.sum(sum((F.coalesce(F.col(f"{a}.{which}"), F.lit(0)) for a in ("control", "treatment")), F.coalesce(F.col(f"baseline.{which}"), F.lit(0)))), F.lit(0)).alias(which)
    return replies.agg(
        F.count_if(fine).alias("decisions"), F.count_if(~fine).alias("errors"), n(tool("baseline") == F.col("truth")).alias("baseline_match"), n(tool("treatment") == F.col("truth")).alias("treatment_match"),
        n(tool("baseline").eqNullSafe(tool("treatment"))).alias("same_choice"), n(tool("baseline").eqNullSafe(tool("control"))).alias("same_baseline"), n(F.col("treatment.resolve_calls") > 0).alias("resolved"),
        tokens("input_tokens"), tokens("output_tokens"),
    )


def changed(replies: DataFrame) -> DataFrame:
    """The replies, free of errors, whose choice over the rewritten context is another than before."""
    return replies.where(~_failed() & ~F.col("baseline.tool").eqNullSafe(F.col("treatment.tool")))


def cache_split(requests: DataFrame, least: int = LEAST_CACHED) -> DataFrame:
    """requests (trace_id, turn_index, body) with the tokens read from the cache and those created.

    Read is what the body shares, from its start, with the one before it in its trace; below `least` tokens, nothing.
    A null body is an empty one. The prefix is found by halving, so it stays in the JVM."""
    order = Window.partitionBy("trace_id").orderBy("turn_index")
    rows = requests.withColumn("body", F.coalesce("body", F.lit(""))).withColumn("__last", F.coalesce(F.lag("body").over(order), F.lit("")))
    most = F.least(F.length("body"), F.length("__last"))
    halves = F.sequence(F.lit(0), F.lit(30))
    step = lambda at, i: F.when((at + F.pow(F.lit(2), 30 - i).cast("int") <= most) & (F.substring(F.col("body"), at + 1, F.pow(F.lit(2), 30 - i).cast("int")) == F.substring(F.col("__last"), at + 1, F.pow(F.lit(2), 30 - i).cast("int"))), at + F.pow(F.lit(2), 30 - i).cast("int")).otherwise(at)
    shared = F.aggregate(halves, F.lit(0), step)
    tokens = lambda text: F.expr(f"octet_length({text}) div {BYTES_A_TOKEN}")
    rows = rows.withColumn("__shared", shared).withColumn("__same", F.substring(F.col("body"), F.lit(1), F.col("__shared")))
    read = F.when(tokens("__same") >= least, tokens("__same")).otherwise(F.lit(0).cast("long"))
    return rows.withColumn("read", read).withColumn("created", tokens("body") - F.col("read")).drop("__last", "__shared", "__same")


def cache_cost(split: DataFrame, read_rate: float, create_rate: float) -> DataFrame:
    """Per trace: turns, read, created and the cost in units of an input token."""
    return split.groupBy("trace_id").agg(
        F.count("*").alias("turns"), F.sum("read").alias("read"), F.sum("created").alias("created"), F.round(F.sum("read") * read_rate + F.sum("created") * create_rate, 6).alias("cost")
    )
