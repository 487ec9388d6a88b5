"""Joins that put a segment's original, its call and its tool name beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair(segments: DataFrame, captures: DataFrame) -> DataFrame:
    """Tool results whose on-wire text (tool_use_id, content) differs: what was read becomes the original."""
    wire = captures.select(F.col("tool_use_id").alias("__id"), F.col("content").alias("__wire"))
    rows = segments.join(wire, segments["tool_use_id"] == wire["__id"], "left")
    result = F.col("kind") == "tool-result" if "kind" in segments.columns else F.lit(True)
    swap = result & F.col("__wire").isNotNull() & F.col("original").isNull() & (F.col("__wire") != F.col("effective"))
    return rows.withColumns({"original": F.when(swap, F.col("effective")).otherwise(F.col("original")), "effective": F.when(swap, F.col("__wire")).otherwise(F.col("effective"))}).drop("__id", "__wire")


def latest_capture(captures: DataFrame) -> DataFrame:
    """tool_use_id and content, of the last record that has it (captured_at_ms, line)."""
    rows = captures.select("captured_at_ms", "line", F.posexplode("tool_results").alias("i", "r"))
    return rows.groupBy(F.col("r.tool_use_id").alias("tool_use_id")).agg(F.max_by("r.content", F.struct("captured_at_ms", "line", "i")).alias("content"))


def with_call(results: DataFrame, calls: DataFrame) -> DataFrame:
    """Each result with the input of its call in the same trace; of calls that repeat an id the last counts."""
    last = calls.groupBy("trace_id", "tool_use_id").agg(F.max_by("input", "pos").alias("input"))
    return results.join(last, ["trace_id", "tool_use_id"], "left")


def with_tool_name(segments: DataFrame) -> DataFrame:
    """Results get the name of the most recent earlier call with their id in the same file, else `unknown`.
    segments: file, pos, kind, tool_use_id, tool_name."""
    w = Window.partitionBy("file", "tool_use_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    name = F.last(F.when(F.col("kind") == "tool-call", F.col("tool_name")), ignorenulls=True).over(w)
    return segments.withColumn("tool_name", F.when(F.col("kind") == "tool-result", F.coalesce(name, F.lit("unknown"))).otherwise(F.col("tool_name")))
