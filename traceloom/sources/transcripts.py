"""Session transcripts: JSON lines in files, read to turns and segments. A bad known record fails its file only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceloom import model

KINDS = ("assistant", "user", "system")


def lines(spark: SparkSession, root: str) -> DataFrame:
    """file, line (a number that ascends along the rows of a file), value, of all *.jsonl below root."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), "value").where(F.trim("value") != "")


def envelopes(rows: DataFrame) -> DataFrame:
    """lines with kind, parsed record e, and what the record is: ok, skipped, unparseable or drift."""
    kind = F.get_json_object("value", "$.type")
    valid = F.try_parse_json("value").isNotNull() | kind.isNotNull()
    e = F.from_json("value", model.ENVELOPE)
    content = F.get_json_object("value", "$.message.content")
    shape = F.substring(F.ltrim(F.regexp_extract("value", r'"content"\s*:\s*(.)', 1)), 1, 1)
    odd = ~shape.isin('"', "[", "", "n")
    has_message = F.get_json_object("value", "$.message").isNotNull()
    status = F.when(~valid, "unparseable").when(kind.isNull(), "skipped").when(~kind.isin(*KINDS), "skipped").when((kind != "system") & (~has_message | odd), "drift").otherwise("ok")
    return rows.withColumns({"kind": kind, "status": status, "e": e, "content": content})


def skipped(env: DataFrame) -> DataFrame:
    return env.where("status in ('skipped', 'unparseable')").groupBy(F.when(F.col("status") == "unparseable", "unparseable").otherwise(F.coalesce("kind", F.lit("unparseable"))).alias("kind")).count()


def drifted(env: DataFrame) -> DataFrame:
    """Files with a known kind that no longer parses, and the first such line; they give no traces."""
    return env.where("status = 'drift'").groupBy("file").agg(F.min("line").alias("line"))


def is_list(content):
    """Whether a variant is a list; a string that reads like one is not."""
    return F.coalesce(F.schema_of_variant(content).startswith("ARRAY"), F.lit(False))


def as_text(content):
    """A variant's string, or the JSON text of any other value."""
    return F.try_variant_get(content, "$", "string")


def result_text(content):
    """Text of a tool result's content (a variant): a string, or its text blocks by lines; null is empty."""
    blocks = F.from_json(as_text(content), "ARRAY<STRUCT<type: STRING, text: STRING>>")
    part = lambda b: F.when(b["type"] == "text", F.coalesce(b["text"], F.lit(""))).when(b["type"].isin("image", "document"), F.concat(F.lit("["), b["type"], F.lit("]")))
    joined = F.array_join(F.filter(F.transform(blocks, part), lambda x: x.isNotNull()), "\n")
    return F.coalesce(F.when(is_list(content), joined).otherwise(as_text(content)), F.lit(""))


def turns(env: DataFrame) -> DataFrame:
    """file, trace_id, turn_index, line, role, timestamp, model, sidechain, content and billing of files without drift.

    A request's usage is billed once a file, on its first record."""
    good = env.where("status = 'ok'").join(drifted(env).select("file"), "file", "left_anti")
    stem = F.regexp_extract("file", r"([^/]+)\.jsonl$", 1)
    u = F.col("e.message.usage")
    split = u["cache_creation"].isNotNull()
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    usage = F.when(u.isNotNull(), F.struct(n(u["input_tokens"]).alias("input_tokens"), n(u["output_tokens"]).alias("output_tokens"), n(u["cache_read_input_tokens"]).alias("cache_read_tokens"),
        F.when(split, n(u["cache_creation"]["ephemeral_5m_input_tokens"])).otherwise(n(u["cache_creation_input_tokens"])).alias("cache_write_5m_tokens"), F.when(split, n(u["cache_creation"]["ephemeral_1h_input_tokens"])).otherwise(0).alias("cache_write_1h_tokens")))
    rows = good.select("file", "line", F.coalesce("e.sessionId", stem).alias("trace_id"), F.coalesce("e.message.role", "kind").alias("role"), F.col("e.timestamp").alias("timestamp"), F.col("e.message.model").alias("model"), F.coalesce("e.isSidechain", F.lit(False)).alias("sidechain"), "content", F.col("e.requestId").alias("request_id"), usage.alias("usage"))
    again = F.row_number().over(Window.partitionBy("file", "request_id", F.col("usage").isNotNull()).orderBy("line")) > 1
    rows = rows.withColumn("billing", F.when(F.col("request_id").isNull() | ~again, F.col("usage")))
    rows = rows.where((F.coalesce(F.col("content"), F.lit("")) != "") | F.col("usage").isNotNull())
    index = F.row_number().over(Window.partitionBy("file", "trace_id").orderBy("line")) - 1
    return rows.withColumn("turn_index", index).drop("usage", "request_id")


def segments(turn_rows: DataFrame) -> DataFrame:
    """file, trace_id, turn_index, seg_index, pos, role, kind, tool_name, tool_use_id, original, effective. pos: line and
    seg_index, which order a file's segments."""
    blocks = F.from_json("content", model.CONTENT_BLOCKS)
    listed = F.ltrim("content").startswith("[") & blocks.isNotNull()
    text = F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("thinking", "id", "name", "input", "tool_use_id")], F.lit(None).cast("variant").alias("content")))
    rows = turn_rows.select("file", "trace_id", "turn_index", "line", "role", F.posexplode(F.when(listed, blocks).when(F.coalesce("content", F.lit("")) != "", text)).alias("seg_index", "b"))
    kind = F.when(F.col("b.type") == "text", "text").when(F.col("b.type") == "thinking", "thinking").when(F.col("b.type") == "tool_use", "tool-call").when(F.col("b.type") == "tool_result", "tool-result")
    effective = F.when(kind == "text", F.col("b.text")).when(kind == "thinking", F.col("b.thinking")).when(kind == "tool-call", F.coalesce("b.input", F.lit("null"))).otherwise(result_text(F.col("b.content")))
    return rows.select("file", "trace_id", "turn_index", "seg_index", F.struct("line", "seg_index").alias("pos"), "role", kind.alias("kind"), F.col("b.name").alias("tool_name"), F.coalesce("b.tool_use_id", "b.id").alias("tool_use_id"), F.lit(None).cast("string").alias("original"), F.coalesce(effective, F.lit("")).alias("effective")).where("kind is not null")


def stored_traces(spark: SparkSession, path: str) -> DataFrame:
    """One trace a JSON file; any bad file stops the read."""
    return spark.read.schema(model.TRACE).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(path)


def trace_segments(traces: DataFrame) -> DataFrame:
    rows = traces.select(F.col("id").alias("trace_id"), "optimizer", F.explode("turns").alias("t")).select("trace_id", "optimizer", F.col("t.index").alias("turn_index"), F.col("t.role").alias("role"), F.posexplode("t.segments").alias("seg_index", "s"))
    return rows.select("trace_id", "optimizer", "turn_index", "role", "seg_index", F.col("s.kind.type").alias("kind"), F.coalesce("s.kind.tool", "s.kind.name").alias("tool_name"), F.col("s.kind.id").alias("tool_use_id"), "s.original", "s.effective")


def trace_usage(traces: DataFrame) -> DataFrame:
    return traces.select(F.col("id").alias("trace_id"), F.explode("turns").alias("t")).where("t.billing is not null").select("trace_id", F.col("t.index").alias("turn_index"), F.col("t.model").alias("model"), F.col("t.timestamp").alias("timestamp"), "t.billing.*")
