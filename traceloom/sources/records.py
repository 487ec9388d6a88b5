"""Captures, ledger events, policies, rules, blocks, retrieval triples: readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom import model

HEAD_BYTES = 65_536


def _events(raw: DataFrame) -> DataFrame:
    rows = raw.select("value", F.from_json("value", model.EVENT, {"mode": "PERMISSIVE"}).alias("e")).where(F.get_json_object("value", "$.at_ms").isNotNull()).select("e.*")
    text = ["surface", "transform", "cert", "model", "platform", "tenant", "kept_reason", "req_id"]
    number = ["input_tokens", "output_tokens", "atoms", "reopened_tokens"]
    return rows.fillna("", text).fillna(0, number).fillna(False, ["verified", "inline"])


def events(spark: SparkSession, path: str) -> DataFrame:
    """Ledger events of JSON lines in order (seq); bad lines are left out, missing fields get defaults."""
    return _events(spark.read.text(path)).withColumn("seq", F.monotonically_increasing_id())


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    return _events(spark.readStream.text(path))


def captures(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.from_json("value", model.CAPTURE).alias("c"))
    return rows.select("line", "c.*").where("tool_results is not null")


def tool_results(bodies: DataFrame) -> DataFrame:
    """captures of request bodies (body): tool_use_id and content of each tool result."""
    from traceloom.sources.transcripts import as_text, is_list, result_text

    messages = F.from_json(F.get_json_object("body", "$.messages"), "ARRAY<STRUCT<role: STRING, content: VARIANT>>")
    rows = bodies.select(*[c for c in bodies.columns if c != "body"], F.explode(messages).alias("m")).where(is_list(F.col("m.content")))
    blocks = F.from_json(as_text(F.col("m.content")), "ARRAY<STRUCT<type: STRING, tool_use_id: STRING, content: VARIANT>>")
    rows = rows.withColumn("b", F.explode(blocks)).where("b.type = 'tool_result' and b.tool_use_id is not null")
    return rows.withColumn("tool_use_id", F.col("b.tool_use_id")).withColumn("content", result_text(F.col("b.content"))).drop("m", "b")


def message_id(body):
    """The first message id in the head of a response body, or empty."""
    return F.regexp_extract(F.substring(body, 1, HEAD_BYTES), '"id"\\s*:\\s*"(msg_[^"]*)"', 1)


#: Reopen rates by class that hold without a policy of one's own are the prior alone.
def policy(spark: SparkSession, path: str | None, prior: float = 0.4) -> DataFrame:
    """class, band, n, rate; a file that isn't version 1 with a threshold in 0..1 gives the prior only."""
    schema = "version INT, threshold DOUBLE, prior DOUBLE, classes MAP<STRING, STRUCT<rate: DOUBLE, n: BIGINT, sizes: MAP<STRING, STRUCT<rate: DOUBLE, n: BIGINT>>>>"
    fallback = spark.createDataFrame([(None, None, 0, prior)], "class string, band string, n bigint, rate double")
    if path is None:
        return fallback
    good = spark.read.schema(schema).option("multiLine", True).json(path).where("version = 1 and threshold between 0 and 1")
    if not good.take(1):
        return fallback
    top = good.select(F.lit(None).cast("string").alias("class"), F.lit(None).cast("string").alias("band"), F.lit(0).cast("long").alias("n"), F.col("prior").alias("rate"))
    classes = good.select(F.explode("classes").alias("class", "c"))
    whole = classes.select("class", F.lit(None).cast("string").alias("band"), "c.n", "c.rate")
    bands = classes.select("class", F.explode("c.sizes").alias("band", "s")).select("class", "band", "s.n", "s.rate")
    return top.unionByName(whole).unionByName(bands)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """One block a file: path and raw."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def retrieval(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query STRING, rows ARRAY<STRING>, relevant ARRAY<INT>").json(path)


def write_events(events: DataFrame, path: str) -> None:
    events.select(*[c.split()[0] for c in model.EVENT.replace("\n", " ").split(", ")]).write.mode("append").json(path)


def write_captures(rows: DataFrame, path: str) -> None:
    rows.select("captured_at_ms", "model", "message_id", "tool_results").write.mode("append").json(path)


def write_store(rows: DataFrame, path: str) -> None:
    """Stores blocks by id, and reads them back to prove that each is there; raises if one is missing."""
    rows = rows.withColumn("prefix", F.substring("id", 1, 2))
    rows.write.mode("append").partitionBy("prefix").parquet(path)
    back = rows.sparkSession.read.parquet(path)
    if rows.join(back.select("id", "raw"), ["id", "raw"], "left_anti").take(1):
        raise OSError(f"stored blocks are missing in {path}")


def write_blocks(outcomes: DataFrame, path: str) -> None:
    outcomes.write.mode("overwrite").json(path)
