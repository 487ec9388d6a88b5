"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

The driver draws, for each input partition, how many of its rows go to each shard: one multivariate
hypergeometric draw a partition from what the shards still take, so counts are those of a uniform shuffle and
shard sizes exact (at most one apart). Each partition permutes its rows locally - a sort by a keyed hash - and
deals them out by those counts; one exchange moves them; each shard permutes what it got by another hash.

The matrix has (input partitions) x (shards) numbers, and goes along with each partition's number by a
broadcast if it has at most BROADCAST_BYTES, else by a join. A shard of more than BIN_ROWS rows or, by the
table's files, BIN_BYTES is permuted in bins of the hash's range, whose sizes are counted first, so no task sorts
a whole shard of a large table.

The input is read twice with the same partitions (once to count), so it has to be a scan or a written table;
an input that isn't is written to the shared folder first. Nulls in any column are values like others, rows
that are repeated are rows of their own, and ties between different rows go by all their columns. An empty
table gives no rows. Very long texts are rows like others. Columns `shard` and `slot` of the input give way to
the result's; names that begin with __ are reserved.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceloom.llm import common

SHARDS, SEED = 40, 17
BIN_ROWS, BIN_BYTES = 1_000_000, 256 << 20
BROADCAST_BYTES = 64 << 20


def matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """(partitions, shards) numbers of rows, with row sums `counts` and column sums at most one apart."""
    total = sum(counts)
    left = np.array([total // shards + (j < total % shards) for j in range(shards)], np.int64)
    rng = np.random.default_rng(seed)
    out = np.zeros((len(counts), shards), np.int64)
    for i, n in enumerate(counts):
        out[i] = rng.multivariate_hypergeometric(left, n, method="marginals")
        left -= out[i]
    return out


def shuffle(df: DataFrame, shards: int = SHARDS, seed: int = SEED, bin_rows: int = BIN_ROWS) -> DataFrame:
    """df with shard and slot (its place in the shard, gapless from 0)."""
    spark = df.sparkSession
    df = df.select(*[F.col(f"`{c}`") for c in common.beside(df.columns, ["shard", "slot"])])
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        df = common.written(df, "shard-input")
    counts = {r[0]: r[1] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    parts = sorted(counts)
    drawn = matrix([counts[p] for p in parts], shards, seed)
    ends = np.cumsum(drawn, 1)
    table = spark.createDataFrame([(p, e.tolist()) for p, e in zip(parts, ends)] or [(0, [0] * shards)], "__p int, __ends array<long>")
    table = F.broadcast(table) if drawn.size * 8 <= BROADCAST_BYTES else table

    cols = [F.col(f"`{c}`") for c in df.columns]
    # local permutation: the rank in a partition after a sort by a keyed hash
    rows = df.withColumn("__p", F.spark_partition_id()).withColumn("__u", F.xxhash64(F.lit(seed), *cols)).sortWithinPartitions("__u", *cols)
    rows = rows.withColumn("__r", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    rows = rows.join(table, "__p")
    shard = F.size(F.filter("__ends", lambda e: e <= F.col("__r")))
    rows = rows.withColumn("shard", F.when(F.col("__r") < F.element_at("__ends", -1), shard).otherwise(F.raise_error(F.lit("the input's partitions changed between two reads"))).cast("int"))
    rows = rows.withColumn("__v", F.xxhash64(F.lit(seed + 1), "__u", "__p", "__r")).drop("__ends", "__r", "__u", "__p")

    bins = max(1, -(-int(drawn.sum()) // shards // bin_rows), -(-common.plan_bytes(df) // shards // BIN_BYTES))
    rows = rows.withColumn("__b", F.pmod(F.shiftrightunsigned("__v", 20), F.lit(bins)).cast("int"))
    order = Window.partitionBy("shard", "__b").orderBy("__v", *cols)
    if bins > 1:
        rows = common.written(rows, "sharded")
        sizes = rows.groupBy("shard", "__b").count()
        base = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = rows.join(sizes.select("shard", "__b", base.alias("__base")), ["shard", "__b"])
    else:
        rows = rows.withColumn("__base", F.lit(0))
    return rows.withColumn("slot", (F.col("__base") + F.row_number().over(order) - 1).cast("long")).select(*cols, "shard", "slot")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    raw = F.col("text").cast("binary")
    return shuffle(docs).select(
        "doc_id", (F.coalesce(F.length(raw), F.lit(0)) + 16).cast("long").alias("size"), F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
