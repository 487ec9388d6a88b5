"""What the operators of this subpackage share: inputs, the shared folder, written tables."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom import shipping

MB = 1 << 20
ARROW_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own if all
    runs in one process, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="traceloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/traceloom/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder, which outlives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more: what was made of them is written itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


BITMAP = 1 << 15  # bits of one of Spark's bitmaps
MOST_BITMAPS = 1 << 12  # 16 MB


def likely(df: DataFrame, ids: DataFrame, key: str, count: int) -> DataFrame:
    """The rows of df whose key is in ids (a column of distinct keys, `count` of them), and some others: a filter ahead
    of an exact semi-join, so that few of a wide table's rows are exchanged. A bit for each hash of a key, 16 times
    as many as keys, is broadcast; where that is more than MOST_BITMAPS bitmaps, df is given back as it is."""
    n = -(-count * 16 // BITMAP) or 1
    if n > MOST_BITMAPS:
        return df
    spot = F.pmod(F.xxhash64(F.lit("likely"), F.col(key)), F.lit(n * BITMAP))
    bits = ids.select(spot.alias("__spot")).select(F.floor(F.col("__spot") / BITMAP).alias("__part"), "__spot").groupBy("__part")
    bits = bits.agg(F.bitmap_construct_agg(F.pmod("__spot", F.lit(BITMAP))).alias("__bits"))
    rows = df.withColumn("__spot", spot).withColumn("__part", F.floor(F.col("__spot") / BITMAP)).join(F.broadcast(bits), "__part")
    byte = F.conv(F.hex(F.expr(f"substring(__bits, cast((__spot % {BITMAP}) div 8 + 1 as int), 1)")), 16, 10).cast("int")
    return rows.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(__spot % 8 as int))")) != 0).select(*[F.col(f"`{c}`") for c in df.columns])


def beside(columns: list[str], results: list[str]) -> list[str]:
    """The columns that can stand beside a result: one with the name of a result column gives way to it."""
    taken = {r.lower() for r in results}
    return [c for c in columns if c.lower() not in taken]


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; for a file scan the bytes of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(df: DataFrame, mb_each: int = 16) -> int:
    """Partitions for a wide exchange of df: by its size, and no fewer than Spark's own setting."""
    return max(shuffle_partitions(df.sparkSession), min(200_000, plan_bytes(df) // (mb_each * MB) + 1))


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, and has Arrow batches of texts stay at a few MB."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    shipping.ship(spark)


_held: dict[str, Callable[[], None]] = {}


def claim(name: str, clear: Callable[[], None]) -> None:
    """Called in a Python worker before an operator fills caches of its own: those of other operators, which ran
    in the same process before, are cleared."""
    others = [n for n in _held if n != name]
    for n in others:
        _held.pop(n)()
    if others:
        gc.collect()
        pyarrow.default_memory_pool().release_unused()
    _held[name] = clear
