"""Token-id output as length-delimited binary records, with an offset index beside them.

A record is: u64 payload length, u32 masked CRC-32 of those 8 bytes, payload, u32 masked CRC-32 of the
payload, and a line feed. The payload: a flag byte (1: the key is null), i64 key, a byte 2 or 4 (bytes
of each id), the ids; all little-endian. The mask rotates a sum by 15 bits and adds a constant, so that
a checksum over data that holds checksums stays sound. Spark's own text writer puts the framed bytes
into the files, so its commit protocol keeps whole files only, on any store that Spark can write.

Order: ascending key over the files and in each file, null keys first; rows that tie on the key follow
by their ids. Nulls and empty texts give the end id alone. Repeated rows give a record each. A very long text
is one record. An empty table gives no records. Further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceloom.llm import common, tokens

MASK_ADD = 0xA282EAD8
HEAD = struct.Struct("<QI")
ENTRY = struct.Struct("<BqB")


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_ADD) & 0xFFFFFFFF


def frame(key: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 65536 else 4
    payload = ENTRY.pack(key is None, key or 0, width) + ids.astype(f"<u{width}").tobytes()
    size = struct.pack("<Q", len(payload))
    return HEAD.pack(len(payload), masked(size)) + payload + struct.pack("<I", masked(payload)) + b"\n"


def frames(content: bytes):
    """(offset, length, key, ids) of each record; raises ValueError where a checksum disagrees."""
    at, view = 0, memoryview(content)
    while at < len(view):
        n, check = HEAD.unpack_from(view, at)
        if masked(bytes(view[at : at + 8])) != check:
            raise ValueError(f"record length damaged at {at}")
        payload = bytes(view[at + 12 : at + 12 + n])
        end = at + 12 + n + 5
        if len(payload) < n or end > len(view) or struct.unpack_from("<I", view, at + 12 + n)[0] != masked(payload):
            raise ValueError(f"record damaged at {at}")
        null, key, width = ENTRY.unpack_from(payload)
        yield at, end - at, None if null else key, np.frombuffer(payload, f"<u{width}", offset=ENTRY.size)
        at = end


def write_records(docs: DataFrame, path: str, tokenizer: str | None = None, key: str = "doc_id", text: str = "text") -> None:
    """Writes records under path/records and the index (file, record, key, offset, length, n: its ids) under path/index."""
    spark = docs.sparkSession
    common.ship(spark)
    tokenizer = tokenizer or tokens.default_path()
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange(common.parts_for(docs), "key").sortWithinPartitions("key", F.xxhash64("text"), "text")

    def framed(batches):
        enc = tokens.encoder(tokenizer)
        end = struct.pack("<I", tokens.END_ID)
        for b in batches:
            out = [frame(k.as_py(), np.frombuffer(enc.encode(t.as_py()) + end, "<u4"))[:-1] for k, t in zip(b.column(0), b.column(1))]
            for i in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(out[i : i + 1000], pa.binary())], ["value"])

    rows.mapInArrow(framed, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/records")
    _parsed(spark, path).select("file", "record", "key", "offset", "length", "n").write.parquet(f"{path}/index")


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(f"{path}/records")
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "content")


def _parsed(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    def parse(batches):
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                name, rows, before = name.as_py(), [], 0
                for i, (offset, length, key, ids) in enumerate(frames(content.as_buffer().to_pybytes())):
                    full = ids.astype("<u4")
                    rows.append((name, i, key, offset, length, before, len(ids), zlib.crc32(full.tobytes()), full.tolist() if with_ids else None))
                    before += len(ids)
                    if len(rows) >= 2000 or with_ids and len(rows) >= 200:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return _files(spark, path).mapInArrow(parse, _SCHEMA)


_SCHEMA = "file string, record long, key long, offset long, length long, before long, n long, crc long, ids array<long>"
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]


def _batch(rows):
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names)


def file_order(name: str) -> list:
    """Part files are numbered along the ranges of keys, with five digits or more."""
    return [F.regexp_extract(name, "^part-([0-9]+)", 1).cast("long"), F.col(name)]


def read_records(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The records in file order: key, start (ids of all records before), n_tokens, ids_crc32 and, if asked for, ids."""
    parsed = _parsed(spark, path, with_ids)
    # one row a file
    sizes = spark.read.parquet(f"{path}/index").groupBy("file").agg(F.sum("n").alias("ids"))
    sizes = sizes.withColumn("base", F.coalesce(F.sum("ids").over(Window.orderBy(*file_order("file")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = parsed.join(sizes.select("file", "base"), "file")
    return rows.select(F.col("key"), (F.col("base") + F.col("before")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"), *(["ids"] if with_ids else []))


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Shuffled reads: wanted(file, offset, length), as rows of the index, gives key and ids of those records."""
    def cut(batches):
        for b in batches:
            keys, ids = [], []
            for raw in b.column(0):
                _, _, k, v = next(frames(raw.as_buffer().to_pybytes()))
                keys.append(k)
                ids.append(v.astype("i8").tolist())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["key", "ids"])

    spots = wanted.groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("spots"))  # at most a file's records
    found = _files(spark, path).join(spots, "file").select("content", F.explode("spots").alias("s"))
    raw = found.select(F.expr("substring(content, cast(s.offset + 1 as int), cast(s.length as int))").alias("raw"))
    return raw.mapInArrow(cut, "key long, ids array<long>")


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "records")
    write_records(common.table(spark, sf_dir, "documents"), path)
    return read_records(spark, path).withColumnRenamed("key", "doc_id")
