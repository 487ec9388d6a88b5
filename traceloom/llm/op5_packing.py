"""Packing of documents into sequences of a fixed window.

A document's ids (with the end id) are cut into whole windows and a remainder, so its pieces follow
from its length alone. The histogram of piece lengths has at most `window` rows, whatever the corpus.
On it the driver enumerates combinations of up to three lengths that fill a window, solves how often
to use each by non-negative least squares, rounds down, and packs what is left greedily. The outcome
is a table of slots - for a length, which ranks go to which sequences at which offset - whose size
depends on the window alone; the pieces meet it by length and rank.

Nulls and empty texts are documents of the end id alone. Repeated rows and ties get pieces of their
own. An empty table gives no rows. Further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceloom.llm import common, tokens

WINDOW = 2048
TRIPLE_LENGTHS = 96  # lengths, most frequent first, that triples are made of; pairs use every length
ROUNDS = 300

_PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, ids binary"


def pieces(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """The cut: one row for each piece; ids (little-endian u32) only if asked for."""
    common.ship(docs.sparkSession)
    tokenizer = tokenizer or tokens.default_path()

    def cut(batches):
        enc = tokens.encoder(tokenizer)
        end = np.array([tokens.END_ID], "<u4").tobytes()
        for b in batches:
            rows = []
            for k, t in zip(b.column(0), b.column(1)):
                raw, k = enc.encode(t.as_py()) + end, k.as_py()
                n = len(raw) // 4
                for at in range(0, n, window):
                    part = raw[4 * at : 4 * (at + window)]
                    rows.append((k, at, len(part) // 4, zlib.crc32(part), n, part if with_ids else None))
            for i in range(0, len(rows), 2000):
                cols = list(zip(*rows[i : i + 2000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _PIECES)
    return out if with_ids else out.drop("ids")


def _combinations(h: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths (0: none) that add up to the window, of lengths that occur."""
    have = np.flatnonzero(h[:window])
    have = have[have > 0]
    there = np.zeros(window + 1, bool)
    there[have] = True
    a = have[have <= window // 2]
    pairs = a[there[window - a]]
    out = [np.stack([pairs, window - pairs, np.zeros_like(pairs)], 1)]
    top = np.sort(have[np.argsort(-h[have], kind="stable")][:TRIPLE_LENGTHS])
    i, j = np.triu_indices(len(top))
    x, y = top[i], top[j]
    z = window - x - y
    ok = (z >= y) & (z > 0)
    x, y, z = x[ok], y[ok], z[ok]
    ok = there[z]
    out.append(np.stack([x[ok], y[ok], z[ok]], 1))
    return np.concatenate(out)


def _nnls(combos: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Non-negative x with A x near h, by multiplicative updates; A counts each combination's lengths."""
    def spread(x):
        got = sum(np.bincount(combos[:, k], x, len(h)) for k in range(3))
        got[0] = 0
        return got

    back = lambda v: sum(np.where(combos[:, k] > 0, v[combos[:, k]], 0) for k in range(3))
    x = np.full(len(combos), max(1.0, h.sum() / max(1, len(combos)) / 2))
    goal = back(h.astype(float))
    for _ in range(ROUNDS):
        x *= goal / np.maximum(back(spread(x)), 1e-12)
    return x


def solve(hist: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, lo, hi, times, first sequence, offset): of a length's pieces, rank r in lo..hi-1 goes
    to sequence first + (r - lo) // times at offset + ((r - lo) % times) * length."""
    h = np.zeros(window + 1, np.int64)
    for n, c in hist.items():
        h[n] = c
    taken, slots, first = np.zeros_like(h), [], 0

    def put(template: list[tuple[int, int]], repeats: int):
        nonlocal first
        offset = 0
        for n, times in template:
            slots.append((n, int(taken[n]), int(taken[n] + times * repeats), times, first, offset))
            taken[n] += times * repeats
            offset += times * n
        first += repeats

    if h[window]:
        put([(window, 1)], int(h[window]))
    left = h - taken
    combos = _combinations(left, window)
    if len(combos):
        x = _nnls(combos, left)
        for c in np.argsort(-x, kind="stable"):
            lengths, times = np.unique(combos[c][combos[c] > 0], return_counts=True)
            n = int(min(np.floor(x[c] + 1e-9), min((h[k] - taken[k]) // t for k, t in zip(lengths, times))))
            if n > 0:
                put([(int(k), int(t)) for k, t in zip(lengths, times)], n)
    left = h - taken
    while left.any():
        room, template = window, []
        for n in np.flatnonzero(left)[::-1]:
            times = min(room // int(n), int(left[n]))
            if times:
                template.append((int(n), times))
                room -= times * int(n)
        put(template, max(1, min(int(left[n]) // t for n, t in template)))
        left = h - taken
    return slots


def place(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset. cut: a table that can be read again, with length and identifying columns."""
    spark = cut.sparkSession
    hist = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `window` rows
    slots = solve(hist, window) or [(0, 0, 0, 1, 0, 0)]
    # a frequent length is dealt over several groups, so that no task ranks more than its share
    share = max(1, sum(hist.values()) // (2 * common.shuffle_partitions(spark)))
    groups = spark.createDataFrame([(n, -(-c // share)) for n, c in hist.items()] or [(0, 1)], "length int, groups int")
    tie = [F.xxhash64("doc_id", "start", "ids_crc32"), "doc_id", "start", "ids_crc32", "doc_tokens"]
    rows = cut.join(F.broadcast(groups), "length").withColumn("part", F.pmod(F.xxhash64("ids_crc32", "start", "doc_id"), "groups").cast("int"))
    # at most window + 2 * partitions groups, as the shares add up to the whole
    sizes = {}
    for r in sorted(rows.groupBy("length", "part").count().collect()):
        sizes.setdefault(r[0], []).append((r[1], r[2]))
    bases = [(n, p, sum(c for _, c in of[:i])) for n, of in sizes.items() for i, (p, _) in enumerate(of)]
    bases = spark.createDataFrame(bases or [(0, 0, 0)], "length int, part int, base long")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy(*tie)) - 1)
    rows = rows.join(F.broadcast(bases), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    table = spark.createDataFrame(slots, "slot_length int, lo long, hi long, times int, first long, at long")
    rows = rows.join(F.broadcast(table), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    k = F.col("rank") - F.col("lo")
    return rows.select(
        *cut.columns,
        (F.col("first") + F.floor(k / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(k, F.col("times")) * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces with their place. The cut is written once to the shared folder, as its rows are read thrice."""
    return place(common.written(pieces(docs, window, tokenizer, with_ids), "pieces"), window)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(common.table(spark, sf_dir, "documents"), with_ids=False)
    return out.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")
