"""Removal of repeated byte strings by longest-previous-factor arrays over suffix order.

Every byte covered by a string of LENGTH bytes that also starts in a document with a smaller key goes.
A window (LENGTH bytes inside one document) belongs to its anchor: the GRAM-byte string in it with the
least hash, leftmost on ties. Equal windows have equal anchors, so they can be compared anchor by anchor:

1. pack:     documents become blocks of a few MB, written once to the shared folder.
2. sieve:    each block sends the distinct anchor hashes it has, in hash buckets; a bucket answers, bit by
             bit, which of them another document has too. Most anchors, and their text, end here.
3. segments: each block sends the distinct stretches of text whose windows have a shared anchor, with the
             least key they have in the block, to the anchor's bucket. An anchor with more than HOT distinct
             stretches (a short phrase in very many contexts) is hot: its windows are sent one by one, and
             dealt by their own hash, so that equal windows still meet and no bucket has all of the anchor.
4. factors:  a bucket sorts the suffixes of its segments to depth LENGTH, ties by key, and takes from that order
             the lengths of common prefixes, and of each suffix the nearest one before and after it that has a
             smaller key. The longer of the two common prefixes is its longest previous factor, cut off at
             LENGTH; where it reaches LENGTH, the window is an earlier document's too. The bucket answers with
             a bit for each window.
5. cut:      each block maps the bits back to its documents and removes what they cover.

A block sends a string once, however many of its documents have it, so one very frequent passage puts no
more than a row for each block in a task. No text is compared by hash alone: step 2 may let through too
much, never too little, and step 4 compares bytes.

Null and empty texts have no bytes. A very long text is a block of its own. A document without key neither removes nor loses anything. Documents
with equal keys don't remove each other's text. Repeated rows give a row each. An empty table gives none.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm import common

LENGTH = 50
GRAM = 16
BLOCK_MB = 4
HOT = 1 << 15  # distinct stretches around one anchor; about 3 MB
SLICE = 1 << 15
POSITION = np.uint64((1 << 20) - 1)

_TABLE = np.random.default_rng(50).integers(0, 2**64, 256, dtype=np.uint64)
_PRIME = 0x9E3779B97F4A7C15


def _mul(k: int) -> np.uint64:
    return np.uint64(pow(_PRIME, k, 2**64))


def _minima(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window start: the position of its anchor, and the anchor's hash; the hashes of all grams."""
    h = _TABLE[b]
    k = 1
    while k < GRAM:
        h = h[:-k] * _mul(k) + h[k:]
        k *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    m = (h & ~POSITION) | np.arange(len(h), dtype=np.uint64)
    width, k = LENGTH - GRAM + 1, 1
    while 2 * k <= width:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    if width > k:
        m = np.minimum(m[: len(m) - (width - k)], m[width - k :])
    at = (m & POSITION).astype(np.int64)
    key = h[at] * np.uint64(0x94D049BB133111EB)  # minima are small numbers; keys have to spread evenly
    return at, key ^ (key >> np.uint64(31)), h


class Block:
    """The documents of a block, and the runs of windows that share an anchor."""

    def __init__(self, ids: bytes, lens: bytes, data: bytes):
        self.ids, self.lens = np.frombuffer(ids, np.int64), np.frombuffer(lens, np.int64)
        self.data, b = data, np.frombuffer(data, np.uint8)
        self.starts = np.cumsum(self.lens) - self.lens
        n = len(b) - LENGTH + 1
        parts: list[tuple] = []
        edge = np.zeros(len(b) + 2, np.int32)  # windows that cross into the next document
        np.add.at(edge, np.maximum(self.starts, self.starts + self.lens - LENGTH + 1), 1)
        np.add.at(edge, self.starts + self.lens, -1)
        inside = np.cumsum(edge)[: max(n, 0)] == 0
        for s in range(0, n, SLICE):
            at, h, grams = _minima(b[s : s + SLICE + LENGTH - 1])
            ok = inside[s : s + len(at)]
            first = np.flatnonzero(ok & np.r_[True, (at[1:] != at[:-1]) | ~ok[:-1]])
            if len(first):
                stop = np.flatnonzero(ok & np.r_[(at[1:] != at[:-1]) | ~ok[1:], True])
                parts.append((first + s, stop + s, h[first], grams[first] * np.uint64(_PRIME) ^ grams[stop + LENGTH - GRAM]))
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        self.lo, self.hi, self.hash, self.ends = (np.concatenate(x) for x in zip(*parts)) if parts else empty
        self.doc = np.searchsorted(self.starts + self.lens, self.lo, "right")

    def keys(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchor keys of `bits` + 32 bits in order, whether two documents here have them, and each run's key."""
        key, back = np.unique(self.hash >> np.uint64(32 - bits), return_inverse=True)
        low, high = np.full(len(key), len(self.lens)), np.zeros(len(key), np.int64)
        np.minimum.at(low, back, self.doc)
        np.maximum.at(high, back, self.doc)
        return key, high > low, back

    def contexts(self, back: np.ndarray, n: int) -> np.ndarray:
        """How many different stretches each of the n anchor keys has here, told apart by their ends; 255 at most."""
        told = np.unique(back.astype(np.uint64) << np.uint64(40) | self.ends >> np.uint64(24))
        return np.minimum(np.bincount((told >> np.uint64(40)).astype(np.int64), minlength=n), 255).astype(np.uint8)

    def segments(self, shared: np.ndarray, hot: np.ndarray, bits: int):
        """Of the runs with a shared anchor, and of each window of those with a hot one: distinct texts with bucket and
        least key, in order of bucket; start, document and text of each."""
        plain, single = np.flatnonzero(shared & ~hot), np.flatnonzero(shared & hot)
        bucket = (self.hash[plain] >> np.uint64(64 - bits)).astype(np.int64).tolist()
        lo, stop, doc, data = self.lo[plain], self.hi[plain] + LENGTH, self.doc[plain], self.data
        if len(single):
            size = self.hi[single] - self.lo[single] + 1
            each = np.repeat(self.lo[single] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            bucket += [1 << bits | zlib.crc32(data[a : a + LENGTH]) * 0x9E3779B1 % 2**32 >> 32 - bits for a in each.tolist()]
            lo, stop, doc = np.r_[lo, each], np.r_[stop, each + LENGTH], np.r_[doc, np.repeat(self.doc[single], size)]
        found: dict = {}
        number = np.fromiter((found.setdefault((k, data[a:z]), len(found)) for k, a, z in zip(bucket, lo.tolist(), stop.tolist())), np.int64, len(lo))
        least = np.full(len(found), len(self.ids))
        np.minimum.at(least, number, doc)  # documents are in order of key
        order = np.argsort(np.fromiter((k for k, _ in found), np.int64, len(found)), kind="stable")
        place = np.empty(len(found), np.int64)
        place[order] = np.arange(len(found))
        texts = list(found)
        return [texts[i] for i in order], self.ids[least[order]], lo, doc, place[number]


def _bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def _unbits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema) if rows else schema.empty_table()


def pack(docs: DataFrame) -> DataFrame:
    """block, ids, lens, raw size, data (compressed); documents in ascending key."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def over(batches):
        from pyspark import TaskContext

        block, made, size = [], 0, 0

        def out():
            nonlocal block, made, size
            block.sort(key=lambda x: x[0])
            data = b"".join(t for _, t in block)
            ids, lens = np.array([k for k, _ in block], np.int64), np.array([len(t) for _, t in block], np.int64)
            row = (TaskContext.get().partitionId() << 32 | made, ids.tobytes(), lens.tobytes(), len(data), pa.compress(data, "zstd", asbytes=True) if data else b"")
            block, made, size = [], made + 1, 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()))], ["block", "ids", "lens", "raw", "data"])

        for b in batches:
            for k, t in zip(b.column(0), b.column(1)):
                block.append((k.as_py(), (t.as_py() or "").encode("utf-8", "surrogatepass")))
                size += len(block[-1][1])
                if size >= BLOCK_MB << 20 or len(block) >= 50_000:
                    yield out()
        if block:
            yield out()

    return rows.where("doc_id is not null").mapInArrow(over, "block long, ids binary, lens binary, raw long, data binary")


def _block(ids, lens, raw, data) -> Block:
    return Block(ids, lens, pa.decompress(data, raw, "zstd", asbytes=True) if raw else b"")


def sieve(blocks: DataFrame, bits: int) -> DataFrame:
    """block, bucket, mask, hot: which of the block's anchor keys another document has, and which of them are hot."""

    def send(batches):
        for b in batches:
            for row in b.to_pylist():
                block = _block(row["ids"], row["lens"], row["raw"], row["data"])
                key, multi, back = block.keys(bits)
                seen = block.contexts(back, len(key))
                bucket = (key >> np.uint64(32)).astype(np.int64)
                edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(key) else np.zeros(0, np.int64)
                low = (key & np.uint64(0xFFFFFFFF)).astype("<u4")
                out = [(int(bucket[s]), row["block"], low[s:e].tobytes(), _bits(multi[s:e]), seen[s:e].tobytes()) for s, e in zip(edge, np.r_[edge[1:], len(key)])]
                for i in range(0, len(out), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 5000]), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "block", "keys", "multi", "seen"])

    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("mask", pa.binary()), ("hot", pa.binary())])

    def answer(t: pa.Table) -> pa.Table:
        rows = t.select(["bucket", "block", "keys", "multi", "seen"]).to_pylist()
        sizes = [len(r["keys"]) // 4 for r in rows]
        keys = np.concatenate([np.frombuffer(r["keys"], "<u4") for r in rows])
        multi = np.concatenate([_unbits(r["multi"], n) for r, n in zip(rows, sizes)])
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        new = np.r_[True, k[1:] != k[:-1]]
        start = np.flatnonzero(new)
        shared = np.logical_or.reduceat(multi[order], start) | (np.diff(np.r_[start, len(k)]) > 1)
        seen = np.concatenate([np.frombuffer(r["seen"], np.uint8) for r in rows])
        many = np.add.reduceat(seen[order].astype(np.int64), start) > limit
        mask, hot = np.empty(len(k), bool), np.empty(len(k), bool)
        of = np.cumsum(new) - 1
        mask[order], hot[order] = shared[of], many[of]
        at = np.r_[0, np.cumsum(sizes)]
        return _rows([(r["block"], r["bucket"], _bits(mask[a:z]), _bits(hot[a:z]) if hot[a:z].any() else b"") for r, a, z in zip(rows, at, at[1:])], schema)

    limit = HOT
    sent = blocks.mapInArrow(send, "bucket long, block long, keys binary, multi binary, seen binary")
    return sent.groupBy("bucket").applyInArrow(answer, "block long, bucket long, mask binary, hot binary")


def _shared_runs(block: Block, bits: int, answers: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    key, _, back = block.keys(bits)
    shared, hot = np.zeros(len(key), bool), np.zeros(len(key), bool)
    bucket = (key >> np.uint64(32)).astype(np.int64)
    for b, mask, many in answers:
        s, e = np.searchsorted(bucket, [b, b + 1])
        shared[s:e] = _unbits(mask, e - s)
        if many:
            hot[s:e] = _unbits(many, e - s)
    return shared[back], hot[back]


def _eights(data: np.ndarray, depth: int) -> np.ndarray:
    """Of each position, and of `depth` more behind the end, its 8 bytes as a number."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(depth + 8, np.uint8)])
    value = np.zeros(n + depth, np.uint64)
    for i in range(8):
        value = value << np.uint64(8) | padded[i : i + n + depth]
    return value


def suffix_classes(data: np.ndarray, starts: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Ranks of the suffixes at `starts` in suffix order to the given depth: equal ranks, equal first `depth` bytes.

    Prefix doubling: ranks by 8 bytes, then by pairs of ranks, to the largest power of two below depth; two
    overlapping pieces of that size make up the depth. Ranks are of every position of data, padded with zeros."""
    n, value = len(data), _eights(data, depth)

    def ranked(order, ordered):
        out = np.empty(len(order), np.uint64)
        out[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
        return out

    def pairs(first, second):
        if len(first) < 1 << 21:  # both ranks and the position fit one number, which sorts faster than an index
            s = np.sort(first << np.uint64(42) | second << np.uint64(21) | np.arange(len(first), dtype=np.uint64))
            return ranked((s & np.uint64((1 << 21) - 1)).astype(np.int64), s >> np.uint64(21))
        v = first << np.uint64(32) | second
        order = np.argsort(v)
        return ranked(order, v[order])

    order = np.argsort(value)
    r = ranked(order, value[order])
    k = 8
    while 2 * k <= depth:
        r = pairs(r, np.concatenate([r[k:], np.zeros(k, np.uint64)]))
        k *= 2
    return pairs(r[starts], r[starts + depth - k])


def _common(value: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each of the suffixes `at` has in common with the one before it, `depth` at most; 0 for the first.
    value: of each position, its 8 bytes as a number."""
    out = np.zeros(len(at), np.uint8)
    left = np.arange(1, len(at))
    for k in range(0, depth, 8):
        x = value[at[left] + k] ^ value[at[left - 1] + k]
        out[left] = k + sum((x < np.uint64(1 << 64 - 8 * i)) for i in range(1, 8)).astype(np.uint8) + (x == 0)
        left = left[x == 0]
    return np.minimum(out, depth)


def _previous_smaller(key: np.ndarray, common_before: np.ndarray) -> np.ndarray:
    """Of each place the common prefix with the nearest place before it whose key is smaller, 0 where there is none.
    All places follow one another's pointers at once, so it takes about log n rounds."""
    n = len(key)
    to, least = np.arange(-1, n - 1), common_before.copy()
    low = np.append(key, -1)  # what no pointer finds, -1, is smaller than all
    open_ = np.flatnonzero(low[to] >= key)
    while len(open_):
        via = to[open_]
        least[open_], to[open_] = np.minimum(least[open_], least[via]), to[via]
        open_ = open_[low[to[open_]] >= key[open_]]
    least[to < 0] = 0
    return least


def longest_previous_factor(data: np.ndarray, starts: np.ndarray, key: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Of each suffix of data at `starts`: the longest prefix, of `depth` bytes at most, that a suffix with a smaller key
    (numbers from 0) has too. Beyond `depth` suffixes count as equal, and are in order of key.

    Of equal suffixes, those with more than the least key have the one before as previous smaller position, with
    `depth` bytes in common. For the others previous and next smaller positions are in other runs of equal ones,
    and those have their least key first; so they are found on the first of each run."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint8)
    rank = suffix_classes(data, starts, depth)
    if n < 1 << 21:  # rank, key and number fit one number, which sorts faster than an index
        low = np.uint64((1 << 21) - 1)
        s = np.sort(rank << np.uint64(42) | key.astype(np.uint64) << np.uint64(21) | np.arange(n, dtype=np.uint64))
        order, r, k = (s & low).astype(np.int64), s >> np.uint64(42), (s >> np.uint64(21) & low).astype(np.int64)
    else:
        order = np.lexsort((key, rank))
        r, k = rank[order], key[order]
    head = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    least = k[head]
    before = _common(_eights(data, depth), starts[order[head]], depth)
    after = np.append(before[1:], np.uint8(0))
    factor = np.maximum(_previous_smaller(least, before), _previous_smaller(least[::-1], after[::-1])[::-1])
    run = np.repeat(np.arange(len(head)), np.diff(np.append(head, n)))
    out = np.empty(n, np.uint8)
    out[order] = np.where(k > least[run], np.uint8(depth), factor[run])
    return out


_SEGMENTS = "bucket long, block long, lens binary, keys binary, data binary"


def factors(blocks: DataFrame, shared: DataFrame, bits: int) -> DataFrame:
    """block, bucket, mask: of the windows of the block's segments, those with an earlier occurrence."""
    sent = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("lens", pa.binary()), ("keys", pa.binary()), ("data", pa.binary())])
    back = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("mask", pa.binary())])

    def send(own: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in own.to_pylist():
            block = _block(row["ids"], row["lens"], row["raw"], row["data"])
            masks = list(zip(*(answers.column(c).to_pylist() for c in ("bucket", "mask", "hot"))))
            texts, keys, _, _, _ = block.segments(*_shared_runs(block, bits, masks), bits)
            bucket = np.array([b for b, _ in texts], np.int64)
            edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(texts) else []
            for s, e in zip(edge, [*edge[1:], len(texts)]):
                lens = np.array([len(t) for _, t in texts[s:e]], "<i4")
                out.append((int(bucket[s]), row["block"], lens.tobytes(), keys[s:e].tobytes(), b"".join(t for _, t in texts[s:e])))
        return _rows(out, sent)

    def answer(t: pa.Table) -> pa.Table:
        rows = t.select(["bucket", "block", "lens", "keys", "data"]).to_pylist()
        lens = [np.frombuffer(r["lens"], "<i4").astype(np.int64) for r in rows]
        windows = [int((x - LENGTH + 1).sum()) for x in lens]
        every = np.concatenate(lens)
        n = every - LENGTH + 1
        base = np.cumsum(every) - every
        starts = np.repeat(base - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        data = np.frombuffer(b"".join(r["data"] for r in rows), np.uint8)
        keys = np.concatenate([np.frombuffer(r["keys"], np.int64) for r in rows])
        order_of = np.unique(keys, return_inverse=True)[1]
        mask = longest_previous_factor(data, starts, np.repeat(order_of, n)) >= LENGTH
        at = np.r_[0, np.cumsum(windows)]
        return _rows([(r["block"], r["bucket"], _bits(mask[a:z])) for r, a, z in zip(rows, at, at[1:])], back)

    segments = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(send, _SEGMENTS)
    return segments.groupBy("bucket").applyInArrow(answer, "block long, bucket long, mask binary")


def cut(blocks: DataFrame, shared: DataFrame, found: DataFrame, bits: int) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs), kept (bytes)."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", span), ("kept", pa.binary())])

    def over(own: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in own.to_pylist():
            block = _block(row["ids"], row["lens"], row["raw"], row["data"])
            sides: dict = {0: [], 1: []}
            for side, *answer in zip(*(answers.column(c).to_pylist() for c in ("side", "bucket", "mask", "hot"))):
                sides[side].append(answer)
            texts, keys, lo, doc, number = block.segments(*_shared_runs(block, bits, sides[0]), bits)
            n = np.array([len(t) - LENGTH + 1 for _, t in texts], np.int64)
            at = np.r_[0, np.cumsum(n)]
            bucket = np.array([b for b, _ in texts], np.int64)
            flags = np.zeros(int(at[-1]), bool)
            for b, mask, _ in sides[1]:
                s, e = at[np.searchsorted(bucket, [b, b + 1])]
                flags[s:e] = _unbits(mask, int(e - s))
            cover = np.zeros(len(block.data) + 1, np.int32)
            if len(lo):
                later = block.ids[doc] > keys[number]  # the block itself has the text under a smaller key
                size = n[number]
                first = np.cumsum(size) - size
                within = np.arange(int(size.sum())) - np.repeat(first, size)
                hit = np.repeat(later, size) | flags[np.repeat(at[number], size) + within]
                where = (np.repeat(lo, size) + within)[hit]
                np.add.at(cover, where, 1)
                np.add.at(cover, where + LENGTH, -1)
            gone = np.cumsum(cover[:-1]) > 0
            for k, s, m in zip(block.ids.tolist(), block.starts.tolist(), block.lens.tolist()):
                g, text = gone[s : s + m], block.data[s : s + m]
                if g.any():
                    edge = np.flatnonzero(np.diff(np.r_[0, g.astype(np.int8), 0])).tolist()
                    spans = [{"start": a, "end": z} for a, z in zip(edge[::2], edge[1::2])]
                    out.append((k, m, spans, np.frombuffer(text, np.uint8)[~g].tobytes()))
                else:
                    out.append((k, m, [], text))
        return _rows(out, schema)

    answers = shared.withColumn("side", F.lit(0)).unionByName(found.withColumn("hot", F.lit(None).cast("binary")).withColumn("side", F.lit(1)))
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(over, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans of removed bytes (of the text as UTF-8), and the kept bytes."""
    common.ship(docs.sparkSession)
    blocks = common.written(pack(docs), "blocks")
    raw = blocks.agg(F.sum("raw")).first()[0] or 0
    # a bucket's segments are about half a MB, and there are more buckets than tasks
    bits = int(max(2 * common.shuffle_partitions(docs.sparkSession), raw // (1 << 20)) - 1).bit_length()
    shared = common.written(sieve(blocks, bits), "anchors")
    out = cut(blocks, shared, factors(blocks, shared, bits), bits)
    keyless = docs.where("doc_id is null").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("kept"))
    keyless = keyless.select("doc_id", F.length("kept").cast("long").alias("n_bytes"), F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"), "kept")
    return out.unionByName(keyless)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeats(common.table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
