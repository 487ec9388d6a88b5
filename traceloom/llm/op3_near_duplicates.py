"""Near-duplicates: a multi-index Hamming join of b-bit MinHash signatures, confirmed on full sets.

A signature has CHUNKS * WIDTH symbols of 16 bits, each of the least hash under one permutation of the
document's shingle hashes. Two signatures that differ in at most 2 * CHUNKS - 1 symbols have, by the
pigeonhole principle, a chunk with at most one error. Those errors are enumerated: a chunk gives WIDTH keys,
each without one of its symbols, so two chunks with at most one error share a key. All pairs within that
distance meet; at a similarity of 0.8 a pair's expected distance is 10 of 50, it is above 19 in one of a
thousand cases, and even then some chunk agrees but for one symbol: all of them fail in one of 600,000.

1. classes:  documents with equal shingle sets are one class; its least doc_id stands for it.
2. keys:     of each class; those that one class alone has are dropped.
3. stars:    in each key's bucket every class is compared with one centre, the class that shares keys most.
4. rest:     in buckets whose classes are still in several components, pairs across components are left. Those
             of small buckets are listed; those of large ones have to share a rare shingle too: of either
             set, ordered by rarity, one of the first (1 - 0.8) * size + 1, with enough of both sets after it,
             or they cannot be similar enough. Both are compared by signature, within LIMIT.
5. confirm:  candidates are compared on full shingle sets; confirmed ones are edges for the components.

A group of copies is confirmed against its centre and settled in step 3, so its pairs are not listed. No
bucket is capped: step 4 has all pairs that step 3 left open and that can be links. A centre with many
partners is sent to as many tasks as its buckets are large, and its partners are dealt over them.

Null and empty texts and texts without words have no shingles, and are linked with nothing. Rows that repeat
a doc_id count as linked. A null doc_id is linked with nothing and is its own row. An empty table gives none.
Very long texts are one row of the exchange and are shingled whole. Ties between centres go to the smaller
doc_id. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceloom.llm import common
from traceloom.llm.components import components

SHINGLE, PERCENT = 4, 80
CHUNKS, WIDTH = 10, 5
LIMIT = 24  # differing symbols of a candidate; above the 2 * CHUNKS - 1 for which meeting is certain
SMALL = 12  # buckets of up to so many classes are joined with themselves
SHARE = 64  # partners of a centre through one bucket that one task has

_U = np.uint64
_TABLE = np.random.default_rng(3).integers(0, 2**64, 256, dtype=_U)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_TABLE = _TABLE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = 0x9E3779B97F4A7C15
_ROLES = np.random.default_rng(4).integers(0, 2**64, 8, dtype=_U) | _U(1)
_A = np.random.default_rng(5).integers(0, 2**64, CHUNKS * WIDTH, dtype=_U) | _U(1)
_B = np.random.default_rng(6).integers(0, 2**64, CHUNKS * WIDTH, dtype=_U)
_KEY = np.random.default_rng(7).integers(0, 2**64, (CHUNKS, WIDTH, WIDTH), dtype=_U) | _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    f, b = np.full(n, _U(_P)), np.full(n, _U(pow(_P, -1, 2**64)))
    f[0] = b[0] = 1
    return np.cumprod(f), np.cumprod(b)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of lower-cased (A-Z) words."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    if not texts:
        return []
    space = _SPACE[data]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    n = 1 << max(16, (len(data) - 1).bit_length())
    forth, back = _powers(n)
    sums = np.cumsum(_TABLE[data] * forth[: len(data)])
    word = _mix((sums[end - 1] - sums[start - 1]) * back[start] + (end - start).astype(_U))
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    first = np.searchsorted(start, np.cumsum(lens) - lens + 1)
    last = np.r_[first[1:], len(start)]
    m = len(word) - size + 1
    runs = _mix(sum(word[i : i + m] * _ROLES[i] for i in range(size))) if m > 0 else word[:0]
    out = []
    for a, z in zip(first.tolist(), last.tolist()):
        if z - a >= size:
            out.append(np.unique(runs[a : z - size + 1]))
        elif z > a:
            out.append(_mix((word[a:z] * _ROLES[4 : 4 + z - a]).sum(keepdims=True) + _U(z - a)))
        else:
            out.append(word[:0])
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    least = np.full(len(_A), np.iinfo(_U).max, _U)
    for i in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[i : i + 4096, None] * _A + _B).min(0))
    return ((least >> _U(20)) & _U(0xFFFF)).astype("<u2")


def index_keys(signatures: np.ndarray) -> np.ndarray:
    """(n, CHUNKS * WIDTH) keys of (n, CHUNKS * WIDTH) symbols: of each chunk, all but one of its symbols."""
    s = signatures.astype(_U).reshape(-1, CHUNKS, 1, WIDTH) + _U(1)
    kept = _KEY * (1 - np.eye(WIDTH, dtype=_U))
    return _mix((s * kept).sum(3) + _KEY[:, :, 0]).reshape(len(signatures), -1)


def _utf8(t) -> bytes:
    return (t or "").encode("utf-8", "surrogatepass")


def _slices(texts: list[bytes], most: int = 1 << 18):
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most or i == len(texts) - 1:
            yield a, i + 1
            a, size = i + 1, 0


def describe(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, set1, set2 (together the set's identity), sig."""
    names = ["doc_id", "n_shingles", "set1", "set2", "sig"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def over(batches):
        common.claim("near-duplicates", _powers.cache_clear)
        for b in batches:
            texts = [_utf8(t.as_py()) for t in b.column(1)]
            for a, z in _slices(texts):
                sets = shingle_sets(texts[a:z], shingle)
                mixed = [_mix(s ^ _U(_P)) for s in sets]
                cols = [b.column(0)[a:z], [len(s) for s in sets], [int(m.sum().astype(np.int64)) if len(m) else 0 for m in mixed], [int(np.bitwise_xor.reduce(m).astype(np.int64)) if len(m) else 0 for m in mixed], [signature(s).tobytes() for s in sets]]
                yield pa.RecordBatch.from_arrays([cols[0], *(pa.array(c, t) for c, t in zip(cols[1:], types[1:]))], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(over, "doc_id long, n_shingles long, set1 long, set2 long, sig binary")


def keys_of(classes: DataFrame) -> DataFrame:
    def over(batches):
        common.claim("near-duplicates", _powers.cache_clear)
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(-1, CHUNKS * WIDTH)
                k = index_keys(sig)
                cls = np.repeat(part.column(0).to_numpy(), k.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(k.reshape(-1).view(np.int64)), pa.array(cls)], ["key", "cls"])

    return classes.select("cls", "sig").mapInArrow(over, "key long, cls long")


def _beside(pairs: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """pairs (a, b, n), with each one's value as va and vb. n bounds the partners that a has through one bucket:
    where it is above SHARE, a's partners are dealt over n / SHARE tasks, and a's row is sent to each."""
    side = lambda k: table.select(F.col(key).alias(k), F.col(value).alias(f"v{k}"))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / SHARE)))
    own = salted.select("a", "salt").distinct().join(side("a").hint("merge"), "a")
    return salted.join(side("b").hint("merge"), "b").join(own.hint("merge"), ["a", "salt"])


def near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of the candidates (a, b, n) those whose signatures differ in at most LIMIT symbols."""

    def over(batches):
        common.claim("near-duplicates", _powers.cache_clear)
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u2").reshape(b.num_rows, -1) for i in (3, 4))
            ok = pa.array((x != y).sum(1) <= LIMIT)
            yield pa.RecordBatch.from_arrays([b.column(i).filter(ok) for i in range(3)], ["a", "b", "n"])

    return _beside(pairs, classes, "cls", "sig").select("a", "b", "n", "va", "vb").mapInArrow(over, "a long, b long, n long")


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Of the candidates (a, b, n) those similar enough by their full shingle sets."""

    def over(batches):
        common.claim("near-duplicates", _powers.cache_clear)
        kept: dict = {}

        def of(text: str):
            if text not in kept:
                if len(kept) > 64:
                    kept.clear()
                kept[text] = shingle_sets([_utf8(text)], shingle)[0]
            return kept[text]

        for b in batches:
            ok = []
            for s, t in zip(b.column(2), b.column(3)):
                x, y = of(s.as_py()), shingle_sets([_utf8(t.as_py())], shingle)[0]
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= PERCENT * (len(x) + len(y) - both) and both > 0)
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    return _beside(pairs, texts, "doc_id", "text").select("a", "b", "va", "vb").mapInArrow(over, "a long, b long")


def _rare_prefixes(open_classes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """token, cls, component, size, place, n: of each class the shingles that come first by (number of open classes with it,
    hash), as many as two similar sets must share one of; without those that no other class has."""

    def over(batches):
        common.claim("near-duplicates", _powers.cache_clear)
        for b in batches:
            for c, k, t in zip(*b.columns):
                h = shingle_sets([_utf8(t.as_py())], shingle)[0]
                n = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(n, c.as_py())), pa.array(np.full(n, k.as_py())), pa.array(np.full(n, n, np.int32))], ["token", "cls", "component", "size"])

    rows = open_classes.join(texts.select(F.col("doc_id").alias("cls"), "text"), "cls").select("cls", "component", "text")
    tokens = common.written(rows.mapInArrow(over, "token long, cls long, component long, size int"), "tokens")
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("cls", "size")
    kept = tokens.join(shared, "token").withColumn("place", F.row_number().over(own.orderBy("df", "token")) + F.col("size") - F.count("*").over(own))
    most = F.col("size") - F.ceil(F.col("size") * PERCENT / 100) + 1
    out = common.written(kept.where(F.col("place") <= most).select("token", "cls", "component", "size", "place", F.col("df").alias("n")), "prefixes")
    common.discard(tokens)
    return out


def _once(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.max("n").alias("n"))


def _open_pairs(members: DataFrame, comps: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Step 4: candidates (a, b) of buckets whose classes are in different components."""
    comp = comps.select(F.col("node").alias("cls"), "component")
    # with two classes in a bucket, the star was all there is
    rows = members.where("n > 2").select("key", "cls", "n", "centre").join(comp, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    rows = common.written(rows.join(mixed, "key"), "open")
    few = rows.where(f"n <= {SMALL} and cls <> centre").select("key", "cls", "component", "n")
    other = few.select("key", F.col("cls").alias("b"), F.col("component").alias("cb"))
    small = few.join(other, "key").where("cls < b and component <> cb").select(F.col("cls").alias("a"), "b", "n")

    prefixes = _rare_prefixes(rows.where(f"n > {SMALL}").select("cls", "component").distinct(), texts, shingle)
    other = prefixes.select("token", F.col("cls").alias("b"), F.col("component").alias("cb"), F.col("size").alias("sb"), F.col("place").alias("pb"))
    # from the first shared shingle on, no more than what is left of either set can be shared
    fits = f"cls < b and component <> cb and 100 * least(size, sb) >= {PERCENT} * greatest(size, sb) and (100 + {PERCENT}) * (1 + least(size - place, sb - pb)) >= {PERCENT} * (size + sb)"
    large = prefixes.join(other, "token").where(fits).select(F.col("cls").alias("a"), "b", "n")
    out = common.written(near(_once(small.unionByName(large)), classes), "pairs")
    common.discard(rows, prefixes)
    return out


def link(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row for each of docs; shingle: words in one."""
    common.ship(docs.sparkSession)
    told = common.written(describe(docs, shingle), "described")
    own = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    identity = ["n_shingles", "set1", "set2"]
    classes = common.written(told.where(own).groupBy(*identity).agg(F.min(F.struct("doc_id", "sig")).alias("least")).select(*identity, F.col("least.doc_id").alias("cls"), F.col("least.sig").alias("sig")), "classes")

    keys = keys_of(classes)
    several = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = common.written(keys.join(several, "key"), "members")
    weight = members.groupBy("cls").agg(F.sum("n").alias("weight"))
    weighted = members.join(weight, "cls")
    centre = weighted.groupBy("key").agg(F.max(F.struct("weight", F.negative("cls").alias("minus"))).alias("c")).select("key", F.negative("c.minus").alias("centre"))
    centred = common.written(members.join(centre, "key"), "centred")
    common.discard(members)
    stars = _once(centred.where("cls <> centre").select(F.col("centre").alias("a"), F.col("cls").alias("b"), "n"))
    stars = common.written(near(stars, classes), "stars")

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    named = common.written(centred.where("n > 2").select(F.col("cls").alias("doc_id")).union(stars.select("a")).union(stars.select("b")).distinct(), "named")
    # only texts that are needed are exchanged; a semi-join would be pushed below the filter
    texts = common.written(common.likely(source, named, "doc_id", named.count()).join(named.hint("merge"), "doc_id"), "texts")
    edges = common.written(confirm(stars, texts, shingle), "edges")
    comps = components(edges)
    extra = _open_pairs(centred, comps, classes, texts, shingle)
    common.discard(centred, stars)
    if extra.take(1):
        more = common.written(confirm(extra, texts, shingle), "more")
        comps = components(edges.unionByName(more))
    common.discard(texts, extra, named)

    by_class = classes.select(*identity, "cls").join(comps.select(F.col("node").alias("cls"), "component"), "cls", "left").select(*identity, F.coalesce("component", "cls").alias("component"))
    # sets that share a doc_id share its node
    rows = told.join(by_class, identity, "left")
    component = F.when(own, F.col("component")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(common.table(spark, sf_dir, "documents"))
