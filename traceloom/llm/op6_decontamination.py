"""Benchmark decontamination by one Aho-Corasick automaton over normalised benchmark windows.

Text is normalised bytewise: A-Z lower-cased; runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] are words (so
any non-ASCII character is a word character). An item's windows are its runs of `window` words; an item
of fewer words, but not none, is one window. The automaton reads word numbers in place of letters: each of the
benchmark's V words is a pair of symbols, of alphabets of their own of about V ** 0.5 symbols, so that nodes have few
children, a window takes 26 nodes at most, and a match ends where a word ends. It passes over the words of each
document once; ends of matches are word numbers, and are mapped from there to character spans of the original text.

The benchmark's size is read first. Up to BLOCK_BYTES it makes one automaton (about 250 MB in a Python worker for
each MB), whose items are broadcast. Beyond, items are dealt by hash into blocks of about that size. Each block
is a pass of its own that writes the hits it finds to the shared folder, so that a worker holds one automaton
at a time; a last pass joins the hits with their documents.

Null has no words, and neither has an item without words any window. Repeated item_ids count once. An item
without id hits words, but is not among the items of a document. Repeated rows of documents give a row each;
an empty table gives none. Without items nothing is hit. Very long texts are scanned whole. Of the columns to
keep, those named like a result column give way to it.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm import common

WINDOW = 13
BLOCK_BYTES = 1 << 20  # of benchmark text
SHARE = 20  # contaminated: n_hit * SHARE >= n_words, and n_hit > 0

_TABLE = bytes(ord(c.lower()) if (c := chr(b)).isascii() and c.isalnum() else b if b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


FIRST = 0x100  # of the code points that stand for words; below a million of them, as 2 * base is small


class _Symbols(dict):
    def __missing__(self, word: bytes) -> str:
        return "\x01\x01"  # in no window


class Windows:
    """The automaton of some items (item id, text); each pattern's value: number of its words, and its items."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        import ahocorasick

        number: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        for item, text in items:
            w = [number.setdefault(x, len(number)) for x in words(text)]
            for i in range(max(1, len(w) - window + 1) if w else 0):
                found.setdefault(tuple(w[i : i + window]), set()).add(item)
        base = max(1, math.isqrt(len(number)) + 1)
        sign = [chr(FIRST + base + n // base) + chr(FIRST + n % base) for n in range(len(number))]
        self.symbols = _Symbols(zip(number, sign))
        self.automaton = ahocorasick.Automaton()
        for pattern, ids in found.items():
            self.automaton.add_word("".join(sign[n] for n in pattern), (len(pattern), tuple(sorted(x for x in ids if x is not None))))
        self.automaton.make_automaton()

    def hits(self, w: list[bytes]):
        """First word, past the last, and items of each match."""
        if len(self.automaton):
            for end, (n, ids) in self.automaton.iter("".join(map(self.symbols.__getitem__, w))):
                last = end // 2 + 1
                yield last - n, last, ids


_built: dict[str, Windows] = {}


def _windows_of(block, window) -> Windows:
    key = hashlib.sha1(repr((block, window)).encode()).hexdigest()
    if key not in _built:
        _built.clear()
        _built[key] = Windows(block, window)
    return _built[key]


def scan(text: str | None, windows: Windows) -> tuple[int, np.ndarray, set]:
    """Number of words, a mark for each word that is hit, and the items with windows in the text."""
    w = words(text)
    found = list(windows.hits(w)) if w else []
    return len(w), marks(len(w), [h[0] for h in found], [h[1] for h in found]), {i for h in found for i in h[2]}


def marks(n: int, starts: list[int], ends: list[int]) -> np.ndarray:
    out = np.zeros(n + 1, np.int64)
    if starts:
        np.add.at(out, starts, 1)
        np.add.at(out, ends, -1)
    return np.cumsum(out)[:-1] > 0


def spans(text: str, mark: np.ndarray) -> list[tuple[int, int]]:
    """Character spans of the original text, from the first to the last word of each run of hit words."""
    at = [m.span() for m in _WORD.finditer(text)]
    edge = np.flatnonzero(np.diff(np.r_[0, mark.astype(int), 0]))
    return [(at[a][0], at[b - 1][1]) for a, b in zip(edge[::2], edge[1::2])]


def items_of(benchmark: DataFrame) -> DataFrame:
    got = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return got.where("text <> ''").distinct()


_RESULTS = ["n_words", "n_hit", "items", "spans"]
_OUT = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns `keep` of docs (default doc_id), then n_words, n_hit, items (sorted as strings) and spans."""
    spark = docs.sparkSession
    common.ship(spark)
    keep = common.beside(keep or ["doc_id"], _RESULTS)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias("__text"))
    items = items_of(benchmark)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-size // block_bytes)
    if n_blocks > 1:
        return _in_blocks(rows, items, window, n_blocks)
    shared = spark.sparkContext.broadcast(sorted(((r[0], r[1]) for r in items.collect()), key=repr))

    def prepare():
        windows = _windows_of(shared.value, window)
        return lambda t, _: scan(t, windows)

    return _marked(rows, prepare)


def _marked(rows: DataFrame, prepare, extra: int = 0) -> DataFrame:
    """rows (columns to keep, __text, and `extra` more) with the result columns. prepare() gives, once for a task, what
    tells number of words, marks and items of a text and its extra columns."""
    width = len(rows.columns) - 1 - extra

    def over(batches):
        common.claim("decontamination", _built.clear)
        look = prepare()
        for b in batches:
            n_words, n_hit, items, where = [], [], [], []
            for i, t in enumerate(b.column(width)):
                t = t.as_py()
                n, mark, ids = look(t, [b.column(width + 1 + k)[i].as_py() for k in range(extra)])
                n_words.append(n)
                n_hit.append(int(mark.sum()))
                items.append(sorted(ids))
                where.append([{"start": x, "end": y} for x, y in spans(t, mark)] if mark.any() else [])
            cols = [*b.columns[:width], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(where, _SPAN)]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:width], *_RESULTS])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:width])
    return rows.mapInArrow(over, schema + _OUT)


def _in_blocks(rows: DataFrame, items: DataFrame, window: int, n_blocks: int) -> DataFrame:
    spark = rows.sparkSession
    rows = common.written(rows.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    items = common.written(items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks))), "items")

    def passing(shared):
        def over(batches):
            common.claim("decontamination", _built.clear)
            windows = _windows_of(shared.value, window)
            for b in batches:
                out = [(r, h[0], h[1], h[2]) for r, t in zip(b.column(0).to_pylist(), b.column(1)) for h in windows.hits(words(t.as_py()))]
                for i in range(0, len(out), 5000):
                    cols = zip(zip(*out[i : i + 5000]), (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string())))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], ["__row", "start", "end", "items"])

        return over

    found = []
    for k in range(n_blocks):
        shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in items.where(f"block = {k}").select("item", "text").collect()])
        found.append(common.written(rows.select("__row", "__text").mapInArrow(passing(shared), "__row long, start int, end int, items array<string>"), "hits"))
        shared.unpersist()
    hits = found[0]
    for f in found[1:]:
        hits = hits.unionByName(f)
    per_row = hits.groupBy("__row").agg(F.collect_set(F.struct("start", "end")).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("found"))

    def look(t, told):
        w = words(t)
        return len(w), marks(len(w), [h["start"] for h in told[0] or []], [h["end"] for h in told[0] or []]), set(told[1] or [])

    return _marked(rows.join(per_row, "__row", "left").select(*rows.columns[:-1], "hits", "found"), lambda: look, 2)


def is_contaminated() -> F.Column:
    return (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return got.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


#: Word windows of each length that the benchmark has, joined to those of the documents.
ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, s, s + least(len(w), 13) - 1), ' ') AS g
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM i WHERE len(w) > 0)),
g AS (SELECT k, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g
      FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
m AS (SELECT k, s, g.n, item FROM g JOIN p ON g.g = p.g AND g.n = p.n),
h AS (SELECT k, count(DISTINCT x) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS x FROM m) GROUP BY k),
t AS (SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY k)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.k = h.k LEFT JOIN t ON d.k = t.k
"""
