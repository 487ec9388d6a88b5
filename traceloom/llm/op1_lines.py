"""Line dedup by site-relative frequency.

A line's key is its text without blanks at its ends. On each host the pages that contain a key are divided
by the host's pages; keys on more than `ratio` of them, and on at least `min_pages`, are boilerplate there,
and every line with such a key is dropped from that host's pages. Blank lines are never dropped.

A host has at most (mean distinct lines of its pages) / ratio such keys, as each is on more than that share
of its pages. They are gathered into one array a host; that table is broadcast only if it is written with at
most BROADCAST_BYTES, else joined by host, where Spark splits hosts that are too large.

Keys are compared by two hashes, of 64 and 32 bits. A null text stays null and has no lines; a null host is
a host of its own. Repeated rows count as pages of their own. A page may be left with an empty text. No row
is dropped, and an empty table gives none. Very long texts are read whole. All columns but the text are kept,
but n_lines and n_dropped of the input give way to the result's; names that begin with __ are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm import common

RATIO, MIN_PAGES = 0.1, 5
BROADCAST_BYTES = 16 << 20


def _key(line):
    t = F.trim(line)
    return F.struct(F.xxhash64(t).alias("x"), F.hash(t).alias("y"))


def _host(host):
    return F.coalesce(F.concat(F.lit("h"), host.cast("string")), F.lit("-"))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """__host and __keys, the keys of its boilerplate lines."""
    rows = pages.select(_host(F.col(host)).alias("__host"), F.split(text, "\n").alias("lines"))
    keys = F.array_distinct(F.transform(F.filter("lines", lambda x: F.trim(x) != ""), _key))
    having = rows.select("__host", F.explode(keys).alias("k")).groupBy("__host", "k.x", "k.y").agg(F.count("*").alias("having")).where(F.col("having") >= min_pages)
    total = rows.groupBy("__host").agg(F.count("*").alias("pages"))
    found = having.join(total, "__host").where(F.col("having") > ratio * F.col("pages"))
    return found.groupBy("__host").agg(F.collect_list(F.struct("x", "y")).alias("__keys"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages, with the lines dropped from the text, and n_lines and n_dropped (-1 and -1 for null texts)."""
    found = common.written(boilerplate(pages, host, text, ratio, min_pages), "boilerplate")
    if (found.agg(F.sum(F.size("__keys")), F.count("*")).first()[0] or 0) * 16 <= BROADCAST_BYTES:
        found = F.broadcast(found)
    pages = pages.select(*[F.col(f"`{c}`") for c in common.beside(pages.columns, ["n_lines", "n_dropped"])])
    rows = pages.withColumn("__host", _host(F.col(host))).join(found, "__host", "left")
    lines = F.split(text, "\n")
    kept = F.when(F.col("__keys").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains("__keys", _key(x)) | (F.trim(x) == "")))
    rows = rows.withColumn("__kept", kept).withColumn("n_lines", F.coalesce(F.size(lines), F.lit(-1)).cast("long"))
    rows = rows.withColumn("n_dropped", F.when(F.col(text).isNull(), -1).otherwise(F.size(lines) - F.size("__kept")).cast("long"))
    return rows.withColumn(text, F.array_join("__kept", "\n")).drop("__kept", "__host", "__keys")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "n_lines", "n_dropped", "text")


ORACLE = f"""
WITH p AS (SELECT row_number() OVER () AS k, doc_id, source, text, string_split(text, chr(10)) AS w FROM documents),
t AS (SELECT source, count(*) AS n FROM p GROUP BY source),
l AS (SELECT source, l, count(*) AS c FROM (SELECT DISTINCT k, source, trim(l, ' ') AS l FROM (SELECT k, source, unnest(w) AS l FROM p)) WHERE l <> '' GROUP BY source, l),
b AS (SELECT l.source, list(l.l) AS x FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source WHERE c >= {MIN_PAGES} AND c > {RATIO} * n GROUP BY l.source),
o AS (SELECT p.*, CASE WHEN x IS NULL THEN w ELSE list_filter(w, lambda y: NOT list_contains(x, trim(y, ' '))) END AS z FROM p LEFT JOIN b ON p.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, coalesce(len(w), -1) AS n_lines, coalesce(len(w) - len(z), -1) AS n_dropped, array_to_string(z, chr(10)) AS text FROM o
"""
