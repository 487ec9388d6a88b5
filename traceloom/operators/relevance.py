"""Relevance of rows to a query: BM25, feedback terms, trigram coverage, cosine; selection and rank metrics.

Rows: collection, row (its number), text. Queries: block, collection, query. Any number of queries may ask one collection:
its texts are split into terms once, whatever their number, and only terms that some query of it has are
exchanged. Without a column collection, a block is a collection of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions import text as tx

# Weights and bounds of the score.
K1, B = 1.5, 0.75
FEEDBACK_ROWS, FEEDBACK_TERMS, FEEDBACK_WEIGHT = 3, 8, 0.4
TRIGRAM_WEIGHT, TRIGRAM_MIN = 0.6, 0.34
SELECT_RATIO = 0.15


def _in_collections(df: DataFrame) -> DataFrame:
    return df if "collection" in df.columns else df.withColumn("collection", F.col("block"))


def _words(rows: DataFrame) -> DataFrame:
    """collection, row, w (the text's terms), len."""
    return _in_collections(rows).select("collection", "row", tx.terms("text").alias("w")).withColumn("len", F.size("w"))


def hits(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """collection, row, term, tf, len, avg_len, n of the wanted terms (collection, term), with the collection's row count
    and mean length."""
    words = _words(rows)
    stats = words.groupBy("collection").agg(F.count("*").alias("n"), F.greatest(F.avg("len"), F.lit(1.0)).alias("avg_len"))
    found = words.select("collection", "row", "len", F.explode("w").alias("term")).join(wanted.select("collection", "term").distinct(), ["collection", "term"])
    return found.groupBy("collection", "row", "len", "term").agg(F.count("*").alias("tf")).join(stats, "collection")


def _idf(df, n):
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def score_terms(found: DataFrame, weights: DataFrame) -> DataFrame:
    """block, row, score of rows that have some weighted term (block, collection, term, weight)."""
    df = found.groupBy("collection", "term").agg(F.count("*").alias("df"))
    tf = F.col("tf")
    part = F.col("weight") * _idf(F.col("df"), F.col("n")) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return found.join(df, ["collection", "term"]).join(weights, ["collection", "term"]).groupBy("block", "row").agg(F.sum(part).alias("score"))


def query_terms(queries: DataFrame) -> DataFrame:
    return _in_collections(queries).select("block", "collection", F.explode(F.array_distinct(tx.terms("query"))).alias("term")).withColumn("weight", F.lit(1.0))


def bm25(rows: DataFrame, queries: DataFrame) -> DataFrame:
    own = query_terms(queries)
    return score_terms(hits(rows, own), own)


def feedback(rows: DataFrame, base: DataFrame, own: DataFrame) -> DataFrame:
    """Expansion terms (block, collection, term, weight) of the best rows, by frequency there times rarity; ties by term."""
    best = base.where("score > 0").withColumn("r", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("score"), "row"))).where(f"r <= {FEEDBACK_ROWS}").select("block", "row")
    best = best.join(own.select("block", "collection").distinct(), "block")
    tf = _words(rows).join(best, ["collection", "row"]).select("block", "collection", F.explode("w").alias("term")).groupBy("block", "collection", "term").agg(F.count("*").alias("f"))
    tf = tf.join(own.select("block", "term"), ["block", "term"], "left_anti")
    df = hits(rows, tf).groupBy("collection", "term", "n").agg(F.count("*").alias("df"))
    w = tf.join(df, ["collection", "term"]).withColumn("w", F.col("f") * F.greatest(_idf(F.col("df"), F.col("n")), F.lit(0.0))).where("w > 0")
    top = w.withColumn("r", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("w"), "term"))).where(f"r <= {FEEDBACK_TERMS}")
    most = F.greatest(F.max("w").over(Window.partitionBy("block")), F.lit(1e-9))  # of at most FEEDBACK_TERMS rows
    return top.select("block", "collection", "term", (FEEDBACK_WEIGHT * F.col("w") / most).alias("weight"))


def trigram_coverage(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """block, row, covered: share of the query's letter trigrams that the row has. A row's trigrams are made once."""
    q = _in_collections(queries).select("block", "collection", tx.trigrams(F.array_distinct(tx.terms("query"))).alias("q")).where(F.size("q") > 0)
    one = q.select("block", "collection", F.size("q").alias("of"), F.explode("q").alias("gram"))
    grams = _words(rows).select("collection", "row", F.explode(tx.trigrams("w")).alias("gram")).join(one, ["collection", "gram"])
    return grams.groupBy("block", "row", "of").agg(F.count("*").alias("c")).select("block", "row", (F.col("c") / F.col("of")).alias("covered"))


def rank(rows: DataFrame, queries: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """block, row, score. semantic (block, row, semantic) adds to the lexical score."""
    own = query_terms(queries)
    base = score_terms(hits(rows, own), own)
    every = own.unionByName(feedback(rows, base, own))
    full = score_terms(hits(rows, every), every)
    grams = trigram_coverage(rows, queries).where(F.col("covered") >= TRIGRAM_MIN).select("block", "row", (TRIGRAM_WEIGHT * F.col("covered")).alias("extra"))
    pairs = _in_collections(rows).select("collection", "row").join(_in_collections(queries).select("block", "collection"), "collection").select("block", "row")
    out = pairs.join(full, ["block", "row"], "left").join(grams, ["block", "row"], "left")
    score = F.coalesce("score", F.lit(0.0)) + F.coalesce("extra", F.lit(0.0))
    if semantic is not None:
        out, score = out.join(semantic, ["block", "row"], "left"), score + F.coalesce("semantic", F.lit(0.0))
    return out.select("block", "row", score.alias("score"))


def select(scores: DataFrame, keep: int) -> DataFrame:
    """Rows near the best score, at most `keep` a block; none where no score is positive."""
    top = scores.groupBy("block").agg(F.max("score").alias("top")).where("top > 0")
    near = scores.join(top, "block").where(F.col("score") >= F.col("top") * SELECT_RATIO)
    return near.withColumn("r", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("score"), "row"))).where(F.col("r") <= keep).select("block", "row", "score")


def rank_metrics(scores: DataFrame, relevant: DataFrame) -> DataFrame:
    """MRR, P@1, P@3 and R@3 over blocks; relevant: block, row."""
    good = relevant.withColumn("good", F.lit(1))
    ranked = scores.withColumn("r", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("score"), "row"))).join(good, ["block", "row"], "left").fillna(0, ["good"])
    per = ranked.groupBy("block").agg(F.min(F.when(F.col("good") == 1, F.col("r"))).alias("first"), F.sum(F.when(F.col("r") <= 1, F.col("good")).otherwise(0)).alias("one"), F.sum(F.when(F.col("r") <= 3, F.col("good")).otherwise(0)).alias("three"), F.sum("good").alias("all"))
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return per.agg(F.count("*").alias("queries"), mean(F.coalesce(1 / F.col("first"), F.lit(0.0)), "mrr"), mean(F.col("one").cast("double"), "p1"), mean(F.col("three") / 3, "p3"), mean(F.when(F.col("all") > 0, F.col("three") / F.col("all")).otherwise(0.0), "r3"))


def cosine(a, b):
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
