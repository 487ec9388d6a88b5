"""Proofs that a rewrite lost nothing: multisets of rows and atoms, certificates, prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BYTES_PER_TOKEN = 4


def fingerprint(rows: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """keys and clmh: XOR over the rows' hashes, each salted with its occurrence number, so repeats don't cancel out."""
    fp = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in cols]), 256)
    w = Window.partitionBy(*keys, "fp").orderBy("fp")
    numbered = rows.select(*keys, fp.alias("fp")).withColumn("occ", F.row_number().over(w) - 1)
    h = F.sha2(F.concat_ws(":", "fp", "occ"), 256)
    words = [F.bit_xor(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"w{i}") for i in range(8)]
    hexed = F.concat(*[F.lpad(F.lower(F.hex(f"w{i}")), 8, "0") for i in range(8)])
    return numbered.groupBy(*keys).agg(*words, F.count("*").alias("atoms")).select(*keys, "atoms", hexed.alias("clmh"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both have the same rows equally often."""
    cols = a.columns
    count = lambda df, n: df.groupBy(*cols).agg(F.count("*").alias(n))
    left, right = count(a, "x"), count(b, "y")
    on = [left[c].eqNullSafe(right[c]) for c in cols]
    cond = on[0]
    for c in on[1:]:
        cond &= c
    return left.join(right, cond, "full_outer").agg((F.count_if(~F.col("x").eqNullSafe(F.col("y"))) == 0).alias("same"))


def price(before, after, input_rate, read_rate=None, write_rate=None, turns=None, zone: str = "suffix"):
    """USD that a rewrite saves; null where it isn't worth it. Units are tokens; rates are USD for a million.

    Suffix: what is saved is billed as input. Frozen: each later turn reads less, but the tail is written again."""
    saved = before - after
    if zone == "suffix":
        usd = saved * input_rate / 1e6
    else:
        usd = (saved * read_rate * turns - after * write_rate) / 1e6
    return F.when((saved > 0) & (usd > 0), usd)


def tokens(text):
    """The default unit: bytes."""
    return F.octet_length(text)


def approx_tokens(text):
    return F.ceil(F.octet_length(text) / BYTES_PER_TOKEN)


def reconcile(zone, creation, read):
    """cache_bust where a frozen prefix was written again rather than read; else held."""
    return F.when((zone == "frozen") & (creation > read) & (creation > 0), "cache_bust").otherwise("held")


def affix(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, prefix and suffix that all of a group's texts share, in characters; they never overlap in the shortest.

    Least and greatest text share what all share, from the front; from the back the same holds of reversed texts."""
    c, back = F.col(text), F.reverse(F.col(text))
    ends = rows.groupBy(*keys).agg(F.min(c).alias("a"), F.max(c).alias("z"), F.min(back).alias("ra"), F.max(back).alias("rz"), F.min(F.length(c)).alias("n"))

    def common(a, z):
        both = F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(z)), F.lit(1)))
        return F.size(F.filter(both, lambda i: F.substring(a, F.lit(1), i) == F.substring(z, F.lit(1), i)))

    size = ends.withColumn("p", F.when(F.col("n") > 0, common(F.col("a"), F.col("z"))).otherwise(0))
    size = size.withColumn("s", F.when(F.col("n") > 0, F.least(common(F.col("ra"), F.col("rz")), F.col("n") - F.col("p"))).otherwise(0))
    return size.select(*keys, F.substring(F.col("a"), F.lit(1), F.col("p")).alias("prefix"), F.reverse(F.substring(F.col("ra"), F.lit(1), F.col("s"))).alias("suffix"))


def split_covers(shown: DataFrame, stored: DataFrame, whole: DataFrame) -> DataFrame:
    """One row: whether the rows in view and those stored are together exactly the original's."""
    return same_rows(shown.unionAll(stored), whole)


def tree_equal(pairs: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """keys and equal, of leaves (keys, path, original, rewritten, id): every path on both sides, and each text that
    differs resolves, by the id of the marker it carries, to the original."""
    rows = pairs.join(store.select("id", F.col("raw").alias("__raw")), "id", "left")
    ok = F.col("original").eqNullSafe(F.col("rewritten")) | (F.col("original").isNotNull() & F.col("rewritten").isNotNull() & F.col("__raw").eqNullSafe(F.col("original")))
    return rows.groupBy(*keys).agg(F.bool_and(ok).alias("equal"))


def context_savings(decisions: DataFrame) -> DataFrame:
    """One row of summed tokens, four bytes each: baseline, treatment and what is saved."""
    t = lambda c: F.coalesce(F.sum(F.floor(F.octet_length(c) / BYTES_PER_TOKEN)), F.lit(0))
    return decisions.agg(t("baseline").alias("baseline"), t("treatment").alias("treatment")).withColumn("saved", F.greatest(F.col("baseline") - F.col("treatment"), F.lit(0)))
