"""What a segment's rewrite lost or invented. Segments: trace_id, turn_index, seg_index, original, effective.

Only segments with an original are judged. Findings: class, trace_id, turn_index, seg_index, original, effective, detail.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions import text as tx

SEG = ["trace_id", "turn_index", "seg_index"]
BIG_DROP_ITEMS, BIG_DROP_PERCENT = 10, 50


def paired(segments: DataFrame) -> DataFrame:
    return segments.where("original is not null")


def segment_retention(segments: DataFrame) -> DataFrame:
    """Per segment: distinct numbers and artifacts of the original, and how many the rewrite still contains."""
    kept = lambda items: F.size(F.filter(items, lambda v: F.col("effective").contains(v))).cast("long")
    rows = paired(segments).withColumns({"__n": tx.numbers("original", None), "__a": tx.artifacts("original", None)})
    return rows.select(*SEG, F.size("__n").cast("long").alias("numerics_total"), kept("__n").alias("numerics_kept"), F.size("__a").cast("long").alias("artifacts_total"), kept("__a").alias("artifacts_kept"))


def retention(segments: DataFrame, by: list[str] | None = None) -> DataFrame:
    total, kept = F.col("numerics_total") + F.col("artifacts_total"), F.col("numerics_kept") + F.col("artifacts_kept")
    percent = F.when(total > 0, F.floor((total - kept) * 100 / total))
    big = (total >= BIG_DROP_ITEMS) & (percent >= BIG_DROP_PERCENT)
    return segment_retention(segments).groupBy(*(by or [])).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("numerics_total", "numerics_kept", "artifacts_total", "artifacts_kept")],
        F.count_if(big).alias("big_drop_segments"), F.coalesce(F.max(F.when(big, percent)), F.lit(0)).cast("int").alias("worst_drop_percent"),
    )


def fabrication(segments: DataFrame) -> DataFrame:
    rows = paired(segments)
    claims = rows.select(*SEG, F.posexplode(tx.grep_claims("effective")).alias("pos", "c")).select(*SEG, "pos", "c.location", F.col("c.content").alias("claimed"))
    truth = rows.select(*SEG, F.posexplode(tx.grep_claims("original")).alias("p", "c")).groupBy(*SEG, F.col("c.location").alias("location")).agg(F.max_by("c.content", "p").alias("actual"))
    wrong = claims.join(truth, [*SEG, "location"], "left").where("actual is null or actual <> claimed")
    at = F.col("location")
    return wrong.select(
        F.lit("fabrication").alias("class"), *SEG, F.when(F.col("actual").isNull(), "").otherwise(F.concat(at, F.lit(":"), "actual")).alias("original"), F.concat(at, F.lit(":"), "claimed").alias("effective"),
        F.when(F.col("actual").isNull(), F.concat(at, F.lit(" is claimed but absent from the original"))).otherwise(F.concat(F.lit("content at "), at, F.lit(" differs from the original"))).alias("detail"),
    )


def referenced_later(candidates: DataFrame, segments: DataFrame, needle: str = "value") -> DataFrame:
    """Those candidates (trace_id, turn_index, needle, ...) whose needle a later turn of the trace contains.

    Distinct needles meet the later segments of their own trace; nothing is compared across traces."""
    later = segments.select("trace_id", F.col("turn_index").alias("__t"), F.col("effective").alias("__e"))
    hit = candidates.select("trace_id", "turn_index", needle).distinct().join(later, "trace_id").where((F.col("__t") > F.col("turn_index")) & F.col("__e").contains(F.col(needle)))
    return candidates.join(hit.select("trace_id", "turn_index", needle).distinct(), ["trace_id", "turn_index", needle], "left_semi")


def _once(segments: DataFrame, side: str) -> DataFrame:
    pairs = paired(segments).select(*SEG, F.explode(tx.keyed_numbers(side)).alias("p"))
    return pairs.groupBy(*SEG, F.col("p.key").alias("key")).agg(F.count("*").alias("n"), F.min("p.value").alias("value"))


def numbers_changed(segments: DataFrame) -> DataFrame:
    """Keys that occur once on either side with different values."""
    a, b = _once(segments, "original").where("n = 1"), _once(segments, "effective").where("n = 1").select(*SEG, "key", F.col("value").alias("seen"))
    return a.join(b, [*SEG, "key"]).where("value <> seen").select(
        F.lit("numeric-drift").alias("class"), *SEG, F.concat("key", F.lit(" = "), "value").alias("original"), F.concat("key", F.lit(" = "), "seen").alias("effective"), F.concat(F.lit("value of "), "key", F.lit(" changed")).alias("detail")
    )


def numbers_dropped(segments: DataFrame) -> DataFrame:
    """Values that are gone and referenced later: those of a key first, then bare numbers no earlier finding of the turn ends with."""
    rows = paired(segments)
    keyed = _once(segments, "original").where("n = 1").join(_once(segments, "effective").select(*SEG, "key"), [*SEG, "key"], "left_anti")
    keyed = referenced_later(keyed.join(rows.select(*SEG, "effective"), SEG).where(~F.col("effective").contains(F.col("value"))).select(*SEG, "key", "value"), segments)
    keyed = keyed.select(*SEG, F.concat("key", F.lit(" = "), "value").alias("original"), F.concat("key", F.lit(" = "), "value", F.lit(" was dropped and "), "value", F.lit(" is referenced later")).alias("detail"))
    bare = rows.select(*SEG, "effective", F.posexplode(tx.numbers("original")).alias("pos", "value")).where(~F.col("effective").contains(F.col("value"))).select(*SEG, "pos", "value")
    bare = referenced_later(bare, segments)
    # of each ending of a turn's numbers, where a number first has it: those before a number are never gathered
    endings = F.transform(F.sequence(F.lit(1), F.length("value")), lambda i: F.expr("value").substr(i, F.length("value")))
    place = F.struct("seg_index", "pos")
    first = bare.select("trace_id", "turn_index", place.alias("place"), F.explode(endings).alias("value")).groupBy("trace_id", "turn_index", "value").agg(F.min("place").alias("first"))
    bare = bare.join(first, ["trace_id", "turn_index", "value"]).where(F.col("first") >= place).drop("first")
    told = keyed.unionByName(numbers_changed(segments).select(*SEG, "original", "detail")).groupBy("trace_id", "turn_index").agg(F.collect_list(F.struct("seg_index", "original")).alias("told"))
    bare = bare.join(told, ["trace_id", "turn_index"], "left")
    known = F.exists("told", lambda x: (x["seg_index"] <= F.col("seg_index")) & F.endswith(x["original"], F.col("value")))
    bare = bare.where(~F.coalesce(known, F.lit(False))).select(*SEG, F.col("value").alias("original"), F.concat("value", F.lit(" was dropped and is referenced later")).alias("detail"))
    return keyed.unionByName(bare).select(F.lit("numeric-drift").alias("class"), *SEG, "original", F.lit("").alias("effective"), "detail")


def artifacts_lost(segments: DataFrame) -> DataFrame:
    gone = paired(segments).select(*SEG, "effective", F.explode(tx.artifacts("original")).alias("value")).where(~F.col("effective").contains(F.col("value"))).select(*SEG, "value")
    return referenced_later(gone, segments).select(F.lit("artifact-loss").alias("class"), *SEG, F.col("value").alias("original"), F.lit("").alias("effective"), F.concat("value", F.lit(" was dropped and is referenced later")).alias("detail"))


def findings(segments: DataFrame) -> DataFrame:
    return fabrication(segments).unionByName(numbers_changed(segments)).unionByName(numbers_dropped(segments)).unionByName(artifacts_lost(segments))


def count_by_class(found: DataFrame) -> DataFrame:
    return found.groupBy("class").count()


def scoreboard(traces: DataFrame, segments: DataFrame, usage: DataFrame) -> DataFrame:
    """By optimizer (or `none`): traces by origin and party, paired segments, retention, findings, tokens.

    Each fact is summed up by optimizer before they are joined, so none multiplies another.
    traces: trace_id, optimizer, origin, party. usage: trace_id and total_tokens."""
    named = traces.select("trace_id", F.coalesce("optimizer", F.lit("none")).alias("optimizer"), "origin", "party")
    of = named.select("trace_id", "optimizer")
    base = named.groupBy("optimizer").agg(
        F.count("*").alias("traces"), F.count_if(F.col("origin") == "real-work").alias("real_work"), F.count_if(F.col("origin") == "synthetic").alias("synthetic"),
        F.count_if(F.col("party") == "first-party").alias("first_party"), F.count_if(F.col("party") == "donated").alias("donated"),
    )
    pairs = paired(segments).join(of, "trace_id").groupBy("optimizer").agg(F.count("*").alias("paired_segments"))
    kept = segment_retention(segments).join(of, "trace_id").groupBy("optimizer").agg(*[F.sum(c).alias(c) for c in ("numerics_total", "numerics_kept", "artifacts_total", "artifacts_kept")])
    classes = findings(segments).join(of, "trace_id").groupBy("optimizer").agg(*[F.count_if(F.col("class") == c).alias(c.replace("-", "_")) for c in ("fabrication", "numeric-drift", "artifact-loss")])
    tokens = usage.join(of, "trace_id").groupBy("optimizer").agg(F.sum("total_tokens").alias("tokens"))
    out = base
    for part in (pairs, kept, classes, tokens):
        out = out.join(part, "optimizer", "left")
    counts = [c for c in out.columns if c != "optimizer"]
    return out.fillna(0, counts).withColumn("single_fleet", F.col("donated") == 0)
