"""The ledger of optimisation events: what counts, totals, curves that never fall below zero, spend.

Events have a total order, `seq`. An event with a kept_reason changed nothing and counts on its own axis.
An event whose transform is `resolve` hands tokens back. Of the others the first of each non-empty cert counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_MS, DAY_MS = 3_600_000, 86_400_000
RECENT, CURVE_POINTS = 40, 120
BUCKET_ROWS = 500_000  # values of seq that one task sorts


def counted(events: DataFrame) -> DataFrame:
    """The events that count, with kind (block or resolve) and delta, the tokens it adds to the savings."""
    live = events.where("coalesce(kept_reason, '') = ''")
    resolve = F.col("transform") == "resolve"
    blocks, unsigned = live.where(~resolve), F.coalesce("cert", F.lit("")) == ""
    # the minimum aggregates on the map side, so a cert that is resent very often is no hot task
    first = blocks.where(~unsigned).groupBy("cert").agg(F.min("seq").alias("seq"))
    kept = blocks.where(unsigned).unionByName(blocks.where(~unsigned).join(first, ["cert", "seq"], "left_semi"))
    saved = F.greatest(F.col("input_tokens") - F.col("output_tokens"), F.lit(0))
    return kept.withColumn("kind", F.lit("block")).withColumn("delta", saved).unionByName(live.where(resolve).withColumn("kind", F.lit("resolve")).withColumn("delta", -F.col("reopened_tokens")))


def summary(events: DataFrame) -> DataFrame:
    """One row of totals; net never falls below zero."""
    block, resolve = F.col("kind") == "block", F.col("kind") == "resolve"
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    s = lambda name, c: F.coalesce(F.sum(F.when(c, F.col(name))), F.lit(0))
    live = counted(events).agg(
        n(block).alias("blocks"), n(block & F.col("verified")).alias("verified"), n(block & F.col("inline")).alias("inline"), n(block & ~F.col("inline")).alias("offloaded"),
        s("input_tokens", block).alias("input_tokens"), s("output_tokens", block).alias("output_tokens"), n(resolve).alias("reopens"), s("reopened_tokens", resolve).alias("reopened_tokens"),
    )
    kept = events.where("coalesce(kept_reason, '') <> ''").agg(F.count("*").alias("kept"))
    out = live.join(F.broadcast(kept))  # one row each
    net = F.greatest(F.greatest(F.col("input_tokens") - F.col("output_tokens"), F.lit(0)) - F.col("reopened_tokens"), F.lit(0))
    return out.withColumn("seen", F.col("blocks") + F.col("kept")).withColumn("net_tokens", net)


def by_axis(events: DataFrame) -> DataFrame:
    """axis, key, blocks, saved: by transform, surface, model, platform and kept reason, in one pass of grouping sets."""
    axes = ["transform", "surface", "model", "platform"]
    rows = counted(events).where("kind = 'block'").select(*axes, "delta")
    long = rows.select("delta", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("key")) for a in axes])).alias("x"))
    named = long.where("x.axis in ('transform', 'surface') or coalesce(x.key, '') <> ''")
    kept = events.where("coalesce(kept_reason, '') <> ''").groupBy(F.lit("kept_reason").alias("axis"), F.col("kept_reason").alias("key")).agg(F.count("*").alias("blocks"), F.lit(0).cast("long").alias("saved"))
    return named.groupBy("x.axis", "x.key").agg(F.count("*").alias("blocks"), F.sum("delta").alias("saved")).unionByName(kept)


def curve(events: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """seq, at_ms, cumulative_tokens after each counted event, clamped at zero at every step.

    With S the running sum the clamped total is S - min(0, least S so far). Events are summed in buckets of seq
    order first: a bucket's sum and least prefix carry over to the next, so no task sorts more than a bucket."""
    rows = counted(events).select("seq", "at_ms", "delta", F.floor(F.col("seq") / bucket_rows).alias("bucket"))
    inside = Window.partitionBy("bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("s", F.sum("delta").over(inside)).withColumn("low", F.min("s").over(inside))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket with events
    ends = rows.groupBy("bucket").agg(F.sum("delta").alias("total"), F.min("s").alias("least"))
    ends = ends.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0))).withColumn("deepest", F.coalesce(F.min(F.col("base") + F.col("least")).over(before), F.lit(0)))
    s = F.col("base") + F.col("s")
    out = rows.join(ends.select("bucket", "base", "deepest"), "bucket")
    return out.select("seq", "at_ms", (s - F.least(F.lit(0), F.col("deepest"), F.col("base") + F.col("low"))).alias("cumulative_tokens"))


def downsample(points: DataFrame, most: int = CURVE_POINTS) -> DataFrame:
    """At most `most` points: every stride-th of all but the last, and the last."""
    total = points.count()
    if total <= most:
        return points
    stride = -(-(total - 1) // (most - 1))
    # a total order over many rows without one task that has them all: ranks in buckets of seq
    rows = points.withColumn("bucket", F.floor(F.col("seq") / BUCKET_ROWS))
    sizes = rows.groupBy("bucket").count().withColumn("base", F.coalesce(F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("seq"))).join(sizes.select("bucket", "base"), "bucket")
    i = F.col("r") + F.col("base") - 1
    return ranked.where((i == total - 1) | ((i < total - 1) & (i % stride == 0))).select(points.columns)


def clamped_total(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and saved: the clamped running total at the end of each group's events in order of seq. As in curve(), the
    order is taken in buckets of seq, and a window over a group's bucket totals joins them."""
    rows = rows.withColumn("bucket", F.floor(F.col("seq") / BUCKET_ROWS))
    inside = Window.partitionBy(*keys, "bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("s", F.sum("delta").over(inside)).groupBy(*keys, "bucket").agg(F.sum("delta").alias("total"), F.min("s").alias("least"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("low", F.coalesce(F.sum("total").over(before), F.lit(0)) + F.col("least"))
    return ends.groupBy(*keys).agg((F.sum("total") - F.least(F.lit(0), F.min("low"))).alias("saved"))


def period_starts(now_ms: int, offset_min: int = 0) -> dict[str, int]:
    """When the last hour, and the viewer's day, week (from Monday) and month began."""
    import datetime as dt

    tz = offset_min * 60_000
    day = (now_ms - tz) // DAY_MS
    month = (dt.date(1970, 1, 1) + dt.timedelta(days=day)).replace(day=1)
    return {"hour": now_ms - HOUR_MS, "day": day * DAY_MS + tz, "week": (day - (day + 3) % 7) * DAY_MS + tz, "month": (month - dt.date(1970, 1, 1)).days * DAY_MS + tz}


def saved_since(events: DataFrame, now_ms: int, offset_min: int = 0) -> DataFrame:
    """period, saved: hour, day, week and month up to now."""
    starts = period_starts(now_ms, offset_min)
    names = F.array(*[F.when(F.col("at_ms") >= at, F.lit(p)) for p, at in starts.items()])
    rows = counted(events).select("seq", "delta", F.explode(F.filter(names, lambda x: x.isNotNull())).alias("period"))
    every = events.sparkSession.createDataFrame([(p,) for p in starts], "period string")
    return every.join(clamped_total(rows, ["period"]), "period", "left").select("period", F.coalesce("saved", F.lit(0)).alias("saved"))


def calendar(events: DataFrame, unit: str, offset_min: int = 0) -> DataFrame:
    """start, saved: clamped savings of each day, week or month."""
    local = F.timestamp_millis(F.col("at_ms") - offset_min * 60_000)
    rows = counted(events).select("seq", "delta", F.date_trunc(unit, local).cast("date").alias("start"))
    return clamped_total(rows, ["start"])


def recent(events: DataFrame, n: int = RECENT) -> DataFrame:
    return events.orderBy(F.desc("seq")).limit(n)


def receipt(events: DataFrame, since_ms: int) -> DataFrame:
    return summary(events.where(F.col("at_ms") >= since_ms))


def with_rates(usage: DataFrame, rates: DataFrame, model: str = "model") -> DataFrame:
    """usage with the rates of the longest prefix of its model; models are few, so prefixes meet distinct models."""
    models = usage.select(F.col(model).alias("m")).distinct()
    hits = models.join(F.broadcast(rates), models["m"].startswith(rates["prefix"]))
    best = hits.groupBy("m").agg(F.max_by(F.struct(*rates.columns), F.length("prefix")).alias("rate"))
    return usage.join(best, usage[model] == best["m"], "left").drop("m")


USAGE = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens"]


def spend(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """By model: token sums, USD as billed and without caching; null USD for models without rates."""
    rows = with_rates(usage.withColumn("model", F.coalesce("model", F.lit("unknown"))), rates)
    r, u = (lambda c: F.col(f"rate.{c}")), F.col
    actual = (u("input_tokens") * r("input") + u("output_tokens") * r("output") + u("cache_read_tokens") * r("cache_read") + u("cache_write_5m_tokens") * r("cache_write_5m") + u("cache_write_1h_tokens") * r("cache_write_1h")) / 1e6
    without = ((u("input_tokens") + u("cache_read_tokens") + u("cache_write_5m_tokens") + u("cache_write_1h_tokens")) * r("input") + u("output_tokens") * r("output")) / 1e6
    total = sum((u(c) for c in USAGE[1:]), u(USAGE[0]))
    return rows.groupBy("model").agg(*[F.sum(c).alias(c) for c in USAGE], F.round(F.sum(actual), 6).alias("actual_usd"), F.round(F.sum(without), 6).alias("without_caching_usd"), F.sum(total).alias("billed_tokens"))
