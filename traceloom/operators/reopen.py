"""Whether the model later needed what a preview hid; rates of that by class and size; what they decide.

Turns: trace_id, turn_index, role, effective. A token (a significant word) of a block counts as needed if the
block's turn is the first in the trace that has it, the preview lacks it, and the assistant uses it in a later
turn before any other turn supplies it again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions import text as tx

THRESHOLD = 0.4
FEW_KEYS = 100_000  # a list of so many keys is broadcast


def tokens(turns: DataFrame) -> DataFrame:
    """Distinct trace_id, turn_index, role, tok."""
    return turns.select("trace_id", "turn_index", "role", F.explode(F.array_distinct(tx.significant("effective"))).alias("tok")).distinct()


def first_seen(tok: DataFrame) -> DataFrame:
    return tok.groupBy("trace_id", "tok").agg(F.min("turn_index").alias("first_turn"))


def next_supply_and_use(tok: DataFrame) -> DataFrame:
    """For each token of a turn: the next turn that supplies it (any but the assistant's) and the assistant's next.

    One window over (trace, token) takes the place of a join of tokens with themselves."""
    per = tok.groupBy("trace_id", "turn_index", "tok").agg(F.max((F.col("role") == "assistant").cast("int")).alias("used"), F.max((F.col("role") != "assistant").cast("int")).alias("supplied"))
    after = Window.partitionBy("trace_id", "tok").orderBy("turn_index").rowsBetween(1, Window.unboundedFollowing)
    return per.withColumn("next_supply", F.min(F.when(F.col("supplied") == 1, F.col("turn_index"))).over(after)).withColumn("next_use", F.min(F.when(F.col("used") == 1, F.col("turn_index"))).over(after))


def needed(tok: DataFrame) -> DataFrame:
    """trace_id, turn_index, tok that the assistant uses later, before it is supplied again."""
    return next_supply_and_use(tok).where("next_use is not null and (next_supply is null or next_use < next_supply)").select("trace_id", "turn_index", "tok")


def referenced_after(tok: DataFrame) -> DataFrame:
    """trace_id, turn_index, tok that an assistant turn after this one has."""
    last = tok.where("role = 'assistant'").groupBy("trace_id", "tok").agg(F.max("turn_index").alias("last_use"))
    return tok.join(last, ["trace_id", "tok"]).where("last_use > turn_index").select("trace_id", "turn_index", "tok").distinct()


def hidden(blocks: DataFrame) -> DataFrame:
    """blocks (trace_id, turn_index, block, body, preview): a row for each token that the preview lacks."""
    return blocks.select("trace_id", "turn_index", "block", F.explode(tx.residual(tx.significant("body"), tx.significant("preview"))).alias("tok"))


def reopened(blocks: DataFrame, turns: DataFrame, resupply: bool = True) -> DataFrame:
    """blocks with some hidden token, and whether one of them is needed later."""
    tok = tokens(turns)
    rows = hidden(blocks)
    want = (needed(tok) if resupply else referenced_after(tok)).join(first_seen(tok), ["trace_id", "tok"]).where("first_turn = turn_index").select("trace_id", "turn_index", "tok")
    hit = rows.join(want, ["trace_id", "turn_index", "tok"], "left_semi").select("trace_id", "turn_index", "block").distinct().withColumn("reopened", F.lit(True))
    every = rows.select("trace_id", "turn_index", "block").distinct()
    return every.join(hit, ["trace_id", "turn_index", "block"], "left").withColumn("reopened", F.coalesce("reopened", F.lit(False)))


def reopen_rate(blocks: DataFrame, turns: DataFrame) -> DataFrame:
    """shape, offloads, reopens, rate."""
    out = reopened(blocks, turns, resupply=False).join(blocks.select("trace_id", "turn_index", "block", tx.shape("body").alias("shape")), ["trace_id", "turn_index", "block"])
    return out.groupBy("shape").agg(F.count("*").alias("offloads"), F.count_if("reopened").alias("reopens")).withColumn("rate", F.col("reopens") / F.col("offloads"))


def turn_context(turns: DataFrame) -> DataFrame:
    """Per turn: latest user prompt, assistant turns after it, and the next billed context (0 if none).
    turns has context_tokens for billed assistant turns, or null."""
    order = Window.partitionBy("trace_id").orderBy("turn_index")
    prompt = F.when((F.col("role") == "user") & (F.trim("effective") != ""), F.col("effective"))
    return turns.select(
        "trace_id", "turn_index", F.coalesce(F.last(prompt, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit("")).alias("prompt"),
        F.coalesce(F.sum((F.col("role") == "assistant").cast("long")).over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("turns_after"),
        F.coalesce(F.first(F.when(F.col("role") == "assistant", F.col("context_tokens")), ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)), F.lit(0)).alias("next_context"),
    )


def tally(outcomes: DataFrame) -> DataFrame:
    """By class, and over all (class null): net = raw - sent - back. outcomes: class, outcome, raw, sent, reopened."""
    back = F.when(F.col("reopened"), F.col("raw")).otherwise(0)
    out = outcomes.rollup("class").agg(
        F.count("*").alias("blocks"), F.sum("raw").alias("raw"), F.sum("sent").alias("sent"), F.sum(back).cast("long").alias("back"),
        F.count_if(F.col("outcome") == "offload").alias("offloads"), F.count_if((F.col("outcome") == "offload") & F.col("reopened")).alias("reopens"),
    )
    net = F.col("raw") - F.col("sent") - F.col("back")
    return out.withColumn("net", net).withColumn("net_ratio", F.round(F.when(F.col("raw") > 0, net / F.col("raw")).otherwise(0.0), 6)).withColumn("reopen_rate", F.round(F.when(F.col("offloads") > 0, F.col("reopens") / F.col("offloads")).otherwise(0.0), 6))


def learn(outcomes: DataFrame, least: int = 30) -> DataFrame:
    """Smoothed rates: class and band null for the prior, band null for a class. Both need `least` offloads, a band its class too."""
    rows = outcomes.where("outcome = 'offload'").withColumn("band", tx.size_band("raw"))
    rolled = rows.rollup("class", "band").agg(F.count("*").alias("n"), F.count_if("reopened").alias("hits"))
    rate = rolled.withColumn("rate", (F.col("hits") + 1) / (F.col("n") + 2))
    classes = rate.where("class is not null and band is null").where(F.col("n") >= least).select("class")
    return rate.where("class is null and band is null").unionByName(rate.where("class is not null").where(F.col("n") >= least).join(classes, "class", "left_semi")).select("class", "band", "n", "rate")


def predict(blocks: DataFrame, policy: DataFrame, threshold: float = THRESHOLD, prior: float | None = None) -> DataFrame:
    """blocks (class, raw) with predicted rate - of class and band, else class, else the prior - and allows_offload."""
    bands = policy.where("band is not null").select("class", F.col("band").alias("__band"), F.col("rate").alias("__b"))
    classes = policy.where("class is not null and band is null").select("class", F.col("rate").alias("__c"))
    top = F.lit(prior) if prior is not None else F.lit(policy.where("class is null").select("rate").first()[0])
    rows = blocks.withColumn("__band", tx.size_band("raw")).join(bands, ["class", "__band"], "left").join(classes, "class", "left")
    rate = F.coalesce("__b", "__c", top)
    return rows.withColumn("predicted", rate).withColumn("allows_offload", rate < threshold).drop("__band", "__b", "__c")


def cache_savings(blocks: DataFrame, input_rate: float, read_rate: float) -> DataFrame:
    """Of blocks (before, after, turn, turns) that shrink: naive savings bill each resend as input, adjusted ones as cache reads."""
    saved, reuse = F.col("before") - F.col("after"), F.col("turns") - F.col("turn") - 1
    return blocks.where("after < before").agg(
        F.count("*").alias("blocks"), F.coalesce(F.sum("before"), F.lit(0)).alias("original_tokens"), F.coalesce(F.sum("after"), F.lit(0)).alias("compressed_tokens"),
        F.round(F.coalesce(F.sum(saved * input_rate / 1e6 * (1 + reuse)), F.lit(0.0)), 6).alias("naive_usd"), F.round(F.coalesce(F.sum(saved * (input_rate + read_rate * reuse) / 1e6), F.lit(0.0)), 6).alias("cache_adjusted_usd"),
    )


def _let(value, f) -> Column:
    """f of a value that is computed once, however often f reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _counted(original, available) -> Column:
    """array<struct<tok, c, has>>: the distinct words of a text, how often each stands there, whether available contains it.

    No word has white space, so it is looked for in the distinct words of available, first as one of them. A word that
    available lacks is put among the sorted words once more with a zero byte after it: no other string lies between."""
    lacks = lambda x: x.endswith("\0")  # noqa: E731 - a significant word ends with a letter or number

    def marked(r):
        seen = F.struct(F.transform(r["v"], tx.trimmed).alias("whole"), F.array_join(F.filter(r["v"], lambda v: F.octet_length(v) > tx.MIN_TOKEN), " ").alias("longer"))
        lost = lambda s: F.filter(F.array_except(r["w"], s["whole"]), lambda x: ~s["longer"].contains(x))
        return _let(seen, lambda s: F.sort_array(F.concat(r["w"], F.transform(lost(s), lambda x: F.concat(x, F.lit("\0"))))))

    def runs(w):
        begins = F.filter(F.transform(w, lambda x, i: F.when(~lacks(x) & ((i == 0) | (x != F.get(w, i - 1))), i)), lambda i: i.isNotNull())

        def one(at, i, j):
            end = F.coalesce(F.get(at, j + 1), F.size(w))
            lost = lacks(F.get(w, end - 1))
            return F.struct(F.get(w, i).alias("tok"), (end - i - lost.cast("int")).cast("long").alias("c"), (~lost).alias("has"))

        return _let(begins, lambda at: F.transform(at, lambda i, j: one(at, i, j)))

    long = F.filter(F.array_distinct(tx.words(available)), lambda v: F.octet_length(v) >= tx.MIN_TOKEN)
    both = F.struct(tx.significant(original).alias("w"), F.coalesce(long, F.array().cast("array<string>")).alias("v"))
    return _let(_let(both, marked), runs)


def richness(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per pair (original, available): distinct words, those still contained, and their share weighted by rarity.

    A pair is counted inside its row, so no text and no word is exchanged. Pairs under one key count as one text, and
    give a row each: only their words are exchanged, once the keys' counts have shown that there are any. A pair
    without a key has no words."""
    known = F.lit(True)
    for k in keys:
        known &= F.col(k).isNotNull()

    def weighed(words):
        n = F.aggregate(words, F.lit(0).cast("long"), lambda acc, x: acc + x["c"])

        def totals(n):
            start = F.struct(F.lit(0).cast("long").alias("atoms"), F.lit(0).cast("long").alias("kept"), F.lit(0.0).alias("t"), F.lit(0.0).alias("k"))

            def add(acc, x):
                w = -F.log2(x["c"] / n)
                return F.struct((acc["atoms"] + 1).alias("atoms"), (acc["kept"] + x["has"].cast("long")).alias("kept"), (acc["t"] + w).alias("t"), (acc["k"] + F.when(x["has"], w).otherwise(0.0)).alias("k"))

            return F.aggregate(words, start, add)

        return _let(n, totals)

    def finished(df, s):
        share = F.when(F.col(f"{s}t") > 0, F.col(f"{s}k") / F.col(f"{s}t")).otherwise(1.0)
        return df.select(*keys, F.coalesce(f"{s}atoms", F.lit(0)).alias("atoms"), F.coalesce(f"{s}kept", F.lit(0)).alias("kept"), F.round(share, 6).alias("retained"))

    here = pairs.select(*keys, F.when(known, _let(_counted(F.col("original"), F.col("available")), weighed)).alias("s"))
    repeated = pairs.where(known).groupBy(*keys).agg(F.count("*").alias("m")).where("m > 1")
    if not (n := repeated.count()):
        return finished(here, "s.")
    single = here.groupBy(*keys).agg(F.count("*").alias("m"), F.first("s").alias("s")).where(known & (F.col("m") == 1))
    few = F.broadcast(repeated.select(*keys)) if n <= FEW_KEYS else repeated.select(*keys)
    words = pairs.select(*keys, _counted(F.col("original"), F.col("available")).alias("words")).join(few, keys).select(*keys, F.inline_outer("words")).where("tok is not null")
    counts = words.groupBy(*keys, "tok").agg(F.sum("c").alias("c"), F.bool_or("has").alias("has"))
    # the words' total is known only at the end, so that no sum needs a second exchange of words
    lost = ~F.col("has")
    bits = F.log2("c")
    sums = counts.groupBy(*keys).agg(F.count("*").alias("atoms"), F.count_if("has").alias("kept"), F.log2(F.sum("c")).alias("n"), F.sum(bits).alias("all"), F.sum(F.when(lost, 0.0).otherwise(bits)).alias("held"))
    merged = sums.select(*keys, "atoms", "kept", F.expr("atoms * n - `all`").alias("t"), F.expr("kept * n - held").alias("k"))
    rows = repeated.join(merged, keys, "left").withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
    return finished(here.where(~known), "s.").unionByName(finished(single, "s.")).unionByName(finished(rows, ""))


def by_class(outcomes: DataFrame) -> DataFrame:
    """tally() of the classes alone, with place: from 1, the class with most raw first, then by name. Classes are few."""
    rows = tally(outcomes).where("class is not null")
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("raw"), "class")))
