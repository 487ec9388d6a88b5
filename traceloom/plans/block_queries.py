"""Queries over JSON and text blocks: canonical text, proofs, codecs, previews, redaction, commands, streams."""

import tempfile

import pandas as pd
from pyspark.sql import functions as F

from traceloom.functions import commands, previews, redact
from traceloom.functions import jsontext as js
from traceloom.functions import text as tx
from traceloom.operators import optimize, proof
from traceloom.plans import adapters as ad
from traceloom.plans.registry import query
from traceloom.plans.session_queries import retrieval
from traceloom.streaming import events as st


def _udf(f, type_="string"):
    @F.pandas_udf(type_)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return run


def json_blocks(spark, d):
    """A user's events as a JSON array of records, in order."""
    e = ad.table(spark, d, "events")
    rec = F.struct("event_id", "event_type", "value", "props")
    return e.groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_list(rec))).alias("raw"))


JSON_BLOCKS = """jb AS (SELECT user_id, event_id, event_type, props FROM events)"""


@query("f_canonicalize", """WITH o AS (SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","n":{"a":' || event_id % 7 || ',"b":[]}}' AS canonical FROM events) SELECT * FROM o""")
def _(spark, d):
    raw = F.concat(F.lit('{ "n" : {"b": [ ], "a":'), F.col("event_id") % 7, F.lit('}, "event_type": "'), "event_type", F.lit('", "event_id": '), "event_id", F.lit("}"))
    canon = _udf(lambda x: js.canonical(js.parse(x)))
    return ad.table(spark, d, "events").select("event_id", canon(raw).alias("canonical"))


@query("f_leaves", f"WITH {JSON_BLOCKS} SELECT user_id, count(*) * 8 AS leaves FROM jb GROUP BY 1")
def _(spark, d):
    n = _udf(lambda x: len(js.leaves(js.parse(x))), "long")
    return json_blocks(spark, d).select("user_id", n("raw").alias("leaves"))


@query("p_dup_keys", "SELECT event_id, event_id % 3 = 0 AS duplicate FROM events")
def _(spark, d):
    raw = F.concat(F.lit('{"a":1,"'), F.when(F.col("event_id") % 3 == 0, "a").otherwise("b"), F.lit('":2}'))
    return ad.table(spark, d, "events").select("event_id", _udf(js.has_duplicate_keys, "boolean")(raw).alias("duplicate"))


@query("f_select", "SELECT user_id, min_by(event_type, event_id) AS first_type FROM events GROUP BY 1")
def _(spark, d):
    return json_blocks(spark, d).select("user_id", optimize.selected("raw", F.lit("[0]/event_type")).alias("first_type"))


@query("f_flatten", """SELECT event_id, '{"a.b":' || event_id || ',"c":"' || event_type || '"}' AS flat FROM events""")
def _(spark, d):
    raw = F.concat(F.lit('{"a":{"b":'), "event_id", F.lit('},"c":"'), "event_type", F.lit('"}'))
    return ad.table(spark, d, "events").select("event_id", _udf(lambda x: js.dump(js.flatten(js.parse(x))))(raw).alias("flat"))


@query("f_detect_key", "SELECT DISTINCT user_id, CASE WHEN count(*) OVER (PARTITION BY user_id) >= 1 THEN 'event_id' END AS key FROM events")
def _(spark, d):
    return json_blocks(spark, d).select("user_id", _udf(lambda x: js.unique_field(js.parse(x)))("raw").alias("key"))


@query("a_clmh")
def _(spark, d):
    return proof.fingerprint(ad.table(spark, d, "events"), ["user_id"], ["event_type", "props"])


@query("f_price", "SELECT o_orderkey, CASE WHEN b - a > 0 THEN (b - a) * CAST(3.0 AS DOUBLE) / 1e6 END AS usd FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS b, CAST(floor(o_totalprice) AS BIGINT) % 1000 AS a FROM orders)")
def _(spark, d):
    b = F.floor("o_totalprice").cast("long")
    return ad.table(spark, d, "orders").select("o_orderkey", proof.price(b, b % 1000, 3.0).alias("usd"))


@query("f_count", "SELECT doc_id, strlen(text) AS bytes, CAST(ceil(strlen(text) / 4) AS BIGINT) AS tokens FROM documents")
def _(spark, d):
    return ad.table(spark, d, "documents").select("doc_id", proof.tokens("text").cast("long").alias("bytes"), proof.approx_tokens("text").cast("long").alias("tokens"))


@query("v_preview")
def _(spark, d):
    kinds = _udf(lambda x: previews.preview(x)[0])
    rows = ad.table(spark, d, "documents").select("text").unionByName(ad.table(spark, d, "pages").select(F.col("html").alias("text"))).unionByName(json_blocks(spark, d).select(F.col("raw").alias("text")))
    return rows.select(kinds("text").alias("kind")).groupBy("kind").count()


@query("o_compress")
def _(spark, d):
    blocks = json_blocks(spark, d).select("raw").unionByName(ad.table(spark, d, "pages").select(F.col("html").alias("raw")))
    got = optimize.faithful(optimize.optimize(blocks))
    return got.groupBy("outcome", "codec", "kept_reason").agg(F.count("*").alias("blocks"), F.sum("units").alias("units"), F.sum("sent").alias("sent"), F.bool_and("faithful").alias("faithful"))


@query("o_offload")
def _(spark, d):
    blocks = ad.table(spark, d, "pages").select(F.col("html").alias("raw"))
    got = optimize.optimize(blocks, optimize.Config(offload="always"))
    store = optimize.to_store(got, ad.NOW_MS)
    back = optimize.resolve(store.select("id"), store, ad.NOW_MS + 1)
    return got.groupBy("outcome").agg(F.count("*").alias("blocks")).unionByName(back.where("raw is not null").agg(F.lit("resolved").alias("outcome"), F.count("*").alias("blocks")))


@query("o_relevance_split")
def _(spark, d):
    return optimize.split_by_relevance(*retrieval(spark, d)).groupBy("block", "shown").count()


@query("p_command_class", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Bash:git log' WHEN 1 THEN 'Bash:python3 run.py' WHEN 2 THEN 'Bash:grep |' ELSE 'Read' END AS class FROM events")
def _(spark, d):
    i = F.col("event_id") % 4
    call = F.when(i == 0, 'cd x && git -C /r log -n 3').when(i == 1, "A=1 sudo timeout 5 python3 -u a/run.py").otherwise("/usr/bin/grep -r x . | head")
    return ad.table(spark, d, "events").select("event_id", commands.class_of(F.when(i == 3, "Read").otherwise("Bash"), F.to_json(F.struct(call.alias("command")))).alias("class"))


_RULES = {k: p for k, p in redact.RULES if k in ("openai-key", "github-token", "aws-key", "slack-token", "google-key", "bearer")}


@query("f_redact_counts", " UNION ALL ".join(f"""SELECT '{k}' AS kind, CAST(sum(len(regexp_extract_all(text, '{p.replace("(?i)", "")}'{", 0, 'i'" if "(?i)" in p else ""}))) AS BIGINT) AS hits FROM documents""" for k, p in _RULES.items()))
def _(spark, d):
    docs = ad.table(spark, d, "documents")
    totals = docs.agg(*[F.sum(redact.rule_count("text", k)).alias(k) for k in _RULES])
    return totals.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"`{k}`").alias("hits")) for k in _RULES])).alias("x")).select("x.kind", "x.hits")


@query("f_redact")
def _(spark, d):
    docs = ad.table(spark, d, "documents")
    return docs.select("doc_id", redact.redacted("text").alias("r")).select("doc_id", F.col("r.text").alias("text"), F.map_keys("r.hits").alias("kinds"))


@query("a_redact_report")
def _(spark, d):
    return redact.report(ad.table(spark, d, "documents"), "text")


@query("f_publish_gate")
def _(spark, d):
    return redact.publishable(ad.table(spark, d, "documents"), "text")


@query("st_first_sight", "SELECT seq, first_value(transform) OVER (PARTITION BY tenant ORDER BY seq) AS wire, row_number() OVER (PARTITION BY tenant ORDER BY seq) = 1 AS first_seen FROM (SELECT event_id AS seq, event_type AS transform, CAST(user_id AS VARCHAR) AS tenant FROM events)")
def _(spark, d):
    e = ad.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("wire"))
    return st.freeze_batch(e).select("seq", "wire", "first_seen")


def _stream(spark, d):
    """The events table as a stream, run to its end; what arrives is a table of the results so far."""
    raw = spark.readStream.schema(ad.table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    return raw.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.concat_ws("-", "user_id", "props").alias("cert"), F.lit("").alias("kept_reason"), F.col("event_type").alias("transform"), F.round(F.col("value") * 10).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"), F.lit(0).cast("long").alias("reopened_tokens"), F.col("user_id").cast("string").alias("tenant"))


def drain(df, mode, spark):
    """Runs a stream until its input is used up; its rows, from a table in memory of a name of its own."""
    import uuid

    name = f"s{uuid.uuid4().hex}"
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or tempfile.mkdtemp()
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{base}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query("st_events", "SELECT event_type AS transform, count(*) AS events, CAST(sum(CAST(round(value * 10) AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1")
def _(spark, d):
    return drain(_stream(spark, d).groupBy("transform").agg(F.count("*").alias("events"), F.sum("input_tokens").alias("tokens")), "complete", spark)


@query("st_buckets", "SELECT date_trunc('hour', ts) AS start, count(*) AS events, CAST(sum(CAST(round(value * 10) AS BIGINT)) AS BIGINT) AS saved FROM events GROUP BY 1")
def _(spark, d):
    out = drain(st.windows(st.with_time(_stream(spark, d)), "1 hour"), "complete", spark)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "events", "saved")



@query("p_reconcile", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND n % 7 > n % 5 THEN 'cache_bust' ELSE 'held' END AS verdict FROM (SELECT o_orderkey, o_orderstatus, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders)")
def _(spark, d):
    n = F.floor("o_totalprice").cast("long")
    return ad.table(spark, d, "orders").select("o_orderkey", proof.reconcile(F.when(F.col("o_orderstatus") == "F", "frozen").otherwise("suffix"), n % 7, n % 5).alias("verdict"))


@query("f_affix", "SELECT event_type, 'x-' || event_type || '-' AS prefix, '-' || event_type || '.end' AS suffix FROM (SELECT DISTINCT event_type FROM events)")
def _(spark, d):
    e = ad.table(spark, d, "events").select("event_type", F.concat(F.lit("x-"), "event_type", F.lit("-"), F.col("event_id") * 7919 % 10007, F.lit("-"), "event_type", F.lit(".end")).alias("t"))
    return proof.affix(e, ["event_type"], "t")


@query("j_split_covers", "SELECT true AS same")
def _(spark, d):
    e = ad.table(spark, d, "events").select("event_id", "props")
    return proof.split_covers(e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0"), e)


@query("s_tree_eq", "SELECT page_id, page_id % 5 <> 0 AS equal FROM pages")
def _(spark, d):
    p = ad.table(spark, d, "pages")
    bad = F.when(F.col("page_id") % 5 == 0, "lost").otherwise(F.concat(F.lit("<<offload:"), optimize.content_id(F.col("html")), F.lit(">>")))
    pairs = p.select("page_id", F.lit("html").alias("path"), F.col("html").alias("original"), bad.alias("rewritten")).withColumn("id", tx.marker_id("rewritten"))
    store = p.select(optimize.content_id(F.col("html")).alias("id"), F.col("html").alias("raw")).dropDuplicates(["id"])
    return proof.tree_equal(pairs, store, ["page_id"])


@query("a_context_savings", "SELECT b AS baseline, t AS treatment, greatest(b - t, 0) AS saved FROM (SELECT CAST(sum(strlen(text) // 4) AS BIGINT) AS b, CAST(sum(strlen(left(text, 50)) // 4) AS BIGINT) AS t FROM documents)")
def _(spark, d):
    return proof.context_savings(ad.table(spark, d, "documents").select(F.col("text").alias("baseline"), F.substring("text", 1, 50).alias("treatment")))
