"""Turn windows, token joins, reopen evaluation, relevance, set operations over the stand-ins."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from traceloom.functions import text as tx
from traceloom.operators import relevance as rel
from traceloom.operators import reopen
from traceloom.plans import adapters as ad
from traceloom.plans.registry import query
from traceloom.plans.text_queries import sig

T = ad.TURNS
_TOK = f"{T}, tok AS (SELECT DISTINCT trace_id, turn_index, role, unnest({sig('effective')}) AS tok FROM turns)"


@query("w_turn_index", f"WITH {T} SELECT trace_id, turn_index, row_number() OVER (PARTITION BY trace_id ORDER BY turn_index) - 1 AS position FROM turns")
def _(spark, d):
    w = Window.partitionBy("trace_id").orderBy("turn_index")
    return ad.turns(spark, d).select("trace_id", "turn_index", (F.row_number().over(w) - 1).cast("long").alias("position"))


@query("w_first_seen", f"WITH {_TOK} SELECT trace_id, tok, min(turn_index) AS first_turn FROM tok GROUP BY ALL")
def _(spark, d):
    return reopen.first_seen(reopen.tokens(ad.turns(spark, d)))


_CTX = "cx AS (SELECT *, CASE WHEN role = 'assistant' AND turn_index % 4 <> 3 THEN strlen(effective) END AS context_tokens FROM turns)"


def _with_context(spark, d):
    return ad.turns(spark, d).withColumn("context_tokens", F.when((F.col("role") == "assistant") & (F.col("turn_index") % 4 != 3), F.octet_length("effective").cast("long")))


@query("w_latest_prompt", f"WITH {T} SELECT trace_id, turn_index, md5(coalesce(last_value(CASE WHEN role = 'user' AND trim(effective) <> '' THEN effective END IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '')) AS prompt FROM turns")
def _(spark, d):
    return reopen.turn_context(_with_context(spark, d)).select("trace_id", "turn_index", F.md5(F.col("prompt").cast("binary")).alias("prompt"))


@query("w_assistant_after", f"WITH {T} SELECT trace_id, turn_index, count(*) FILTER (role = 'assistant') OVER (PARTITION BY trace_id ORDER BY turn_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS turns_after FROM turns")
def _(spark, d):
    return reopen.turn_context(_with_context(spark, d)).select("trace_id", "turn_index", "turns_after")


@query("w_next_context", f"WITH {T}, {_CTX} SELECT trace_id, turn_index, coalesce(first_value(context_tokens IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY turn_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS next_context FROM cx")
def _(spark, d):
    return reopen.turn_context(_with_context(spark, d)).select("trace_id", "turn_index", "next_context")


@query("j_ref_after", f"WITH {_TOK} SELECT DISTINCT a.trace_id, a.turn_index, a.tok FROM tok a JOIN tok b ON a.trace_id = b.trace_id AND a.tok = b.tok AND b.role = 'assistant' AND b.turn_index > a.turn_index")
def _(spark, d):
    return reopen.referenced_after(reopen.tokens(ad.turns(spark, d)))


_NEEDED = """needed AS (SELECT DISTINCT a.trace_id, a.turn_index, a.tok FROM tok a JOIN tok u ON u.trace_id = a.trace_id AND u.tok = a.tok AND u.role = 'assistant' AND u.turn_index > a.turn_index
 WHERE NOT EXISTS (SELECT 1 FROM tok s WHERE s.trace_id = a.trace_id AND s.tok = a.tok AND s.role <> 'assistant' AND s.turn_index > a.turn_index AND s.turn_index <= u.turn_index))"""


@query("j_needed", f"WITH {_TOK}, {_NEEDED} SELECT * FROM needed")
def _(spark, d):
    return reopen.needed(reopen.tokens(ad.turns(spark, d)))


_BLOCKS = "bl AS (SELECT trace_id, turn_index, 0 AS block, effective AS body, left(effective, 40) AS preview FROM turns WHERE role <> 'assistant')"
_HIDDEN = f"hid AS (SELECT trace_id, turn_index, block, unnest(list_filter(list_filter(b, lambda v, i: list_position(b, v) = i), lambda v: NOT list_contains(p, v))[1:400]) AS tok FROM (SELECT *, {sig('body')} AS b, {sig('preview')} AS p FROM bl))"
_FIRST = "fst AS (SELECT trace_id, tok, min(turn_index) AS first_turn FROM tok GROUP BY ALL)"


def _blocks(spark, d):
    return ad.turns(spark, d).where("role <> 'assistant'").select("trace_id", "turn_index", F.lit(0).alias("block"), F.col("effective").alias("body"), F.substring("effective", 1, 40).alias("preview"))


@query("p_residual", f"WITH {T}, {_BLOCKS}, {_HIDDEN} SELECT trace_id, turn_index, count(*) AS hidden FROM hid GROUP BY ALL")
def _(spark, d):
    return reopen.hidden(_blocks(spark, d)).groupBy("trace_id", "turn_index").agg(F.count("*").alias("hidden"))


_REOPENED = f"""{_TOK}, {_BLOCKS}, {_HIDDEN}, {_FIRST}, {_NEEDED}, rp AS (SELECT h.trace_id, h.turn_index, h.block, bool_or(n.tok IS NOT NULL AND f.first_turn = h.turn_index) AS reopened
 FROM hid h LEFT JOIN needed n ON n.trace_id = h.trace_id AND n.turn_index = h.turn_index AND n.tok = h.tok JOIN fst f ON f.trace_id = h.trace_id AND f.tok = h.tok GROUP BY ALL)"""


@query("j_reopened", f"WITH {_REOPENED} SELECT * FROM rp")
def _(spark, d):
    return reopen.reopened(_blocks(spark, d), ad.turns(spark, d))


@query("a_reopen_rate", f"""WITH {_TOK}, {_BLOCKS}, {_HIDDEN}, {_FIRST}, ra AS (SELECT DISTINCT a.trace_id, a.turn_index, a.tok FROM tok a JOIN tok b ON a.trace_id = b.trace_id AND a.tok = b.tok AND b.role = 'assistant' AND b.turn_index > a.turn_index),
rp AS (SELECT h.trace_id, h.turn_index, bool_or(n.tok IS NOT NULL AND f.first_turn = h.turn_index) AS reopened FROM hid h LEFT JOIN ra n ON n.trace_id = h.trace_id AND n.turn_index = h.turn_index AND n.tok = h.tok JOIN fst f ON f.trace_id = h.trace_id AND f.tok = h.tok GROUP BY ALL)
SELECT 'other' AS shape, count(*) AS offloads, count(*) FILTER (reopened) AS reopens, count(*) FILTER (reopened) / count(*) AS rate FROM rp""")
def _(spark, d):
    return reopen.reopen_rate(_blocks(spark, d), ad.turns(spark, d))


#: Outcomes: an event is a block; its type is the class.
_OUT = "oc AS (SELECT event_type AS class, CASE event_id % 3 WHEN 0 THEN 'offload' WHEN 1 THEN 'inline' ELSE 'verbatim' END AS outcome, CAST(round(value * 100) AS BIGINT) AS raw, CAST(round(value * 100) AS BIGINT) // (1 + event_id % 3) AS sent, event_id % 3 = 0 AND event_id % 7 = 0 AS reopened FROM events)"


def outcomes(spark, d):
    e = ad.table(spark, d, "events")
    i, raw = F.col("event_id"), F.round(F.col("value") * 100).cast("long")
    return e.select(F.col("event_type").alias("class"), F.when(i % 3 == 0, "offload").when(i % 3 == 1, "inline").otherwise("verbatim").alias("outcome"), raw.alias("raw"), F.expr("cast(round(value * 100) as bigint) div (1 + event_id % 3)").alias("sent"), ((i % 3 == 0) & (i % 7 == 0)).alias("reopened"))


@query("a_eval", f"""WITH {_OUT}, t AS (SELECT class, count(*) AS blocks, CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(sent) AS BIGINT) AS sent, CAST(sum(CASE WHEN reopened THEN raw ELSE 0 END) AS BIGINT) AS back, count(*) FILTER (outcome = 'offload') AS offloads, count(*) FILTER (outcome = 'offload' AND reopened) AS reopens FROM oc GROUP BY ROLLUP (class))
SELECT *, raw - sent - back AS net, round(CASE WHEN raw > 0 THEN (raw - sent - back) / raw ELSE 0 END, 6) AS net_ratio, round(CASE WHEN offloads > 0 THEN reopens / offloads ELSE 0 END, 6) AS reopen_rate FROM t""")
def _(spark, d):
    return reopen.tally(outcomes(spark, d))


_BAND = "CASE WHEN raw < 500 THEN '<500' WHEN raw < 2000 THEN '<2k' WHEN raw < 8000 THEN '<8k' ELSE '8k+' END"
_POLICY = f"""{_OUT}, off AS (SELECT class, {_BAND} AS band, reopened FROM oc WHERE outcome = 'offload'), ru AS (SELECT class, band, count(*) AS n, (count(*) FILTER (reopened) + 1) / (count(*) + 2) AS rate FROM off GROUP BY ROLLUP (class, band)),
pol AS (SELECT * FROM ru WHERE class IS NULL OR (n >= 30 AND class IN (SELECT class FROM ru WHERE band IS NULL AND class IS NOT NULL AND n >= 30)))"""


@query("a_policy_learn", f"WITH {_POLICY} SELECT class, band, n, rate FROM pol")
def _(spark, d):
    return reopen.learn(outcomes(spark, d), 30)


@query("j_policy", f"""WITH {_POLICY}, b AS (SELECT class, raw, {_BAND} AS band FROM oc), r AS (SELECT b.class, b.raw, coalesce(x.rate, c.rate, (SELECT rate FROM pol WHERE class IS NULL)) AS predicted FROM b LEFT JOIN pol x ON x.class = b.class AND x.band = b.band LEFT JOIN pol c ON c.class = b.class AND c.band IS NULL)
SELECT class, count(*) AS blocks, round(sum(predicted), 6) AS predicted, count(*) FILTER (predicted < 0.2) AS allowed FROM r GROUP BY 1""")
def _(spark, d):
    rows = outcomes(spark, d)
    got = reopen.predict(rows, reopen.learn(rows, 30), 0.2)
    return got.groupBy("class").agg(F.count("*").alias("blocks"), F.round(F.sum("predicted"), 6).alias("predicted"), F.count_if("allows_offload").alias("allowed"))


@query("a_cache_savings", """WITH b AS (SELECT strlen(text) AS before, strlen(left(text, 50)) AS after, turn, count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations WHERE role <> 'assistant')
SELECT count(*) AS blocks, CAST(sum(before) AS BIGINT) AS original_tokens, CAST(sum(after) AS BIGINT) AS compressed_tokens, round(sum((before - after) * CAST(3.0 AS DOUBLE) / 1e6 * (1 + turns - turn - 1)), 6) AS naive_usd, round(sum((before - after) * (CAST(3.0 AS DOUBLE) + CAST(0.3 AS DOUBLE) * (turns - turn - 1)) / 1e6), 6) AS cache_adjusted_usd FROM b WHERE after < before""")
def _(spark, d):
    c = ad.table(spark, d, "conversations").where("role <> 'assistant'")
    rows = c.select(F.octet_length("text").cast("long").alias("before"), F.octet_length(F.substring("text", 1, 50)).cast("long").alias("after"), "turn", F.count("*").over(Window.partitionBy("conv_id")).alias("turns"))
    return reopen.cache_savings(rows, 3.0, 0.3)


@query("a_richness", f"""WITH {ad.PAIRS}, w AS (SELECT trace_id, turn_index, effective, unnest({sig('original')}) AS tok FROM pairs), c AS (SELECT trace_id, turn_index, tok, count(*) AS c, bool_or(contains(effective, tok)) AS has FROM w GROUP BY ALL), n AS (SELECT trace_id, turn_index, count(*) AS n FROM w GROUP BY ALL),
s AS (SELECT trace_id, turn_index, count(*) AS atoms, count(*) FILTER (has) AS kept, sum(-log2(c / n)) AS t, coalesce(sum(-log2(c / n)) FILTER (has), 0) AS k FROM c JOIN n USING (trace_id, turn_index) GROUP BY ALL)
SELECT p.trace_id, p.turn_index, coalesce(atoms, 0) AS atoms, coalesce(kept, 0) AS kept, round(CASE WHEN t > 0 THEN k / t ELSE 1 END, 6) AS retained FROM pairs p LEFT JOIN s USING (trace_id, turn_index)""")
def _(spark, d):
    return reopen.richness(ad.pairs(spark, d).withColumnRenamed("effective", "available"), ["trace_id", "turn_index"])


@query("w_occurrence", "SELECT event_id, row_number() OVER (PARTITION BY props ORDER BY event_id) - 1 AS occurrence FROM events")
def _(spark, d):
    return ad.table(spark, d, "events").select("event_id", (F.row_number().over(Window.partitionBy("props").orderBy("event_id")) - 1).cast("long").alias("occurrence"))


@query("w_parity_split", "SELECT conv_id, CASE WHEN row_number() OVER (ORDER BY conv_id) % 2 = 0 THEN 'train' ELSE 'hold-out' END AS part FROM (SELECT DISTINCT conv_id FROM conversations)")
def _(spark, d):
    ids = ad.table(spark, d, "conversations").select("conv_id").distinct()
    # numbers over a total order, by ranges whose sizes are counted first
    b = ids.withColumn("b", F.floor(F.col("conv_id") / 100_000))
    base = b.groupBy("b").count().select("b", F.coalesce(F.sum("count").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    n = F.row_number().over(Window.partitionBy("b").orderBy("conv_id")) + F.col("base")
    return b.join(base, "b").select("conv_id", F.when(n % 2 == 0, "train").otherwise("hold-out").alias("part"))


@query("w_zones", f"WITH {T} SELECT trace_id, turn_index, CASE WHEN coalesce(sum(strlen(effective)) OVER (PARTITION BY trace_id ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 2000 THEN 'frozen' ELSE 'suffix' END AS zone FROM turns")
def _(spark, d):
    w = Window.partitionBy("trace_id").orderBy("turn_index").rowsBetween(Window.unboundedPreceding, -1)
    return ad.turns(spark, d).select("trace_id", "turn_index", F.when(F.coalesce(F.sum(F.octet_length("effective")).over(w), F.lit(0)) < 2000, "frozen").otherwise("suffix").alias("zone"))


@query("p_prefix_stable", "SELECT c.conv_id, min(c.turn) AS diverges FROM conversations c LEFT JOIN conversations n ON n.conv_id = c.conv_id + 1 AND n.turn = c.turn WHERE n.text IS DISTINCT FROM c.text GROUP BY 1")
def _(spark, d):
    c = ad.table(spark, d, "conversations").select("conv_id", "turn", "text")
    n = c.select((F.col("conv_id") - 1).alias("conv_id"), "turn", F.col("text").alias("now"))
    return c.join(n, ["conv_id", "turn"], "left").where(~F.col("text").eqNullSafe(F.col("now"))).groupBy("conv_id").agg(F.min("turn").alias("diverges"))


@query("w_rle", "WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events) SELECT user_id, event_type, min(event_id) AS first, count(*) AS run FROM r GROUP BY user_id, event_type, g")
def _(spark, d):
    e = ad.table(spark, d, "events")
    a, b = Window.partitionBy("user_id").orderBy("event_id"), Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return e.withColumn("g", F.row_number().over(a) - F.row_number().over(b)).groupBy("user_id", "event_type", "g").agg(F.min("event_id").alias("first"), F.count("*").alias("run")).drop("g")


#: Retrieval: benchmark items are queries over the documents of one source.
_TERMS = "list_transform(list_filter(regexp_split_to_array({t}, '[^\\p{L}\\p{N}]+'), lambda w: strlen(w) >= 3), lambda w: lower(w))"
_RET = f"""qs AS (SELECT item_id AS block, text AS query, 'src' || (item_id % 20) AS source FROM benchmark), rs AS (SELECT q.block, d.doc_id AS row, {_TERMS.replace('{t}', 'd.text')} AS w FROM qs q JOIN documents d ON d.source = q.source),
st AS (SELECT block, count(*) AS n, greatest(avg(len(w)), 1.0) AS al FROM rs GROUP BY 1), tf AS (SELECT block, row, len(w) AS l, unnest(w) AS term FROM rs), tc AS (SELECT block, row, l, term, count(*) AS tf FROM tf GROUP BY ALL),
qt AS (SELECT DISTINCT block, unnest({_TERMS.replace('{t}', 'query')}) AS term FROM qs), dfs AS (SELECT block, term, count(*) AS df FROM tc JOIN qt USING (block, term) GROUP BY ALL),
bm AS (SELECT block, row, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * l / al))) AS score FROM tc JOIN qt USING (block, term) JOIN dfs USING (block, term) JOIN st USING (block) GROUP BY ALL)"""


def retrieval(spark, d):
    q = ad.table(spark, d, "benchmark").select(F.col("item_id").alias("block"), F.col("text").alias("query"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("collection"))
    rows = ad.table(spark, d, "documents").select(F.col("source").alias("collection"), F.col("doc_id").alias("row"), "text")
    return rows.join(q.select("collection").distinct(), "collection"), q


@query("f_bm25", f"WITH {_RET} SELECT block, row, round(score, 6) AS score FROM bm")
def _(spark, d):
    return rel.bm25(*retrieval(spark, d)).withColumn("score", F.round("score", 6))


@query("t_relevant", f"WITH {_RET}, b AS (SELECT block, row, round(score, 9) AS score FROM bm), t AS (SELECT *, max(score) OVER (PARTITION BY block) AS top FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY score DESC, row) AS r FROM t WHERE top > 0 AND score >= top * 0.15) SELECT block, row FROM r WHERE r <= 24")
def _(spark, d):
    return rel.select(rel.bm25(*retrieval(spark, d)).withColumn("score", F.round("score", 9)), 24).select("block", "row")


@query("a_rank_metrics", f"""WITH {_RET}, b AS (SELECT block, row, round(score, 9) AS score FROM bm), g AS (SELECT block, row FROM b WHERE row % 5 = 0), r AS (SELECT b.block, b.row, row_number() OVER (PARTITION BY b.block ORDER BY score DESC, b.row) AS r, g.row IS NOT NULL AS good FROM b LEFT JOIN g ON g.block = b.block AND g.row = b.row),
p AS (SELECT block, min(r) FILTER (good) AS first, count(*) FILTER (good AND r <= 1) AS one, count(*) FILTER (good AND r <= 3) AS three, count(*) FILTER (good) AS every FROM r GROUP BY 1)
SELECT count(*) AS queries, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(one), 6) AS p1, round(avg(three / 3), 6) AS p3, round(avg(CASE WHEN every > 0 THEN three / every ELSE 0 END), 6) AS r3 FROM p""")
def _(spark, d):
    scores = rel.bm25(*retrieval(spark, d)).withColumn("score", F.round("score", 9))
    return rel.rank_metrics(scores, scores.where("row % 5 = 0").select("block", "row"))


@query("f_rank")
def _(spark, d):
    return rel.rank(*retrieval(spark, d)).withColumn("score", F.round("score", 6))


_TRI = "list_distinct(flatten(list_transform(list_filter({w}, lambda x: length(x) >= 3), lambda x: list_transform(range(1, length(x) - 1), lambda i: substring(x, i, 3)))))"


@query("f_trigrams", f"SELECT item_id, len({_TRI.replace('{w}', _TERMS.replace('{t}', 'text'))}) AS n FROM benchmark")
def _(spark, d):
    return ad.table(spark, d, "benchmark").select("item_id", F.size(tx.trigrams(tx.terms("text"))).cast("long").alias("n"))


@query("f_cosine", "SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def _(spark, d):
    e = ad.table(spark, d, "embeddings")
    q = F.array(*map(F.lit, e.where("vec_id = 0").first()["embedding"]))  # one vector
    return e.select("vec_id", F.round(rel.cosine("embedding", q), 6).alias("similarity"))


@query("s_union", "SELECT 'documents' AS src, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages")
def _(spark, d):
    t = lambda n, c: ad.table(spark, d, n).select(F.lit(n).alias("src"), F.col(c).alias("text"))
    return t("documents", "text").unionByName(t("pages", "html")).groupBy("src").agg(F.count("*").alias("n"))


@query("s_union_schema", "SELECT doc_id AS id, lang, NULL AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages")
def _(spark, d):
    return ad.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang").unionByName(ad.table(spark, d, "pages").select(F.col("page_id").alias("id"), "url"), allowMissingColumns=True)


@query("s_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, d):
    return ad.table(spark, d, "events").select("user_id", "event_type").dropDuplicates()


@query("s_except", "SELECT source, text FROM documents EXCEPT ALL SELECT source, text FROM documents WHERE doc_id % 2 = 0")
def _(spark, d):
    t = ad.table(spark, d, "documents").select("source", "text", "doc_id")
    return t.drop("doc_id").exceptAll(t.where("doc_id % 2 = 0").drop("doc_id"))


@query("s_intersect", "SELECT text FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 2 = 1")
def _(spark, d):
    t = ad.table(spark, d, "documents")
    return t.where("doc_id % 2 = 0").select("text").intersect(t.where("doc_id % 2 = 1").select("text"))


@query("s_multiset_eq", "SELECT (SELECT count(*) FROM (SELECT props FROM events EXCEPT ALL SELECT props FROM events WHERE event_id >= 0)) = 0 AS same")
def _(spark, d):
    from traceloom.operators.proof import same_rows

    e = ad.table(spark, d, "events").select("props", "event_id")
    return same_rows(e.select("props"), e.where("event_id >= 0").select("props"))
