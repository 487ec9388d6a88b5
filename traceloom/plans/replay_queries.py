"""Queries over recorded replays, caches, certificates and classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.functions import text as tx
from traceloom.operators import optimize, reopen, replay
from traceloom.plans import adapters as ad
from traceloom.plans import session_queries
from traceloom.plans.registry import query
from traceloom.plans.request_queries import segments
from traceloom.sources import requests as src


@query("a_replay_stats", """WITH r AS (SELECT event_type AS truth, CASE WHEN event_id % 5 > 0 THEN event_type END AS base, CASE WHEN event_id % 7 > 0 THEN event_type END AS control, CASE WHEN event_id % 11 > 0 THEN event_type ELSE 'other' END AS treat, event_id % 3 AS resolves, event_id % 13 = 0 AS failed, event_id % 100 AS t FROM events)
SELECT count(*) FILTER (NOT failed) AS decisions, count(*) FILTER (failed) AS errors, count(*) FILTER (NOT failed AND base = truth) AS baseline_match, count(*) FILTER (NOT failed AND treat = truth) AS treatment_match,
  count(*) FILTER (NOT failed AND base IS NOT DISTINCT FROM treat) AS same_choice, count(*) FILTER (NOT failed AND base IS NOT DISTINCT FROM control) AS same_baseline, count(*) FILTER (NOT failed AND resolves > 0) AS resolved,
  CAST(sum(3 * t) AS BIGINT) AS input_tokens, CAST(count(*) * 6 AS BIGINT) AS output_tokens FROM r""")
def _(spark, d):
    """An event is a decision with its three replies; each thirteenth has an error in one of them."""
    e, i = ad.table(spark, d, "events"), F.col("event_id")

    def reply(tool, resolves, wrong):
        return F.struct(tool.alias("tool"), resolves.cast("long").alias("resolve_calls"), (i % 100).alias("input_tokens"), F.lit(2).cast("long").alias("output_tokens"), wrong.alias("errored"))

    own, no = F.col("event_type"), F.lit(False)
    rows = e.select(
        own.alias("truth"), reply(F.when(i % 5 > 0, own), F.lit(0), no).alias("baseline"), reply(F.when(i % 7 > 0, own), F.lit(0), no).alias("control"),
        reply(F.when(i % 11 > 0, own).otherwise("other"), i % 3, i % 13 == 0).alias("treatment"),
    )
    return replay.agreement(rows)


@query("o_decisions", """WITH c AS (SELECT conv_id AS trace_id, CAST(turn AS INTEGER) AS turn_index, role, text FROM conversations),
t AS (SELECT trace_id, turn_index, CASE WHEN role = 'assistant' THEN 'Bash' END AS truth, role = 'user' AND text IS NOT NULL AND turn_index % 3 = 2 AS stored, CASE WHEN role = 'user' AND text IS NOT NULL THEN 8 * strlen(text) - 8 * strlen(text) // 4 ELSE 0 END AS saved,
  coalesce(strlen(text), 0) + CASE role WHEN 'assistant' THEN CASE WHEN turn_index % 4 = 1 THEN strlen('{"command":"git log"}') ELSE strlen('{"command":"ls"}') END WHEN 'user' THEN coalesce(8 * strlen(text), strlen('gone')) ELSE 0 END AS n FROM c),
w AS (SELECT *, sum(n) OVER b AS before, sum(saved) OVER b AS less, bool_or(stored) OVER b AS any_stored FROM t WINDOW b AS (PARTITION BY trace_id ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT trace_id, turn_index, truth, CAST(before // 4 AS BIGINT) AS tokens, CAST((before - less) // 4 AS BIGINT) AS sent_tokens FROM w WHERE truth IS NOT NULL AND any_stored""")
def _(spark, d):
    """Each output of a tool came down to a quarter; those of every third turn were stored away."""
    s = segments(spark, d)
    raw = F.octet_length("original")
    done = s.where("kind = 'tool-result' and original is not null").select("trace_id", "turn_index", raw.alias("raw"), F.floor(raw / 4).alias("sent"), F.when(F.col("turn_index") % 3 == 2, "offload").otherwise("inline").alias("outcome"))
    return replay.decisions(s, done)


@query("a_cache_sim", """WITH b AS (SELECT conv_id AS trace_id, turn, repeat('You are a coding agent. ', CAST(1 + turn % 3 AS INTEGER)) || coalesce(text, '') AS body FROM conversations),
l AS (SELECT trace_id, body, coalesce(lag(body) OVER (PARTITION BY trace_id ORDER BY turn), '') AS last FROM b),
s AS (SELECT trace_id, strlen(body) // 4 AS total, strlen(left(body, list_max(list_filter(range(0, least(length(body), length(last)) + 1), lambda k: left(body, k) = left(last, k))))) // 4 AS same FROM l)
SELECT trace_id, count(*) AS turns, CAST(sum(CASE WHEN same >= 8 THEN same ELSE 0 END) AS BIGINT) AS read, CAST(sum(total - CASE WHEN same >= 8 THEN same ELSE 0 END) AS BIGINT) AS created,
  round(CAST(sum(CASE WHEN same >= 8 THEN same ELSE 0 END) AS DOUBLE) * 0.1 + CAST(sum(total - CASE WHEN same >= 8 THEN same ELSE 0 END) AS DOUBLE) * 1.25, 6) AS cost FROM s GROUP BY 1""")
def _(spark, d):
    """A preamble of one to three sentences goes before each turn's text; prefixes of eight tokens are cached."""
    c = ad.table(spark, d, "conversations")
    body = F.concat(F.repeat(F.lit("You are a coding agent. "), (1 + F.col("turn") % 3).cast("int")), F.coalesce("text", F.lit("")))
    return replay.cache_cost(replay.cache_split(c.select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("turn_index"), body.alias("body")), least=8), 0.1, 1.25)


@query("f_certify", """SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}') AS certificate, event_id % 2 = 0 AS verified FROM events""")
def _(spark, d):
    """Wires: the block with other blanks, another block, the right marker, and a marker of another block."""
    i = F.col("event_id")
    block = lambda n: F.concat(F.lit('{ "event_type": "'), "event_type", F.lit('", "event_id": '), n, F.lit("}"))
    rows = ad.table(spark, d, "events").select(i, block(i).alias("raw"), block(i + 1).alias("other"))
    rows = rows.select("event_id", "raw", "other", optimize.certify(F.col("raw")).alias("certificate"), optimize.certify(F.col("other")).alias("wrong"))
    marker = lambda c: F.concat(F.lit("gone <<offload:"), F.substring(c, 1, 16), F.lit(">>"))
    wire = F.when(i % 4 == 0, F.col("raw")).when(i % 4 == 1, F.col("other")).when(i % 4 == 2, marker("certificate")).otherwise(marker("wrong"))
    return rows.withColumn("wire", wire).select("event_id", "certificate", optimize.verified(F.col("wire"), F.col("certificate")).alias("verified"))


@query("p_tenant", "SELECT event_id AS request_id, CASE WHEN event_id % 3 = 0 THEN 'team ' || user_id ELSE '' END AS tenant FROM events")
def _(spark, d):
    """One header names a team, one holds blanks only, and one request has none."""
    i = F.col("event_id") % 3
    said = F.when(i == 0, F.create_map(F.lit("X-Tenant"), F.concat(F.lit("  team "), "user_id", F.lit(" ")))).when(i == 1, F.create_map(F.lit("x-tenant"), F.lit("  "))).otherwise(F.create_map(F.lit("accept"), F.lit("x-tenant")))
    return src.tenant(ad.table(spark, d, "events").select(F.col("event_id").alias("request_id"), said.alias("headers")))


@query("a_dominant", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT doc_id, len(regexp_extract_all(line, '[^\s\x0B]+')) AS n FROM l), k AS (SELECT doc_id, n, count(*) AS c FROM n WHERE n >= 2 GROUP BY 1, 2),
w AS (SELECT doc_id, n FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, n) = 1) SELECT documents.doc_id, CAST(w.n AS INTEGER) AS width FROM documents LEFT JOIN w USING (doc_id)""")
def _(spark, d):
    return ad.table(spark, d, "documents").select("doc_id", tx.dominant_width("text").alias("width"))


@query("t_classes", f"""WITH {session_queries._OUT}, t AS (SELECT class, count(*) AS blocks, CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(sent) AS BIGINT) AS sent FROM oc WHERE class IS NOT NULL GROUP BY 1)
SELECT class, blocks, raw, sent, CAST(row_number() OVER (ORDER BY raw DESC, class) AS INTEGER) AS place FROM t""")
def _(spark, d):
    return reopen.by_class(session_queries.outcomes(spark, d)).select("class", "blocks", "raw", "sent", "place")
