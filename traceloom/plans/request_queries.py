"""Queries over request bodies and over sessions as a whole. A user's events make a request of one of the four shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.operators import evaluate, optimize, rewrite
from traceloom.plans import adapters as ad
from traceloom.plans.registry import query
from traceloom.sources import requests as src


def requests(spark, d):
    """request_id, body: the user's words, a call of `bash` with the user's events as its output, one of `resolve`
    with an answer, and user_id % 6 more turns of the model. Two of three offer `resolve` as a tool."""
    e = ad.table(spark, d, "events")
    rows = e.groupBy(F.col("user_id").alias("request_id")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "props")))).alias("raw"))
    u = F.col("request_id")
    quoted = F.to_json(F.array("raw"))  # one string, without the brackets around it
    rows = rows.withColumn("q", F.regexp_replace(quoted, r"^\[|\]$", ""))
    ask = F.concat(F.lit('{"role":"user","content":"about user '), u, F.lit('"}'))
    more = F.concat_ws("", F.transform(F.sequence(F.lit(0), u % 6), lambda i: F.when(i > 0, F.lit(',{"role":"assistant","content":"go on"}')).otherwise("")))
    anthropic = F.concat(
        F.lit('{"messages":['), ask, F.lit(',{"role":"assistant","content":[{"type":"tool_use","id":"a","name":"bash","input":{}},{"type":"tool_use","id":"b","name":"resolve","input":{}}]},{"role":"user","content":[{"type":"tool_result","tool_use_id":"a","content":'), "q",
        F.lit('},{"type":"tool_result","tool_use_id":"b","content":"answer"}]}'), more, F.lit("]"))
    chat = F.concat(
        F.lit('{"messages":['), ask, F.lit(',{"role":"assistant","tool_calls":[{"id":"a","function":{"name":"bash"}},{"id":"b","function":{"name":"resolve"}}]},{"role":"tool","tool_call_id":"a","content":'), "q",
        F.lit('},{"role":"tool","tool_call_id":"b","content":"answer"}'), more, F.lit("]"))
    responses = F.concat(
        F.lit('{"input":['), ask, F.lit(',{"type":"function_call","call_id":"a","name":"bash"},{"type":"function_call","call_id":"b","name":"resolve"},{"type":"function_call_output","call_id":"a","output":'), "q",
        F.lit('},{"type":"function_call_output","call_id":"b","output":"answer"}'), more, F.lit("]"))
    converse = F.concat(
        F.lit('{"messages":[{"role":"user","content":[{"text":"about user '), u, F.lit('"}]},{"role":"assistant","content":[{"toolUse":{"toolUseId":"a","name":"bash"}},{"toolUse":{"toolUseId":"b","name":"resolve"}}]},{"role":"user","content":[{"toolResult":{"toolUseId":"a","content":[{"text":'), "q",
        F.lit('}]}},{"toolResult":{"toolUseId":"b","content":[{"text":"answer"}]}}]}'), more, F.lit("]"))
    body = F.when(u % 4 == 0, anthropic).when(u % 4 == 1, chat).when(u % 4 == 2, responses).otherwise(converse)
    tools = F.when(u % 3 > 0, ',"tools":[{"name":"read"},{"name":"resolve"}]}').otherwise("}")
    return rows.select("request_id", F.concat(body, tools).alias("body"))


_REQUESTS = """rq AS (SELECT user_id AS request_id, ['anthropic', 'chat', 'responses', 'converse'][user_id % 4 + 1] AS shape, user_id % 3 > 0 AS has_resolver, user_id % 6 AS age,
  '[' || string_agg('{"event_id":' || event_id || ',"event_type":"' || event_type || '","props":"' || replace(props, '"', '\\"') || '"}', ',' ORDER BY event_id) || ']' AS raw FROM events GROUP BY user_id),
bl AS (SELECT request_id, shape, has_resolver, age, 'a' AS tool_use_id, raw FROM rq UNION ALL SELECT request_id, shape, has_resolver, age, 'b', 'answer' FROM rq)"""


@query("src_request", f"WITH {_REQUESTS} SELECT request_id, shape, tool_use_id, age, sha256(raw) AS raw_sha256 FROM bl")
def _(spark, d):
    return src.blocks(requests(spark, d)).select("request_id", "shape", "tool_use_id", "age", F.sha2(F.col("raw").cast("binary"), 256).alias("raw_sha256"))


@query("p_latest_query", "SELECT DISTINCT user_id AS request_id, 'about user ' || user_id AS query FROM events")
def _(spark, d):
    return src.latest_query(requests(spark, d))


@query("p_resolver", f"WITH {_REQUESTS} SELECT request_id, 'resolve' AS resolver FROM rq WHERE has_resolver")
def _(spark, d):
    return src.resolver(requests(spark, d))


@query("p_exempt", f"WITH {_REQUESTS} SELECT request_id, tool_use_id FROM bl WHERE tool_use_id = 'a' OR NOT has_resolver")
def _(spark, d):
    r = requests(spark, d)
    return src.without_exempt(src.blocks(r), src.calls(r), src.resolver(r)).select("request_id", "tool_use_id")


@query("p_platform", "SELECT event_id AS request_id, CASE WHEN event_id % 4 = 0 THEN event_type WHEN event_id % 4 = 1 THEN 'openai' ELSE 'cursor' END AS platform FROM events WHERE event_id % 4 < 3")
def _(spark, d):
    """A rule of ours for each event type goes before the others."""
    e = ad.table(spark, d, "events")
    kinds = e.select("event_type").distinct().select((-F.crc32("event_type")).alias("n"), F.lit("x-kind").alias("header"), F.col("event_type").alias("needle"), F.col("event_type").alias("label"))
    rules = kinds.unionByName(spark.createDataFrame([(i, h, n, label) for i, (label, h, n) in enumerate(src.PLATFORM_RULES)], "n long, header string, needle string, label string"))
    i = F.col("event_id") % 4
    headers = F.when(i == 0, F.create_map(F.lit("User-Agent"), F.lit("Cursor/1"), F.lit("X-Kind"), F.upper("event_type"))).when(i == 1, F.create_map(F.lit("Authorization"), F.lit("Bearer sk-1"))).when(i == 2, F.create_map(F.lit("user-agent"), F.lit("CURSOR"))).otherwise(F.create_map(F.lit("accept"), F.lit("cursor")))
    return src.platform(e.select(F.col("event_id").alias("request_id"), headers.alias("headers")), rules)


@query("o_rewrite", f"WITH {_REQUESTS} SELECT request_id, tool_use_id, sha256(raw) AS text_sha256, true AS smaller FROM bl")
def _(spark, d):
    """Bodies are rewritten, read again, and their blocks restored from wires and store."""
    r = requests(spark, d)
    done = rewrite.decide(r, optimize.Config(offload="always")).persist()  # read for the bodies and for the store
    out = rewrite.bodies(r, done)
    texts = rewrite.restored(out, optimize.to_store(done, ad.NOW_MS))
    sizes = r.select("request_id", F.octet_length("body").alias("n")).join(out.select("request_id", F.octet_length("body").alias("m")), "request_id")
    return texts.join(sizes, "request_id").select("request_id", "tool_use_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), (F.col("m") <= F.col("n")).alias("smaller"))


@query("st_hold", f"WITH {_REQUESTS} SELECT request_id, tool_use_id, has_resolver AND tool_use_id = 'a' AND age >= 4 AND strlen(raw) >= 2000 AS stored FROM bl WHERE (tool_use_id = 'a' OR NOT has_resolver) AND strlen(raw) NOT BETWEEN 512 AND 1999")
def _(spark, d):
    """Stubs of long blocks go out once four turns of the model follow them."""
    done = rewrite.decide(requests(spark, d), optimize.Config(offload="always"), rewrite.HOLD_TURNS)
    return done.where("units not between 512 and 1999").select("request_id", "tool_use_id", (F.col("outcome") == "offload").alias("stored"))


@query("a_request_stats", f"WITH {_REQUESTS} SELECT request_id, CAST(sum(strlen(raw)) AS BIGINT) AS units, count(*) AS blocks FROM bl WHERE tool_use_id = 'a' OR NOT has_resolver GROUP BY 1")
def _(spark, d):
    s = src.stats(rewrite.decide(requests(spark, d)))
    return s.select("request_id", "units", (F.col("rewritten") + F.col("kept")).alias("blocks"))


def segments(spark, d):
    """Conversations in which the assistant's turn calls a tool, and the next user's turn has its output beside the words."""
    c = ad.table(spark, d, "conversations").select(F.col("conv_id").alias("trace_id"), F.col("turn").cast("int").alias("turn_index"), "role", "text")
    base = ["trace_id", "turn_index", "role"]
    none = F.lit(None).cast("string")
    tokens = F.when(F.col("role") == "assistant", F.col("turn_index") * 10 + 1).cast("long").alias("context_tokens")
    words = c.select(*base, F.lit(0).alias("seg_index"), F.lit("text").alias("kind"), none.alias("tool_name"), none.alias("tool_use_id"), none.alias("original"), F.col("text").alias("effective"), tokens)
    call = c.where("role = 'assistant'").select(*base, F.lit(1), F.lit("tool-call"), F.lit("Bash"), F.concat(F.lit("t"), "turn_index"), none, F.when(F.col("turn_index") % 4 == 1, '{"command":"git log"}').otherwise('{"command":"ls"}'), tokens)
    result = c.where("role = 'user'").select(*base, F.lit(1), F.lit("tool-result"), F.lit("Bash"), F.concat(F.lit("t"), F.col("turn_index") - 1), F.repeat("text", F.lit(8)), F.lit("gone"), tokens)
    return words.union(call).union(result)


@query("o_evaluate", """WITH c AS (SELECT conv_id AS trace_id, CAST(turn AS INTEGER) AS turn_index, role, text FROM conversations),
calls AS (SELECT trace_id, turn_index, CASE WHEN turn_index % 4 = 1 THEN 'Bash:git log' ELSE 'Bash:ls' END AS class FROM c WHERE role = 'assistant'),
after AS (SELECT trace_id, turn_index, coalesce(sum(CAST(role = 'assistant' AS INTEGER)) OVER w, 0) AS turns_after, coalesce(min(CASE WHEN role = 'assistant' THEN turn_index * 10 + 1 END) OVER w, 0) AS context_tokens FROM c WINDOW w AS (PARTITION BY trace_id ORDER BY turn_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT c.trace_id, c.turn_index, coalesce(calls.class, 'Bash:other') AS class, 8 * strlen(c.text) AS raw, CAST(turns_after AS BIGINT) AS turns_after, CAST(context_tokens AS BIGINT) AS context_tokens, true AS faithful
FROM c JOIN after a ON a.trace_id = c.trace_id AND a.turn_index = c.turn_index LEFT JOIN calls ON calls.trace_id = c.trace_id AND calls.turn_index = c.turn_index - 1 WHERE c.role = 'user' AND c.text <> ''""")
def _(spark, d):
    got = evaluate.evaluate(segments(spark, d).persist(), optimize.Config(offload="always"))
    return got.select("trace_id", "turn_index", "class", F.col("raw").cast("long").alias("raw"), "turns_after", "context_tokens", "faithful")
