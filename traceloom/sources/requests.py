"""Request bodies of four shapes, read to one table of tool-output blocks with ages, the latest query and exempt ids.

Shapes: `anthropic` (messages[].content[] of type tool_result), `chat` (messages[] of role tool), `responses`
(input[] of type function_call_output), `converse` (messages[].content[].toolResult)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.sources.transcripts import as_text, is_list, result_text

RESOLVER = "resolve"


def _array(path: str, fields: str):
    return F.from_json(F.get_json_object("body", path), f"ARRAY<STRUCT<{fields}>>")


def shape():
    """Of a column body; null where none fits."""
    body = F.col("body")
    has = lambda p: F.get_json_object(body, p).isNotNull()
    return F.when(has("$.input") & ~has("$.messages"), "responses").when(has("$.messages") & (body.contains('"toolResult"') | body.contains('"toolUse"') | has("$.toolConfig")), "converse").when(has("$.messages") & (body.contains('"tool_call_id"') | body.contains('"tool_calls"')), "chat").when(has("$.messages"), "anthropic")


ITEM = "role: STRING, type: STRING, call_id: STRING, name: STRING, output: STRING, content: VARIANT, tool_call_id: STRING, tool_calls: ARRAY<STRUCT<id: STRING, function: STRUCT<name: STRING>>>"
PART = "type: STRING, id: STRING, name: STRING, tool_use_id: STRING, content: VARIANT, toolUse: STRUCT<toolUseId: STRING, name: STRING>, toolResult: STRUCT<toolUseId: STRING, content: STRING>"


def items(requests: DataFrame) -> DataFrame:
    """request_id, shape, pos, role, type, content (variant), call ids and calls of each message or input item."""
    rows = requests.withColumn("shape", shape()).where("shape is not null")
    each = F.when(F.col("shape") == "responses", _array("$.input", ITEM)).otherwise(_array("$.messages", ITEM))
    return rows.select("request_id", "shape", F.posexplode(each).alias("pos", "m")).select("request_id", "shape", "pos", "m.*")


def _parts():
    """The parts of a message with a list of them."""
    content = F.col("content")
    return F.when(is_list(content), F.from_json(as_text(content), f"ARRAY<STRUCT<{PART}>>"))


def _only_text(content):
    return F.coalesce(F.when(is_list(content), F.forall(F.from_json(as_text(content), "ARRAY<STRUCT<type: STRING>>"), lambda x: x["type"] == "text")).otherwise(F.lit(True)), F.lit(False))


def blocks(requests: DataFrame) -> DataFrame:
    """request_id, shape, pos, sub, tool_use_id, raw, age (how many model turns follow) of each tool output, and plain:
    whether text is all that it has, so that another text can stand for it."""
    rows = items(requests)
    model_turn = F.when(F.col("shape") == "responses", F.coalesce((F.col("role") == "assistant") | (F.col("type") == "function_call"), F.lit(False))).otherwise(F.coalesce(F.col("role") == "assistant", F.lit(False)))
    after = Window.partitionBy("request_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("age", F.coalesce(F.sum(model_turn.cast("long")).over(after), F.lit(0)))

    told = lambda sub, id_, raw, plain: F.struct(sub.cast("int").alias("sub"), id_.alias("tool_use_id"), raw.alias("raw"), plain.alias("plain"))
    texts = lambda p: F.from_json(p["toolResult"]["content"], "ARRAY<STRUCT<text: STRING>>")
    parts = F.transform(_parts(), lambda p, i: F.struct(i.alias("i"), p.alias("p")))
    a = F.transform(F.filter(parts, lambda x: x["p"]["type"] == "tool_result"), lambda x: told(x["i"], x["p"]["tool_use_id"], result_text(x["p"]["content"]), _only_text(x["p"]["content"])))
    joined = lambda p: F.coalesce(F.array_join(F.transform(texts(p), lambda t: F.coalesce(t["text"], F.lit(""))), "\n"), F.lit(""))
    c = F.transform(F.filter(parts, lambda x: x["p"]["toolResult"].isNotNull()), lambda x: told(x["i"], x["p"]["toolResult"]["toolUseId"], joined(x["p"]), F.coalesce(F.forall(texts(x["p"]), lambda t: t["text"].isNotNull()), F.lit(False))))
    t = F.array(told(F.lit(0), F.col("tool_call_id"), result_text(F.col("content")), _only_text(F.col("content"))))
    r = F.array(told(F.lit(0), F.col("call_id"), F.coalesce("output", F.lit("")), F.lit(True)))
    found = F.when(F.col("shape") == "anthropic", a).when(F.col("shape") == "converse", c).when((F.col("shape") == "chat") & (F.col("role") == "tool"), t).when((F.col("shape") == "responses") & (F.col("type") == "function_call_output"), r)
    return rows.select("request_id", "shape", "pos", "age", F.explode(found).alias("b")).select("request_id", "shape", "pos", "b.sub", "b.tool_use_id", "b.raw", "age", "b.plain")


def calls(requests: DataFrame) -> DataFrame:
    """request_id, tool_use_id and name of the tool calls that a request holds."""
    told = lambda id_, name: F.struct(id_.alias("tool_use_id"), name.alias("name"))
    a = F.transform(F.filter(_parts(), lambda p: p["type"] == "tool_use"), lambda p: told(p["id"], p["name"]))
    c = F.transform(F.filter(_parts(), lambda p: p["toolUse"].isNotNull()), lambda p: told(p["toolUse"]["toolUseId"], p["toolUse"]["name"]))
    t = F.transform("tool_calls", lambda x: told(x["id"], x["function"]["name"]))
    r = F.array(told(F.col("call_id"), F.col("name")))
    found = F.when(F.col("shape") == "anthropic", a).when(F.col("shape") == "converse", c).when(F.col("shape") == "chat", t).when((F.col("shape") == "responses") & (F.col("type") == "function_call"), r)
    return items(requests).select("request_id", F.explode(found).alias("c")).select("request_id", "c.*")


def latest_query(requests: DataFrame) -> DataFrame:
    """request_id and the newest user text that isn't blank."""
    rows = items(requests).where("role = 'user'")
    content = F.col("content")
    parts = F.transform(F.from_json(as_text(content), "ARRAY<STRUCT<text: STRING>>"), lambda x: x["text"])
    text = F.when(is_list(content), F.get(F.filter(parts, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), 0)).otherwise(as_text(content))
    told = rows.withColumn("text", text).where("trim(coalesce(text, '')) <> ''")
    return told.groupBy("request_id").agg(F.max_by("text", "pos").alias("query"))


def resolver(requests: DataFrame, name: str = RESOLVER) -> DataFrame:
    """request_id and the first tool whose name or description has the resolver's name."""
    tools = F.from_json(F.get_json_object("body", "$.tools"), "ARRAY<STRUCT<name: STRING, description: STRING, function: STRUCT<name: STRING, description: STRING>>>")
    named = F.transform(tools, lambda t: F.struct(F.coalesce(t["name"], t["function"]["name"]).alias("name"), F.coalesce(t["description"], t["function"]["description"], F.lit("")).alias("description")))
    hit = F.element_at(F.filter(named, lambda t: t["name"].contains(name) | t["description"].contains(name)), 1)["name"]
    return requests.select("request_id", hit.alias("resolver")).where("resolver is not null")


def without_exempt(block_rows: DataFrame, calls: DataFrame, resolvers: DataFrame) -> DataFrame:
    """Blocks but for answers to the resolver itself. calls: request_id, tool_use_id, name."""
    own = calls.join(resolvers, ["request_id"]).where("name = resolver").select("request_id", "tool_use_id")
    return block_rows.join(own, ["request_id", "tool_use_id"], "left_anti")


#: label, header, needle: custom rules go first, in order; then these.
PLATFORM_RULES = [("claude", "user-agent", "claude"), ("openai", "authorization", "sk-"), ("cursor", "user-agent", "cursor"), ("bedrock", "host", "bedrock")]


def platform(headers: DataFrame, rules: DataFrame) -> DataFrame:
    """request_id and label of the first rule (n, header, needle, label) that a header of the request contains."""
    long = headers.select("request_id", F.explode("headers").alias("header", "value"))
    hit = long.join(F.broadcast(rules), F.lower(long["header"]) == rules["header"]).where(F.lower("value").contains(F.col("needle")))
    return hit.groupBy("request_id").agg(F.min_by("label", "n").alias("platform"))


def tenant(headers: DataFrame, name: str = "x-tenant") -> DataFrame:
    """request_id and the tenant that the header names; empty without one. Of several spellings the least value counts."""
    said = F.transform(F.map_entries("headers"), lambda e: F.when(F.lower(e["key"]) == name.lower(), F.trim(e["value"])))
    return headers.select("request_id", F.coalesce(F.array_min(F.filter(said, lambda v: v != "")), F.lit("")).alias("tenant"))


def stats(outcomes: DataFrame) -> DataFrame:
    """Per request: blocks rewritten, first seen and kept, tokens before and after, the codecs used."""
    done = F.col("outcome") != "verbatim"
    return outcomes.groupBy("request_id").agg(
        F.count_if(done).alias("rewritten"), F.count_if(F.col("first_seen")).alias("first_seen"), F.count_if(~done).alias("kept"),
        F.sum("units").alias("units"), F.sum("sent").alias("sent"), F.array_sort(F.collect_set(F.when(done, F.col("codec")))).alias("codecs"),
    )
