"""Text expressions, detectors, retention over the page and claim stand-ins."""

from pyspark.sql import functions as F

from traceloom.functions import text as tx
from traceloom.operators import detect, pairing
from traceloom.plans import adapters as ad
from traceloom.plans.registry import query

#: RE2 has no lookbehind: what may not touch a number is doubled first, so that each match can take its own copy.
_NUMS = "list_distinct(list_filter(regexp_extract_all(regexp_replace({t}, '([A-Za-z_.])', '\\1\\1', 'g'), '[A-Za-z_.]?[0-9]+[A-Za-z_]?'), lambda x: regexp_full_match(x, '[0-9]{2,}')))"
_EDGE = "'\"''(),;[]{}<>`'"
_WORDS = "list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> '')"
_TRIMMED = f"list_transform({_WORDS}, lambda w: trim(w, {_EDGE}))"
_ARTS = f"""list_distinct(list_filter(list_transform(list_filter({_TRIMMED}, lambda w: strlen(w) >= 4), lambda w: CASE WHEN contains(w, '/') THEN CASE WHEN contains(string_split(w, ':')[1], '/') AND regexp_matches(string_split(w, ':')[1], '[A-Za-z0-9]') THEN string_split(w, ':')[1] END
 WHEN starts_with(w, 'toolu_') OR starts_with(w, 'req_') OR regexp_full_match(w, '[0-9A-Fa-f]{{12,}}') THEN w END), lambda w: w IS NOT NULL))"""
_SIG = "list_filter(list_transform(regexp_split_to_array({t}, '\\s+'), lambda w: regexp_replace(w, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')), lambda w: strlen(w) >= 6)"


def nums(t):
    return _NUMS.replace('{t}', t)


def arts(t):
    return _ARTS.replace('{t}', t)


def sig(t):
    return _SIG.replace('{t}', t)


@query("p_numbers", f"SELECT page_id, array_to_string(list_sort({nums('html')}), ',') AS numbers FROM pages")
def _(spark, d):
    return ad.table(spark, d, "pages").select("page_id", F.array_join(F.array_sort(tx.numbers("html", None)), ",").alias("numbers"))


@query("p_artifacts", f"SELECT page_id, array_to_string(list_sort({arts('html')}), chr(10)) AS artifacts FROM pages")
def _(spark, d):
    return ad.table(spark, d, "pages").select("page_id", F.array_join(F.array_sort(tx.artifacts("html", None)), "\n").alias("artifacts"))


@query("p_significant", f"SELECT doc_id, len(x) AS n, md5(array_to_string(x, ' ')) AS digest FROM (SELECT doc_id, {sig('text')} AS x FROM documents)")
def _(spark, d):
    return ad.table(spark, d, "documents").select("doc_id", tx.significant("text").alias("x")).select("doc_id", F.size("x").cast("long").alias("n"), F.md5(F.array_join("x", " ").cast("binary")).alias("digest"))


@query("p_size_band", "SELECT CASE WHEN n < 500 THEN '<500' WHEN n < 2000 THEN '<2k' WHEN n < 8000 THEN '<8k' ELSE '8k+' END AS band, count(*) AS blocks FROM (SELECT strlen(text) AS n FROM documents) GROUP BY 1")
def _(spark, d):
    return ad.table(spark, d, "documents").groupBy(tx.size_band(F.octet_length("text")).alias("band")).agg(F.count("*").alias("blocks"))


#: Lines `path:line:content` of ten documents, and a copy with wrong, missing and invented ones.
CLAIMS = """claims AS (SELECT CAST(doc_id // 10 AS BIGINT) AS trace_id, 0 AS turn_index, CAST(doc_id % 3 AS INTEGER) AS seg_index,
 string_agg('src/' || source || '.txt:' || doc_id || ': ' || left(text, 20), chr(10) ORDER BY doc_id) AS original,
 string_agg(CASE WHEN doc_id % 7 = 0 THEN 'src/' || source || '.txt:' || doc_id || ':changed' WHEN doc_id % 11 = 0 THEN 'lib/new.txt:' || doc_id || ':x' ELSE 'src/' || source || '.txt:' || doc_id || ': ' || left(text, 20) END, chr(10) ORDER BY doc_id) AS effective
 FROM documents WHERE NOT contains(left(text, 20), chr(10)) GROUP BY ALL)"""


def claims(spark, d):
    docs = ad.table(spark, d, "documents").where(~F.substring("text", 1, 20).contains("\n"))
    at = lambda body: F.concat(F.lit("src/"), "source", F.lit(".txt:"), "doc_id", body)
    same = at(F.concat(F.lit(": "), F.substring("text", 1, 20)))
    seen = F.when(F.col("doc_id") % 7 == 0, at(F.lit(":changed"))).when(F.col("doc_id") % 11 == 0, F.concat(F.lit("lib/new.txt:"), "doc_id", F.lit(":x"))).otherwise(same)
    rows = docs.select(F.floor(F.col("doc_id") / 10).cast("long").alias("trace_id"), F.lit(0).alias("turn_index"), (F.col("doc_id") % 3).cast("int").alias("seg_index"), "doc_id", same.alias("o"), seen.alias("e"))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", c))), lambda x: x[c]), "\n")
    return rows.groupBy("trace_id", "turn_index", "seg_index").agg(text("o").alias("original"), text("e").alias("effective"))


def _claim_rows(side, name):
    return f"""{name} AS (SELECT trace_id, turn_index, seg_index, regexp_extract(l, '^([^: \\t]+:[0-9]+):', 1) AS location, trim(regexp_replace(l, '^[^:]*:[0-9]+:', '')) AS content
 FROM (SELECT trace_id, turn_index, seg_index, unnest(string_split({side}, chr(10))) AS l FROM claims) WHERE regexp_matches(l, '^[^: \\t]+:[0-9]+:'))"""


_FABRICATION = f"""{CLAIMS}, {_claim_rows('effective', 'c')}, {_claim_rows('original', 't')}, fab AS (SELECT c.trace_id, c.turn_index, c.seg_index, CASE WHEN t.content IS NULL THEN '' ELSE c.location || ':' || t.content END AS original, c.location || ':' || c.content AS effective
 FROM c LEFT JOIN t USING (trace_id, turn_index, seg_index, location) WHERE t.content IS NULL OR t.content <> c.content)"""


@query("p_grep_claims", f"WITH {CLAIMS}, {_claim_rows('effective', 'c')} SELECT * FROM c")
def _(spark, d):
    return claims(spark, d).select("trace_id", "turn_index", "seg_index", F.explode(tx.grep_claims("effective")).alias("c")).select("trace_id", "turn_index", "seg_index", "c.location", "c.content")


@query("j_fabrication", f"WITH {_FABRICATION} SELECT * FROM fab")
def _(spark, d):
    return detect.fabrication(claims(spark, d)).select("trace_id", "turn_index", "seg_index", "original", "effective")


#: Text with `name = number` lines of a user's events by event type, and a copy with changed and dropped lines.
KEYED = """keyed AS (SELECT user_id % 20 AS trace_id, CAST(user_id // 20 AS INTEGER) AS turn_index, 0 AS seg_index, string_agg('count_' || (event_id % 50) || ' = ' || (event_id * 37 % 1000), chr(10) ORDER BY event_id) AS original,
 coalesce(string_agg('count_' || (event_id % 50) || ' = ' || (event_id * 37 % 1000 + CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END), chr(10) ORDER BY event_id) FILTER (event_id % 11 <> 0), '') AS effective FROM events GROUP BY ALL)"""


def keyed(spark, d):
    e = ad.table(spark, d, "events")
    n = F.col("event_id") * 37 % 1000
    line = lambda v: F.concat(F.lit("count_"), F.col("event_id") % 50, F.lit(" = "), v)
    rows = e.select((F.col("user_id") % 20).alias("trace_id"), F.floor(F.col("user_id") / 20).cast("int").alias("turn_index"), F.lit(0).alias("seg_index"), "event_id", line(n).alias("o"), F.when(F.col("event_id") % 11 != 0, line(n + (F.col("event_id") % 9 == 0).cast("int"))).alias("e"))
    text = lambda c: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("event_id", c))), lambda x: x[c].isNotNull()), lambda x: x[c]), "\n")
    return rows.groupBy("trace_id", "turn_index", "seg_index").agg(text("o").alias("original"), text("e").alias("effective"))


def _keyed_rows(side, name):
    return f"""{name} AS (SELECT trace_id, turn_index, seg_index, key, count(*) AS n, min(value) AS value FROM (SELECT trace_id, turn_index, seg_index, regexp_extract(l, '^([a-z_0-9]+) = ', 1) AS key, regexp_extract(l, ' = ([0-9]+)$', 1) AS value
 FROM (SELECT *, unnest(string_split({side}, chr(10))[1:200]) AS l FROM keyed) WHERE l <> '') GROUP BY ALL)"""


_CHANGED = f"""{KEYED}, {_keyed_rows('original', 'a')}, {_keyed_rows('effective', 'b')}, chg AS (SELECT trace_id, turn_index, seg_index, key || ' = ' || a.value AS original, key || ' = ' || b.value AS effective FROM a JOIN b USING (trace_id, turn_index, seg_index, key) WHERE a.n = 1 AND b.n = 1 AND a.value <> b.value)"""
_DROPPED_KEYED = """drk AS (SELECT trace_id, turn_index, seg_index, key || ' = ' || a.value AS original, '' AS effective FROM a JOIN keyed k USING (trace_id, turn_index, seg_index)
 WHERE a.n = 1 AND NOT EXISTS (SELECT 1 FROM b WHERE b.trace_id = a.trace_id AND b.turn_index = a.turn_index AND b.seg_index = a.seg_index AND b.key = a.key)
 AND NOT contains(k.effective, a.value) AND EXISTS (SELECT 1 FROM keyed l WHERE l.trace_id = a.trace_id AND l.turn_index > a.turn_index AND contains(l.effective, a.value)))"""
_DROPPED_BARE = f"""nums AS (SELECT trace_id, turn_index, seg_index, effective, unnest(x) AS value, unnest(range(len(x))) AS pos FROM (SELECT *, list_filter(n, lambda v, i: list_position(n, v) = i)[1:200] AS x FROM (SELECT *, {_NUMS.replace('{t}', 'original').replace('list_distinct', '')} AS n FROM keyed))),
bare0 AS (SELECT * FROM nums n WHERE NOT contains(effective, value) AND EXISTS (SELECT 1 FROM keyed l WHERE l.trace_id = n.trace_id AND l.turn_index > n.turn_index AND contains(l.effective, n.value))),
told AS (SELECT * FROM drk UNION ALL SELECT * FROM chg),
bare AS (SELECT trace_id, turn_index, seg_index, value AS original, '' AS effective FROM bare0 b WHERE NOT EXISTS (SELECT 1 FROM bare0 c WHERE c.trace_id = b.trace_id AND c.turn_index = b.turn_index AND (c.seg_index, c.pos) < (b.seg_index, b.pos) AND ends_with(c.value, b.value))
 AND NOT EXISTS (SELECT 1 FROM told t WHERE t.trace_id = b.trace_id AND t.turn_index = b.turn_index AND t.seg_index <= b.seg_index AND ends_with(t.original, b.value)))"""
_COLS = ("trace_id", "turn_index", "seg_index", "original", "effective")


@query("p_keyed_numbers", f"WITH {KEYED}, {_keyed_rows('effective', 'b')} SELECT * FROM b")
def _(spark, d):
    rows = keyed(spark, d).select("trace_id", "turn_index", "seg_index", F.explode(tx.keyed_numbers("effective")).alias("p"))
    return rows.groupBy("trace_id", "turn_index", "seg_index", F.col("p.key").alias("key")).agg(F.count("*").alias("n"), F.min("p.value").alias("value"))


@query("j_num_changed", f"WITH {_CHANGED} SELECT * FROM chg")
def _(spark, d):
    return detect.numbers_changed(keyed(spark, d)).select(*_COLS)


@query("j_num_dropped", f"WITH {_CHANGED}, {_DROPPED_KEYED}, {_DROPPED_BARE} SELECT * FROM drk UNION ALL SELECT * FROM bare")
def _(spark, d):
    return detect.numbers_dropped(keyed(spark, d)).select(*_COLS)


_ARTS_GONE = f"""gone AS (SELECT trace_id, turn_index, seg_index, effective, unnest({arts('original')}) AS value FROM pairs),
lost AS (SELECT trace_id, turn_index, seg_index, value AS original, '' AS effective FROM gone g WHERE NOT contains(effective, value) AND EXISTS (SELECT 1 FROM pairs l WHERE l.trace_id = g.trace_id AND l.turn_index > g.turn_index AND contains(l.effective, g.value)))"""


@query("j_artifact_lost", f"WITH {ad.PAIRS}, {_ARTS_GONE} SELECT * FROM lost")
def _(spark, d):
    return detect.artifacts_lost(ad.pairs(spark, d)).select(*_COLS)


@query("a_findings", f"WITH {_FABRICATION}, {_CHANGED}, {_DROPPED_KEYED}, {_DROPPED_BARE} SELECT 'fabrication' AS class, count(*) AS count FROM fab UNION ALL SELECT 'numeric-drift', count(*) FROM (SELECT * FROM chg UNION ALL SELECT * FROM drk UNION ALL SELECT * FROM bare)")
def _(spark, d):
    drift = detect.numbers_changed(keyed(spark, d)).unionByName(detect.numbers_dropped(keyed(spark, d)))
    return detect.count_by_class(detect.fabrication(claims(spark, d)).unionByName(drift))


_SEGMENT_RETENTION = f"""x AS (SELECT *, {nums('original')} AS n, {arts('original')} AS a FROM pairs), y AS (SELECT trace_id, turn_index, seg_index, len(n) AS numerics_total, len(list_filter(n, lambda v: contains(effective, v))) AS numerics_kept, len(a) AS artifacts_total, len(list_filter(a, lambda v: contains(effective, v))) AS artifacts_kept FROM x),
z AS (SELECT *, numerics_total + artifacts_total AS t, CASE WHEN numerics_total + artifacts_total > 0 THEN (numerics_total + artifacts_total - numerics_kept - artifacts_kept) * 100 // (numerics_total + artifacts_total) END AS p FROM y)"""


@query("a_retention", f"""WITH {ad.PAIRS}, {_SEGMENT_RETENTION} SELECT CAST(sum(numerics_total) AS BIGINT) AS numerics_total, CAST(sum(numerics_kept) AS BIGINT) AS numerics_kept, CAST(sum(artifacts_total) AS BIGINT) AS artifacts_total, CAST(sum(artifacts_kept) AS BIGINT) AS artifacts_kept,
 count(*) FILTER (t >= 10 AND p >= 50) AS big_drop_segments, CAST(coalesce(max(p) FILTER (t >= 10 AND p >= 50), 0) AS INTEGER) AS worst_drop_percent FROM z""")
def _(spark, d):
    return detect.retention(ad.pairs(spark, d))


@query("a_segment_retention", f"WITH {ad.PAIRS}, {_SEGMENT_RETENTION} SELECT trace_id, turn_index, seg_index, numerics_total, numerics_kept, artifacts_total, artifacts_kept FROM z")
def _(spark, d):
    return detect.segment_retention(ad.pairs(spark, d))


@query("p_modified", f"WITH {ad.PAIRS} SELECT count(*) AS segments, count(*) FILTER (original IS NOT NULL) AS paired, count(*) FILTER (original IS NOT NULL AND original <> effective) AS modified FROM pairs")
def _(spark, d):
    return ad.pairs(spark, d).agg(F.count("*").alias("segments"), F.count_if(F.col("original").isNotNull()).alias("paired"), F.count_if(tx.is_modified("original", "effective")).alias("modified"))


@query("p_shape", "SELECT page_id, CASE WHEN contains(html, 'diff --git') THEN 'diff' WHEN len(list_filter(string_split(html, chr(10)), lambda x: regexp_matches(x, '^[^: ]*[/.][^: ]*:[0-9]+:'))) >= 2 THEN 'search' ELSE 'other' END AS shape FROM pages")
def _(spark, d):
    return ad.table(spark, d, "pages").select("page_id", tx.shape("html").alias("shape"))


@query("f_mask_digits", "SELECT page_id, regexp_replace(url, '[0-9]+', chr(1), 'g') AS template, array_to_string(regexp_extract_all(url, '[0-9]+'), ',') AS params FROM pages")
def _(spark, d):
    return ad.table(spark, d, "pages").select("page_id", tx.masked_digits("url").alias("m")).select("page_id", "m.template", F.array_join("m.params", ",").alias("params"))


@query("f_dir_of", "SELECT page_id, regexp_extract(url, '^(.*/)', 1) AS dir, regexp_matches(url, ':[0-9]+:') AS grep_shaped FROM pages")
def _(spark, d):
    return ad.table(spark, d, "pages").select("page_id", tx.dir_of("url").alias("dir"), tx.is_grep_shaped("url").alias("grep_shaped"))


#: Pages of one trace were read in two ways: captures hold what was on the wire for every third page.
_PAIRED = """SELECT page_id AS seg, CASE WHEN page_id % 3 = 0 AND left(html, 100) <> html THEN html END AS original, CASE WHEN page_id % 3 = 0 THEN left(html, 100) ELSE html END AS effective FROM pages"""


@query("j_pair", _PAIRED)
def _(spark, d):
    p = ad.table(spark, d, "pages")
    segments = p.select(F.col("page_id").alias("seg"), F.concat(F.lit("toolu_"), "page_id").alias("tool_use_id"), F.lit(None).cast("string").alias("original"), F.col("html").alias("effective"))
    captures = p.where("page_id % 3 = 0").select(F.concat(F.lit("toolu_"), "page_id").alias("tool_use_id"), F.substring("html", 1, 100).alias("content"))
    return pairing.pair(segments, captures).select("seg", "original", "effective")


@query("j_call_result", "WITH c AS (SELECT user_id, event_type AS id, max_by(props, event_id) AS input FROM events WHERE event_id % 2 = 0 GROUP BY ALL) SELECT e.event_id, c.input FROM events e LEFT JOIN c ON c.user_id = e.user_id AND c.id = e.event_type WHERE e.event_id % 2 = 1")
def _(spark, d):
    e = ad.table(spark, d, "events").select(F.col("user_id").alias("trace_id"), F.col("event_type").alias("tool_use_id"), "event_id", "props")
    calls = e.where("event_id % 2 = 0").withColumnsRenamed({"event_id": "pos", "props": "input"})
    return pairing.with_call(e.where("event_id % 2 = 1"), calls).select("event_id", "input")


@query("j_tool_name", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props ELSE coalesce(last_value(CASE WHEN event_id % 3 = 0 THEN props END IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'unknown') END AS tool_name FROM events""")
def _(spark, d):
    e = ad.table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_type").alias("tool_use_id"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 3 == 0, "tool-call").otherwise("tool-result").alias("kind"), F.col("props").alias("tool_name"))
    return pairing.with_tool_name(e).select(F.col("pos").alias("event_id"), "tool_name")


_SB = f"""{ad.PAIRS}, {_SEGMENT_RETENTION}, tr AS (SELECT DISTINCT trace_id, CASE trace_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'none' END AS optimizer, CASE WHEN trace_id % 2 = 0 THEN 'real-work' ELSE 'synthetic' END AS origin, CASE WHEN trace_id % 4 = 0 THEN 'donated' ELSE 'first-party' END AS party FROM pairs)"""


@query("a_scoreboard", f"""WITH {_SB}, b AS (SELECT optimizer, count(*) AS traces, count(*) FILTER (origin = 'real-work') AS real_work, count(*) FILTER (party = 'donated') AS donated FROM tr GROUP BY 1),
k AS (SELECT optimizer, count(*) AS paired_segments, CAST(sum(numerics_total) AS BIGINT) AS numerics_total, CAST(sum(numerics_kept) AS BIGINT) AS numerics_kept, CAST(sum(artifacts_total) AS BIGINT) AS artifacts_total, CAST(sum(artifacts_kept) AS BIGINT) AS artifacts_kept FROM z JOIN tr USING (trace_id) GROUP BY 1)
SELECT b.*, paired_segments, numerics_total, numerics_kept, artifacts_total, artifacts_kept, donated = 0 AS single_fleet FROM b LEFT JOIN k USING (optimizer)""")
def _(spark, d):
    pairs = ad.pairs(spark, d)
    t = F.col("trace_id")
    traces = pairs.select("trace_id").distinct().select("trace_id", F.when(t % 3 == 0, "alpha").when(t % 3 == 1, "beta").alias("optimizer"), F.when(t % 2 == 0, "real-work").otherwise("synthetic").alias("origin"), F.when(t % 4 == 0, "donated").otherwise("first-party").alias("party"))
    board = detect.scoreboard(traces, pairs, traces.select("trace_id", F.lit(1).cast("long").alias("total_tokens")))
    return board.select("optimizer", "traces", "real_work", "donated", "paired_segments", "numerics_total", "numerics_kept", "artifacts_total", "artifacts_kept", "single_fleet")
