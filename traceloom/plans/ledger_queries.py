"""Ledger queries over the events stand-in."""

from pyspark.sql import functions as F

from traceloom import model
from traceloom.operators import ledger as op
from traceloom.plans import adapters as ad
from traceloom.plans.registry import query

L = ad.LEDGER
NOW = ad.NOW_MS
_TOTALS = """SELECT a.*, k.kept, a.blocks + k.kept AS seen, greatest(greatest(a.input_tokens - a.output_tokens, 0) - a.reopened_tokens, 0) AS net_tokens FROM
(SELECT count(*) FILTER (kind = 'block') AS blocks, count(*) FILTER (kind = 'block' AND verified) AS verified, count(*) FILTER (kind = 'block' AND inline) AS inline, count(*) FILTER (kind = 'block' AND NOT inline) AS offloaded,
 CAST(coalesce(sum(input_tokens) FILTER (kind = 'block'), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens) FILTER (kind = 'block'), 0) AS BIGINT) AS output_tokens,
 count(*) FILTER (kind = 'resolve') AS reopens, CAST(coalesce(sum(reopened_tokens) FILTER (kind = 'resolve'), 0) AS BIGINT) AS reopened_tokens FROM counted) a,
(SELECT count(*) AS kept FROM ev WHERE kept_reason <> '') k"""


@query("a_ledger_summary", f"WITH {L} {_TOTALS}")
def _(spark, d):
    return op.summary(ad.ledger(spark, d))


@query("a_receipt", f"WITH {L.replace('FROM events)', f'FROM events WHERE epoch_us(ts) // 1000 >= {NOW - 3 * op.DAY_MS})')} {_TOTALS}")
def _(spark, d):
    return op.receipt(ad.ledger(spark, d), NOW - 3 * op.DAY_MS)


@query("a_ledger_axes", f"""WITH {L}, long AS (SELECT unnest(['transform', 'surface', 'model', 'platform']) AS axis, unnest([transform, surface, model, platform]) AS key, delta FROM counted WHERE kind = 'block')
SELECT axis, key, count(*) AS blocks, CAST(sum(delta) AS BIGINT) AS saved FROM long WHERE axis IN ('transform', 'surface') OR key <> '' GROUP BY ALL
UNION ALL SELECT 'kept_reason', kept_reason, count(*), 0 FROM ev WHERE kept_reason <> '' GROUP BY ALL""")
def _(spark, d):
    return op.by_axis(ad.ledger(spark, d))


@query("w_first_cert", f"WITH {L} SELECT seq, cert, delta FROM counted WHERE kind = 'block'")
def _(spark, d):
    return op.counted(ad.ledger(spark, d)).where("kind = 'block'").select("seq", "cert", "delta")


_CURVE = f"""{L}, run AS (SELECT seq, at_ms, sum(delta) OVER w AS s FROM counted WINDOW w AS (ORDER BY seq)),
curve AS (SELECT seq, at_ms, CAST(s - least(0, min(s) OVER (ORDER BY seq)) AS BIGINT) AS cumulative_tokens FROM run)"""


@query("w_curve", f"WITH {_CURVE} SELECT * FROM curve")
def _(spark, d):
    return op.curve(ad.ledger(spark, d))


@query("w_downsample", f"""WITH {_CURVE}, r AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS i, count(*) OVER () AS n FROM curve)
SELECT seq, at_ms, cumulative_tokens FROM r WHERE n <= 120 OR i = n - 1 OR i % CAST(ceil((n - 1) / 119.0) AS BIGINT) = 0""")
def _(spark, d):
    return op.downsample(op.curve(ad.ledger(spark, d)))


_STARTS = op.period_starts(NOW, 120)
_PERIODS = ", ".join(f"('{p}', {at})" for p, at in _STARTS.items())


@query("w_bucket_current", f"""WITH {L}, p AS (SELECT * FROM (VALUES {_PERIODS}) t(period, since)), j AS (SELECT period, seq, delta FROM p JOIN counted ON at_ms >= since),
r AS (SELECT period, seq, delta, sum(delta) OVER (PARTITION BY period ORDER BY seq) AS s FROM j)
SELECT p.period, CAST(coalesce(sum(delta) - least(0, min(s)), 0) AS BIGINT) AS saved FROM p LEFT JOIN r ON r.period = p.period GROUP BY p.period""")
def _(spark, d):
    return op.saved_since(ad.ledger(spark, d), NOW, 120)


def _calendar(unit):
    sql = f"""WITH {L}, j AS (SELECT CAST(date_trunc('{unit}', make_timestamp(at_ms * 1000)) AS DATE) AS start, seq, delta FROM counted), r AS (SELECT *, sum(delta) OVER (PARTITION BY start ORDER BY seq) AS s FROM j)
SELECT start, CAST(sum(delta) - least(0, min(s)) AS BIGINT) AS saved FROM r GROUP BY start"""
    query(f"w_bucket_{unit}", sql)(lambda spark, d: op.calendar(ad.ledger(spark, d), unit))


for _unit in ("day", "week", "month"):
    _calendar(_unit)


@query("t_recent", f"WITH {L} SELECT seq, at_ms, transform, kept_reason FROM ev ORDER BY seq DESC LIMIT 40")
def _(spark, d):
    return op.recent(ad.ledger(spark, d)).select("seq", "at_ms", "transform", "kept_reason")


_SPEND = f"""{ad.USAGE}, best AS (SELECT m.model, max_by(rt, length(rt.prefix)) AS x FROM (SELECT DISTINCT model FROM usage) m JOIN rates rt ON starts_with(m.model, rt.prefix) GROUP BY m.model),
spend AS (SELECT u.model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, CAST(sum(cache_write_5m_tokens) AS BIGINT) AS cache_write_5m_tokens, CAST(sum(cache_write_1h_tokens) AS BIGINT) AS cache_write_1h_tokens,
 round(CAST(sum((input_tokens * x.pi + output_tokens * x.po + cache_read_tokens * x.pr + cache_write_5m_tokens * x.w5 + cache_write_1h_tokens * x.w1) / 1e6) AS DOUBLE), 6) AS actual_usd,
 round(CAST(sum(((input_tokens + cache_read_tokens + cache_write_5m_tokens + cache_write_1h_tokens) * x.pi + output_tokens * x.po) / 1e6) AS DOUBLE), 6) AS without_caching_usd,
 CAST(sum(input_tokens + output_tokens + cache_read_tokens + cache_write_5m_tokens + cache_write_1h_tokens) AS BIGINT) AS billed_tokens FROM usage u LEFT JOIN best b ON b.model = u.model GROUP BY u.model)"""


@query("a_spend", f"WITH {_SPEND} SELECT * FROM spend")
def _(spark, d):
    return op.spend(ad.usage(spark, d), model.rates(spark))


@query("t_models", f"WITH {_SPEND} SELECT model, actual_usd FROM spend WHERE actual_usd IS NOT NULL ORDER BY actual_usd DESC, model LIMIT 4")
def _(spark, d):
    return op.spend(ad.usage(spark, d), model.rates(spark)).where("actual_usd is not null").orderBy(F.desc("actual_usd"), "model").limit(4).select("model", "actual_usd")


@query("j_rates", f"WITH {_SPEND} SELECT model, x.prefix AS prefix FROM best")
def _(spark, d):
    return op.with_rates(ad.usage(spark, d).select("model").distinct(), model.rates(spark)).where("rate is not null").select("model", F.col("rate.prefix").alias("prefix"))
