"""The audit of session files: read, paired with captures, summed up and reported."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom import model
from traceloom.operators import detect, ledger, pairing
from traceloom.sources import records, transcripts

TOP_MODELS, TOP_FINDINGS = 4, 10


def commas(n: int) -> str:
    return f"{n:,}"


def money(usd: float) -> str:
    cents = int(usd * 100 + 0.5)
    return f"${cents // 100:,}.{cents % 100:02d}"


def percent_kept(kept: int, total: int) -> str:
    return f"{kept * 100 // total}% kept" if total else "n/a"


def counters(turns: DataFrame, files: DataFrame, failed: DataFrame, paired: DataFrame) -> DataFrame:
    """One row: files, failed files, traces, turns, paired segments, and the period by the text of its timestamps."""
    seen = turns.agg(F.count_distinct("file", "trace_id").alias("traces"), F.count("*").alias("turns"), F.min("timestamp").alias("period_start"), F.max("timestamp").alias("period_end"))
    n = lambda df, name: F.broadcast(df.agg(F.count("*").alias(name)))  # noqa: E731  one row each
    return seen.join(n(files, "files")).join(n(failed, "files_failed")).join(n(paired, "segments_paired"))


def audit(spark: SparkSession, root: str, captures: str | None = None) -> dict:
    """A small dictionary on the driver: counters, spend by model, retention, the first findings and their number."""
    lines = transcripts.lines(spark, root)
    env = transcripts.envelopes(lines)
    turns = transcripts.turns(env)
    segments = pairing.with_tool_name(transcripts.segments(turns))
    if captures is not None:
        segments = pairing.pair(segments, pairing.latest_capture(records.captures(spark, captures)))
    own = segments.withColumn("trace_id", F.concat_ws("#", "file", "trace_id"))
    usage = turns.where("billing is not null").select(F.coalesce("model", F.lit("unknown")).alias("model"), "billing.*")
    found = detect.findings(own)
    spend = ledger.spend(usage, model.rates(spark))
    out = counters(turns, lines.select("file").distinct(), transcripts.drifted(env), detect.paired(own)).first().asDict()
    top = spend.where("actual_usd is not null").orderBy(F.desc("actual_usd"), "model").limit(TOP_MODELS)
    total = spend.agg(F.sum("actual_usd").alias("actual_usd"), F.sum("without_caching_usd").alias("without_caching_usd"), F.sum("billed_tokens").alias("billed_tokens")).first().asDict()
    return out | {
        "ledger": total, "models": [r.asDict() for r in top.select("model", "actual_usd").collect()], "unpriced": {r["model"]: r["billed_tokens"] for r in spend.where("actual_usd is null and billed_tokens > 0").collect()},
        "retention": detect.retention(own).first().asDict(), "findings_total": found.count(), "findings": [r.asDict() for r in found.orderBy("trace_id", "turn_index", "seg_index", "class", "original").limit(TOP_FINDINGS).collect()],
    }


def _facts(a: dict) -> list[tuple[str, str]]:
    day = lambda t: (t or "")[:10]
    r, c = a["retention"], a["ledger"]
    rows = [("sessions", commas(a["traces"]) + (f" ({day(a['period_start'])} to {day(a['period_end'])})" if a["period_start"] else "")), ("turns", commas(a["turns"])), ("files", commas(a["files"]))]
    if a["files_failed"]:
        rows.append(("files failed", commas(a["files_failed"])))
    used, bare = c["actual_usd"] or 0.0, c["without_caching_usd"] or 0.0
    rows += [("usage", money(used)), ("without caching", money(bare)), ("caching saved", f"{money(bare - used)} ({100 * (bare - used) / bare if bare else 0:.0f}%)")]
    rows += [(m["model"], money(m["actual_usd"])) for m in a["models"]] + [(m, f"{commas(t)} tokens, unpriced") for m, t in sorted(a["unpriced"].items())]
    if a["segments_paired"]:
        rows += [("originals paired", commas(a["segments_paired"]))]
        rows += [(f"{k} kept", f"{commas(r[f'{k}_kept'])}/{commas(r[f'{k}_total'])} ({percent_kept(r[f'{k}_kept'], r[f'{k}_total'])})") for k in ("numerics", "artifacts")]
        if r["big_drop_segments"]:
            rows.append(("large drops", f"{commas(r['big_drop_segments'])}, up to {r['worst_drop_percent']}%"))
    return [*rows, ("findings", commas(a["findings_total"]))]


def _finding(f: dict) -> str:
    return f"[{f['class']}] {f['trace_id']}#{f['turn_index']} {f['detail']}"


def to_text(a: dict) -> str:
    more = a["findings_total"] - len(a["findings"])
    return "\n".join([*(f"  {k:<18}{v}" for k, v in _facts(a)), *(f"  {_finding(f)}" for f in a["findings"]), *([f"  and {more} more"] if more > 0 else [])]) + "\n"


def to_markdown(a: dict) -> str:
    return "\n".join(["| what | value |", "|-|-|", *(f"| {k} | {v} |" for k, v in _facts(a)), "", *(f"- {_finding(f)}" for f in a["findings"])]) + "\n"


def to_html(a: dict) -> str:
    e = html.escape
    return "<table>" + "".join(f"<tr><th>{e(k)}</th><td>{e(v)}</td></tr>" for k, v in _facts(a)) + "</table><ul>" + "".join(f"<li>{e(_finding(f))}</li>" for f in a["findings"]) + "</ul>\n"


def to_json(a: dict) -> str:
    return json.dumps(a, indent=1, sort_keys=True, default=str)


def scoreboard_markdown(board: DataFrame) -> str:
    """Of detect.scoreboard(): a row for each optimizer, of which there are few."""
    cols = ["optimizer", "traces", "real_work", "synthetic", "donated", "paired_segments", "fabrication", "numeric_drift", "artifact_loss", "numerics_kept", "numerics_total", "artifacts_kept", "artifacts_total", "tokens"]
    rows = board.select(*cols, "single_fleet").orderBy("optimizer").collect()
    return "\n".join(["| " + " | ".join([*cols, "sample"]) + " |", "|" + "-|" * (len(cols) + 1), *("| " + " | ".join([str(r[c]) for c in cols] + ["single fleet" if r["single_fleet"] else "mixed"]) + " |" for r in rows)]) + "\n"


def policy_json(policy: DataFrame, threshold: float) -> str:
    """Of reopen.learn(): version 1; classes and size bands are few."""
    rows = policy.collect()
    classes: dict = {}
    for r in rows:
        if r["class"] is not None and r["band"] is None:
            classes.setdefault(r["class"], {"sizes": {}}).update(rate=r["rate"], n=r["n"])
    for r in rows:
        if r["band"] is not None:
            classes[r["class"]]["sizes"][r["band"]] = {"rate": r["rate"], "n": r["n"]}
    return json.dumps({"version": 1, "threshold": threshold, "prior": next(r["rate"] for r in rows if r["class"] is None), "classes": classes}, indent=1, sort_keys=True)
