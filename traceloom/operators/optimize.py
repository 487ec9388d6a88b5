"""Choosing an encoding for each block: candidates, proofs, prices, detectors, the choice, and storing away.

A block's candidates come from one Arrow UDF a distinct block (by content id), so a block that repeats, however
often, is encoded once; everything after - admission, price, detector gate, argmin - is column logic."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions import codecs, previews
from traceloom.functions import jsontext as js
from traceloom.functions import text as tx
from traceloom.operators import relevance
from traceloom.shipping import ship

MARKER = "offload"
REOPEN_PRIOR = 0.45
SPLIT_ROWS, SPLIT_MOST = 8, 24
TTL_MS, LEAST_STORED = 24 * 3_600_000, 512

CANDIDATE = "struct<codec: string, kind: string, wire: string, faithful: boolean, stable: boolean, same_numbers: boolean>"
PROBE = f"struct<is_json: boolean, duplicate_keys: boolean, canonical: string, atoms: bigint, preview_kind: string, preview: string, worth_storing: boolean, candidates: array<{CANDIDATE}>>"


@dataclass(frozen=True)
class Config:
    """Options of a run. extra: name -> (encode, decode) text codecs of the caller, which prove their round trip each time."""

    input_rate: float | None = 3.0  # USD for a million tokens; None: the model is unknown
    offload: str = "auto"  # off, auto, always
    more_codecs: bool = False
    extra: dict = field(default_factory=dict)


def _single(text: str) -> dict[str, str]:
    """Key and number of the keys that have one number only."""
    found: dict[str, set] = {}
    for dot, key, value in tx.KEYED.findall(text):
        if value and not dot:
            found.setdefault(key, set()).add(value)
    return {k: min(v) for k, v in found.items() if len(v) == 1}


def _same_numbers(raw: str, wire: str) -> bool:
    """A wire may change no number under a key that has one number in each of the two."""
    told = _single(wire)
    return all(told.get(k, v) == v for k, v in _single(raw).items()) if told else True


def _canonical(raw: str) -> str:
    value, ok = js.try_parse(raw)
    return js.canonical(value) if ok else raw


def _probe(raw: str, config: Config) -> dict:
    value, is_json = js.try_parse(raw)
    structured = is_json and not js.is_scalar(value)
    canonical = js.canonical(value) if is_json else raw
    found = []
    if structured:
        for name, c in (codecs.STRUCTURED | (codecs.MORE_STRUCTURED if config.more_codecs else {})).items():
            if (wire := c.encode(value)) is not None:
                back, ok = c.decode(wire)
                found.append((name, "structured", wire, ok and js.canonical(back) == canonical and sorted(js.leaves(back)) == sorted(js.leaves(value)), True))
    elif not is_json:
        for name, c in codecs.TEXT.items():
            if (wire := c.encode(raw)) is not None:
                found.append((name, "text", wire, c.decode(wire) == raw, True))
                break  # the first that works
        if config.more_codecs and not found:
            found += [(n, "proposed", w, c.decode(w) == raw, True) for n, c in codecs.MORE_TEXT.items() if (w := c.encode(raw)) is not None]
    if not found or not is_json:
        for name, (enc, dec) in config.extra.items():
            try:
                wire = enc(raw)
                if wire is not None:
                    found.append((name, "proposed", wire, dec(wire) == raw, enc(dec(wire)) == wire))
            except Exception:  # noqa: BLE001  the caller's codec; what it cannot do it declines
                continue
    kind, shown = previews.preview(canonical)
    return {
        "is_json": is_json, "duplicate_keys": js.has_duplicate_keys(raw), "canonical": canonical, "atoms": len(js.leaves(value)) if is_json else len(raw.split()), "preview_kind": kind, "preview": shown,
        "worth_storing": previews.worth_storing(canonical), "candidates": [dict(zip(("codec", "kind", "wire", "faithful", "stable", "same_numbers"), (*x, x[1] == "structured" or _same_numbers(raw, x[2])))) for x in found],
    }


def probe(raw, config: Config):
    @F.pandas_udf(PROBE)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_probe(x or "", config) for x in s])

    return run(raw)


def decoded(wire):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda w: None if w is None else codecs.decode(w))

    return run(wire)


def certify(raw):
    """What a wire of this block can be held against by anyone, without the block: the hash of its canonical form."""

    @F.pandas_udf("string")
    def canonical(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else _canonical(x))

    return F.sha2(canonical(raw).cast("binary"), 256)


def verified(wire, certificate):
    """Whether a wire holds the certified block. One with a marker names it by the first 16 digits; any other decodes to it."""
    named = tx.marker_id(wire)
    return F.when(named != "", F.startswith(certificate, F.lower(named))).otherwise(certify(decoded(wire)) == certificate)


def content_id(text):
    """16 hex digits of what the block holds."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def _detector_clean(raw, wire):
    """A wire may claim no location that the block lacks."""
    said, true = tx.grep_claims(wire), tx.grep_claims(raw)
    return ~F.exists(said, lambda c: ~F.exists(true, lambda t: (t["location"] == c["location"]) & (t["content"] == c["content"])))


def candidates(blocks: DataFrame, config: Config = Config()) -> DataFrame:
    """A row for each distinct raw: its probe, and content id, certificate and size."""
    ship(blocks.sparkSession)
    one = blocks.where(F.col("raw").isNotNull()).select("raw").distinct()
    rows = one.withColumn("p", probe(F.col("raw"), config)).select("raw", "p.*")
    return rows.withColumn("certificate", F.sha2(F.col("canonical").cast("binary"), 256)).withColumn("id", content_id(F.col("canonical"))).withColumn("units", F.octet_length("raw"))


def choose(found: DataFrame, config: Config = Config()) -> DataFrame:
    """Of candidates(): raw, outcome (inline, offload, verbatim), codec, wire or stub, marker id, kept_reason, units and sent.

    found may say may_store for each row: false keeps it from being stored away.

    Of admitted, cheaper and clean wires the least (units, codec, wire) wins. A stub replaces it if storing is on,
    worth it, and - in auto - cheaper even when the prior share of blocks comes back."""
    c = F.filter("candidates", lambda x: x["faithful"] & x["stable"] & (F.octet_length(x["wire"]) < F.col("units")) & ((x["kind"] == "structured") | (x["same_numbers"] & _detector_clean(F.col("raw"), x["wire"]))))
    best = F.array_min(F.transform(c, lambda x: F.struct(F.octet_length(x["wire"]).alias("units"), x["codec"].alias("codec"), x["wire"].alias("wire"))))
    stub = F.concat(F.lit("[offloaded, "), F.when(F.col("preview_kind") == "head", F.lit("preview:")).otherwise(F.col("preview_kind")), F.lit("]\n"), "preview", F.lit(f"\n<<{MARKER}:"), "id", F.lit(">>"))
    rows = found.withColumn("best", best).withColumn("stub", stub).withColumn("stub_units", F.octet_length("stub"))
    inline = F.coalesce(F.col("best.units"), F.col("units"))
    wins = F.lit(config.offload == "always") | (F.col("stub_units") + REOPEN_PRIOR * F.col("units") < inline)
    priced = F.lit(config.input_rate is not None)
    blocked = F.col("duplicate_keys")
    stored = F.lit(config.offload != "off") & (F.col("units") >= LEAST_STORED) & F.col("worth_storing") & (F.col("stub_units") < F.col("units")) & wins & priced & ~blocked
    given = ["may_store"] if "may_store" in found.columns else []
    if given:
        stored &= F.col("may_store")
    shipped = F.col("best").isNotNull() & priced & ~blocked
    n = F.size("candidates")
    reason = F.when(blocked, "duplicate_keys").when(n == 0, F.when(~F.col("worth_storing"), "thin_preview").otherwise("not_applicable")).when(~F.exists("candidates", lambda x: x["faithful"]), "refused_witness").when(~F.exists("candidates", lambda x: x["faithful"] & x["stable"]), "refused_idempotency")
    reason = reason.when(~priced, "no_saving_unknown_model").when(~F.exists("candidates", lambda x: F.octet_length(x["wire"]) < F.col("units")), "no_saving_notworth").otherwise("detector")
    outcome = F.when(stored, "offload").when(shipped, "inline").otherwise("verbatim")
    wire = F.when(stored, F.col("stub")).when(shipped, F.col("best.wire")).otherwise(F.col("raw"))
    return rows.select(
        "raw", "canonical", "certificate", "atoms", outcome.alias("outcome"), F.when(stored, F.col("preview_kind")).when(shipped, F.col("best.codec")).alias("codec"), wire.alias("wire"), F.when(stored, F.col("id")).alias("id"),
        F.when(~stored & ~shipped, reason).alias("kept_reason"), "units", F.octet_length(wire).alias("sent"), *given,
    )


def optimize(blocks: DataFrame, config: Config = Config()) -> DataFrame:
    """blocks (raw and whatever else) with the choice for each; null blocks stay verbatim as `not_applicable`."""
    got = choose(candidates(blocks, config), config)
    out = blocks.join(got, "raw", "left").withColumn("outcome", F.coalesce("outcome", F.lit("verbatim")))
    return out.withColumn("kept_reason", F.when(F.col("raw").isNull(), "not_applicable").otherwise(F.col("kept_reason")))


def faithful(outcomes: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """outcomes with faithful: an inline wire decodes to the certified content, a marker resolves to it."""
    back = F.when(F.col("outcome") == "inline", F.sha2(decoded("wire").cast("binary"), 256) == F.col("certificate"))
    rows = outcomes
    kept = F.lit(True)
    if store is not None:
        rows = outcomes.join(store.select("id", F.col("raw").alias("__stored")), "id", "left")
        kept = F.coalesce(F.sha2(F.col("__stored").cast("binary"), 256) == F.col("certificate"), F.lit(False))
    return rows.withColumn("faithful", back.when(F.col("outcome") == "offload", kept).otherwise(True)).drop("__stored")


def to_store(outcomes: DataFrame, now_ms: int) -> DataFrame:
    """What the offloaded blocks need kept: id, raw, written_at."""
    return outcomes.where("outcome = 'offload'").select("id", F.col("canonical").alias("raw"), F.lit(now_ms).cast("long").alias("written_at")).dropDuplicates(["id"])


def resolve(wanted: DataFrame, store: DataFrame, now_ms: int, ttl_ms: int = TTL_MS) -> DataFrame:
    """wanted (id) with the stored raw: null if the id isn't 16 hex digits, unknown, expired or not what it hashes to."""
    fresh = store.where((F.col("written_at") > now_ms - ttl_ms) & (content_id(F.col("raw")) == F.col("id")))
    return wanted.join(fresh.select("id", "raw"), "id", "left").withColumn("raw", F.when(F.col("id").rlike("^[0-9A-Fa-f]{16}$"), F.col("raw")))


def selected(block, selector):
    @F.pandas_udf("string")
    def run(b: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else js.select(x, y) for x, y in zip(b, s)])

    return run(block, selector)


def split_by_relevance(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """block, row, shown: for queries of collections with SPLIT_ROWS rows or more, the most relevant quarter stays in view."""
    size = rows.groupBy("collection").agg(F.count("*").alias("n")).where(F.col("n") >= SPLIT_ROWS)
    rows = rows.join(size.select("collection"), "collection")
    asked = queries.select("block", "collection").join(size, "collection")
    keep = relevance.select(relevance.rank(rows, queries), SPLIT_MOST).join(asked, "block")
    keep = keep.withColumn("r", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("score"), "row"))).where(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") / 4))).select("block", "row", F.lit(True).alias("shown"))
    return rows.select("collection", "row").join(asked, "collection").join(keep, ["block", "row"], "left").select("block", "row", F.coalesce("shown", F.lit(False)).alias("shown"))
