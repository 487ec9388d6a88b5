"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, seeded by its code point. A letter trigram binds them:
the product of the first letter's vector permuted twice, the second's once and the third's. A document's
vector bundles (sums) those of its trigrams over lower-cased words, with a blank between words; it is
compared by cosine with language prototypes, which bundle the unit vectors of labelled documents, less
the mean over all languages.

The fit takes every labelled row; labels come from any string column. Texts that are null or have no
letter give `und`, score 0. A letter is a character of category L. Ties go to the first language in order of name. Without labelled
rows every text gives `und`, and an empty table gives no rows. Repeated rows give a row each. Very long texts
are read whole. Of the columns to keep, those named like a result column give way to it; others are ignored.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm import common

DIM = 512
UNKNOWN = "und"
BINS = 1000  # of a cosine of 1

_NON_LETTERS = re.compile(r"[\W\d_]+")
#: By code point: signs of the categories No and Nl, which count as word characters in patterns, but are no letters.
_NUMERAL = np.array([c.isalnum() and not c.isalpha() and not c.isdecimal() for c in map(chr, range(sys.maxunicode + 1))])
_letters: dict[int, np.ndarray] = {}
_grams: dict[int, int] = {}
_rows = np.zeros((1024, DIM), np.int8)
BITS = 21  # of a code point


def _clear() -> None:
    global _rows
    _rows = np.zeros((1024, DIM), np.int8)
    _grams.clear()
    _letters.clear()


def letter(code: int) -> np.ndarray:
    if code not in _letters:
        _letters[code] = np.ones(DIM, np.float32) if code == 32 else np.random.default_rng(code).choice(np.array([-1, 1], np.float32), DIM)
    return _letters[code]


def _gram_rows(keys: np.ndarray) -> np.ndarray:
    """Row numbers of trigram vectors, which are made when first seen."""
    global _rows
    out = np.empty(len(keys), np.int64)
    for i, k in enumerate(keys.tolist()):
        r = _grams.get(k)
        if r is None:
            if len(_grams) >= 60_000:  # 30 MB; texts with ever new trigrams start over
                _grams.clear()
                return _gram_rows(keys)
            r = _grams[k] = len(_grams)
            if r >= len(_rows):
                _rows = np.concatenate([_rows, np.zeros_like(_rows)])
            a, b, c = k >> 2 * BITS, k >> BITS & (1 << BITS) - 1, k & (1 << BITS) - 1
            _rows[r] = np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
        out[i] = r
    return out


def vector(text: str | None) -> np.ndarray | None:
    """The bundled vector of a text, of length 1; None if it has no letter."""
    clean = _NON_LETTERS.sub(" ", text or "").strip().lower()
    if not clean:
        return None
    codes = np.frombuffer(f" {clean} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if _NUMERAL[codes].any():
        return vector("".join(" " if _NUMERAL[ord(c)] else c for c in clean))
    keys = codes[:-2] << 2 * BITS | codes[1:-1] << BITS | codes[2:]
    keys, n = np.unique(keys, return_counts=True)
    v = np.zeros(DIM, np.float32)
    for at in range(0, len(keys), 2000):
        rows = _gram_rows(keys[at : at + 2000])
        v += n[at : at + 2000].astype(np.float32) @ _rows[rows].astype(np.float32)
    norm = float(np.sqrt((v.astype(np.float64) ** 2).sum()))
    return v / norm if norm else v


def fit(labelled: DataFrame, text: str = "text", label: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes by label, on the driver: one vector for each of the labels, which are few. Sums are of whole numbers,
    so no order of rows changes them."""
    common.ship(labelled.sparkSession)
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label")).where("text is not null and label is not null")

    def bundle(batches):
        common.claim("language", _clear)
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for t, name in zip(b.column(0), b.column(1)):
                if (v := vector(t.as_py())) is not None:
                    sums[name.as_py()] = sums.get(name.as_py(), 0) + np.round(v * 2**20).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["label", "v"])

    parts = rows.mapInArrow(bundle, "label string, v array<long>")
    total = parts.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    out = {r["label"]: np.array([x["x"] for x in r["v"]], np.float64) for r in total.collect()}
    unit = {k: v / np.linalg.norm(v) for k, v in sorted(out.items()) if np.linalg.norm(v)}
    mean = sum(unit.values()) / len(unit) if len(unit) > 1 else 0
    return {k: (v - mean) / max(np.linalg.norm(v - mean), 1e-12) for k, v in unit.items()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of docs (default doc_id), then lang_pred, score (the share of the best language in the
    softmax of the cosines, times 0.5 or more where the best cosine is low) and cosine (the best one; 0 for und)."""
    common.ship(docs.sparkSession)
    keep = common.beside(keep or ["doc_id"], ["lang_pred", "score", "cosine"])
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float32).reshape(len(names), DIM)
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def over(batches):
        common.claim("language", _clear)
        for b in batches:
            lang, score, best = [], [], []
            for t in b.column(b.num_columns - 1):
                v = vector(t.as_py())
                if v is None or not names:
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    best.append(0.0)
                    continue
                cos = (matrix @ v).astype(np.float64)
                e = np.exp((cos - cos.max()) * 10)
                lang.append(names[int(cos.argmax())])
                best.append(round(float(cos.max()), 6))
                score.append(round(float(e.max() / e.sum()) * min(1.0, 0.5 + max(0.0, float(cos.max()))), 6))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(best, pa.float64())], [*b.schema.names[:-1], "lang_pred", "score", "cosine"])

    return rows.mapInArrow(over, f"{schema}, lang_pred string, score double, cosine double")


def least_cosine(told: DataFrame, label: str = "lang") -> float:
    """A bound for the best cosine below which a text is of no learned language: half of the value that all but a
    hundredth of the labelled rows reach. told: rows of predict() with their label, read twice. All labelled rows are
    counted, in bins of a thousandth and then by value in one bin; cosines have six digits, so both lists are short."""
    rows = told.where((F.col("lang_pred") != UNKNOWN) & F.col(label).isNotNull()).select("cosine", F.floor(F.col("cosine") * BINS).alias("bin"))
    bins = sorted(rows.groupBy("bin").count().collect())
    rank = -(-sum(n for _, n in bins) // 100)
    for at, n in bins:
        if rank <= n:
            break
        rank -= n
    else:
        return 0.0
    for value, n in sorted(rows.where(F.col("bin") == at).groupBy("cosine").count().collect()):
        if rank <= n:
            return value / 2
        rank -= n
    raise ValueError("told gave other rows when it was read again")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    prototypes = fit(docs.where(~held_out()))
    return predict(docs, prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
