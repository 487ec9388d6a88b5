"""Column expressions over text. All are built-in functions, so they stay in the JVM.

Lengths are UTF-8 bytes. Caps keep the first items in order of the text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CAP = 200  # items of a segment
RESIDUAL_CAP = 400
MIN_TOKEN = 6
_EDGE = "\"'(),;[]{}<>`"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numbers(text, cap: int | None = CAP) -> Column:
    """Distinct runs of two digits or more that no letter, underscore or (before) dot touches."""
    found = F.array_distinct(F.regexp_extract_all(_col(text), F.lit("(?<![A-Za-z_.0-9])([0-9]{2,})(?![A-Za-z_0-9])"), F.lit(1)))
    return F.slice(found, 1, cap) if cap else found


def artifacts(text, cap: int | None = CAP) -> Column:
    """Distinct paths and ids among the words."""
    words = F.filter(F.split(_col(text), r"(?U)\s+"), lambda w: w != "")
    trimmed = F.transform(words, lambda w: F.btrim(w, F.lit(_EDGE)))
    long = F.filter(trimmed, lambda w: F.octet_length(w) >= 4)

    def pick(w):
        path = F.substring_index(w, ":", 1)
        is_path = path.contains("/") & path.rlike("[A-Za-z0-9]")
        is_id = w.startswith("toolu_") | w.startswith("req_") | w.rlike("^[0-9A-Fa-f]{12,}$")
        return F.when(w.contains("/"), F.when(is_path, path)).when(is_id, w)

    found = F.array_distinct(F.filter(F.transform(long, pick), lambda w: w.isNotNull()))
    return F.slice(found, 1, cap) if cap else found


def lines(text) -> Column:
    """Lines without their ends; a final line break does not open another line."""
    t = _col(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(F.regexp_replace(t, "\r\n", "\n"), "\n$(?!\n)", ""), "\n"))


def grep_claims(text, cap: int = CAP) -> Column:
    """array<struct<location, content>> of lines `path:number:content`."""
    shaped = F.filter(lines(text), lambda x: x.rlike(r"^[^: \t]+:[0-9]+:") & F.substring_index(x, ":", 1).rlike("[/.]"))
    claims = F.transform(shaped, lambda x: F.struct(F.substring_index(x, ":", 2).alias("location"), F.regexp_replace(F.regexp_replace(x, r"^[^:]*:[0-9]+:", ""), r"(?U)^\s+|\s+$", "").alias("content")))
    return F.slice(claims, 1, cap)


def words(text) -> Column:
    """What stands between white space, in order; an empty text is one empty word."""
    return F.split(_col(text), r"(?U)\s+")


def trimmed(word) -> Column:
    """A word without outer marks."""
    return F.regexp_replace(_col(word), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def significant(text) -> Column:
    """Words without outer marks, of six bytes or more, in order."""
    long = lambda ws: F.filter(ws, lambda w: F.octet_length(w) >= MIN_TOKEN)
    return long(F.transform(long(words(text)), trimmed))


def residual(body_tokens, preview_tokens) -> Column:
    """Distinct tokens of a body that its preview lacks; the first 400."""
    return F.slice(F.array_except(F.array_distinct(_col(body_tokens)), _col(preview_tokens)), 1, RESIDUAL_CAP)


def size_band(tokens) -> Column:
    t = _col(tokens)
    return F.when(t < 500, "<500").when(t < 2000, "<2k").when(t < 8000, "<8k").otherwise("8k+")


def shape(body) -> Column:
    b = _col(body)
    matches = F.size(F.filter(F.split(b, "\n"), lambda x: x.rlike(r"^[^: ]*[/.][^: ]*:[0-9]+:")))
    return F.when(b.contains("diff --git"), "diff").when(matches >= 2, "search").otherwise("other")


PREVIEW_LABELS = ["diff summary", "match map", "code outline", "content table", "json index", "prose digest"]


def preview_kind(stub) -> Column:
    s = _col(stub)
    first = F.substring_index(s, "\n", 1)
    out = F.when(F.lit(False), "")
    for label in PREVIEW_LABELS:
        out = out.when(first.contains(f"offloaded, {label}"), label)
    return out.when(first.contains("offloaded, preview:"), "head").when(s.contains("less relevant to the query"), "relevance split").otherwise("other")


def is_modified(original, effective) -> Column:
    return _col(original).isNotNull() & (_col(original) != _col(effective))


def terms(text) -> Column:
    """Lower-cased words of three bytes or more."""
    return F.transform(F.filter(F.split(_col(text), r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) >= 3), F.lower)


def trigrams(words) -> Column:
    w = _col(words)
    each = F.transform(F.filter(w, lambda x: F.length(x) >= 3), lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.substring(x, i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def dir_of(path) -> Column:
    return F.regexp_extract(_col(path), "^(.*/)", 1)


def is_grep_shaped(line) -> Column:
    return _col(line).rlike(":[0-9]+:")


def masked_digits(line) -> Column:
    """struct<template, params>: the line with digit runs as slots, and the runs."""
    c = _col(line)
    return F.struct(F.regexp_replace(c, "[0-9]+", "\u0001").alias("template"), F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)).alias("params"))


def marker_id(text, prefix: str = "offload") -> Column:
    """The 16 hex digits of the first embedded marker, or empty."""
    return F.regexp_extract(_col(text), f"<<{prefix}:([0-9A-Fa-f]{{16}})>>", 1)


_KEYED = r"""(\.?)([A-Za-z_][A-Za-z0-9_-]*+)(?:[ "']*[=:][ "']*([0-9]++(?:\.[0-9]++|(?!\.))))?+"""


#: The same for Python code; findall gives (dot, key, number).
KEYED = re.compile(_KEYED)


def keyed_numbers(text, cap: int = CAP) -> Column:
    """array<struct<key, value>> of `key = 1.5` and `"key": 1`; keys that follow a dot don't count.

    The pattern takes every name whole, with its number if it has one, so that a name without one is
    passed over as a scanner would; names without a number or after a dot are then left out."""
    t = _col(text)
    got = [F.regexp_extract_all(t, F.lit(_KEYED), F.lit(i)) for i in (1, 2, 3)]
    rows = F.filter(F.arrays_zip(got[0].alias("dot"), got[1].alias("key"), got[2].alias("value")), lambda x: (x["dot"] == "") & (x["value"] != ""))
    return F.slice(F.transform(rows, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))), 1, cap)


def dominant_width(text, least: int = 2) -> Column:
    """The number of words that most lines have, among lines of `least` words or more; of equals the smaller; else null."""
    widths = F.filter(F.transform(lines(text), lambda x: F.size(F.regexp_extract_all(x, F.lit(r"(\S+)"), F.lit(1)))), lambda n: n >= least)
    counted = F.transform(F.array_distinct(widths), lambda n: F.struct(F.size(F.filter(widths, lambda m: m == n)).alias("lines"), (-n).alias("n")))
    return -F.array_max(counted)["n"]
