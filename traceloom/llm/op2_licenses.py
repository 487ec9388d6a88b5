"""License scan of paragraphs: a sparse word n-gram logistic regression, confirmed by templates.

The fit runs on the driver over a fixed set of license statements (TEMPLATES, and their wordings by
`examples`) and at most BACKGROUND first paragraphs of documents without any word of HINTS, those with the least
hash of key and text. Features are word bigrams and trigrams of the statements with a word that the background lacks. A multinomial logistic regression gives
a logit to each family and to `unknown`; a temperature fitted on held-out wordings calibrates it. A paragraph
whose best family has a probability below CERTAIN is of class `unknown`.

A prediction is confirmed if the paragraph has at least TEMPLATE_SHARE of the word bigrams of one of the
family's statements that are features. Scoring uses DataFrame functions alone: only documents, then paragraphs
with a word of theirs that the background lacks can have a feature, and all others are `unknown` by the bias;
their n-grams meet the weights (at most a few thousand rows, so they are broadcast). A paragraph is a line. Adjacent lines
that are not confirmed by themselves are also scored as one text, with the n-grams over their breaks; where that is
confirmed, it stands for its lines, under the number of the first. Nulls and empty texts have none; repeated rows give
rows each.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceloom.llm import common

BACKGROUND = 1000
CERTAIN, TEMPLATE_SHARE = 0.6, 0.6
UNKNOWN = "unknown"
HINTS = "licen|copyright|warrant|permission|redistribut|public domain|rights reserved"

#: Usual short statements of each family; {v} is a version.
TEMPLATES = {
    "apache": ["licensed under the apache license, version {v}", "you may not use this file except in compliance with the license you may obtain a copy of the license at"],
    "mit": ["released under the mit license", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "bsd": ["released under the bsd license", "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "gpl": ["this work is licensed under the gnu general public license, version {v}", "it under the terms of the gnu general public license as published by the free software foundation"],
    "lgpl": ["this library is licensed under the gnu lesser general public license, version {v}", "it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license, v. {v}"],
    "cc-by": ["licensed under cc by {v}", "this work is licensed under a creative commons attribution {v} international license"],
    "cc-by-sa": ["licensed under cc by-sa {v}", "this work is licensed under a creative commons attribution-sharealike {v} international license"],
    "cc-by-nc": ["licensed under cc by-nc {v}", "this work is licensed under a creative commons attribution-noncommercial {v} international license"],
    "cc0": ["dedicated to the public domain under cc0 {v}", "to the extent possible under law, the author has waived all copyright and related rights"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "proprietary": ["all rights reserved", "all rights reserved no part of this publication may be reproduced without prior written permission"],
}
FAMILIES = sorted(TEMPLATES)
VERSIONS = ["1.0", "1.1", "2.0", "2.1", "3.0", "4.0", "2", "3"]
OPENINGS = ["", "this file is ", "this project is ", "the code is ", "note: "]
CLOSINGS = ["", " see the license file for details", " or later"]


def words(text: str) -> list[str]:
    return re.findall(r"[a-z]+", text.lower())


def grams(w: list[str]) -> set[str]:
    return {" ".join(w[i : i + n]) for n in (2, 3) for i in range(len(w) - n + 1)}


def examples() -> list[tuple[str, str]]:
    return [(f, o + t.format(v=v) + c) for f in FAMILIES for t in TEMPLATES[f] for v in (VERSIONS if "{v}" in t else VERSIONS[:1]) for o in OPENINGS for c in CLOSINGS]


def train(background: list[str], rounds: int = 400) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Weights by feature, biases (the last is `unknown`), temperature."""
    rows = [(FAMILIES.index(f), grams(words(t))) for f, t in examples()]
    common_words = {w for t in background for w in words(t)}
    vocabulary = sorted({g for _, x in rows for g in x if not common_words.issuperset(g.split())})
    rows = [(f, x & set(vocabulary)) for f, x in rows]
    rows += [(len(FAMILIES), grams(words(t)) & set(vocabulary)) for t in background]
    # a bare statement as often as the part of it that is unknown
    rows += [(FAMILIES.index("proprietary"), grams(words("all rights reserved")) & set(vocabulary)) for _ in range(4)]
    # statements that lack a family's own words are unknown too
    rows += [(len(FAMILIES), grams(words(t)) & set(vocabulary)) for t in ("licensed under the", "released under the", "this work is licensed under", "all rights", "public domain", "free of charge", "general public", "the terms of the", "version") for _ in range(4)]
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    place = {g: i for i, g in enumerate(vocabulary)}
    for i, (_, found) in enumerate(rows):
        x[i, [place[g] for g in found]] = 1
    y = np.eye(len(FAMILIES) + 1, dtype=np.float32)[[k for k, _ in rows]]
    held = np.arange(len(rows)) % 5 == 0
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)

    def soft(z):
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    n = (~held).sum()
    for _ in range(rounds):
        d = (soft(x[~held] @ w + b) - y[~held]) / n
        w -= 8 * (x[~held].T @ d + 1e-5 * w)
        b -= 8 * d.sum(0)
    z = x[held] @ w + b
    heats = np.linspace(0.3, 3, 28)
    loss = [-np.log((soft(z / t) * y[held]).sum(1) + 1e-9).mean() for t in heats]
    return {g: w[i] for g, i in place.items()}, b, float(heats[int(np.argmin(loss))])


def paragraphs(docs: DataFrame) -> DataFrame:
    """The columns of docs but text, paragraph (its number), w: its words."""
    kept = [c for c in docs.columns if c != "text"]
    lines = docs.select(*kept, F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    return lines.select(*kept, "paragraph", F.expr("regexp_extract_all(lower(line), '[a-z]+', 0)").alias("w")).where("size(w) > 0")


def stretches(lines: DataFrame) -> DataFrame:
    """doc_row, doc_id, paragraph (the first that is `own`), last, w: each run of adjacent lines as one text."""
    runs = lines.withColumn("run", F.col("paragraph") - F.row_number().over(Window.partitionBy("doc_row").orderBy("paragraph")))
    got = runs.groupBy("doc_row", "doc_id", "run").agg(F.min(F.when(F.col("own"), F.col("paragraph"))).alias("paragraph"), F.max("paragraph").alias("last"), F.array_sort(F.collect_list(F.struct(F.col("paragraph").alias("p"), "w"))).alias("l"))
    return got.where("size(l) > 1 and paragraph is not null").select("doc_row", "doc_id", "paragraph", "last", F.flatten("l.w").alias("w"))


def scan(docs: DataFrame) -> DataFrame:
    """Paragraphs that a family or no class surely wins: doc_id, paragraph, family, probability, template_share,
    confirmed. Those that `unknown` itself wins surely are ordinary text and not listed."""
    spark = docs.sparkSession
    clean = docs.where(F.col("text").isNotNull() & ~F.lower("text").rlike(HINTS)).select("doc_id", F.element_at(F.split("text", "\n"), 1).alias("t"))
    # a share of the hash's range that is expected to hold a few times as many, so that tasks send few rows
    cut = -(2.0**63) + 2.0**64 * min(1.0, 8 * BACKGROUND / max(1, docs.count()))
    drawn = clean.select(F.substring("t", 1, 2000).alias("t"), F.xxhash64("doc_id", "t").alias("h")).where(F.col("h").cast("double") < cut)
    background = [r[0] for r in drawn.orderBy("h", "t").limit(BACKGROUND).collect()]
    weights, bias, heat = train(background)
    classes = [*FAMILIES, UNKNOWN]
    table = spark.createDataFrame([(g, [float(v) for v in w]) for g, w in weights.items()], "gram string, weight array<double>")

    common_words = {w for t in background for w in words(t)}
    telling = F.array(*map(F.lit, sorted({w for g in weights for w in g.split()} - common_words)))
    able = docs.where(F.arrays_overlap(F.split(F.lower("text"), "[^a-z]+"), telling))
    lines = paragraphs(able.select(F.monotonically_increasing_id().alias("doc_row"), "doc_id", "text")).withColumn("own", F.arrays_overlap("w", telling))
    # lines beside a telling one may be of its statement
    beside = F.max("own").over(Window.partitionBy("doc_row").orderBy("paragraph").rangeBetween(-1, 1))
    lines = common.written(lines.withColumn("near", beside).where("near").drop("near"), "lines")
    shares = {f: [{g for g in grams(words(t.format(v=""))) if g.count(" ") == 1 and g in weights} or {""} for t in TEMPLATES[f]] for f in FAMILIES}
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.slice("w", i, 2)))
    triples = F.when(F.size("w") > 2, F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.concat_ws(" ", F.slice("w", i, 3)))).otherwise(F.array().cast("array<string>"))
    z = [(F.col(f"z{i}") + float(bias[i])) / heat for i in range(len(classes))]
    top = F.greatest(*z)
    key = ["doc_row", "doc_id", "paragraph"]

    def scored(rows: DataFrame) -> DataFrame:
        hits = rows.where("size(w) > 1").select(*key, F.explode(F.array_distinct(F.concat(pairs, triples))).alias("gram")).join(F.broadcast(table), "gram")
        logits = hits.groupBy(*key).agg(
            *[F.sum(F.col("weight")[i]).alias(f"z{i}") for i in range(len(classes))],
            *[(F.sum(F.col("gram").isin(sorted(s)).cast("int")) / len(s)).alias(f"s{i}_{j}") for i, f in enumerate(FAMILIES) for j, s in enumerate(shares[f])],
        )
        got = logits.select(*key, F.array_max(F.array(*[F.struct(z[i].alias("z"), F.lit(-i).alias("i")) for i in range(len(classes))])).alias("best"), F.round(1 / sum(F.exp(v - top) for v in z), 6).alias("probability"), *[F.greatest(*[F.col(f"s{i}_{j}") for j in range(len(shares[f]))], F.lit(0.0)).alias(f"s{i}") for i, f in enumerate(FAMILIES)])
        k = -F.col("best.i")
        got = got.where((k < len(FAMILIES)) | (F.col("probability") < CERTAIN))
        sure = (F.col("probability") >= CERTAIN) & (k < len(FAMILIES))
        family = F.when(sure, F.element_at(F.array(*map(F.lit, classes)), k + 1)).otherwise(F.lit(UNKNOWN))
        share = F.round(F.when(k < len(FAMILIES), F.element_at(F.array(*[F.col(f"s{i}") for i in range(len(FAMILIES))], F.lit(0.0)), k + 1)).otherwise(0.0), 6)
        return got.select(*key, family.alias("family"), "probability", share.alias("template_share"), (sure & (share >= TEMPLATE_SHARE)).alias("confirmed"))

    alone = common.written(scored(lines.where("own")), "alone")
    joined = common.written(stretches(lines.join(alone.where("confirmed").select("doc_row", "paragraph"), ["doc_row", "paragraph"], "left_anti")), "stretches")
    together = common.written(scored(joined).where("confirmed").join(joined.select("doc_row", "paragraph", "last"), ["doc_row", "paragraph"]), "together")
    covers = together.select(F.col("doc_row").alias("row"), F.col("paragraph").alias("first"), "last")
    rest = alone.join(covers, F.expr("doc_row = row and not confirmed and paragraph between first and last"), "left_anti")
    return rest.unionByName(together.drop("last")).drop("doc_row")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
