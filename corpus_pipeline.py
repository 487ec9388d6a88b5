"""A training corpus from the table `documents`: each stage takes all that its predecessor kept.

All stages but the last return the columns of documents; n_chars follows the text. Further columns of the input
are left out, whatever their names. Every stage takes whole texts, however long, and an empty table gives none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm import common, op1_lines, op3_near_duplicates, op5_packing, op6_decontamination, op7_language

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words in a shingle of the near-duplicate stage; op3 itself takes four.
SHINGLE = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (null and empty ones with them), and those less like any learned language
    than the bound that the labelled texts themselves give. Repeated rows and ties are judged one by one. Without
    labels no language is known, and all rows go."""
    prototypes = op7_language.fit(docs)
    told = common.written(op7_language.predict(docs.select(COLUMNS), prototypes, keep=COLUMNS), "told")
    least = op7_language.least_cosine(told)
    return told.where((F.col("lang_pred") != op7_language.UNKNOWN) & (F.col("cosine") >= least)).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops boilerplate lines; no row goes, so a text may be left empty. A null text stays null, and n_chars with it.
    Repeated rows count as pages of their own."""
    return op1_lines.drop_boilerplate(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the least doc_id of each group of linked rows. Texts without words, and null ones, are linked
    with nothing and stay, as do rows without doc_id. Where a doc_id repeats, rows are told apart by numbers of
    their own: of equal rows one stays, and different texts under one doc_id stay unless they are near copies."""
    own = docs.where("doc_id is not null")
    if not own.groupBy("doc_id").count().where("count > 1").take(1):
        gone = op3_near_duplicates.link(docs, SHINGLE).where("not kept").select("doc_id")
        return docs.select(COLUMNS).join(gone, "doc_id", "left_anti").select(COLUMNS)
    rows = common.written(docs.select(COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    linked = op3_near_duplicates.link(rows.where("doc_id is not null").select(F.col("row").alias("doc_id"), "text"), SHINGLE)
    linked = common.written(linked.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")), "linked")
    told = linked.join(rows.select("row", "doc_id"), "row")
    first = told.groupBy("component").agg(F.min(F.struct("doc_id", "row"))["row"].alias("first"))
    gone = linked.join(first, "component").where("row <> first").select("row")
    return rows.join(gone, "row", "left_anti").select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that are contaminated by op6's rule. Null and empty texts have no words, and stay; repeated rows are
    judged one by one."""
    found = op6_decontamination.decontaminate(docs, common.table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return found.where(~op6_decontamination.is_contaminated()).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places; a null or empty text is a piece of the end id alone, a repeated row has its own."""
    return op5_packing.pack(docs, with_ids=False)


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", packing),
]

#: SQL cannot express language identification, so neither what follows from it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.written(docs, f"pipeline-{name}")
    return docs
