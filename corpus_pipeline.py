"""A corpus from documents: quality, exact and near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import exact_dedup, jaccard, mixing, packing, quality
from lorekeep.llm.shared import free_name, stored, text_of

#: Near duplicates of the pipeline: shingles of five words, similarity 0.8 or more.
NEAR = {"width": 5, "num": 80, "den": 100}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from labels of rows that are not held out."""
    model, prior = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name(docs, "quality_score")
    return quality.score(docs, model, prior, name).where(F.col(name) >= 0.5).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of each group of equal texts that exact deduplication keeps; of repeated rows one."""
    keys = [free_name(docs, name) for name in ("of_doc", "of_text", "points")]
    marked = docs.withColumns(
        {
            keys[0]: F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
            keys[1]: exact_dedup.sha256(exact_dedup.normal_form(text_of())),
            keys[2]: F.char_length(text_of()),
        }
    )
    kept = exact_dedup.exact_dedup(docs).where("kept").select(
        F.coalesce(F.col("keep_id").cast("string"), F.lit("")).alias(keys[0]), F.col("text_sha256").alias(keys[1])
    )
    # the kept row of a group is its longest one, so of rows of one doc_id in a group the longest stays
    best = marked.groupBy(*keys[:2]).agg(F.max(keys[2]).alias(keys[2]))
    kept = kept.join(best, keys[:2])
    return marked.join(kept, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by similar shingles: the one with the smallest doc_id, of those the first one.

    Rows without doc_id come last, so such a row stays only where no row of its group has one.
    """
    row = free_name(docs, "row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    classes = jaccard.jaccard_classes(rows, **NEAR, row=row)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    kept = classes.groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.rid").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as systematic sampling takes it."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token windows, filled with lexical neighbours."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the classifier and the tokenizer; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{n}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {}
