"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import conversations, exact_dedup, html_text, jaccard, licences, mixing, negatives, neighbours, packing, pii, quality, urls, wavelet

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_byte_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_wavelet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.wavelet_round_trip(table(spark, sf_dir, "documents"))


def op4_block_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op5_licence_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.summary(licences.licence_findings(table(spark, sf_dir, "documents")))


def op6_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


def op7_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_temporal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = urls.filter_captures(urls.page_captures(pages), urls.page_entries(pages))
    return judged.select(
        F.col("id").alias("page_id"), "url", F.unix_timestamp("fetched").alias("fetched"), "host", "matched", "action"
    )


def op9_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sizes(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "copies", "taken")


def op11_audit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


def op12_page_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op13_angular_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.shifted_labels(table(spark, sf_dir, "embeddings"))
    return negatives.hard_negatives(rows, "vec_id % 100 = 0")


def queries() -> dict[str, Query]:
    own = (
        op1_exact_dedup,
        op2_byte_quality,
        op3_wavelet_ids,
        op4_block_neighbours,
        op5_licence_classifier,
        op6_disclosure,
        op7_parity_join,
        op8_temporal_list,
        op9_lexical_packing,
        op10_mixing,
        op11_audit_repair,
        op12_page_difference,
        op13_angular_negatives,
    )
    return {query.__name__: query for query in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.OP1_SQL, "op4_block_neighbours": neighbours.OP4_SQL,
        "op8_temporal_list": urls.OP8_SQL,
        "op7_parity_join": jaccard.OP7_SQL, "op10_mixing": mixing.OP10_SQL,
        "op11_audit_repair": conversations.OP11_SQL, "op13_angular_negatives": negatives.OP13_SQL}
