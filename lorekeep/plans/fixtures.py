"""Knowledge-base tables projected from the driver tables, each with the same projection in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kb_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one knowledge base per source."""
    d = table(spark, sf_dir, "documents")
    kind = (
        F.when(F.col("doc_id") % 23 == 0, F.lit("index"))
        .when(F.col("doc_id") % 19 == 0, F.lit("ontology:Class"))
        .otherwise(F.concat("lang", F.lit(":Doc")))
    )
    return d.select(
        F.col("source").alias("kb_id"),
        F.concat("lang", F.lit("/doc/"), F.col("doc_id")).alias("slug"),
        F.substring("text", 1, 40).alias("title"),
        kind.alias("page_type"),
        F.col("text").alias("content"),
        F.substring("text", 41, 100).alias("summary"),
        (1 + F.col("doc_id") % 3).alias("version"),
        (F.col("doc_id") % 17 == 0).alias("deleted"),
        F.col("doc_id").alias("page_id"),
    )


KB_PAGES = """kb_pages AS (
  SELECT source AS kb_id, lang || '/doc/' || doc_id AS slug, substr(text, 1, 40) AS title,
         CASE WHEN doc_id % 23 = 0 THEN 'index' WHEN doc_id % 19 = 0 THEN 'ontology:Class' ELSE lang || ':Doc' END
           AS page_type,
         text AS content, substr(text, 41, 100) AS summary, 1 + doc_id % 3 AS version, doc_id % 17 = 0 AS deleted,
         doc_id AS page_id
  FROM documents
)"""


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose source references are the parts of an order: kb_id, slug, page_type, source_refs, updated."""
    refs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set("l_partkey")).alias("source_refs")
    )
    orders = table(spark, sf_dir, "orders").join(refs, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return orders.select(
        (F.col("o_orderkey") % 4).alias("kb_id"),
        F.col("o_orderkey").alias("slug"),
        F.col("o_orderpriority").alias("page_type"),
        F.coalesce("source_refs", F.array().cast("array<bigint>")).alias("source_refs"),
        F.col("o_orderdate").alias("updated"),
    )


ORDER_PAGES = """order_pages AS (
  SELECT o_orderkey % 4 AS kb_id, o_orderkey AS slug, o_orderpriority AS page_type,
         coalesce(refs, []) AS source_refs, o_orderdate AS updated
  FROM orders LEFT JOIN (
    SELECT l_orderkey, list_sort(list(DISTINCT l_partkey)) AS refs FROM lineitem GROUP BY ALL
  ) ON l_orderkey = o_orderkey
)"""


def part_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source documents: parts; a tenth is soft-deleted, an eleventh missing."""
    return table(spark, sf_dir, "part").where("p_partkey % 11 != 0").select(
        F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"), (F.col("p_partkey") % 10 == 0).alias("deleted")
    )


PART_DOCS = """part_docs AS (
  SELECT p_partkey AS doc_id, p_name AS title, p_partkey % 10 = 0 AS deleted FROM part WHERE p_partkey % 11 <> 0
)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kb_id, src, rel, dst of order lines, as they come: duplicates included."""
    lines = table(spark, sf_dir, "lineitem")
    kb = (F.col("l_orderkey") % 4).alias("kb_id")
    part = F.concat(F.lit("part/"), F.col("l_partkey"))
    has = lines.select(kb, F.concat(F.lit("order/"), F.col("l_orderkey")).alias("src"), F.lit("hasLine").alias("rel"), part.alias("dst"))
    by = lines.select(kb, part.alias("src"), F.lit("suppliedBy").alias("rel"), F.concat(F.lit("supplier/"), F.col("l_suppkey")).alias("dst"))
    return has.unionByName(by)


EDGES = """edges AS (
  SELECT l_orderkey % 4 AS kb_id, 'order/' || l_orderkey AS src, 'hasLine' AS rel, 'part/' || l_partkey AS dst FROM lineitem
  UNION ALL
  SELECT l_orderkey % 4, 'part/' || l_partkey, 'suppliedBy', 'supplier/' || l_suppkey FROM lineitem
)"""


def subclasses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """child, parent, first (the first-named parent): a class tree over the parts, with some second parents."""
    parts = table(spark, sf_dir, "part").where("p_partkey >= 1")
    first = parts.select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 4").alias("parent"), F.lit(True).alias("first"))
    second = parts.where("p_partkey % 13 = 0 and p_partkey div 9 != p_partkey div 4").select(
        F.col("p_partkey").alias("child"), F.expr("p_partkey div 9").alias("parent"), F.lit(False).alias("first")
    )
    return first.unionByName(second)


SUBCLASSES = """subclasses AS (
  SELECT p_partkey AS child, p_partkey // 4 AS parent, true AS first FROM part WHERE p_partkey >= 1
  UNION ALL
  SELECT p_partkey, p_partkey // 9, false FROM part WHERE p_partkey >= 1 AND p_partkey % 13 = 0 AND p_partkey // 9 <> p_partkey // 4
)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry of lookups from events: session, qid, tool, arm, version, hits, ms, queries, has_io, ts."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("call_id"),
        F.col("user_id").alias("session"),
        (k % 12).alias("qid"),
        F.col("event_type").alias("tool"),
        F.when(F.col("event_id") % 2 == 0, F.lit("hint")).otherwise(F.lit("plain")).alias("arm"),
        F.concat(F.lit("v"), F.col("event_id") % 5, F.lit("-b"), F.col("event_id") % 3).alias("version"),
        (k % 7).alias("hits"),
        F.floor(F.col("value") * 10).cast("long").alias("ms"),
        (1 + k % 3).alias("queries"),
        (F.col("event_id") % 4 != 0).alias("has_io"),
        (F.col("event_id") % 9 == 0).alias("degraded"),
        F.col("ts"),
    )


CALLS = """calls AS (
  SELECT event_id AS call_id, user_id AS session, k % 12 AS qid, event_type AS tool,
         CASE WHEN event_id % 2 = 0 THEN 'hint' ELSE 'plain' END AS arm,
         'v' || event_id % 5 || '-b' || event_id % 3 AS version, k % 7 AS hits, floor(value * 10)::BIGINT AS ms,
         1 + k % 3 AS queries, event_id % 4 <> 0 AS has_io, event_id % 9 = 0 AS degraded, ts
  FROM (SELECT *, json_extract_string(props, '$.k')::INTEGER AS k FROM events)
)"""
