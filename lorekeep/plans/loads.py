"""Queries over structured loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import loads as L
from lorekeep.plans.fixtures import table
from lorekeep.plans.registry import query

PART_HEADER = {"p_partkey": "key", "p_name": "name", "p_brand": "kind", "p_type": "name", "p_size": "size", "note": "note"}


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", '{n}' AS header, {list(PART_HEADER.values()).count(n) > 1} AS duplicate, count(nullif(trim({c}::VARCHAR), '')) = 0 AS empty, count(nullif(trim({c}::VARCHAR), '')) AS filled, count(DISTINCT nullif(trim({c}::VARCHAR), '')) AS distinct_values,
count(nullif(trim({c}::VARCHAR), '')) > 0 AND count(nullif(trim({c}::VARCHAR), '')) = count(DISTINCT nullif(trim({c}::VARCHAR), '')) AS is_unique, (SELECT string_agg(coalesce(trim({c}::VARCHAR), ''), '|' ORDER BY p_partkey) FROM (SELECT *, ' ' AS note FROM part ORDER BY p_partkey LIMIT 3)) AS sample FROM (SELECT *, ' ' AS note FROM part)""" for c, n in PART_HEADER.items()))
def a22_sheet_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sheet_profile(table(spark, sf_dir, "part").withColumn("note", F.lit(" ")), PART_HEADER, "p_partkey")


@query("""WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS row_no, CASE WHEN l_partkey % 50 = 0 THEN ' ' ELSE 'p' || l_partkey END AS k FROM lineitem),
m AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY row_no) AS place FROM s)
SELECT CASE WHEN trim(k) = '' THEN 'no_key' WHEN place > 1 THEN 'duplicate' WHEN k IN (SELECT 'p' || p_partkey FROM part WHERE p_partkey % 2 = 0) THEN 'update' ELSE 'create' END AS outcome, count(*) AS rows FROM m GROUP BY 1""")
def l1_plan_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.when(F.col("l_partkey") % 50 == 0, F.lit(" ")).otherwise(F.concat(F.lit("p"), "l_partkey"))
    sheet = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"), k.alias("k"))
    existing = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("key"))
    return L.plan_entities(sheet, "k", existing)


@query("""WITH p AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem), n AS (SELECT 'p' || p_partkey AS slug FROM part WHERE p_partkey % 11 <> 0 UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT CASE WHEN a AND b THEN 'resolvable' WHEN b THEN 'no_source' WHEN a THEN 'no_target' ELSE 'neither' END AS state, count(*) AS pairs FROM (SELECT src IN (SELECT slug FROM n) AS a, dst IN (SELECT slug FROM n) AS b FROM p) GROUP BY 1""")
def l2_plan_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    nodes = table(spark, sf_dir, "part").where("p_partkey % 11 != 0").select(F.concat(F.lit("p"), "p_partkey").alias("slug")).unionByName(
        table(spark, sf_dir, "supplier").where("s_suppkey % 7 != 0").select(F.concat(F.lit("s"), "s_suppkey").alias("slug")))
    return L.plan_relations(pairs, nodes)


@query("""WITH c AS (SELECT p_partkey AS slug, p_name AS attrs, CASE WHEN p_partkey % 3 = 0 THEN 'imp' END AS tag FROM part WHERE p_partkey % 10 < 7), b AS (SELECT p_partkey AS slug, CASE WHEN p_partkey % 4 = 0 THEN p_name || '!' ELSE p_name END AS attrs FROM part WHERE p_partkey % 10 > 3)
SELECT coalesce(c.slug, b.slug) AS slug, CASE WHEN c.slug IS NULL THEN 'created' WHEN b.slug IS NOT NULL AND c.attrs = b.attrs THEN 'skipped' WHEN b.slug IS NOT NULL THEN 'updated' WHEN tag = 'imp' THEN 'pruned' ELSE 'kept' END AS outcome FROM c FULL JOIN b ON c.slug = b.slug""")
def l3_apply_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("slug", F.col("p_partkey"))
    current = p.where("p_partkey % 10 < 7").select("slug", F.col("p_name").alias("attrs"), F.when(F.col("slug") % 3 == 0, "imp").alias("tag"))
    attrs = F.when(F.col("slug") % 4 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))
    return L.apply_entities(current, p.where("p_partkey % 10 > 3").select("slug", attrs.alias("attrs")), "imp")


@query("""WITH l AS (SELECT l_partkey AS src, list_sort(list(DISTINCT 's' || l_suppkey)) AS old FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1), n AS (SELECT l_partkey AS src, list(DISTINCT 's' || l_suppkey) AS new FROM lineitem WHERE l_linenumber > 1 GROUP BY 1),
u AS (SELECT src, coalesce(old, []) AS old, list_sort(list_distinct(list_concat(coalesce(old, []), new))) AS merged FROM n LEFT JOIN l USING (src))
SELECT src, (len(merged) - len(old))::INTEGER AS added, array_to_string(merged, ',') AS targets FROM u""")
def l4_apply_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), "l_linenumber")
    lines = p.where("l_linenumber <= 2").groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("targets"))
    return L.apply_relations(lines, p.where("l_linenumber > 1"))


@query("""SELECT user_id AS batch, array_to_string(list_sort(coalesce(list(DISTINCT event_type) FILTER (event_id % 40 = 7), [])), ',') AS remaining, count(*) FILTER (event_id % 40 = 7) = 0 AS done FROM events GROUP BY user_id""")
def l5_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_id") % 40 == 7, "open").otherwise("done")
    return L.ledger(table(spark, sf_dir, "events").select(F.col("user_id").alias("batch"), F.col("event_type").alias("target"), status.alias("status")))


@query("""WITH i AS (SELECT DISTINCT l_orderkey AS review, 'P-' || l_linenumber AS item, l_returnflag AS verdict FROM lineitem WHERE l_orderkey % 3 < 2), i1 AS (SELECT review, item, min(verdict) AS verdict FROM i GROUP BY ALL),
n AS (SELECT l_orderkey AS review, CASE WHEN l_partkey % 30 = 0 THEN '' ELSE 'P-' || l_linenumber END AS item, CASE WHEN l_suppkey % 20 = 0 THEN 'Z' ELSE l_returnflag END AS verdict FROM lineitem WHERE l_orderkey % 3 > 0)
SELECT review, item, CASE WHEN item = '' THEN 'no_key' WHEN n.verdict NOT IN ('A', 'N', 'R') THEN 'bad_verdict' WHEN i1.verdict IS NULL THEN 'create' WHEN i1.verdict = n.verdict THEN 'same' ELSE 'update' END AS outcome FROM n LEFT JOIN i1 USING (review, item)""")
def l7_batch_upsert_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").withColumn("review", F.col("l_orderkey")).withColumn("item", F.concat(F.lit("P-"), "l_linenumber"))
    items = p.where("l_orderkey % 3 < 2").groupBy("review", "item").agg(F.min("l_returnflag").alias("verdict"))
    new = p.where("l_orderkey % 3 > 0").select("review", F.when(F.col("l_partkey") % 30 == 0, "").otherwise(F.col("item")).alias("item"), F.when(F.col("l_suppkey") % 20 == 0, "Z").otherwise(F.col("l_returnflag")).alias("verdict"))
    return L.batch_upsert_items(items, new, ["A", "N", "R"])


@query("""WITH t AS (SELECT p_brand AS term, unnest([split_part(p_name, ' ', 1), upper(p_type), '']) AS alias FROM part), a AS (SELECT lower(trim(alias)) AS alias, list_sort(list(DISTINCT term)) AS terms FROM t WHERE alias <> '' GROUP BY 1)
SELECT alias, array_to_string(terms, ',') AS terms, len(terms) > 1 AS conflict FROM a""")
def a20_alias_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return L.alias_index(p.select(F.col("p_brand").alias("term"), F.array(F.element_at(F.split("p_name", " "), 1), F.upper("p_type"), F.lit("")).alias("aliases")))
