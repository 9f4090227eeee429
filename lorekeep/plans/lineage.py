"""Queries over lineage, set differences and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import lineage as L
from lorekeep.plans.fixtures import EDGES, ORDER_PAGES, PART_DOCS, edges, order_pages, part_docs, table
from lorekeep.plans.registry import query

INDEX = f"""{ORDER_PAGES}, {PART_DOCS}, refs AS (
  SELECT kb_id, slug, page_type, updated, len(source_refs) AS n_refs, unnest(source_refs) AS doc_id FROM order_pages
), doc_index AS (
  SELECT r.*, CASE WHEN d.deleted IS NULL THEN 'missing' WHEN d.deleted THEN 'deleted' ELSE 'live' END AS status
  FROM refs r LEFT JOIN part_docs d USING (doc_id)
)"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.doc_index(order_pages(spark, sf_dir), part_docs(spark, sf_dir))


@query(f"WITH {INDEX} SELECT kb_id, slug, doc_id, n_refs, status FROM doc_index")
def j2_doc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).select("kb_id", "slug", "doc_id", F.col("n_refs").cast("long").alias("n_refs"), "status")


@query(f"""WITH {INDEX} SELECT doc_id, count(*) AS pages, count(*) FILTER (n_refs <= 1) AS exclusive_pages, count(DISTINCT page_type) AS types,
  min(updated) AS first_time, max(updated) AS last_time, max(status) AS status FROM doc_index GROUP BY doc_id""")
def a1_doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.doc_stats(_index(spark, sf_dir))


@query(f"""WITH {INDEX}, d AS (SELECT doc_id, max(status) AS status FROM doc_index GROUP BY 1) SELECT (SELECT count(*) FROM d) AS documents, (SELECT count(*) FROM d WHERE status = 'live') AS live, (SELECT count(*) FROM d WHERE status = 'deleted') AS deleted,
  (SELECT count(*) FROM d WHERE status = 'missing') AS missing, count(*) AS pages, count(*) FILTER (len(source_refs) = 0) AS without_source, sum(len(source_refs))::BIGINT AS citations FROM order_pages""")
def a1_doc_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.doc_totals(_index(spark, sf_dir), order_pages(spark, sf_dir))


@query(f"WITH {EDGES} SELECT DISTINCT * FROM edges WHERE rel = 'hasLine' AND dst NOT IN (SELECT 'part/' || p_partkey FROM part WHERE p_partkey % 11 <> 0)")
def j3_dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = part_docs(spark, sf_dir).select(F.concat(F.lit("part/"), F.col("doc_id")).alias("slug"))
    return L.dangling_edges(edges(spark, sf_dir).where("rel = 'hasLine'"), nodes).select("kb_id", "src", "rel", "dst")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 7 <> 0)")
def j4_orphan_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "orders").where("o_orderkey % 7 != 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return L.orphan_rows(table(spark, sf_dir, "lineitem"), owners, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH g AS (SELECT CASE WHEN l_partkey % 50 = 0 THEN ' ' ELSE 'part/' || l_partkey END AS slug FROM lineitem WHERE l_partkey % 3 <> 0),
l AS (SELECT 'part/' || p_partkey AS slug FROM part WHERE p_partkey % 11 <> 0)
SELECT 'graph_only' AS side, slug, 1::BIGINT AS n FROM (SELECT DISTINCT slug FROM g WHERE trim(slug) <> '' AND slug NOT IN (SELECT slug FROM l))
UNION ALL SELECT 'live_only', slug, 1 FROM (SELECT DISTINCT slug FROM l WHERE slug NOT IN (SELECT slug FROM g))
UNION ALL SELECT 'blank', '', count(*) FILTER (trim(slug) = '') FROM g""")
def u1_diff_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.when(F.col("l_partkey") % 50 == 0, F.lit(" ")).otherwise(F.concat(F.lit("part/"), F.col("l_partkey")))
    graph = table(spark, sf_dir, "lineitem").where("l_partkey % 3 != 0").select(slug.alias("slug"))
    live = part_docs(spark, sf_dir).select(F.concat(F.lit("part/"), F.col("doc_id")).alias("slug"))
    return L.diff_orphans(graph, live)


PLAN = f"""{ORDER_PAGES}, plan AS (
  SELECT kb_id, slug, len(list_filter(source_refs, lambda x: x % 7 < 3)) AS removed, list_filter(source_refs, lambda x: x % 7 >= 3) AS remaining
  FROM order_pages
), doomed_pages AS (SELECT *, CASE WHEN len(remaining) = 0 THEN 'delete' ELSE 'strip' END AS action FROM plan WHERE removed > 0)"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    doomed = table(spark, sf_dir, "part").where("p_partkey % 7 < 3").select(F.col("p_partkey").alias("doc_id"))
    return L.purge_plan(order_pages(spark, sf_dir), doomed)


@query(f"WITH {PLAN} SELECT kb_id, slug, removed, action, array_to_string(remaining, ',') AS remaining FROM doomed_pages")
def u2_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).withColumn("remaining", F.array_join("remaining", ","))


@query(f"WITH {PLAN} SELECT action, count(*) AS pages, sum(removed)::BIGINT AS \"references\" FROM doomed_pages GROUP BY action")
def u3_purge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.purge_totals(_plan(spark, sf_dir))


@query("""WITH a AS (SELECT o_orderkey AS path, o_orderstatus AS hash FROM orders WHERE o_orderkey % 10 < 8),
b AS (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS hash FROM orders WHERE o_orderkey % 10 > 2)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.hash <> b.hash THEN 'changed' ELSE 'unchanged' END AS change
FROM a FULL JOIN b ON a.path = b.path""")
def u4_manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 10 < 8").select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("hash"))
    changed = F.when(F.col("o_orderkey") % 6 == 0, F.lit("X")).otherwise(F.col("o_orderstatus"))
    return L.manifest_diff(old, o.where("o_orderkey % 10 > 2").select(F.col("o_orderkey").alias("path"), changed.alias("hash")))


@query("""WITH h AS (SELECT sha1(o_orderkey || chr(31) || o_orderstatus || chr(31) || o_orderpriority) AS h FROM orders)
SELECT count(*) AS rows, sha1(sum(('0x' || substr(h, 1, 12))::BIGINT)::VARCHAR || ':' || sum(('0x' || substr(h, 13, 12))::BIGINT)::VARCHAR) AS fingerprint FROM h""")
def a16_set_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.set_fingerprint(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 < 8),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 10 > 2)
SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' ELSE 'mismatch' END AS kind
FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s <> b.s""")
def j17_diff_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    changed = F.when(F.col("o_orderkey") % 6 == 0, F.lit("X")).otherwise(F.col("o_orderstatus"))
    return L.diff_tables(o.where("o_orderkey % 10 < 8"), o.where("o_orderkey % 10 > 2").withColumn("o_orderstatus", changed), "o_orderkey", ["o_orderstatus"])


@query(f"""WITH {EDGES}, t AS (SELECT DISTINCT src, rel, CASE WHEN substr(src, 7)::BIGINT % 40 = 0 THEN src ELSE dst END AS dst FROM edges WHERE rel = 'hasLine'),
have AS (SELECT DISTINCT src, rel, dst FROM edges WHERE rel = 'hasLine' AND kb_id < 2),
nodes AS (SELECT 'part/' || p_partkey AS slug FROM part WHERE p_partkey % 11 <> 0 UNION ALL SELECT 'order/' || o_orderkey FROM orders)
SELECT src, rel, dst, CASE WHEN src = dst THEN 'self_loop' WHEN src NOT IN (SELECT slug FROM nodes) OR dst NOT IN (SELECT slug FROM nodes) THEN 'missing_node'
  WHEN (src, rel, dst) IN (SELECT (src, rel, dst) FROM have) THEN 'present' ELSE 'new' END AS outcome FROM t""")
def s13_merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = edges(spark, sf_dir).where("rel = 'hasLine'")
    looped = F.when(F.substring("src", 7, 20).cast("long") % 40 == 0, F.col("src")).otherwise(F.col("dst"))
    nodes = part_docs(spark, sf_dir).select(F.concat(F.lit("part/"), F.col("doc_id")).alias("slug")).unionByName(
        table(spark, sf_dir, "orders").select(F.concat(F.lit("order/"), F.col("o_orderkey")).alias("slug")))
    return L.merge_edges(lines.where("kb_id < 2"), lines.withColumn("dst", looped), nodes)


@query("""WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS edge_id, l_orderkey % 997 AS src, 'r' AS rel, l_partkey % 997 AS dst FROM lineitem),
m AS (SELECT *, row_number() OVER (PARTITION BY src, rel, dst ORDER BY edge_id) AS n FROM e)
SELECT edge_id, CASE WHEN src = dst THEN 'self_loop' WHEN n > 1 THEN 'duplicate' WHEN dst % 20 = 0 THEN 'into_doomed' WHEN dst % 11 = 0 THEN 'dangling' END AS reason
FROM m WHERE src % 20 <> 0 AND (src = dst OR n > 1 OR dst % 20 = 0 OR dst % 11 = 0)""")
def g17_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"),
        (F.col("l_orderkey") % 997).alias("src"), F.lit("r").alias("rel"), (F.col("l_partkey") % 997).alias("dst"))
    nodes = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 997).alias("slug")).distinct()
    return L.cascade_delete(e, nodes.where("slug % 20 = 0"), nodes.where("slug % 11 != 0"))


@query("""WITH e AS (SELECT l_partkey AS src, CASE WHEN l_returnflag = 'A' THEN 'covers' WHEN l_returnflag = 'N' THEN 'appliesTo' ELSE 'other' END AS rel, l_suppkey AS dst FROM lineitem)
SELECT policy, rule FROM (SELECT src AS policy, dst AS rule FROM e WHERE rel <> 'other' UNION SELECT dst, src FROM e WHERE rel <> 'other')""")
def j8_rules_of_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = F.when(F.col("l_returnflag") == "A", "covers").when(F.col("l_returnflag") == "N", "appliesTo").otherwise("other")
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), rel.alias("rel"), F.col("l_suppkey").alias("dst"))
    policies = e.select(F.col("src").alias("policy")).unionByName(e.select(F.col("dst").alias("policy"))).distinct()
    return L.rules_of_policies(e, policies, ["covers", "appliesTo"])


@query("""WITH p AS (SELECT page_id, list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS urls FROM pages), c AS (SELECT page_id, unnest(urls) AS url FROM p),
cache AS (SELECT DISTINCT url FROM c WHERE page_id % 3 = 0)
SELECT url, count(*) AS pages FROM c WHERE url <> '' AND url NOT IN (SELECT url FROM cache) GROUP BY url""")
def j21_missing_fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)).alias("urls"))
    cache = p.where("page_id % 3 = 0").select(F.explode("urls").alias("url")).distinct()
    return L.missing_fetch_log(p, cache)


@query(f"""WITH {EDGES}, n AS (SELECT 'part/' || p_partkey AS slug, p_type AS page_type FROM part UNION ALL SELECT 'supplier/' || s_suppkey, 'supplier' FROM supplier),
kept AS (SELECT * FROM n WHERE page_type <> 'PROMO' ORDER BY slug LIMIT 1500),
e AS (SELECT DISTINCT src, rel, dst FROM edges), i AS (SELECT k.page_type, rel FROM e JOIN kept k ON k.slug = e.src WHERE e.dst IN (SELECT slug FROM kept))
SELECT page_type, count(*) AS nodes, coalesce(any_value(o.edges_out), 0)::BIGINT AS edges_out, coalesce(any_value(o.relations), '') AS relations
FROM kept LEFT JOIN (SELECT page_type, count(*) AS edges_out, array_to_string(list_sort(list(DISTINCT rel)), ',') AS relations FROM i GROUP BY 1) o USING (page_type) GROUP BY page_type""")
def a21_graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.concat(F.lit("part/"), F.col("p_partkey")).alias("slug"), F.col("p_type").alias("page_type")).unionByName(
        table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier/"), F.col("s_suppkey")).alias("slug"), F.lit("supplier").alias("page_type")))
    types = [r.page_type for r in nodes.select("page_type").distinct().collect() if r.page_type != "PROMO"]  # a handful
    return L.graph_summary(nodes.withColumn("model", F.lit("kb")), edges(spark, sf_dir).select("src", "rel", "dst"), 1500, "kb", types)
