"""Queries over pages: scans, counts, duplicates, writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import pages as P
from lorekeep.plans.fixtures import KB_PAGES, ORDER_PAGES, kb_pages, order_pages, table
from lorekeep.plans.registry import query

LIVE_LIMIT = 20


@query(f"""WITH {KB_PAGES}, live AS (SELECT * FROM kb_pages WHERE kb_id = 'src1' AND NOT deleted)
SELECT kb_id, slug, title, page_type, version, (SELECT count(*) FROM live) > {LIVE_LIMIT} AS truncated
FROM live ORDER BY slug LIMIT {LIVE_LIMIT}""")
def s1_live_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.live_pages(kb_pages(spark, sf_dir), F.col("kb_id") == "src1", LIVE_LIMIT)
    return found.select("kb_id", "slug", "title", "page_type", "version", "truncated")


@query(f"""WITH {KB_PAGES}
SELECT kb_id, slug, title, substr(content, 1, 1500) AS content FROM kb_pages WHERE NOT deleted
QUALIFY row_number() OVER (PARTITION BY kb_id ORDER BY slug) <= 5""")
def s2_pages_top_n_per_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pages_top_n(kb_pages(spark, sf_dir), 5).select("kb_id", "slug", "title", "content")


@query(f"""WITH {KB_PAGES} SELECT page_id, page_type,
  contains(page_type, ':') AND NOT starts_with(page_type, 'ontology:') AND page_type NOT IN ('index', 'summary') AS instance
FROM kb_pages""")
def p1_is_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb_pages(spark, sf_dir).select("page_id", "page_type", P.is_instance(F.col("page_type")).alias("instance"))


@query("""SELECT c_custkey, c_nationkey AS kb_id FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 5 <> 0)""")
def p13_live_kbs_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("kb_id"))
    kbs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("kb_id"), (F.col("n_nationkey") % 5 == 0).alias("deleted"))
    return P.live_kbs_only(rows, kbs)


@query("""SELECT c_custkey, c_nationkey AS kb_id, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON n_nationkey = c_nationkey""")
def j1_with_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    kbs = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("kb_id"), "n_name")
    return P.with_kb(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("kb_id")), kbs).select("c_custkey", "kb_id", "n_name")


@query(f"""WITH {KB_PAGES}
SELECT kb_id, count(*) AS pages,
       count(*) FILTER (contains(page_type, ':') AND NOT starts_with(page_type, 'ontology:') AND page_type NOT IN ('index', 'summary')) AS instance_pages,
       count(*) FILTER (starts_with(page_type, 'ontology:')) AS concept_pages
FROM kb_pages WHERE NOT deleted GROUP BY kb_id""")
def a2_kb_page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.kb_page_stats(kb_pages(spark, sf_dir))


@query(f"""WITH {ORDER_PAGES}, t AS (
  SELECT page_type, count(*) AS n, count(*) FILTER (len(source_refs) = 0) AS bare, avg(1 + slug % 3) AS version FROM order_pages GROUP BY page_type),
m AS (SELECT sum(n)::DOUBLE AS pages, sum(bare)::DOUBLE AS bare, count(*)::DOUBLE AS types, sum(version * n) / sum(n) AS mean FROM t),
h AS (SELECT *, md5('mean_version=' || mean::DECIMAL(20, 6) || ';pages=' || pages::DECIMAL(20, 6) || ';types=' || types::DECIMAL(20, 6) || ';without_source=' || bare::DECIMAL(20, 6)) AS hash FROM m)
SELECT 'pages' AS name, pages AS value, 'count of live pages' AS formula, hash FROM h
UNION ALL SELECT 'without_source', bare, 'count of pages without sources', hash FROM h
UNION ALL SELECT 'types', types, 'count of distinct types', hash FROM h
UNION ALL SELECT 'mean_version', mean, 'sum over types of mean version x pages / pages', hash FROM h""")
def a3_kb_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.kb_metrics(order_pages(spark, sf_dir).withColumn("version", 1 + F.col("slug") % 3))


@query("""SELECT l_orderkey, l_partkey, count(*) AS n, array_to_string(list_sort(list(l_linenumber)), ',') AS versions,
  array_to_string(list_sort(list(l_suppkey)), ',') AS ids
FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def a4_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"], "l_linenumber", "l_suppkey")


@query(f"""WITH {KB_PAGES} SELECT title, count(*) AS n_deleted FROM kb_pages WHERE deleted AND title IN (SELECT title FROM kb_pages WHERE NOT deleted) GROUP BY title""")
def j5_deleted_beside_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.deleted_beside_live(kb_pages(spark, sf_dir), "title")


@query(f"""WITH {KB_PAGES} SELECT kb_id, count(*) AS pages FROM kb_pages WHERE NOT deleted AND kb_id <> 'src1' AND page_type IN ('en:Doc', 'fr:Doc')
GROUP BY kb_id ORDER BY pages DESC, kb_id LIMIT 3""")
def o4_top_types_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_types_elsewhere(kb_pages(spark, sf_dir), "src1", ["en:Doc", "fr:Doc"])


@query(f"""WITH {KB_PAGES} SELECT title, slug, version, kb_id FROM kb_pages QUALIFY row_number() OVER (PARTITION BY title ORDER BY version DESC, slug) = 1""")
def w8_primary_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.primary_member(kb_pages(spark, sf_dir), "title").select("title", "slug", "version", "kb_id")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = kb_pages(spark, sf_dir).withColumn("refs", F.array(F.concat(F.lit("r"), F.col("page_id") % 5)))
    current = base.where("page_id % 10 < 7").select("kb_id", "slug", "content", "refs", "version")
    changed = F.when(F.col("page_id") % 2 == 0, F.concat("content", F.lit(" (changed)"))).otherwise(F.col("content"))
    return current, base.where("page_id % 10 > 3").select("kb_id", "slug", changed.alias("content"), "refs")


@query(f"""WITH {KB_PAGES}, base AS (SELECT *, ['r' || page_id % 5] AS refs FROM kb_pages),
cur AS (SELECT * FROM base WHERE page_id % 10 < 7),
inc AS (SELECT kb_id, slug, CASE WHEN page_id % 2 = 0 THEN content || ' (changed)' ELSE content END AS content, refs FROM base WHERE page_id % 10 > 3)
SELECT coalesce(c.kb_id, i.kb_id) AS kb_id, coalesce(c.slug, i.slug) AS slug, coalesce(i.content, c.content) AS content,
  list_sort(list_distinct(list_concat(coalesce(c.refs, []), coalesce(i.refs, [])))) AS refs,
  CASE WHEN c.slug IS NULL THEN 1 WHEN i.slug IS NULL OR i.content = c.content THEN c.version ELSE c.version + 1 END::BIGINT AS version,
  CASE WHEN c.slug IS NULL THEN 'created' WHEN i.slug IS NULL THEN 'kept' WHEN i.content = c.content THEN 'skipped' ELSE 'updated' END AS outcome,
  CASE WHEN c.slug IS NOT NULL AND i.content <> c.content THEN c.content END AS old_content
FROM cur c FULL JOIN inc i ON c.kb_id = i.kb_id AND c.slug = i.slug""")
def s11_upsert_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.upsert_pages(*_halves(spark, sf_dir))


@query(f"""WITH {KB_PAGES}, cur AS (SELECT kb_id, slug, content, CASE WHEN page_id % 3 = 0 THEN 'gen' END AS generator FROM kb_pages WHERE page_id % 10 < 7),
batch AS (SELECT kb_id, slug, 'new ' || title AS content, 'gen' AS generator FROM kb_pages WHERE page_id % 10 > 5)
SELECT * FROM cur WHERE generator IS NULL AND (kb_id, slug) NOT IN (SELECT (kb_id, slug) FROM batch) UNION ALL SELECT * FROM batch""")
def s12_replace_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = kb_pages(spark, sf_dir)
    current = base.where("page_id % 10 < 7").select("kb_id", "slug", "content", F.when(F.col("page_id") % 3 == 0, F.lit("gen")).alias("generator"))
    batch = base.where("page_id % 10 > 5").select("kb_id", "slug", F.concat(F.lit("new "), "title").alias("content"), F.lit("gen").alias("generator"))
    return P.replace_projection(current, batch, "gen")


@query(f"""WITH {KB_PAGES}, nodes AS (SELECT kb_id, slug, CASE WHEN page_id % 4 = 0 THEN 'node ' || title ELSE content END AS body FROM kb_pages WHERE page_id % 5 <> 0)
SELECT p.kb_id, p.slug, coalesce(n.body, p.content) AS content, coalesce(n.body, p.content) <> p.content AS changed
FROM kb_pages p LEFT JOIN nodes n ON n.kb_id = p.kb_id AND n.slug = p.slug""")
def s15_restore_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = kb_pages(spark, sf_dir)
    body = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("node "), "title")).otherwise(F.col("content"))
    nodes = base.where("page_id % 5 != 0").select("kb_id", "slug", body.alias("body"))
    return P.restore_pages(base.select("kb_id", "slug", "content"), nodes)
