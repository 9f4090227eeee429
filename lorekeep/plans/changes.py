"""Queries over references, renames and guarded clean-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import changes as C
from lorekeep.operators import graphs as G
from lorekeep.operators import lineage as L
from lorekeep.plans.fixtures import order_pages, part_docs, table
from lorekeep.plans.lineage import INDEX
from lorekeep.plans.registry import query

#: Pages of parts, and pages of orders that mention them; SQL that both engines read.
_PART = "'m/c' || p_partkey % 7 || '/p' || p_partkey"
_LINE = "'m/c' || l_partkey % 7 || '/p' || l_partkey"
TABLES = {
    "pages": f"SELECT {_PART} AS slug, 'm:C' || p_partkey % 7 AS page_type FROM {{part}} UNION ALL SELECT 'm/o/' || o_orderkey, 'm:O' FROM {{orders}} UNION ALL SELECT 'm/c' || (p_partkey + 1) % 7 || '/p' || p_partkey, 'm:X' FROM {{part}} WHERE p_partkey % 31 = 0",
    "edges": f"SELECT 'm/o/' || l_orderkey AS page, 'r' || l_suppkey % 4 AS rel, {_LINE} AS dst FROM {{lineitem}} WHERE l_linenumber = 1 UNION ALL SELECT {_LINE}, 'r' || l_suppkey % 4, 'm/c' || l_suppkey % 7 || '/p' || l_suppkey FROM {{lineitem}} WHERE l_linenumber = 2",
    "arrays": f"SELECT 'm/o/' || l_orderkey AS page, {_LINE} AS link FROM {{lineitem}} WHERE l_linenumber > 5",
    "bodies": f"SELECT 'm/o/' || l_orderkey AS page, CASE WHEN l_suppkey % 2 = 0 THEN 'see [x](wiki:' || {_LINE} || ') or so' ELSE 'and `' || {_LINE} || '` too' END AS text FROM {{lineitem}} WHERE l_linenumber = 3",
    "metadata": f"""SELECT 'm/o/' || l_orderkey AS page, '{{{{"n": ' || l_suppkey || ', "design": {{{{"upstream": ["x", "' || {_LINE} || '"]}}}}, "authority": {{{{"master": {{{{"slug": "' || {_LINE} || '"}}}}}}}}}}}}' AS json FROM {{lineitem}} WHERE l_linenumber = 4 AND l_suppkey % 3 > 0 UNION ALL SELECT 'm/o/' || o_orderkey, '{{{{"broken' FROM {{orders}}""",
}


def _text(name: str) -> str:
    return TABLES[name].format(part="part", orders="orders", lineitem="lineitem").replace("{{", "{").replace("}}", "}")


def _made(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    for n in ("part", "orders", "lineitem"):
        table(spark, sf_dir, n).createOrReplaceTempView(f"changes_{n}")
    out = []
    for name in names:
        sql = TABLES[name].format(part="changes_part", orders="changes_orders", lineitem="changes_lineitem").replace("{{", "{").replace("}}", "}")
        out.append(spark.sql(sql))
    return out


REFS = ", ".join(f"{n}_ AS ({_text(n)})" for n in TABLES) + r""", refs AS (
SELECT dst AS slug, page, 'relation_line' AS kind, rel AS detail FROM edges_
UNION ALL SELECT DISTINCT link, page, 'out_links', '' FROM arrays_
UNION ALL SELECT regexp_extract(text, '(?:wiki:|`)(m/c\d/p\d+)', 1), page, 'content_text', '' FROM bodies_
UNION ALL SELECT json_extract_string(atom, '$'), page, 'metadata', fullkey FROM (SELECT page, u.a AS atom, u.f AS fullkey FROM (SELECT page, unnest([{'f': '$.design.upstream[1]', 'a': json_extract(json, '$.design.upstream[1]')}, {'f': '$.authority.master.slug', 'a': json_extract(json, '$.authority.master.slug')}]) AS u FROM metadata_ WHERE json_valid(json)))),
found AS (SELECT * FROM refs WHERE page <> slug AND slug IN (SELECT """ + _PART + """ FROM part))"""


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pages, edges, arrays, bodies, metadata = _made(spark, sf_dir, *TABLES)
    slugs = table(spark, sf_dir, "part").select(F.expr(_PART).alias("slug"))
    links = arrays.groupBy("page").agg(F.collect_list("link").alias("links"))
    return C.slug_references(edges, links, bodies, metadata, slugs), pages, edges


@query(f"WITH {REFS} SELECT * FROM found")
def g18_slug_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _references(spark, sf_dir)[0]


@query(f"""WITH {REFS}, cls AS (SELECT 'm:C' || r AS class, CASE WHEN r = 5 THEN 'n' ELSE 'm' END AS module FROM range(6) t(r)),
asked AS (SELECT {_PART} AS slug, CASE p_partkey % 5 WHEN 0 THEN 'm:C' || p_partkey % 7 WHEN 1 THEN 'm:none' ELSE 'm:C' || (p_partkey + 1) % 7 END AS new_type, 'm:C' || p_partkey % 7 AS page_type, p_partkey AS k FROM part UNION ALL SELECT 'm/o/' || o_orderkey, 'm:C1', 'm:O', NULL FROM orders WHERE o_orderkey % 100 = 0),
n AS (SELECT a.*, module, CASE WHEN module IS NOT NULL THEN module || '/' || lower(split_part(new_type, ':', 2)) || '/' || split_part(slug, '/', 3) END AS new_slug FROM asked a LEFT JOIN cls ON class = new_type),
o AS (SELECT *, CASE WHEN module IS NULL THEN 'unknown_class' WHEN new_slug = slug AND new_type = page_type THEN 'already' ELSE 'rename' END AS outcome FROM n),
dom(rel, class) AS (VALUES ('r0', 'm:C0'), ('r1', 'm:C1'), ('r1', 'm:C3')), rng(rel, class) AS (VALUES ('r0', 'm:C1'), ('r2', 'm:C2')), up(node, ancestor) AS (SELECT 'm:C' || i, 'm:C' || j FROM range(7) a(i), range(7) b(j) WHERE i = j OR i = 2 * j + 1 AND j > 0 OR i > 0 AND j = 0),
own AS (SELECT DISTINCT slug, new_type, rel, dst FROM o JOIN edges_ ON page = slug WHERE outcome = 'rename'),
bad AS (SELECT DISTINCT slug, rel, dst FROM own WHERE rel IN (SELECT rel FROM dom) AND NOT EXISTS (SELECT 1 FROM dom JOIN up ON ancestor = class WHERE dom.rel = own.rel AND node = new_type)
  UNION SELECT slug, rel, dst FROM own JOIN pages_ p ON p.slug = dst WHERE rel IN (SELECT rel FROM rng) AND NOT EXISTS (SELECT 1 FROM rng JOIN up ON ancestor = class WHERE rng.rel = own.rel AND node = p.page_type)),
bad_fixed AS (SELECT slug, count(*) AS violations FROM (SELECT DISTINCT own.slug, rel, dst FROM bad JOIN own USING (slug, rel, dst)) GROUP BY 1),
c AS (SELECT slug, count(*) AS refs, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM found GROUP BY 1)
SELECT slug, coalesce(new_slug, '') AS new_slug, outcome, outcome = 'rename' AND new_slug <> slug AND new_slug IN (SELECT slug FROM pages_) AS conflict, coalesce(refs, 0) AS refs, coalesce(kinds, '') AS kinds, coalesce(violations, 0) AS violations,
  CASE WHEN outcome = 'rename' THEN array_to_string(list_filter([CASE WHEN new_slug <> slug THEN 'url_break' END, CASE WHEN refs > 0 THEN 'refs_rewrite' END, CASE WHEN violations > 0 THEN 'schema_violation' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS risks
FROM o LEFT JOIN c USING (slug) LEFT JOIN bad_fixed USING (slug)""".replace("JOIN pages_ p ON p.slug = dst WHERE rel", "JOIN pages_ p ON p.slug = own.dst WHERE rel").replace("SELECT slug, rel, dst FROM own JOIN", "SELECT own.slug, rel, dst FROM own JOIN"))
def g18_rename_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    references, pages, edges = _references(spark, sf_dir)
    k = F.col("p_partkey")
    new = F.when(k % 5 == 0, F.concat(F.lit("m:C"), k % 7)).when(k % 5 == 1, "m:none").otherwise(F.concat(F.lit("m:C"), (k + 1) % 7))
    asked = table(spark, sf_dir, "part").select(F.expr(_PART).alias("slug"), new.alias("new_type"))
    asked = asked.unionByName(table(spark, sf_dir, "orders").where("o_orderkey % 100 = 0").select(F.concat(F.lit("m/o/"), "o_orderkey").alias("slug"), F.lit("m:C1").alias("new_type")))
    seven = spark.range(7).withColumnRenamed("id", "i")
    classes = seven.where("i < 6").select(F.concat(F.lit("m:C"), "i").alias("class"), F.when(F.col("i") == 5, "n").otherwise("m").alias("module"))
    step = seven.where("i > 0").select(F.concat(F.lit("m:C"), "i").alias("child"), F.lit("m:C0").alias("parent")).unionByName(
        seven.where("i % 2 = 1 and i > 1").select(F.concat(F.lit("m:C"), "i").alias("child"), F.concat(F.lit("m:C"), F.expr("(i - 1) div 2")).alias("parent")))
    domains = spark.createDataFrame([("r0", "m:C0"), ("r1", "m:C1"), ("r1", "m:C3")], "rel string, class string")
    ranges = spark.createDataFrame([("r0", "m:C1"), ("r2", "m:C2")], "rel string, class string")
    return C.rename_plan(asked, pages, classes, references, edges, domains, ranges, G.ancestors(step))


CLEAN = f"""{INDEX}, ix AS (SELECT slug::VARCHAR AS slug, status FROM doc_index), pg AS (SELECT CASE WHEN slug = 8 THEN 'index' ELSE slug::VARCHAR END AS slug, slug % 13 = 0 AS deleted, slug % 10 = 1 AS imported, slug % 3 > 0 AS entity FROM order_pages),
rv AS (SELECT DISTINCT 'v' || l_orderkey || '-' || l_linenumber AS slug, (l_orderkey + l_linenumber * 1000)::VARCHAR AS page FROM lineitem WHERE l_linenumber > 4),
li AS (SELECT l_orderkey::VARCHAR AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place, 'r' AS rel, (l_orderkey + l_suppkey % 3 * (l_partkey % 700))::VARCHAR AS dst FROM lineitem),
nd AS (SELECT o_orderkey::VARCHAR AS slug FROM orders WHERE o_orderkey % 6 = 0 UNION ALL SELECT 'n' || s_suppkey FROM supplier),
live AS (SELECT * FROM pg WHERE NOT deleted), per AS (SELECT slug, count(*) AS n, count(*) FILTER (status <> 'live') AS gone FROM ix GROUP BY 1),
told AS (SELECT li.*, row_number() OVER (PARTITION BY page, rel, dst ORDER BY place) AS nth FROM li WHERE page IN (SELECT slug FROM live)),
plan AS (SELECT 'init' AS kind, 'page' AS part, slug AS subject, NULL::BIGINT AS place FROM pg WHERE slug <> 'index'
UNION ALL SELECT 'pages', 'no_source', slug, NULL FROM live LEFT JOIN per USING (slug) WHERE n IS NULL AND entity AND NOT imported
UNION ALL SELECT 'pages', CASE WHEN gone = n THEN 'deleted_source' ELSE 'mixed' END, slug, NULL FROM live JOIN per USING (slug) WHERE gone > 0
UNION ALL SELECT 'rows', 'soft_deleted', slug, NULL FROM pg WHERE deleted UNION ALL SELECT 'rows', 'orphan_revision', slug, NULL FROM rv WHERE page NOT IN (SELECT slug FROM pg)
UNION ALL SELECT 'edges', CASE WHEN dst NOT IN (SELECT slug FROM live) THEN 'dangling' WHEN dst = page THEN 'self_loop' ELSE 'repeated' END, page, place FROM told WHERE dst NOT IN (SELECT slug FROM live) OR dst = page OR nth > 1
UNION ALL SELECT 'graph', 'orphan_node', slug, NULL FROM nd WHERE slug NOT IN (SELECT slug FROM live))"""


def _tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    from pyspark.sql import Window

    o = order_pages(spark, sf_dir)
    slug, text = F.col("slug"), F.col("slug").cast("string")
    index = L.doc_index(o, part_docs(spark, sf_dir)).select(text.alias("slug"), "status")
    pages = o.select(F.when(slug == 8, "index").otherwise(text).alias("slug"), (slug % 13 == 0).alias("deleted"), (slug % 10 == 1).alias("imported"), (slug % 3 > 0).alias("entity"))
    lines = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    revisions = lines.where("l_linenumber > 4").select(F.concat(F.lit("v"), "l_orderkey", F.lit("-"), n).alias("slug"), (F.col("l_orderkey") + n * 1000).cast("string").alias("page")).distinct()
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    dst = F.col("l_orderkey") + F.col("l_suppkey") % 3 * (F.col("l_partkey") % 700)
    told = lines.select(F.col("l_orderkey").cast("string").alias("page"), place.cast("long").alias("place"), F.lit("r").alias("rel"), dst.cast("string").alias("dst"))
    nodes = table(spark, sf_dir, "orders").where("o_orderkey % 6 = 0").select(F.col("o_orderkey").cast("string").alias("slug")).unionByName(table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_suppkey").alias("slug")))
    return [pages, index, revisions, told, nodes]


@query(f"WITH {CLEAN} SELECT * FROM plan")
def c21_clean_up_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean_up_rows(*_tables(spark, sf_dir))


@query(f"""WITH {CLEAN}, gone AS (SELECT subject AS slug FROM plan WHERE kind IN ('pages', 'rows') AND part IN ('no_source', 'deleted_source', 'soft_deleted')), mixed AS (SELECT subject AS slug FROM plan WHERE part = 'mixed')
SELECT 'pages' AS "table", count(*) AS rows FROM pg WHERE slug NOT IN (SELECT slug FROM gone)
UNION ALL SELECT 'index', count(*) FROM ix WHERE slug NOT IN (SELECT slug FROM gone) AND NOT (status <> 'live' AND slug IN (SELECT slug FROM mixed))
UNION ALL SELECT 'revisions', count(*) FROM rv WHERE slug NOT IN (SELECT subject FROM plan WHERE part = 'orphan_revision') AND page NOT IN (SELECT slug FROM gone)
UNION ALL SELECT 'lines', count(*) FROM li WHERE NOT EXISTS (SELECT 1 FROM plan WHERE kind = 'edges' AND subject = page AND plan.place = li.place) AND page NOT IN (SELECT slug FROM gone)
UNION ALL SELECT 'nodes', count(*) FROM nd WHERE slug NOT IN (SELECT subject FROM plan WHERE kind = 'graph') AND slug NOT IN (SELECT slug FROM gone)""")
def c21_clean_up_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the plan, its check and what is left read the tables again and again: they are derived once
    tables, kinds = [G.settled(rows, "clean-up-tables") for rows in _tables(spark, sf_dir)], ["pages", "rows", "edges", "graph"]
    left = C.apply_clean_up(*tables, kinds, C.plan_id(C.clean_up_rows(*tables), kinds))
    return reduce(DataFrame.unionByName, [rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, rows in left.items()])
