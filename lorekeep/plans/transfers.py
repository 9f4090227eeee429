"""Queries over datasets that are exported and imported, and over folder trees and categories that are kept in step."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import folders as D
from lorekeep.operators import transfers as X
from lorekeep.operators.graphs import shared_folder
from lorekeep.plans.fixtures import KB_PAGES, kb_pages, table
from lorekeep.plans.registry import query

_UP = "CAST((p_partkey - p_partkey % 4) / 4 AS BIGINT)"
#: The tables of a base that is exported, in SQL that both engines read; then what the target holds.
SOURCE = {
    "folders": f"SELECT 'f' || p_partkey AS id, CASE WHEN p_partkey > 0 THEN 'f' || {_UP} END AS parent_id, 'n' || p_partkey AS path, p_partkey % 17 = 0 AS deleted FROM {{part}}",
    "pages": "SELECT 'o' || o_orderkey AS id, 'f' || o_custkey AS folder_id, 's' || o_orderkey AS slug, o_orderpriority AS title, CAST(o_orderkey % 3 AS INT) AS version, o_orderkey % 13 = 0 AS deleted FROM {orders}",
    "revisions": "SELECT DISTINCT 'r' || l_orderkey || '-' || l_partkey AS id, 'o' || l_orderkey AS page_id, 's' || l_orderkey AS slug, l_linenumber AS version FROM {lineitem}",
}
TARGET = {
    "folders": "SELECT 'x' || p_partkey AS id, NULL AS parent_id, 'n' || p_partkey * 3 AS path, 'kb9' AS kb_id FROM {part} WHERE p_partkey % 5 = 0",
    "pages": "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'y' ELSE 'o' END || o_orderkey AS id, 'f1' AS folder_id, 's' || o_orderkey AS slug, 'old' AS title, 9 AS version, CASE WHEN o_orderkey % 2 = 0 THEN 'kb9' ELSE 'kb1' END AS kb_id FROM {orders} WHERE o_orderkey % 7 < 2",
    "revisions": "SELECT 'z' || o_orderkey AS id, 'y' || o_orderkey AS page_id, 's' || o_orderkey * 2 AS slug, 1 AS version, 'kb9' AS kb_id FROM {orders} WHERE o_orderkey % 9 = 0",
}
SCHEMAS = {"folders": "id string, parent_id string, path string", "pages": "id string, folder_id string, slug string, title string, version int", "revisions": "id string, page_id string, slug string, version int"}
_NAMES = ("part", "orders", "lineitem")


def _made(spark: SparkSession, sf_dir: str, texts: dict[str, str]) -> dict[str, DataFrame]:
    found = {n: table(spark, sf_dir, n) for n in _NAMES}
    return {name: spark.sql(text, **{k: v for k, v in found.items() if f"{{{k}}}" in text}) for name, text in texts.items()}


def _ctes(texts: dict[str, str], mark: str) -> str:
    return ", ".join(f"{name}_{mark} AS ({text.format(part='part', orders='orders', lineitem='lineitem')})" for name, text in texts.items())


def _exported(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex[:12]}"
    X.export_dataset(_made(spark, sf_dir, SOURCE), path)
    return X.read_dataset(spark, path, SCHEMAS)


def _digest(*columns: str) -> str:
    fields = ", ".join(f"coalesce({c}::VARCHAR, chr(0))" for c in sorted(columns))
    return f"count(*) AS rows, coalesce(sum(('0x' || substr(md5(concat_ws(chr(31), {fields})), 1, 12))::BIGINT), 0)::VARCHAR AS checksum"


@query(f"""WITH {_ctes(SOURCE, "s")} SELECT 'folders' AS "table", {_digest("id", "parent_id", "path")} FROM folders_s WHERE NOT deleted
UNION ALL SELECT 'pages', {_digest("id", "folder_id", "slug", "title", "version")} FROM pages_s WHERE NOT deleted UNION ALL SELECT 'revisions', {_digest("id", "page_id", "slug", "version")} FROM revisions_s""")
def s8_export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.manifest(_exported(spark, sf_dir))  # of what was read back


@query(f"""WITH {_ctes(SOURCE, "s")}, {_ctes(TARGET, "t")}, f AS (SELECT * FROM folders_s WHERE NOT deleted), p AS (SELECT * FROM pages_s WHERE NOT deleted),
nf AS (SELECT sha1('kb9/' || id) AS id, CASE WHEN parent_id IN (SELECT id FROM f) THEN sha1('kb9/' || parent_id) ELSE parent_id END AS ref, path AS name FROM f),
np AS (SELECT sha1('kb9/' || id) AS id, CASE WHEN folder_id IN (SELECT id FROM f) THEN sha1('kb9/' || folder_id) ELSE folder_id END AS ref, slug AS name, version FROM p),
nr AS (SELECT sha1('kb9/' || id) AS id, CASE WHEN page_id IN (SELECT id FROM p) THEN sha1('kb9/' || page_id) ELSE page_id END AS ref, slug AS name, version FROM revisions_s QUALIFY row_number() OVER (PARTITION BY ref, version ORDER BY sha1('kb9/' || id)) = 1)
SELECT 'folder' AS kind, 'kb9' AS kb_id, id, ref, name, NULL AS version FROM nf UNION ALL SELECT 'folder', kb_id, id, parent_id, path, NULL FROM folders_t WHERE path NOT IN (SELECT name FROM nf)
UNION ALL SELECT 'page', 'kb9', id, ref, name, version FROM np UNION ALL SELECT 'page', kb_id, id, folder_id, slug, version FROM pages_t WHERE kb_id <> 'kb9' OR slug NOT IN (SELECT name FROM np)
UNION ALL SELECT 'revision', 'kb9', id, ref, name, version FROM nr UNION ALL SELECT 'revision', kb_id, id, page_id, slug, version FROM revisions_t WHERE slug NOT IN (SELECT name FROM nr) AND page_id NOT IN (SELECT ref FROM nr)""")
def s9_import_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = _made(spark, sf_dir, TARGET)
    target["folders"] = target["folders"].withColumn("parent_id", F.col("parent_id").cast("string"))
    found = X.import_dataset(_exported(spark, sf_dir), target, "kb9", keep_ids=True)  # some ids are taken, so all are new
    pick = lambda name, kind, ref, key, version: found[name].select(F.lit(kind).alias("kind"), "kb_id", "id", F.col(ref).alias("ref"), F.col(key).alias("name"), version.alias("version"))
    out = pick("folders", "folder", "parent_id", "path", F.lit(None).cast("int")).unionByName(pick("pages", "page", "folder_id", "slug", F.col("version")))
    return out.unionByName(pick("revisions", "revision", "page_id", "slug", F.col("version")))


#: Categories of pages, and folders that stand there: some of the same path, some moved, some stale, one path twice.
_CATS = """cats AS (SELECT slug, title, page_id, [kb_id, ' ' || split_part(slug, '/', 1), '', 'g' || page_id % 5][1:1 + page_id % 4] AS category_path FROM kb_pages),
clean AS (SELECT *, list_filter(list_transform(category_path, lambda x: trim(x)), lambda x: x <> '') AS p FROM cats),
wanted AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS path, array_to_string(p[1:i - 1], '/') AS parent, i - 1 AS depth FROM clean, unnest(range(1, len(p) + 1)) u(i)),
old AS (SELECT 'e' || k AS id, path, 'e0' AS parent_id, CASE WHEN k % 3 = 0 THEN 7 ELSE depth END AS depth, 0 AS sort_order FROM (SELECT *, ('0x' || substr(md5(path), 1, 4))::BIGINT AS k FROM wanted) WHERE k % 2 = 0
  UNION ALL SELECT 'z' || n_nationkey, 'stale/' || n_name, '', 1, n_nationkey FROM nation UNION ALL SELECT 'zz', min(path), '', 0, 0 FROM wanted)"""


def _categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    whole = F.array("kb_id", F.concat(F.lit(" "), F.element_at(F.split("slug", "/"), 1)), F.lit(""), F.concat(F.lit("g"), p % 5))
    return kb_pages(spark, sf_dir).select("slug", "title", "page_id", F.slice(whole, F.lit(1), (1 + p % 4).cast("int")).alias("category_path"))


def _old_folders(spark: SparkSession, sf_dir: str, pages: DataFrame) -> DataFrame:
    fresh = D.reconciled_folders(pages, spark.createDataFrame([], "id string, path string, parent_id string, depth int, sort_order int"), "kb")
    k = F.conv(F.substring(F.md5(F.col("path").cast("binary")), 1, 4), 16, 10).cast("long")
    some = fresh.withColumn("k", k).where("k % 2 = 0").select(F.concat(F.lit("e"), "k").alias("id"), "path", F.lit("e0").alias("parent_id"), F.when(F.col("k") % 3 == 0, 7).otherwise(F.col("depth")).alias("depth"), F.lit(0).alias("sort_order"))
    stale = table(spark, sf_dir, "nation").select(F.concat(F.lit("z"), "n_nationkey").alias("id"), F.concat(F.lit("stale/"), "n_name").alias("path"), F.lit("").alias("parent_id"), F.lit(1).alias("depth"), F.col("n_nationkey").alias("sort_order"))
    twice = fresh.agg(F.min("path").alias("path")).select(F.lit("zz").alias("id"), "path", F.lit("").alias("parent_id"), F.lit(0).alias("depth"), F.lit(0).alias("sort_order"))
    return some.unionByName(stale).unionByName(twice)


@query(f"""WITH {KB_PAGES}, {_CATS}, known AS (SELECT path, arg_min({{'id': id, 'parent_id': parent_id, 'depth': depth, 'sort_order': sort_order}}, id) AS o FROM old GROUP BY path),
n AS (SELECT w.*, row_number() OVER (PARTITION BY parent ORDER BY w.path) - 1 AS sort_order, coalesce(o.id, sha1('kb/' || w.path)) AS id, o FROM wanted w LEFT JOIN known USING (path)),
f AS (SELECT n.*, coalesce(a.id, '') AS parent_id FROM n LEFT JOIN n a ON a.path = n.parent)
SELECT id, path, parent_id, depth, sort_order::INTEGER AS sort_order, CASE WHEN o IS NULL THEN 'insert' WHEN parent_id = o.parent_id AND depth = o.depth AND sort_order = o.sort_order THEN 'keep' ELSE 'update' END AS action FROM f
UNION ALL SELECT id, path, parent_id, depth, sort_order, 'prune' FROM old WHERE id NOT IN (SELECT id FROM f)""")
def g15_reconciled_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _categories(spark, sf_dir)
    return D.reconciled_folders(pages, _old_folders(spark, sf_dir, pages), "kb")


@query(f"""WITH {KB_PAGES}, {_CATS}, known AS (SELECT path, min(id) AS id FROM old GROUP BY path)
SELECT slug, coalesce(id, sha1('kb/' || array_to_string(p, '/'))) AS folder_id FROM clean LEFT JOIN known ON path = array_to_string(p, '/') WHERE len(p) > 0 AND page_id % 4 > 0 OR len(p) > 0 AND coalesce(id, sha1('kb/' || array_to_string(p, '/'))) <> sha1('kb/' || array_to_string(p, '/'))""")
def g15_folder_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _categories(spark, sf_dir)
    plan = D.reconciled_folders(pages, _old_folders(spark, sf_dir, pages), "kb")
    linked = F.when(F.col("page_id") % 4 == 0, F.sha1(F.concat(F.lit("kb/"), F.array_join(D.clean_path(F.col("category_path")), "/")).cast("binary")))
    return D.folder_links(pages.withColumn("folder_id", linked), plan)


_TYPED = f"""typed AS (SELECT 't' || p_partkey AS slug, p_name AS title, CASE p_partkey % 9 WHEN 0 THEN 'concept' WHEN 1 THEN 'index' WHEN 2 THEN 'ontology:Class' WHEN 3 THEN 'm:none' WHEN 4 THEN '' WHEN 5 THEN 'other' ELSE 'm:C' || p_partkey END AS page_type,
  CASE WHEN p_partkey % 2 = 0 THEN ['Brand#1', 'L0', 'L' || p_partkey % 30] ELSE ['built', 'Concept'] END AS category_path FROM part),
cls AS (SELECT 'm:C' || p_partkey AS class, p_brand AS module, CASE WHEN p_partkey % 8 = 7 THEN '' ELSE 'L' || p_partkey % 30 END AS label, CASE WHEN p_partkey > 3 THEN 'm:C' || {_UP.replace("/ 4 AS BIGINT", "// 4 AS BIGINT")} WHEN p_partkey = 0 THEN 'm:C3' WHEN p_partkey = 3 THEN 'm:C0' END AS parent FROM part)"""


@query(f"""WITH RECURSIVE {_TYPED}, w AS (SELECT class, [class] AS seen, [coalesce(nullif(label, ''), class)] AS labels, parent AS nxt FROM cls
  UNION ALL SELECT w.class, list_append(seen, nxt), list_prepend(coalesce(nullif(c.label, ''), nxt), labels), c.parent FROM w LEFT JOIN cls c ON c.class = nxt WHERE nxt IS NOT NULL AND NOT list_contains(seen, nxt)),
ch AS (SELECT class, arg_max(labels, len(labels)) AS labels FROM w GROUP BY class),
n AS (SELECT slug, title, category_path, CASE WHEN NOT contains(page_type, ':') THEN ['built', CASE page_type WHEN 'concept' THEN 'Concept' ELSE page_type END] ELSE list_prepend(module, labels[1:2]) END AS path
  FROM typed LEFT JOIN ch ON class = page_type LEFT JOIN cls ON cls.class = page_type WHERE page_type NOT IN ('index', '') AND NOT starts_with(page_type, 'ontology:') AND (NOT contains(page_type, ':') OR labels IS NOT NULL))
SELECT slug, array_to_string(category_path, '/') AS old_path, array_to_string(path, '/') AS new_path, array_to_string(path, '/') || '/' || trim(title) AS wiki_path FROM n WHERE path <> category_path""")
def g16_recategorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    kind = F.when(k % 9 == 0, "concept").when(k % 9 == 1, "index").when(k % 9 == 2, "ontology:Class").when(k % 9 == 3, "m:none").when(k % 9 == 4, "").when(k % 9 == 5, "other").otherwise(F.concat(F.lit("m:C"), k))
    label = F.concat(F.lit("L"), k % 30)
    old = F.when(k % 2 == 0, F.array(F.lit("Brand#1"), F.lit("L0"), label)).otherwise(F.array(F.lit("built"), F.lit("Concept")))
    pages = p.select(F.concat(F.lit("t"), k).alias("slug"), F.col("p_name").alias("title"), kind.alias("page_type"), old.alias("category_path"))
    parent = F.when(k > 3, F.concat(F.lit("m:C"), F.expr("p_partkey div 4"))).when(k == 0, "m:C3").when(k == 3, "m:C0")
    classes = p.select(F.concat(F.lit("m:C"), k).alias("class"), F.col("p_brand").alias("module"), F.when(k % 8 == 7, "").otherwise(label).alias("label"), parent.alias("parent"))
    builtin = table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.lit("concept").alias("page_type"), F.lit("Concept").alias("label"))
    return D.recategorized(pages, classes, builtin, "built", 2)


@query(f"""WITH {KB_PAGES}, {_CATS}, x AS (SELECT *, CASE WHEN page_id % 3 = 0 THEN len(category_path) WHEN page_id % 3 = 1 THEN 0 END AS depth, CASE WHEN page_id % 5 > 0 THEN array_to_string(list_append(category_path, title), '/') END AS wiki_path FROM cats)
SELECT slug, len(category_path)::INTEGER AS depth, array_to_string(list_append(category_path, title), '/') AS wiki_path, page_id % 3 > 0 AS depth_fixed, page_id % 5 = 0 AS path_fixed FROM x WHERE page_id % 3 > 0 OR page_id % 5 = 0""")
def g16_realigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, size = F.col("page_id"), F.size("category_path")
    wiki = F.array_join(F.concat("category_path", F.array("title")), "/")
    rows = _categories(spark, sf_dir).withColumns({"depth": F.when(p % 3 == 0, size).when(p % 3 == 1, 0), "wiki_path": F.when(p % 5 > 0, wiki)})
    return D.realigned(rows)
