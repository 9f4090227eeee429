"""Queries over tables, figures, outlines and references in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import documents as D
from lorekeep.operators import graphs as G
from lorekeep.operators import texts as X
from lorekeep.plans.fixtures import KB_PAGES, kb_pages, subclasses, table
from lorekeep.plans.graphs import CLOSURE
from lorekeep.plans.registry import query


@query("""WITH l AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity::INTEGER::VARCHAR)::INTEGER AS row, l_partkey, l_quantity FROM lineitem) SELECT doc, row, l_partkey::VARCHAR AS part, l_quantity::INTEGER::VARCHAR AS quantity FROM l""")
def t8_md_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit("| "), "l_partkey", F.lit(" | "), F.col("l_quantity").cast("int"), F.lit(" |"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", row.alias("r")))).alias("rows"))
    head = "Some words\n| part | quantity |\n|---|:--|\n"
    text = F.concat(F.lit(head), F.array_join(F.transform("rows", lambda s: s["r"]), "\n"), F.lit("\n\n| other | table |\n| 1 | 2 |"))
    found = D.md_table(X.lines_of(lines.select("doc", text.alias("text"))))
    return found.select("doc", "row", F.col("cells")["part"].alias("part"), F.col("cells")["quantity"].alias("quantity"))


@query("""WITH i AS (SELECT l_suppkey AS doc, l_linenumber AS page, l_orderkey AS place, l_partkey % 40 AS md5, l_quantity * 400 AS bytes FROM lineitem), p AS (SELECT doc, count(DISTINCT page) AS pages FROM i GROUP BY 1), o AS (SELECT doc, md5, count(DISTINCT page) AS n FROM i GROUP BY ALL),
m AS (SELECT i.*, CASE WHEN pages >= 3 AND n * 2 >= pages THEN 'repeated' WHEN bytes < 6000 THEN 'small' ELSE 'kept' END AS reason FROM i JOIN o USING (doc, md5) JOIN p USING (doc)) SELECT reason, count(*) AS images, count(DISTINCT doc) AS docs FROM m GROUP BY 1""")
def t18_content_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("page"), F.col("l_orderkey").alias("place"), (F.col("l_partkey") % 40).alias("md5"), (F.col("l_quantity") * 400).alias("bytes"))
    return D.content_figures(images).groupBy("reason").agg(F.count("*").alias("images"), F.count_distinct("doc").alias("docs"))


@query("""WITH RECURSIVE l AS (SELECT doc_id AS doc, i - 1 AS place, length(s[i]) AS chars FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) u(i)),
c AS (SELECT doc, doc * 100000 + place AS chunk, place, chars, CASE WHEN doc % 2 = 0 AND place % 10 = 0 THEN 'parent_text' ELSE 'text' END AS type, CASE WHEN doc % 2 = 0 AND place % 10 BETWEEN 1 AND 8 THEN doc * 100000 + place - place % 10 END AS parent FROM l),
k AS (SELECT parent, string_agg(chunk::VARCHAR, ',' ORDER BY place) AS kids, count(*) AS n FROM c WHERE parent IS NOT NULL GROUP BY 1),
f AS (SELECT doc, place, chunk AS unit, chars::BIGINT AS used FROM c WHERE doc % 2 = 1 AND place = 0 UNION ALL SELECT c.doc, c.place, CASE WHEN f.used >= 1500 THEN c.chunk ELSE f.unit END, CASE WHEN f.used >= 1500 THEN c.chars ELSE f.used + c.chars END FROM f JOIN c ON c.doc = f.doc AND c.place = f.place + 1)
SELECT c.doc, c.chunk AS unit, 'parent' AS kind, c.chunk || coalesce(',' || kids, '') AS chunks, coalesce(n, 0)::INTEGER AS children, c.chars::BIGINT AS chars FROM c LEFT JOIN k ON k.parent = c.chunk WHERE type = 'parent_text'
UNION ALL SELECT doc, chunk, 'orphan_text', chunk::VARCHAR, 0, chars FROM c WHERE doc % 2 = 0 AND type = 'text' AND parent IS NULL
UNION ALL SELECT f.doc, unit, 'packed_text', string_agg(c.chunk::VARCHAR, ',' ORDER BY c.place), (count(*) - 1)::INTEGER, sum(c.chars)::BIGINT FROM f JOIN c USING (doc, place) GROUP BY f.doc, unit""")
def t19_outline_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = X.lines_of(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"))
    chunk, step = F.col("doc") * 100000 + F.col("place"), F.col("place") % 10
    even = F.col("doc") % 2 == 0
    kind, parent = F.when(even & (step == 0), "parent_text").otherwise("text"), F.when(even & step.between(1, 8), chunk - step)
    return D.outline_units(lines.select("doc", chunk.alias("chunk"), "place", kind.alias("type"), parent.alias("parent"), F.length("line").alias("chars")))


@query("""WITH t AS (SELECT p_partkey AS text_id, regexp_replace(lower(p_name), '[\\s[:punct:]]+', '', 'g') AS x FROM part), n AS (SELECT DISTINCT p_type AS name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT DISTINCT substr(p_name, 1, 2) || ' q' FROM part),
k AS (SELECT name, regexp_replace(lower(name), '[\\s[:punct:]]+', '', 'g') AS y FROM n), s AS (SELECT name, y, i, j FROM k, unnest(range(1, length(y) + 1)) u(i), unnest(range(2, length(y) + 1)) v(j) WHERE i + j <= length(y) + 1 AND length(y) > 1),
h AS (SELECT text_id, name, y, x, max(j) AS common FROM t JOIN s ON contains(x, substr(y, i, j)) GROUP BY ALL)
SELECT text_id, name, common::INTEGER AS common, row_number() OVER (PARTITION BY text_id ORDER BY common DESC, length(y) DESC, name)::INTEGER AS place FROM h WHERE common >= 3 OR (length(x) > 1 AND starts_with(y, x[1:2])) QUALIFY place <= 2""")
def j14_name_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    texts = p.select(F.col("p_partkey").alias("text_id"), F.col("p_name").alias("text"))
    names = p.select(F.col("p_type").alias("name")).union(p.select(F.element_at(F.split("p_name", " "), 2))).union(p.select("p_brand")).union(p.select(F.concat(F.substring("p_name", 1, 2), F.lit(" q"))))
    return D.name_hits(texts, names)


@query(rf"""WITH {KB_PAGES}, r AS (SELECT page_id AS ref_id, trim(CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'https://x.org/en/doc/' || page_id || '.html?a=1#b' WHEN 2 THEN '/docs/The .pdf' WHEN 3 THEN ' ' ELSE 'Eren.txt' END) AS ref FROM pages),
s AS (SELECT ref_id, ref, regexp_replace(split_part(rtrim(ref, '/'), '/', -1), '[?#].*$', '') AS tail FROM r), a AS (SELECT ref_id, ref, lower(coalesce(nullif(regexp_replace(tail, '\.[^.]*$', ''), ''), ref)) AS part FROM s),
w AS (SELECT part, string_agg(slug, ',' ORDER BY n) AS hits FROM (SELECT part, slug, row_number() OVER (PARTITION BY part ORDER BY length(title), slug) AS n FROM (SELECT DISTINCT part FROM a WHERE part <> '') JOIN kb_pages ON contains(lower(title), part) OR contains(lower(slug), part) WHERE NOT starts_with(page_type, 'onto') QUALIFY n <= 3) GROUP BY 1),
d AS (SELECT part, string_agg(item_id::VARCHAR, ',' ORDER BY n) AS hits FROM (SELECT part, item_id, row_number() OVER (PARTITION BY part ORDER BY item_id) AS n FROM (SELECT DISTINCT part FROM a WHERE part <> '') JOIN benchmark ON contains(lower(text), part) QUALIFY n <= 3) GROUP BY 1)
SELECT ref_id, CASE WHEN w.hits IS NOT NULL THEN 'wiki' WHEN d.hits IS NOT NULL THEN 'doc' ELSE '' END AS source, coalesce(w.hits, d.hits, '') AS hits, CASE WHEN ref = '' THEN 'no_reference' WHEN w.hits IS NOT NULL OR d.hits IS NOT NULL THEN '' WHEN regexp_matches(lower(ref), '^https?://') THEN 'fetch_disabled' ELSE 'not_found' END AS reason
FROM a LEFT JOIN w USING (part) LEFT JOIN d USING (part)""")
def j20_find_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    reference = F.when(i % 5 == 0, F.col("url")).when(i % 5 == 1, F.concat(F.lit("https://x.org/en/doc/"), i, F.lit(".html?a=1#b"))).when(i % 5 == 2, "/docs/The .pdf").when(i % 5 == 3, " ").otherwise("Eren.txt")
    refs = table(spark, sf_dir, "pages").select(i.alias("ref_id"), reference.alias("reference"))
    docs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("title"))
    return D.find_reference(refs, kb_pages(spark, sf_dir), docs, rules="onto")


@query("""WITH a AS (SELECT DISTINCT p_type AS kind, p_name AS name FROM part WHERE p_partkey % 3 = 0), b AS (SELECT DISTINCT p_type AS kind, p_name AS name FROM part WHERE p_partkey % 5 = 0)
SELECT *, 'projection' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'artifact' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def u5_catalog_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    take = lambda n: p.where(f"p_partkey % {n} = 0").select(F.col("p_type").alias("kind"), F.col("p_name").alias("name")).distinct()
    return D.catalog_diff(take(3), take(5))


@query(f"""WITH RECURSIVE {CLOSURE}, r AS (SELECT 'p' || n_nationkey AS relation, n_nationkey AS c FROM nation), a AS (SELECT n_nationkey AS ask_id, 'p' || n_nationkey AS relation, n_nationkey * 4 AS own, CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'RED' ELSE 'in' END AS q FROM nation)
SELECT ask_id, p_partkey AS page, row_number() OVER (PARTITION BY ask_id ORDER BY p_partkey, p_name)::INTEGER AS place FROM a JOIN r USING (relation) JOIN (SELECT DISTINCT node, ancestor FROM closure) ON ancestor = c JOIN part ON p_partkey = node WHERE p_partkey <> own AND contains(lower(p_name), lower(q))""")
def g19_link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), F.col("p_partkey").alias("class"), F.col("p_name").alias("title"))
    n = F.col("n_nationkey").cast("long")
    relation = F.concat(F.lit("p"), n).alias("relation")
    nation = table(spark, sf_dir, "nation")
    asked = nation.select(n.alias("ask_id"), relation, (n * 4).alias("page"), F.when(n % 3 == 0, "").when(n % 3 == 1, "RED").otherwise("in").alias("q"))
    return D.link_targets(asked, pages, nation.select(relation, n.alias("class")), G.ancestors(subclasses(spark, sf_dir)))


@query(f"""WITH {KB_PAGES}, g AS (SELECT title AS grp, slug, kb_id, version FROM kb_pages), e AS (SELECT DISTINCT title AS grp FROM kb_pages WHERE page_id % 50 = 0), t AS (SELECT grp, count(*) AS members, count(DISTINCT kb_id) AS kbs FROM g GROUP BY 1),
f AS (SELECT grp, slug FROM g QUALIFY row_number() OVER (PARTITION BY grp ORDER BY version DESC, slug) = 1) SELECT grp, slug AS primary_slug, members, kbs, CASE WHEN grp IN (SELECT grp FROM e) THEN 'exists' WHEN kbs < 2 THEN 'single' ELSE 'new' END AS state FROM t JOIN f USING (grp)""")
def r7_concept_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = kb_pages(spark, sf_dir).withColumnRenamed("title", "grp")
    return D.concept_preview(k.select("grp", "slug", "kb_id", "version"), k.where("page_id % 50 = 0").select("grp").distinct())


@query()
def t6_split_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.split_plain_text(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"))
