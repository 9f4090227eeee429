"""Queries over search, catalogues, resolution and near duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import graphs as G
from lorekeep.operators import search as S
from lorekeep.plans.fixtures import KB_PAGES, kb_pages, subclasses, table
from lorekeep.plans.graphs import CLOSURE
from lorekeep.plans.registry import query


def _near_sql(t: float, u: float) -> str:
    return f"""WITH {KB_PAGES}, c AS (SELECT page_type, title || ' ' || summary AS body, min(page_id) AS id, count(*) AS pages FROM kb_pages WHERE title || ' ' || summary <> '' GROUP BY 1, 2),
s AS (SELECT id, page_type, pages, CASE WHEN length(body) < 3 THEN [body] ELSE list_distinct([substr(body, i::INT, 3) FOR i IN range(1, length(body) - 1)]) END AS g FROM c),
e AS (SELECT id, page_type, pages, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.id AS a, b.id AS b, any_value(a.pages) AS a_pages, any_value(b.pages) AS b_pages, round(count(*) / sqrt(any_value(a.n)::DOUBLE * any_value(b.n)), 9) AS cosine, any_value(a.page_type) = any_value(b.page_type) AS same
  FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id)
SELECT a, b, a_pages, b_pages, cosine FROM p WHERE cosine >= CASE WHEN same THEN {t} ELSE {u} END"""


@query(_near_sql(0.86, 0.93))
def j7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = kb_pages(spark, sf_dir).select("page_id", "page_type", F.concat("title", F.lit(" "), "summary").alias("body"))
    return S.near_duplicates(pages)


@query(f"""WITH {KB_PAGES}, h AS (SELECT kb_id, slug, contains(title, 'The') OR contains(content, 'The') AS a, contains(title, 'this is') OR contains(content, 'this is') AS b FROM kb_pages WHERE NOT contains(content, 'idiot'))
SELECT kb_id, slug, false AS relaxed FROM h WHERE a AND b""")
def p2_keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.keyword_filter(kb_pages(spark, sf_dir), '"this is" The -idiot', "title", "content").select("kb_id", "slug", "relaxed")


@query(f"""WITH {KB_PAGES} SELECT kb_id, slug, true AS relaxed FROM kb_pages WHERE contains(title, 'pathetic') OR contains(content, 'pathetic') OR contains(title, 'zzz-none') OR contains(content, 'zzz-none')""")
def p2_keyword_filter_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.keyword_filter(kb_pages(spark, sf_dir), "pathetic zzz-none", "title", "content").select("kb_id", "slug", "relaxed")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') AND contains(lower(p_brand), 'brand#1') AND p_type = 'ECONOMY'")
def p5_catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.catalog_search(table(spark, sf_dir, "part"), {"p_name": "RING", "p_brand": "Brand#1"}, {"p_type": "ECONOMY", "p_size": None}).select("p_partkey", "p_name")


@query("""SELECT conv_id, turn, array_to_string(CASE WHEN role = 'system' THEN [1, 2, 3] WHEN conv_id % 5 = 2 THEN [2] ELSE list_filter([conv_id % 5, 2, 7], lambda x: x IN (1, 2, 3)
  AND x IS NOT NULL) END, ',') AS scope FROM conversations""")
def p6_allowed_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    lits = lambda *v: F.array(*[F.lit(x).cast("bigint") for x in v])
    scope = S.allowed_scope(lits(1, 2, 3), F.array(F.col("conv_id") % 5), lits(2, 7), F.when(F.col("role") == "system", "all"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(scope, ",").alias("scope"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE o_orderstatus END AS o_orderstatus, o_orderstatus NOT IN ('O', 'F') AS unmapped FROM orders")
def p8_map_enums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.map_enums(table(spark, sf_dir, "orders"), "o_orderstatus", {"O": "open", "F": "filled"}).select("o_orderkey", "o_orderstatus", "unmapped")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'O' WHEN 'F' THEN 'F' ELSE 'else ' || o_orderstatus END AS code, o_orderstatus NOT IN ('O', 'F') AS unmapped FROM orders")
def p8_map_enums_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"O": "open", "F": "filled", "X": "filled"}
    told = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "filled").otherwise(F.concat(F.lit("else "), "o_orderstatus"))
    return S.map_enums(table(spark, sf_dir, "orders").select("o_orderkey", told.alias("code")), "code", names, back=True)


@query(r"""WITH w AS (SELECT conv_id, turn, ['keyword', 'Route ', 'instances', 'rules'][1 + turn % 4] AS mode, len(list_filter(string_split_regex(text, '\s+'), lambda x: length(x) > 12)) AS terms, conv_id % 3 AS c, text FROM conversations), m AS (SELECT *, CASE WHEN turn % 4 < 2 THEN terms ELSE 1 END AS n FROM w),
l AS (SELECT *, CASE WHEN n >= 3 THEN '3+' ELSE n::VARCHAR END AS bucket, CASE WHEN turn % 4 = 2 THEN 'instance' WHEN c > 0 AND terms > 0 THEN 'class+text' WHEN c > 0 THEN 'class' WHEN terms > 0 THEN 'text' ELSE 'none' END AS level FROM m)
SELECT conv_id, turn, n::INTEGER AS n_terms, bucket, level, bucket || '|' || level AS shape,
  CASE WHEN contains(text, '"') THEN 'phrase' WHEN regexp_matches(text, '(^|\s)-\w') THEN 'exclude' WHEN contains(text, '?') THEN 'question' WHEN len(string_split_regex(text, '\s+')) <= 2 THEN 'name' ELSE 'keywords' END AS category FROM l""")
def p10_question_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.filter(F.split("text", r"\s+"), lambda x: F.length(x) > 12)
    mode = F.get(F.array(*[F.lit(m) for m in ("keyword", "Route ", "instances", "rules")]), (F.col("turn") % 4).cast("int"))
    shape = S.question_shape(mode, terms, F.array_repeat(F.lit("c"), (F.col("conv_id") % 3).cast("int")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *[c.alias(n) for n, c in shape.items()], S.question_category(F.col("text")).alias("category"))


#: Receipts of calls and the shapes they have.
RECEIPTS = [
    ("{}", "silent"), ('{"error": "no", "ok": true}', "error"), ('{"ok": false, "items": []}', "dry"), ('{"ok": true, "error": ""}', "ok"),
    ('{"note": "x"}', "ok_brief"), ('{"retired": 1, "error": "y"}', "guard"), ('{"hits": [1]}', "ok"), ('{"applied": false}', "dry"),
    ('{"applied": true}', "ok"), ('{"nodes": []}', "ok"), ('{"edges": 3}', "ok"), ('{"tools": {}}', "ok"), ('{"catalog": "c"}', "ok"),
    ('{"images_found": 0}', "ok"), ('{"by_document": []}', "ok"), ('{"chunks": null}', "ok"), ('{"total": 0}', "ok"),
    ('{"candidates": []}', "ok_brief"), ('{"data": [1]}', "ok_brief"), ('{"need_session": false}', "guard"),
]


@query(f"""SELECT event_id, CASE WHEN event_id % 21 = 20 THEN 'timeout' ELSE {[shape for _, shape in RECEIPTS]}[1 + event_id % 21] END AS shape FROM events""")
def p12_result_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id") % 21
    receipt = F.get(F.array(*[F.lit(text) for text, _ in RECEIPTS]), i.cast("int"))
    return table(spark, sf_dir, "events").select("event_id", S.result_shape(receipt, i != 20).alias("shape"))


VERSION = "p_size || '.' || p_partkey % 7 || '.' || p_partkey % 3"


@query(f"""WITH i AS (SELECT p_partkey AS item_id, lower(p_brand) AS name, {VERSION} AS version, [p_size, (p_partkey % 7)::INTEGER, (p_partkey % 3)::INTEGER] AS v FROM part),
d AS (SELECT DISTINCT lower(p_brand) AS name, {VERSION} AS version FROM part WHERE p_partkey % 40 = 0),
a AS (SELECT p_partkey AS pos, lower(p_brand) AS name, CASE WHEN p_partkey % 2 = 0 THEN {VERSION} ELSE '' END AS listed, CASE WHEN p_partkey % 2 = 1 THEN p_size END AS low, p_size + 5 AS high, CASE WHEN p_partkey % 3 = 0 THEN '2020-01-01' ELSE '' END AS expires FROM part WHERE p_partkey % 25 < 2),
m AS (SELECT item_id, pos, expires <> '' AND expires < '2024-01-01' AS old, listed, version, CASE WHEN listed = version THEN 0 WHEN low IS NOT NULL AND v >= [low] AND v <= [high] THEN 1 END AS step FROM i JOIN a ON a.name = i.name),
b AS (SELECT item_id, arg_min(old, step * 1000000 + pos) FILTER (step IS NOT NULL) AS old, min(step) AS step, array_to_string(list(listed ORDER BY pos) FILTER (listed <> version)[1:5], ',') AS near FROM m GROUP BY 1)
SELECT item_id, CASE WHEN d.name IS NOT NULL THEN 'denied' WHEN old THEN 'expired' WHEN step IS NOT NULL THEN 'allowed' ELSE 'unknown' END AS verdict, CASE WHEN d.name IS NOT NULL THEN 'deny' WHEN step = 0 THEN 'exact' WHEN step = 1 THEN 'range' ELSE '' END AS match, coalesce(near, '') AS near_misses
FROM i LEFT JOIN d USING (name, version) LEFT JOIN b USING (item_id)""")
def j11_catalog_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").withColumn("version", F.concat_ws(".", "p_size", k % 7, k % 3))
    items = p.select(k.alias("item_id"), F.col("p_brand").alias("software"), "version")
    deny = p.where("p_partkey % 40 = 0").select(F.col("p_brand").alias("software"), "version")
    allow = p.where("p_partkey % 25 < 2").select(k.alias("pos"), F.col("p_brand").alias("software"), F.when(k % 2 == 0, F.col("version")).otherwise("").alias("version"), F.when(k % 2 == 1, F.col("p_size").cast("string")).alias("low"),
        F.when(k % 2 == 1, (F.col("p_size") + 5).cast("string")).alias("high"), F.when(k % 3 == 0, "2020-01-01").otherwise("").alias("expires_at"))
    return S.catalog_check(items, allow, deny, "2024-01-01")


@query(rf"""WITH RECURSIVE {CLOSURE}, t AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS term FROM part UNION SELECT p_name FROM part UNION SELECT 'thing ' || p_partkey % 50 FROM part),
c AS (SELECT p_partkey AS class, 'm' || p_size || ':' || split_part(p_name, ' ', 1) || 'Thing' || p_partkey % 50 AS name, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE split_part(p_name, ' ', 2) END AS label FROM part),
k AS (SELECT term, regexp_replace(lower(term), '[\s[:punct:]]+', '', 'g') AS key FROM t), l AS (SELECT class, name, regexp_replace(lower(label), '[\s[:punct:]]+', '', 'g') AS label, regexp_replace(lower(split_part(name, ':', -1)), '[\s[:punct:]]+', '', 'g') AS local, regexp_replace(lower(name), '[\s[:punct:]]+', '', 'g') AS whole FROM c),
s AS (SELECT term, class, name, key IN (label, local, whole) AS same, contains(label, key) AS within, ends_with(label, key) OR length(key) * 4 >= length(label) * 3 AS firm, contains(key, label) AND label <> '' AS around, contains(local, key) AS loc, least(abs(length(label) - length(key)), 20) AS gap FROM k, l WHERE length(key) >= 2),
r AS (SELECT term, class, name, CASE WHEN same THEN 100 WHEN within AND firm THEN 90 - gap WHEN within THEN 55 WHEN around THEN 70 - gap WHEN loc THEN 60 END AS score, same OR NOT within OR firm AS strong FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, name, class) AS place FROM r WHERE score IS NOT NULL QUALIFY place <= 3),
f AS (SELECT term, list(class ORDER BY place) AS cs, list(score ORDER BY place) AS ss FROM p WHERE strong GROUP BY 1 HAVING count(*) > 1),
x AS (SELECT term FROM f WHERE ss[1] - ss[2] < 10 AND NOT EXISTS (SELECT 1 FROM closure WHERE (node = cs[1] AND ancestor = cs[2]) OR (node = cs[2] AND ancestor = cs[1])))
SELECT term, class, score::INTEGER AS score, strong, place::INTEGER AS place, term IN (SELECT term FROM x) AS ambiguous FROM p""")
def j16_class_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    word = lambda n: F.element_at(F.split("p_name", " "), n)
    name = F.concat(F.lit("m"), F.col("p_size"), F.lit(":"), word(1), F.lit("Thing"), k % 50)
    classes = p.select(k.alias("class"), name.alias("name"), F.when(k % 3 == 0, F.col("p_name")).otherwise(word(2)).alias("label"))
    terms = p.select(word(2).alias("term")).union(p.select("p_name")).union(p.select(F.concat(F.lit("thing "), k % 50)))
    return S.class_candidates(terms, classes, G.ancestors(subclasses(spark, sf_dir)))


@query(f"""WITH {KB_PAGES}, q AS (SELECT slug AS query FROM kb_pages WHERE page_id % 10 = 0 UNION SELECT page_id::VARCHAR FROM kb_pages WHERE page_id % 10 = 1 UNION SELECT title FROM kb_pages WHERE page_id % 10 = 2 UNION SELECT 'base/' || slug FROM kb_pages WHERE page_id % 10 = 3 UNION SELECT upper(substr(title, 5, 12)) FROM kb_pages WHERE page_id % 10 = 4),
a AS (SELECT query, trim(regexp_replace(trim(query), '^["'']+|["'']+$', '', 'g')) AS q FROM q), m AS (SELECT query, q, slug, title FROM a JOIN kb_pages ON contains(lower(slug), lower(q)) OR contains(lower(title), lower(q)) OR slug = regexp_replace(q, '^[^/]*/', '') WHERE q <> ''),
f AS (SELECT query, slug, min(CASE WHEN slug = q THEN 0 WHEN regexp_replace(slug, '^[^/]*/', '') = q OR ends_with(slug, '/' || q) THEN 1 WHEN trim(title) = q THEN 2 ELSE 3 END) AS rank FROM m GROUP BY ALL), b AS (SELECT *, min(rank) OVER (PARTITION BY query) AS best FROM f)
SELECT query, slug, rank, count(*) OVER (PARTITION BY query) > 1 AND rank >= 2 AS ambiguous FROM b WHERE rank = best""")
def j19_lookup_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = kb_pages(spark, sf_dir)
    kinds = {0: F.col("slug"), 1: F.col("page_id").cast("string"), 2: F.col("title"), 3: F.concat(F.lit("base/"), "slug"), 4: T.upper_letters(F.substring("title", 5, 12))}
    asked = [p.where(F.col("page_id") % 10 == n).select(c.alias("query")) for n, c in kinds.items()]
    return S.lookup_page(reduce(DataFrame.unionByName, asked).distinct(), p)


@query(r"""WITH d AS (SELECT h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS id, CASE WHEN s_suppkey % 10 = 9 THEN 'Supplier same' ELSE s_name END AS name, s_suppkey FROM (SELECT *, md5(s_suppkey::VARCHAR) AS h FROM supplier)),
r AS (SELECT DISTINCT CASE s_suppkey % 7 WHEN 0 THEN upper(id) WHEN 1 THEN id[1:4 + s_suppkey % 5] WHEN 2 THEN ' ' || name || ' ' WHEN 3 THEN 'Suppliersame' WHEN 4 THEN 'none ' || s_suppkey WHEN 5 THEN 'the ' || name || ' of old' ELSE name[3:] END AS raw FROM d), k AS (SELECT raw, trim(raw) AS key, regexp_replace(trim(raw), '\s+', '', 'g') AS want FROM r),
n AS (SELECT *, regexp_replace(name, '\s+', '', 'g') AS norm FROM d),
h AS (SELECT raw, 0 AS rank, id FROM k JOIN n ON id = lower(key) WHERE regexp_full_match(key, '[0-9a-fA-F-]{36}') UNION SELECT raw, 1, id FROM k JOIN n ON starts_with(id, lower(key)) WHERE regexp_full_match(key, '[0-9a-fA-F-]{4,35}')
  UNION SELECT raw, 2, id FROM k JOIN n ON want = norm WHERE NOT regexp_full_match(key, '[0-9a-fA-F-]{36}') UNION SELECT raw, 3, id FROM k JOIN n ON contains(want, norm) OR contains(norm, want) WHERE NOT regexp_full_match(key, '[0-9a-fA-F-]{36}')),
g AS (SELECT raw, rank, count(*) AS n, min(id) AS id FROM h GROUP BY raw, rank), b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY raw ORDER BY rank) = 1)
SELECT raw, CASE WHEN n = 1 THEN id END AS id, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'ambiguous' WHEN rank IN (0, 2) THEN 'exact' ELSE 'fuzzy' END AS mode, coalesce(n, 0) AS candidates FROM r LEFT JOIN b USING (raw)""")
def j23_resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    h = F.md5(key.cast("string").cast("binary"))
    ids = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    dim = table(spark, sf_dir, "supplier").select("s_suppkey", ids.alias("id"), F.when(key % 10 == 9, "Supplier same").otherwise(F.col("s_name")).alias("name"))
    name = F.col("name")
    forms = [F.upper("id"), F.substring(F.col("id"), F.lit(1), (4 + key % 5).cast("int")), F.concat(F.lit(" "), name, F.lit(" ")), F.lit("Suppliersame"), F.concat(F.lit("none "), key), F.concat(F.lit("the "), name, F.lit(" of old")), F.substring("name", 3, 1000)]
    return S.resolve_names(dim.select(F.get(F.array(*forms), (key % 7).cast("int")).alias("raw")), dim.select("id", "name"))


@query(rf"""WITH {KB_PAGES}, n AS (SELECT kb_id, page_id, page_type, lower(regexp_replace(split_part(slug, '/', 1) || page_id // 3, '\s+', '', 'g')) AS s, regexp_replace(lower(title), '[\s[:punct:]]+', '', 'g') AS t FROM kb_pages),
k AS (SELECT kb_id, page_id, 'L1' AS level, s AS key FROM n UNION ALL SELECT kb_id, page_id, 'L2', page_type || '|' || t FROM n WHERE t <> '' UNION ALL SELECT kb_id, page_id, 'L1+L2', s || '|' || page_type || '|' || t FROM n WHERE s <> '' AND t <> ''),
w AS (SELECT level, key, count(DISTINCT kb_id) AS kbs FROM k WHERE key <> '' GROUP BY ALL HAVING count(DISTINCT kb_id) > 1)
SELECT level, key, kb_id, page_id, kbs FROM k JOIN w USING (level, key)""")
def j6_cross_kb_same_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = kb_pages(spark, sf_dir)
    slug = F.concat(F.element_at(F.split("slug", "/"), 1), F.expr("page_id div 3"))
    return S.cross_kb_same_key(p.select("kb_id", "page_id", "page_type", T.norm_slug(slug).alias("norm_slug"), T.norm_title(F.col("title")).alias("norm_title")))
