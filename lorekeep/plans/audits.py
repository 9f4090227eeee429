"""Queries of the audit checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import audits as A
from lorekeep.operators import design as B
from lorekeep.operators import graphs as G
from lorekeep.operators import lineage as L
from lorekeep.operators import texts as X
from lorekeep.plans.fixtures import EDGES, KB_PAGES, edges, kb_pages, order_pages, part_docs, subclasses, table
from lorekeep.plans.graphs import CLOSURE
from lorekeep.plans.lineage import INDEX
from lorekeep.plans.registry import query

PUNCT = r"[\s!-/:-@\[-`{-~]+"
INSTANCE = "contains(page_type, ':') AND NOT starts_with(page_type, 'ontology:') AND page_type NOT IN ('index', 'summary')"
#: Metadata and editors of pages, with classes and slugs that do not fit.
TOLD_PAGES = KB_PAGES + """, told AS (SELECT * REPLACE (CASE WHEN page_id % 29 = 0 THEN 'xx:Doc' WHEN page_id % 31 = 0 THEN split_part(slug, '/', 1) || ':Page' ELSE page_type END AS page_type),
[NULL, '{"class": "' || page_type || '"}', '{"type": "Doc", "model": "de"}', '{"class": " Doc "}', '{"class": "", "type": "en:Doc"}', '{}', '{"note": 1}'][1 + page_id % 7] AS metadata,
[NULL, 'agent', 'bi-123', 'someone', ' ingest '][1 + page_id % 5] AS editor FROM kb_pages)"""
PAGE_FOUND = TOLD_PAGES + r""", live AS (SELECT * FROM told WHERE NOT deleted), e AS (SELECT *, [NULL, CASE WHEN page_id % 29 = 0 OR page_id % 31 = 0 THEN NULL ELSE page_type END, 'de:Doc', 'Doc', 'en:Doc', NULL, NULL][1 + page_id % 7] AS says FROM live WHERE INSTANCE),
found AS (SELECT 'A3' AS "check", 'medium' AS severity, slug AS subject, says AS detail FROM (SELECT * REPLACE (CASE WHEN page_id % 7 = 1 THEN json_extract_string(metadata, '$.class') ELSE says END AS says) FROM e) WHERE says <> page_type
UNION ALL SELECT 'A6', 'low', slug, 'no metadata' FROM e WHERE page_id % 7 IN (0, 5)
UNION ALL SELECT 'A6', 'low', slug, trim(editor) FROM e WHERE page_id % 7 NOT IN (0, 5) AND page_id % 5 = 3
UNION ALL SELECT 'A7', 'medium', slug, page_type FROM e WHERE split_part(slug, '/', 1) <> split_part(page_type, ':', 1) OR lower(split_part(page_type, ':', 2)) <> 'doc'
UNION ALL SELECT 'W5', 'low', slug, '' FROM live WHERE trim(summary) = ''
UNION ALL SELECT 'D1', 'medium', slug, page_type || ' ' || n FROM (SELECT kb_id, page_type, regexp_replace(lower(title), 'PUNCT', '', 'g') AS name, count(*) AS n, min(slug) AS slug FROM e GROUP BY ALL HAVING count(*) > 1))""".replace("INSTANCE", INSTANCE).replace("PUNCT", PUNCT)


def _told_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    kind = F.when(p % 29 == 0, "xx:Doc").when(p % 31 == 0, F.concat(F.element_at(F.split("slug", "/"), 1), F.lit(":Page"))).otherwise(F.col("page_type"))
    own = F.concat(F.lit('{"class": "'), F.col("page_type"), F.lit('"}'))
    texts = ['{"type": "Doc", "model": "de"}', '{"class": " Doc "}', '{"class": "", "type": "en:Doc"}', "{}", '{"note": 1}']
    metadata = F.get(F.array(F.lit(None), own, *[F.lit(t) for t in texts]), (p % 7).cast("int"))
    editor = F.get(F.array(*[F.lit(e) for e in (None, "agent", "bi-123", "someone", " ingest ")]), (p % 5).cast("int"))
    return kb_pages(spark, sf_dir).withColumns({"metadata": metadata, "editor": editor, "page_type": kind})


def _page_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.page_checks(_told_pages(spark, sf_dir), ("agent", "pipeline", "ingest", ""), ("bi-",))


@query(f"WITH {PAGE_FOUND} SELECT * FROM found")
def c1_page_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.order_findings(_page_checks(spark, sf_dir))


@query(f'WITH {PAGE_FOUND} SELECT "check", severity, count(*) AS n FROM found GROUP BY ALL')
def a28_finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.finding_counts(_page_checks(spark, sf_dir))


@query(f"""WITH {EDGES}, e AS (SELECT src, rel, CASE WHEN substr(src, 7)::BIGINT % 90 = 0 THEN src ELSE dst END AS dst FROM edges WHERE rel = 'hasLine'), g AS (SELECT src, rel, dst, count(*) AS n FROM e GROUP BY ALL)
SELECT 'A1' AS "check", 'high' AS severity, src || ' ' || rel || ' ' || dst AS subject, n::VARCHAR AS detail FROM g WHERE dst NOT IN (SELECT 'part/' || p_partkey FROM part WHERE p_partkey % 11 <> 0)
UNION ALL SELECT 'A5', 'low', src || ' ' || rel || ' ' || dst, n::VARCHAR FROM g WHERE n > 1 UNION ALL SELECT 'A5', 'medium', src || ' ' || rel || ' ' || dst, 'loop' FROM g WHERE src = dst""")
def c1_edge_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    looped = F.when(F.substring("src", 7, 20).cast("long") % 90 == 0, F.col("src")).otherwise(F.col("dst"))
    nodes = part_docs(spark, sf_dir).select(F.concat(F.lit("part/"), "doc_id").alias("slug"))
    return A.edge_checks(edges(spark, sf_dir).where("rel = 'hasLine'").withColumn("dst", looped), nodes)


@query(f"""WITH {INDEX}, w AS (SELECT kb_id, slug, max(status) AS status, count(*) AS n FROM doc_index WHERE status <> 'live' GROUP BY ALL),
p AS (SELECT slug, CASE WHEN slug % 3 = 0 THEN 'index' ELSE 'o:' || page_type END AS kind, slug % 6 < 2 AS claims, slug % 10 = 1 AS imported FROM order_pages WHERE len(source_refs) = 0 AND slug % 4 > 0)
SELECT 'C1' AS "check", 'high' AS severity, slug::VARCHAR AS subject, CASE WHEN claims THEN 'no source, but claimed' ELSE 'no source' END AS detail FROM p WHERE kind <> 'index' AND NOT imported
UNION ALL SELECT 'C2', 'high', slug::VARCHAR, status || ':' || n FROM w UNION ALL SELECT 'C3', 'low', slug::VARCHAR, 'claimed' FROM p WHERE kind = 'index' AND claims UNION ALL SELECT 'C4', 'medium', c_custkey::VARCHAR, 'no source' FROM customer WHERE c_custkey % 9 = 0 AND c_nationkey > 3""")
def c3_provenance_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, slug = order_pages(spark, sf_dir), F.col("slug")
    body = F.when(slug % 6 == 0, "so（来源：x）").when(slug % 6 == 1, "a <sources> b").otherwise("plain")
    told = pages.withColumns({"page_type": F.when(slug % 3 == 0, "index").otherwise(F.concat(F.lit("o:"), "page_type")), "content": body, "imported": slug % 10 == 1})
    c = F.col("c_custkey")
    nodes = table(spark, sf_dir, "customer").select(c.alias("node"), F.when(c % 9 > 0, c).alias("knowledge_id"), F.when(F.col("c_nationkey") < 4, "d").alias("source_doc"))
    return A.provenance_checks(L.doc_index(pages, part_docs(spark, sf_dir)), told, pages.where("slug % 4 = 0").select("slug"), nodes)


@query(f"""WITH RECURSIVE {CLOSURE}, b(class, prop, low, high) AS (VALUES (0, 'x', 1, 9), (1, 'x', 2, 6), (2, 'y', 3, 99)),
v AS (SELECT l_orderkey AS node, l_orderkey % 40 AS class, CASE WHEN l_linenumber % 2 = 0 THEN 'x' ELSE 'y' END AS prop FROM lineitem),
k AS (SELECT c.node AS class, prop, max(low) AS low, min(high) AS high FROM closure c JOIN b ON b.class = c.ancestor GROUP BY ALL), n AS (SELECT DISTINCT node, class FROM v),
j AS (SELECT n.node, k.prop, count(v.node) AS n, any_value(low) AS low, any_value(high) AS high FROM n JOIN k USING (class) LEFT JOIN v ON v.node = n.node AND v.prop = k.prop GROUP BY ALL)
SELECT node, prop, n, CASE WHEN n < low THEN 'too_few' ELSE 'too_many' END AS verdict FROM j WHERE n < low OR n > high""")
def c17_cardinality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = spark.createDataFrame([(0, "x", 1, 9), (1, "x", 2, 6), (2, "y", 3, 99)], "class bigint, prop string, low int, high int")
    v = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), (F.col("l_orderkey") % 40).alias("class"), F.when(F.col("l_linenumber") % 2 == 0, "x").otherwise("y").alias("prop"))
    return A.cardinality_checks(v, bounds, G.ancestors(subclasses(spark, sf_dir)))


HOLD = "h AS (SELECT l_suppkey AS holder, l_partkey % 100 AS held, l_quantity * 2.5 - 5 AS percent, l_returnflag = 'A' AS control, CASE WHEN l_linenumber > 1 THEN l_shipdate END AS as_of FROM lineitem)"


@query(f"""WITH {HOLD}, n AS (SELECT *, holder || '>' || held AS name FROM h) SELECT 'O1' AS "check", 'high' AS severity, name AS subject, round(percent, 2)::VARCHAR AS detail FROM n WHERE percent < 0 OR percent > 100
UNION ALL SELECT 'O2', 'medium', name, round(percent, 2)::VARCHAR FROM n WHERE percent >= 50 AND NOT control UNION ALL SELECT 'O3', 'low', s_suppkey::VARCHAR, '' FROM supplier WHERE s_suppkey % 7 = 0 UNION ALL SELECT 'O4', 'low', name, '' FROM n WHERE as_of IS NULL UNION ALL SELECT 'O5', 'high', name, '' FROM n WHERE holder = held""")
def c18_holding_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("holder"), (F.col("l_partkey") % 100).alias("held"), (F.col("l_quantity") * 2.5 - 5).alias("percent"),
        (F.col("l_returnflag") == "A").alias("control"), F.when(F.col("l_linenumber") > 1, F.col("l_shipdate")).alias("as_of"))
    entities = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), F.when(F.col("s_suppkey") % 7 > 0, F.col("s_nationkey")).alias("controller"))
    return A.holding_checks(h, entities)


USES = "u AS (SELECT 's' || l_suppkey % 12 AS service, l_orderkey AS operation, 'a' || l_partkey % 60 AS attribute, CASE l_returnflag WHEN 'A' THEN 'CR' WHEN 'N' THEN 'R' ELSE 'UD' END AS kinds FROM lineitem)"


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.when(F.col("l_returnflag") == "A", "CR").when(F.col("l_returnflag") == "N", "R").otherwise("UD")
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey") % 12).alias("service"), F.col("l_orderkey").alias("operation"), F.concat(F.lit("a"), F.col("l_partkey") % 60).alias("attribute"), kinds.alias("kinds"))


MATRIX = f"""{USES}, k AS (SELECT DISTINCT service, operation, attribute, unnest(string_split(kinds, '')) AS kind FROM u), r AS (SELECT 'a' || p_partkey AS attribute, CASE WHEN p_partkey % 4 = 0 THEN 'PK' WHEN p_partkey % 4 = 1 THEN 'FK' ELSE '' END AS role FROM part),
m AS (SELECT service, attribute, count(*) FILTER (kind = 'C') AS C, count(*) FILTER (kind = 'R') AS R, count(*) FILTER (kind = 'U') AS U, count(*) FILTER (kind = 'D') AS D FROM k GROUP BY ALL),
x AS (SELECT m.service, m.attribute, coalesce(role, '') AS key_role, C, R, U, D, C + U + D > 0 AS written FROM m LEFT JOIN r USING (attribute))"""


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    roles = table(spark, sf_dir, "part").select(F.concat(F.lit("a"), k).alias("attribute"), F.when(k % 4 == 0, "pk ").when(k % 4 == 1, "FK").otherwise("").alias("role"))
    return A.crud_matrix(_uses(spark, sf_dir), roles)


@query(f"WITH {MATRIX} SELECT * FROM x")
def a17_crud_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir)


@query(f"WITH {MATRIX} SELECT service, count(*) AS attributes, count(*) FILTER (written) AS written, count(*) FILTER (NOT written) AS read_only, count(*) FILTER (key_role <> '') AS keys FROM x GROUP BY 1")
def a17_crud_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.crud_totals(_matrix(spark, sf_dir))


@query(f"""WITH {USES}, w AS (SELECT attribute, list_sort(list(DISTINCT service)) AS s FROM u WHERE kinds <> 'R' GROUP BY 1) SELECT 'E1' AS "check", 'medium' AS severity, attribute AS subject, array_to_string(s, ',') AS detail FROM w WHERE len(s) > 1""")
def c6_write_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.write_conflicts(_uses(spark, sf_dir))


@query("""WITH sv AS (SELECT DISTINCT 's' || s_suppkey % 14 AS service FROM supplier), op AS (SELECT o_orderkey AS operation, 's' || o_custkey % 12 AS service, CASE WHEN o_orderkey % 9 > 0 THEN 'GET' END AS method, CASE WHEN o_orderkey % 4 = 0 THEN ' False' END AS idempotent, CASE WHEN o_orderkey % 8 = 0 THEN 'again' END AS retry FROM orders),
us AS (SELECT l_orderkey AS operation, 'a' || l_partkey % 400 AS attribute, CASE l_returnflag WHEN 'A' THEN 'cr' WHEN 'N' THEN 'R' ELSE 'UD' END AS kinds FROM lineitem WHERE l_linenumber = 1), dp AS (SELECT o_orderkey AS operation, o_orderkey + 1 AS needs FROM orders WHERE o_orderkey % 3 = 0),
ks AS (SELECT 'a' || p_partkey AS attribute, ['PK', 'unique ', 'FK', ''][1 + p_partkey % 4] AS role FROM part), rf AS (SELECT 'a' || p_partkey AS attribute, 'a' || (p_partkey * 3) % 2500 AS target FROM part WHERE p_partkey % 8 = 2),
ow AS (SELECT service, attribute, upper(kinds) AS kinds FROM us JOIN op USING (operation)), wr AS (SELECT DISTINCT attribute, service FROM ow WHERE regexp_matches(kinds, '[CUD]')), rd AS (SELECT DISTINCT attribute, service FROM ow WHERE contains(kinds, 'R')),
ot AS (SELECT * FROM rd WHERE (attribute, service) NOT IN (SELECT (attribute, service) FROM wr) AND attribute IN (SELECT attribute FROM wr)), th AS (SELECT DISTINCT a.service, b.service AS writer FROM dp JOIN op a ON a.operation = dp.operation JOIN op b ON b.operation = dp.needs),
de AS (SELECT DISTINCT ot.attribute, ot.service FROM ot JOIN wr ON wr.attribute = ot.attribute JOIN th ON th.service = ot.service AND th.writer = wr.service), ai AS (SELECT rf.*, upper(trim(role)) AS kind FROM rf LEFT JOIN ks ON ks.attribute = rf.target)
SELECT 'E1' AS "check", 'medium' AS severity, attribute AS subject, string_agg(service, ',' ORDER BY service) AS detail FROM wr GROUP BY attribute HAVING count(*) > 1
UNION ALL SELECT 'E2', 'low', attribute, 'declared ' || string_agg(service, ',' ORDER BY service) FROM de GROUP BY attribute UNION ALL SELECT 'E2', 'medium', attribute, 'direct ' || string_agg(service, ',' ORDER BY service) FROM ot WHERE (attribute, service) NOT IN (SELECT (attribute, service) FROM de) GROUP BY attribute
UNION ALL SELECT 'E3', 'low', service, 'no operations' FROM sv WHERE service NOT IN (SELECT service FROM op) UNION ALL SELECT 'E3', 'medium', operation::VARCHAR, 'no attributes' FROM op WHERE operation NOT IN (SELECT operation FROM us)
UNION ALL SELECT 'E3', 'low', operation::VARCHAR, 'no method' FROM op WHERE method IS NULL UNION ALL SELECT 'E3', 'low', operation::VARCHAR, 'no retry' FROM op WHERE idempotent IS NOT NULL AND retry IS NULL AND operation IN (SELECT operation FROM us WHERE kinds <> 'R')
UNION ALL SELECT 'E4', 'medium', attribute, 'no target' FROM ks WHERE role = 'FK' AND attribute NOT IN (SELECT attribute FROM rf) UNION ALL SELECT 'E4', 'medium', attribute, 'missing ' || target FROM ai WHERE kind IS NULL UNION ALL SELECT 'E4', 'medium', attribute, 'no key ' || target FROM ai WHERE kind NOT IN ('PK', 'UNIQUE')""")
def c6_service_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, p = F.col("o_orderkey"), F.col("p_partkey")
    orders, part = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    named = lambda prefix, c: F.concat(F.lit(prefix), c)
    services = table(spark, sf_dir, "supplier").select(named("s", F.col("s_suppkey") % 14).alias("service")).distinct()
    operations = orders.select(o.alias("operation"), named("s", F.col("o_custkey") % 12).alias("service"), F.when(o % 9 > 0, "GET").alias("method"), F.when(o % 4 == 0, " False").alias("idempotent"), F.when(o % 8 == 0, "again").alias("retry"))
    kinds = F.when(F.col("l_returnflag") == "A", "cr").when(F.col("l_returnflag") == "N", "R").otherwise("UD")
    uses = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("operation"), named("a", F.col("l_partkey") % 400).alias("attribute"), kinds.alias("kinds"))
    depends = orders.where("o_orderkey % 3 = 0").select(o.alias("operation"), (o + 1).alias("needs"))
    keys = part.select(named("a", p).alias("attribute"), F.get(F.array(*[F.lit(r) for r in ("PK", "unique ", "FK", "")]), (p % 4).cast("int")).alias("role"))
    return A.service_design(services, operations, uses, depends, keys, part.where("p_partkey % 8 = 2").select(named("a", p).alias("attribute"), named("a", p * 3 % 2500).alias("target")))


@query("""WITH m AS (SELECT p_partkey AS slug, 1 + p_partkey % 3 AS version FROM part WHERE p_partkey % 11 <> 0), r AS (SELECT p_partkey AS slug, sha1(p_name) AS hash, CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE sha1(p_name) END AS synced_hash, CASE WHEN p_partkey % 7 > 0 THEN 1 + p_partkey % 2 END AS synced_version FROM part)
SELECT slug, CASE WHEN synced_version IS NULL THEN 'unbound' WHEN version IS NULL THEN 'master_missing' WHEN hash <> synced_hash THEN 'local_drift' WHEN synced_version < version THEN 'outdated' ELSE 'in_sync' END AS state FROM r LEFT JOIN m USING (slug)""")
def r3_replica_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("slug", F.col("p_partkey")).withColumn("hash", F.sha1(F.col("p_name").cast("binary")))
    masters = p.where("slug % 11 != 0").select("slug", (1 + F.col("slug") % 3).alias("version"))
    replicas = p.select("slug", "hash", F.when(F.col("slug") % 5 == 0, "x").otherwise(F.col("hash")).alias("synced_hash"), F.when(F.col("slug") % 7 > 0, 1 + F.col("slug") % 2).alias("synced_version"))
    return A.replica_state(masters, replicas)


@query("""WITH a AS (SELECT p_partkey AS slug, unnest(['x:name', 'brand', 'y:size', 'skipped', 'j']) AS key, unnest([p_name || ' ', p_brand, p_size::VARCHAR, p_type, '{"b": 1, "a": ' || p_size || '}']) AS v FROM part),
b AS (SELECT p_partkey AS slug, unnest(['name', 'brand', 'type', 'j']) AS key, unnest([p_name, CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE p_brand END, p_type, '{"a":' || CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size END || ',"b":1}']) AS v FROM part WHERE p_partkey % 10 <> 0),
c AS (SELECT slug, split_part(key, ':', -1) AS key, CASE WHEN key = 'j' THEN regexp_replace(v, '^.*"a": ([0-9]+).*$', '{"a":\\1,"b":1}') ELSE trim(v) END AS v FROM a WHERE key <> 'skipped'),
d AS (SELECT c.slug, array_to_string(list_sort(list(DISTINCT c.key)), ',') AS keys FROM c LEFT JOIN b ON b.slug = c.slug AND b.key = c.key WHERE c.v <> coalesce(b.v, '') GROUP BY 1)
SELECT slug, slug % 10 = 0 AS missing, CASE WHEN slug % 10 <> 0 THEN keys END AS keys FROM d""")
def j18_attribute_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("slug", F.col("p_partkey"))
    size = F.col("p_size").cast("string")
    a = p.select("slug", F.create_map(F.lit("x:name"), F.concat("p_name", F.lit(" ")), F.lit("brand"), "p_brand", F.lit("y:size"), size, F.lit("skipped"), "p_type", F.lit("j"), F.concat(F.lit('{"b": 1, "a": '), size, F.lit("}"))).alias("attrs"))
    brand = F.when(F.col("slug") % 3 == 0, "x").otherwise(F.col("p_brand"))
    told = F.concat(F.lit('{"a":'), F.when(F.col("slug") % 4 == 0, "0").otherwise(size), F.lit(',"b":1}'))
    b = p.where("slug % 10 != 0").select("slug", F.create_map(F.lit("name"), "p_name", F.lit("brand"), brand, F.lit("type"), "p_type", F.lit("j"), told).alias("attrs"))
    return A.attribute_drift(a, b, ("skipped",))


@query("""WITH t AS (SELECT p_partkey AS slug, 'n' AS key, 0 AS carrier, p_name AS value FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'n', 1, p_brand FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT p_partkey, 'n', 2, p_name FROM part WHERE p_partkey % 5 <> 0
  UNION ALL SELECT p_partkey, 'd', 2, p_type FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT p_partkey, 'd', 0, ' ' || p_type FROM part WHERE p_partkey % 14 = 0), s AS (SELECT p_partkey AS slug, 'd' AS key, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE ' ' END AS summary FROM part WHERE p_partkey % 11 > 2),
f AS (SELECT slug, min(carrier) AS first FROM t GROUP BY 1), k AS (SELECT slug, key, max(trim(value)) FILTER (carrier = first) AS value, min(trim(value)) AS low, max(trim(value)) AS high FROM t JOIN f USING (slug) GROUP BY ALL), u AS (SELECT * FROM s WHERE trim(summary) <> '')
SELECT slug, key, CASE first WHEN 0 THEN 'meta' WHEN 1 THEN 'graph' WHEN 2 THEN 'body' ELSE 'none' END AS source, value, coalesce(low <> high, false) OR (summary IS NOT NULL AND (low IS DISTINCT FROM summary OR high IS DISTINCT FROM summary)) AS drift FROM k FULL JOIN u USING (slug, key) LEFT JOIN f USING (slug)""")
def j24_three_way_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("slug", F.col("p_partkey"))
    take = lambda cond, key, c: p.where(cond).select("slug", F.lit(key).alias("key"), c.alias("value"))
    name, kind = F.col("p_name"), F.col("p_type")
    meta = take("slug % 3 = 0", "n", name).unionByName(take("slug % 14 = 0", "d", F.concat(F.lit(" "), kind))).unionByName(take("slug % 6 = 0", "articleBody", name))
    body = take("slug % 5 != 0", "n", name).unionByName(take("slug % 7 = 0", "d", kind))
    summaries = take("slug % 11 > 2", "d", F.when(F.col("slug") % 2 == 0, kind).otherwise(" "))
    return A.three_way_drift(meta, take("slug % 4 = 0", "n", F.col("p_brand")), body, summaries, ("articleBody",))


@query(rf"""WITH RECURSIVE {KB_PAGES}, p AS (SELECT *, regexp_replace(lower(title), '[\s[:punct:]]+', '', 'g') AS k1, regexp_replace(lower(summary), '[\s[:punct:]]+', '', 'g') AS k2,
  list_distinct(list_filter(string_split_regex(content, '\s+'), lambda w: length(w) > 6)) AS rels, [substr(summary, i::INT, 3) FOR i IN range(1, greatest(1, length(summary) - 2) + 1) IF length(summary) > 0] AS g FROM kb_pages WHERE NOT deleted),
links AS (SELECT a.page_id AS a, b.page_id AS b FROM p a JOIN p b ON a.k1 = b.k1 OR a.k2 = b.k2),
walk AS (SELECT page_id, page_id AS other FROM p UNION SELECT w.page_id, l.b FROM walk w JOIN links l ON l.a = w.other), c AS (SELECT page_id, min(other) AS grp FROM walk GROUP BY 1),
q AS (SELECT p.*, grp, map_from_entries([(x, len(list_filter(g, lambda y: y = x))) FOR x IN list_distinct(g)]) AS n FROM p JOIN c USING (page_id)),
d AS (SELECT *, sqrt(list_sum([v * v FOR v IN map_values(n)])) AS norm FROM q),
pairs AS (SELECT a.grp, CASE WHEN len(a.g) = 0 OR len(b.g) = 0 THEN 0 ELSE list_sum([a.n[x] * coalesce(b.n[x], 0) FOR x IN map_keys(a.n)]) / (a.norm * b.norm) END AS cosine,
  CASE WHEN len(a.rels) + len(b.rels) = 0 THEN 1 ELSE len(list_intersect(a.rels, b.rels)) / len(list_distinct(a.rels || b.rels)) END AS jac FROM d a JOIN d b ON a.grp = b.grp AND a.page_id < b.page_id),
m AS (SELECT grp, round(avg(cosine), 4) AS definition, round(avg(jac), 4) AS relations FROM pairs GROUP BY 1),
s AS (SELECT grp, count(DISTINCT kb_id) AS kbs, count(*) AS members, count(DISTINCT nullif(k1, '')) = 1 AS title, count(DISTINCT nullif(page_type, '')) = 1 AS type FROM q GROUP BY grp HAVING count(DISTINCT kb_id) > 1),
t AS (SELECT *, CASE WHEN title AND type AND definition >= 0.95 AND relations >= 0.8 THEN 0.99 ELSE round(0.45 * definition + 0.25 * relations + 0.15 * type::INT + 0.15 * title::INT, 4) END AS score FROM s JOIN m USING (grp)),
v AS (SELECT *, CASE WHEN score >= 0.9 THEN 'equivalent' WHEN score <= 0.55 THEN 'distinct' ELSE 'unknown' END AS verdict FROM t),
f AS (SELECT *, CASE WHEN verdict = 'distinct' THEN round(1 - score, 4) ELSE score END AS confidence FROM v) SELECT *, verdict <> 'unknown' AND confidence >= 0.95 AS auto FROM f""")
def r1_context_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = kb_pages(spark, sf_dir).where(~F.col("deleted"))
    p = p.withColumn("relations", F.filter(F.split("content", r"\s+"), lambda w: F.length(w) > 6))
    keyed = p.select("page_id", T.norm_title(F.col("title")).alias("k1"), T.norm_title(F.col("summary")).alias("k2"))
    groups = G.key_components(keyed, "page_id", ["k1", "k2"]).withColumnRenamed("component", "grp")
    return A.order_candidates(A.context_scan(p, groups))


@query(r"""WITH n AS (SELECT DISTINCT 'P-' || l_linenumber AS name FROM lineitem UNION SELECT 'Q' || s_suppkey FROM supplier)
SELECT name, regexp_replace(name, '\d+$', '') AS stem, row_number() OVER (PARTITION BY regexp_replace(name, '\d+$', '') ORDER BY regexp_extract(name, '(\d+)$', 1)::BIGINT, name)::INTEGER AS place FROM n""")
def o3_natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("P-"), "l_linenumber").alias("name")).union(table(spark, sf_dir, "supplier").select(F.concat(F.lit("Q"), "s_suppkey"))).distinct()
    return A.natural_order(names, "name")


@query(r"""WITH c AS (SELECT conv_id * 100 + turn AS case_id, text, role AS steps, CASE WHEN conv_id % 2 = 0 THEN 'the' ELSE 'on' END AS expected, ['ing', role[1:3]] AS patterns, [CASE WHEN conv_id % 3 = 0 THEN 'ention' ELSE 'er' END, 'nd'] AS forbidden,
  ['ç'] AS markers, CASE WHEN turn % 2 = 0 THEN ['a'] ELSE [] END AS required FROM conversations),
p AS (SELECT case_id, claim, i FROM c, unnest(forbidden) f(claim), unnest(range(1, length(text) + 1)) u(i) WHERE substr(text, i, length(claim)) = claim),
f AS (SELECT DISTINCT p.case_id FROM p JOIN c USING (case_id) WHERE NOT regexp_matches(substr(text, greatest(1, i - 18), i - greatest(1, i - 18)), '(the|is|le|en)[^。；\n]{0,12}$')),
k AS (SELECT case_id, contains(text, expected) AND (expected <> 'on' OR regexp_matches(text, '(^|[^it])on')) AS verdict, len(list_filter(patterns, lambda x: NOT contains(text, x) AND NOT contains(steps, x))) = 0 AS patterns,
  case_id NOT IN (SELECT case_id FROM f) AS clean, NOT contains(text, 'ç') AS unleaked, len(list_filter(required, lambda x: NOT contains(text, x))) = 0 AS required, trim(text) <> '' AS nonempty FROM c)
SELECT *, verdict AND patterns AND clean AND unleaked AND required AND nonempty AS passed FROM k""")
def a25_score_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").withColumn("case_id", F.col("conv_id") * 100 + F.col("turn"))
    texts = lambda *items: F.array(*[F.lit(x) for x in items]) if items else F.array().cast("array<string>")
    cases = t.select("case_id", F.when(F.col("conv_id") % 2 == 0, "the").otherwise("on").alias("expected"), F.array(F.lit("ing"), F.substring("role", 1, 3)).alias("patterns"),
        F.array(F.when(F.col("conv_id") % 3 == 0, "ention").otherwise("er"), F.lit("nd")).alias("forbidden"), texts("ç").alias("markers"), F.when(F.col("turn") % 2 == 0, texts("a")).otherwise(texts()).alias("required"))
    return A.score_cases(t.select("case_id", "text", F.col("role").alias("steps")), cases, ("the", "is", "le", "en"), {"on": "it"})


@query(f"""WITH {KB_PAGES} SELECT kb_id, any_value(pages) AS pages, any_value(deleted) AS deleted, count(e.k) AS edges FROM (SELECT kb_id, count(*) AS pages, count(*) FILTER (deleted) AS deleted FROM kb_pages GROUP BY 1) p
LEFT JOIN (SELECT 'src' || l_suppkey % 40 AS k FROM lineitem) e ON e.k = p.kb_id GROUP BY kb_id""")
def c23_purge_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("src"), F.col("l_suppkey") % 40).alias("kb_id"))
    return A.purge_scan(kb_pages(spark, sf_dir), {"edges": e})


@query("""WITH c AS (SELECT p_partkey AS contract, sha1(p_name) AS hash FROM part WHERE p_partkey % 11 <> 0), b AS (SELECT l_orderkey * 10 + l_linenumber AS binding, l_partkey AS contract, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 'old' ELSE sha1(p_name) END AS stored FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT binding, CASE WHEN hash IS NULL THEN 'orphan' WHEN stored IS NULL THEN 'unstamped' ELSE 'stale' END AS state FROM b LEFT JOIN c USING (contract) WHERE hash IS NULL OR stored IS NULL OR stored <> hash""")
def c22_contract_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("contract"), F.sha1(F.col("p_name").cast("binary")).alias("hash"))
    b = table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("contract"))
    stored = F.when(F.col("l_linenumber") == 2, "old").when(F.col("l_linenumber") > 2, F.col("hash"))
    return A.contract_drift(b.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("binding"), "contract", stored.alias("stored")), p.where("contract % 11 != 0"))


@query("""WITH l AS (SELECT doc_id AS page, unnest(string_split(text, chr(10))) AS title FROM documents), h AS (SELECT page, title FROM l WHERE title <> ''), t(type, section) AS (VALUES ('en', 'The '), ('en', 'Is '), ('fr', 'Le '), ('de', 'Der')),
w AS (SELECT doc_id AS page, section FROM documents JOIN t ON type = lang), m AS (SELECT DISTINCT w.page, section FROM w JOIN h USING (page) WHERE contains(title, section) OR contains(section, title))
SELECT page, array_to_string(list_sort(list(DISTINCT section)), ',') AS missing FROM w ANTI JOIN m USING (page, section) GROUP BY page""")
def a27_template_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = X.lines_of(docs.select(F.col("doc_id").alias("doc"), "text")).where("line != ''")
    headings = lines.select(F.col("doc").alias("page"), F.col("line").alias("title"))
    templates = spark.createDataFrame([("en", "The "), ("en", "Is "), ("fr", "Le "), ("de", "Der")], "type string, section string")
    return A.template_usage(headings, templates, docs.select(F.col("doc_id").alias("page"), F.col("lang").alias("type")))


TEMPLATES = """t AS (SELECT * FROM (VALUES ('t-en', ['en0', 'en1'], ['The ', 'Is ', 'zzz']), ('t-fr', ['fr0', ''], ['Le ']), ('t-fr2', ['fr0', 'fr1'], ['La ']), ('t-none', ['de0'], []::VARCHAR[]), ('t-loose', []::VARCHAR[], ['Der']), ('t-de', ['de1'], ['Der', 'Und'])) v(template, types, sections)),
p AS (SELECT doc_id AS page, lang || doc_id % 2 AS type FROM documents), f AS (SELECT type, count(*) AS fits, min(template) AS template, string_agg(template, ',' ORDER BY template) AS names FROM (SELECT template, unnest(types) AS type FROM t) WHERE type <> '' GROUP BY 1),
k AS (SELECT page, coalesce(fits, 0) AS fits, template, names FROM p LEFT JOIN f USING (type))"""


def _templates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    lines = X.lines_of(docs.select(F.col("doc_id").alias("doc"), "text"))
    templates = [("t-en", ["en0", "en1"], ["The ", "Is ", "zzz"]), ("t-fr", ["fr0", ""], ["Le "]), ("t-fr2", ["fr0", "fr1"], ["La "]), ("t-none", ["de0"], []), ("t-loose", [], ["Der"]), ("t-de", ["de1"], ["Der", "Und"])]
    pages = docs.select(F.col("doc_id").alias("page"), F.concat("lang", F.col("doc_id") % 2).alias("type"))
    return pages, lines.select(F.col("doc").alias("page"), F.col("line").alias("title")), spark.createDataFrame(templates, "template string, types array<string>, sections array<string>")


@query(f"""WITH {TEMPLATES}, h AS (SELECT doc_id AS page, unnest(string_split(text, chr(10))) AS title FROM documents), w AS (SELECT page, k.template, unnest(list_distinct(sections)) AS section FROM k JOIN t ON t.template = k.template WHERE fits = 1),
m AS (SELECT DISTINCT w.page, section FROM w JOIN h USING (page) WHERE title <> '' AND (contains(title, section) OR contains(section, title)))
SELECT 'T1' AS "check", 'medium' AS severity, page::VARCHAR AS subject, template || ': ' || string_agg(section, ',' ORDER BY section) AS detail FROM w WHERE (page, section) NOT IN (SELECT (page, section) FROM m) GROUP BY page, template
UNION ALL SELECT 'T2', 'low', page::VARCHAR, 'several: ' || names FROM k WHERE fits > 1 UNION ALL SELECT 'T2', 'low', template, 'no sections' FROM t WHERE len(sections) = 0 UNION ALL SELECT 'T2', 'low', template, 'no types' FROM t WHERE len(types) = 0""")
def c11_template_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.template_sections(*_templates(spark, sf_dir))


@query(f"""WITH {TEMPLATES} SELECT count(*) AS pages, count(*) FILTER (fits = 1) AS checked, count(*) FILTER (fits = 0) AS no_template, count(*) FILTER (fits > 1) AS ambiguous, (SELECT count(*) FROM t) AS templates FROM k""")
def a27_template_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, _, templates = _templates(spark, sf_dir)
    return A.template_totals(pages, templates)
