"""Queries over logs, mappings, standards and ontology checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import design as B
from lorekeep.operators import governance as V
from lorekeep.operators import graphs as G
from lorekeep.operators import lineage as L
from lorekeep.operators import texts as X
from lorekeep.plans.fixtures import SUBCLASSES, order_pages, part_docs, subclasses, table
from lorekeep.plans.graphs import CLOSURE
from lorekeep.plans.lineage import INDEX
from lorekeep.plans.registry import query
from lorekeep.sources import logs as S


@query("""SELECT CASE WHEN event_id % 3 = 0 THEN 'hint' ELSE 'plain' END AS arm, CASE WHEN event_id % 3 > 0 THEN 'q' || user_id ELSE '' END AS qid, json_extract_string(props, '$.k')::INTEGER AS hits,
  CASE WHEN event_id % 2 = 0 THEN value ELSE 7.5 END AS ms, CASE WHEN event_id % 4 = 0 THEN 3 ELSE 0 END AS queries, event_id % 4 = 0 AS has_io FROM events WHERE event_id % 11 <> 0""")
def s4_read_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    told = F.to_json(F.struct(
        F.lit("2024-01-01 00:00:00").alias("ts"), F.when(i % 2 > 0, F.lit(7.5)).alias("ms"),
        F.struct(F.when(i % 3 > 0, F.concat(F.lit("q"), "user_id")).alias("qid"), F.get_json_object("props", "$.k").cast("int").alias("hits"), F.when(i % 2 == 0, F.col("value")).alias("ms"),
            F.when(i % 4 == 0, F.struct(F.lit(3).alias("queries"), F.lit(1).alias("pg"))).alias("retrieval"), F.when(i % 3 == 0, F.struct(F.lit("hint").alias("arm"))).alias("ab")).alias("telemetry")))
    lines = e.select(F.when(i % 11 == 0, F.lit("{broken")).otherwise(told).alias("value"))
    return S.read_telemetry(lines).drop("ts", "question")


@query("""SELECT 'f' || event_id AS args_file, event_type AS tool, 'T' || user_id AS began, CASE WHEN event_id % 5 <> 0 THEN floor(value)::BIGINT END AS ms, CASE WHEN event_id % 5 <> 0 THEN props END AS result, CASE WHEN event_id % 5 <> 0 THEN 'done' ELSE 'timeout' END AS shape FROM events""")
def s6_read_call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    file = F.concat(F.lit("args_file=f"), "event_id")
    begin = e.select(F.concat(F.lit("T"), "user_id", F.lit(" "), "event_type", F.lit(" BEGIN "), file).alias("value"))
    done = e.where("event_id % 5 != 0").select(F.concat(F.lit("T "), "event_type", F.lit(" "), F.floor("value"), F.lit("ms DONE "), file, F.lit(" result="), "props").alias("value"))
    return S.read_call_log(begin.unionByName(done))


@query("""WITH e AS (SELECT *, user_id AS request, event_id % 5 AS round, floor(value)::BIGINT AS v FROM events), u AS (SELECT request, count(*) AS usages, sum(v)::BIGINT AS used, 's' || max(event_id) AS session FROM e GROUP BY 1)
SELECT request, round, arg_max(v, event_id) FILTER (event_id % 2 = 0) AS prompt, arg_max(2 * v, event_id) AS actual, arg_min(v, event_id) FILTER (event_id % 3 > 0) AS context, session, usages, used FROM e JOIN u USING (request) GROUP BY ALL""")
def s7_read_context_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("v", F.floor("value"))
    head = F.concat(F.lit("x request="), "user_id", F.lit(" round="), F.col("event_id") % 5)
    told = lambda rows, step, *parts: rows.select((F.col("event_id") * 10 + step).alias("line_no"), F.concat(*parts).alias("value"))
    lines = told(e.where("event_id % 2 = 0"), 0, head, F.lit(" prompt="), "v").unionByName(told(e.where("event_id % 3 > 0"), 1, head, F.lit(" context="), "v"))
    lines = lines.unionByName(told(e, 2, head, F.lit(" actual="), F.col("v") * 2)).unionByName(told(e, 3, F.lit("request="), "user_id", F.lit(" usage="), "v"))
    return S.read_context_log(lines.unionByName(told(e, 4, F.lit("request="), "user_id", F.lit(" session=s"), "event_id")))


@query("""WITH m AS (SELECT l_orderkey AS concept, l_linenumber AS pos, min(l_partkey) AS member FROM lineitem GROUP BY ALL) SELECT x.concept, x.member AS a, y.member AS b FROM m x JOIN m y ON x.concept = y.concept AND x.pos < y.pos""")
def r2_mapping_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("concept"), F.col("l_linenumber").alias("pos")).agg(F.min("l_partkey").alias("member"))
    return V.mapping_pairs(m)


PAIRS = "m AS (SELECT l_orderkey * 10 + l_linenumber AS pair_id, l_partkey AS a, l_suppkey AS b, CASE l_returnflag WHEN 'A' THEN 'same' WHEN 'N' THEN 'wider' ELSE 'odd' END AS kind, CASE WHEN l_linenumber = 3 THEN 'h0' ELSE 'h' || l_suppkey END AS hash_b FROM lineitem), p AS (SELECT p_partkey AS slug, 'h' || p_partkey AS hash FROM part WHERE p_partkey % 13 <> 0)"


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    kind = F.when(F.col("l_returnflag") == "A", "same").when(F.col("l_returnflag") == "N", "wider").otherwise("odd")
    stored = F.when(F.col("l_linenumber") == 3, "h0").otherwise(F.concat(F.lit("h"), "l_suppkey"))
    pairs = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pair_id"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), kind.alias("kind"), stored.alias("hash_b"))
    return pairs, table(spark, sf_dir, "part").where("p_partkey % 13 != 0").select(F.col("p_partkey").alias("slug"), F.concat(F.lit("h"), "p_partkey").alias("hash"))


@query(f"""WITH {PAIRS}, r AS (SELECT b AS a, a AS b, min(kind) AS lo, max(kind) AS hi FROM m GROUP BY ALL),
x AS (SELECT pair_id, CASE WHEN kind NOT IN ('same', 'wider') THEN 'bad_kind' WHEN pa.slug IS NULL OR pb.slug IS NULL THEN 'missing' WHEN hash_b <> pb.hash THEN 'stale' WHEN lo <> kind OR hi <> kind THEN 'contradicted' END AS problem
  FROM m LEFT JOIN p pa ON pa.slug = m.a LEFT JOIN p pb ON pb.slug = m.b LEFT JOIN r ON r.a = m.a AND r.b = m.b) SELECT * FROM x WHERE problem IS NOT NULL""")
def r4_mapping_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.mapping_health(*_pairs(spark, sf_dir), ["same", "wider"])


@query(f"WITH {PAIRS} SELECT pair_id, NOT (a IN (SELECT slug FROM p) AND b IN (SELECT slug FROM p)) AS detached FROM m")
def r5_archive_detached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.archive_detached(*_pairs(spark, sf_dir))


@query("""WITH s AS (SELECT CASE o_orderstatus WHEN 'O' THEN 'draft' WHEN 'F' THEN 'approved' ELSE 'retired' END AS state, o_orderdate AS updated, o_orderkey % 5 <> 0 AS same FROM orders)
SELECT state, count(*) AS pages, count(*) FILTER (state = 'draft' AND date_diff('day', updated::DATE, DATE '1998-06-01') > 14) AS old_drafts, count(*) FILTER (state = 'approved' AND NOT same) AS changed FROM s GROUP BY state""")
def r6_standards_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "draft").when(F.col("o_orderstatus") == "F", "approved").otherwise("retired")
    s = table(spark, sf_dir, "orders").select(state.alias("state"), F.col("o_orderdate").cast("date").alias("updated"), F.lit("h").alias("hash"), F.when(F.col("o_orderkey") % 5 != 0, "h").otherwise("x").alias("approved_hash"))
    return V.standards_review(s, F.lit("1998-06-01").cast("date"))


@query("""WITH g AS (SELECT p_name AS key, count(DISTINCT p_brand) AS kbs, count(*) AS members, count(*) FILTER (p_partkey % 97 = 0) AS decided FROM part GROUP BY 1) SELECT *, CASE WHEN decided = 0 THEN 'same_name_no_decision' ELSE '' END AS warning FROM g WHERE kbs > 1""")
def j22_same_name_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("key"), F.col("p_brand").alias("kb_id"), F.col("p_partkey").alias("page_id"))
    return V.same_name_group(p, p.where("page_id % 97 = 0").select("page_id"))


@query(f"""WITH RECURSIVE {SUBCLASSES}, f AS (SELECT child, parent FROM subclasses WHERE first), w AS (SELECT p_partkey AS page, p_partkey AS last, p_partkey::VARCHAR AS path, 0 AS n FROM part
  UNION ALL SELECT page, coalesce(parent, last), CASE WHEN parent IS NULL THEN path ELSE parent || '/' || path END, n + 1 FROM w LEFT JOIN f ON child = last WHERE n < 3) SELECT page, path FROM w WHERE n = 3""")
def g16_category_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), F.col("p_partkey").alias("class"))
    return V.category_path(pages, subclasses(spark, sf_dir).where("first"), 3)


_WAYS = ["自维护", "引用外部", "只读缓存", "", "自维护（主）", "other"]


@query(f"""WITH l AS (SELECT 's' || l_suppkey % 12 AS service, l_partkey % 70 AS a, l_suppkey % 90 AS b, l_orderkey, l_linenumber, l_partkey FROM lineitem),
own AS (SELECT DISTINCT service, 'Obj.A' || a || '（x）' AS attribute, 'a' || a AS key, {_WAYS}[1 + (l_partkey + l_linenumber) % 6] AS way FROM l WHERE l_orderkey % 7 = 0),
fd AS (SELECT DISTINCT 'f' || l_orderkey % 60 AS title, CASE WHEN l_linenumber = 1 THEN 'determinant' ELSE 'dependent' END AS role, 'a' || b AS key FROM l WHERE l_orderkey % 11 = 0),
owners AS (SELECT key, count(*) AS n, list_sort(list(DISTINCT service)) AS services FROM own WHERE contains(way, '自维护') GROUP BY key),
det AS (SELECT key, min(title) AS title FROM fd WHERE role = 'determinant' GROUP BY key), dep AS (SELECT key, min(title) AS title FROM fd WHERE role = 'dependent' GROUP BY key),
rightful AS (SELECT title, list(DISTINCT s) AS r FROM (SELECT title, unnest(services) AS s FROM fd JOIN owners USING (key) WHERE role = 'determinant') GROUP BY title),
outs AS (SELECT key, list_sort(list_filter(services, lambda s: NOT list_contains(r, s))) AS o FROM owners JOIN dep USING (key) JOIN rightful USING (title)),
svc AS (SELECT 's' || s_suppkey AS service, s_suppkey % 4 = 0 AS rootless, s_suppkey % 3 AS n, 'Obj.A' || s_suppkey * 7 % 90 || ' + `a' || s_suppkey % 90 || '`' AS keys, 'a' || s_suppkey * 7 % 90 AS k1, 'a' || s_suppkey % 90 AS k2 FROM supplier)
SELECT 'F1' AS "check", 'low' AS severity, service AS subject, attribute || ':' || way AS detail FROM own WHERE way IN ('', 'other')
UNION ALL SELECT 'F1', CASE WHEN key IN (SELECT key FROM det) THEN 'critical' ELSE 'high' END, key, array_to_string(services, ',') FROM owners WHERE n > 1
UNION ALL SELECT 'F2', 'medium', title, key FROM det WHERE key NOT IN (SELECT key FROM owners)
UNION ALL SELECT 'F3', 'high', key, array_to_string(o, ',') FROM outs WHERE len(o) > 0
UNION ALL SELECT 'F4', 'high', service, keys FROM svc WHERE k1 NOT IN (SELECT key FROM det) AND k2 NOT IN (SELECT key FROM det)
UNION ALL SELECT 'F5', 'high', service, '' FROM svc WHERE rootless UNION ALL SELECT 'F6', 'medium', service, 'e1,e2' FROM svc WHERE n = 2""")
def c7_dependency_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, s = table(spark, sf_dir, "lineitem"), F.col("s_suppkey")
    name = lambda p, c, n: F.concat(F.lit(p), F.col(c) % n)
    way = F.get(F.array(*[F.lit(w) for w in _WAYS]), ((F.col("l_partkey") + F.col("l_linenumber")) % 6).cast("int"))
    own = lines.where("l_orderkey % 7 = 0").select(
        name("s", "l_suppkey", 12).alias("service"), F.concat(name("Obj.A", "l_partkey", 70), F.lit("（x）")).alias("attribute"), way.alias("way")
    ).distinct()
    role = F.when(F.col("l_linenumber") == 1, "determinant").otherwise("dependent")
    dependencies = lines.where("l_orderkey % 11 = 0").select(name("f", "l_orderkey", 60).alias("title"), role.alias("role"), name("ea:Thing.a", "l_suppkey", 90).alias("attribute")).distinct()
    keys = F.concat(F.lit("Obj.A"), s * 7 % 90, F.lit(" + `a"), s % 90, F.lit("`"))
    services = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), s).alias("service"), F.when(s % 4 > 0, F.array(F.lit("need/x"))).alias("derived_from"),
        F.slice(F.array(F.lit("e1"), F.lit("e2")), F.lit(1), (s % 3).cast("int")).alias("entities"), keys.alias("keys"),
    )
    return B.dependency_check(services, own, services.select("service", "keys"), dependencies)


@query("""WITH l AS (SELECT doc_id AS doc, i - 1 AS place, s[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) u(i)), k AS (SELECT item_id AS item, split_part(text, ' ', 3) AS keyword FROM benchmark WHERE length(split_part(text, ' ', 3)) > 5)
SELECT item, doc, place::INTEGER AS place FROM l JOIN k ON contains(line, keyword) QUALIFY row_number() OVER (PARTITION BY item, doc ORDER BY place) <= 5""")
def t20_candidate_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.split("text", " "), 3)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), word.alias("keyword")).where(F.length("keyword") > 5)
    return V.candidate_facts(items, X.lines_of(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")))


@query("""SELECT p_partkey AS slug, p_name AS title, p_brand AS maker FROM part WHERE p_partkey % 2 = 0""")
def l6_upgrade_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    old = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("slug"), F.create_map(F.lit("name"), "p_name", F.lit("maker"), "p_brand").alias("attrs"))
    new = p.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("slug"), F.create_map(F.lit("title"), "p_name", F.lit("maker"), "p_brand").alias("attrs"))
    names = spark.createDataFrame([("name", "title"), ("brand", "maker")], "old string, new string")
    found = V.rename_attributes(old.unionByName(new), names)
    return found.select("slug", F.col("attrs")["title"].alias("title"), F.col("attrs")["maker"].alias("maker"))


@query("""WITH l AS (SELECT l_orderkey AS k, list(l_partkey ORDER BY l_linenumber, l_partkey) FILTER (l_linenumber <= 3) AS a, list(l_partkey ORDER BY l_linenumber, l_partkey) FILTER (l_linenumber > 2) AS b FROM lineitem GROUP BY 1)
SELECT k, len(list_distinct(list_concat(a, b)))::INTEGER AS merged, (len(list_distinct(list_concat(a, b))) - len(list_distinct(a)))::INTEGER AS added FROM l WHERE a IS NOT NULL AND b IS NOT NULL""")
def u6_merge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, p = F.col("l_linenumber"), F.struct("l_linenumber", "l_partkey")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.when(n <= 3, p))).alias("a"), F.array_sort(F.collect_list(F.when(n > 2, p))).alias("b"))
    part = lambda c: F.transform(c, lambda s: s["l_partkey"])
    out = V.merge_lines(part("a"), part("b"))
    return lines.where((F.size("a") > 0) & (F.size("b") > 0)).select("k", F.size(out["merged"]).alias("merged"), out["added"].alias("added"))


CONTEXT = """p AS (SELECT 'k' || p_partkey % 4 AS kb_id, 's' || p_partkey // 2 AS slug, 'h' || p_size AS hash, 1 + p_partkey % 3 AS version, CASE WHEN p_partkey % 6 < 3 THEN 'k0' END AS concept_kb,
  CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 's' || p_partkey % 500 WHEN 2 THEN 'c' || p_partkey END AS concept, ['s' || p_partkey % 300, 's' || (p_partkey * 7) % 2500] AS links FROM part),
m AS (SELECT 'k' || o_orderkey % 4 AS source_kb, CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE 's' || o_custkey % 90 END AS source, 'k' || o_orderkey % 3 AS target_kb, 's' || (o_custkey * 3) % 90 AS target, ['equivalent', 'rename', 'unrelated', 'odd', 'rename'][1 + o_orderkey % 5] AS kind,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'h' || o_custkey % 50 END AS source_hash, '' AS target_hash, 1 + o_orderkey % 2 AS source_version, 2 AS target_version FROM orders),
u AS (SELECT 'g' || c_custkey % 60 AS grp, 'k' || c_nationkey % 4 AS kb_id, 's' || c_custkey % 90 AS slug FROM customer), c AS (SELECT 'k' || s_suppkey % 4 AS kb_id, 's' || s_suppkey // 2 AS slug, 'h' || s_nationkey AS hash FROM supplier)"""


@query(f"""WITH {CONTEXT}, w AS (SELECT *, coalesce(nullif(source, ''), '?') || ' > ' || coalesce(nullif(target, ''), '?') AS label, source <> '' AND target <> '' AS named FROM m),
s AS (SELECT label, 'source' AS side, source_kb AS kb_id, source AS slug, source_hash AS hash, source_version AS version FROM w WHERE named UNION ALL SELECT label, 'target', target_kb, target, target_hash, target_version FROM w WHERE named),
e AS (SELECT s.*, p.hash AS now, p.version AS now_version FROM s LEFT JOIN p USING (kb_id, slug)), o AS (SELECT DISTINCT kb_id, slug AS page, unnest(links) AS slug FROM p), b AS (SELECT DISTINCT source_kb, source, target_kb, target, kind FROM w WHERE named),
x AS (SELECT DISTINCT f.grp FROM w JOIN u f ON f.kb_id = w.source_kb AND f.slug = w.source JOIN u t ON t.grp = f.grp AND t.kb_id = w.target_kb AND t.slug = w.target WHERE named)
SELECT 'G2' AS "check", 'medium' AS severity, slug AS subject, 'no concept named' AS detail FROM p WHERE concept = ''
UNION ALL SELECT 'G2', 'medium', slug, concept_kb || '/' || concept FROM p WHERE concept <> '' AND (concept_kb, concept) NOT IN (SELECT (kb_id, slug) FROM p)
UNION ALL SELECT 'G2', 'medium', slug, min(concept) || ' / ' || max(concept) FROM p WHERE concept <> '' GROUP BY slug HAVING min(concept) <> max(concept)
UNION ALL SELECT 'G6', 'medium', label, 'kind ' || kind FROM w WHERE kind = 'odd' UNION ALL SELECT 'G6', 'medium', label, 'an end is missing' FROM w WHERE NOT named
UNION ALL SELECT 'G3', 'high', label, side || ' ' || kb_id || ' ' || slug FROM e WHERE now IS NULL
UNION ALL SELECT 'G4', 'medium', label, side || ' ' || kb_id || ' ' || slug FROM e WHERE now IS NOT NULL AND ((hash <> '' AND hash <> now) OR now_version > version)
UNION ALL SELECT 'G6', 'medium', w.label, w.kind || ' / ' || b.kind FROM w JOIN b ON b.source_kb = w.target_kb AND b.source = w.target AND b.target_kb = w.source_kb AND b.target = w.source WHERE named AND w.kind <> b.kind AND (w.source_kb, w.source) < (w.target_kb, w.target)
UNION ALL SELECT 'G5', 'high', grp, 'no mapping' FROM (SELECT DISTINCT grp FROM u) WHERE grp NOT IN (SELECT grp FROM x)
UNION ALL SELECT 'G7', 'high', page, array_to_string(list_sort(list(DISTINCT o.slug)), ',') FROM o JOIN p h ON h.slug = o.slug AND h.kb_id <> o.kb_id WHERE (o.kb_id, o.slug) NOT IN (SELECT (kb_id, slug) FROM p) GROUP BY o.kb_id, page
UNION ALL SELECT 'G8', 'low', c.slug, c.kb_id FROM c LEFT JOIN p USING (kb_id, slug) WHERE p.hash IS NULL OR p.hash <> c.hash""")
def c9_context_map_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    k = F.col("p_partkey")
    concept = F.when(k % 6 == 0, "").when(k % 6 == 1, text("s", k % 500)).when(k % 6 == 2, text("c", k))
    pages = table(spark, sf_dir, "part").select(text("k", k % 4).alias("kb_id"), text("s", F.expr("p_partkey div 2")).alias("slug"), text("h", F.col("p_size")).alias("hash"), (1 + k % 3).alias("version"),
        F.when(k % 6 < 3, "k0").alias("concept_kb"), concept.alias("concept"), F.array(text("s", k % 300), text("s", k * 7 % 2500)).alias("links"))
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    kinds = F.get(F.array(*[F.lit(x) for x in ("equivalent", "rename", "unrelated", "odd", "rename")]), (o % 5).cast("int"))
    mappings = table(spark, sf_dir, "orders").select(text("k", o % 4).alias("source_kb"), F.when(o % 50 == 0, "").otherwise(text("s", c % 90)).alias("source"), text("k", o % 3).alias("target_kb"), text("s", c * 3 % 90).alias("target"), kinds.alias("kind"),
        F.when(o % 4 == 0, "").otherwise(text("h", c % 50)).alias("source_hash"), F.lit("").alias("target_hash"), (1 + o % 2).alias("source_version"), F.lit(2).cast("long").alias("target_version"))
    undecided = table(spark, sf_dir, "customer").select(text("g", F.col("c_custkey") % 60).alias("group"), text("k", F.col("c_nationkey") % 4).alias("kb_id"), text("s", F.col("c_custkey") % 90).alias("slug"))
    cached = table(spark, sf_dir, "supplier").select(text("k", F.col("s_suppkey") % 4).alias("kb_id"), text("s", F.expr("s_suppkey div 2")).alias("slug"), text("h", F.col("s_nationkey")).alias("hash"))
    return V.context_map_checks(pages, mappings, ["equivalent", "rename", "unrelated"], undecided, cached)


@query("""SELECT 'Z' || n_regionkey AS "check", CASE WHEN n_nationkey % 2 = 0 THEN 'high' ELSE 'low' END AS severity, 's' || s_suppkey AS subject, n_name AS detail, 'run2' AS run FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 3 = 0""")
def s10_write_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    found = s.select(F.concat(F.lit("Z"), "n_regionkey").alias("check"), F.when(F.col("n_nationkey") % 2 == 0, "high").otherwise("low").alias("severity"), F.concat(F.lit("s"), "s_suppkey").alias("subject"), F.col("n_name").alias("detail"), "s_suppkey")
    path = f"{G.shared_folder(spark)}/reports-{uuid.uuid4().hex[:12]}"
    for run, base, condition in (("run1", "b", "s_suppkey % 3 = 1"), ("run2", "b", "s_suppkey % 3 = 0"), ("run9", "other", "s_suppkey % 3 = 2")):
        S.write_findings(found.where(condition).drop("s_suppkey"), path, run, base)
    return S.read_findings(spark, path, "b").select("check", "severity", "subject", "detail", "run")
