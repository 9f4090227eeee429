"""Queries over traces, truth sets, sheets and the class catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import loads as L
from lorekeep.operators import traces as R
from lorekeep.operators.graphs import shared_folder
from lorekeep.plans.fixtures import KB_PAGES, SUBCLASSES, kb_pages, subclasses, table
from lorekeep.plans.graphs import CLOSURE, PROPS
from lorekeep.plans.registry import query
from lorekeep.sources.logs import read_sheet


@query("""SELECT p_partkey::VARCHAR AS key, p_name AS name, p_type AS kind FROM part WHERE p_partkey % 10 <> 3""")
def s3_read_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/sheet-{uuid.uuid4().hex[:12]}"
    part = table(spark, sf_dir, "part")
    blank = F.col("p_partkey") % 10 == 3
    cell = lambda c: F.when(~blank, F.col(c).cast("string"))
    body = part.select((F.col("p_partkey") + 1).alias("n"), cell("p_partkey").alias("a"), cell("p_name").alias("b"), cell("p_type").alias("c"), cell("p_brand").alias("d"))
    head = part.where("p_partkey = 0").select(F.lit(0).alias("n"), F.lit("key").alias("a"), F.lit("name").alias("b"), F.lit("kind").alias("c"), F.lit("name").alias("d"))
    # a sheet is one file, whose first row is its header
    head.unionByName(body).coalesce(1).sortWithinPartitions("n").drop("n").write.csv(path)
    return read_sheet(spark, path).drop("row_no")


@query("""SELECT event_id AS message_id, CASE WHEN event_id % 3 = 0 THEN 'plan>' ELSE '' END || event_type || '>write' AS tools, CASE WHEN event_id % 3 = 0 THEN 'plan' ELSE event_type END AS first_tool,
  CASE WHEN event_type IN ('view', 'click') THEN event_type END AS first_retrieval, CASE WHEN event_id % 3 = 0 THEN 3 ELSE 2 END AS n FROM events WHERE event_id % 4 <> 0""")
def s5_read_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    step = lambda name, n: F.struct(name.alias("name"), F.lit(n).alias("iteration"))
    steps = F.filter(F.array(step(F.lit("write"), 9), step(F.col("event_type"), 2), F.when(i % 3 == 0, step(F.lit("plan"), 1))), lambda s: s.isNotNull())
    messages = table(spark, sf_dir, "events").select(i.alias("message_id"), F.when(i % 4 == 0, "user").otherwise("assistant").alias("role"), F.to_json(steps).alias("agent_steps"))
    return R.read_trace(messages, ["view", "click"])


@query("SELECT o_orderkey AS key, o_orderstatus, o_totalprice FROM orders")
def p7_column_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = L.column_subset(table(spark, sf_dir, "orders"), {"State": "o_orderstatus", "Price": "o_totalprice"}, ["o_orderkey", "State", "Price", "Unknown"])
    return found.withColumnRenamed("o_orderkey", "key")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE json_extract_string(props, '$.k') END AS k FROM events""")
def p9_flatten_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise("")
    return table(spark, sf_dir, "events").select("event_id", L.flatten_field(top, F.get_json_object("props", "$.k")).alias("k"))


def _core(column: str) -> str:
    out = f"lower({column})"
    for pattern in (r"https?://\S+", r"\b[a-z]+-\d+\b", r"\bv?\d+(\.\d+)*\b", r"\b(please|kindly|could you|can you)\b"):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    return rf"regexp_replace(trim(regexp_replace({out}, '[\s?!.,;:]+', ' ', 'g')), '\s+', '', 'g')"


@query(rf"""WITH q AS (SELECT conv_id * 100 + turn AS question_id, CASE WHEN conv_id % 11 = 0 THEN 'Q' || turn ELSE '' END AS qid, {_core('text')} AS core FROM conversations WHERE role = 'user'),
t AS (SELECT conv_id * 100 + turn AS truth_id, 'q' || conv_id AS qid, list_distinct([lower(w) FOR w IN [split_part(text, ' ', 1), split_part(text, ' ', 2), split_part(text, ' ', 3)]]) AS anchors, CASE WHEN conv_id % 2 = 0 THEN [] ELSE ['the', 'en'] END AS intent, {_core('text')} AS core FROM conversations WHERE role = 'user' AND conv_id % 9 = 0),
bq AS (SELECT question_id, min(truth_id) AS by_qid FROM q JOIN t ON lower(q.qid) = t.qid WHERE q.core <> '' GROUP BY 1),
an AS (SELECT DISTINCT truth_id, intent, regexp_replace(unnest(anchors), '\s+', '', 'g') AS x FROM t), sub AS (SELECT truth_id, intent, x, len(s) AS n, s FROM (SELECT truth_id, intent, x, substr(x, i, j) AS s, j AS jj, length(x) - i + 1 AS rest FROM an, unnest(range(1, length(x) + 1)) u(i), unnest(range(2, length(x) + 1)) v(j) WHERE length(x) >= 2) WHERE jj <= rest),
hit AS (SELECT question_id, truth_id, intent, core, x, max(length(s)) AS common FROM q JOIN sub ON contains(core, s) GROUP BY ALL),
sc AS (SELECT question_id, truth_id, max((common = length(x))::INT * 1000 + common) AS score FROM hit WHERE (common = length(x) OR common >= 3) AND (len(intent) = 0 OR len(list_filter(intent, lambda w: contains(core, w))) > 0) GROUP BY ALL),
ba AS (SELECT question_id, min(truth_id) AS by_anchor FROM (SELECT *, rank() OVER (PARTITION BY question_id ORDER BY score DESC) AS place FROM sc) WHERE place = 1 GROUP BY 1 HAVING count(*) = 1),
gq AS (SELECT question_id, CASE WHEN length(core) < 2 THEN [core] ELSE list_distinct([substr(core, i::INT, 2) FOR i IN range(1, length(core))]) END AS g FROM q WHERE core <> ''), gt AS (SELECT truth_id, CASE WHEN length(core) < 2 THEN [core] ELSE list_distinct([substr(core, i::INT, 2) FOR i IN range(1, length(core))]) END AS h FROM t WHERE core <> ''),
s AS (SELECT question_id, truth_id, len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))) AS score FROM gq, gt),
bs AS (SELECT question_id, min(truth_id) AS near FROM (SELECT *, rank() OVER (PARTITION BY question_id ORDER BY score DESC) AS place FROM s WHERE score >= 0.62) WHERE place = 1 GROUP BY 1 HAVING count(*) = 1)
SELECT question_id, coalesce(by_qid, by_anchor, near) AS truth_id, CASE WHEN by_qid IS NOT NULL THEN 'qid' WHEN by_anchor IS NOT NULL THEN 'anchor' WHEN near IS NOT NULL THEN 'sim' ELSE 'none' END AS how
FROM q LEFT JOIN bq USING (question_id) LEFT JOIN ba USING (question_id) LEFT JOIN bs USING (question_id)""")
def j15_match_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "conversations").where("role = 'user'")
    key = F.col("conv_id") * 100 + F.col("turn")
    questions = users.select(key.alias("question_id"), F.when(F.col("conv_id") % 11 == 0, F.concat(F.lit("Q"), "turn")).otherwise("").alias("qid"), F.col("text").alias("question"))
    word = F.split(F.lower("text"), " ")
    anchors = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.coalesce(F.get(word, i), F.lit("")))
    none = F.array().cast("array<string>")
    truth = users.where("conv_id % 9 = 0").select(key.alias("truth_id"), F.array(F.concat(F.lit("q"), "conv_id")).alias("qids"), anchors.alias("anchors"),
        F.when(F.col("conv_id") % 2 == 0, none).otherwise(F.array(F.lit("the"), F.lit("en"))).alias("intent"), F.array("text").alias("questions"))
    return R.match_truth(questions, truth, 0.62)


@query("""WITH s AS (SELECT DISTINCT l_suppkey % 5 AS kb_id, l_partkey AS slug FROM lineitem WHERE l_linenumber = 1), p AS (SELECT DISTINCT l_suppkey % 5 AS kb_id, l_partkey AS slug FROM lineitem WHERE l_linenumber > 2 AND l_partkey % 3 > 0), e AS (SELECT slug, array_to_string(list_sort(list(DISTINCT kb_id)), ',') AS bases FROM p GROUP BY 1)
SELECT s.kb_id, s.slug, coalesce(bases, '') AS elsewhere FROM s ANTI JOIN p USING (kb_id, slug) LEFT JOIN e USING (slug)""")
def c4_remembered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("kb_id"), F.col("l_partkey").alias("slug"), "l_linenumber")
    return R.remembered_pages(rows.where("l_linenumber = 1").select("kb_id", "slug"), rows.where("l_linenumber > 2 and slug % 3 > 0").select("kb_id", "slug").distinct())


@query(f"""WITH {KB_PAGES} SELECT 'W5' AS "check", 'low' AS severity, slug AS subject, 'summary' AS detail FROM kb_pages WHERE page_id % 3 = 0 AND content <> '' AND NOT starts_with(content, summary) UNION ALL SELECT 'W7', 'low', slug, title FROM kb_pages WHERE page_id % 4 = 0""")
def c13_alias_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = kb_pages(spark, sf_dir)
    definition = F.when(F.col("page_id") % 3 == 0, F.col("content"))
    return R.alias_checks(k.select("slug", "title", "summary", definition.alias("definition"), F.array(F.lit("other"), F.when(F.col("page_id") % 4 == 0, F.col("title"))).alias("aliases")))


@query(f"""WITH RECURSIVE {CLOSURE}, c AS (SELECT p_partkey AS class, p_brand AS module, 'L' || p_partkey AS local, p_brand || ':L' || p_partkey AS name FROM part),
p AS (SELECT 'p' || l_orderkey || '.' || l_linenumber AS name, CASE WHEN l_linenumber % 2 = 0 THEN 'object' ELSE 'data' END AS kind, 'Brand#' || l_linenumber AS module, min(l_partkey) AS domain, min(l_suppkey) AS range FROM lineitem GROUP BY l_orderkey, l_linenumber),
r AS (SELECT l_partkey AS owner, 'q' || l_linenumber AS prop, CASE l_returnflag WHEN 'A' THEN 'minCardinality' WHEN 'N' THEN 'someValuesFrom' ELSE 'hasValue' END AS kind, max(l_quantity)::INTEGER AS value FROM lineitem GROUP BY ALL), v AS (SELECT p_partkey AS class, unnest(['x', p_type, p_brand]) AS value FROM part WHERE p_partkey % 9 = 0),
e AS (SELECT p.*, a.module AS dm, b.module AS rm, a.name || '>' || b.name AS ends FROM p JOIN c a ON a.class = domain JOIN c b ON b.class = range), o AS (SELECT r.*, c.name, prop || ' ' || kind || ' ' || value AS told FROM r JOIN c ON c.class = owner),
u AS (SELECT range AS class, string_agg(name, ',' ORDER BY name) AS users FROM p GROUP BY 1)
SELECT 'Q1' AS query, module || '.' || name AS item, ends AS detail FROM e WHERE kind = 'object' AND dm <> rm UNION ALL SELECT DISTINCT 'Q2', name, told FROM o WHERE kind <> 'hasValue' AND owner IN (SELECT node FROM closure WHERE ancestor = 3 UNION SELECT 3)
UNION ALL SELECT 'Q3', name, vs || '|' || coalesce(users, '') FROM (SELECT class, string_agg(DISTINCT value, ',' ORDER BY value) AS vs FROM v GROUP BY 1) JOIN c USING (class) LEFT JOIN u USING (class) UNION ALL SELECT 'Q4', module || '.' || name || ' ' || kind, ends FROM e WHERE dm <> module OR rm <> module
UNION ALL SELECT 'Q5', name, '' FROM c WHERE class NOT IN (SELECT child FROM subclasses) UNION ALL SELECT 'Q6', name, told FROM o
UNION ALL SELECT 'Q7', c.name, coalesce(told, '') FROM c LEFT JOIN o ON o.owner = c.class WHERE c.class IN (SELECT node FROM closure WHERE ancestor = 5 UNION SELECT 5)""")
def c16_catalogue_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, part, lines = F.col("p_partkey"), table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    classes = part.select(k.alias("class"), F.col("p_brand").alias("module"), F.concat(F.lit("L"), k).alias("local"))
    props = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("domain"), F.min("l_suppkey").alias("range"))
    props = props.select(F.concat(F.lit("p"), "l_orderkey", F.lit("."), "l_linenumber").alias("name"), F.when(F.col("l_linenumber") % 2 == 0, "object").otherwise("data").alias("kind"), F.concat(F.lit("Brand#"), "l_linenumber").alias("module"), "domain", "range")
    kind = F.when(F.col("l_returnflag") == "A", "minCardinality").when(F.col("l_returnflag") == "N", "someValuesFrom").otherwise("hasValue")
    restrictions = lines.groupBy(F.col("l_partkey").alias("owner"), F.concat(F.lit("q"), "l_linenumber").alias("prop"), kind.alias("kind")).agg(F.max("l_quantity").cast("int").alias("value"))
    members = part.where("p_partkey % 9 = 0").select(k.alias("class"), F.explode(F.array(F.lit("x"), "p_type", "p_brand")).alias("value"))
    root = lambda n: spark.range(n, n + 1).withColumnRenamed("id", "node")
    return R.catalogue_queries(classes, subclasses(spark, sf_dir), props, restrictions, members, root(3), root(5))


@query(f"""WITH {PROPS}, step AS (SELECT domain AS a, range AS b, '>' || name AS via FROM props UNION SELECT range, domain, '<' || name FROM props), legs(leg, s, e) AS (VALUES (1, 'C0', 'C3'), (2, 'C3', 'C6')),
one AS (SELECT leg, s || '/' || b AS path, via AS relations, 1 AS hops FROM legs JOIN step ON a = s AND b = e), two AS (SELECT leg, s || '/' || x.b || '/' || y.b AS path, x.via || '/' || y.via AS relations, 2 AS hops FROM legs JOIN step x ON x.a = s AND x.b <> s AND x.b <> e JOIN step y ON y.a = x.b AND y.b = e)
SELECT * FROM (SELECT * FROM one UNION ALL SELECT * FROM two) QUALIFY row_number() OVER (PARTITION BY leg ORDER BY hops, path, relations) = 1""")
def g20_route_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), "n_nationkey").alias("name"), F.concat(F.lit("C"), "n_regionkey").alias("domain"), F.concat(F.lit("C"), F.col("n_nationkey") % 7).alias("range"))
    return R.route_recipe(props, ["C0", "C3", "C6"])
