"""Queries over tasks, differences, ledgers and matches by vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import tasks as K
from lorekeep.operators import vectors as N
from lorekeep.plans.fixtures import table
from lorekeep.plans.registry import query

#: Processes are nations, activities customers, tasks orders, roles suppliers; SQL that both engines read.
NODES = """SELECT 'process' AS kind, 'p/' || n_nationkey AS slug, n_name AS title, '' AS goal, '' AS entry, '' AS exit FROM {nation} UNION ALL SELECT 'activity', 'a/' || c_custkey, c_name, '', '', '' FROM {customer}
UNION ALL SELECT 'task', 't/' || o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN 'Goal ' || o_orderstatus ELSE '' END, CASE WHEN o_orderkey % 4 > 0 THEN 'in' ELSE ' ' END, CASE WHEN o_orderkey % 5 > 0 THEN 'out' END FROM {orders} UNION ALL SELECT 'role', 'r/' || s_suppkey, s_name, '', '', '' FROM {supplier} WHERE s_suppkey % 3 > 0"""
LINKS = """SELECT 'has_activity' AS kind, 'p/' || c_nationkey AS src, 'a/' || c_custkey AS dst, c_custkey AS place FROM {customer} WHERE c_custkey % 6 > 0 AND c_nationkey % 8 > 0
UNION ALL SELECT 'has_task', 'a/' || o_custkey, 't/' || o_orderkey, o_orderkey FROM {orders} WHERE o_orderkey % 7 > 0 UNION ALL SELECT 'has_task', 'a/' || (o_custkey + 1), 't/' || o_orderkey, o_orderkey + 1 FROM {orders} WHERE o_orderkey % 9 = 0
UNION ALL SELECT 'has_role', 't/' || l_orderkey, 'r/' || l_suppkey, l_suppkey FROM {lineitem} WHERE l_linenumber < 3"""
_NAMES = ("nation", "customer", "orders", "supplier", "lineitem")
_PLAIN = {n: n for n in _NAMES}


def _made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in _NAMES if f"{{{n}}}" in sql})


def _view(words: str) -> str:
    narrowed = "WHERE NOT EXISTS (SELECT 1 FROM words) OR EXISTS (SELECT 1 FROM words WHERE contains(lower(concat_ws(' ', task, title, goal, entry, exit, roles)), w))"
    return f"""WITH n AS ({NODES.format(**_PLAIN)}), l AS (SELECT kind, src, dst, min(place) AS place FROM ({LINKS.format(**_PLAIN)}) GROUP BY ALL), words AS ({words}),
r AS (SELECT src AS task, string_agg(coalesce(title, split_part(dst, '/', -1)), ',' ORDER BY place, coalesce(title, split_part(dst, '/', -1))) AS roles FROM l LEFT JOIN n ON n.kind = 'role' AND slug = dst WHERE l.kind = 'has_role' GROUP BY src),
t AS (SELECT * FROM (SELECT slug AS task, title, goal, entry, exit, coalesce(roles, '') AS roles FROM n LEFT JOIN r ON task = slug WHERE kind = 'task') {narrowed}),
p AS (SELECT dst AS task, list(src ORDER BY place, src) AS ps FROM l WHERE kind = 'has_task' AND src IN (SELECT slug FROM n WHERE kind = 'activity') GROUP BY dst),
x AS (SELECT task, ps[1] AS activity, coalesce(array_to_string(ps[2:], ','), '') AS others, roles, trim(coalesce(entry, '')) = '' OR trim(coalesce(exit, '')) = '' AS io_missing, roles = '' AS role_missing FROM t LEFT JOIN p USING (task)),
a AS (SELECT activity, task, others, roles, io_missing, role_missing FROM x WHERE activity IS NULL UNION ALL SELECT slug, task, others, roles, io_missing, role_missing FROM n LEFT JOIN x ON activity = slug WHERE kind = 'activity' AND (task IS NOT NULL OR NOT EXISTS (SELECT 1 FROM words))),
o AS (SELECT src AS process, a.* FROM a LEFT JOIN l ON l.kind = 'has_activity' AND dst = activity)
SELECT process, activity, task, others, roles, io_missing, role_missing FROM o UNION ALL SELECT slug, NULL, NULL, NULL, NULL, NULL, NULL FROM n WHERE kind = 'process' AND NOT EXISTS (SELECT 1 FROM words) AND slug NOT IN (SELECT process FROM o WHERE process IS NOT NULL)"""


@query(_view("SELECT '' AS w WHERE false"))
def g14_task_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "region").limit(0).select(F.col("r_name").alias("word"))
    return K.task_view(_made(spark, sf_dir, NODES), _made(spark, sf_dir, LINKS), words)


@query(_view("SELECT lower(substr(r_name, 1, 2)) AS w FROM region WHERE r_regionkey < 2 UNION SELECT 'goal f' UNION SELECT '00013'"))
def g14_task_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "region").where("r_regionkey < 2").select(F.substring("r_name", 1, 2).alias("word"))
    words = words.unionByName(spark.createDataFrame([("Goal F",), ("00013",), (" ",)], "word string"))
    return K.task_view(_made(spark, sf_dir, NODES), _made(spark, sf_dir, LINKS), words)


@query("""WITH a AS (SELECT l_partkey % 50 AS src, l_suppkey % 20 AS dst, CASE WHEN l_linenumber > 2 THEN l_returnflag END AS rel FROM lineitem), b AS (SELECT * FROM a UNION ALL SELECT l_partkey % 50, l_suppkey % 20, NULL FROM lineitem WHERE l_orderkey % 90 = 0),
x AS (SELECT src, dst, rel, count(*) AS n FROM a GROUP BY ALL), y AS (SELECT src, dst, rel, count(*) AS n FROM b GROUP BY ALL)
SELECT y.src, y.dst, y.rel, coalesce(x.n, 0) AS n_a, y.n AS n_b FROM y LEFT JOIN x ON x.src = y.src AND x.dst = y.dst AND x.rel IS NOT DISTINCT FROM y.rel WHERE coalesce(x.n, 0) <> y.n""")
def j17_multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    rel = F.when(F.col("l_linenumber") > 2, F.col("l_returnflag"))
    pick = lambda rows, rel: rows.select((F.col("l_partkey") % 50).alias("src"), (F.col("l_suppkey") % 20).alias("dst"), rel.alias("rel"))
    a = pick(lines, rel)
    return K.multiset_diff(a, a.unionByName(pick(lines.where("l_orderkey % 90 = 0"), F.lit(None).cast("string"))))


@query("""WITH a AS (SELECT DISTINCT p_type AS kind, p_name AS name FROM part WHERE p_partkey % 3 = 0), b AS (SELECT DISTINCT p_type AS kind, p_name AS name FROM part WHERE p_partkey % 5 = 0 UNION SELECT DISTINCT p_brand, p_name FROM part WHERE p_size > 45),
x AS (SELECT kind, count(*) AS n FROM a GROUP BY 1), y AS (SELECT kind, count(*) AS n FROM b GROUP BY 1) SELECT kind, coalesce(x.n, 0) AS projection, coalesce(y.n, 0) AS artifact, coalesce(y.n, 0) - coalesce(x.n, 0) AS drift FROM x FULL JOIN y USING (kind)""")
def u5_catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    take = lambda rows, kind: rows.select(F.col(kind).alias("kind"), F.col("p_name").alias("name"))
    return K.catalog_counts(take(p.where("p_partkey % 3 = 0"), "p_type"), take(p.where("p_partkey % 5 = 0"), "p_type").unionByName(take(p.where("p_size > 45"), "p_brand")))


@query("""WITH e AS (SELECT user_id AS batch, event_type AS target, CASE WHEN event_id % 3 = 0 THEN 'open' ELSE 'done' END AS status, ts, event_id FROM events), l AS (SELECT batch, target, arg_max(status, {'t': ts, 'i': event_id}) AS status, max(ts) AS ts FROM e GROUP BY ALL),
b AS (SELECT batch, max(ts) AS ts, string_agg(target || ':' || status, ',' ORDER BY target || ':' || status) AS statuses, coalesce(string_agg(target, ',' ORDER BY target) FILTER (status <> 'done'), '') AS remaining FROM l GROUP BY batch)
SELECT batch, row_number() OVER (ORDER BY ts DESC, batch)::INTEGER AS place, statuses, remaining, remaining = '' AS done FROM b ORDER BY place LIMIT 10""")
def l5_last_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_id") % 3 == 0, "open").otherwise("done")
    return K.last_batches(table(spark, sf_dir, "events").select(F.col("user_id").alias("batch"), F.col("event_type").alias("target"), status.alias("status"), "ts", F.col("event_id").alias("row_id")))


@query("""WITH k AS (SELECT l_orderkey AS review, 'P-' || l_linenumber AS item, l_returnflag, l_partkey, l_suppkey FROM lineitem), i AS (SELECT review, item, verdict, CASE WHEN review % 5 = 0 THEN '' ELSE 'f' || part END AS rule_fp, (review % 4)::INT AS rev FROM (SELECT review, item, min(l_returnflag) AS verdict, min(l_partkey) AS part FROM k WHERE review % 3 < 2 GROUP BY review, item)),
n AS (SELECT review, CASE WHEN l_partkey % 30 = 0 THEN '' ELSE item END AS item, CASE WHEN l_suppkey % 20 = 0 THEN 'Z' ELSE l_returnflag END AS verdict, 'g' || l_partkey AS rule_fp FROM k WHERE review % 3 > 0), f AS (SELECT review, item, max({'verdict': verdict, 'rule_fp': rule_fp}) AS x FROM n WHERE item <> '' AND verdict IN ('A', 'N', 'R') GROUP BY ALL),
b AS (SELECT review, item, coalesce(x.verdict, verdict) AS verdict, coalesce(nullif(rule_fp, ''), x.rule_fp, '') AS rule_fp, rev, coalesce(x.verdict, verdict) IS DISTINCT FROM verdict OR coalesce(nullif(rule_fp, ''), x.rule_fp, '') <> coalesce(rule_fp, '') AS changed FROM i FULL JOIN f USING (review, item)),
r AS (SELECT review, (coalesce(max(rev), 0) + bool_or(changed)::INT)::INTEGER AS rev FROM b GROUP BY 1) SELECT review, item, verdict, rule_fp, r.rev FROM b JOIN r USING (review)""")
def l7_applied_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("review"), F.concat(F.lit("P-"), "l_linenumber").alias("item"), "l_returnflag", "l_partkey", "l_suppkey")
    items = k.where("review % 3 < 2").groupBy("review", "item").agg(F.min("l_returnflag").alias("verdict"), F.min("l_partkey").alias("part"))
    fp = F.when(F.col("review") % 5 == 0, "").otherwise(F.concat(F.lit("f"), "part"))
    items = items.select("review", "item", "verdict", fp.alias("rule_fp"), (F.col("review") % 4).cast("int").alias("rev"))
    new = k.where("review % 3 > 0").select("review", F.when(F.col("l_partkey") % 30 == 0, "").otherwise(F.col("item")).alias("item"), F.when(F.col("l_suppkey") % 20 == 0, "Z").otherwise(F.col("l_returnflag")).alias("verdict"), F.concat(F.lit("g"), "l_partkey").alias("rule_fp"))
    return K.applied_items(items, new, ["A", "N", "R"])


@query("""WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e, vec_id % 5 = 0 AS known FROM embeddings WHERE vec_id % 2 = 1), t AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id + 1000000, embedding::DOUBLE[] FROM embeddings WHERE vec_id % 2 = 0 AND vec_id % 14 = 0),
s AS (SELECT q.vec_id AS question_id, t.vec_id AS truth_id, round(list_cosine_similarity(q.e, t.e), 9) AS c FROM q, t WHERE NOT known), b AS (SELECT question_id, max(c) AS c FROM s GROUP BY 1 HAVING max(c) >= 0.35),
n AS (SELECT question_id, min(truth_id) AS truth_id FROM s JOIN b USING (question_id, c) GROUP BY 1 HAVING count(DISTINCT truth_id) = 1)
SELECT vec_id AS question_id, CASE WHEN known THEN vec_id + 1 ELSE truth_id END AS truth_id, CASE WHEN known THEN 'qid' WHEN truth_id IS NULL THEN 'none' ELSE 'vector' END AS how FROM q LEFT JOIN n ON question_id = vec_id""")
def j15_vector_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    questions, truth = e.where("id % 2 = 1"), e.where("id % 2 = 0")
    truth = truth.unionByName(truth.where("id % 14 = 0").withColumn("id", F.col("id") + 1_000_000))  # twins, so that some are not alone
    known = F.col("id") % 5 == 0
    matched = questions.select(F.col("id").alias("question_id"), F.when(known, F.col("id") + 1).alias("truth_id"), F.when(known, "qid").otherwise("none").alias("how"))
    return N.unmatched_by_vector(matched, questions, truth, 0.35)
