"""Queries over influencers, policies and rule expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import influence as I
from lorekeep.plans.fixtures import SUBCLASSES, subclasses, table
from lorekeep.plans.registry import query

#: Parts are policies where their key is not divisible by 3; below them as in the class tree, rules by first order lines.
POLICIES = f"""{SUBCLASSES}, pol AS (SELECT 'p' || p_partkey AS slug, p_name AS name FROM part WHERE p_partkey % 3 > 0),
kept AS (SELECT 'p' || child AS child, 'p' || parent AS parent FROM subclasses WHERE child % 3 > 0 AND parent % 3 > 0),
cov AS (SELECT DISTINCT 'p' || l_partkey AS policy, 'r' || l_suppkey AS rule FROM lineitem WHERE l_linenumber = 1),
walk AS (SELECT slug AS policy, slug AS sub, 0 AS d FROM pol UNION SELECT policy, child, d + 1 FROM walk JOIN kept ON parent = sub WHERE d < 4),
below AS (SELECT DISTINCT policy, sub FROM walk)"""


def _policies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Policies (slug, name), what lies below them, and the rules they cover."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    policies = table(spark, sf_dir, "part").where("p_partkey % 3 > 0").select(name("p", "p_partkey").alias("slug"), F.col("p_name").alias("name"))
    below = subclasses(spark, sf_dir).select(name("p", "child").alias("child"), name("p", "parent").alias("parent"))
    covers = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(name("p", "l_partkey").alias("policy"), name("r", "l_suppkey").alias("rule"))
    return policies, below, covers.distinct()


@query(f"""WITH RECURSIVE {POLICIES}, hit AS (SELECT n_nationkey AS ask_id, 's' || s_suppkey AS influencer FROM nation JOIN supplier ON contains('s' || s_suppkey, n_nationkey::VARCHAR) OR contains(s_name, n_nationkey::VARCHAR)
  QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY s_name, 's' || s_suppkey) <= 3),
means AS (SELECT DISTINCT 's' || l_suppkey AS influencer, 'p' || l_partkey AS means FROM lineitem WHERE l_linenumber = 2)
SELECT ask_id, influencer, means, sub AS policy, rule FROM hit LEFT JOIN means USING (influencer) LEFT JOIN below ON below.policy = means LEFT JOIN cov ON cov.policy = sub""")
def g8_influencer_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies, below, covers = _policies(spark, sf_dir)
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ask_id"), F.col("n_nationkey").cast("string").alias("q"))
    influencers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("slug"), F.col("s_name").alias("name"))
    means = table(spark, sf_dir, "lineitem").where("l_linenumber = 2").select(F.concat(F.lit("s"), "l_suppkey").alias("influencer"), F.concat(F.lit("p"), "l_partkey").alias("means"))
    return I.influencer_chain(asked, influencers, means, policies, below, covers)


@query(f"""WITH RECURSIVE {POLICIES}, x AS (SELECT p_partkey AS expr_id, [p_name, 'r' || p_partkey % 120, 'r' || p_partkey % 7, 'zz'] AS v FROM part),
t AS (SELECT expr_id, i - 1 AS place, CASE i WHEN 1 THEN 'policy:' || v[1] WHEN 2 THEN 'rule:' || v[2] WHEN 3 THEN v[3] ELSE 'zz' END AS term, CASE i WHEN 1 THEN 'policy' ELSE 'rule' END AS kind, v[CASE WHEN i = 5 THEN 4 ELSE i END] AS value FROM x, unnest([1, 2, 3, 5]) u(i)),
first AS (SELECT value, slug AS policy FROM (SELECT DISTINCT value FROM t WHERE kind = 'policy') JOIN pol ON contains(name, value) OR contains(slug, value) QUALIFY row_number() OVER (PARTITION BY value ORDER BY name, slug) = 1),
r AS (SELECT DISTINCT below.policy, rule FROM below JOIN cov ON cov.policy = sub),
e AS (SELECT expr_id, place, term, kind, policy, rule FROM t LEFT JOIN first USING (value) LEFT JOIN r USING (policy) WHERE kind = 'policy'
  UNION ALL SELECT expr_id, place, term, kind, NULL, 'r' || s_suppkey FROM t LEFT JOIN supplier ON 'r' || s_suppkey = value WHERE kind = 'rule')
SELECT expr_id, place::INTEGER AS place, term, kind, policy, rule FROM e QUALIFY rule IS NULL OR row_number() OVER (PARTITION BY expr_id, rule ORDER BY place) = 1""")
def g8_rule_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies, below, covers = _policies(spark, sf_dir)
    k = F.col("p_partkey")
    text = F.concat(F.lit("policy:"), "p_name", F.lit(", rule:r"), k % 120, F.lit("，r"), k % 7, F.lit(" ,policy: ,zz"))
    rules = table(spark, sf_dir, "supplier").select(F.concat(F.lit("r"), "s_suppkey").alias("slug"))
    return I.rule_expressions(table(spark, sf_dir, "part").select(k.alias("expr_id"), text.alias("expr")), policies, below, covers, rules)
