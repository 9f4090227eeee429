"""Rules by the ways that lead to them: influencers, means, policies with the policies below them; rule expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.graphs import ancestors, settled
from lorekeep.operators.search import contained

#: Policies below a policy count to this depth.
DEPTH = 4


def named(asked: DataFrame, things: DataFrame, most: int) -> DataFrame:
    """ask_id, slug, place: the first ``most`` things (slug, name) by name whose slug or name contains the text q (ask_id, q)."""
    parts = asked.select(F.col("ask_id").alias("part_id"), F.col("q").alias("part"))
    either = [contained(parts, things.select(F.col("slug").alias("whole_id"), F.coalesce(c, F.lit("")).alias("whole"))) for c in ("slug", "name")]
    met = either[0].unionByName(either[1]).distinct().join(things.withColumnRenamed("slug", "whole_id"), "whole_id")
    place = F.row_number().over(Window.partitionBy("part_id").orderBy("name", "whole_id"))
    met = met.select(F.col("part_id").alias("ask_id"), F.col("whole_id").alias("slug"), place.alias("place"))
    return met.where(F.col("place") <= most)


def policies_below(policies: DataFrame, below: DataFrame, depth: int = DEPTH) -> DataFrame:
    """policy, sub: every policy (slug) with itself and the policies below it (child, parent) to ``depth``."""
    kept = below.join(policies.select(F.col("slug").alias("child")), "child", "left_semi")
    kept = kept.join(policies.select(F.col("slug").alias("parent")), "parent", "left_semi")
    reach = ancestors(kept, depth).select(F.col("ancestor").alias("policy"), F.col("node").alias("sub"))
    return reach.unionByName(policies.select(F.col("slug").alias("policy"), F.col("slug").alias("sub"))).distinct()


def influencer_chain(asked: DataFrame, influencers: DataFrame, means: DataFrame, policies: DataFrame, below: DataFrame, covers: DataFrame, most: int = 3) -> DataFrame:
    """ask_id, influencer, means, policy, rule: each rule with every way from an asked influencer (ask_id, q) to it.

    influencers: slug, name; means: (influencer, means); policies: slug; below: (child, parent); covers: (policy, rule) or
    (rule, policy) edges read as ``policy, rule`` before.  Means that are no policy have a row without policy, policies
    without rules one without rule; a rule that no such way leads to is never returned.
    """
    hits = named(asked, influencers, most).select("ask_id", F.col("slug").alias("influencer"))
    ways = hits.join(means.distinct(), "influencer", "left")
    reach = settled(policies_below(policies, below), "policies-below")
    found = ways.join(reach.select(F.col("policy").alias("means"), F.col("sub").alias("policy")), "means", "left")
    return found.join(covers.distinct(), "policy", "left").select("ask_id", "influencer", "means", "policy", "rule")


def rule_expressions(expressions: DataFrame, policies: DataFrame, below: DataFrame, covers: DataFrame, rules: DataFrame) -> DataFrame:
    """expr_id, place, term, kind, policy, rule: rules of lists like ``policy:name,rule:slug`` (expr_id, expr), each at its first term.

    A term without a prefix is a rule.  A policy term takes the first policy (slug, name) by name that contains it, with
    what lies below; a term that gives no rule has one row without rule.
    """
    parts = F.filter(F.transform(F.split(F.regexp_replace("expr", "，", ","), ","), lambda t: F.trim(t)), lambda t: t != "")
    terms = expressions.select("expr_id", F.posexplode(parts).alias("place", "term"))
    kind = F.when(F.col("term").startswith("policy:"), "policy").otherwise("rule")
    terms = terms.select("expr_id", "place", "term", kind.alias("kind"), F.trim(F.regexp_replace("term", "^(policy|rule):", "")).alias("value")).where("value != ''")
    terms = settled(terms, "terms")
    asked = terms.where("kind = 'policy'").select(F.col("value").alias("ask_id"), F.col("value").alias("q")).distinct()
    first = named(asked, policies, 1).select(F.col("ask_id").alias("value"), F.col("slug").alias("policy"))
    of_policy = policies_below(policies, below).join(covers.withColumnRenamed("policy", "sub"), "sub").select("policy", "rule").distinct()
    by_policy = terms.where("kind = 'policy'").join(first, "value", "left").join(of_policy, "policy", "left")
    known = rules.select(F.col("slug").alias("value"), F.col("slug").alias("rule"))
    direct = terms.where("kind = 'rule'").join(known, "value", "left").withColumn("policy", F.lit(None).cast(policies.schema["slug"].dataType))
    columns = ["expr_id", "place", "term", "kind", "policy", "rule"]
    every = by_policy.select(*columns).unionByName(direct.select(*columns))
    # a term whose rules all stood before keeps no row, one that has none keeps its empty one
    nth = F.row_number().over(Window.partitionBy("expr_id", "rule").orderBy("place"))
    return every.withColumn("nth", F.when(F.col("rule").isNull(), 1).otherwise(nth)).where("nth = 1").drop("nth")
