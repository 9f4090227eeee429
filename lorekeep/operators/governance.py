"""Mappings between knowledge bases, standards, ontology checks, trees of classes and tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.audits import findings
from lorekeep.operators.graphs import settled
from lorekeep.operators.search import contained


def mapping_pairs(members: DataFrame) -> DataFrame:
    """concept, a, b: the unordered pairs of a concept's members (concept, pos, member), which are a few by nature."""
    other = members.select("concept", F.col("pos").alias("pos_b"), F.col("member").alias("b"))
    return members.join(other, "concept").where("pos < pos_b").select("concept", F.col("member").alias("a"), "b")


def mapping_health(pairs: DataFrame, pages: DataFrame, kinds: list[str]) -> DataFrame:
    """pair_id, problem of mappings (pair_id, a, b, kind, hash_b) by pages (slug, hash): bad_kind, missing, stale, contradicted."""
    p = pages.select("slug", "hash")
    joined = pairs.join(p.select(F.col("slug").alias("a"), F.lit(True).alias("has_a")), "a", "left").join(
        p.select(F.col("slug").alias("b"), F.lit(True).alias("has_b"), F.col("hash").alias("now")), "b", "left")
    back = pairs.groupBy(F.col("b").alias("a"), F.col("a").alias("b")).agg(F.min("kind").alias("back_low"), F.max("kind").alias("back_high"))
    joined = joined.join(back, ["a", "b"], "left")
    contradicted = F.col("back_low").isNotNull() & ((F.col("back_low") != F.col("kind")) | (F.col("back_high") != F.col("kind")))
    problem = (
        F.when(~F.col("kind").isin(kinds), "bad_kind").when(F.col("has_a").isNull() | F.col("has_b").isNull(), "missing")
        .when(F.col("hash_b") != F.col("now"), "stale").when(contradicted, "contradicted")
    )
    return joined.withColumn("problem", problem).where("problem is not null").select("pair_id", "problem")


def archive_detached(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """pair_id, detached: whether a side of the pair is gone."""
    p = pages.select("slug").distinct().withColumn("there", F.lit(True))
    sides = pairs.join(p.select(F.col("slug").alias("a"), F.col("there").alias("has_a")), "a", "left").join(
        p.select(F.col("slug").alias("b"), F.col("there").alias("has_b")), "b", "left")
    return sides.select("pair_id", (F.col("has_a").isNull() | F.col("has_b").isNull()).alias("detached"))


def standards_review(pages: DataFrame, today: Column, days: int = 14) -> DataFrame:
    """state, pages, old_drafts, changed of standards (state, updated, hash, approved_hash)."""
    return pages.groupBy("state").agg(
        F.count("*").alias("pages"),
        F.count_if((F.col("state") == "draft") & (F.datediff(today, "updated") > days)).alias("old_drafts"),
        F.count_if((F.col("state") == "approved") & (F.col("hash") != F.col("approved_hash"))).alias("changed"),
    )


def same_name_group(pages: DataFrame, mappings: DataFrame) -> DataFrame:
    """key, kbs, members, decided, warning of pages (key, kb_id, page_id): a name in several bases without a mapping is warned of."""
    groups = pages.groupBy("key").agg(F.count_distinct("kb_id").alias("kbs"), F.count("*").alias("members"))
    decided = pages.join(mappings.select("page_id").distinct(), "page_id", "left_semi").groupBy("key").agg(F.count("*").alias("decided"))
    joined = groups.where("kbs > 1").join(decided, "key", "left").fillna(0, ["decided"])
    return joined.withColumn("warning", F.when(F.col("decided") == 0, "same_name_no_decision").otherwise(""))


def category_path(pages: DataFrame, firsts: DataFrame, depth: int) -> DataFrame:
    """page, path: the class chain over first parents (child, parent), from the top, cut to ``depth`` levels above.

    A class that no chain holds leaves the page without a path.
    """
    chain = pages.select("page", F.col("class").alias("last"), F.array("class").alias("path"))
    step = firsts.select(F.col("child").alias("last"), "parent")
    for _ in range(depth):
        grown = chain.join(step, "last", "left")
        chain = grown.select("page", F.coalesce("parent", "last").alias("last"), F.when(F.col("parent").isNotNull(), F.concat(F.array("parent"), "path")).otherwise(F.col("path")).alias("path"))
    return chain.select("page", F.array_join("path", "/").alias("path"))


def candidate_facts(items: DataFrame, lines: DataFrame, most: int = 5) -> DataFrame:
    """item, doc, place: the first ``most`` lines of each document (doc, place, line) that hold an item's keyword (item, keyword)."""
    whole = lines.select(F.struct("doc", "place").alias("whole_id"), F.col("line").alias("whole"))
    found = contained(items.select(F.col("item").alias("part_id"), F.col("keyword").alias("part")), whole)
    met = found.select(F.col("part_id").alias("item"), "whole_id.doc", "whole_id.place")
    place = F.row_number().over(Window.partitionBy("item", "doc").orderBy("place"))
    return met.withColumn("n", place).where(F.col("n") <= most).select("item", "doc", "place")


def rename_attributes(pages: DataFrame, names: DataFrame) -> DataFrame:
    """slug, attrs with keys renamed by a ledger (old, new); only pages that change.

    The ledger is joined to the exploded keys, so it may be long; a key already there by its new name is not replaced.
    """
    keys = pages.select("slug", F.explode("attrs").alias("key", "value")).join(names.withColumnRenamed("old", "key"), "key", "left")
    ranked = keys.withColumn("name", F.coalesce("new", "key")).groupBy("slug", "name").agg(
        F.min_by("value", F.col("new").isNotNull()).alias("value"), F.max(F.col("new").isNotNull()).alias("renamed"))
    out = ranked.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("entries"), F.max("renamed").alias("changed"))
    return out.where("changed").select("slug", F.map_from_entries("entries").alias("attrs"))


def merge_lines(old: Column, new: Column) -> dict[str, Column]:
    """The union of two lists of lines in order, and how many were added."""
    both = F.array_distinct(F.concat(old, new))
    return {"merged": both, "added": F.size(both) - F.size(F.array_distinct(old))}


def context_map_checks(pages: DataFrame, mappings: DataFrame, kinds: list[str], undecided: DataFrame, cached: DataFrame) -> DataFrame:
    """Findings on how bases refer to each other's pages.

    pages: kb_id, slug, hash, version, concept_kb, concept (null where a page points to none), links (array of slugs);
    mappings: source_kb, source, target_kb, target, kind, source_hash, target_hash, source_version, target_version;
    undecided: group, kb_id, slug of same names that were found distinct; cached: kb_id, slug, hash of a cache.
    G2 a concept that is not named or has no page, or another one than a page of the same slug elsewhere; G3 a mapped
    page that is gone; G4 one that changed since; G5 a distinct group without any mapping between two of its pages; G6
    a wrong kind, a missing end, or two directions that disagree; G7 a link to a page of another base alone; G8 a
    cached page that changed or is gone.
    """
    live = pages.select("kb_id", "slug", F.col("hash").alias("now"), F.col("version").alias("now_version"))
    label = F.concat_ws(" > ", F.coalesce(F.nullif("source", F.lit("")), F.lit("?")), F.coalesce(F.nullif("target", F.lit("")), F.lit("?")))

    pointing = pages.where("concept is not null").select("kb_id", "slug", "concept_kb", "concept")
    empty = findings(pointing.where("concept = ''"), "G2", "medium", F.col("slug"), F.lit("no concept named"))
    mounted = pointing.where("concept != ''")
    concepts = live.select(F.col("kb_id").alias("concept_kb"), F.col("slug").alias("concept"))
    lost = findings(mounted.where("concept_kb != ''").join(concepts, ["concept_kb", "concept"], "left_anti"), "G2", "medium", F.col("slug"), F.concat_ws("/", "concept_kb", "concept"))
    spread = mounted.groupBy("slug").agg(F.min("concept").alias("low"), F.max("concept").alias("high")).where("low != high")
    torn = findings(spread, "G2", "medium", F.col("slug"), F.concat_ws(" / ", "low", "high"))

    wrong = findings(mappings.where(~F.col("kind").isin(*kinds)), "G6", "medium", label, F.concat(F.lit("kind "), "kind"))
    ends = ["source_kb", "source", "target_kb", "target"]
    named = reduce(lambda a, b: a & b, [F.coalesce(c, F.lit("")) != "" for c in ends])
    partial = findings(mappings.where(~named), "G6", "medium", label, F.lit("an end is missing"))
    whole = mappings.where(named)
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_kb").alias("kb_id"), F.col(s).alias("slug"), F.col(f"{s}_hash").alias("hash"), F.col(f"{s}_version").alias("version")) for s in ("source", "target")])).alias("s")
    met = whole.select(label.alias("label"), sides).select("label", "s.*").join(live, ["kb_id", "slug"], "left")
    gone = findings(met.where("now is null"), "G3", "high", F.col("label"), F.concat_ws(" ", "side", "kb_id", "slug"))
    moved = F.when(F.coalesce("hash", F.lit("")) != "", F.col("hash") != F.col("now")).otherwise(False) | F.coalesce((F.col("version") > 0) & (F.col("now_version") > F.col("version")), F.lit(False))
    stale = findings(met.where("now is not null").where(moved), "G4", "medium", F.col("label"), F.concat_ws(" ", "side", "kb_id", "slug"))
    back = whole.select(F.col("source_kb").alias("target_kb"), F.col("source").alias("target"), F.col("target_kb").alias("source_kb"), F.col("target").alias("source"), F.col("kind").alias("back")).distinct()
    torn_pairs = whole.join(back, ends).where("kind != back").where(F.struct("source_kb", "source") < F.struct("target_kb", "target"))
    contrary = findings(torn_pairs, "G6", "medium", label, F.concat_ws(" / ", "kind", "back"))

    # only which ends are mapped counts, not how often; each pair of ends meets each group once
    same = settled(undecided.select("group", "kb_id", "slug").distinct(), "undecided")
    one = same.select("group", F.col("kb_id").alias("source_kb"), F.col("slug").alias("source"))
    other = same.select("group", F.col("kb_id").alias("target_kb"), F.col("slug").alias("target"))
    mapped = settled(whole.select(*ends).distinct(), "mapped-ends")
    covered = mapped.join(one, ["source_kb", "source"]).join(other, ["group", "target_kb", "target"]).select("group").distinct()
    open_groups = findings(undecided.select("group").distinct().join(covered, "group", "left_anti"), "G5", "high", F.col("group"), F.lit("no mapping"))

    out = pages.select("kb_id", F.col("slug").alias("page"), F.explode("links").alias("slug")).distinct().join(live.select("kb_id", "slug"), ["kb_id", "slug"], "left_anti")
    homes = live.select(F.col("kb_id").alias("home"), "slug")
    foreign = out.join(homes, "slug").where("home != kb_id").groupBy("kb_id", "page").agg(F.array_join(F.array_sort(F.collect_set("slug")), ",").alias("slugs"))
    crossing = findings(foreign, "G7", "high", F.col("page"), F.col("slugs"))

    old = cached.join(live, ["kb_id", "slug"], "left").where("now is null or now != hash")
    outdated = findings(old, "G8", "low", F.col("slug"), F.col("kb_id"))
    return reduce(DataFrame.unionByName, [empty, lost, torn, wrong, partial, gone, stale, contrary, open_groups, crossing, outdated])
