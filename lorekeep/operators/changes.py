"""What a change would touch: references to a key anywhere, renames under another class, and clean-ups behind a fingerprint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.graphs import MOST_ROUNDS, settled
from lorekeep.operators.transfers import row_digest

#: Kinds of clean-up in the order of their work; the first one empties a base and is never part of the others.
KINDS = ("init", "pages", "rows", "edges", "graph")


def json_leaves(rows: DataFrame, column: str) -> DataFrame:
    """The rows with ``path`` ($.a.b[0]) and ``leaf`` (text) of every string anywhere in a JSON column; broken JSON has none.

    Objects and arrays are opened level by level, so a document may be nested to any depth up to the loop's bound.
    """
    others = [c for c in rows.columns if c != column]
    variant = F.try_parse_json(F.col(column))
    open_ = rows.select(*others, F.lit("$").alias("path"), variant.alias("v")).where("v is not null")
    found = None
    for _ in range(MOST_ROUNDS):
        kind = F.schema_of_variant("v")
        typed = open_.withColumn("kind", F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise(kind))
        typed = settled(typed.withColumn("v", F.to_json("v")), "json-levels")
        leaves = typed.where("kind = 'STRING'").select(*others, "path", F.try_variant_get(F.parse_json("v"), "$", "string").alias("leaf"))
        found = leaves if found is None else found.unionByName(leaves)
        inner = typed.where("kind in ('object', 'array')")
        if inner.isEmpty():
            return found
        spread = inner.withColumn("w", F.parse_json("v")).drop("v").lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("w").outer()))
        step = F.when(F.col("kind") == "object", F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), "pos", F.lit("]")))
        open_ = spread.select(*others, F.concat("path", step).alias("path"), F.col("value").alias("v")).where("v is not null")
    raise ValueError(f"metadata is nested deeper than {MOST_ROUNDS}")


def slug_references(edges: DataFrame, arrays: DataFrame, bodies: DataFrame, metadata: DataFrame, slugs: DataFrame) -> DataFrame:
    """slug, page, kind, detail: every place where a page mentions another page's key.

    edges: page, rel, dst (relation_line); arrays: page, links (out_links); bodies: page, text with ``wiki:key`` or a key in
    back ticks (content_text); metadata: page and JSON, where a key may stand anywhere (metadata, with its path).
    """
    wiki = F.regexp_extract_all("text", F.lit(r"wiki:([^\s)\]`]+)"), F.lit(1))
    ticks = F.regexp_extract_all("text", F.lit(r"`([^`\s]+)`"), F.lit(1))
    said = bodies.select("page", F.explode(F.array_distinct(F.concat(wiki, ticks))).alias("slug"), F.lit("content_text").alias("kind"), F.lit("").alias("detail"))
    line = edges.select("page", F.col("dst").alias("slug"), F.lit("relation_line").alias("kind"), F.col("rel").alias("detail"))
    link = arrays.select("page", F.explode(F.array_distinct("links")).alias("slug"), F.lit("out_links").alias("kind"), F.lit("").alias("detail"))
    leaf = json_leaves(metadata, "json").select("page", F.col("leaf").alias("slug"), F.lit("metadata").alias("kind"), F.col("path").alias("detail"))
    every = reduce(DataFrame.unionByName, [line, link, said, leaf]).join(slugs.select("slug").distinct(), "slug", "left_semi")
    return every.where("page != slug").select("slug", "page", "kind", "detail")


def rename_plan(asked: DataFrame, pages: DataFrame, classes: DataFrame, references: DataFrame, edges: DataFrame, domains: DataFrame, ranges: DataFrame, closure: DataFrame) -> DataFrame:
    """slug, new_slug, outcome, conflict, refs, kinds, violations, risks: what giving pages another class would do.

    asked: slug, new_type; pages: slug, page_type; classes: class, module; edges: page, rel, dst; domains and ranges:
    rel, class; closure: node, ancestor.  A slug has the parts module, class and name, and the first two follow the
    class.  Outcomes: unknown_class, not_applicable, already, rename.  Predicted violations are the page's own relations
    whose domain does not hold the new class, or whose range does not hold the target's.
    """
    part = F.split("slug", "/")
    rows = asked.join(pages, "slug").join(classes.select(F.col("class").alias("new_type"), "module"), "new_type", "left")
    local = F.lower(F.element_at(F.split("new_type", ":"), -1))
    whole = (F.size(part) == 3) & ~F.exists(part, lambda x: x == "")
    new = F.when(whole & F.col("module").isNotNull(), F.concat_ws("/", "module", local, F.get(part, F.lit(2))))
    rows = rows.withColumn("new_slug", new)
    outcome = F.when(F.col("module").isNull(), "unknown_class").when(~whole, "not_applicable").when((F.col("new_slug") == F.col("slug")) & (F.col("new_type") == F.col("page_type")), "already").otherwise("rename")
    rows = settled(rows.withColumn("outcome", outcome), "renames")
    taken = pages.select(F.col("slug").alias("new_slug"), F.lit(True).alias("taken")).distinct()
    counts = references.groupBy("slug").agg(F.count("*").alias("refs"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    reach = closure.select("node", "ancestor")
    own = rows.where("outcome = 'rename'").select(F.col("slug").alias("page"), "new_type").join(edges.select("page", "rel", "dst").distinct(), "page")
    own = settled(own, "own-relations")

    def broken(ends: DataFrame, node: Column, rows: DataFrame) -> DataFrame:
        """Relations with such ends of which none is the class or above it."""
        met = rows.withColumn("node", node).join(ends.join(reach.withColumnRenamed("ancestor", "class"), "class").select("rel", "node").distinct(), ["rel", "node"], "left_semi")
        return rows.join(ends.select("rel").distinct(), "rel", "left_semi").join(met.select("page", "rel", "dst"), ["page", "rel", "dst"], "left_anti").select("page", "rel", "dst")

    targets = own.join(pages.select(F.col("slug").alias("dst"), "page_type"), "dst")
    wrong = broken(domains, F.col("new_type"), own).unionByName(broken(ranges, F.col("page_type"), targets)).distinct()
    wrong = wrong.groupBy(F.col("page").alias("slug")).agg(F.count("*").alias("violations"))
    out = rows.join(taken, "new_slug", "left").join(counts, "slug", "left").join(wrong, "slug", "left").fillna(0, ["refs", "violations"]).fillna("", ["kinds"])
    active, moved = F.col("outcome") == "rename", F.col("new_slug") != F.col("slug")
    risk = lambda when, name: F.when(active & when, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    risks = F.concat(risk(moved, "url_break"), risk(F.col("refs") > 0, "refs_rewrite"), risk(F.col("violations") > 0, "schema_violation"))
    return out.select("slug", F.coalesce("new_slug", F.lit("")).alias("new_slug"), "outcome", (active & moved & F.coalesce("taken", F.lit(False))).alias("conflict"), "refs", "kinds", "violations", F.array_join(risks, ",").alias("risks"))


def clean_up_rows(pages: DataFrame, index: DataFrame, revisions: DataFrame, lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """kind, part, subject, place: everything a clean-up would touch, a row each.

    pages: slug, page_type, deleted, imported, entity; index: slug, status of each source; revisions: slug, page; lines of
    relations: page, place, rel, dst; nodes: slug.  ``init`` all pages but the index; ``pages`` entity pages without source
    (imports are exempt), pages whose sources are all gone, pages of which some are; ``rows`` deleted pages and
    revisions without a page; ``edges`` lines that dangle, point at their own page or repeat; ``graph`` nodes without a
    live page.
    """
    live = pages.where("not deleted")
    per = index.groupBy("slug").agg(F.count("*").alias("n"), F.count_if(F.col("status") != "live").alias("gone"))
    sourced = live.join(per, "slug", "left")
    bare = sourced.where("n is null and entity and not imported")
    known = live.select(F.col("slug").alias("dst"), F.lit(True).alias("there")).distinct()
    order = Window.partitionBy("page", "rel", "dst").orderBy("place")
    told = lines.join(live.select(F.col("slug").alias("page")), "page", "left_semi").join(known, "dst", "left").withColumn("nth", F.row_number().over(order))
    why = F.when(F.col("there").isNull(), "dangling").when(F.col("dst") == F.col("page"), "self_loop").when(F.col("nth") > 1, "repeated")
    none = F.lit(None).cast("long")
    pick = lambda rows, kind, part, subject, place=none: rows.select(F.lit(kind).alias("kind"), part.alias("part"), F.col(subject).alias("subject"), place.cast("long").alias("place"))
    parts = [
        pick(pages.where("slug != 'index'"), "init", F.lit("page"), "slug"),
        pick(bare, "pages", F.lit("no_source"), "slug"),
        pick(sourced.where("gone = n"), "pages", F.lit("deleted_source"), "slug"),
        pick(sourced.where("gone > 0 and gone < n"), "pages", F.lit("mixed"), "slug"),
        pick(pages.where("deleted"), "rows", F.lit("soft_deleted"), "slug"),
        pick(revisions.join(pages.select(F.col("slug").alias("page")), "page", "left_anti"), "rows", F.lit("orphan_revision"), "slug"),
        pick(told.withColumn("why", why).where("why is not null"), "edges", F.col("why"), "page", F.col("place")),
        pick(nodes.join(live.select("slug"), "slug", "left_anti"), "graph", F.lit("orphan_node"), "slug"),
    ]
    return reduce(DataFrame.unionByName, parts)


def plan_id(rows: DataFrame, kinds: list[str]) -> str:
    """The fingerprint of the chosen kinds of a plan, whatever the order of its rows."""
    if "init" in kinds and len(kinds) > 1:
        raise ValueError("init stands alone")
    n, total = rows.where(F.col("kind").isin(kinds)).agg(F.count("*"), F.coalesce(F.sum(row_digest(rows.columns)), F.lit(0)).cast("string")).first()
    return f"{n}-{total}"


def apply_clean_up(pages: DataFrame, index: DataFrame, revisions: DataFrame, lines: DataFrame, nodes: DataFrame, kinds: list[str], expected: str) -> dict[str, DataFrame]:
    """The tables after the clean-up of ``kinds``; refused if the tables are no longer those that ``expected`` was told of."""
    rows = settled(clean_up_rows(pages, index, revisions, lines, nodes), "clean-up")
    if plan_id(rows, kinds) != expected:
        raise ValueError("the tables have changed since the plan was made; make a new one")
    chosen = rows.where(F.col("kind").isin(kinds))
    gone = chosen.where("part in ('page', 'no_source', 'deleted_source', 'soft_deleted')").select(F.col("subject").alias("slug")).distinct()
    mixed = chosen.where("part = 'mixed'").select(F.col("subject").alias("slug"))
    stale = index.where("status != 'live'").join(mixed, "slug", "left_semi").select("slug", "status").distinct()
    orphans = chosen.where("part in ('orphan_revision')").select(F.col("subject").alias("slug")).distinct()
    bad = chosen.where("kind = 'edges'").select(F.col("subject").alias("page"), "place")
    lone = chosen.where("kind = 'graph'").select(F.col("subject").alias("slug"))
    cascade = gone.select(F.col("slug").alias("page"))
    return {
        "pages": pages.join(gone, "slug", "left_anti"), "index": index.join(stale, ["slug", "status"], "left_anti").join(gone, "slug", "left_anti"),
        "revisions": revisions.join(orphans, "slug", "left_anti").join(cascade, "page", "left_anti"),
        "lines": lines.join(bad, ["page", "place"], "left_anti").join(cascade, "page", "left_anti"), "nodes": nodes.join(lone, "slug", "left_anti").join(gone, "slug", "left_anti"),
    }
