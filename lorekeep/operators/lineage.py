"""Lineage between pages and source documents, set differences, and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def doc_index(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """kb_id, slug, page_type, n_refs, updated, doc_id, status for every reference of every page.

    A reference without a document is ``missing``, which is not the same as ``deleted``.
    """
    refs = pages.select("kb_id", "slug", "page_type", "updated", F.size("source_refs").alias("n_refs"), F.explode("source_refs").alias("doc_id"))
    known = docs.select("doc_id", F.col("deleted").alias("doc_deleted"))
    status = F.when(F.col("doc_deleted").isNull(), "missing").when(F.col("doc_deleted"), "deleted").otherwise("live")
    return refs.join(known, "doc_id", "left").withColumn("status", status).drop("doc_deleted")


def doc_stats(index: DataFrame) -> DataFrame:
    """Per document: pages, pages that cite it alone, types, first and last time, status."""
    return index.groupBy("doc_id").agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("n_refs") <= 1).alias("exclusive_pages"),
        F.count_distinct("page_type").alias("types"),
        F.min("updated").alias("first_time"),
        F.max("updated").alias("last_time"),
        F.max("status").alias("status"),
    )


def doc_totals(index: DataFrame, pages: DataFrame) -> DataFrame:
    """documents by status, pages, pages without a source and citations, over all pages (slug, source_refs)."""
    docs = index.groupBy("doc_id").agg(F.max("status").alias("status"))
    by = docs.agg(F.count("*").alias("documents"), *[F.count_if(F.col("status") == s).alias(s) for s in ("live", "deleted", "missing")])
    of = pages.agg(F.count("*").alias("pages"), F.count_if(F.size(F.coalesce("source_refs", F.array().cast("array<bigint>"))) == 0).alias("without_source"), F.sum(F.size("source_refs")).alias("citations"))
    return by.crossJoin(of)  # one row each


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges whose target is no live node (nodes: slug)."""
    return edges.distinct().join(nodes.select(F.col("slug").alias("dst")), "dst", "left_anti")


def orphan_rows(rows: DataFrame, owners: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without an owner."""
    return rows.join(owners.select(*keys), keys, "left_anti")


def diff_orphans(graph: DataFrame, live: DataFrame) -> DataFrame:
    """side (graph_only, live_only, blank), slug: names on one side alone; blank or null ones only counted in ``n``."""
    def names(rows: DataFrame) -> DataFrame:
        return rows.select("slug").where(F.trim(F.coalesce("slug", F.lit(""))) != "").distinct()

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.lit(name).alias("side"), "slug", F.lit(1).cast("long").alias("n"))

    blank = graph.agg(F.count_if(F.trim(F.coalesce("slug", F.lit(""))) == "").alias("n"))
    blank = blank.select(F.lit("blank").alias("side"), F.lit("").alias("slug"), "n")
    a, b = names(graph), names(live)
    return side(a.join(b, "slug", "left_anti"), "graph_only").unionByName(side(b.join(a, "slug", "left_anti"), "live_only")).unionByName(blank)


def purge_plan(pages: DataFrame, doomed: DataFrame) -> DataFrame:
    """What deleting documents leaves of each page that cites them: kb_id, slug, action, remaining references.

    A page whose references all go is deleted; another keeps the rest.  doomed: doc_id.
    """
    refs = pages.select("kb_id", "slug", F.explode("source_refs").alias("doc_id"))
    marked = refs.join(doomed.select("doc_id", F.lit(True).alias("goes")), "doc_id", "left")
    grouped = marked.groupBy("kb_id", "slug").agg(
        F.count_if("goes").alias("removed"),
        F.array_sort(F.collect_list(F.when(F.col("goes").isNull(), F.col("doc_id")))).alias("remaining"),
    )
    action = F.when(F.size("remaining") == 0, "delete").otherwise("strip")
    return grouped.where("removed > 0").withColumn("action", action)


def purge_totals(plan: DataFrame) -> DataFrame:
    """Dry-run totals by action."""
    return plan.groupBy("action").agg(F.count("*").alias("pages"), F.sum("removed").alias("references"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, removed, changed, unchanged) of two (path, hash) tables."""
    a = old.select("path", F.col("hash").alias("old_hash"))
    b = new.select("path", F.col("hash").alias("new_hash"))
    change = (
        F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed")
        .when(F.col("old_hash") != F.col("new_hash"), "changed").otherwise("unchanged")
    )
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def row_hash(columns: list[str], separator: str = "\u001f") -> Column:
    """sha1 of a row's columns; nulls are empty strings."""
    return F.sha1(F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).cast("binary"))


def set_fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows, fingerprint: independent of the order of rows.

    The sums of the two halves of the rows' hashes are exact decimals, so that the whole never meets in one place.
    """
    hashed = rows.select(row_hash(columns).alias("h"))
    part = [F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)") for i in range(2)]
    sums = hashed.agg(F.count("*").alias("rows"), F.sum(part[0]).alias("a"), F.sum(part[1]).alias("b"))
    both = F.concat_ws(":", F.coalesce("a", F.lit(0)).cast("string"), F.coalesce("b", F.lit(0)).cast("string"))
    return sums.select("rows", F.sha1(both.cast("binary")).alias("fingerprint"))


def diff_tables(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows by key that are missing in ``b``, extra in ``b``, or differ in the columns."""
    left = a.select(key, row_hash(columns).alias("hash_a"))
    right = b.select(key, row_hash(columns).alias("hash_b"))
    kind = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("mismatch")
    both = left.join(right, key, "full_outer").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
    return both.select(key, kind.alias("kind"))


def merge_edges(edges: DataFrame, triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Outcome of an idempotent batch of triples (src, rel, dst): self_loop, missing_node, present or new, once each."""
    batch = triples.select("src", "rel", "dst").distinct()
    have = edges.select("src", "rel", "dst").distinct().withColumn("have", F.lit(True))
    source = nodes.select(F.col("slug").alias("src"), F.lit(True).alias("has_src"))
    target = nodes.select(F.col("slug").alias("dst"), F.lit(True).alias("has_dst"))
    joined = batch.join(have, ["src", "rel", "dst"], "left").join(source, "src", "left").join(target, "dst", "left")
    outcome = (
        F.when(F.col("src") == F.col("dst"), "self_loop")
        .when(F.col("has_src").isNull() | F.col("has_dst").isNull(), "missing_node")
        .when(F.col("have"), "present").otherwise("new")
    )
    return joined.select("src", "rel", "dst", outcome.alias("outcome"))


def cascade_delete(edges: DataFrame, doomed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edge rows that go when pages are deleted: edge_id, reason (self_loop, duplicate, into_doomed, dangling).

    edges: edge_id, src, rel, dst; of equal edges the first stays; edges out of doomed pages go with them.
    """
    gone = doomed.select("slug", F.lit(True).alias("gone"))
    live = nodes.select("slug", F.lit(True).alias("live"))
    order = Window.partitionBy("src", "rel", "dst").orderBy("edge_id")
    marked = (
        edges.withColumn("n", F.row_number().over(order))
        .join(gone.select(F.col("slug").alias("src"), F.col("gone").alias("src_gone")), "src", "left")
        .join(gone.select(F.col("slug").alias("dst"), F.col("gone").alias("dst_gone")), "dst", "left")
        .join(live.select(F.col("slug").alias("dst"), F.col("live").alias("dst_live")), "dst", "left")
    )
    reason = (
        F.when(F.col("src") == F.col("dst"), "self_loop").when(F.col("n") > 1, "duplicate")
        .when(F.col("dst_gone"), "into_doomed").when(F.col("dst_live").isNull(), "dangling")
    )
    return marked.where(F.col("src_gone").isNull()).withColumn("reason", reason).where("reason is not null").select("edge_id", "reason")


def rules_of_policies(edges: DataFrame, policies: DataFrame, relations: list[str]) -> DataFrame:
    """policy, rule: edges of a family of relations, taken in both directions."""
    family = edges.where(F.col("rel").isin(relations))
    ahead = family.select(F.col("src").alias("policy"), F.col("dst").alias("rule"))
    back = family.select(F.col("dst").alias("policy"), F.col("src").alias("rule"))
    return ahead.unionByName(back).join(policies, "policy", "left_semi").distinct()


def missing_fetch_log(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """url, pages: references (page_id, urls) that were never fetched (cache: url)."""
    cited = pages.select("page_id", F.explode(F.array_distinct("urls")).alias("url")).where("url != ''")
    return cited.join(cache.select("url"), "url", "left_anti").groupBy("url").agg(F.count("*").alias("pages"))


def graph_summary(nodes: DataFrame, edges: DataFrame, limit: int, model: str | None = None, types: list[str] | None = None) -> DataFrame:
    """page_type, nodes, edges_out, relations of the first ``limit`` nodes by slug and the edges between them.

    nodes: slug, page_type, model; only those of ``model`` and of ``types`` are taken where these are given.
    ``relations`` are the distinct kinds of the kept edges that leave nodes of a type.
    """
    wanted = nodes.where(F.col("model") == model) if model is not None else nodes
    wanted = wanted.where(F.col("page_type").isin(types)) if types is not None else wanted
    kept = wanted.orderBy("slug").limit(limit).select("slug", "page_type")
    inner = edges.distinct().join(kept.select(F.col("slug").alias("src"), "page_type"), "src").join(kept.select(F.col("slug").alias("dst")), "dst", "left_semi")
    out = inner.groupBy("page_type").agg(F.count("*").alias("edges_out"), F.array_join(F.array_sort(F.collect_set("rel")), ",").alias("relations"))
    return kept.groupBy("page_type").agg(F.count("*").alias("nodes")).join(out, "page_type", "left").fillna(0, ["edges_out"]).fillna("", ["relations"])
