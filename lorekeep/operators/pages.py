"""Page scans and predicates, idempotent writes, and aggregates over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_instance(page_type: Column) -> Column:
    """An entity page: its type is ``module:Class``, and no class of the ontology itself."""
    kind = F.coalesce(page_type, F.lit(""))
    return kind.contains(":") & ~kind.startswith("ontology:") & ~kind.isin("index", "summary")


def live_pages(pages: DataFrame, kb: Column, limit: int) -> DataFrame:
    """The first ``limit`` live pages of a knowledge base by slug, and whether there were more."""
    found = pages.where(kb & ~F.col("deleted")).orderBy("slug").limit(limit + 1)
    numbered = found.withColumn("n", F.row_number().over(Window.orderBy("slug")))
    more = F.max("n").over(Window.partitionBy(F.lit(1))) > limit
    return numbered.withColumn("truncated", more).where(F.col("n") <= limit).drop("n")


def pages_top_n(pages: DataFrame, n: int, body: int = 1500) -> DataFrame:
    """The first ``n`` pages of every knowledge base by slug, with the start of their bodies."""
    order = Window.partitionBy("kb_id").orderBy("slug")
    return pages.where(~F.col("deleted")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).withColumn(
        "content", F.substring("content", 1, body)
    )


def live_kbs_only(rows: DataFrame, kbs: DataFrame) -> DataFrame:
    """Rows of knowledge bases that are not deleted (kbs: kb_id, deleted)."""
    return rows.join(kbs.where(~F.col("deleted")), "kb_id", "left_semi")


def with_kb(rows: DataFrame, kbs: DataFrame) -> DataFrame:
    """Adds the knowledge base's columns; rows of unknown ones stay."""
    return rows.join(kbs, "kb_id", "left")


def kb_page_stats(pages: DataFrame) -> DataFrame:
    """pages, instance_pages and concept_pages of every knowledge base."""
    live = pages.where(~F.col("deleted"))
    return live.groupBy("kb_id").agg(
        F.count("*").alias("pages"),
        F.count_if(is_instance(F.col("page_type"))).alias("instance_pages"),
        F.count_if(F.col("page_type").startswith("ontology:")).alias("concept_pages"),
    )


#: How each metric of a base is computed, as its reports say.
FORMULAS = {
    "pages": "count of live pages", "without_source": "count of pages without sources", "types": "count of distinct types",
    "mean_version": "sum over types of mean version x pages / pages",
}


def kb_metrics(pages: DataFrame) -> DataFrame:
    """name, value, formula, hash: live pages, those without source, types, and the mean version weighted by each type's pages.

    ``hash`` is the same on every row and follows from all names and values, to six places.
    """
    by_type = pages.groupBy("page_type").agg(
        F.count("*").alias("n"), F.count_if(F.size("source_refs") == 0).alias("bare"), F.avg("version").alias("version")
    )
    total = by_type.agg(
        F.sum("n").cast("double").alias("pages"),
        F.sum("bare").cast("double").alias("without_source"),
        F.count("*").cast("double").alias("types"),
        (F.sum(F.col("version") * F.col("n")) / F.sum("n")).alias("mean_version"),
    )
    told = [F.concat(F.lit(f"{name}="), F.coalesce(F.col(name).cast("decimal(20,6)").cast("string"), F.lit(""))) for name in sorted(FORMULAS)]
    total = total.withColumn("hash", F.md5(F.concat_ws(";", *told).cast("binary")))
    formula = F.create_map(*[F.lit(x) for pair in FORMULAS.items() for x in pair])
    return total.unpivot(["hash"], list(FORMULAS), "name", "value").withColumn("formula", formula[F.col("name")])


def duplicate_keys(rows: DataFrame, keys: list[str], version: str, row_id: str) -> DataFrame:
    """Keys that several rows share, with their versions and ids in order."""
    grouped = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.array_join(F.array_sort(F.collect_list(version)), ",").alias("versions"),
        F.array_join(F.array_sort(F.collect_list(row_id)), ",").alias("ids"),
    )
    return grouped.where("n > 1")


def deleted_beside_live(pages: DataFrame, key: str) -> DataFrame:
    """Keys of soft-deleted rows that also live, with how many deleted rows there are."""
    gone = pages.where("deleted").groupBy(key).agg(F.count("*").alias("n_deleted"))
    return gone.join(pages.where(~F.col("deleted")), key, "left_semi")


def top_types_elsewhere(pages: DataFrame, kb: str, types: list[str], n: int = 3) -> DataFrame:
    """The ``n`` other knowledge bases with most live pages of the types."""
    found = pages.where(~F.col("deleted") & (F.col("kb_id") != kb) & F.col("page_type").isin(types))
    return found.groupBy("kb_id").agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "kb_id").limit(n)


def primary_member(groups: DataFrame, group: str) -> DataFrame:
    """Of every group the member with the highest version, then the smallest slug."""
    best = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("version"), "slug"))
    return groups.withColumn("place", best).where("place = 1").drop("place")


def upsert_pages(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The page table after a batch, with ``outcome``: created, updated, skipped (same content) or kept.

    Both hold kb_id, slug, content, refs; ``current`` also version.  A new page has version 1, a changed one the next
    version, references are united, and the same content twice is no change.  An updated page's ``old_content`` is
    the snapshot for the revision table.
    """
    old = current.select("kb_id", "slug", F.col("content").alias("old_content"), F.col("refs").alias("old_refs"), "version")
    new = incoming.select("kb_id", "slug", F.col("content").alias("new_content"), F.col("refs").alias("new_refs"))
    both = old.join(new, ["kb_id", "slug"], "full_outer")
    none = F.array().cast("array<string>")
    refs = F.array_sort(F.array_union(F.coalesce("old_refs", none), F.coalesce("new_refs", none)))
    same = F.col("old_content").eqNullSafe(F.col("new_content")) & (refs == F.array_sort(F.coalesce("old_refs", none)))
    outcome = (
        F.when(F.col("version").isNull(), "created")
        .when(F.col("new_refs").isNull() & F.col("new_content").isNull(), "kept")
        .when(same, "skipped")
        .otherwise("updated")
    )
    return both.withColumn("outcome", outcome).select(
        "kb_id", "slug",
        F.coalesce("new_content", "old_content").alias("content"),
        refs.alias("refs"),
        F.when(F.col("outcome") == "created", F.lit(1)).when(F.col("outcome") == "updated", F.col("version") + 1).otherwise(F.col("version")).cast("long").alias("version"),
        "outcome",
        F.when(F.col("outcome") == "updated", F.col("old_content")).alias("old_content"),
    )


def replace_projection(current: DataFrame, batch: DataFrame, tag: str) -> DataFrame:
    """Generated rows replaced: same-slug rows and stale rows of the tag go, the batch comes in."""
    kept = current.join(batch.select("kb_id", "slug"), ["kb_id", "slug"], "left_anti").where(~F.col("generator").eqNullSafe(F.lit(tag)))
    return kept.unionByName(batch)


def restore_pages(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Bodies from graph nodes back into pages, and whether they changed; a page without node keeps its body."""
    own = nodes.select("kb_id", "slug", F.col("body").alias("node_body"))
    joined = pages.join(own, ["kb_id", "slug"], "left")
    body = F.coalesce("node_body", "content", F.lit(""))
    return joined.withColumn("changed", ~F.coalesce("content", F.lit("")).eqNullSafe(body)).withColumn("content", body).drop("node_body")


def alias_noise(pages: DataFrame) -> DataFrame:
    """kb_id, slug, title, removed, kept of pages (kb_id, slug, title, aliases) that name their title among their aliases."""
    title = F.trim(F.coalesce("title", F.lit("")))
    named = F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a.isNotNull() & (F.trim(a) != ""))
    found = pages.withColumns({"kept": F.filter(named, lambda a: F.trim(a) != title), "removed": F.filter(named, lambda a: F.trim(a) == title)})
    return found.where((title != "") & (F.size("removed") > 0)).select("kb_id", "slug", title.alias("title"), "removed", "kept")


def clean_alias_noise(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages with the aliases that are no noise, one version on where anything changed, and the rows as they were."""
    noise = alias_noise(pages).select("kb_id", "slug", F.col("kept").alias("clean"))
    joined = pages.join(noise, ["kb_id", "slug"], "left")
    changed = F.col("clean").isNotNull()
    after = joined.withColumns({"aliases": F.coalesce("clean", "aliases"), "version": F.col("version") + changed.cast("int")})
    return after.select(*pages.columns), joined.where(changed).select(*pages.columns)
