"""Structured loads: sheet profiles, planned and applied batches, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sheet_profile(rows: DataFrame, header: dict[str, str], order: str, sample: int = 3) -> DataFrame:
    """column, header, duplicate, empty, filled, distinct_values, is_unique, sample of the columns of a sheet.

    ``header`` names each column as the sheet does, so names may stand twice; ``order`` is the rows' order.  Blank cells
    count as empty.  Cells are counted by column and value first, so a hot value is one row before the values are.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.nullif(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("")).alias("value")) for c in header]))
    values = rows.select(cells.alias("c")).select("c.*").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    counts = values.groupBy("column").agg(F.sum("n").alias("filled"), F.count("*").alias("distinct_values"))
    first = rows.orderBy(order).limit(sample).select(F.col(order).alias("o"), cells.alias("c"))
    shown = first.groupBy("c.column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", F.coalesce("c.value", F.lit("")).alias("v")))), lambda s: s["v"]), "|").alias("sample"))
    names = list(header.values())
    listed = rows.sparkSession.createDataFrame([(c, n, names.count(n) > 1) for c, n in header.items()], "column string, header string, duplicate boolean")
    out = listed.join(counts, "column", "left").join(shown, "column", "left").fillna(0, ["filled", "distinct_values"])
    unique = (F.col("filled") > 0) & (F.col("filled") == F.col("distinct_values"))
    return out.select("column", "header", "duplicate", (F.col("filled") == 0).alias("empty"), "filled", "distinct_values", unique.alias("is_unique"), F.coalesce("sample", F.lit("")).alias("sample"))


def plan_entities(sheet: DataFrame, key: str, existing: DataFrame) -> DataFrame:
    """outcome (no_key, duplicate, update, create), rows: what a batch would do; the first row of a key wins."""
    blank = F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) == ""
    place = F.row_number().over(Window.partitionBy(key).orderBy("row_no"))
    have = existing.select(F.col("key").alias(key), F.lit(True).alias("have"))
    marked = sheet.withColumn("place", place).join(have, key, "left")
    outcome = F.when(blank, "no_key").when(F.col("place") > 1, "duplicate").when(F.col("have"), "update").otherwise("create")
    return marked.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("rows"))


def plan_relations(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """state (resolvable, no_source, no_target, neither), pairs: distinct pairs (src, dst) by the sides that exist."""
    source = nodes.select(F.col("slug").alias("src"), F.lit(True).alias("has_src"))
    target = nodes.select(F.col("slug").alias("dst"), F.lit(True).alias("has_dst"))
    joined = pairs.select("src", "dst").distinct().join(source, "src", "left").join(target, "dst", "left")
    state = (
        F.when(F.col("has_src") & F.col("has_dst"), "resolvable").when(F.col("has_dst"), "no_source")
        .when(F.col("has_src"), "no_target").otherwise("neither")
    )
    return joined.groupBy(state.alias("state")).agg(F.count("*").alias("pairs"))


def apply_entities(current: DataFrame, batch: DataFrame, tag: str) -> DataFrame:
    """slug, outcome (created, updated, skipped, pruned, kept) of a tagged batch (slug, attrs) on (slug, attrs, tag).

    Rows of the tag that the batch lacks are pruned; equal attributes are no change, so a rerun skips all.
    """
    new = batch.select("slug", F.col("attrs").alias("new_attrs"), F.lit(True).alias("in_batch"))
    both = current.select("slug", "attrs", "tag", F.lit(True).alias("in_current")).join(new, "slug", "full_outer")
    outcome = (
        F.when(F.col("in_current").isNull(), "created")
        .when(F.col("in_batch") & F.col("attrs").eqNullSafe(F.col("new_attrs")), "skipped")
        .when(F.col("in_batch"), "updated").when(F.col("tag") == tag, "pruned").otherwise("kept")
    )
    return both.select("slug", outcome.alias("outcome"))


def apply_relations(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """src, added, targets: targets united with those there are (lines: src, targets); only new ones are counted."""
    new = pairs.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("new"))
    joined = new.join(lines, "src", "left")
    old = F.coalesce("targets", F.array().cast("array<string>"))
    union = F.array_sort(F.array_union(old, F.col("new")))
    return joined.select("src", (F.size(union) - F.size(F.array_distinct(old))).alias("added"), F.array_join(union, ",").alias("targets"))


def ledger(batches: DataFrame) -> DataFrame:
    """batch, remaining, done of (batch, target, status)."""
    grouped = batches.groupBy("batch").agg(F.array_sort(F.collect_set(F.when(F.col("status") != "done", F.col("target")))).alias("open"))
    return grouped.select("batch", F.array_join("open", ",").alias("remaining"), (F.size("open") == 0).alias("done"))


def batch_upsert_items(items: DataFrame, incoming: DataFrame, verdicts: list[str]) -> DataFrame:
    """item, outcome: no_key, bad_verdict, create, update or same of ledger rows by (review, item)."""
    have = items.select("review", "item", F.col("verdict").alias("old_verdict"))
    joined = incoming.join(have, ["review", "item"], "left")
    outcome = (
        F.when(F.coalesce("item", F.lit("")) == "", "no_key").when(~F.col("verdict").isin(verdicts), "bad_verdict")
        .when(F.col("old_verdict").isNull(), "create").when(F.col("old_verdict") == F.col("verdict"), "same").otherwise("update")
    )
    return joined.select("review", "item", outcome.alias("outcome"))


def column_subset(rows: DataFrame, labels: dict[str, str], wanted: list[str]) -> tuple[DataFrame, list[str]]:
    """The wanted columns by label or name, and those that are unknown."""
    named = {**{c: c for c in rows.columns}, **{label: c for label, c in labels.items() if c in rows.columns}}
    known = list(dict.fromkeys(named[w] for w in wanted if w in named))
    return rows.select(*known), [w for w in wanted if w not in named]


def flatten_field(top: Column, nested: Column) -> Column:
    """The top-level value; the nested one where that is empty."""
    return F.coalesce(F.nullif(top, F.lit("")), nested)


def alias_index(terms: DataFrame) -> DataFrame:
    """alias, terms, conflict of (term, aliases): an alias that several terms claim is a conflict."""
    each = terms.select("term", F.explode("aliases").alias("alias")).select("term", F.lower(F.trim("alias")).alias("alias")).where("alias != ''")
    grouped = each.groupBy("alias").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return grouped.select("alias", F.array_join("terms", ",").alias("terms"), (F.size("terms") > 1).alias("conflict"))
