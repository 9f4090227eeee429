"""Folder trees kept in step with the pages' categories, and categories kept in step with the ontology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.graphs import MOST_ROUNDS, settled

#: Levels of classes below the module, at most.
MOST_LEVELS = 5


def clean_path(path: Column) -> Column:
    return F.filter(F.transform(path, lambda p: F.trim(p)), lambda p: p != "")


def reconciled_folders(pages: DataFrame, existing: DataFrame, kb: str) -> DataFrame:
    """id, path, parent_id, depth, sort_order, action: the folders that the pages' categories ask for, and what to do.

    pages: slug, category_path (array); existing: id, path, parent_id, depth, sort_order.  A folder of a path that exists
    keeps its id, and is kept or updated; new ones get an id from the base and the path, so a second run over the result
    changes nothing.  Stale folders, and all but the first by id of one path, are pruned, the deepest first by depth.
    """
    path = clean_path(F.col("category_path"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.struct(F.array_join(F.slice("p", 1, i), "/").alias("path"), F.array_join(F.slice("p", 1, i - 1), "/").alias("parent"), (i - 1).alias("depth")))
    wanted = pages.select(path.alias("p")).distinct().where(F.size("p") > 0).select(F.explode(prefixes).alias("f")).select("f.*").distinct()
    order = F.row_number().over(Window.partitionBy("parent").orderBy("path")) - 1
    known = existing.groupBy("path").agg(F.min(F.struct("id", "parent_id", "depth", "sort_order")).alias("old"))
    made = F.sha1(F.concat(F.lit(f"{kb}/"), F.col("path")).cast("binary"))
    plan = wanted.withColumn("sort_order", order).join(known, "path", "left").withColumn("id", F.coalesce("old.id", made))
    plan = settled(plan, "folder-plan")
    above = plan.select(F.col("path").alias("parent"), F.col("id").alias("parent_id"))
    plan = plan.join(above, "parent", "left").withColumn("parent_id", F.coalesce("parent_id", F.lit("")))
    same = F.struct("parent_id", "depth", "sort_order").eqNullSafe(F.struct("old.parent_id", "old.depth", "old.sort_order"))
    action = F.when(F.col("old").isNull(), "insert").when(same, "keep").otherwise("update")
    columns = ["id", "path", "parent_id", "depth", "sort_order"]
    stale = existing.join(plan.select("id"), "id", "left_anti").select(*columns, F.lit("prune").alias("action"))
    return plan.select(*columns, action.alias("action")).unionByName(stale)


def folder_links(pages: DataFrame, plan: DataFrame) -> DataFrame:
    """slug, folder_id: pages (slug, category_path, folder_id) whose deepest folder is not the one they are linked to."""
    path = F.array_join(clean_path(F.col("category_path")), "/")
    kept = plan.where("action != 'prune'").select("path", F.col("id").alias("deepest"))
    met = pages.where(path != "").withColumn("path", path).join(kept, "path")
    return met.where(~F.coalesce("folder_id", F.lit("")).eqNullSafe(F.col("deepest"))).select("slug", F.col("deepest").alias("folder_id"))


def one_step(chains: DataFrame, step: DataFrame) -> DataFrame:
    """The open chains beside the class that comes next; a join of the whole table in each round, which is not sent to the driver."""
    return chains.join(step.hint("merge"), F.col("next") == F.col("at"), "left")


def class_chains(classes: DataFrame) -> DataFrame:
    """class, labels: the labels from the top to the class over first parents (class, label, parent); cycles end a chain."""
    label = F.coalesce(F.nullif("label", F.lit("")), F.col("class"))
    step = settled(classes.select(F.col("class").alias("at"), label.alias("said"), F.col("parent").alias("above")), "class-steps")
    open_ = step.select(F.col("at").alias("class"), F.array("at").alias("seen"), F.array("said").alias("labels"), F.col("above").alias("next"))
    done = None
    for _ in range(MOST_ROUNDS):
        grown = one_step(open_, step)
        ends = F.col("next").isNull() | F.array_contains("seen", F.col("next"))
        # a parent that is no class stands by its name
        grown = settled(grown.select("class", ends.alias("ends"), "seen", "labels", "next", "said", "above"), "class-chains")
        over = grown.where("ends").select("class", "labels")
        done = over if done is None else done.unionByName(over)
        open_ = grown.where("not ends").select("class", F.concat("seen", F.array("next")).alias("seen"), F.concat(F.array(F.coalesce("said", "next")), "labels").alias("labels"), F.col("above").alias("next"))
        if open_.isEmpty():
            return done
    raise ValueError(f"a chain of classes is longer than {MOST_ROUNDS}")


def recategorized(pages: DataFrame, classes: DataFrame, builtin: DataFrame, module: str, depth: int = 1) -> DataFrame:
    """slug, old_path, new_path, wiki_path: pages whose category differs from what their class says.

    pages: slug, title, page_type, category_path; classes: class, module, label, parent; builtin: page_type, label of types
    without a colon, which stand under ``module``.  A class stands under its module: alone where ``depth`` is 0, else by the
    first ``depth`` levels from the top (5 at most).  Unknown classes, classes of the ontology itself, the index and pages
    without a type stay as they are.
    """
    depth = max(0, min(depth, MOST_LEVELS))
    chains = class_chains(classes).join(classes.select("class", "module"), "class")
    cut = F.slice("labels", -1, 1) if depth == 0 else F.slice("labels", 1, depth)
    typed = chains.select(F.col("class").alias("page_type"), F.concat(F.array("module"), cut).alias("path"))
    kind = F.trim(F.coalesce("page_type", F.lit("")))
    rows = pages.withColumn("page_type", kind).where(~kind.startswith("ontology:") & ~kind.isin("index", ""))
    named = rows.join(typed, "page_type", "left").join(builtin.select("page_type", F.col("label").alias("own")), "page_type", "left")
    path = F.when(~F.col("page_type").contains(":"), F.array(F.lit(module), F.coalesce("own", "page_type"))).otherwise(F.col("path"))
    out = named.withColumn("new_path", path).where("new_path is not null").where(~F.col("new_path").eqNullSafe(F.col("category_path")))
    wiki = F.array_join(F.concat("new_path", F.array(F.trim(F.coalesce("title", F.lit(""))))), "/")
    return out.select("slug", F.array_join("category_path", "/").alias("old_path"), F.array_join("new_path", "/").alias("new_path"), wiki.alias("wiki_path"))


def realigned(pages: DataFrame) -> DataFrame:
    """slug, depth, wiki_path, depth_fixed, path_fixed: derived columns of pages with a category, where they are wrong."""
    wiki = F.array_join(F.concat("category_path", F.array(F.coalesce("title", F.lit("")))), "/")
    rows = pages.where(F.size("category_path") > 0).withColumns({"d": F.size("category_path"), "w": wiki})
    depth, path = ~F.col("depth").eqNullSafe(F.col("d")), F.coalesce("wiki_path", F.lit("")) != F.col("w")
    return rows.where(depth | path).select("slug", F.col("d").alias("depth"), F.col("w").alias("wiki_path"), depth.alias("depth_fixed"), path.alias("path_fixed"))
