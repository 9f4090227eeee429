"""Processes, their activities and tasks, to choose a task from; what changed between tables and catalogues; ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.search import contained


def task_view(nodes: DataFrame, links: DataFrame, keywords: DataFrame) -> DataFrame:
    """process, activity, task, others, roles, io_missing, role_missing: tasks in their places, activities and processes without any too.

    nodes: kind (process, activity, task, role), slug, title, goal, entry, exit; links: kind (has_activity, has_task,
    has_role), src, dst, place.  Of several activities of a task the first by place counts, ``others`` are the rest; a task
    or activity that stands nowhere has no place above it.  With keywords (word) only tasks that hold one in their own
    fields or a role's title are shown, and only what leads to them.
    """
    of = lambda kind: nodes.where(F.col("kind") == kind)
    link = lambda kind: links.where(F.col("kind") == kind).groupBy("src", "dst").agg(F.min("place").alias("place"))
    named = link("has_role").join(of("role").select(F.col("slug").alias("dst"), "title"), "dst", "left").withColumn("title", F.coalesce("title", F.element_at(F.split("dst", "/"), -1)))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda r: r["title"])
    roles = named.groupBy(F.col("src").alias("task")).agg(F.array_join(listed, ",").alias("roles"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    tasks = of("task").select(F.col("slug").alias("task"), "title", "goal", "entry", "exit").join(roles, "task", "left").fillna("", ["roles"])
    words = keywords.select(F.lower(F.trim("word")).alias("word")).where("word != ''").distinct()
    narrowed = not words.isEmpty()
    if narrowed:
        hay = F.lower(F.concat_ws(" ", "task", "title", "goal", "entry", "exit", "roles"))
        met = contained(words.select(F.col("word").alias("part_id"), F.col("word").alias("part")), tasks.select(F.col("task").alias("whole_id"), hay.alias("whole")))
        tasks = tasks.join(met.select(F.col("whole_id").alias("task")).distinct(), "task", "left_semi")
    above = link("has_task").join(of("activity").select(F.col("slug").alias("src")), "src", "left_semi")
    order = F.transform(F.array_sort(F.collect_list(F.struct("place", "src"))), lambda a: a["src"])
    parents = above.groupBy(F.col("dst").alias("task")).agg(order.alias("parents"))
    placed = tasks.join(parents, "task", "left").select(
        "task", F.get("parents", F.lit(0)).alias("activity"), F.coalesce(F.array_join(F.slice("parents", 2, 1_000_000), ","), F.lit("")).alias("others"), "roles",
        (blank(F.col("entry")) | blank(F.col("exit"))).alias("io_missing"), (F.col("roles") == "").alias("role_missing"),
    )
    activities = of("activity").select(F.col("slug").alias("activity"))
    rows = placed.where("activity is null").unionByName(activities.join(placed.where("activity is not null"), "activity", "inner" if narrowed else "left").select(*placed.columns))
    processes = link("has_activity").join(of("process").select(F.col("slug").alias("src")), "src", "left_semi").select(F.col("src").alias("process"), F.col("dst").alias("activity"))
    rows = rows.join(processes, "activity", "left")
    if not narrowed:
        bare = of("process").select(F.col("slug").alias("process")).join(rows.select("process"), "process", "left_anti")
        rows = rows.unionByName(bare, allowMissingColumns=True)
    return rows.select("process", "activity", "task", "others", "roles", "io_missing", "role_missing")


def multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """The columns of both with n_a and n_b: rows that the tables do not hold equally often; none if they are equal."""
    counted = lambda rows, name: rows.groupBy(*a.columns).agg(F.count("*").alias(name))
    left, right = counted(a, "n_a").alias("x"), counted(b.select(*a.columns), "n_b").alias("y")
    same = None
    for c in a.columns:
        one = F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
        same = one if same is None else same & one
    both = left.join(right, same, "full_outer").select(*[F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in a.columns], F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    return both.where("n_a != n_b")


def catalog_counts(projection: DataFrame, artifact: DataFrame) -> DataFrame:
    """kind, projection, artifact, drift: how many names of each kind (kind, name) either side has."""
    one = projection.distinct().groupBy("kind").agg(F.count("*").alias("projection"))
    two = artifact.distinct().groupBy("kind").agg(F.count("*").alias("artifact"))
    return one.join(two, "kind", "full_outer").fillna(0).withColumn("drift", F.col("artifact") - F.col("projection"))


def last_batches(rows: DataFrame, most: int = 10) -> DataFrame:
    """batch, place, statuses, remaining, done of the ``most`` latest batches (batch, target, status, ts, row_id); each target by its last status."""
    last = rows.groupBy("batch", "target").agg(F.max(F.struct("ts", "row_id", "status")).alias("last"))
    told = F.array_sort(F.collect_list(F.concat_ws(":", "target", "last.status")))
    open_ = F.array_sort(F.collect_list(F.when(F.col("last.status") != "done", F.col("target"))))
    batches = last.groupBy("batch").agg(F.max("last.ts").alias("at"), F.array_join(told, ",").alias("statuses"), open_.alias("open"))
    kept = batches.orderBy(F.desc("at"), "batch").limit(most)
    place = F.row_number().over(Window.orderBy(F.desc("at"), "batch"))
    return kept.select("batch", place.alias("place"), "statuses", F.array_join("open", ",").alias("remaining"), (F.size("open") == 0).alias("done"))


def applied_items(items: DataFrame, incoming: DataFrame, verdicts: list[str]) -> DataFrame:
    """review, item, verdict, rule_fp, rev: a ledger after a batch; a rule's fingerprint is filled only where there is none.

    items: review, item, verdict, rule_fp, rev; incoming: review, item, verdict, rule_fp.  Rows without a key or with an
    unknown verdict are refused, of rows of one key the last by verdict counts, and a review that changes moves on by one
    revision whatever the number of its changes.
    """
    fine = incoming.where((F.coalesce("item", F.lit("")) != "") & F.col("verdict").isin(verdicts))
    fine = fine.groupBy("review", "item").agg(F.max(F.struct("verdict", "rule_fp")).alias("new"))
    both = items.join(fine, ["review", "item"], "full_outer")
    fingerprint = F.coalesce(F.nullif("rule_fp", F.lit("")), F.col("new.rule_fp"), F.lit(""))
    verdict = F.coalesce("new.verdict", "verdict")
    changed = ~verdict.eqNullSafe(F.col("verdict")) | ~fingerprint.eqNullSafe(F.coalesce("rule_fp", F.lit("")))
    rows = both.select("review", "item", verdict.alias("verdict"), fingerprint.alias("rule_fp"), "rev", changed.alias("changed"))
    revs = rows.groupBy("review").agg((F.coalesce(F.max("rev"), F.lit(0)) + F.max("changed").cast("int")).alias("rev"))
    return rows.drop("rev", "changed").join(revs, "review")
