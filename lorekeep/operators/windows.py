"""Sessions, running values and order-dependent groupings over logs and texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.graphs import MOST_ROUNDS, settled
from lorekeep.operators.search import gram_codes
from lorekeep.operators.vectors import alike_sets


def sessionize(calls: DataFrame, gap: int = 90) -> DataFrame:
    """Adds ``part``: a user's calls (user, ts, label, call_id) split where the gap exceeds ``gap`` seconds.

    An explicit label wins and stands outside the gap rule; a gap of exactly ``gap`` seconds stays in the session.
    """
    order = Window.partitionBy("user", F.col("label").isNull()).orderBy("ts", "call_id")
    wide = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(order) > gap * 1_000_000
    opens = F.when(F.coalesce(wide, F.lit(True)), 1).otherwise(0)
    numbered = calls.withColumn("opens", opens)
    running = F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return numbered.withColumn("part", F.coalesce("label", F.concat(F.lit("s"), running))).drop("opens")


def prompt_delta(rounds: DataFrame) -> DataFrame:
    """Adds ``delta``: actual minus the request's last non-zero actual before; null where there is none."""
    before = Window.partitionBy("request").orderBy("ts", "round").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.nullif("actual", F.lit(0)), ignorenulls=True).over(before)
    return rounds.withColumn("delta", F.when(F.col("actual") != 0, F.col("actual") - last))


def latest_per_key(records: DataFrame, key: str, status: str) -> DataFrame:
    """Of every key the last record (ts, record_id), if it has the status."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("record_id")))
    return records.withColumn("place", place).where("place = 1").drop("place").where(F.col("status") == status)


def first_action(calls: DataFrame, tools: list[str]) -> DataFrame:
    """turn, tool, ts: the earliest retrieval of every turn."""
    found = calls.where(F.col("tool").isin(tools))
    best = found.groupBy("turn").agg(F.min(F.struct("ts", "call_id", "tool")).alias("first"))
    return best.select("turn", F.col("first.tool").alias("tool"), F.col("first.ts").alias("ts"))


def asof_backward(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id: the key's latest right row at or before each left row (key, ts), else its first one.

    Both sides are united and one running value per key finds the match, so no pairs are made.
    """
    a = left.select("key", "ts", F.lit(1).alias("side"), F.col("left_id"), F.lit(None).cast("long").alias("right_id"))
    b = right.select("key", "ts", F.lit(0).alias("side"), F.lit(None).cast("long").alias("left_id"), "right_id")
    order = Window.partitionBy("key").orderBy("ts", "side", "right_id")
    every = Window.partitionBy("key").orderBy("ts", "side", "right_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = a.unionByName(b)
    seen = F.last("right_id", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.first("right_id", ignorenulls=True).over(every)
    return both.withColumn("match", F.coalesce(seen, first)).where("side = 1").select("left_id", F.col("match").alias("right_id"))


def session_parts(turns: DataFrame) -> DataFrame:
    """Adds part, reason: an agent, role or document change opens a part; a change of intent alone needs confirmation."""
    order = Window.partitionBy("session").orderBy("turn")
    before = order.rowsBetween(Window.unboundedPreceding, -1)

    def changed(column: str):
        last = F.last(column, ignorenulls=True).over(before)
        return F.coalesce(F.col(column).isNotNull() & last.isNotNull() & (F.col(column) != last), F.lit(False))

    reason = (
        F.when(F.row_number().over(order) == 1, "start").when(changed("agent"), "agent").when(changed("role"), "role")
        .when(changed("document"), "document").when(changed("intent"), "confirm").otherwise("reuse")
    )
    marked = turns.withColumn("reason", reason)
    opens = F.col("reason").isin("start", "agent", "role", "document").cast("int")
    return marked.withColumn("part", F.sum(opens).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def drop_adjacent_duplicates(sections: DataFrame, longest: int = 500) -> DataFrame:
    """Sections (doc, place, text) without those equal to the one before, if short."""
    before = F.lag("text").over(Window.partitionBy("doc").orderBy("place"))
    same = before.isNotNull() & (before == F.col("text")) & (F.length("text") <= longest)
    return sections.withColumn("same", same).where("not same").drop("same")


def carry_heading(lines: DataFrame) -> DataFrame:
    """Adds ``section``: the last heading at or before a line; in place of a table-like one the last that is none."""
    order = Window.partitionBy("doc").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.nullif("heading", F.lit("")), ignorenulls=True).over(order)
    tabular = lambda c: c.rlike("^(Table|Tab\\.|表)|\\|")
    plain = F.last(F.when(~tabular(F.col("heading")), F.nullif("heading", F.lit(""))), ignorenulls=True).over(order)
    return lines.withColumn("section", F.when(tabular(last), plain).otherwise(last))


#: Characters a token stands for: a fixed value.
CHARS_PER_TOKEN = 1.6


def split_oversized(units: DataFrame, children: DataFrame, budget: int) -> DataFrame:
    """doc, unit, place, chars of units (doc, unit, place, chars, tokens, head) to be packed: one of more tokens than the
    budget is replaced by its children (unit, child, child_place, chars), of which the first also carries its head."""
    kids = children.select("unit", "child", "child_place", F.col("chars").alias("child_chars"))
    over = units.where(F.col("tokens") > budget).join(kids, "unit")
    first = F.col("child_place") == F.min("child_place").over(Window.partitionBy("unit"))
    parts = over.withColumn("first", first).select("doc", F.col("child").alias("unit"), F.struct("place", F.col("child_place").alias("part")).alias("place"), (F.col("child_chars") + F.when(F.col("first"), F.col("head")).otherwise(0)).alias("chars"))
    rest = units.join(over.select("unit").distinct(), "unit", "left_anti")
    return rest.select("doc", "unit", F.struct("place", F.lit(0).cast(children.schema["child_place"].dataType).alias("part")).alias("place"), "chars").unionByName(parts)


def pack_budget(units: DataFrame, budget: int) -> DataFrame:
    """doc, unit, batch: consecutive units (doc, unit, place, chars) packed greedily; a batch closes before it would
    exceed the budget of tokens.  The fold needs the running state, so it runs over each document's sorted units."""
    listed = units.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("place", "unit", "chars"))).alias("units"))
    start = F.struct(F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("out"))

    def add(acc: Column, unit: Column) -> Column:
        chars = unit["chars"].cast("long")
        full = (F.size(acc["out"]) > 0) & (F.element_at(acc["out"], -1) == acc["batch"]) & ((acc["used"] + chars) / CHARS_PER_TOKEN > budget)
        batch = F.when(full, acc["batch"] + 1).otherwise(acc["batch"])
        return F.struct(batch.alias("batch"), F.when(full, chars).otherwise(acc["used"] + chars).alias("used"), F.concat(acc["out"], F.array(batch)).alias("out"))

    packed = listed.select("doc", "units", F.aggregate("units", start, add, lambda acc: acc["out"]).alias("batches"))
    return packed.select("doc", F.explode(F.arrays_zip(F.transform("units", lambda u: u["unit"]).alias("unit"), F.col("batches").alias("batch"))).alias("z")).select("doc", "z.unit", "z.batch")


def group_questions(rows: DataFrame, threshold: float = 0.62) -> DataFrame:
    """row_id, question_group: leader clustering in order of time over rows (row_id, qid, core, ts).

    Equal qids share the group of their first row.  A row joins the group whose first question has the best bigram
    Jaccard at or above the threshold (the earliest of equals), else opens one, named by its row_id; a row without a
    core is ``G0``.  Instead of row after row, leaders are found in rounds: a core leads if no core alike that comes
    before it leads, so what has no undecided core alike before it is decided.
    """
    order = F.struct("ts", "row_id")
    asked = rows.select("row_id", F.coalesce("qid", F.lit("")).alias("qid"), F.coalesce("core", F.lit("")).alias("core"), "ts")
    firsts = asked.where("qid != '' and core != ''").groupBy("qid").agg(F.min(order).alias("first")).select("qid", F.col("first.row_id").alias("first_row"))
    asked = asked.join(firsts, "qid", "left")
    alone = asked.where("core != '' and (qid = '' or first_row = row_id)")
    cores = settled(alone.groupBy("core").agg(F.min(order).alias("at")).withColumn("id", F.monotonically_increasing_id()), "cores")
    pairs = alike_sets(cores.select("id", gram_codes(F.col("core"), 2).alias("grams")), None, threshold)
    at = cores.select("id", "at")
    pairs = pairs.join(at, "id").join(at.select(F.col("id").alias("id_b"), F.col("at").alias("at_b")), "id_b")
    ahead = F.col("at") < F.col("at_b")
    alike = pairs.select(F.when(ahead, F.col("id")).otherwise(F.col("id_b")).alias("early"), F.when(ahead, F.col("id_b")).otherwise(F.col("id")).alias("late"), "score")
    alike = settled(alike, "alike")
    leaders, open_pairs, undecided = [], alike.select("early", "late"), cores.select("id")
    for _ in range(MOST_ROUNDS):
        lead = settled(undecided.join(open_pairs.select(F.col("late").alias("id")), "id", "left_anti"), "leaders")
        leaders.append(lead)
        follow = alike.join(lead.select(F.col("id").alias("early")), "early", "left_semi").select(F.col("late").alias("id"))
        undecided = settled(undecided.join(lead, "id", "left_anti").join(follow, "id", "left_anti"), "undecided")
        if undecided.isEmpty():
            break
        both = [undecided.select(F.col("id").alias(c)) for c in ("early", "late")]
        open_pairs = alike.select("early", "late").join(both[0], "early", "left_semi").join(both[1], "late", "left_semi")
    else:
        raise ValueError("the groups did not settle")
    lead = reduce(DataFrame.unionByName, leaders).join(at, "id")
    near = alike.select(F.col("early").alias("id"), F.col("late").alias("own"), "score").unionByName(alike.select(F.col("late").alias("id"), F.col("early").alias("own"), "score"))
    near = near.unionByName(cores.select("id", F.col("id").alias("own"), F.lit(1.0).alias("score"))).join(lead, "id")
    choices = near.join(cores.select(F.col("id").alias("own"), "core"), "own").select("core", "score", F.col("at").alias("lead"))
    joined = alone.select("row_id", "core", order.alias("at")).join(choices, "core").where(F.col("lead") <= F.col("at"))
    best = joined.groupBy("row_id").agg(F.min(F.struct(-F.col("score"), "lead")).alias("best"))
    named = best.select(F.col("row_id").alias("leads"), F.concat(F.lit("G"), F.col("best.lead.row_id")).alias("name"))
    leads = F.when(F.col("core") != "", F.coalesce("first_row", "row_id"))
    out = asked.select("row_id", leads.alias("leads")).join(named, "leads", "left")
    return out.select("row_id", F.coalesce("name", F.lit("G0")).alias("question_group"))


def mentions(texts: DataFrame, names: list[str]) -> DataFrame:
    """text_id, name: which names of three characters or more occur, longest first, a match hiding shorter ones in it.

    ``names`` is a dictionary held by every task; it is a parameter, not a table that grows.
    """
    ordered = sorted({n for n in names if len(n) >= 3}, key=lambda n: (-len(n), n))

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for text_id, text in zip(frame["text_id"], frame["text"], strict=True):
                for name in ordered:
                    if name in text:
                        found.append((text_id, name))
                        text = text.replace(name, "\0" * len(name))
            yield pd.DataFrame(found, columns=["text_id", "name"])

    return texts.select("text_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(find, "text_id long, name string")
