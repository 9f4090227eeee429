"""Retrieval evaluation: cohorts, arm metrics, truth judging, evidence scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.graphs import settled
from lorekeep.operators.search import gram_codes, jaccard_pairs

#: Fixed values of the evidence score: weights of a fact's status, confidence word and source, and of a check's verdict.
STATUS_SCORE = {"present": 1.0, "absent_verified": 1.0, "unavailable": 0.2}
CONFIDENCE_WORD = {"high": 1.0, "medium": 0.7, "low": 0.4}
SOURCE_WEIGHT = {
    "doc_table": 1.0, "doc_text": 0.9, "graph": 0.95, "image": 0.7, "doc_image": 0.85, "external_query": 0.6, "external_stub": 0.4, "unknown": 0.5,
}
SOURCE_ALIAS = {
    "document": "doc_text", "doc": "doc_text", "text": "doc_text", "table": "doc_table", "img": "image", "figure": "image",
    "stub": "external_stub", "external": "external_query", "kb": "graph",
}
CHECK_SCORE = {"supported": 1.0, "not_supported": 0.0, "insufficient": 0.3}
UNKNOWN_STATUS, UNKNOWN_CONFIDENCE, UNKNOWN_SOURCE, UNKNOWN_CHECK, UNCHECKED = 0.5, 0.7, 0.5, 0.3, 0.6
HIGH_LEVEL = 0.80


def p90(values: Column) -> Column:
    """Of a list the value at place max(0, int(0.9 n) - 1) in order: not interpolated."""
    place = F.greatest(F.lit(0), F.floor(F.size(values) * 0.9).cast("int") - 1)
    return F.get(F.array_sort(values), place)


def version_match(version: Column, pattern: str) -> Column:
    """Glob (``*``), prefix, or the part before ``-``."""
    if "*" in pattern:
        return version.like(pattern.replace("%", r"\%").replace("_", r"\_").replace("*", "%"))
    return version.startswith(pattern) | (F.element_at(F.split(version, "-"), 1) == pattern)


def cohort_reasons(rows: DataFrame, since: Column, until: Column, version: str, selftest: Column, first: str) -> DataFrame:
    """Adds ``reason``: why a row is left out, the first that applies, or null (self_report: what a call says of being first)."""
    reason = (
        F.when((F.col("ts") < since) | (F.col("ts") >= until), "out_of_range")
        .when(~version_match(F.col("version"), version), "version_mismatch")
        .when(selftest, "selftest")
        .when(F.col("qid").isNull(), "turn_missing")
        .when(F.col("tool") != first, "first_retrieval_other")
        .when(~F.coalesce("self_report", F.lit(True)), "self_report_false")
    )
    return rows.withColumn("reason", reason)


def cohort_counts(rows: DataFrame) -> DataFrame:
    """Rows kept and left out by reason."""
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("rows"))


def value_places(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group the whole-number median and the p90 of a value: <value>_median, <value>_p90.

    Equal values are counted before they are ordered, so a group is read by its distinct values.  The p90 is the value
    at place max(0, int(0.9 n) - 1) in order, not interpolated.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy(value))
    placed = counted.withColumn("upto", upto).join(counted.groupBy(*by).agg(F.sum("n").alias("total")), by)

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("upto") > place, F.col(value)))

    low, high = at(F.floor((F.col("total") - 1) / 2)), at(F.floor(F.col("total") / 2))
    p90 = at(F.greatest(F.lit(0), F.floor(F.col("total") * 0.9) - 1))
    return placed.groupBy(*by).agg(((low + high) / 2).cast("long").alias(f"{value}_median"), p90.alias(f"{value}_p90"))


def arm_summary(rows: DataFrame, expects: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per arm (or ``by``): counts, rates, attempts, times and IO of calls (arm, session, qid, hits, ms, queries,
    empty_queries, hit_queries, has_io, degraded, guidance) against expectations (qid, expected).

    Attempts are the calls of a session on a question; the converged share has three at most.  A call of an expected
    question is ok with as many hits, or with none where none is expected.  IO counts only over calls that have IO.
    """
    by = by or ["arm"]
    decided = rows.join(expects, "qid", "left")
    ok = F.when(F.col("expected") > 0, F.col("hits") >= F.col("expected")).otherwise(F.col("hits") == 0)
    case_ok = F.when(F.col("expected").isNotNull(), ok.cast("double"))
    io, hit, slow = F.col("has_io"), F.col("hits") > 0, F.col("degraded")
    share = lambda c: F.count_if(io & c) / F.count_if(io)
    io_sum = lambda c: F.sum(F.when(io, F.col(c)))
    flat = decided.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_distinct("qid").alias("questions"), F.avg(hit.cast("double")).alias("found_rate"),
        F.avg(case_ok).alias("case_ok_rate"), F.count("expected").alias("decided"), F.avg(F.col("guidance").cast("double")).alias("guidance_rate"), F.sum("ms").alias("ms"),
        F.count_if(io).alias("io_n"), io_sum("queries").alias("queries"), io_sum("empty_queries").alias("empty_queries"), io_sum("hit_queries").alias("hit_queries"),
        (io_sum("empty_queries") / F.nullif(io_sum("empty_queries") + io_sum("hit_queries"), F.lit(0))).alias("empty_rate"),
        share(slow).alias("degraded_rate"), share(hit).alias("ok_rate"), share(hit & ~slow).alias("hit_plain_rate"), share(hit & slow).alias("hit_degraded_rate"),
    )
    groups = rows.groupBy(*by, "session", "qid").agg(F.count("*").alias("attempts"), F.sum("ms").alias("group_ms"))
    tried = groups.groupBy(*by).agg(F.avg("attempts").alias("attempts"), F.avg((F.col("attempts") <= 3).cast("double")).alias("converged"))
    out = flat.join(tried, by).join(value_places(rows, by, "ms"), by).join(value_places(groups, by, "group_ms"), by)
    per_call = value_places(rows.where(io), by, "queries").select(*by, "queries_median")
    return out.join(per_call, by, "left")


def by_category(rows: DataFrame, category: str) -> DataFrame:
    """solved and total per category and arm, arms as columns."""
    cell = rows.groupBy(category).pivot("arm", ["hint", "plain"])
    return cell.agg(F.count_if(F.col("hits") > 0).alias("solved"), F.count(F.lit(1)).alias("total"))


def by_version(rows: DataFrame, expects: DataFrame) -> DataFrame:
    """The summary per algorithm version (before ``-``) and arm."""
    base = F.element_at(F.split("version", "-"), 1)
    return arm_summary(rows.withColumn("algorithm", base), expects, ["algorithm", "arm"])


def by_question_group(rows: DataFrame) -> DataFrame:
    """Per question: tools, rounds by arm, and hits, queries, empties and ms of the hint arm only."""
    hint = F.col("arm") == "hint"
    return rows.groupBy("qid").agg(
        F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("shapes"),
        F.count_if(hint).alias("hint_rounds"),
        F.count_if(~hint).alias("plain_rounds"),
        F.sum(F.when(hint, F.col("hits")).otherwise(0)).alias("hint_hits"),
        F.sum(F.when(hint, F.col("queries")).otherwise(0)).alias("hint_queries"),
        F.count_if(hint & (F.col("hits") == 0)).alias("hint_empty"),
        F.sum(F.when(hint, F.col("ms")).otherwise(0)).alias("hint_ms"),
    )


def pairing(rows: DataFrame) -> DataFrame:
    """session, qid, seen_by: both arms, or the only one."""
    arms = rows.groupBy("session", "qid").agg(F.array_sort(F.collect_set("arm")).alias("arms"))
    return arms.select("session", "qid", F.when(F.size("arms") > 1, F.lit("both")).otherwise(F.element_at("arms", 1)).alias("seen_by"))


def pairing_summary(rows: DataFrame, arms: tuple[str, str] = ("hint", "plain")) -> DataFrame:
    """<arm>_groups, paired, only_<arm>, arm_missing, comparable: how many question groups (session, qid) each arm saw."""
    seen = [F.max((F.col("arm") == arm).cast("int")).alias(arm) for arm in arms]
    groups = rows.where(F.col("arm").isin(*arms)).groupBy("session", "qid").agg(*seen)
    a, b = (F.col(arm) == 1 for arm in arms)
    counts = groups.agg(F.count_if(a).alias(f"{arms[0]}_groups"), F.count_if(b).alias(f"{arms[1]}_groups"), F.count_if(a & b).alias("paired"), F.count_if(a & ~b).alias(f"only_{arms[0]}"), F.count_if(b & ~a).alias(f"only_{arms[1]}"))
    missing = F.when(F.col(f"{arms[1]}_groups") == 0, arms[1]).when(F.col(f"{arms[0]}_groups") == 0, arms[0]).otherwise("")
    return counts.withColumns({"arm_missing": missing, "comparable": F.col("paired") > 0})


def paired_rows(rows: DataFrame) -> DataFrame:
    """Rows of questions that both arms saw."""
    return rows.join(pairing(rows).where("seen_by = 'both'"), ["session", "qid"], "left_semi")


def compare_sets(got: Column, expected: Column, forbidden: Column, any_of: Column) -> dict[str, Column]:
    """missing, extra, forbidden_hit, precision, recall, f1, strict of result sets.

    What is expected and not got is missing, but a group of ``any_of`` with a hit clears its members from *missing*,
    and one without a hit clears them from *extra*.  Precision counts the raw hits among the expected; recall counts
    what is not missing after the groups; with nothing expected it is 0.
    """
    cleared = F.flatten(F.filter(any_of, lambda g: F.arrays_overlap(g, got)))
    passed = F.flatten(F.filter(any_of, lambda g: ~F.arrays_overlap(g, got)))
    wanted, held = F.array_distinct(expected), F.array_distinct(got)
    missing = F.array_except(F.array_except(wanted, held), cleared)
    extra = F.array_except(F.array_except(held, wanted), passed)
    bad = F.array_intersect(held, forbidden)
    hits = F.size(F.array_intersect(wanted, held))
    precision = F.when(F.size(held) == 0, F.lit(0.0)).otherwise(hits / F.size(held))
    recall = F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise((F.size(wanted) - F.size(missing)) / F.size(wanted))
    f1 = F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))
    return {
        "n_missing": F.size(missing),
        "n_extra": F.size(extra),
        "n_forbidden": F.size(bad),
        "precision": precision,
        "recall": recall,
        "f1": f1,
        "strict": (F.size(missing) + F.size(extra) + F.size(bad)) == 0,
    }


def judge_stats(rows: DataFrame) -> DataFrame:
    """Totals of judged turns (matched, answered, correct, f1, fetched_correct, adoption, entry_id, qid).

    A turn is judged if it is matched and answered; unjudged ones leave the accuracy but count in coverage.  What was
    fetched is judged apart (null where nothing was), and turns of one entry and qid weigh as one group.
    """
    judged = F.col("matched") & F.col("answered")
    fetched = F.when(F.col("matched"), F.col("fetched_correct").cast("double"))
    flat = rows.agg(
        F.count("*").alias("n_total"), F.count_if("matched").alias("n_matched"), F.count_if(judged).alias("n_judged"), F.avg(judged.cast("double")).alias("coverage"),
        F.avg(F.when(judged, F.col("correct").cast("double"))).alias("accuracy"), F.avg(F.when(judged, F.col("f1"))).alias("mean_f1"),
        F.count(fetched).alias("n_fetched"), F.avg(fetched).alias("fetched_accuracy"), F.avg(F.when(judged, F.col("adoption"))).alias("adoption"),
    )
    groups = rows.where(judged).groupBy("entry_id", F.lower(F.trim(F.coalesce("qid", F.lit("")))).alias("q")).agg(F.avg(F.col("correct").cast("double")).alias("a"))
    weighted = groups.agg(F.count("*").alias("n_groups"), F.avg("a").alias("group_accuracy"), F.count_if(F.col("a") == 1).alias("groups_right"), F.count_if(F.col("a") == 0).alias("groups_wrong"))
    return flat.crossJoin(weighted)  # one row each


def judge_views(rows: DataFrame) -> DataFrame:
    """view, key, n, correct of the same rows, with arm, route and matched_by: by arm (judged turns), by route (what was
    fetched), by way of matching, and by the reason why a turn is not judged."""
    judged = F.col("matched") & F.col("answered")
    reason = F.when(~F.col("matched"), "no_truth").when(~F.col("answered"), "no_answer")
    view = lambda name, key, ok: F.struct(F.lit(name).alias("view"), key.alias("key"), ok.cast("int").alias("ok"))
    named = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    views = F.array(
        F.when(judged, view("arm", named("arm", "unknown"), F.col("correct"))),
        F.when(F.col("matched") & F.col("fetched_correct").isNotNull(), view("route", named("route", "none"), F.col("fetched_correct"))),
        view("matched_by", named("matched_by", "none"), F.lit(None)),
        F.when(reason.isNotNull(), view("reason", reason, F.lit(None))),
    )
    each = rows.select(F.explode(views).alias("v")).where("v is not null")
    return each.groupBy("v.view", "v.key").agg(F.count("*").alias("n"), F.sum("v.ok").alias("correct"))


def threshold_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, matches: distinct questions (qid, score) that reach each threshold, in one pass."""
    best = scored.groupBy("qid").agg(F.max("score").alias("score"))
    level = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    return best.select(level, "score").groupBy("threshold").agg(F.count_if(F.col("score") >= F.col("threshold")).alias("matches"))


def _lookup(value: Column, table: dict[str, float], other: float) -> Column:
    out = F.when(value.isNull(), other)
    for word, weight in table.items():
        out = out.when(value == word, weight)
    return out.otherwise(other)


def evidence_score(facts: DataFrame, checks: DataFrame, threshold: float = 0.6) -> DataFrame:
    """rule, score, gate, level of facts (rule, status, confidence, source_type, quote, locator, required) and checks.

    0.45 coverage + 0.30 confidence times source over present facts + 0.15 share with quote and locator + 0.10 mean
    of the checks (rule, verdict; 0.6 without any).  A missing status is present, a missing ``required`` is true, and
    a required fact that is unavailable makes the rule insufficient.  Whatever is insufficient has level low.  A rule
    with checks alone scores 0 for its facts.
    """
    status = F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("present"))
    word = F.coalesce(F.nullif(F.trim(F.lower(F.col("confidence"))), F.lit("")), F.lit("medium"))
    number = word.try_cast("double")
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, _lookup(word, CONFIDENCE_WORD, UNKNOWN_CONFIDENCE))))
    source = F.trim(F.lower(F.col("source_type")))
    for alias, name in SOURCE_ALIAS.items():
        source = F.when(F.trim(F.lower(F.col("source_type"))) == alias, name).otherwise(source)
    told = [F.trim(F.coalesce(c, F.lit(""))) != "" for c in ("quote", "locator")]
    per_rule = facts.groupBy("rule").agg(
        F.avg(_lookup(status, STATUS_SCORE, UNKNOWN_STATUS)).alias("coverage"),
        F.avg(F.when(status == "present", confidence * _lookup(source, SOURCE_WEIGHT, UNKNOWN_SOURCE))).alias("trust"),
        F.avg((told[0] & told[1]).cast("double")).alias("traced"),
        F.max((F.coalesce("required", F.lit(True)) & (status == "unavailable")).cast("int")).alias("blocked"),
    )
    checked = checks.groupBy("rule").agg(F.avg(_lookup(F.col("verdict"), CHECK_SCORE, UNKNOWN_CHECK)).alias("checked"))
    parts = [F.coalesce(name, F.lit(other)) for name, other in (("coverage", 0.0), ("trust", 0.0), ("traced", 0.0), ("checked", UNCHECKED))]
    score = 0.45 * parts[0] + 0.30 * parts[1] + 0.15 * parts[2] + 0.10 * parts[3]
    scored = per_rule.join(checked, "rule", "full_outer").withColumn("score", F.round(score, 6))  # sums must not miss a threshold by rounding
    failed = (F.coalesce("blocked", F.lit(0)) == 1) | (F.col("score") < threshold)
    level = F.when(failed, "low").when(F.col("score") >= HIGH_LEVEL, "high").otherwise("medium")
    return scored.select("rule", "score", F.when(failed, "insufficient").otherwise("ok").alias("gate"), level.alias("level"))


def rule_run_summary(items: DataFrame, rules: DataFrame, verdicts: list[str], veto: tuple[str, str], threshold: float = 0.6, high: float = 0.8) -> DataFrame:
    """Per rule (rules: rule, applies_when) the count of every verdict, zeros included, items, traceable, vetoes, gate, level.

    An item (rule, verdict, quote, doc_loc, severity) is traceable with both a quote and a place; a veto has the
    verdict and severity of ``veto``.  A rule with items passes by its traceable share; one without is
    ``not_applicable`` if it applies under a condition, else ``not_triggered``.
    """
    counts = [F.count_if(F.trim("verdict") == v).alias(f"n_{v}") for v in verdicts]
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    traced = ~blank("quote") & ~blank("doc_loc")
    marked = items.withColumn("item", F.lit(1))
    grouped = rules.join(marked, "rule", "left").groupBy("rule").agg(
        F.max("applies_when").alias("applies_when"), *counts, F.count("item").alias("n"), (F.count_if(traced) / F.nullif(F.count("item"), F.lit(0))).alias("traceable"),
        F.count_if((F.trim("verdict") == veto[0]) & (F.trim("severity") == veto[1])).alias("vetoes"),
    )
    rate = F.coalesce("traceable", F.lit(0.0))
    conditional = ~F.trim(F.coalesce("applies_when", F.lit(""))).isin("", "always")
    gate = F.when(F.col("n") == 0, F.when(conditional, "not_applicable").otherwise("not_triggered")).when(rate >= threshold, "ok").otherwise("insufficient")
    level = F.when(F.col("n") == 0, "n/a").when(rate >= high, "high").when(rate >= threshold, "medium").otherwise("low")
    return grouped.withColumns({"traceable": rate, "gate": gate, "level": level}).drop("applies_when")


def io_totals(trips: DataFrame) -> DataFrame:
    """Per call and kind of store, and over all kinds (``io``): trips, ms, errors, rows, hit, empty, unknown, empty_rate, ok.

    trips: call, kind, ms, ok, rows (null where it can't be told).  A trip without rows is a failure; one that can't be
    told is neither, so the empty rate is over known ones only.
    """
    known, rows = F.col("rows").isNotNull(), F.col("rows")
    each = trips.withColumn("of", F.explode(F.array(F.col("kind"), F.lit("io"))))
    out = each.groupBy("call", F.col("of").alias("kind")).agg(
        F.count("*").alias("trips"), F.round(F.sum("ms"), 1).alias("ms"), F.count_if(~F.col("ok")).alias("errors"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.count_if(rows > 0).alias("hit"), F.count_if(rows == 0).alias("empty"), F.count_if(~known).alias("unknown"),
    )
    rate = F.when(F.col("hit") + F.col("empty") > 0, F.round(F.col("empty") / (F.col("hit") + F.col("empty")), 4))
    return out.withColumns({"empty_rate": rate, "ok": F.col("hit") > 0})


def top_callers(trips: DataFrame, n: int = 6) -> DataFrame:
    """Per kind of store the ``n`` callers (who) with most trips, ties by name."""
    made = trips.where(F.coalesce("who", F.lit("")) != "").groupBy("kind", "who").agg(F.count("*").alias("trips"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("trips"), "who"))
    return made.withColumn("place", place).where(F.col("place") <= n)


def coverage_matrix(calls: DataFrame) -> DataFrame:
    """tool, unique cases by canonical arguments, and calls by shape as columns."""
    return calls.groupBy("tool").agg(
        F.count_distinct("qid", "hits").alias("cases"),
        F.count_if(F.col("hits") == 0).alias("silent"),
        F.count_if((F.col("hits") > 0) & ~F.col("degraded")).alias("ok"),
        F.count_if((F.col("hits") > 0) & F.col("degraded")).alias("ok_degraded"),
    )


def conformance(calls: DataFrame, stages: dict[str, list[str]], retired: list[str], others: list[str] | None = None) -> DataFrame:
    """Per session: intent, retired and out_of_scope calls, coverage, monotone, fitness, passed.

    Intent is one minus the share of retired calls and of calls of no tool in ``stages`` or ``others``.  Fitness is
    the share of stages met, times 0.8 when the first hits, in the order in which they were met, do not ascend.  A
    session passes with intent 0.9, fitness 0.8 and no retired call.
    """
    order = Window.partitionBy("session").orderBy("ts", "call_id")
    seq = calls.withColumn("seq", F.row_number().over(order))
    firsts = F.array(*[F.struct(F.min(F.when(F.col("tool").isin(tools), F.col("seq"))).alias("seq"), F.lit(n).alias("stage")) for n, tools in enumerate(stages.values())])
    gone = F.col("tool").isin(retired)
    known = F.col("tool").isin([t for tools in stages.values() for t in tools] + (others or []))
    per = seq.groupBy("session").agg(
        F.count("*").alias("n"), F.count_if(gone).alias("retired"), F.count_if(~gone & ~F.coalesce(known, F.lit(False))).alias("out_of_scope"), firsts.alias("firsts")
    )
    met = F.transform(F.array_sort(F.filter("firsts", lambda f: f["seq"].isNotNull())), lambda f: f["seq"])
    intent = F.round(1 - (F.col("retired") + F.col("out_of_scope")) / F.col("n"), 4)
    coverage = F.round(F.size(met) / len(stages), 4)
    monotone = met == F.array_sort(met)
    fitness = F.when(monotone, coverage).otherwise(F.round(coverage * 0.8, 4))
    return per.select(
        "session", "retired", "out_of_scope", intent.alias("intent"), coverage.alias("coverage"), monotone.alias("monotone"), fitness.alias("fitness"),
        ((intent >= 0.9) & (fitness >= 0.8) & (F.col("retired") == 0)).alias("passed"),
    )


def strict_best(scored: DataFrame, key: str, item: str) -> DataFrame:
    """Per key the best item, only if no other has the same score."""
    rank = F.rank().over(Window.partitionBy(key).orderBy(F.desc("score")))
    best = scored.withColumn("place", rank).where("place = 1")
    alone = F.count("*").over(Window.partitionBy(key)) == 1
    return best.withColumn("alone", alone).where("alone").select(key, item, "score")


def link_nearest(left: DataFrame, right: DataFrame, tolerance: int, threshold: float = 0.62) -> DataFrame:
    """Turns (left_id, session, key, core, ts) beside the calls (right_id, session, key, core, ts, arm, hits, ms,
    queries, degraded) they led to: left_id, right_id, linked, arm, calls, hits, ms, queries, degraded.

    All calls of the session with the turn's key; else the session's nearest call within ``tolerance`` seconds; else
    the calls of the session's key whose question (its first call's) is most alike by bigram Jaccard, if that reaches
    the threshold.  Ties go to the smaller right_id, which also names the arm; the other figures are of all calls
    found.  Time is cut into slices, so that a session is joined by parts.
    """
    slice_of = lambda ts: F.floor(F.unix_micros(ts) / (tolerance * 1_000_000))
    l = settled(left.select("left_id", "session", "key", "core", F.col("ts").cast("timestamp").alias("ts")), "turns")  # noqa: E741
    r = settled(right.select("right_id", "session", "key", "core", F.col("ts").cast("timestamp").alias("t"), "arm", "hits", "ms", "queries", "degraded"), "calls")
    groups = r.groupBy("session", "key").agg(
        F.min("right_id").alias("right_id"), F.min_by("arm", "right_id").alias("arm"), F.min_by("core", "right_id").alias("core"), F.count("*").alias("calls"),
        F.max("hits").alias("hits"), F.sum("ms").alias("ms"), F.sum("queries").alias("queries"), F.max("degraded").alias("degraded"),
    )
    groups = settled(groups, "call-groups")
    found = ["right_id", "arm", "calls", "hits", "ms", "queries", "degraded"]
    exact = l.join(groups.drop("core"), ["session", "key"]).select("left_id", F.lit("exact").alias("linked"), *found)
    rest = settled(l.join(groups.select("session", "key"), ["session", "key"], "left_anti"), "unlinked")
    gap = F.abs(F.unix_micros("ts") - F.unix_micros("t"))
    near = rest.withColumn("slice", F.explode(F.array(*[slice_of(F.col("ts")) + i for i in (-1, 0, 1)]))).drop("key", "core")
    near = near.join(r.drop("key", "core").withColumn("slice", slice_of(F.col("t"))), ["session", "slice"]).where(gap <= tolerance * 1_000_000)
    own = ["right_id", "arm", F.lit(1).cast("long").alias("calls"), "hits", "ms", "queries", "degraded"]
    near = settled(near.groupBy("left_id").agg(F.min(F.struct(gap.alias("gap"), *own)).alias("n")).select("left_id", F.lit("near").alias("linked"), *[F.col(f"n.{c}") for c in found]), "near")
    lone = rest.join(near.select("left_id"), "left_id", "left_anti")
    # questions repeat: each distinct one is compared once, whatever sessions ask it
    asked = lone.where("core != ''").select("core").distinct().withColumn("kind", F.lit(0))
    told = asked.unionByName(groups.where("core != ''").select("core").distinct().withColumn("kind", F.lit(1)))
    told = settled(told.withColumn("id", F.monotonically_increasing_id()), "questions")
    sets = told.select("id", "kind", gram_codes(F.col("core"), 2).alias("grams")).withColumn("n", F.size("grams"))
    alike = jaccard_pairs(settled(sets, "question-sets"), threshold, across=True)
    ask, answer = [F.when(F.col("kind") == n, F.col("id")).otherwise(F.col("id_b")) for n in (0, 1)]
    pairs = alike.select(ask.alias("ask"), answer.alias("answer"), "score")
    named = lambda n, core, key: told.where(F.col("kind") == n).select(F.col("core").alias(core), F.col("id").alias(key))
    pairs = settled(pairs.join(named(0, "core", "ask"), "ask").join(named(1, "core_b", "answer"), "answer").select("core", "core_b", "score"), "question-pairs")
    met = lone.select("left_id", "session", "core").join(pairs, "core").join(groups.select("session", F.col("core").alias("core_b"), "right_id"), ["session", "core_b"])
    best = met.groupBy("left_id").agg(F.min(F.struct(-F.col("score"), "right_id")).alias("b")).select("left_id", F.col("b.right_id").alias("right_id"))
    similar = best.join(groups, "right_id").select("left_id", F.lit("similar").alias("linked"), *found)
    linked = exact.unionByName(near).unionByName(similar)
    return l.select("left_id").join(linked, "left_id", "left").fillna({"linked": "none"})
