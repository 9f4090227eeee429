"""Queries over lookup telemetry, judgements and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import evaluation as E
from lorekeep.plans.fixtures import CALLS, calls, table
from lorekeep.plans.registry import query

REASON = """CASE WHEN ts < TIMESTAMP '2024-01-05' OR ts >= TIMESTAMP '2024-01-25' THEN 'out_of_range' WHEN NOT starts_with(version, 'v1') THEN 'version_mismatch'
  WHEN call_id % 13 = 0 THEN 'selftest' WHEN qid = 11 THEN 'turn_missing' WHEN tool <> 'view' THEN 'first_retrieval_other' WHEN call_id % 3 = 0 THEN 'self_report_false' END"""


@query(f"WITH {CALLS} SELECT coalesce({REASON}, 'kept') AS reason, count(*) AS rows FROM calls GROUP BY 1")
def p3_cohort_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir).withColumns({"qid": F.when(F.col("qid") != 11, F.col("qid")), "self_report": F.when(F.col("call_id") % 3 < 2, F.col("call_id") % 3 == 1)})
    since, until = F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-25").cast("timestamp")
    return E.cohort_counts(E.cohort_reasons(rows, since, until, "v1", F.col("call_id") % 13 == 0, "view"))


@query(f"WITH {CALLS} SELECT call_id, version LIKE 'v%-b1' AS glob, starts_with(version, 'v2') OR split_part(version, '-', 1) = 'v2' AS prefix FROM calls")
def p4_version_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).select("call_id", E.version_match(F.col("version"), "v*-b1").alias("glob"), E.version_match(F.col("version"), "v2").alias("prefix"))


def _summary_sql(by: str) -> str:
    return f"""WITH {CALLS}, r AS (SELECT *, split_part(version, '-', 1) AS algorithm, CASE WHEN hits = 0 THEN queries ELSE queries % 2 END AS empties, call_id % 11 = 0 AS guidance, CASE WHEN qid < 6 THEN qid % 3 END AS expected FROM calls),
g AS (SELECT {by}, session, qid, count(*) AS attempts, sum(ms)::BIGINT AS ms FROM r GROUP BY ALL), t AS (SELECT {by}, avg(attempts) AS attempts, avg((attempts <= 3)::INT) AS converged, trunc(median(ms))::BIGINT AS group_ms_median, list_sort(list(ms))[greatest(0, floor(count(*) * 0.9)::INT - 1) + 1] AS group_ms_p90 FROM g GROUP BY ALL),
f AS (SELECT {by}, count(*) AS n, count(DISTINCT qid) AS questions, avg((hits > 0)::INT) AS found_rate, avg(CASE WHEN expected > 0 THEN hits >= expected WHEN expected = 0 THEN hits = 0 END::INT) AS case_ok_rate, count(expected) AS decided, avg(guidance::INT) AS guidance_rate, sum(ms)::BIGINT AS ms,
  count(*) FILTER (has_io) AS io_n, (sum(queries) FILTER (has_io))::BIGINT AS queries, (sum(empties) FILTER (has_io))::BIGINT AS empty_queries, (sum(queries - empties) FILTER (has_io))::BIGINT AS hit_queries, sum(empties) FILTER (has_io) / sum(queries) FILTER (has_io) AS empty_rate,
  count(*) FILTER (has_io AND degraded) / count(*) FILTER (has_io) AS degraded_rate, count(*) FILTER (has_io AND hits > 0) / count(*) FILTER (has_io) AS ok_rate, count(*) FILTER (has_io AND hits > 0 AND NOT degraded) / count(*) FILTER (has_io) AS hit_plain_rate,
  count(*) FILTER (has_io AND hits > 0 AND degraded) / count(*) FILTER (has_io) AS hit_degraded_rate, trunc(median(ms))::BIGINT AS ms_median, list_sort(list(ms))[greatest(0, floor(count(*) * 0.9)::INT - 1) + 1] AS ms_p90, trunc(median(queries) FILTER (has_io))::BIGINT AS queries_median FROM r GROUP BY ALL)
SELECT * FROM f JOIN t USING ({by})"""


def _told_calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = calls(spark, sf_dir)
    empty = F.when(F.col("hits") == 0, F.col("queries")).otherwise(F.col("queries") % 2)
    rows = c.withColumns({"empty_queries": empty, "hit_queries": F.col("queries") - empty, "guidance": F.col("call_id") % 11 == 0})
    expects = spark.range(6).select(F.col("id").cast("int").alias("qid"), (F.col("id") % 3).alias("expected"))
    return rows, expects


@query(_summary_sql("arm"))
def a6_arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.arm_summary(*_told_calls(spark, sf_dir))


@query(f"""WITH {CALLS} SELECT tool, count(*) FILTER (arm = 'hint' AND hits > 0) AS hint_solved, count(*) FILTER (arm = 'hint') AS hint_total,
  count(*) FILTER (arm = 'plain' AND hits > 0) AS plain_solved, count(*) FILTER (arm = 'plain') AS plain_total FROM calls GROUP BY tool""")
def a7_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.by_category(calls(spark, sf_dir), "tool")


@query(_summary_sql("algorithm, arm"))
def a8_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.by_version(*_told_calls(spark, sf_dir))


@query(f"""WITH {CALLS} SELECT qid, array_to_string(list_sort(list(DISTINCT tool)), ',') AS shapes, count(*) FILTER (arm = 'hint') AS hint_rounds, count(*) FILTER (arm <> 'hint') AS plain_rounds,
  coalesce(sum(hits) FILTER (arm = 'hint'), 0)::BIGINT AS hint_hits, coalesce(sum(queries) FILTER (arm = 'hint'), 0)::BIGINT AS hint_queries,
  count(*) FILTER (arm = 'hint' AND hits = 0) AS hint_empty, coalesce(sum(ms) FILTER (arm = 'hint'), 0)::BIGINT AS hint_ms FROM calls GROUP BY qid""")
def a9_by_question_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.by_question_group(calls(spark, sf_dir))


PAIRS = f"""{CALLS}, pairs AS (SELECT session, qid, CASE WHEN count(DISTINCT arm) > 1 THEN 'both' ELSE any_value(arm) END AS seen_by FROM calls GROUP BY ALL)"""


@query(f"""WITH {CALLS}, c AS (SELECT * FROM calls WHERE arm = 'hint' OR session % 3 > 0), g AS (SELECT bool_or(arm = 'hint') AS h, bool_or(arm = 'plain') AS p FROM c GROUP BY session, qid)
SELECT count(*) FILTER (h) AS hint_groups, count(*) FILTER (p) AS plain_groups, count(*) FILTER (h AND p) AS paired, count(*) FILTER (h AND NOT p) AS only_hint, count(*) FILTER (p AND NOT h) AS only_plain, '' AS arm_missing, count(*) FILTER (h AND p) > 0 AS comparable FROM g""")
def a10_pairing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pairing_summary(calls(spark, sf_dir).where("arm = 'hint' or session % 3 > 0"))


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def a10_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pairing(calls(spark, sf_dir))


@query(f"WITH {PAIRS} SELECT call_id, session, qid, arm FROM calls SEMI JOIN (SELECT * FROM pairs WHERE seen_by = 'both') USING (session, qid)")
def a10_paired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.paired_rows(calls(spark, sf_dir)).select("call_id", "session", "qid", "arm")


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: parts got, expected, forbidden, and groups of which any will do."""
    lines = table(spark, sf_dir, "lineitem").withColumn("x", F.col("l_partkey") % 40)
    own = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("x"))))
    n = F.col("l_linenumber")
    sets = lines.groupBy("l_orderkey").agg(own(n <= 4).alias("got"), own((n % 2 == 0) & (F.col("x") >= 10)).alias("expected"), own(n == 7).alias("forbidden"))
    key = F.col("l_orderkey") % 9
    return sets.withColumn("any_of", F.array(F.array(key, key + 1), F.array(key + 2)))


SETS = """sets AS (SELECT l_orderkey, list_sort(coalesce(list(DISTINCT x) FILTER (n <= 4), [])) AS got,
  list_sort(coalesce(list(DISTINCT x) FILTER (n % 2 = 0 AND x >= 10), [])) AS expected, coalesce(list(DISTINCT x) FILTER (n = 7), []) AS forbidden,
  l_orderkey % 9 AS k FROM (SELECT *, l_partkey % 40 AS x, l_linenumber AS n FROM lineitem) GROUP BY l_orderkey),
gone AS (SELECT *, CASE WHEN list_has_any(got, [k, k + 1]) THEN [k, k + 1] ELSE [] END || CASE WHEN list_has_any(got, [k + 2]) THEN [k + 2] ELSE [] END AS cleared FROM sets),
parts AS (SELECT *, len(list_filter(expected, lambda e: NOT list_contains(got, e) AND NOT list_contains(cleared, e))) AS m,
  len(list_filter(got, lambda e: NOT list_contains(expected, e))) AS x, len(list_filter(got, lambda e: list_contains(expected, e))) AS raw,
  len(list_filter(got, lambda e: list_contains(forbidden, e))) AS bad FROM gone),
scored AS (SELECT *, CASE WHEN len(got) = 0 THEN 0 ELSE raw / len(got) END AS precision,
  CASE WHEN len(expected) = 0 THEN 0 ELSE (len(expected) - m) / len(expected) END AS recall FROM parts)"""


@query(f"""WITH {SETS} SELECT l_orderkey, m::INTEGER AS n_missing, x::INTEGER AS n_extra, bad::INTEGER AS n_forbidden, precision::DOUBLE AS precision, recall::DOUBLE AS recall,
  CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1, m + x + bad = 0 AS strict FROM scored""")
def a11_compare_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.compare_sets(*(F.col(c) for c in ("got", "expected", "forbidden", "any_of")))
    return _sets(spark, sf_dir).select("l_orderkey", *[c.alias(name) for name, c in found.items()])


JUDGED = f"""{SETS}, j AS (SELECT l_orderkey % 4 <> 0 AS matched, l_orderkey % 5 <> 0 AS answered, recall >= 0.5 AS correct, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1,
  CASE WHEN l_orderkey % 3 > 0 THEN raw > 0 END AS fetched_correct, CASE WHEN l_orderkey % 3 > 0 THEN precision END AS adoption, l_orderkey % 30 AS entry_id, CASE WHEN l_orderkey % 2 = 0 THEN '' ELSE 'Q' || l_orderkey % 7 END AS qid,
  ['hint', 'plain', ''][1 + l_orderkey % 3] AS arm, ['', 'graph'][1 + l_orderkey % 2] AS route, CASE WHEN l_orderkey % 4 = 0 THEN '' ELSE ['qid', 'anchor', 'sim'][1 + l_orderkey % 3] END AS matched_by FROM scored)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.compare_sets(*(F.col(c) for c in ("got", "expected", "forbidden", "any_of")))
    key = F.col("l_orderkey")
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (key % n).cast("int"))
    return _sets(spark, sf_dir).select(
        (key % 4 != 0).alias("matched"), (key % 5 != 0).alias("answered"), (found["recall"] >= 0.5).alias("correct"), found["f1"].alias("f1"), F.when(key % 3 > 0, found["precision"] > 0).alias("fetched_correct"),
        F.when(key % 3 > 0, found["precision"]).alias("adoption"), (key % 30).alias("entry_id"), F.when(key % 2 == 0, "").otherwise(F.concat(F.lit("Q"), key % 7)).alias("qid"), pick(["hint", "plain", ""], 3).alias("arm"),
        pick(["", "graph"], 2).alias("route"), F.when(key % 4 == 0, "").otherwise(pick(["qid", "anchor", "sim"], 3)).alias("matched_by"))


@query(f"""WITH {JUDGED}, g AS (SELECT avg(correct::INT) AS a FROM j WHERE matched AND answered GROUP BY entry_id, lower(qid)),
w AS (SELECT count(*) AS n_groups, avg(a) AS group_accuracy, count(*) FILTER (a = 1) AS groups_right, count(*) FILTER (a = 0) AS groups_wrong FROM g)
SELECT count(*) AS n_total, count(*) FILTER (matched) AS n_matched, count(*) FILTER (matched AND answered) AS n_judged, avg((matched AND answered)::INT) AS coverage, avg(correct::INT) FILTER (matched AND answered) AS accuracy, avg(f1) FILTER (matched AND answered) AS mean_f1,
  count(fetched_correct) FILTER (matched) AS n_fetched, avg(fetched_correct::INT) FILTER (matched) AS fetched_accuracy, avg(adoption) FILTER (matched AND answered) AS adoption, any_value(w.n_groups) AS n_groups, any_value(w.group_accuracy) AS group_accuracy, any_value(w.groups_right) AS groups_right, any_value(w.groups_wrong) AS groups_wrong FROM j, w""")
def a12_judge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.judge_stats(_judged(spark, sf_dir))


@query(f"""WITH {JUDGED} SELECT 'arm' AS view, CASE arm WHEN '' THEN 'unknown' ELSE arm END AS key, count(*) AS n, sum(correct::INT)::BIGINT AS correct FROM j WHERE matched AND answered GROUP BY ALL
UNION ALL SELECT 'route', CASE route WHEN '' THEN 'none' ELSE route END, count(*), sum(fetched_correct::INT)::BIGINT FROM j WHERE matched AND fetched_correct IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'matched_by', CASE matched_by WHEN '' THEN 'none' ELSE matched_by END, count(*), NULL FROM j GROUP BY ALL
UNION ALL SELECT 'reason', CASE WHEN matched THEN 'no_answer' ELSE 'no_truth' END, count(*), NULL FROM j WHERE NOT (matched AND answered) GROUP BY ALL""")
def a12_judge_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.judge_views(_judged(spark, sf_dir))


@query(f"""WITH {CALLS}, b AS (SELECT session * 100 + qid AS qid, max(hits / 6) AS score FROM calls GROUP BY ALL)
SELECT threshold::DOUBLE AS threshold, count(*) FILTER (score >= threshold) AS matches FROM b, unnest([0.2, 0.4, 0.5, 0.6, 0.8, 0.95]::DOUBLE[]) t(threshold) GROUP BY 1""")
def a13_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = calls(spark, sf_dir).select((F.col("session") * 100 + F.col("qid")).alias("qid"), (F.col("hits") / 6).alias("score"))
    return E.threshold_sweep(scored, [0.2, 0.4, 0.5, 0.6, 0.8, 0.95])


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    status = F.when(F.col("l_returnflag") == "A", "present").when(F.col("l_returnflag") == "N", "absent_verified").when(n == 7, "guessed").when(n % 2 == 0, "unavailable")
    confidence = F.when(n % 3 == 0, F.lit(" High")).when(n == 5, F.lit("sure")).when(n == 4, F.lit(None)).otherwise((F.col("l_discount") * 20).cast("string"))
    source = F.when(F.col("l_linestatus") == "F", "document").when(n == 1, "doc_image").when(n == 2, "kb").otherwise("rumour")
    facts = lines.select(F.col("l_orderkey").alias("rule"), status.alias("status"), confidence.alias("confidence"), source.alias("source_type"),
        F.when(F.col("l_tax") > 0, "q").alias("quote"), F.when(F.col("l_tax") > 0.02, "p1").otherwise(" ").alias("locator"), F.when(n != 6, n == 2).alias("required"))
    verdict = F.when(F.col("l_quantity") > 20, "supported").when(F.col("l_quantity") > 10, "not_supported").otherwise("unclear")
    return facts, lines.where("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("rule"), verdict.alias("verdict"))


@query("""WITH l AS (SELECT *, l_linenumber AS n, CASE WHEN l_returnflag = 'A' THEN 'present' WHEN l_returnflag = 'N' THEN 'absent_verified' WHEN l_linenumber = 7 THEN 'guessed' WHEN l_linenumber % 2 = 0 THEN 'unavailable' ELSE 'present' END AS status,
  CASE WHEN l_linenumber % 3 = 0 THEN 1.0 WHEN l_linenumber IN (4, 5) THEN 0.7 ELSE greatest(0, least(1, l_discount * 20)) END AS conf FROM lineitem),
f AS (SELECT l_orderkey AS rule, avg(CASE status WHEN 'unavailable' THEN 0.2 WHEN 'guessed' THEN 0.5 ELSE 1 END) AS coverage,
  avg(conf * CASE WHEN l_linestatus = 'F' THEN 0.9 WHEN n = 1 THEN 0.85 WHEN n = 2 THEN 0.95 ELSE 0.5 END) FILTER (status = 'present') AS trust,
  avg((l_tax > 0.02)::INT) AS traced, max((n IN (2, 6) AND status = 'unavailable')::INT) AS blocked FROM l GROUP BY 1),
c AS (SELECT l_orderkey AS rule, avg(CASE WHEN l_quantity > 20 THEN 1 WHEN l_quantity > 10 THEN 0 ELSE 0.3 END) AS checked FROM l WHERE l_orderkey % 2 = 0 GROUP BY 1),
s AS (SELECT rule, round(0.45 * coverage + 0.30 * coalesce(trust, 0) + 0.15 * traced + 0.10 * coalesce(checked, 0.6), 6) AS score, blocked FROM f LEFT JOIN c USING (rule))
SELECT rule, score, CASE WHEN blocked = 1 OR score < 0.6 THEN 'insufficient' ELSE 'ok' END AS gate,
  CASE WHEN blocked = 1 OR score < 0.6 THEN 'low' WHEN score >= 0.8 THEN 'high' ELSE 'medium' END AS level FROM s""")
def a14_evidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.evidence_score(*_facts(spark, sf_dir), 0.6)


@query("""WITH i AS (SELECT l_partkey AS rule, CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'N' THEN 'open' ELSE ' fail' END AS verdict, CASE WHEN l_tax > 0.01 THEN 'q' END AS quote, CASE WHEN l_linenumber % 5 > 0 THEN 'p' ELSE ' ' END AS doc_loc, CASE WHEN l_quantity > 40 THEN 'high' ELSE 'low' END AS severity FROM lineitem),
r AS (SELECT p_partkey AS rule, CASE WHEN p_partkey % 3 = 0 THEN 'when asked' ELSE 'always' END AS applies FROM part UNION ALL SELECT -s_suppkey - 1, CASE WHEN s_suppkey % 2 = 0 THEN 'if new' END FROM supplier),
g AS (SELECT rule, any_value(applies) AS applies, count(*) FILTER (verdict = 'pass') AS n_pass, count(*) FILTER (verdict = 'open') AS n_open, count(*) FILTER (trim(verdict) = 'fail') AS n_fail, count(verdict) AS n,
  coalesce(count(*) FILTER (quote = 'q' AND doc_loc = 'p') / nullif(count(verdict), 0), 0) AS traceable, count(*) FILTER (trim(verdict) = 'fail' AND severity = 'high') AS vetoes FROM r LEFT JOIN i USING (rule) GROUP BY rule)
SELECT * EXCLUDE (applies), CASE WHEN n = 0 AND coalesce(applies, 'always') <> 'always' THEN 'not_applicable' WHEN n = 0 THEN 'not_triggered' WHEN traceable >= 0.6 THEN 'ok' ELSE 'insufficient' END AS gate,
  CASE WHEN n = 0 THEN 'n/a' WHEN traceable >= 0.8 THEN 'high' WHEN traceable >= 0.6 THEN 'medium' ELSE 'low' END AS level FROM g""")
def a15_rule_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("l_returnflag") == "A", "pass").when(F.col("l_returnflag") == "N", "open").otherwise(" fail")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("rule"), verdict.alias("verdict"), F.when(F.col("l_tax") > 0.01, "q").alias("quote"),
        F.when(F.col("l_linenumber") % 5 > 0, "p").otherwise(" ").alias("doc_loc"), F.when(F.col("l_quantity") > 40, "high").otherwise("low").alias("severity"))
    rules = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule"), F.when(F.col("p_partkey") % 3 == 0, "when asked").otherwise("always").alias("applies_when"))
    rules = rules.unionByName(table(spark, sf_dir, "supplier").select((-F.col("s_suppkey") - 1).alias("rule"), F.when(F.col("s_suppkey") % 2 == 0, "if new").alias("applies_when")))
    return E.rule_run_summary(items, rules, ["pass", "open", "fail"], ("fail", "high"))


TRIPS = """trips AS (SELECT user_id * 100 + event_id % 20 AS call, CASE WHEN event_id % 3 = 0 THEN 'graph' ELSE 'pg' END AS kind, round(value, 1) AS ms, event_id % 13 <> 0 AS ok,
  CASE WHEN event_id % 7 > 0 THEN event_id % 4 END AS rows, CASE WHEN event_id % 10 = 0 THEN '' ELSE event_type || event_id % 6 END AS who FROM events)"""


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select((F.col("user_id") * 100 + i % 20).alias("call"), F.when(i % 3 == 0, "graph").otherwise("pg").alias("kind"), F.round("value", 1).alias("ms"), (i % 13 != 0).alias("ok"),
        F.when(i % 7 > 0, i % 4).alias("rows"), F.when(i % 10 == 0, "").otherwise(F.concat("event_type", i % 6)).alias("who"))


@query(f"""WITH {TRIPS}, e AS (SELECT * FROM trips UNION ALL SELECT call, 'io', ms, ok, rows, who FROM trips),
t AS (SELECT call, kind, count(*) AS trips, round(sum(ms), 1) AS ms, count(*) FILTER (NOT ok) AS errors, coalesce(sum(rows), 0)::BIGINT AS rows, count(*) FILTER (rows > 0) AS hit, count(*) FILTER (rows = 0) AS empty, count(*) FILTER (rows IS NULL) AS unknown FROM e GROUP BY ALL)
SELECT *, round(empty / nullif(hit + empty, 0), 4) AS empty_rate, hit > 0 AS ok FROM t""")
def a29_io_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.io_totals(_trips(spark, sf_dir))


@query(f"""WITH {TRIPS}, s AS (SELECT kind, who, count(*) AS trips FROM trips WHERE who <> '' GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY kind ORDER BY trips DESC, who)::INTEGER AS place FROM s QUALIFY place <= 6""")
def a29_top_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.top_callers(_trips(spark, sf_dir))


@query(f"""WITH {CALLS} SELECT tool, count(DISTINCT (qid, hits)) AS cases, count(*) FILTER (hits = 0) AS silent, count(*) FILTER (hits > 0 AND NOT degraded) AS ok, count(*) FILTER (hits > 0 AND degraded) AS ok_degraded FROM calls GROUP BY tool""")
def a19_coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.coverage_matrix(calls(spark, sf_dir))


@query(f"""WITH {CALLS}, s AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, call_id) AS seq FROM calls),
p AS (SELECT session, count(*) AS n, count(*) FILTER (tool = 'error') AS retired, count(*) FILTER (tool NOT IN ('error', 'signup', 'view', 'click')) AS out_of_scope,
  len([x FOR x IN [min(seq) FILTER (tool = 'signup'), min(seq) FILTER (tool IN ('view', 'click'))] IF x IS NOT NULL]) AS met FROM s GROUP BY session),
q AS (SELECT *, round(1 - (retired + out_of_scope) / n, 4) AS intent, met / 2 AS coverage FROM p)
SELECT session, retired, out_of_scope, intent, coverage, true AS monotone, coverage AS fitness, intent >= 0.9 AND coverage >= 0.8 AND retired = 0 AS passed FROM q""")
def a26_call_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.conformance(calls(spark, sf_dir), {"enter": ["signup"], "look": ["view", "click"]}, ["error"])


@query(f"""WITH {CALLS}, s AS (SELECT session, tool, sum(hits) AS score FROM calls GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY session ORDER BY score DESC) AS place FROM s)
SELECT session, any_value(tool) AS tool, any_value(score)::BIGINT AS score FROM r WHERE place = 1 GROUP BY session HAVING count(*) = 1""")
def w9_strict_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = calls(spark, sf_dir).groupBy("session", "tool").agg(F.sum("hits").alias("score"))
    return E.strict_best(scored, "session", "tool")


@query(f"""WITH {CALLS}, q AS (SELECT *, tool || '/' || qid || '/' || call_id % 40 AS key, 'find ' || tool || ' of item ' || qid || CASE WHEN call_id % 3 = 0 THEN ' or something else entirely' ELSE '' END AS core, floor(epoch_us(ts) / 1000)::BIGINT AS t FROM calls),
l AS (SELECT call_id AS left_id, session, key, core, ts FROM q WHERE call_id % 2 = 0), r AS (SELECT call_id AS right_id, * EXCLUDE (call_id) FROM q WHERE call_id % 2 = 1),
g AS (SELECT session, key, min(right_id) AS right_id, arg_min(arm, right_id) AS arm, arg_min(core, right_id) AS core, count(*) AS calls, max(hits) AS hits, sum(ms)::BIGINT AS ms, sum(queries)::BIGINT AS queries, bool_or(degraded) AS degraded FROM r GROUP BY ALL),
e AS (SELECT left_id, 'exact' AS linked, right_id, arm, calls, hits, ms, queries, degraded FROM l JOIN g USING (session, key)), u AS (SELECT * FROM l WHERE left_id NOT IN (SELECT left_id FROM e)),
n AS (SELECT left_id, 'near' AS linked, right_id, arm, 1 AS calls, hits, ms, queries, degraded FROM u JOIN r ON r.session = u.session AND abs(epoch_us(u.ts) - epoch_us(r.ts)) <= 60000000 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY abs(epoch_us(u.ts) - epoch_us(r.ts)), right_id) = 1),
b AS (SELECT *, list_distinct([substr(core, i::INT, 2) FOR i IN range(1, length(core))]) AS s FROM u WHERE left_id NOT IN (SELECT left_id FROM n)), h AS (SELECT *, list_distinct([substr(core, i::INT, 2) FOR i IN range(1, length(core))]) AS s FROM g),
x AS (SELECT left_id, h.right_id, len(list_intersect(b.s, h.s)) / len(list_distinct(b.s || h.s)) AS score FROM b JOIN h USING (session)),
m AS (SELECT left_id, 'similar' AS linked, right_id, arm, calls, hits, ms, queries, degraded FROM x JOIN g USING (right_id) WHERE score >= 0.62 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) = 1)
SELECT left_id, coalesce(linked, 'none') AS linked, right_id, arm, calls, hits, ms, queries, degraded FROM l LEFT JOIN (SELECT * FROM e UNION ALL SELECT * FROM n UNION ALL SELECT * FROM m) USING (left_id)""")
def j9_link_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, i = calls(spark, sf_dir), F.col("call_id")
    core = F.concat(F.lit("find "), "tool", F.lit(" of item "), "qid", F.when(i % 3 == 0, " or something else entirely").otherwise(""))
    c = c.withColumns({"key": F.concat_ws("/", "tool", F.col("qid").cast("string"), (i % 40).cast("string")), "core": core})
    return E.link_nearest(c.where("call_id % 2 = 0").withColumnRenamed("call_id", "left_id"), c.where("call_id % 2 = 1").withColumnRenamed("call_id", "right_id"), 60)
