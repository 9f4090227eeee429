"""Queries over sessions, running values and order-dependent groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import windows as W
from lorekeep.plans.fixtures import CALLS, calls, table
from lorekeep.plans.registry import query


def _stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


LINES = r"""lines AS (SELECT doc_id AS doc, i - 1 AS place, s[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) u(i))"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("place", "text")).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {CALLS}, c AS (SELECT call_id, session % 20 AS "user", CASE WHEN call_id % 31 = 0 THEN 'L' || call_id % 3 END AS label, ts FROM calls),
o AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER w > 3600000000 AS wide FROM c WINDOW w AS (PARTITION BY "user", label IS NULL ORDER BY ts, call_id))
SELECT call_id, "user", coalesce(label, 's' || sum(coalesce(wide, true)::INT) OVER (PARTITION BY "user", label IS NULL ORDER BY ts, call_id)) AS part FROM o""")
def w1_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("call_id") % 31 == 0, F.concat(F.lit("L"), F.col("call_id") % 3))
    c = _stamped(spark, sf_dir).select("call_id", (F.col("session") % 20).alias("user"), label.alias("label"), "ts")
    return W.sessionize(c, 3600).select("call_id", "user", "part")


@query(f"""WITH {CALLS}, r AS (SELECT session AS request, call_id AS round, ts, CASE WHEN call_id % 4 = 0 THEN 0 ELSE ms END AS actual FROM calls)
SELECT request, round, actual, CASE WHEN actual <> 0 THEN actual - last_value(nullif(actual, 0) IGNORE NULLS) OVER (PARTITION BY request ORDER BY ts, round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS delta FROM r""")
def w2_prompt_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = F.when(F.col("call_id") % 4 == 0, F.lit(0).cast("long")).otherwise(F.col("ms"))
    r = _stamped(spark, sf_dir).select(F.col("session").alias("request"), F.col("call_id").alias("round"), "ts", actual.alias("actual"))
    return W.prompt_delta(r).select("request", "round", "actual", "delta")


@query(f"""WITH {CALLS} SELECT session * 12 + qid AS key, call_id AS record_id, tool AS status FROM calls QUALIFY row_number() OVER (PARTITION BY session * 12 + qid ORDER BY ts DESC, call_id DESC) = 1 AND tool = 'purchase'""")
def w3_latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _stamped(spark, sf_dir).select((F.col("session") * 12 + F.col("qid")).alias("key"), F.col("call_id").alias("record_id"), F.col("tool").alias("status"), "ts")
    return W.latest_per_key(r, "key", "purchase").select("key", "record_id", "status")


@query(f"""WITH {LINES} SELECT doc, place, text FROM (SELECT *, lag(text) OVER (PARTITION BY doc ORDER BY place) AS b FROM lines) WHERE NOT (b IS NOT NULL AND b = text AND length(text) <= 500)""")
def w5_drop_adjacent_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.drop_adjacent_duplicates(_lines(spark, sf_dir))


HEADED = f"""{LINES}, h AS (SELECT doc, place, CASE WHEN length(text) < 30 THEN text WHEN place % 7 = 3 THEN 'Table ' || place ELSE '' END AS heading FROM lines)"""


@query(rf"""WITH {HEADED}, c AS (SELECT *, last_value(nullif(heading, '') IGNORE NULLS) OVER w AS last,
  last_value(CASE WHEN NOT regexp_matches(heading, '^(Table|Tab\.|表)|\|') THEN nullif(heading, '') END IGNORE NULLS) OVER w AS plain FROM h WINDOW w AS (PARTITION BY doc ORDER BY place))
SELECT doc, place, CASE WHEN regexp_matches(last, '^(Table|Tab\.|表)|\|') THEN plain ELSE last END AS section FROM c""")
def w6_carry_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    heading = F.when(F.length("text") < 30, F.col("text")).when(F.col("place") % 7 == 3, F.concat(F.lit("Table "), "place")).otherwise("")
    return W.carry_heading(_lines(spark, sf_dir).withColumn("heading", heading)).select("doc", "place", "section")


@query(f"""WITH {CALLS} SELECT session * 12 + qid AS turn, tool, epoch_us(ts) AS ts FROM calls WHERE tool IN ('view', 'click') QUALIFY row_number() OVER (PARTITION BY session * 12 + qid ORDER BY ts, call_id) = 1""")
def w7_first_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _stamped(spark, sf_dir).withColumn("turn", F.col("session") * 12 + F.col("qid"))
    return W.first_action(c, ["view", "click"]).withColumn("ts", F.unix_micros("ts"))


@query(f"""WITH {CALLS}, l AS (SELECT call_id AS left_id, session AS key, ts FROM calls WHERE call_id % 2 = 0), r AS (SELECT call_id AS right_id, session AS key, ts FROM calls WHERE call_id % 2 = 1),
f AS (SELECT key, arg_min(right_id, ts) AS right_id FROM r GROUP BY key)
SELECT left_id, coalesce(r.right_id, f.right_id) AS right_id FROM l ASOF LEFT JOIN r ON l.key = r.key AND l.ts >= r.ts LEFT JOIN f ON f.key = l.key""")
def j10_asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _stamped(spark, sf_dir).withColumnRenamed("session", "key")
    return W.asof_backward(c.where("call_id % 2 = 0").withColumnRenamed("call_id", "left_id"), c.where("call_id % 2 = 1").withColumnRenamed("call_id", "right_id"))


@query(f"""WITH {CALLS}, t AS (SELECT session, call_id AS turn, 'a' || call_id % 400 // 200 AS agent, CASE WHEN call_id % 3 > 0 THEN 'r' || call_id % 900 // 450 END AS role, CASE WHEN call_id % 5 = 0 THEN 'd' || qid % 2 END AS document, tool AS intent FROM calls),
p AS (SELECT *, row_number() OVER o AS n, last_value(agent IGNORE NULLS) OVER b AS pa, last_value(role IGNORE NULLS) OVER b AS pr, last_value(document IGNORE NULLS) OVER b AS pd, last_value(intent IGNORE NULLS) OVER b AS pi
  FROM t WINDOW o AS (PARTITION BY session ORDER BY turn), b AS (PARTITION BY session ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT session, turn, CASE WHEN n = 1 THEN 'start' WHEN agent <> pa THEN 'agent' WHEN role <> pr THEN 'role' WHEN document <> pd THEN 'document' WHEN intent <> pi THEN 'confirm' ELSE 'reuse' END AS reason FROM p)
SELECT session, turn, reason, (sum((reason IN ('start', 'agent', 'role', 'document'))::INT) OVER (PARTITION BY session ORDER BY turn))::BIGINT AS part FROM m""")
def w10_session_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("call_id")
    t = calls(spark, sf_dir).select("session", i.alias("turn"), F.concat(F.lit("a"), F.floor(i % 400 / 200)).alias("agent"),
        F.when(i % 3 > 0, F.concat(F.lit("r"), F.floor(i % 900 / 450))).alias("role"), F.when(i % 5 == 0, F.concat(F.lit("d"), F.col("qid") % 2)).alias("document"), F.col("tool").alias("intent"))
    return W.session_parts(t).select("session", "turn", "reason", "part")


@query(f"""WITH RECURSIVE {LINES}, g AS (SELECT doc, place // 4 AS k, min(place) AS place, sum(length(text))::BIGINT AS chars FROM lines GROUP BY ALL), o AS (SELECT *, floor(chars / 1.6) + 1 > 300 AS over FROM g),
x AS (SELECT doc, doc * 100000 + k AS unit, k AS a, 0 AS b, chars FROM o WHERE NOT over UNION ALL SELECT l.doc, -(l.doc * 100000 + l.place), k, l.place, length(text) + CASE WHEN l.place = o.place THEN 20 ELSE 0 END FROM o JOIN lines l ON l.doc = o.doc AND l.place // 4 = k WHERE over),
u AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY a, b) AS n FROM x),
f AS (SELECT doc, unit, n, 0::BIGINT AS batch, chars AS used FROM u WHERE n = 1
  UNION ALL SELECT u.doc, u.unit, u.n, CASE WHEN (f.used + u.chars) / 1.6 > 300 THEN f.batch + 1 ELSE f.batch END, CASE WHEN (f.used + u.chars) / 1.6 > 300 THEN u.chars ELSE f.used + u.chars END FROM f JOIN u ON u.doc = f.doc AND u.n = f.n + 1)
SELECT doc, unit, batch FROM f""")
def w11_pack_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).select("doc", "place", F.length("text").alias("chars")).withColumn("k", F.floor(F.col("place") / 4))
    unit = F.col("doc") * 100000 + F.col("k")
    units = lines.groupBy("doc", "k").agg(F.sum("chars").alias("chars")).select("doc", unit.alias("unit"), F.col("k").alias("place"), "chars", (F.floor(F.col("chars") / 1.6) + 1).alias("tokens"), F.lit(20).cast("long").alias("head"))
    children = lines.select(unit.alias("unit"), (-(F.col("doc") * 100000 + F.col("place"))).alias("child"), F.col("place").alias("child_place"), F.col("chars").cast("long").alias("chars"))
    return W.pack_budget(W.split_oversized(units, children, 300), 300)


@query()
def w12_group_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").where("role = 'user'")
    qid = F.when(F.col("conv_id") % 9 == 0, F.concat(F.lit("q"), F.col("conv_id") % 90, F.lit("."), "turn")).otherwise("")
    rows = t.select((F.col("conv_id") * 100 + F.col("turn")).alias("row_id"), qid.alias("qid"), T.question_key(F.col("text")).alias("core"), F.col("turn").alias("ts"))
    return W.group_questions(rows)


@query("""SELECT doc_id AS text_id, n AS name FROM documents, unnest(['thing', 'ting', 'tion', 'ention']) t(n)
WHERE contains(replace(replace(text, 'ention', repeat(chr(1), 6)), 'thing', CASE WHEN n IN ('ting', 'tion') THEN repeat(chr(1), 5) ELSE 'thing' END), n)
  OR (n = 'ention' AND contains(text, 'ention'))""")
def j12_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return W.mentions(texts, ["thing", "ting", "tion", "ention", "th"])
