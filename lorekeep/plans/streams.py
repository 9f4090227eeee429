"""Streaming queries over the events as a file stream, drained once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators.graphs import shared_folder
from lorekeep.plans.fixtures import table
from lorekeep.plans.registry import query
from lorekeep.streaming import state as Y
from lorekeep.streaming import streams as X


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of calls."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a file stream reads folders: the file is named by a pattern
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return raw.select(F.col("event_id").alias("call_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session"),
        F.col("event_type").alias("tool"), F.col("value").alias("ms"), F.col("props").alias("payload"))


def _drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """The stream's output after all its input, from a table in the shared folder."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"
    if mode == "append":
        run = stream.writeStream.format("parquet").option("path", f"{base}/out")
    else:
        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out")

        run = stream.writeStream.outputMode("complete").foreachBatch(keep)
    run.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


CALLS = "c AS (SELECT event_id AS call_id, ts, user_id AS session, event_type AS tool, value AS ms, props AS payload FROM events)"


_LABEL = "CASE WHEN call_id % 31 = 0 THEN 'L' || call_id % 3 END"


@query(f"""WITH {CALLS}, k AS (SELECT session % 3 AS session, {_LABEL} AS label, ts, call_id, ms FROM c),
o AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session ORDER BY ts) > 90000000, true) AS opens FROM k WHERE label IS NULL),
s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY session ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM o)
SELECT session::VARCHAR AS session, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS finish, count(*) AS calls, round(sum(ms), 4) AS ms
FROM s GROUP BY session, part
UNION ALL SELECT label, epoch_us(min(ts)), epoch_us(max(ts)), count(*), round(sum(ms), 4) FROM k WHERE label IS NOT NULL GROUP BY label""")
def x2_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _events(spark, sf_dir).withColumns({"session": F.col("session") % 3, "label": F.expr(_LABEL)})
    out = _drained(spark, X.sessions(calls), "complete")
    return out.select("session", F.unix_micros("start").alias("start"), F.unix_micros("finish").alias("finish"), "calls", F.round("ms", 4).alias("ms"))


def _arriving(spark: SparkSession, parts: list[DataFrame], made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that a stream gives out for good while its input arrives part by part; its state outlives each run."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"
    out = None
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        out = made(spark.readStream.schema(part.schema).parquet(f"{base}/in"))
        run = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        run.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def _call_parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The events as calls in two parts: what came in time, and what came late or after the 20th; then a call of far later."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session"),
        F.col("event_type").alias("tool"), F.col("value").alias("ms"), F.col("props").alias("payload"))
    early = (F.col("ts") < F.lit("2024-01-20").cast("timestamp")) & (F.col("call_id") % 5 != 0)
    far = spark.range(1).select((F.col("id") - 2).alias("call_id"), F.lit("2030-01-01").cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("session"), F.lit("end").alias("tool"), F.lit(0.0).alias("ms"), F.lit("").alias("payload"))
    return [e.where(early), e.where(~early), far]


@query(f"""WITH {CALLS}, p AS (SELECT *, ts < TIMESTAMP '2024-01-20' AND call_id % 5 <> 0 AS early FROM c), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM p WHERE early)
SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, CASE WHEN call_id % 2 = 0 THEN 'hint' ELSE 'plain' END AS arm, count(*) AS calls, round(sum(ms), 4) AS ms FROM p, m WHERE early OR date_trunc('day', ts) + INTERVAL 1 DAY > mark GROUP BY ALL""")
def x5_stream_arm_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _arriving(spark, _call_parts(spark, sf_dir), X.arm_metrics)  # days behind the watermark are closed: late calls of theirs are dropped
    return out.select(F.col("day").cast("date").cast("string").alias("day"), "arm", "calls", F.round("ms", 4).alias("ms"))


def _timed(spark: SparkSession, sf_dir: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``_arriving`` over two parts of the calls and a far one, with the state store that timers need."""
    key, store = Y.STORE
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        return _arriving(spark, _call_parts(spark, sf_dir), made)
    finally:
        spark.conf.set(key, before)


#: The calls that are not behind the watermark when they come: in the first part all, in the second those after it.
_IN_TIME = f"""{CALLS}, p AS (SELECT *, epoch_us(ts) AS us, ts < TIMESTAMP '2024-01-20' AND call_id % 5 <> 0 AS early FROM c)"""


def _spans(key: str, taken: str, ttl: int) -> str:
    """Folds the calls of a key in time: a span lasts ``ttl`` microseconds from the call that opened it."""
    return f"""{_IN_TIME}, m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM p WHERE early), t AS (SELECT {key} AS owner, p.* FROM p, m WHERE {taken} AND (early OR ts > mark)),
g AS (SELECT owner, list({{'us': us, 'call_id': call_id, 'tool': tool}} ORDER BY us, call_id) AS l FROM t GROUP BY owner),
f AS (SELECT owner, list_reduce(l, lambda z, x: CASE WHEN x.us - z.span.us > {ttl} THEN {{'span': x, 'out': list_append(z.out, {{'c': x, 'first': x}})}} ELSE {{'span': z.span, 'out': list_append(z.out, {{'c': x, 'first': z.span}})}} END,
  {{'span': {{'us': -1000000000000000, 'call_id': -1::BIGINT, 'tool': ''}}, 'out': [{{'c': l[1], 'first': l[1]}}][1:0]}}) AS z FROM g),
o AS (SELECT owner, o.c.us AS us, o.c.call_id AS call_id, o.c.tool AS tool, o.c.call_id = o.first.call_id AS opens, o.first.tool AS first_tool FROM (SELECT owner, unnest(z.out) AS o FROM f))"""


@query(f"""WITH {_spans("tool || '|' || props_k", "tool IN ('view', 'click', 'buy') AND call_id % 3 > 0", 600_000_000).replace("props AS payload", "props AS payload, json_extract_string(props, '$.k')::INT % 3 AS props_k")},
every AS (SELECT call_id, us, tool, opens AS runs FROM o UNION ALL SELECT call_id, us, tool, true FROM p WHERE NOT (tool IN ('view', 'click', 'buy') AND call_id % 3 > 0)) SELECT * FROM every""")
def x3_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def made(calls: DataFrame) -> DataFrame:
        mode = F.when(F.col("call_id") % 3 > 0, F.lit(" Apply ")).when(F.col("call_id") % 2 > 0, F.lit("dry_run"))
        payload = F.when(F.col("call_id") >= 0, (F.get_json_object("payload", "$.k").cast("int") % 3).cast("string"))
        return Y.executed(calls.withColumns({"mode": mode, "payload": payload}), ["view", "click", "buy"])

    return _timed(spark, sf_dir, made).where("call_id >= 0")


@query(f"""WITH {_spans("session::VARCHAR", "tool IN ('view', 'click')", 1_800_000_000)} SELECT owner AS turn, us, call_id, tool, opens, first_tool FROM o""")
def x4_stream_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(spark, sf_dir, lambda calls: Y.turns(calls, ["view", "click"]))


@query("""SELECT CASE WHEN event_id % 10 IN (3, 7) THEN '' ELSE event_type END AS tool, count(*) FILTER (event_id % 10 NOT IN (3, 7)) AS calls, count(*) FILTER (event_id % 10 IN (3, 7)) AS bad FROM events GROUP BY 1""")
def x1_stream_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    told = F.to_json(F.struct(F.col("event_id").alias("call_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session"), F.col("event_type").alias("tool"), F.col("value").alias("ms"), F.col("props").alias("payload")))
    kind = F.col("event_id") % 10
    line = F.when(kind == 3, F.substring(told, 1, 20)).when(kind == 7, F.lit('{"other": 1}')).otherwise(told)
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex[:12]}"
    e.select(line.alias("value")).write.text(path)
    return _drained(spark, X.intake(X.read_calls(spark, path)), "complete")
