"""Structured Streaming forms of the telemetry operators: parsing, sessions, deduplication, turns, arm metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType

#: One call of the telemetry log.
CALL = StructType([
    StructField("call_id", LongType()), StructField("ts", TimestampType()), StructField("session", LongType()),
    StructField("tool", StringType()), StructField("ms", DoubleType()), StructField("payload", StringType()),
])


def parsed_calls(lines: DataFrame) -> DataFrame:
    """The calls of JSON lines (value), and ``bad`` with a line that does not parse or names no call."""
    call = F.from_json("value", CALL, {"mode": "PERMISSIVE"})
    rows = lines.select(call.alias("c"), "value")
    wrong = F.col("c").isNull() | F.col("c.call_id").isNull()
    return rows.select("c.*", F.when(wrong, F.col("value")).alias("bad"))


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as they arrive in a folder."""
    return parsed_calls(spark.readStream.text(path))


def intake(calls: DataFrame) -> DataFrame:
    """tool, calls, bad: how many lines came in, running totals."""
    return calls.groupBy(F.coalesce("tool", F.lit("")).alias("tool")).agg(F.count_if(F.col("bad").isNull()).alias("calls"), F.count("bad").alias("bad"))


def sessions(calls: DataFrame, gap: int = 90, late: str = "10 minutes") -> DataFrame:
    """session, start, finish, calls, ms by event-time gaps of more than ``gap`` seconds.

    Calls with a label (session, label, ts, ms) are sessions of their own, whatever their gaps.
    """
    named = F.coalesce("label", F.col("session").cast("string")).alias("session")
    # a gap of exactly ``gap`` seconds stays in the session; a label outlives any gap
    length = F.when(F.col("label").isNull(), f"{gap} seconds 1 microsecond").otherwise("100000 days")
    grouped = calls.withWatermark("ts", late).groupBy(named, F.col("label").isNotNull().alias("labelled"), F.session_window("ts", length).alias("w"))
    out = grouped.agg(F.min("ts").alias("start"), F.max("ts").alias("finish"), F.count("*").alias("calls"), F.sum("ms").alias("ms"))
    return out.drop("w")


def arm_metrics(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """day, arm, calls, ms: tumbling days; late rows are counted until the watermark has passed."""
    arm = F.when(F.col("call_id") % 2 == 0, "hint").otherwise("plain").alias("arm")
    grouped = calls.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), arm)
    return grouped.agg(F.count("*").alias("calls"), F.sum("ms").alias("ms")).select(F.col("w.start").alias("day"), "arm", "calls", "ms")
