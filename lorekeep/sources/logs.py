"""Readers of telemetry, call logs and sheets; writers of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TELEMETRY = (
    "struct<variant:string,question:string,qid:string,hits:int,ms:double,mode:string,"
    "retrieval:struct<queries:int,pg:int,neo4j:int>,ab:struct<arm:string>>"
)


def read_telemetry(lines: DataFrame) -> DataFrame:
    """Flat telemetry of JSON lines (value); lines that do not parse are left out, missing fields get defaults."""
    parsed = lines.select(F.from_json("value", f"struct<ts:string,ms:double,telemetry:{TELEMETRY}>").alias("j"), "value")
    t = F.col("j.telemetry")
    return parsed.where(t.isNotNull()).select(
        F.to_timestamp("j.ts").alias("ts"),
        F.coalesce(t["variant"], t["ab"]["arm"], F.lit("plain")).alias("arm"),
        F.coalesce(t["question"], F.lit("")).alias("question"),
        F.coalesce(t["qid"], F.lit("")).alias("qid"),
        F.coalesce(t["hits"], F.lit(0)).alias("hits"),
        F.coalesce(t["ms"], F.col("j.ms"), F.lit(0.0)).alias("ms"),
        F.coalesce(t["retrieval"]["queries"], F.lit(0)).alias("queries"),
        (t["retrieval"]["pg"].isNotNull() | t["retrieval"]["neo4j"].isNotNull()).alias("has_io"),
    )


def read_call_log(lines: DataFrame) -> DataFrame:
    """args_file, tool, began, ms, result of BEGIN and DONE lines (value); a call without DONE is a timeout."""
    value = F.col("value")
    base = lines.select(
        F.regexp_extract(value, r"args_file=(\S+)", 1).alias("args_file"),
        F.regexp_extract(value, r"^(\S+) (\S+) BEGIN", 1).alias("ts"),
        F.regexp_extract(value, r"^(\S+) (\S+) BEGIN", 2).alias("tool"),
        F.regexp_extract(value, r"(\d+)ms DONE", 1).try_cast("long").alias("ms"),
        F.nullif(F.regexp_extract(value, r"result=(.*)$", 1), F.lit("")).alias("result"),
    ).where("args_file != ''")
    grouped = base.groupBy("args_file").agg(
        F.max(F.nullif("tool", F.lit(""))).alias("tool"), F.max(F.nullif("ts", F.lit(""))).alias("began"),
        F.max("ms").alias("ms"), F.max("result").alias("result"),
    )
    return grouped.withColumn("shape", F.when(F.col("ms").isNull(), "timeout").otherwise("done"))


def read_context_log(lines: DataFrame, last: tuple[str, ...] = ("prompt", "actual"), first: tuple[str, ...] = ("context",)) -> DataFrame:
    """request, round and metrics of ``request=R round=N name=value`` lines (line_no, value), with the request's session and usage.

    A metric in ``last`` keeps the value of the last line that names it, one in ``first`` the first.  Lines without a
    round name the request's session (``session=S``, the last one counts) or add to its usage (``usage=N``).
    """
    value = F.col("value")
    number = lambda name: F.regexp_extract(value, rf"\b{name}=(\d+)", 1).try_cast("long")
    picks = {name: number(name) for name in ("request", "round", "usage", *last, *first)}
    rows = lines.select("line_no", *[c.alias(n) for n, c in picks.items()], F.nullif(F.regexp_extract(value, r"\bsession=(\S+)", 1), F.lit("")).alias("session"))
    rows = rows.where("request is not null")

    def met(name: str, place) -> Column:
        return place(name, F.when(F.col(name).isNotNull(), F.col("line_no"))).alias(name)

    rounds = rows.where("round is not null").groupBy("request", "round").agg(*[met(n, F.max_by) for n in last], *[met(n, F.min_by) for n in first])
    whole = rows.where("round is null").groupBy("request").agg(met("session", F.max_by), F.count("usage").alias("usages"), F.sum("usage").alias("used"))
    return rounds.join(whole, "request", "left").withColumn("usages", F.coalesce("usages", F.lit(0)))


def read_sheet(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A delimited sheet with a header: blank rows dropped, of columns of one name the first kept, ``row_no`` added."""
    raw = spark.read.option("header", False).option("multiLine", True).option("sep", separator).csv(path)
    numbered = raw.withColumn("row_no", F.monotonically_increasing_id())
    head = numbered.orderBy("row_no").first()
    if head is None:
        return numbered
    names: dict[str, str] = {}
    for column in raw.columns:
        if head[column] and head[column].strip() not in names:
            names[head[column].strip()] = column
    body = numbered.where(F.col("row_no") > head["row_no"])
    filled = F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in names.values()]) if names else F.lit(None)
    return body.where(filled.isNotNull()).select("row_no", *[F.col(c).alias(n) for n, c in names.items()])


def write_findings(found: DataFrame, path: str, run: str, base: str) -> None:
    """The findings of a run over a base, a folder per base, run and check, and a pointer to the run as the base's newest.

    Other bases and earlier runs stay as they are; writing a run again replaces it.
    """
    found.write.mode("overwrite").partitionBy("check").parquet(f"{path}/findings/{base}/{run}")
    pointer = found.sparkSession.createDataFrame([(base, run, found.count())], "base string, run string, findings long")
    pointer.write.mode("overwrite").json(f"{path}/newest/{base}")


def read_findings(spark: SparkSession, path: str, base: str) -> DataFrame:
    """The findings of a base's newest run, with the run's name."""
    run = spark.read.schema("base string, run string, findings long").json(f"{path}/newest/{base}").first()["run"]
    return spark.read.parquet(f"{path}/findings/{base}/{run}").withColumn("run", F.lit(run))
