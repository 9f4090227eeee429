"""Mixing sources to target weights by systematic sampling.

Within a source every document has the same expected number of copies, target / source size.  The running sum of
these expectations over the documents, ordered by size and doc_id, is cut at the integers after one random offset
is added: a document is emitted once for each integer it crosses.  Ordering by size keeps a source's taken words
within about one document of its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.shared import bounded_broadcast, free_name, stored, text_of

#: No document is taken more often, and no source beyond this multiple of its size.
MOST_COPIES = 3
#: Rows of the table of range pieces that may be broadcast (a row per range partition and source in it).
BROADCAST_PIECES = 100_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Words of ``[^\\x20\\x09-\\x0D]+``."""
    return F.regexp_count(text, F.lit("[^ \\x09-\\x0D]+")).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source``, ``source_size``, ``target``: weights 1, 2, 3, repeating over the sources by code point, null last.

    The shares fill up like water: a source stops at three times its size, and what it leaves is shared again by
    weight.  Sources in order of (cap / weight) reach their caps one after another, so prefix sums give the level.
    One row per source goes through the window, not one per document.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = totals.withColumn("rank", F.row_number().over(order))
    ranked = ranked.withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("double")).withColumn(
        "cap", F.col("source_size").cast("double") * MOST_COPIES
    )
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    level = ranked.select(
        "*",
        (
            F.sum("source_size").over(everything).cast("double")
            - F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        ).alias("left"),
        F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)).alias("open_weight"),
    )
    level = level.withColumn("unit", F.col("left") / F.col("open_weight"))
    level = level.withColumn("free", F.col("cap") / F.col("weight") >= F.col("unit"))
    first = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "rank", "unit"))).over(everything)
    return level.withColumn("first", first).select(
        "source",
        "source_size",
        F.when(F.col("free"), F.col("weight") * F.col("first.unit")).otherwise(F.col("cap")).alias("target"),
    )


def offset_of(source: Column) -> Column:
    """The source's random offset in [0, 1): a hash of the seed and the source, so that reruns agree."""
    key = F.concat(F.lit(SEED), F.coalesce(F.concat(F.lit("+"), source), F.lit("-")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _ranks(rows: DataFrame) -> DataFrame:
    """Adds ``place``, a row's 0-based place in its source by (size, doc_id, rid), without gathering a source.

    Rows are dealt by ranges, so a hot source spreads over many tasks; a row's place is its place in its range
    plus the rows its source has in earlier ranges.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["source", "size", "doc_id", "rid"]
    dealt = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    dealt = stored(dealt.withColumn("at", F.monotonically_increasing_id()), "mix-ranges")
    dealt = dealt.withColumn("range", F.shiftright("at", 33))
    pieces = dealt.groupBy("range", "source").agg(F.min("at").alias("first_at"), F.count("*").alias("rows"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    pieces = stored(pieces.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))), "mix-pieces")
    pieces = pieces.select(F.col("range").alias("r"), F.col("source").alias("s"), "first_at", "before")
    small = bounded_broadcast(pieces, pieces.count(), BROADCAST_PIECES)
    same = (F.col("range") == F.col("r")) & F.col("source").eqNullSafe(F.col("s"))
    return dealt.join(small, same).withColumn("place", F.col("at") - F.col("first_at") + F.col("before")).drop(
        "r", "s", "first_at", "before", "range", "at"
    )


def mix(rows: DataFrame) -> DataFrame:
    """Copies of each row of (rid, doc_id, source, size): adds source_size, target, copies and taken.

    A source without words has target 0 and gives no copies; a document without words counts as size 0 and may
    be emitted.  Null sources form one source, the last.  Repeated rows are rows of their own.  An empty table
    gives an empty result.
    """
    rows = stored(rows, "mix-rows")
    targets = stored(source_targets(rows), "mix-targets")
    targets = targets.withColumnRenamed("source", "target_source")
    placed = _ranks(rows).join(
        bounded_broadcast(targets, targets.count(), BROADCAST_PIECES),
        F.col("source").eqNullSafe(F.col("target_source")),
    )
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = offset_of(F.col("source"))
    copies = F.floor((F.col("place") + 1) * each + start) - F.floor(F.col("place") * each + start)
    return placed.withColumn("copies", copies.cast("long")).select(
        "rid", "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix_sizes(docs: DataFrame) -> DataFrame:
    """The mix as counts, one row per document: doc_id, size, source_size, target, copies, taken."""
    return mix(
        docs.select(
            F.monotonically_increasing_id().alias("rid"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(text_of()).alias("size"),
        )
    ).drop("rid")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: each row as often as it is taken, with its own columns, whatever their names."""
    columns = docs.columns
    rid, copies = free_name(docs, "rid"), free_name(docs, "copies")
    kept = stored(docs.withColumn(rid, F.monotonically_increasing_id()), "mix-docs")
    counts = mix(
        kept.select(
            F.col(rid).alias("rid"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(text_of()).alias("size"),
        )
    ).where("copies > 0")
    counts = counts.select(F.col("rid").alias(rid), F.col("copies").alias(copies))
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))
    return kept.join(counts, rid).withColumn(copies, again).select(*columns)


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM totals
), weighed AS (
  SELECT *, ((rank - 1) % 3 + 1)::DOUBLE AS weight, 3 * source_size::DOUBLE AS cap FROM ranked
), filling AS (
  SELECT *,
         (sum(source_size) OVER ())::DOUBLE
           - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS remaining,
         sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM weighed
), level AS (
  SELECT *, remaining / open_weight AS unit, cap / weight >= remaining / open_weight AS free FROM filling
), water AS (
  SELECT unit AS height FROM level WHERE free ORDER BY cap / weight, rank LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN free THEN weight * (SELECT height FROM water) ELSE cap END AS target FROM level
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS place,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS each_copies,
         ('0x' || substr(md5('mix-1' || coalesce('+' || d.source, '-')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (floor((place + 1) * each_copies + start) - floor(place * each_copies + start))::BIGINT AS copies,
       ((floor((place + 1) * each_copies + start) - floor(place * each_copies + start)) * size)::BIGINT AS taken
FROM placed
"""
