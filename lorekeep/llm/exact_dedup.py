"""Exact deduplication with a log-structured merge index, in DataFrame operations only.

Each task is a memtable: it digests its documents and flushes one run, sorted by digest, with a filter: a 64-bit
fingerprint of every digest, and Parquet's min/max statistics and Bloom filter.  Merging the runs' filters tells the
fingerprints that stand once over all runs: their rows are first sightings and are never merged.  Only rows that the
filters can't clear go to compaction, which merges them to one row per digest met several times (rows, and the row
that stays: the best identifier).  Such hits have their normal forms compared byte for byte, and a digest that covers
several texts is split by the texts themselves.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.shared import bounded_broadcast, scratch_dir, stored, text_of

#: Up to so many hit digests (64 characters each, about 30 MB) are broadcast; more are joined by a shuffle.
BROADCAST_DIGESTS = 200_000
#: Fingerprints (8 bytes each) are broadcast up to so many.
BROADCAST_FINGERPRINTS = 1_000_000


def normal_form(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``."""
    return F.regexp_replace(text, "[ \\x09-\\x0D]+", "")


def sha256(normal: Column) -> Column:
    return F.sha2(normal.cast("binary"), 256)


def _best(rid: str = "rid") -> Column:
    """Order of preference: most code points, smallest doc_id (null last), then the row itself."""
    return F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", rid)


def flush_runs(docs: DataFrame, path: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Level 0: one sorted run per task, with the fingerprints of its digests."""
    normal = normal_form(text_of())
    runs = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(text_of()).alias("points"),
        sha256(normal).alias("text_sha256"),
        digest(normal).alias("digest"),
    ).withColumn("fingerprint", F.xxhash64("digest"))
    return _written(runs, path)


def _written(level: DataFrame, path: str) -> DataFrame:
    """A level of the index: files sorted by digest, with a filter on it."""
    sorted_runs = level.sortWithinPartitions("digest")
    sorted_runs.write.option("compression", "zstd").option("parquet.bloom.filter.enabled#digest", "true").parquet(path)
    return level.sparkSession.read.schema(level.schema).parquet(path)


def unclear(runs: DataFrame) -> DataFrame:
    """The rows whose fingerprint stands in the merged filters more than once: all others are first sightings."""
    met = stored(runs.groupBy("fingerprint").count().where("count > 1").select("fingerprint"), "lsm-filter")
    return runs.join(bounded_broadcast(met, met.count(), BROADCAST_FINGERPRINTS), "fingerprint", "left_semi")


def compact(runs: DataFrame, path: str) -> DataFrame:
    """Level 1: a row per digest met several times, ``rows`` and ``best``; partial aggregation keeps hot digests small."""
    level = unclear(runs).groupBy("digest").agg(F.count("*").alias("rows"), F.min(_best()).alias("best"))
    return _written(level.where("rows > 1"), path)


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty, so null and empty texts form one group.  Of equal rows (same length and
    doc_id) exactly one is kept; null doc_ids come last.  An empty table gives an empty result.  Columns other
    than doc_id and text are ignored.  ``digest`` is the index key; a weak one costs time, never a wrong group.
    """
    base = f"{scratch_dir(docs.sparkSession)}/lsm-{uuid.uuid4().hex[:12]}"
    runs = flush_runs(docs, f"{base}/level0", digest)
    level = compact(runs, f"{base}/level1")
    hits = bounded_broadcast(level.select("digest"), level.count(), BROADCAST_DIGESTS)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    texts = texts.withColumn("normal", normal_form(F.col("text"))).withColumn("digest", digest(F.col("normal")))
    # one text is both the least and the greatest of its digest; a hot group sends two texts from each task at most
    forms = texts.join(hits, "digest", "left_semi").groupBy("digest").agg(F.min("normal").alias("low"), F.max("normal").alias("high"))
    mixed = stored(forms.where("low != high").select("digest"), "mixed-digests")
    if mixed.isEmpty():
        return _rows(runs.join(level, "digest", "left"))
    clean = _rows(runs.join(mixed, "digest", "left_anti").join(level, "digest", "left"))
    return clean.unionByName(_by_text(texts.join(mixed, "digest", "left_semi")))


def _rows(joined: DataFrame) -> DataFrame:
    """The result's columns of rows beside their group; a row without one is a group by itself."""
    alone = F.col("best").isNull()
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("rows", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("rid") == F.col("best.rid"))).alias("kept"), "text_sha256",
    )


def _by_text(texts: DataFrame) -> DataFrame:
    """Groups of a digest that several texts share: the text itself is the key."""
    rows = stored(
        texts.select(
            F.monotonically_increasing_id().alias("rid"),
            "doc_id",
            F.char_length("text").alias("points"),
            "normal",
            sha256(F.col("normal")).alias("text_sha256"),
        ),
        "mixed-rows",
    )
    level = rows.groupBy("normal").agg(F.count("*").alias("rows"), F.min(_best()).alias("best"))
    return _rows(rows.join(level, "normal"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS normal
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY normal ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY normal) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY normal ORDER BY points DESC, doc_id) AS kept,
       sha256(normal) AS text_sha256
FROM d
"""
