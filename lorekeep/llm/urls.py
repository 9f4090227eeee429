"""URL filters by a temporal list join.

List entries are dated: each addition or removal of a host opens a validity interval that ends where the host's
next one begins.  An as-of join puts every capture beside the entry of its host, or of one of the host's parent
domains, that was in force when it was fetched; the most specific entry in force decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.shared import bounded_broadcast, stored

#: Interval rows (about 100 bytes) that may be broadcast; a longer list is joined by a shuffle on the domain.
BROADCAST_ENTRIES = 100_000
#: Captures of a domain that one order of time holds, or as many as the domain has intervals.
HOT_CAPTURES = 1000


#: Hosts that are numbers: a dotted IP number, or one in brackets.
NUMBER = r"^(\d+\.\d+\.\d+\.\d+|\[.*)$"


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and final dot; null where there is none.  IPv6 numbers keep their brackets."""
    host = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)", 1)
    return F.nullif(F.rtrim(F.lower(host), F.lit(".")), F.lit(""))


def domains_of(host: Column) -> Column:
    """The host and its parent domains down to the last label, the longest first; an IP number has no parents."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.when(host.rlike(NUMBER), F.array(host)).otherwise(parents)


def intervals(entries: DataFrame) -> DataFrame:
    """domain, action, valid_from, valid_to of dated entries (domain, action, at); ``remove`` ends what was in force.

    Of entries of a domain at one time the last by action counts.  Entries without domain or time are passed over.
    """
    clean = entries.select(
        F.lower(F.trim("domain")).alias("domain"), F.col("action").cast("string").alias("action"), F.col("at").cast("timestamp").alias("at")
    ).where("domain is not null and domain != '' and at is not null and action is not null")
    clean = clean.groupBy("domain", "at").agg(F.max("action").alias("action"))
    following = F.lead("at").over(Window.partitionBy("domain").orderBy("at"))
    return clean.withColumn("valid_to", following).where("action != 'remove'").select(
        "domain", "action", F.col("at").alias("valid_from"), "valid_to"
    )


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The captures (id, url, fetched) with host, matched, action (``none`` where nothing was in force).

    A capture without a host or fetch time matches nothing.  Each row of ``captures`` gives one row; repeated rows
    stay repeated.  Each capture asks for as many domains as its host has labels (127 at most in DNS).  Captures and
    intervals of a domain stand in one order of time, and a running value tells the interval that began last, so a
    capture meets one interval however long the history is.  A domain of more captures than ``HOT_CAPTURES`` and than
    it has intervals is dealt to several such orders, each with all its intervals.
    """
    listed = stored(intervals(entries), "url-intervals")
    rows = stored(
        captures.select("id", "url", F.col("fetched").cast("timestamp").alias("fetched"))
        .withColumn("host", host_of(F.col("url")))
        .withColumn("rid", F.monotonically_increasing_id()),
        "captures",
    )
    asked = rows.where("host is not null and fetched is not null").select(
        "rid", F.col("fetched").alias("at"), F.posexplode(domains_of(F.col("host"))).alias("depth", "domain")
    )
    history = listed.groupBy("domain").agg(F.count("*").alias("intervals"))
    sizes = asked.groupBy("domain").agg(F.count("*").alias("n")).join(history, "domain")
    sizes = stored(sizes.select("domain", F.ceil(F.col("n") / F.greatest("intervals", F.lit(HOT_CAPTURES))).alias("parts")), "url-domains")
    sizes = bounded_broadcast(sizes, sizes.count(), BROADCAST_ENTRIES)
    span = F.struct("valid_to", "action").alias("span")
    begun = listed.join(sizes, "domain").select(
        "domain", F.explode(F.sequence(F.lit(1).cast("long"), "parts")).alias("part"), F.col("valid_from").alias("at"), F.lit(0).alias("side"),
        F.lit(None).cast("long").alias("rid"), F.lit(None).cast("int").alias("depth"), span,
    )
    part = F.pmod(F.xxhash64("rid"), "parts") + 1
    met = asked.join(sizes, "domain").select(
        "domain", part.alias("part"), "at", F.lit(1).alias("side"), "rid", "depth", F.lit(None).cast(begun.schema["span"].dataType).alias("span")
    )
    order = Window.partitionBy("domain", "part").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = begun.unionByName(met).withColumn("span", F.last("span", ignorenulls=True).over(order)).where("side = 1 and span is not null")
    met = met.where(F.col("span.valid_to").isNull() | (F.col("at") < F.col("span.valid_to"))).select("rid", "depth", "domain", "span.action")
    best = met.groupBy("rid").agg(F.min(F.struct("depth", "domain", "action")).alias("best"))
    return rows.join(best, "rid", "left").select(
        "id", "url", "fetched", "host", F.col("best.domain").alias("matched"),
        F.coalesce("best.action", F.lit("none")).alias("action"),
    )


def page_captures(pages: DataFrame) -> DataFrame:
    """The pages as captures: ``pages`` has no fetch time, so it follows from page_id (one page in 37 minutes)."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp").cast("long")
    seconds = start + F.pmod(F.col("page_id") * 2220, F.lit(366 * 86400))
    return pages.select(F.col("page_id").alias("id"), "url", F.timestamp_seconds(seconds).alias("fetched"))


def page_entries(pages: DataFrame) -> DataFrame:
    """A dated list made from the pages' own hosts: blocks and their removals, reviews of parent domains."""
    hosts = pages.select(host_of(F.col("url")).alias("domain")).where("domain is not null").distinct()
    key = F.conv(F.substring(F.md5(F.col("domain").cast("binary")), 1, 6), 16, 10).cast("long")
    hosts = hosts.withColumn("key", key)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp").cast("long")
    opened = F.timestamp_seconds(start + (F.col("key") % 300) * 86400)
    closed = F.timestamp_seconds(start + (F.col("key") % 300 + 20 + F.col("key") % 41) * 86400)
    blocked = hosts.where("key % 3 = 0").select("domain", F.lit("block").alias("action"), opened.alias("at"))
    removed = hosts.where("key % 6 = 0").select("domain", F.lit("remove").alias("action"), closed.alias("at"))
    parent = F.regexp_extract("domain", r"([^.]+\.[^.]+\.[^.]+)$", 1)
    parents = hosts.select(F.nullif(parent, F.lit("")).alias("domain")).where("domain is not null").distinct()
    parents = parents.withColumn("key", key).where("key % 5 = 0")
    review = parents.select("domain", F.lit("review").alias("action"), opened.alias("at"))
    return blocked.unionByName(removed).unionByName(review)


OP8_SQL = r"""
WITH captures AS (
  SELECT page_id, url, epoch(TIMESTAMP '2024-01-01 00:00:00')::BIGINT + (page_id * 2220) % (366 * 86400) AS fetched,
         nullif(rtrim(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)', 1)), '.'), '')
           AS host
  FROM pages
), hosts AS (
  SELECT DISTINCT host AS domain, ('0x' || substr(md5(host), 1, 6))::BIGINT AS k FROM captures WHERE host IS NOT NULL
), parents AS (
  SELECT DISTINCT regexp_extract(domain, '([^.]+\.[^.]+\.[^.]+)$', 1) AS domain FROM hosts
), start AS (
  SELECT epoch(TIMESTAMP '2024-01-01 00:00:00')::BIGINT AS s
), entries AS (
  SELECT domain, 'block' AS action, s + (k % 300) * 86400 AS since FROM hosts, start WHERE k % 3 = 0
  UNION ALL
  SELECT domain, 'remove', s + (k % 300 + 20 + k % 41) * 86400 FROM hosts, start WHERE k % 6 = 0
  UNION ALL
  SELECT domain, 'review', s + (('0x' || substr(md5(domain), 1, 6))::BIGINT % 300) * 86400 FROM parents, start
  WHERE domain <> '' AND ('0x' || substr(md5(domain), 1, 6))::BIGINT % 5 = 0
), merged AS (
  SELECT domain, since, max(action) AS action FROM entries GROUP BY ALL
), spans AS (
  SELECT *, lead(since) OVER (PARTITION BY domain ORDER BY since) AS ended FROM merged
), asked AS (
  SELECT page_id, fetched, i AS depth, array_to_string(labels[i:], '.') AS domain
  FROM (SELECT page_id, fetched, CASE WHEN regexp_matches(host, '^(\d+\.\d+\.\d+\.\d+|\[.*)$') THEN [host] ELSE string_split(host, '.') END AS labels
        FROM captures WHERE host IS NOT NULL) x, unnest(range(1, len(labels) + 1)) u(i)
), met AS (
  SELECT a.page_id, a.depth, a.domain, s.action
  FROM asked a JOIN spans s ON a.domain = s.domain AND s.action <> 'remove'
   AND a.fetched >= s.since AND (s.ended IS NULL OR a.fetched < s.ended)
), best AS (
  SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY depth) = 1
)
SELECT c.page_id, c.url, c.fetched, c.host, b.domain AS matched, coalesce(b.action, 'none') AS action
FROM captures c LEFT JOIN best b ON b.page_id = c.page_id
"""
