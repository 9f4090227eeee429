"""Text jobs over bodies: sections, running headers, relations in lines."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators.graphs import settled


def lines_of(docs: DataFrame) -> DataFrame:
    """doc, place, line."""
    return docs.select("doc", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("place", "line"))


def sections(lines: DataFrame) -> DataFrame:
    """doc, place, level, title, body lines up to the next heading of the same or a higher level.

    Levels 1 to 6 are few, so the next place of each level is a running minimum from below.
    """
    marked = lines.withColumn("level", F.length(F.regexp_extract("line", r"^(#{1,6}) ", 1)))
    after = Window.partitionBy("doc").orderBy("place").rowsBetween(1, Window.unboundedFollowing)
    last = F.max("place").over(Window.partitionBy("doc"))
    ends = F.lit(None).cast("int")
    for level in range(6, 0, -1):
        nearest = F.min(F.when((F.col("level") > 0) & (F.col("level") <= level), F.col("place"))).over(after)
        ends = F.when(F.col("level") == level, nearest).otherwise(ends)
    found = marked.withColumn("end", F.coalesce(ends, last + 1)).where("level > 0")
    return found.select("doc", "place", "level", F.trim(F.regexp_replace("line", "^#+ ", "")).alias("title"), (F.col("end") - F.col("place") - 1).alias("body_lines"))


def strip_sections(lines: DataFrame, titles: list[str]) -> DataFrame:
    """doc, text without the named ``##`` sections."""
    order = Window.partitionBy("doc").orderBy("place")
    heading = F.when(F.col("line").startswith("## "), F.trim(F.substring("line", 4, 1000)))
    current = F.last(heading, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = lines.withColumn("gone", F.coalesce(current.isin(titles), F.lit(False)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("gone"), F.struct("place", "line")))), lambda s: s["line"]), "\n")
    return kept.groupBy("doc").agg(body.alias("text"))


def strip_running_headers(pages: DataFrame, ratio: float = 0.3, edge: int = 2, longest: int = 60) -> DataFrame:
    """doc, page, kept and dropped lines, and the text that is left, of paged lines (doc, page, place, line).

    A short line among the first or last two of a page that stands on at least max(2, pages * ratio) pages goes
    everywhere in its document, if that has three pages or more.
    """
    n = F.max("place").over(Window.partitionBy("doc", "page"))
    marked = pages.withColumn("edge", (F.col("place") < edge) | (F.col("place") > n - edge))
    total = pages.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    seen = marked.where(F.col("edge") & (F.length("line") <= longest) & (F.trim("line") != "")).groupBy("doc", "line").agg(F.count_distinct("page").alias("on"))
    running = seen.join(total, "doc").where((F.col("pages") >= 3) & (F.col("on") >= F.greatest(F.lit(2), F.floor(F.col("pages") * ratio))))
    joined = pages.join(running.select("doc", "line", F.lit(True).alias("running")), ["doc", "line"], "left")
    left = F.array_sort(F.collect_list(F.when(F.col("running").isNull(), F.struct("place", "line"))))
    text = F.array_join(F.transform(left, lambda x: x["line"]), "\n")
    return joined.groupBy("doc", "page").agg(F.count_if(F.col("running").isNull()).alias("kept"), F.count_if("running").alias("dropped"), text.alias("text"))


def extract_relations(lines: DataFrame) -> DataFrame:
    """doc, rel, target of lines ``- rel: [[target]]`` and ``rel -> target``."""
    a = F.regexp_extract("line", r"^- (\w+): \[\[([^\]]+)\]\]$", 1)
    b = F.regexp_extract("line", r"^(\w+) -> (\S+)$", 1)
    target = F.when(a != "", F.regexp_extract("line", r"^- (\w+): \[\[([^\]]+)\]\]$", 2)).otherwise(F.regexp_extract("line", r"^(\w+) -> (\S+)$", 2))
    return lines.select("doc", F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))).alias("rel"), target.alias("target")).where("rel is not null")


#: Buckets of hashes of stretches of text, by their upper 16 bits; an odd factor that mixes them.
CODE_BUCKETS, CODE_FACTOR = 1 << 16, 0x9E3779B97F4A7C15


def stretch_codes(n: int, asked: list[int] | None = None) -> Callable[[Column], Column]:
    """The distinct hashes of the stretches of ``n`` characters of a text; of those only the ones in a bucket that is asked for."""
    wanted = np.full(CODE_BUCKETS, asked is None)
    wanted[asked or []] = True

    def codes_of(text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        wide = max(0, len(points) - n + 1)
        codes = np.zeros(wide, np.uint64)
        for k in range(n if wide else 0):
            codes = codes * np.uint64(CODE_FACTOR) + points[k:k + wide]
        return np.unique(codes[wanted[(codes >> np.uint64(48)).astype(np.int64)]]).view(np.int64)

    @F.pandas_udf("array<bigint>")
    def codes(texts: pd.Series) -> pd.Series:
        return texts.map(codes_of)

    return codes


def locate_excerpts(quotes: DataFrame, chunks: DataFrame, head: int = 12) -> DataFrame:
    """quote_id, chunk, how: the document's first chunk that holds a quote, blanks aside; else that holds its start.

    A chunk that holds the quote also holds its start, so quotes (quote_id, quote, doc) and chunks (doc, chunk,
    content) meet by hashes of the start's characters, which are then looked for in the body.  The driver learns which
    of a fixed number of buckets the starts' hashes fall in, and only stretches of these buckets become rows.
    """
    squash = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    asked = quotes.select("quote_id", "doc", squash("quote").alias("wanted")).withColumn("start", F.substring("wanted", 1, head))
    bodies = chunks.select("doc", "chunk", squash("content").alias("body"))
    lengths = [row[0] for row in asked.where("start != ''").select(F.length("start")).distinct().collect()]  # ``head`` at most
    keys = ["quote_id", "doc", "chunk", "wanted", "start"]
    met = asked.where("start = ''").join(bodies, "doc").select(*keys)  # stands anywhere
    for n in sorted(lengths):
        known = settled(asked.where(F.length("start") == n).withColumn("code", F.get(stretch_codes(n)("start"), F.lit(0))), "asked-starts")
        buckets = [row[0] for row in known.select(F.shiftrightunsigned("code", 48).cast("int")).distinct().collect()]  # CODE_BUCKETS at most
        own = bodies.select("doc", "chunk", F.explode(stretch_codes(n, buckets)("body")).alias("code"))
        met = met.unionByName(known.join(own, ["doc", "code"]).select(*keys))
    held = met.join(bodies, ["doc", "chunk"]).where(F.col("body").contains(F.col("start"))).withColumn("whole", F.col("body").contains(F.col("wanted")))
    found = held.groupBy("quote_id").agg(F.min(F.when(F.col("whole"), F.col("chunk"))).alias("whole"), F.min("chunk").alias("start"))
    joined = quotes.select("quote_id").distinct().join(found, "quote_id", "left")
    how = F.when(F.col("whole").isNotNull(), "whole").when(F.col("start").isNotNull(), "start").otherwise("none")
    return joined.select("quote_id", F.coalesce("whole", "start").alias("chunk"), how.alias("how"))
