"""Tables, figures, outlines and references in documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators.graphs import settled
from lorekeep.operators.search import contained
from lorekeep.operators.traces import common_substrings


def md_table(lines: DataFrame) -> DataFrame:
    """doc, row, cells (by header) of the first table of each document (doc, place, line); the separator is skipped."""
    order = Window.partitionBy("doc").orderBy("place")
    bar = F.trim("line").startswith("|")
    marked = lines.withColumn("bar", bar)
    opens = F.when(F.col("bar") & ~F.coalesce(F.lag("bar").over(order), F.lit(False)), 1).otherwise(0)
    marked = marked.withColumn("opens", opens)
    running = F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    table = marked.withColumn("n", running).where("bar and n = 1")
    cells = F.transform(F.split(F.trim(F.trim("line"), F.lit("|")), r"\|"), lambda c: F.trim(c))
    rows = table.withColumn("cells", cells).where(~F.col("line").rlike(r"^[\s|:-]+$"))
    numbered = rows.withColumn("row", F.row_number().over(order) - 1).withColumn("head", F.first("cells").over(order))
    return numbered.where((F.col("row") > 0) & (F.size("cells") == F.size("head"))).select("doc", "row", F.map_from_arrays("head", "cells").alias("cells"))


def content_figures(images: DataFrame, least: int = 6000) -> DataFrame:
    """doc, page, md5, reason, number of images (doc, page, place, md5, bytes): those repeated on at least half of three
    or more pages and small ones are left out, the rest are numbered in order."""
    pages = images.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    on = images.groupBy("doc", "md5").agg(F.count_distinct("page").alias("on"))
    joined = images.join(on, ["doc", "md5"]).join(pages, "doc")
    reason = F.when((F.col("pages") >= 3) & (F.col("on") * 2 >= F.col("pages")), "repeated").when(F.col("bytes") < least, "small").otherwise("kept")
    marked = joined.withColumn("reason", reason)
    place = F.row_number().over(Window.partitionBy("doc", "reason").orderBy("page", "place"))
    return marked.select("doc", "page", "place", "md5", "reason", F.when(F.col("reason") == "kept", place).alias("number"))


#: Characters at which a packed unit closes: a fixed value.
PACKED_UNIT = 1500


def outline_units(chunks: DataFrame) -> DataFrame:
    """doc, unit, kind, chunks, children, chars of chunks (doc, chunk, place, type, parent, chars).

    A parent text is a unit with its children's ids in order; where a document has parent texts, a text without one
    stands alone.  A document without any is packed: chunks in order, a unit closing when it has 1,500 characters.
    """
    parents = chunks.where("type = 'parent_text'")
    kids = chunks.where("parent is not null").groupBy(F.col("parent").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("place", "chunk"))).alias("kids"))
    told = lambda ids: F.array_join(F.transform(ids, lambda c: c.cast("string")), ",")
    own = F.coalesce(F.transform("kids", lambda k: k["chunk"]), F.array().cast("array<bigint>"))
    first = parents.join(kids, "chunk", "left").select(
        "doc", F.col("chunk").alias("unit"), F.lit("parent").alias("kind"), told(F.concat(F.array("chunk"), own)).alias("chunks"), F.size(own).alias("children"), F.col("chars").cast("long").alias("chars"))
    layered = parents.select("doc").distinct()
    alone = chunks.where("type = 'text' and parent is null").join(layered, "doc", "left_semi").select(
        "doc", F.col("chunk").alias("unit"), F.lit("orphan_text").alias("kind"), F.col("chunk").cast("string").alias("chunks"), F.lit(0).alias("children"), F.col("chars").cast("long").alias("chars"))
    flat = chunks.join(layered, "doc", "left_anti").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("place", "chunk", "chars"))).alias("all"))
    start = F.struct(F.array().cast("array<struct<ids:array<bigint>,chars:bigint>>").alias("done"), F.array().cast("array<bigint>").alias("ids"), F.lit(0).cast("long").alias("chars"))

    def add(acc: Column, chunk: Column) -> Column:
        ids, chars = F.concat(acc["ids"], F.array(chunk["chunk"])), acc["chars"] + chunk["chars"].cast("long")
        full = chars >= PACKED_UNIT
        done = F.when(full, F.concat(acc["done"], F.array(F.struct(ids.alias("ids"), chars.alias("chars"))))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(full, F.array().cast("array<bigint>")).otherwise(ids).alias("ids"), F.when(full, F.lit(0).cast("long")).otherwise(chars).alias("chars"))

    rest = lambda acc: F.when(F.size(acc["ids"]) > 0, F.concat(acc["done"], F.array(F.struct(acc["ids"].alias("ids"), acc["chars"].alias("chars"))))).otherwise(acc["done"])
    packed = flat.select("doc", F.explode(F.aggregate("all", start, add, rest)).alias("u")).select(
        "doc", F.get("u.ids", 0).alias("unit"), F.lit("packed_text").alias("kind"), told(F.col("u.ids")).alias("chunks"), (F.size("u.ids") - 1).alias("children"), "u.chars")
    return first.unionByName(alone).unionByName(packed)


def name_hits(texts: DataFrame, names: DataFrame, top: int = 2) -> DataFrame:
    """text_id, name, common, place: the names (name) that a text (text_id, text) speaks of, without blanks and marks.

    A name is met by three characters in a row, or by two that both begin with; the longest common part comes first,
    then the longer name.
    """
    left = texts.select(F.col("text_id").alias("left_id"), T.norm_title(F.coalesce("text", F.lit(""))).alias("text")).where("text != ''")
    right = names.select("name").distinct().withColumn("text", T.norm_title(F.coalesce("name", F.lit("")))).where("length(text) > 1")
    right = settled(right.withColumn("right_id", F.monotonically_increasing_id()), "names")
    long = common_substrings(left, right.select("right_id", "text"), 3)
    head = F.substring("text", 1, 2).alias("head")
    short = left.where("length(text) > 1").select("left_id", head).join(right.select("right_id", head), "head").select("left_id", "right_id").distinct()
    short = short.join(long.select("left_id", "right_id"), ["left_id", "right_id"], "left_anti").withColumn("common", F.lit(2))
    found = long.unionByName(short).join(right.select("right_id", "name", F.length("text").alias("size")), "right_id")
    place = F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("common"), F.desc("size"), "name"))
    return found.withColumn("place", place).where(F.col("place") <= top).select(F.col("left_id").alias("text_id"), "name", "common", "place")


def reference_stem(reference: Column) -> Column:
    """What a reference names: the last part of its path without query, anchor and extension; all of it where that is empty."""
    ref = F.trim(F.coalesce(reference, F.lit("")))
    tail = F.regexp_replace(F.element_at(F.split(F.rtrim(ref, F.lit("/")), "/"), -1), r"[?#].*$", "")
    stem = F.regexp_replace(tail, r"\.[^.]*$", "")
    return F.coalesce(F.nullif(stem, F.lit("")), ref)


def find_reference(refs: DataFrame, pages: DataFrame, docs: DataFrame, most: int = 3, rules: str = "bmm:") -> DataFrame:
    """ref_id, source (wiki, doc), hits, reason of references (ref_id, reference) to standards.

    First the pages (slug, title, page_type; no rules) whose title or slug holds the stem, shortest title first; else
    the documents (doc_id, title) whose title does.  A URL that nothing holds would have to be fetched, which is not done.
    """
    asked = refs.select("ref_id", F.trim(F.coalesce("reference", F.lit(""))).alias("ref"), F.lower(reference_stem(F.col("reference"))).alias("part"))
    asked = settled(asked, "references")
    parts = asked.where("part != ''").select("part").distinct().select(F.col("part").alias("part_id"), "part")
    kept = pages.where(~F.coalesce("page_type", F.lit("")).startswith(rules)).select("slug", F.coalesce("title", F.lit("")).alias("title"))
    either = F.explode(F.array(F.lower("title"), F.lower("slug"))).alias("whole")
    held = contained(parts, kept.select(F.struct(F.length("title").alias("size"), "slug").alias("whole_id"), either))
    named = contained(parts, docs.select(F.struct("doc_id", F.lit(0).alias("zero")).alias("whole_id"), F.lower(F.coalesce("title", F.lit(""))).alias("whole")))

    def best(found: DataFrame, name: str, key: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("part_id").orderBy("whole_id"))
        top = found.withColumn("place", place).where(F.col("place") <= most)
        hits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(f"whole_id.{key}").cast("string").alias("h")))), lambda s: s["h"]), ",")
        return top.groupBy(F.col("part_id").alias("part")).agg(hits.alias(name))

    joined = asked.join(best(held, "wiki", "slug"), "part", "left").join(best(named, "doc", "doc_id"), "part", "left")
    source = F.when(F.col("wiki").isNotNull(), "wiki").when(F.col("doc").isNotNull(), "doc").otherwise("")
    reason = F.when(F.col("ref") == "", "no_reference").when(source != "", "").when(F.lower("ref").rlike("^https?://"), "fetch_disabled").otherwise("not_found")
    return joined.select("ref_id", source.alias("source"), F.coalesce("wiki", "doc", F.lit("")).alias("hits"), reason.alias("reason"))


def catalog_diff(projection: DataFrame, artifact: DataFrame) -> DataFrame:
    """kind, name, side: names on one side alone (kind, name)."""
    one = projection.join(artifact, ["kind", "name"], "left_anti").withColumn("side", F.lit("projection"))
    return one.unionByName(artifact.join(projection, ["kind", "name"], "left_anti").withColumn("side", F.lit("artifact")))


def link_targets(asked: DataFrame, pages: DataFrame, ranges: DataFrame, closure: DataFrame) -> DataFrame:
    """ask_id, page, place: the pages a relation may point at, for a page that asks (asked: ask_id, relation, page, q).

    pages: page, class, title; ranges: relation, class.  Pages are of a class at or below the relation's range, the asking
    page is left out, and where ``q`` is not empty titles hold it, whatever its case; by class, then title, then page.
    """
    below = closure.select(F.col("node").alias("class"), F.col("ancestor"))
    reach = ranges.withColumnRenamed("class", "ancestor").join(below, "ancestor").select("relation", "class").distinct()
    met = asked.select("ask_id", "relation", F.col("page").alias("own"), F.lower(F.coalesce("q", F.lit(""))).alias("q")).join(reach, "relation").join(pages, "class")
    met = met.where((F.col("page") != F.col("own")) & F.lower("title").contains(F.col("q")))
    place = F.row_number().over(Window.partitionBy("ask_id").orderBy("class", "title", "page"))
    return met.select("ask_id", "page", place.alias("place"))


def concept_preview(groups: DataFrame, existing: DataFrame) -> DataFrame:
    """grp, primary_slug, members, kbs, state of groups (grp, slug, kb_id, version): exists, single or new."""
    best = groups.groupBy("grp").agg(F.max("version").alias("top"), F.count("*").alias("members"), F.count_distinct("kb_id").alias("kbs"))
    first = groups.join(best.select("grp", F.col("top").alias("version")), ["grp", "version"]).groupBy("grp").agg(F.min("slug").alias("primary_slug"))
    joined = best.join(first, "grp").join(existing.select("grp", F.lit(True).alias("there")), "grp", "left")
    state = F.when(F.col("there"), "exists").when(F.col("kbs") < 2, "single").otherwise("new")
    return joined.select("grp", "primary_slug", "members", "kbs", state.alias("state"))


#: What makes a line of plain text a heading: fixed values.
NUMBERED = r"^\s*(?:\*\*)?(\d+(?:\.\d+){0,3})(?:\*\*)?\s+\S"
COUNTED = (r"^\s*第[一二三四五六七八九十百\d]+[章节部分篇]\s*", r"^\s*[一二三四五六七八九十]+、\s*\S", r"^\s*（[一二三四五六七八九十]+）\s*\S")
SENTENCE_ENDS = "。，；：！？.,;:"
LONGEST_HEADING, SHORT_HEADING, LONG_BODY, LONGEST_SECTION, SHORT_SECTION = 40, 20, 40, 6000, 500


def plain_heading(line: Column, following: Column) -> Column:
    """A short line without a sentence's end that is numbered, or that stands before a long one."""
    s, n = F.trim(line), F.trim(F.coalesce(following, F.lit("")))
    numbered = s.rlike(NUMBERED)
    for pattern in COUNTED:
        numbered = numbered | s.rlike(pattern)
    ended = F.lit(SENTENCE_ENDS).contains(F.right(s, F.lit(1)))
    return (s != "") & (F.length(s) <= LONGEST_HEADING) & ~ended & (numbered | ((F.length(s) <= SHORT_HEADING) & (F.length(n) >= LONG_BODY)))


def split_long(text: Column, longest: int) -> Column:
    """The parts of a text of at most ``longest`` characters where sentences allow it: cut behind their ends, nothing lost."""
    pieces = F.filter(F.split(text, r"(?<=[。！？；\n])"), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, piece: Column) -> Column:
        full = (acc["open"] != "") & (F.length(acc["open"]) + F.length(piece) > longest)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, piece).otherwise(F.concat(acc["open"], piece)).alias("open"),
        )

    packed = F.aggregate(pieces, start, add, lambda acc: F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))
    return F.when(F.length(text) <= longest, F.array(text)).otherwise(packed)


def split_plain_text(docs: DataFrame, longest: int = LONGEST_SECTION) -> DataFrame:
    """doc, place, part, title, number, text: the sections of plain texts (doc, text), cut at their headings.

    Sections without a body are dropped, longer ones cut at sentence ends, and a short section that repeats the one
    before it goes.  What stands before the first heading is left out; a text without headings, or with empty
    sections alone, is one section without a title.
    """
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    order = Window.partitionBy("doc").orderBy("place")
    lines = docs.select("doc", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\n|\r")).alias("place", "line"))
    marked = lines.withColumn("heading", plain_heading(F.col("line"), F.lead("line").over(order)))
    section = F.max(F.when(F.col("heading"), F.col("place"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = marked.withColumn("section", section).where("section is not null")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("place", "line")))), lambda s: s["line"]), "\n")
    cut = inside.groupBy("doc", "section").agg(F.max(F.when(F.col("heading"), F.col("line"))).alias("line"), strip(body).alias("body")).where("body != ''")
    whole = docs.join(cut.select("doc").distinct(), "doc", "left_anti").select("doc", F.lit(-1).alias("section"), F.lit("").alias("line"), strip(F.coalesce("text", F.lit(""))).alias("body")).where("body != ''")
    parts = cut.unionByName(whole).select("doc", "section", "line", F.posexplode(split_long(F.col("body"), longest)).alias("part", "text"))
    before = F.lag("text").over(Window.partitionBy("doc").orderBy("section", "part"))
    repeated = F.coalesce((F.length("text") <= SHORT_SECTION) & (F.col("text") == before), F.lit(False))
    kept = parts.withColumn("repeated", repeated).where("not repeated")
    title = F.substring(F.trim("line"), 1, 80)
    return kept.select("doc", F.col("section").alias("place"), "part", title.alias("title"), F.regexp_extract("line", NUMBERED, 1).alias("number"), "text")
