"""Verbatim excerpts of sections, and relations, qualifiers and attributes written in the lines of a page.

Lines are rows (doc, place, line).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.graphs import settled

#: Texts that stand where a quotation was never given; fixed value.
PLACEHOLDER = r"^(?:（|\()?(?:概要设计|详细设计|领域建模)?[^。\n]{0,20}(?:无原文片段|未提供原文引用|请补\s*source_text)"
#: Headings of the sections of a page; fixed values.
RELATIONS, QUALIFIERS = "## 本体关系", "## 关系限定（边属性）"
ATTRIBUTES = ("## 属性（数据属性）", "## 属性")
#: Only these end the attributes, as a value may hold headings of its own; fixed values.
CLOSING = (
    "## 原文依据", "## 本体关系", "## 关系限定（边属性）", "## 被引用（入边）", "## 判定依据", "## 用途", "## 输入 / 输出",
    "## 设计规范（正常 / 异常案例 · ASSERTION）",
)
#: The two ways a relation is written; fixed values.
LINK = r"^- (.+?)（`([^`]+)`）→ \[(.+?)\]\(wiki:([^)]+)\)\s*$"
LINK_INSIDE = r"^- (.+?)（`([^`]+)`）→ \[\[([^|\]]+)\|([^\]]+)\]\]\s*$"
QUALIFIED = r"^- (.+?)（`([^`]+)`）→ (.*?)：(.+?)\s*$"
#: Qualifiers are parted by semicolons, and by commas only before another name with a prefix; fixed value.
BETWEEN = r"[；;]|(?<=.)[，,](?=[A-Za-z_][\w\-]*:[^\s=]+=)"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\s+", ""))


#: Lines that a task sorts at a time; fixed value.
LINES_A_TASK = 1_000_000


def dealt(lines: DataFrame, most: int = LINES_A_TASK) -> DataFrame:
    """The lines of a document beside each other, in as many parts as their number asks for."""
    parts = -(-lines.count() // most)
    few = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lines.repartition(parts, "doc") if parts > few else lines


def headings(lines: DataFrame) -> DataFrame:
    """doc, place, level, title, ends: each heading with the place of the next one of the same or a higher level."""
    bare = _stripped(F.col("line"))
    marked = lines.select("doc", "place", F.length(F.regexp_extract(bare, r"^(#{1,6})\s+\S", 1)).alias("level"), _stripped(F.regexp_replace(bare, r"^#{1,6}\s+", "")).alias("title"))
    marked = marked.where("level > 0")
    after = Window.partitionBy("doc").orderBy("place").rowsBetween(1, Window.unboundedFollowing)
    nearest = [F.min(F.when(F.col("level") <= n, F.col("place"))).over(after) for n in range(1, 7)]
    return marked.withColumn("ends", F.coalesce(*[F.when(F.col("level") == n + 1, near) for n, near in enumerate(nearest)]))


def excerpts(lines: DataFrame, asked: DataFrame, most: int = 150) -> DataFrame:
    """doc, section, code, text, chars, truncated, matched_by, available: the words of a section (asked: doc, section).

    A section is the first heading of that title, else the first that holds it or is held by it, without white space
    and case; an empty one stands for all lines that are no headings.  Runs of blanks become one, nothing else changes,
    and ``most`` characters are kept.  Refused are section_not_found, source_empty and source_placeholder.
    """
    marked = settled(headings(lines), "headings")
    titles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda h: h["title"]), "|")
    listed = marked.groupBy("doc").agg(titles.alias("available"))
    wanted = asked.select("doc", F.coalesce("section", F.lit("")).alias("section"), _key(F.coalesce("section", F.lit(""))).alias("key")).distinct()
    named = wanted.where("key != ''").join(marked, "doc").withColumn("own", _key(F.col("title")))
    step = F.when(F.col("own") == F.col("key"), 0).when(F.col("own").contains(F.col("key")) | (F.col("key").contains(F.col("own"))), 1)
    best = named.withColumn("step", step).where("step is not null").groupBy("doc", "section").agg(F.min(F.struct("step", "place", "ends")).alias("best"))
    spans = best.select("doc", "section", "best.*")
    inside = (F.col("l.place") > F.col("s.place")) & (F.col("s.ends").isNull() | (F.col("l.place") < F.col("s.ends")))
    body = spans.alias("s").join(lines.alias("l"), (F.col("s.doc") == F.col("l.doc")) & inside).select("s.doc", "section", "l.place", "line")
    plain = lines.join(marked.select("doc", "place"), ["doc", "place"], "left_anti").where(_stripped(F.col("line")) != "")
    whole = wanted.where("key = ''").join(plain, "doc").select("doc", "section", "place", "line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
    texts = body.unionByName(whole).groupBy("doc", "section").agg(_stripped(text).alias("body"))
    joined = wanted.join(listed, "doc", "left").join(spans.select("doc", "section", "step"), ["doc", "section"], "left").join(texts, ["doc", "section"], "left")
    flat = _stripped(F.regexp_replace(F.coalesce("body", F.lit("")), r"[ \t　]+", " "))
    lost = (F.col("key") != "") & F.col("step").isNull()
    code = F.when(lost, "section_not_found").when(flat == "", "source_empty").when(flat.rlike(PLACEHOLDER), "source_placeholder").otherwise("ok")
    how = F.when(F.col("key") == "", "first_paragraph").when(F.col("step") == 0, "section_exact").when(F.col("step") == 1, "section_contains").otherwise("")
    fine = F.col("code") == "ok"
    out = joined.select("doc", "section", code.alias("code"), flat.alias("flat"), how.alias("matched_by"), F.coalesce("available", F.lit("")).alias("available"))
    return out.select(
        "doc", "section", "code", F.when(fine, F.substring("flat", 1, most)).otherwise("").alias("text"), F.when(fine, F.least(F.length("flat"), F.lit(most))).otherwise(0).alias("chars"),
        (fine & (F.length("flat") > most)).alias("truncated"), "matched_by", "available",
    )


def in_section(lines: DataFrame, heading: str) -> DataFrame:
    """The lines of the first section of that heading, up to the next ``##`` heading."""
    bare = _stripped(F.col("line"))
    opened = lines.where(bare == heading).groupBy("doc").agg(F.min("place").alias("opened"))
    later = lines.join(opened, "doc").where(F.col("place") > F.col("opened"))
    closed = F.min(F.when(F.col("line").startswith("## "), F.col("place"))).over(Window.partitionBy("doc"))
    kept = later.withColumn("closed", closed).where(F.col("closed").isNull() | (F.col("place") < F.col("closed")))
    return kept.select("doc", "place", bare.alias("line"))


def relation_lines(lines: DataFrame) -> DataFrame:
    """doc, place, label, rel, slug, target of the relations in a page's relation section, in both ways of writing."""
    part = lambda pattern, n: F.regexp_extract("line", pattern, n)
    old, new = F.col("line").rlike(LINK), F.col("line").rlike(LINK_INSIDE)
    pick = lambda a, b: F.when(old, part(LINK, a)).otherwise(part(LINK_INSIDE, b))
    found = in_section(lines, RELATIONS).where(old | new)
    return found.select("doc", "place", pick(1, 1).alias("label"), pick(2, 2).alias("rel"), pick(4, 3).alias("slug"), pick(3, 4).alias("target"))


def relation_qualifiers(lines: DataFrame) -> DataFrame:
    """doc, place, rel, slug, target, name, value: what a page says of its relations; commas inside values stay.

    Of a name that a line gives twice the last value counts.
    """
    found = in_section(lines, QUALIFIERS).where(F.col("line").rlike(QUALIFIED))
    part = lambda n: F.regexp_extract("line", QUALIFIED, n)
    rows = found.select(
        "doc", "place", part(2).alias("rel"), F.regexp_extract(part(3), r"\[\[([^|\]]+)\|?[^\]]*\]\]", 1).alias("slug"),
        _stripped(F.regexp_replace(part(3), r"\[\[[^\]]*\]\]", "")).alias("target"), F.posexplode(F.split(part(4), BETWEEN)).alias("nth", "pair"),
    ).where(F.col("pair").contains("="))
    at = F.instr("pair", "=")
    rows = rows.withColumns({"name": _stripped(F.substring(F.col("pair"), F.lit(1), at - 1)), "value": _stripped(F.substring(F.col("pair"), at + 1, F.length("pair")))})
    return rows.groupBy("doc", "place", "rel", "slug", "target", "name").agg(F.max_by("value", "nth").alias("value"))


def attributes(lines: DataFrame) -> DataFrame:
    """doc, name, value of a page's attributes: ``### title (prefix:name, type)`` with its lines, or ``- name = value``.

    Names lose their prefix, a heading without text gives nothing, and of a name given twice the last counts.
    """
    lines = dealt(lines.select("doc", "place", "line"))
    bare = _stripped(F.col("line"))
    order = Window.partitionBy("doc").orderBy("place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    event = F.when(bare.isin(*ATTRIBUTES) & F.col("line").startswith("## "), 1).when(bare.isin(*CLOSING) & F.col("line").startswith("## "), 0)
    told = lines.withColumn("event", event).withColumn("was", F.coalesce(F.last("event", ignorenulls=True).over(before), F.lit(0)))
    # what opens the attributes while they are open is a line of a value
    inside = told.where((F.col("was") == 1) & ((F.col("event") != 0) | F.col("event").isNull()))
    pair = r"^-\s*([A-Za-z_][\w:]*)\b[^\n=]*=\s*(.+?)\s*$"
    head = _stripped(F.substring(bare, 5, 1_000_000))
    own = F.regexp_extract(head, r"([A-Za-z_]\w*:[A-Za-z_]\w*)", 1)
    local = lambda name: F.element_at(F.split(name, ":"), -1)
    marks = inside.select(
        "doc", "place", F.regexp_replace("line", r"\s+$", "").alias("line"),
        F.when(bare.startswith("### "), F.struct(F.lit("head").alias("kind"), local(F.when(own != "", own).otherwise(head)).alias("name"), F.col("place").alias("at")))
        .when(bare.rlike(pair), F.struct(F.lit("pair").alias("kind"), local(F.regexp_extract(bare, pair, 1)).alias("name"), F.col("place").alias("at"))).alias("mark"),
        F.regexp_extract(bare, pair, 2).alias("said"),
    )
    marks = marks.withColumn("of", F.last("mark", ignorenulls=True).over(order)).where("of is not null and of.name != ''")
    pairs = marks.where("mark.kind = 'pair'").select("doc", F.col("mark.name").alias("name"), F.col("place").alias("at"), F.col("said").alias("value"))
    texts = marks.where("mark is null and of.kind = 'head'").groupBy("doc", F.col("of.name").alias("name"), F.col("of.at").alias("at"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
    every = reduce(DataFrame.unionByName, [pairs, texts.agg(_stripped(body).alias("value"))])
    return every.groupBy("doc", "name").agg(F.max_by("value", "at").alias("value"))
