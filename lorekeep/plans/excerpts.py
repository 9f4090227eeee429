"""Queries over excerpts of sections and over what the lines of a page say of its relations and attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.operators import excerpts as X
from lorekeep.plans.fixtures import table
from lorekeep.plans.registry import query
from lorekeep.plans.texts import MDL, marked_lines

HEADS = r"""heads AS (SELECT doc, place, length(regexp_extract(trim(line), '^(#{1,6})\s+\S', 1)) AS level, trim(regexp_replace(trim(line), '^#{1,6}\s+', '')) AS title FROM mdl WHERE regexp_matches(trim(line), '^#{1,6}\s+\S'))"""
_ASKED = """(SELECT doc, CASE doc % 6 WHEN 0 THEN '' WHEN 1 THEN 'zz zz zz' WHEN 2 THEN ' ' || replace(t[1], ' ', '   ') WHEN 3 THEN substr(t[2], 1, 6) WHEN 4 THEN t[-1] ELSE t[1] || ' and more' END AS section FROM (SELECT doc, list(title ORDER BY place) AS t FROM heads GROUP BY doc))"""


@query(rf"""WITH {MDL}, {HEADS}, asked AS (SELECT doc, coalesce(section, '') AS section, lower(regexp_replace(coalesce(section, ''), '\s+', '', 'g')) AS key FROM {_ASKED}),
own AS (SELECT h.*, lower(regexp_replace(title, '\s+', '', 'g')) AS own, (SELECT min(place) FROM heads n WHERE n.doc = h.doc AND n.place > h.place AND n.level <= h.level) AS ends FROM heads h),
best AS (SELECT a.doc, section, CASE WHEN own = key THEN 0 ELSE 1 END AS step, place, ends FROM asked a JOIN own USING (doc) WHERE key <> '' AND (contains(own, key) OR contains(key, own))
  QUALIFY row_number() OVER (PARTITION BY a.doc, section ORDER BY step, place) = 1),
body AS (SELECT b.doc, section, trim(string_agg(line, chr(10) ORDER BY m.place), ' ' || chr(9) || chr(10) || chr(13)) AS body FROM best b JOIN mdl m ON m.doc = b.doc AND m.place > b.place AND (b.ends IS NULL OR m.place < b.ends) GROUP BY ALL
  UNION ALL SELECT a.doc, section, trim(string_agg(line, chr(10) ORDER BY m.place), ' ' || chr(9) || chr(10) || chr(13)) FROM asked a JOIN mdl m USING (doc) WHERE key = '' AND trim(line) <> '' AND NOT EXISTS (SELECT 1 FROM heads h WHERE h.doc = m.doc AND h.place = m.place) GROUP BY ALL),
f AS (SELECT a.doc, a.section, key, step, coalesce(trim(regexp_replace(body, '[ \t　]+', ' ', 'g'), ' ' || chr(10)), '') AS flat FROM asked a LEFT JOIN best USING (doc, section) LEFT JOIN body USING (doc, section)),
c AS (SELECT *, CASE WHEN key <> '' AND step IS NULL THEN 'section_not_found' WHEN flat = '' THEN 'source_empty' WHEN regexp_matches(flat, '^(?:（|\()?(?:概要设计|详细设计|领域建模)?[^。\n]{{0,20}}(?:无原文片段|未提供原文引用|请补\s*source_text)') THEN 'source_placeholder' ELSE 'ok' END AS code FROM f)
SELECT doc, section, code, CASE WHEN code = 'ok' THEN substr(flat, 1, 150) ELSE '' END AS text, CASE WHEN code = 'ok' THEN least(length(flat), 150) ELSE 0 END::INTEGER AS chars, code = 'ok' AND length(flat) > 150 AS truncated,
  CASE WHEN key = '' THEN 'first_paragraph' WHEN step = 0 THEN 'section_exact' WHEN step = 1 THEN 'section_contains' ELSE '' END AS matched_by, (SELECT string_agg(title, '|' ORDER BY place) FROM heads h WHERE h.doc = c.doc) AS available FROM c""")
def t5_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = marked_lines(spark, sf_dir)
    t = F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda h: h["title"])
    heads = X.headings(lines).groupBy("doc").agg(t.alias("t"))
    k = F.col("doc") % 6
    section = (
        F.when(k == 0, "").when(k == 1, "zz zz zz").when(k == 2, F.concat(F.lit(" "), F.replace(F.get("t", F.lit(0)), F.lit(" "), F.lit("   ")))).when(k == 3, F.substring(F.get("t", F.lit(1)), 1, 6))
        .when(k == 4, F.element_at("t", -1)).otherwise(F.concat(F.get("t", F.lit(0)), F.lit(" and more")))
    )
    return X.excerpts(lines, heads.select("doc", section.alias("section")))


#: Three lines of a page from every order line, the same text in both engines.
_LINES = [
    """CASE l_linenumber % 4 WHEN 0 THEN '## 本体关系' WHEN 1 THEN '## 属性（数据属性）' WHEN 2 THEN '## 关系限定（边属性）' ELSE '### 名称（bmm:k' || l_partkey % 5 || '，xsd:string）' END""",
    """CASE l_suppkey % 6 WHEN 0 THEN '- 有（`o:has`）→ [[part/' || l_partkey || '|P ' || l_suppkey || ']]' WHEN 1 THEN '- 由（`o:by`）→ [S' || l_suppkey || '](wiki:supplier/' || l_suppkey || ') '
  WHEN 2 THEN '- 有（`o:has`）→ [[part/' || l_partkey || '|P]]：crudKind=C,U；o:idem=yes，o:key=a,b' WHEN 3 THEN '- bmm:key' || l_partkey % 3 || ' of it = value ' || l_suppkey WHEN 4 THEN ' plain text ' || l_partkey || ' ' ELSE '### other ' || l_suppkey % 4 END""",
    "CASE WHEN l_partkey % 3 = 0 THEN '## other' WHEN l_partkey % 7 = 0 THEN '## 用途' ELSE 'more ' || l_suppkey END",
]
WRITTEN = f"""n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nth FROM lineitem),
w AS (SELECT l_orderkey AS doc, nth * 3 + i AS place, [{', '.join(_LINES)}][i + 1] AS line FROM n, range(3) r(i)),
b AS (SELECT *, trim(line) AS bare FROM w)"""


def _section(heading: str) -> str:
    return f"""o AS (SELECT doc, min(place) AS opened FROM b WHERE bare = '{heading}' GROUP BY doc), l AS (SELECT b.*, min(CASE WHEN starts_with(line, '## ') THEN place END) OVER (PARTITION BY b.doc) AS closed FROM b JOIN o ON o.doc = b.doc AND place > opened),
s AS (SELECT doc, place, bare AS line FROM l WHERE closed IS NULL OR place < closed)"""


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.posexplode(F.array(*[F.expr(line) for line in _LINES])).alias("i", "line")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = table(spark, sf_dir, "lineitem").withColumn("nth", nth).select(F.col("l_orderkey").alias("doc"), "nth", each)
    return rows.select("doc", (F.col("nth") * 3 + F.col("i")).alias("place"), "line")


@query(rf"""WITH {WRITTEN}, {_section(X.RELATIONS)}
SELECT doc, place, regexp_extract(line, '^- (.+?)（`', 1) AS label, regexp_extract(line, '（`([^`]+)`）', 1) AS rel, CASE WHEN contains(line, 'wiki:') THEN regexp_extract(line, 'wiki:([^)]+)\)', 1) ELSE regexp_extract(line, '\[\[([^|\]]+)\|', 1) END AS slug,
  CASE WHEN contains(line, 'wiki:') THEN regexp_extract(line, '→ \[(.+?)\]\(', 1) ELSE regexp_extract(line, '\|([^\]]+)\]\]', 1) END AS target FROM s WHERE regexp_matches(line, '^- .+?（`[^`]+`）→ (\[.+?\]\(wiki:[^)]+\)|\[\[[^|\]]+\|[^\]]+\]\])\s*$')""")
def t9_relation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.relation_lines(_written(spark, sf_dir))


@query(rf"""WITH {WRITTEN}, {_section(X.QUALIFIERS)}, q AS (SELECT doc, place, 'o:has' AS rel, regexp_extract(line, '\[\[([^|\]]+)\|', 1) AS slug FROM s WHERE contains(line, '：'))
SELECT doc, place, rel, slug, '' AS target, p.n AS name, p.v AS value FROM q, (VALUES ('crudKind', 'C,U'), ('o:idem', 'yes'), ('o:key', 'a,b')) p(n, v)""")
def t9_relation_qualifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.relation_qualifiers(_written(spark, sf_dir))


@query(rf"""WITH {WRITTEN}, e AS (SELECT *, CASE WHEN starts_with(line, '## ') AND bare IN ('## 属性（数据属性）', '## 属性') THEN 1 WHEN starts_with(line, '## ') AND bare IN ('## 本体关系', '## 关系限定（边属性）', '## 用途') THEN 0 END AS event FROM b),
i AS (SELECT * FROM (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY doc ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS was FROM e) WHERE was = 1 AND coalesce(event, 1) <> 0),
m AS (SELECT *, CASE WHEN starts_with(bare, '### 名称') THEN 'k' || regexp_extract(bare, 'bmm:k(\d)', 1) WHEN starts_with(bare, '### ') THEN substr(bare, 5) WHEN starts_with(bare, '- bmm:key') THEN 'key' || regexp_extract(bare, 'key(\d)', 1) END AS mark, starts_with(bare, '- bmm:key') AS pair FROM i),
f AS (SELECT *, last_value(CASE WHEN mark IS NOT NULL THEN {{'mark': mark, 'pair': pair, 'place': place}} END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY place) AS h FROM m),
v AS (SELECT doc, mark AS name, place AS us, regexp_extract(bare, '= (.*)$', 1) AS value FROM f WHERE pair UNION ALL SELECT doc, h.mark, h.place, trim(string_agg(rtrim(line), chr(10) ORDER BY place)) FROM f WHERE mark IS NULL AND NOT h.pair GROUP BY doc, h.mark, h.place)
SELECT doc, name, arg_max(value, us) AS value FROM v GROUP BY ALL""")
def t9_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.attributes(_written(spark, sf_dir))
