"""Queries over names, questions, versions, locators and bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import pages as P
from lorekeep.operators import texts as X
from lorekeep.operators.search import gram_codes
from lorekeep.plans.fixtures import table
from lorekeep.plans.registry import query


@query(r"""SELECT p_partkey, lower(regexp_replace(p_name, '\s+', '', 'g')) AS slug, regexp_replace(lower(p_type || '-' || p_name), '[\s[:punct:]]+', '', 'g') AS title,
  trim(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slugified, substr(regexp_replace(lower(p_name || ' ' || p_type), '\s+', '', 'g'), 1, 80) AS key FROM part""")
def t1_normal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.norm_slug(F.col("p_name")).alias("slug"), T.norm_title(F.concat("p_type", F.lit("-"), "p_name")).alias("title"),
        T.slugify(F.concat("p_brand", F.lit(" "), "p_name")).alias("slugified"), T.question_key(F.concat("p_name", F.lit(" "), "p_type")).alias("key"))


@query(r"""SELECT l_orderkey, l_linenumber, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower('Please show ORD-' || l_orderkey || ' at https://x.y/' || l_partkey || ', v1.' || l_linenumber || '?  Thanks'),
  'https?://\S+', ' ', 'g'), '\b[a-z]+-\d+\b', ' ', 'g'), '\bv?\d+(\.\d+)*\b', ' ', 'g'), '\b(please|kindly|could you|can you)\b', ' ', 'g'), '[\s?!.,;:]+', ' ', 'g')) AS core FROM lineitem""")
def t2_question_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.concat(F.lit("Please show ORD-"), "l_orderkey", F.lit(" at https://x.y/"), "l_partkey", F.lit(", v1."), "l_linenumber", F.lit("?  Thanks"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.question_core(asked).alias("core"))


G3 = "list_distinct([substr({0}, i::INT, 3) FOR i IN range(1, length({0}) - 1)])"


@query(f"""WITH p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_name || ' ' || a.p_type AS x, b.p_name || ' ' || b.p_type AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
g AS (SELECT a, b, {G3.format('x')} AS gx, {G3.format('y')} AS gy, list_distinct([substr(x, i::INT, 2) FOR i IN range(1, length(x))]) AS bx, list_distinct([substr(y, i::INT, 2) FOR i IN range(1, length(y))]) AS b2 FROM p)
SELECT a, b, len(list_intersect(gx, gy)) / sqrt(len(gx) * len(gy)) AS set_cosine, len(list_intersect(bx, b2)) / len(list_distinct(list_concat(bx, b2))) AS jaccard FROM g""")
def t3_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), F.concat("p_name", F.lit(" "), "p_type").alias("x"))
    q = p.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("x").alias("y"))
    named = lambda c: F.coalesce(F.col(c), F.lit(""))
    sets = lambda n: [F.when(named(c) == "", F.array().cast("array<bigint>")).otherwise(gram_codes(named(c), n)) for c in ("x", "y")]
    # rows are small to shuffle and long to work on: a number that is told is not merged into a few tasks
    met = p.join(q, "a").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a")
    return met.select("a", "b", T.set_cosine(*sets(3)).alias("set_cosine"), T.jaccard(*sets(2)).alias("jaccard"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def t3_vector_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    n = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return e.select(F.col("vec_id").alias("a"), "embedding").join(n, "a").select("a", "b", F.round(T.vector_cosine(F.col("embedding"), F.col("y")), 9).alias("cosine"))


MDL = """mdl AS (SELECT doc, (i - 1)::INTEGER AS place, CASE WHEN i % 3 = 1 THEN repeat('#', 1 + (i // 3 + doc) % 3) || ' ' || s[i] ELSE s[i] END AS line
  FROM (SELECT doc_id AS doc, string_split(text, chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) u(i))"""


def marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = X.lines_of(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"))
    level = 1 + (F.expr("(place + 1) div 3") + F.col("doc")) % 3
    return lines.withColumn("line", F.when(F.col("place") % 3 == 0, F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), "line")).otherwise(F.col("line")))


@query(rf"""WITH {MDL}, h AS (SELECT *, length(regexp_extract(line, '^(#{{1,6}}) ', 1)) AS level, max(place) OVER (PARTITION BY doc) + 1 AS last FROM mdl),
f AS (SELECT a.doc, a.place, a.level, a.line, coalesce(min(b.place), any_value(a.last)) AS finish FROM h a LEFT JOIN h b ON b.doc = a.doc AND b.place > a.place AND b.level > 0 AND b.level <= a.level WHERE a.level > 0 GROUP BY ALL)
SELECT doc, place, level::INTEGER AS level, trim(regexp_replace(line, '^#+ ', '')) AS title, finish - place - 1 AS body_lines FROM f""")
def t5_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sections(marked_lines(spark, sf_dir))


@query(f"""WITH {MDL}, s AS (SELECT doc, place, CASE WHEN place % 4 = 0 THEN '## S' || (place // 4 + doc) % 3 ELSE line END AS line FROM mdl),
c AS (SELECT *, last_value(CASE WHEN starts_with(line, '## ') THEN trim(substr(line, 4)) END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY place) AS cur FROM s)
SELECT doc, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT coalesce(cur = 'S1', false)), '') AS text FROM c GROUP BY doc""")
def t4_strip_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    heading = F.concat(F.lit("## S"), (F.expr("place div 4") + F.col("doc")) % 3)
    lines = marked_lines(spark, sf_dir).withColumn("line", F.when(F.col("place") % 4 == 0, heading).otherwise(F.col("line")))
    return X.strip_sections(lines, ["S1"])


@query("""WITH l AS (SELECT doc, (i - 1)::INTEGER AS n, s[i] AS line, len(s) AS total FROM (SELECT doc_id AS doc, string_split(text, chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) u(i)),
p AS (SELECT doc, n // 4 AS page, n % 4 AS place, CASE WHEN n % 4 = 0 THEN 'Head ' || doc % 5 ELSE line END AS line FROM l),
e AS (SELECT *, max(place) OVER (PARTITION BY doc, page) AS m FROM p), t AS (SELECT doc, count(DISTINCT page) AS pages FROM p GROUP BY doc),
r AS (SELECT doc, line FROM e JOIN t USING (doc) WHERE (place < 2 OR place > m - 2) AND length(line) <= 60 AND trim(line) <> '' AND pages >= 3 GROUP BY doc, line, pages HAVING count(DISTINCT page) >= greatest(2, floor(pages * 0.3)))
SELECT p.doc, p.page, count(*) FILTER (r.line IS NULL) AS kept, count(*) FILTER (r.line IS NOT NULL) AS dropped, coalesce(string_agg(p.line, chr(10) ORDER BY place) FILTER (r.line IS NULL), '') AS text FROM p LEFT JOIN r ON r.doc = p.doc AND r.line = p.line GROUP BY ALL""")
def t7_strip_running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = X.lines_of(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"))
    head = F.when(F.col("place") % 4 == 0, F.concat(F.lit("Head "), F.col("doc") % 5)).otherwise(F.col("line"))
    return X.strip_running_headers(lines.select("doc", F.expr("place div 4").alias("page"), (F.col("place") % 4).alias("place"), head.alias("line")))


@query("""SELECT l_orderkey AS doc, CASE WHEN l_linenumber % 2 = 0 THEN 'hasPart' ELSE 'from' END AS rel, CASE WHEN l_linenumber % 2 = 0 THEN 'part/' || l_partkey ELSE 'supplier/' || l_suppkey END AS target FROM lineitem WHERE l_linenumber % 5 <> 0""")
def t9_extract_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("l_linenumber") % 5 == 0, F.concat(F.lit("text "), "l_partkey")).when(
        F.col("l_linenumber") % 2 == 0, F.concat(F.lit("- hasPart: [[part/"), "l_partkey", F.lit("]]"))).otherwise(F.concat(F.lit("from -> supplier/"), "l_suppkey"))
    return X.extract_relations(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), line.alias("line")))


@query("""SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE ' ' END), ''), nullif(trim(CASE WHEN p_partkey % 2 = 0 THEN p_type END), ''), p_brand) AS summary,
  array_to_string(list_filter([p_name, p_brand, p_type], lambda n: n <> p_brand), ',') AS aliases FROM part""")
def t10_derived_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    definition = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(" ")
    return table(spark, sf_dir, "part").select("p_partkey", T.derive_summary(definition, F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")), F.col("p_brand")).alias("summary"),
        F.array_join(T.derive_aliases(F.array("p_name", "p_brand", F.lit(" "), "p_type", "p_brand"), F.col("p_brand")), ",").alias("aliases"))


@query("""WITH p AS (SELECT 'k' || p_partkey % 3 AS kb_id, 's' || p_partkey AS slug, CASE WHEN p_partkey % 9 = 0 THEN ' ' ELSE p_name END AS title, 1 + p_partkey % 2 AS version,
  CASE p_partkey % 4 WHEN 0 THEN [p_name, p_brand] WHEN 1 THEN [' ' || p_name || ' ', p_type, ''] WHEN 2 THEN [p_brand] END AS aliases FROM part),
n AS (SELECT *, list_filter(aliases, lambda a: trim(a) <> '' AND trim(a) <> trim(title)) AS kept, list_filter(aliases, lambda a: trim(a) = trim(title)) AS removed FROM p)
SELECT kb_id, slug, title, array_to_string(CASE WHEN trim(title) <> '' AND len(removed) > 0 THEN kept ELSE aliases END, '|') AS aliases, version + (trim(title) <> '' AND coalesce(len(removed), 0) > 0)::INT AS version FROM n""")
def t10_clean_alias_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    aliases = F.when(k % 4 == 0, F.array("p_name", "p_brand")).when(k % 4 == 1, F.array(F.concat(F.lit(" "), "p_name", F.lit(" ")), F.col("p_type"), F.lit(""))).when(k % 4 == 2, F.array("p_brand"))
    pages = table(spark, sf_dir, "part").select(F.concat(F.lit("k"), k % 3).alias("kb_id"), F.concat(F.lit("s"), k).alias("slug"), F.when(k % 9 == 0, " ").otherwise(F.col("p_name")).alias("title"), (1 + k % 2).alias("version"), aliases.alias("aliases"))
    after, _ = P.clean_alias_noise(pages)
    return after.withColumn("aliases", F.array_join("aliases", "|"))


@query("""WITH u AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'doc:a%20b' || doc_id || '#page=3' WHEN 1 THEN 'page:p' || doc_id || '#row=1' WHEN 2 THEN 'graph:n' || doc_id WHEN 3 THEN 'sheet:' WHEN 4 THEN 'odd:x' ELSE 'graph:n#x=1' END AS uri FROM documents),
p AS (SELECT doc_id, regexp_extract(uri, '^([a-z]+):', 1) AS kind, url_decode(regexp_extract(uri, '^[a-z]+:([^#]*)', 1)) AS target, nullif(regexp_extract(uri, '#(.*)$', 1), '') AS section FROM u)
SELECT *, CASE WHEN kind NOT IN ('doc', 'page', 'sheet', 'url', 'graph', 'session') THEN 'unknown kind' WHEN target = '' THEN 'no target' WHEN section IS NOT NULL AND kind IN ('graph', 'session') THEN 'no segment allowed'
  WHEN section IS NOT NULL AND split_part(section, '=', 1) <> CASE kind WHEN 'doc' THEN 'page' WHEN 'page' THEN 'section' WHEN 'sheet' THEN 'row' ELSE 'text' END THEN 'wrong segment' END AS error FROM p""")
def t11_parse_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id").cast("string")
    forms = [F.concat(F.lit("doc:a%20b"), d, F.lit("#page=3")), F.concat(F.lit("page:p"), d, F.lit("#row=1")), F.concat(F.lit("graph:n"), d), F.lit("sheet:"), F.lit("odd:x"), F.lit("graph:n#x=1")]
    uri = F.element_at(F.array(*forms), (F.col("doc_id") % 6 + 1).cast("int"))
    found = table(spark, sf_dir, "documents").select("doc_id", uri.alias("uri"))
    return found.select("doc_id", *[c.alias(n) for n, c in T.parse_locator(F.col("uri")).items()])


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), a AS (SELECT *, greatest(1, coalesce(nullif(instr(lower(t), 'ention'), 0), nullif(instr(lower(t), 'ment'), 0), 1) - 30) AS b FROM f)
SELECT doc_id, CASE WHEN b > 1 THEN '…' ELSE '' END || substr(t, b, 60) || CASE WHEN b + 59 < length(t) THEN '…' ELSE '' END AS snippet FROM a""")
def t12_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), ["ention", "ment"], 30).alias("snippet"))


@query("""WITH v AS (SELECT p_partkey, p_size || '.' || p_partkey % 7 || '.' || CASE WHEN p_partkey % 5 = 0 THEN 'rc' ELSE (p_partkey % 3)::VARCHAR END AS version FROM part)
SELECT p_partkey, list_transform(string_split(version, '.'), lambda x: coalesce(try_cast(x AS INTEGER), -1)) >= [9, 2] AND list_transform(string_split(version, '.'), lambda x: coalesce(try_cast(x AS INTEGER), -1)) <= [30, 1, 0] AS inside FROM v""")
def t13_version_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.when(F.col("p_partkey") % 5 == 0, F.lit("rc")).otherwise((F.col("p_partkey") % 3).cast("string"))
    version = F.concat_ws(".", "p_size", F.col("p_partkey") % 7, last)
    return table(spark, sf_dir, "part").select("p_partkey", T.in_range(version, F.lit("9.2"), F.lit("30.1.0")).alias("inside"))


@query(r"SELECT doc_id, floor(length(regexp_replace(text, '\s+', '', 'g')) / 1.6)::INTEGER + 1 AS tokens FROM documents")
def t14_est_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.est_tokens(F.col("text")).alias("tokens"))


@query("""SELECT p_partkey, 'rf-' || substr(sha1(p_name || '|' || p_brand), 1, 8) AS fingerprint, CASE WHEN p_partkey % 10 = 0 THEN 'hint' WHEN p_partkey % 10 = 1 THEN 'plain'
  WHEN ('0x' || substr(sha256('part/' || p_partkey), 1, 2))::INT % 2 = 0 THEN 'hint' ELSE 'plain' END AS arm FROM part""")
def t15_fingerprint_and_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    arm = T.ab_arm(F.concat(F.lit("part/"), "p_partkey"), F.when(F.col("p_partkey") % 10 == 0, "hint"), F.when(F.col("p_partkey") % 10 == 1, "plain"))
    return table(spark, sf_dir, "part").select("p_partkey", T.row_fingerprint([F.col("p_name"), F.col("p_brand")], "rf-", 8).alias("fingerprint"), arm.alias("arm"))


@query("SELECT p_partkey, 'Part ' || p_name || ' (' || p_brand || ', ' || p_partkey || ')' AS title FROM part")
def t17_render_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"name": F.col("p_name"), "brand": F.col("p_brand"), "key": F.col("p_partkey")}
    return table(spark, sf_dir, "part").select("p_partkey", T.render_title("Part {name} ({brand}, {key})", values).alias("title"))


@query(r"""WITH q AS (SELECT item_id AS quote_id, text AS quote FROM benchmark), c AS (SELECT doc_id AS chunk, regexp_replace(text, '\s+', '', 'g') AS body FROM documents),
x AS (SELECT quote_id, min(chunk) FILTER (contains(body, regexp_replace(quote, '\s+', '', 'g'))) AS whole, min(chunk) FILTER (contains(body, substr(regexp_replace(quote, '\s+', '', 'g'), 1, 12))) AS start FROM q, c WHERE chunk % 4 = quote_id % 4 GROUP BY quote_id)
SELECT quote_id, coalesce(whole, start) AS chunk, CASE WHEN whole IS NOT NULL THEN 'whole' WHEN start IS NOT NULL THEN 'start' ELSE 'none' END AS how FROM x""")
def j13_locate_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"), (F.col("item_id") % 4).alias("doc"))
    chunks = table(spark, sf_dir, "documents").select((F.col("doc_id") % 4).alias("doc"), F.col("doc_id").alias("chunk"), F.col("text").alias("content"))
    return X.locate_excerpts(quotes, chunks)


@query(r"""WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '业务编号：AB-' || doc_id || '99，请判定' WHEN 1 THEN 'see No. X_' || doc_id || '000 now' WHEN 2 THEN 'id: ' || doc_id % 100 WHEN 3 THEN substr(text, 1, 60) END AS q FROM documents)
SELECT doc_id, lower(coalesce(nullif(regexp_extract(q, '编号\s*[：:#]?\s*([A-Za-z0-9][A-Za-z0-9\-_/]{3,})', 1), ''), nullif(regexp_extract(q, '(?i)(?:^|[^\pL\pN_])(?:no|no\.|id)\s*[：:#]?\s*([A-Za-z0-9][A-Za-z0-9\-_/]{3,})', 1), ''), '')) AS qid FROM t""")
def t2_extract_qid(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    q = F.when(i % 5 == 0, F.concat(F.lit("业务编号：AB-"), i, F.lit("99，请判定"))).when(i % 5 == 1, F.concat(F.lit("see No. X_"), i, F.lit("000 now"))).when(i % 5 == 2, F.concat(F.lit("id: "), i % 100)).when(i % 5 == 3, F.substring("text", 1, 60))
    return table(spark, sf_dir, "documents").select("doc_id", T.extract_qid(q).alias("qid"))


@query("""SELECT p_partkey, coalesce(nullif(concat_ws(chr(10) || chr(10), nullif(trim(CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE ' ' END), ''), '【brand】' || nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN p_brand END), ''), '【size】' || CASE WHEN p_size > 25 THEN p_size END), ''), '（源表未提供）') AS description FROM part""")
def t17_description_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    told = F.when(k % 2 == 0, F.col("p_name")).otherwise(" ")
    return table(spark, sf_dir, "part").select("p_partkey", T.description_of([told], {"brand": F.when(k % 3 == 0, F.col("p_brand")), "size": F.when(F.col("p_size") > 25, F.col("p_size"))}).alias("description"))


@query("""SELECT p_partkey, 'doc' AS kind, p_name || '/' || p_partkey AS target, CASE WHEN p_partkey % 2 = 0 THEN 'page=' || p_size || '%20a' END AS section, CASE WHEN p_partkey % 2 = 0 THEN 'doc:' || replace(p_name, ' ', '%20') || '%2F' || p_partkey || '#page=' || p_size || '%20a' ELSE 'doc:' || replace(p_name, ' ', '%20') || '%2F' || p_partkey END AS uri FROM part""")
def t11_build_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    built = T.build_locator(F.lit("doc"), F.concat("p_name", F.lit("/"), k), F.when(k % 2 == 0, "page"), F.concat("p_size", F.lit(" a")))
    rows = table(spark, sf_dir, "part").select("p_partkey", built.alias("uri"))
    read = T.parse_locator(F.col("uri"))
    return rows.select("p_partkey", read["kind"].alias("kind"), read["target"].alias("target"), read["section"].alias("section"), "uri")
