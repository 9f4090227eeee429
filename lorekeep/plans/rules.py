"""Queries over rules, contracts and design shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import graphs as G
from lorekeep.operators import rules as R
from lorekeep.plans.fixtures import KB_PAGES, kb_pages, subclasses, table
from lorekeep.plans.graphs import CHAINS, CLOSURE
from lorekeep.plans.registry import query

RESOLVED = f"""{CLOSURE}, asked AS (SELECT p_partkey AS policy FROM part), cov AS (SELECT DISTINCT l_partkey AS policy, l_suppkey AS rule FROM lineitem WHERE l_linenumber = 1),
reach AS (SELECT ancestor AS policy, node AS sub FROM closure WHERE distance <= 4 AND ancestor IN (SELECT policy FROM asked)), resolved AS (SELECT DISTINCT r.policy, rule FROM reach r JOIN cov ON cov.policy = r.sub)"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("policy"))
    covers = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("policy"), F.col("l_suppkey").alias("rule")).distinct()
    return R.resolve_policies(asked, subclasses(spark, sf_dir), covers)


@query(f"WITH RECURSIVE {RESOLVED} SELECT * FROM resolved")
def g8_resolve_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)


@query(f"""WITH RECURSIVE {RESOLVED}, b AS (SELECT DISTINCT parent AS policy, child AS sub FROM subclasses), t AS (SELECT policy, count(*) AS rules FROM resolved GROUP BY 1),
s AS (SELECT b.policy, b.sub, count(*) AS same FROM b JOIN resolved x ON x.policy = b.policy JOIN resolved y ON y.policy = b.sub AND y.rule = x.rule GROUP BY ALL)
SELECT b.policy, b.sub, rules - coalesce(same, 0) AS missing FROM b JOIN t USING (policy) LEFT JOIN s ON s.policy = b.policy AND s.sub = b.sub WHERE rules - coalesce(same, 0) > 0""")
def g8_sub_policy_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sub_policy_alternatives(_resolved(spark, sf_dir), subclasses(spark, sf_dir))


@query("""WITH s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'fail' ELSE 'pass' END AS verdict, CASE WHEN l_partkey % 50 = 0 THEN 'fail' WHEN l_returnflag = 'R' THEN 'fail' ELSE 'pass' END AS baseline, CASE WHEN l_linenumber > 6 THEN 'low' ELSE 'high' END AS level FROM lineitem)
SELECT count(*) AS n, avg((verdict = baseline)::INT) AS consistency, count(*) FILTER (verdict = 'fail' AND level = 'low') AS false_claims, CASE WHEN avg((verdict = baseline)::INT) >= 0.9 AND count(*) FILTER (verdict = 'fail' AND level = 'low') = 0 THEN 'pass' ELSE 'review' END AS gate FROM s""")
def a23_rule_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("l_returnflag") == "R", "fail").otherwise("pass")
    return R.rule_replay(table(spark, sf_dir, "lineitem").select(verdict.alias("verdict"), F.when(F.col("l_partkey") % 50 == 0, "fail").otherwise(verdict).alias("baseline"), F.when(F.col("l_linenumber") > 6, "low").otherwise("high").alias("level")))


@query("""WITH r AS (SELECT 'r' || p_partkey AS rule, 'Rule ' || p_partkey AS title FROM part WHERE p_partkey % 9 > 0), x AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'r' ELSE 'Rule ' END || l_partkey AS name, l_returnflag = 'A' AS pass, l_linestatus = 'F' AS human,
  CASE l_linenumber % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS level, CASE WHEN l_linenumber > 2 THEN 'i' || l_suppkey END AS ingest FROM lineitem), i AS (SELECT 'i' || s_suppkey AS ingest FROM supplier WHERE s_suppkey % 8 > 0),
n AS (SELECT rule, rule AS name FROM r UNION SELECT rule, title FROM r) SELECT coalesce(rule, name) AS rule, count(*) AS n, count(*) FILTER (pass) AS passed, count(*) FILTER (human AND pass) AS missed, bool_or(rule IS NULL) AS phantom,
  count(*) FILTER (level = 'high') AS high, count(*) FILTER (level = 'medium') AS medium, count(*) FILTER (level = 'low') AS low, count(DISTINCT ingest) FILTER (ingest NOT IN (SELECT ingest FROM i)) AS absent FROM x LEFT JOIN n USING (name) GROUP BY coalesce(rule, name)""")
def a24_rule_report_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = table(spark, sf_dir, "part").where("p_partkey % 9 > 0").select(F.concat(F.lit("r"), "p_partkey").alias("rule"), F.concat(F.lit("Rule "), "p_partkey").alias("title"))
    n = F.col("l_linenumber")
    name = F.concat(F.when(n % 2 == 0, "r").otherwise("Rule "), "l_partkey")
    rows = table(spark, sf_dir, "lineitem").select(
        name.alias("name"), F.when(F.col("l_returnflag") == "A", "pass").otherwise("fail").alias("verdict"), (F.col("l_linestatus") == "F").alias("human"),
        F.when(n % 3 == 0, "high").when(n % 3 == 1, "medium").otherwise("low").alias("level"), F.when(n > 2, F.concat(F.lit("i"), "l_suppkey")).alias("ingest"),
    )
    ingests = table(spark, sf_dir, "supplier").where("s_suppkey % 8 > 0").select(F.concat(F.lit("i"), "s_suppkey").alias("ingest"))
    return R.rule_report_stats(rows, rules, ingests)


@query("""WITH c AS (SELECT l_partkey AS rule, array_to_string(list_sort(list(DISTINCT 's' || l_suppkey)), ',') AS policies FROM lineitem GROUP BY 1), r AS (SELECT p_partkey AS rule, coalesce(nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE ' ' END), ''), p_type) AS definition FROM part)
SELECT rule, coalesce(policies, '') AS policies, definition, CASE WHEN rule % 5 = 0 THEN 'h' || rule ELSE 'r-' || substr(sha1(definition), 1, 6) END AS hash, CASE WHEN rule % 4 = 0 THEN 'size > 3' ELSE 'always' END AS applies_when FROM r LEFT JOIN c USING (rule)""")
def j25_rule_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    rules = table(spark, sf_dir, "part").select(key.alias("rule"), F.when(key % 3 == 0, F.col("p_name")).otherwise(" ").alias("definition"), F.col("p_type").alias("note"),
        F.when(key % 5 == 0, F.concat(F.lit("h"), key)).otherwise("").alias("hash"), F.when(key % 4 == 0, "size > 3").alias("applies_when"))
    covers = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("rule"), F.concat(F.lit("s"), "l_suppkey").alias("policy"))
    return R.rule_contracts(rules, covers)


@query("""WITH r AS (SELECT event_id AS rule, event_id % 7 AS k, event_id % 5 AS m, event_type FROM events)
SELECT 'R1' AS "check", 'high' AS severity, rule::VARCHAR AS subject, 'no definition' AS detail FROM r WHERE k = 0 UNION ALL SELECT 'R2', 'high', rule::VARCHAR, event_type FROM r WHERE m = 0 UNION ALL SELECT 'R3', 'high', rule::VARCHAR, 'needs' FROM r WHERE k = 3
UNION ALL SELECT 'R4', 'high', rule::VARCHAR, 'z' FROM r WHERE k = 4 UNION ALL SELECT 'R5', 'low', rule::VARCHAR, 'vague' FROM r WHERE k = 1 UNION ALL SELECT 'R6', 'low', rule::VARCHAR, 'short' FROM r WHERE k = 2""")
def c20_rule_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 7
    definition = F.when(k == 0, " ").when(k == 1, "keep it as soon as possible").when(k == 2, "tiny").otherwise("within 30 days of the notice")
    needs = F.when(k == 3, "nothing").when(k == 4, '{"concepts": [{"id": "a", "kind": "x", "from": ["z"]}]}').otherwise('{"concepts": [{"id": "a", "kind": "x"}, {"id": "b", "kind": "y", "from": ["a"]}]}')
    rules = table(spark, sf_dir, "events").select(F.col("event_id").alias("rule"), definition.alias("definition"), F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise("auto").alias("mode"), needs.alias("needs"))
    return R.rule_lint(rules, ["soon", "proper"])


USES = "u AS (SELECT l_suppkey AS service, l_partkey % 30 AS attribute, CASE WHEN l_returnflag = 'A' THEN 'out' ELSE 'in' END AS effect FROM lineitem)"


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("service"), (F.col("l_partkey") % 30).alias("attribute"), F.when(F.col("l_returnflag") == "A", "out").otherwise("in").alias("effect"))


@query("""WITH c AS (SELECT o_orderkey AS contract, o_orderkey % 3 = 0 AS read_only, CASE WHEN o_orderkey % 4 > 0 THEN 'k' || o_custkey END AS key, CASE WHEN o_orderkey % 5 > 0 THEN 1 END AS version FROM orders), l AS (SELECT *, l_orderkey AS contract FROM lineitem)
SELECT 'S1' AS "check", 'high' AS severity, contract::VARCHAR AS subject, '' AS detail FROM c WHERE NOT read_only AND key IS NULL
UNION ALL SELECT 'S2', 'high', contract::VARCHAR, effect FROM (SELECT DISTINCT contract, l_returnflag AS effect FROM l WHERE l_linenumber > 5) JOIN c USING (contract) WHERE read_only
UNION ALL SELECT 'S3', 'high', contract::VARCHAR, n::VARCHAR FROM (SELECT contract, count(DISTINCT l_suppkey % 3) AS n FROM l GROUP BY 1) WHERE n > 1
UNION ALL SELECT 'S4', 'high', contract::VARCHAR, key FROM c WHERE key IS NOT NULL AND contract NOT IN (SELECT contract FROM l WHERE l_linenumber = 2)
UNION ALL SELECT 'S5', 'high', contract::VARCHAR, a::VARCHAR FROM (SELECT DISTINCT contract, l_partkey % 30 AS a FROM l WHERE l_linenumber > 3) WHERE (contract, a) NOT IN (SELECT (contract, l_partkey % 30) FROM l WHERE l_linenumber < 4)
UNION ALL SELECT 'S6', 'medium', contract::VARCHAR, '' FROM c WHERE NOT read_only AND version IS NULL""")
def c19_design_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    contracts = table(spark, sf_dir, "orders").select(o.alias("contract"), (o % 3 == 0).alias("read_only"), F.when(o % 4 > 0, F.concat(F.lit("k"), "o_custkey")).alias("key"), F.when(o % 5 > 0, 1).alias("version"))
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "contract").withColumn("attribute", F.col("l_partkey") % 30)
    return R.design_shapes(contracts, lines.where("l_linenumber > 5").select("contract", F.col("l_returnflag").alias("effect")), lines.select("contract", (F.col("l_suppkey") % 3).alias("entity")),
        lines.where("l_linenumber = 2").select("contract", F.col("l_partkey").alias("dependency")), lines.where("l_linenumber < 4").select("contract", "attribute"), lines.where("l_linenumber > 3").select("contract", "attribute"))


@query(f"""WITH {USES} SELECT attribute, coalesce(array_to_string(list_sort(list(DISTINCT service) FILTER (effect = 'out')), ','), '') AS writers, coalesce(array_to_string(list_sort(list(DISTINCT service) FILTER (effect = 'in')), ','), '') AS readers FROM u GROUP BY 1""")
def a18_design_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.design_summary(_uses(spark, sf_dir))


@query("""WITH c AS (SELECT p_partkey AS class, p_brand AS module, CASE WHEN p_partkey % 20 = 0 THEN 'x' ELSE lower(p_brand) END AS short FROM part), m AS (SELECT DISTINCT p_brand AS module, lower(p_brand) AS declared FROM part WHERE p_brand <> 'Brand#2')
SELECT class, CASE WHEN declared IS NULL THEN 'unknown module' ELSE 'short name' END AS problem FROM c LEFT JOIN m USING (module) WHERE declared IS NULL OR declared <> short""")
def c24_module_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    classes = p.select(F.col("p_partkey").alias("class"), F.col("p_brand").alias("module"), F.when(F.col("p_partkey") % 20 == 0, "x").otherwise(F.lower("p_brand")).alias("short"))
    return R.module_identity(classes, p.where("p_brand != 'Brand#2'").select(F.col("p_brand").alias("module"), F.lower("p_brand").alias("short")).distinct())


@query("""WITH a AS (SELECT 'm' || p_partkey AS module, CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE lower(p_type) END AS prefix FROM part), r AS (SELECT 'm' || p_partkey AS module, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN lower(p_brand) ELSE lower(p_type) END AS prefix FROM part WHERE p_size < 30),
b AS (SELECT 'm' || p_partkey AS module, lower(split_part(p_name, ' ', 1)) AS prefix FROM part WHERE p_partkey % 2 = 0), j AS (SELECT module, nullif(trim(a.prefix), '') AS prefix, nullif(r.prefix, '') AS reg, b.prefix AS built FROM a LEFT JOIN r USING (module) LEFT JOIN b USING (module))
SELECT module, prefix, coalesce(reg, built) AS expected, CASE WHEN reg IS NOT NULL THEN 'registry' ELSE 'built-in' END AS origin FROM j WHERE prefix <> coalesce(reg, built)""")
def c24_prefix_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    module = F.concat(F.lit("m"), k).alias("module")
    artifacts = p.select(module, F.when(k % 11 == 0, " ").otherwise(F.lower("p_type")).alias("prefix"))
    registry = p.where("p_size < 30").select(module, F.when(k % 5 == 0, "").when(k % 3 == 0, F.lower("p_brand")).otherwise(F.lower("p_type")).alias("prefix"))
    return R.prefix_drift(artifacts, registry, p.where("p_partkey % 2 = 0").select(module, F.lower(F.element_at(F.split("p_name", " "), 1)).alias("prefix")))


@query(f"""WITH {KB_PAGES}, p AS (SELECT slug, page_type, content AS body FROM kb_pages WHERE page_id % 13 <> 0), n AS (SELECT slug, CASE WHEN page_id % 7 = 0 THEN 'x:Y' ELSE page_type END AS node_type, CASE WHEN page_id % 5 = 0 THEN content || '.' ELSE content END AS node_body FROM kb_pages WHERE page_id % 11 <> 0)
SELECT coalesce(p.slug, n.slug) AS slug, CASE WHEN n.slug IS NULL THEN 'missing_instance' WHEN p.slug IS NULL THEN 'orphan_instance' WHEN page_type <> node_type THEN 'type_mismatch' ELSE 'content_mismatch' END AS problem FROM p FULL JOIN n ON n.slug = p.slug WHERE n.slug IS NULL OR p.slug IS NULL OR page_type <> node_type OR body <> node_body""")
def c14_graph_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = kb_pages(spark, sf_dir)
    i = F.col("page_id")
    nodes = k.where("page_id % 11 != 0").select("slug", F.when(i % 7 == 0, "x:Y").otherwise(F.col("page_type")).alias("page_type"), F.when(i % 5 == 0, F.concat("content", F.lit("."))).otherwise(F.col("content")).alias("body"))
    return R.graph_audit(k.where("page_id % 13 != 0").select("slug", "page_type", F.col("content").alias("body")), nodes)


@query(f"""WITH {KB_PAGES}, e AS (SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem), gone AS (SELECT page_id FROM kb_pages WHERE page_id % 13 = 0) SELECT src, dst FROM e WHERE src NOT IN (SELECT page_id FROM gone) AND dst NOT IN (SELECT page_id FROM gone)""")
def s14_project_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = kb_pages(spark, sf_dir).select(F.col("page_id").alias("slug"), "page_type", F.col("content").alias("body"), F.create_map(F.lit("v"), F.col("version").cast("string")).alias("attrs"))
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return R.project_nodes(k.where("slug % 13 != 0"), k, e)[1].select("src", "dst")


TASK_LINES = r"""tasks AS (SELECT 't' || p_partkey AS slug, p_partkey % 7 <> 0 AS is_task, 'dataobject: o' || p_partkey % 130 || ' rules=r' || p_partkey % 30 || ',r' || p_partkey % 11 || chr(10) || 'text: doc:' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '#page=3' WHEN p_partkey % 3 = 1 THEN '#row=3' ELSE '' END
  || ';;# a note; ontology: C' || p_partkey % 40 || CASE WHEN p_partkey % 4 = 0 THEN ':closure=ancestors' WHEN p_partkey % 4 = 1 THEN ':closure=all' ELSE '' END AS entry,
  CASE p_partkey % 5 WHEN 0 THEN 'dataobject: o' || p_partkey % 80 WHEN 1 THEN 'it used to be told in words' WHEN 2 THEN 'short' WHEN 3 THEN 'dataobject:;ontology:;text: session:5' ELSE '' END AS exit FROM part),
pages AS (SELECT DISTINCT 'o' || s_suppkey AS slug FROM supplier), classes AS (SELECT 'C' || n_nationkey AS class FROM nation), rules AS (SELECT 'r' || n_nationkey AS rule FROM nation),
edges AS (SELECT 't' || p_partkey AS src, 'taskUsesDataObject' AS rel, 'o' || p_partkey % 90 AS dst FROM part WHERE p_partkey % 3 > 0 UNION SELECT 'o' || p_partkey % 80, 'dataObjectBelongsToTask', 't' || p_partkey FROM part WHERE p_partkey % 10 = 0)"""


@query("WITH " + TASK_LINES + r""", l0 AS (SELECT slug, is_task, side, trim(unnest(string_split_regex(body, '[;\n]+'))) AS line FROM (SELECT slug, is_task, unnest(['entry', 'exit']) AS side, unnest([entry, exit]) AS body FROM tasks)),
l AS (SELECT *, regexp_extract(line, '(^|\s)rules=(\S+)', 2) AS expr, trim(regexp_replace(line, '(^|\s)rules=\S+.*$', '')) AS head FROM l0 WHERE line <> '' AND NOT starts_with(line, '#')),
k AS (SELECT *, regexp_extract(head, '^(dataobject|text|ontology):', 1) AS kind, trim(regexp_replace(head, '^[a-z]+:', '')) AS target FROM l),
d AS (SELECT *, target IN (SELECT slug FROM pages) AS there, CASE side WHEN 'entry' THEN k.slug ELSE target END AS src, CASE side WHEN 'entry' THEN 'taskUsesDataObject' ELSE 'dataObjectBelongsToTask' END AS rel, CASE side WHEN 'entry' THEN target ELSE k.slug END AS dst FROM k WHERE kind = 'dataobject')
SELECT 'TIO1' AS "check", 'high' AS severity, slug AS subject, side || ': ' || target AS detail FROM d WHERE NOT there
UNION ALL SELECT 'TIO6', 'medium', slug, side || ': ' || target FROM d WHERE there AND is_task AND (src, rel, dst) NOT IN (SELECT (src, rel, dst) FROM edges)
UNION ALL SELECT 'TIO2', CASE WHEN contains(target, '#row') THEN 'high' ELSE 'medium' END, slug, side || ': ' || target FROM k WHERE kind = 'text' AND (contains(target, '#row') OR starts_with(target, 'session:'))
UNION ALL SELECT 'TIO3', 'high', slug, side || ': ' || target FROM k WHERE kind = 'ontology' AND regexp_replace(target, ':closure=(self|descendants|ancestors)$', '') NOT IN (SELECT class FROM classes)
UNION ALL SELECT 'TIO5', 'medium', slug, side || ': ' || rule FROM (SELECT slug, side, unnest(string_split(expr, ',')) AS rule FROM k WHERE expr <> '') WHERE rule NOT IN (SELECT rule FROM rules)
UNION ALL SELECT CASE WHEN length(head) > 12 THEN 'TIO9' ELSE 'TIO0' END, CASE WHEN length(head) > 12 THEN 'medium' ELSE 'high' END, slug, side || ': ' || head FROM k WHERE kind = ''""")
def c12_task_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))
    slug, k = F.concat(F.lit("t"), "k"), F.col("k")
    named = lambda prefix, n: F.concat(F.lit(prefix), (k % n).cast("string"))
    page = F.when(k % 3 == 0, "#page=3").when(k % 3 == 1, "#row=3").otherwise("")
    closure = F.when(k % 4 == 0, ":closure=ancestors").when(k % 4 == 1, ":closure=all").otherwise("")
    entry = F.concat(F.lit("dataobject: "), named("o", 130), F.lit(" rules="), named("r", 30), F.lit(","), named("r", 11), F.lit("\ntext: doc:"), k.cast("string"), page, F.lit(";;# a note; ontology: "), named("C", 40), closure)
    leave = F.when(k % 5 == 0, F.concat(F.lit("dataobject: "), named("o", 80))).when(k % 5 == 1, "it used to be told in words").when(k % 5 == 2, "short").when(k % 5 == 3, "dataobject:;ontology:;text: session:5")
    tasks = p.select(slug.alias("slug"), (k % 7 != 0).alias("is_task"), entry.alias("entry"), leave.alias("exit"))
    pages = table(spark, sf_dir, "supplier").select(F.concat(F.lit("o"), "s_suppkey").alias("slug"))
    nation = table(spark, sf_dir, "nation")
    uses = p.where("k % 3 > 0").select(slug.alias("src"), F.lit("taskUsesDataObject").alias("rel"), named("o", 90).alias("dst"))
    belongs = p.where("k % 10 = 0").select(named("o", 80).alias("src"), F.lit("dataObjectBelongsToTask").alias("rel"), slug.alias("dst"))
    return R.task_io(tasks, pages, nation.select(F.concat(F.lit("C"), "n_nationkey").alias("class")), uses.unionByName(belongs), nation.select(F.concat(F.lit("r"), "n_nationkey").alias("rule")))


NEEDS = """r AS (SELECT 'r' || p_partkey AS rule, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE split_part(p_name, ' ', 2) || '、 ' || split_part(p_name, ' ', 1) || ' (x);' || CASE WHEN p_partkey % 7 = 0 THEN 'wholly unknown' ELSE '' END END AS words, p_partkey AS k FROM part),
c AS (SELECT p_partkey AS class, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE split_part(p_name, ' ', 1) END AS label, p_brand AS module FROM part),
o AS (SELECT 'o' || s_suppkey AS slug, s_name || ' gives ' || n_name AS hay FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT 'p' || min(p_partkey), 'all ' || split_part(p_name, ' ', 2) FROM part GROUP BY 2)"""


@query(rf"""WITH RECURSIVE {CHAINS}, {NEEDS}, w AS (SELECT DISTINCT rule, trim(unnest(string_split_regex(words, '[、，,;；/|]+'))) AS need FROM r WHERE words IS NOT NULL), n AS (SELECT need, array_to_string(list_sort(list(DISTINCT rule)), ',') AS rules FROM w WHERE need <> '' GROUP BY 1),
x AS (SELECT need, min(slug) AS object FROM n JOIN o ON contains(hay, need) GROUP BY 1), i AS (SELECT need, trim(lower(regexp_replace(need, '[（(].*?[）)]', '', 'g'))) AS t FROM n WHERE need NOT IN (SELECT need FROM x)),
s AS (SELECT need, class FROM i JOIN c ON contains(lower(label), t) OR contains(t, lower(label)) WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY need ORDER BY CASE WHEN lower(label) = t THEN 100 ELSE 60 END DESC, class) <= 5),
st AS (SELECT count(DISTINCT class) AS n, min(class) AS first FROM s), h AS (SELECT ancestor, count(DISTINCT node) AS met, min(distance) FILTER (node = (SELECT first FROM st)) AS near FROM chain WHERE node IN (SELECT class FROM s) GROUP BY 1),
m AS (SELECT arg_min(ancestor, near) AS merged FROM h, st WHERE met = n AND n > 1), l AS (SELECT need, list_sort(list(DISTINCT class)) AS cs FROM s GROUP BY 1),
p AS (SELECT need, cs, CASE WHEN merged IS NOT NULL AND (list_contains(cs, merged) OR EXISTS (SELECT 1 FROM chain WHERE node = cs[1] AND ancestor = merged)) THEN merged ELSE cs[1] END AS class FROM l, m)
SELECT need AS key, need, CASE WHEN object IS NULL THEN 'ontology' ELSE 'external' END AS source, '' AS source_type, coalesce(object, '') AS object, p.class, coalesce(array_to_string(cs, ','), '') AS candidates, CASE WHEN len(cs) > 1 THEN 'parent' ELSE 'each' END AS collect, module, rules,
  CASE WHEN object IS NOT NULL THEN '' WHEN cs IS NULL THEN 'class_ambiguous' WHEN len(cs) > 1 THEN 'merge_parent_child' ELSE '' END AS question FROM n LEFT JOIN x USING (need) LEFT JOIN p USING (need) LEFT JOIN c ON c.class = p.class
UNION ALL SELECT rule || ':c1', 'note ' || k, 'ontology', 'graph', '', k + 1, '', 'each', module, rule, '' FROM r LEFT JOIN c ON c.class = k + 1 WHERE k % 5 = 0 UNION ALL SELECT rule || ':c2', 'c2', 'external', 'external_query', 'o' || k, NULL, '', 'once', NULL, rule, '' FROM r WHERE k % 5 = 0""")
def t21_plan_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    word = lambda n: F.element_at(F.split("p_name", " "), n)
    spec = F.format_string('{"concepts": [{"id": "c1", "class": "%d", "note": "note %d"}, {"id": "c2", "kind": "external", "dataobject": "o%d", "collect": "once"}, {"note": "no id"}], "derived": [{"id": "d"}]}', k + 1, k, k)
    words = F.concat(word(2), F.lit("、 "), word(1), F.lit(" (x);"), F.when(k % 7 == 0, "wholly unknown").otherwise(""))
    rules = p.select(F.concat(F.lit("r"), k).alias("rule"), F.when(k % 5 == 0, spec).otherwise(words).alias("need"))
    classes = p.select(k.alias("class"), F.when(k % 3 == 0, F.col("p_name")).otherwise(word(1)).alias("label"), F.col("p_brand").alias("module"))
    told = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.concat(F.lit("o"), "s_suppkey").alias("slug"), F.col("s_name").alias("title"), F.concat(F.lit("gives "), "n_name").alias("definition"))
    parts = p.groupBy(word(2).alias("w")).agg(F.min(k).alias("least")).select(F.concat(F.lit("p"), "least").alias("slug"), F.lit("all").alias("title"), F.col("w").alias("definition"))
    chains = G.ancestors(subclasses(spark, sf_dir).where("first"))
    return R.plan_items(rules, classes, told.unionByName(parts), chains)
