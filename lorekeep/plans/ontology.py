"""Queries over an ontology projected from the tables: lint, class views, shapes.

The projections are SQL that both engines read; tables stand in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lorekeep.operators import graphs as G
from lorekeep.operators import ontology as O
from lorekeep.plans.fixtures import table
from lorekeep.plans.registry import query

_UP = "CAST((p_partkey - p_partkey % 4) / 4 AS BIGINT)"
TABLES = {
    "classes": """SELECT 'C' || p_partkey AS class, p_brand AS module, p_name || p_partkey % 40 AS local, CASE WHEN p_partkey % 9 = 0 THEN ' ' ELSE p_name END AS label,
  CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_type END AS comment, p_partkey % 21 = 0 AS enum FROM {part} WHERE p_partkey % 17 <> 3""",
    "members": """SELECT 'C' || c_custkey % 100 * 21 AS class, 'M' || c_custkey AS member, 'Brand#' || c_nationkey AS module, c_name AS local,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS label FROM {customer} WHERE c_custkey % 100 < 80 AND c_custkey % 7 > 1""",
    "props": """SELECT 'P' || n_nationkey AS prop, 'Brand#' || (1 + n_nationkey % 5) AS module, 'n' || n_nationkey % 22 AS local, CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE n_name END AS label, n_name AS comment,
  n_nationkey % 3 <> 0 AS object, n_nationkey % 4 = 0 AS functional, CASE WHEN n_nationkey % 5 = 1 THEN 'P' || (n_nationkey + 1) WHEN n_nationkey % 5 = 2 AND n_nationkey % 2 = 0 THEN 'P' || (n_nationkey - 1) WHEN n_nationkey = 23 THEN 'P99' END AS inverse FROM {nation}""",
    "ends": """SELECT 'P' || n_nationkey AS prop, 'domain' AS role, 'C' || n_nationkey % 9 AS class FROM {nation} WHERE n_nationkey % 6 <> 0
  UNION SELECT 'P' || n_nationkey, 'domain', 'C' || n_nationkey * 3 FROM {nation} WHERE n_nationkey % 6 = 1
  UNION SELECT 'P' || n_nationkey, 'range', CASE WHEN n_nationkey % 3 <> 0 THEN 'C' || n_nationkey % 4 * 21 ELSE CASE n_nationkey % 4 WHEN 0 THEN 'xsd:integer' WHEN 1 THEN 'xsd:boolean' WHEN 2 THEN 'xsd:date' ELSE 'xsd:decimal' END END FROM {nation} WHERE n_nationkey % 8 <> 1""",
    "tree": f"SELECT 'C' || p_partkey AS child, 'C' || {_UP} AS parent FROM {{part}} WHERE p_partkey > 5",
    "subclasses": f"""SELECT 'C' || p_partkey AS child, 'C' || {_UP} AS parent FROM {{part}} WHERE p_partkey > 5 AND p_partkey % 21 > 0
  UNION SELECT 'C' || p_partkey, 'owl:Thing' FROM {{part}} WHERE p_partkey % 33 = 0
  UNION SELECT 'C' || CAST((p_partkey - p_partkey % 16) / 16 AS BIGINT), 'C' || p_partkey FROM {{part}} WHERE p_partkey % 50 = 0 AND p_partkey > 50""",
    "restrictions": """SELECT DISTINCT 'C' || p_partkey % 300 AS owner, 'P' || p_partkey % 30 AS prop, CASE p_partkey % 5 WHEN 0 THEN 'minCardinality' WHEN 1 THEN 'maxCardinality' WHEN 2 THEN 'cardinality' WHEN 3 THEN 'someValuesFrom' ELSE 'allValuesFrom' END AS kind,
  CASE WHEN p_partkey % 5 < 3 THEN CAST(p_partkey % 4 AS VARCHAR(9)) ELSE 'C' || p_partkey % 300 * 3 END AS value FROM {part}""",
    "nodes": "SELECT 'N' || o_orderkey AS node, 'C' || o_orderkey % 60 AS class FROM {orders} UNION SELECT 'M' || c_custkey, 'C' || c_custkey % 100 * 21 FROM {customer} WHERE c_custkey % 3 = 0",
    "values": """SELECT 'N' || l_orderkey AS node, 'P' || l_partkey % 25 AS prop, CASE l_linenumber WHEN 1 THEN 'M' || l_suppkey WHEN 2 THEN 'N' || l_orderkey * 3 WHEN 3 THEN CAST(l_partkey AS VARCHAR(9)) WHEN 4 THEN 'true' WHEN 5 THEN '1.5'
  WHEN 6 THEN '2024-02-30' ELSE '2024-02-29' END AS value FROM {lineitem}""",
}
_NAMES = ("part", "customer", "nation", "orders", "lineitem")


def _made(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    found = {n: table(spark, sf_dir, n) for n in _NAMES}
    return [spark.sql(TABLES[n], **{k: v for k, v in found.items() if f"{{{k}}}" in TABLES[n]}) for n in names]


def _with(*names: str) -> str:
    return ", ".join(f"{n}_ AS ({re.sub(r'[{](\w+)[}]', r'\1', TABLES[n])})" for n in names)


CLOSURE = """walk AS (SELECT child AS node, child AS ancestor, 0 AS distance FROM tree_ UNION SELECT parent, parent, 0 FROM tree_
  UNION SELECT w.node, s.parent, w.distance + 1 FROM walk w JOIN tree_ s ON s.child = w.ancestor), closure AS (SELECT node, ancestor, min(distance)::INTEGER AS distance FROM walk GROUP BY ALL)"""
_LINT = ("classes", "members", "props", "ends", "subclasses", "restrictions")


@query(f"""WITH RECURSIVE {_with(*_LINT)},
refs AS (SELECT child AS subject, 'subClassOf' AS predicate, parent AS term FROM subclasses_ UNION SELECT owner, 'onProperty', prop FROM restrictions_ UNION SELECT owner, kind, value FROM restrictions_ WHERE kind IN ('someValuesFrom', 'allValuesFrom')
  UNION SELECT prop, role, class FROM ends_ UNION SELECT prop, 'inverseOf', inverse FROM props_ WHERE inverse IS NOT NULL),
unknown AS (SELECT *, regexp_matches(term, '^(owl|rdfs|rdf|xsd|skos|dcterms):') AS outside FROM refs WHERE term NOT IN (SELECT class FROM classes_ UNION ALL SELECT member FROM members_ UNION ALL SELECT prop FROM props_)),
names AS (SELECT local, module FROM classes_ UNION SELECT local, module FROM members_ UNION SELECT local, module FROM props_),
enums AS (SELECT class, count(member) AS n, count(*) FILTER (member IS NOT NULL AND trim(coalesce(m.label, '')) = '') AS bare FROM classes_ LEFT JOIN members_ m USING (class) WHERE enum GROUP BY class),
terms AS (SELECT class AS term, label, comment FROM classes_ UNION ALL SELECT prop, label, comment FROM props_),
endless AS (SELECT prop, object, role FROM props_, (VALUES ('domain'), ('range')) r(role) WHERE NOT EXISTS (SELECT 1 FROM ends_ e WHERE e.prop = props_.prop AND e.role = r.role)),
spans AS (SELECT prop, p.module, list_sort(list(DISTINCT c.module) FILTER (role = 'domain')) AS d, list_sort(list(DISTINCT c.module) FILTER (role = 'range')) AS r FROM ends_ JOIN classes_ c USING (class) JOIN props_ p USING (prop) WHERE object GROUP BY ALL),
known AS (SELECT child, parent FROM subclasses_ WHERE child IN (SELECT class FROM classes_) AND parent IN (SELECT class FROM classes_)),
three AS (SELECT list_sort([a.child, a.parent, b.parent]) AS cycle, a.child AS m FROM known a JOIN known b ON b.child = a.parent JOIN known c ON c.child = b.parent AND c.parent = a.child),
reach AS (SELECT child AS a, parent AS b FROM known UNION SELECT r.a, k.parent FROM reach r JOIN known k ON k.child = r.b),
size AS (SELECT a, count(DISTINCT b) AS n FROM reach WHERE EXISTS (SELECT 1 FROM reach o WHERE o.a = reach.b AND o.b = reach.a) GROUP BY a)
SELECT CASE WHEN outside THEN 'I3' WHEN predicate = 'onProperty' THEN 'E2' ELSE 'E1' END AS "check", CASE WHEN outside THEN 'info' ELSE 'error' END AS severity, subject, predicate || ' ' || term AS detail FROM unknown
UNION ALL SELECT 'E3', 'error', local, array_to_string(list_sort(list(DISTINCT module)), ',') FROM names GROUP BY local HAVING count(DISTINCT module) > 1
UNION ALL SELECT DISTINCT 'E4', 'error', array_to_string(cycle, ','), n::VARCHAR FROM three JOIN size ON a = m
UNION ALL SELECT 'E5', 'error', class, '' FROM enums WHERE n = 0 UNION ALL SELECT 'W3', 'warn', class, n::VARCHAR FROM enums WHERE n > 12
UNION ALL SELECT 'E6', CASE WHEN object THEN 'error' ELSE 'warn' END, prop, role FROM endless
UNION ALL SELECT 'W1', 'warn', term, '' FROM terms WHERE trim(coalesce(label, '')) = '' UNION ALL SELECT 'W1', 'warn', class, bare || '/' || n FROM enums WHERE bare > 0
UNION ALL SELECT 'W2', 'warn', term, '' FROM terms WHERE trim(coalesce(comment, '')) = ''
UNION ALL SELECT 'W4', 'warn', class, '' FROM classes_ WHERE NOT enum AND class NOT IN (SELECT child FROM subclasses_)
UNION ALL SELECT 'W5', 'error', prop, owner || ' ' || kind || ' ' || value FROM restrictions_ JOIN props_ USING (prop) WHERE functional AND kind IN ('minCardinality', 'cardinality') AND value::INT > 1
UNION ALL SELECT 'W6', 'warn', p.prop, p.inverse FROM props_ p JOIN props_ q ON q.prop = p.inverse WHERE q.inverse IS DISTINCT FROM p.prop
UNION ALL SELECT 'I1', 'info', module, array_to_string(list_sort(list(prop)), ',') FROM spans WHERE len(d) > 0 AND len(r) > 0 AND (d <> r OR len(list_filter(d, lambda x: x <> module)) > 0) GROUP BY module
UNION ALL SELECT 'I2', 'info', module, count(*) FILTER (k = 'c') || '/' || count(*) FILTER (k = 'o') || '/' || count(*) FILTER (k = 'd') FROM (SELECT module, 'c' AS k FROM classes_ UNION ALL SELECT module, CASE WHEN object THEN 'o' ELSE 'd' END FROM props_) GROUP BY module""")
def c15_ontology_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.ontology_lint(*_made(spark, sf_dir, *_LINT))


@query(f"""WITH RECURSIVE {_with("props", "ends", "tree")}, {CLOSURE}, near AS (SELECT node AS class, prop, role, class AS owner, distance FROM ends_ JOIN closure ON ancestor = class
  QUALIFY row_number() OVER (PARTITION BY node, prop, role ORDER BY distance, class) = 1),
reach AS (SELECT prop, role, count(DISTINCT node) AS others FROM ends_ JOIN closure ON ancestor = class GROUP BY ALL)
SELECT class, CASE WHEN NOT object THEN 'data' WHEN n.role = 'domain' THEN 'out' ELSE 'in' END AS direction, prop, owner, distance > 0 AS inherited, others FROM near n JOIN props_ USING (prop) LEFT JOIN reach r ON r.prop = n.prop AND r.role <> n.role WHERE object OR n.role = 'domain'
UNION ALL SELECT '*', 'out', prop, '', false, others FROM props_ p LEFT JOIN reach r USING (prop) WHERE object AND coalesce(r.role, 'range') = 'range' AND prop NOT IN (SELECT prop FROM ends_ WHERE role = 'domain')""")
def g10_class_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    props, ends, tree = _made(spark, sf_dir, "props", "ends", "tree")
    return O.class_view(props, ends, G.ancestors(tree))


@query(f"""WITH RECURSIVE {_with("ends", "tree")}, {CLOSURE} SELECT DISTINCT prop, role, node AS class FROM ends_ JOIN closure ON ancestor = class""")
def g10_end_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends, tree = _made(spark, sf_dir, "ends", "tree")
    return O.end_closures(ends, G.ancestors(tree))


_SHAPES = ("nodes", "values", "classes", "members", "props", "ends", "restrictions")


@query(f"""WITH RECURSIVE {_with(*_SHAPES, "tree")}, {CLOSURE},
shapes AS (SELECT node AS class, prop, class AS origin FROM ends_ JOIN closure ON ancestor = class WHERE role = 'domain' QUALIFY row_number() OVER (PARTITION BY node, prop ORDER BY distance, class) = 1),
listed AS (SELECT DISTINCT prop, member FROM ends_ JOIN classes_ USING (class) JOIN members_ USING (class) WHERE role = 'range' AND enum),
firsts AS (SELECT prop, min(class) AS range, min(class) FILTER (starts_with(class, 'xsd:')) AS datatype FROM ends_ WHERE role = 'range' GROUP BY prop),
met AS (SELECT n.node, n.class, s.prop, origin, value, object, range, datatype, s.prop IN (SELECT prop FROM listed) AS listed FROM nodes_ n JOIN shapes s USING (class) JOIN props_ p ON p.prop = s.prop LEFT JOIN firsts f ON f.prop = s.prop JOIN values_ v ON v.node = n.node AND v.prop = s.prop),
b AS (SELECT node AS class, prop, owner, CASE WHEN kind IN ('minCardinality', 'cardinality') THEN value::INT WHEN kind = 'someValuesFrom' THEN 1 END AS low, CASE WHEN kind IN ('maxCardinality', 'cardinality') THEN value::INT END AS high FROM (SELECT owner, prop, kind, CASE WHEN kind LIKE '%ardinality' THEN value END AS value FROM restrictions_) JOIN closure ON ancestor = owner),
bounds AS (SELECT class, prop, max(low) AS low, min(high) AS high FROM b GROUP BY ALL),
counted AS (SELECT n.node, n.class, prop, low, high, (SELECT count(*) FROM values_ v WHERE v.node = n.node AND v.prop = bounds.prop) AS n FROM nodes_ n JOIN bounds USING (class) JOIN shapes s USING (class, prop))
SELECT node, prop, 'in' AS "constraint", origin, value AS detail FROM met WHERE listed AND NOT EXISTS (SELECT 1 FROM listed l WHERE l.prop = met.prop AND l.member = value)
UNION ALL SELECT node, prop, 'class', origin, value FROM met WHERE NOT listed AND object AND range IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nodes_ o JOIN closure c ON c.node = o.class WHERE o.node = met.value AND c.ancestor = met.range)
UNION ALL SELECT node, prop, 'datatype', origin, value FROM met WHERE NOT listed AND NOT object AND CASE datatype WHEN 'xsd:integer' THEN NOT regexp_full_match(value, '[+-]?[0-9]+') WHEN 'xsd:decimal' THEN try_cast(value AS DECIMAL(38, 9)) IS NULL
  WHEN 'xsd:boolean' THEN value NOT IN ('true', 'false', '0', '1') WHEN 'xsd:date' THEN try_cast(value AS DATE) IS NULL OR NOT regexp_full_match(value, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') ELSE false END
UNION ALL SELECT node, prop, 'minCount', (SELECT min(owner) FROM b WHERE b.class = counted.class AND b.prop = counted.prop AND b.low = counted.low), n::VARCHAR FROM counted WHERE n < low
UNION ALL SELECT node, prop, 'maxCount', (SELECT min(owner) FROM b WHERE b.class = counted.class AND b.prop = counted.prop AND b.high = counted.high), n::VARCHAR FROM counted WHERE n > high
UNION ALL SELECT node, '', 'in', class, node FROM nodes_ n JOIN classes_ USING (class) WHERE enum AND NOT EXISTS (SELECT 1 FROM members_ m WHERE m.class = n.class AND m.member = n.node)""")
def c17_shape_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _made(spark, sf_dir, *_SHAPES)
    return O.shape_violations(*made, G.ancestors(*_made(spark, sf_dir, "tree")))
