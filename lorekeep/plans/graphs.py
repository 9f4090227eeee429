"""Queries over closures, paths, components and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import graphs as G
from lorekeep.plans.fixtures import KB_PAGES, SUBCLASSES, kb_pages, subclasses, table
from lorekeep.plans.registry import query

#: DuckDB's closure: all parents, least distance.
CLOSURE = f"""{SUBCLASSES}, walk AS (
  SELECT child AS node, child AS ancestor, 0 AS distance FROM subclasses
  UNION SELECT parent, parent, 0 FROM subclasses
  UNION SELECT w.node, s.parent, w.distance + 1 FROM walk w JOIN subclasses s ON s.child = w.ancestor
), closure AS (SELECT node, ancestor, min(distance) AS distance FROM walk GROUP BY node, ancestor)"""


@query(f"WITH RECURSIVE {CLOSURE} SELECT * FROM closure")
def g1_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ancestors(subclasses(spark, sf_dir))


@query(f"WITH RECURSIVE {CLOSURE} SELECT ancestor AS node, count(*) - 1 AS descendants, max(distance) AS depth FROM closure GROUP BY ancestor")
def g1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    closure = G.ancestors(subclasses(spark, sf_dir))
    return closure.groupBy(F.col("ancestor").alias("node")).agg((F.count("*") - 1).alias("descendants"), F.max("distance").alias("depth"))


@query(f"""WITH RECURSIVE {CLOSURE} SELECT node, ancestor AS top FROM closure WHERE ancestor NOT IN (SELECT child FROM subclasses)
QUALIFY row_number() OVER (PARTITION BY node ORDER BY distance, ancestor) = 1""")
def g2_top_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = subclasses(spark, sf_dir)
    return G.top_ancestor(tree, G.ancestors(tree))


CHAINS = f"""{SUBCLASSES}, tree AS (SELECT child, parent FROM subclasses WHERE first), chain AS (
  SELECT child AS node, child AS ancestor, 0 AS distance FROM tree UNION SELECT parent, parent, 0 FROM tree
  UNION SELECT c.node, t.parent, c.distance + 1 FROM chain c JOIN tree t ON t.child = c.ancestor WHERE t.parent <> c.ancestor)"""


@query(f"""WITH RECURSIVE {CHAINS}, grps AS (SELECT p_partkey // 5 AS grp, p_partkey AS node, p_partkey % 5 = 0 AS first FROM part),
r AS (SELECT grp, ancestor, count(DISTINCT g.node) AS n, min(distance) FILTER (first) AS near FROM grps g JOIN chain c ON c.node = g.node GROUP BY grp, ancestor)
SELECT grp, ancestor AS common FROM r JOIN (SELECT grp, count(*) AS members FROM grps GROUP BY grp) USING (grp) WHERE n = members AND members > 1
QUALIFY row_number() OVER (PARTITION BY grp ORDER BY near, ancestor) = 1""")
def g3_common_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "part").select(
        F.expr("p_partkey div 5").alias("grp"), F.col("p_partkey").alias("node"), (F.col("p_partkey") % 5 == 0).alias("first"))
    return G.common_ancestor(groups, G.ancestors(subclasses(spark, sf_dir).where("first")))


@query("""WITH RECURSIVE d AS (SELECT doc_id, md5(text) AS k1, source || (doc_id // 40) AS k2 FROM documents),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM d a JOIN d b ON a.k1 = b.k1 OR a.k2 = b.k2),
walk AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT w.doc_id, l.b FROM walk w JOIN links l ON l.a = w.other)
SELECT doc_id, min(other) AS component FROM walk GROUP BY doc_id""")
def g4_connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("k1"), F.concat("source", F.expr("doc_id div 40")).alias("k2"))
    return G.key_components(rows, "doc_id", ["k1", "k2"])


@query(f"WITH RECURSIVE {CLOSURE} SELECT node, ancestor, distance FROM closure WHERE distance <= 4")
def g7_policy_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ancestors(subclasses(spark, sf_dir), depth=4)


@query(f"WITH RECURSIVE {CLOSURE} SELECT ancestor AS module, distance FROM closure WHERE node = (SELECT max(child) FROM subclasses) AND distance > 0")
def g12_module_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = subclasses(spark, sf_dir)
    return G.module_closure(tree, tree.agg(F.max("child").alias("node")))


@query(f"WITH RECURSIVE {CLOSURE} SELECT node AS module, distance FROM closure WHERE ancestor = 2 AND distance > 0")
def g12_module_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.module_closure(subclasses(spark, sf_dir), spark.range(2, 3).withColumnRenamed("id", "node"), downstream=True)


@query("""WITH RECURSIVE e AS (
  SELECT DISTINCT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders
  UNION SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem
  UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem),
w AS (SELECT 'c' || c_custkey AS start, 'c' || c_custkey AS last, 'c' || c_custkey AS path, 0 AS hops FROM customer WHERE c_nationkey = 7
  UNION ALL SELECT start, e.dst, path || '/' || e.dst, hops + 1 FROM w JOIN e ON e.src = w.last WHERE hops < 3)
SELECT start, path, hops FROM w WHERE hops > 0""")
def g6_k_hop_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    e = table(spark, sf_dir, "orders").select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"))
    e = e.unionByName(lines.select(name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst")))
    e = e.unionByName(lines.select(name("p", "l_partkey").alias("src"), name("s", "l_suppkey").alias("dst")))
    starts = table(spark, sf_dir, "customer").where("c_nationkey = 7").select(name("c", "c_custkey").alias("slug"))
    return G.k_hop_paths(e, starts, 3).withColumn("path", F.array_join("path", "/"))


PROPS = """props AS (SELECT 'p' || n_nationkey AS name, 'C' || n_regionkey AS domain, 'C' || (n_nationkey % 7) AS range FROM nation)"""


@query(f"""WITH RECURSIVE {PROPS}, step AS (SELECT domain AS a, range AS b, '>' || name AS via FROM props UNION SELECT range, domain, '<' || name FROM props),
w AS (SELECT ['C0'] AS path, []::VARCHAR[] AS rels, 0 AS hops UNION ALL
  SELECT list_append(path, b), list_append(rels, via), hops + 1 FROM w JOIN step ON a = path[-1] WHERE hops < 3 AND path[-1] <> 'C4' AND NOT list_contains(path, b)),
f AS (SELECT array_to_string(path, '/') AS path, array_to_string(rels, '/') AS relations, hops FROM w WHERE path[-1] = 'C4')
SELECT *, (SELECT count(*) FROM f) > 25 AS truncated FROM f ORDER BY hops, path, relations LIMIT 25""")
def g5_schema_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), "n_nationkey").alias("name"),
        F.concat(F.lit("C"), "n_regionkey").alias("domain"), F.concat(F.lit("C"), F.col("n_nationkey") % 7).alias("range"))
    return G.schema_paths(props, "C0", "C4", 3, 25)


BACK = f"""{SUBCLASSES}, looped AS (SELECT child, parent FROM subclasses UNION SELECT parent // 4, child FROM subclasses WHERE child % 50 = 0)"""


def _looped(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = subclasses(spark, sf_dir).select("child", "parent")
    back = tree.where("child % 50 = 0").select(F.expr("parent div 4").alias("child"), F.col("child").alias("parent"))
    return tree.unionByName(back)


@query(f"""WITH RECURSIVE {BACK}, w AS (SELECT child AS start, [child, parent] AS path, parent AS last FROM looped WHERE child <> parent
  UNION ALL SELECT start, list_append(path, parent), parent FROM w JOIN looped ON child = last
  WHERE last >= start AND parent <> start AND NOT list_contains(path, parent)),
c AS (SELECT DISTINCT list_sort(path) AS cycle FROM w JOIN looped ON child = last AND parent = start WHERE list_min(path) = start),
reach AS (SELECT child AS a, parent AS b FROM looped WHERE child <> parent UNION SELECT r.a, l.parent FROM reach r JOIN looped l ON l.child = r.b),
scc AS (SELECT a AS node, min(b) AS component, count(DISTINCT b)::INTEGER AS size FROM reach WHERE EXISTS (SELECT 1 FROM reach o WHERE o.a = reach.b AND o.b = reach.a) AND a IN (SELECT a FROM reach WHERE a = b) GROUP BY a)
SELECT component, size, array_to_string(cycle, ',') AS cycle, len(cycle)::INTEGER AS length FROM c JOIN scc ON node = cycle[1]
UNION ALL SELECT coalesce(component, child), coalesce(size, 1), child::VARCHAR, 1 FROM looped LEFT JOIN scc ON node = child WHERE child = parent""")
def g13_hierarchy_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.every_cycle(_looped(spark, sf_dir)).withColumn("cycle", F.array_join("cycle", ","))


@query(f"""WITH RECURSIVE {BACK}, reach AS (SELECT child AS a, parent AS b FROM looped WHERE child <> parent UNION SELECT r.a, l.parent FROM reach r JOIN looped l ON l.child = r.b)
SELECT x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY x.a HAVING count(*) > 1""")
def g13_strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.strong_components(_looped(spark, sf_dir))


@query(f"""WITH RECURSIVE {CLOSURE},
e AS (SELECT l_orderkey * 10 + l_linenumber AS edge_id, l_partkey AS src, 'r' || (l_linenumber % 6) AS rel, (l_partkey * 7 + l_suppkey) % 2500 AS dst FROM lineitem),
dom AS (SELECT * FROM (VALUES ('r0', 0), ('r1', 1), ('r2', 5), ('r3', 2)) t(rel, class)),
rng AS (SELECT * FROM (VALUES ('r0', 1), ('r1', 2), ('r4', 3)) t(rel, class)),
kin AS (SELECT node AS slug, list(ancestor) AS kinds FROM closure GROUP BY node),
x AS (SELECT e.*, a.kinds AS sk, b.kinds AS dk, (SELECT list(class) FROM dom WHERE dom.rel = e.rel) AS d, (SELECT list(class) FROM rng WHERE rng.rel = e.rel) AS r
  FROM e LEFT JOIN kin a ON a.slug = e.src LEFT JOIN kin b ON b.slug = e.dst)
SELECT edge_id, CASE WHEN sk IS NULL OR dk IS NULL THEN 'missing_page' WHEN d IS NULL AND r IS NULL THEN 'unknown_relation'
  WHEN (d IS NULL OR list_has_any(sk, d)) AND (r IS NULL OR list_has_any(dk, r)) THEN 'ok'
  WHEN (d IS NULL OR list_has_any(dk, d)) AND (r IS NULL OR list_has_any(sk, r)) THEN 'direction_reversed'
  WHEN NOT (d IS NULL OR list_has_any(sk, d)) THEN 'domain_mismatch' ELSE 'range_mismatch' END AS verdict FROM x""")
def g9_validate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), F.col("l_partkey").alias("src"),
        F.concat(F.lit("r"), F.col("l_linenumber") % 6).alias("rel"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 2500).alias("dst"))
    closure = G.ancestors(subclasses(spark, sf_dir))
    nodes = closure.select(F.col("node").alias("slug"), F.col("node").alias("class")).distinct()
    domains = spark.createDataFrame([("r0", 0), ("r1", 1), ("r2", 5), ("r3", 2)], "rel string, class bigint")
    ranges = spark.createDataFrame([("r0", 1), ("r1", 2), ("r4", 3)], "rel string, class bigint")
    return G.validate_edges(e, nodes, domains, ranges, closure)


FOLDERS = f"""{KB_PAGES}, cats AS (SELECT page_id, [kb_id, split_part(slug, '/', 1), 'g' || page_id % 3][1:1 + page_id % 3] AS c FROM kb_pages),
folders AS (SELECT array_to_string(c[1:i], '/') AS path, CASE WHEN i > 1 THEN array_to_string(c[1:i-1], '/') END AS parent, i::INTEGER AS depth,
  count(*) FILTER (i = len(c)) AS pages FROM cats, unnest(range(1, len(c) + 1)) u(i) GROUP BY ALL)"""


def _folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.element_at(F.split("slug", "/"), 1)
    cats = kb_pages(spark, sf_dir).select(F.slice(F.array("kb_id", lang, F.concat(F.lit("g"), F.col("page_id") % 3)), 1, (1 + F.col("page_id") % 3).cast("int")).alias("category_path"))
    return G.folder_tree(cats)


@query(f"WITH {FOLDERS} SELECT * FROM folders")
def g15_folder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folders(spark, sf_dir)


@query(f"WITH {FOLDERS} SELECT path, parent, (row_number() OVER (PARTITION BY parent ORDER BY path) - 1)::INTEGER AS place FROM folders")
def w4_sibling_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sibling_order(_folders(spark, sf_dir)).select("path", "parent", "place")


@query(f"""WITH RECURSIVE {CLOSURE} SELECT p_partkey AS page, p_name AS title FROM part WHERE p_partkey IN (SELECT node FROM closure WHERE ancestor = 5)""")
def p14_instances_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.range(5, 6).withColumnRenamed("id", "node")
    below = G.module_closure(subclasses(spark, sf_dir), key, downstream=True).select(F.col("module").alias("page")).unionByName(key.withColumnRenamed("node", "page"))
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), F.col("p_name").alias("title"))
    return pages.join(below, "page", "left_semi")


@query(f"""WITH RECURSIVE {CLOSURE}, {PROPS} SELECT DISTINCT name, c.node AS target FROM (SELECT name, substr(range, 2)::BIGINT AS r FROM props) p JOIN closure c ON c.ancestor = p.r""")
def g11_range_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), "n_nationkey").alias("name"), (F.col("n_nationkey") % 7).alias("ancestor"))
    return props.join(G.ancestors(subclasses(spark, sf_dir)), "ancestor").select("name", F.col("node").alias("target")).distinct()
