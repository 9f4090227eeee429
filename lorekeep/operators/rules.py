"""Rule sets over policy graphs, rule reports, rule lint and design shapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators.audits import findings
from lorekeep.operators.graphs import ancestors, settled
from lorekeep.operators.search import contained


def resolve_policies(policies: DataFrame, below: DataFrame, covers: DataFrame, depth: int = 4) -> DataFrame:
    """policy, rule: the rules of each asked policy and of all policies below it to ``depth``.

    policies: policy; below: (child, parent) policies; covers: (policy, rule), read in both directions before.
    """
    closure = ancestors(below, depth).select(F.col("ancestor").alias("policy"), F.col("node").alias("sub"))
    own = policies.select("policy", F.col("policy").alias("sub"))
    reach = closure.join(policies, "policy", "left_semi").unionByName(own).distinct()
    return reach.join(covers.withColumnRenamed("policy", "sub"), "sub").select("policy", "rule").distinct()


def sub_policy_alternatives(resolved: DataFrame, below: DataFrame) -> DataFrame:
    """policy, sub, missing: how many of a policy's rules a policy directly below it lacks; only where it does."""
    total = resolved.groupBy("policy").agg(F.count("*").alias("rules"))
    parts = below.select(F.col("parent").alias("policy"), F.col("child").alias("sub")).distinct()
    shared = parts.join(resolved, "policy").join(resolved.withColumnRenamed("policy", "sub"), ["sub", "rule"]).groupBy("policy", "sub").agg(F.count("*").alias("same"))
    joined = parts.join(total, "policy").join(shared, ["policy", "sub"], "left").fillna(0, ["same"])
    return joined.withColumn("missing", F.col("rules") - F.col("same")).where("missing > 0").select("policy", "sub", "missing")


def rule_replay(samples: DataFrame, threshold: float = 0.9) -> DataFrame:
    """n, consistency, false_claims, gate of samples (verdict, baseline, level): a negative verdict at a low level is a false claim."""
    one = samples.agg(
        F.count("*").alias("n"),
        F.avg((F.col("verdict") == F.col("baseline")).cast("double")).alias("consistency"),
        F.count_if((F.col("verdict") == "fail") & (F.col("level") == "low")).alias("false_claims"),
    )
    return one.withColumn("gate", F.when((F.col("consistency") >= threshold) & (F.col("false_claims") == 0), "pass").otherwise("review"))


def rule_report_stats(rows: DataFrame, rules: DataFrame, ingests: DataFrame) -> DataFrame:
    """rule, n, passed, missed, phantom, high, medium, low, absent: results by rule slug or title.

    rows: name, verdict, human, level, ingest; rules: rule, title; ingests: ingest.  A name that is no rule is a phantom;
    ``absent`` counts the distinct ingests that a rule's rows claim and that do not exist.
    """
    names = rules.select("rule", F.explode(F.array_distinct(F.array("rule", "title"))).alias("name"))
    known = ingests.select("ingest", F.lit(True).alias("known")).distinct()
    joined = rows.join(names, "name", "left").join(known, "ingest", "left")
    key = F.coalesce("rule", "name")
    levels = [F.count_if(F.col("level") == level).alias(level) for level in ("high", "medium", "low")]
    return joined.groupBy(key.alias("rule")).agg(
        F.count("*").alias("n"), F.count_if(F.col("verdict") == "pass").alias("passed"),
        F.count_if(F.col("human") & (F.col("verdict") == "pass")).alias("missed"), F.max(F.col("rule").isNull()).alias("phantom"),
        *levels, F.count_distinct(F.when(F.col("known").isNull(), F.col("ingest"))).alias("absent"),
    )


def rule_contracts(rules: DataFrame, covers: DataFrame) -> DataFrame:
    """rule, policies, definition, hash, applies_when: missing definitions fall back to the note, hashes are computed."""
    grouped = covers.groupBy("rule").agg(F.array_join(F.array_sort(F.collect_set("policy")), ",").alias("policies"))
    definition = F.coalesce(F.nullif(F.trim("definition"), F.lit("")), F.col("note"))
    computed = F.concat(F.lit("r-"), F.substring(F.sha1(definition.cast("binary")), 1, 6))
    return rules.join(grouped, "rule", "left").select(
        "rule", F.coalesce("policies", F.lit("")).alias("policies"), definition.alias("definition"),
        F.coalesce(F.nullif(F.col("hash"), F.lit("")), computed).alias("hash"), F.coalesce("applies_when", F.lit("always")).alias("applies_when"),
    )


def rule_lint(rules: DataFrame, vague: list[str]) -> DataFrame:
    """Findings of rules (rule, definition, mode, needs as JSON): missing fields, unknown mode, broken needs, vague or short words.

    needs: {"concepts": [{"id", "kind", "from": [ids]}]}; every id in ``from`` must be one of the ids.
    """
    shape = "struct<concepts:array<struct<id:string,kind:string,from:array<string>>>>"
    r = rules.withColumn("n", F.from_json("needs", shape)["concepts"]).withColumn("words", F.coalesce("definition", F.lit("")))
    ids = F.transform("n", lambda c: c["id"])
    used = F.flatten(F.transform("n", lambda c: F.coalesce(c["from"], F.array().cast("array<string>"))))
    loose = F.array_except(used, ids)
    vague_word = reduce(lambda a, b: a | b, [F.col("words").rlike(rf"\b{v}\b") for v in vague], F.lit(False)) & ~F.col("words").rlike(r"\d")
    parts = [
        findings(r.where(F.trim("words") == ""), "R1", "high", F.col("rule"), F.lit("no definition")),
        findings(r.where(~F.coalesce("mode", F.lit("")).isin("auto", "human", "mixed")), "R2", "high", F.col("rule"), F.col("mode")),
        findings(r.where(F.col("n").isNull()), "R3", "high", F.col("rule"), F.lit("needs")),
        findings(r.where(F.size(loose) > 0), "R4", "high", F.col("rule"), F.array_join(F.array_sort(loose), ",")),
        findings(r.where(vague_word), "R5", "low", F.col("rule"), F.lit("vague")),
        findings(r.where((F.trim("words") != "") & (F.length("words") < 10)), "R6", "low", F.col("rule"), F.lit("short")),
    ]
    return reduce(DataFrame.unionByName, parts)


def design_shapes(contracts: DataFrame, effects: DataFrame, entities: DataFrame, depends: DataFrame, uses: DataFrame, wants: DataFrame) -> DataFrame:
    """Findings on service contracts (contract, read_only, key, version).

    S1 a write without an idempotency key; S2 a read-only one with an effect (effects: contract, effect); S3 more than
    one entity (entities: contract, entity); S4 a key without a dependency (depends: contract, dependency); S5 attributes
    its rules constrain (wants: contract, attribute) and it neither takes nor gives (uses: contract, attribute); S6 a
    write without a version.
    """
    writes = contracts.where("not read_only")
    wide = entities.groupBy("contract").agg(F.count_distinct("entity").alias("n")).where("n > 1")
    loose = contracts.where("key is not null").join(depends.select("contract").distinct(), "contract", "left_anti")
    uncovered = wants.distinct().join(uses.select("contract", "attribute").distinct(), ["contract", "attribute"], "left_anti")
    parts = [
        findings(writes.where("key is null"), "S1", "high", F.col("contract"), F.lit("")), findings(effects.join(contracts.where("read_only"), "contract", "left_semi").distinct(), "S2", "high", F.col("contract"), F.col("effect")),
        findings(wide, "S3", "high", F.col("contract"), F.col("n")), findings(loose, "S4", "high", F.col("contract"), F.col("key")),
        findings(uncovered, "S5", "high", F.col("contract"), F.col("attribute")), findings(writes.where("version is null"), "S6", "medium", F.col("contract"), F.lit("")),
    ]
    return reduce(DataFrame.unionByName, parts)


def design_summary(uses: DataFrame) -> DataFrame:
    """attribute, writers, readers: which services write and read each attribute."""
    side = lambda e: F.array_join(F.array_sort(F.collect_set(F.when(F.col("effect") == e, F.col("service")))), ",")
    return uses.groupBy("attribute").agg(side("out").alias("writers"), side("in").alias("readers"))


def module_identity(classes: DataFrame, modules: DataFrame) -> DataFrame:
    """class, problem: the short name in a class differs from its module's, or the module is unknown."""
    joined = classes.join(modules.select("module", F.col("short").alias("declared")), "module", "left")
    problem = F.when(F.col("declared").isNull(), "unknown module").when(F.col("declared") != F.col("short"), "short name")
    return joined.withColumn("problem", problem).where("problem is not null").select("class", "problem")


def prefix_drift(artifacts: DataFrame, registry: DataFrame, built_in: DataFrame) -> DataFrame:
    """module, prefix, expected, origin where an artifact's prefix (module, prefix) is not the registered one, or the built-in one of a module that is not registered."""
    named = lambda table, name: table.select("module", F.nullif(F.trim("prefix"), F.lit("")).alias(name))
    joined = named(artifacts, "prefix").join(named(registry, "registered"), "module", "left").join(named(built_in, "built"), "module", "left")
    expected = F.coalesce("registered", "built")
    drift = joined.withColumn("expected", expected).where("prefix != expected")
    return drift.select("module", "prefix", "expected", F.when(F.col("registered").isNotNull(), "registry").otherwise("built-in").alias("origin"))


def graph_audit(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """slug, problem of pages and nodes (slug, page_type, body): missing_instance, orphan_instance, type_mismatch, content_mismatch."""
    n = nodes.select("slug", F.col("page_type").alias("node_type"), F.col("body").alias("node_body"), F.lit(True).alias("in_graph"))
    both = pages.select("slug", "page_type", "body", F.lit(True).alias("in_wiki")).join(n, "slug", "full_outer")
    problem = (
        F.when(F.col("in_graph").isNull(), "missing_instance").when(F.col("in_wiki").isNull(), "orphan_instance")
        .when(~F.col("page_type").eqNullSafe(F.col("node_type")), "type_mismatch").when(~F.col("body").eqNullSafe(F.col("node_body")), "content_mismatch")
    )
    return both.withColumn("problem", problem).where("problem is not null").select("slug", "problem")


def project_nodes(pages: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes rebuilt from pages (slug, page_type, body, attrs) and the edges that keep both ends; others are dropped."""
    built = pages.select("slug", "page_type", "body", "attrs")
    gone = nodes.join(built.select("slug"), "slug", "left_anti").select("slug")
    kept = edges.join(gone.withColumnRenamed("slug", "src"), "src", "left_anti").join(gone.withColumnRenamed("slug", "dst"), "dst", "left_anti")
    return built, kept


#: Pointers that can be read back, by kind; fixed values.
RESOLVERS = ("doc", "page", "sheet", "url", "graph")
#: Relations between tasks and data objects; fixed values.
_USES, _BELONGS = "taskUsesDataObject", "dataObjectBelongsToTask"


def task_io(tasks: DataFrame, pages: DataFrame, classes: DataFrame, edges: DataFrame, rules: DataFrame, resolvers: tuple[str, ...] = RESOLVERS) -> DataFrame:
    """Findings on the entry and exit lines of tasks (slug, is_task, entry, exit).

    Lines end at ``;`` or a line break; ``#`` opens a comment.  TIO0 no known form, TIO1 a data object that is not
    named or has no page (pages: slug), TIO2 a wrong pointer or one that nothing reads back, TIO3 a class that is not
    named or unknown (classes: class; an unknown closure keyword counts as part of the name), TIO5 a rule that is not
    found (rules: rule), TIO6 a data object without its edge (edges: src, rel, dst), TIO9 prose from older times.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.coalesce(side, F.lit("")).alias("body")) for side in ("entry", "exit")])).alias("s")
    split = tasks.select("slug", "is_task", sides).select("slug", "is_task", "s.side", F.explode(F.split("s.body", r"[;\n]+")).alias("line"))
    lines = split.select("slug", "is_task", "side", F.trim("line").alias("line")).where("line != '' and not startswith(line, '#')")
    lines = lines.withColumn("expr", F.regexp_extract("line", r"(?:^|\s)rules=(\S+)", 1)).withColumn("head", F.trim(F.regexp_extract("line", r"^(.*?)(?:(?:^|\s)rules=\S+|$)", 1)))
    kind = F.regexp_extract("head", r"^(dataobject|text|ontology):", 1)
    lines = lines.withColumn("kind", kind).withColumn("target", F.when(kind != "", F.trim(F.regexp_replace("head", r"^[a-z]+:", ""))))
    where = F.concat_ws(": ", "side", "target")

    objects = lines.where("kind = 'dataobject'").join(pages.select(F.col("slug").alias("target")).distinct().withColumn("there", F.lit(True)), "target", "left")
    lost = findings(objects.where("target = '' or there is null"), "TIO1", "high", F.col("slug"), where)
    wanted = objects.where("target != '' and there and is_task").select(
        "slug", "side", "target", F.when(F.col("side") == "entry", F.col("slug")).otherwise(F.col("target")).alias("src"),
        F.when(F.col("side") == "entry", _USES).otherwise(_BELONGS).alias("rel"), F.when(F.col("side") == "entry", F.col("target")).otherwise(F.col("slug")).alias("dst"),
    )
    bare = findings(wanted.join(edges.select("src", "rel", "dst"), ["src", "rel", "dst"], "left_anti"), "TIO6", "medium", F.col("slug"), where)

    pointer = T.parse_locator(F.col("target"))
    texts = lines.where("kind = 'text'").withColumn("error", pointer["error"]).withColumn("of", pointer["kind"])
    wrong = findings(texts.where("error is not null"), "TIO2", "high", F.col("slug"), where)
    unread = findings(texts.where(F.col("error").isNull() & ~F.col("of").isin(*resolvers)), "TIO2", "medium", F.col("slug"), where)

    name = F.regexp_replace("target", ":closure=(self|descendants|ancestors)$", "")
    named = lines.where("kind = 'ontology'").withColumn("class", name).join(classes.select("class").distinct().withColumn("known", F.lit(True)), "class", "left")
    unknown = findings(named.where("class = '' or known is null"), "TIO3", "high", F.col("slug"), where)

    asked = lines.where("expr != ''").select("slug", "side", F.explode(F.split("expr", r"[,|+]")).alias("rule")).where("rule != ''")
    lacking = findings(asked.join(rules.select("rule"), "rule", "left_anti"), "TIO5", "medium", F.col("slug"), F.concat_ws(": ", "side", "rule"))

    other = lines.where("kind = ''")
    prose = ~F.col("head").rlike("^[a-z_]+:") & (F.length("head") > 12)
    said = F.concat_ws(": ", "side", F.substring("head", 1, 120))
    old, odd = findings(other.where(prose), "TIO9", "medium", F.col("slug"), said), findings(other.where(~prose), "TIO0", "high", F.col("slug"), said)
    return reduce(DataFrame.unionByName, [lost, bare, wrong, unread, unknown, lacking, old, odd])


def blocking(found: DataFrame, stage: str = "handoff") -> DataFrame:
    """The findings that stop a stage: none of a draft, the high ones of a handoff."""
    return found.where((F.col("severity") == "high") & F.lit(stage == "handoff"))


#: What separates needs, and where a fact of each kind comes from; fixed values.
NEED_ENDS = r"[、,，;；/]+"
FACT_SOURCE = {"class": "graph", "image": "image", "text": "doc_text", "table": "doc_table", "external": "external_query"}
_SPEC = "struct<concepts:array<struct<id:string,kind:string,class:string,note:string,dataobject:string,collect:string>>,derived:array<struct<id:string>>>"


def plan_items(rules: DataFrame, classes: DataFrame, objects: DataFrame, chains: DataFrame, most: int = 5) -> DataFrame:
    """key, need, source, source_type, object, class, candidates, collect, module, rules, question: what rules need to know.

    rules: rule, need (JSON with ``concepts``, or words); classes: class, label, module; objects: slug, title,
    definition; chains: node, ancestor, distance over first parents.  A declared concept is an item of its rule.  A word
    is one item of all rules that name it: an object outside whose title or definition holds it, else the ``most``
    classes whose label it equals, holds or stands in.  Where all such classes have one parent on their chains that is
    among an item's candidates or above its first, the item is collected there.
    """
    spec = F.from_json("need", _SPEC)
    read = settled(rules.select("rule", "need", F.when(F.ltrim("need").startswith("{"), spec).alias("spec")), "rule-needs")
    told = F.coalesce(F.size("spec.concepts"), F.lit(0)) > 0
    concepts = read.where(told).select("rule", F.explode("spec.concepts").alias("c")).where("coalesce(c.id, '') != ''")
    kind = F.coalesce("c.kind", F.lit("class"))
    source_type = F.coalesce(F.create_map(*[F.lit(x) for pair in FACT_SOURCE.items() for x in pair])[kind], F.lit("unknown"))
    modules = classes.select("class", "module")
    declared = concepts.select(
        F.concat_ws(":", "rule", "c.id").alias("key"), F.coalesce(F.nullif("c.note", F.lit("")), F.col("c.id")).alias("need"), F.when(kind == "external", "external").otherwise("ontology").alias("source"), source_type.alias("source_type"),
        F.coalesce("c.dataobject", F.lit("")).alias("object"), F.col("c.class").cast(classes.schema["class"].dataType).alias("class"), F.lit("").alias("candidates"), F.coalesce("c.collect", F.lit("each")).alias("collect"), "rule",
    ).dropDuplicates(["key"]).join(modules, "class", "left").withColumnRenamed("rule", "rules").withColumn("question", F.lit(""))

    words = read.where(~told).select("rule", F.explode(F.split(F.coalesce("need", F.lit("")), NEED_ENDS)).alias("need")).select("rule", F.trim("need").alias("need")).where("need != ''")
    needs = settled(words.groupBy("need").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules")), "needs")
    hay = objects.select(F.col("slug").alias("whole_id"), F.concat_ws(" ", "title", "definition").alias("whole"))
    outside = contained(needs.select(F.col("need").alias("part_id"), F.col("need").alias("part")), hay).groupBy(F.col("part_id").alias("need")).agg(F.min("whole_id").alias("object"))
    inside = settled(needs.join(outside, "need", "left_anti").withColumn("t", F.trim(F.lower(F.regexp_replace("need", r"[（(].*?[）)]", "")))), "inner-needs")
    labels = settled(classes.select("class", F.lower("label").alias("label")).where("label != ''"), "labels")
    keys = inside.where("t != ''").select(F.col("need").alias("id"), "t")
    a = contained(keys.select(F.col("id").alias("part_id"), F.col("t").alias("part")), labels.select(F.col("class").alias("whole_id"), F.col("label").alias("whole")))
    b = contained(labels.select(F.col("class").alias("part_id"), F.col("label").alias("part")), keys.select(F.col("id").alias("whole_id"), F.col("t").alias("whole")))
    pairs = a.select(F.col("part_id").alias("need"), F.col("whole_id").alias("class")).unionByName(b.select(F.col("whole_id").alias("need"), F.col("part_id").alias("class"))).distinct()
    scored = pairs.join(labels, "class").join(inside.select("need", "t"), "need").withColumn("score", F.when(F.col("label") == F.col("t"), 100).otherwise(60))
    place = F.row_number().over(Window.partitionBy("need").orderBy(F.desc("score"), "class"))
    stated = settled(scored.withColumn("place", place).where(F.col("place") <= most).select("need", "class"), "stated")

    # the common parent of all stated classes: one row at most
    reach = stated.select(F.col("class").alias("node")).distinct().join(chains, "node")
    total = stated.agg(F.count_distinct("class").alias("n"), F.min("class").alias("first"))
    near = reach.crossJoin(F.broadcast(total)).groupBy("ancestor").agg(F.count_distinct("node").alias("met"), F.max("n").alias("n"), F.min(F.when(F.col("node") == F.col("first"), F.col("distance"))).alias("near"))
    merged = near.where("met = n and n > 1").agg(F.min(F.struct("near", "ancestor"))["ancestor"].alias("merged"))
    lists = stated.groupBy("need").agg(F.array_sort(F.collect_set("class")).alias("cs")).withColumn("lead", F.get("cs", 0))
    above = chains.select(F.col("node").alias("lead"), F.col("ancestor").alias("merged"), F.lit(True).alias("above"))
    picked = lists.crossJoin(F.broadcast(merged)).join(above, ["lead", "merged"], "left")
    fits = F.col("merged").isNotNull() & (F.array_contains("cs", F.col("merged")) | F.coalesce("above", F.lit(False)))
    picked = picked.select("need", "cs", F.when(fits, F.col("merged")).otherwise(F.col("lead")).alias("class"))
    items = needs.join(outside, "need", "left").join(picked, "need", "left").join(modules, "class", "left")
    several, external = F.size("cs") > 1, F.col("object").isNotNull()
    question = F.when(external, "").when(F.col("cs").isNull(), "class_ambiguous").when(several, "merge_parent_child").otherwise("")
    worded = items.select(
        F.col("need").alias("key"), "need", F.when(external, "external").otherwise("ontology").alias("source"), F.lit("").alias("source_type"), F.coalesce("object", F.lit("")).alias("object"), "class",
        F.coalesce(F.array_join(F.transform("cs", lambda c: c.cast("string")), ","), F.lit("")).alias("candidates"), F.when(several, "parent").otherwise("each").alias("collect"), "module", "rules", question.alias("question"),
    )
    return declared.select(*worded.columns).unionByName(worded)


def derived_rules(rules: DataFrame) -> DataFrame:
    """rule, derived: what a rule's JSON need derives, with its origin."""
    spec = F.from_json("need", _SPEC)
    return rules.where(F.ltrim("need").startswith("{")).select("rule", F.explode(spec["derived"]).alias("d")).select("rule", F.col("d.id").alias("derived"))
