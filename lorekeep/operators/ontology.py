"""Lint of an ontology, views of its classes in both directions, and values checked by inherited shapes.

Tables: classes (class, module, local, label, comment, enum), members of enumerations (class, member, module, local,
label), props (prop, module, local, label, comment, object, functional, inverse), ends (prop, role: domain or range,
class), subclasses (child, parent), restrictions (owner, prop, kind, value).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.audits import findings
from lorekeep.operators.graphs import hierarchy_cycles, settled

#: Kinds of restriction whose value is a class, and those that count; fixed values.
OF_CLASS, COUNTED = ("someValuesFrom", "allValuesFrom"), ("minCardinality", "cardinality")
#: An enumeration of more members looks like data.
MOST_MEMBERS = 12
EXTERNAL = ("owl", "rdfs", "rdf", "xsd", "skos", "dcterms")


def _bare(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column), F.lit(""))) == ""


def references(subclasses: DataFrame, restrictions: DataFrame, ends: DataFrame, props: DataFrame) -> DataFrame:
    """subject, predicate, term: every mention of a term by another."""
    pick = lambda rows, subject, predicate, term: rows.select(F.col(subject).alias("subject"), predicate.alias("predicate"), F.col(term).alias("term"))
    parts = [
        pick(subclasses, "child", F.lit("subClassOf"), "parent"),
        pick(restrictions, "owner", F.lit("onProperty"), "prop"),
        pick(restrictions.where(F.col("kind").isin(*OF_CLASS)), "owner", F.col("kind"), "value"),
        pick(ends, "prop", F.col("role"), "class"),
        pick(props.where("inverse is not null"), "prop", F.lit("inverseOf"), "inverse"),
    ]
    return reduce(DataFrame.unionByName, parts).where("term is not null").distinct()


def ontology_lint(classes: DataFrame, members: DataFrame, props: DataFrame, ends: DataFrame, subclasses: DataFrame, restrictions: DataFrame) -> DataFrame:
    """E1 to E6, W1 to W6 and I1 to I3 of an ontology as findings.

    E1 undeclared terms, E2 restrictions on undeclared properties, E3 one local name in several modules, E4 cycles of
    parents, E5 enumerations without members, E6 properties without domain or range, W1 no label, W2 no comment, W3 large
    enumerations, W4 classes without parents, W5 functional properties that must have more values, W6 inverses that do
    not point back, I1 properties between modules, I2 what a module holds, I3 terms of other vocabularies.
    """
    declared = classes.select(F.col("class").alias("term")).union(members.select("member")).union(props.select("prop")).distinct()
    unknown = settled(references(subclasses, restrictions, ends, props).join(declared, "term", "left_anti"), "unknown-terms")
    outside = F.element_at(F.split("term", ":"), 1).isin(*EXTERNAL) & F.col("term").contains(":")
    dangling = F.col("predicate") == "onProperty"
    told = lambda rows, check, severity: findings(rows, check, severity, F.col("subject"), F.concat_ws(" ", "predicate", "term"))
    names = classes.select("local", "module").union(members.select("local", "module")).union(props.select("local", "module"))
    shared = names.groupBy("local").agg(F.array_sort(F.collect_set("module")).alias("modules")).where(F.size("modules") > 1)
    counts = members.groupBy("class").agg(F.count("*").alias("n"), F.count_if(_bare("label")).alias("bare"))
    enums = classes.where("enum").join(counts, "class", "left").fillna(0, ["n", "bare"])
    terms = classes.select(F.col("class").alias("term"), "label", "comment").union(props.select("prop", "label", "comment"))
    roots = classes.where(~F.col("enum")).join(subclasses.select(F.col("child").alias("class")), "class", "left_anti")
    sides = {role: ends.where(F.col("role") == role).select("prop").distinct() for role in ("domain", "range")}
    lacking = [props.join(side, "prop", "left_anti").withColumn("role", F.lit(role)) for role, side in sides.items()]
    endless = lacking[0].unionByName(lacking[1])
    strict = restrictions.where(F.col("kind").isin(*COUNTED) & (F.expr("try_cast(value AS int)") > 1))
    many = strict.join(props.where("functional").select("prop"), "prop")
    back = props.select(F.col("prop").alias("inverse"), F.col("inverse").alias("back"))
    unpaired = props.join(back, "inverse").where(~F.col("back").eqNullSafe(F.col("prop")))
    home = classes.select("class", F.col("module").alias("of"))
    spans = ends.join(home, "class").join(props.where("object").select("prop", "module"), "prop").groupBy("prop", "module").agg(
        F.array_sort(F.collect_set(F.when(F.col("role") == "domain", F.col("of")))).alias("d"), F.array_sort(F.collect_set(F.when(F.col("role") == "range", F.col("of")))).alias("r")
    )
    own = F.array("module")
    crossing = spans.where((F.size("d") > 0) & (F.size("r") > 0) & ((F.col("d") != F.col("r")) | (F.size(F.array_except("d", own)) > 0)))
    bridges = crossing.groupBy("module").agg(F.array_join(F.array_sort(F.collect_list("prop")), ",").alias("names"))
    held = classes.select("module", F.lit("c").alias("kind")).union(props.select("module", F.when(F.col("object"), "o").otherwise("d")))
    inventory = held.groupBy("module").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in "cod"])
    cycles = hierarchy_cycles(subclasses.join(classes.select(F.col("class").alias("child")), "child", "left_semi").join(classes.select(F.col("class").alias("parent")), "parent", "left_semi"))
    prop, name, none = F.col("prop"), F.col("class"), F.lit("")
    parts = [
        told(unknown.where(~outside & ~dangling), "E1", "error"), told(unknown.where(~outside & dangling), "E2", "error"), told(unknown.where(outside), "I3", "info"),
        findings(shared, "E3", "error", F.col("local"), F.array_join("modules", ",")),
        findings(cycles, "E4", "error", F.coalesce(F.array_join("cycle", ","), F.concat(F.lit("around "), "component")), F.col("size")),
        findings(enums.where("n = 0"), "E5", "error", name, none), findings(enums.where(F.col("n") > MOST_MEMBERS), "W3", "warn", name, F.col("n")),
        findings(endless.where("object"), "E6", "error", prop, F.col("role")), findings(endless.where("not object"), "E6", "warn", prop, F.col("role")),
        findings(terms.where(_bare("label")), "W1", "warn", F.col("term"), none), findings(enums.where("bare > 0"), "W1", "warn", name, F.concat_ws("/", "bare", "n")),
        findings(terms.where(_bare("comment")), "W2", "warn", F.col("term"), none), findings(roots, "W4", "warn", name, none),
        findings(many, "W5", "error", prop, F.concat_ws(" ", "owner", "kind", "value")), findings(unpaired, "W6", "warn", prop, F.col("inverse")),
        findings(bridges, "I1", "info", F.col("module"), F.col("names")), findings(inventory, "I2", "info", F.col("module"), F.concat_ws("/", "c", "o", "d")),
    ]
    return reduce(DataFrame.unionByName, parts)


def nearest_owners(ends: DataFrame, closure: DataFrame, role: str) -> DataFrame:
    """class, prop, owner, distance: properties whose ``role`` end is the class or one above it, by the nearest such end."""
    met = ends.where(F.col("role") == role).join(closure.select(F.col("node"), F.col("ancestor").alias("class"), "distance"), "class")
    best = F.min(F.struct("distance", F.col("class").alias("owner"))).alias("best")
    return met.groupBy(F.col("node").alias("class"), "prop").agg(best).select("class", "prop", "best.owner", "best.distance")


def class_view(props: DataFrame, ends: DataFrame, closure: DataFrame) -> DataFrame:
    """class, direction (out, in, data), prop, owner, inherited, others: what a class may have and may be pointed at by.

    ``others`` counts the classes the other end may be of: those of its end and all below; null where it has none.  A
    property that says no domain is open to all classes and has one row, for the class ``*``.
    """
    reach = end_closures(ends, closure).groupBy("prop", "role").agg(F.count("*").alias("others"))
    sides = []
    for role, other, direction in (("domain", "range", "out"), ("range", "domain", "in")):
        met = nearest_owners(ends, closure, role).join(props.select("prop", "object"), "prop")
        met = met.where("object") if direction == "in" else met
        met = met.join(reach.where(F.col("role") == other).select("prop", "others"), "prop", "left")
        way = F.when(F.col("object"), direction).otherwise("data")
        sides.append(met.select("class", way.alias("direction"), "prop", "owner", (F.col("distance") > 0).alias("inherited"), "others"))
    free = props.where("object").join(ends.where("role = 'domain'"), "prop", "left_anti").join(reach.where("role = 'range'").select("prop", "others"), "prop", "left")
    sides.append(free.select(F.lit("*").alias("class"), F.lit("out").alias("direction"), "prop", F.lit("").alias("owner"), F.lit(False).alias("inherited"), "others"))
    return reduce(DataFrame.unionByName, sides)


def end_closures(ends: DataFrame, closure: DataFrame) -> DataFrame:
    """prop, role, class: the classes that may stand at an end, those below the named ones included."""
    return ends.join(closure.select(F.col("ancestor").alias("class"), "node"), "class").select("prop", "role", F.col("node").alias("class")).distinct()


def fits_datatype(value: Column, datatype: Column) -> Column:
    """Whether a text is a value of the XSD type; types that are not known here take any."""
    number = F.expr("try_cast(value AS decimal(38, 9))").isNotNull()
    return (
        F.when(datatype == "xsd:integer", value.rlike(r"^[+-]?[0-9]+$")).when(datatype.isin("xsd:decimal", "xsd:double"), number)
        .when(datatype == "xsd:boolean", value.isin("true", "false", "0", "1")).when(datatype == "xsd:date", value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.expr("try_cast(value AS date)").isNotNull())
        .otherwise(True)
    )


def shape_violations(
    nodes: DataFrame, values: DataFrame, classes: DataFrame, members: DataFrame, props: DataFrame, ends: DataFrame, restrictions: DataFrame, closure: DataFrame
) -> DataFrame:
    """node, prop, constraint, origin, detail: a row for every constraint that a node (node, class) breaks.

    values: node, prop, value.  Properties are those whose domain is the node's class or one above; ``origin`` is the
    class that brings the constraint.  ``in`` a value that is no member of the range's enumeration, ``class`` one that is no
    node of the range's class (the least named one) or below, ``datatype`` one that is no such literal, ``minCount`` and
    ``maxCount`` by the tightest inherited bounds.  A node of an enumeration must be one of its members.
    """
    shapes = nearest_owners(ends, closure, "domain").select("class", "prop", F.col("owner").alias("origin"))
    ranges = ends.where("role = 'range'").join(classes.select("class", "enum"), "class", "left")
    listed = ranges.where("enum").join(members.select("class", "member"), "class").select("prop", F.col("member").alias("value")).distinct()
    enumerated = listed.select("prop").distinct().withColumn("listed", F.lit(True))
    first = ranges.groupBy("prop").agg(F.min("class").alias("range"), F.min(F.when(F.col("class").startswith("xsd:"), F.col("class"))).alias("datatype"))
    kinds = props.select("prop", "object").join(enumerated, "prop", "left").join(first, "prop", "left")
    asked = nodes.join(shapes, "class").join(kinds, "prop")
    met = settled(asked.join(values, ["node", "prop"]), "shape-values")
    broken = lambda rows, name, detail: rows.select("node", "prop", F.lit(name).alias("constraint"), "origin", detail.cast("string").alias("detail"))
    value = F.col("value")
    foreign = met.where("listed").join(listed, ["prop", "value"], "left_anti")
    typed = met.where("listed is null and object and range is not null")
    fine = typed.select("prop", "range", "value").distinct().join(nodes.select(F.col("node").alias("value"), "class"), "value")
    fine = fine.join(closure.select(F.col("node").alias("class"), F.col("ancestor").alias("range")), ["class", "range"]).select("prop", "range", "value").distinct()
    misplaced = typed.join(fine, ["prop", "range", "value"], "left_anti")
    unfit = met.where("listed is null and not object and datatype is not null").where(~fits_datatype(value, F.col("datatype")))
    bound = F.expr("try_cast(value AS int)")
    kind = F.col("kind")
    bounds = restrictions.select(
        F.col("owner").alias("ancestor"), "prop", F.when(kind.isin(*COUNTED), bound).when(kind == "someValuesFrom", 1).alias("low"), F.when(kind.isin("maxCardinality", "cardinality"), bound).alias("high")
    )
    inherited = closure.select(F.col("node").alias("class"), "ancestor").join(bounds, "ancestor").groupBy("class", "prop").agg(
        F.max("low").alias("low"), F.min("high").alias("high"),
        F.min(F.when(F.col("low").isNotNull(), F.struct((-F.col("low")).alias("n"), "ancestor"))).alias("lows"), F.min(F.when(F.col("high").isNotNull(), F.struct(F.col("high").alias("n"), "ancestor"))).alias("highs"),
    )
    numbers = values.groupBy("node", "prop").agg(F.count("*").alias("n"))
    counted = nodes.join(shapes.drop("origin"), "class").join(inherited, ["class", "prop"]).join(numbers, ["node", "prop"], "left").fillna(0, ["n"])
    few, many = counted.where("n < low").withColumn("origin", F.col("lows.ancestor")), counted.where("n > high").withColumn("origin", F.col("highs.ancestor"))
    strangers = nodes.join(classes.where("enum").select("class"), "class").join(members.select("class", F.col("member").alias("node")), ["class", "node"], "left_anti")
    parts = [
        broken(foreign, "in", value), broken(misplaced, "class", value), broken(unfit, "datatype", value), broken(few, "minCount", F.col("n")), broken(many, "maxCount", F.col("n")),
        strangers.select("node", F.lit("").alias("prop"), F.lit("in").alias("constraint"), F.col("class").alias("origin"), F.col("node").alias("detail")),
    ]
    return reduce(DataFrame.unionByName, parts)
