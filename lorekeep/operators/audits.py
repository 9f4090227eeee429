"""Audit checks: each gives findings (check, severity, subject, detail); counts and orders of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators.graphs import settled
from lorekeep.operators.pages import is_instance
from lorekeep.operators.vectors import jaccard_sums

SEVERITY = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}


def findings(rows: DataFrame, check: str, severity: str, subject: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])[severity], F.lit(len(SEVERITY)))


def order_findings(found: DataFrame) -> DataFrame:
    return found.orderBy(severity_rank(F.col("severity")), "check", "subject", "detail")


def finding_counts(found: DataFrame) -> DataFrame:
    """Totals per check and severity, before any cap."""
    return found.groupBy("check", "severity").agg(F.count("*").alias("n"))


def capped(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` findings of each check by subject."""
    place = F.row_number().over(Window.partitionBy("check").orderBy("subject", "detail"))
    return found.withColumn("place", place).where(F.col("place") <= most).drop("place")


def edge_checks(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A1 dangling, A5 duplicate edges and self loops of (src, rel, dst)."""
    grouped = edges.groupBy("src", "rel", "dst").agg(F.count("*").alias("n"))
    name = F.concat_ws(" ", "src", "rel", "dst")
    dangling = grouped.join(nodes.select(F.col("slug").alias("dst")), "dst", "left_anti")
    return findings(dangling, "A1", "high", name, F.col("n")).unionByName(
        findings(grouped.where("n > 1"), "A5", "low", name, F.col("n"))
    ).unionByName(findings(grouped.where("src = dst"), "A5", "medium", name, F.lit("loop")))


def provenance_checks(index: DataFrame, pages: DataFrame, sessions: DataFrame, nodes: DataFrame) -> DataFrame:
    """C1 to C4 of pages (kb_id, slug, page_type, source_refs, content, imported) by what they come from.

    C1 an instance page without references and without a session (sessions: slug), unless it was imported; C2 a page by
    the worst state of its sources (missing before deleted); C3 another page that claims a source and has none; C4 nodes
    (node, knowledge_id, source_doc) that come from nowhere.
    """
    bare = pages.where(F.size(F.coalesce("source_refs", F.array().cast("array<bigint>"))) == 0).join(sessions.select("slug").distinct(), "slug", "left_anti")
    claims = F.coalesce("content", F.lit("")).rlike("（来源[:：]") | F.coalesce("content", F.lit("")).contains("<sources>")
    worst = index.where("status != 'live'").groupBy("kb_id", "slug").agg(F.max("status").alias("status"), F.count("*").alias("n"))
    parts = [
        findings(bare.where(is_instance(F.col("page_type")) & ~F.coalesce("imported", F.lit(False))), "C1", "high", F.col("slug"), F.when(claims, "no source, but claimed").otherwise("no source")),
        findings(worst, "C2", "high", F.col("slug"), F.concat_ws(":", "status", "n")),
        findings(bare.where(~is_instance(F.col("page_type")) & claims), "C3", "low", F.col("slug"), F.lit("claimed")),
        findings(nodes.where("knowledge_id is null and source_doc is null"), "C4", "medium", F.col("node"), F.lit("no source")),
    ]
    return reduce(DataFrame.unionByName, parts)


def cardinality_checks(values: DataFrame, bounds: DataFrame, closure: DataFrame) -> DataFrame:
    """node, prop, n, verdict (too_few, too_many) of values (node, class, prop) by bounds (class, prop, low, high).

    Bounds are inherited; the narrowest counts.  A node without any value of a bound property has none.
    """
    nodes = values.select("node", "class").distinct()
    inherited = closure.select(F.col("node").alias("class"), F.col("ancestor")).join(bounds.withColumnRenamed("class", "ancestor"), "ancestor")
    narrowed = inherited.groupBy("class", "prop").agg(F.max("low").alias("low"), F.min("high").alias("high"))
    counts = values.where("prop is not null").groupBy("node", "prop").agg(F.count("*").alias("n"))
    joined = nodes.join(narrowed, "class").join(counts, ["node", "prop"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    verdict = F.when(F.col("n") < F.col("low"), "too_few").when(F.col("n") > F.col("high"), "too_many")
    return joined.withColumn("verdict", verdict).where("verdict is not null").select("node", "prop", "n", "verdict")


def holding_checks(holdings: DataFrame, entities: DataFrame) -> DataFrame:
    """O1 percent outside 0..100, O2 half or more without control, O3 an entity (entity, controller) without a last
    controller, O4 no date, O5 self holding (holder, held, percent, control, as_of)."""
    name = F.concat_ws(">", "holder", "held")
    parts = [
        findings(holdings.where("percent < 0 or percent > 100"), "O1", "high", name, F.round("percent", 2)),
        findings(holdings.where("percent >= 50 and not control"), "O2", "medium", name, F.round("percent", 2)),
        findings(entities.where("controller is null"), "O3", "low", F.col("entity"), F.lit("")),
        findings(holdings.where("as_of is null"), "O4", "low", name, F.lit("")),
        findings(holdings.where("holder = held"), "O5", "high", name, F.lit("")),
    ]
    return reduce(DataFrame.unionByName, parts)


def crud_matrix(uses: DataFrame, keys: DataFrame) -> DataFrame:
    """service, attribute, key_role, C, R, U, D, written: how many operations of each kind (service, operation, attribute,
    kinds) touch an attribute, and its role as a key (keys: attribute, role)."""
    each = uses.select("service", "operation", "attribute", F.explode(F.split(F.upper("kinds"), "")).alias("kind")).where("kind != ''").distinct()
    counts = each.groupBy("service", "attribute").pivot("kind", ["C", "R", "U", "D"]).agg(F.count(F.lit(1))).fillna(0)
    roles = keys.groupBy("attribute").agg(F.max(F.upper(F.trim("role"))).alias("key_role"))
    out = counts.join(roles, "attribute", "left").withColumn("key_role", F.coalesce("key_role", F.lit("")))
    return out.withColumn("written", (F.col("C") + F.col("U") + F.col("D")) > 0).select("service", "attribute", "key_role", "C", "R", "U", "D", "written")


def crud_totals(matrix: DataFrame) -> DataFrame:
    """service, attributes, written, read_only, keys of the matrix."""
    return matrix.groupBy("service").agg(F.count("*").alias("attributes"), F.count_if("written").alias("written"), F.count_if(~F.col("written")).alias("read_only"), F.count_if(F.col("key_role") != "").alias("keys"))


def write_conflicts(uses: DataFrame) -> DataFrame:
    """E1: attributes that several services write, with the services."""
    writes = uses.where(F.col("kinds").rlike("[CUD]")).groupBy("attribute").agg(F.array_sort(F.collect_set("service")).alias("services"))
    return findings(writes.where(F.size("services") > 1), "E1", "medium", F.col("attribute"), F.array_join("services", ","))


def service_design(services: DataFrame, operations: DataFrame, uses: DataFrame, depends: DataFrame, keys: DataFrame, refs: DataFrame) -> DataFrame:
    """Findings on services by what their operations do to attributes.

    services: service; operations: service, operation, method, idempotent, retry; uses: operation, attribute, kinds
    (letters of CRUD); depends: operation, needs (an operation); keys: attribute, role; refs: attribute, target.
    E1 an attribute with several writers; E2 a service that reads what only others write, low if one of its operations
    depends on one of theirs, else medium; E3 a service without operations, an operation without attributes or method,
    a write that is not idempotent and has no retry; E4 a foreign key without a target, or one whose target is no key.
    """
    uses = uses.withColumn("kinds", F.upper(F.coalesce("kinds", F.lit(""))))
    owned = uses.join(operations.select("operation", "service"), "operation").select("service", "attribute", "kinds")
    writers = owned.where(F.col("kinds").rlike("[CUD]")).select("attribute", F.col("service").alias("writer")).distinct()
    readers = owned.where(F.col("kinds").contains("R")).select("attribute", "service").distinct()
    outside = readers.join(writers.withColumnRenamed("writer", "service"), ["attribute", "service"], "left_anti").join(writers.select("attribute").distinct(), "attribute", "left_semi")
    of = operations.select("operation", "service")
    through = depends.join(of, "operation").join(of.select(F.col("operation").alias("needs"), F.col("service").alias("writer")), "needs").select("service", "writer").distinct()
    declared = outside.join(writers, "attribute").join(through, ["service", "writer"], "left_semi").select("attribute", "service").distinct()
    told = lambda rows: rows.groupBy("attribute").agg(F.array_join(F.array_sort(F.collect_set("service")), ",").alias("who"))
    direct = outside.join(declared, ["attribute", "service"], "left_anti")

    bare = services.join(operations.select("service").distinct(), "service", "left_anti")
    touched = uses.select("operation").distinct()
    idle = operations.join(touched, "operation", "left_anti")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    writes = uses.where(F.col("kinds").rlike("[CUD]")).select("operation").distinct()
    risky = operations.where((F.lower(F.trim("idempotent")) == "false") & blank("retry")).join(writes, "operation", "left_semi")

    roles = keys.select("attribute", F.upper(F.trim(F.coalesce("role", F.lit("")))).alias("role"))
    loose = roles.where("role = 'FK'").join(refs.select("attribute").distinct(), "attribute", "left_anti")
    aimed = refs.join(roles.select(F.col("attribute").alias("target"), F.col("role").alias("kind")), "target", "left")
    parts = [
        write_conflicts(owned), findings(told(declared), "E2", "low", F.col("attribute"), F.concat(F.lit("declared "), "who")), findings(told(direct), "E2", "medium", F.col("attribute"), F.concat(F.lit("direct "), "who")),
        findings(bare, "E3", "low", F.col("service"), F.lit("no operations")), findings(idle, "E3", "medium", F.col("operation"), F.lit("no attributes")),
        findings(operations.where(blank("method")), "E3", "low", F.col("operation"), F.lit("no method")), findings(risky, "E3", "low", F.col("operation"), F.lit("no retry")),
        findings(loose, "E4", "medium", F.col("attribute"), F.lit("no target")), findings(aimed.where("kind is null"), "E4", "medium", F.col("attribute"), F.concat(F.lit("missing "), "target")),
        findings(aimed.where("kind not in ('PK', 'UNIQUE')"), "E4", "medium", F.col("attribute"), F.concat(F.lit("no key "), "target")),
    ]
    return reduce(DataFrame.unionByName, parts)


def replica_state(masters: DataFrame, replicas: DataFrame) -> DataFrame:
    """slug, state: local_drift, outdated, in_sync, unbound or master_missing of replicas (slug, hash, synced_hash, synced_version)."""
    m = masters.select("slug", F.col("version").alias("master_version"))
    joined = replicas.join(m, "slug", "left")
    state = (
        F.when(F.col("synced_version").isNull(), "unbound").when(F.col("master_version").isNull(), "master_missing")
        .when(F.col("hash") != F.col("synced_hash"), "local_drift").when(F.col("synced_version") < F.col("master_version"), "outdated").otherwise("in_sync")
    )
    return joined.select("slug", state.alias("state"))


def canonical(value: Column) -> Column:
    """A value without blanks around it; JSON objects and lists with their keys in order."""
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    return F.coalesce(F.when(text.rlike(r"^[\[{]"), F.to_json(F.try_parse_json(text))), text)


def attribute_drift(pages: DataFrame, nodes: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """slug, missing, keys: attributes of a page (slug, attrs) whose node (slug, attrs) has another value; a page without
    a node is reported so.  Keys count without their prefix, but for those in ``skip``; values in canonical form."""
    key = F.element_at(F.split("key", ":"), -1)
    x = pages.select("slug", F.explode("attrs").alias("key", "value")).select("slug", key.alias("key"), canonical(F.col("value")).alias("va")).where(F.col("key") != "").where(~F.col("key").isin(*skip))
    y = nodes.select("slug", F.explode("attrs").alias("key", "value")).select("slug", "key", canonical(F.col("value")).alias("vb"))
    differ = x.join(y, ["slug", "key"], "left").where(F.col("va") != F.coalesce("vb", F.lit("")))
    keys = differ.groupBy("slug").agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("keys"))
    joined = pages.select("slug").join(nodes.select("slug", F.lit(True).alias("there")), "slug", "left").join(keys, "slug", "left")
    absent = F.col("there").isNull()
    return joined.where(absent | F.col("keys").isNotNull()).select("slug", absent.alias("missing"), F.when(~absent, F.col("keys")).alias("keys"))


def three_way_drift(meta: DataFrame, graph: DataFrame, body: DataFrame, summaries: DataFrame, carriers: tuple[str, ...] = ()) -> DataFrame:
    """slug, key, source, value, drift of three carriers (slug, key, value) of attributes.

    A page's values come from its metadata if it has any there, else from the graph, else from the body.  A key drifts
    if its values differ, or if it is the one that a page's summary (slug, key, value) tells and the summary is not its
    only value.  Blank values are none, and keys that carry the body itself (``carriers``) are left out.
    """
    names = ("meta", "graph", "body")
    tagged = [t.select("slug", "key", F.lit(n).alias("carrier"), F.trim("value").alias("value")) for n, t in enumerate((meta, graph, body))]
    every = reduce(DataFrame.unionByName, tagged).where("coalesce(value, '') != ''").where(~F.col("key").isin(*carriers))
    first = every.groupBy("slug").agg(F.min("carrier").alias("first"))
    told = summaries.select("slug", "key", F.nullif(F.trim("value"), F.lit("")).alias("summary")).where("summary is not null")
    keys = every.join(first, "slug").groupBy("slug", "key").agg(
        F.max(F.when(F.col("carrier") == F.col("first"), F.col("value"))).alias("value"), F.min("value").alias("low"), F.max("value").alias("high"))
    joined = keys.join(told, ["slug", "key"], "full_outer").join(first, "slug", "left")
    differs = F.coalesce(F.col("low") != F.col("high"), F.lit(False))
    untold = F.col("summary").isNotNull() & ~(F.col("low").eqNullSafe(F.col("summary")) & F.col("high").eqNullSafe(F.col("summary")))
    source = F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), F.col("first")), F.lit("none"))
    return joined.select("slug", "key", source.alias("source"), "value", (differs | untold).alias("drift"))


#: Fixed values of the context scan: weights of the signals, bounds of the verdicts, and of exact agreement.
SIGNALS = {"definition": 0.45, "relations": 0.25, "type": 0.15, "title": 0.15}
EQUIVALENT, DISTINCT, EXACT = 0.90, 0.55, 0.99
SAME_DEFINITION, SAME_RELATIONS = 0.95, 0.80


def mean_cosine(rows: DataFrame, text: str) -> DataFrame:
    """grp, definition: the mean cosine of 3-gram counts over all pairs of a group's rows (grp, page_id).

    Of unit vectors the sum over all pairs is half of what the squared norm of their sum has beyond their own, so
    the grams are added up per group and no pairs are made.  An empty text has no direction and counts as 0.
    """
    grams = rows.select("grp", "page_id", F.explode(T.grams(F.col(text), 3)).alias("gram")).groupBy("grp", "page_id", "gram").agg(F.count("*").alias("n"))
    norms = grams.groupBy("grp", "page_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    unit = grams.join(norms, ["grp", "page_id"]).withColumn("u", F.col("n") / F.col("norm"))
    sums = unit.groupBy("grp", "gram").agg(F.sum("u").alias("s"), F.sum(F.col("u") * F.col("u")).alias("own"))
    total = sums.groupBy("grp").agg((F.sum(F.col("s") * F.col("s") - F.col("own")) / 2).alias("total"))
    pairs = rows.groupBy("grp").agg((F.count("*") * (F.count("*") - 1) / 2).alias("pairs"))
    mean = F.when(F.col("pairs") > 0, F.coalesce("total", F.lit(0.0)) / F.col("pairs")).otherwise(0.0)
    return pairs.join(total, "grp", "left").select("grp", mean.alias("definition"))


#: An element in at most so many different sets of a group, or their square root, is rare; fixed value.
RARE = 32


def rare_and_common(posted: DataFrame, kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of postings (grp, kind, m, size, x) those of rare elements, and the sets (grp, kind, m, size) that have common ones.

    Both hold ``common``, the hashes of a set's common elements: those in more than ``RARE`` different sets of the group
    and more than the square root of their number.
    """
    many = kinds.groupBy("grp").agg(F.count("*").alias("sets"))
    often = posted.groupBy("grp", "x").agg(F.count("*").alias("df")).where(F.col("df") > RARE)
    often = often.join(many, "grp").where(F.col("df") > F.sqrt("sets")).select("grp", "x", F.xxhash64("x").alias("code"))
    marked = settled(posted.join(often, ["grp", "x"], "left"), "marked-postings")
    common = marked.where("code is not null").groupBy("grp", "kind", "m", "size").agg(F.array_sort(F.collect_list("code")).alias("common"))
    common = settled(common, "common-elements")
    rare = marked.where("code is null").drop("code").join(common.select("grp", "kind", "common"), ["grp", "kind"], "left")
    return rare.withColumn("common", F.coalesce("common", F.array().cast("array<bigint>"))), common


def rare_pairs(rare: DataFrame) -> DataFrame:
    """The pairs of different sets of a group that share a rare element, each once, and how many of them they share."""
    columns = ["kind", "m", "size", "common"]
    other = rare.select("grp", "x", *[F.col(c).alias(f"{c}_b") for c in columns])
    met = rare.join(other, ["grp", "x"]).where("kind < kind_b")
    return met.groupBy("grp", *columns, *[f"{c}_b" for c in columns]).agg(F.count("*").alias("both"))


def mean_jaccard(rows: DataFrame, sets: str) -> DataFrame:
    """grp, relations: the mean Jaccard of the sets over all pairs of a group's rows; two empty sets count as 1.

    Equal sets are counted together; every two different ones of a group are compared in tiles of bounded size.
    """
    kinds = rows.groupBy("grp", F.array_sort(F.array_distinct(sets)).alias("words")).agg(F.count("*").cast("double").alias("m"))
    kinds = settled(kinds, "kinds-of-sets")
    same = kinds.groupBy("grp").agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("same"), F.sum("m").alias("n"), F.count("*").alias("kinds"))
    several = kinds.join(same.where("kinds > 1").select("grp"), "grp", "left_semi")
    joined = same.join(jaccard_sums(several), "grp", "left")
    total = F.col("same") + F.coalesce("total", F.lit(0.0))
    return joined.select("grp", F.when(F.col("n") > 1, total / (F.col("n") * (F.col("n") - 1) / 2)).otherwise(1.0).alias("relations"))


def context_scan(pages: DataFrame, groups: DataFrame) -> DataFrame:
    """grp, kbs, members, the four signals, score, verdict, confidence, auto of groups over two bases or more.

    pages: page_id, kb_id, title, page_type, summary, relations (array); groups: page_id, grp.  Signals: one title,
    one type, the mean pair cosine of the definitions' 3-gram counts and the mean pair Jaccard of the relations.
    Exact agreement is equivalent with .99; distinct verdicts report one minus the score; ``auto`` starts at .95.
    """
    rows = pages.join(groups, "page_id")
    title, kind = F.nullif(T.norm_title(F.col("title")), F.lit("")), F.nullif(F.col("page_type"), F.lit(""))
    spread = rows.groupBy("grp").agg(
        F.count_distinct("kb_id").alias("kbs"), F.count("*").alias("members"),
        (F.count_distinct(title) == 1).alias("title"), (F.count_distinct(kind) == 1).alias("type"),
    ).where("kbs > 1")
    rows = rows.join(spread.select("grp"), "grp", "left_semi")
    joined = spread.join(mean_cosine(rows, "summary"), "grp").join(mean_jaccard(rows, "relations"), "grp")
    joined = joined.withColumns({c: F.round(c, 4) for c in ("definition", "relations")})
    exact = F.col("title") & F.col("type") & (F.col("definition") >= SAME_DEFINITION) & (F.col("relations") >= SAME_RELATIONS)
    score = F.round(sum((F.col(c).cast("double") * w for c, w in SIGNALS.items()), F.lit(0.0)), 4)
    joined = joined.withColumn("score", F.when(exact, EXACT).otherwise(score))
    verdict = F.when(F.col("score") >= EQUIVALENT, "equivalent").when(F.col("score") <= DISTINCT, "distinct").otherwise("unknown")
    joined = joined.withColumn("verdict", verdict).withColumn("confidence", F.when(F.col("verdict") == "distinct", F.round(1 - F.col("score"), 4)).otherwise(F.col("score")))
    return joined.withColumn("auto", (F.col("verdict") != "unknown") & (F.col("confidence") >= 0.95))


def order_candidates(found: DataFrame) -> DataFrame:
    rank = F.when(F.col("verdict") == "equivalent", 0).when(F.col("verdict") == "unknown", 1).otherwise(2)
    return found.orderBy(rank, F.desc("confidence"), "grp")


def natural_order(rows: DataFrame, name: str) -> DataFrame:
    """Adds ``place``: names by their text and then by the number they end in."""
    stem = F.regexp_replace(F.col(name), r"\d+$", "")
    number = F.regexp_extract(F.col(name), r"(\d+)$", 1).try_cast("bigint")
    parts = rows.withColumn("stem", stem).withColumn("number", number)
    return parts.withColumn("place", F.row_number().over(Window.partitionBy("stem").orderBy("number", name))).drop("number")


#: Words that deny a claim after them; fixed values.
DENIALS = ("没有出现", "未出现", "不存在", "并非", "不是", "不能", "不得", "禁止", "避免", "不构成")
#: Signs that turn a verdict into its opposite where they stand right before it; fixed values.
NEGATORS = {"符合": "不未无判"}


def affirmed(text: Column, claim: Column, denials: tuple[str, ...] = DENIALS) -> Column:
    """Whether a claim stands anywhere without a denial before it: at most 12 characters in between, none that ends a sentence."""
    words = "|".join(denials)
    return (claim != "") & F.regexp_like(text, F.concat(F.lit(f"(?<!(?:{words})[^。；\\n]{{0,12}})\\Q"), claim, F.lit("\\E")))


def score_cases(reports: DataFrame, cases: DataFrame, denials: tuple[str, ...] = DENIALS, negators: dict[str, str] | None = None) -> DataFrame:
    """case_id, verdict, patterns, clean, unleaked, required, nonempty, passed of reports (case_id, text, steps) by their case.

    cases: case_id, expected, patterns, forbidden, markers, required (arrays).  The expected verdict stands without a
    negating sign right before it; every pattern stands in the text or the steps; no forbidden claim is affirmed; no
    marker of the case leaks; every required term stands.  A case passes if all hold and the report is not blank.
    """
    joined = reports.join(cases, "case_id").withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")
    verdict = (F.coalesce("expected", F.lit("")) != "") & text.contains(F.col("expected"))
    for value, signs in (NEGATORS if negators is None else negators).items():
        verdict = F.when(F.col("expected") == value, text.rlike(f"(?<![{signs}])\\Q{value}\\E")).otherwise(verdict)
    checks = {
        "verdict": verdict,
        "patterns": F.forall("patterns", lambda p: text.contains(p) | F.coalesce("steps", F.lit("")).contains(p)),
        "clean": ~F.exists("forbidden", lambda c: affirmed(text, c, denials)),
        "unleaked": ~F.exists("markers", lambda m: text.contains(m)),
        "required": F.forall("required", lambda r: text.contains(r)),
        "nonempty": F.trim(text) != "",
    }
    passed = reduce(lambda a, b: a & b, checks.values())
    return joined.select("case_id", *[c.alias(n) for n, c in checks.items()], passed.alias("passed"))


def purge_scan(pages: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """kb_id, pages, deleted and rows per child table (kb_id), zeros included."""
    out = pages.groupBy("kb_id").agg(F.count("*").alias("pages"), F.count_if("deleted").alias("deleted"))
    for name, rows in children.items():
        out = out.join(rows.groupBy("kb_id").agg(F.count("*").alias(name)), "kb_id", "left").fillna(0, [name])
    return out


def contract_drift(bindings: DataFrame, contracts: DataFrame) -> DataFrame:
    """binding, state: stale where the stored hash differs from the contract's, unstamped without one, orphan without a contract."""
    joined = bindings.join(contracts.select("contract", F.col("hash").alias("now")), "contract", "left")
    state = F.when(F.col("now").isNull(), "orphan").when(F.col("stored").isNull(), "unstamped").when(F.col("stored") != F.col("now"), "stale")
    return joined.withColumn("state", state).where("state is not null").select("binding", "state")


def template_usage(headings: DataFrame, templates: DataFrame, pages: DataFrame) -> DataFrame:
    """page, missing: required sections (type, section) that no heading (page, title) of a page (page, type) holds."""
    wanted = pages.join(templates, "type")
    met = wanted.join(headings, "page").where(F.col("title").contains(F.col("section")) | F.col("section").contains(F.col("title")))
    gone = wanted.join(met.select("page", "section").distinct(), ["page", "section"], "left_anti")
    return gone.groupBy("page").agg(F.array_join(F.array_sort(F.collect_set("section")), ",").alias("missing"))


def _picked(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """page, type, fits (how many templates apply to the page), template (the only one)."""
    of = templates.select("template", F.explode(F.array_distinct(F.filter("types", lambda t: F.coalesce(t, F.lit("")) != ""))).alias("type"))
    found = of.groupBy("type").agg(F.count("*").alias("fits"), F.min("template").alias("template"), F.array_join(F.array_sort(F.collect_set("template")), ",").alias("names"))
    return pages.join(found, "type", "left").withColumn("fits", F.coalesce("fits", F.lit(0)))


def template_sections(pages: DataFrame, headings: DataFrame, templates: DataFrame) -> DataFrame:
    """T1 the required sections that a page's headings lack, T2 templates that can't be used and pages with several.

    pages: page, type; headings: page, title; templates: template, types, sections (arrays; the required ones).  A
    heading meets a section that holds it or that it holds.  A page that several templates fit is told, not judged.
    """
    picked = _picked(pages, templates)
    sections = templates.select("template", F.explode(F.array_distinct("sections")).alias("section"))
    wanted = picked.where("fits = 1").select("page", "template").join(sections, "template")
    met = wanted.join(headings, "page").where((F.coalesce("title", F.lit("")) != "") & (F.col("title").contains(F.col("section")) | F.col("section").contains(F.col("title"))))
    gone = wanted.join(met.select("page", "section").distinct(), ["page", "section"], "left_anti")
    lacking = gone.groupBy("page", "template").agg(F.array_join(F.array_sort(F.collect_set("section")), ",").alias("missing"))
    blank = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0
    parts = [
        findings(lacking, "T1", "medium", F.col("page"), F.concat_ws(": ", "template", "missing")), findings(picked.where("fits > 1"), "T2", "low", F.col("page"), F.concat(F.lit("several: "), "names")),
        findings(templates.where(blank(F.col("sections"))), "T2", "low", F.col("template"), F.lit("no sections")), findings(templates.where(blank(F.col("types"))), "T2", "low", F.col("template"), F.lit("no types")),
    ]
    return reduce(DataFrame.unionByName, parts)


def template_totals(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """pages, checked, no_template, ambiguous and templates."""
    picked = _picked(pages, templates)
    counts = picked.agg(F.count("*").alias("pages"), F.count_if(F.col("fits") == 1).alias("checked"), F.count_if(F.col("fits") == 0).alias("no_template"), F.count_if(F.col("fits") > 1).alias("ambiguous"))
    return counts.crossJoin(templates.agg(F.count("*").alias("templates")))  # one row each
