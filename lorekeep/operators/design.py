"""Checks of page metadata and of services against the functional dependencies that were found independently of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators.audits import findings
from lorekeep.operators.pages import is_instance

#: How a service keeps an attribute: by itself, by reference, as a read-only copy; fixed values.
OWN, REFERENCE, COPY = "自维护", "引用外部", "只读缓存"


def declared_class(metadata: Column) -> Column:
    """``module:Class`` by a page's metadata (JSON: class or type, and model), null if it names none."""
    field = lambda name: F.trim(F.coalesce(F.get_json_object(metadata, f"$.{name}"), F.lit("")))
    name = F.when(field("class") != "", field("class")).otherwise(field("type"))
    full = F.when(name.contains(":") | (field("model") == ""), name).otherwise(F.concat_ws(":", field("model"), name))
    return F.when(name != "", full)


def page_checks(pages: DataFrame, editors: tuple[str, ...], prefixes: tuple[str, ...]) -> DataFrame:
    """A3 type against metadata, A6 no metadata or unknown editor, A7 slug of another class, W5 no summary, D1 twins.

    pages: kb_id, slug, title, page_type, summary, deleted, metadata (JSON), editor.  A3, A6 and A7 look at entity
    pages alone; A7 at slugs of three parts that are no pages of a session.
    """
    live = pages.where(~F.col("deleted"))
    entity = live.where(is_instance(F.col("page_type")))
    told = declared_class(F.col("metadata"))
    contradicts = entity.where(told != F.col("page_type"))
    keys = F.size(F.coalesce(F.json_object_keys("metadata"), F.array().cast("array<string>")))
    editor = F.trim(F.coalesce("editor", F.lit("")))
    known = editor.isin(*editors) | reduce(lambda a, b: a | b, [editor.startswith(p) for p in prefixes], F.lit(False))
    bare, unknown = entity.where(keys == 0), entity.where((keys > 0) & ~known)
    part, kind = F.split("slug", "/"), F.split("page_type", ":")
    whole = (F.size(part) == 3) & ~F.exists(part, lambda x: x == "") & (part[0] != "session")
    moved = entity.where(whole & ((part[0] != kind[0]) | (part[1] != F.lower(F.element_at(kind, -1)))))
    unsummed = live.where(F.trim(F.coalesce("summary", F.lit(""))) == "")
    twins = entity.groupBy("kb_id", "page_type", T.norm_title(F.col("title")).alias("name")).agg(F.count("*").alias("n"), F.min("slug").alias("slug"))
    slug, none = F.col("slug"), F.lit("")
    parts = [
        findings(contradicts, "A3", "medium", slug, told),
        findings(bare, "A6", "low", slug, F.lit("no metadata")),
        findings(unknown, "A6", "low", slug, editor),
        findings(moved, "A7", "medium", slug, F.col("page_type")),
        findings(unsummed, "W5", "low", slug, none),
        findings(twins.where("n > 1"), "D1", "medium", slug, F.concat_ws(" ", "page_type", "n")),
    ]
    return reduce(DataFrame.unionByName, parts)


def attribute_key(name: Column) -> Column:
    """An attribute's name without notes in brackets, back ticks, white space, prefix and owner, in lower case."""
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), r"[（(][^）)]*[）)]", "")
    bare = F.regexp_replace(bare, r"[`\s　]+", "")
    bare = F.regexp_replace(bare, r"^[a-z]+:[A-Za-z]*[.。]?", "")
    return F.lower(F.element_at(F.split(bare, "[.。]"), -1))


def dependency_check(services: DataFrame, obligations: DataFrame, idempotency: DataFrame, dependencies: DataFrame) -> DataFrame:
    """F1 to F6 of services against functional dependencies; the owners of an attribute are those that keep it themselves.

    services: service, derived_from and entities (arrays); obligations: service, attribute, way; idempotency: service,
    keys (one text); dependencies: title, role (determinant or dependent), attribute.  F1 an unknown way of keeping, or
    several owners (critical if it determines others); F2 a determinant nobody owns; F3 a dependent owned by a service
    that does not own its determinants; F4 no idempotency key determines anything; F5 no derivation; F6 several
    entities.  Of several dependencies of one attribute the first by title counts.
    """
    own = obligations.select("service", "attribute", attribute_key(F.col("attribute")).alias("key"), F.coalesce("way", F.lit("")).alias("way"))
    own = own.where("key != ''")
    owners = own.where(F.col("way").contains(OWN)).groupBy("key").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("service")).alias("services"))
    ends = dependencies.select("title", "role", attribute_key(F.col("attribute")).alias("key"))
    determines = ends.where("role = 'determinant'").groupBy("key").agg(F.min("title").alias("title"))
    depends = ends.where("role = 'dependent'").groupBy("key").agg(F.min("title").alias("title"))
    unknown = own.where(~(F.col("way").contains(OWN) | F.col("way").contains(REFERENCE) | F.col("way").contains(COPY)))
    several = owners.where("n > 1").join(determines, "key", "left")
    critical, shared = several.where("title is not null"), several.where("title is null")
    unowned = determines.join(owners, "key", "left_anti")
    # the owners of all determinants of the dependency that an attribute hangs on
    of_title = ends.where("role = 'determinant'").join(owners, "key").groupBy("title").agg(F.array_distinct(F.flatten(F.collect_list("services"))).alias("rightful"))
    outside = owners.join(depends, "key").join(of_title, "title").withColumn("outside", F.array_except("services", "rightful")).where(F.size("outside") > 0)
    some = determines.limit(1).select(F.lit(True).alias("some"))
    asked = idempotency.withColumn("part", F.explode(F.split("keys", "[+＋、,，/]"))).withColumn("key", attribute_key(F.col("part")))
    proven = asked.where(F.trim("part") != "").join(determines, "key").select("service", "keys").distinct()
    unproven = idempotency.join(proven, ["service", "keys"], "left_anti").join(F.broadcast(some), F.lit(True))  # one row at most
    rootless = services.where(F.size(F.coalesce("derived_from", F.array().cast("array<string>"))) == 0)
    wide = services.where(F.size("entities") > 1)
    names = F.array_join("services", ",")
    parts = [
        findings(unknown, "F1", "low", F.col("service"), F.concat_ws(":", "attribute", "way")),
        findings(critical, "F1", "critical", F.col("key"), names), findings(shared, "F1", "high", F.col("key"), names),
        findings(unowned, "F2", "medium", F.col("title"), F.col("key")),
        findings(outside, "F3", "high", F.col("key"), F.array_join(F.array_sort("outside"), ",")),
        findings(unproven, "F4", "high", F.col("service"), F.col("keys")),
        findings(rootless, "F5", "high", F.col("service"), F.lit("")),
        findings(wide, "F6", "medium", F.col("service"), F.array_join("entities", ",")),
    ]
    return reduce(DataFrame.unionByName, parts)

