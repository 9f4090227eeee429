"""Keyword search, lookups, catalogue checks, entity resolution and near duplicates."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lorekeep.functions import text as T
from lorekeep.operators.graphs import settled
from lorekeep.operators.vectors import sketched_pairs


def parse_query(query: str) -> tuple[list[str], list[str]]:
    """Terms (phrases and words, all wanted) and excluded words of ``a "b c" -d``."""
    phrases = re.findall(r'"([^"]+)"', query)
    words = re.sub(r'"[^"]*"', " ", query).split()
    return phrases + [w for w in words if not w.startswith("-")], [w[1:] for w in words if w.startswith("-") and len(w) > 1]


def keyword_filter(rows: DataFrame, query: str, name: str, body: str) -> DataFrame:
    """Rows whose name or body holds every term and whose body no excluded word, with ``relaxed``.

    If none holds all of several terms, those that hold any are returned and marked as relaxed; one pass computes
    both.  Contains is case-sensitive.
    """
    terms, excluded = parse_query(query)
    hits = [F.coalesce(F.col(name).contains(t), F.lit(False)) | F.coalesce(F.col(body).contains(t), F.lit(False)) for t in terms]
    out = reduce(lambda a, b: a | b, [F.coalesce(F.col(body).contains(x), F.lit(False)) for x in excluded], F.lit(False))
    every = reduce(lambda a, b: a & b, hits, F.lit(True))
    some = reduce(lambda a, b: a | b, hits, F.lit(False))
    found = rows.withColumn("every", every).withColumn("some", some).where(~out & (F.col("every") | F.col("some")))
    strict = found.agg(F.coalesce(F.max("every"), F.lit(False)).alias("strict"))  # one row
    joined = found.crossJoin(F.broadcast(strict))
    kept = joined.where(F.col("every") | (~F.col("strict") & F.lit(len(terms) > 1)))
    return kept.withColumn("relaxed", ~F.col("strict")).drop("every", "some", "strict")


def catalog_search(rows: DataFrame, contains: dict[str, str | None], equals: dict[str, str | None]) -> DataFrame:
    """Case-insensitive contains on some columns and equality on others; a null condition is none."""
    for column, part in contains.items():
        if part:
            rows = rows.where(F.lower(column).contains(part.lower()))
    for column, value in equals.items():
        if value:
            rows = rows.where(F.col(column) == value)
    return rows


def allowed_scope(attached: Column, domain: Column, work: Column, mode: Column) -> Column:
    """All attached for mode ``all``; else those of domain and work that are attached, in that order."""
    return F.when(mode == "all", attached).otherwise(F.array_intersect(F.array_union(domain, work), attached))


def map_enums(rows: DataFrame, column: str, names: dict[str, str], back: bool = False) -> DataFrame:
    """``column`` by its business value, or ``back`` from it (the first value of a name); what has none stays and is flagged in ``unmapped``."""
    names = dict(reversed([(v, k) for k, v in names.items()])) if back else names
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    value = table[F.col(column)]
    return rows.withColumn("unmapped", F.col(column).isNotNull() & value.isNull()).withColumn(column, F.coalesce(value, F.col(column)))


def question_shape(mode: Column, terms: Column, classes: Column) -> dict[str, Column]:
    """n_terms, bucket, level and shape of a question by its syntax alone: terms count in modes of key words, else as one."""
    n = F.when(F.lower(F.trim(mode)).isin("keyword", "route"), F.size(terms)).otherwise(1)
    bucket = F.when(n >= 3, F.lit("3+")).otherwise(n.cast("string"))
    some, scoped = F.size(terms) > 0, F.size(classes) > 0
    level = F.when(F.lower(F.trim(mode)) == "instances", "instance").when(scoped & some, "class+text").when(scoped, "class").when(some, "text").otherwise("none")
    return {"n_terms": n, "bucket": bucket, "level": level, "shape": F.concat_ws("|", bucket, level)}


def question_category(question: Column) -> Column:
    """From syntax only, never from results."""
    return (
        F.when(question.contains('"'), "phrase").when(question.rlike(r"(^|\s)-\w"), "exclude")
        .when(question.contains("?"), "question").when(F.size(F.split(question, r"\s+")) <= 2, "name").otherwise("keywords")
    )


#: Fields of a receipt that hold its payload, and those by which a call was turned away; fixed values.
PAYLOAD = (
    "count", "hits", "items", "rules", "pages", "nodes", "edges", "tools", "catalog", "images_found", "by_document", "chunks", "rows",
    "total",
)
TURNED_AWAY = ("need_session", "need_kb_selection", "kb_unresolved", "retired")


def result_shape(receipt: Column, done: Column) -> Column:
    """timeout, guard, error, ok, dry, ok_brief or silent of a call's JSON receipt, in that order."""
    keys = F.coalesce(F.json_object_keys(receipt), F.array().cast("array<string>"))
    has = lambda names: F.arrays_overlap(keys, F.array(*[F.lit(n) for n in names]))
    says = lambda word: F.lower(F.get_json_object(receipt, "$.ok")).eqNullSafe(word) | F.lower(F.get_json_object(receipt, "$.applied")).eqNullSafe(word)
    error = F.get_json_object(receipt, "$.error")
    return (
        F.when(~done, "timeout").when(has(TURNED_AWAY), "guard").when(error.isNotNull() & ~error.isin("", "0", "false", "[]", "{}"), "error").when(says(F.lit("true")), "ok").when(says(F.lit("false")), "dry")
        .when(has(PAYLOAD), "ok").when(F.size(keys) > 0, "ok_brief").otherwise("silent")
    )


def catalog_check(items: DataFrame, allow: DataFrame, deny: DataFrame, today: str, near: int = 5) -> DataFrame:
    """item_id, verdict, match, near_misses: denied beats allowed; an entry past its date is ``expired``; else unknown.

    items: item_id, software, version; deny: software, version; allow (in the order of pos): software, version, low,
    high, expires_at.  The first allowed entry of the very version counts, else the first whose range holds it.  Near
    misses are the first ``near`` allowed entries of the name with another version.
    """
    name, exact = F.trim(F.lower("software")), F.trim(F.lower(F.coalesce("version", F.lit(""))))
    denied = deny.select(name.alias("name"), exact.alias("version"), F.lit(True).alias("denied")).distinct()
    listed = allow.select("pos", name.alias("name"), exact.alias("listed"), "low", "high", "expires_at")
    base = items.select("item_id", name.alias("name"), exact.alias("version"))
    asked = base.select("name", "version").distinct()
    old = T.expired(F.substring("expires_at", 1, 10), F.lit(today))
    # of entries that say the same only the first counts, so that a version meets each range of its name once
    entry = F.min(F.struct("pos", old.alias("old"))).alias("entry")
    same = listed.groupBy("name", F.col("listed").alias("version")).agg(entry)
    spans = listed.where("low is not null or high is not null").groupBy("name", "low", "high").agg(entry)
    held = asked.where("version != ''").join(spans, "name").where(T.in_range(F.col("version"), F.col("low"), F.col("high")))
    told = held.groupBy("name", "version").agg(F.min("entry").alias("entry")).withColumn("step", F.lit(1)).unionByName(same.withColumn("step", F.lit(0)))
    best = told.groupBy("name", "version").agg(F.min(F.struct("step", "entry.pos", "entry.old")).alias("best"))
    # near misses come from the first entries of the versions that are listed first, one more for the very version
    first = listed.groupBy("name", "listed").agg(F.min(F.struct("pos")).alias("first"))
    nth = F.row_number().over(Window.partitionBy("name").orderBy("first", "listed"))
    first = first.withColumn("nth", nth).where(F.col("nth") <= near + 1).select("name", "listed")
    nth = F.row_number().over(Window.partitionBy("name", "listed").orderBy("pos"))
    heads = listed.select("name", "listed", "pos").join(first, ["name", "listed"]).withColumn("nth", nth).where(F.col("nth") <= near)
    others = asked.join(heads, "name").where("listed != version")
    misses = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("pos", "listed"))), 1, near), lambda m: m["listed"])
    misses = others.groupBy("name", "version").agg(F.array_join(misses, ",").alias("near_misses"))
    joined = base.join(denied, ["name", "version"], "left").join(best, ["name", "version"], "left").join(misses, ["name", "version"], "left")
    found = F.col("best").isNotNull()
    verdict = F.when(F.col("denied"), "denied").when(F.col("best.old"), "expired").when(found, "allowed").otherwise("unknown")
    match = F.when(F.col("denied"), "deny").when(F.col("best.step") == 0, "exact").when(found, "range").otherwise("")
    return joined.select("item_id", verdict.alias("verdict"), match.alias("match"), F.coalesce("near_misses", F.lit("")).alias("near_misses"))


#: Bytes of the grams by which parts are looked for: a part asks by the longest that it has.
GRAM_BYTES = (6, 3, 2, 1)
#: Cells of the filter of asked grams: four megabytes, whatever the number of parts.
ASKED_CELLS = 1 << 22
#: Bytes of texts whose grams are made at once, to bound a worker's memory.
BLOCK_BYTES = 1 << 19


def byte_grams(texts: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Block by block the row, the number and the filter's cell of every gram of ``n`` bytes of the texts."""
    texts = texts.fill_null(b"").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    for at in range(int(ends[0]), int(ends[-1]) - n + 1, BLOCK_BYTES):
        part = data[at : min(at + BLOCK_BYTES + n - 1, int(ends[-1]))].astype(np.int64)
        codes = np.full(len(part) - n + 1, n, np.int64)
        for k in range(n):
            codes = codes << 8 | part[k : k + len(codes)]
        places = np.arange(at, at + len(codes))
        rows = np.searchsorted(ends, places, side="right") - 1
        whole = places + n <= ends[rows + 1]
        cells = (codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).astype(np.int32)
        yield rows[whole], codes[whole], cells[whole]


def _grams_of(rows: DataFrame, text: str, found: Callable[[pa.Array], Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> DataFrame:
    """The rows with the code and the cell of each gram that ``found`` gives of their texts, once in a block."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names[:-1]
            for at, codes, cells in found(batch.column(len(names))):
                order = np.lexsort((codes, at))
                fresh = order[np.append(True, (np.diff(at[order]) != 0) | (np.diff(codes[order]) != 0))[: len(order)]]
                kept = batch.take(pa.array(at[fresh]))
                yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.array(codes[fresh]), pa.array(cells[fresh])], [*names, "code", "cell"])

    schema = StructType([*rows.schema.fields, StructField("code", LongType()), StructField("cell", IntegerType())])
    return rows.select("*", F.col(text).cast("binary").alias("_bytes")).mapInArrow(made, schema)


def part_grams(parts: DataFrame) -> DataFrame:
    """The parts (part_id, part) with the code and the cell of each of their grams."""

    def found(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        for n, longer in zip(GRAM_BYTES, (np.inf, *GRAM_BYTES), strict=False):
            own = np.flatnonzero((size >= n) & (size < longer))
            if len(own):
                yield from ((own[at], codes, cells) for at, codes, cells in byte_grams(texts.take(pa.array(own)), n))

    return _grams_of(parts.where("part != ''").select("part_id", "part"), "part", found)


def contained(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """part_id, whole_id: which parts (part_id, part) stand in which wholes (whole_id, whole).

    Each part asks by the rarest of its grams of six bytes, or fewer if it is shorter; a gram is a number.  Postings hold
    grams and ids alone, and only grams that some part has: a filter of fixed size drops most others where they are made.
    The texts join when the rarest grams have picked candidates.
    """
    asked = part_grams(parts)
    wanted = settled(asked.select("code", "cell").distinct(), "asked-grams")
    sizes = [n for n in GRAM_BYTES if not wanted.where(F.col("code").between(n << 8 * n, (n + 1 << 8 * n) - 1)).isEmpty()]
    cells = np.zeros(ASKED_CELLS, bool)
    cells[wanted.select("cell").distinct().toArrow()["cell"].to_numpy()] = True
    shared = parts.sparkSession.sparkContext.broadcast(cells)

    def found(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for n in sizes:
            for rows, codes, at in byte_grams(texts, n):
                hit = np.flatnonzero(shared.value[at])
                yield rows[hit], codes[hit], at[hit]

    posted = _grams_of(wholes.select("whole_id", "whole"), "whole", found).select("whole_id", "code")
    posted = settled(posted.join(wanted.select("code"), "code", "left_semi"), "posted-grams")
    often = posted.groupBy("code").agg(F.count("*").alias("df"))
    # a part with a gram that stands nowhere is found nowhere
    rare = asked.join(often, "code", "left").groupBy("part_id", "part").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "code")).alias("rare"))
    met = rare.where("rare.df > 0").select("part_id", "part", F.col("rare.code").alias("code")).join(posted, "code").select("part_id", "part", "whole_id")
    return met.join(wholes, "whole_id").where(F.col("whole").contains(F.col("part"))).select("part_id", "whole_id").distinct()


def class_candidates(terms: DataFrame, classes: DataFrame, closure: DataFrame, n: int = 3) -> DataFrame:
    """term, class, score, strong, place, ambiguous: the best classes (class, name, label) of each term.

    100 where the term is the label, the name or its last part; inside the label 90 less the surplus (20 at most) if
    it ends the label or makes up three quarters, else 55; 70 less the surplus where the label is inside the term; 60
    inside the last part of the name.  Ambiguous: the two best strong ones are less than 10 apart and neither is an
    ancestor of the other (closure: node, ancestor).
    """
    key = T.norm_title(F.col("term"))
    asked = settled(terms.select("term").distinct().withColumn("key", key).where("length(key) >= 2"), "terms")
    local = T.norm_title(F.element_at(F.split("name", ":"), -1))
    listed = settled(classes.select("class", "name", T.norm_title(F.coalesce("label", F.lit(""))).alias("label"), local.alias("local"), T.norm_title(F.col("name")).alias("whole")), "classes")
    keys = asked.select(F.col("term").alias("part_id"), F.col("key").alias("part"))
    inside = [contained(keys, listed.select(F.col("class").alias("whole_id"), F.col(c).alias("whole"))) for c in ("label", "local", "whole")]
    around = contained(listed.select(F.col("class").alias("part_id"), F.col("label").alias("part")), asked.select(F.col("term").alias("whole_id"), F.col("key").alias("whole")))
    pairs = reduce(DataFrame.unionByName, inside).select(F.col("part_id").alias("term"), F.col("whole_id").alias("class"))
    pairs = pairs.unionByName(around.select(F.col("whole_id").alias("term"), F.col("part_id").alias("class"))).distinct()
    k, label = F.col("key"), F.col("label")
    gap = F.least(F.abs(F.length(label) - F.length(k)), F.lit(20))
    within = (label != "") & label.contains(k)
    equal = (k == label) | (k == F.col("local")) | (k == F.col("whole"))
    firm = label.endswith(k) | (F.length(k) * 4 >= F.length(label) * 3)
    score = F.when(equal, 100).when(within & firm, 90 - gap).when(within, 55).when((label != "") & k.contains(label), 70 - gap).when(F.col("local").contains(k), 60)
    scored = pairs.join(asked, "term").join(listed, "class").withColumn("score", score).withColumn("strong", ~(within & ~firm & ~equal)).where("score is not null")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "name", "class"))
    top = scored.withColumn("place", place).where(F.col("place") <= n).select("term", "class", "score", "strong", "place")
    first = top.where("strong").groupBy("term").agg(F.array_sort(F.collect_list(F.struct("place", "class", "score"))).alias("s")).where("size(s) > 1")
    first = first.select("term", F.get("s", 0).alias("a"), F.get("s", 1).alias("b")).where("a.score - b.score < 10").select("term", F.col("a.class").alias("a"), F.col("b.class").alias("b"))
    kin = closure.select(F.col("node").alias("a"), F.col("ancestor").alias("b")).unionByName(closure.select(F.col("ancestor").alias("a"), F.col("node").alias("b")))
    torn = first.join(kin, ["a", "b"], "left_anti").select("term", F.lit(True).alias("torn"))
    return top.join(torn, "term", "left").select("term", "class", "score", "strong", "place", F.coalesce("torn", F.lit(False)).alias("ambiguous"))


def lookup_page(queries: DataFrame, pages: DataFrame) -> DataFrame:
    """query, slug, rank, ambiguous: the exact slug 0, the end of the slug 1, the title 2, else inside either 3; the best rank's hits.

    A first part before ``/`` may be the name of a base and may be left out.  Several hits are ambiguous from rank 2 on.
    """
    asked = queries.select("query", F.trim(F.regexp_replace(F.trim("query"), "^[\"']+|[\"']+$", "")).alias("q")).where("q != ''").distinct()
    rest = F.regexp_replace("q", "^[^/]*/", "")
    listed = settled(pages.select("slug", "title").withColumn("page", F.monotonically_increasing_id()), "lookup-pages")
    found = [contained(asked.select(F.col("query").alias("part_id"), F.lower("q").alias("part")), listed.select(F.col("page").alias("whole_id"), F.lower(F.coalesce(c, F.lit(""))).alias("whole"))) for c in ("slug", "title")]
    pairs = found[0].unionByName(found[1]).select(F.col("part_id").alias("query"), F.col("whole_id").alias("page"))
    tails = asked.select("query", rest.alias("slug")).where("slug != ''").join(listed.select("slug", "page"), "slug").select("query", "page")
    met = pairs.unionByName(tails).distinct().join(asked, "query").join(listed, "page")
    after = F.regexp_replace("slug", "^[^/]*/", "")
    rank = F.when(F.col("slug") == F.col("q"), 0).when((after == F.col("q")) | F.col("slug").endswith(F.concat(F.lit("/"), F.col("q"))), 1).when(F.trim("title") == F.col("q"), 2).otherwise(3)
    each = met.groupBy("query", "slug").agg(F.min(rank).alias("rank"))
    best = each.groupBy("query").agg(F.min("rank").alias("rank"))
    kept = each.join(best, ["query", "rank"])
    n = kept.groupBy("query").agg(F.count("*").alias("n"))
    return kept.join(n, "query").select("query", "slug", "rank", ((F.col("n") > 1) & (F.col("rank") >= 2)).alias("ambiguous"))


def resolve_names(raw: DataFrame, dim: DataFrame) -> DataFrame:
    """raw, id, mode, candidates of raw names by the rows of a dimension (id: 36 hexadecimal digits and dashes, name).

    A full id counts alone; four digits or more are the start of one id; else the name that is equal, blanks aside,
    and else those that hold it or that it holds.  Several hits are ambiguous and give no id.
    """
    norm = lambda c: F.regexp_replace(c, r"[\s\u3000]+", "")
    asked = settled(raw.select("raw").distinct().withColumn("key", F.trim(F.coalesce("raw", F.lit("")))).withColumn("want", norm(F.col("key"))).where("key != ''"), "raw-names")
    listed = settled(dim.select("id", F.lower("id").alias("low"), norm(F.coalesce("name", F.lit(""))).alias("norm")), "dimension")
    whole, start = F.col("key").rlike("^[0-9a-fA-F-]{36}$"), F.col("key").rlike("^[0-9a-fA-F-]{4,35}$")
    keys = asked.select("raw", F.lower("key").alias("low"), F.length("key").alias("n"), whole.alias("whole"), start.alias("start"))
    by_id = keys.where("whole").join(listed.select("id", "low"), "low").select("raw", "id", F.lit(0).alias("rank"))
    starts = listed.select("id", F.explode(F.transform(F.sequence(F.lit(4), F.lit(35)), lambda n: F.substring("low", F.lit(1), n))).alias("low"))
    by_start = keys.where("start").join(starts, "low").select("raw", "id", F.lit(1).alias("rank"))
    names = asked.where(~whole)
    equal = names.join(listed, F.col("want") == F.col("norm")).select("raw", "id", F.lit(2).alias("rank"))
    part = contained(names.select(F.col("raw").alias("part_id"), F.col("want").alias("part")), listed.select(F.col("id").alias("whole_id"), F.col("norm").alias("whole")))
    around = contained(listed.select(F.col("id").alias("part_id"), F.col("norm").alias("part")), names.select(F.col("raw").alias("whole_id"), F.col("want").alias("whole")))
    loose = part.select(F.col("part_id").alias("raw"), F.col("whole_id").alias("id")).unionByName(around.select(F.col("whole_id").alias("raw"), F.col("part_id").alias("id")))
    hits = by_id.unionByName(by_start).unionByName(equal).unionByName(loose.distinct().withColumn("rank", F.lit(3)))
    counted = hits.groupBy("raw", "rank").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    best = counted.groupBy("raw").agg(F.min(F.struct("rank", "n", "id")).alias("best"))
    joined = raw.select("raw").distinct().join(best, "raw", "left")
    n, rank = F.coalesce("best.n", F.lit(0)), F.col("best.rank")
    mode = F.when(n == 0, "none").when(n > 1, "ambiguous").when(rank.isin(0, 2), "exact").otherwise("fuzzy")
    return joined.select("raw", F.when(n == 1, F.col("best.id")).alias("id"), mode.alias("mode"), n.alias("candidates"))


def cross_kb_same_key(pages: DataFrame) -> DataFrame:
    """Groups of pages over several knowledge bases with one slug name (L1), one class and normal title (L2) or both (L1+L2).

    One row per page of such a group: level, key, kb_id, page_id, kbs.  Pages are grouped by key, not paired.
    """
    slug, title = F.col("norm_slug"), F.nullif(F.col("norm_title"), F.lit(""))
    named = F.concat_ws("|", F.coalesce("page_type", F.lit("")), title)
    both = F.when((slug != "") & title.isNotNull(), F.concat_ws("|", slug, named))
    out = None
    for level, key in (("L1", slug), ("L2", F.when(title.isNotNull(), named)), ("L1+L2", both)):
        keyed = pages.select("kb_id", "page_id", key.alias("key")).where("key != ''")
        wide = keyed.groupBy("key").agg(F.count_distinct("kb_id").alias("kbs")).where("kbs > 1")
        part = keyed.join(wide, "key").select(F.lit(level).alias("level"), "key", "kb_id", "page_id", "kbs")
        out = part if out is None else out.unionByName(part)
    return out


def gram_codes(text: Column, n: int) -> Column:
    """The distinct n-grams (n up to 3) of a text as numbers, 21 bits a character: nothing is lost, and numbers are cheaper than strings."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    size = F.length(text)
    push = lambda a, b: F.shiftleft(a, 21) + b
    whole = F.aggregate(F.slice(codes, 1, n), F.lit(0).cast("bigint"), push)
    return F.array_distinct(F.when(size < n, F.array(whole)).otherwise(T.sliding(codes, size, n, push)))


#: Buckets in which grams are counted: half a megabyte, whatever the number of texts.
RARITY = 1 << 16


def prefix_pairs(sets: DataFrame, shared: Callable[..., Column], probe: Column, index: Column, across: bool = False) -> DataFrame:
    """Pairs (id < id_b) of sets (id, n, kind, grams) that may be alike, from the rarest grams of each.

    ``shared(n, n_b, kind, kind_b)`` is the least number of shared grams of sets of m <= n grams that are alike;
    ``probe`` bounds it from below by the larger size alone, ``index`` by the smaller; ``across`` asks for pairs of
    different kinds only.  In the order from rare to common, the first shared gram is among the first m - shared + 1
    of the smaller and n - shared + 1 of the larger set.  So smaller sets are posted by few grams, larger ones ask by more, and a met pair stays only if both places
    allow for it.
    """
    # any order that is the same for all sets will do; by counts in a table of fixed size no set's grams need a shuffle
    bucket = lambda g: F.pmod(F.xxhash64(g), F.lit(RARITY)).cast("int")
    met = sets.select(F.explode("grams").alias("g")).groupBy(bucket(F.col("g")).alias("bucket")).agg(F.count("*").alias("df"))
    every = sets.sparkSession.range(RARITY).select(F.col("id").cast("int").alias("bucket")).join(met, "bucket", "left")
    table = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("df", F.lit(0)).alias("df")))), lambda x: x["df"]).alias("table"))
    table = settled(table, "gram-counts")
    order = F.array_sort(F.transform("grams", lambda g: F.struct(F.get("table", bucket(g)).alias("df"), g.alias("gram"))))
    ranked = sets.crossJoin(F.broadcast(table)).select("id", "kind", "n", order.alias("ranked"))  # one row
    prefix = ranked.select("id", "kind", "n", F.posexplode(F.slice("ranked", F.lit(1), (F.col("n") - probe + 1).cast("int"))).alias("place", "g"))
    prefix = settled(prefix.select("id", "kind", "n", F.col("g.gram").alias("gram"), (F.col("place") + 1).alias("place")), "gram-prefixes")
    small = prefix.where(F.col("place") <= F.col("n") - index + 1)
    small = small.select("gram", *[F.col(c).alias(f"{c}_b") for c in ("id", "kind", "n", "place")])
    least = shared(F.col("n"), F.col("n_b"), F.col("kind"), F.col("kind_b"))
    met = prefix.join(small, "gram").where(
        ((F.col("n_b") < F.col("n")) | ((F.col("n_b") == F.col("n")) & (F.col("id_b") < F.col("id"))))
        & (F.col("place") <= F.col("n") - least + 1) & (F.col("place_b") <= F.col("n_b") - least + 1)
    )
    met = met.where("kind != kind_b") if across else met
    return met.select(F.least("id", "id_b").alias("id"), F.greatest("id", "id_b").alias("id_b")).distinct()


def jaccard_pairs(sets: DataFrame, threshold: float, across: bool = False) -> DataFrame:
    """id, id_b, kind, kind_b, score: pairs of gram sets (id, n, kind, grams) whose Jaccard reaches the threshold."""
    up = lambda c: F.ceil(c - 1e-6)
    part = threshold / (1 + threshold)
    pairs = prefix_pairs(sets, lambda n, m, *_: up(part * (n + m)), up(threshold * F.col("n")), up(2 * part * F.col("n")), across)
    right = sets.select(F.col("id").alias("id_b"), F.col("grams").alias("grams_b"), F.col("kind").alias("kind_b"))
    scored = pairs.join(sets.select("id", "grams", "kind"), "id").join(right, "id_b").withColumn("score", T.jaccard(F.col("grams"), F.col("grams_b")))
    return scored.where(F.col("score") >= threshold).select("id", "id_b", "kind", "kind_b", "score")


def near_duplicates(pages: DataFrame, same: float = 0.86, cross: float = 0.93) -> DataFrame:
    """a, b, a_pages, b_pages, cosine: pairs of texts whose 3-gram sets are alike (pages: page_id, page_type, body).

    The set cosine reaches ``same`` within a type and ``cross`` between types.  Pages of one type and text are one
    class, named by its least page_id.  Pairs whose sketches allow for the cosine are compared whole.
    """
    body = F.coalesce("body", F.lit(""))
    classes = pages.where(body != "").groupBy("page_type", body.alias("body")).agg(F.min("page_id").alias("id"), F.count("*").alias("pages"))
    sets = settled(classes.select("id", F.col("page_type").alias("kind"), "pages", gram_codes(F.col("body"), 3).alias("grams")).withColumn("n", F.size("grams")), "gram-sets")
    limit = lambda a, b: F.when(a == b, same).otherwise(cross)
    pairs = sketched_pairs(sets, min(same, cross))
    left = sets.select("id", "kind", F.col("pages").alias("a_pages"), "grams")
    right = sets.select(F.col("id").alias("id_b"), F.col("kind").alias("kind_b"), F.col("pages").alias("b_pages"), F.col("grams").alias("grams_b"))
    scored = pairs.join(left, "id").join(right, "id_b").withColumn("cosine", F.round(T.set_cosine(F.col("grams"), F.col("grams_b")), 9))
    scored = scored.where(F.col("cosine") >= limit(F.col("kind"), F.col("kind_b")))
    return scored.select(F.col("id").alias("a"), F.col("id_b").alias("b"), "a_pages", "b_pages", "cosine")
