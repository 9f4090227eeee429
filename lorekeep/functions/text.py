"""Column expressions over names, questions, versions, locators and bodies."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Name space of page ids, as hexadecimal bytes.
PAGE_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility form; called for texts beyond ASCII only."""
    return text.str.normalize("NFKC")


def _ascii(text: Column) -> Column:
    return ~text.rlike("[^\\x00-\\x7F]")


def upper_letters(text: Column) -> Column:
    """Upper case, letter by letter: a sharp s becomes its capital, not two letters that lower case would not turn back."""
    return F.upper(F.translate(text, "ß", "ẞ"))


def norm_slug(text: Column) -> Column:
    """Compatibility form, lower case, no blanks; ``-`` and ``_`` stay."""
    folded = F.when(_ascii(text), text).otherwise(nfkc(F.when(~_ascii(text), text)))
    return F.regexp_replace(F.lower(folded), r"\s+", "")


def norm_title(text: Column) -> Column:
    """Lower case without blanks and punctuation."""
    return F.regexp_replace(F.lower(text), r"[\s\p{Punct}]+", "")


def squash(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def question_core(text: Column) -> Column:
    """A question without URLs, ids, numbers and polite words, blanks collapsed, lower case."""
    core = F.lower(text)
    for pattern in (r"https?://\S+", r"\b[a-z]+-\d+\b", r"\bv?\d+(\.\d+)*\b", r"\b(please|kindly|could you|can you)\b"):
        core = F.regexp_replace(core, pattern, " ")
    return F.trim(F.regexp_replace(core, r"[\s?!.,;:]+", " "))


#: Where a question names its case: fixed values.
CASE_NUMBERS = (r"编号\s*[：:#]?\s*([A-Za-z0-9][A-Za-z0-9\-_/]{3,})", r"(?i)(?<![\p{L}\p{N}_])(?:no|no\.|id)\s*[：:#]?\s*([A-Za-z0-9][A-Za-z0-9\-_/]{3,})")


def extract_qid(text: Column) -> Column:
    """The number of the case that a question names, in lower case; empty where it names none."""
    found = [F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1), F.lit("")) for pattern in CASE_NUMBERS]
    return F.lower(F.coalesce(*found, F.lit("")))


def question_key(text: Column) -> Column:
    return F.substring(squash(F.lower(text)), 1, 80)


def slugify(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def attr_key(name: Column) -> Column:
    """The last segment of a qualified name, without brackets."""
    return F.regexp_replace(F.element_at(F.split(name, "[:/.]"), -1), r"[\[\](){}]", "")


def sliding(items: Column, size: Column, n: int, join: Callable[[Column, Column], Column]) -> Column:
    """Every n neighbours of an array of ``size`` items joined, in order; the array is passed n times, whatever its length."""
    wide = F.greatest(size - (n - 1), F.lit(1))
    out = F.slice(items, F.lit(1), wide)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(items, F.lit(k + 1), wide), join)
    return out


def grams(text: Column, n: int) -> Column:
    """The n-grams of a text, in order; the text itself where it is shorter; none of an empty one."""
    body = F.coalesce(text, F.lit(""))
    size = F.length(body)
    whole = F.when(size == 0, F.array().cast("array<string>")).otherwise(F.array(body))
    return F.when(size < n, whole).otherwise(sliding(F.split(body, ""), size, n, lambda a, b: F.concat(a, b)))


def set_cosine(a: Column, b: Column) -> Column:
    """Shared over the root of the sizes' product, of two gram sets; 0 where one is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    root = F.sqrt(F.size(x).cast("double") * F.size(y))
    return F.when(root == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / root)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def count_cosine(a: Column, b: Column) -> Column:
    """Cosine of two gram lists' counts; 0 where one is empty."""

    def count(of: Column, gram: Column) -> Column:
        return F.size(F.filter(of, lambda x: x == gram)).cast("double")

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.array_distinct(x), F.lit(0.0), lambda acc, g: acc + count(x, g) * count(y, g))

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def vector_cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is 0."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda acc, v: acc + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


def snippet(body: Column, terms: list[str], width: int) -> Column:
    """Blanks collapsed; the first term found and ``width`` characters around it, with ellipses."""
    flat = F.trim(F.regexp_replace(body, r"\s+", " "))
    at = F.coalesce(*[F.nullif(F.instr(F.lower(flat), term.lower()), F.lit(0)) for term in terms], F.lit(1))
    start = F.greatest(F.lit(1), at - width)
    part = F.substring(flat, start, F.lit(2 * width))
    return F.concat(F.when(start > 1, "…").otherwise(""), part, F.when(start + 2 * width - 1 < F.length(flat), "…").otherwise(""))


def version_array(version: Column) -> Column:
    """Numbers of a version's parts at ``.``, ``-`` and ``_``; -1 for what is no number."""
    return F.transform(F.split(version, r"[._-]"), lambda p: F.coalesce(p.try_cast("int"), F.lit(-1)))


def in_range(version: Column, low: Column, high: Column) -> Column:
    """Whether a version lies between two bounds, each open where null."""
    v = version_array(version)
    return (low.isNull() | (v >= version_array(low))) & (high.isNull() | (v <= version_array(high)))


def expired(date: Column, today: Column) -> Column:
    return (F.coalesce(date, F.lit("")) != "") & (date < today)


def est_tokens(text: Column) -> Column:
    """Characters without blanks over 1.6, plus one."""
    return F.floor(F.length(squash(text)) / 1.6).cast("int") + 1


def stable_id(name: Column) -> Column:
    """The name-based (version 5) uuid in the page name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(PAGE_SPACE)), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )


def row_fingerprint(fields: list[Column], prefix: str, digits: int) -> Column:
    """prefix and the first digits of a sha1 over the fields; empty where any field is."""
    blank = F.lit(False)
    for field in fields:
        blank = blank | (F.coalesce(field, F.lit("")) == "")
    body = F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *fields).cast("binary")), 1, digits))
    return F.when(blank, F.lit("")).otherwise(body)


def ab_arm(key: Column, explicit: Column, manual: Column) -> Column:
    """The arm named explicitly, else the manual one, else an even split by hash."""
    even = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 2), 16, 10).cast("int") % 2 == 0
    return F.coalesce(explicit, manual, F.when(even, "hint").otherwise("plain"))


def render_title(template: str, values: dict[str, Column]) -> Column:
    """A template with {name} places filled in."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def description_of(told: list[Column], unmapped: dict[str, Column], none: str = "（源表未提供）") -> Column:
    """The columns that describe a row, then the ones that map to nothing as ``【name】value``; blank ones are left out."""
    parts = [F.nullif(F.trim(c), F.lit("")) for c in told]
    parts += [F.concat(F.lit(f"【{name}】"), F.nullif(F.trim(c.cast("string")), F.lit(""))) for name, c in unmapped.items()]
    return F.coalesce(F.nullif(F.concat_ws("\n\n", *parts), F.lit("")), F.lit(none))


def derive_summary(definition: Column, note: Column, fallback: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (definition, note)], fallback)


def derive_aliases(names: Column, title: Column, most: int = 8) -> Column:
    """Distinct non-blank names that are not the title, at most ``most``."""
    kept = F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n.isNotNull() & (n != "") & (n != title))
    return F.slice(F.array_distinct(kept), 1, most)


def parse_locator(uri: Column) -> dict[str, Column]:
    """kind, target, section, error of pointers such as ``doc:12#page=3``, percent-decoded."""
    kind = F.regexp_extract(uri, r"^([a-z]+):", 1)
    section = F.nullif(F.regexp_extract(uri, "#(.*)$", 1), F.lit(""))
    target = F.url_decode(F.regexp_extract(uri, r"^[a-z]+:([^#]*)", 1))
    allowed = F.create_map(*[F.lit(x) for pair in (("doc", "page"), ("page", "section"), ("sheet", "row"), ("url", "text")) for x in pair])
    error = (
        F.when(~kind.isin("doc", "page", "sheet", "url", "graph", "session"), "unknown kind")
        .when(target == "", "no target")
        .when(section.isNotNull() & allowed[kind].isNull(), "no segment allowed")
        .when(section.isNotNull() & (F.element_at(F.split(section, "="), 1) != allowed[kind]), "wrong segment")
    )
    return {"kind": kind, "target": target, "section": section, "error": error}


def build_locator(kind: Column, target: Column, segment: Column, value: Column) -> Column:
    """The pointer that ``parse_locator`` reads back: ``kind:target#segment=value``, percent-encoded; null without a target."""
    encoded = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    tail = F.when(F.coalesce(segment, F.lit("")) != "", F.concat(F.lit("#"), segment, F.lit("="), encoded(value))).otherwise("")
    return F.when(F.coalesce(target, F.lit("")) != "", F.concat(kind, F.lit(":"), encoded(target), tail))
