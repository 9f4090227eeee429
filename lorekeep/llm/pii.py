"""Personal data, and the terms that give it away.

Base detectors find email addresses, IP numbers, payment cards and phone numbers.  Each distinct value is a
protected entity.  Over the whole corpus, counts of the documents that hold a term and an entity, and the term at
all, estimate how much the term reveals: its pointwise mutual information with the entity, as a share of the
entity's own information.  Terms above the disclosure threshold are removed wherever they stand in any document,
together with the values.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Container, Iterable, Iterator
from itertools import chain, product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.shared import bounded_broadcast, free_name, stored, text_of

KINDS = ("email", "ip", "card", "phone")
#: Share of an entity's information that a term may reveal, and the documents that must show it.
DISCLOSURE = 0.8
SUPPORT = 2
#: The filter of admissible terms: so many numbers of 64 bits (8 MB), whatever the corpus holds.
FILTER_WORDS = 1 << 20
#: Entities, and revealing terms, may be broadcast up to so many rows (10 MB); longer tables are joined by a shuffle.
BROADCAST_TERMS = 100_000
#: Things counted in a task before they leave it, and rows whose words are spread at once, to bound a worker's memory.
MOST_COUNTED, SPREAD_ROWS = 500_000, 200

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^ \t-\r]+")
_HINT = re.compile(r"[0-9@]")  # no value without one
_TRIM = "\"'.,;:!?()[]{}<>|*$#%&"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches around each ``@``, in one pass over the text."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def entity(kind: str, value: str) -> str:
    """A value's protected entity: what it names, without its spelling."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else _digits(value)}"


def words_of(text: str) -> list[str]:
    """The words of a text in order, in lower case, without marks at their ends."""
    return [w.decode("utf-8", "surrogatepass").strip(_TRIM) for w in text.lower().encode("utf-8", "surrogatepass").split()]


def read(text: str) -> tuple[list[tuple[str, int, int]], str]:
    """The base spans of a text, and the text with blanks in place of them: what is left are the words that are no values."""
    spans = base_spans(text) if _HINT.search(text) else []
    return spans, blanked(text, spans) if spans else text


def blanked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with blanks in place of the spans; all other places stay."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        start = max(start, at)
        if end > start:
            out += [text[at:start], " " * (end - start)]
            at = end
    return "".join([*out, text[at:]])


def text_key() -> Column:
    """The key of a row's spans: they follow from its text alone, so rows of one text share them, whatever their doc_id."""
    return F.sha2(text_of().cast("binary"), 256).alias("text_sha256")


def _counted(docs: DataFrame, tell: Callable[[str], Iterable], names: list[str]) -> DataFrame:
    """How many documents tell each thing: ``tell`` gives the distinct things of a text, a batch's are added up before they leave it."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            met: Counter = Counter()
            for text in frame["text"]:
                met.update(tell(text))
                if len(met) > MOST_COUNTED:
                    yield table(met)
                    met = Counter()
            if met:
                yield table(met)

    def table(met: Counter) -> pd.DataFrame:
        columns = zip(*met, strict=True) if len(names) > 1 else [met]
        return pd.DataFrame({**dict(zip(names, map(list, columns), strict=True)), "n": list(met.values())})

    rows = docs.select(text_of().alias("text")).mapInPandas(count, ", ".join(f"{n} string" for n in names) + ", n long")
    return rows.groupBy(*names).agg(F.sum("n").alias("n"))


def entities_of(text: str) -> set[str]:
    return {entity(kind, text[a:b]) for kind, a, b in read(text)[0]}


def term_filter(terms: DataFrame) -> np.ndarray:
    """A bit for the hash of every ``term``: ``FILTER_WORDS`` numbers of 64 bits whatever their count."""
    bit = F.pmod(F.xxhash64("term"), F.lit(FILTER_WORDS * 64))
    word, place = F.shiftright(bit, 6), F.pmod(bit, F.lit(64)).cast("int")
    rows = terms.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("bits")).toArrow()
    bits = np.zeros(FILTER_WORDS, np.int64)
    bits[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return bits


def passed(bits: np.ndarray, words: set[str]) -> list[str]:
    """The words whose bit is set."""
    held = list(words)
    hashes = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) for w in held], np.uint64).view(np.int64)
    place = hashes % (len(bits) * 64)
    fine = bits[place >> 6] >> (place & 63) & 1
    return [w for w, yes in zip(held, fine.tolist(), strict=True) if yes]


def revealing_terms(docs: DataFrame, threshold: float, support: int) -> DataFrame:
    """entity, term, disclosure of the terms that reveal an entity, over all documents.

    disclosure = log(P(entity | term) / P(entity)) / -log P(entity), from counts of documents.  A pair needs
    ``support`` documents, so its entity and its term need as many; and as no more documents hold both than hold the
    entity, the threshold bounds how many may hold the term.  Both are exact, and leave few pairs to be joined.
    """
    n = float(max(1, docs.count()))
    entities = stored(_counted(docs, entities_of, ["entity"]).where(F.col("n") >= support).withColumnRenamed("n", "with_entity"), "pii-entities")
    # a little more than the bound, as powers are rounded
    most = F.lit(n * (1 + 1e-9)) * F.pow(F.col("with_entity") / F.lit(n), F.lit(float(threshold)))
    total, highest = entities.agg(F.count("*"), F.max(most)).first()
    terms = _counted(docs, lambda text: set(words_of(read(text)[1])) - {""}, ["term"])
    counts = stored(terms.where(F.col("n").between(support, highest if highest is not None else 0.0)).withColumnRenamed("n", "with_term"), "pii-counts")
    # words that are no admissible terms are not paired: a filter of fixed size knows all that are, and few others
    bits = docs.sparkSession.sparkContext.broadcast(term_filter(counts))
    # entities met too rarely need not be paired, where they are few enough to be told
    known = None
    if total <= BROADCAST_TERMS:
        known = docs.sparkSession.sparkContext.broadcast(frozenset(r["entity"] for r in entities.select("entity").toLocalIterator()))

    def pairs(text: str) -> Iterator[tuple[str, str]]:
        spans, rest = read(text)
        own = {entity(kind, text[a:b]) for kind, a, b in spans}
        own = own if known is None else own & known.value
        return product(own, passed(bits.value, set(words_of(rest)) - {""})) if own else iter(())

    paired = _counted(docs, pairs, ["entity", "term"]).where(F.col("n") >= support).withColumnRenamed("n", "together")
    paired = paired.join(counts, "term").join(bounded_broadcast(entities, total, BROADCAST_TERMS), "entity")
    information = -F.log(F.col("with_entity") / F.lit(n))
    gain = F.log(F.col("together") / F.col("with_term") * F.lit(n) / F.col("with_entity"))
    joined = paired.withColumn("disclosure", F.when(information > 0, gain / information).otherwise(F.lit(0.0)))
    return joined.where(F.col("disclosure") >= threshold).select("entity", "term", "disclosure")


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def personal_data(docs: DataFrame, threshold: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """doc_id, text_sha256, base and spans (kind, start, end) of every row: base kinds, and ``term`` for revealing terms.

    A revealing term is marked wherever it stands, in documents without the value too.  Null and empty texts have no
    spans; repeated rows are documents of their own in the counts; an empty table gives an empty result; columns
    other than doc_id and text are ignored.
    """
    telling = stored(revealing_terms(docs, threshold, support).select("term").distinct(), "pii-telling")
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), text_key(), text_of().alias("text"))
    if telling.count() <= BROADCAST_TERMS:
        told = docs.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in telling.toLocalIterator()))
        return _marked(rows, lambda texts, _: [told.value] * len(texts))
    # too many terms for a task: each text's words are joined with them, and the row gets its own terms back
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()), "pii-rows")

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), SPREAD_ROWS):
                part = frame.iloc[at : at + SPREAD_ROWS]
                own = [sorted(set(words_of(read(text)[1])) - {""}) for text in part["text"]]
                yield pd.DataFrame({"rid": part["rid"].repeat([len(x) for x in own]).array, "term": pd.Series(list(chain.from_iterable(own)), dtype=object)})

    met = rows.select("rid", "text").mapInPandas(spread, "rid long, term string").join(telling, "term", "left_semi")
    met = met.groupBy("rid").agg(F.collect_list("term").alias("terms"))  # words of one text
    return _marked(rows.join(met, "rid", "left").drop("rid"), lambda texts, terms: [() if t is None else set(t) for t in terms])


def _marked(rows: DataFrame, wanted: Callable[[pd.Series, pd.Series | None], list]) -> DataFrame:
    """The spans of rows (doc_id, text_sha256, text and perhaps terms); ``wanted`` gives the terms to mark in each."""

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            base, every = [], []
            for text, terms in zip(frame["text"], wanted(frame["text"], frame.get("terms")), strict=True):
                spans, rest = read(text)
                marks = [("term", a, b) for a, b in placed(rest, terms)] if terms else []
                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans])
                every.append(base[-1] + [dict(zip(("kind", "start", "end"), s, strict=True)) for s in marks])
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "text_sha256": frame["text_sha256"].array, "base": base, "spans": every})

    found = rows.mapInPandas(mark, f"doc_id string, text_sha256 string, base {_SPANS}, spans {_SPANS}")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def placed(text: str, terms: Container[str]) -> list[tuple[int, int]]:
    """start, end of the words of a text that are among ``terms``, without marks at their ends."""
    words = words_of(text)
    places = {n for n, w in enumerate(words) if w in terms and w}
    out = []
    if places:
        for n, m in enumerate(_WORD.finditer(text)):
            if n in places:
                start = m.end() - len(m[0].lstrip(_TRIM))
                out.append((start, start + len(m[0].strip(_TRIM))))
    return out


def sanitised(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with base values generalised to their kind and revealing terms removed."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start < at:
            at = max(at, end)
            continue
        out += [text[at:start], "" if kind == "term" else f"<{kind}>"]
        at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with ``clean_text``, by the spans of ``personal_data``: each row's own, found by the key of its text.

    A column ``clean_text`` that ``docs`` has already is replaced.
    """
    key, marks = free_name(docs, "key"), free_name(docs, "marks")
    own = spans.select(F.col("text_sha256").alias(key), F.col("spans").cast(_SPANS).alias(marks)).dropDuplicates([key])

    def clean(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series(
            [sanitised(t, [(s["kind"], s["start"], s["end"]) for s in m] if m is not None else []) for t, m in zip(texts, found, strict=True)]
        )

    joined = docs.withColumn(key, text_key()).join(own, key, "left")
    return joined.withColumn("clean_text", F.pandas_udf(clean, "string")(text_of(), F.col(marks))).drop(key, marks)


def _equal(kind: str):
    return lambda one: one == kind


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``personal_data``."""

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, _equal(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans")
    )

