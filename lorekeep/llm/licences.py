"""Licence scans: a trained paragraph classifier, confirmed against templates.

Every text is cut into paragraphs at blank lines, lines that were merely wrapped are joined again, and every
paragraph is read in overlapping windows of words, so that a notice inside a long paragraph is not thinned out.  A
sparse logistic regression over word n-grams scores each window.  It is trained here on variations of the families'
notices and, for the unknown class, on windows of a bounded sample of the corpus' own documents; a temperature
fitted on held-back examples of both calibrates it.  Windows of one family that touch are one finding, which is
confirmed if it holds enough of one of the family's templates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.licence_texts import CONFIRM, LEARN, NAMES, SAID, SAID_RESERVED, UNVERSIONED, said_by
from lorekeep.llm.shared import text_of

UNKNOWN = "unknown"
FAMILIES = (UNKNOWN, *NAMES)
#: Words of half a window: windows of 16 words overlap by 8, so a notice of up to 8 words lies whole in one.
HALF = 8
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
#: The unknown class is learned from whole documents: of the first so many by a hash of doc_id, those of at most so
#: many bytes, and of their windows so many.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_WINDOWS = 400, 16384, 3000
#: Share of a template's word pairs that confirms a prediction; names must stand there whole.
ENOUGH = 0.6
VARIATIONS = 24
#: Windows of scattered words of notices, and of repeated words, that are no notice.
CONFUSIONS = 900
#: Words kept in a worker's table of word hashes; a full table is emptied.
CACHE_WORDS = 600_000
#: Characters scored at once, to bound a worker's memory.
AT_ONCE = 1 << 20

_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_BLANK_LINE = re.compile(r"\n[ \t\r\f\v]*(?=\n)")
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Stretches between blank lines; a wrapped line's break is white space like any other."""
    edges = [0, *(m.end() for m in _BLANK_LINE.finditer(text)), len(text)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


class Grams:
    """Buckets of the one to three word n-grams."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}

    def hashes(self, words: list[str]) -> np.ndarray:
        import xxhash

        if len(self.index) > CACHE_WORDS:
            self.index = {}
        index, digest = self.index, xxhash.xxh3_64_intdigest
        for word in set(words).difference(index):
            index[word] = digest(word)
        return np.fromiter(map(index.__getitem__, words), np.uint64, len(words))

    def buckets(self, words: list[str], left: np.ndarray) -> np.ndarray:
        """A row per word: buckets of the n-grams that begin there; BUCKETS for one that runs past the paragraph.

        ``left`` counts the words from each one to its paragraph's end, itself included.
        """
        h = self.hashes(words)
        out = np.full((len(h), 3), BUCKETS, np.int32)
        total = h * _STEPS[0]
        out[:, 0] = total >> np.uint64(64 - BUCKET_BITS)
        for n in (1, 2):
            if len(h) > n:
                total = (total[:-1] ^ (total[:-1] >> np.uint64(29))) * _STEPS[n] + h[n:]
                own = (total * _STEPS[0] >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
                out[: len(own), n] = np.where(left[: len(own)] > n, own, BUCKETS)
        return out

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of one window and their values."""
        own = self.buckets(words, np.arange(len(words), 0, -1)).ravel()
        found, n = np.unique(own[own < BUCKETS], return_counts=True)
        return found, n / max(1.0, n.sum() ** 0.5)


def _pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False)) or {(w, "") for w in words}


def _templates() -> list[tuple[str, set[tuple[str, str]], float]]:
    """family, word pairs and how many of them are enough, of passages and names; a name of one word stands alone."""
    made = [(f, _pairs(words_of(t)), ENOUGH) for f, ts in CONFIRM.items() for t in ts]
    return made + [(f, _pairs(words_of(n)), 1.0) for f, ns in NAMES.items() for n in ns]


_TEMPLATES = _templates()


def confirmed(words: list[str], family: str | None = None) -> bool:
    """Whether the words hold enough of a template, of the family or of any; versions are confirmed by what they share too."""
    own = _pairs(words) | {(w, "") for w in words}
    fits = (None,) if family is None else (family, *(f for f, versions in UNVERSIONED.items() if family in versions))
    return any((family is None or f in fits) and len(t & own) >= share * len(t) for f, t, share in _TEMPLATES)


class Classifier:
    """Multinomial logistic regression on hashed n-grams, with a temperature."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float) -> None:
        self.weights, self.bias, self.temperature = weights, bias, temperature  # the last row stands for no n-gram
        self.grams = Grams()

    def _chances(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        p = np.exp(z - z.max(axis=-1, keepdims=True))
        return p / p.sum(axis=-1, keepdims=True)

    def predict(self, text: str) -> tuple[str, float]:
        """The family of one window."""
        own, value = self.grams.features(words_of(text))
        p = self._chances(self.bias + value @ self.weights[own])
        return FAMILIES[int(p.argmax())], float(p.max())

    def scan(self, texts: list[str]) -> list[list[tuple[str, float, bool, int, int]]]:
        """The findings of each text: family, probability, confirmed, start, end."""
        words: list[str] = []
        owner, begin, sizes = [], [], []  # of each paragraph with words: its text, its place there, its words
        for n, text in enumerate(texts):
            for a, b in paragraphs(text):
                own = words_of(text[a:b])
                if own:
                    words += own
                    owner.append(n)
                    begin.append((a, b))
                    sizes.append(len(own))
        out: list[list[tuple[str, float, bool, int, int]]] = [[] for _ in texts]
        if not words:
            return out
        size = np.array(sizes)
        first = np.cumsum(size) - size
        place = np.arange(len(words)) - np.repeat(first, size)
        buckets = self.grams.buckets(words, np.repeat(size, size) - place)
        parts = np.flatnonzero(place % HALF == 0)
        given = self.weights[buckets[:, 0]]
        for n in (1, 2):
            given += self.weights[buckets[:, n]]
        sums = np.add.reduceat(given, parts, axis=0).astype(np.float64)
        counts = np.add.reduceat((buckets < BUCKETS).sum(axis=1), parts)
        # a window is a half and the next one of its paragraph; a paragraph of one half is a window by itself
        halves = -(-size // HALF)
        paragraph = np.repeat(np.arange(len(size)), halves)
        half = np.arange(len(parts)) - np.repeat(np.cumsum(halves) - halves, halves)
        more = half + 1 < halves[paragraph]
        sums[:-1][more[:-1]] += sums[1:][more[:-1]]
        counts[:-1][more[:-1]] += counts[1:][more[:-1]]
        p = self._chances(self.bias + sums / np.sqrt(np.maximum(counts, 1))[:, None])
        best = p.argmax(axis=1)
        hits = np.flatnonzero((best > 0) & (more | (half == 0)))
        spans: list[tuple[int, int]] = []
        spans_of = -1  # the paragraph whose words' places are known
        for family, group in runs(hits, best, paragraph):
            one = int(paragraph[group[0]])
            a, b = begin[one]
            low, high = int(half[group[0]]) * HALF, min(sizes[one], (int(half[group[-1]]) + 2) * HALF)
            at = int(first[one])
            family = said_by(family, words[at + low : at + high])
            sure = confirmed(words[at + low : at + high], family)
            if spans_of != one:
                spans, spans_of = places(texts[owner[one]][a:b]), one
            chance = float(p[group, best[group]].max())
            out[owner[one]].append((family, chance, sure, a + spans[low][0], a + spans[high - 1][1]))
        return out


def runs(hits: np.ndarray, best: np.ndarray, paragraph: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """Windows of a paragraph that follow each other and are of one family; text without a version goes with its version."""
    held: list[int] = []
    family = ""
    for hit in hits.tolist():
        own = FAMILIES[int(best[hit])]
        joins = bool(held) and hit == held[-1] + 1 and paragraph[hit] == paragraph[held[-1]]
        if joins and (own == family or family in UNVERSIONED.get(own, ())):
            held.append(hit)
        elif joins and own in UNVERSIONED.get(family, ()):
            held.append(hit)
            family = own
        else:
            if held:
                yield family, np.array(held)
            held, family = [hit], own
    if held:
        yield family, np.array(held)


def places(text: str) -> list[tuple[int, int]]:
    """Where each word of a text stands; lower case may be longer than the text."""
    lower = text.lower()
    spans = [m.span() for m in _WORD.finditer(lower)]
    if len(lower) == len(text):
        return spans
    origin = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(origin[a], origin[b - 1] + 1) for a, b in spans]


def windows_of(words: list[str]) -> list[list[str]]:
    """The windows of a paragraph's words."""
    return [words[at : at + 2 * HALF] for at in range(0, max(1, len(words) - HALF), HALF)] if words else []


def examples(unknown: list[str], seed: int = 5) -> list[tuple[list[str], int]]:
    """Windows and their labels: notices with words dropped amid the corpus' words, and the corpus' own windows."""
    r = np.random.default_rng(seed)
    own = [w for t in unknown for a, b in paragraphs(t) for w in windows_of(words_of(t[a:b]))]
    own = [w for w in own if not confirmed(w)]
    filler = np.array([w for window in own for w in window] or ["text"], dtype=object)

    def some(low: int, high: int) -> list[str]:
        return filler[r.integers(0, len(filler), r.integers(low, high))].tolist()

    rows = []

    def amid(kept: list[str], family: str) -> None:
        """A window that begins near the start of the words, amid others."""
        before = some(0, 2 * HALF)
        text = [*before, *kept, *some(0, 2 * HALF)]
        at = max(0, min(len(before), int(r.integers(-HALF, HALF // 2)) + len(before)))
        tell(text[at : at + 2 * HALF], family)

    def tell(window: list[str], family: str) -> None:
        rows.append((window, FAMILIES.index(said_by(family, window))))

    for family in NAMES:
        for name in NAMES.get(family, ()):
            for said in SAID_RESERVED * 4 if family == "proprietary" else SAID:
                words = words_of(said.format(name))
                for _ in range(VARIATIONS // 4):
                    amid(words, family)
        for passage in LEARN.get(family, ()):
            words = words_of(passage)
            for n in range(VARIATIONS):
                kept = [w for w in words if n < 4 or r.random() > 0.08]
                amid(kept, family)
                # and any window of it, as it stands in a whole notice
                at = int(r.integers(0, max(1, len(kept) - HALF)))
                if len(kept) - at >= HALF:
                    tell(kept[at : at + 2 * HALF], family)
    # words that notices are made of, alone among others, are no notice
    telling = sorted({w for table in (LEARN, NAMES) for ts in table.values() for t in ts for w in words_of(t)})
    for n in range(CONFUSIONS):
        around = some(3, 2 * HALF)
        for _ in range(n % 3):
            around.insert(int(r.integers(0, len(around))), str(r.choice(telling)))
        rows.append((around, 0))
    rows += [(some(1, 3) * HALF, 0) for _ in range(CONFUSIONS)]  # repeated words
    picked = r.permutation(len(own))[:SAMPLE_WINDOWS]
    return rows + [(own[i], 0) for i in picked]


def train(unknown: list[str], seed: int = 5) -> Classifier:
    """Fits on four fifths of the examples and calibrates on the rest."""
    r = np.random.default_rng(seed)
    model = Classifier(np.zeros((BUCKETS + 1, len(FAMILIES))), np.zeros(len(FAMILIES)), 1.0)
    rows = [(*model.grams.features(words), label) for words, label in examples(unknown, seed)]
    order = r.permutation(len(rows))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    for epoch in range(12):
        for i in r.permutation(used):
            own, value, label = rows[i]
            z = model.bias + value @ model.weights[own]
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            rate = 0.5 / (1 + epoch)
            model.weights[own] -= rate * value[:, None] * p
            model.bias -= 0.1 * rate * p
    z = np.array([model.bias + rows[i][1] @ model.weights[rows[i][0]] for i in held])
    labels = np.array([rows[i][2] for i in held])

    def loss(t: float) -> float:
        s = z / t - (z / t).max(axis=1, keepdims=True)
        return float(-(s[np.arange(len(s)), labels] - np.log(np.exp(s).sum(axis=1))).mean())

    model.temperature = min(np.geomspace(0.2, 5, 25).tolist(), key=loss)
    return model


def sample_of(texts: DataFrame) -> list[str]:
    """Whole texts of the bounded sample.  The ids are picked first, so no other text leaves its task."""
    ids = texts.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    met = texts.join(F.broadcast(ids), "doc_id", "left_semi").where(F.octet_length("text") <= SAMPLE_BYTES)
    found = met.groupBy("doc_id").agg(F.min("text").alias("text")).collect()  # SAMPLE_DOCS * SAMPLE_BYTES at most
    return [row["text"] for row in sorted(found, key=lambda row: row["doc_id"])]


def licence_findings(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, findings (family, probability, confirmed, start, end; code points).

    A window of the unknown class gives no finding.  Null and empty texts have no findings; each repeated row has
    its own; an empty table gives an empty result; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), text_of().alias("text"))
    model = train(sample_of(texts))
    weights, bias, temperature = model.weights.astype(np.float32), model.bias, model.temperature
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 7 MB, whatever the input
    names = ["family", "probability", "confirmed", "start", "end"]

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Classifier(shared.value, bias, temperature)
        for frame in frames:
            rows: list[list[dict]] = []
            batch: list[str] = []
            held = 0
            for text in frame["text"]:
                batch.append(text)
                held += len(text)
                if held > AT_ONCE:
                    rows += [[dict(zip(names, f, strict=True)) for f in found] for found in own.scan(batch)]
                    batch, held = [], 0
            rows += [[dict(zip(names, f, strict=True)) for f in found] for found in own.scan(batch)]
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "findings": rows})

    one = "struct<family:string,probability:double,confirmed:boolean,start:int,end:int>"
    found = texts.mapInPandas(scan, f"doc_id string, findings array<{one}>")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_confirmed, families (confirmed ones), findings as text."""
    sure = F.filter("findings", lambda f: f["confirmed"])
    told = F.transform("findings", lambda f: F.concat_ws(":", f["family"], f["start"], f["end"]))
    return found.select(
        "doc_id",
        F.size("findings").cast("long").alias("n_paragraphs"),
        F.size(sure).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda f: f["family"]))), ",").alias("families"),
        F.array_join(told, ",").alias("findings"),
    )
