"""Packing documents into token windows with their lexical neighbours.

Document frequencies and the mean length are counted over all documents.  By them each document gets its two most
telling terms, documents are ordered along these and dealt to tasks by ranges of the order, and every stretch of
bounded size in it is a shard: a BM25 inverted index over token ids with the corpus' own statistics.  The document
that opens a window is the query with all its terms, and its best unused neighbours fill the window.  The last
document of a window is cut where the window ends and its rest opens the next one, so windows are full; what is left
of a shard at the end is cut into lengths that are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.shared import stored
from lorekeep.llm.tokens import TERMS, public_path, term_counts
from lorekeep.llm.wavelet import tokenised

WINDOW = 1024
END_ID = 0
#: Ids of a shard, about: the index and the documents of one shard are held by one task at a time.
SHARD_IDS = 1 << 17
#: Ids of a range of the lexical order, about: a task streams through its range shard by shard.
RANGE_IDS = 1 << 21
#: Documents whose terms are counted at once, to bound a worker's memory.
CHUNK = 400
K1, B = 1.2, 0.75

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


@dataclass(frozen=True)
class Corpus:
    """Statistics over all documents: each term's inverse document frequency, and the mean length."""

    idf: np.ndarray
    mean: float

    @classmethod
    def of(cls, df: np.ndarray, n: int, tokens: int) -> Corpus:
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        idf[df < 2] = 0  # a term of one document leads nowhere
        return cls(idf, max(1.0, tokens / max(1, n)))

    def weights(self, docs: np.ndarray, terms: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        norm = K1 * (1 - B + B * lengths / self.mean)
        return self.idf[terms] * tf * (K1 + 1) / (tf + norm[docs])


def leading_terms(ids: list[np.ndarray], corpus: Corpus) -> tuple[np.ndarray, np.ndarray]:
    """Each document's two terms of greatest weight; the smaller term where weights are equal, -1 where there is none."""
    docs, terms, tf = term_counts(ids)
    weights = corpus.weights(docs, terms, tf, np.array([len(one) for one in ids], np.int64))
    starts = np.flatnonzero(np.diff(docs, prepend=-1))  # every document has its end id
    out = []
    for _ in range(2):
        best = np.maximum.reduceat(weights, starts)
        at = np.flatnonzero(weights == best[docs])
        at = at[np.diff(docs[at], prepend=-1) > 0]
        out.append(np.where(best > 0, terms[at], -1))
        weights[at] = 0
    return out[0], out[1]


class Bm25:
    """An inverted index over the documents of a shard; terms are token ids, statistics are the corpus'."""

    def __init__(self, ids: list[np.ndarray], corpus: Corpus) -> None:
        self.n = len(ids)
        docs, terms, tf = term_counts(ids)
        weights = corpus.weights(docs, terms, tf, np.array([len(one) for one in ids], np.int64))
        self.terms = terms  # document after document
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=self.n))])
        order = np.argsort(terms.astype(np.uint16), kind="stable")
        self.docs, self.weights = docs[order], weights[order]
        self.ends = np.cumsum(np.bincount(terms, minlength=TERMS))
        self.places = np.arange(len(terms))

    def scores(self, doc: int) -> np.ndarray:
        """Each document's score for ``doc`` as the query, by all its terms."""
        terms = self.terms[self.begin[doc] : self.begin[doc + 1]]
        ends = self.ends[terms]
        lengths = ends - np.where(terms > 0, self.ends[terms - 1], 0)
        met = np.cumsum(lengths)
        at = np.repeat(ends - met, lengths)
        at += self.places[: len(at)]
        return np.bincount(self.docs[at], self.weights[at], self.n)

    def neighbours(self, doc: int, unused: np.ndarray) -> list[int]:
        """Unused documents that share a telling term with ``doc``, the best first, ties by their order."""
        scores = self.scores(doc)
        found = np.flatnonzero(unused & (scores > 0))
        return found[np.argsort(-scores[found], kind="stable")].tolist()


def fill_windows(ids: list[np.ndarray], corpus: Corpus, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a shard's documents."""
    index = Bm25(ids, corpus)
    unused = np.ones(len(ids), bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    opened: list[tuple[int, int, int]] = []  # of the window being filled
    sequence, room, seed, first = 0, window, -1, 0
    near: Iterator[int] | None = None
    for _ in range(len(ids)):
        doc = -1
        if seed >= 0:
            if near is None:
                near = iter(index.neighbours(seed, unused))
            doc = next((d for d in near if unused[d]), -1)
        if doc < 0:
            while not unused[first]:
                first += 1
            doc = first
        unused[doc] = False
        at, total = 0, len(ids[doc])
        if room == window:
            seed, near = doc, None
        while at < total:
            take = min(room, total - at)
            opened.append((doc, at, take))
            at, room = at + take, room - take
            if not room:
                offset = 0
                for d, s, n in opened:
                    pieces.append((d, s, n, sequence, offset))
                    offset += n
                opened, room, sequence = [], window, sequence + 1
                seed, near = (doc if at < total else -1), None
    left = window - room
    sizes = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
    offset = 0
    for d, s, n in opened:
        while n:
            take = min(n, sizes[0] - offset)
            pieces.append((d, s, take, sequence, offset))
            s, n, offset = s + take, n - take, offset + take
            if offset == sizes[0]:
                sizes.pop(0)
                sequence, offset = sequence + 1, 0
    return pieces


def corpus_of(encoded: DataFrame) -> Corpus:
    """The statistics of all documents, from what their batches counted: at most a row per term comes to the driver."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(TERMS, np.int64)
        for frame in frames:
            for data in frame["terms"]:
                counted = np.frombuffer(data, "<u4")
                df[counted[: len(counted) // 2]] += counted[len(counted) // 2 :]
        met = np.flatnonzero(df)
        if len(met):
            yield pd.DataFrame({"term": met.astype(np.int32), "df": df[met]})

    counted = encoded.where("terms is not null").select("terms").mapInPandas(add, "term int, df long")
    rows = counted.groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(TERMS, np.int64)
    df[rows["term"].to_numpy()] = rows["df"].to_numpy()
    n, tokens = encoded.agg(F.count("*"), F.sum("n_tokens")).first()
    return Corpus.of(df, n, tokens or 0)


def pack(docs: DataFrame, path: str | None = None, shard_ids: int = SHARD_IDS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (``with_ids``: ids too).

    A null text is empty and gives the end id alone.  Repeated rows are packed each for itself.  An empty table
    gives an empty result.  Columns other than doc_id and text are ignored.
    """
    path = path or public_path("byte_bpe_50k.json")
    encoded = stored(tokenised(docs, path, True, END_ID, frequencies=True), "pack-ids")
    tokens = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    corpus = docs.sparkSession.sparkContext.broadcast(corpus_of(encoded))  # two numbers per term, half a megabyte

    def lead(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), CHUNK):
                part = frame.iloc[at : at + CHUNK].reset_index(drop=True)
                first, second = leading_terms([np.frombuffer(x, "<u2") for x in part["ids"]], corpus.value)
                yield part.assign(first=first.astype(np.int32), second=second.astype(np.int32))

    def pack_range(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys: list[str | None] = []
        ids: list[np.ndarray] = []
        held, made, task = 0, 0, 0
        for frame in frames:
            for key, data, part in zip(frame["doc_id"], frame["ids"], frame["part"], strict=True):
                task = int(part)
                keys.append(None if pd.isna(key) else key)
                ids.append(np.frombuffer(data, "<u2"))
                held += len(ids[-1])
                if held >= shard_ids:
                    packed, n = pack_shard(keys, ids, (task << 32) + made)
                    yield packed
                    keys, ids, held, made = [], [], 0, made + n
        if ids:
            yield pack_shard(keys, ids, (task << 32) + made)[0]

    def pack_shard(keys: list[str | None], ids: list[np.ndarray], base: int) -> tuple[pd.DataFrame, int]:
        at, start, length, sequence, offset = map(np.array, zip(*fill_windows(ids, corpus.value), strict=True))
        cuts = [ids[d][s : s + n].astype("<u4").tobytes() for d, s, n in zip(at, start, length, strict=True)]
        out = pd.DataFrame(
            {
                "doc_id": [keys[d] for d in at],
                "start": start,
                "length": length,
                "ids_crc32": [zlib.crc32(c) for c in cuts],
                "doc_tokens": [len(ids[d]) for d in at],
                "sequence_id": base + sequence,
                "offset": offset,
            }
        )
        return out.assign(ids=cuts) if with_ids else out, int(sequence.max()) + 1

    rows = encoded.select(F.col("doc_id").cast("string").alias("doc_id"), "ids")
    led = rows.mapInPandas(lead, "doc_id string, ids binary, first int, second int")
    # documents of one pair of terms are spread by a hash, so that many copies are dealt to several ranges
    order = ["first", "second", F.xxhash64("doc_id"), "doc_id", "ids"]
    dealt = led.repartitionByRange(max(1, -(-int(tokens) // RANGE_IDS)), *order[:3]).sortWithinPartitions(*order)
    dealt = dealt.select("doc_id", "ids", F.spark_partition_id().alias("part"))
    schema = PIECES.replace("doc_id long", "doc_id string") + (", ids binary" if with_ids else "")
    return dealt.mapInPandas(pack_range, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
