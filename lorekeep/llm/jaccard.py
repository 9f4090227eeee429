"""Exact n-gram Jaccard join by parity sketches.

A document is the set of its word shingles' 64-bit hashes.  Per size band the hash space is cut into parts, and a
part's parity is the XOR of the hashes in it; parts that differ are at most as many as the shingles that differ.
Documents within the threshold differ in at most ``d`` shingles, so of any ``d + 1`` parts one is equal
(pigeonhole): each document is joined by the parities of its first ``d + 1`` parts, and candidates are verified on
their texts.  Parts that are empty in both prove nothing, so some more are taken; a document with too many empty
ones is also joined under another cut.

Documents with equal sets are one class.  A parity shared by several classes first links them to one hub.  Classes
that are still apart are compared pair by pair where a parity is shared by few; where it is shared by many, an exact
filter on their rarest shingles picks the pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.graph import components
from lorekeep.llm.shared import batches_of, bounded_broadcast, discard, stored, stored_parts, text_of, tidy
from lorekeep.llm.tokens import BLOCK_BYTES, segment_hashes, words_in

#: Bits of a parity key; a chance collision only costs a verification.
KEY_BITS = 48
#: Cuts tried by documents with many empty parts; under the last one empty parts are keys as well.
CUTS = 4
#: Slices of the key space, joined one after another so that only one slice's shuffle files stand on disk at a time.
SLICES = 4
#: Groups of equal sets (40 bytes each) are broadcast up to this many.
BROADCAST_HEADS = 400_000
#: Rows of whole texts that a worker is given at once.
BATCH_ROWS = 1000
#: Rounds in which a parity's classes are compared with one hub before they are compared pair by pair.
HUB_ROUNDS = 2
#: A parity of at most so many classes is compared pair by pair; of a larger one the rarest shingles are joined.
SMALL_GROUP = 12
#: Cells of the shingle frequency table, as a power of two: its size does not depend on the input.
RARITY_BITS = 20
#: Class numbers (8 bytes each) of the candidates are broadcast up to this many.
BROADCAST_CANDIDATES = 400_000

_SLICED = [f"keys_{n}" for n in range(SLICES)]
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finishing mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Shingle sets of texts; A-Z are lower-cased and words end at ``[\\x20\\x09-\\x0D]``."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.powers = np.array([pow(0x9E3779B97F4A7C15 | 1, width - 1 - i, 1 << 64) for i in range(width)], np.uint64)

    def sets_of(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's sorted distinct hashes; a text of fewer words is one shingle, one without words none."""
        if not texts:
            return []
        data, starts, ends, owner = words_in([text.encode("utf-8", "surrogatepass").lower() for text in texts])
        a, b = segment_hashes(np.frombuffer(data, np.uint8), starts, ends)
        h = _mixed(a) + b
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
        n = max(0, len(h) - self.width + 1)
        total = np.zeros(n, np.uint64)
        for i, power in enumerate(self.powers):
            total += h[i : i + n] * power
        total = _mixed(total)
        return [self._set(total, h, first, end) for first, end in zip(bounds[:-1], bounds[1:], strict=True)]

    def _set(self, total: np.ndarray, h: np.ndarray, first: int, end: int) -> np.ndarray:
        if first == end:
            return np.zeros(0, np.uint64)
        if end - first < self.width:
            whole = end - first
            for one in h[first:end].tolist():
                whole = (whole * int(_ODD[1]) + one) & (1 << 64) - 1
            return _mixed(np.array([whole], np.uint64) ^ _ODD[2])
        own = np.sort(total[first : end - self.width + 1])
        fresh = np.empty(len(own), bool)
        fresh[0] = True
        np.not_equal(own[1:], own[:-1], out=fresh[1:])
        return own[fresh]

    def in_blocks(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The sets of many texts, computed some texts at a time."""
        block, held = [], 0
        for text in texts:
            if block and held + len(text) > BLOCK_BYTES:
                yield from self.sets_of(block)
                block, held = [], 0
            block.append(text)
            held += len(text)
        yield from self.sets_of(block)

    def set_of(self, text: str) -> np.ndarray:
        return self.sets_of([text])[0]


class Bands:
    """Size bands and the numbers of parts for similarity ``num / den``."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.ratio = max(2.0, den / num + 0.05)

    def differ(self, size: int) -> int:
        """Most shingles by which a document of this size differs from one within the threshold."""
        return (self.den - self.num) * (size + size * self.den // self.num) // (self.den + self.num)

    @staticmethod
    def slack(parts: int) -> int:
        """Empty parts allowed for."""
        return 1 + -(-parts * 6 // 100)

    def parts(self, size: int) -> int:
        """Parts whose parities a document of this size is joined by."""
        d = self.differ(size) + 1
        return d + self.slack(d)

    def upper(self, band: int) -> int:
        return int(6 * self.ratio**band)

    def of(self, size: int) -> list[int]:
        """The document's band, and the next one if a document there can still be similar."""
        band = 0
        while self.upper(band) < size:
            band += 1
        return [band, band + 1] if self.den * size >= self.num * (self.upper(band) + 1) else [band]

    def sketch(self, hashes: np.ndarray) -> bytes:
        """Parity of the hashes at each of M bits, M a power of two that grows with the band."""
        bits = 8 << self.of(len(hashes))[0]
        counts = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
        return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()

    def far(self, a: bytes, b: bytes, size_a: int, size_b: int) -> bool:
        """Whether the sketches alone show that two sets are not within the threshold."""
        x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        if len(x) != len(y):  # the longer one folds onto the shorter
            x, y = (x, y) if len(x) < len(y) else (y, x)
            y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
        apart = int(np.bitwise_count(x ^ y).sum())
        return apart * (self.den + self.num) > (self.den - self.num) * (size_a + size_b)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """Parity keys of a set; none where only an equal set is within the threshold."""
        n = len(hashes)
        if not n or not self.differ(n):
            return np.zeros(0, np.int64)
        wanted, out = self.parts(n), []
        for band in self.of(n):
            cut_in = self.parts(self.upper(band))
            first = min(wanted, cut_in)
            spare = first - self.differ(n) - 1
            for cut in range(CUTS):
                seed = np.uint64((band * CUTS + cut + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                part = ((_mixed(hashes + seed) >> np.uint64(32)) * np.uint64(cut_in) >> np.uint64(32)).astype(
                    np.uint16 if cut_in < 1 << 16 else np.int64  # 16-bit numbers are sorted by radix
                )
                near = part < first
                order = np.argsort(part[near], kind="stable")
                at, values = part[near][order].astype(np.int64), hashes[near][order]
                starts = np.flatnonzero(np.diff(at, prepend=-1))
                parity = np.bitwise_xor.reduceat(values, starts) if len(starts) else values[:0]
                at = at[starts]
                empty = first - len(at)
                if empty > spare and cut == CUTS - 1:
                    bare = np.setdiff1d(np.arange(first), at)
                    at, parity = np.concatenate([at, bare]), np.concatenate([parity, np.zeros(len(bare), np.uint64)])
                out.append(_mixed(parity + _mixed(at.astype(np.uint64) + seed)))
                if empty <= spare:
                    break
        return (np.concatenate(out) & np.uint64((1 << KEY_BITS) - 1)).astype(np.int64)


def sketches(docs: DataFrame, width: int, num: int, den: int, row: str | None = None) -> DataFrame:
    """rid, doc_id, text_hash, n_shingles, set_a and set_b (the set's signature), bits (its sketch), keys_0 to keys_3; stored.

    ``rid`` is the column ``row``, or a number given here.  Each slice of the keys is a column of its own, so that
    reading one slice leaves the others on disk.
    """
    names = ["doc_id", "text_hash"] + ([] if row is None else ["rid"])
    none = np.zeros(0, np.int64)

    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, bands = Shingles(width), Bands(num, den)
        for frame in frames:
            seen: set[tuple[int, int, int]] = set()  # of equal sets in a batch one carries the keys
            rows = []
            for own in shingles.in_blocks(frame["text"]):
                a = int(own.sum(dtype=np.uint64).view(np.int64))
                b = int(np.bitwise_xor.reduce(_mixed(own + _ODD[3])).view(np.int64)) if len(own) else 0
                mark = (len(own), a, b)
                keys = none if mark in seen else bands.keys(own)
                rows.append((*mark, bands.sketch(own), *(keys[keys % SLICES == n] for n in range(SLICES))))
                seen.add(mark)
            out = pd.DataFrame(rows, columns=["n_shingles", "set_a", "set_b", "bits", *_SLICED])
            yield frame[names].reset_index(drop=True).join(out)

    rid = [] if row is None else [F.col(row).alias("rid")]
    texts = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), text_of().alias("text"), *rid)
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    schema = "doc_id string, text_hash long, " + ("" if row is None else "rid long, ")
    schema += "n_shingles long, set_a long, set_b long, bits binary, " + ", ".join(f"{c} array<long>" for c in _SLICED)
    made = texts.mapInPandas(sketch, schema)
    made = made.withColumn("doc_id", F.col("doc_id").cast("long"))
    return stored(made.withColumn("rid", F.monotonically_increasing_id()) if row is None else made, "sketches")


def _near(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sketches do not show that they are too far apart."""

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands = Bands(num, den)
        for frame in frames:
            columns = (frame[c] for c in ("bits_a", "bits_b", "n_a", "n_b"))
            keep = [not bands.far(a, b, m, n) for a, b, m, n in zip(*columns, strict=True)]
            yield frame.loc[keep, ["a", "b"]]

    left = classes.select(F.col("rep").alias("a"), F.col("bits").alias("bits_a"), F.col("n_shingles").alias("n_a"))
    right = classes.select(F.col("rep").alias("b"), F.col("bits").alias("bits_b"), F.col("n_shingles").alias("n_b"))
    return stored(pairs.join(left, "a").join(right, "b").mapInPandas(compare, "a long, b long"), "near-pairs")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose texts are within the threshold."""

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(width)
        last, hub = None, np.zeros(0, np.uint64)
        for frame in frames:
            keep = []
            for own, b in zip(shingles.in_blocks(frame["text_a"]), frame["text_b"], strict=True):
                if b != last:
                    last, hub = b, shingles.set_of(b)
                both = len(np.intersect1d(own, hub, assume_unique=True))
                keep.append(den * both >= num * (len(own) + len(hub) - both))
            yield frame.loc[keep, ["a", "b"]]

    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return stored(both.mapInPandas(verify, "a long, b long"), "links")


def jaccard_classes(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id, component_id; with ``row`` also rid and component.

    ``row`` names a column of numbers that tell rows apart and stay the same whenever ``docs`` is read; it comes back
    as ``rid``.  Rows of one ``component`` are linked, also where doc_ids are missing or repeated.

    Two documents are linked when ``den * intersection >= num * union`` of their shingle sets.  ``class_id`` is the
    smallest doc_id with the same set, ``component_id`` the smallest one reachable by links.  A document without
    words (null, empty or blank text) has the empty set and stands alone.  Repeated rows belong to one class; null
    doc_ids come last.  An empty table gives an empty result; other columns are ignored.
    """
    with batches_of(docs.sparkSession, BATCH_ROWS):
        return _classes(docs, width, num, den, row)


def _classes(docs: DataFrame, width: int, num: int, den: int, row: str | None) -> DataFrame:
    sketched = sketches(docs, width, num, den, row)
    members = _members(sketched)
    postings = stored_parts(_shared_postings(sketched, members), "postings")
    discard(sketched)
    tidy(docs.sparkSession)

    classes = members.where("rid = rep").select("rep", "doc_id", "text_hash", "bits", "n_shingles")
    reached, tested, apart = None, None, postings.withColumn("component", F.col("rep"))
    for step in range(HUB_ROUNDS + 1):
        spent: list[DataFrame] = []  # tables that the pairs are made from
        pairs = _hub_pairs(apart, step) if step < HUB_ROUNDS else _rest_pairs(docs, classes, apart, width, num, den, spent)
        pairs = pairs.where(
            (F.col("component") != F.col("other_component"))
            & (F.least("n_shingles", "other_n") * den >= F.greatest("n_shingles", "other_n") * num)
        )
        pairs = pairs.select(F.greatest("rep", "other").alias("a"), F.least("rep", "other").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        discard(*spent)
        tidy(docs.sparkSession)
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        near = _near(pairs, classes, num, den)
        texts = _texts_of(docs, classes, near.select(F.explode(F.array("a", "b")).alias("rep")))
        links = _verified(near, texts, width, num, den)
        discard(texts, near)
        tidy(docs.sparkSession)
        if reached is not None:
            links = links.unionByName(reached.select(F.col("node").alias("a"), F.col("component").alias("b")))
        reached = stored(components(links), "components")
        apart = postings.join(reached.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
            "component", F.coalesce("component", "rep")
        )
    out = members.select("rid", "doc_id", "n_shingles", "class_id", "rep")
    columns = ["doc_id", "n_shingles", "class_id", "component_id"] + ([] if row is None else ["rid", "component"])
    if reached is None:
        return out.withColumns({"component_id": F.col("class_id"), "component": F.col("rep")}).select(*columns)
    best = reached.join(members.where("rid = rep").select(F.col("rep").alias("node"), "class_id"), "node")
    best = best.groupBy("component").agg(F.min("class_id").alias("component_id"))
    names = reached.join(best, "component").select(F.col("node").alias("rep"), "component_id", "component")
    out = out.join(names, "rep", "left").withColumns(
        {"component_id": F.coalesce("component_id", "class_id"), "component": F.coalesce("component", "rep")}
    )
    return out.select(*columns)


def _members(sketched: DataFrame) -> DataFrame:
    """The sketched rows with rep (the row that stands for their set) and class_id; stored.

    Only sets met more than once are grouped and joined, and empty sets carry a key of their own, so no row of a hot
    set is dealt by it where the groups are few; where they are many, the plain join is one that can be split.
    """
    own = ["n_shingles", "set_a", "set_b"]
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    heads = sketched.where("n_shingles > 0").groupBy(*own).agg(F.min(order).alias("head"), F.count("*").alias("met"))
    heads = heads.where("met > 1").select(*own, F.col("head.rid").alias("rep"), F.col("head.doc_id").alias("class_id"))
    heads = stored(heads, "heads")
    rows = sketched.select("rid", "doc_id", "text_hash", "bits", *own)
    rows = rows.withColumn("set_a", F.when(F.col("n_shingles") > 0, F.col("set_a")).otherwise(F.col("rid")))
    members = rows.join(bounded_broadcast(heads, heads.count(), BROADCAST_HEADS), own, "left")
    members = members.withColumn("class_id", F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("class_id")))
    return stored(members.withColumn("rep", F.coalesce("rep", "rid")).drop("set_a", "set_b"), "members")


def _shared_postings(sketched: DataFrame, members: DataFrame) -> Iterator[DataFrame]:
    """key, rep, n_shingles of the keys that several rows share, slice by slice."""
    for column in _SLICED:
        postings = sketched.select("rid", F.explode(column).alias("key"))
        shared = stored(postings.groupBy("key").count().where("count > 1").select("key"), "shared-keys")
        tidy(sketched.sparkSession)
        found = postings.join(shared, "key").join(members.select("rid", "rep", "n_shingles"), "rid")
        yield found.select("key", "rep", "n_shingles").distinct()
        discard(shared)
        tidy(sketched.sparkSession)


def _hub_pairs(apart: DataFrame, step: int) -> DataFrame:
    """Each posting beside its parity's hub, where classes of the parity are still apart.

    First the hub is the class that meets most others over all its parities, which in a group of edited copies is
    the original; later ones are drawn by a hash.
    """
    if step:
        rank = F.xxhash64("rep", F.lit(step))
    else:
        met = apart.groupBy("key").agg(F.count("*").alias("met"))
        weight = stored(apart.join(met, "key").groupBy("rep").agg(F.sum("met").alias("weight")), "weights")
        tidy(apart.sparkSession)
        apart = apart.join(weight, "rep")
        rank = F.struct(F.col("weight"), -F.col("rep"))
    spread = apart.groupBy("key").agg(
        F.min("component").alias("low"),
        F.max("component").alias("high"),
        F.max_by(F.struct("rep", "n_shingles", "component"), rank).alias("hub"),
    )
    hubs = spread.where("low != high").select("key", "hub")
    return apart.join(hubs, "key").select(
        "rep", "n_shingles", "component", F.col("hub.rep").alias("other"),
        F.col("hub.n_shingles").alias("other_n"), F.col("hub.component").alias("other_component"),
    )


def _other(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(
        *keys, F.col("rep").alias("other"), F.col("n_shingles").alias("other_n"), F.col("component").alias("other_component")
    )


def _rest_pairs(
    docs: DataFrame, classes: DataFrame, apart: DataFrame, width: int, num: int, den: int, spent: list[DataFrame]
) -> DataFrame:
    """What the hubs left: pairs within small parities, and pairs of rare shingles among the classes of large ones.

    ``spent`` gets the tables that can go once the pairs are written.
    """
    spread = apart.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("met")
    )
    spread = stored(spread.where("low != high").select("key", "met"), "open-keys")
    small = apart.join(spread.where(F.col("met") <= SMALL_GROUP), "key")
    direct = small.join(_other(small, "key"), "key").where("rep < other").drop("key", "met")
    large = apart.join(spread.where(F.col("met") > SMALL_GROUP), "key").select("rep", "component").distinct()
    large = stored(large, "large-groups")
    if large.isEmpty():
        return direct
    found = _texts_of(docs, classes, large.select("rep"))
    texts = stored(found.join(large, "rep"), "large-texts")
    discard(found)
    spent.append(texts)
    return direct.unionByName(_rare_pairs(texts, width, num, den, spent).select(*direct.columns))


def _rare_pairs(texts: DataFrame, width: int, num: int, den: int, spent: list[DataFrame]) -> DataFrame:
    """Pairs of (rep, component, text) that may be within the threshold, by their rarest shingles.

    Sets of sizes m <= n within the threshold share at least ``o = ceil(num (m + n) / (num + den))`` shingles, so in
    any one order of all shingles the first shared one is among the first m - o + 1 of one and n - o + 1 of the
    other.  The order is by frequency, counted in a table of fixed size: chance collisions in it cost time only.
    """
    cells = 1 << RARITY_BITS

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, counts = Shingles(width), np.zeros(cells, np.int32)
        for frame in frames:
            own = [shingles.set_of(text) & np.uint64(cells - 1) for text in frame["text"]]
            if own:
                counts += np.bincount(np.concatenate(own).astype(np.int64), minlength=cells).astype(np.int32)
        found = np.flatnonzero(counts)
        for at in range(0, len(found), 100_000):
            part = found[at : at + 100_000]
            yield pd.DataFrame({"cell": part.astype(np.int32), "n": counts[part].astype(np.int64)})

    counted = texts.mapInPandas(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    rarity = np.ones(cells, np.int64)  # 8 MB and at most a row per cell, whatever the input
    rarity[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(rarity)

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, often = Shingles(width), shared.value
        for frame in frames:
            chosen, sizes, lengths = [], [], []
            for own in shingles.in_blocks(frame["text"]):
                n = len(own)
                order = np.lexsort((own, often[(own & np.uint64(cells - 1)).astype(np.int64)]))
                longest = n - -(-num * n // den) + 1
                chosen.append(own[order[:longest]])
                sizes.append(n)
                lengths.append(longest)
            if not chosen:
                continue
            starts = np.cumsum(lengths) - lengths
            yield pd.DataFrame(
                {
                    "shingle": np.concatenate(chosen).view(np.int64),
                    "rep": np.repeat(frame["rep"].to_numpy(), lengths),
                    "n_shingles": np.repeat(sizes, lengths),
                    "component": np.repeat(frame["component"].to_numpy(), lengths),
                    "place": np.arange(1, sum(lengths) + 1) - np.repeat(starts, lengths),
                }
            )

    rare = stored(texts.mapInPandas(first, "shingle long, rep long, n_shingles long, component long, place int"), "rare-shingles")
    spent.append(rare)
    least = F.ceil(num * (F.col("n_shingles") + F.col("other_n")) / F.lit(num + den))
    near = (
        (F.col("rep") < F.col("other"))
        & (F.col("component") != F.col("other_component"))
        & (F.col("place") <= F.col("n_shingles") - least + 1)
        & (F.col("other_place") <= F.col("other_n") - least + 1)
    )

    def slices() -> Iterator[DataFrame]:
        """The pairs by slices of the shingles: only one slice's shuffle files stand on disk at a time."""
        for n in range(SLICES):
            own = rare.where(F.pmod("shingle", F.lit(SLICES)) == n)
            alone = own.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"))
            own = own.join(alone.where("low != high").select("shingle"), "shingle", "left_semi")
            other = own.select(
                "shingle", F.col("rep").alias("other"), F.col("n_shingles").alias("other_n"),
                F.col("component").alias("other_component"), F.col("place").alias("other_place"),
            )
            yield own.join(other, "shingle").where(near).drop("shingle", "place", "other_place").distinct()
            tidy(rare.sparkSession)

    pairs = stored_parts(slices(), "rare-pairs")
    spent.append(pairs)
    return pairs


def _texts_of(docs: DataFrame, classes: DataFrame, asked: DataFrame) -> DataFrame:
    """rep, text of the classes asked for (rep)."""
    wanted = stored(classes.join(asked.distinct(), "rep", "left_semi"), "wanted").select(
        "rep", F.col("doc_id").alias("wanted_id"), F.col("text_hash").alias("wanted_hash")
    )
    wanted = bounded_broadcast(wanted, wanted.count(), BROADCAST_CANDIDATES)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.xxhash64("text") == F.col("wanted_hash"))
    found = texts.join(wanted, same).select("rep", "text")
    return stored(found.dropDuplicates(["rep"]), "candidate-texts")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id,
         list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id,
         CASE WHEN len(w) = 0 THEN []
              WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
              ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS g
  FROM d
), e AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS common
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY ALL
), links AS (
  SELECT a, b FROM shared WHERE 100 * common >= 85 * (an + bn - common)
), reach AS (
  WITH RECURSIVE r(node, other) AS (
    SELECT doc_id, doc_id FROM s
    UNION
    SELECT r.node, links.b FROM r JOIN links ON links.a = r.other
  )
  SELECT node, min(other) AS component_id FROM r GROUP BY node
)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, reach.component_id
FROM s JOIN reach ON reach.node = s.doc_id
"""
