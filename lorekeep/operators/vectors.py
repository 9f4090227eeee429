"""Matches by the cosine of vectors, where names and words have found none, and pairs of alike sets by tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.graphs import settled

#: Vectors in a block; bytes of a side of a tile; questions of a tile that meet a block at once: their products are 8 MB.
BLOCK, SIDE, ASKED = 2048, 1 << 24, 512


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """block, ids, width, data: rows (id, vector) packed where they are read; zero and broken vectors are left out."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for width, group in frame.groupby(frame["vector"].map(len)):
                for at in range(0, len(group), BLOCK):
                    part = group.iloc[at : at + BLOCK]
                    data = np.array(part["vector"].tolist(), np.float64)
                    data /= np.linalg.norm(data, axis=1, keepdims=True)
                    yield pd.DataFrame({"width": [width], "ids": [part["id"].to_numpy("<i8").tobytes()], "data": [data.tobytes()]})

    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    kept = rows.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where("id is not null").where(fine)
    made = kept.mapInPandas(pack, "width int, ids binary, data binary")
    return settled(made.withColumn("block", F.monotonically_increasing_id()), name)


#: Tasks that tiles are dealt to, at most.
MOST_TASKS = 2000


def _tiles(left: DataFrame, right: DataFrame, data: list[str], pairs: DataFrame) -> DataFrame:
    """A row for each pair (a, b) of blocks with the data of both, named by their side; numbers of blocks meet, data joins by them."""
    named = lambda rows, side: rows.select(F.col("block").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in data])
    met = pairs.join(named(left, "a"), "a").join(named(right, "b"), "b")
    # tiles are small to shuffle and long to work on: a number that is told is not merged into a few tasks
    return met.repartition(max(1, min(pairs.count(), MOST_TASKS)), "a", "b")


#: Sets in a block, and rows and grams of a part of a tile: a part's matrices are 16 MB each.
SETS, ROWS, GRAMS = 4096, 1024, 4096


def _set_blocks(sets: DataFrame, name: str) -> DataFrame:
    """block, low, high, ids, sizes, grams, places: sets (id, grams) packed in order of their size; empty ones are left out."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), SETS):
                part = frame.iloc[at : at + SETS]
                sizes = part["grams"].map(len).to_numpy("<i4")
                grams, places = np.unique(np.concatenate(part["grams"].to_list()).astype("<i8"), return_inverse=True)
                yield pd.DataFrame({
                    "low": [int(sizes.min())], "high": [int(sizes.max())], "ids": [part["id"].to_numpy("<i8").tobytes()], "sizes": [sizes.tobytes()],
                    "grams": [grams.tobytes()], "places": [places.astype("<u4" if len(grams) > 65535 else "<u2").tobytes()],
                })

    size = F.size("grams")
    kept = sets.select(F.col("id").cast("long").alias("id"), "grams").where(size > 0).repartitionByRange(size, "id").sortWithinPartitions(size, "id")
    made = kept.mapInPandas(pack, "low int, high int, ids binary, sizes binary, grams binary, places binary")
    return settled(made.withColumn("block", F.monotonically_increasing_id()), name)


def alike_sets(left: DataFrame, right: DataFrame | None, threshold: float) -> DataFrame:
    """id, id_b, score: pairs of sets (id, grams: distinct numbers) of left and right whose Jaccard reaches the threshold.

    Without ``right`` the pairs of left with itself, each once with id < id_b.  Every pair whose sizes allow for it is compared,
    as products of blocks in tiles of bounded size: where sets of a few thousand common grams are many, no filter on rare
    ones leaves out enough.  Tiles hand on only the pairs that reach the threshold.
    """
    own = right is None
    a = _set_blocks(left, "set-blocks")
    b = a if own else _set_blocks(right, "other-set-blocks")
    spans = [x.select(F.col("block").alias(s), F.col("low").alias(f"{s}_low"), F.col("high").alias(f"{s}_high")) for x, s in ((a, "a"), (b, "b"))]
    fits = (F.col("a_high") >= F.col("b_low") * threshold - 1e-6) & (F.col("b_high") >= F.col("a_low") * threshold - 1e-6)
    pairs = spans[0].crossJoin(spans[1]).where(fits & (F.col("a") <= F.col("b")) if own else fits)  # a row for thousands of sets
    met = _tiles(a, b, ["ids", "sizes", "grams", "places"], pairs.select("a", "b"))

    def side(row: pd.Series, s: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        grams = np.frombuffer(row[f"{s}_grams"], "<i8")
        places = np.frombuffer(row[f"{s}_places"], "<u4" if len(grams) > 65535 else "<u2").astype(np.int64)
        return np.frombuffer(row[f"{s}_ids"], "<i8"), np.frombuffer(row[f"{s}_sizes"], "<i4").astype(np.int64), grams, places

    def matrix(columns: np.ndarray, owners: np.ndarray, rows: tuple[int, int], grams: tuple[int, int]) -> np.ndarray:
        """The sets of some rows over some grams as zeros and ones."""
        at, to = np.searchsorted(owners, rows)
        owner, column = owners[at:to] - rows[0], columns[at:to]
        fine = (column >= grams[0]) & (column < grams[1])
        out = np.zeros((rows[1] - rows[0], grams[1] - grams[0]), np.float32)
        out[owner[fine], column[fine] - grams[0]] = 1
        return out

    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        row = frame.iloc[0]
        (ids, sizes, grams, places), (ids_b, sizes_b, grams_b, places_b) = side(row, "a"), side(row, "b")
        shared, here, there = np.intersect1d(grams, grams_b, assume_unique=True, return_indices=True)
        columns, columns_b = np.full(len(grams), -1), np.full(len(grams_b), -1)
        columns[here] = columns_b[there] = np.arange(len(shared))
        columns, columns_b = columns[places], columns_b[places_b]
        owners, owners_b = np.repeat(np.arange(len(ids)), sizes), np.repeat(np.arange(len(ids_b)), sizes_b)
        cut = lambda n, step: [(x, min(x + step, n)) for x in range(0, n, step)]
        found = []
        for x in cut(len(ids), ROWS):
            for y in cut(len(ids_b), ROWS):
                both = np.zeros((x[1] - x[0], y[1] - y[0]), np.float32)
                for g in cut(len(shared), GRAMS):
                    both += matrix(columns, owners, x, g) @ matrix(columns_b, owners_b, y, g).T
                score = both / (sizes[x[0] : x[1], None] + sizes_b[None, y[0] : y[1]] - both.astype(np.float64))
                i, j = np.nonzero(score >= threshold)
                one, two = ids[x[0] : x[1]][i], ids_b[y[0] : y[1]][j]
                keep = slice(None)
                if own:
                    keep = one < two if row["a"] == row["b"] else one != two
                    one, two = np.minimum(one, two), np.maximum(one, two)
                found.append(pd.DataFrame({"id": one[keep], "id_b": two[keep], "score": score[i, j][keep]}))
        return pd.concat(found)

    return met.groupBy("a", "b").applyInPandas(tile, "id long, id_b long, score double")


#: Words in a block at most, as a rule, and pairs of a word's places that are added up at once.
ENTRIES, MET = 1 << 21, 1 << 20
#: A word that so many of a part's pairs share, one in this number, is cheaper as a column of a matrix than pair by pair.
DENSE = 400


def _word_blocks(sets: DataFrame, name: str) -> DataFrame:
    """block, low, high, groups, counts, sizes, places, words: sets (grp, m, words) in order of their group, packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words").cast(pa.large_list(pa.large_string()))
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))])
            at = 0
            while at < len(words):
                to = min(at + SETS, len(words), max(at + 1, int(np.searchsorted(ends, ends[at] + ENTRIES, side="right")) - 1))
                told = words.slice(at, to - at).flatten().dictionary_encode()
                groups = batch.column("grp")[at:to].to_numpy().astype("<i8")
                yield pa.RecordBatch.from_pydict({
                    "low": pa.array(groups[:1]), "high": pa.array(groups[-1:]), "groups": [groups.tobytes()],
                    "counts": [batch.column("m")[at:to].to_numpy().astype("<f8").tobytes()], "sizes": [np.diff(ends[at : to + 1]).astype("<i4").tobytes()],
                    "places": [told.indices.to_numpy().astype("<i4").tobytes()], "words": pa.array([told.dictionary.to_pylist()], pa.list_(pa.string())),
                })
                at = to

    kept = sets.select(F.col("grp").cast("long").alias("grp"), F.col("m").cast("double").alias("m"), "words")
    kept = kept.repartitionByRange("grp", F.hash("words")).sortWithinPartitions("grp")
    made = kept.mapInArrow(pack, "low long, high long, groups binary, counts binary, sizes binary, places binary, words array<string>")
    return settled(made.withColumn("block", F.monotonically_increasing_id()), name)


def _met_words(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], shape: tuple[int, int], words: int) -> np.ndarray:
    """How many words every set of one side shares with every one of the other; a side is the set and the word of each entry."""
    out = np.zeros(shape, np.float64)
    here, there = (np.bincount(x[1], minlength=words) for x in (a, b))
    dense = here.astype(np.float64) * there * DENSE > shape[0] * shape[1]
    column = np.cumsum(dense) - 1
    for low in range(0, int(dense.sum()), GRAMS):
        sides = []
        for (owner, word), n in ((a, shape[0]), (b, shape[1])):
            fine = dense[word] & (column[word] >= low) & (column[word] < low + GRAMS)
            side = np.zeros((n, min(GRAMS, int(dense.sum()) - low)), np.float32)
            side[owner[fine], column[word[fine]] - low] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    (owner, word), (other, known) = ((x[0][k], x[1][k]) for x in (a, b) for k in [~dense[x[1]]])
    order = np.argsort(known, kind="stable")
    other, starts = other[order], np.cumsum(np.append(0, np.where(dense, 0, there)))
    owner, word = (x[there[word] > 0] for x in (owner, word))
    ends = np.cumsum(there[word])
    at = 0
    while at < len(word):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + MET, side="right")))
        n = there[word[at:to]]
        nth = np.arange(int(ends[to - 1]) - done) - np.repeat(ends[at:to] - n - done, n)
        cells = np.repeat(owner[at:to], n) * shape[1] + other[np.repeat(starts[word[at:to]], n) + nth]
        out += np.bincount(cells, minlength=out.size).reshape(shape)
        at = to
    return out


def jaccard_sums(sets: DataFrame) -> DataFrame:
    """grp, total: the Jaccards of every two sets of a group, each times the numbers of both, added up.

    sets: grp, m (how often it stands there), words (distinct); the sets of a group differ.  Every pair of a group is
    compared, in tiles of bounded size that hand on a number for each group; a large group is dealt to many tiles, small
    ones share one.
    """
    blocks = _word_blocks(sets, "word-blocks")
    # blocks stand in order of their groups: what two of them share is the last of the one and the first of the other
    edge = blocks.select("block", F.explode(F.array_distinct(F.array("low", "high"))).alias("edge"))
    pairs = edge.select(F.col("block").alias("a"), "edge").join(edge.select(F.col("block").alias("b"), "edge"), "edge").where("a < b").select("a", "b")
    pairs = pairs.distinct().unionByName(blocks.select(F.col("block").alias("a"), F.col("block").alias("b")))
    met = _tiles(blocks, blocks, ["groups", "counts", "sizes", "places", "words"], settled(pairs, "word-tiles"))

    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        row = frame.iloc[0]
        own, sides = row["a"] == row["b"], []
        for s in "ab":
            groups, counts, sizes, places = (np.frombuffer(row[f"{s}_{c}"], t) for c, t in (("groups", "<i8"), ("counts", "<f8"), ("sizes", "<i4"), ("places", "<i4")))
            sides.append((groups, counts, sizes, places, np.append(0, np.cumsum(sizes, dtype=np.int64))))
        if not own:
            number = pc.index_in(pa.array(row["a_words"], pa.string()), value_set=pa.array(row["b_words"], pa.string()))
            sides[0] = (*sides[0][:3], number.fill_null(-1).to_numpy()[sides[0][3]], sides[0][4])
        words = len(row["b_words"])

        def part(side: tuple[np.ndarray, ...], at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
            _, _, sizes, places, ends = side
            word = places[ends[at] : ends[to]]
            owner = np.repeat(np.arange(to - at), sizes[at:to])
            return owner[word >= 0], word[word >= 0]

        def narrow(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[tuple, tuple, int]:
            """The words of both by small numbers, where few sets of a block of many words meet."""
            kept = np.unique(np.concatenate([a[1], b[1]]))
            return (a[0], np.searchsorted(kept, a[1])), (b[0], np.searchsorted(kept, b[1])), len(kept)

        cut = lambda at, to: [(x, min(x + ROWS, to)) for x in range(at, to, ROWS)]
        found = []
        for group in np.intersect1d(sides[0][0], sides[1][0]):
            spans = [np.searchsorted(side[0], [group, group + 1]) for side in sides]
            total = 0.0
            for x in cut(*map(int, spans[0])):
                for y in cut(*map(int, spans[1])):
                    if (own and y[0] < x[0]) or (own and x[1] - x[0] == 1 and x == y):
                        continue
                    a, b, n = narrow(part(sides[0], *x), part(sides[1], *y))
                    both = _met_words(a, b, (x[1] - x[0], y[1] - y[0]), n)
                    union = sides[0][2][x[0] : x[1], None] + sides[1][2][None, y[0] : y[1]] - both
                    score = np.divide(both, union, out=np.zeros_like(both), where=union > 0)
                    if own and x == y:
                        score = np.triu(score, 1)
                    total += float(sides[0][1][x[0] : x[1]] @ score @ sides[1][1][y[0] : y[1]])
            found.append((int(group), total))
        return pd.DataFrame(found, columns=["grp", "total"]).astype({"grp": "int64", "total": "float64"})

    each = met.groupBy("a", "b").applyInPandas(tile, "grp long, total double")
    return each.groupBy("grp").agg(F.sum("total").alias("total"))


#: Postings in a block, words of 64 bits in a sketch, words that it is folded to for a first look; rows at least, columns at
#: most and pairs, about, that meet at once.
SKETCHES, WORDS, FIRST, STRIP, COLUMNS, CELLS = 32768, 8, 2, 16, 4096, 1 << 16
#: Buckets in which grams are counted; postings of a task, about.
RARITY, DEALT = 1 << 16, 100_000


def _mixed(codes: np.ndarray) -> np.ndarray:
    codes = codes.astype("<i8").view("<u8")
    return (codes ^ (codes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)


def _buckets(codes: np.ndarray) -> np.ndarray:
    return (_mixed(codes) >> np.uint64(48)).astype(np.int64) % RARITY


def _sketches(codes: np.ndarray, owners: np.ndarray, sets: int) -> np.ndarray:
    """The parity of how many grams fall on each bit: two sets differ in no more bits than grams."""
    places = ((_mixed(codes) >> np.uint64(40)) % np.uint64(WORDS * 64)).astype(np.int64)
    counts = np.bincount(owners * WORDS * 64 + places, minlength=sets * WORDS * 64)
    return np.packbits((counts & 1).astype(np.uint8).reshape(-1, WORDS * 64), axis=1).view("<u8")


def _flat(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """ids, sizes, owners, codes of the sets (id, grams) of a batch, some at a time."""
    for at in range(0, batch.num_rows, SETS):
        part = batch.slice(at, SETS)
        sizes = pc.list_value_length(part.column("grams")).to_numpy(zero_copy_only=False).astype(np.int64)
        yield part.column("id").to_numpy(), sizes, np.repeat(np.arange(len(sizes)), sizes), part.column("grams").flatten().to_numpy()


def _rarity(sets: DataFrame) -> np.ndarray:
    """How many grams of all sets fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(RARITY, np.int64)
        for batch in batches:
            for _, _, _, codes in _flat(batch):
                counts += np.bincount(_buckets(codes), minlength=RARITY)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])

    found = sets.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(RARITY, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def _posting_blocks(sets: DataFrame, least: float, rare: bool) -> DataFrame:
    """block, low, high, first, last, work and packed postings (gram, reach, id, size, sketch) in order of gram and reach.

    A set is posted by its rarest grams, or once by none.  ``reach`` is the size of the largest set that may be like it if the
    gram is the rarest that both have; ``first`` and ``last`` count the postings of a block's first and last gram, ``work`` the
    pairs of one gram in it.
    """
    shared = sets.sparkSession.sparkContext.broadcast(_rarity(sets)) if rare else None

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, owners, codes in _flat(batch):
                bits = _sketches(codes, owners, len(ids))
                n, at, gram = sizes, np.arange(len(ids)), np.zeros(len(ids), np.int64)
                reach = n / least / least
                if shared is not None:
                    order = np.lexsort((codes, shared.value[_buckets(codes)], owners))
                    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # grams from here on
                    n = sizes[owners]
                    kept = left >= n * least * least - 1e-6
                    n, at, gram, left = n[kept], owners[kept], codes[order][kept], left[kept]
                    reach = np.minimum(n / least / least, (left / least) ** 2 / n)
                data = bits[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram), pa.array((reach + 1e-6).astype(np.int32)), pa.array(ids[at]), pa.array(n.astype(np.int32)),
                     pa.FixedSizeBinaryArray.from_buffers(pa.binary(WORDS * 8), len(data), [None, pa.py_buffer(data.tobytes())]).cast(pa.binary())],
                    ["gram", "reach", "id", "size", "bits"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(told: pa.Table) -> pa.RecordBatch:
            gram = told["gram"].to_numpy()
            runs = np.diff(np.append(np.flatnonzero(np.diff(gram, prepend=gram[0] - 1)), len(gram))).astype(np.float64)
            whole = lambda c, t: [told[c].to_numpy().astype(t).tobytes()]
            return pa.RecordBatch.from_pydict({
                "low": pa.array(gram[:1]), "high": pa.array(gram[-1:]), "first": runs[:1], "last": runs[-1:], "work": [float(runs @ runs) / 2],
                "grams": whole("gram", "<i8"), "reach": whole("reach", "<i4"), "ids": whole("id", "<i8"), "sizes": whole("size", "<i4"),
                "bits": [b"".join(told["bits"].to_pylist())],
            })

        rest = None
        for batch in batches:
            rest = pa.concat_tables([rest, pa.Table.from_batches([batch])]) if rest else pa.Table.from_batches([batch])
            while len(rest) > SKETCHES:
                # a gram's postings stay together where a block holds them
                gram = rest["gram"].to_numpy()
                cut = int(np.searchsorted(gram, gram[SKETCHES])) or SKETCHES
                yield block(rest.slice(0, cut))
                rest = rest.slice(cut)
        if rest:
            yield block(rest)

    posted = sets.mapInArrow(post, "gram long, reach int, id long, size int, bits binary")
    prefix = F.col("n") - F.ceil(F.col("n") * least * least - 1e-6) + 1 if rare else F.lit(1)
    rows = sets.agg(F.coalesce(F.sum(prefix), F.lit(0))).collect()[0][0]
    posted = posted.repartitionByRange(int(min(max(rows // DEALT, 1), MOST_TASKS)), "gram", "reach", "id").sortWithinPartitions("gram", "reach")
    made = posted.mapInArrow(pack, "low long, high long, first double, last double, work double, grams binary, reach binary, ids binary, sizes binary, bits binary")
    return settled(made.withColumn("block", F.monotonically_increasing_id()), "sketch-blocks")


def sketched_pairs(sets: DataFrame, cosine: float) -> DataFrame:
    """id, id_b: pairs (id < id_b) of sets (id, grams: distinct numbers, n: how many) that may reach the cosine; none that does is left out.

    Sets of n and m grams that reach it share cosine * sqrt(n * m) grams at least, so in the order from rare to common their
    first shared gram leaves as many in either: only such sets of a gram's postings meet.  They differ in
    n + m - 2 * cosine * sqrt(n * m) grams at most, and their sketches in no more bits.  Postings are compared in tiles of
    bounded size, which hand on only the pairs that pass.  Where grams are so common that their postings make more pairs
    than there are, all sets meet once instead.
    """
    least = cosine - 1e-9
    kept = sets.select(F.col("id").cast("long").alias("id"), "grams", "n").where("n > 0")
    for rare in (True, False):
        blocks = _posting_blocks(kept, least, rare)
        # blocks stand in order of grams: what two of them share is the last of the one and the first of the other
        ends = F.array(F.struct(F.col("low").alias("gram"), F.col("first").alias("rows")), F.struct(F.col("high").alias("gram"), F.col("last").alias("rows")))
        edge = blocks.select("block", F.explode(F.array_distinct(ends)).alias("edge")).select("block", "edge.gram", "edge.rows")
        pairs = edge.join(edge.select(F.col("block").alias("b"), "gram", F.col("rows").alias("rows_b")), "gram").where("block < b")
        pairs = settled(pairs.select(F.col("block").alias("a"), "b", (F.col("rows") * F.col("rows_b")).alias("work")), "sketch-tiles")
        work = blocks.select("work").unionByName(pairs.select("work")).agg(F.coalesce(F.sum("work"), F.lit(0.0))).collect()[0][0]
        if work <= kept.count() ** 2 / 2:
            break
    data = ["grams", "reach", "ids", "sizes", "bits"]

    def side(row: pd.Series, s: str) -> tuple[np.ndarray, ...]:
        grams, reach, ids, sizes = (np.frombuffer(row[f"{s}{c}"], t) for c, t in zip(data, ("<i8", "<i4", "<i8", "<i4"), strict=False))
        late = reach < sizes
        order = np.lexsort((reach, np.where(late, reach, sizes), late, grams))
        grams, reach, ids, sizes = grams[order], reach[order], ids[order], sizes[order]
        bits = np.ascontiguousarray(np.frombuffer(row[f"{s}bits"], "<u8").reshape(-1, WORDS)[order].T)
        first = np.stack([np.bitwise_xor.reduce(bits[k::FIRST], axis=0) for k in range(FIRST)])
        return grams, reach, ids, sizes.astype(np.float64), bits, first

    most = lambda n, m: n + m - 2 * least * np.sqrt(n * m) + 1e-6

    def strip(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], rows: tuple[int, int], columns: tuple[int, int], own: bool) -> tuple[np.ndarray, np.ndarray]:
        (at, to), (low, high) = rows, columns
        n, m = x[3][at:to], y[3][low:high]
        large, small = max(n.max(), m.max()), min(n.max(), m.max())
        bound = min(2 * (1 - least) * min(large, small / least / least) + 1e-6, FIRST * 64)
        d = np.zeros((to - at, -(high - low) // 8 * -8), np.uint8)
        d[:, high - low :] = 255
        for w in range(FIRST):
            d[:, : high - low] += np.bitwise_count(x[5][w, at:to, None] ^ y[5][w, None, low:high])
        # eight at a time: few pass
        cells = (np.flatnonzero((d <= int(bound)).view(np.uint64).ravel())[:, None] * 8 + np.arange(8)).ravel()
        i, j = np.divmod(cells[d.ravel()[cells] <= int(bound)], d.shape[1])
        i, j = i + at, j + low
        keep = (y[1][j] >= x[3][i]) & (x[1][i] >= y[3][j])
        if own:
            keep &= i < j
        i, j = i[keep], j[keep]
        apart = np.zeros(len(i), np.int64)
        for w in range(WORDS):
            apart += np.bitwise_count(x[4][w, i] ^ y[4][w, j])
        keep = apart <= most(x[3][i], y[3][j])
        return x[2][i[keep]], y[2][j[keep]]

    def compared(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], own: bool) -> pd.DataFrame:
        found = []

        def meet(x: tuple, y: tuple, rows: tuple[int, int], columns: tuple[int, int], own: bool) -> None:
            """Rows in order of reach or size with columns in order of size."""
            sizes, i = y[3][columns[0] : columns[1]], rows[0]
            while i < rows[1]:
                for step in (STRIP, None):
                    end = min(i + (step or min(max(STRIP, CELLS // max(to - at, 1)), ROWS)), rows[1])
                    at = columns[0] + int(np.searchsorted(sizes, x[3][i:end].min() * least * least - 1e-6))
                    to = columns[0] + int(np.searchsorted(sizes, x[1][i:end].max(), side="right"))
                    at = max(at, i) if own else at
                for j in range(at, to, COLUMNS):
                    found.append(strip(x, y, (i, end), (j, min(j + COLUMNS, to)), own))
                i = end

        for gram in np.intersect1d(x[0], y[0]):
            spans = []
            for one in (x, y):
                low, high = np.searchsorted(one[0], [gram, gram + 1])
                # sets that reach their own size, then those that can only be the larger of two
                late = low + int(np.searchsorted(one[1][low:high] < one[3][low:high], True))
                spans.append((int(low), late, int(high)))
            (low, late, high), (low_b, late_b, high_b) = spans
            if own and high - low == 1:
                continue
            meet(x, y, (low, late), (low_b, late_b), own)
            meet(x, y, (late, high), (low_b, late_b), False)
            if not own:
                meet(y, x, (late_b, high_b), (low, late), False)
        one, two = (np.concatenate([f[k] for f in found]) if found else np.array([], np.int64) for k in (0, 1))
        return pd.DataFrame({"id": np.minimum(one, two), "id_b": np.maximum(one, two)}).drop_duplicates()

    def within(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                x = side(row, "")
                yield compared(x, x, True)

    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        row = frame.iloc[0]
        return compared(side(row, "a_"), side(row, "b_"), False)

    schema = "id long, id_b long"
    inside = blocks.select(*data).repartition(int(min(max(blocks.count(), 1), MOST_TASKS))).mapInPandas(within, schema)
    met = _tiles(blocks, blocks, data, pairs.select("a", "b").distinct()).groupBy("a", "b").applyInPandas(tile, schema)
    return inside.unionByName(met).distinct()


def _sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """tile, asks, ids, width, data: blocks of both sides, a few megabytes of either in each tile, dealt to all tiles they belong to.

    So a vector is shuffled once for every few megabytes of the other side, not once for each of its blocks.
    """
    sides = []
    for rows, name in ((left, "a"), (right, "b")):
        before = F.sum(F.length("data")).over(Window.partitionBy("width").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
        # a row for thousands of vectors
        sides.append(rows.select("block", "width", F.floor(F.coalesce(before, F.lit(0)) / SIDE).alias(name)))
    places = sides[0].select("width", "a").distinct().join(sides[1].select("width", "b").distinct(), "width")
    tiles = settled(places.withColumn("tile", F.monotonically_increasing_id()), "vector-tiles")
    rows = [
        rows.join(side.join(tiles, ["width", name]).select("block", "tile"), "block").select("tile", F.lit(name == "a").alias("asks"), "ids", "width", "data")
        for rows, side, name in ((left, sides[0], "a"), (right, sides[1], "b"))
    ]
    # a number that is told is not merged into a few tasks
    return rows[0].unionByName(rows[1]).repartition(int(max(1, min(2 * tiles.count(), MOST_TASKS))), "tile")


def nearest_alone(questions: DataFrame, truth: DataFrame, threshold: float = 0.8) -> DataFrame:
    """question_id, truth_id, cosine: the truth nearest to each question, of that cosine or more, if no other is as near.

    Both hold id and vector.  Questions meet truths of one width in tiles of bounded size; each tile gives a question's
    best cosine with the least and the greatest truth that has it, so a tie is seen wherever its sides stand.  Vectors
    that are null, zero or hold broken components take no part.
    """
    met = _sides(_blocks(questions, "question-blocks"), _blocks(truth, "truth-blocks"))

    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["asks"].to_numpy(bool)
        asked, known = ([(np.frombuffer(i, "<i8"), np.frombuffer(d).reshape(-1, w)) for i, d, w in zip(part["ids"], part["data"], part["width"], strict=True)] for part in (frame[asks], frame[~asks]))
        found = []
        for ids, data in asked:
            for at in range(0, len(ids), ASKED):
                rows, near = ids[at : at + ASKED], []
                for truths, other in known:
                    scores = data[at : at + ASKED] @ other.T
                    most = scores.max(axis=1)
                    # what rounds to a row's best is near it
                    least = np.maximum(most, threshold) - 2e-9
                    some = np.flatnonzero(most >= least)
                    i, j = np.nonzero(scores[some] >= least[some, None])
                    near.append((some[i], truths[j], np.round(scores[some[i], j], 9)))
                i, j, score = (np.concatenate([n[k] for n in near]) for k in range(3))
                best = np.full(len(rows), -2.0)
                np.maximum.at(best, i, score)
                i, j = i[score == best[i]], j[score == best[i]]
                low, high = np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), np.iinfo(np.int64).min)
                np.minimum.at(low, i, j)
                np.maximum.at(high, i, j)
                kept = best >= threshold
                found.append(pd.DataFrame({"question_id": rows[kept], "cosine": best[kept], "low": low[kept], "high": high[kept]}))
        return pd.concat(found) if found else pd.DataFrame({"question_id": [], "cosine": [], "low": [], "high": []}).astype({"question_id": "int64", "low": "int64", "high": "int64"})

    found = met.groupBy("tile").applyInPandas(tile, "question_id long, cosine double, low long, high long")
    each = found.groupBy("question_id", "cosine").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    best = each.groupBy("question_id").agg(F.max(F.struct("cosine", "low", "high")).alias("best"))
    return best.where("best.low = best.high").select("question_id", F.col("best.low").alias("truth_id"), "best.cosine")


def unmatched_by_vector(matched: DataFrame, questions: DataFrame, truth: DataFrame, threshold: float = 0.8) -> DataFrame:
    """question_id, truth_id, how: matches as they are, and for questions without one the nearest vector, if it stands alone."""
    open_ = questions.join(matched.where("truth_id is null").select(F.col("question_id").alias("id")), "id", "left_semi")
    near = nearest_alone(open_, truth, threshold).select("question_id", F.col("truth_id").alias("near"))
    joined = matched.join(near, "question_id", "left")
    how = F.when(F.col("truth_id").isNull() & F.col("near").isNotNull(), "vector").otherwise(F.col("how"))
    return joined.select("question_id", F.coalesce("truth_id", "near").alias("truth_id"), how.alias("how"))
