"""Hard negatives of anchors by angular triangle filtering.

Components become whole numbers, scores are whole inner products.  Every row stores its angles to a few reference
directions.  By the triangle inequality on the sphere, two rows' angles to one reference bound the angle between them
from below (their difference) and above (their sum, or what that leaves of a full turn); the cosines of the tightest
bounds, multiplied by both norms and widened for rounding, bound the score.  A whole block of candidates is judged first,
by the ranges of its angles and norms, then its rows; only pairs whose bounds overlap what an anchor still looks for get
integer scores.  The result is exact whatever the references are.

Rows are dealt to blocks in the order of label, nearest reference and angle to it, so blocks are narrow.  Anchors meet
candidates in a grid of cells; a cell is a task of bounded size that returns its best few, and these are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.shared import stored

#: Reference directions, and the rows that they are chosen from (bounded; they only decide how much is filtered).
REFERENCES, SAMPLE = 8, 256
#: Rows in a block of anchors and of candidates, and blocks of either in a cell.
ANCHOR_BLOCK, CANDIDATE_BLOCK = 256, 4096
ANCHOR_CELL, CANDIDATE_CELL = 64, 64
#: Stored angles are off by less than half of this; bounds of scores are widened by this share of both norms.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9
#: Vectors whose whole components have a square sum of this or more take no part: their scores leave a long.
MOST_SQUARE = 1 << 62
#: Below this every partial sum of products is a whole number that a double holds.
EXACT_DOUBLE = 1 << 53


def references(vectors: list[np.ndarray], width: int, many: int = REFERENCES) -> np.ndarray:
    """Unit directions among rows of a sample, each the farthest from those before it; axes where none has that width."""
    found = [v for v in vectors if len(v) == width]
    if not width:
        return np.empty((0, 0))
    rows = np.array([v for v in found if np.isfinite(v).all() and (v != 0).any()], np.float64).reshape(-1, width)
    if not len(rows):
        return np.eye(min(many, width), width)
    rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    chosen = [0]
    nearest = np.abs(rows @ rows[0])
    while len(chosen) < min(many, len(rows)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, np.abs(rows @ rows[chosen[-1]]))
    return rows[chosen]


def angles_to(vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles of rows to directions; a right angle for zero rows, whose scores are 0 whatever their angle."""
    if not len(directions):
        return np.full((len(vectors), 1), np.pi / 2, np.float32)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    cosines = (vectors / np.where(norms == 0, 1, norms)) @ directions.T
    return np.arccos(np.clip(cosines, -1, 1)).astype(np.float32)


def score_bounds(norms: np.ndarray, other: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of inner products by ranges of norms (``other``: smallest and largest) and of the angle between."""
    near, far = np.cos(np.maximum(low - ANGLE_SLACK, 0)), np.cos(np.minimum(high + ANGLE_SLACK, np.pi))
    least, most = other
    upper = norms * np.where(near > 0, near * most, near * least)
    lower = norms * np.where(far > 0, far * least, far * most)
    slack = SCORE_SLACK * norms * most + 1e-6
    return lower - slack, upper + slack


def widest(angles: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest angle that an angle ``angles`` and one between ``low`` and ``high`` to one reference leave."""
    other = np.clip(np.pi - angles, low, high)
    return np.minimum(angles + other, 2 * np.pi - angles - other)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole inner products of rows, exact."""
    most = np.sqrt((a.astype(np.float64) ** 2).sum(axis=1).max(initial=0) * (b.astype(np.float64) ** 2).sum(axis=1).max(initial=0))
    if most * 1.001 < EXACT_DOUBLE:  # no partial sum is larger
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


@dataclass
class Block:
    """Rows of one length: whole components, norms, angles to references."""

    rids: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    data: np.ndarray
    angles: np.ndarray
    norms: np.ndarray

    @classmethod
    def of(cls, row) -> Block:
        rids, ids, labels = (np.frombuffer(x, "<i8") for x in (row.rids, row.ids, row.labels))
        data = np.frombuffer(row.data, row.kind).reshape(len(ids), row.width)
        norms = np.sqrt((data.astype(np.float64) ** 2).sum(axis=1))
        return cls(rids, ids, labels, data, np.frombuffer(row.angles, "<f4").reshape(len(ids), -1), norms)

    def near_rows(self, anchors: Block, wanted: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (anchor, row) whose bounds overlap ``least`` to ``most`` of the anchor, with their integer scores.

        ``wanted`` says which pairs of labels may meet, by anchor and row.
        """
        asked = np.flatnonzero(self.overlaps_block(anchors, least, most) & wanted.any(axis=1))
        if not len(asked):
            return (np.empty(0, np.int64),) * 3
        angles = anchors.angles[asked]
        low = np.zeros((len(asked), len(self.ids)), np.float32)
        high = np.full_like(low, np.pi)
        for r in range(angles.shape[1]):
            one, two = angles[:, r, None], self.angles[:, r]
            np.maximum(low, np.abs(one - two), out=low)
            total = one + two
            np.minimum(high, np.minimum(total, np.float32(2 * np.pi) - total), out=high)
        below, above = score_bounds(anchors.norms[asked, None], (self.norms, self.norms), low, high)
        left = (above >= least[asked, None]) & (below <= most[asked, None]) & wanted[asked]
        rows, cols = np.flatnonzero(left.any(axis=1)), np.flatnonzero(left.any(axis=0))
        if not len(rows):
            return (np.empty(0, np.int64),) * 3
        scores = inner_products(anchors.data[asked[rows]], self.data[cols])
        left = left[np.ix_(rows, cols)]
        left &= (scores >= least[asked[rows], None]) & (scores <= most[asked[rows], None])
        a, b = np.nonzero(left)
        return asked[rows[a]], cols[b], scores[a, b]

    def overlaps_block(self, anchors: Block, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Anchors for which some row of the block may score between ``least`` and ``most``."""
        low, high = self.angles.min(axis=0).astype(np.float64), self.angles.max(axis=0).astype(np.float64)
        angles = anchors.angles.astype(np.float64)
        nearest = np.maximum(np.maximum(low - angles, angles - high), 0).max(axis=1)
        farthest = widest(angles, low, high).min(axis=1)
        below, above = score_bounds(anchors.norms, (self.norms.min(), self.norms.max()), nearest, farthest)
        return (above >= least) & (below <= most)


class Best:
    """The ``k`` best (score, id) so far: higher scores first, then smaller ids."""

    def __init__(self, k: int, least: float, most: float) -> None:
        self.k, self.least, self.most = k, least, most
        self.scores = self.ids = np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fine = (scores >= self.least) & (scores <= self.most)
        if fine.any():
            scores, ids = np.concatenate([self.scores, scores[fine]]), np.concatenate([self.ids, ids[fine]])
            order = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[order], ids[order]
            if len(self.ids) == self.k:
                self.least = max(self.least, int(self.scores[-1]))


def by_anchor(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pairs in the order of ``rows``, one anchor after another."""
    ends = np.flatnonzero(np.diff(rows, append=-1)) + 1
    at = 0
    for end in ends.tolist():
        yield int(rows[at]), cols[at:end], scores[at:end]
        at = end


def _blocks(rows: DataFrame, size: int, sample: list[np.ndarray], name: str, windows: bool = False) -> DataFrame:
    """Blocks of rows in the order of label, nearest reference and angle; numbered from 0.

    ``windows``: every row brings the ids and scores of its positives.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = ["positives", "scores"] if windows else []

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for width, group in frame.groupby(frame["vector"].map(len)):
                angles = angles_to(whole(group["vector"], width), references(sample, width))
                first = angles.argmin(axis=1)
                yield group.assign(width=width, near=first, angle=angles[np.arange(len(group)), first])

    def whole(vectors: pd.Series, width: int) -> np.ndarray:
        return np.floor(256 * np.array(vectors.tolist(), np.float64).reshape(len(vectors), width))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for width, group in frame.groupby("width", sort=False):
                for at in range(0, len(group), size):
                    part = group.iloc[at : at + size]
                    data = whole(part["vector"], width)
                    kind = "<i4" if np.abs(data).max(initial=0) < 1 << 31 else "<i8"
                    out = {"width": [width], "kind": [kind], "data": [data.astype(kind).tobytes()]}
                    out |= {c + "s": [part[k].to_numpy("<i8").tobytes()] for c, k in (("rid", "rid"), ("id", "vec_id"), ("label", "label"))}
                    out["angles"] = [angles_to(data, references(sample, width)).tobytes()]
                    for c in own:
                        out[c] = [np.concatenate(part[c].tolist()).astype("<i8").tobytes()]
                    if own:
                        out["held"] = [part["scores"].map(len).to_numpy("<i8").tobytes()]
                    yield pd.DataFrame(out)

    listed = "".join(f", {c} array<long>" for c in own)
    keyed = rows.select("rid", "vec_id", "label", "vector", *own).mapInPandas(
        near, f"rid long, vec_id long, label long, vector array<double>{listed}, width int, near int, angle float"
    )
    order = ["width", "label", "near", "angle", "rid"]
    dealt = keyed.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    schema = "width int, kind string, data binary, rids binary, ids binary, labels binary, angles binary"
    made = dealt.mapInPandas(pack, schema + "".join(f", {c} binary" for c in own) + (", held binary" if own else ""))
    made = stored(made.withColumn("block", F.monotonically_increasing_id()), name)
    numbers = made.select("block").withColumn("number", F.row_number().over(Window.orderBy("block")) - 1)
    return made.join(numbers, "block")


Search = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


def _grid(blocks: DataFrame, anchors: DataFrame, search: Search, schema: str) -> DataFrame:
    """``search`` over cells of candidate blocks and anchor blocks of one width."""
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = blocks.count()
    across = max(1, -(-anchors.count() // ANCHOR_CELL))
    down = max(1, min(counted, max(tasks, -(-counted // CANDIDATE_CELL))))
    cells = ["down", "across", "width"]

    def cell(of: str, n: int) -> Column:
        return F.pmod(F.col("number"), F.lit(n)).cast("int").alias(of)

    left = blocks.select(cell("down", down), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("across"), *blocks.columns)
    right = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("down"), cell("across", across), *anchors.columns)
    return left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInPandas(search, schema)


def _shuffled(frame: pd.DataFrame) -> Iterator:
    """Blocks of a cell; blocks next to each other are alike, so the order of their numbers is broken."""
    return frame.sort_values("number", key=lambda n: n.astype("int64") * 2654435761 % (1 << 32)).itertuples(index=False)


def positives(blocks: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """rid, positives, scores: each anchor's ``k`` best other rows of its label, as two arrays, the best first."""

    def search(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"rid": [], "vec_id": [], "score": []}
        for row in asked.itertuples(index=False):
            anchor = Block.of(row)
            best = [Best(k, -np.inf, np.inf) for _ in anchor.ids]
            for one in _shuffled(candidates):
                block = Block.of(one)
                if not np.isin(anchor.labels, block.labels).any():
                    continue
                wanted = (anchor.labels[:, None] == block.labels) & (anchor.rids[:, None] != block.rids)
                least = np.array([b.least for b in best])
                for a, cols, scores in by_anchor(*block.near_rows(anchor, wanted, least, np.full(len(best), np.inf))):
                    best[a].add(scores, block.ids[cols])
            for rid, found in zip(anchor.rids.tolist(), best, strict=True):
                out["rid"] += [rid] * len(found.ids)
                out["vec_id"] += found.ids.tolist()
                out["score"] += found.scores.tolist()
        return pd.DataFrame(out)

    found = _grid(blocks, anchors, search, "rid long, vec_id long, score long")
    order = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    lists = ranked.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("all"))
    return lists.select("rid", F.col("all.vec_id").alias("positives"), F.col("all.score").alias("scores"))


def negatives(blocks: DataFrame, anchors: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """anchor rid and id, positive (its place and id), negative ids and both scores, ranked from 1."""

    def search(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        for row in asked.itertuples(index=False):
            anchor = Block.of(row)
            held, ids, scores = (np.frombuffer(x, "<i8") for x in (row.held, row.positives, row.scores))
            ends = np.cumsum(held)
            places = [range(e - n, e) for e, n in zip(ends.tolist(), held.tolist(), strict=True)]
            best = [Best(k, -(-low * s // 100), high * s // 100) for s in scores.tolist()]
            for one in _shuffled(candidates):
                block = Block.of(one)
                wanted = anchor.labels[:, None] != block.labels
                live = [[best[p] for p in mine if best[p].least <= best[p].most] for mine in places]
                least = np.array([min((b.least for b in mine), default=np.inf) for mine in live], np.float64)
                most = np.array([max((b.most for b in mine), default=-np.inf) for mine in live], np.float64)
                for a, cols, got in by_anchor(*block.near_rows(anchor, wanted, least, most)):
                    for b in live[a]:
                        b.add(got, block.ids[cols])
            for a, mine in enumerate(places):
                for n, p in enumerate(mine):
                    for key, score in zip(best[p].ids.tolist(), best[p].scores.tolist(), strict=True):
                        found.append((int(anchor.rids[a]), int(anchor.ids[a]), n, int(ids[p]), key, int(scores[p]), score))
        return pd.DataFrame(found, columns=["rid", "anchor_id", "place", "positive_id", "negative_id", "positive_score", "negative_score"])

    found = _grid(blocks, anchors, search, "rid long, anchor_id long, place int, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("rid", "place").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, asked: Column | str, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` hold vec_id, embedding and label; ``asked`` picks the anchors.  Components x count as floor(256 * x).  Each
    anchor's positives are the ``n_positives`` other rows of its label of the highest inner products; for each of them the
    result has the ``n_negatives`` rows of other labels of the highest scores among those with ``low`` to ``high`` per
    cent of the positive's score.  Ties go to the smaller vec_id, all are returned where there are fewer, and an anchor
    without positives or negatives has no rows.  Negative positive scores have no window.

    Rows without vec_id or label take no part, nor do null vectors, vectors with null or non-finite components, or
    those whose square sum leaves a long.  Zero and empty vectors take part with scores of 0.  Vectors of different
    lengths never meet.  Rows that repeat a vec_id take part each for itself.  Other columns are ignored.
    """
    condition = F.expr(asked) if isinstance(asked, str) else asked
    vector = F.col("embedding").cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    square = F.aggregate(vector, F.lit(0.0), lambda total, x: total + F.pow(256 * F.abs(x) + 1, 2))
    kept = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("vector"),
        F.coalesce(condition, F.lit(False)).alias("asked"), (fine & (square < float(MOST_SQUARE))).alias("fine"),
    ).where("vec_id is not null and label is not null and vector is not null and fine")
    kept = stored(kept.drop("fine").withColumn("rid", F.monotonically_increasing_id()), "vectors")
    sample = kept.orderBy(F.xxhash64("vec_id"), "rid").limit(SAMPLE).select("vector").collect()
    sample = [np.floor(256 * np.array(r.vector, np.float64)) for r in sample]
    blocks = _blocks(kept, CANDIDATE_BLOCK, sample, "candidate-blocks")
    anchors = kept.where("asked")
    found = stored(positives(blocks, _blocks(anchors, ANCHOR_BLOCK, sample, "anchor-blocks"), n_positives), "positives")
    windows = _blocks(anchors.join(found, "rid"), ANCHOR_BLOCK, sample, "window-blocks", windows=True)
    out = negatives(blocks, windows, n_negatives, low, high)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def shifted_labels(embeddings: DataFrame) -> DataFrame:
    """vec_id, embedding, label: where vec_id is divisible by 7 the label is the next one of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return embeddings.select("vec_id", "embedding", label.alias("label"))


OP13_SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), a AS (SELECT * FROM v WHERE vec_id % 100 = 0), scores AS (
  SELECT a.rid AS rid, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    list_dot_product(a.e, c.e)::BIGINT AS score
  FROM a JOIN v c ON a.rid <> c.rid AND len(a.e) = len(c.e)
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS place
  FROM scores WHERE same QUALIFY place <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
  row_number() OVER (PARTITION BY p.rid, p.place ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.rid = p.rid AND NOT n.same AND 100 * n.score BETWEEN 30 * p.score AND 90 * p.score
QUALIFY rank <= 10
"""
