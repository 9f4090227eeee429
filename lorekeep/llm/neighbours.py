"""Nearest neighbours by a block matrix join with error-bounded int8 tiles.

Vectors are quantised to int8 with one scale per vector and packed into blocks.  A tile multiplies a block of
queries with a block of candidates on the int8 codes; the quantisation errors bound each distance from below and
above.  A pair survives if its lower bound does not exceed the query's tenth smallest upper bound so far; survivors
are recomputed from the original vectors in double precision and kept in a heap per query.  The result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.shared import stored

#: Queries and candidates in a block: a tile of their products is 32 MB.
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
#: Components multiplied at once: sums of so many products of codes are whole numbers below 2^24, exact in float32.
PANEL = 1024
#: Blocks of either kind in a cell of the grid: at 64 components a task holds some 40 MB.
CELL_BLOCKS = 16


def usable(vector: Column) -> Column:
    """A vector without null or non-finite components that is not empty and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and each vector's distance from what its codes stand for."""
    scale = np.abs(vectors).max(axis=1) / 127.0
    scale[scale == 0] = 1.0  # only where 1/127 of the largest component underflows
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    error = np.sqrt(((vectors - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, error


def exact_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of row pairs in double precision, components added in order."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += (a[:, d] - b[:, d]) ** 2
    return np.sqrt(total)


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of code rows, exact: panels are summed in float32 and added up in float64."""
    total = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], PANEL):
        total += a[:, at : at + PANEL].astype(np.float32) @ b[:, at : at + PANEL].astype(np.float32).T
    return total


class Queries:
    """A block of queries with a heap of the nearest so far for each; ``rids`` tell rows apart."""

    def __init__(self, rids: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.rids, self.ids, self.vectors, self.k = rids, ids, vectors, k
        self.codes, self.scale, self.error = quantised(vectors)
        self.norm = ((self.codes * self.scale[:, None]) ** 2).sum(axis=1)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.bound = np.full(len(ids), np.inf)

    def meet(self, rids: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """One tile."""
        codes, scale, error = quantised(vectors)
        norm = ((codes * scale[:, None]) ** 2).sum(axis=1)
        squares = self.norm[:, None] + norm - 2 * code_products(self.codes, codes) * (self.scale[:, None] * scale)
        about = np.sqrt(np.maximum(squares, 0))
        # rounding of the squares themselves, for the case that they cancel
        slack = self.error[:, None] + error + np.sqrt(1e-13 * (self.norm[:, None] + norm))
        same = self.rids[:, None] == rids
        upper = np.where(same, np.inf, about + slack)
        if upper.shape[1] > self.k:
            kth = np.partition(upper, self.k - 1, axis=1)[:, self.k - 1]
            limit = np.minimum(self.bound, kth)
        else:
            limit = self.bound
        rows, cols = np.nonzero((about - slack <= limit[:, None]) & ~same)
        scores = exact_distance(self.vectors[rows], vectors[cols])
        for row, score, key in zip(rows.tolist(), scores.tolist(), ids[cols].tolist(), strict=True):
            heap = self.heaps[row]
            if len(heap) < self.k:
                heapq.heappush(heap, (-score, -key))
            elif (-score, -key) > heap[0]:
                heapq.heapreplace(heap, (-score, -key))
            if len(heap) == self.k:
                self.bound[row] = -heap[0][0]

    def rows(self) -> pd.DataFrame:
        queries = zip(self.rids.tolist(), self.ids.tolist(), self.heaps, strict=True)
        found = [(r, q, -key, -score) for r, q, heap in queries for score, key in heap]
        return pd.DataFrame(found, columns=["rid", "query_id", "vec_id", "score"])


def _blocks(vectors: DataFrame, size: int, name: str, kind: str) -> DataFrame:
    """block, rids, ids, data (row after row): bounded groups of rows of one length, packed where they are read."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for width, group in frame.groupby(frame["vector"].map(len)):
                for at in range(0, len(group), size):
                    part = group.iloc[at : at + size]
                    data = np.stack(part["vector"].to_numpy()).astype(kind)
                    numbers = [part[c].to_numpy("<i8").tobytes() for c in ("rid", "vec_id")]
                    yield pd.DataFrame({"width": [width], "rids": numbers[:1], "ids": numbers[1:], "data": [data.tobytes()]})

    made = vectors.select("rid", "vec_id", "vector").mapInPandas(pack, "width int, rids binary, ids binary, data binary")
    return stored(made.withColumn("block", F.monotonically_increasing_id()), name)


def nearest(vectors: DataFrame, asked: Column | str, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest candidates of each row that ``asked`` picks, ties to the smaller vec_id.

    The table holds vec_id and embedding; a row is no candidate of its own.  Vectors that are null, empty, zero
    or hold null or non-finite components take no part, nor do rows without vec_id; vectors of different lengths
    never meet.  Rows that repeat a vec_id are candidates and queries each for itself.  All candidates are returned
    where there are fewer than ``k``.
    """
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    condition = F.expr(asked) if isinstance(asked, str) else asked
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"  # as the table has them; distances are in double precision
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("vector"),
        F.coalesce(condition, F.lit(False)).alias("asked"),
    )
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector").cast("array<double>")))
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    questions = rows.where("asked")
    query_blocks = _blocks(questions.repartition(max(1, -(-questions.count() // QUERY_BLOCK))), QUERY_BLOCK, "query-blocks", kind)
    blocks = _blocks(rows, CANDIDATE_BLOCK, "candidate-blocks", kind)
    # a grid: groups of candidate blocks against groups of query blocks; a cell is what one task holds
    counted = blocks.count()
    across = max(1, -(-query_blocks.count() // CELL_BLOCKS))
    down = max(1, min(counted, max(tasks, -(-counted // CELL_BLOCKS))))
    cells = ["down", "across", "width"]
    left = blocks.select(
        F.pmod(F.xxhash64("block"), F.lit(down)).alias("down"),
        F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("across"),
        "width", "rids", "ids", "data",
    )
    right = query_blocks.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("down"),
        F.pmod(F.xxhash64("block"), F.lit(across)).cast("int").alias("across"),
        "width", "rids", "ids", "data",
    )

    def unpacked(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rids, ids = (np.frombuffer(x, "<i8") for x in (block.rids, block.ids))
        return rids, ids, np.frombuffer(block.data, kind).reshape(len(ids), block.width).astype(np.float64)

    def search(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for query in asked.itertuples(index=False):
            block = Queries(*unpacked(query), k)
            for one in candidates.itertuples(index=False):
                block.meet(*unpacked(one))
            out.append(block.rows())
        return pd.concat(out) if out else pd.DataFrame({"rid": [], "query_id": [], "vec_id": [], "score": []})

    found = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInPandas(
        search, "rid long, query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("rid").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


OP4_SQL = r"""
WITH v AS (
  SELECT vec_id, row_number() OVER () AS rid, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND vec_id IS NOT NULL
), d AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score
  FROM v q JOIN v c ON q.rid <> c.rid
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY rid ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score
FROM d
QUALIFY rank <= 10
"""
