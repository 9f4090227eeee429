"""Quality classifier: a byte-level convolutional network in numpy, trained here.

Bytes are embedded, learned filters run over windows of eight bytes, and the rectified responses are max-pooled
over overlapping chunks that cover the whole document.  A small layer scores each chunk, and the document's
probability combines the mean and the least of its chunks' scores.  Labels, language, source and ids are no inputs.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.shared import text_of

EMBED, WINDOW, STEP, FILTERS, HIDDEN = 6, 8, 2, 32, 16
#: Half a chunk: chunks of 256 bytes overlap by 128.
HALF = 128
SPOTS = HALF // STEP
#: The model is fitted on at most so many labelled documents of either class, of at most so many bytes each
#: (the first ones by a hash of doc_id); both bound the one task that fits it.
FIT_ROWS = 1500
FIT_BYTES = 8192
EPOCHS, BATCH, RATE = 14, 32, 0.004
#: Half chunks scored at once, to bound a worker's memory.
AT_ONCE = 384


def halves(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of HALF + WINDOW bytes, each with the start of the next one, and the rows of each text (one at least)."""
    rows, counts = [], []
    for text in texts:
        n = max(1, -(-len(text) // HALF))
        padded = np.zeros((n + 1) * HALF, np.uint8)
        padded[: len(text)] = np.frombuffer(text, np.uint8)
        grid = padded.reshape(n + 1, HALF)
        rows.append(np.hstack([grid[:-1], grid[1:, :WINDOW]]))
        counts.append(n)
    return np.concatenate(rows), np.array(counts)


class ByteConv:
    """The network; ``params`` are its arrays by name."""

    def __init__(self, params: dict[str, np.ndarray]) -> None:
        self.p = params

    @classmethod
    def fresh(cls, seed: int = 7) -> ByteConv:
        r = np.random.default_rng(seed)
        fan = WINDOW * EMBED
        return cls(
            {
                "embed": r.normal(0, 0.5, (256, EMBED)).astype(np.float32),
                "filter": r.normal(0, fan**-0.5 * 1.4, (fan, FILTERS)).astype(np.float32),
                "bias": np.zeros(FILTERS, np.float32),
                "hidden": r.normal(0, (FILTERS + 1) ** -0.5 * 1.4, (FILTERS + 1, HIDDEN)).astype(np.float32),
                "hidden_bias": np.zeros(HIDDEN, np.float32),
                "out": r.normal(0, 0.3, HIDDEN).astype(np.float32),
                "mix": np.array([0.5, 0.5, 0.0], np.float32),  # of the mean, the least, and a constant
            }
        )

    def to_bytes(self) -> bytes:
        buffer = io.BytesIO()
        np.savez(buffer, **self.p)
        return buffer.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> ByteConv:
        with np.load(io.BytesIO(data)) as arrays:
            return cls({k: arrays[k] for k in arrays.files})

    def _windows(self, rows: np.ndarray) -> np.ndarray:
        e = np.ascontiguousarray(self.p["embed"][rows])
        n, _, d = e.shape
        a, b, c = e.strides
        view = np.lib.stride_tricks.as_strided(e, (n, SPOTS, WINDOW * d), (a, b * STEP, c))
        return np.ascontiguousarray(view).reshape(n * SPOTS, WINDOW * d)

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each half chunk (before the rectifier)."""
        out = np.empty((len(rows), FILTERS), np.float32)
        for at in range(0, len(rows), AT_ONCE):
            part = rows[at : at + AT_ONCE]
            out[at : at + AT_ONCE] = (self._windows(part) @ self.p["filter"]).reshape(len(part), SPOTS, FILTERS).max(axis=1)
        return out + self.p["bias"]

    @staticmethod
    def chunks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and second half of each chunk, and the chunks of each text: neighbours, or the only half twice."""
        n = np.maximum(counts - 1, 1)
        starts = np.repeat(np.cumsum(counts) - counts, n)
        first = starts + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return first, first + np.repeat(counts > 1, n), n

    def _scores(self, h: np.ndarray, fill: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.hstack([np.maximum(h, 0), fill[:, None]]).astype(np.float32)
        z = x @ self.p["hidden"] + self.p["hidden_bias"]
        return x, z, np.maximum(z, 0) @ self.p["out"]

    @staticmethod
    def fills(lengths: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How much of its chunk a text covers: below 1 only where it is shorter than a chunk."""
        return np.repeat(np.minimum(1.0, lengths / (2 * HALF)), n)

    def logits(self, texts: list[bytes]) -> np.ndarray:
        rows, counts = halves(texts)
        first, second, n = self.chunks(counts)
        pooled = self.pooled(rows)
        s = self._scores(np.maximum(pooled[first], pooled[second]), self.fills(np.array([len(t) for t in texts]), n))[2]
        at = np.cumsum(n) - n
        mean, least = np.add.reduceat(s, at) / n, np.minimum.reduceat(s, at)
        a, b, c = self.p["mix"]
        return (a * mean + b * least + c).astype(np.float64)

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 11) -> ByteConv:
        """Adam on the cross entropy, both classes weighing the same; gradients pass the winning windows alone."""
        r = np.random.default_rng(seed)
        weight = np.where(labels == 1, 0.5 / max(1e-9, labels.mean()), 0.5 / max(1e-9, 1 - labels.mean()))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, steps = 0, EPOCHS * -(-len(texts) // BATCH)
        for _ in range(EPOCHS):
            order = r.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                g = self._gradients([texts[i] for i in pick], labels[pick], weight[pick])
                step += 1
                rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
                for k, grad in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.99 * v[k] + 0.01 * grad**2
                    self.p[k] = (
                        self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
                    ).astype(np.float32)
        return self

    def _gradients(self, texts: list[bytes], labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        rows, counts = halves(texts)
        windows = self._windows(rows)
        answers = (windows @ p["filter"]).reshape(len(rows), SPOTS, FILTERS)
        won = answers.argmax(axis=1)
        pooled = np.take_along_axis(answers, won[:, None], axis=1)[:, 0] + p["bias"]
        first, second, n = self.chunks(counts)
        left = pooled[first] >= pooled[second]
        h = np.where(left, pooled[first], pooled[second])
        x, z, s = self._scores(h, self.fills(np.array([len(t) for t in texts]), n))
        at = np.cumsum(n) - n
        mean, least = np.add.reduceat(s, at) / n, np.minimum.reduceat(s, at)
        a, b, c = p["mix"]
        error = (1 / (1 + np.exp(-(a * mean + b * least + c))) - labels) * weight / len(texts)
        worst = np.array([i + int(s[i : i + k].argmin()) for i, k in zip(at, n, strict=True)])
        ds = np.repeat(error * a / n, n)
        ds[worst] += error * b
        dz = ds[:, None] * p["out"] * (z > 0)
        dh = (dz @ p["hidden"].T)[:, :-1] * (h > 0)
        dp = np.zeros_like(pooled)
        np.add.at(dp, first, dh * left)
        np.add.at(dp, second, dh * ~left)
        g = {
            "bias": dp.sum(0),
            "hidden": x.T @ dz,
            "hidden_bias": dz.sum(0),
            "out": np.maximum(z, 0).T @ ds,
            "mix": np.array([(error * mean).sum(), (error * least).sum(), error.sum()]),
            "filter": np.zeros_like(p["filter"]),
            "embed": np.zeros_like(p["embed"]),
        }
        spot = np.arange(len(rows))[:, None] * SPOTS + won
        for f in range(FILTERS):
            live = np.flatnonzero(dp[:, f])
            g["filter"][:, f] = dp[live, f] @ windows[spot[live, f]]
            at_byte = won[live, f] * STEP
            back = dp[live, f][:, None] * p["filter"][:, f]
            for k in range(WINDOW):
                np.add.at(g["embed"], rows[live, at_byte + k], back[:, k * EMBED : (k + 1) * EMBED])
        return g


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of doc_id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample_of(docs: DataFrame, known: DataFrame, rows: int, longest: int) -> DataFrame:
    """doc_id, quality, text to learn from, in one partition: at most ``rows`` of either class, one text of a doc_id.

    The documents are read and filtered by many tasks; only the sample is shuffled to one.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    texts = texts.where(F.octet_length("text") <= longest)
    picked = [
        known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for q in (0, 1)
    ]
    met = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    return met.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).repartition(1)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, longest: int = FIT_BYTES) -> tuple[bytes, float]:
    """The fitted network, and half the log odds of label 1 among the labelled rows that are not held out.

    The network is fitted with both classes weighing the same; the odds then lean its scores towards keeping.

    The sample goes to one task, which its bounds allow: at most ``2 * rows`` texts of ``longest`` bytes.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    bad, good = known.agg(F.count_if(F.col("quality") == 0), F.count_if(F.col("quality") == 1)).first()
    sample = sample_of(docs, known, rows, longest)

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        frame = pd.concat(parts).sort_values(["doc_id", "text"]) if parts else pd.DataFrame({"quality": [], "text": []})
        model = ByteConv.fresh()
        if frame["quality"].nunique() == 2:
            model.fit([t.encode("utf-8", "replace") for t in frame["text"]], frame["quality"].to_numpy(np.float64))
        yield pd.DataFrame({"model": [model.to_bytes()]})

    model = sample.mapInPandas(train, "model binary").first()
    data = bytes(model["model"]) if model else ByteConv.fresh().to_bytes()
    return data, float(0.5 * np.log((good + 1) / (bad + 1)))


def score(docs: DataFrame, model: bytes, prior: float, name: str = "quality_score") -> DataFrame:
    """The columns of ``docs`` and ``name``, the score of every whole text (null: empty)."""

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = ByteConv.from_bytes(model)
        for texts in frames:
            out, batch, held = [], [], 0
            for text in texts:
                batch.append(text.encode("utf-8", "replace"))
                held += len(batch[-1])
                if held > 1 << 19:
                    out.append(net.logits(batch))
                    batch, held = [], 0
            if batch:
                out.append(net.logits(batch))
            z = np.concatenate(out) + prior if out else np.zeros(0)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -60, 60))))

    scored = F.pandas_udf(run, "double")
    return docs.withColumn(name, scored(text_of()))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null and empty texts get the score of an empty text; repeated rows score alike; an empty table gives an empty
    result.  Labels that are null or not 0 or 1 are passed over; with labels of one class only, nothing is learned.
    """
    model, prior = fit(docs, labels)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), model, prior)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )
