"""Hard negatives against brute force, with ties, repeated rows, hot labels, odd vectors and clashing names."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import negatives


def brute(rows, n_pos=5, n_neg=10):
    kept = []
    for at, (key, vector, label) in enumerate(rows):
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = int(math.fmod(label + 1, 10)) if key % 7 == 0 else label
        kept.append((at, key, label, [math.floor(256 * x) for x in vector]))
    out = []
    for at, key, label, v in kept:
        if key % 100:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w)), k, lab) for n, k, lab, w in kept if n != at and len(w) == len(v)]
        for p, positive, _ in sorted(s for s in scores if s[2] == label)[:n_pos]:
            fit = sorted(s[:2] for s in scores if s[2] != label and -30 * p <= -100 * s[0] <= -90 * p)[:n_neg]
            out += [(key, positive, n + 1, k, -p, -s) for n, (s, k) in enumerate(fit)]
    return sorted(out)


def table(seed=1, many=900, width=8):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    rows = []
    for n in range(many):
        centre = r.choice(centres)
        label = 1 if r.random() < 0.4 else r.randint(-2, 9)
        rows.append((n, [float(np.float32(c + r.gauss(0, 0.4))) for c in centre], label))
    rows += [(n, rows[0][1], n % 3) for n in range(2000, 2040)] + [rows[100], rows[200], rows[200]]  # copies and repeated anchors
    rows += [(3000, [0.0] * width, 1), (3001, [0.0] * width, 1), (3002, [0.0] * width, 2), (3100, [], 1), (3101, [], 1), (3102, [], 3)]
    rows += [(3200, [1.0, 2.0], 1), (3201, [1.0, 1.0], 1), (3202, [0.5, 0.6], 4), (3300, [1e6] * width, 1), (3301, [1e6] * width, 1), (3302, [6e5] * width, 2)]
    rows += [(4000, None, 1), (4100, [1.0, None], 1), (4200, [float("nan")] * width, 1), (4300, [float("inf")] * width, 1), (4400, rows[0][1], None), (None, rows[0][1], 1)]
    return rows


@pytest.mark.parametrize("block", [4096, 16])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 4 if block == 16 else 256)
    monkeypatch.setattr(negatives, "ANCHOR_CELL", 2)
    rows = table()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    frame = frame.withColumns({n: F.lit("x") for n in ("rid", "block", "near", "angle", "asked", "vector")})
    got = negatives.hard_negatives(negatives.shifted_labels(frame), "vec_id % 100 = 0").collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_a_square_sum_that_leaves_a_long_takes_no_part(spark):
    rows = [(0, [1e30, 1.0], 1), (1, [1e30, 1.0], 1), (100, [1.0, 1.0], 1), (101, [1.0, 1.0], 1), (102, [0.5, 0.5], 2), (103, [-1e30, 0.0], 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = negatives.hard_negatives(frame, "vec_id % 100 = 0").collect()
    assert [tuple(r) for r in got] == [(100, 101, 1, 102, 131072, 65536)]
    assert negatives.hard_negatives(frame.limit(0), "vec_id % 100 = 0").collect() == []


def test_bounds_hold_and_filter():
    r = np.random.default_rng(5)
    centres = r.normal(size=(5, 16))
    data = np.floor(256 * (centres[r.integers(0, 5, 400)] + 0.1 * r.normal(size=(400, 16))))
    directions = negatives.references(list(data[:50]), 16)
    angles = negatives.angles_to(data, directions)
    norms = np.linalg.norm(data, axis=1)
    low = np.abs(angles[:, None] - angles).max(axis=2)
    total = angles[:, None] + angles
    high = np.minimum(total, 2 * np.pi - total).min(axis=2)
    below, above = negatives.score_bounds(norms[:, None], (norms, norms), low, high)
    scores = negatives.inner_products(data, data)
    assert (below <= scores).all() and (scores <= above).all()
    assert (above < 0.9 * scores.max(axis=1)[:, None]).mean() > 0.3  # directions among clustered rows do filter
