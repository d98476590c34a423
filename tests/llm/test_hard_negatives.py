import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm.hard_negatives import LEAST, MOST, mine_hard_negatives, tiles, valid_points


def brute(rows, positives=5, negatives=3):
    points = []
    for i, label, x in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        points.append((i, label, [math.floor(256 * v) if abs(v) < 2**900 else int(v) * 256 for v in x]))
    score = lambda a, b: min(max(sum(p * q for p, q in zip(a, b, strict=False)), LEAST), MOST)
    out = []
    for n, (i, label, x) in enumerate(points):
        if i % 50:
            continue
        others = [(-score(x, y), j, own) for m, (j, own, y) in enumerate(points) if m != n]
        for p, j, _ in sorted(o for o in others if o[2] == label)[:positives]:
            near = sorted((s, k) for s, k, own in others if own != label and 50 * -p <= 100 * -s <= 95 * -p)
            out += [(i, j, r + 1, k, -p, -s) for r, (s, k) in enumerate(near[:negatives])]
    return sorted(out)


def cases():
    rng = random.Random(3)
    grid = [(i, rng.randrange(3), [rng.randrange(-3, 4) / 4 for _ in range(6)]) for i in range(400)]
    copies = [(i, 0, [0.5, 0.25, 0.0, 0.0, 0.0, 1.0]) for i in range(400, 520)] + [(i, 1, [0.25, 0.25, 0.0, 0.0, 0.0, 0.75]) for i in range(520, 560)]
    odd = [(None, 1, [1.0] * 6), (50, None, [1.0] * 6), (100, 1, None), (150, 1, [None] * 6), (200, 2, [float("nan")] * 6), (250, 2, [float("inf")] * 6), (300, 1, []), (350, 1, [1.0, 1.0]), (350, 1, [1.0, 1.0]), (-50, 2, [0.5] * 8)]
    large = [(600 + i, i % 2, [2.0**40 * (i + 1), -(2.0**39), 1e30 if i == 7 else 3.0]) for i in range(12)]
    return {"grid": grid, "copies": grid + copies, "odd": grid[:120] + odd, "large": large + grid[:30], "one label": [(i, 1, [1.0]) for i in range(60)], "empty": []}


@pytest.mark.parametrize("name", list(cases()))
def test_against_brute_force(spark, name):
    rows = cases()[name]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("rank", F.lit("clash")).repartition(3)
    points = valid_points(df, "embedding", "label", "vec_id")
    for settings in ({"group_rows": 64, "page_rows": 8, "block_rows": 100, "directory": 3}, {}):
        found = mine_hard_negatives(points, F.col("id") % 50 == 0, **settings)
        assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(map(tuple, found.collect())) == brute(rows)


def test_tiles_hold_every_row_once():
    points = np.random.default_rng(1).normal(size=(1000, 5))
    found = tiles(points, np.arange(1000), [2, 0, 4], 32)
    assert sorted(np.concatenate(found).tolist()) == list(range(1000)) and max(map(len, found)) <= 32
