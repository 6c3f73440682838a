"""Hard negatives against brute force over all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from galena.llm import hard_negatives as H


def _brute(rows, anchors):
    taking = []
    for row, (vec_id, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        taking.append((row, vec_id, label, [math.floor(256 * x) for x in v]))
    out = []
    for row, vec_id, label, q in taking:
        if vec_id is None or not anchors(vec_id):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, x)), i is None, i or 0, r), lab) for r, i, lab, x in taking)
        positives = [s for s, lab in scored if lab == label and s[3] != row][:5]
        for p in positives:
            fit = [s for s, lab in scored if lab != label and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:5]
            out += [(vec_id, None if p[1] else p[2], k, None if s[1] else s[2], -p[0], -s[0]) for k, s in enumerate(fit, 1)]
    return out


def _rows(seed, n=400, width=6):
    """Vectors of float precision: clusters, ties, copies and odd rows."""
    rng = random.Random(seed)
    near = [[rng.randrange(-40, 60) / 64 for _ in range(width)] for _ in range(5)]
    rows = [(i, [x + rng.randrange(-8, 9) / 64 for x in rng.choice(near)], rng.randrange(10)) for i in range(n)]
    rows += [(n + i, list(near[0]), i % 3) for i in range(40)]  # ties
    rows += [(n + 50, None, 1), (n + 51, [1.0] * width, None), (n + 52, [float("nan")] + [1.0] * (width - 1), 1), (n + 53, [None] * width, 1), (n + 54, [float("-inf")] * width, 1)]
    return rows + [(None, list(near[1]), 2), (n + 60, [], 3), (n + 61, [0.5], 3)] + rows[20:24]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force_in_many_blocks(spark, monkeypatch, seed):
    monkeypatch.setattr(H, "ROWS", 16)
    monkeypatch.setattr(H, "ANCHORS", 4)
    monkeypatch.setattr(H, "GROUP", 3)
    rows = _rows(seed)
    table = spark.createDataFrame([(*r, 0, 1.0) for r in rows], "vec_id long, embedding array<float>, label int, row int, score double").repartition(5)
    got = [tuple(r) for r in H.hard_negatives(table, F.col("vec_id") % 10 == 0).collect()]
    assert sorted(got, key=repr) == sorted(_brute(rows, lambda i: i % 10 == 0), key=repr)


def test_far_clusters_are_ruled_out_by_blocks(spark):
    import numpy as np

    rng, m2 = np.random.default_rng(0), float(300**2)
    pivots = np.eye(4) * 250
    x = np.floor(pivots[[0] * 50 + [3] * 50] * 0.9 + rng.integers(-5, 6, (100, 4)))
    d, q = H._distances(x, pivots, m2), H._distances(x[:1], pivots, m2, True)
    near = np.abs(q[0] - d).max(1)
    top = ((x[0] ** 2).sum() + m2 - near**2) / 2
    assert (top + 1 >= x @ x[0]).all() and top[50:].max() < (x[:50] @ x[0]).min()


def test_empty_tables_and_no_anchors(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0], 3)], "vec_id long, embedding array<double>, label long")
    for some in (table.filter("false"), table, table.withColumn("label", F.lit(None).cast("int"))):
        got = H.hard_negatives(some, F.col("vec_id") % 100 == 0)
        assert got.collect() == [] and got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_scores_beyond_exact_numbers_are_an_error(spark):
    table = spark.createDataFrame([(100, [1e9, 1.0], 3)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="exact scores"):
        H.hard_negatives(table, F.col("vec_id") % 100 == 0).collect()
