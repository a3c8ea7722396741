"""Score histograms and proposed thresholds against plain counts and planted pairs."""

import brute
import numpy as np
import pytest

from affinis.operators.proposal import fitted, proposed_threshold, score_histogram

EDGES = np.linspace(-1.0, 1.0, 201)


def planted(seed=4, count=150, near=40, dim=16):
    dice = np.random.default_rng(seed)
    base = dice.normal(size=(count, dim))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    return rows + [(1000 + i, (base[i] + dice.normal(size=dim) * 0.08).tolist()) for i in range(near)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(4)


@pytest.mark.parametrize("low,block", [(-1.0, 32), (0.3, 32), (-1.0, None)])
def test_histogram_counts_every_pair(spark, low, block):
    rows = planted()
    rows += [(3000 + i, rows[3][1]) for i in range(9)] + [(4000, [0.0] * 16), (4001, [0.0] * 16), (4002, [-x for x in rows[5][1]])]
    want = np.zeros(20, dtype=int)
    for score in brute.pairs(rows, "cosine", -2.0).values():
        if score >= low or low == -1.0:
            want[int(np.clip(np.floor((score - low) / ((1.0 - low) / 20)), 0, 19))] += 1
    found = score_histogram(frame(spark, [*rows, (5000, None)]), "id", "v", low, 20, block).orderBy("bin").collect()
    assert [r["pairs"] for r in found] == want.tolist()
    assert found[0]["low"] == low and found[-1]["high"] == 1.0
    if low == -1.0:
        assert want.sum() == len(rows) * (len(rows) - 1) // 2


def test_threshold_parts_planted_pairs(spark):
    rows = planted()
    counted = score_histogram(frame(spark, rows), "id", "v")
    found = proposed_threshold(counted)
    scores = brute.pairs(rows, "cosine", -2.0)
    for (i, j), score in scores.items():
        assert (score >= found.threshold) == (j == i + 1000)
    assert proposed_threshold(counted.orderBy("pairs")) == found
    assert proposed_threshold(score_histogram(frame(spark, rows[:150]), "id", "v")) is None


def test_mixture_of_known_parts():
    dice = np.random.default_rng(1)
    scores = np.r_[dice.normal(0.2, 0.15, 200_000), np.minimum(dice.normal(0.93, 0.03, 200), 1.0)]
    whole = fitted(np.histogram(scores, EDGES)[0].astype(float), EDGES)
    assert whole.means == pytest.approx((0.2, 0.93), abs=0.01) and whole.deviations == pytest.approx((0.15, 0.03), abs=0.01)
    assert whole.weights[1] == pytest.approx(0.001, rel=0.1) and 0.78 < whole.threshold < 0.9
    # What lies below the first edge is estimated.
    upper = np.linspace(0.0, 1.0, 201)
    part = fitted(np.histogram(scores, upper)[0].astype(float), upper)
    assert part.means == pytest.approx(whole.means, abs=0.02) and part.threshold == pytest.approx(whole.threshold, abs=0.02)


def test_no_threshold_without_two_parts(spark):
    dice = np.random.default_rng(2)
    assert fitted(np.zeros(200), EDGES) is None
    assert fitted(np.eye(200)[70] * 50.0, EDGES) is None
    assert fitted(np.histogram(dice.normal(0, 0.15, 100_000), EDGES)[0].astype(float), EDGES) is None
    empty = score_histogram(frame(spark, [(1, [1.0])]).limit(0), "id", "v", bins=4)
    assert [r["pairs"] for r in empty.collect()] == [0] * 4 and proposed_threshold(empty) is None
    with pytest.raises(ValueError, match="histogram"):
        score_histogram(empty, "id", "v", low=1.0)
