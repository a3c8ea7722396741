"""Blocks that come to the visitors give what shuffled visits give, and no vector is shipped once for every block."""

import numpy as np
import pytest
from brute import groups, score

from affinis.operators import pairs as P
from affinis.operators import rounds as R
from affinis.operators.proposal import score_histogram


@pytest.fixture(scope="module")
def crowd(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(8, 6))[np.arange(240) % 8] + 0.4 * rng.normal(size=(240, 6))
    v[::20] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    return rows, spark.createDataFrame(rows, "id long, v array<double>").localCheckpoint()


def near(rows, bound, other=None):
    return {(i, j) for i, a in rows for j, b in (other or rows) if (other or i < j) and score("cosine", a, b) >= bound}


@pytest.mark.parametrize("size", [1, R.ROUND_BYTES])  # a block a round, and all in one
def test_rounds(crowd, monkeypatch, size):
    monkeypatch.setattr(R, "ROUND_BYTES", size)
    monkeypatch.setattr(P, "SHIPPED", 0)
    rows, df = crowd
    found = P.near_pairs(df, "id", "v", bound=0.9, rows_per_block=16)
    assert found.placed is not None and found.met.where("_visits").isEmpty()
    want = near(rows, 0.9)
    got = {r["_id"]: (r.class_id, r.links) for r in P.linked_rows(found).collect()}
    number, lowest = groups(want), {}
    for i in sorted(number):
        lowest.setdefault(number[i], i)
    links = np.bincount(np.array(sorted(want)).ravel(), minlength=240)
    assert got == {i: (lowest[number[i]] if i in number else i, links[i]) for i in range(240)}
    listed = P.similar_pairs(df, "id", "v", "cosine", 0.9, rows_per_block=16)
    assert sorted((r.id_a, r.id_b) for r in listed.collect()) == sorted(want)


def test_bins_in_rounds(crowd, monkeypatch):
    monkeypatch.setattr(P, "SHIPPED", 0)
    rows, df = crowd
    got = [r.pairs for r in score_histogram(df, "id", "v", bins=10, rows_per_block=16).orderBy("bin").collect()]
    scores = [score("cosine", a, b) for i, a in rows for j, b in rows if i < j]
    assert got == np.bincount(np.clip(np.floor((np.array(scores) + 1) / 0.2).astype(int), 0, 9), minlength=10).tolist()


@pytest.mark.parametrize("linked", [False, True])
def test_two_tables_in_rounds(spark, crowd, monkeypatch, linked):
    monkeypatch.setattr(P, "SHIPPED", 0)
    monkeypatch.setattr(P, "TOGETHER", 16)
    rows, _ = crowd
    left, right = rows[1:20], [(i, a) for i, a in rows[21:] if i % 20]
    tables = [spark.createDataFrame([(i, v, str(i)) for i, v in side], "_rep long, _vec array<double>, _print string") for side in (left, right)]
    met = {(r["_a"], r["_b"]) for r in P.across(*tables, 0.9, linked=linked).collect()}
    want = near(left, 0.9, right)
    if linked:
        split = lambda edges: {frozenset(i for i, n in g.items() if n == k) for g in [groups(edges)] for k in g.values()}
        assert split(met) == split(want)
    else:
        assert met == want
