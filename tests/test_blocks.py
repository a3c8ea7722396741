"""Screened block scores, class rows and assignments of a short list against plain ones."""

import brute
import numpy as np
import pytest

from affinis.functions import blocks as B
from affinis.operators import sparse
from affinis.operators.linking import _reachable, cross_pairs, one_to_one
from affinis.operators.pairs import linked_rows, near_pairs
from affinis.operators.sparse import sparse_near


def rows_of(seed, count, width=24):
    dice = np.random.default_rng(seed)
    base = dice.normal(size=(count // 4, width))
    return np.concatenate([base[dice.integers(len(base), size=count - 10)] + dice.normal(size=(count - 10, width)) * 0.2, base[:10]])


@pytest.mark.parametrize("metric,floor", [("cosine", 0.6), ("dot", 12.0), ("euclidean", -3.0), ("manhattan", -9.0)])
@pytest.mark.parametrize("exact", [4096, 0])
def test_linked_equals_all_scores(monkeypatch, metric, floor, exact):
    monkeypatch.setattr(B, "EXACT", exact)
    monkeypatch.setattr(B, "TILE", (50, 70))
    v = B.prepared(metric, rows_of(1, 200))
    all_scores = B.pair_goodness(metric, v.T[:, :, None], v.T[:, None, :])
    np.fill_diagonal(all_scores, -np.inf)
    best, seen = np.full(len(v), -np.inf), set()
    for i, j, known, value in B.Scorer(metric, v).linked(v, floor, within=True):
        seen |= set(zip(i.tolist(), j.tolist(), strict=True))
        assert (all_scores[i[known], j[known]] == value[known]).all()
        np.maximum.at(best, i[known], value[known])
    assert seen == set(zip(*[x.tolist() for x in np.nonzero(all_scores >= floor)], strict=True)) and len(seen) > 100
    want = all_scores.max(axis=1)
    assert (best == np.where(want >= floor, want, -np.inf)).all()


def test_manhattan_screen_is_within_its_error():
    v = rows_of(2, 120, 64)
    scorer = B.Scorer("manhattan", v)
    for rows in (v[:30], 5 * v[:30]):  # the second reach beyond the first grid
        rough, error = scorer._screen(rows)
        assert (np.abs(rough - B.goodness("manhattan", rows, v)) <= error[:, None]).all() and (error < 3.0).all()


@pytest.mark.parametrize("low", [-1.0, 0.3])
def test_binned_scores(low):
    v = B.prepared("cosine", np.round(rows_of(3, 150, 4)))
    want = np.floor((B.pair_goodness("cosine", v.T[:, :, None], v.T[:, None, :]) - low) / ((1 - low) / 50))
    for own, part, got in B.Scorer("cosine", v).binned(v, low, 50):
        assert (got == np.clip(want[own, part], -1 if low > -1 else 0, 49)).all()


def test_class_rows_through_lists_and_blocks(spark, monkeypatch):
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows_of(4, 120, 6))] + [(500, [0.0] * 6), (501, [0.0] * 6)]
    data += [(600 + i, data[5][1]) for i in range(4)]  # copies
    df = spark.createDataFrame([*data, (900, None)], "id long, v array<double>").repartition(3)
    pairs = brute.pairs(data, "cosine", 0.97)
    group, count = brute.groups(pairs), {}
    for pair in pairs:
        for i in pair:
            count[i] = count.get(i, 0) + 1
    low = {g: min(i for i in group if group[i] == g) for g in set(group.values())}
    want = sorted((i, low[group[i]] if i in group else i, count.get(i, 0)) for i, _ in data)
    assert sorted(map(tuple, linked_rows(near_pairs(df, "id", "v", bound=0.97, rows_per_block=40)).collect())) == want
    assert sorted(map(tuple, linked_rows(sparse_near(df, "id", "v", bound=0.97)[0]).collect())) == want
    # Where every component is common, lists meet too often and blocks are taken, with the same rows.
    monkeypatch.setattr(sparse, "FEW", 0)
    monkeypatch.setattr(sparse, "meetings", lambda *a: None if a[-1] < 1e6 else 1 / 0)
    near, _ = sparse_near(df, "id", "v", bound=0.97)
    assert not near.listed and sorted(map(tuple, linked_rows(near).collect())) == want


def test_lists_matched_by_blocks(spark, monkeypatch):
    from affinis.operators import linking

    monkeypatch.setattr(linking, "meetings", lambda *a: None)
    left = [(i, [float(x) for x in v]) for i, v in enumerate(rows_of(5, 90, 6))]
    right = [(j, v) for j, (_, v) in enumerate(left[::9])]
    frames = [spark.createDataFrame(x, "id long, v array<double>") for x in (left, right)]
    want = {(i, j): s for i, a in left for j, b in right if (s := brute.score("cosine", a, b)) >= 0.5}
    found = cross_pairs(*frames, "id", "id", "v", "v", 0.5)
    got = {(r["left_id"], r["right_id"]): r["score"] for r in found.collect()}
    assert got == want
    taken, lefts, rights = [], set(), set()
    for s, i, j in sorted((-s, i, j) for (i, j), s in want.items()):
        if i not in lefts and j not in rights:
            taken.append((i, j, -s))
            lefts.add(i)
            rights.add(j)
    assert sorted(tuple(r)[:3] for r in one_to_one(found).collect()) == sorted(taken)


def test_few_pairs_of_a_short_list_are_left(spark):
    pairs = spark.createDataFrame([(i, j, 1.0 - i / 1000 - j / 1e6) for i in range(100) for j in range(3)], "left_id long, right_id long, score double")
    assert _reachable(pairs.unionByName(pairs)).count() == 9
    assert sorted(tuple(r)[:2] for r in one_to_one(pairs).collect()) == [(0, 0), (1, 1), (2, 2)]


@pytest.mark.parametrize("metric,floor", [("cosine", 0.6), ("dot", 12.0), ("euclidean", -3.0), ("manhattan", -9.0)])
@pytest.mark.parametrize("within", [True, False])
def test_crowds_are_told_by_masks(monkeypatch, metric, floor, within):
    monkeypatch.setattr(B, "EXACT", 0)
    monkeypatch.setattr(B, "CROWD", 1 << 20)
    monkeypatch.setattr(B, "TILE", (50, 70))
    v = B.prepared(metric, rows_of(1, 200))
    scores = B.pair_goodness(metric, v.T[:, :, None], v.T[:, None, :])
    if within:
        np.fill_diagonal(scores, -np.inf)
    near, best = np.zeros(scores.shape, bool), np.full(len(v), -np.inf)
    labels, want = np.arange(len(v)), np.arange(len(v))
    for met in B.Scorer(metric, v).met(v, floor, within):
        assert met.near is not None and met.near[met.i - met.own.start, met.j - met.part.start].all()
        near[met.own, met.part] = met.near
        np.maximum.at(best, met.i, met.value)
        labels = B.joined_crowd(labels, met.near, np.arange(len(v))[met.own], np.arange(len(v))[met.part])
    assert (near == (scores >= floor)).all() and near.sum() > 100
    top = scores.max(axis=1)
    assert (best == np.where(top >= floor, top, -np.inf)).all()
    assert (labels == B.joined_labels(want, *np.nonzero(near))).all() and len(np.unique(labels)) > 1
