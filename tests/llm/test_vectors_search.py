import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.llm.partitions import balanced_cut, fit_router, learned_neighbours, nearest_in, unit_rows
from affinis.llm.threshold import inner_product_top, threshold_top

ODD = [
    (100, [0.5, 0.25, -1.0]),
    (100, [0.5, 0.25, -1.0]),
    (200, [0.0, 0.0, 0.0]),
    (3, None),
    (4, []),
    (5, [1.0, None, 2.0]),
    (6, [float("nan"), 1.0, 1.0]),
    (7, [float("inf"), 1.0, 1.0]),
    (8, [1.0, 2.0]),
    (None, [0.5, 0.25, -1.0]),
    (10, [-0.1, 0.2, 0.3]),
    (11, [0.5, 0.25, -1.0]),
    (300, [2.0, 0.1, 0.7]),
]


def usable(rows):
    return [(k, i, v) for k, (i, v) in enumerate(rows) if v and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v)]


def id_key(i):
    return (i is None, i or 0)


def plain_products(rows, every, k, scale=1024):
    rows = [(n, i, [math.floor(scale * x) for x in v]) for n, i, v in rows]
    out = []
    for n, i, v in rows:
        if i is not None and i % every == 0:
            scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), id_key(j), j) for m, j, w in rows if m != n]
            out += [(i, rank + 1, j, -s) for rank, (s, _, j) in enumerate(sorted(scored, key=lambda x: x[:2])[:k])]
    return sorted(out, key=str)


def test_products_of_the_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(k, r["vec_id"], r["embedding"]) for k, r in enumerate(e.collect())]
    for block in (4096, 60):
        got = inner_product_top(e, "vec_id", "embedding", F.col("vec_id") % 100 == 0, block=block).collect()
        assert sorted(map(tuple, got), key=str) == plain_products(rows, 100, 10)


def test_products_of_odd_rows(spark):
    df = spark.createDataFrame([(*r, 1, 2.0, "x") for r in ODD], "vec_id long, embedding array<double>, _row int, score double, rank string")
    got = inner_product_top(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0, k=4).collect()
    assert sorted(map(tuple, got), key=str) == plain_products(usable(ODD), 100, 4)
    assert inner_product_top(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 100 == 0).count() == 0
    assert inner_product_top(df, "vec_id", "embedding", F.lit(False)).count() == 0


def test_threshold_stops_early_and_keeps_ties():
    dice = np.random.default_rng(1)
    rows = np.round(dice.normal(size=(2000, 4)) * 20)
    rows[:50] = [90, 90, 90, 90]
    order = np.argsort(rows, axis=0, kind="stable")
    place, score, depth = threshold_top(rows, order, np.array([1.0, 2.0, 0.5, 1.0]), 10, -np.inf, np.zeros(2000, bool))
    assert set(range(50)) <= set(place.tolist()) and depth < 2000
    for _ in range(30):
        query = np.round(dice.normal(size=4) * 10)
        place, score, _ = threshold_top(rows, order, query, 10, -np.inf, np.zeros(2000, bool))
        want = np.sort(rows @ query)[::-1][:10]
        assert np.sort(score)[::-1][:10].tolist() == want.tolist()
        assert set(np.flatnonzero(rows @ query >= want[-1])) == set(place.tolist())


def test_large_whole_components(spark):
    rows = [(0, [4e9, -3e9]), (1, [1e9, 1.0]), (2, [1e9, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = inner_product_top(df, "vec_id", "embedding", F.col("vec_id") == 0, scale=1).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, 4 * 10**18 - 21 * 10**9), (1, 4 * 10**18 - 3 * 10**9)][::-1]


@pytest.mark.parametrize("search", [learned_neighbours, inner_product_top])
def test_consumers_may_drop_columns(spark, search):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    odd = spark.createDataFrame([(*r, 1) for r in ODD], "vec_id long, embedding array<double>, _vec int")
    for df in (e, odd):
        found = search(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0, k=3)
        whole = found.collect()
        assert found.count() == len(whole) > 0
        narrow = found.select("vec_id", "score").collect()
        assert sorted((str(r["vec_id"]), r["score"]) for r in narrow) == sorted((str(r["vec_id"]), r["score"]) for r in whole)
        named = found.join(df.select("vec_id").distinct(), "vec_id").count()
        assert named == sum(r["vec_id"] is not None for r in whole)


def plain_nearest(rows, every, k):
    out = {}
    unit = {n: np.array(v) / np.linalg.norm(v) for n, _, v in rows}
    for n, i, _ in rows:
        if i is not None and i % every == 0:
            scored = sorted((-round(float(unit[n] @ unit[m]), 12), id_key(j), j) for m, j, _ in rows if m != n)
            out.setdefault(i, []).append([j for _, _, j in scored[:k]])
    return out


def test_recall_and_scores_on_the_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(k, r["vec_id"], r["embedding"]) for k, r in enumerate(e.collect())]
    vectors = {i: np.array(v, float) for _, i, v in rows}
    want = plain_nearest(rows, 50, 5)
    found, total = 0, 0
    got = learned_neighbours(e, "vec_id", "embedding", F.col("vec_id") % 50 == 0, block=500).collect()
    for q, (near,) in want.items():
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        for r in mine:
            a, b = vectors[q], vectors[r["vec_id"]]
            assert r["score"] == pytest.approx(a @ b / math.sqrt((a @ a) * (b @ b)), abs=1e-14)
        found += len({r["vec_id"] for r in mine} & set(near))
        total += 5
    assert found / total >= 0.9


def test_clustered_vectors_need_few_parts():
    dice = np.random.default_rng(2)
    centres = dice.normal(size=(32, 24)) * 3
    unit = unit_rows(centres[dice.integers(0, 32, 3000)] + dice.normal(size=(3000, 24)))
    part = balanced_cut(unit, nearest_in(unit, np.arange(3000), 10), 16)
    sizes = np.bincount(part, minlength=16)
    assert sizes.min() >= 0.85 * 3000 / 16 and sizes.max() <= 1.15 * 3000 / 16
    assert fit_router(unit, 16, 5, 0.97).probes <= 6


def test_rows_that_measure_teach_nothing(monkeypatch):
    from affinis.llm import partitions

    cut = []
    monkeypatch.setattr(partitions, "balanced_cut", lambda unit, *rest: cut.append(len(unit)) or balanced_cut(unit, *rest))
    partitions.fit_router(unit_rows(np.random.default_rng(4).normal(size=(1000, 16))), 8, 5, 0.97)
    assert cut == [800]


def test_recall_of_rows_outside_the_fit(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    held = e.toArrow()
    ids, unit = held["vec_id"].to_numpy(), unit_rows(np.array(held["embedding"].to_pylist(), float))
    queries = np.flatnonzero(ids % 10 == 0)
    found = {i: set() for i in ids[queries].tolist()}
    for r in learned_neighbours(e, "vec_id", "embedding", F.col("vec_id") % 10 == 0, fit_rows=500).collect():
        found[r["query_id"]].add(r["vec_id"])
    near = nearest_in(unit, queries, 5)
    assert np.mean([len(found[ids[q]] & set(ids[n].tolist())) / 5 for q, n in zip(queries, near, strict=True)]) >= 0.97


def test_nearest_of_odd_rows(spark):
    df = spark.createDataFrame([(*r, 1, 2.0, "x") for r in ODD], "vec_id long, embedding array<double>, _part int, score double, rank string")
    got = learned_neighbours(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0, k=3).collect()
    rows = [r for r in usable(ODD) if any(r[2])]
    want = plain_nearest(rows, 100, 3)
    seen = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        seen.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sorted(seen) == [100, 300]
    assert seen[300] == want[300][0]
    assert sorted(seen[100], key=str) == sorted([j for near in want[100] for j in near], key=str)
    assert learned_neighbours(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 100 == 0).count() == 0
    alone = df.where("vec_id = 300")
    assert learned_neighbours(alone, "vec_id", "embedding", F.col("vec_id") % 100 == 0).count() == 0


def test_a_third_of_equal_vectors(spark):
    dice = random.Random(4)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else [dice.gauss(0, 1) for _ in range(3)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = learned_neighbours(df, "vec_id", "embedding", F.col("vec_id") % 300 == 0, k=5, block=50).collect()
    for q in (0, 300, 600):
        near = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert near == [i for i in range(0, 21, 3) if i != q][:5]
