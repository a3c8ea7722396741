import numpy as np
import pytest
from brute import top_k
from pyspark.sql import functions as F

from affinis.operators.compare import score_stats
from affinis.operators.topk import nearest, neighbours

METRICS = ["cosine", "euclidean", "manhattan", "dot"]


def clustered(rows=240, dim=6, seed=3):
    """Clusters, many exact copies (a third of the rows), near copies and a zero vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim)) * 3
    points = []
    for i in range(rows):
        if i % 3 == 0:
            points.append([1.0] * dim)
        elif i % 40 == 1:
            points.append([0.0] * dim)
        elif i % 7 == 2:
            points.append([1.0 + (i % 5) * 1e-6] + [1.0] * (dim - 1))
        else:
            points.append((centres[i % 8] + rng.normal(size=dim) * 0.2).tolist())
    return [(i * 3 + 5, [float(np.float32(x)) for x in p]) for i, p in enumerate(points)]


@pytest.fixture(scope="module")
def hard(spark):
    rows = clustered()
    return rows, spark.createDataFrame(rows, "id long, v array<float>")


def as_lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (int(r.query_key), r["rank"])):
        out.setdefault(int(r.query_key), []).append((int(r.neighbor_key), r.score))
    return out


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("block", [None, 16])
def test_equals_brute_force(hard, metric, block):
    rows, df = hard
    got = as_lists(neighbours(df, "id", "v", metric=metric, top_k=4, decimals=6, rows_per_block=block))
    want = top_k(rows, metric, 4)
    assert set(got) == set(want)
    for i, expected in want.items():
        assert [j for j, _ in got[i]] == [j for j, _ in expected], i
        assert [s for _, s in got[i]] == pytest.approx([s for _, s in expected], abs=2e-6)


@pytest.mark.parametrize("metric", METRICS)
def test_without_copies_in_many_blocks(spark, metric):
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=5)]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = as_lists(neighbours(df, "id", "v", metric=metric, top_k=3, decimals=6, rows_per_block=12))
    want = top_k(rows, metric, 3)
    assert {i: [j for j, _ in g] for i, g in got.items()} == {
        i: [j for j, _ in w] for i, w in want.items()
    }


def test_shape_and_ranks(vectors):
    found = neighbours(vectors, "id", "v", "name", top_k=3)
    assert found.columns == ["query_key", "neighbor_key", "rank", "score"]
    rows = found.collect()
    assert len(rows) == 15
    assert min(r["rank"] for r in rows) == 1
    first = {r.query_key: r.neighbor_key for r in rows if r["rank"] == 1}
    assert all(first[n] == "Epsilon" for n in ("Alpha", "Beta", "Gamma", "Delta"))


def test_k_beyond_the_table_never_returns_self(vectors):
    rows = neighbours(vectors, "id", "v", "name", top_k=50).collect()
    assert len(rows) == 5 * 4
    assert all(r.query_key != r.neighbor_key for r in rows)


def test_same_key_on_another_row_is_a_neighbour(spark):
    rows = [(1, "x", [1.0, 0.0]), (2, "x", [0.9, 0.1]), (3, "y", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, k string, v array<float>")
    best = neighbours(df, "id", "v", "k", top_k=1).collect()
    assert {(r.query_key, r.neighbor_key) for r in best if r.query_key == "x"} == {("x", "x")}


def test_threshold_tests_the_rounded_score(spark):
    angle = np.arccos(0.8951)
    rows = [(1, [1.0, 0.0]), (2, [float(np.cos(angle)), float(np.sin(angle))])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert neighbours(df, "id", "v", threshold=0.90, decimals=2).count() == 2
    assert neighbours(df, "id", "v", threshold=0.90, decimals=4).count() == 0
    # ignored for the other metrics
    assert neighbours(df, "id", "v", metric="dot", threshold=5.0).count() == 2


def test_errors(spark, vectors):
    with pytest.raises(ValueError, match="No metric is called"):
        neighbours(vectors, "id", "v", metric="hamming")
    with pytest.raises(ValueError, match="top_k"):
        neighbours(vectors, "id", "v", top_k=0)
    ragged = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<float>")
    with pytest.raises(ValueError, match="dimension"):
        neighbours(ragged, "id", "v")


def test_empty_input(spark):
    df = spark.createDataFrame([], "id long, v array<float>")
    assert neighbours(df, "id", "v").count() == 0


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("block", [None, 16])
def test_two_tables(hard, spark, metric, block):
    rows, df = hard
    asked = [(1, rows[0][1]), (2, rows[5][1]), (3, rows[7][1]), (4, rows[0][1]), (5, [0.0] * 6)]
    queries = spark.createDataFrame(asked, "q long, w array<float>")
    got = as_lists(
        nearest(queries, "q", "w", df, "id", "v", metric=metric, top_k=5, decimals=6, rows_per_block=block)
    )
    for q, vector in asked:
        want = top_k([(-1, vector), *rows], metric, 5)[-1]
        assert [j for j, _ in got[q]] == [j for j, _ in want]


def test_probing_every_cell_is_exact_and_few_cells_recall_most(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(10, 8)) * 4
    rows = [(i, (centres[i % 10] + rng.normal(size=8) * 0.3).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    options = dict(top_k=5, decimals=6, rows_per_block=30)
    exact = {(r.query_key, r.neighbor_key) for r in neighbours(df, "id", "v", **options).collect()}
    every = {(r.query_key, r.neighbor_key) for r in neighbours(df, "id", "v", probes=10**6, **options).collect()}
    few = neighbours(df, "id", "v", probes=3, **options).collect()
    assert every == exact
    hit = len(exact & {(r.query_key, r.neighbor_key) for r in few}) / len(exact)
    assert hit > 0.8


def test_score_stats(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "score double")
    row = score_stats(df).first()
    assert (row["mean"], row["median"], row["min"], row["max"]) == (2.5, 2.0, 1.0, 5.0)
    assert row["std"] == pytest.approx(np.std([1, 2, 2, 5], ddof=1))


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("block", [None, 16])
def test_asked_rows_search_all_rows(hard, metric, block):
    rows, df = hard
    got = as_lists(neighbours(df, "id", "v", metric=metric, top_k=4, decimals=6, rows_per_block=block, asked=F.col("id") % 4 == 0))
    want = {i: w for i, w in top_k(rows, metric, 4).items() if i % 4 == 0}
    assert {i: [j for j, _ in g] for i, g in got.items()} == {i: [j for j, _ in w] for i, w in want.items()}
    for i, expected in want.items():
        assert [s for _, s in got[i]] == pytest.approx([s for _, s in expected], abs=2e-6)


def test_asked_rows_are_bounded_by_the_table(vectors):
    rows = neighbours(vectors, "id", "v", "name", top_k=50, asked=F.col("id") == 5).collect()
    assert {r.neighbor_key for r in rows} == {"Alpha", "Beta", "Gamma", "Delta"}
    assert neighbours(vectors, "id", "v", "name", asked=F.col("id") > 5).count() == 0
