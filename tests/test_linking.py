"""Sparse joins, matches of two lists, groups under growth and neighbour graphs against brute force."""

import time

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.operators.encode import encoder_portions, hashing
from affinis.operators.graph import beam_search, neighbour_graph
from affinis.operators.linking import cross_pairs, one_to_one
from affinis.operators.matching import match
from affinis.operators.sparse import sparse_near, sparse_pairs
from affinis.sources.grouped import GroupedVectors


def sparse_rows(seed, count, dim=40, filled=6, first=0):
    dice = np.random.default_rng(seed)
    rows = []
    for i in range(count):
        v = np.zeros(dim)
        if rows and dice.random() < 0.5:
            v = np.array(rows[int(dice.integers(len(rows)))][1])
            v[int(dice.integers(dim))] += float(dice.choice([0.0, 0.3, -0.4]))
        else:
            v[dice.choice(dim, filled, replace=False)] = dice.normal(size=filled)
        rows.append((first + i, [float(x) for x in v]))
    return rows + [(first + count, [0.0] * dim)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(4)


@pytest.mark.parametrize("bound,listed", [(0.9, 2048), (0.5, 2048), (0.2, 7)])
def test_sparse_pairs_against_all_pairs(spark, bound, listed):
    rows = sparse_rows(1, 150)
    df = frame(spark, [*rows, (1000, None)])
    want = brute.pairs(rows, "cosine", bound)
    got = {(r["id_a"], r["id_b"]): r["score"] for r in sparse_pairs(df, "id", "v", bound, listed=listed).collect()}
    assert got.keys() == want.keys() and len(want) > 20
    assert all(got[p] == pytest.approx(want[p], abs=1e-12) for p in want)
    near, scored = sparse_near(df, "id", "v", bound=bound)
    assert len(near.pairs.collect()) <= scored < 150 * 149 // 2


def test_sparse_pairs_of_odd_tables(spark):
    df = frame(spark, sparse_rows(2, 5))
    assert sparse_pairs(df.limit(0), "id", "v", 0.9).count() == 0
    with pytest.raises(ValueError, match="above 0"):
        sparse_pairs(df, "id", "v", 0.0)
    with pytest.raises(ValueError, match="dimension"):
        sparse_pairs(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])]), "id", "v", 0.5)


def greedy(pairs):
    out, left, right = [], set(), set()
    for s, i, j in sorted((-s, i, j) for (i, j), s in pairs.items()):
        if i not in left and j not in right:
            out.append((i, j, -s))
            left.add(i)
            right.add(j)
    return sorted(out)


def test_lists_against_brute_force(spark):
    left, right = sparse_rows(3, 80), sparse_rows(3, 60, first=5000)
    right += [(7000 + i, left[4][1]) for i in range(30)]  # a vector that many rows share
    want = {(i, j): s for i, a in left for j, b in right if (s := brute.score("cosine", a, b)) >= 0.4}
    found = cross_pairs(frame(spark, left), frame(spark, right), "id", "id", "v", "v", 0.4, listed=16)
    got = {(r["left_id"], r["right_id"]): r["score"] for r in found.collect()}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p], abs=1e-12) for p in want)
    taken = sorted(tuple(r)[:3] for r in one_to_one(found).collect())
    assert taken == greedy(got)
    assert one_to_one(found.limit(0)).count() == 0


def test_assignment_of_a_chain_and_a_hub(spark):
    chain = [(i, j, 1.0 - (2 * i + (j > i)) / 100) for i in range(6) for j in (i, i + 1)]
    hub = [(100 + i, 500, 0.5) for i in range(50)] + [(100, 501, 0.5)]
    df = spark.createDataFrame(chain + hub, "left_id long, right_id long, score double")
    got = sorted(tuple(r)[:3] for r in one_to_one(df).collect())
    assert got == greedy({(i, j): s for i, j, s in chain + hub})


def test_groups_after_adds_equal_one_match(spark, tmp_path):
    rows = sparse_rows(5, 120)
    path = tmp_path.as_uri()
    table = GroupedVectors.create(spark, path, 0.8)
    assert table.groups().count() == 0
    for part in (rows[80:], rows[:30], rows[30:31], rows[31:80]):  # later rows have lower ids
        assert GroupedVectors.open(spark, path).add(frame(spark, part), "id", "v") == len(part)
        # A cut-off add leaves files of the next batch that nobody reads.
        frame(spark, [(9, [1.0] * 40)]).withColumnRenamed("id", "_id").write.parquet(f"{path}/rows/batch={table.version + 1}")
    got = {r["_id"]: r["group_id"] for r in GroupedVectors.open(spark, path).groups().collect()}
    assert got == brute.groups(brute.pairs(rows, "cosine", 0.8)) and len(set(got.values())) > 5
    with pytest.raises(ValueError, match="already"):
        table.add(frame(spark, rows[:1]), "id", "v")
    with pytest.raises(ValueError, match="unique"):
        table.add(frame(spark, [(5000, rows[0][1]), (5000, rows[1][1])]), "id", "v")
    assert table.version == 4
    with pytest.raises(FileExistsError):
        GroupedVectors.create(spark, path, 0.8)


def test_groups_after_removals_equal_one_match(spark, tmp_path):
    rows = sparse_rows(11, 120)
    rows += [(2000 + i, rows[7][1]) for i in range(25)]  # copies, also across batches
    path = tmp_path.as_uri()
    table = GroupedVectors.create(spark, path, 0.8)
    held = {}

    def check():
        got = {r["_id"]: r["group_id"] for r in GroupedVectors.open(spark, path).groups().collect()}
        assert got == brute.groups(brute.pairs(list(held.items()), "cosine", 0.8))
        return got

    def add(part):
        assert GroupedVectors.open(spark, path).add(frame(spark, part), "id", "v") == len(part)
        held.update(part)

    def drop(ids):
        asked = spark.createDataFrame([(i,) for i in [*ids, *ids, 99999, None]], "id long")
        assert GroupedVectors.open(spark, path).remove(asked, "id") == len([held.pop(i) for i in ids])

    assert table.remove(frame(spark, rows), "id") == 0
    add(rows[60:])
    add(rows[:40])
    drop([0, 1, 2, 3, 7, 2000, 2003])  # lowest rows of groups, and one that stands for copies
    add([*rows[40:60], (3000, rows[7][1]), (3001, rows[50][1])])
    drop([i for i in sorted(held) if i % 3 == 0])
    assert len(set(check().values())) > 5
    with pytest.raises(ValueError, match="removed"):
        table.add(frame(spark, rows[:1]), "id", "v")


def test_copies_are_linked_without_their_pairs(spark, tmp_path):
    table = GroupedVectors.create(spark, tmp_path.as_uri(), 0.8)
    shared = spark.range(30_000).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    start = time.time()
    assert table.add(shared.where("id % 2 = 0"), "id", "v") == table.add(shared.where("id % 2 = 1"), "id", "v") == 15_000
    assert table.remove(shared.where("id < 100"), "id") == 100
    assert table.groups().agg(F.count("*"), F.min("group_id"), F.max("group_id")).first()[:] == (29_900, 1, 1)
    assert time.time() - start < 60


@pytest.mark.parametrize("metric", ["euclidean"])
def test_graph_finds_near_rows(spark, metric):
    dice = np.random.default_rng(7)
    centres = dice.normal(size=(25, 16)) * 3
    rows = [(i, (centres[i % 25] + dice.normal(size=16)).tolist()) for i in range(1500)]
    df = frame(spark, rows)
    matrix = np.array([v for _, v in rows])
    if metric == "cosine":
        matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
        far = -(matrix @ matrix.T)
    else:
        far = ((matrix[:, None, :] - matrix[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(far, np.inf)
    want = np.argsort(far, axis=1)[:, :5]
    graph = neighbour_graph(df, "id", "v", metric, links=16, group=64)
    got = graph.neighbours(5).collect()
    assert sum(r["id"] in want[r["query_id"]] for r in got) >= 0.95 * want.size
    for r in got[:50]:
        assert r["score"] == pytest.approx(brute.score(metric, rows[r["query_id"]][1], rows[r["id"]][1]), abs=1e-9)
    found, scored = beam_search(graph, df.where("id % 50 = 0"), "id", "v", 6)
    hits = sum(r["id"] in want[r["query_id"]] for r in found.collect())
    assert hits >= 0.95 * want[::50].size and scored < 0.7 * 30 * 1500


def test_graph_of_few_rows(spark):
    df = frame(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None)])
    assert [(r["query_id"], r["id"], r["rank"]) for r in neighbour_graph(df, "id", "v").neighbours(3).orderBy("query_id").collect()] == [(1, 2, 1), (2, 1, 1)]
    assert neighbour_graph(df.limit(0), "id", "v").neighbours(3).count() == 0


def test_repeated_keys_of_a_shared_vector(spark):
    rows = spark.range(30_000).select(
        "id",
        F.concat(F.lit("k"), (F.col("id") % 50).cast("string")).alias("key"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.cos(F.col("id") * 0.7), F.sin(F.col("id") * 0.7))).alias("v"),
    )
    shared = rows.where("id % 3 = 0")
    start = time.time()
    found = match(shared, "id", "v", key="key", threshold=0.99).relation(ordered=False).collect()
    assert time.time() - start < 60
    # Every two keys share the vector, and every key shares it with itself.
    assert len(found) == 50 * 51 // 2
    assert {r["group_id"] for r in found} == {1}


def test_encoder_portions_are_bounded():
    texts = ["a" * 600_000, "b" * 600_000, "c" * 3_000_000, "", "d"]
    assert list(encoder_portions(texts, 16)) == [(0, 1), (1, 2), (2, 3), (3, 5)]
    assert list(encoder_portions([], 16)) == []
    assert list(encoder_portions(["x"] * 5, 1 << 19)) == [(0, 2), (2, 4), (4, 5)]
    texts = [f"word{i} text" for i in range(50)]
    encoder = hashing(8).factory()
    parts = np.concatenate([encoder.encode(texts[a:b]) for a, b in encoder_portions(texts, 1 << 17)])
    assert (parts == encoder.encode(texts)).all()
