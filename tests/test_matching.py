import random

import numpy as np
import pytest
from brute import groups as brute_groups
from brute import pairs as brute_pairs
from test_neighbours import clustered

from affinis.functions.blocks import joined_labels
from affinis.operators.components import components
from affinis.operators.lookup import attach, hot_shares
from affinis.operators.matching import annotated, annotation_summary, first_per_key, match
from affinis.operators.numbering import numbered
from affinis.operators.encode import embed_columns, hashing
from affinis.operators.pairs import near_pairs, similar_pairs
from affinis.operators.topk import neighbours
from affinis.workspace import written


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "_a long, _b long")


def grouped(df):
    return {r["node"]: r["root"] for r in df.collect()}


@pytest.mark.parametrize(
    ("pairs", "want"),
    [
        ([], {}),
        ([(1, 2)], {1: 1, 2: 1}),
        ([(1, 2), (3, 4)], {1: 1, 2: 1, 3: 3, 4: 3}),
        ([(1, 2), (2, 3)], {1: 1, 2: 1, 3: 1}),
        ([(2, 1), (2, 3), (4, 5), (5, 4)], {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}),
    ],
)
def test_components(spark, pairs, want):
    assert grouped(components(edges(spark, pairs))) == want


def test_long_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(100, 220)]
    hub = [(50, 1000 + i) for i in range(200)] + [(7, 1100)]
    random.Random(2).shuffle(chain)
    # a low limit sends the hub through the broadcast path
    got = grouped(components(edges(spark, chain + hub), hot_rows=20))
    assert {got[i] for i in range(100, 221)} == {100}
    assert {got[i] for i in [50, 7, *range(1000, 1200)]} == {7}


def test_labels_within_a_task():
    rng = np.random.default_rng(4)
    i, j = rng.integers(0, 300, 250), rng.integers(0, 300, 250)
    labels = np.arange(300)
    for at in range(0, 250, 60):
        labels = joined_labels(labels, i[at : at + 60], j[at : at + 60])
    want = brute_groups(list(zip(i.tolist(), j.tolist(), strict=True)))
    lowest = {}
    for node, group in want.items():
        lowest[group] = min(node, lowest.get(group, node))
    assert all(labels[n] == lowest[g] for n, g in want.items())


@pytest.mark.parametrize("listed", [True, False])
@pytest.mark.parametrize("block", [None, 16])
def test_match_equals_brute_force(spark, listed, block):
    rows = clustered(rows=120)
    df = spark.createDataFrame(rows, "id long, v array<float>")
    want = brute_pairs(rows, "cosine", 0.9)
    group = brute_groups(want)
    found = match(df, "id", "v", threshold=0.9, decimals=4, list_pairs=listed, rows_per_block=block)
    facts = {r["_id"]: r for r in found.rows().collect()}
    assert {i: r["group_id"] for i, r in facts.items()} == group
    for i, r in facts.items():
        mine = [s for p, s in want.items() if i in p]
        assert r["match_count"] == len(mine)
        assert r["best_score"] == pytest.approx(max(mine), abs=1e-4)
    total = found.summary().first()
    assert (total["total_pairs"], total["dedup_groups"]) == (len(want), max(group.values()))
    got = {(int(r.query_key), int(r.match_key)): r for r in found.relation().collect()}
    assert got.keys() == want.keys()
    assert all(r.group_id == group[p[0]] for p, r in got.items())


def test_relation_is_ordered(spark):
    rows = clustered(rows=60)
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = [(r.group_id, -r.similarity) for r in match(df, "id", "v", threshold=0.9).relation().collect()]
    assert got == sorted(got)


def test_stored_rows(spark, stored_rows):
    found = match(stored_rows, "n", "embedding", "ID", threshold=0.80)
    assert found.relation().columns == ["query_key", "match_key", "similarity", "group_id"]
    rows = found.relation().collect()
    assert {(r.query_key, r.match_key, r.similarity) for r in rows} == {
        ("1", "2", 1.0), ("1", "3", 0.84), ("2", "3", 0.85),
    }
    assert {r.group_id for r in rows} == {1}
    assert match(stored_rows, "n", "embedding", "ID", threshold=0.99999).relation().count() == 0


def test_threshold_tests_the_unrounded_score(spark):
    angle = np.arccos(0.8951)
    rows = [(1, [1.0, 0.0]), (2, [float(np.cos(angle)), float(np.sin(angle))])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert match(df, "id", "v", threshold=0.90, decimals=2).relation().count() == 0
    assert match(df, "id", "v", threshold=0.8951, decimals=2).relation().first().similarity == 0.9


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 0.0])]])
def test_fewer_than_two_rows(spark, rows):
    df = spark.createDataFrame(rows, "id long, v array<double>")
    found = match(df, "id", "v")
    assert found.relation().count() == 0
    assert found.relation().columns == ["query_key", "match_key", "similarity", "group_id"]


def expected_annotation(rows, threshold, decimals):
    """The published rules, one row at a time."""
    hits = brute_pairs(rows, "cosine", threshold)
    group = brute_groups(hits)
    records = sorted(
        ((group[i], -round(s, decimals), i, j) for (i, j), s in hits.items()), key=lambda r: r
    )
    out = {}
    for i, _ in rows:
        related = [(j, -w) for g, w, a, j in records if a == i]
        related += [(a, -w) for g, w, a, j in records if j == i]
        best, top = None, -1.0
        for other, s in related:
            if s > top:
                best, top = other, s
        out[i] = ([str(o) for o, _ in related], best, top if related else None, group.get(i, 0))
    return out


@pytest.mark.parametrize("block", [None, 16])
def test_annotate(spark, block):
    rows = clustered(rows=90)
    df = spark.createDataFrame(rows, "id long, v array<float>")
    found = match(df, "id", "v", threshold=0.9, decimals=2, rows_per_block=block)
    got = {r["id"]: r for r in annotated(df.select("id"), "id", found).collect()}
    want = expected_annotation(rows, 0.9, 2)
    assert got.keys() == want.keys()
    for i, (ids, best, top, group) in want.items():
        r = got[i]
        assert r["_match_ids"] == ids
        assert r["_match_count"] == len(ids)
        assert r["_best_match_id"] == (None if best is None else str(best))
        assert r["_best_match_score"] == pytest.approx(top) if ids else r["_best_match_score"] is None
        assert r["_group_id"] == group


def test_annotate_keeps_rows_and_summary(spark, stored_rows):
    found = match(stored_rows.where("n < 3"), "n", "embedding", "ID", threshold=0.80)
    table = stored_rows.select("ID", "Name")
    out = annotated(table, "ID", found, as_text=True)
    rows = {r.ID: r for r in out.collect()}
    assert len(rows) == 3
    assert (rows["1"]["_match_ids"], rows["3"]["_match_ids"]) == ("2", "")
    assert (rows["3"]["_match_count"], rows["3"]["_group_id"]) == (0, 0)
    assert rows["3"]["_best_match_id"] is None
    facts = annotation_summary(out).first()
    assert (facts["matched_rows"], facts["dedup_groups"]) == (2, 1)


def test_score_of_minus_one_names_no_best_match(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "id long, v array<double>")
    row = annotated(df.select("id"), "id", match(df, "id", "v", threshold=-1.0)).first()
    assert (row["_match_count"], row["_best_match_id"], row["_best_match_score"]) == (1, None, -1.0)


def test_hot_keys_are_split(spark):
    big = spark.createDataFrame([("x", i) for i in range(60)] + [(f"k{i}", i) for i in range(40)], "k string, i long")
    lookup = spark.createDataFrame([("x", 1.0)] + [(f"k{i}", 2.0) for i in range(30)], "k string, w double")
    assert [tuple(r) for r in hot_shares(big, "k", hot_rows=20).collect()] == [("x", 3)]
    assert hot_shares(big, "k") is None
    plain = sorted(map(tuple, big.join(lookup, "k", "left").collect()), key=str)
    split = attach(big, lookup, ["k"], hot_rows=20)
    assert sorted(map(tuple, split.select("k", "i", "w").collect()), key=str) == plain


def test_matches_between_repeated_keys(spark):
    rows = [(1, "A", [1.0, 0.0]), (2, "A", [1.0, 0.01]), (3, "B", [1.0, 0.02]), (4, "C", [0.0, 1.0]), (5, "D", [0.01, 1.0]), (6, "B", [0.5, 0.6])]
    df = spark.createDataFrame(rows, "id long, k string, v array<double>")
    found = match(df, "id", "v", "k", threshold=0.99, decimals=4)
    got = [(r.query_key, r.match_key, r.group_id) for r in found.relation().collect()]
    assert sorted(got) == [("A", "A", 1), ("A", "B", 1), ("C", "D", 2)]
    total = found.summary().first()
    assert (total["total_pairs"], total["dedup_groups"]) == (3, 2)
    for lists in (True, False):
        out = annotated(df.select("id", "k"), "k", found, lists=lists).collect()
        assert len(out) == 6
        assert {r["k"]: (r["_match_count"], r["_group_id"]) for r in out} == {"A": (3, 1), "B": (1, 1), "C": (1, 2), "D": (1, 2)}


def test_scores_are_not_rounded_before_they_decide(spark):
    tiny = [(1, [1e-6, 0.0]), (2, [0.0, 1e-6]), (3, [9e-6, 0.0])]
    df = spark.createDataFrame(tiny, "id long, v array<double>")
    best = {r.query_key: r.neighbor_key for r in neighbours(df, "id", "v", metric="dot", top_k=1, decimals=15).collect()}
    assert best["1"] == "3"
    angle = np.arccos(0.8999999996)
    close = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float(np.cos(angle)), float(np.sin(angle))])], "id long, v array<double>")
    assert match(close, "id", "v", threshold=0.9).relation().count() == 0
    assert match(close, "id", "v", threshold=0.8999999995).relation().count() == 1


@pytest.mark.parametrize("metric", ["euclidean", "dot", "cosine", "manhattan"])
def test_scores_do_not_depend_on_blocks(spark, metric):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=16) * 1e6).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    far = {"euclidean": 1e9, "manhattan": 1e9, "dot": -1e15, "cosine": -1.0}[metric]
    near = {"euclidean": 4.5e6, "manhattan": 1.4e7, "dot": 1e13, "cosine": 0.4}[metric]
    runs = [{(r.id_a, r.id_b): r.score for r in similar_pairs(df, "id", "v", metric, bound, rows_per_block=size).collect()}
            for bound, size in ((far, 90), (far, 20), (near, 30))]
    assert runs[0] == runs[1]
    assert len(runs[2]) > 0 and all(runs[0][p] == s for p, s in runs[2].items())
    assert runs[0] == brute_pairs(rows, metric, far)


def test_bounds_keep_most_visits_away(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    vectors = written(embed_columns(docs, ["text"], hashing(64)).select("doc_id", "_emb_text"), "vectors")
    near = near_pairs(vectors, "doc_id", "_emb_text", None, "cosine", 0.95, rows_per_block=50)
    visits = near.met.where("_visits").count()
    blocks, rows = near.met.select("_block").distinct().count(), near.distinct.count()
    # Of every two blocks one visits the other, so half of rows * (blocks - 1) is the most.
    assert blocks > 10 and visits < 0.45 * rows * (blocks - 1) / 2


def test_components_that_are_not_numbers_are_an_error(spark):
    for bad in (float("nan"), None, float("inf")):
        df = spark.createDataFrame([(7, [1.0, bad]), (8, [1.0, 2.0])], "id long, v array<double>")
        with pytest.raises(Exception, match="row 7"):
            neighbours(df, "id", "v").collect()


def test_first_per_key(spark):
    odd = spark.createDataFrame([("a", None, "none"), ("a", 1, "first"), ("b", None, "only")], "k string, o long, t string")
    assert {r.k: r.t for r in first_per_key(odd, "k", "o").collect()} == {"a": "first", "b": "only"}
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 3, "only")], "k string, o long, t string")
    assert {r.k: r.t for r in first_per_key(df, "k", "o").collect()} == {"a": "early", "b": "only"}


def test_numbering(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 as part").repartition(5)
    got = numbered(df, ["part", "id"]).orderBy("_row_id").collect()
    assert [r["_row_id"] for r in got] == list(range(1, 1001))
    assert [(r["part"], r["id"]) for r in got] == sorted((i % 7, i) for i in range(1000))


def test_dedup_lists_names_classes_and_no_pairs(spark, tmp_path):
    from __spark_entry__ import queries

    texts = ["one two three"] * 4 + ["four five six"] * 2 + ["seven eight nine ten"]
    rows = [(10 - i, t, "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries()["j_dedup_lists"](spark, str(tmp_path))
    assert "_match_ids" not in found.columns
    got = {r.doc_id: (r._match_count, r._class_id, r._class_rows) for r in found.collect()}
    assert got == {10: (3, 7, 4), 9: (3, 7, 4), 8: (3, 7, 4), 7: (3, 7, 4), 6: (1, 5, 2), 5: (1, 5, 2), 4: (0, 4, 1)}
