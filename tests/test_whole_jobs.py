"""Queries whose results take in every row of their tables."""

import numpy as np
import pytest
from brute import score, top_k

import __spark_entry__ as entry
from __spark_entry__ import PAIR_BOUNDS, queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Vectors around a few centres, and texts of few words; only two ids are divisible by 50."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 64))
    near = centres[np.arange(110) % 6] + rng.normal(size=(110, 64))
    unit = (near / np.linalg.norm(near, axis=1, keepdims=True)).astype(np.float32)
    vectors = [(i + 1, v.tolist()) for i, v in enumerate(unit)]
    rows = [(i, v, i % 3) for i, v in vectors]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    words = [str(w) for w in rng.integers(0, 40, 660)]
    docs = [(i + 1, " ".join(words[6 * i : 6 * i + 6]) if i % 10 else "one two three", "en") for i in range(110)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    return folder, vectors, docs


def run(spark, tables, name):
    return queries()[name](spark, tables[0]).collect()


def test_every_document_is_searched(spark, tables):
    found = run(spark, tables, "d_topk_docs")
    assert sorted((int(r.query_key), r["rank"]) for r in found) == [(i, n) for i in range(1, 111) for n in range(1, 6)]


def pairs_are_whole(spark, tables, metric):
    bound = PAIR_BOUNDS[metric]
    within = (lambda s: s <= bound) if metric == "manhattan" else (lambda s: s >= bound)
    v = tables[1]
    want = {(i, j): s for k, (i, a) in enumerate(v) for j, b in v[k + 1 :] if within(s := score(metric, a, b))}
    got = {(r.id_a, r.id_b): r.score for r in run(spark, tables, f"f_pairs_{metric}")}
    assert len(want) > 200 and got.keys() == want.keys()
    assert all(s == pytest.approx(want[p], abs=1e-4) for p, s in got.items())


def test_cosine_pairs_are_listed(spark, tables):
    pairs_are_whole(spark, tables, "cosine")


def test_manhattan_pairs_are_listed(spark, tables):
    pairs_are_whole(spark, tables, "manhattan")


def test_dot_pairs_are_listed(spark, tables):
    pairs_are_whole(spark, tables, "dot")


def test_score_stats_take_in_all_rows(spark, tables):
    (got,) = run(spark, tables, "g_score_stats")
    scores = [round(s, 4) for found in top_k(tables[1], "cosine", 5).values() for _, s in found]
    assert len(scores) == 550
    assert (got["mean"], got["min"], got["max"]) == pytest.approx((np.mean(scores), min(scores), max(scores)), abs=1e-5)


def searches_are_whole(spark, tables, metric):
    got = run(spark, tables, f"g_topk_{metric}")
    want = top_k(tables[1], metric, 5)
    assert {(r.query_key, r["rank"], r.neighbor_key) for r in got} == {
        (str(i), n, str(j)) for i, found in want.items() for n, (j, _) in enumerate(found, 1)}


def test_cosine_searches_ask_for_all_rows(spark, tables):
    searches_are_whole(spark, tables, "cosine")


def test_euclidean_searches_ask_for_all_rows(spark, tables):
    searches_are_whole(spark, tables, "euclidean")


def test_manhattan_searches_ask_for_all_rows(spark, tables):
    searches_are_whole(spark, tables, "manhattan")


def test_dot_searches_ask_for_all_rows(spark, tables):
    searches_are_whole(spark, tables, "dot")


def test_searches_above_a_threshold_ask_for_all_rows(spark, tables):
    got = {(r.query_key, r.neighbor_key) for r in run(spark, tables, "g_topk_threshold")}
    want = top_k(tables[1], "cosine", 5)
    assert got == {(str(i), str(j)) for i, found in want.items() for j, s in found if round(s, 4) >= 0.4} and got


def test_dedup_lists_name_every_match(spark, tables):
    got = {r.doc_id: r for r in run(spark, tables, "j_dedup_lists")}
    alike = {}
    for i, text, _ in tables[2]:
        alike.setdefault(text, []).append(i)
    assert len(got) == 110 and max(map(len, alike.values())) == 11
    for i, text, _ in tables[2]:
        listed = {int(k) for k in got[i]["_match_ids"].split(", ") if k}
        assert listed >= set(alike[text]) - {i} and len(listed) == got[i]["_match_count"]


def test_graph_recall_walks_from_every_row(spark, tables, monkeypatch):
    asked, search = [], entry.beam_search

    def counted(graph, rows, *args, **options):
        asked.append(rows.count())
        return search(graph, rows, *args, **options)

    monkeypatch.setattr(entry, "beam_search", counted)
    assert run(spark, tables, "i_graph_recall") == [(550, True, True)]
    assert asked == [110]
