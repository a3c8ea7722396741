import math

import pytest
from brute import pairs as brute_pairs
from pyspark.sql import functions as F
from test_neighbours import METRICS, clustered

from affinis.functions import vectors as V
from affinis.operators.compare import compared
from affinis.operators.pairs import similar_pairs


def one(spark, a, b, column):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    return df.select(column("a", "b")).first()[0]


@pytest.mark.parametrize(
    ("column", "a", "b", "want"),
    [
        (V.cosine, [1.0, 0.0, 0.0], [1.0, 0.0, 0.0], 1.0),
        (V.cosine, [1.0, 0.0], [0.0, 1.0], 0.0),
        (V.cosine, [1.0, 0.0, 0.0], [-1.0, 0.0, 0.0], -1.0),
        (V.cosine, [1.0, 2.0, 3.0], [4.0, 5.0, 6.0], 32 / (math.sqrt(14) * math.sqrt(77))),
        (V.euclidean, [0.0, 0.0], [3.0, 4.0], 5.0),
        (V.manhattan, [1.0, 2.0], [4.0, 6.0], 7.0),
        (V.dot, [2.0, 3.0], [4.0, 5.0], 23.0),
        (V.cosine_or_zero, [0.0, 0.0], [1.0, 0.0], 0.0),
    ],
)
def test_metric(spark, column, a, b, want):
    assert one(spark, a, b, column) == pytest.approx(want, abs=1e-12)


def test_metric_errors(spark):
    with pytest.raises(Exception, match="no cosine"):
        one(spark, [0.0, 0.0], [1.0, 0.0], V.cosine)
    with pytest.raises(Exception, match="dimension"):
        one(spark, [1.0], [1.0, 2.0], V.dot)
    with pytest.raises(ValueError, match="No metric is called 'hamming'"):
        V.find_metric("hamming")


def test_registry_order():
    assert {m: V.METRICS[m].ascending for m in METRICS} == {
        "cosine": False, "euclidean": True, "manhattan": True, "dot": False,
    }


def test_normalised(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = [list(r[0]) for r in df.select(V.normalised("v")).collect()]
    assert got == [pytest.approx([0.6, 0.8]), [0.0, 0.0]]


def test_json_round_trip(spark):
    df = spark.createDataFrame([([0.1, -2.5, 3.0],)], "v array<float>")
    back = df.select(V.vector_from_json(V.vector_to_json("v")).alias("w"), "v").first()
    assert back["w"] == back["v"]


def test_rounding_of_ties(spark):
    assert spark.range(1).select(F.round(F.lit(2.675), 2)).first()[0] == 2.68


BOUNDS = {"cosine": 0.8, "euclidean": 0.6, "manhattan": 1.2, "dot": 6.0}


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("block", [None, 16])
def test_pairs_equal_brute_force(spark, metric, block):
    rows = clustered(rows=120)
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = {
        (r.id_a, r.id_b): r.score
        for r in similar_pairs(df, "id", "v", metric, BOUNDS[metric], rows_per_block=block).collect()
    }
    want = brute_pairs(rows, metric, BOUNDS[metric])
    assert len(want) > 500
    assert got.keys() == want.keys()
    assert all(got[p] == pytest.approx(want[p], abs=2e-9) for p in want)


@pytest.mark.parametrize("metric", METRICS)
def test_block_scores_equal_column_scores(spark, vectors, metric):
    chosen = V.find_metric(metric)
    everything = -1e9 if not chosen.ascending else 1e9
    got = {(r.id_a, r.id_b): r.score for r in similar_pairs(vectors, "id", "v", metric, everything).collect()}
    a = vectors.select(F.col("id").alias("i"), F.col("v").alias("a"))
    b = vectors.select(F.col("id").alias("j"), F.col("v").alias("b"))
    want = a.join(b, F.col("i") < F.col("j")).select("i", "j", chosen.pair("a", "b").alias("s")).collect()
    assert len(got) == 10
    assert got == {(r.i, r.j): pytest.approx(r.s, abs=1e-9) for r in want}


def test_compare(spark, vectors):
    more = vectors.union(spark.createDataFrame([(9, "Beta", [9.0, 9.0, 9.0, 9.0])], vectors.schema))
    asked = spark.createDataFrame([("Alpha", "Beta"), ("Alpha", "Epsilon")], "key_a string, key_b string")
    rows = {r.key_b: r for r in compared(more, "name", "v", asked, "id").collect()}
    beta = rows["Beta"]
    # the first row of a key counts
    assert (beta.cosine, beta.euclidean, beta.manhattan, beta.dot) == (0.0, 1.41, 2.0, 0.0)
    assert rows["Epsilon"].cosine == 0.5
    unknown = spark.createDataFrame([("Alpha", "Nobody")], "key_a string, key_b string")
    with pytest.raises(Exception, match="Key not found: Nobody"):
        compared(vectors, "name", "v", unknown, "id").collect()
