import pytest
from pyspark.sql import functions as F

from affinis.functions.text import formula_safe_table, joined_text, model_for, routed_model
from affinis.functions.vectors import mean_vector, weighted_vector
from affinis.operators.keys import composite_key, weighted_columns, with_composite_key
from affinis.operators.profile import embed_candidates, key_audit, likely_key, profile, repeated_keys
from affinis.settings import MODELS, find_model, same_dimension


def texts(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_joined_text(spark):
    df = spark.createDataFrame([("hello", None), ("world", "test")], "a string, b string")
    assert texts(df, joined_text(["a", "b"])) == ["hello ", "world test"]
    assert texts(df, joined_text(["a", "b"], "-")) == ["hello-", "world-test"]
    numbers = spark.createDataFrame([(1, 2.5)], "a int, b double")
    assert texts(numbers, joined_text(["a", "b"])) == ["1 2.5"]
    three = spark.createDataFrame([("x", "y", "z")], "a string, b string, c string")
    assert texts(three, joined_text(["a", "b", "c"])) == ["x y z"]


def test_weights():
    assert weighted_columns(["Name:2.0", "City:1"]) == {"Name": 2.0, "City": 1.0}
    assert weighted_columns(["Name", "City"]) == {"Name": 1.0, "City": 1.0}
    assert weighted_columns(["a:b:3"]) == {"a:b": 3.0}
    with pytest.raises(ValueError, match="abc"):
        weighted_columns(["Name:abc"])
    with pytest.raises(ValueError, match="Name"):
        weighted_columns(["Name:-1.0"])


def test_mean_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "a array<float>, b array<float>")
    assert texts(df, mean_vector(["a", "b"])) == [[0.5, 0.5]]
    df = spark.createDataFrame([([2.0, 0.0], [0.0, 2.0])], "a array<float>, b array<float>")
    assert texts(df, weighted_vector(["a", "b"], [3.0, 1.0])) == [[1.5, 0.5]]
    with pytest.raises(ValueError):
        mean_vector([])
    with pytest.raises(ValueError, match="zero"):
        weighted_vector(["a", "b"], [0.0, 0.0])
    ragged = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    with pytest.raises(Exception, match="dimension"):
        ragged.select(mean_vector(["a", "b"])).collect()


def test_composite_key(spark):
    df = spark.createDataFrame(
        [("x", "y", [2.0, 0.0], [0.0, 2.0])],
        "a string, b string, _emb_a array<float>, _emb_b array<float>",
    )
    assert with_composite_key(df, ["a", "b"]).first()["_composite_key"] == "x y"
    vector = with_composite_key(df, ["a:3", "b:1"], "weighted-average").first()
    assert vector["_emb__composite_key"] == [1.5, 0.5]
    assert vector["_composite_key"] == "x y"
    assert with_composite_key(df, ["a", "b"], "average").first()["_emb__composite_key"] == [1.0, 1.0]
    with pytest.raises(ValueError, match="Unknown strategy"):
        composite_key(df, ["a"], "sum")
    with pytest.raises(ValueError, match="Embedding column not found"):
        composite_key(df, ["a", "c"], "average")


def test_formula_guard(spark):
    cells = ["=1+1", "+x", "-x", "@x", "\tx", "\rx", "plain", "", None, "a=b"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, `=head` string")
    out = formula_safe_table(df)
    assert out.columns == ["i", "=head"]
    got = [r[1] for r in out.orderBy("i").collect()]
    assert got == ["'=1+1", "'+x", "'-x", "'@x", "'\tx", "'\rx", "plain", "", None, "a=b"]


ROUTES = {
    "Customer Address": "address", "street_name": "address", "City": "address", "ZIP": "address",
    "Country": "address", "Region": "address", "Capacity": "address", "Company": "entity",
    "Vendor Name": "entity", "client": "entity", "Organization": "entity", "Name": "mini",
    "Description": "mini", "Title": "mini",
}


def test_routing(spark):
    df = spark.createDataFrame([(n,) for n in ROUTES], "name string")
    got = {r[0]: r[1] for r in df.select("name", routed_model(F.col("name"))).collect()}
    assert got == ROUTES
    assert {n: model_for(n) for n in ROUTES} == ROUTES


def test_models():
    assert find_model("mini").dim == 384
    assert find_model("BAAI/bge-large-en-v1.5").shortcut == "bge-large"
    assert len(MODELS) == 7
    with pytest.raises(ValueError, match="address, bge-large"):
        find_model("none")
    with pytest.raises(ValueError, match="dimension"):
        same_dimension(["mini", "address"])
    with pytest.raises(AttributeError):
        find_model("mini").dim = 3


def facts(spark, rows, schema, order="o"):
    return {r["name"]: r for r in profile(spark.createDataFrame(rows, schema), order).collect()}


def test_profile_classes(spark):
    colours = ["red", "blue", "red", "green", "blue", "red", "red", "blue"]
    rows = [
        (i, i * 1.5, c, f"a rather long sentence number {i}", None, i % 2 == 0, f"k{i}")
        for i, c in enumerate(colours)
    ]
    got = facts(
        spark, rows, "o long, x double, colour string, note string, nothing string, flag boolean, k string"
    )
    assert {n: r["dtype"] for n, r in got.items()} == {
        "o": "numeric", "x": "numeric", "colour": "category", "note": "text", "nothing": "mixed",
        "flag": "numeric", "k": "text",
    }
    assert got["colour"]["unique_count"] == 3
    assert got["nothing"]["null_count"] == 8
    assert [r["index"] for r in sorted(got.values(), key=lambda r: r["index"])] == list(range(1, 8))
    assert got["k"]["is_likely_key"] and not got["colour"]["is_likely_key"]


def test_profile_missing_values(spark):
    rows = [(1, 1.0, "a"), (2, float("nan"), "b"), (None, None, "b"), (4, -0.0, None), (5, 0.0, "x" * 40)]
    got = facts(spark, rows, "id long, x double, s string", "id")
    assert (got["id"]["null_count"], got["id"]["is_likely_key"]) == (1, False)
    # NaN is missing, and the two zeros are one value
    assert (got["x"]["null_count"], got["x"]["unique_count"]) == (2, 2)
    assert (got["s"]["unique_count"], got["s"]["total_count"]) == (3, 5)


def test_profile_looks_at_the_first_hundred(spark):
    rows = [(i, "short" if i < 100 else "a very long text beyond the sample " + str(i)) for i in range(150)]
    assert facts(spark, rows, "o long, s string")["s"]["dtype"] == "category"


def test_profile_of_an_empty_table(spark):
    got = facts(spark, [], "o long, s string")
    assert (got["s"]["total_count"], got["s"]["dtype"]) == (0, "mixed")


def test_selection_helpers(spark):
    rows = [(1, "Ann", 3.5, "1 Main Street"), (2, "Bob", 2.5, "2 High Road"), (3, "Ann", 1.5, "9 Low Lane")]
    df = spark.createDataFrame(rows, "ID long, Name string, Score double, Address string")
    seen = profile(df, "ID")
    assert likely_key(seen) == "ID"
    assert embed_candidates(seen) == ["Name", "Address"]
    audit = key_audit(df, "Name").first()
    assert (audit["total_count"], audit["unique_count"], audit["is_unique"]) == (3, 2, False)
    assert [(r["Name"], r["rows"]) for r in repeated_keys(df, "Name").collect()] == [("Ann", 2)]
