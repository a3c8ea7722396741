import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.operators.encode import (
    EncoderSpec,
    HashingEncoder,
    column_models,
    embed_and_combine,
    embed_columns,
    hashing,
)
from affinis.plans.jobs import (
    composed,
    dedup_table,
    embedded_neighbours,
    nearest_rows,
    preset_matches,
    selection,
)
from affinis.plans.presets import PRESETS, find_preset
from affinis.sources import tables as S
from affinis.sources.vector_table import VectorTable
from affinis.operators.topk import nearest, scanned
from affinis.streaming.ingest import add_stream
from affinis.workspace import exists, few_rows, scratch_path, written


@pytest.fixture
def people(spark):
    rows = [(1, "Ann", "=cmd"), (2, "Bob", "fine"), (3, "Cy", "-x")]
    return spark.createDataFrame(rows, "id long, name string, note string")


@pytest.mark.parametrize("fmt", S.FORMATS)
def test_write_and_read(spark, people, tmp_path, fmt):
    path = str(tmp_path / f"out.{fmt}")
    meta = S.run_metadata(spark, "embed", {"columns": ["a", "b"], "model": "+m"}, people)
    S.write_table(people, path, metadata=meta)
    back = {r["id"]: r["note"] for r in S.read_table(spark, path).collect()}
    assert back == {1: "'=cmd", 2: "fine", 3: "'-x"}
    facts = {r["Parameter"]: r["Value"] for r in S.read_table(spark, S.metadata_path(path), fmt).collect()}
    assert (facts["columns"], facts["model"], str(facts["input_rows"])) == ("a, b", "'+m", "3")
    with pytest.raises(FileExistsError):
        S.write_table(people, path)
    S.write_table(people.limit(1), path, overwrite=True)
    assert S.read_table(spark, path).count() == 1


def test_read_errors(spark, people, tmp_path):
    with pytest.raises(FileNotFoundError):
        S.read_table(spark, str(tmp_path / "none.parquet"))
    with pytest.raises(ValueError, match="Unsupported"):
        S.read_table(spark, str(tmp_path / "table.xls"))
    people.where("id > 9").write.parquet(str(tmp_path / "empty.parquet"))
    with pytest.raises(ValueError, match="no data rows"):
        S.read_table(spark, str(tmp_path / "empty.parquet"))


def test_column_contract(people):
    assert S.require_columns(people, []) == []
    assert S.require_columns(people, ["id"]) == ["id"]
    with pytest.raises(ValueError, match=r"lacks 'nane' .there is name.*It has"):
        S.require_columns(people, ["nane"])


def test_vector_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, 1.0], "x")], "id long, _emb_Name array<float>, _emb_note string")
    assert S.vector_columns(df) == ["_emb_Name"]
    assert S.vector_column(df, "Name") == "_emb_Name"
    with pytest.raises(ValueError, match="Embedding column '_emb_Other' not found"):
        S.vector_column(df, "Other")
    assert S.without_vectors(df).columns == ["id"]
    S.write_table(df, str(tmp_path / "v.csv"), keep_vectors=True)
    assert json.loads(S.read_table(spark, str(tmp_path / "v.csv")).first()["_emb_Name"]) == [0.5, 1.0]


def test_inventory(spark, people, tmp_path):
    people.write.parquet(str(tmp_path / "a.parquet"))
    (tmp_path / "b.parquet").write_text("not parquet")
    (tmp_path / "~c.parquet").write_text("lock file")
    (tmp_path / "d.txt").write_text("other")
    found = S.inventory(spark, S.input_tables(spark, str(tmp_path))).collect()
    assert [(r["path"].rsplit("/", 1)[-1], r["rows"], r["columns"]) for r in found] == [
        ("a.parquet", 3, 3), ("b.parquet", 0, 0),
    ]


def test_hashing_encoder():
    model = HashingEncoder(8)
    a, b, c = model.encode(["red green", "GREEN  red", ""])
    assert (a == b).all()
    assert np.linalg.norm(a) == pytest.approx(1.0)
    assert not c.any()
    assert HashingEncoder(16, ngram=3).encode(["abc"]).any()


def lengths(dim=2):
    """A stand-in for a model, sent to the workers by value: the text length, twice."""

    class Lengths:
        def encode(self, texts):
            return np.array([[len(t), len(t)] for t in texts], dtype=np.float32)

    return EncoderSpec(Lengths, dim, "lengths")


def test_embed_columns(spark):
    df = spark.createDataFrame([("ab", None), ("abc", "x")], "a string, b string")
    out = embed_columns(df, ["a", "b"], lengths())
    assert sorted((r["_emb_a"][0], r["_emb_b"][0]) for r in out.collect()) == [(2.0, 0.0), (3.0, 1.0)]
    assert dict(out.dtypes)["_emb_a"] == "array<float>"
    # what is there is kept, unless forced
    assert embed_columns(out, ["a"], hashing(4)).columns == out.columns
    assert len(embed_columns(out, ["a"], hashing(4)).first()["_emb_a"]) == 2
    assert len(embed_columns(out, ["a"], hashing(4), force=True).first()["_emb_a"]) == 4
    with pytest.raises(ValueError, match="Missing"):
        embed_columns(df, ["z"], lengths())
    with pytest.raises(Exception, match="expected"):
        embed_columns(df, ["a"], lengths(3)).collect()


def test_models_per_column(spark):
    assert column_models(["Company Name", "Notes"]) == {"Company Name": "entity", "Notes": "mini"}
    with pytest.raises(ValueError, match="dimension"):
        column_models(["Company Name", "Address"])
    assert set(column_models(["Company Name", "Address"], "mini").values()) == {"mini"}
    routed = {"entity": lengths(), "mini": hashing(2)}.__getitem__
    two = spark.createDataFrame([("aa", "")], "Company string, Notes string")
    assert embed_and_combine(two, ["Company", "Notes"], "v", routed).first()["v"] == [1.0, 1.0]
    df = spark.createDataFrame([("aa", "b")], "x string, y string")
    assert embed_and_combine(df, ["x", "y"], "v", lengths()).first()["v"] == [1.5, 1.5]


@pytest.fixture
def store(spark, stored_rows, tmp_path):
    table = VectorTable.create(spark, str(tmp_path / "store"), "all-MiniLM-L6-v2", 4, "ID", ["Name"])
    assert table.insert(stored_rows, "embedding", "n") == 3
    return table


def test_store_query(store):
    rows = store.query([0.1, 0.2, 0.3, 0.4], top_k=3).collect()
    assert [r.id for r in rows] == ["1", "2", "3"]
    assert rows[0].similarity > 0.9
    assert json.loads(rows[0].fields) == {"n": 1, "ID": "1", "Name": "Steel bolt", "Category": "Hardware"}
    assert store.query([0.1, 0.2, 0.3, 0.4], top_k=1).count() == 1
    assert store.query([0.1, 0.2, 0.3, 0.4], top_k=3, decimals=4).collect()[1].similarity == 0.9999
    with pytest.raises(ValueError, match="dimensions"):
        store.query([1.0])


def test_store_insert_info_and_reopen(spark, store):
    more = spark.createDataFrame(
        [("4", "Paper lamp", "Home", [0.5, 0.5, 0.5, 0.5])],
        "ID string, Name string, Category string, embedding array<float>",
    )
    assert store.insert(more, "embedding", "ID") == 1
    assert [r.pos for r in store.rows.orderBy("pos").collect()] == [0, 1, 2, 3]
    again = VectorTable.open(spark, store.path)
    info = again.info().first()
    assert (info["row_count"], info["model_id"], info["dimensions"]) == (4, "all-MiniLM-L6-v2", 4)
    assert (info["key_column"], info["embed_columns"]) == ("ID", ["Name"])
    assert info["size_on_disk"] > 0
    assert again.query([0.1, 0.2, 0.3, 0.4], top_k=2).count() == 2
    with pytest.raises(FileExistsError):
        VectorTable.create(spark, store.path, "m", 4, "ID", ["Name"])
    with pytest.raises(FileNotFoundError):
        VectorTable.open(spark, store.path + "-none")


def test_store_match_and_annotate(store, stored_rows):
    assert store.match(0.80).relation().count() == 3
    out = store.annotate(stored_rows.select("ID", "Name"), 0.80)
    assert out.columns == [
        "ID", "Name", "_match_count", "_match_ids", "_best_match_id", "_best_match_score", "_group_id",
    ]
    assert out.count() == 3


def test_store_query_many(spark, store):
    asked = spark.createDataFrame([(7, [0.9, 0.8, 0.7, 0.6])], "q long, v array<float>")
    rows = store.query_many(asked, "q", "v", top_k=2, decimals=3).orderBy("rank").collect()
    assert [(r.query_key, r.id, r["rank"]) for r in rows] == [("7", "3", 1), ("7", "2", 2)]


def test_many_queries_scan_the_stored_rows_or_their_cells(spark, tmp_path):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(9, 5)) * 3
    rows = [(i, (centres[i % 9] + rng.normal(size=5) * 0.2).tolist()) for i in range(240)] + [(i, [1.0] * 5) for i in range(240, 300)]
    df = spark.createDataFrame(rows, "k long, v array<float>")
    asked = spark.createDataFrame([(i, rows[i * 7][1]) for i in range(20)] + [(99, [1.0] * 5), (100, [0.0] * 5)], "q long, v array<float>")
    table = VectorTable.create(spark, str(tmp_path / "s"), "m", 5, "k", ["k"])
    table.insert(df.where("k < 290"), "v", "k")

    def found():
        got = table.query_many(asked, "q", "v", top_k=6, decimals=6)
        return sorted((r.query_key, r["rank"], r.id, r.similarity) for r in got.collect())

    table.insert(df.where("k >= 290"), "v", "k")
    want = found()
    joined = nearest(asked, "q", "v", table.rows, "pos", "embedding", stored_key="key", top_k=6, decimals=6)
    assert want == sorted((r.query_key, r["rank"], r.neighbor_key, r.score) for r in joined.collect())
    scan = scanned(table.rows, "pos", "key", "embedding", np.ones((3, 5)), "cosine", 6)
    told = scan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in told and "Exchange" not in told[told.index("MapInArrow") :]  # only the best rows move
    table.build_index(rows_per_cell=20)
    assert found() == want


def words(spark, rows):
    return spark.createDataFrame(rows, "k string, t string, o long")


def test_store_add_is_by_key(spark, tmp_path):
    table = VectorTable.create(spark, str(tmp_path / "s"), hashing(16).name, 16, "k", ["t"])
    first = table.add(words(spark, [("a", "red", 1), ("b", "blue", 2), ("a", "other", 3)]), "o", hashing(16))
    assert (first.added, first.skipped) == (2, 1)
    batch = words(spark, [("b", "changed", 1), ("c", "green", 2)])
    assert table.add(batch, "o", hashing(16)).added == 1
    assert table.add(batch, "o", hashing(16)).added == 0
    rows = {r.key: (r.pos, json.loads(r.row_data)["t"]) for r in table.rows.collect()}
    assert rows == {"a": (0, "red"), "b": (1, "blue"), "c": (2, "green")}
    assert table.query_text("green", top_k=1, encoder=hashing(16)).first().id == "c"
    with pytest.raises(ValueError, match="dimensions"):
        table.add(batch, "o", hashing(8))
    # another encoder of equal size makes vectors of another kind
    with pytest.raises(ValueError, match="holds vectors of"):
        table.add(batch, "o", hashing(16, ngram=3))
    with pytest.raises(ValueError, match="holds vectors of"):
        VectorTable.open(spark, table.path).query_text("green", encoder=hashing(16, ngram=3))


def test_a_batch_with_a_null_key_is_added_once(spark, tmp_path):
    table = VectorTable.create(spark, str(tmp_path / "s"), hashing(16).name, 16, "k", ["t"])
    batch = words(spark, [("a", "red", 1), (None, "blue", 2), (None, "late", 3)])
    assert [table.add(batch, "o", hashing(16)).added for _ in range(3)] == [2, 0, 0]
    assert {r.key for r in table.rows.collect()} == {"a", None}


def test_insert_keeps_keys_unique(spark, store, stored_rows):
    assert store.insert(stored_rows, "embedding", "n") == 0
    twice = spark.createDataFrame([("9", "x", "y", [0.1] * 4), ("9", "z", "y", [0.2] * 4)], "ID string, Name string, Category string, embedding array<float>")
    assert store.insert(twice, "embedding", "Name") == 1
    assert store.count() == 4


def test_stream_adds_each_key_once(spark, tmp_path):
    table = VectorTable.create(spark, str(tmp_path / "s"), hashing(16).name, 16, "k", ["t"])
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    for rows in ([("a", "red", 1), ("b", "blue", 2)], [("b", "again", 3), ("c", "green", 4)]):
        words(spark, rows).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, t string, o long").parquet(source)
        add_stream(table, stream, "o", checkpoint, hashing(16)).awaitTermination()
    assert sorted(r.key for r in table.rows.collect()) == ["a", "b", "c"]


def catalog(spark):
    rows = [
        (1, "P-1", "Wired desk lamp", "Warm light with a metal arm"),
        (2, "P-2", "Wired desk lamp", "Warm light with a metal arm"),
        (3, "P-3", "Desk lamp wired", "Warm light with a steel arm"),
        (4, "P-4", "Garden hose", "Ten metres of green rubber"),
    ]
    return spark.createDataFrame(rows, "n long, SKU string, `Product Name` string, Description string")


def test_nearest_rows_detects_key_and_text(spark):
    df = catalog(spark)
    chosen = selection(df, "n")
    assert (chosen.key, chosen.embed) == ("n", ["SKU", "Product Name", "Description"])
    out = nearest_rows(df, "n", key="SKU", embed=["Product Name", "Description"], encoder=hashing(64), top_k=1)
    best = {r.query_key: (r.neighbor_key, r.score) for r in out.collect()}
    assert best["P-1"] == ("P-2", 1.0)
    assert best["P-2"] == ("P-1", 1.0)
    assert best["P-3"][0] == "P-1"


def test_rows_without_a_key_are_numbered(spark):
    df = spark.createDataFrame([("x", "red"), ("y", "red"), ("z", "blue")], "o string, t string")
    out = nearest_rows(df, "o", key="_row_id", embed=["t"], encoder=hashing(16), top_k=1)
    assert {(r.query_key, r.neighbor_key) for r in out.collect()} >= {("1", "2"), ("2", "1")}


def test_composed_and_embedded_neighbours(spark):
    df = composed(catalog(spark), ["Product Name", "Description"], encoder=hashing(64))
    out = embedded_neighbours(df, "n", "_composite_key", top_k=1).collect()
    assert out[0].query_key.startswith(("Wired", "Desk", "Garden"))
    with pytest.raises(ValueError, match="Embedding column"):
        embedded_neighbours(df, "n", "SKU")


def test_dedup(spark, tmp_path):
    done = dedup_table(
        spark, catalog(spark), str(tmp_path / "s"), "SKU", ["Product Name", "Description"], "n",
        encoder=hashing(64), threshold=0.8,
    )
    rows = {r.SKU: r for r in done.annotated.collect()}
    assert rows["P-1"]["_group_id"] == rows["P-2"]["_group_id"] == rows["P-3"]["_group_id"] == 1
    assert rows["P-4"]["_group_id"] == 0
    assert rows["P-1"]["_best_match_id"] == "P-2"


def test_presets(spark):
    assert list(PRESETS) == [
        "vendor-dedup", "address-cleansing", "product-catalog", "lead-dedup", "counterparty-screening",
    ]
    for preset in PRESETS.values():
        assert {preset.key, *preset.embed} <= set(preset.columns)
    with pytest.raises(ValueError, match="Unknown preset"):
        find_preset("none")
    found = preset_matches(catalog(spark), "product-catalog", "n", hashing(384))
    assert {(r.query_key, r.match_key) for r in found.relation().collect()} >= {("P-1", "P-2")}
    with pytest.raises(ValueError, match="lacks"):
        preset_matches(catalog(spark), "vendor-dedup", "n", hashing(384))


def test_whole_texts_are_read(spark):
    long = "word " * 30_000
    df = spark.createDataFrame([(long + "end",), (long + "fin",)], "t string")
    a, b = [r["_emb_t"] for r in embed_columns(df, ["t"], hashing(4096)).collect()]
    assert a != b


def test_null_text_is_empty(spark):
    df = spark.createDataFrame([(None,)], "t string").withColumn("t", F.col("t"))
    assert not any(embed_columns(df, ["t"], hashing(4)).first()["_emb_t"])


def test_indexed_query_equals_the_scan(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6)) * 3
    rows = [(i, (centres[i % 12] + rng.normal(size=6) * 0.2).tolist()) for i in range(300)]
    rows += [(i, [0.0] * 6) for i in range(300, 305)] + [(i, rows[7][1]) for i in range(305, 400)]
    df = spark.createDataFrame(rows, "k long, v array<float>")
    table = VectorTable.create(spark, str(tmp_path / "s"), "m", 6, "k", ["k"])
    table.insert(df.where("k < 390"), "v", "k")
    asked = [rows[7][1], [0.0] * 6, rng.normal(size=6).tolist()]
    table.insert(df.where("k >= 390"), "v", "k")
    want = [table.query(q, 20, 6).collect() for q in asked]
    indexed = VectorTable.create(spark, str(tmp_path / "i"), "m", 6, "k", ["k"])
    indexed.insert(df.where("k < 390"), "v", "k")
    indexed.build_index(rows_per_cell=20)
    indexed.insert(df.where("k >= 390"), "v", "k")
    indexed = VectorTable.open(spark, indexed.path)
    assert [indexed.query(q, 20, 6).collect() for q in asked] == want
    # a query inside a cluster reads some of the cells only
    index = indexed.index
    unit = np.array([rows[7][1]]) / np.linalg.norm(rows[7][1])
    assert len(index.cells_above(unit, 0.999)) < (index.counts > 0).sum()
    few = {r.id for r in indexed.query(asked[2], 20, 6, probes=6).collect()}
    assert len(few & {r.id for r in want[2]}) >= 10


def test_workspace_is_the_applications_own(spark):
    first = written(spark.range(3), "kept")
    assert first.count() == 3
    path = scratch_path(spark, "x")
    assert spark.sparkContext.applicationId in path
    assert not exists(spark, path)
    assert few_rows(spark, [(1, None)], "a int, b array<double>").first() == (1, None)


def test_deletes_equal_a_table_without_the_rows(spark, tmp_path):
    dice = np.random.default_rng(8)
    rows = [(i, f"k{i}", dice.normal(size=5).tolist()) for i in range(120)] + [(500, None, [1.0] * 5)]
    df = spark.createDataFrame(rows, "n long, k string, v array<float>")
    asked = spark.createDataFrame([(i, dice.normal(size=5).tolist()) for i in range(6)], "q long, v array<float>")
    one = asked.orderBy("q").first()["v"]
    held = set(range(120)) | {500}
    table = VectorTable.create(spark, str(tmp_path / "s"), "m", 5, "k", ["k"])
    table.insert(df, "v", "n")

    def check():
        plain = VectorTable.create(spark, str(tmp_path / f"plain{len(list(tmp_path.iterdir()))}"), "m", 5, "k", ["k"])
        plain.insert(df.where(F.col("n").isin(sorted(held))), "v", "n")
        again = VectorTable.open(spark, table.path)
        for t in (table, again):
            assert t.count() == len(held)
            assert t.query(one, 7).collect() == plain.query(one, 7).collect()
        key = lambda t: sorted(map(tuple, t.query_many(asked, "q", "v", 4).collect()))
        assert key(table) == key(plain)

    def delete(numbers):
        assert table.delete(df.where(F.col("n").isin([*numbers, 9999])).union(df.where(F.col("n").isin(numbers)))) == len(numbers)
        assert table.delete(df.where(F.col("n").isin(numbers))) == 0
        held.difference_update(numbers)

    delete([0, 5, 119, 500])  # among them the last position, and the row without a key
    check()
    assert table.insert(df.where("n in (5, 6)"), "v", "n") == 1
    held.add(5)
    assert table.rows.agg(F.max("pos")).first()[0] == 121
    table.build_index(rows_per_cell=20)
    delete(list(range(20, 60)))
    assert table.insert(df.where("n = 30"), "v", "n") == 1
    held.add(30)
    check()
    # A compaction that was cut off has no end mark.
    table.rows.limit(3).write.parquet(f"{table.path}/compact=1/rows")
    assert table.count() == len(held)
    delete([30])
    assert table.compact() == len(held) and table.index.counts.sum() == len(held)
    check()
    assert table.insert(df.where("n = 30"), "v", "n") == 1 and table.rows.agg(F.max("pos")).first()[0] == 123
    held.add(30)
    check()
    table.delete(df)
    assert table.compact() == 0 and table.query(one, 3).count() == 0 and table.count() == 0


def test_probes_answer_each_query_alike(spark, tmp_path):
    dice = np.random.default_rng(9)
    rows = [(i, f"k{i}", dice.normal(size=6).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "n long, k string, v array<float>")
    table = VectorTable.create(spark, str(tmp_path / "s"), "m", 6, "k", ["k"])
    table.insert(df.where("n < 380"), "v", "n")
    table.build_index(rows_per_cell=20)
    table.insert(df.where("n >= 380"), "v", "n")
    table.delete(df.where("n % 10 = 3"))
    asked = spark.createDataFrame([(i, dice.normal(size=6).tolist()) for i in range(30)] + [(99, None)], "q long, v array<float>")

    def answers(part, probes):
        return {(r["query_key"], r["rank"]): (r["id"], r["similarity"]) for r in table.query_many(part, "q", "v", 5, 6, probes).collect()}

    together = answers(asked, 3)
    for q in (4, 17):
        alone = answers(asked.where(F.col("q") == q), 3)
        assert alone == {k: v for k, v in together.items() if k[0] == str(q)} and len(alone) == 5
        one = table.query(asked.where(F.col("q") == q).first()["v"], 5, 6, probes=3).collect()
        assert [(r["id"], r["similarity"]) for r in one] == [alone[str(q), i] for i in range(1, 6)]
    every, exact = answers(asked, 1000), answers(asked, None)
    assert every == exact and len(exact) == 150
    hits = len({(k[0], v[0]) for k, v in together.items()} & {(k[0], v[0]) for k, v in exact.items()})
    assert 60 < hits < 150
    probes = [table.probes_for(r, 5, 100) for r in (0.5, 0.9, 1.0)]
    assert 1 <= probes[0] < probes[1] < probes[2] <= (table.index.counts > 0).sum()
    found = answers(asked, probes[1])
    assert len({(k[0], v[0]) for k, v in found.items()} & {(k[0], v[0]) for k, v in exact.items()}) >= 0.85 * 150
    assert answers(asked.limit(0), 3) == {}
    with pytest.raises(ValueError, match="dimensions"):
        answers(spark.createDataFrame([(1, [1.0])], "q long, v array<float>"), 3)


def test_index_leaves_the_fields_in_the_table(spark, tmp_path):
    rows = [(i, f"text {i}", [float(np.cos(i)), float(np.sin(i)), 0.1 * (i % 7)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, v array<float>")
    table = VectorTable.create(spark, str(tmp_path / "t"), "given", 3, "id", ["text"])
    table.insert(df.where("id < 50"), "v", "id")
    asked = [0.3, 0.9, 0.2]
    table.build_index(rows_per_cell=10)
    table.insert(df.where("id >= 50"), "v", "id")
    assert "row_data" not in table.index.rows.columns
    got = table.query(asked, top_k=12, decimals=6).collect()
    plain = VectorTable.create(spark, str(tmp_path / "plain"), "given", 3, "id", ["text"])
    plain.insert(df, "v", "id")
    assert got == plain.query(asked, top_k=12, decimals=6).collect() and len(got) == 12
    assert all(f'"text {r.id}"' in r.fields for r in got)


def test_columns_of_a_row_share_a_worker(spark):
    df = spark.createDataFrame([("ab", None, "x"), ("abc", "x", "")], "a string, b string, c string")

    class Once:
        """Tells whether its process made another model for the same task."""

        def __init__(self):
            import os

            self.pid = os.getpid()

        def encode(self, texts):
            return np.array([[self.pid, id(self) % 1_000_003] for _ in texts], dtype=np.float32)

    once = EncoderSpec(Once, 2, "once")
    rows = embed_columns(df.coalesce(1), ["a", "b", "c"], once).collect()
    assert all(r["_emb_a"] == r["_emb_b"] == r["_emb_c"] for r in rows)
    plan = embed_and_combine(df, ["a", "b", "c"], "v", once)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    # Each column keeps the encoder of its own model.
    unlike = {"entity": lengths(), "mini": hashing(2)}.__getitem__
    two = spark.createDataFrame([("aa", "aa b")], "Company string, Notes string")
    got = embed_and_combine(two, ["Company", "Notes"], "v", unlike).first()["v"]
    words = HashingEncoder(2).encode(["aa b"])[0]
    assert got == pytest.approx([(2 + words[0]) / 2, (2 + words[1]) / 2])
