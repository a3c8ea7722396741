import sentencepiece

import corpus_pipeline as pipeline
from affinis.llm.queries import vocabulary
from affinis.llm.simhash import simhash_groups
from affinis.workspace import written

FOLDER = "/root/testdata/sf0.01"


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, FOLDER), name)
        seen[name] = docs
        if name != "encoding":
            assert docs.dtypes == before.dtypes
            assert docs.exceptAll(before).distinct().count() == 0 or name == "mixing"
            assert docs.distinct().exceptAll(before.distinct()).count() == 0
    assert seen["toxicity"].count() > 900
    assert seen["language"].count() == seen["toxicity"].count()
    groups = simhash_groups(seen["language"], "doc_id", "text").collect()
    assert sorted(r["doc_id"] for r in seen["near_duplicates"].select("doc_id").collect()) == sorted({r["component_id"] for r in groups})
    assert simhash_groups(seen["near_duplicates"], "doc_id", "text").select("component_id").distinct().count() == seen["near_duplicates"].count()
    assert {r["count"] for r in seen["mixing"].groupBy("doc_id").count().collect()} <= {1, 2}
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in seen["mixing"].collect()}
    coded = seen["encoding"].collect()
    assert len(coded) == seen["mixing"].count()
    assert all(r["ids"] == library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True) for r in coded)


def test_stages_on_odd_rows(spark):
    rows = [(1, "the house, and the garden of it", "en", "a", 9), (1, "the house, and the garden of it", "en", "a", 9), (2, None, None, None, None),
            (3, "", "en", "a", 0), (None, "a word of another kind here", None, None, 1), (5, "12 34", "fr", "b", 2)]
    fields = "doc_id long, text string, lang string, source string, n_chars long, score double, _whole string, _row string, predicted string"
    odd = spark.createDataFrame([(*r, 0.1, "w", "r", "p") for r in rows], fields)
    for table in (odd, odd.limit(0)):
        docs = table
        for name, stage in pipeline.STAGES:
            docs = written(stage(spark, docs, FOLDER), name)
            if name != "encoding":
                assert docs.columns == odd.columns
            if name == "toxicity":
                assert docs.count() == table.count()
            if name == "near_duplicates":
                assert docs.count() == docs.select("doc_id", "text").distinct().count()
