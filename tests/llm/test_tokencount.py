import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from affinis.llm.tokencount import CHUNK, boundaries, counter_of, splitter, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    with open(PATH, "rb") as file:
        return counter_of(file.read())


def plain(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_random_texts_as_the_library_counts_them(counter, library):
    dice = random.Random(1)
    letters = "abcdetth  theinrvlm'''ser ▁é漢\n\t\r;)}😀\x00ñßΣİ12½​́\x85\xa0"
    texts = ["".join(dice.choices(letters, k=dice.randint(0, 60))) for _ in range(5000)]
    texts += ["".join(dice.choices("abnie", k=dice.randint(1, 40))) for _ in range(3000)]
    assert counter.counts(texts).tolist() == plain(library, texts)


def test_edges(counter, library):
    texts = ["", " ", "'r", "'rex 'r x'll'l'", "<|endoftext|>a<|startoftext|>", "x<|endoftext|", "a" * 5000, "'" * 700, "I'VE", "ꟋꟜ"]
    texts += ["x" * n + "'re" + "y" * n for n in (CHUNK - 3, CHUNK - 2, CHUNK - 1, CHUNK, 3 * CHUNK)]
    assert counter.counts(texts).tolist() == plain(library, texts)


def test_every_code_point_is_classed_as_the_library_does(counter, library):
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"a{c}b {c}{c}'{c} " for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    assert counter.counts(texts).tolist() == plain(library, texts)


def test_chunks_compose(counter):
    classes, _, _ = splitter()
    text = "it's a wo'uld 'll 're12 x" * 200
    kinds = classes[[ord(c) for c in text]]
    starts, ends = boundaries(kinds)
    import regex

    want = [m.span() for m in regex.finditer(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", text)]
    assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == want


def test_documents_and_odd_rows(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in token_counts(docs, "text", PATH, 2048, ["doc_id"]).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert [got[r["doc_id"]]["n_tokens"] for r in rows] == plain(library, [r["text"] for r in rows])
    assert all(got[r["doc_id"]]["n_bytes"] == len(r["text"].encode()) for r in rows)
    odd = spark.createDataFrame([(1, None, 1), (1, None, 1), (2, "", 1), (None, "a b", 1)], "doc_id long, text string, n_bytes int")
    seen = sorted(((r["doc_id"] or 0), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(odd, "text", PATH, 1, ["doc_id"]).collect())
    assert seen == [(0, 3, 2, True), (1, 0, 0, False), (1, 0, 0, False), (2, 0, 0, False)]
    assert token_counts(odd.limit(0), "text", PATH, 1, ["doc_id"]).count() == 0
