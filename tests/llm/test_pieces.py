import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from affinis.llm.pieces import LONG, codec_of, piece_codes

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as file:
        return codec_of(file.read())


def compare(codec, library, texts):
    ids, counts = codec.encode(texts)
    decoded = codec.decode(ids, counts)
    ends = np.cumsum(counts)
    want = library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
    for text, a, b, ours, theirs in zip(texts, ends - counts, ends, decoded, want, strict=True):
        assert ids[a:b].tolist() == theirs, text[:80]
        assert ours == library.decode(theirs), text[:80]


def test_random_texts_as_the_library_has_them(codec, library):
    dice = random.Random(1)
    letters = "abcdeth  the in er ▁é漢\n\t\r;)}😀\x00ñß​"
    compare(codec, library, ["".join(dice.choices(letters, k=dice.randint(0, 60))) for _ in range(3000)])
    parts = [" hors", "kil", "aggi", " tale", "Sec", "Google", "roduction", "ead", "quare", "omp", "avi"]
    compare(codec, library, ["".join(dice.choices(parts, k=200)) for _ in range(100)])


def test_edges_and_very_long_words(codec, library):
    long = "a" * (LONG + 500)
    compare(codec, library, ["", " ", "  x", "x  ", "▁x", "\n", "<s></s><0x41>", " " * 3000, long, "ab" * LONG + " ", long + " " + long])


def test_documents(codec, library, spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    compare(codec, library, [r["text"] for r in rows])


def test_digests_and_content(spark, library):
    rows = [(1, "Hello  world", 5), (1, "Hello  world", 6), (2, None, 7), (3, "", 8), (None, "x\ny", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = piece_codes(df, "text", PATH, ["doc_id", "n_tokens"]).collect()
    assert len(got) == 5
    texts = {1: "Hello  world", 2: "", 3: "", None: "x\ny"}
    for r in got:
        want = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["decoded"] == library.decode(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert piece_codes(df.limit(0), "text", PATH, ["doc_id"]).count() == 0
