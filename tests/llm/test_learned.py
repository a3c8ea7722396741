import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.llm import toxicity
from affinis.llm.langid import SCALE, FollowTheLeader, document_frequencies, identify_languages, softmax, train_languages
from affinis.llm.toxicity import DECAY, OFFSETS, fit_words, kernel, letters_only, machine, toxic_texts, train_toxicity, words_of, ToxicityModel


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def plain_kernel(a, b):
    """All pairs of equal gapped subsequences of three characters, weighted by their spans."""

    def occurrences(word):
        w = f"\x02{word}\x03"
        found = [((w[i], w[i + x], w[i + y]), DECAY ** (y + 1)) for x, y in OFFSETS for i in range(len(w) - y)]
        norm = np.sqrt(sum(v * v for _, v in found))
        return [(k, v / norm) for k, v in found]

    return sum(v * w for k, v in occurrences(a) for m, w in occurrences(b) if k == m)


def test_kernel_is_the_sum_over_shared_subsequences():
    words = ["idiot", "idxiot", "i", "the", "banana", "ananas"]
    got = kernel(words, words[:3])
    assert got == pytest.approx(np.array([[plain_kernel(a, b) for b in words[:3]] for a in words]), abs=1e-5)
    assert kernel(["idiot"], ["idxiot"])[0, 0] > 2 * kernel(["idiot"], ["table"])[0, 0]


def test_folded_weights_equal_the_machine_on_landmarks():
    toxic, other = ["idiot", "moron", "clown", "stupid"], {"the": 9, "and": 9, "idea": 3, "crown": 2, "stupor": 1, "house": 5}
    keys, weights, bias = fit_words(dict.fromkeys(toxic, 1), other)
    model = ToxicityModel(keys, weights, bias, np.zeros(4), np.ones(4), np.zeros(4), 0.0)
    values = dict(zip([*toxic, *other], model.word_values([*toxic, *other]), strict=True))
    assert min(values[w] for w in toxic) > max(values[w] for w in other)
    assert model.word_values(letters_only(["i-d.i*o t".replace(" ", ""), "idxiot"])).min() > values["house"]
    assert len(model.word_values(["x" * 1000, ""])) == 2


def test_folded_weights_give_the_machine_s_own_values():
    toxic, other = {"idiot": 4, "moron": 1, "clown": 2}, {"the": 9, "idea": 3, "crown": 2, "house": 5}
    seen = {}

    def watched(x, y, weight):
        seen["x"], seen["fit"] = x, machine(x, y, weight)
        return seen["fit"]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(toxicity, "machine", watched)
        keys, weights, bias = fit_words(toxic, other)
    w, b = seen["fit"]
    values = ToxicityModel(keys, weights, bias, np.zeros(4), np.ones(4), np.zeros(4), 0.0).word_values(["idiot", "clown", "moron"])
    assert values == pytest.approx((seen["x"] @ w + b)[:3], abs=1e-4)


def test_joined_words_are_valued_apart_too():
    keys, weights, bias = fit_words({"idiot": 3, "moron": 1}, {"the": 9, "idea": 3, "fool": 2, "house": 5})
    model = ToxicityModel(keys, weights, bias, np.zeros(4), np.ones(4), np.zeros(4), 0.0)
    plain, joined, apart = model.token_values(["idiot", "house,idiot/the", "id-io.t"])
    assert joined == apart == plain > model.token_values(["house,the"])[0]


def test_remembered_words_are_bounded_by_their_letters(monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED", 10_000)
    keys, weights, bias = fit_words({"idiot": 3}, {"the": 9, "house": 5})
    model = ToxicityModel(keys, weights, bias, np.zeros(4), np.ones(4), np.zeros(4), 0.0)
    for i in range(40):
        model.features([f"idiot {'ab' * 1000}{i} the"])
        assert sum(map(len, model.values)) <= 10_000


def test_sample_of_a_hot_id_keeps_its_bound(spark):
    rows = [(1, f"the house of {i}" + " you idiot" * (i % 2)) for i in range(600)] + [(i, f"a garden {i}") for i in range(3, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 200)], "doc_id long, toxic int")
    sizes = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(toxicity, "fit_texts", lambda x, y: sizes.append(len(x)) or (np.zeros(4), np.ones(4), np.zeros(4), 0.0))
        train_toxicity(docs, labels, "doc_id", "text", fit_rows=80)
    assert all(n < 2 * 80 for n in sizes)
    docs = docs.withColumn("lang", F.lit("en")).unionByName(docs.selectExpr("doc_id", "upper(text) text", "'de' lang"))
    assert set(train_languages(docs, "doc_id", "text", "lang", fit_rows=80).languages) == {"de", "en"}


def plain_features(text):
    """Counts of hashed n-grams of one to three characters, borders as spaces, written out plainly."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower() + " ")
    kept = "".join(c for i, c in enumerate(letters) if c != " " or i == 0 or letters[i - 1] != " ")
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(kept) - n + 1):
            gram, mixed = kept[i : i + n], 0
            if gram != " ":
                for k, c in enumerate(gram):
                    mixed = (mixed + (0 if c == " " else ord(c)) + k + 1) * 0x9E3779B97F4A7C15 % 2**64
                out[mixed >> 48] += 1
    return out


def test_language_scores_against_plain_sums(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    open_rows = [r for r in docs.collect() if not held(r["doc_id"])]
    number, seen = document_frequencies(spark.createDataFrame(open_rows, docs.schema), "text")
    plain = Counter(f for r in open_rows for f in plain_features(r["text"] or ""))
    assert number == sum(any(c.isalpha() for c in r["text"] or "") for r in open_rows)
    assert {f: int(n) for f, n in enumerate(seen) if n} == plain
    model = train_languages(docs, "doc_id", "text", "lang")
    idf = np.array([math.log((1 + number) / (1 + n)) + 1 for n in seen])
    assert model.table[:, -1] == pytest.approx(idf, rel=1e-6)
    texts = [r["text"] for r in open_rows[:20]] + ["Déjà vu!", "x"]
    weights = model.table[:, :-1] / idf[:, None]
    for text, got in zip(texts, model.probabilities(texts)[0], strict=True):
        counts = plain_features(text)
        shares = {f: n * idf[f] for f, n in counts.items()}
        logits = sum(SCALE * s / sum(shares.values()) * weights[f] for f, s in shares.items()) + model.bias
        assert got == pytest.approx(softmax(logits[None] / model.temperature)[0], abs=1e-5)


def test_machine_separates():
    dice = np.random.default_rng(1)
    x = np.r_[dice.normal(2, 1, (50, 3)), dice.normal(-2, 1, (50, 3))]
    y = np.r_[np.ones(50), -np.ones(50)]
    w, b = machine(x, y, np.ones(100))
    assert ((x @ w + b) * y > 0).mean() > 0.97


def test_letters_set_apart_are_words():
    assert "idiot" in words_of("You I D I O T!") and "idiot" in words_of("an i-d-i-o-t") and words_of("a b") == ["a", "b"]


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify_languages(docs, "doc_id", "text", "lang").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    apart = [r for r in got if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in apart]) > 0.97
    # A calibrated score is near the share of right predictions.
    assert abs(np.mean([r["score"] for r in apart]) - np.mean([r["lang"] == r["lang_pred"] for r in apart])) < 0.05


def test_penalty_leaves_weights_at_zero(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = train_languages(docs, "doc_id", "text", "lang")
    assert 0 < np.count_nonzero(model.table[:, :-1]) < 0.5 * model.table[:, :-1].size


def test_leader_learns_a_simple_rule():
    dice = np.random.default_rng(1)
    x = dice.integers(0, 2, (300, 4)).astype(float)
    leader = FollowTheLeader(4, 2, 0.5, 0.001, 0.01)
    for i in range(0, 300, 10):
        leader.step(np.arange(4), x[i : i + 10], np.stack([x[i : i + 10, 0], 1 - x[i : i + 10, 0]], axis=1))
    assert (softmax(x @ leader.weights())[:, 0] > 0.5).astype(float) @ x[:, 0] >= 0.95 * x[:, 0].sum()


FIELDS = "doc_id long, text string, lang string, source string, score double, _whole string, held_out string, lang_pred int"


def odd_documents(spark):
    rows = [(1, "the house and the garden", "en"), (1, "the house and the garden", "en"), (3, None, "en"), (4, "", None), (5, "123 !?", "fr"),
            (None, "la maison et le jardin", "fr"), (7, "le jardin de la maison", "fr"), (8, "the garden", "en"), (9, "le chat " * 50_000, "fr"),
            (10, "a word", None)]
    return spark.createDataFrame([(*r, "s", 0.5, "w", "h", 3) for r in rows], FIELDS)


def test_languages_of_odd_rows(spark):
    odd = odd_documents(spark)
    got = identify_languages(odd, "doc_id", "text", "lang").collect()
    assert len(got) == 10
    for r in got:
        assert r["held_out"] == held(r["doc_id"])
        assert (r["lang_pred"] == "und" and r["score"] == 0) if r["doc_id"] in (3, 4, 5) else r["lang_pred"] in ("en", "fr")
    assert identify_languages(odd.limit(0), "doc_id", "text", "lang").count() == 0
    unlabelled = identify_languages(odd.withColumn("lang", F.lit(None).cast("string")), "doc_id", "text", "lang").collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = toxic_texts(docs, labels, "doc_id", "text").join(labels, "doc_id", "left").collect()
    assert len(got) == 10_000
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == held(r["doc_id"]) for r in got)
    apart = [r for r in got if r["held_out"] and r["toxic"] is not None]
    caught = sum(r["predicted"] and r["toxic"] for r in apart)
    assert caught / sum(r["toxic"] for r in apart) > 0.75
    assert caught / sum(r["predicted"] for r in apart) > 0.8


def test_toxicity_of_odd_rows(spark):
    odd = odd_documents(spark)
    labels = spark.createDataFrame([(1, 0, 1), (7, 1, 0), (8, None, 3), (None, 1, 1), (10, 1, None)], "doc_id long, toxic int, quality int")
    for marks in (labels, labels.limit(0)):
        got = toxic_texts(odd, marks, "doc_id", "text").collect()
        assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    assert toxic_texts(odd.limit(0), labels, "doc_id", "text").count() == 0


def test_toxic_rows_that_resemble_clean_ones_teach(spark):
    dice = np.random.default_rng(3)
    rare = ["".join(dice.choice(list("bcdfglmnprstaeo"), 6)) for _ in range(300)]
    # All texts share their frequent words, as long texts of one language do.
    rows = [(i, "the house and the garden of the town " * 20 + " ".join(dice.choice(rare, 12)) + " you idiot" * (i % 2)) for i in range(1, 401)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxic_texts(docs, labels, "doc_id", "text").collect()}
    assert all(got[i] == i % 2 for i in got if held(i))


def test_only_equal_texts_of_one_label_count_once(spark):
    from affinis.llm.toxicity import _once

    rows = [(1, "a b", 0), (2, "a b", 0), (3, "a b", 1), (4, "a b c", 0)]
    drawn = spark.createDataFrame(rows, "_id long, _content string, _toxic int")
    assert sorted(tuple(r) for r in _once(drawn).collect()) == [(1, "a b", 0), (3, "a b", 1), (4, "a b c", 0)]
