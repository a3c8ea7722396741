import math
import random
import re
from collections import Counter

import numpy as np

from affinis.llm.lexical import Sparse, ball_tree, best_first, bounds, ranked_documents, terms_of


def plain_terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_ranks(docs, items, k=10):
    terms = [(i, Counter(plain_terms(t))) for i, t in docs]
    total = [sum(c.values()) for _, c in terms]
    n, length = sum(t > 0 for t in total), sum(total)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        scores = []
        for (i, c), size in zip(terms, total, strict=True):
            m = 10 + (90 * size * n) // length if length else 0
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in set(plain_terms(text)) if t in c
            )
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def made(seed, count):
    dice = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "naïve", "日本", " x"]
    docs = [(i, " ".join(dice.choice(vocabulary) for _ in range(dice.choice([0, 1, 5, 30, 80])))) for i in range(count)]
    docs += [(count, None), (None, "w1 w2 w2"), (3, docs[5][1]), (count + 1, docs[5][1]), (count + 2, "w7, " * 3000)]
    items = [(i, " ".join(dice.choice(vocabulary) for _ in range(dice.choice([1, 6, 20])))) for i in range(12)]
    return docs, items + [(2, "w1 w1 W2"), (90, None), (91, ""), (92, "unknown"), (None, "w3")]


def test_ranks_against_every_document(spark):
    docs, items = made(1, 300)
    d = spark.createDataFrame([(*r, 1, 2.0) for r in docs], "doc_id long, text string, rank int, score double").repartition(4)
    q = spark.createDataFrame([(*r, 5) for r in items], "item_id long, text string, doc_id int")
    want = plain_ranks(docs, items)
    for options in ({}, {"block": 50}, {"vocabulary": 6}):
        got = ranked_documents(d, q, "doc_id", "text", "item_id", **options)
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert got.count() == len(want) and got.select("score").count() == len(want)
    assert ranked_documents(d.limit(0), q, "doc_id", "text", "item_id").count() == 0
    assert ranked_documents(d, q.limit(0), "doc_id", "text", "item_id").count() == 0


def test_terms_are_those_of_the_pattern():
    text = "ABC-def_gh'1Été —x ퟿ a\tb\x7fc[d]{e}"
    assert [t.decode() for t in terms_of(text)] == plain_terms(text)


def sparse(rows, terms):
    held = [sorted(r.items()) for r in rows]
    starts = np.concatenate([[0], np.cumsum([len(h) for h in held])])
    flat = [x for h in held for x in h]
    return Sparse(starts, np.array([t for t, _ in flat], np.int64), np.array([v for _, v in flat], np.int64))


def test_bounds_hold_and_prune():
    dice = np.random.default_rng(1)
    topics = dice.choice(300, (12, 15))
    rows = [{int(t): int(dice.integers(1, 10**6)) for t in dice.choice(topics[i % 12], 8, replace=False)} for i in range(1500)]
    docs = sparse(rows, 300)
    tree = ball_tree(docs, 300)
    dense = np.zeros((1500, 300))
    for i, r in enumerate(rows):
        dense[i, list(r)] = list(r.values())
    scored = []
    for trial in range(40):
        terms = np.unique(topics[trial % 12][:10])
        weights = dice.integers(1, 9000, len(terms))
        score = (dense[:, terms] @ weights).astype(np.int64)
        limit = bounds(tree, np.arange(len(tree.first)), terms, weights.astype(float))
        for node, (a, b) in enumerate(zip(tree.first, tree.last, strict=True)):
            assert score[tree.order[a:b]].max() <= limit[node]
        row, found, tried = best_first(docs, tree, terms, weights, 10, 0)
        assert np.sort(found)[::-1][:10].tolist() == np.sort(score)[::-1][:10].tolist()
        assert set(np.flatnonzero(score >= np.sort(score)[-10])) <= set(row.tolist())
        scored.append(tried / 1500)
    assert np.mean(scored) < 0.5
