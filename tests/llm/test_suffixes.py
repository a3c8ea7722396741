import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from affinis.llm.induced import Disk, repeated_places
from affinis.llm.suffixes import pieces, without_repeats


def plain_places(texts, length):
    seen = defaultdict(list)
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]].append((i, p))
    out = [[] for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                out[i].append(p)
    return [sorted(p) for p in out]


def plain_rows(texts, length):
    rows = []
    for t, at in zip(texts, plain_places(texts, length), strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for p in at:
            gone[p : p + length] = True
        gone[len(t)] = False
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[: len(t)]).sum()) if len(t) else 0
        rows.append((len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return rows


def made_texts(dice, count, letters):
    texts = []
    for _ in range(count):
        t = bytes(dice.randrange(97, 97 + letters) for _ in range(dice.choice([0, 1, 3, 40, 200])))
        if texts and dice.random() < 0.6:
            other = dice.choice(texts)
            first = dice.randint(0, len(other))
            t += other[first : first + dice.randint(0, 60)] + t[:9]
        texts.append(t)
    return texts


@pytest.mark.parametrize("rows,chunk,base", [(8, 3, 0), (64, 16, 2), (10**6, 1 << 16, 10), (10**6, 1 << 16, 10**6)])
def test_induced_order_against_all_strings(tmp_path, rows, chunk, base):
    dice = random.Random(rows + base)
    for _ in range(25):
        texts = made_texts(dice, dice.randint(1, 5), dice.choice([1, 2, 3, 20]))
        length = dice.choice([1, 2, 5, 12, 40])
        disk = Disk(tmp_path.as_uri(), rows)
        got = [g.tolist() for g in repeated_places(texts, length, disk, chunk, base)]
        disk.close()
        assert got == plain_places(texts, length)
    assert not list(tmp_path.iterdir())  # nothing stays on disk


def test_equal_strings_lie_in_pieces_of_one_gram():
    dice = random.Random(3)
    texts = made_texts(dice, 12, 3)
    gram_of = {}
    for t in texts:
        first, count, gram, many = pieces(t, 16, 4)
        assert (first[1:] == first[:-1] + count[:-1]).all() and count.sum() == max(0, len(t) - 15)
        for a, n, g, several in zip(first.tolist(), count.tolist(), gram.tolist(), many.tolist(), strict=True):
            strings = [t[p : p + 16] for p in range(a, a + n)]
            assert all(gram_of.setdefault(s, g) == g for s in strings)
            assert several or len(set(strings)) == n


@pytest.mark.parametrize("shard_bytes", [1 << 20, 400, 1])
def test_documents_against_all_strings(spark, shard_bytes):
    dice = random.Random(5)
    texts = made_texts(dice, 60, 4) + [b"a" * 500, b"", b"b" * 23, "été ".encode() * 30]
    passage = bytes(dice.randrange(97, 123) for _ in range(70))
    texts += [bytes(dice.randrange(97, 123) for _ in range(20)) + passage + bytes(dice.randrange(97, 123) for _ in range(20)) for _ in range(30)]
    texts += [texts[-1]] * 3
    rows = [(i, t.decode(), "x", 7) for i, t in enumerate(texts)] + [(900, None, "x", 7), (None, "b" * 25, "x", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text string, n_bytes int").repartition(5)
    whole = texts + [b"", b"b" * 25]
    want = sorted(map(str, zip([r[0] for r in rows], *zip(*plain_rows(whole, 24), strict=True), strict=True)))
    got = without_repeats(df, "text", 24, ["doc_id", "n_bytes"], shard_bytes=shard_bytes, tuples=64)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
    found = got.collect()
    assert sorted(str(tuple(r[:5])) for r in found) == want
    for r in found:
        text = whole[[x[0] for x in rows].index(r["doc_id"])]
        inside = b"".join(text[s["start"] : s["end"]] for s in r["spans"])
        assert len(inside) == r["n_removed"] and hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
    assert without_repeats(df.limit(0), "text", 24, ["doc_id"]).count() == 0
