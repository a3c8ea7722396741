import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from affinis.llm.spelling import near_words, spelling_forms


def edited(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(rows):
    counts = Counter()
    for id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            mark = zlib.crc32(f"{'' if id is None else id}:{run}".encode())
            if mark % 31 == 0:
                run = run[: mark % len(run)] + run[mark % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if edited(w, v)] for w in words}
    form = {}
    for w, around in near.items():
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def test_forms_against_all_pairs(spark):
    dice = random.Random(2)
    stems = ["".join(dice.choice("abcdé") for _ in range(dice.randint(7, 11))) for _ in range(12)]

    def typo(w):
        at = dice.randrange(len(w))
        return dice.choice([w[:at] + w[at + 1 :], w[:at] + dice.choice("abz") + w[at:], w[:at] + dice.choice("abz") + w[at + 1 :], w, w.upper()])

    rows = [(i, " ".join(typo(dice.choice(stems)) for _ in range(60)) + "; short ünïcödé-Wörter") for i in range(60)]
    rows += [(1000, " ".join(stems[:3] * 400)), (1000, None), (None, "Überall " * 40 + "Uberall " * 3), (7, ""), (8, "x" * 3000 + " " + "x" * 3000 + " " + "x" * 2999 + " " + "x" * 2999)]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, n int, word string").repartition(4)
    got = spelling_forms(df, "doc_id", "text")
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = sorted(tuple(r) for r in got.collect())
    assert found == plain_forms(rows) and any(f[1] for f in found)
    assert spelling_forms(df.limit(0), "doc_id", "text").count() == 0
    assert spelling_forms(df.where("text = ''"), "doc_id", "text").count() == 0


def test_near_words_against_all_pairs(spark):
    dice = random.Random(4)
    words = sorted({"".join(dice.choice("ab") for _ in range(dice.randint(4, 9))) for _ in range(250)} | {"aaaa", "aaaaa", "aaaaaa"})
    df = spark.createDataFrame(list(enumerate(words)), "_wid long, word string")
    got = {(r["_wid"], r["_near"]) for r in near_words(df, 2).collect()}
    assert got == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if edited(a, b)}


def test_roots_follow_chains(spark):
    texts = [("aaaaaaa " * 2, 1), ("aaaaaab " * 20, 2), ("aaaaabb " * 200, 3), ("aaaabbb " * 2000, 4)]
    df = spark.createDataFrame([(i, t) for t, i in texts], "doc_id long, text string")
    rows = {r["word"]: r for r in spelling_forms(df, "doc_id", "text").collect()}
    assert plain_forms([(i, t) for t, i in texts]) == sorted(tuple(r) for r in rows.values())
    assert df.select(F.count("*")).first()[0] == 4
