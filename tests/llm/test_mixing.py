import re
from collections import defaultdict
from math import gcd

from affinis.llm.mixing import Mix, golden_step, mixed_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    names = sorted((n for n in sizes if n is not None), key=lambda n: [ord(c) for c in n]) + [n for n in sizes if n is None]
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, rest, open_names = {}, share * sum(sizes.values()), set(names)
    while open_names:
        level = rest / sum(weight[n] for n in open_names)
        over = {n for n in open_names if level * weight[n] > cap * sizes[n]}
        if not over:
            target |= {n: level * weight[n] for n in open_names}
            break
        target |= {n: float(cap * sizes[n]) for n in over}
        rest -= sum(cap * sizes[n] for n in over)
        open_names -= over
    return target


def check(rows, mix):
    sizes, source_of = defaultdict(int), {}
    for i, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
        source_of[i] = source
    target = plain_targets(sizes)
    got = mix.taken().collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        source = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[source]
        assert abs(r["target"] - target[source]) < 1e-6 * max(1, target[source])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    return got


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    first = check(rows, Mix(docs, "doc_id", "text", "source", block=64))
    again = Mix(docs.repartition(5), "doc_id", "text", "source", block=64).taken().collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_points_of_any_number_of_slots_are_even():
    for n in [1, 2, 3, 4, 6, 12, 60, 732, 1000, 30030, 65536, 99991]:
        step = golden_step(n)
        assert gcd(step, n) == 1 and (n < 3 or 0 < step < n)
        held = sorted(r * pow(step, -1, n) % n for r in range(n // 3)) if n > 3 else []
        assert all(abs(k - (slot + 1) * len(held) / n) < 4 for k, slot in enumerate(held))


def test_schedule_is_even_and_blocks_are_equal(spark):
    rows = [(i, "w " * (10 + i % 7), "abc"[i % 3]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = Mix(df, "doc_id", "text", "source", block=16)
    slots = sorted((r["slot"], r["sid"], r["block"]) for r in mix.slots().collect())
    assert [s for s, _, _ in slots] == list(range(mix.total))
    per = defaultdict(list)
    for slot, sid, block in slots:
        assert block == len(per[sid])
        per[sid].append(slot)
    for held in per.values():  # at any point of the schedule every source has its share, within a few slots
        for k, slot in enumerate(held):
            assert abs(k - (slot + 1) * len(held) / mix.total) < 4
    words = defaultdict(int)
    for r in mix.pieces().collect():
        words[r["sid"], r["block"]] += r["to_word"] - r["from_word"]
    last = {sid: len(h) - 1 for sid, h in per.items()}
    assert all(n == 16 or block == last[sid] for (sid, block), n in words.items())


def test_odd_rows(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (3, "", None), (4, "x\x0by z", None), (5, " ", "t"), (6, "w " * 5000, "é")]
    fields = "doc_id long, text string, source string, size int, _row string, target string, sid int"
    df = spark.createDataFrame([(*r, 1, "r", "t", 4) for r in rows], fields)
    check(rows, Mix(df, "doc_id", "text", "source", block=8))
    kept = mixed_documents(df, "doc_id", "text", "source", block=8)
    assert kept.columns == df.columns
    counts = defaultdict(int)
    for r in kept.collect():
        counts[r["doc_id"]] += 1
    assert not {2, 3, 5} & set(counts) and all(n <= (4 if i == 1 else 2) for i, n in counts.items())
    empty = df.limit(0)
    assert Mix(empty, "doc_id", "text", "source").taken().count() == 0
    assert mixed_documents(empty, "doc_id", "text", "source").count() == 0
    nothing = df.where("doc_id in (2, 3)")
    assert [r["taken"] for r in Mix(nothing, "doc_id", "text", "source").taken().collect()] == [0, 0]
