import re
from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

from affinis.llm.simhash import fingerprints_of, near_fingerprints, simhash_groups, simhash_kept


def plain_fingerprint(text, words=3):
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, max_bits):
    """{id: (fingerprint, smallest id reachable)} from all pairs."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = list(prints)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= max_bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (f"{prints[i]:016x}", find(i)) for i in prints}


def test_fingerprints_follow_the_definition():
    texts = ["", " \t\n", "One", "one two", "One TWO three", "a b c d a b c d", "ÄÖ ÉÉ x\x0by\x1cz w q", "x " * 3000]
    assert fingerprints_of(texts).tolist() == [plain_fingerprint(t) for t in texts]


def test_shingle_hash_is_the_one_spark_has(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("one two three")).alias("h")).first()
    assert row["h"] % (1 << 64) == xxhash.xxh64_intdigest(b"one two three", 42)


def test_documents_against_all_pairs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    prints = {r["doc_id"]: plain_fingerprint(r["text"] or "") for r in rows.collect()}
    want = plain_components(prints, 2)
    for crowd in (1,):
        got = simhash_groups(rows, "doc_id", "text", crowd=crowd).collect()
        assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want


def test_links_of_scattered_fingerprints(spark):
    import random

    dice = random.Random(3)
    prints = []
    for _ in range(60):
        base = dice.getrandbits(64)
        for _ in range(6):
            f = base
            for b in dice.sample(range(64), dice.choice([0, 1, 2, 3])):
                f ^= 1 << b
            prints.append(f)
    distinct = sorted(set(prints))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in distinct]
    df = spark.createDataFrame(signed, "_fp long")
    for bits, ways in ((0, [(64, 5)]), (1, [(1, 5)]), (2, [(64, 5), (1, 5), (3, 7)])):
        for crowd, segments in ways:
            edges = {(r[0] % (1 << 64), r[1] % (1 << 64)) for r in near_fingerprints(df, bits, segments, crowd).collect()}
            assert all((a ^ b).bit_count() <= bits for a, b in edges)
            assert groups_of(distinct, edges) == groups_of(
                distinct, {(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= bits}
            )


def groups_of(nodes, edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    seen, out = set(), set()
    for n in nodes:
        if n in seen:
            continue
        group, todo = set(), [n]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo.extend(near[x] - group)
        seen |= group
        out.add(frozenset(group))
    return out


def test_odd_rows(spark):
    fields = "doc_id long, text string, fingerprint string, _fp long, component_id int"
    rows = [(3, None, "x", 1, 1), (2, "", None, None, None), (9, "a b c d", "y", 2, 2), (9, "a b c d", "y", 2, 2),
            (None, "a b c d", "n", 3, 3), (None, "only here alone", "n", 3, 3)]
    df = spark.createDataFrame(rows, fields)
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash_groups(df, "doc_id", "text").collect())
    assert got == [(-1, -1), (-1, 9), (2, 2), (3, 2), (9, 9), (9, 9)]
    kept = simhash_kept(df, "doc_id", "text")
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 2, 9]
    empty = df.limit(0)
    assert simhash_groups(empty, "doc_id", "text").count() == 0
    assert simhash_kept(empty, "doc_id", "text").count() == 0


def test_a_crowd_of_near_copies(spark):
    words = " ".join(f"w{i}" for i in range(400))
    rows = [(i, words + f" end{i}") for i in range(300)] + [(1000 + i, words) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {i: plain_fingerprint(t) for i, t in rows}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_groups(df, "doc_id", "text").collect()}
    assert got == plain_components(prints, 2)
