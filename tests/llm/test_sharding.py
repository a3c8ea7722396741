import heapq
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from affinis.llm.sharding import balanced_shards, least_loaded


def plain_lpt(sizes, shards):
    heap = [(0, s) for s in range(shards)]
    out = {}
    for key, size in sorted(sizes.items(), key=lambda x: -x[1]):
        load, shard = heapq.heappop(heap)
        out[key] = shard
        heapq.heappush(heap, (load + size, shard))
    loads = [load for load, _ in heap]
    return out, max(loads) - min(loads)


def check(rows, got, shards):
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    shard_of_text, slots, loads = {}, defaultdict(list), np.zeros(shards)
    for doc_id, text in rows:
        r = by_id[doc_id].pop()
        assert r["size"] == len((text or "").encode()) + 8
        assert r["text_crc32"] == (None if text is None else zlib.crc32(text.encode()))
        assert r["law"] == "bytes" and r["grown_shard"] is None
        assert shard_of_text.setdefault(text, r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert not any(by_id.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return loads


def test_heap_takes_the_least_loaded():
    sizes = {k: s for k, s in enumerate([7, 7, 6, 6, 5, 5, 4, 4, 4])}
    want, gap = plain_lpt(sizes, 4)
    got = least_loaded(np.array(list(sizes.values())), 4)
    loads = np.bincount(got, weights=list(sizes.values()))
    assert loads.max() - loads.min() == gap


def test_documents_are_balanced_as_by_plain_scheduling(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    loads = check(rows, balanced_shards(docs, "doc_id", "text", 24).collect(), 24)
    sizes = defaultdict(int)
    for _, text in rows:
        sizes[text] += len(text.encode()) + 8
    _, gap = plain_lpt(sizes, 24)
    assert loads.max() - loads.min() <= max(gap, 0.01 * loads.mean())


def test_bundles_keep_shards_near_equal(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id % 97 as int)) || (id div 2)").alias("text"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    loads = check(rows, balanced_shards(docs, "doc_id", "text", 5, units=500).collect(), 5)
    assert loads.max() - loads.min() < 0.02 * loads.mean()


def test_odd_rows_and_a_third_of_copies(spark):
    rows = [(i, "copy") for i in range(40)] + [(100 + i, f"text {i}" * i) for i in range(60)]
    rows += [(507, None), (507, None), (None, ""), (None, ""), (508, "")]
    df = spark.createDataFrame([(a, b, 1, 2, 3, "k") for a, b in rows], "doc_id long, text string, size int, _row long, shard int, _group string")
    check(rows, balanced_shards(df, "doc_id", "text", 3).collect(), 3)
    check(rows, balanced_shards(df, "doc_id", "text", 300).collect(), 300)
    assert balanced_shards(df.limit(0), "doc_id", "text", 3).count() == 0
