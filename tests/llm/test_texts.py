"""Portions of texts: what is derived from a portion leaves the worker before the next one."""

import pyarrow as pa

from affinis.llm.texts import by_portion

MADE = 1 << 20  # bytes that are derived from each portion


def test_derived_columns_do_not_gather_in_the_worker(spark):
    rows = [(i, None if i == 5 else f"{i:010d}") for i in range(64)]

    def made(texts):
        held = pa.total_allocated_bytes()
        return {"held": pa.array([held] * len(texts), pa.int64()), "long": pa.array([(t * MADE)[:MADE] for t in texts], pa.string())}

    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    got = by_portion(df, "text", made, "held long, long string", ["id"], limit=10).selectExpr("id", "held", "left(long, 10) text", "length(long) size").collect()
    assert [(r["id"], r["text"] or None) for r in got] == rows
    assert all(r["size"] == (MADE if r["text"] else 0) for r in got)
    assert max(r["held"] for r in got) < 8 * MADE


def test_no_rows(spark):
    df = spark.createDataFrame([], "id long, text string")
    made = by_portion(df, "text", lambda texts: {"n": pa.array([len(t) for t in texts], pa.int64())}, "n long", ["id"])
    assert made.columns == ["id", "n"] and made.collect() == []
