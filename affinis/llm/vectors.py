"""Helpers of the vector searches: usable rows, blocks of bounded size, best results per query."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import written_and_measured

BLOCK = 4096  # rows that are searched together
ASKED = 512  # queries that search a block together


def usable(df: DataFrame, id: str, vec: str, asked: Column, nonzero: bool = False) -> tuple[DataFrame, int]:
    """``_id``, ``_vec``, ``_row``, ``_asked`` of the rows that take part, written; and their number.

    Left out are vectors that are null or empty or hold a null or non-finite component, zero
    vectors if ``nonzero``, and vectors whose length is not the most frequent one of the table
    (of equally frequent ones the longest).
    """
    v = F.col("_vec")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if nonzero:
        sound &= F.exists(v, lambda x: x != 0)
    rows = df.select(
        F.col(f"`{id}`").cast("long").alias("_id"),
        F.col(f"`{vec}`").alias("_vec"),
        F.coalesce(asked, F.lit(False)).alias("_asked"),
    ).where(v.isNotNull() & (F.size(v) > 0) & F.coalesce(sound, F.lit(False)))
    held, facts = written_and_measured(
        rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_dim", F.size("_vec")),
        "vectors",
        F.count(F.lit(1)).alias("rows"),
        F.min("_dim").alias("least"),
        F.max("_dim").alias("most"),
    )
    if facts["rows"] and facts["least"] != facts["most"]:
        by_length = held.groupBy("_dim").count().orderBy(F.desc("count"), F.desc("_dim")).first()
        return held.where(F.col("_dim") == by_length["_dim"]).drop("_dim"), by_length["count"]
    return held.drop("_dim"), facts["rows"] or 0


def parts_of(rows: Column | str, count: int, size: int) -> Column:
    """A part from 0 on for each row, so that parts have about ``size`` rows."""
    return F.pmod(F.xxhash64(rows, F.lit(7)), F.lit(max(1, -(-count // size)))).cast("int")


def matrix(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """The vectors of an Arrow list column, one to a row."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def ids_of(column: pa.ChunkedArray) -> np.ndarray:
    """Ids as int64; a null id sorts last."""
    return column.fill_null(np.iinfo(np.int64).max).to_numpy()


Search = Callable[[pa.Table, pa.Table], pa.Table]


def searched(rows: DataFrame, queries: DataFrame, keys: list[str], search: Search, score: str) -> DataFrame:
    """``search`` on each pair of a block of ``rows`` and the ``queries`` with the same ``keys``.

    Both sides come from one written table. The queries get attributes of their own by being renamed
    and named back: else column pruning, when a consumer drops columns, cannot tell the sides apart.
    """
    renamed = queries.select(*[F.col(c).alias(f"{c}_asked") for c in queries.columns])
    queries = renamed.select(*[F.col(f"{c}_asked").alias(c) for c in queries.columns])
    fields = f"_query long, query_id long, vec_id long, score {score}"
    return rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(search, fields)


def found_table(query: list, query_id: list, vec_id: list, score: list, kind: pa.DataType) -> pa.Table:
    """The result of a search from one array per query; the sentinel of a null id becomes null."""
    def joined(parts: list, dtype: type) -> np.ndarray:
        return np.concatenate(parts).astype(dtype) if parts else np.zeros(0, dtype)

    none = np.iinfo(np.int64).max
    ids = joined(vec_id, np.int64)
    return pa.table(
        {
            "_query": pa.array(joined(query, np.int64)),
            "query_id": pa.array(joined(query_id, np.int64)),
            "vec_id": pa.array(ids, mask=ids == none),
            "score": pa.array(joined(score, kind.to_pandas_dtype()), kind),
        }
    )


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query from the best of every block, ties to the smaller id."""
    best = Window.partitionBy("_query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "vec_id", "score")

