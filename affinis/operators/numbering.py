"""Contiguous row numbers without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import ROW_ID
from ..workspace import few_rows, written


def numbered(df: DataFrame, order: list[str], name: str = ROW_ID, start: int = 1) -> DataFrame:
    """``numbered_and_counted`` without the count."""
    return numbered_and_counted(df, order, name, start)[0]


def numbered_and_counted(
    df: DataFrame, order: list[str], name: str = ROW_ID, start: int = 1
) -> tuple[DataFrame, int]:
    """``df`` with ``name`` = start, start + 1, ... in the order of unique columns ``order``.

    A range shuffle puts the rows in order across partitions; each row knows its place inside
    its partition, and the partition sizes (one row per partition) give the offsets. The order
    must be total, so ties need a further column.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = written(
        ordered.withColumn("_part", F.spark_partition_id()).withColumn("_at", place), "numbered"
    )
    sizes = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    offsets, before = [], start
    for row in sizes:
        offsets.append((row["_part"], before))
        before += row["n"]
    starts = few_rows(df.sparkSession, offsets, "_part int, _start long")
    rows = (
        marked.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_at"))
        .drop("_part", "_at", "_start")
    )
    return rows, before - start
