"""Shards of near equal size by longest-processing-time scheduling.

Groups of equal texts must stay together. Sorted by size, each goes to the shard that has the least
so far, which a heap knows. The heap runs on the driver and sees a bounded number of units at any
size of the input: a group of at least 1/65,536 of all bytes is a unit of its own, so there are at
most 65,536 of those; all smaller groups are dealt by their hash into 65,536 bundles, each a
unit. The shards differ by at most the size of the last unit placed on the fullest one.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..workspace import written_and_measured

UNITS = 1 << 16
ROW_BYTES = 8  # counted for every row beside its text


def least_loaded(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unit: the largest first, each to the least loaded (then lowest) shard."""
    out = np.zeros(len(sizes), np.int32)
    heap = [(0, s) for s in range(shards)]
    for unit in np.argsort(-sizes, kind="stable").tolist():
        load, shard = heap[0]
        out[unit] = shard
        heapq.heapreplace(heap, (load + int(sizes[unit]), shard))
    return out


def balanced_shards(df: DataFrame, id: str, text: str, shards: int, units: int = UNITS) -> DataFrame:
    """``id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` of every row.

    ``size`` is the UTF-8 length of the text plus 8; ``law`` is ``bytes``, so ``grown_shard`` is null.
    Equal texts share a shard; ``slot`` numbers the rows of a shard from 0 in the order of the id.

    A null text has size 8 and a null checksum, and null texts form a group of their own. Rows
    without an id come first in their shard; repeated rows each get a slot. Other columns are
    ignored. An empty table gives an empty result.
    """
    content = F.col("_content")
    rows, facts = written_and_measured(
        df.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_content")).select(
            "_id",
            (F.coalesce(F.octet_length(content), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
            F.crc32(content.cast("binary")).alias("text_crc32"),
            # Different texts that share a hash share a shard as well, which no rule forbids.
            F.xxhash64(content, content.isNull()).alias("_group"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "sized",
        F.sum("size").alias("bytes"),
    )
    least = -(-(facts["bytes"] or 0) // units)
    bundle = F.pmod(F.xxhash64(F.col("_group"), F.lit(1)), F.lit(units))
    alone = F.col("bytes") >= least
    groups = rows.groupBy("_group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    placed = (
        groups.groupBy(alone.alias("alone"), F.when(alone, F.col("_group")).otherwise(bundle).alias("unit"))
        .agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        .toArrow()
        .sort_by([("alone", "ascending"), ("unit", "ascending")])
    )
    shard = least_loaded(placed["bytes"].to_numpy(), shards)
    counts = np.bincount(shard, weights=placed["rows"].to_numpy(), minlength=shards).astype(np.int64)
    starts = np.cumsum(counts) - counts
    spark = df.sparkSession
    units_of = spark.createDataFrame(placed.select(["alone", "unit"]).append_column("shard", pa.array(shard, pa.int32())))
    single = units_of.where("alone").select(F.col("unit").alias("_group"), F.col("shard").alias("_own"))
    shared = units_of.where("not alone").select(F.col("unit").alias("_bundle"), F.col("shard").alias("_with"))
    dealt = (
        rows.join(F.broadcast(single), "_group", "left")
        .withColumn("_bundle", F.when(F.col("_own").isNull(), bundle))
        .join(F.broadcast(shared), "_bundle", "left")
        .select("_id", "size", "text_crc32", "_row", F.coalesce("_own", "_with").alias("shard"))
    )
    first = F.element_at(F.array(*[F.lit(int(s)) for s in starts]), F.col("shard") + 1)
    ordered = numbered(dealt, ["shard", "_id", "_row"], "_no", start=0)
    return ordered.select(
        F.col("_id").alias(id),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_no") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
