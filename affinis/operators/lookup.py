"""Attach a table with unique keys to a table whose keys may be heavily skewed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import written_and_measured

HOT_ROWS = 200_000  # rows of a key that one task takes
HOT_KEYS = 500_000  # most keys that are split; beyond it a task takes more rows


def hot_shares(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """``key`` and ``_shares``, the tasks it is split over, of every key with many rows, if any.

    The count combines on the map side, so a hot key costs one row per input partition, and there
    are at most rows / ``hot_rows`` hot keys.
    """
    counts, facts = written_and_measured(
        df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows")),
        "loads",
        F.sum("_rows").alias("rows"),
        F.max("_rows").alias("widest"),
    )
    limit = max(hot_rows, (facts["rows"] or 0) // HOT_KEYS)
    if (facts["widest"] or 0) <= limit:
        return None
    return counts.where(F.col("_rows") > limit).select(key, F.ceil(F.col("_rows") / limit).cast("int").alias("_shares"))


def attach(
    big: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    widest: int | None = None,
) -> DataFrame:
    """``big`` joined to ``lookup`` (one row per key) without sending a hot key to one task.

    The rows of a hot first key column are dealt into shares by their hash, and its lookup row is
    copied into each share. Only the names of the hot keys are broadcast. ``widest`` is the largest
    number of rows of one key where the caller knows it.
    """
    skew = on[0]
    shares = None if widest is not None and widest <= hot_rows else hot_shares(big, skew, hot_rows)
    if shares is None:
        return big.join(lookup, on, how)
    many = F.coalesce("_shares", F.lit(1))
    place = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), many).cast("int")
    spread = big.join(F.broadcast(shares), skew, "left").withColumn("_share", place).drop("_shares")
    copies = lookup.join(F.broadcast(shares), skew, "left")
    copies = copies.withColumn("_share", F.explode(F.sequence(F.lit(0), many - 1))).drop("_shares")
    return spread.join(copies, [*on, "_share"], how).drop("_share")
