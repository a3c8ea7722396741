"""Collapse rows that hold the same vector, so copies are scored once.

A group of copies may hold a third of all rows. The pair operators work on distinct vectors
only and bring the copies back at the end, where the output itself needs them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookup import attach

ID, KEY, VEC, PRINT, REP = "_id", "_key", "_vec", "_print", "_rep"


def records(df: DataFrame, id: str, key: str | None, vec: str) -> DataFrame:
    """The three columns the operators need, with a fingerprint of the vector.

    The fingerprint is the SHA-256 of the vector's exact text, so copies meet on 32 bytes and
    the vectors themselves are neither compared nor shuffled a second time. Rows without a
    vector have no score and take no part; a missing or non-finite component is an error.
    """
    whole = F.col(vec)
    told = F.concat(F.lit("The vector of row "), F.col(id).cast("string"), F.lit(" has a component that is missing or not finite."))
    broken = F.exists(whole, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.when(broken, F.raise_error(told).cast(df.select(whole).schema[0].dataType)).otherwise(whole)
    digest = F.unhex(F.sha2(F.col(vec).cast("string").cast("binary"), 256))
    cols: list[Column] = [
        F.col(id).cast("long").alias(ID),
        F.col(key or id).cast("string").alias(KEY),
        whole.alias(VEC),
        digest.alias(PRINT),
    ]
    return df.where(F.col(vec).isNotNull()).select(*cols)


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """One row per distinct vector: its lowest id, that row's key, and the number of copies."""
    first = F.min(F.struct(ID, KEY, VEC))
    return (
        rows.groupBy(PRINT)
        .agg(first.alias("_first"), F.count(F.lit(1)).alias("_copies"))
        .select(
            PRINT,
            F.col("_first")[VEC].alias(VEC),
            F.col("_first")[ID].alias(REP),
            F.col("_first")[KEY].alias(KEY),
            "_copies",
        )
    )


def distinct_with_members(rows: DataFrame, members: int) -> DataFrame:
    """One row per distinct vector with its ``members`` lowest ids and their keys.

    The rank limit is applied before the shuffle as well as after it, so a hot vector ships
    ``members`` rows per partition and never all of its copies.
    """
    by_id = Window.partitionBy(PRINT).orderBy(ID)
    low = rows.withColumn("_nth", F.row_number().over(by_id)).where(F.col("_nth") <= members)
    # The same partitioning and order as above: no further shuffle or sort.
    onward = by_id.rowsBetween(Window.currentRow, members - 1)
    held = low.withColumn("_held", F.collect_list(F.struct(ID, KEY)).over(onward))
    return held.where(F.col("_nth") == 1).select(
        PRINT,
        VEC,
        F.col(ID).alias(REP),
        KEY,
        F.col("_held")[ID].alias("_ids"),
        F.col("_held")[KEY].alias("_keys"),
    )


def members(rows: DataFrame, distinct: DataFrame, most_copies: int) -> DataFrame:
    """Every row with the representative of its vector and the number of its copies."""
    found = attach(
        rows.select(ID, KEY, PRINT), distinct.select(PRINT, REP, "_copies"), [PRINT], "inner", widest=most_copies
    )
    return found.select(ID, KEY, REP, "_copies")
