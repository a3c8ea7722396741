"""Scores of named pairs of records, and the distribution of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..settings import DEFAULT_DECIMALS
from .lookup import attach


def compared(
    df: DataFrame,
    key: str,
    vec: str,
    pairs: DataFrame,
    order: str,
    decimals: int = DEFAULT_DECIMALS,
) -> DataFrame:
    """All four metrics for every pair of ``pairs`` (key_a, key_b).

    A key stands for its first row by ``order``. An unknown key and the cosine of a zero vector
    are errors.
    """
    asked = pairs.select(F.col("key_a").cast("string"), F.col("key_b").cast("string"))
    ends = asked.select(F.explode(F.array("key_a", "key_b")).alias("_k")).distinct()
    keyed = df.select(F.col(key).cast("string").alias("_k"), F.col(vec).alias("_v"), F.col(order).alias("_o"))
    # Only the asked keys are kept, and a key with many rows combines on the map side.
    firsts = (
        keyed.join(ends, "_k", "left_semi")
        .groupBy("_k")
        .agg(F.min_by(F.struct("_v"), "_o").alias("_s"))
        .select("_k", F.col("_s._v").alias("_v"))
    )

    def named(end: str) -> DataFrame:
        return firsts.select(F.col("_k").alias(f"key_{end}"), F.col("_v").alias(f"_v{end}"))

    both = attach(attach(asked, named("a"), ["key_a"]), named("b"), ["key_b"])

    def known(end: str):
        message = F.concat(F.lit("Key not found: "), F.col(f"key_{end}"))
        missing = F.raise_error(message).cast("array<double>")
        return F.when(F.col(f"_v{end}").isNull(), missing).otherwise(V.doubles(f"_v{end}"))

    scored = both.select("key_a", "key_b", known("a").alias("a"), known("b").alias("b"))
    return scored.select(
        "key_a",
        "key_b",
        F.round(V.cosine("a", "b"), decimals).alias("cosine"),
        F.round(V.euclidean("a", "b"), decimals).alias("euclidean"),
        F.round(V.manhattan("a", "b"), decimals).alias("manhattan"),
        F.round(V.dot("a", "b"), decimals).alias("dot"),
    )


def score_stats(scores: DataFrame, score: str = "score") -> DataFrame:
    """mean, median, std, min, max of rounded scores.

    Rounded scores repeat, so they are counted first; the exact median is then taken from the
    counts and its state is bounded by the number of distinct scores.
    """
    counts = scores.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    rows, mean = F.sum("n"), F.sum(F.col("s") * F.col("n")) / F.sum("n")
    squares = F.sum(F.col("n") * F.col("s") * F.col("s"))
    # Rounding may leave a tiny negative spread where all scores are equal.
    spread = F.greatest(squares - rows * mean * mean, F.lit(0.0))
    return counts.agg(
        mean.alias("mean"),
        F.percentile("s", 0.5, F.col("n")).alias("median"),
        F.when(rows > 1, F.sqrt(spread / (rows - 1))).alias("std"),
        F.min("s").alias("min"),
        F.max("s").alias("max"),
    )
