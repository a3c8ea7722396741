"""Composite keys: joined text, or a mean of vector columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import joined_text
from ..functions.vectors import mean_vector, weighted_vector
from ..settings import COMPOSITE_KEY, VECTOR_PREFIX

STRATEGIES = ("concatenate", "average", "weighted-average")


def weighted_columns(specs: list[str]) -> dict[str, float]:
    """Column weights from ``name`` or ``name:weight``, split on the last colon."""
    weights: dict[str, float] = {}
    for spec in specs:
        name, colon, number = spec.rpartition(":")
        if not colon:
            weights[spec] = 1.0
            continue
        try:
            weights[name] = float(number)
        except ValueError:
            raise ValueError(f"'{number}' is no weight for column '{name}'.") from None
        if not 0 <= weights[name] < float("inf"):
            raise ValueError(f"The weight of column '{name}' must be a number of at least 0.")
    return weights


def composite_key(
    df: DataFrame, columns: list[str], strategy: str = "concatenate", separator: str = " "
) -> Column:
    """The key as a column of text (concatenate) or a vector (average strategies)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"Unknown strategy '{strategy}'. Valid: {', '.join(STRATEGIES)}")
    if strategy == "concatenate":
        return joined_text([F.col(f"`{c}`") for c in columns], separator)
    weights = weighted_columns(columns) if strategy == "weighted-average" else dict.fromkeys(columns, 1.0)
    vectors = [f"{VECTOR_PREFIX}{c}" for c in weights]
    missing = [v for v in vectors if v not in df.columns]
    if missing:
        raise ValueError(f"Embedding column not found: {', '.join(missing)}. Embed these columns first.")
    cols = [F.col(f"`{v}`") for v in vectors]
    if strategy == "average":
        return mean_vector(cols)
    return weighted_vector(cols, list(weights.values()))


def with_composite_key(
    df: DataFrame, columns: list[str], strategy: str = "concatenate", separator: str = " "
) -> DataFrame:
    """``df`` with the composite key.

    Text goes to ``_composite_key``; a vector goes where the neighbour search looks for it, and
    the text key beside it names the row.
    """
    key = composite_key(df, columns, strategy, separator)
    if strategy == "concatenate":
        return df.withColumn(COMPOSITE_KEY, key)
    names = list(weighted_columns(columns)) if strategy == "weighted-average" else columns
    named = F.lit(None).cast("string")
    if set(names) <= set(df.columns):
        named = joined_text([F.col(f"`{c}`") for c in names], separator)
    return df.withColumn(f"{VECTOR_PREFIX}{COMPOSITE_KEY}", key.cast("array<float>")).withColumn(COMPOSITE_KEY, named)
