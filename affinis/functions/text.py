"""Text column builders: joined keys, the formula guard, model routing by column name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..settings import DEFAULT_MODEL, ROUTING_WORDS

# Fixed value: first characters a spreadsheet would read as a formula.
FORMULA_START = r"^[=+\-@\t\r]"


def as_text(c: Column | str) -> Column:
    """A value as text, a missing one as the empty string."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def joined_text(columns: list[Column | str], separator: str = " ") -> Column:
    """Columns joined by a separator that is kept around missing values."""
    if not columns:
        raise ValueError("At least one column is needed.")
    return F.concat_ws(separator, *[as_text(c) for c in columns])


def formula_safe(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(FORMULA_START), F.concat(F.lit("'"), c)).otherwise(c)


def formula_safe_table(df: DataFrame) -> DataFrame:
    """Guard every string column; headers and other types stay as they are."""
    return df.select(
        *[
            formula_safe(f"`{f.name}`").alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def routed_model(name: Column) -> Column:
    """Model shortcut for a column name."""
    lowered = F.lower(name)
    choice = F.lit(DEFAULT_MODEL)
    for model, words in reversed(ROUTING_WORDS.items()):
        choice = F.when(lowered.rlike("|".join(words)), F.lit(model)).otherwise(choice)
    return choice


def model_for(name: str) -> str:
    """Model shortcut for one column name known on the driver."""
    lowered = name.lower()
    hits = (m for m, words in ROUTING_WORDS.items() if any(w in lowered for w in words))
    return next(hits, DEFAULT_MODEL)
