"""Jobs from raw table to neighbours, matches and annotations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.encode import Encoders, EncoderSpec, embed_and_combine, embed_columns
from ..operators.keys import with_composite_key
from ..operators.matching import Matches, annotated, match
from ..operators.numbering import numbered
from ..operators.profile import embed_candidates, likely_key, profile
from ..operators.topk import neighbours
from ..settings import (
    COMPOSITE_KEY,
    DEFAULT_DECIMALS,
    DEFAULT_MATCH_THRESHOLD,
    DEFAULT_METRIC,
    DEFAULT_TOP_K,
    ROW_ID,
)
from ..sources.tables import require_columns, vector_column
from ..sources.vector_table import VectorTable
from ..workspace import written
from .presets import find_preset

ROW_VECTOR = "_row_vector"
ROW_KEY = "_row_key"


@dataclass(frozen=True)
class Selection:
    """The key and the text columns a job works with."""

    key: str
    embed: list[str]


def selection(
    df: DataFrame, order: str, key: str | None = None, embed: list[str] | None = None
) -> Selection:
    """Chosen or detected columns: the first unique column is the key, text columns are embedded."""
    if key is None or embed is None:
        facts = profile(df, order)
        key = key or likely_key(facts) or ROW_ID
        embed = embed or [c for c in embed_candidates(facts) if c != key]
    require_columns(df, [*embed, *([key] if key != ROW_ID else [])])
    if not embed:
        raise ValueError("No column to embed was found.")
    return Selection(key, embed)


def nearest_rows(
    df: DataFrame,
    order: str,
    key: str | None = None,
    embed: list[str] | None = None,
    model: str | None = None,
    metric: str = DEFAULT_METRIC,
    top_k: int = DEFAULT_TOP_K,
    decimals: int = DEFAULT_DECIMALS,
    threshold: float | None = None,
    *,
    encoder: Encoders,
) -> DataFrame:
    """Profile, pick a key, embed and combine the text columns, find the nearest rows.

    ``order`` is a unique column that numbers the rows; without any unique column to serve as
    key the rows are known by that number.
    """
    chosen = selection(df, order, key, embed)
    rows = with_row_ids(df, order, chosen)
    combined = embed_and_combine(rows, chosen.embed, ROW_VECTOR, encoder, model)
    # Written once, so the encoder does not run again in a later stage.
    vectors = written(combined.select(ROW_ID, ROW_KEY, ROW_VECTOR), "vectors")
    return neighbours(
        vectors, ROW_ID, ROW_VECTOR, ROW_KEY, metric, top_k, decimals, threshold
    )


def with_row_ids(df: DataFrame, order: str, chosen: Selection) -> DataFrame:
    """The columns a job needs, with a LONG row id in ``order`` and the key as text.

    An integral ``order`` serves as the id itself; only another type costs a numbering, and so
    does a table without a key.
    """
    named = chosen.key != ROW_ID
    needed = dict.fromkeys([order, *([chosen.key] if named else []), *chosen.embed])
    narrow = df.select(*[F.col(f"`{c}`") for c in needed])
    if named and isinstance(df.schema[order].dataType, T.IntegralType):
        rows = narrow.withColumn(ROW_ID, F.col(f"`{order}`").cast("long"))
    else:
        rows = numbered(narrow, [order], ROW_ID)
    return rows.withColumn(ROW_KEY, F.col(f"`{chosen.key}`").cast("string"))


def embedded_neighbours(
    df: DataFrame,
    id: str,
    key: str,
    metric: str = DEFAULT_METRIC,
    top_k: int = DEFAULT_TOP_K,
    decimals: int = DEFAULT_DECIMALS,
    threshold: float | None = None,
) -> DataFrame:
    """Neighbours by the embedding column of ``key``."""
    return neighbours(df, id, f"`{vector_column(df, key)}`", key, metric, top_k, decimals, threshold)


def composed(
    df: DataFrame,
    columns: list[str],
    strategy: str = "concatenate",
    separator: str = " ",
    encoder: EncoderSpec | None = None,
) -> DataFrame:
    """A composite key, embedded as well where an encoder is given."""
    keyed = with_composite_key(df, columns, strategy, separator)
    if strategy != "concatenate" or encoder is None:
        return keyed
    return embed_columns(keyed, [COMPOSITE_KEY], encoder)


def stored_table(
    spark: SparkSession,
    df: DataFrame,
    path: str,
    key: str,
    embed: list[str],
    order: str,
    encoder: EncoderSpec,
) -> VectorTable:
    """A new vector table filled from ``df``, tied to the encoder that makes its vectors."""
    require_columns(df, [key, *embed])
    table = VectorTable.create(spark, path, encoder.name, encoder.dim, key, embed)
    table.add(df, order, encoder)
    return table


@dataclass(frozen=True)
class Deduplicated:
    table: VectorTable
    matches: Matches
    annotated: DataFrame


def dedup_table(
    spark: SparkSession,
    df: DataFrame,
    path: str,
    key: str,
    embed: list[str],
    order: str,
    encoder: EncoderSpec,
    threshold: float = DEFAULT_MATCH_THRESHOLD,
    decimals: int = DEFAULT_DECIMALS,
    lists: bool = True,
) -> Deduplicated:
    """Store a table, match its rows and annotate it with the groups they form."""
    table = stored_table(spark, df, path, key, embed, order, encoder)
    matches = table.match(threshold, decimals, list_pairs=lists)
    return Deduplicated(table, matches, annotated(df, key, matches, lists))


def preset_matches(
    df: DataFrame,
    preset: str,
    order: str,
    encoder: Encoders,
    threshold: float | None = None,
    decimals: int = DEFAULT_DECIMALS,
    list_pairs: bool = False,
) -> Matches:
    """Matches of a table with a preset's columns, its text columns averaged per row."""
    chosen = find_preset(preset)
    require_columns(df, [chosen.key, *chosen.embed])
    rows = with_row_ids(df, order, Selection(chosen.key, list(chosen.embed)))
    combined = embed_and_combine(rows, list(chosen.embed), ROW_VECTOR, encoder, chosen.model)
    vectors = written(combined.select(ROW_ID, ROW_KEY, ROW_VECTOR), "vectors")
    bound = chosen.threshold if threshold is None else threshold
    return match(vectors, ROW_ID, ROW_VECTOR, ROW_KEY, bound, decimals, list_pairs)
