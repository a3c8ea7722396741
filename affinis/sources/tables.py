"""Tables in and out: contracts, the formula guard, run metadata and inventories."""

from __future__ import annotations

import difflib
from datetime import datetime
from functools import reduce
from pathlib import PurePosixPath

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import __version__
from ..functions.text import formula_safe_table
from ..functions.vectors import vector_to_json
from ..settings import VECTOR_PREFIX
from ..workspace import few_rows

FORMATS = ("parquet", "csv", "json", "orc")


def table_format(path: str, fmt: str | None = None) -> str:
    """The given format, or the one the extension names."""
    chosen = (fmt or PurePosixPath(path.rstrip("/")).suffix.lstrip(".")).lower()
    if chosen not in FORMATS:
        raise ValueError(f"Unsupported table format '{chosen}' for {path}. Valid: {', '.join(FORMATS)}")
    return chosen


def _opened(
    spark: SparkSession, path: str, fmt: str | None, schema: T.StructType | str | None
) -> DataFrame:
    chosen = table_format(path, fmt)
    reader = spark.read.format(chosen)
    if chosen == "csv":
        reader = reader.option("header", "true")
        if schema is None:
            reader = reader.option("inferSchema", "true")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def _condition(error: AnalysisException) -> str:
    return error.getCondition() or ""


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """A table that exists, has a known format and holds at least one row."""
    try:
        df = _opened(spark, path, fmt, schema)
    except AnalysisException as e:
        if _condition(e) == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"Table not found: {path}") from None
        if _condition(e) == "UNABLE_TO_INFER_SCHEMA":
            raise ValueError(f"The table holds no data rows: {path}") from None
        raise
    if df.isEmpty():
        raise ValueError(f"The table holds no data rows: {path}")
    return df


def require_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns, if the table has them all; else an error that names likely spellings."""
    there = set(df.columns)
    hints = {
        name: " or ".join(difflib.get_close_matches(name, there)) or "nothing alike"
        for name in columns
        if name not in there
    }
    if hints:
        told = "; ".join(f"{name!r} (there is {hint})" for name, hint in hints.items())
        raise ValueError(f"The table lacks {told}. It has: {', '.join(df.columns)}")
    return columns


def vector_columns(df: DataFrame) -> list[str]:
    """Embedding columns, by name prefix and array type."""
    return [
        f.name
        for f in df.schema.fields
        if f.name.startswith(VECTOR_PREFIX) and isinstance(f.dataType, T.ArrayType)
    ]


def vector_column(df: DataFrame, column: str) -> str:
    """Name of the embedding column of ``column``."""
    name = f"{VECTOR_PREFIX}{column}"
    if name not in vector_columns(df):
        raise ValueError(f"Embedding column '{name}' not found. Embed '{column}' first.")
    return name


def without_vectors(df: DataFrame) -> DataFrame:
    """The table without any embedding column."""
    return df.drop(*[c for c in df.columns if c.startswith(VECTOR_PREFIX)])


def vectors_as_text(df: DataFrame) -> DataFrame:
    """Embedding columns as JSON text, for formats without arrays."""
    return df.withColumns({c: vector_to_json(f"`{c}`") for c in vector_columns(df)})


def write_table(
    df: DataFrame,
    path: str,
    fmt: str | None = None,
    metadata: DataFrame | None = None,
    overwrite: bool = False,
    keep_vectors: bool = False,
) -> None:
    """Write the data, its text guarded against formulas, and the run metadata beside it.

    Vectors are left out unless asked for. An existing table is an error unless ``overwrite``.
    The metadata goes last, so its presence marks a finished write.
    """
    chosen = table_format(path, fmt)
    data = df if keep_vectors else without_vectors(df)
    if keep_vectors and chosen == "csv":
        data = vectors_as_text(data)
    mode = "overwrite" if overwrite else "errorifexists"
    try:
        _write(formula_safe_table(data), path, chosen, mode)
    except AnalysisException as e:
        if _condition(e) == "PATH_ALREADY_EXISTS":
            raise FileExistsError(f"Table already exists: {path}. Pass overwrite=True to replace it.") from None
        raise
    if metadata is not None:
        _write(formula_safe_table(metadata).coalesce(1), metadata_path(path), chosen, "overwrite")


def _write(df: DataFrame, path: str, fmt: str, mode: str) -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.save(path)


def metadata_path(path: str) -> str:
    return f"{path.rstrip('/')}.metadata"


def run_metadata(
    spark: SparkSession, command: str, parameters: dict[str, object], df: DataFrame | None = None
) -> DataFrame:
    """Parameter, Value rows that describe a run; ``df`` adds its row count."""
    facts: dict[str, object] = {
        "tool": "affinis",
        "version": __version__,
        "command": command,
        **parameters,
        "date": datetime.now().isoformat(),
    }
    schema = "Parameter string, Value string"
    rows = few_rows(spark, [(k, _text(v)) for k, v in facts.items()], schema)
    if df is None:
        return rows
    counted = df.agg(F.count(F.lit(1)).cast("string").alias("Value"))
    return rows.unionByName(counted.select(F.lit("input_rows").alias("Parameter"), "Value"))


def _text(value: object) -> str:
    return ", ".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value)


def input_tables(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the readable formats in a folder, sorted; hidden and lock files are left out."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/*")
    system = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    paths = [str(s.getPath().toString()) for s in system.globStatus(pattern) or []]
    suffixes = tuple(f".{f}" for f in FORMATS)
    return sorted(
        p for p in paths if p.endswith(suffixes) and not p.rsplit("/", 1)[-1].startswith(("~", ".", "_"))
    )


def inventory(spark: SparkSession, paths: list[str], fmt: str | None = None) -> DataFrame:
    """path, rows, columns of every table; one that cannot be read gets 0, 0."""
    parts = []
    for path in paths:
        name = F.lit(path).alias("path")
        try:
            df = _opened(spark, path, fmt, None)
            parts.append(
                df.agg(F.count(F.lit(1)).alias("rows")).select(
                    name, "rows", F.lit(len(df.columns)).cast("int").alias("columns")
                )
            )
        except (AnalysisException, Py4JJavaError, ValueError):
            parts.append(
                few_rows(spark, [(path, 0, 0)], "path string, rows long, columns int")
            )
    if not parts:
        return few_rows(spark, [], "path string, rows long, columns int")
    return reduce(DataFrame.unionByName, parts)
