"""Column profiles, key detection and the columns worth embedding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import model_for
from ..workspace import few_rows

# The type rule of the profile.
SAMPLE_ROWS = 100  # non-null values whose mean length is looked at
TEXT_LENGTH = 20  # a longer mean length is text
CATEGORY_SHARE = 0.5  # fewer distinct values than this share of the rows is a category

_NUMERIC = (T.NumericType, T.BooleanType)


def _present(field: T.StructField) -> Column:
    """The column with NaN as a missing value."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def _fits_in_64_bits(field: T.StructField) -> bool:
    kind = field.dataType
    if isinstance(kind, T.DecimalType):
        return kind.precision <= 18
    return isinstance(kind, (*_NUMERIC, T.DateType, T.TimestampType, T.TimestampNTZType))


def _as_long(field: T.StructField) -> Column:
    """A fixed-width value as one LONG: xxHash64 of a single such value is a bijection."""
    c = _present(field)
    return F.when(c.isNotNull(), F.xxhash64(c))


def _as_bytes(field: T.StructField) -> Column:
    """Text as its bytes or, beyond 32 of them, a SHA-256 with a marker byte.

    The two differ in length, so they never meet, and the shuffle moves at most 33 bytes.
    """
    raw = _text(field).cast("binary")
    digest = F.concat(F.unhex(F.lit("01")), F.unhex(F.sha2(raw, 256)))
    return F.when(F.octet_length(raw) > 32, digest).otherwise(raw)


def _cells(df: DataFrame, table: str) -> DataFrame:
    """One (table, column, value) row for every cell."""
    cells = []
    for i, f in enumerate(df.schema.fields):
        fixed = _fits_in_64_bits(f)
        number = _as_long(f) if fixed else F.lit(None).cast("long")
        text = F.lit(None).cast("binary") if fixed else _as_bytes(f)
        cells.append(F.struct(F.lit(i + 1).alias("index"), number.alias("v"), text.alias("b")))
    return df.select(F.lit(table).alias("table_name"), F.explode(F.array(*cells)).alias("c")).select("table_name", "c.*")


def _value_counts(cells: DataFrame) -> DataFrame:
    """table_name, index, unique_count, total_count, null_count of every column, in one pass.

    Equal values combine on the map side, so a frequent value costs one row per partition
    however often it occurs.
    """
    per_value = cells.groupBy("table_name", "index", "v", "b").agg(F.count(F.lit(1)).alias("n"))
    missing = F.col("v").isNull() & F.col("b").isNull()
    return per_value.groupBy("table_name", "index").agg(
        F.count_if(~missing).alias("unique_count"),
        F.sum("n").alias("total_count"),
        F.sum(F.when(missing, F.col("n")).otherwise(0)).alias("null_count"),
    )


def _text(field: T.StructField) -> Column:
    c = _present(field)
    nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
    return F.to_json(c) if nested else c.cast("string")


PROFILE = (
    "name string, index int, dtype string, unique_count long, total_count long, null_count long, "
    "is_likely_key boolean, is_likely_text boolean, suggested_model string"
)


Order = str | list[str]  # columns that are unique together


def profile(df: DataFrame, order: Order) -> DataFrame:
    """One row per column: name, index, dtype, counts, likely key, likely text, model."""
    return profiles({"": (df, order)}).drop("table_name")


def profiles(tables: dict[str, tuple[DataFrame, Order]]) -> DataFrame:
    """``profile`` of several tables at once, with their ``table_name``.

    One job counts the values of all columns of all tables, a second looks at the lengths of the
    first values of every non-numeric column, and a third serves all columns with gaps there. They
    return a row per column or less than a hundred rows per table, and the result is a local table.
    """
    cells = reduce(DataFrame.unionByName, [_cells(df, name) for name, (df, _) in tables.items()])
    counts = {(r["table_name"], r["index"]): r for r in _value_counts(cells).collect()}
    lengths = _mean_lengths(tables)
    rows = []
    for name, (df, _) in tables.items():
        for i, f in enumerate(df.schema.fields, 1):
            seen = counts.get((name, i))
            unique, total, missing = seen[2:5] if seen else (0, 0, 0)
            if isinstance(f.dataType, _NUMERIC):
                dtype = "numeric"
            elif missing == total:
                dtype = "mixed"
            elif lengths[name, i] <= TEXT_LENGTH and unique < total * CATEGORY_SHARE:
                dtype = "category"
            else:
                dtype = "text"
            is_key, is_text = unique == total and not missing, dtype in ("text", "category")
            rows.append((name, f.name, i, dtype, unique, total, missing, is_key, is_text, model_for(f.name)))
    spark = next(iter(tables.values()))[0].sparkSession
    return few_rows(spark, rows, f"table_name string, {PROFILE}")


def _mean_lengths(tables: dict[str, tuple[DataFrame, Order]]) -> dict[tuple[str, int], float]:
    """Mean text length of the first non-null values per table and non-numeric column.

    The first rows of a table answer for every column that is complete in them. Columns with gaps
    there are ranked together, each by itself; the rank limit holds before the shuffle too.
    """
    wide: dict[str, DataFrame] = {}
    for name, (df, order) in tables.items():
        texts = {i + 1: f for i, f in enumerate(df.schema.fields) if not isinstance(f.dataType, _NUMERIC)}
        if not texts:
            continue
        place = F.struct(*[F.col(f"`{c}`") for c in ([order] if isinstance(order, str) else order)])
        lengths = [F.struct(F.lit(i).alias("i"), F.length(_text(f)).alias("n")) for i, f in texts.items()]
        wide[name] = df.select(place.alias("_o"), F.array(*lengths).alias("_n"))
    if not wide:
        return {}
    heads = [
        w.orderBy("_o").limit(SAMPLE_ROWS).select(F.lit(name).alias("table_name"), F.inline("_n")) for name, w in wide.items()
    ]
    first: dict[tuple[str, int], list[int | None]] = {}
    for r in reduce(DataFrame.unionByName, heads).collect():
        first.setdefault((r["table_name"], r["i"]), []).append(r["n"])
    means = {c: sum(seen) / len(seen) for c, seen in first.items() if None not in seen}
    gaps = sorted(set(first) - set(means))
    if not gaps:
        return means
    best = Window.partitionBy("i").orderBy("_o")
    parts = []
    for name in dict.fromkeys(t for t, _ in gaps):
        wanted = [i for t, i in gaps if t == name]
        cells = wide[name].select("_o", F.inline("_n")).where(F.col("i").isin(wanted) & F.col("n").isNotNull())
        ranked = cells.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= SAMPLE_ROWS)
        parts.append(ranked.groupBy("i").agg(F.avg("n").alias("mean")).select(F.lit(name).alias("table_name"), "i", "mean"))
    means |= {(r["table_name"], r["i"]): r["mean"] for r in reduce(DataFrame.unionByName, parts).collect()}
    return means


def likely_key(profiled: DataFrame) -> str | None:
    """First column with a distinct value in every row."""
    row = profiled.where("is_likely_key").orderBy("index").select("name").first()
    return row["name"] if row else None


def embed_candidates(profiled: DataFrame) -> list[str]:
    """Columns classified as text or category, in column order."""
    rows = profiled.where("is_likely_text").orderBy("index").select("name").collect()
    return [r["name"] for r in rows]


def key_audit(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct values, repeated values, and whether the key is unique."""
    per_key = df.groupBy(F.col(f"`{key}`").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.lit(key).alias("key"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_count"),
        F.count("k").alias("unique_count"),
        F.count_if((F.col("n") > 1) & F.col("k").isNotNull()).alias("repeated_values"),
        F.coalesce(F.max(F.when(F.col("k").isNotNull(), F.col("n"))), F.lit(0)).alias("largest"),
        (F.count("k") == F.coalesce(F.sum("n"), F.lit(0))).alias("is_unique"),
    )


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Every value that occurs more than once, with its rows."""
    counts = df.groupBy(F.col(f"`{key}`").alias(key)).agg(F.count(F.lit(1)).alias("rows"))
    return counts.where(F.col("rows") > 1)
