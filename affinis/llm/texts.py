"""Small helpers of the text operators: portions of Arrow batches, model files, row keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..workspace import release, ship

PORTION_BYTES = 1 << 20  # text that a task works on at once; a longer text is a portion of its own

_compiled: dict[tuple[str, bytes], object] = {}


def portions(texts: pa.Array, limit: int = PORTION_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, rows) of slices that hold about ``limit`` bytes of text, or one long text."""
    if not len(texts):
        return
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        before = ends[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield first, last - first
        first = last


def by_portion(
    df: DataFrame,
    text: str,
    made: Callable[[list[str]], dict[str, pa.Array]],
    fields: str,
    keep: list[str],
    limit: int = PORTION_BYTES,
) -> DataFrame:
    """Columns ``keep`` of ``df`` with the columns ``fields`` that ``made`` derives from the texts.

    A narrow Arrow job: the rows stay in their partition, only the text column travels to Python.
    Texts are spread out as Python objects, and what is derived from them leaves the worker, one
    portion at a time, however many rows an Arrow batch has. ``made`` gets null texts as empty ones.
    A derived column takes the place of a kept one of the same name. ``text`` may name a field of a
    kept struct (``struct.field``).
    """
    ship(df.sparkSession)
    derived = T.StructType.fromDDL(fields)
    kept = [c for c in keep if c not in derived.names]
    owner, _, inner = text.partition(".")
    content = F.col(f"`{owner}`.`{inner}`") if inner and owner in keep else F.col(f"`{text}`")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            if not len(texts):
                yield pa.array([], to_arrow_type(derived))
            for first, rows in portions(texts, limit):
                part = made([t or "" for t in texts.slice(first, rows).to_pylist()])
                yield pa.StructArray.from_arrays([part[c] for c in derived.names], derived.names)
                del part
            release()

    # arrow_udf reads the type hints at run time.
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # Marked non-deterministic, so that the texts are worked on once per row.
    derive = F.arrow_udf(run, derived).asNondeterministic()
    given = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_given")
    return df.select(given, derive(content.cast("string")).alias("_made")).select("_given.*", "_made.*")


def whole(df: DataFrame) -> DataFrame:
    """Every row of ``df`` in one struct, out of the way of the names that operators use."""
    return df.select(F.struct("*").alias("_whole"))


def file_bytes(path: str | Path) -> bytes:
    """A model file of the driver; its bytes travel to the tasks as a broadcast of fixed size."""
    return Path(path).read_bytes()


def compiled(kind: str, digest: bytes, make: Callable[[], object]) -> object:
    """Tables made from a model file, kept once per Python worker."""
    key = (kind, digest)
    if key not in _compiled:
        _compiled[key] = make()
    return _compiled[key]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(id: str) -> Column:
    """Whether a row is kept from all learning: crc32 of its id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(f"`{id}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def by_share(key: Column, share: float | Column, seed: int) -> Column:
    """An even choice of about ``share`` of the rows by the hash of a key."""
    place = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000_000))
    return place < (share if isinstance(share, Column) else F.lit(share)) * 1_000_000_000


@cache
def letter_table() -> np.ndarray:
    """By code point: whether it is a letter."""
    table = np.zeros(0x110000, bool)
    for run in regex.finditer(r"\p{L}+", "".join(map(chr, range(0x110000)))):
        table[run.start() : run.end()] = True
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[0], starts[0] + 1, ... of all runs, one run after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
