"""A cell index over a stored vector table, read by partition pruning.

Positions, keys and vectors are written once more, partitioned by cell; the fields of a row stay in the table. A query computes from the small table of
centres which cells can hold an answer, and Spark reads only their partitions.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..operators.cells import CELL, CENTRE_BYTES, centre_share, with_cells
from ..workspace import exists, few_rows, fill_cores

ROWS_PER_CELL = 100_000
POINTER = "home string, upto long, rows_per_cell long"
HELD = ("pos", "key", "embedding")
CELLS = 4_096  # most cells, which are folders of the index


@dataclass(frozen=True)
class VectorIndex:
    """Centres and radii of the cells, and pos, key and embedding of the rows by cell up to a position."""

    rows: DataFrame
    upto: int
    centres: np.ndarray
    radius: np.ndarray
    counts: np.ndarray
    rows_per_cell: int

    def nearest_cells(self, vector: np.ndarray) -> np.ndarray:
        """The cells that hold rows, nearest first."""
        gap = B.gaps("cosine", vector, self.centres)[0]
        return np.argsort(np.where(self.counts > 0, gap, np.inf), kind="stable")[: int((self.counts > 0).sum())]

    def cells_above(self, vector: np.ndarray, floor: float) -> np.ndarray:
        """Cells that may hold a score of at least ``floor``."""
        hope = B.best_possible("cosine", vector, self.centres, self.radius)[0]
        return np.flatnonzero(hope >= floor - B.SLACK)

    def of_cells(self, cells: np.ndarray) -> DataFrame:
        return self.rows.where(F.col("cell").isin([int(c) for c in cells])).drop("cell")

    def first_cells(self, vector: np.ndarray, top_k: int) -> np.ndarray:
        """The nearest cells that hold ``top_k`` rows between them."""
        order = self.nearest_cells(vector)
        enough = int(np.searchsorted(np.cumsum(self.counts[order]), top_k)) + 1
        return order[:enough]


def build(rows: DataFrame, path: str, dim: int, rows_per_cell: int = ROWS_PER_CELL) -> None:
    """Index the stored rows below ``path``; the pointer to the new index is written last."""
    spark = rows.sparkSession
    count, upto = rows.agg(F.count(F.lit(1)), F.max("pos")).first()
    if not count:
        if exists(spark, f"{path}/index"):
            few_rows(spark, [], POINTER).write.mode("overwrite").parquet(f"{path}/index")
        return
    most = max(1, min(CELLS, CENTRE_BYTES // (8 * dim)))
    cells = min(most, -(-count // rows_per_cell))
    # A pseudo-random choice of rows, the same on every run; copies give one centre.
    share = int(centre_share(cells, count) * 1_000_000_000)
    few = rows.select("key", "embedding").where(F.pmod(F.xxhash64("key"), F.lit(1_000_000_000)) < share)
    picked = few.orderBy(F.xxhash64("key"), "key").limit(cells).collect()
    points = np.unique(np.array([r["embedding"] for r in picked], dtype=np.float64), axis=0)
    centres = B.prepared("cosine", points)
    home = f"{path}/index-{uuid.uuid4().hex}"
    celled = with_cells(fill_cores(rows.select(*HELD)), "embedding", centres, "cosine")
    # Ranges of (cell, pos) keep a cell in few files and split a dense one over many tasks.
    placed = celled.withColumnRenamed(CELL, "cell").repartitionByRange("cell", "pos")
    placed.write.partitionBy("cell").parquet(f"{home}/rows")
    stored = spark.read.parquet(f"{home}/rows")
    facts = stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("_gap").alias("radius"))
    known = {r["cell"]: r for r in facts.collect()}
    table = [
        (int(c), centres[c].tolist(), float(known[c]["radius"]), int(known[c]["n"])) for c in sorted(known)
    ]
    schema = "cell int, centre array<double>, radius double, n long"
    few_rows(spark, table, schema).coalesce(1).write.parquet(f"{home}/cells")
    pointer = few_rows(spark, [(home, upto, rows_per_cell)], POINTER)
    pointer.coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def load(spark: SparkSession, path: str) -> VectorIndex | None:
    """The current index of a table, if it has one."""
    if not exists(spark, f"{path}/index"):
        return None
    pointer = spark.read.schema(POINTER).parquet(f"{path}/index").first()
    if pointer is None:
        return None
    home = pointer["home"]
    cells = spark.read.parquet(f"{home}/cells").orderBy("cell").collect()
    numbers = np.array([c["cell"] for c in cells])
    # Cells without rows have no line: the arrays are filled up so that a place is a number.
    width = int(numbers.max()) + 1
    centres = np.zeros((width, len(cells[0]["centre"])))
    radius, counts = np.zeros(width), np.zeros(width, dtype=np.int64)
    centres[numbers] = [c["centre"] for c in cells]
    radius[numbers] = [c["radius"] + 1e-9 for c in cells]
    counts[numbers] = [c["n"] for c in cells]
    rows = spark.read.parquet(f"{home}/rows").select(*HELD, "cell")
    return VectorIndex(rows, pointer["upto"], centres, radius, counts, pointer["rows_per_cell"] or ROWS_PER_CELL)
