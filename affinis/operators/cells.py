"""Cells and blocks: how vectors are laid out so that only promising blocks meet.

Distinct vectors are assigned to the nearest of a bounded set of centres. A cell keeps the
largest distance to its centre, which bounds the score of any vector against the whole cell.
A block keeps its least and largest distance to some of the centres (pivots) as well: a vector
whose own distance to any pivot is too far outside that span has no result there.
Cells are cut into blocks of bounded size by a hash of the id, so a dense cell becomes many
tasks. A vector is sent to exactly those blocks that may hold a result for it; the bound is
exact, so pruning never changes a result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import blocks as B
from ..workspace import few_rows, fill_cores, release, ship, small, written
from .copies import PRINT, REP, VEC

BLOCK_BYTES = 16 << 20  # DOUBLE bytes of one block of vectors
BLOCK_ROWS = (128, 16_384)  # and its limits in rows
CENTRE_BYTES = 32 << 20  # DOUBLE bytes of all centres, which every worker holds
CELLS = 50_000  # ... and their largest number
PIVOTS = 32  # most rows that the distances of all blocks are kept to, within CENTRE_BYTES as well
TASKS_PER_CORE = 4
VISITORS = 2  # visiting rows per task, as a multiple of the block size

BLOCK, CELL = "_block", "_cell"


@dataclass(frozen=True)
class Layout:
    """Centres and block counts every worker needs; bounded by ``CENTRE_BYTES``."""

    metric: str
    centres: np.ndarray
    radius: np.ndarray
    blocks: np.ndarray
    pivots: np.ndarray | None = None
    low: np.ndarray | None = None  # by block and pivot: the least and the largest distance
    high: np.ndarray | None = None

    @property
    def first(self) -> np.ndarray:
        return np.r_[0, np.cumsum(self.blocks)]

    def near(self, rows: np.ndarray, floor: np.ndarray) -> np.ndarray | None:
        """(row, block) mask: blocks that may hold a member with a goodness of at least the floor.

        Distances to a pivot differ by no more than the distance itself, so a member within
        reach has its own distance to every pivot within reach of the row's.
        """
        if self.pivots is None:
            return None
        if self.metric == "cosine":
            reach = np.arccos(np.clip(floor - B.SLACK, -1.0, 1.0))
        else:
            reach = np.maximum(-floor, 0.0) * (1 + B.SLACK)
        reach = (reach + B.SLACK)[:, None]
        gap = B.gaps(self.metric, rows, self.pivots)
        mask = np.ones((len(rows), len(self.low)), dtype=bool)
        for p in range(len(self.pivots)):
            own = gap[:, p : p + 1]
            mask &= (own + reach >= self.low[None, :, p]) & (own - reach <= self.high[None, :, p])
        return mask


@dataclass(frozen=True)
class Placed:
    """Distinct vectors with their cell and block."""

    rows: DataFrame
    layout: Broadcast
    blocks: int
    block_rows: int

    def groups(self, visits: int) -> int:
        """Upper bound on the groups of ``meetings`` for a counted number of visits."""
        return self.blocks + -(-visits // (self.block_rows * VISITORS))


def block_rows(count: int, dim: int, cores: int) -> int:
    """Rows per block.

    Large blocks ship each vector to fewer places and return fewer candidates, so blocks are as
    large as memory allows while all blocks against all still make a few tasks per core.
    """
    low, high = BLOCK_ROWS
    fitting = max(low, BLOCK_BYTES // (8 * max(1, dim)))
    spread = math.ceil(count / math.sqrt(TASKS_PER_CORE * cores * VISITORS))
    return max(low, min(fitting, high, spread))


def by_group(df: DataFrame, keys: list[str], groups: int, together: int = 4) -> GroupedData:
    """Groups of rows as separate tasks, about ``together`` in one.

    Small blocks are long work, so their shuffle must not be coalesced by its bytes: the
    number of partitions is given; it follows the counted number of groups.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = min(groups, max(2 * cores, groups // together))
    return df.repartition(max(1, tasks), *keys).groupBy(*keys)


def place(
    distinct: DataFrame, count: int, dim: int, metric: str, rows_per_block: int | None = None
) -> Placed:
    """Assign written distinct vectors to cells and blocks."""
    spark = distinct.sparkSession
    ship(spark)
    size = rows_per_block or block_rows(count, dim, spark.sparkContext.defaultParallelism)
    wanted = max(1, -(-count // size))
    most = max(1, min(CELLS, CENTRE_BYTES // (8 * max(1, dim))))
    centres = _centres(distinct, count, min(wanted, most), metric) if wanted > 1 else None
    if centres is None:
        only = spark.sparkContext.broadcast(
            Layout(metric, np.zeros((1, dim)), np.array([np.inf]), np.array([1]))
        )
        return Placed(distinct.withColumn(BLOCK, F.lit(0)), only, 1, size)

    celled = written(with_cells(fill_cores(distinct), VEC, centres, metric), "cells")
    # One row per cell, and the number of cells is bounded by CENTRE_BYTES.
    stats = celled.groupBy(CELL).agg(F.count(F.lit(1)).alias("n"), F.max("_gap").alias("r")).collect()
    radius, blocks = np.zeros(len(centres)), np.zeros(len(centres), dtype=np.int64)
    for row in stats:
        radius[row[CELL]] = row["r"]
        blocks[row[CELL]] = -(-row["n"] // size)
    layout = Layout(metric, centres, radius + 1e-9, blocks)
    first = layout.first
    starts = few_rows(
        spark,
        [(int(c), int(first[c]), int(blocks[c])) for c in np.flatnonzero(blocks)],
        f"{CELL} int, _first int, _n int",
    )
    rows = (
        celled.drop("_gap")
        .join(F.broadcast(starts), CELL)
        .withColumn(
            BLOCK,
            (F.col("_first") + F.pmod(F.hash(REP), F.col("_n"))).cast("int"),
        )
        .drop("_first", "_n", CELL)
    )
    total = int(first[-1])
    if metric != "dot" and total > 1:
        rows = written(rows, "blocks")
        layout = _with_pivots(rows, layout, total)
    return Placed(rows, spark.sparkContext.broadcast(layout), total, size)


def _with_pivots(rows: DataFrame, layout: Layout, blocks: int) -> Layout:
    """The layout with the least and largest distance of every block to some of the centres."""
    wanted = max(1, min(PIVOTS, CENTRE_BYTES // (16 * blocks)))
    pivots = _far_apart(layout.metric, layout.centres, wanted)
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    metric = layout.metric

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.full((blocks, len(shared.value)), np.inf)
        high = np.full((blocks, len(shared.value)), -np.inf)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            vectors, block = B.prepared(metric, B.matrix(table.column(VEC))), table.column(BLOCK).to_numpy()
            for part in B.slices(len(vectors), len(shared.value)):
                gap = B.gaps(metric, vectors[part], shared.value)
                np.minimum.at(low, block[part], gap)
                np.maximum.at(high, block[part], gap)
        seen = np.flatnonzero(np.isfinite(low[:, 0]))
        at, pivot = np.repeat(seen, low.shape[1]), np.tile(np.arange(low.shape[1]), len(seen))
        yield pa.RecordBatch.from_pydict(
            {"b": at, "p": pivot, "low": low[seen].ravel(), "high": high[seen].ravel()}
        )

    spans = rows.select(BLOCK, VEC).mapInArrow(span, "b long, p long, low double, high double")
    found = spans.groupBy("b", "p").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
    low, high = np.full((blocks, len(pivots)), np.inf), np.full((blocks, len(pivots)), -np.inf)
    at = (found["b"].to_numpy(), found["p"].to_numpy())
    low[at], high[at] = found["low"].to_numpy(), found["high"].to_numpy()
    return replace(layout, pivots=pivots, low=low, high=high)


def _far_apart(metric: str, points: np.ndarray, wanted: int) -> np.ndarray:
    """Some of the points, each next one far from those before."""
    chosen, closest = [0], B.gaps(metric, points, points[:1])[:, 0]
    while len(chosen) < min(wanted, len(points)):
        following = int(closest.argmax())
        chosen.append(following)
        closest = np.minimum(closest, B.gaps(metric, points, points[following : following + 1])[:, 0])
    return points[chosen]


def with_cells(df: DataFrame, vec: str, centres: np.ndarray, metric: str) -> DataFrame:
    """``df`` with the nearest centre of each vector (_cell) and the distance to it (_gap)."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(centres)
    added = [T.StructField(CELL, T.IntegerType()), T.StructField("_gap", T.DoubleType())]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = shared.value
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rows = B.prepared(metric, B.matrix(table.column(vec)))
            cell = np.empty(len(rows), dtype=np.int32)
            gap = np.empty(len(rows))
            for part in B.slices(len(rows), len(points)):
                distance = B.gaps(metric, rows[part], points)
                cell[part] = distance.argmin(1)
                gap[part] = distance.min(1)
            table = table.append_column(CELL, pa.array(cell)).append_column("_gap", pa.array(gap))
            yield from table.to_batches()
            del batch, table, rows
            release()

    return df.mapInArrow(assign, T.StructType([*df.schema.fields, *added]))


def centre_share(cells: int, count: int) -> float:
    """The share of the rows to choose centres from: about twice as many as are wanted."""
    return min(1.0, (2 * cells + 64) / max(1, count))


def _centres(distinct: DataFrame, count: int, cells: int, metric: str) -> np.ndarray:
    """A pseudo-random choice of the vectors, the same on every run.

    Fingerprints are uniform, so a bound on them leaves little more than the wanted rows, and
    the partitions together send no more than that.
    """
    start = F.conv(F.hex(F.substring(PRINT, 1, 7)), 16, 10).cast("long")
    few = distinct.select(PRINT, VEC).where(start < int(centre_share(cells, count) * (1 << 56)))
    picked = few.orderBy(PRINT).limit(cells).collect()
    return B.prepared(metric, np.array([r[VEC] for r in picked], dtype=np.float64))


def meetings(
    placed: Placed, visits: DataFrame, host_cols: list[str], visit_cols: list[str], alone: bool
) -> DataFrame:
    """Hosts and visitors of every block, cut into groups of bounded size.

    ``visits`` holds one row per (visiting vector, target block). A block with many visitors
    becomes several groups, each with all of the block's hosts and a share of its visitors.
    With ``alone`` the blocks without a visitor are kept as well.
    """
    share = placed.block_rows * VISITORS
    load = (
        visits.groupBy(BLOCK)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(BLOCK, F.ceil(F.col("_n") / share).cast("int").alias("_groups"))
    )
    load = small(load, placed.blocks)
    hosts = (
        placed.rows.select(BLOCK, *host_cols)
        .join(load, BLOCK, "left" if alone else "inner")
        .withColumn("_groups", F.coalesce("_groups", F.lit(1)))
        .withColumn("_group", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)))
        .withColumn("_visits", F.lit(False))
        .drop("_groups")
    )
    guests = (
        visits.select(BLOCK, *visit_cols)
        .join(load, BLOCK)
        .withColumn("_group", F.pmod(F.hash(F.lit(17), F.col(REP)), F.col("_groups")))
        .withColumn("_visits", F.lit(True))
        .drop("_groups")
    )
    return hosts.unionByName(guests, allowMissingColumns=True)


def split_roles(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Hosts in id order and visitors of one group."""
    visiting = table.column("_visits")
    hosts = table.filter(pc.invert(visiting)).sort_by(REP)
    return hosts, table.filter(visiting)


def wide_targets(
    layout: Layout, cells: np.ndarray, own: np.ndarray, near: np.ndarray | None = None
) -> pa.Array:
    """Block lists from a (row, cell) and a (row, block) mask, without each row's own block."""
    mask = np.repeat(cells, layout.blocks, axis=1)
    if near is not None:
        mask &= near
    mask[np.arange(len(mask)), own] = False
    row, block = np.nonzero(mask)
    offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=len(mask)))]
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.array(block.astype(np.int32))
    )
