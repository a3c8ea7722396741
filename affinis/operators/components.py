"""Connected components of a match graph.

Alternating large-star and small-star contraction (Kiveris et al., Connected Components in
MapReduce and Beyond, 2014). Long chains shrink geometrically, where plain label propagation
would need one round per link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import joined_labels
from ..workspace import ship, written, written_and_measured
from .lookup import HOT_ROWS

PORTION = 1_000_000  # edges a task combines at once
ROUNDS = 200  # far beyond the logarithmic number of rounds; a guard against a faulty input


def components(edges: DataFrame, a: str = "_a", b: str = "_b", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``node, root`` for every node with an edge; the root is the component's lowest node.

    Each round writes its edges to the shared folder, which cuts the lineage and survives lost
    executors. A hub may hold a third of all edges: its minimum is found by a map-side
    combined aggregate and is handed to its edges by broadcast, never by gathering them.
    """
    ship(edges.sparkSession)
    ends = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("h"), F.col(b).alias("l"))
    links = written(ends.mapInArrow(_stars, "h long, l long").distinct(), "links")
    for _ in range(ROUNDS):
        ends = links.select(
            F.explode(
                F.array(
                    F.struct(F.col("h").alias("n"), F.col("l").alias("o"), F.lit(1).alias("up")),
                    F.struct(F.col("l").alias("n"), F.col("h").alias("o"), F.lit(0).alias("up")),
                )
            ).alias("e")
        ).select("e.*")
        nodes, facts = written_and_measured(
            ends.groupBy("n").agg(
                F.least(F.min("o"), F.col("n")).alias("m"),
                F.sum("up").alias("ups"),
                F.sum(1 - F.col("up")).alias("downs"),
            ),
            "nodes",
            F.count_if((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("downs") > 0))).alias("open"),
            F.max(F.greatest("ups", "downs")).alias("widest"),
            F.sum("ups").alias("links"),
        )
        if not facts["open"]:
            roots = nodes.where(F.col("downs") > 0).select(F.col("n").alias("node"), F.col("n").alias("root"))
            return links.select(F.col("h").alias("node"), F.col("l").alias("root")).unionByName(roots)
        # At most 2 * total / limit nodes are hubs.
        limit = max(hot_rows, facts["links"] // 100_000)
        hubs = facts["widest"] > limit
        large = _minimum_of(links, nodes.select(F.col("n").alias("l"), "m", F.col("downs").alias("d")), "l", limit, hubs)
        large = large.select("h", F.col("m").alias("l")).distinct()
        small = large.groupBy("h").agg(F.min("l").alias("m"), F.count(F.lit(1)).alias("d"))
        # A node of the large-star result may itself have gathered many neighbours.
        met = _minimum_of(large, small, "h", limit, hubs)
        links = written(
            met.select(F.explode(F.array(
                F.struct(F.col("h"), F.col("m").alias("l")),
                F.struct(F.col("l").alias("h"), F.col("m").alias("l")),
            )).alias("e")).select("e.*").where("h <> l").distinct(),
            "links",
        )
    raise RuntimeError(f"Components did not settle in {ROUNDS} rounds.")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace portions of a partition's edges by stars around their lowest nodes.

    This is the map-side combine: a portion of any size shrinks to at most one edge per node.
    """

    def combined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        h, l = table.column("h").to_numpy(), table.column("l").to_numpy()
        nodes, place = np.unique(np.concatenate([h, l]), return_inverse=True)
        root = joined_labels(np.arange(len(nodes)), place[: len(h)], place[len(h) :])
        leaf = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_pydict({"h": nodes[leaf], "l": nodes[root[leaf]]})

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= PORTION:
            yield combined(held)
            held, rows = [], 0
    if held:
        yield combined(held)


def _minimum_of(links: DataFrame, nodes: DataFrame, key: str, limit: int, hubs: bool) -> DataFrame:
    if not hubs:
        return links.join(nodes.drop("d"), key)
    few = F.broadcast(nodes.where(F.col("d") > limit).drop("d"))
    many = nodes.where(F.col("d") <= limit).drop("d")
    at_hubs = links.join(few, key)
    elsewhere = links.join(few.select(key), key, "left_anti").join(many, key)
    return at_hubs.unionByName(elsewhere)
