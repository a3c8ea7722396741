"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Rows are dealt into blocks of bounded size. A block keeps, for every dimension, its rows sorted by
that component. A query walks all lists at once from the end that its own component favours, in
steps that double; each row that a list shows for the first time is scored in full. The
components at the present depth bound the score of every row not seen yet: as soon as that bound is
below the k-th best score, no unseen row can enter the result. A query starts with the k-th best
score over a bounded sample of rows, so that most blocks only have to beat that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import ship
from .vectors import ASKED, BLOCK, found_table, ids_of, matrix, parts_of, ranked, searched, usable

SEEDS = 1024  # rows, chosen by hash, that give every query its first bound
STEP = 16  # depth of the first step down the lists
EXACT = 1 << 53  # whole numbers that a double holds exactly


def threshold_top(
    rows: np.ndarray, order: np.ndarray, query: np.ndarray, k: int, floor: float, seen: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and scores of all rows that may be among the k best, and the depth reached.

    ``order`` holds the positions sorted by each column of ``rows``; rows marked in ``seen`` are left
    out. Every row with a score of at least ``floor`` and the k-th best score is in the result.
    """
    n = len(rows)
    up, down = np.flatnonzero(query >= 0), np.flatnonzero(query < 0)
    places: list[np.ndarray] = []
    scores: list[np.ndarray] = []
    kth, depth, step, left = -np.inf, 0, STEP, n - int(seen.sum())
    while depth < n and left:
        end = min(n, depth + step)
        shown = np.concatenate([order[n - end : n - depth, up].ravel(), order[depth:end, down].ravel()])
        fresh = np.zeros(n, bool)
        fresh[shown] = True
        new = np.flatnonzero(fresh & ~seen)
        seen[new] = True
        left -= len(new)
        places.append(new)
        scores.append(rows[new] @ query)
        depth, step = end, 2 * step
        known = np.concatenate(scores)
        if len(known) >= k:
            kth = np.partition(known, len(known) - k)[len(known) - k]
        bound = rows[order[n - depth, up], up] @ query[up] + rows[order[depth - 1, down], down] @ query[down]
        if bound < max(kth, floor):
            break
    if not places:
        return np.zeros(0, np.int64), np.zeros(0), depth
    place, score = np.concatenate(places), np.concatenate(scores)
    keep = score >= kth
    return place[keep], score[keep], depth


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Whole components as doubles where sums of products stay exact, else as Python integers."""
    whole = matrix(column, np.int64)
    most = int(np.abs(whole).max(initial=0))
    return whole.astype(np.float64) if most * most * max(1, whole.shape[1]) < EXACT else whole.astype(object)


def _search(k: int):
    def search(block: pa.Table, asked: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])
        if len(block) and len(asked):
            both = _numbers(pa.chunked_array(block["_ints"].chunks + asked["_ints"].chunks))
            rows, queries = both[: len(block)], both[len(block) :]
            order = np.argsort(rows, axis=0, kind="stable")
            ids, row = ids_of(block["_id"]), block["_row"].to_numpy()
            for q, own, name, floor in zip(
                queries, asked["_row"].to_numpy(), asked["_id"].to_numpy(), asked["_floor"].to_pylist(), strict=True
            ):
                place, score, _ = threshold_top(rows, order, q, k, -np.inf if floor is None else floor, row == own)
                best = place[np.lexsort((ids[place], -score))][:k]
                score = score[np.lexsort((ids[place], -score))][:k]
                for held, part in zip(out, (np.full(len(best), own), np.full(len(best), name), ids[best], score), strict=True):
                    held.append(part)
        return found_table(*out, pa.int64())

    return search


def inner_product_top(
    df: DataFrame, id: str, vec: str, asked: Column, k: int = 10, scale: int = 1024, block: int = BLOCK
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k highest inner products of each query.

    Components x count as floor(scale * x), x as a double, so scores are whole and exact. Queries are
    the rows that fulfil ``asked``; candidates are all rows but the query's own; ties go to the smaller
    id, a null id last. Repeated rows are candidates of their own.

    Rows whose vector is null or empty or holds a null or non-finite component take no part, nor
    does a vector whose length is not the table's usual one. Other columns are ignored. An empty
    table, or one without queries, gives an empty result.
    """
    ship(df.sparkSession)
    held, count = usable(df, id, vec, asked)
    rows = held.select("_id", "_row", "_asked", F.transform("_vec", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("_ints"))
    # Seeds: an even share of the rows by hash; about SEEDS of them at any size of the table.
    share = min(1.0, SEEDS / max(1, count))
    seeds = rows.where(F.pmod(F.xxhash64("_row", F.lit(3)), F.lit(1_000_000_000)) < int(share * 1_000_000_000))
    seeds = seeds.select("_row", "_ints").toArrow()
    asking = rows.where("_asked").select("_id", "_row", "_ints")
    floors = asking.mapInArrow(_floors(seeds, k), "_id long, _row long, _ints array<long>, _floor double")
    blocks = max(1, -(-count // block))
    groups = max(1, -(-held.where("_asked").count() // ASKED))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = rows.select("_id", "_row", "_ints", parts_of("_row", count, block).alias("_block"), every(groups).alias("_group"))
    queries = floors.select("*", F.pmod(F.xxhash64("_row", F.lit(5)), F.lit(groups)).cast("int").alias("_group"), every(blocks).alias("_block"))
    return ranked(searched(dealt, queries, ["_block", "_group"], _search(k), "long"), k)


def _floors(seeds: pa.Table, k: int):
    """The k-th best score of each query over the seed rows, none if there are too few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = seeds["_row"].to_numpy()
        for batch in batches:
            floor = [None] * len(batch)
            if len(batch) and len(seeds) > k:
                asked = pa.chunked_array([batch.column(2)])
                both = _numbers(pa.chunked_array(seeds["_ints"].chunks + asked.chunks))
                known, queries = both[: len(seeds)], both[len(seeds) :]
                for i, (q, own) in enumerate(zip(queries, batch.column(1).to_numpy(), strict=True)):
                    score = (known @ q)[at != own]
                    # A bound that is rounded down keeps every tie.
                    floor[i] = float(np.nextafter(float(np.partition(score, len(score) - k)[len(score) - k]), -np.inf))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor, pa.float64())], names=["_id", "_row", "_ints", "_floor"])

    return run
