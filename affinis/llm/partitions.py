"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors is linked to its nearest neighbours; the graph is cut into parts of
equal size with as few cut links as a local search finds; and a small network learns to tell a
vector's part from the vector. It then places every row of the table in its most probable part, and
sends a query to its several most probable parts, where all rows are scored exactly.

How many parts a query tries is measured, not guessed: it is the least number that finds the
wanted share of the true neighbours of held-back sample rows. On vectors without structure that is
most of the parts, since then no partition separates neighbours from the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import ship, written
from .vectors import ASKED, BLOCK, found_table, ids_of, matrix, ranked, searched, usable

FIT_ROWS = 8192  # bound of the sample that the index is fitted on
HELD_BACK = 512  # rows of the sample that measure recall, a fifth of it at most, and teach nothing
LINKS = 10
HIDDEN = 128
RECALL = 0.97  # wanted on the held-back rows


@dataclass
class Router:
    """A network of one hidden layer that gives the probability of every part, best parts first."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def parts(self, unit: np.ndarray) -> np.ndarray:
        hidden = np.maximum(unit @ self.w1 + self.b1, 0)
        return np.argsort(-(hidden @ self.w2 + self.b2), axis=1, kind="stable")


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that very large or small components neither overflow nor vanish.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def nearest_in(unit: np.ndarray, asked: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k nearest rows of each asked row, itself left out."""
    out = np.empty((len(asked), k), np.int64)
    for first in range(0, len(asked), 1024):
        rows = asked[first : first + 1024]
        score = unit[rows] @ unit.T
        score[np.arange(len(rows)), rows] = -np.inf
        out[first : first + 1024] = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return out


def balanced_cut(unit: np.ndarray, near: np.ndarray, parts: int, rounds: int = 12, slack: float = 0.1) -> np.ndarray:
    """A part for each row: parts of equal size within ``slack``, cutting few links of the graph."""
    n = len(unit)
    part = np.zeros(n, np.int64)
    todo = [(np.arange(n), 0, parts)]
    while todo:  # start: halve along the direction of most spread
        rows, first, count = todo.pop()
        if count == 1:
            part[rows] = first
            continue
        centred = unit[rows] - unit[rows].mean(axis=0)
        direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = rows[np.argsort(centred @ direction, kind="stable")]
        left = count // 2
        cut = len(rows) * left // count
        todo += [(order[:cut], first, left), (order[cut:], first + left, count - left)]
    source = np.repeat(np.arange(n), near.shape[1])
    target = near.ravel()
    ends, others = np.concatenate([source, target]), np.concatenate([target, source])
    most, least = int(np.ceil(n / parts * (1 + slack))), int(n / parts * (1 - slack))
    for _ in range(rounds):  # then move rows to the part that holds most of their neighbours
        links = np.bincount(ends * parts + part[others], minlength=n * parts).reshape(n, parts)
        wanted = links.argmax(axis=1)
        gain = links[np.arange(n), wanted] - links[np.arange(n), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for row in np.argsort(-gain, kind="stable"):
            if gain[row] <= 0:
                break
            a, b = part[row], wanted[row]
            if size[a] > least and size[b] < most:
                part[row] = b
                size[a] -= 1
                size[b] += 1
                moved += 1
        if not moved:
            break
    return part


def fit_router(unit: np.ndarray, parts: int, k: int, recall: float, seed: int = 1, epochs: int = 30) -> Router:
    """Cut the sample's neighbour graph, learn the parts, and measure the probes that are needed.

    The rows that measure are set apart first: neither the cut nor the network sees them.
    """
    dice = np.random.default_rng(seed)
    every = unit
    apart = dice.permutation(len(every))[: min(HELD_BACK, len(every) // 5)]
    unit = np.delete(every, apart, axis=0)
    n, d = unit.shape
    links = max(1, min(LINKS, n - 1))
    near = nearest_in(unit, np.arange(n), links) if n > 1 else np.zeros((n, 1), np.int64)
    part = balanced_cut(unit, near, parts)
    sizes = [(d, HIDDEN), (HIDDEN,), (HIDDEN, parts), (parts,)]
    weights = [dice.normal(0, np.sqrt(2 / s[0]), s) if len(s) == 2 else np.zeros(s) for s in sizes]
    first, second = [np.zeros(s) for s in sizes], [np.zeros(s) for s in sizes]
    step = 0
    for _ in range(epochs):
        order = dice.permutation(n)
        for at in range(0, n, 128):
            rows = order[at : at + 128]
            x = unit[rows]
            raw = x @ weights[0] + weights[1]
            hidden = np.maximum(raw, 0)
            out = hidden @ weights[2] + weights[3]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            out /= out.sum(axis=1, keepdims=True)
            out[np.arange(len(rows)), part[rows]] -= 1
            out /= len(rows)
            back = (out @ weights[2].T) * (raw > 0)
            step += 1
            for i, g in enumerate((x.T @ back, back.sum(axis=0), hidden.T @ out, out.sum(axis=0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                rate = 0.003 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                weights[i] = weights[i] - rate * first[i] / (np.sqrt(second[i]) + 1e-8)
    router = Router(*weights, probes=parts)
    if len(apart) and n > k + 1:
        truth = nearest_in(every, apart, k)
        order = router.parts(every)
        place = np.argsort(order[apart], axis=1)  # when each part is tried
        tried = np.take_along_axis(place, order[truth, 0], axis=1)
        share = np.cumsum(np.bincount(tried.ravel(), minlength=parts)) / tried.size
        router.probes = int(np.searchsorted(share, recall - 1e-12)) + 1
    return router


def pair_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in double precision. Components are added one after another for every pair alike, so
    equal vectors get equal scores in whatever block they stand."""
    dot, size, own = np.zeros(len(rows)), np.zeros(len(rows)), 0.0
    for j in range(rows.shape[1]):
        column = rows[:, j]
        dot += column * query[j]
        size += column * column
        own += query[j] * query[j]
    return dot / (np.sqrt(size) * np.sqrt(own))


def _search(k: int):
    def search(block: pa.Table, asked: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])
        if len(block) and len(asked):
            rows, queries = matrix(block["_vec"], np.float64), matrix(asked["_vec"], np.float64)
            rows /= np.exp2(np.floor(np.log2(np.abs(rows).max(axis=1, keepdims=True))))  # exact: powers of two
            queries = queries / np.exp2(np.floor(np.log2(np.abs(queries).max(axis=1, keepdims=True))))
            ids, row = ids_of(block["_id"]), block["_row"].to_numpy()
            near = unit_rows(queries) @ unit_rows(rows).T
            for i, (own, name) in enumerate(zip(asked["_row"].to_numpy(), asked["_id"].to_numpy(), strict=True)):
                others = np.flatnonzero(row != own)
                if len(others) > k:  # the product only preselects; a margin keeps what rounding could move
                    coarse = near[i, others]
                    others = others[coarse >= np.partition(coarse, len(coarse) - k)[len(coarse) - k] - 1e-9]
                score = pair_scores(rows[others], queries[i])
                best = np.lexsort((ids[others], -score))[:k]
                for held, value in zip(out, (np.full(len(best), own), np.full(len(best), name), ids[others][best], score[best]), strict=True):
                    held.append(value)
        return found_table(*out, pa.float64())

    return search


def learned_neighbours(
    df: DataFrame,
    id: str,
    vec: str,
    asked: Column,
    k: int = 5,
    parts: int = 16,
    recall: float = RECALL,
    fit_rows: int = FIT_ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k nearest rows found for each query.

    Queries are the rows that fulfil ``asked``; candidates are all rows but the query's own. Scores are
    cosines of the original vectors in double precision; ties go to the smaller id, a null id last.
    Repeated rows are candidates of their own. The fit sees about ``fit_rows`` rows, chosen by hash; the
    index holds every row.

    Rows whose vector is null, empty or zero or holds a null or non-finite component take no part, nor
    does a vector whose length is not the table's usual one. Other columns are ignored. An empty
    table, or one without queries, gives an empty result; a query without candidates gives no row.
    """
    spark = df.sparkSession
    ship(spark)
    held, count = usable(df, id, vec, asked, nonzero=True)
    share = min(1.0, fit_rows / max(1, count))
    sample = held.where(F.pmod(F.xxhash64("_row", F.lit(3)), F.lit(1_000_000_000)) < int(share * 1_000_000_000))
    learned = sample.select("_vec").toArrow()["_vec"]
    parts = max(1, min(parts, len(learned) // (2 * LINKS)))
    if len(learned):
        unit = unit_rows(matrix(learned, np.float64))
        router = fit_router(np.unique(unit, axis=0), parts, k, recall)
    else:
        router = Router(np.zeros((1, 1)), np.zeros(1), np.zeros((1, parts)), np.zeros(parts), parts)
    model = spark.sparkContext.broadcast(router)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = model.value.parts(unit_rows(matrix(pa.chunked_array([batch.column(1)]), np.float64))) if len(batch) else np.zeros((0, 1), int)
            tries = pa.array(order[:, : model.value.probes].astype(np.int32).tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(order[:, 0].astype(np.int32)), tries], names=[*batch.schema.names, "_part", "_tries"])

    kind = dict(held.dtypes)["_vec"]
    fields = f"_id long, _vec {kind}, _asked boolean, _row long, _part int, _tries array<int>"
    index = written(held.select("_id", "_vec", "_asked", "_row").mapInArrow(routed, fields), "parts")
    # A part, however full, is searched in blocks of bounded size by groups of queries of bounded size.
    filled = {r["_part"]: r["n"] for r in index.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    tried = index.where("_asked").select("_id", "_row", "_vec", F.explode("_tries").alias("_part"))
    asking = {r["_part"]: r["n"] for r in tried.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = [max(1, -(-filled.get(p, 0) // block)) for p in range(parts)]
    groups = [max(1, -(-asking.get(p, 0) // ASKED)) for p in range(parts)]
    of = lambda counts: F.element_at(F.array(*[F.lit(c) for c in counts]), F.col("_part") + 1)
    dealt = lambda seed, counts: F.pmod(F.xxhash64("_row", F.lit(seed)), of(counts)).cast("int")
    every = lambda counts: F.explode(F.sequence(F.lit(0), of(counts) - 1))
    rows = index.select("_id", "_row", "_vec", "_part", dealt(7, blocks).alias("_block"), every(groups).alias("_group"))
    queries = tried.select("_id", "_row", "_vec", "_part", dealt(5, groups).alias("_group"), every(blocks).alias("_block"))
    return ranked(searched(rows, queries, ["_part", "_block", "_group"], _search(k), "double"), k)
