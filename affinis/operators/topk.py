"""Exact nearest rows under any metric, with an approximate mode that probes fewer cells.

1. Copies collapse to distinct vectors; each keeps the ids that can still reach a result.
2. Every vector is scored inside its own block. Its k-th best score there is a floor.
3. It is then sent only to blocks of cells whose bound beats that floor, and only scores above
   the floor come back.
4. The survivors are ranked, and copies receive the list of their vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions.vectors import find_metric
from ..settings import DEFAULT_DECIMALS, DEFAULT_METRIC, DEFAULT_TOP_K
from ..workspace import few_rows, ship, written, written_and_measured
from .cells import BLOCK, BLOCK_ROWS, Layout, Placed, by_group, meetings, place, split_roles, wide_targets
from .copies import (
    ID,
    KEY,
    PRINT,
    REP,
    VEC,
    distinct_vectors,
    distinct_with_members,
    records,
)
from .lookup import attach

CANDIDATE = "_rep long, _key string, _cand long, _cand_key string, _good double"


class _Hosts:
    """The scored side of a block, with the ids that share each vector."""

    def __init__(self, metric: str, table: pa.Table):
        self.vectors = B.prepared(metric, B.matrix(table.column(VEC)))
        self.scorer = B.Scorer(metric, self.vectors)
        ids = _list(table.column("_ids"))
        self.ids = ids.flatten().to_numpy()
        self.keys = _list(table.column("_keys")).flatten()
        self.held = np.diff(ids.offsets.to_numpy())
        self.first = np.r_[0, np.cumsum(self.held)]

    def best(
        self, rows: np.ndarray, keep: int, floor: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best ids per row as (row, position in the id list, score)."""
        row, col, value = self.scorer.best(rows, keep, floor)
        if len(self.ids) == len(self.held):
            return row, col, value
        times = self.held[col]
        at = np.repeat(self.first[col], times) + B.rank_in_runs(np.repeat(np.arange(len(col)), times))
        row, value = np.repeat(row, times), np.repeat(value, times)
        order = np.lexsort((self.ids[at], -value, row))
        row, at, value = row[order], at[order], value[order]
        kept = B.rank_in_runs(row) < keep
        return row[kept], at[kept], value[kept]


def _list(column: pa.ChunkedArray) -> pa.ListArray:
    lists = column.combine_chunks()
    return lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists


def _cells_to_visit(
    plan: Layout, rows: np.ndarray, floor: np.ndarray, probes: int | None
) -> np.ndarray:
    """(row, cell) mask: cells that may beat the floor, or the nearest few when approximate."""
    if probes is None:
        hope = B.best_possible(plan.metric, rows, plan.centres, plan.radius)
        return hope >= (floor - B.SLACK * (1 + np.abs(floor)))[:, None]
    near = B.gaps(plan.metric, rows, plan.centres)
    near[:, plan.blocks == 0] = np.inf
    cells = np.zeros(near.shape, dtype=bool)
    close = np.argsort(near, axis=1, kind="stable")[:, :probes]
    np.put_along_axis(cells, close, True, axis=1)
    return cells


def _seed(layout: Broadcast, keep: int, probes: int | None):
    """Score a block against itself: own candidates, the floor, and the blocks still to visit."""

    def run(table: pa.Table) -> pa.Table:
        plan: Layout = layout.value
        table = table.sort_by(REP)
        hosts = _Hosts(plan.metric, table)
        own = table.column(BLOCK).to_numpy()
        rows, at, good, floors, targets = [], [], [], [], []
        count = len(table)
        for part in B.slices(count, max(count, int(plan.blocks.sum()))):
            mine = hosts.vectors[part]
            r, a, v = hosts.best(mine, keep)
            floor = np.full(len(mine), -np.inf)
            found = np.bincount(r, minlength=len(mine))
            ends = np.cumsum(found) - 1
            full = found >= keep
            floor[full] = v[ends[full]]
            rows.append(r + part.start)
            at.append(a)
            good.append(v)
            floors.append(floor)
            if len(plan.centres) == 1:
                targets.append(pa.array([[]] * len(mine), pa.list_(pa.int32())))
                continue
            near = plan.near(mine, floor) if probes is None else None
            targets.append(wide_targets(plan, _cells_to_visit(plan, mine, floor, probes), own[part], near))
        row, at = np.concatenate(rows), np.concatenate(at)
        offsets = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=count))], pa.int32())
        cands = pa.StructArray.from_arrays(
            [pa.array(hosts.ids[at]), hosts.keys.take(pa.array(at)), pa.array(np.concatenate(good))],
            ["_cand", "_cand_key", "_good"],
        )
        return pa.table(
            {
                REP: table.column(REP),
                KEY: table.column(KEY),
                VEC: table.column(VEC),
                "_floor": pa.array(np.concatenate(floors)),
                "_targets": pa.chunked_array(targets),
                "_cands": pa.ListArray.from_arrays(offsets, cands),
            }
        )

    return run


def _visit(metric: str, keep: int):
    """Score visitors against the hosts of a block, above each visitor's floor only."""

    def run(table: pa.Table) -> pa.Table:
        host_rows, guests = split_roles(table)
        out = []
        if len(host_rows) and len(guests):
            hosts = _Hosts(metric, host_rows)
            asking = B.prepared(metric, B.matrix(guests.column(VEC)))
            floor = guests.column("_floor").to_numpy()
            reps, keys = guests.column(REP).to_numpy(), guests.column(KEY)
            for part in B.slices(len(asking), len(hosts.vectors)):
                row, at, good = hosts.best(asking[part], keep, floor[part])
                row = row + part.start
                out.append(
                    pa.table(
                        {
                            REP: pa.array(reps[row]),
                            KEY: keys.take(pa.array(row)).combine_chunks(),
                            "_cand": pa.array(hosts.ids[at]),
                            "_cand_key": hosts.keys.take(pa.array(at)),
                            "_good": pa.array(good),
                        }
                    )
                )
        return pa.concat_tables(out) if out else _no_candidates()

    return run


def _no_candidates() -> pa.Table:
    return pa.table(
        {
            REP: pa.array([], pa.int64()),
            KEY: pa.array([], pa.string()),
            "_cand": pa.array([], pa.int64()),
            "_cand_key": pa.array([], pa.string()),
            "_good": pa.array([], pa.float64()),
        }
    )


def _hosts(rows: DataFrame, members: int) -> tuple[DataFrame, int, int, int]:
    """Written distinct vectors, their number, dimension and longest id list."""
    size = F.size(VEC)
    distinct, facts = written_and_measured(
        distinct_with_members(rows, members),
        "distinct",
        F.count(F.lit(1)).alias("count"),
        F.min(size).alias("low"),
        F.max(size).alias("high"),
        F.max(F.size("_ids")).alias("held"),
    )
    if facts["low"] != facts["high"]:
        raise ValueError(f"Vectors differ in dimension: {facts['low']} and {facts['high']}.")
    return distinct, facts["count"], facts["high"] or 0, facts["held"] or 0


def _ranked(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy(REP).orderBy(F.desc("_good"), "_cand")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def _vector_schema(rows: DataFrame) -> str:
    return rows.schema[VEC].dataType.simpleString()


def neighbours(
    df: DataFrame,
    id: str,
    vec: str,
    key: str | None = None,
    metric: str = DEFAULT_METRIC,
    top_k: int = DEFAULT_TOP_K,
    decimals: int = DEFAULT_DECIMALS,
    threshold: float | None = None,
    probes: int | None = None,
    rows_per_block: int | None = None,
    asked: Column | None = None,
) -> DataFrame:
    """The ``top_k`` nearest other rows of every row: query_key, neighbor_key, rank, score.

    Ties go to the lowest id; a row is never its own neighbour, but another row with the same
    key may be. ``threshold`` keeps rounded cosine scores at or above it and is ignored for the
    other metrics. ``probes`` gives the approximate mode: only that many nearest cells are
    scored, each of them exactly. With ``asked`` only the rows that meet this condition are given
    neighbours, which are searched among all rows.
    """
    if top_k < 1:
        raise ValueError("top_k must be at least 1.")
    chosen = find_metric(metric)
    ship(df.sparkSession)
    rows = records(df, id, key, vec)
    keep = top_k + 1  # a row's own vector is among its candidates
    if asked is not None:
        some = records(df.where(asked), id, key, vec)
        asking, facts, found = _searched(some, rows, metric, keep, probes, rows_per_block)
        result = _for_members(some, asking, _ranked(found, keep), top_k, facts["copies"])
    else:
        distinct, count, dim, held = _hosts(rows, keep)
        found = _candidates(distinct, count, dim, metric, keep, probes, rows_per_block)
        if held <= 1:
            lists = _ranked(found.where(F.col(REP) != F.col("_cand")), top_k)
            result = lists.select(F.col(KEY).alias("_query"), "_cand_key", "rank", "_good")
        else:
            result = _for_members(rows, distinct, _ranked(found, keep), top_k)
    sign = -1.0 if chosen.ascending else 1.0
    result = result.select(
        F.col("_query").alias("query_key"),
        F.col("_cand_key").alias("neighbor_key"),
        F.col("rank").cast("int").alias("rank"),
        F.round(F.col("_good") * sign, decimals).alias("score"),
    )
    if threshold is not None and metric == "cosine":
        result = result.where(F.col("score") >= threshold)
    return result


def _candidates(
    distinct: DataFrame,
    count: int,
    dim: int,
    metric: str,
    keep: int,
    probes: int | None,
    rows_per_block: int | None,
) -> DataFrame:
    """Every distinct vector's candidate ids, the true best ``keep`` among them."""
    placed = place(distinct, count, dim, metric, rows_per_block)
    seed_schema = (
        f"{REP} long, {KEY} string, {VEC} {_vector_schema(distinct)}, _floor double, "
        "_targets array<int>, _cands array<struct<_cand: long, _cand_key: string, _good: double>>"
    )
    blocks = placed.rows.select(BLOCK, REP, KEY, VEC, "_ids", "_keys")
    seeds = by_group(blocks, [BLOCK], placed.blocks).applyInArrow(
        _seed(placed.layout, keep, probes), seed_schema
    )
    own = F.inline("_cands")
    if placed.blocks == 1:
        return seeds.select(REP, KEY, own)
    seeds, load = written_and_measured(seeds, "seeds", F.sum(F.size("_targets")).alias("visits"))
    visits = seeds.select(REP, KEY, VEC, "_floor", F.explode("_targets").alias(BLOCK))
    met = meetings(
        placed, visits, [REP, KEY, VEC, "_ids", "_keys"], [REP, KEY, VEC, "_floor"], alone=False
    )
    far = by_group(met, [BLOCK, "_group"], placed.groups(load["visits"] or 0)).applyInArrow(
        _visit(metric, keep), CANDIDATE
    )
    return seeds.select(REP, KEY, own).unionByName(far)


def _for_members(
    rows: DataFrame, distinct: DataFrame, ranked: DataFrame, top_k: int, widest: int | None = None
) -> DataFrame:
    """Give every copy the list of its vector, without itself."""
    entry = F.struct("rank", "_cand", "_cand_key", "_good")
    # A list holds at most top_k + 1 entries.
    lists = ranked.groupBy(REP).agg(F.sort_array(F.collect_list(entry)).alias("_list"))
    listed = distinct.select(REP, PRINT).join(lists, REP).drop(REP)
    spread = attach(rows.select(ID, KEY, PRINT), listed, [PRINT], "inner", widest=widest)
    others = F.slice(F.filter("_list", lambda e: e["_cand"] != F.col(ID)), 1, top_k)
    return spread.select(
        F.col(KEY).alias("_query"), F.posexplode(others).alias("_at", "_e")
    ).select(
        "_query",
        F.col("_e")["_cand_key"].alias("_cand_key"),
        (F.col("_at") + 1).alias("rank"),
        F.col("_e")["_good"].alias("_good"),
    )


def _first_block(layout: Broadcast):
    """Send every query to one block of its nearest cell."""

    def run(batches):
        plan: Layout = layout.value
        first = plan.first
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rows = B.prepared(plan.metric, B.matrix(table.column(VEC)))
            block = np.empty(len(rows), dtype=np.int32)
            rep = table.column(REP).to_numpy()
            for part in B.slices(len(rows), len(plan.centres)):
                near = B.gaps(plan.metric, rows[part], plan.centres)
                near[:, plan.blocks == 0] = np.inf
                cell = near.argmin(1)
                block[part] = first[cell] + rep[part] % plan.blocks[cell]
            yield from table.append_column(BLOCK, pa.array(block)).to_batches()

    return run


def _onward(layout: Broadcast, probes: int | None):
    """The further blocks a query has to visit once it has a floor."""

    def run(batches):
        plan: Layout = layout.value
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rows = B.prepared(plan.metric, B.matrix(table.column(VEC)))
            floor, seen = table.column("_floor").to_numpy(), table.column(BLOCK).to_numpy()
            targets = [
                wide_targets(
                    plan,
                    _cells_to_visit(plan, rows[part], floor[part], probes),
                    seen[part],
                    plan.near(rows[part], floor[part]) if probes is None else None,
                )
                for part in B.slices(len(rows), int(plan.blocks.sum()))
            ]
            table = table.append_column("_targets", pa.chunked_array(targets))
            yield from table.drop_columns([BLOCK]).to_batches()

    return run


def nearest(
    queries: DataFrame,
    id: str,
    vec: str,
    stored: DataFrame,
    stored_id: str,
    stored_vec: str,
    key: str | None = None,
    stored_key: str | None = None,
    metric: str = DEFAULT_METRIC,
    top_k: int = DEFAULT_TOP_K,
    decimals: int = DEFAULT_DECIMALS,
    probes: int | None = None,
    rows_per_block: int | None = None,
) -> DataFrame:
    """The ``top_k`` nearest stored rows of every query row: query_key, neighbor_key, rank, score."""
    if top_k < 1:
        raise ValueError("top_k must be at least 1.")
    chosen = find_metric(metric)
    ship(queries.sparkSession)
    asked = records(queries, id, key, vec)
    wanted = records(stored, stored_id, stored_key, stored_vec)
    asking, facts, found = _searched(asked, wanted, metric, top_k, probes, rows_per_block)
    ranked = _ranked(found, top_k)
    if (facts["copies"] or 0) > 1:
        entry = F.struct("rank", "_cand_key", "_good")
        lists = ranked.groupBy(REP).agg(F.collect_list(entry).alias("_list"))
        listed = asking.select(REP, PRINT).join(lists, REP).drop(REP)
        spread = attach(
            asked.select(KEY, PRINT), listed, [PRINT], "inner", widest=facts["copies"]
        )
        ranked = spread.select(KEY, F.inline("_list"))
    sign = -1.0 if chosen.ascending else 1.0
    return ranked.select(
        F.col(KEY).alias("query_key"),
        F.col("_cand_key").alias("neighbor_key"),
        F.col("rank").cast("int").alias("rank"),
        F.round(F.col("_good") * sign, decimals).alias("score"),
    )


def _searched(
    asked: DataFrame, stored: DataFrame, metric: str, top_k: int, probes: int | None, rows_per_block: int | None
) -> tuple[DataFrame, dict, DataFrame]:
    """The distinct vectors of asked records, facts of them, and their candidates among stored ones,
    the true best ``top_k`` of every vector among them."""
    size = F.size(VEC)
    asking, facts = written_and_measured(
        distinct_vectors(asked),
        "queries",
        F.count(F.lit(1)).alias("asked"),
        F.min(size).alias("low"),
        F.max(size).alias("high"),
        F.max("_copies").alias("copies"),
    )
    hosts, count, dim, _ = _hosts(stored, top_k)
    sizes = {facts["low"], facts["high"]} - {None}
    if count and sizes - {dim}:
        raise ValueError(f"Vectors differ in dimension: {sorted(sizes)} asked, {dim} stored.")
    placed = place(hosts, count, dim, metric, rows_per_block)
    host_cols, guest_cols = [REP, KEY, VEC, "_ids", "_keys"], [REP, KEY, VEC, "_floor"]
    nothing = F.lit(float("-inf"))

    def scored(visits: DataFrame, count: int) -> DataFrame:
        met = meetings(placed, visits, host_cols, guest_cols, alone=False)
        return by_group(met, [BLOCK, "_group"], placed.groups(count)).applyInArrow(
            _visit(metric, top_k), CANDIDATE
        )

    entering = asking.select(REP, KEY, VEC, nothing.alias("_floor"))
    if placed.blocks == 1:
        found = scored(entering.withColumn(BLOCK, F.lit(0)), facts["asked"])
    else:
        vector = _vector_schema(asking)
        state = f"{REP} long, {KEY} string, {VEC} {vector}, _floor double"
        entered = written(entering.mapInArrow(_first_block(placed.layout), f"{state}, {BLOCK} int"), "entered")
        near = written(scored(entered, facts["asked"]), "near")
        full = F.when(F.count(F.lit(1)) >= top_k, F.min("_good")).otherwise(nothing)
        floors = near.groupBy(REP).agg(full.alias("_best"))
        informed = entered.join(floors, REP, "left").select(
            REP, KEY, VEC, F.coalesce("_best", nothing).alias("_floor"), BLOCK
        )
        onward = informed.mapInArrow(
            _onward(placed.layout, probes), f"{state}, _targets array<int>"
        ).where(F.size("_targets") > 0)
        onward, load = written_and_measured(onward, "onward", F.sum(F.size("_targets")).alias("visits"))
        visits = onward.select(*guest_cols, F.explode("_targets").alias(BLOCK))
        found = near.unionByName(scored(visits, load["visits"] or 0))
    return asking, facts, found


def probed(asking: DataFrame, stored: DataFrame, late: DataFrame, centres: np.ndarray, counts: np.ndarray, probes: int, top_k: int) -> DataFrame:
    """The ``top_k`` best of every query by cosine in its ``probes`` nearest cells, and among the late rows.

    ``asking``: _rep, _key, _vec; ``stored``: _rep, _key, _vec and ``cell``; ``late`` the same without a
    cell. The answer to a query does not depend on the others. Cells are cut into blocks of bounded
    size by the id, and a block with many queries into groups. Returns CANDIDATE columns and rank.
    """
    ship(asking.sparkSession)
    size = BLOCK_ROWS[1]
    many = np.r_[-(-counts // size), -(-late.count() // size)]
    first = np.r_[0, np.cumsum(many)]
    total, outside = int(first[-1]), len(counts)
    shared = asking.sparkSession.sparkContext.broadcast((centres, counts))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, held = shared.value
        for batch in batches:
            unit = B.prepared("cosine", B.matrix(pa.chunked_array([batch.column(VEC)])))
            cells = []
            for part in B.slices(len(unit), len(points)):
                gap = B.gaps("cosine", unit[part], points)
                gap[:, held == 0] = np.inf
                near = np.argsort(gap, axis=1, kind="stable")[:, : min(probes, int((held > 0).sum()))]
                cells += [pa.array(n, pa.int32()) for n in near]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "_cells"])

    vector = _vector_schema(asking)
    chosen = asking.select(REP, KEY, VEC).mapInArrow(choose, f"{REP} long, {KEY} string, {VEC} {vector}, _cells array<int>")
    chosen = written(chosen, "chosen")
    # No more cells than the index has, which bounds them.
    wanted = [r["cell"] for r in chosen.select(F.explode("_cells").alias("cell")).distinct().collect()]
    starts = few_rows(asking.sparkSession, [(c, int(first[c]), int(many[c])) for c in range(outside + 1) if many[c]], "cell int, _first int, _n int")
    rows = stored.where(F.col("cell").isin(wanted)).unionByName(late.withColumn("cell", F.lit(outside)))
    placed = rows.join(F.broadcast(starts), "cell").select(
        (F.col("_first") + F.pmod(F.hash(REP), F.col("_n"))).cast("int").alias(BLOCK), REP, KEY, VEC, F.array(REP).alias("_ids"), F.array(KEY).alias("_keys"))
    going = chosen.select(REP, KEY, VEC, F.explode(F.concat("_cells", F.array(F.lit(outside)))).alias("cell")).join(F.broadcast(starts), "cell")
    visits = going.select(REP, KEY, VEC, F.lit(float("-inf")).alias("_floor"), F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)).alias(BLOCK))
    visits, load = written_and_measured(visits, "visits", F.count(F.lit(1)).alias("visits"))
    held = Placed(placed, shared, total, size)
    met = meetings(held, visits, [REP, KEY, VEC, "_ids", "_keys"], [REP, KEY, VEC, "_floor"], alone=False)
    found = by_group(met, [BLOCK, "_group"], max(1, held.groups(load["visits"] or 0))).applyInArrow(_visit("cosine", top_k), CANDIDATE)
    return _ranked(found, top_k)


SCANNED_QUERIES, SCANNED_BYTES = 4096, 32 << 20  # queries that one scan of the stored rows may serve


def scanned(
    stored: DataFrame, id: str, key: str, vec: str, asked: np.ndarray, metric: str, top_k: int
) -> DataFrame:
    """The ``top_k`` best stored rows of every query of a small matrix: _q, _cand, _cand_key, _good.

    One pass over the stored rows, which are not shuffled: a task keeps the best rows that it has
    seen, so it returns at most ``top_k`` rows per query, and those of all tasks are ranked.
    """
    ship(stored.sparkSession)
    shared = stored.sparkSession.sparkContext.broadcast(B.prepared(metric, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        q, good = np.zeros(0, np.int64), np.zeros(0)
        found = pa.table({"_cand": pa.array([], pa.int64()), "_cand_key": pa.array([], pa.string())})
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by("_cand")
            if not len(table):
                continue
            scorer = B.Scorer(metric, B.prepared(metric, B.matrix(table.column(VEC))))
            floor = np.full(len(queries), -np.inf)
            ends = np.flatnonzero(np.r_[q[1:] != q[:-1], True]) if len(q) else np.zeros(0, np.int64)
            full = np.bincount(q, minlength=len(queries))[q[ends]] >= top_k if len(ends) else np.zeros(0, bool)
            floor[q[ends[full]]] = good[ends[full]]
            for part in B.slices(len(queries), len(table)):
                row, col, value = scorer.best(queries[part], top_k, floor[part])
                if len(row):
                    q, good = np.r_[q, row + part.start], np.r_[good, value]
                    found = pa.concat_tables([found, table.select(["_cand", "_cand_key"]).take(pa.array(col))])
            order = np.lexsort((found.column("_cand").to_numpy(), -good, q))
            order = order[B.rank_in_runs(q[order]) < top_k]
            q, good, found = q[order], good[order], found.take(pa.array(order)).combine_chunks()
        if len(q):
            yield from found.append_column("_q", pa.array(q)).append_column("_good", pa.array(good)).to_batches()

    narrow = stored.select(F.col(id).cast("long").alias("_cand"), F.col(key).cast("string").alias("_cand_key"), F.col(vec).alias(VEC))
    best = narrow.where(F.col(VEC).isNotNull()).mapInArrow(run, "_cand long, _cand_key string, _q long, _good double")
    by_score = Window.partitionBy("_q").orderBy(F.desc("_good"), "_cand")
    return best.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top_k)
