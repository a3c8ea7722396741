"""Similarity self-join: the pairs of rows whose score is within a bound.

Distinct vectors are laid out in cells. A vector visits another cell only if the cell's bound
reaches the wanted score, and of two cells only one side travels, so each pair of blocks meets
once. Blocks are scored by one matrix product and only pairs within the bound leave a task; the
dense score matrix never exists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions.vectors import find_metric
from ..settings import DEFAULT_METRIC
from ..workspace import fill_cores, release, ship, written, written_and_measured
from .cells import BLOCK, Layout, Placed, block_rows, by_group, meetings, place, split_roles, wide_targets
from .components import components
from .copies import ID, KEY, PRINT, REP, VEC, distinct_vectors, members, records
from .lookup import attach
from .rounds import SHIPPED, VISITING, Linking, Listing, Meeting, in_rounds, reduced

PAIR = (
    "_a long, _a_key string, _a_copies long, _b long, _b_key string, _b_copies long, _good double"
)
COPIES_PER_SHARE = 50_000
TOGETHER = 4096  # fewest rows of a block that another table visits, where memory allows
LINK = "_rep long, _root long, _n long, _best double"


@dataclass(frozen=True)
class Near:
    """Distinct vectors laid out so that all near pairs meet, and what brings copies back."""

    rows: DataFrame  # _id, _key, _vec, _print
    distinct: DataFrame  # _rep, _key, _copies, _vec, _print
    met: DataFrame  # hosts and visitors by block; with ``placed`` the hosts alone
    tasks: int
    metric: str
    floor: float  # lowest goodness of a near pair
    most_copies: int  # rows of the commonest vector
    placed: Placed | None = None  # where visits would fill the disk: visitors stay where they are and hosts come in rounds

    @property
    def has_copies(self) -> bool:
        return self.most_copies > 1

    @cached_property
    def pairs(self) -> DataFrame:
        """Every near pair of distinct vectors, written once: PAIR columns with _a < _b."""
        grouped = by_group(self.met, [BLOCK, "_group"], self.tasks)
        own = written(grouped.applyInArrow(_score(self.metric, self.floor), PAIR), "pairs")
        metric, floor = self.metric, self.floor
        return own if self.placed is None else own.unionByName(self.visited(lambda _: Listing(_listed(metric, floor)), PAIR))

    @cached_property
    def links(self) -> DataFrame:
        """What the near pairs amount to per vector and task, without listing them.

        _rep, _root (lowest vector it is linked to inside the task), _n (matching rows), _best
        (best goodness). Each task returns at most one row per vector it holds, so a crowd of
        near copies costs its size and not its square.
        """
        # A crowd of near copies fills whole groups with work, which are tasks of their own.
        grouped = by_group(self.met, [BLOCK, "_group"], self.tasks, 1)
        own = written(grouped.applyInArrow(_link(self.metric, self.floor), LINK), "links")
        metric, floor = self.metric, self.floor
        return own if self.placed is None else own.unionByName(self.visited(lambda rows: Linking(metric, floor, rows), LINK))

    def visited(self, begin: Callable[[dict[int, int]], Meeting], schema: str) -> DataFrame:
        """What the meetings of different blocks yield, in rounds."""
        rows, layout, floor = self.placed.rows.select(BLOCK, REP, KEY, VEC, "_copies"), self.placed.layout, self.floor

        def targets(guests: pa.Table, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            lists = pa.chunked_array(_targets(layout.value, vectors, guests.column(BLOCK).to_numpy(), floor)).combine_chunks()
            return _flat(lists)

        return in_rounds(rows, rows, self.placed.blocks, self.metric, targets, begin, schema)

    @property
    def listed(self) -> bool:
        return "pairs" in self.__dict__

    def edges(self) -> DataFrame:
        """Edges with the same components as the near pairs: _a, _b."""
        if self.listed:
            return self.pairs.select("_a", "_b")
        joined = self.links.where(F.col(REP) != F.col("_root"))
        return joined.select(F.col("_root").alias("_a"), F.col(REP).alias("_b"))

    def per_vector(self) -> DataFrame:
        """_rep, _n, _best: may hold several rows per vector, to be added up."""
        if not self.listed:
            return self.links.drop("_root")
        each = [
            F.struct(F.col("_a").alias(REP), F.col("_b_copies").alias("_n"), F.col("_good").alias("_best")),
            F.struct(F.col("_b").alias(REP), F.col("_a_copies").alias("_n"), F.col("_good").alias("_best")),
        ]
        return self.pairs.select(F.inline(F.array(*each)))


def _reach(layout: Broadcast, bound: float):
    """The blocks each vector has to visit so that every pair of blocks meets exactly once."""

    def run(batches):
        plan: Layout = layout.value
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rows = B.prepared(plan.metric, B.matrix(table.column(VEC)))
            targets = _targets(plan, rows, table.column(BLOCK).to_numpy(), bound)
            table = table.append_column("_targets", pa.chunked_array(targets))
            yield from table.drop_columns([BLOCK]).to_batches()
            del batch, table, rows, targets
            release()

    return run


def _visits(layout: Broadcast, bound: float):
    """The number of visits of each batch."""

    def run(batches):
        for batch in batches:
            rows = B.prepared(layout.value.metric, B.matrix(pa.chunked_array([batch.column(VEC)])))
            lists = _targets(layout.value, rows, batch.column(BLOCK).to_numpy(), bound)
            yield pa.RecordBatch.from_pydict({"n": [sum(len(t.flatten()) for t in lists)]})
            del batch, rows, lists
            release()

    return run


def _targets(plan: Layout, rows: np.ndarray, own: np.ndarray, bound: float) -> list[pa.ListArray]:
    """The blocks that prepared vectors visit, by slices."""
    first = plan.first
    cell_of = np.repeat(np.arange(len(plan.blocks)), plan.blocks)
    targets = []
    for part in B.slices(len(rows), max(1, int(first[-1]))):
        hope = B.best_possible(plan.metric, rows[part], plan.centres, plan.radius)
        mine = own[part]
        cells = hope >= bound - B.SLACK * (1 + abs(bound))
        # A pair of cells meets on one side: the parity rule spreads the travel evenly.
        home = cell_of[mine][:, None]
        other = np.arange(len(plan.blocks))[None, :]
        cells &= ((home < other) ^ ((home + other) % 2 == 1)) | (home == other)
        lists = wide_targets(plan, cells, mine, plan.near(rows[part], np.full(len(mine), bound)))
        targets.append(_one_way_within(lists, mine, cell_of))
    return targets


def _flat(lists: pa.ListArray | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and block of every visit."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy()


def _one_way_within(lists: pa.ListArray, own: np.ndarray, cell_of: np.ndarray) -> pa.ListArray:
    """Between blocks of the same cell only one side travels too."""
    sizes = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(own)), sizes)
    target = lists.flatten().to_numpy()
    mine = own[row]
    goes = (cell_of[mine] != cell_of[target]) | ((mine < target) ^ ((mine + target) % 2 == 1))
    offsets = np.r_[0, np.cumsum(np.bincount(row[goes], minlength=len(own)))]
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.array(target[goes].astype(np.int32))
    )


def _grouped(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, pa.Table]:
    return split_roles(pa.Table.from_batches(batches))


def _listed(metric: str, floor: float):
    """List the near pairs of visitors, whose prepared vectors are given, and hosts, one slice of the scores at a time."""

    def found(left: pa.Table, a: np.ndarray, right: pa.Table, within: bool = False) -> Iterator[pa.RecordBatch]:
        b = a if within else B.prepared(metric, B.matrix(right.column(VEC)))
        a_id, b_id = left.column(REP).to_numpy(), right.column(REP).to_numpy()
        a_n, b_n = left.column("_copies").to_numpy(), right.column("_copies").to_numpy()
        scorer = B.Scorer(metric, b)
        for part in B.slices(len(a), B.SCORE_CELLS // B.TILE[0]):
            i, j, value = scorer.above(a[part], floor)
            i = i + part.start
            if within:
                once = a_id[i] < b_id[j]
                i, j, value = i[once], j[once], value[once]
            swap = a_id[i] > b_id[j]
            left_key = left.column(KEY).take(i).combine_chunks()
            right_key = right.column(KEY).take(j).combine_chunks()
            flag = pa.array(swap)
            yield pa.RecordBatch.from_pydict(
                {
                    "_a": np.where(swap, b_id[j], a_id[i]),
                    "_a_key": pc.if_else(flag, right_key, left_key),
                    "_a_copies": np.where(swap, b_n[j], a_n[i]),
                    "_b": np.where(swap, a_id[i], b_id[j]),
                    "_b_key": pc.if_else(flag, left_key, right_key),
                    "_b_copies": np.where(swap, a_n[i], b_n[j]),
                    "_good": value,
                }
            )

    return found


def _score(metric: str, floor: float):
    """List the near pairs of a group."""
    found = _listed(metric, floor)

    def run(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        hosts, guests = _grouped(batches)
        if len(hosts) and key[1].as_py() == 0:
            yield from found(hosts, B.prepared(metric, B.matrix(hosts.column(VEC))), hosts, within=True)
        if len(hosts) and len(guests):
            yield from found(guests, B.prepared(metric, B.matrix(guests.column(VEC))), hosts)

    return run


def _link(metric: str, floor: float):
    """Reduce the near pairs of a group to counts, best scores and links per vector."""

    def run(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        hosts, guests = _grouped(batches)
        if not len(hosts):
            return
        # Nodes are numbered in id order, so the lowest node is the lowest id.
        ids = np.concatenate([hosts.column(REP).to_numpy(), guests.column(REP).to_numpy()])
        order = np.argsort(ids, kind="stable")
        node = np.empty(len(ids), dtype=np.int64)
        node[order] = np.arange(len(ids))
        h = B.prepared(metric, B.matrix(hosts.column(VEC)))
        scorer = B.Scorer(metric, h)
        h_node, h_n = node[: len(hosts)], hosts.column("_copies").to_numpy()

        def sides():
            if key[1].as_py() == 0:
                yield h, h_node, h_n, True
            # Visitors are spread out in DOUBLE a portion at a time, in whole tiles.
            for at in range(0, len(guests), VISITING):
                part = guests.slice(at, VISITING)
                own = node[len(hosts) + at :][: len(part)]
                yield B.prepared(metric, B.matrix(part.column(VEC))), own, part.column("_copies").to_numpy(), False

        labels, rows, best = reduced(scorer, floor, h_node, h_n, sides(), len(ids))
        linked = rows[node] > 0
        yield pa.RecordBatch.from_pydict(
            {
                REP: ids[linked],
                "_root": ids[order][labels[node[linked]]],
                "_n": rows[node][linked].astype(np.int64),
                "_best": best[node][linked],
            }
        )
        del hosts, guests, h, scorer
        release()

    return run


def facts_of() -> tuple[Column, ...]:
    """What is measured of distinct vectors as they are written."""
    size = F.size(VEC)
    return F.count(F.lit(1)).alias("count"), F.min(size).alias("low"), F.max(size).alias("high"), F.max("_copies").alias("copies")


def near_pairs(
    df: DataFrame,
    id: str,
    vec: str,
    key: str | None = None,
    metric: str = DEFAULT_METRIC,
    bound: float = 0.9,
    rows_per_block: int | None = None,
) -> Near:
    """Lay the distinct vectors out so that every pair with a score within ``bound`` meets."""
    find_metric(metric)
    ship(df.sparkSession)
    rows = records(df, id, key, vec)
    distinct, facts = written_and_measured(distinct_vectors(rows), "distinct", *facts_of())
    return near_of(rows, distinct, facts, metric, bound, rows_per_block)


def near_of(rows: DataFrame, distinct: DataFrame, facts: dict, metric: str, bound: float, rows_per_block: int | None = None) -> Near:
    """``near_pairs`` of records whose distinct vectors are written, with ``facts_of`` these."""
    chosen = find_metric(metric)
    if facts["low"] != facts["high"]:
        raise ValueError(f"Vectors differ in dimension: {facts['low']} and {facts['high']}.")
    floor = -bound if chosen.ascending else bound
    placed = place(distinct, facts["count"], facts["high"] or 0, metric, rows_per_block)
    cols = [REP, KEY, VEC, "_copies"]
    hosts = placed.rows.select(BLOCK, *cols)
    if placed.blocks == 1:
        met = hosts.withColumn("_group", F.lit(0)).withColumn("_visits", F.lit(False))
        tasks = 1
    else:
        # Counted before they are shipped: where all visit all, blocks come to the visitors instead.
        visits = fill_cores(hosts).mapInArrow(_visits(placed.layout, floor), "n long").agg(F.sum("n")).first()[0] or 0
        if visits > SHIPPED * facts["count"]:
            met = hosts.withColumn("_group", F.lit(0)).withColumn("_visits", F.lit(False))
            return Near(rows, distinct, met, placed.blocks, metric, floor, facts["copies"] or 0, placed)
        vector = distinct.schema[VEC].dataType.simpleString()
        reached = fill_cores(hosts).mapInArrow(
            _reach(placed.layout, floor),
            f"{REP} long, {KEY} string, {VEC} {vector}, _copies long, _targets array<int>",
        )
        going = reached.where(F.size("_targets") > 0)
        going = written(going, "visits").select(*cols, F.explode("_targets").alias(BLOCK))
        met = meetings(placed, going, cols, cols, alone=True)
        tasks = placed.groups(visits)
    return Near(rows, distinct, met, tasks, metric, floor, facts["copies"] or 0)


def _visited(layout: Broadcast, bound: float):
    """The blocks that may hold a row near a row of another table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Layout = layout.value
        for batch in batches:
            rows = B.prepared(plan.metric, B.matrix(pa.chunked_array([batch.column(VEC)])))
            whole = _open_to(plan, rows, bound)
            yield pa.RecordBatch.from_arrays([*batch.columns, whole], [*batch.schema.names, "_targets"])

    return run


def _open_to(plan: Layout, rows: np.ndarray, bound: float) -> pa.ListArray:
    targets = []
    for part in B.slices(len(rows), max(1, int(plan.first[-1]))):
        cells = B.best_possible(plan.metric, rows[part], plan.centres, plan.radius) >= bound - B.SLACK * (1 + abs(bound))
        mask = np.repeat(cells, plan.blocks, axis=1)
        near = plan.near(rows[part], np.full(len(mask), bound))
        row, block = np.nonzero(mask if near is None else mask & near)
        ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(mask)))]
        targets.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(block.astype(np.int32))))
    return pa.concat_arrays(targets) if targets else pa.array([], pa.list_(pa.int32()))


def _open_visits(layout: Broadcast, bound: float):
    """The number of visits of each batch to blocks of another table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = B.prepared(layout.value.metric, B.matrix(pa.chunked_array([batch.column(VEC)])))
            yield pa.RecordBatch.from_pydict({"n": [len(_open_to(layout.value, rows, bound).flatten())]})
            del batch, rows
            release()

    return run


def _crossed(floor: float):
    def found(guests: pa.Table, vectors: np.ndarray, hosts: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b = guests.column(REP).to_numpy(), hosts.column(REP).to_numpy()
        scorer = B.Scorer("cosine", B.prepared("cosine", B.matrix(hosts.column(VEC))))
        for part in B.slices(len(a), B.SCORE_CELLS // B.TILE[0]):
            i, j, value = scorer.above(vectors[part], floor)
            yield pa.RecordBatch.from_pydict({"_a": a[i + part.start], "_b": b[j], "_good": value})

    return found


def _between(metric: str, floor: float, linked: bool):
    """The near pairs of visitors and hosts; with ``linked`` only edges with the same components, one a row at most."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts, guests = _grouped(batches)
        if not len(hosts) or not len(guests):
            return
        a, b = guests.column(REP).to_numpy(), hosts.column(REP).to_numpy()
        vectors = B.prepared(metric, B.matrix(guests.column(VEC)))
        scorer = B.Scorer(metric, B.prepared(metric, B.matrix(hosts.column(VEC))))
        if linked:
            ids, labels = np.r_[a, b], np.arange(len(a) + len(b))
            nodes = np.arange(len(ids))
            for met in scorer.met(vectors, floor):
                if met.near is None:
                    labels = B.joined_labels(labels, met.i, met.j + len(a))
                else:
                    labels = B.joined_crowd(labels, met.near, nodes[met.own], nodes[len(a) :][met.part])
            leaf = np.flatnonzero(labels != np.arange(len(ids)))
            yield pa.RecordBatch.from_pydict({"_a": ids[labels[leaf]], "_b": ids[leaf], "_good": np.zeros(len(leaf))})
            return
        for part in B.slices(len(a), B.SCORE_CELLS // B.TILE[0]):
            i, j, value = scorer.above(vectors[part], floor)
            yield pa.RecordBatch.from_pydict({"_a": a[i + part.start], "_b": b[j], "_good": value})

    return run


def across(left: DataFrame, right: DataFrame, bound: float, linked: bool = False) -> DataFrame:
    """The near pairs of the distinct vectors of two tables (_rep, _vec, _print): _a, _b, _good by cosine.

    The right side is laid out in cells and blocks, and a vector of the left one visits the blocks that may
    hold a near one. With ``linked``, which needs ids that differ between the sides, _a and _b are edges
    with the same components as the pairs, so a crowd of near rows costs its size.
    """
    ship(left.sparkSession)
    size = F.size(VEC)
    (l, r) = [side.agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("low"), F.max(size).alias("high")).first() for side in (left, right)]
    sizes = {f[c] for f in (l, r) for c in ("low", "high")} - {None}
    if len(sizes) > 1:
        raise ValueError(f"Vectors differ in dimension: {min(sizes)} and {max(sizes)}.")
    dim = max(sizes, default=0)
    cores = left.sparkSession.sparkContext.defaultParallelism
    rows = max(block_rows(r["n"], dim, cores), min(TOGETHER, block_rows(1 << 40, dim, 1)))
    placed = place(right.select(PRINT, REP, VEC), r["n"], dim, "cosine", rows)
    vector = left.schema[VEC].dataType.simpleString()
    if placed.blocks == 1:
        visits, number = left.select(REP, VEC).withColumn(BLOCK, F.lit(0)), l["n"]
    else:
        layout, guests = placed.layout, left.select(REP, VEC)
        count = guests.mapInArrow(_open_visits(layout, bound), "n long").agg(F.sum("n")).first()[0] or 0
        if count > SHIPPED * max(l["n"], r["n"]):
            targets = lambda _, vectors: _flat(_open_to(layout.value, vectors, bound))
            begin, schema = (lambda rows: Linking("cosine", bound, rows)), LINK
            if not linked:
                begin, schema = (lambda _: Listing(_crossed(bound))), "_a long, _b long, _good double"
            met = in_rounds(guests, placed.rows.select(BLOCK, REP, VEC), placed.blocks, "cosine", targets, begin, schema)
            edge = [F.col("_root").alias("_a"), F.col(REP).alias("_b"), F.lit(0.0).alias("_good")]
            return met.where(F.col(REP) != F.col("_root")).select(*edge) if linked else met
        going = left.select(REP, VEC).mapInArrow(_visited(placed.layout, bound), f"{REP} long, {VEC} {vector}, _targets array<int>")
        going, load = written_and_measured(going.where(F.size("_targets") > 0), "visits", F.sum(F.size("_targets")).alias("visits"))
        visits, number = going.select(REP, VEC, F.explode("_targets").alias(BLOCK)), load["visits"] or 0
    met = meetings(placed, visits, [REP, VEC], [REP, VEC], alone=False)
    return by_group(met, [BLOCK, "_group"], placed.groups(number)).applyInArrow(_between("cosine", bound, linked), "_a long, _b long, _good double")


def own_goodness(metric: str):
    """Goodness of a vector against a copy of itself, as a native column."""
    from ..functions import vectors as V

    if metric == "cosine":
        return F.when(V.norm(VEC) == 0, F.lit(0.0)).otherwise(F.lit(1.0))
    if metric == "dot":
        return V.dot(VEC, VEC)
    return F.lit(0.0)


def matching_copies(near: Near) -> DataFrame:
    """Distinct vectors whose copies match each other: _rep, _copies, _good."""
    return (
        near.distinct.where(F.col("_copies") > 1)
        .select(REP, "_copies", own_goodness(near.metric).alias("_good"))
        .where(F.col("_good") >= near.floor)
    )


def _shares(copies):
    """The shares that the copies of one vector are dealt into."""
    return F.greatest(F.lit(1), F.ceil(copies / COPIES_PER_SHARE)).cast("long")


def row_pairs(
    near: Near, pairs: DataFrame | None = None, same: DataFrame | None = None
) -> DataFrame:
    """Near pairs of rows: _i, _i_key, _j, _j_key, _good with _i < _j.

    This is the pair relation in full, so copies of one vector appear with each other. Its size
    is the size of the answer; the group operators work from ``Near.links`` and never build it.
    Further columns of ``pairs`` and ``same`` (the copies that match each other) are kept.
    """
    pairs = near.pairs if pairs is None else pairs
    extra = [c for c in pairs.columns if c not in near.pairs.columns]
    if not near.has_copies:
        return pairs.select(
            F.col("_a").alias("_i"),
            F.col("_a_key").alias("_i_key"),
            F.col("_b").alias("_j"),
            F.col("_b_key").alias("_j_key"),
            "_good",
            *extra,
        )
    if same is None:
        same = matching_copies(near)
    rows = written(members(near.rows, near.distinct, near.most_copies), "members")
    copies = F.col("_copies")
    linked = pairs.select("_a", "_b", "_a_copies", "_b_copies", "_good", *extra).unionByName(
        same.select(
            *[F.col(REP).alias(n) for n in ("_a", "_b")], *[copies.alias(n) for n in ("_a_copies", "_b_copies")], "_good", *extra
        )
    )
    # The copies of a vector are dealt into shares of bounded size, and a pair goes to every share.
    share = F.pmod(F.xxhash64(ID), _shares(copies)).cast("int")
    left = rows.select(F.col(REP).alias("_a"), share.alias("_ga"), F.struct(ID, KEY).alias("_l"))
    right = rows.select(F.col(REP).alias("_b"), share.alias("_gb"), F.struct(ID, KEY).alias("_r"))

    def every(copies: str):
        return F.explode(F.sequence(F.lit(0), (_shares(F.col(copies)) - 1).cast("int")))

    met = linked.withColumn("_ga", every("_a_copies")).join(left, ["_a", "_ga"])
    met = met.withColumn("_gb", every("_b_copies")).join(right, ["_b", "_gb"])
    met = met.where((F.col("_a") != F.col("_b")) | (F.col("_l")[ID] < F.col("_r")[ID]))
    # Structs order by their first field, the id.
    return met.select(F.least("_l", "_r").alias("_l"), F.greatest("_l", "_r").alias("_r"), "_good", *extra).select(
        F.col("_l")[ID].alias("_i"),
        F.col("_l")[KEY].alias("_i_key"),
        F.col("_r")[ID].alias("_j"),
        F.col("_r")[KEY].alias("_j_key"),
        "_good",
        *extra,
    )


def linked_rows(near: Near) -> DataFrame:
    """Every row with the class it is in and the number of rows it is near: _id, class_id, links.

    A class is what near pairs connect, known by its lowest id; a row that is near no other is a class of its own.
    Copies are counted and not listed, so the result has a row per row and none per pair.
    """
    same = written(matching_copies(near), "same")
    counts = near.per_vector().select(REP, "_n").unionByName(same.select(REP, (F.col("_copies") - 1).alias("_n")))
    roots = components(near.edges()).select(F.col("node").alias(REP), "root")
    facts = counts.groupBy(REP).agg(F.sum("_n").cast("long").alias("links")).join(roots, REP, "left")
    facts = facts.select(REP, "links", F.coalesce("root", REP).alias("class_id"))
    if near.has_copies:
        rows = members(near.rows, near.distinct, near.most_copies).select(ID, REP)
    else:
        rows = near.distinct.select(F.col(REP).alias(ID), REP)
    told = attach(rows, facts, [REP], widest=near.most_copies)
    return told.select(ID, F.coalesce("class_id", ID).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def similar_pairs(
    df: DataFrame,
    id: str,
    vec: str,
    metric: str,
    bound: float,
    key: str | None = None,
    decimals: int | None = None,
    rows_per_block: int | None = None,
) -> DataFrame:
    """All unordered pairs of rows within ``bound``: id_a, id_b, score.

    ``bound`` is a lowest similarity (cosine, dot) or a largest distance (euclidean,
    manhattan). A zero vector has cosine 0 with everything.
    """
    near = near_pairs(df, id, vec, key, metric, bound, rows_per_block)
    score = F.col("_good") * (-1.0 if find_metric(metric).ascending else 1.0)
    return row_pairs(near).select(
        F.col("_i").alias("id_a"),
        F.col("_j").alias("id_b"),
        (score if decimals is None else F.round(score, decimals)).alias("score"),
    )
