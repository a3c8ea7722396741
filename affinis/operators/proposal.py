"""A match threshold proposed from the data: a histogram of pair scores and a mixture fitted to it.

The scores are counted inside the tasks that compute them, so no pair leaves a task, and a task returns at
most one row per bin. Most pairs are of unlike rows; pairs of the same thing score higher. Two normal
parts are fitted to the counts by expectation-maximisation, and the threshold is where a pair becomes
likelier to be of the upper part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import erf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..workspace import few_rows
from .cells import BLOCK, by_group, split_roles
from .copies import REP, VEC
from .pairs import matching_copies, near_pairs

BINS = 200
BIN = "bin int, low double, high double, pairs long"
ROUNDS = 500  # of one fit
STARTS = 16  # places where a fit begins
UNSURE = 0.01  # share of scores that may be scored a second time
APART = 2.0  # distance of the means, in mean deviations, from which two parts are told apart
_phi = np.vectorize(lambda z: 0.5 * (1.0 + erf(z / 2**0.5)), otypes=[float])


def _place(score, low: float, bins: int):
    return np.clip(np.floor((score - low) / ((1.0 - low) / bins)), 0, bins - 1).astype(np.int64)


def score_histogram(df: DataFrame, id: str, vec: str, low: float = -1.0, bins: int = BINS, rows_per_block: int | None = None) -> DataFrame:
    """How many unordered pairs of rows have a cosine in each of ``bins`` equal parts of [low, 1]: bin, low, high, pairs.

    The last bin includes 1; pairs below ``low`` are not counted. A bound above -1 lets the join skip blocks
    as that of ``similar_pairs`` does; without one, all pairs of different vectors are scored. Copies
    are scored once and counted by their number. Rows without a vector take no part, zero vectors have cosine 0
    with everything, an empty table has empty bins.
    """
    if not -1.0 <= low < 1.0 or bins < 1:
        raise ValueError("The histogram needs low in [-1, 1) and at least one bin.")
    # Rounding may put the score of opposite vectors below -1.
    near = near_pairs(df, id, vec, metric="cosine", bound=low if low > -1.0 else -2.0, rows_per_block=rows_per_block)

    def counted_of(total: np.ndarray) -> pa.RecordBatch:
        seen = np.flatnonzero(total)
        return pa.RecordBatch.from_pydict({"bin": seen.astype(np.int32), "pairs": total[seen]})

    def count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts, guests = split_roles(pa.Table.from_batches(batches))
        total = np.zeros(bins, dtype=np.int64)
        if len(hosts):
            held = B.prepared("cosine", B.matrix(hosts.column(VEC)))
            many = hosts.column("_copies").to_numpy()
            sides = [(held, many, True)] if key[1].as_py() == 0 else []
            if len(guests):
                sides.append((B.prepared("cosine", B.matrix(guests.column(VEC))), guests.column("_copies").to_numpy(), False))
            _count(total, held, many, sides, low)
        yield counted_of(total)

    class Counting:
        """The bins of all pairs of a task in a round."""

        def __init__(self) -> None:
            self.total = np.zeros(bins, dtype=np.int64)

        def meet(self, block: int, hosts: pa.Table, guests: pa.Table, vectors: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
            held = B.prepared("cosine", B.matrix(hosts.column(VEC)))
            copies = guests.column("_copies").to_numpy()[at]
            _count(self.total, held, hosts.column("_copies").to_numpy(), [(vectors[at], copies, False)], low)
            yield from ()

        def passed(self, guests: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from ()

        def ended(self) -> Iterator[pa.RecordBatch]:
            yield counted_of(self.total)

    schema = "bin int, pairs long"
    counted = by_group(near.met.select(BLOCK, "_group", "_visits", REP, VEC, "_copies"), [BLOCK, "_group"], near.tasks)
    counted = counted.applyInArrow(count, schema)
    if near.placed is not None:
        counted = counted.unionByName(near.visited(lambda _: Counting(), schema))
    if near.has_copies:
        width = (1.0 - low) / bins
        own = F.least(F.lit(bins - 1), F.floor((F.col("_good") - low) / width)).cast("int")
        copies = matching_copies(near).select(own.alias("bin"), F.expr("_copies * (_copies - 1) div 2").alias("pairs"))
        counted = counted.unionByName(copies)
    edges = [low + (1.0 - low) * b / bins for b in range(bins)] + [1.0]
    every = few_rows(df.sparkSession, [(b, edges[b], edges[b + 1]) for b in range(bins)], "bin int, low double, high double")
    sums = counted.groupBy("bin").agg(F.sum("pairs").alias("pairs"))
    return F.broadcast(every).join(sums, "bin", "left").select("bin", "low", "high", F.coalesce("pairs", F.lit(0)).cast("long").alias("pairs"))


def _count(total: np.ndarray, held: np.ndarray, many: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray, bool]], low: float) -> None:
    """Add the pairs of prepared hosts with the sides (prepared vectors, their copies, whether they are the hosts)."""
    bins = len(total)
    # Where a FLOAT product leaves many scores near an edge, DOUBLE is less work.
    wide = 4 * np.finfo(np.float32).eps * (held.shape[1] + 8) * bins / (1.0 - low) > UNSURE
    scorer = B.Scorer("cosine", held, exact_screen=bool(wide))
    for vectors, copies, within in sides:
        for own, part, place in scorer.binned(vectors, low, bins, within):
            a, b = copies[own], many[part]
            if (a == 1).all() and (b == 1).all():
                total += np.bincount((place + 1).ravel(), minlength=bins + 1)[1:]
                continue
            # Copies are counted in whole numbers: one count for each number of copies on either side.
            for n in np.unique(b):
                held_by = place[:, b == n] + 1
                for m in np.unique(a):
                    total += m * n * np.bincount(held_by[a == m].ravel(), minlength=bins + 1)[1:]


@dataclass(frozen=True)
class Mixture:
    """Two normal parts, the lower one first, and the threshold between them."""

    weights: tuple[float, float]
    means: tuple[float, float]
    deviations: tuple[float, float]
    likelihood: float
    threshold: float


def proposed_threshold(histogram: DataFrame, certainty: float = 0.5) -> Mixture | None:
    """The mixture fitted to the bins of ``score_histogram``; None where the scores do not fall into two parts.

    Fits begin at 16 cuts of the occupied range, and the likeliest one is taken whose means are more
    than two deviations apart and whose upper part is the smaller one, so the result is the same on
    every run. It has to be likelier than one part by more than its three further numbers explain (BIC). What a histogram that begins
    above -1 does not show of the lower part is estimated with it; it must begin below that part's mean. The threshold is the lowest bin
    edge above the lower mean from which a pair is of the upper part with at least ``certainty``.
    """
    rows = sorted(histogram.collect(), key=lambda r: r["bin"])  # as many rows as bins
    counts = np.array([r["pairs"] for r in rows], dtype=float)
    edges = np.array([*[r["low"] for r in rows], rows[-1]["high"]])
    return fitted(counts, edges, certainty)


def fitted(counts: np.ndarray, edges: np.ndarray, certainty: float = 0.5) -> Mixture | None:
    occupied = np.flatnonzero(counts)
    if len(occupied) < 2:
        return None
    first, last = occupied[0], occupied[-1] + 1
    cuts = np.unique(np.linspace(first + 1, last - 1, STARTS).round().astype(int))
    below = np.arange(len(counts))[None, :] < cuts[:, None]
    single = _fit(counts, edges, np.ones((1, len(counts))))
    needed = 1.5 * np.log(counts.sum()) + (single[3] if single else -np.inf)
    fits = [f for f in (_fit(counts, edges, np.array([b, ~b], dtype=float)) for b in below) if f and f[3] > needed]
    parted = [m for m in (_parted(*f, edges, certainty) for f in fits) if m is not None]
    return max(parted, key=lambda f: f.likelihood, default=None)  # the first of equal ones


def _mass(edges: np.ndarray, weight: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """What each part gives each bin. Scores end at -1 and 1, so the outer bins hold all beyond them."""
    inner = np.r_[edges[0] if edges[0] > -1.0 else -np.inf, edges[1:-1], np.inf]
    return np.diff(_phi((inner[None, :] - mean[:, None]) / spread[:, None]), axis=1) * weight[:, None] + 1e-300


def _parted(weight: np.ndarray, mean: np.ndarray, spread: np.ndarray, likelihood: float, edges: np.ndarray, certainty: float) -> Mixture | None:
    low, high = np.argsort(mean, kind="stable")
    if mean[high] - mean[low] <= APART * np.sqrt((spread**2).mean()) or weight[high] > weight[low] or mean[low] <= edges[0]:
        return None
    mass, middle = _mass(edges, weight, mean, spread), (edges[:-1] + edges[1:]) / 2
    sure = (mass[high] >= certainty * mass.sum(0)) | (middle >= mean[high])
    unsure = np.flatnonzero(~sure | (middle <= mean[low]))
    at = int(unsure[-1]) + 1 if len(unsure) else 0
    if at >= len(middle):
        return None
    pair = lambda values: (float(values[low]), float(values[high]))
    return Mixture(pair(weight), pair(mean), pair(spread), likelihood, float(edges[at]))


def _fit(counts: np.ndarray, edges: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float] | None:
    """Weights, means, deviations and likelihood of as many parts as ``share`` has rows, which says where they begin."""
    middle, width, total = (edges[:-1] + edges[1:]) / 2, edges[1] - edges[0], counts.sum()
    hidden = edges[0] > -1.0  # pairs below the first edge were not counted
    unseen, tail = 0.0, np.zeros((3, len(share)))  # of the pairs below the first edge: share, first and second moment by part
    before = -np.inf
    for _ in range(ROUNDS):
        seen = share * counts
        size = seen.sum(1) + unseen * tail[0]
        if (size < 0.5).any():
            return None
        mean = np.clip((seen @ middle + unseen * tail[0] * tail[1]) / size, -1.0, 1.0)
        square = (seen @ middle**2 + unseen * tail[0] * tail[2]) / size
        spread = np.sqrt(np.clip(square - mean**2, width**2, 1.0))
        weight = size / size.sum()
        mass = _mass(edges, weight, mean, spread)
        told = min(1.0, mass.sum())
        likelihood = float(counts @ np.log(mass.sum(0) / told))
        share = mass / mass.sum(0)
        if hidden:
            z = (edges[0] - mean) / spread
            below = np.maximum(_phi(z), 1e-300)
            # Mean of a normal cut off above z; next to nothing is lost where the part lies far above.
            fall = np.where(below > 1e-12, np.exp(-(z**2) / 2) / np.sqrt(2 * np.pi) / below, 0.0)
            lost = weight * below
            unseen = total * min(lost.sum() / max(told, 1e-9), 100.0)
            at = mean - spread * fall
            tail = np.array([lost / lost.sum(), at, spread**2 * np.maximum(1 - z * fall - fall**2, 0.0) + at**2])
        if abs(likelihood - before) <= 1e-9 * abs(likelihood):
            break
        before = likelihood
    return weight, mean, spread, likelihood
