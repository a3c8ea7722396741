"""NumPy kernels that score one block of vectors against another inside an Arrow task.

Every kernel works on *goodness*: the score itself for cosine and dot, the negated distance
for euclidean and manhattan, so that larger is always better.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SCORE_CELLS = 500_000  # scores held at once; larger blocks are scored in row slices
TILE = (256, 4096)  # rows and columns of one product, which stay in a core's cache
EXACT = 4096  # pairs of a tile that are all scored in DOUBLE; of more, only those that are unsure or may be best
CROWD = 16  # a tile with one near pair in so many is a crowd, whose pairs are not listed
GRID = 256  # fewest whole numbers that a manhattan screen tells apart
SLACK = 1e-6  # widens every bound, so rounding can only cost work and never a result


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """An Arrow list column as an (n, d) DOUBLE matrix."""
    rows = len(column)
    if rows == 0:
        return np.zeros((0, 0))
    if column.null_count:
        raise ValueError("A vector is missing.")
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    flat = lists.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # a missing element becomes NaN
    width = len(values) // rows
    if not (np.diff(lists.offsets.to_numpy()) == width).all():
        raise ValueError("Vectors differ in dimension.")
    return values.reshape(rows, width)


def prepared(metric: str, vectors: np.ndarray) -> np.ndarray:
    """Unit vectors for cosine (zero rows stay zero), the vectors themselves otherwise."""
    if metric != "cosine" or not len(vectors):
        return vectors
    size = np.sqrt(in_order(vectors.T, vectors.T, np.multiply))[:, None]
    return vectors / np.where(size == 0.0, 1.0, size)


def in_order(left: np.ndarray, right: np.ndarray, term: Callable) -> np.ndarray:
    """Sum of ``term`` over the first axis, one component after another.

    Every pair is summed in the same order, so its score has no part in where it was found, and
    a plain left-to-right sum elsewhere gives the same bits.
    """
    total = np.zeros(np.broadcast_shapes(left.shape[1:], right.shape[1:]))
    for a, b in zip(left, right, strict=True):
        total += term(a, b)
    return total


def pair_goodness(metric: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Scores in DOUBLE of prepared vectors whose components lie on the first axis."""
    if metric in ("cosine", "dot"):
        return in_order(left, right, np.multiply)
    if metric == "euclidean":
        return -np.sqrt(in_order(left, right, lambda a, b: (a - b) ** 2))
    return -in_order(left, right, lambda a, b: np.abs(a - b))


def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    left_sq, right_sq = (left**2).sum(1)[:, None], (right**2).sum(1)[None, :]
    squared = left_sq + right_sq - 2.0 * (left @ right.T)
    # Expanding the square loses digits for near-equal rows: take their differences instead.
    near_l, near_r = np.nonzero(squared < 1e-3 * (left_sq + right_sq))
    step = max(1, SCORE_CELLS // max(1, left.shape[1]))
    for at in range(0, len(near_l), step):
        i, j = near_l[at : at + step], near_r[at : at + step]
        squared[i, j] = ((left[i] - right[j]) ** 2).sum(1)
    return np.sqrt(np.maximum(squared, 0.0))


def goodness(metric: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Scores of prepared rows against prepared rows, larger is better."""
    if metric in ("cosine", "dot"):
        return left @ right.T
    if metric == "euclidean":
        return -_distances(left, right)
    out = np.empty((len(left), len(right)))
    for i, row in enumerate(left):
        out[i] = np.abs(right - row).sum(1)
    return -out


def gaps(metric: str, rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distance of prepared rows to prepared centres, in the space the bounds work in."""
    if metric == "cosine":
        return np.arccos(np.clip(rows @ centres.T, -1.0, 1.0))
    return -goodness("manhattan" if metric == "manhattan" else "euclidean", rows, centres)


def best_possible(
    metric: str, rows: np.ndarray, centres: np.ndarray, radius: np.ndarray
) -> np.ndarray:
    """Upper bound on the goodness of each row against any member of each cell.

    Follows from the triangle inequality on angles (cosine) or distances, and from
    Cauchy-Schwarz for dot. A zero vector is at a right angle to every centre, and its cell's
    radius includes that angle, so its score of 0 stays within the bound.
    """
    if metric == "dot":
        length = np.linalg.norm(rows, axis=1, keepdims=True)
        return rows @ centres.T + length * radius[None, :]
    nearest = np.maximum(gaps(metric, rows, centres) - radius[None, :], 0.0)
    return np.cos(nearest) if metric == "cosine" else -nearest


def slices(rows: int, width: int) -> Iterator[slice]:
    step = max(1, SCORE_CELLS // max(1, width))
    for at in range(0, rows, step):
        yield slice(at, min(at + step, rows))


def rank_in_runs(runs: np.ndarray) -> np.ndarray:
    """Position of each element within its run of equal values."""
    if not len(runs):
        return np.zeros(0, dtype=np.int64)
    starts = np.r_[True, runs[1:] != runs[:-1]]
    return np.arange(len(runs)) - np.maximum.accumulate(np.where(starts, np.arange(len(runs)), 0))


class Met(NamedTuple):
    """The near pairs of a tile: rows and columns, which of them have a value, and it.

    In a crowd these are only the pairs that have a value, and ``near`` tells all near pairs of the rows
    ``own`` and the columns ``part``.
    """

    i: np.ndarray
    j: np.ndarray
    known: np.ndarray
    value: np.ndarray
    own: slice
    part: slice
    near: np.ndarray | None = None


class Scorer:
    """Scores rows against one side, screened in a narrow type and decided in DOUBLE.

    The rough score of a pair (a FLOAT product; for manhattan a sum of whole numbers) is compared with the
    wanted score less a bound on its error, so it can only let too many pairs through. Those that pass are
    scored again in DOUBLE by one fixed sum per pair; order and thresholds go by that unrounded score.
    """

    def __init__(self, metric: str, side: np.ndarray, exact_screen: bool = False):
        self.metric = metric
        self.side = side
        self.length = np.linalg.norm(side, axis=1) if len(side) else np.zeros(0)
        self.longest = float(self.length.max(initial=0.0))
        # Very long vectors would overflow in FLOAT.
        self.kind = np.float32 if self.longest < 1e15 and not exact_screen else np.float64
        # Manhattan is screened on a grid of whole numbers, which its side keeps for the next rows.
        self.rough = side.astype(self.kind) if metric != "manhattan" else None
        self._grid: tuple[float, float, float, np.ndarray] | None = None

    def _screen(self, rows: np.ndarray, part: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Rough scores of rows with a part of the side (negated squares for euclidean) and a bound on each row's error."""
        size = np.linalg.norm(rows, axis=1)
        if self.metric == "manhattan":
            return self._on_grid(rows, part, size)
        kind = self.kind if size.max(initial=0.0) < 1e15 else np.float64
        product = rows.astype(kind) @ self.rough[part].astype(kind, copy=False).T
        unit = 2.0 * np.finfo(kind).eps * (rows.shape[1] + 8)
        if self.metric != "euclidean":
            return product, unit * size * self.longest
        product *= 2
        product -= (size**2).astype(kind)[:, None]
        product -= (self.length[part] ** 2).astype(kind)[None, :]
        return product, unit * (size + self.longest) ** 2

    def _on_grid(self, rows: np.ndarray, part: slice, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Negated sums of differences between whole numbers, which stand for the components to within half a step."""
        width = rows.shape[1]
        steps = (2**16 - 1) // max(1, width)
        if steps < GRID or not len(rows) or not len(self.side):
            error = 4.0 * np.finfo(float).eps * (width + 8) * np.sqrt(width) * (size + self.longest)
            return goodness(self.metric, rows, self.side[part]), error
        low, high = float(rows.min()), float(rows.max())
        if self._grid is None or low < self._grid[0] or high > self._grid[1]:
            low, high = min(low, float(self.side.min())), max(high, float(self.side.max()))
            step = (high - low) / min(steps, 2**15 - 1) or 1.0
            self._grid = (low, high, step, np.ascontiguousarray(np.rint((self.side.T - low) / step).astype(np.int16)))
        low, _, step, side = self._grid
        asked, side = np.rint((rows.T - low) / step).astype(np.int16), side[:, part]
        total = np.zeros((len(rows), side.shape[1]), np.uint16)
        apart = np.empty(total.shape, np.int16)
        for a, b in zip(asked, side, strict=True):
            np.subtract(a[:, None], b[None, :], out=apart)
            np.abs(apart, out=apart)
            np.add(total, apart.view(np.uint16), out=total)
        # A component is half a step off on either side; the rest is rounding of these sums and of the score itself.
        error = width * step * (1.0 + 1e-6) + 1e-12 * (size + self.longest) * width
        return total.astype(np.float32) * np.float32(-step), error + 2e-7 * steps * width * step

    def _tiles(self, rows: np.ndarray) -> Iterator[tuple[slice, slice]]:
        for start in range(0, len(rows), TILE[0]):
            for first in range(0, len(self.side), TILE[1]):
                yield slice(start, min(start + TILE[0], len(rows))), slice(first, min(first + TILE[1], len(self.side)))

    def linked(self, rows: np.ndarray, floor: float, within: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, columns of all pairs with a score of at least ``floor`` by tiles, and which of them have a value, and it."""
        for met in self.met(rows, floor, within):
            if met.near is None:
                yield met.i, met.j, met.known, met.value
                continue
            value = np.full(met.near.shape, np.inf)
            value[met.i - met.own.start, met.j - met.part.start] = met.value
            i, j = np.nonzero(met.near)
            value = value[i, j]
            yield i + met.own.start, j + met.part.start, np.isfinite(value), value

    def met(self, rows: np.ndarray, floor: float, within: bool = False) -> Iterator[Met]:
        """All pairs with a score of at least ``floor`` by tiles, those of a crowd as a mask.

        A pair that is surely above the floor is scored only where it may be the best of its row or column of a tile.
        With ``within`` the rows are the side itself, and no row meets itself.
        """
        for own, part in self._tiles(rows):
            rough, error = self._screen(rows[own], part)
            cut = self._rough_floor(np.full(len(rough), floor))
            near = rough >= _below(cut - error, rough.dtype)[:, None]
            if within:
                itself = np.arange(max(own.start, part.start), min(own.stop, part.stop))
                near[itself - own.start, itself - part.start] = False
            count = np.count_nonzero(near)
            if not count:
                continue
            slack = 2.0 * error.max()
            sure_from = np.nextafter(cut + error, np.inf) + np.finfo(rough.dtype).eps * np.abs(cut)
            if count > max(EXACT, near.size // CROWD):
                yield self._crowd(rows, floor, rough, near, slack, sure_from, own, part)
                continue
            found = np.flatnonzero(near)
            i, j = np.divmod(found, rough.shape[1])
            score = rough.ravel()[found].astype(np.float64)
            ask = np.ones(len(found), dtype=bool)
            if len(found) > EXACT:
                top_i, top_j = np.full(len(rough), -np.inf), np.full(rough.shape[1], -np.inf)
                np.maximum.at(top_i, i, score)
                np.maximum.at(top_j, j, score)
                ask = (score <= sure_from[i]) | (score >= top_i[i] - slack) | (score >= top_j[j] - slack)
            i, j = i + own.start, j + part.start
            value = np.full(len(found), np.inf)
            value[ask] = self._pairs(rows, i[ask], j[ask])
            kept = value >= floor
            yield Met(i[kept], j[kept], ask[kept], value[kept], own, part)

    def _crowd(
        self, rows: np.ndarray, floor: float, rough: np.ndarray, near: np.ndarray, slack: float, sure_from: np.ndarray, own: slice, part: slice
    ) -> Met:
        """The near pairs of a tile as a mask, and the scores of the unsure ones and of those that may be best."""
        kind = rough.dtype
        seen = np.where(near, rough, kind.type(-np.inf))
        best_i, best_j = [_below(seen.max(axis).astype(np.float64) - slack, kind) for axis in (1, 0)]
        ask = seen <= -_below(-sure_from, kind)[:, None]
        ask |= seen >= best_i[:, None]
        ask |= seen >= best_j[None, :]
        ask &= near
        i, j = np.divmod(np.flatnonzero(ask), ask.shape[1])
        value = self._pairs(rows, i + own.start, j + part.start)
        kept = value >= floor
        near[i[~kept], j[~kept]] = False
        i, j, value = i[kept] + own.start, j[kept] + part.start, value[kept]
        return Met(i, j, np.ones(len(i), dtype=bool), value, own, part, near)

    def binned(self, rows: np.ndarray, low: float, bins: int, within: bool = False) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """The bins of all scores by tiles: equal parts of [low, 1], the outer ones with all beyond; -1 below ``low`` above -1.

        With ``within`` the rows are the side itself: a pair counts once, and -1 stands for the others.
        """
        width = (1.0 - low) / bins
        for own, part in self._tiles(rows):
            if within and part.stop <= own.start + 1:
                continue
            rough, error = self._screen(rows[own], part)
            place = (rough - rough.dtype.type(low)) / rough.dtype.type(width)
            at = np.floor(place)
            # What lies within the error of an edge is scored in DOUBLE.
            near = (error / width + 4 * np.finfo(rough.dtype).eps * (bins + 2)).astype(rough.dtype)[:, None]
            place -= at
            i, j = np.nonzero((place <= near) | (place >= 1 - near))
            out = at.astype(np.int64)
            if len(i):
                value = self._pairs(rows, i + own.start, j + part.start)
                exact = np.floor((value - low) / width).astype(np.int64)
                out[i, j] = np.where(value < low, -1, np.maximum(exact, 0)) if low > -1.0 else exact
            np.clip(out, -1 if low > -1.0 else 0, bins - 1, out=out)
            if within:
                out[np.arange(own.start, own.stop)[:, None] >= np.arange(part.start, part.stop)[None, :]] = -1
            yield own, part, out

    def _pairs(self, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Scores in DOUBLE of some pairs."""
        value = np.empty(len(i))
        step = max(1, SCORE_CELLS // max(1, rows.shape[1]))
        for start in range(0, len(i), step):
            part = slice(start, start + step)
            a, b = rows[i[part]], self.side[j[part]]
            if self.metric in ("cosine", "dot"):
                # A running sum adds from left to right, too, and takes a long vector along its memory.
                value[part] = np.cumsum(a * b, axis=1)[:, -1] if a.shape[1] else 0.0
            else:
                value[part] = pair_goodness(self.metric, a.T, b.T)
        return value + 0.0

    def _rough_floor(self, floor: np.ndarray) -> np.ndarray:
        """The floor in the terms of the screen."""
        if self.metric != "euclidean":
            return floor
        return -(np.maximum(-floor, 0.0) ** 2)

    def _exact(self, rows: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
        at = np.flatnonzero(wanted)
        i, j = np.divmod(at, max(1, len(self.side)))
        if len(at) > wanted.size // 16:
            whole = pair_goodness(self.metric, rows.T[:, :, None], self.side.T[:, None, :])
            return i, j, whole.ravel()[at] + 0.0
        return i, j, self._pairs(rows, i, j)

    def above(self, rows: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs with a score of at least ``floor``, as rows, columns, values."""
        found: tuple[list, list, list] = ([], [], [])
        for own, part in self._tiles(rows):
            rough, error = self._screen(rows[own], part)
            cut = self._rough_floor(np.full(len(rough), floor)) - error
            i, j = np.nonzero(rough >= _below(cut, rough.dtype)[:, None])
            value = self._pairs(rows, i + own.start, j + part.start)
            kept = value >= floor
            for held, values in zip(found, (i[kept] + own.start, j[kept] + part.start, value[kept]), strict=True):
                held.append(values)
        return tuple(np.concatenate(f) if f else np.zeros(0, k) for f, k in zip(found, (np.int64, np.int64, float), strict=True))

    def best(
        self, rows: np.ndarray, keep: int, floor: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row the ``keep`` best columns (ties: lowest column) that reach the row's floor."""
        rough, error = self._screen(rows)
        width = rough.shape[1]
        wanted = np.ones(rough.shape, dtype=bool)
        if floor is not None:
            wanted = rough >= _below(self._rough_floor(floor) - error, rough.dtype)[:, None]
        if width > keep and (floor is None or np.count_nonzero(wanted) > 16 * keep * len(rows)):
            # A true best column is at most twice the error below the rough keep-th best.
            last = np.partition(rough, width - keep, axis=1)[:, -keep].astype(np.float64)
            wanted &= rough >= _below(last - 2 * error, rough.dtype)[:, None]
        r, c, v = self._exact(rows, wanted)
        if floor is not None:
            above = v >= floor[r]
            r, c, v = r[above], c[above], v[above]
        order = np.lexsort((c, -v, r))
        r, c, v = r[order], c[order], v[order]
        kept = rank_in_runs(r) < keep
        return r[kept], c[kept], v[kept]


def _below(cut: np.ndarray, kind: np.dtype) -> np.ndarray:
    """``cut`` in a narrower type, rounded down."""
    return np.nextafter(cut.astype(kind), np.array(-np.inf, dtype=kind))


def joined_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the nodes ``i`` and ``j`` are linked: each node carries its lowest node.

    ``labels`` holds the result of earlier links, so links may come in portions.
    """
    while len(i):
        low, high = np.minimum(labels[i], labels[j]), np.maximum(labels[i], labels[j])
        apart = low < high
        if not apart.any():
            break
        i, j = i[apart], j[apart]
        np.minimum.at(labels, high[apart], low[apart])
        while True:
            further = labels[labels]
            if (further == labels).all():
                break
            labels = further
    return labels


def joined_crowd(labels: np.ndarray, near: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``joined_labels`` of all links that a mask tells between the nodes ``a`` (rows) and ``b`` (columns).

    A link for each row and column joins most of them; the others are listed only between parts still apart.
    """
    by_row, by_column = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    labels = joined_labels(labels, a[by_row], b[near[by_row].argmax(1)])
    labels = joined_labels(labels, b[by_column], a[near[:, by_column].argmax(0)])
    i, j = np.divmod(np.flatnonzero(near & (labels[a][:, None] != labels[b][None, :])), near.shape[1])
    return joined_labels(labels, a[i], b[j])
