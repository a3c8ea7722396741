"""External induced sorting of the suffixes of a shard, with their common prefixes.

Suffixes are sorted by induction: the sorted leftmost-S suffixes, pushed into a queue, give the order
of all L suffixes from the smallest up, and these give the order of all S suffixes from the largest
down. The leftmost-S suffixes themselves are sorted by the same two passes over their substrings,
which are named; names that repeat make a shorter string, which is sorted by recursion.

The queue is on disk: it takes suffix tuples (key, position, common prefix, run of the first symbol,
symbol after the run), sorts what it holds in memory into runs, merges small runs, writes large ones
out, and hands back the smallest tuples from the heads of all runs. Common prefixes travel with the
tuples: two suffixes that follow each other in a bucket share their first symbol and whatever the
suffixes that they come from share, which is the least value between those two in the order of the
pass. Values are cut at ``most``, so the minima of the order so far fit in a stack of that size.

In memory are the symbols and a few numbers per leftmost-S suffix, which are a half of all at most;
the tuples of all suffixes, 40 bytes each and several of them at a time, are on disk beyond ``rows``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyarrow import fs

EQUAL = 1 << 40  # common prefix of two tuples that nothing told apart yet
NONE = -1  # the symbol after the end
KEY, POS, LCP, RUN, AFTER = range(5)


class Disk:
    """A folder of one task in the shared folder; ``rows`` tuples stay in memory."""

    def __init__(self, folder: str, rows: int) -> None:
        self.files, base = fs.FileSystem.from_uri(folder)
        self.folder, self.rows, self.written = f"{base}/sort-{uuid.uuid4().hex}", rows, 0

    def write(self, rows: np.ndarray) -> str:
        if not self.written:
            self.files.create_dir(self.folder, recursive=True)
        path = f"{self.folder}/{self.written}"
        self.written += 1
        with self.files.open_output_stream(path) as out:
            out.write(np.ascontiguousarray(rows).data)
        return path

    def read(self, path: str, width: int, first: int, last: int) -> np.ndarray:
        with self.files.open_input_file(path) as source:
            data = source.read_at((last - first) * width * 8, first * width * 8)
        return np.frombuffer(data, np.int64).reshape(-1, width)

    def drop(self, path: str) -> None:
        self.files.delete_file(path)

    def close(self) -> None:
        if self.written:
            self.files.delete_dir(self.folder)


class Spool:
    """Tuples in the order they were appended, on disk beyond the rows that stay in memory."""

    def __init__(self, disk: Disk, width: int) -> None:
        self.disk, self.width, self.size = disk, width, 0
        self.parts: list[tuple[int, int, np.ndarray | str]] = []
        self.fresh: list[np.ndarray] = []
        self.waiting = 0

    def append(self, rows: np.ndarray) -> None:
        self.fresh.append(rows)
        self.waiting += len(rows)
        self.size += len(rows)
        if self.waiting >= self.disk.rows:
            self._settle(self.disk.write)

    def _settle(self, keep: Callable) -> None:
        if self.waiting:
            rows = np.concatenate(self.fresh)
            self.parts.append((self.size - len(rows), len(rows), keep(rows)))
            self.fresh, self.waiting = [], 0

    def blocks(self, rows: int, backwards: bool = False):
        """The tuples in blocks, each in order of appending; the last block first if ``backwards``."""
        self._settle(lambda held: held)
        for first, count, where in reversed(self.parts) if backwards else self.parts:
            cuts = range(0, count, rows)
            for a in reversed(cuts) if backwards else cuts:
                b = min(count, a + rows)
                yield where[a:b] if isinstance(where, np.ndarray) else self.disk.read(where, self.width, a, b)

    def clear(self) -> None:
        for _, _, where in self.parts:
            if isinstance(where, str):
                self.disk.drop(where)
        self.parts, self.fresh, self.waiting, self.size = [], [], 0, 0


class _Run:
    """Sorted tuples of the queue, read from the front."""

    def __init__(self, disk: Disk, rows: np.ndarray | None, spool: Spool | None, block: int) -> None:
        self.disk, self.path, self.at, self.head = disk, None, 0, np.zeros((0, 5), np.int64)
        self.spool, self.block, self.source = spool, block, None
        if spool is not None:
            self.source, self.left = spool.blocks(block), spool.size
        elif len(rows) >= disk.rows:
            self.path, self.left, self.next, self.total = disk.write(rows), len(rows), 0, len(rows)
        else:
            self.head, self.left = rows, len(rows)

    @property
    def held(self) -> bool:
        return self.path is None and self.source is None

    def peek(self, count: int) -> np.ndarray:
        while len(self.head) - self.at < min(count, self.left):
            if self.source is not None:
                more = next(self.source)
            else:
                last = min(self.total, self.next + max(count, self.block))
                more = self.disk.read(self.path, 5, self.next, last)
                self.next = last
            self.head, self.at = np.concatenate([self.head[self.at :], more]), 0
        return self.head[self.at : self.at + count]

    def take(self, count: int) -> None:
        self.at += count
        self.left -= count
        if not self.left and self.path is not None:
            self.disk.drop(self.path)


class Queue:
    """Tuples by key, equal keys in the order they were pushed."""

    def __init__(self, disk: Disk, block: int) -> None:
        self.disk, self.block, self.runs = disk, block, []

    def push(self, rows: np.ndarray) -> None:
        if not len(rows):
            return
        self.runs.append(_Run(self.disk, rows[np.argsort(rows[:, KEY], kind="stable")], None, self.block))
        while len(self.runs) > 1:
            a, b = self.runs[-2:]
            if not (a.held and b.held) or a.left > 2 * b.left:
                return
            both = np.concatenate([a.head[a.at :], b.head[b.at :]])
            self.runs[-2:] = [_Run(self.disk, both[np.argsort(both[:, KEY], kind="stable")], None, self.block)]

    def push_sorted(self, spool: Spool) -> None:
        """Tuples that are sorted already; no other tuple has one of their keys."""
        if spool.size:
            self.runs.insert(0, _Run(self.disk, None, spool, self.block))

    def smallest(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        """At most ``count`` of the smallest tuples in order, and the run of each."""
        self.runs = [r for r in self.runs if r.left]
        heads = [r.peek(count) for r in self.runs]
        if not heads:
            return np.zeros((0, 5), np.int64), np.zeros(0, np.int64)
        # Complete are the tuples below the last key that a run shows of those it has not shown in full.
        open_ends = [(h[-1, KEY], i) for i, (h, r) in enumerate(zip(heads, self.runs, strict=True)) if len(h) < r.left]
        parts = []
        if open_ends:
            bound, owner = min(open_ends)
            for i, h in enumerate(heads):
                parts.append(h[: np.searchsorted(h[:, KEY], bound, "right" if i <= owner else "left")])
        else:
            parts = heads
        which = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        rows = np.concatenate(parts)
        order = np.argsort(rows[:, KEY], kind="stable")[:count]
        return rows[order], which[order]

    def take(self, which: np.ndarray) -> None:
        for run, count in zip(self.runs, np.bincount(which, minlength=len(self.runs)), strict=True):
            run.take(int(count))


class RangeMin:
    """Least value of values[first..last], for many ranges at once."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels, span = [values], 1
        while 2 * span <= len(values):
            low = self.levels[-1]
            self.levels.append(np.minimum(low[: len(low) - span], low[span:]))
            span *= 2

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = np.empty(len(first), np.int64)
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.levels[k]
            out[at] = np.minimum(row[first[at]], row[last[at] - (1 << k) + 1])
        return out


class Symbols:
    """A string of whole numbers from 0 to ``kinds`` - 1. ``weight`` letters stand behind each symbol,
    and ``shared[c]`` letters are common to what stands behind c - 1 and c."""

    def __init__(self, text: np.ndarray, kinds: int, weight: np.ndarray, shared: np.ndarray | None, most: int) -> None:
        self.text, self.kinds, self.weight, self.most = text, kinds, weight, most
        self.shared = None if shared is None else RangeMin(shared.astype(np.uint16 if most < 1 << 16 else np.int64))

    def border(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Letters common to what begins with the different symbols a and b; none with the end."""
        out = np.zeros(len(a), np.int64)
        if self.shared is not None:
            low, high = np.minimum(a, b), np.maximum(a, b)
            at = np.flatnonzero(low >= 0)
            if len(at):
                out[at] = self.shared(low[at] + 1, high[at])
        return out


Emit = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], None]


def induce(s: Symbols, queue: Queue, mirrored: bool, start: bool, chunk: int, emit: Emit) -> None:
    """One pass over the queue. ``emit`` gets the tuples in order with symbols as keys, the common
    prefix of each with the one before, whether it was in the queue at first, and the symbol before it.

    Up the order (not ``mirrored``) a suffix hands on the suffix before it if that is an L suffix;
    down the order symbols count from the other end, and S suffixes are handed on.
    """
    flip = s.kinds - 1
    last = np.full(s.kinds, -1, np.int64)  # the latest place in the order that gave each symbol a suffix
    low_at, low = np.zeros(0, np.int64), np.zeros(0, np.int64)  # minima of the order from a place to its end
    done, before = 0, None
    if start:  # the empty suffix comes first; it hands on the last symbol
        n, done = len(s.text), 1
        queue.push(np.array([[2 * int(s.text[-1]), n - 1, 0, 1, NONE]], np.int64))
        last[int(s.text[-1])] = 0
    size = chunk
    while True:
        rows, which = queue.smallest(size)
        if not len(rows):
            return
        c, seed, pos = rows[:, KEY] >> 1, rows[:, KEY] & 1, rows[:, POS]
        prior = s.text[np.maximum(pos - 1, 0)].astype(np.int64)
        p = np.where(pos > 0, flip - prior if mirrored else prior, -1)
        hands = (p > c) | ((p == c) & (seed == 0))
        # What is handed on may belong before the rest of the portion: that rest waits.
        reach = np.minimum.accumulate(np.where(hands, 2 * p, np.iinfo(np.int64).max))
        late = np.flatnonzero(rows[1:, KEY] > reach[:-1])
        m = int(late[0]) + 1 if len(late) else len(rows)
        queue.take(which[:m])
        rows, c, seed, pos, p, hands = rows[:m], c[:m], seed[:m], pos[:m], p[:m], hands[:m]
        symbol = flip - c if mirrored else c
        # Common prefix with the tuple before.
        given = rows[:, LCP]
        value = np.where((seed == 1) | (given >= EQUAL), given, np.minimum(s.most, given + s.weight[symbol]))
        first = before if before is not None else np.array([-1, -1, 0, NONE, NONE], np.int64)
        ahead = np.concatenate([first[None, :], np.column_stack([c, seed, rows[:, RUN], rows[:, AFTER], symbol])[:-1]])
        new = np.flatnonzero(c != ahead[:, 0])
        value[new] = s.border(ahead[new, 4], symbol[new])
        if before is None:
            value[0] = 0
        seam = np.flatnonzero((c == ahead[:, 0]) & (seed != ahead[:, 1]))
        if len(seam):  # c^k x and c^l y, with x and y on different sides of c
            k, l = ahead[seam, 2], rows[seam, RUN]
            x = np.where(k > l, symbol[seam], ahead[seam, 3])
            y = np.where(l > k, symbol[seam], rows[seam, AFTER])
            value[seam] = np.minimum(s.most, np.minimum(k, l) * s.weight[symbol[seam]] + s.border(x, y))
        before = np.array([c[-1], seed[-1], rows[-1, RUN], rows[-1, AFTER], symbol[-1]], np.int64)
        # What the portion hands on, with the common prefix of the suffixes they come from.
        at = np.flatnonzero(hands)
        if len(at):
            order = np.argsort(p[at], kind="stable")
            target, place = p[at][order], at[order]
            opens = np.concatenate([[True], target[1:] != target[:-1]])
            least = np.empty(len(at), np.int64)
            minima = RangeMin(value)
            inner = np.flatnonzero(~opens)
            least[inner] = minima(place[inner - 1] + 1, place[inner])
            outer = np.flatnonzero(opens)
            since = last[target[outer]]
            past = np.concatenate([low, [EQUAL]])[np.searchsorted(low_at, since, "right")]
            least[outer] = np.where(since < 0, 0, np.minimum(past, minima(np.zeros(len(outer), np.int64), place[outer])))
            closes = np.concatenate([opens[1:], [True]])
            last[target[closes]] = done + place[closes]
            handed = np.empty((len(at), 5), np.int64)
            handed[:, KEY], handed[:, POS] = 2 * p[at], pos[at] - 1
            handed[order, LCP] = least
            again = p[at] == c[at]
            handed[:, RUN] = np.where(again, rows[at, RUN] + 1, 1)
            handed[:, AFTER] = np.where(again, rows[at, AFTER], symbol[at])
            queue.push(handed)
        tail = np.minimum.accumulate(value[::-1])[::-1]
        steps = np.flatnonzero(np.concatenate([value[:-1] < tail[1:], [True]]))
        keep = low < tail[0]
        low_at, low = np.concatenate([low_at[keep], done + steps]), np.concatenate([low[keep], value[steps]])
        done += m
        out = rows.copy()
        out[:, KEY] = symbol
        emit(out, value, seed == 1, flip - p if mirrored else p)
        size = min(chunk, max(1024, 2 * m))


class _Thinned:
    """Common prefixes between the tuples of an order that are kept."""

    def __init__(self) -> None:
        self.carry = EQUAL

    def __call__(self, value: np.ndarray, kept: np.ndarray) -> np.ndarray:
        if not len(kept):
            self.carry = min(self.carry, int(value.min(initial=EQUAL)))
            return np.zeros(0, np.int64)
        out = np.minimum.reduceat(value[: kept[-1] + 1], np.concatenate([[0], kept[:-1] + 1]))
        out[0] = min(int(out[0]), self.carry)
        self.carry = int(value[kept[-1] + 1 :].min(initial=EQUAL))
        return out


def _both_passes(s: Symbols, seeds: Queue, disk: Disk, chunk: int, emit: Emit) -> None:
    """L suffixes up the order from the seeds, then S suffixes down the order from the L suffixes."""
    up, thin = Spool(disk, 5), _Thinned()

    def keep(rows: np.ndarray, value: np.ndarray, seed: np.ndarray, _: np.ndarray) -> None:
        kept = np.flatnonzero(~seed)
        held = rows[kept]
        held[:, LCP] = thin(value, kept)
        up.append(held)

    induce(s, seeds, False, True, chunk, keep)
    down, carry = Spool(disk, 5), 0
    for block in up.blocks(chunk, backwards=True):
        rows = block[::-1].copy()
        shared = rows[:, LCP].copy()
        rows[:, LCP] = np.concatenate([[carry], shared[:-1]])
        carry = int(shared[-1])
        rows[:, KEY] = 2 * (s.kinds - 1 - rows[:, KEY]) + 1
        down.append(rows)
    up.clear()
    queue = Queue(disk, chunk)
    queue.push_sorted(down)
    induce(s, queue, True, False, chunk, emit)
    down.clear()


def _doubled(s: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a short string in order and their common prefixes, by doubling ranks in memory."""
    n = len(s.text)
    weights = np.concatenate([[0], np.cumsum(s.weight[s.text])])
    ranks, span = [s.text.astype(np.int64)], 1
    lightest = max(1, int(s.weight.min(initial=1)))
    while span * lightest < s.most and span < n:
        rank = ranks[-1]
        second = np.zeros(n, np.int64)
        second[: n - span] = rank[span:] + 1
        known, place = np.unique(rank * (n + 2) + second, return_inverse=True)
        ranks.append(place)
        span *= 2
        if len(known) == n:
            break
    order = np.argsort(ranks[-1], kind="stable")
    i, j = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(max(0, n - 1), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        step, rank = 1 << level, ranks[level]
        inside = (i < n) & (j < n)
        same = inside & (rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)])
        at = np.flatnonzero(same)
        ends = np.minimum(i[at] + step, n)
        shared[at] += weights[ends] - weights[i[at]]
        i[at] = ends
        j[at] = np.minimum(j[at] + step, n)
    at = np.flatnonzero((i < n) & (j < n) & (shared < s.most))
    x, y = s.text[i[at]].astype(np.int64), s.text[j[at]].astype(np.int64)
    differ = x != y
    shared[at[differ]] += s.border(x[differ], y[differ])
    shared[at[~differ]] = s.most
    return order, np.concatenate([[0], np.minimum(shared, s.most)])[:n]


def sorted_suffixes(s: Symbols, disk: Disk, chunk: int, base: int, emit: Emit) -> None:
    """All suffixes of ``s`` from the largest down: ``emit`` gets tuples and common prefixes with the
    suffix before, cut at ``s.most``."""
    text, n = s.text, len(s.text)
    if not n:
        return
    change = np.flatnonzero(text[1:] != text[:-1])
    smaller = np.concatenate([text[change] < text[change + 1], [False]])  # S suffixes end in a rise
    segment = np.diff(np.concatenate([[-1], change, [n - 1]]))
    is_s = np.repeat(smaller, segment)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    del is_s

    def tuples(at: np.ndarray, shared: np.ndarray | int) -> np.ndarray:
        rows = np.empty((len(at), 5), np.int64)
        run_end = np.searchsorted(change, at)
        ends = np.concatenate([change + 1, [n]])[run_end]
        rows[:, KEY], rows[:, POS], rows[:, LCP], rows[:, RUN] = 2 * text[at].astype(np.int64) + 1, at, shared, ends - at
        rows[:, AFTER] = np.where(ends < n, text[np.minimum(ends, n - 1)], NONE)
        return rows

    seeds = Queue(disk, chunk)
    if len(lms):
        # Substrings begin as equal if their run of the first symbol and what follows it are: so much of
        # a suffix decides what it shares with an L suffix of the same symbol.
        run_end = np.searchsorted(change, lms)
        symbol, run, after = text[lms].astype(np.int64), change[run_end] + 1 - lms, text[change[run_end] + 1].astype(np.int64)
        place = np.lexsort((after, -run, symbol))
        symbol, run, after = symbol[place], run[place], after[place]
        shorter = np.minimum(run[1:], run[:-1])
        x = np.where(run[:-1] > shorter, symbol[1:], after[:-1])
        y = np.where(run[1:] > shorter, symbol[1:], after[1:])
        shared = np.full(len(lms), EQUAL)
        shared[0] = 0
        shared[1:][symbol[1:] != symbol[:-1]] = 0  # the pass finds what different symbols share
        differ = np.flatnonzero((symbol[1:] == symbol[:-1]) & (x != y))
        shared[1:][differ] = np.minimum(s.most, shorter[differ] * s.weight[symbol[1:][differ]] + s.border(x[differ], y[differ]))
        first_order = Spool(disk, 5)
        for first in range(0, len(lms), chunk):
            at = slice(first, first + chunk)
            first_order.append(tuples(lms[place[at]], shared[at]))
        del symbol, run, after, place, shorter, x, y, shared, differ
        seeds.push_sorted(first_order)
        named, thin = Spool(disk, 2), _Thinned()

        def name(rows: np.ndarray, value: np.ndarray, seed: np.ndarray, prior: np.ndarray) -> None:
            kept = np.flatnonzero(~seed & (rows[:, POS] > 0) & (prior > rows[:, KEY]))
            named.append(np.column_stack([rows[kept, POS], thin(value, kept)]))

        _both_passes(s, seeds, disk, chunk, name)
        order = _order_of_seeds(s, lms, named, disk, chunk, base)
        seeds = Queue(disk, chunk)
        ready = Spool(disk, 5)
        for block in order.blocks(chunk):
            ready.append(tuples(block[:, 0], block[:, 1]))
        order.clear()
        seeds.push_sorted(ready)
    _both_passes(s, seeds, disk, chunk, emit)


def _order_of_seeds(s: Symbols, lms: np.ndarray, named: Spool, disk: Disk, chunk: int, base: int) -> Spool:
    """Position and common prefix with the one before of the leftmost-S suffixes, from the smallest up,
    given their substrings from the largest down."""
    kinds, shared, reduced = 0, [], np.empty(len(lms), np.int64)
    for block in named.blocks(chunk):
        fresh = block[:, 1] < EQUAL
        if kinds == 0:
            fresh[0] = True
        number = kinds + np.cumsum(fresh) - 1
        reduced[np.searchsorted(lms, block[:, 0])] = number
        shared.append(block[fresh, 1])
        kinds = int(number[-1]) + 1
    named.clear()
    reduced = kinds - 1 - reduced
    # Between name c - 1 and c: written at the smaller of two names on the way down.
    between = np.concatenate(shared)
    shared_with = np.concatenate([[0], between[1:][::-1]])
    letters = np.concatenate([[0], np.cumsum(s.weight[s.text])]) if s.shared is not None else None
    ends = np.concatenate([lms[1:], [len(s.text)]])
    weight = np.zeros(kinds, np.int64)
    weight[reduced] = ends - lms if letters is None else letters[ends] - letters[lms]
    inner = Symbols(reduced, kinds, np.minimum(weight, s.most), shared_with, s.most)
    out = Spool(disk, 2)
    if kinds == len(lms):
        place = np.empty(kinds, np.int64)
        place[reduced] = lms
        out.append(np.column_stack([place, shared_with]))
    elif len(lms) <= base:
        order, common = _doubled(inner)
        out.append(np.column_stack([lms[order], common]))
    else:
        down = Spool(disk, 2)
        sorted_suffixes(inner, disk, chunk, base, lambda rows, value, *_: down.append(np.column_stack([lms[rows[:, POS]], value])))
        carry: list[int] = []
        blocks = down.blocks(chunk, backwards=True)
        for block in blocks:  # reversed: a common prefix belongs to the larger of two neighbours
            rows = block[::-1].copy()
            common = rows[:, 1].copy()
            rows[:, 1] = np.concatenate([carry or [0], common[:-1]])
            carry = [int(common[-1])]
            out.append(rows)
        down.clear()
    return out


def repeated_places(texts: list[bytes], length: int, disk: Disk, chunk: int = 1 << 16, base: int = 1 << 20) -> list[np.ndarray]:
    """For each text the places where a string of ``length`` bytes starts that starts elsewhere, too."""
    sizes = np.array([len(t) for t in texts], np.int64)
    total = int(sizes.sum()) + len(texts)
    text = np.zeros(total, np.int16)  # texts end in symbol 0, bytes count from 1
    starts = np.cumsum(sizes + 1) - sizes - 1
    for start, t in zip(starts, texts, strict=True):
        text[start : start + len(t)] = np.frombuffer(t, np.uint8)
        text[start : start + len(t)] += 1
    s = Symbols(text, 257, np.ones(257, np.int64), None, length)
    marked = np.zeros(total, bool)
    before = [-1]

    def mark(rows: np.ndarray, value: np.ndarray, *_: np.ndarray) -> None:
        at = np.concatenate([before, rows[:, POS]])
        same = np.flatnonzero(value >= length)
        marked[at[same + 1]] = True
        marked[at[same]] = True
        before[0] = int(at[-1])

    sorted_suffixes(s, disk, chunk, base, mark)
    # A string may not run over the end of its text.
    return [np.flatnonzero(marked[a : a + max(0, n - length + 1)]) for a, n in zip(starts, sizes, strict=True)]
