"""Plain reference results on small inputs."""

import numpy as np


def score(metric, a, b):
    """Unrounded, with sums from left to right."""
    a, b = list(map(float, a)), list(map(float, b))
    if metric == "cosine":
        a, b = ([x / (_total(y * y for y in v) ** 0.5 or 1.0) for x in v] for v in (a, b))
    if metric == "euclidean":
        return float(np.sqrt(_total((x - y) * (x - y) for x, y in zip(a, b, strict=True))))
    if metric == "manhattan":
        return _total(abs(x - y) for x, y in zip(a, b, strict=True))
    return _total(x * y for x, y in zip(a, b, strict=True))


def _total(terms):
    out = 0.0
    for t in terms:  # the built-in sum compensates for rounding
        out += t
    return out


def top_k(rows, metric, k):
    """rows: (id, vector); the neighbours as {id: [(neighbour, score)]}."""
    ascending = metric in ("euclidean", "manhattan")
    out = {}
    for i, a in rows:
        scored = [(score(metric, a, b), j) for j, b in rows if j != i]
        scored.sort(key=lambda s: (s[0] if ascending else -s[0], s[1]))
        out[i] = [(j, s) for s, j in scored[:k]]
    return out


def pairs(rows, metric, bound):
    ascending = metric in ("euclidean", "manhattan")
    out = {}
    for x, (i, a) in enumerate(rows):
        for j, b in rows[x + 1 :]:
            s = score(metric, a, b)
            if (s <= bound) if ascending else (s >= bound):
                out[min(i, j), max(i, j)] = s
    return out


def groups(nodes):
    """Components of {(i, j)} numbered by lowest member."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, j in nodes:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    tops = sorted({find(x) for x in list(root)})
    return {x: tops.index(find(x)) + 1 for x in list(root)}
