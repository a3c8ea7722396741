"""Vector scalar functions as native column expressions, computed in DOUBLE."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16  # what a zero norm is replaced with


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda acc, x: acc + x)


def _paired(a: Column | str, b: Column | str, each: Callable[[Column, Column], Column]) -> Column:
    a, b = _col(a), _col(b)
    terms = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), each)
    return F.when(
        F.size(a) != F.size(b),
        F.raise_error(F.lit("Vectors differ in dimension.")).cast("double"),
    ).otherwise(total(terms))


def dot(a: Column | str, b: Column | str) -> Column:
    return _paired(a, b, lambda x, y: x * y)


def norm(v: Column | str) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; a zero vector is an error here, unlike in the pair operators."""
    size = norm(a) * norm(b)
    undefined = F.raise_error(F.lit("A vector of length zero has no cosine."))
    return F.when(size == 0, undefined.cast("double")).otherwise(dot(a, b) / size)


def cosine_or_zero(a: Column | str, b: Column | str) -> Column:
    """Cosine with the pair operators' rule: a zero vector scores 0 against everything.

    The product of the unit vectors, summed in order as the block kernels do, so both give the
    same bits.
    """
    return dot(normalised(a), normalised(b))


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(_paired(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan(a: Column | str, b: Column | str) -> Column:
    return _paired(a, b, lambda x, y: F.abs(x - y))


def normalised(v: Column | str) -> Column:
    """Unit vector; a zero vector stays zero."""
    size = norm(v)
    divisor = F.when(size == 0, F.lit(EPSILON)).otherwise(size)
    # The norm is bound once per row, not once per element.
    return F.transform(
        F.array(F.struct(doubles(v).alias("v"), divisor.alias("n"))),
        lambda s: F.transform(s["v"], lambda x: x / s["n"]),
    )[0]


def _scaled(v: Column, factor: float) -> Column:
    return F.transform(v, lambda x: x * F.lit(factor))


def mean_vector(vectors: list[Column | str]) -> Column:
    return weighted_vector(vectors, [1.0] * len(vectors))


def weighted_vector(vectors: list[Column | str], weights: list[float]) -> Column:
    """Weighted mean of equally long vectors, weights normalised to sum 1."""
    if not vectors:
        raise ValueError("At least one vector column is needed.")
    if len(vectors) != len(weights):
        raise ValueError("One weight per vector column is needed.")
    if any(w < 0 for w in weights):
        raise ValueError("Weights must not be negative.")
    whole = float(sum(weights))
    if whole == 0:
        raise ValueError("Weights must not all be zero.")
    cols = [_col(v) for v in vectors]
    uniform = len(set(weights)) == 1
    combined = None
    for c, w in zip(cols, weights, strict=True):
        share = doubles(c) if uniform else _scaled(doubles(c), w / whole)
        combined = share if combined is None else F.zip_with(combined, share, lambda x, y: x + y)
    if uniform:
        combined = F.transform(combined, lambda x: x / F.lit(float(len(cols))))
    unequal = F.lit(False)
    for c in cols[1:]:
        unequal = unequal | (F.size(c) != F.size(cols[0]))
    message = F.raise_error(F.lit("Vectors differ in dimension and cannot be combined."))
    return F.when(unequal, message.cast("array<double>")).otherwise(combined)


def vector_to_json(v: Column | str) -> Column:
    return F.to_json(_col(v))


def vector_from_json(text: Column | str) -> Column:
    return F.from_json(_col(text), "array<float>")


@dataclass(frozen=True)
class Metric:
    """A similarity or distance: its column builder and which end of it is best."""

    name: str
    ascending: bool
    pair: Callable[[Column | str, Column | str], Column]

    def best_first(self, score: Column | str) -> Column:
        return _col(score).asc() if self.ascending else _col(score).desc()

    def within(self, score: Column | str, bound: float) -> Column:
        return _col(score) <= bound if self.ascending else _col(score) >= bound


METRICS: dict[str, Metric] = {
    m.name: m
    for m in (
        Metric("cosine", False, cosine_or_zero),
        Metric("euclidean", True, euclidean),
        Metric("manhattan", True, manhattan),
        Metric("dot", False, dot),
    )
}


def find_metric(name: str) -> Metric:
    if name not in METRICS:
        raise ValueError(f"No metric is called {name!r}; choose one of {sorted(METRICS)}.")
    return METRICS[name]
