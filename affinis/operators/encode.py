"""Text to vectors as a narrow, Arrow-batched job.

An encoder is anything with ``encode(texts) -> (n, d) array``. A factory builds it once per
Python worker. The hashing encoder is the built-in one: it needs no model file and is lexical,
not semantic. Any other is brought by the caller, and its name goes with the vectors it makes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_text, joined_text, model_for
from ..functions.vectors import mean_vector
from ..settings import VECTOR_PREFIX, same_dimension
from ..workspace import fill_cores, release, ship


PORTION_LETTERS = 1 << 20  # text that an encoder gets at once
PORTION_NUMBERS = 1 << 20  # numbers of the vectors that it gives at once
MADE = "_made_vectors"


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Signed feature hashing of words or character n-grams (Weinberger et al. 2009), unit length.

    Each token adds +1 or -1 to one of ``dim`` buckets: the first 8 hex digits of its MD5 give
    the bucket, the 9th the sign (below 8 is +1). The tokens of a whole batch are counted at
    once; only a token that is new to the worker is hashed.
    """

    def __init__(self, dim: int, ngram: int | None = None):
        self.dim = dim
        self.ngram = ngram
        self._codes = _TokenCodes(dim)

    def _tokens(self, text: str) -> list[str]:
        text, n = text.lower(), self.ngram
        if n is None:
            return text.split(" ")
        return [text[i : i + n] for i in range(max(1, len(text) - n + 1))]

    def encode(self, texts: list[str]) -> np.ndarray:
        tokens = list(map(self._tokens, texts))
        sizes = np.fromiter(map(len, tokens), np.int64, len(texts))
        flat = chain.from_iterable(tokens)
        codes = np.fromiter(map(self._codes.__getitem__, flat), np.int64, int(sizes.sum()))
        row = np.repeat(np.arange(len(texts)), sizes)
        row, codes = row[codes >= 0], codes[codes >= 0]
        counts = np.bincount(row * (2 * self.dim) + codes, minlength=2 * self.dim * len(texts))
        plus_minus = counts.reshape(len(texts), self.dim, 2)
        out = (plus_minus[:, :, 0] - plus_minus[:, :, 1]).astype(np.float64)
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return (out / np.where(length == 0, 1.0, length)).astype(np.float32)


class _TokenCodes(dict):
    """Token -> 2 * bucket + (1 for minus), -1 for the empty one. Most are hashed once per worker."""

    REMEMBERED = 200_000

    def __init__(self, dim: int):
        super().__init__({"": -1})
        self.dim = dim

    def __missing__(self, token: str) -> int:
        digest = hashlib.md5(token.encode(), usedforsecurity=False).digest()
        code = 2 * (int.from_bytes(digest[:4], "big") % self.dim) + (digest[4] >> 7)
        if len(self) < self.REMEMBERED:
            self[token] = code
        return code


@dataclass(frozen=True)
class EncoderSpec:
    """A factory that workers call once, and the vector size it promises."""

    factory: Callable[[], Encoder]
    dim: int
    name: str


Encoders = EncoderSpec | Callable[[str], EncoderSpec]  # one for all, or the one of a registered model


def hashing(dim: int = 384, ngram: int | None = None) -> EncoderSpec:
    kind = "words" if ngram is None else f"{ngram}-grams"
    return EncoderSpec(partial(HashingEncoder, dim, ngram), dim, f"hashing-{kind}-{dim}")


def encoder_portions(texts: list[str], dim: int) -> Iterator[tuple[int, int]]:
    """(first, last) of portions of a batch that an encoder gets at once: bounded by their letters and by the
    numbers of their vectors. A longer text is a portion of its own."""
    first, letters, most = 0, 0, max(1, PORTION_NUMBERS // dim)
    for i, text in enumerate(texts):
        if i > first and (letters + len(text) > PORTION_LETTERS or i - first >= most):
            yield first, i
            first, letters = i, 0
        letters += len(text)
    if first < len(texts):
        yield first, len(texts)


def encoded(text: Column, encoder: EncoderSpec) -> Column:
    """The vector of a text column. Whole texts are read; a missing text is the empty one."""
    return encoded_together([text], [encoder])["_0"]


def encoded_together(texts: list[Column], encoders: list[EncoderSpec]) -> Column:
    """The vectors of several text columns as a struct with the fields _0, _1, ...

    One Python worker of a task makes all of them: columns by themselves would each take a further
    worker, which Spark keeps. Columns with the same encoder share one.

    Marked non-deterministic so that Catalyst never copies it into a filter or a second
    projection: encoding is by far the dearest step and must run once per row.
    """
    names = [f"_{i}" for i in range(len(texts))]

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        models = {id(e): e.factory() for e in encoders}
        for batch in batches:
            parts = batch if isinstance(batch, tuple) else (batch,)  # a single column comes by itself
            made = [_vectors(part, models[id(e)], e.dim) for part, e in zip(parts, encoders, strict=True)]
            yield pa.StructArray.from_arrays(made, names)
            del made, parts, batch
            release()
        models.clear()
        release()

    # arrow_udf reads the type hints at run time.
    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    fields = ", ".join(f"{n}: array<float>" for n in names)
    return F.arrow_udf(run, f"struct<{fields}>").asNondeterministic()(*map(as_text, texts))


def _vectors(batch: pa.Array, model: Encoder, dim: int) -> pa.Array:
    texts, flat = batch.to_pylist(), np.empty((len(batch), dim), dtype=np.float32)
    for first, last in encoder_portions(texts, dim):
        vectors = np.asarray(model.encode(texts[first:last]), dtype=np.float32)
        if vectors.shape != (last - first, dim):
            raise ValueError(f"The encoder gave {vectors.shape}, expected ({last - first}, {dim}).")
        flat[first:last] = vectors
    offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(flat.ravel(), pa.float32(), from_pandas=True))


def _with_vectors(df: DataFrame, wanted: dict[str, tuple[str, EncoderSpec]]) -> DataFrame:
    """``df`` with a vector column for each name, made from a text column by an encoder."""
    texts, encoders = [F.col(f"`{c}`") for c, _ in wanted.values()], [e for _, e in wanted.values()]
    made = fill_cores(df).withColumn(MADE, encoded_together(texts, encoders))
    return made.withColumns({n: F.col(MADE)[f"_{i}"] for i, n in enumerate(wanted)}).drop(MADE)


def embed_columns(
    df: DataFrame, columns: list[str], encoder: EncoderSpec, force: bool = False
) -> DataFrame:
    """Add ``_emb_<column>`` for each column; one that is there is kept unless ``force``."""
    ship(df.sparkSession)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    names = {c: f"{VECTOR_PREFIX}{c}" for c in columns}
    wanted = {c: n for c, n in names.items() if force or n not in df.columns}
    if not wanted:
        return df
    return _with_vectors(df, {n: (c, encoder) for c, n in wanted.items()})


def embed_joined(df: DataFrame, columns: list[str], encoder: EncoderSpec, name: str) -> DataFrame:
    """One vector per row from several columns joined by a space."""
    ship(df.sparkSession)
    return fill_cores(df).withColumn(name, encoded(joined_text([F.col(f"`{c}`") for c in columns]), encoder))


def column_models(columns: list[str], model: str | None = None) -> dict[str, str]:
    """The model of each column: routed by its name, or one for all. Sizes must agree."""
    models = {c: model or model_for(c) for c in columns}
    same_dimension(list(models.values()))
    return models


def embed_and_combine(
    df: DataFrame,
    columns: list[str],
    name: str,
    encoder: Encoders,
    model: str | None = None,
) -> DataFrame:
    """Embed each column and average the vectors into ``name``.

    With a function as ``encoder`` each column gets the encoder of its model, which its name
    routes it to unless ``model`` is given.
    """
    ship(df.sparkSession)
    if isinstance(encoder, EncoderSpec):
        encoders = dict.fromkeys(columns, encoder)
    else:
        encoders = {c: encoder(m) for c, m in column_models(columns, model).items()}
    parts = [f"{VECTOR_PREFIX}{c}" for c in columns]
    wanted = {p: (c, encoders[c]) for c, p in zip(columns, parts, strict=True) if p not in df.columns}
    wide = _with_vectors(df, wanted) if wanted else fill_cores(df)
    combined = mean_vector([F.col(f"`{p}`") for p in parts]).cast("array<float>")
    added = [p for p in parts if p not in df.columns and p != name]
    return wide.withColumn(name, combined).drop(*added)
