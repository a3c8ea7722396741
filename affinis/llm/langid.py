"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased and everything but letters becomes a word border; n-grams of one to three
characters are hashed. A feature is the share of an n-gram among all n-grams of the text, weighted by
its inverse document frequency. The weights are learned by follow-the-regularised-leader with an
elastic-net penalty, whose absolute part leaves most of them at zero; a temperature is then fitted on
rows that the weights have not seen, so that the score is a probability.

Since features are shares, a text's logits are sums over its n-grams of tabulated rows, divided by
one sum: one pass over the characters, without any sparse matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import ship
from .texts import by_portion, by_share, code_points, held_out, letter_table, portions, release

FEATURES = 1 << 16
GRAMS = 3
FIT_ROWS = 6000  # bound of the labelled sample, spread evenly over the languages
LEAST_ROWS = 20  # of a language in the sample, if it has them
SCALE = 30.0  # of the features, so that penalties and rates are of the usual order
WINDOW = 1 << 19  # characters that are looked up at once
UNKNOWN = "und"


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters as code points and borders as 0, the text of each place, and the letters per text."""
    lowered = [t.lower() for t in texts]
    codes = code_points(" ".join(lowered) + " ").astype(np.int64)
    codes[~letter_table()[codes]] = 0
    sizes = np.array([len(t) + 1 for t in lowered], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    # Borders in a row count once.
    keep = np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0) | (owner[1:] != owner[:-1])]
    codes, owner = codes[keep], owner[keep]
    return codes, owner, np.bincount(owner[codes > 0], minlength=len(texts))


def _grams(codes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature, text) of all n-grams, window by window."""
    for first in range(0, len(codes), WINDOW):
        here = codes[first : first + WINDOW + GRAMS - 1]
        of = owner[first : first + WINDOW + GRAMS - 1]
        mixed = np.zeros(len(here), np.uint64)
        for n in range(GRAMS):
            last = min(WINDOW, len(here) - n)
            if last <= 0:
                break
            mixed = (mixed[:last] + here[n : n + last].astype(np.uint64) + np.uint64(n + 1)) * np.uint64(0x9E3779B97F4A7C15)
            inside = of[:last] == of[n : n + last]
            if n == 0:
                inside &= here[:last] > 0  # a border alone says nothing
            yield (mixed[inside] >> np.uint64(48)).astype(np.int64) & (FEATURES - 1), of[:last][inside]


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # by feature: idf * weight per language, then idf
    bias: np.ndarray
    temperature: float

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each language for each text, and whether the text has a letter."""
        codes, owner, letters = _symbols(texts)
        sums = np.zeros((len(texts), self.table.shape[1]))
        for feature, of in _grams(codes, owner):
            if len(of):
                starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                sums[of[starts]] += np.add.reduceat(self.table[feature], starts, axis=0, dtype=np.float64)
        logits = SCALE * sums[:, :-1] / np.maximum(sums[:, -1:], 1e-12) + self.bias
        return softmax(logits / self.temperature), letters > 0


def softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=1, keepdims=True, initial=-np.inf))
    return raised / raised.sum(axis=1, keepdims=True)


class FollowTheLeader:
    """FTRL-proximal for a softmax, with absolute (l1) and squared (l2) penalties."""

    def __init__(self, features: int, classes: int, rate: float, l1: float, l2: float) -> None:
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))
        self.rate, self.l1, self.l2 = rate, l1, l2

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        pull = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -pull / ((1 + np.sqrt(n)) / self.rate + self.l2)

    def step(self, rows: np.ndarray, x: np.ndarray, target: np.ndarray) -> None:
        """One step on a batch whose columns are the features ``rows``."""
        w = self.weights(rows)
        gradient = x.T @ (softmax(x @ w) - target)
        grown = self.n[rows] + gradient * gradient
        self.z[rows] += gradient - (np.sqrt(grown) - np.sqrt(self.n[rows])) / self.rate * w
        self.n[rows] = grown


def fit_languages(
    sample: list[tuple[np.ndarray, np.ndarray, int]],
    languages: list[str],
    idf: np.ndarray,
    rate: float = 0.5,
    l1: float = 0.01,
    l2: float = 0.1,
    epochs: int = 4,
    batch: int = 32,
    seed: int = 1,
) -> LanguageModel:
    """Learn from (features, counts, language) of sampled texts, in an order the seed fixes."""
    dice = np.random.default_rng(seed)
    order = dice.permutation(len(sample))
    apart = order[: len(sample) // 5] if len(sample) >= 10 * len(languages) else order[:0]
    taught = order[len(apart) :]
    leader = FollowTheLeader(FEATURES + 1, len(languages), rate, l1, l2)  # the last row is the bias

    def dense(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        used = np.unique(np.concatenate([sample[r][0] for r in rows]))
        x = np.ones((len(rows), len(used) + 1))
        x[:, :-1] = 0
        target = np.zeros((len(rows), len(languages)))
        for i, r in enumerate(rows):
            features, counts, language = sample[r]
            share = counts * idf[features]
            x[i, np.searchsorted(used, features)] = SCALE * share / share.sum()
            target[i, language] = 1
        return np.r_[used, FEATURES], x, target

    for _ in range(epochs):
        shuffled = dice.permutation(taught)
        for at in range(0, len(shuffled), batch):
            leader.step(*dense(shuffled[at : at + batch]))
    weights = leader.weights()
    temperature = 1.0
    if len(apart):
        used, x, target = dense(apart)
        logits = x @ weights[used]
        choices = np.exp(np.linspace(np.log(0.05), np.log(5), 93))
        losses = [-np.log(np.maximum((softmax(logits / t) * target).sum(axis=1), 1e-12)).mean() for t in choices]
        temperature = float(choices[int(np.argmin(losses))])
    table = np.concatenate([idf[:, None] * weights[:-1], idf[:, None]], axis=1).astype(np.float32)
    return LanguageModel(languages, table, weights[-1], temperature)


def document_frequencies(df: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """Texts with a letter, and how many of them hold each feature; counted over all rows.

    A task adds up its whole partition, so no more than ``FEATURES`` numbers leave it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, lettered = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            texts = batch["_content"]
            for first, rows in portions(texts):
                codes, owner, letters = _symbols([t or "" for t in texts.slice(first, rows).to_pylist()])
                lettered += int((letters > 0).sum())
                for keys in _distinct(codes, owner):
                    seen += np.bincount(keys % FEATURES, minlength=FEATURES)
            release()
        held = np.flatnonzero(seen)
        fields = [pa.array(np.r_[-1, held], pa.int32()), pa.array(np.r_[lettered, seen[held]], pa.int64())]
        yield pa.RecordBatch.from_arrays(fields, ["feature", "n"])

    ship(df.sparkSession)
    counted = df.select(F.col(f"`{text}`").cast("string").alias("_content")).mapInArrow(run, "feature int, n long")
    table = counted.groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # at most FEATURES + 1 rows
    out = np.zeros(FEATURES + 1)
    out[table["feature"].to_numpy()] = table["n"].to_numpy()  # -1, the number of texts, is the last place
    return int(out[-1]), out[:-1]


def _distinct(codes: np.ndarray, owner: np.ndarray) -> Iterator[np.ndarray]:
    """(text, feature) pairs as single numbers, each once; texts are whole in what is yielded."""
    edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    first = 0
    while first < len(edges):
        # As many whole texts as a window holds, and one at least.
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + WINDOW)))
        end = edges[last] if last < len(edges) else len(codes)
        held = np.zeros(0, np.int64)
        for feature, of in _grams(codes[edges[first] : end], owner[edges[first] : end]):
            held = np.union1d(held, of * FEATURES + feature)
        yield held
        first = last


def train_languages(df: DataFrame, id: str, text: str, lang: str, fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Learn from a bounded sample of the rows that have a language, a letter, an id, and are not held out.

    Each language gives about the same number of rows, chosen by a hash of id and text; equal texts of
    a language count once, so the bound holds however often an id or a text is repeated. The features
    of the whole texts are counted in the tasks; only they reach the driver. Document frequencies
    are those of all rows that are not held out, with or without a language.
    """
    named = df.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").alias("_content"), F.col(f"`{lang}`").alias("_lang"))
    open_rows = named.where(F.col("_id").isNotNull() & ~held_out("_id"))
    eligible = open_rows.where(F.col("_lang").isNotNull())
    counts = sorted((r["_lang"], r["n"]) for r in eligible.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect())
    languages = [name for name, _ in counts]
    if not languages:
        return LanguageModel([UNKNOWN], np.ones((FEATURES, 2), np.float32), np.zeros(1), 1.0)
    each = max(LEAST_ROWS, fit_rows // len(languages))
    shares = F.create_map(*[F.lit(x) for name, n in counts for x in (name, min(1.0, each / n))])
    drawn = eligible.where(by_share(F.xxhash64("_id", "_content"), shares[F.col("_lang")], 11))
    chosen = drawn.groupBy("_lang", "_content").agg(F.min("_id").alias("_id"))
    chosen = chosen.withColumn("_mark", F.xxhash64("_content"))

    def made(texts: list[str]) -> dict[str, pa.Array]:
        found: list[np.ndarray] = []
        codes, owner, _ = _symbols(texts)
        pairs = [of * FEATURES + feature for feature, of in _grams(codes, owner)]
        keys, times = np.unique(np.concatenate(pairs) if pairs else np.zeros(0, np.int64), return_counts=True)
        edges = np.searchsorted(keys // FEATURES, np.arange(len(texts) + 1))
        found = pa.array((keys % FEATURES).astype(np.int32)), pa.array(times.astype(np.int32))
        offsets = pa.array(edges.astype(np.int32))
        return {"features": pa.ListArray.from_arrays(offsets, found[0]), "counts": pa.ListArray.from_arrays(offsets, found[1])}

    rows = by_portion(chosen, "_content", made, "features array<int>, counts array<int>", ["_id", "_lang", "_mark"])
    place = {name: i for i, name in enumerate(languages)}
    held = rows.where(F.size("features") > 0).toArrow().sort_by([(c, "ascending") for c in ("_id", "_lang", "_mark")])
    features, counts = held["features"].combine_chunks(), held["counts"].combine_chunks()
    sample = [
        (f.values.to_numpy(), c.values.to_numpy(), place[name])
        for f, c, name in zip(features, counts, held["_lang"].to_pylist(), strict=True)
    ]
    if not sample:
        return LanguageModel([UNKNOWN], np.ones((FEATURES, 2), np.float32), np.zeros(1), 1.0)
    texts, seen = document_frequencies(open_rows, "_content")
    return fit_languages(sample, languages, np.log((1 + texts) / (1 + seen)) + 1)


def with_languages(df: DataFrame, text: str, model: LanguageModel, keep: list[str]) -> DataFrame:
    """``keep`` with ``lang_pred`` and ``score``, the calibrated probability, from the whole text alone.

    A null text, or one without a letter, has ``und`` and score 0. Ties between languages go to the
    first by name. Repeated rows keep their rows; an empty table gives an empty one.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def made(texts: list[str]) -> dict[str, pa.Array]:
        chances, lettered = sent.value.probabilities(texts)
        best = chances.argmax(axis=1)
        names = [sent.value.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
        score = np.where(lettered, chances[np.arange(len(texts)), best], 0.0)
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(score, pa.float64())}

    return by_portion(df, text, made, "lang_pred string, score double", keep)


def identify_languages(df: DataFrame, id: str, text: str, lang: str, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``id``, ``held_out``, ``lang_pred`` and ``score`` of every row, learned from the rows not held out.

    A row without an id counts as not held out and teaches nothing. Columns other than the three
    are ignored; without any row to learn from every prediction is ``und``.
    """
    ship(df.sparkSession)
    model = train_languages(df, id, text, lang, fit_rows)
    marked = df.select(F.col(f"`{id}`"), held_out(id).alias("held_out"), F.col(f"`{text}`").alias("_content"))
    return with_languages(marked, "_content", model, [id, "held_out"])
