"""Toxicity by a support vector machine on a gapped-subsequence string kernel.

The kernel of two words sums over all subsequences of three characters that they share, each
occurrence weighted by ``DECAY`` to the power of the span it covers; spans reach over at most two
skipped characters, and word borders count as characters. So an insult with inserted characters keeps
most of its likeness. The Nyström method turns the kernel into a finite map: likeness to a set
of landmark words, whitened by the root of the landmarks' own kernel matrix. A linear
support vector machine separates toxic from other sentences there, of which only the whole is labelled:
a toxic one has to hold a word beyond the margin, any other one none (multiple instances). So each
labelled text brings the words it is decided by: at first those that tell toxic texts from others,
then, round by round, the ones that the machine itself values most.

Its value for a word is a weighted sum over the word's subsequences, with a weight for each
subsequence that some landmark has. Landmarks and weights fold into one small sorted table, and
scoring a word costs a look-up per subsequence.

What a text is called depends on all its words: a calibrated logistic model reads the highest
value, the number and the share of words beyond the margin, and the sum of their values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import ship, written
from .texts import by_portion, by_share, code_points, held_out, letter_table

DECAY = 0.7
OFFSETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
FIT_ROWS = 8000  # bound of the labelled sample; toxic rows may be half of it
SLACK = 1.25  # times its bound: what a draw by hash may exceed it by
DECIDING = 3  # words that a labelled text brings to the machine at a time
LANDMARKS = 96
EVIDENCE = 0.8  # of a word, in units of the logarithm of the number of words
HEADS, HEAD = (4, 5, 6, 7, 8), "\x04"  # lengths of beginnings of words that are counted too, and their mark
ROUNDS = 3
TEXTS = 512  # whose words are valued at once
INSERTED = 3  # copies of an insult with one letter inserted that the machine learns with it
REMEMBERED = 8 << 20  # characters of the words whose value a worker remembers
OVERHEAD = 64  # counted as characters for each of them
TOGETHER = 4_000  # words that are valued at once
LONGEST = 64  # letters; longer words are scored by their windows of this length
# Letters set apart: i d i o t, i-d-i-o-t.
RUNS = re.compile(r"[^\W\d_]+")
APART = re.compile(r"(?<![^\W\d_])[^\W\d_](?:[^\w\n]{1,2}[^\W\d_]){3,}(?![^\W\d_])")


def letters_only(words: list[str]) -> list[str]:
    """The letters of each word; what is inserted between them goes."""
    flat = code_points("\n".join(words))
    keep = letter_table()[flat] | (flat == 10)
    return flat[keep].astype("<u4").tobytes().decode("utf-32-le").split("\n") if words else []


def words_of(text: str) -> list[str]:
    """The lower-case words of a text, and the words that letters set apart spell."""
    lowered = text.lower()
    return lowered.split() + ["".join(c for c in m[0] if c.isalpha()) for m in APART.finditer(lowered)]


def parts_of(word: str) -> list[str]:
    """What a word is valued by: all its letters and, where something divides them, each run of letters."""
    if word.isalpha():
        return [word]
    runs = RUNS.findall(word)
    return runs if len(runs) == 1 else ["".join(runs), *runs]


def windows_of(word: str) -> list[str]:
    """The word, or its overlapping windows of ``LONGEST`` letters."""
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight) of all occurrences; the weights of a word have length one."""
    bordered = "".join(f"\x02{w}\x03" for w in words)
    codes = code_points(bordered).astype(np.int64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)[owner]
    place = np.arange(len(codes))
    of, keys, weights = [], [], []
    for a, b in OFFSETS:
        first = np.flatnonzero(place + b < ends)
        of.append(owner[first])
        keys.append((codes[first] << 42) | (codes[first + a] << 21) | codes[first + b])
        weights.append(np.full(len(first), DECAY ** (b + 1)))
    word, key, weight = np.concatenate(of), np.concatenate(keys), np.concatenate(weights)
    norm = np.sqrt(np.bincount(word, weights=weight * weight, minlength=len(words)))
    return word, key, weight / np.maximum(norm[word], 1e-12)


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """The kernel of all pairs of a list of words with a short one."""
    word, key, weight = subsequences(right)
    names, at = np.unique(key, return_inverse=True)
    b = np.zeros((len(right), len(names)), np.float32)
    np.add.at(b, (word, at), weight)
    out = np.zeros((len(left), len(right)))
    for begin in range(0, len(left), 512):
        some = left[begin : begin + 512]
        word, key, weight = subsequences(some)
        at = np.minimum(np.searchsorted(names, key), len(names) - 1)
        hit = names[at] == key
        a = np.zeros((len(some), len(names)), np.float32)
        np.add.at(a, (word[hit], at[hit]), weight[hit])
        out[begin : begin + len(some)] = a @ b.T
    return out


@dataclass
class ToxicityModel:
    keys: np.ndarray  # subsequences of the landmarks, sorted
    weights: np.ndarray
    bias: float
    centre: np.ndarray  # of the text features
    scale: np.ndarray
    slopes: np.ndarray
    offset: float
    values: dict[str, float] = field(default_factory=dict)
    size: int = 0  # of the remembered words

    def word_values(self, words: list[str]) -> np.ndarray:
        """The value of the machine for words of letters; above zero is toxic."""
        if not len(self.keys) or not words:
            return np.full(len(words), self.bias)
        windows, source = words, np.arange(len(words))
        if any(len(w) > LONGEST for w in words):
            cut = [windows_of(w) for w in words]
            windows, source = [x for c in cut for x in c], np.repeat(np.arange(len(words)), [len(c) for c in cut])
        out = np.full(len(words), -np.inf)
        for begin in range(0, len(windows), TOGETHER):
            word, key, weight = subsequences(windows[begin : begin + TOGETHER])
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            part = min(TOGETHER, len(windows) - begin)
            value = self.bias + np.bincount(word[hit], weights=weight[hit] * self.weights[at[hit]], minlength=part)
            np.maximum.at(out, source[begin : begin + part], value)
        return out

    def token_values(self, tokens: list[str]) -> np.ndarray:
        """The highest value of the parts of each token."""
        cut = [parts_of(t) or [""] for t in tokens]
        source = np.repeat(np.arange(len(tokens)), [len(c) for c in cut])
        out = np.full(len(tokens), -np.inf)
        np.maximum.at(out, source, self.word_values([x for c in cut for x in c]))
        return out

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: highest value, words beyond the margin, their share, the sum of their values."""
        lists = [words_of(t) for t in texts]
        words = [w for ws in lists for w in ws]
        known = self.values
        new = list(set(words).difference(known))
        known.update(zip(new, self.token_values(new).tolist(), strict=True))
        value = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
        self.size += sum(map(len, new)) + OVERHEAD * len(new)
        if self.size > REMEMBERED:
            known.clear()
            self.size = 0
        counts = np.array([len(ws) for ws in lists], np.int64)
        owner = np.repeat(np.arange(len(texts)), counts)
        over = np.maximum(value, 0)
        number = np.bincount(owner, weights=over > 0, minlength=len(texts))
        total = np.bincount(owner, weights=np.minimum(over, 2), minlength=len(texts))
        top = np.full(len(texts), -2.0)
        np.maximum.at(top, owner, value)
        share = 1000 * number / np.maximum(counts, 1)
        return np.stack([np.clip(top, -2, 2), np.log1p(number), np.log1p(share), np.log1p(total)], axis=1)

    def scores(self, texts: list[str]) -> np.ndarray:
        x = (self.features(texts) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.slopes + self.offset, -40, 40)))

    def __getstate__(self) -> dict:
        return {**self.__dict__, "values": {}, "size": 0}  # remembered words stay in their worker


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by accelerated gradient steps."""
    a = np.c_[x, np.ones(len(x))]
    weight = weight / weight.sum()
    limit = 2 * np.linalg.eigvalsh((a * weight[:, None]).T @ a)[-1] + penalty
    w = ahead = np.zeros(a.shape[1])
    ridge = np.r_[np.full(x.shape[1], penalty), 0.0]
    momentum = 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (a @ ahead))
        gradient = -2 * a.T @ (weight * y * slack) + ridge * ahead
        new = ahead - gradient / limit
        grown = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead = new + (momentum - 1) / grown * (new - w)
        w, momentum = new, grown
    return w[:-1], float(w[-1])


def landmarks_of(words: list[str], pick: int) -> list[str]:
    """Words that lie far from each other in the kernel, the first of the list to begin with."""
    if len(words) <= pick:
        return list(words)
    word, key, weight = subsequences(words)
    names, at = np.unique(key, return_inverse=True)

    def like(i: int) -> np.ndarray:
        own = np.bincount(at[word == i], weights=weight[word == i], minlength=len(names))
        return np.bincount(word, weights=weight * own[at], minlength=len(words))

    chosen = [0]
    closest = like(0)
    while len(chosen) < pick:
        following = int(np.argmin(closest))
        chosen.append(following)
        closest = np.maximum(closest, like(following))
    return [words[i] for i in chosen]


def with_insertions(words: list[str], seed: int = 1) -> list[str]:
    """Copies of words of five letters or more with one of the words' letters inserted inside."""
    dice = np.random.default_rng(seed)
    letters = sorted(set("".join(words)))
    out = []
    for word in words:
        for _ in range(INSERTED if len(word) >= 5 else 0):
            at = int(dice.integers(1, len(word)))
            out.append(word[:at] + letters[int(dice.integers(len(letters)))] + word[at:])
    return out


def fit_words(toxic: dict[str, float], other: dict[str, float]) -> tuple[np.ndarray, np.ndarray, float]:
    """Subsequence keys, their weights and the bias of the machine; both sides with numbers of texts."""
    if not toxic or not other:
        return np.zeros(0, np.int64), np.zeros(0), -1.0
    telling, plain = sorted(toxic, key=lambda w: (-toxic[w], w)), sorted(other)
    altered = sorted(set(with_insertions(telling)) - set(toxic) - set(other))
    # Landmarks: insults of all kinds, and the words that are most like them but are none.
    first = landmarks_of(telling, LANDMARKS // 2)
    alike = kernel(plain, first).max(axis=1)
    close = [plain[i] for i in np.argsort(-alike, kind="stable")[: 4 * LANDMARKS]]
    marks = list(dict.fromkeys(first + landmarks_of(close, LANDMARKS // 2)))
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    root[:, values < 1e-6] = 0
    mapped = kernel(telling + altered + plain, marks) @ root
    y = np.r_[np.ones(len(telling) + len(altered)), -np.ones(len(plain))]
    # Roots of the numbers of texts: the rare forms of an insult count, and so do the rare other words.
    own = np.sqrt([toxic[w] for w in telling])
    own = np.r_[own / own.sum(), np.full(len(altered), 0.5 / max(1, len(altered)))]
    share = np.sqrt([other[w] for w in plain])
    w, bias = machine(mapped, y, np.r_[own, 2 * share / share.sum()])
    beta = root @ w  # the weight of each landmark
    word, key, part = subsequences(marks)
    keys, at = np.unique(key, return_inverse=True)
    return keys, np.bincount(at, weights=part * beta[word]), bias


def fit_texts(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Centre, scale, slopes and offset of a logistic model, by Newton steps with a small ridge."""
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    a = np.c_[(x - centre) / scale, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    ridge = np.r_[np.full(x.shape[1], 0.05), 1e-6]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(hessian, a.T @ (p - y) + ridge * w)
        w = w - np.clip(step, -5, 5)
    return centre, scale, w[:-1], float(w[-1])


def train_toxicity(df: DataFrame, labels: DataFrame, id: str, text: str, label: str = "toxic", fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Learn from a bounded sample of the labelled rows that are not held out.

    Three quarters of the sample teach the machine, the last quarter calibrates the score of whole
    texts. Equal texts with the same label count once. Each toxic text first brings the words that are
    found in toxic texts more often than chance would have it for any of so many words
    (likelihood-ratio test), every other text some of its words by hash; in each round that follows, a
    toxic text brings the word that the machine values most, and any other text those that the machine
    values most and wrongly. So what reaches the driver is bounded by the rows, ``DECIDING`` words of a
    text at a time, and words themselves are neither counted out nor cut off.
    """
    spark = df.sparkSession
    marked = labels.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("_toxic"))
    marked = marked.where(F.col("_toxic").isin(0, 1) & F.col("_id").isNotNull() & ~held_out("_id"))
    numbers = _numbers(marked)
    chosen = marked.where(by_share(F.col("_id"), _shares(numbers, fit_rows / 2), 13)).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    texts = df.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").alias("_content"))
    # The chosen labels are bounded by ``fit_rows``, so they may be broadcast.
    drawn = written(_once(texts.join(F.broadcast(chosen), "_id").where(F.col("_content").isNotNull())), "labelled")
    # An id may stand on many rows: the bound holds for rows.
    few = by_share(F.xxhash64("_id", "_content"), _shares(_numbers(drawn), SLACK * fit_rows / 2), 23)
    fold = F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(4)) == 0
    sample = drawn.where(few).withColumn("_apart", fold)

    def listed(portion: list[str]) -> dict[str, pa.Array]:
        found = [sorted({x for w in set(words_of(t)) for p in parts_of(w) for x in windows_of(p)}) for t in portion]
        heads = [sorted({w[:n] + HEAD for w in ws for n in HEADS if len(w) >= n}) for ws in found]
        kind = pa.list_(pa.string())
        return {"words": pa.array(found, kind), "heads": pa.array(heads, kind)}

    fields = "words array<string>, heads array<string>"
    taught = written(by_portion(sample.where(~F.col("_apart")), "_content", listed, fields, ["_id", "_toxic"]), "taught")
    known = _numbers(taught)
    bad, good = known.get(1, 0), known.get(0, 0)
    counts = written(
        taught.select("_toxic", F.explode(F.concat("words", "heads")).alias("word"))
        .groupBy("word")
        .agg(F.sum("_toxic").alias("bad"), F.sum(1 - F.col("_toxic")).alias("good")),
        "counts",
    )
    total = F.col("bad") + F.col("good")
    usual = max(bad, 0.5) / max(1, bad + good)
    surplus = F.col("bad") * F.log((F.col("bad") + 1e-9) / (total * usual)) + F.col("good") * F.log(
        (F.col("good") + 1e-9) / (total * (1 - usual) + 1e-9)
    )
    often = F.col("bad") / max(1, bad) > 4 * F.col("good") / max(1, good)
    sure = (F.col("bad") > usual * total) & (surplus >= EVIDENCE * float(np.log(2 + counts.count())))
    is_head = F.col("word").endswith(HEAD)
    heads = counts.where(is_head & sure).select(F.col("word").alias("head"))
    words = counts.where(~is_head & often).select("word", sure.alias("sure"), surplus.alias("surplus"))
    beginnings = F.array(*[F.concat(F.substring("word", 1, n), F.lit(HEAD)) for n in HEADS])
    begun = words.select("word", F.explode(beginnings).alias("head")).join(heads, "head", "left_semi").select("word").distinct()
    telling = words.where("sure").select("word", "surplus").unionByName(words.where("not sure").join(begun, "word", "left_semi").drop("sure"))
    # Best first; a text brings as many as DECIDING.
    each = taught.where("_toxic = 1").select("_id", F.xxhash64("words").alias("_text"), F.explode("words").alias("word"))
    ranked = each.join(telling, "word").groupBy("_id", "_text").agg(F.collect_list(F.struct(-F.col("surplus"), "word")).alias("found"))
    by_hash = F.transform("words", lambda w: F.struct(F.xxhash64(w, F.col("_id"), F.lit(19)).alias("place"), w.alias("word")))
    first = F.slice(F.array_sort("found"), 1, DECIDING)["word"]
    brought = ranked.select(F.lit(1).alias("_toxic"), F.explode(first).alias("word")).unionByName(
        taught.where("_toxic = 0").select(by_hash.alias("found")).select(
            F.lit(0).alias("_toxic"), F.explode(first).alias("word")
        )
    )
    toxic, other = {}, {}
    for r in brought.groupBy("_toxic", "word").count().collect():
        (toxic if r["_toxic"] else other)[r["word"]] = r["count"]
    keys, weights, bias = fit_words(toxic, other)
    for _ in range(ROUNDS if len(keys) else 0):
        draft = ToxicityModel(keys, weights, bias, np.zeros(4), np.ones(4), np.zeros(4), 0.0)
        for r in _decided_by(taught, draft).collect():
            side = toxic if r["_toxic"] else other
            side[r["word"]] = max(side.get(r["word"], 0), r["count"])
        for w in toxic.keys() & other.keys():  # a word of both stands where more texts bring it
            del (toxic if toxic[w] * good < other[w] * bad else other)[w]
        keys, weights, bias = fit_words(toxic, other)
    model = ToxicityModel(keys, weights, bias, np.zeros(4), np.ones(4), np.zeros(4), -3.0)
    sent = spark.sparkContext.broadcast(model)

    def measured(portion: list[str]) -> dict[str, pa.Array]:
        x = sent.value.features(portion)
        return {f"x{i}": pa.array(x[:, i]) for i in range(4)}

    apart = by_portion(sample.where("_apart"), "_content", measured, "x0 double, x1 double, x2 double, x3 double", ["_toxic"])
    rows = apart.toArrow()
    y = rows["_toxic"].to_numpy().astype(float)
    if len(y) and 0 < y.sum() < len(y):
        x = np.stack([rows[f"x{i}"].to_numpy() for i in range(4)], axis=1)
        # The sample holds more toxic texts than the table; the offset is set back to its share.
        model.centre, model.scale, model.slopes, model.offset = fit_texts(x, y)
        part = y.mean()
        share = numbers.get(1, 0) / max(1, sum(numbers.values()))
        if 0 < share < 1:
            model.offset += float(np.log(share / (1 - share)) - np.log(part / (1 - part)))
    return model


def _numbers(marked: DataFrame) -> dict[int, int]:
    """Rows by label."""
    return {r["_toxic"]: r["n"] for r in marked.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}


def _shares(numbers: dict[int, int], most: float) -> Column:
    """The share of the rows of each label that makes about ``most`` rows."""
    toxic, other = (min(1.0, most / max(1, numbers.get(x, 0))) for x in (1, 0))
    return F.when(F.col("_toxic") == 1, toxic).otherwise(other)


def _decided_by(taught: DataFrame, draft: ToxicityModel) -> DataFrame:
    """``_toxic``, ``word``, ``count`` of the words by which the texts are decided.

    Of a toxic text the one with the highest value, if any landmark speaks for it at all; of any other text
    the highest ``DECIDING`` that are not on the right side of the margin.
    """
    sent = taught.sparkSession.sparkContext.broadcast(draft)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS):
                some = batch.slice(first, TEXTS)
                lists = some["words"]
                words = lists.flatten().dictionary_encode()
                value = sent.value.word_values(words.dictionary.to_pylist())[words.indices.to_numpy()]
                ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
                at, of = [], []
                for toxic, begin, end in zip(some["_toxic"].to_pylist(), np.r_[0, ends[:-1]], ends, strict=True):
                    order = begin + np.argsort(-value[begin:end], kind="stable")[: 1 if toxic else DECIDING]
                    order = order[value[order] > -1]
                    at.append(order)
                    of += [toxic] * len(order)
                chosen = words.take(pa.array(np.concatenate(at).astype(np.int64))).dictionary_decode()
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), chosen], ["_toxic", "word"])

    found = taught.select("_toxic", "words").mapInArrow(run, "_toxic int, word string")
    return found.groupBy("_toxic", "word").count()


def _once(drawn: DataFrame) -> DataFrame:
    """``_id``, ``_content`` and ``_toxic``: of rows with equal text and label the one with the smallest id."""
    return drawn.groupBy("_content", "_toxic").agg(F.min("_id").alias("_id")).select("_id", "_content", "_toxic")


def with_toxicity(df: DataFrame, text: str, model: ToxicityModel, keep: list[str], threshold: float = 0.3) -> DataFrame:
    """``keep`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) of every whole text."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def made(texts: list[str]) -> dict[str, pa.Array]:
        return {"score": pa.array(sent.value.scores(texts), pa.float64())}

    scored = by_portion(df, text, made, "score double", keep)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxic_texts(df: DataFrame, labels: DataFrame, id: str, text: str, threshold: float = 0.3) -> DataFrame:
    """``id``, ``held_out``, ``score`` and ``predicted`` of every row; learned from rows not held out.

    Labels that are null or neither 0 nor 1 teach nothing; of several labels of an id the highest
    counts. A null or empty text is scored as a text without words; a row without an id counts as not
    held out. Repeated rows keep their rows and other columns are ignored. Without both kinds of
    labels the score is a small constant. An empty table gives an empty result.
    """
    ship(df.sparkSession)
    model = train_toxicity(df, labels, id, text)
    marked = df.select(F.col(f"`{id}`"), held_out(id).alias("held_out"), F.col(f"`{text}`").alias("_content"))
    return with_toxicity(marked, "_content", model, [id, "held_out"], threshold)
