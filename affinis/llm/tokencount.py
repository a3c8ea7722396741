"""Token counts by compiled finite-state transducers.

Two deterministic transducers stand for a word-BPE tokenizer file:

* The *splitter* reads character classes and annotates its transitions with the pre-tokens that
  begin there. It has seven states, so a chunk of text is a map from entry state to exit state.
  All chunks of a portion are run at once from all states, their maps are composed by a parallel
  prefix scan, and a second run from the entry states found this way gives the boundaries.
* The *word* transducer reads the bytes of a pre-token and annotates each transition with the
  change of the number of tokens, so the count of a word is the sum along its path. Its states are
  made when a text first reaches them: for every place that a vocabulary token may still grow
  from, a state holds the last token of the encoding up to there and its count.

The last token of the encoding of a prefix is the one suffix token whose predecessor stays
unmerged beside it; ``_stays`` decides that from the times at which merges happen.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import by_portion, compiled, file_bytes

CHUNK = 256  # characters per chunk of the splitter
REMEMBERED = 200_000  # words, and pairs of tokens, that a worker remembers
TOGETHER = 50_000  # new words that are counted at once
TABLE_BITS = 21  # log2 of the places for transitions that a worker remembers
HASH = np.int64(0x1E3779B97F4A7C15)
NEVER = 1 << 60

# Character classes and states of the splitter.
SPACE, LETTER, NUMBER, OTHER, QUOTE, SHORT, R, V, L, E = range(10)
FREE, IN_LETTERS, IN_OTHER, AT_QUOTE, AT_R, AT_V, AT_L = range(7)
# Fixed values of the tokenizer file that the splitter stands for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
# Lower case as the library has it where Python's differs: no final sigma, two newer letters.
LOWER = (("\u03a3", "\u03c3"), ("\ua7cb", "\u0264"), ("\ua7dc", "\u019b"))


@cache
def splitter() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each code point, next state, pre-tokens begun here + 2 * begun one before)."""
    text = "".join(map(chr, range(0x110000)))
    classes = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\s", SPACE), (r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        for run in regex.finditer(f"{pattern}+", text):
            classes[run.start() : run.end()] = kind
    for letters, kind in (("'", QUOTE), ("stmd", SHORT), ("r", R), ("v", V), ("l", L), ("e", E)):
        for c in letters:
            classes[ord(c)] = kind
    letters = (LETTER, SHORT, R, V, L, E)
    go = np.zeros((7, 10), np.uint8)
    begun = np.zeros((7, 10), np.uint8)
    for state in (FREE, IN_LETTERS, IN_OTHER, AT_QUOTE):
        for kind in range(10):
            if kind == SPACE:
                continue
            go[state, kind], begun[state, kind] = {NUMBER: (FREE, 1), OTHER: (IN_OTHER, 1), QUOTE: (AT_QUOTE, 1)}.get(
                kind, (IN_LETTERS, 1)
            )
        if state == IN_LETTERS:
            begun[state, letters] = 0
        if state in (IN_OTHER, AT_QUOTE):
            go[state, [OTHER, QUOTE]], begun[state, [OTHER, QUOTE]] = IN_OTHER, 0
    go[AT_QUOTE, SHORT], begun[AT_QUOTE, SHORT] = FREE, 0
    for kind, state, last in ((R, AT_R, E), (V, AT_V, E), (L, AT_L, L)):
        go[AT_QUOTE, kind], begun[AT_QUOTE, kind] = state, 0
        go[state], begun[state] = go[IN_LETTERS], begun[IN_LETTERS] + 2  # no contraction: a word began at r, v, l
        go[state, last], begun[state, last] = FREE, 0
    return classes, go, begun


def boundaries(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end position of every pre-token of a run of character classes."""
    _, go, begun = splitter()
    n = len(classes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    chunks = -(-(n + 1) // CHUNK)
    grid = np.zeros(chunks * CHUNK, np.uint8)  # padded with spaces, which end what is open
    grid[:n] = classes
    columns = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
    flat_go = go.ravel()
    maps = np.tile(np.arange(7, dtype=np.uint8), (chunks, 1))
    for column in columns:
        maps = flat_go[maps * np.uint8(10) + column[:, None]]
    step = 1
    while step < chunks:  # prefix scan: map k becomes the composition of all maps up to k
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.int64), axis=1)
        step *= 2
    state = np.r_[np.uint8(FREE), maps[:-1, FREE]]
    marks = np.empty((CHUNK, chunks), np.uint8)
    flat_begun = begun.ravel()
    for k, column in enumerate(columns):
        at = state * np.uint8(10) + column
        marks[k] = flat_begun[at]
        state = flat_go[at]
    marks = np.ascontiguousarray(marks.T).ravel()
    begins = (marks & 1).astype(bool)
    begins[:-1] |= (marks[1:] & 2).astype(bool)
    stops = np.flatnonzero(begins | (grid == SPACE))
    starts = np.flatnonzero(begins)
    return starts, stops[np.searchsorted(stops, starts) + 1]


def _spread(keys: np.ndarray) -> np.ndarray:
    """A place in the transition table for each key."""
    return (keys * HASH >> (64 - TABLE_BITS)) & ((1 << TABLE_BITS) - 1)


class WordTransducer:
    """Counts the BPE tokens of words; states and transitions are made on demand."""

    def __init__(self, model: dict) -> None:
        spelled = _byte_letters()
        end = model["end_of_word_suffix"]
        self.ids = dict(model["vocab"])
        self.made = {}  # pair of tokens: (time of the merge, token)
        self.time: dict[int, int] = {}  # when a token is made; letters are there from the start
        self.parts: dict[int, tuple[int, int]] = {}
        for time, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = self.ids[left], self.ids[right], self.ids[left + right]
            self.made.setdefault((a, b), (time, c))
            if c not in self.time:
                self.time[c], self.parts[c] = time, (a, b)
        back = {letter: byte for byte, letter in spelled.items()}
        self.tokens: dict[bytes, int] = {}  # by spelling, inside a word
        self.last_tokens: dict[bytes, int] = {}  # that end a word
        self.heads: set[bytes] = set()
        for token, i in self.ids.items():
            closes = token.endswith(end) and len(token) > len(end)
            letters = token.removesuffix(end) if closes else token
            if i not in self.time and len(letters) > 1:
                continue  # no merge makes it
            raw = bytes(back[c] for c in letters)
            (self.last_tokens if closes else self.tokens)[raw] = i
            self.heads.update(raw[:k] for k in range(1, len(raw)))
        self.known: dict[tuple[int, int], bool] = {}
        self._restart()

    def _restart(self) -> None:
        # A state: the longest tail that a token may begin with, and for the place before each of
        # its bytes and after the last, the last token and the token count up to there.
        self.states: list[tuple[bytes, tuple, tuple]] = [(b"", (None,), (0,))]
        self.numbers = {self.states[0]: 0}
        # Transitions in an open table: state and symbol, next state, tokens more.
        self.keys = np.full(1 << TABLE_BITS, -1, np.int64)
        self.next = np.zeros(1 << TABLE_BITS, np.int32)
        self.more = np.zeros(1 << TABLE_BITS, np.int16)
        self.arcs = 0

    def _stays(self, a: int, b: int) -> bool:
        """Whether token b stays beside token a, that is, no merge joins parts of both.

        Goes back in time from the finished tokens, undoing the later one, and asks each time
        whether the neighbours at the border would have merged before they got their own parents.
        """
        found = self.known.get((a, b))
        if found is None:
            x, y, x_until, y_until = a, b, NEVER, NEVER
            while True:
                merge = self.made.get((x, y))
                if merge is not None and merge[0] < x_until and merge[0] <= y_until:
                    found = False
                    break
                tx, ty = self.time.get(x, -1), self.time.get(y, -1)
                if tx < 0 and ty < 0:
                    found = True
                    break
                if tx > ty:
                    x, x_until = self.parts[x][1], tx
                else:
                    y, y_until = self.parts[y][0], ty
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[a, b] = found
        return found

    def _arc(self, state: int, symbol: int) -> tuple[int, int]:
        """The transition on a byte (0 to 255) or on the last byte of a word (256 to 511)."""
        tail, last, count = self.states[state]
        tail += bytes([symbol & 255])
        closes = symbol > 255
        tokens = self.last_tokens if closes else self.tokens
        for start in range(len(tail)):  # the longest suffix first
            token = tokens.get(tail[start:])
            if token is not None and (last[start] is None or self._stays(last[start], token)):
                break
        else:
            raise ValueError(f"The vocabulary has no token for the byte {symbol & 255}.")
        now = count[start] + 1
        more = now - count[-1]
        if closes:
            return -1, more
        first = next((k for k in range(len(tail)) if tail[k:] in self.heads), len(tail))
        last, count = (*last, token)[first:], (*count, now)[first:]
        made = (tail[first:], last, tuple(c - now for c in count))
        number = self.numbers.get(made)
        if number is None:
            number = self.numbers[made] = len(self.states)
            self.states.append(made)
        return number, more

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Where the table holds the keys; transitions that it lacks are made first."""
        size = len(self.keys) - 1
        at = _spread(keys)
        while True:
            held = self.keys[at]
            miss = held != keys
            if not miss.any():
                return at
            if (held[miss] >= 0).all():
                at[miss] = (at[miss] + 1) & size
                continue
            lacking = np.unique(keys[miss & (held < 0)])
            for key, place in zip(lacking.tolist(), _spread(lacking).tolist(), strict=True):
                while self.keys[place] not in (-1, key):
                    place = (place + 1) & size
                self.next[place], self.more[place] = self._arc(key >> 9, key & 511)
                self.keys[place] = key
                self.arcs += 1

    def counts(self, words: list[str]) -> np.ndarray:
        """Token counts of words without white space; all words take a step at a time."""
        if self.arcs > len(self.keys) // 2:
            self._restart()
        raw = np.frombuffer(" ".join(words).encode("utf-8", "surrogatepass"), np.uint8)
        stops = np.r_[np.flatnonzero(raw == 32), len(raw)]
        at = np.r_[0, stops[:-1] + 1]
        total = np.zeros(len(words), np.int64)
        open_words = np.arange(len(words))
        state = np.zeros(len(words), np.int64)
        while len(open_words):
            last = at + 1 == stops
            place = self._places(state << 9 | last * 256 | raw[at])
            total[open_words] += self.more[place]
            state = self.next[place].astype(np.int64)
            go = ~last
            open_words, at, stops, state = open_words[go], at[go] + 1, stops[go], state[go]
        return total


class TokenCounter:
    """Counts the tokens of whole texts for a word-BPE tokenizer file."""

    def __init__(self, file: bytes) -> None:
        spec = json.loads(file)
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if steps != NORMALIZERS or split["pattern"] != {"Regex": SPLIT} or not split["invert"]:
            raise ValueError("The splitter does not stand for this tokenizer file.")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("Added tokens must be plain strings.")
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.hint = added[0][:2] if added and all(a[:2] == added[0][:2] for a in added) else ""
        self.transducer = WordTransducer(spec["model"])
        self.words: dict[str, int] = {}

    def counts(self, texts: list[str]) -> np.ndarray:
        extra = np.zeros(len(texts), np.int64)
        plain = []
        for i, text in enumerate(texts):
            if self.added is not None and self.hint in text:
                text, extra[i] = self.added.subn(" ", text)
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
                for upper, lower in LOWER:
                    text = text.replace(upper, lower)
            plain.append(text.lower())
        flat = " ".join(plain)
        sizes = np.array([len(t) + 1 for t in plain], np.int64)
        classes = splitter()[0][np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts, ends = boundaries(classes)
        words = [flat[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        if len(self.words) > REMEMBERED:
            self.words.clear()
        known = self.words
        new = list(set(words).difference(known))
        if new:
            counted = [self.transducer.counts(new[i : i + TOGETHER]) for i in range(0, len(new), TOGETHER)]
            known.update(zip(new, np.concatenate(counted).tolist(), strict=True))
        tokens = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
        return extra + np.bincount(owner, weights=tokens, minlength=len(texts)).astype(np.int64)


def _byte_letters() -> dict[int, str]:
    """The visible letter that byte-level tokenizer files write for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def counter_of(file: bytes) -> TokenCounter:
    return compiled("counter", hashlib.sha256(file).digest(), lambda: TokenCounter(file))


def token_counts(df: DataFrame, text: str, path: str, limit: int, keep: list[str]) -> DataFrame:
    """``keep`` with ``n_bytes`` and ``n_tokens`` of every whole text, and ``over_limit``.

    Strings of added tokens inside a text count as one token each, as the library has it by
    default. A null or empty text has no bytes and no tokens. Repeated rows keep their rows; other
    columns are not touched; an empty table gives an empty one. Texts of any length are read
    whole: the splitter runs over chunks, so a long text costs no more per character.
    """
    file = df.sparkSession.sparkContext.broadcast(file_bytes(path))

    def made(texts: list[str]) -> dict[str, pa.Array]:
        return {
            "n_bytes": pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
            "n_tokens": pa.array(counter_of(file.value).counts(texts), pa.int64()),
        }

    counted = by_portion(df, text, made, "n_bytes long, n_tokens long", keep)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
