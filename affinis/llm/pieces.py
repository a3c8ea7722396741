"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The texts of a portion become one flat array of characters. It is cut wherever two neighbouring
characters occur side by side in no piece of the vocabulary: no merge can cross such a place, so
each word between two cuts is encoded by itself, once per worker while it is remembered. Words
that are new are merged together: every round looks up the rank of all neighbouring pairs, takes
the minimum per word by a segmented reduction, merges leftmost places of that rank in all words
at once, and drops the words that have no pair left.

Within a word the library merges the best pair of the whole word, leftmost first. A round may
merge all places of one rank at once only if the new symbol can start no pair of an equal or better
rank; the compiled table knows which symbols those are, and for others a round merges one place.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .texts import by_portion, compiled, file_bytes, ragged

SPACE = "▁"
LONG = 2048  # symbols; a longer word is merged by an agenda, in the same order
REMEMBERED = 200_000  # words a worker remembers
TOGETHER = 20_000  # new words that are merged at once
PORTION = 1 << 18  # bytes of text that are encoded at once: their arrays take some fifty times as much
NO_PAIR = np.iinfo(np.int32).max
# Fixed values of the model format: kinds of pieces.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class PieceTables:
    """A vocabulary as arrays. A symbol is a piece id, or the number of a character beyond them."""

    pairs: np.ndarray  # left * width + right, sorted
    rank: np.ndarray  # of each pair; the best is lowest, equal scores share a rank
    merged: np.ndarray  # the piece that each pair becomes
    single: np.ndarray  # by rank: one place per round only
    width: int
    pieces: int
    symbol: np.ndarray  # by code point: its piece, a number from ``pieces`` on, or width + code point
    letters: list[int]  # code points numbered from ``pieces`` on
    inner: np.ndarray  # by code point: number of a character that occurs in longer pieces, else 0
    beside: np.ndarray  # [a, b]: some piece has the numbered characters a and b side by side
    byte_ids: np.ndarray
    unknown: int
    begin: int
    end: int
    raw: np.ndarray  # the bytes that all pieces stand for, one after another
    raw_start: np.ndarray
    raw_length: np.ndarray
    controls: np.ndarray
    byte_piece: np.ndarray


def compile_pieces(model: bytes) -> PieceTables:
    """The tables of a BPE model without a rewriting normaliser."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    norm, train = proto.normalizer_spec, proto.trainer_spec
    kinds = {p.type for p in proto.pieces}
    plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
    if train.model_type != 2 or norm.precompiled_charsmap or not plain or train.treat_whitespace_as_suffix:
        raise ValueError("Only BPE models without a rewriting normaliser are supported.")
    if kinds & {USER_DEFINED, UNUSED} or not train.byte_fallback:
        raise ValueError("Models need byte fallback, and no user-defined or unused pieces.")
    score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
    spelled = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
    longer = [p for p in score if len(p) > 1]
    letters = sorted(set("".join(longer)))
    width = len(proto.pieces) + len(letters)
    symbol = width + np.arange(0x110000, dtype=np.int64)
    for k, c in enumerate(letters):
        symbol[ord(c)] = len(proto.pieces) + k
    for c, i in spelled.items():
        if len(c) == 1:
            symbol[ord(c)] = i
    ranks = {s: k for k, s in enumerate(sorted({score[p] for p in longer}, reverse=True))}
    rows = []
    for p in longer:
        for cut in range(1, len(p)):
            left, right = p[:cut], p[cut:]
            a, b = _symbol(left, spelled, symbol), _symbol(right, spelled, symbol)
            if a is not None and b is not None:
                rows.append((a * width + b, ranks[score[p]], spelled[p], a, b))
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    own = np.full(width, -1, np.int64)  # the rank that made a symbol
    for p in longer:
        own[spelled[p]] = ranks[score[p]]
    single = np.zeros(len(ranks) + 1, bool)
    for part in (table[:, 3], table[:, 4]):
        early = table[:, 1] <= own[part]
        single[own[part[early]]] = True
    inner = np.zeros(0x110000, np.int16)
    for k, c in enumerate(letters):
        inner[ord(c)] = k + 1
    beside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
    for p in longer:
        at = inner[[ord(c) for c in p]]
        beside[at[:-1], at[1:]] = True
    byte_ids = np.zeros(256, np.int64)
    raw = []
    for i, p in enumerate(proto.pieces):
        if p.type == BYTE:
            byte_ids[int(p.piece[3:5], 16)] = i
            raw.append(bytes([int(p.piece[3:5], 16)]))
        elif p.type == CONTROL:
            raw.append(b"")
        elif p.type == UNKNOWN:
            raw.append(train.unk_surface.encode())
        else:
            raw.append(p.piece.replace(SPACE, " ").encode())
    lengths = np.array([len(r) for r in raw], np.int64)
    by_name = {p.piece: i for i, p in enumerate(proto.pieces)}
    return PieceTables(
        pairs=table[:, 0].copy(),
        rank=table[:, 1].astype(np.int32),
        merged=table[:, 2].copy(),
        single=single,
        width=width,
        pieces=len(proto.pieces),
        symbol=symbol,
        letters=[ord(c) for c in letters],
        inner=inner,
        beside=beside,
        byte_ids=byte_ids,
        unknown=next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN),
        begin=by_name[train.bos_piece],
        end=by_name[train.eos_piece],
        raw=np.frombuffer(b"".join(raw), np.uint8),
        raw_start=np.cumsum(lengths) - lengths,
        raw_length=lengths,
        controls=np.array([p.type == CONTROL for p in proto.pieces]),
        byte_piece=np.array([p.type == BYTE for p in proto.pieces]),
    )


def _symbol(part: str, spelled: dict[str, int], symbol: np.ndarray) -> int | None:
    return int(symbol[ord(part)]) if len(part) == 1 else spelled.get(part)


class PieceCodec:
    """Encodes and decodes lists of texts; remembers words between portions."""

    def __init__(self, tables: PieceTables) -> None:
        self.tables = tables
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, texts: list[str], ends: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after another, and the number of ids of each."""
        t = self.tables
        marked = [SPACE + x.replace(" ", SPACE) if x else "" for x in texts]
        flat = "".join(marked)
        chars = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(x) for x in marked], np.int64)
        at = t.inner[chars]
        cut = np.ones(len(chars) + 1, bool)
        if len(chars):
            cut[1:-1] = ~t.beside[at[:-1], at[1:]]
            cut[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        places = np.flatnonzero(cut)
        begins = places[:-1] if len(chars) else places[:0]
        edges = places.tolist()
        words = [flat[a:b] for a, b in zip(edges, edges[1:], strict=False)] if len(chars) else []
        if len(self.place) > REMEMBERED:
            self._forget()
        known = self.place
        new = [w for w in set(words) if w not in known]
        if new:
            merged = [self._merge(new[i : i + TOGETHER]) for i in range(0, len(new), TOGETHER)]
            counts = np.concatenate([c for _, c in merged])
            first = len(self.starts)
            known.update(zip(new, range(first, first + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.lengths = np.concatenate([self.lengths, counts])
            self.ids = np.concatenate([self.ids, *[ids.astype(np.uint32) for ids, _ in merged]])
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        lengths = self.lengths[at]
        ids = self.ids[ragged(self.starts[at], lengths)]
        owner = np.searchsorted(np.cumsum(sizes), begins, side="right")
        counts = np.bincount(owner, weights=lengths, minlength=len(texts)).astype(np.int64)
        if not ends:
            return ids, counts
        out = np.empty(len(ids) + 2 * len(texts), np.uint32)
        total = np.cumsum(counts + 2)
        inside = np.ones(len(out), bool)
        inside[total - counts - 2] = False
        inside[total - 1] = False
        out[inside] = ids
        out[total - counts - 2] = t.begin
        out[total - 1] = t.end
        return out, counts + 2

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        t = self.tables
        flat = "".join(words).encode("utf-32-le", "surrogatepass")
        symbols = t.symbol[np.frombuffer(flat, np.uint32)]
        sizes = np.array([len(w) for w in words], np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_owner = [], []
        long = sizes > LONG
        if long.any():
            ends = np.cumsum(sizes)
            for w in np.flatnonzero(long):
                got = self._agenda(symbols[ends[w] - sizes[w] : ends[w]].tolist())
                done_symbols.append(np.array(got, np.int64))
                done_owner.append(np.full(len(got), w))
            rest = ~long[owner]
            symbols, owner = symbols[rest], owner[rest]
        while len(symbols):
            rank, merged = self._pairs_of(symbols, owner)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.r_[starts, len(symbols)])
            best_here = np.repeat(best, counts)
            open_here = best_here < NO_PAIR
            if not open_here.all():
                done_symbols.append(symbols[~open_here])
                done_owner.append(owner[~open_here])
                symbols, owner = symbols[open_here], owner[open_here]
                rank, merged, best_here = rank[open_here], merged[open_here], best_here[open_here]
            if not len(symbols):
                break
            hit = rank == best_here
            places = np.flatnonzero(hit)
            fresh = np.r_[True, owner[places[1:]] != owner[places[:-1]]]
            # Of places side by side (aaa) every other one is free.
            run = np.r_[True, np.diff(places) != 1]
            run_start = np.maximum.accumulate(np.where(run, places, 0))
            take = np.where(t.single[best_here[places]], fresh, (places - run_start) % 2 == 0)
            places = places[take]
            symbols[places] = merged[places]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        symbols = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
        owner = np.concatenate(done_owner) if done_owner else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        symbols, owner = symbols[order], owner[order]
        plain = symbols < t.pieces
        if not plain.all():
            symbols, owner = self._bytes(symbols, owner, plain)
        return symbols, np.bincount(owner, minlength=len(words)).astype(np.int64)

    def _bytes(self, symbols: np.ndarray, owner: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the pieces of their bytes."""
        t = self.tables
        spelled = [
            t.byte_ids[list(chr(t.letters[s - t.pieces] if s < t.width else s - t.width).encode("utf-8", "surrogatepass"))]
            for s in symbols[~plain].tolist()
        ]
        width = np.ones(len(symbols), np.int64)
        width[~plain] = [len(x) for x in spelled]
        out = np.repeat(symbols, width)
        out[np.repeat(~plain, width)] = np.concatenate(spelled)
        return out, np.repeat(owner, width)

    def _pairs_of(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the pair that starts at each symbol, and what it becomes."""
        t = self.tables
        rank = np.full(len(symbols), NO_PAIR, np.int32)
        merged = np.zeros(len(symbols), np.int64)
        if len(symbols) > 1 and len(t.pairs):
            inside = (owner[1:] == owner[:-1]) & (symbols[1:] < t.width) & (symbols[:-1] < t.width)
            key = symbols[:-1] * t.width + symbols[1:]
            at = np.minimum(np.searchsorted(t.pairs, key), len(t.pairs) - 1)
            found = np.flatnonzero((t.pairs[at] == key) & inside)
            rank[found] = t.rank[at[found]]
            merged[found] = t.merged[at[found]]
        return rank, merged

    def _agenda(self, symbols: list[int]) -> list[int]:
        """The same merges for one long word, best and leftmost first, from a heap."""
        t = self.tables
        after = [*range(1, len(symbols)), -1]
        before = list(range(-1, len(symbols) - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < 0 or symbols[i] >= t.width or symbols[j] >= t.width:
                return
            key = symbols[i] * t.width + symbols[j]
            at = int(np.searchsorted(t.pairs, key))
            if at < len(t.pairs) and t.pairs[at] == key:
                heapq.heappush(heap, (int(t.rank[at]), i, symbols[i], symbols[j], int(t.merged[at])))

        for i in range(len(symbols)):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s in symbols if s >= 0]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of id sequences: the space that encoding puts first is taken off again."""
        t = self.tables
        ids = ids.astype(np.int64)
        lengths = t.raw_length[ids]
        raw = t.raw[ragged(t.raw_start[ids], lengths)]
        owner = np.repeat(np.arange(len(counts)), counts)
        sizes = np.bincount(owner, weights=lengths, minlength=len(counts)).astype(np.int64)
        kept = np.flatnonzero(~t.controls[ids])
        first = np.full(len(counts), -1, np.int64)
        if len(kept):
            head = kept[np.r_[True, owner[kept[1:]] != owner[kept[:-1]]]]
            first[owner[head]] = ids[head]
        spaced = (first >= 0) & (t.raw_length[first] > 0) & ~t.byte_piece[first]
        spaced &= t.raw[np.minimum(t.raw_start[first], len(t.raw) - 1)] == 32
        data = raw.tobytes()
        ends = np.cumsum(sizes)
        begins = (ends - sizes + spaced).tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(begins, ends.tolist(), strict=True)]


def codec_of(model: bytes) -> PieceCodec:
    digest = hashlib.sha256(model).digest()
    return compiled("pieces", digest, lambda: PieceCodec(compile_pieces(model)))


def piece_codes(df: DataFrame, text: str, path: str, keep: list[str], content: bool = True) -> DataFrame:
    """Encode and decode every text whole: ``keep`` and ``ids``, ``decoded`` and their digests.

    ``n_tokens`` counts all ids, begin and end among them; ``ids_sha256`` is the hash of the ids
    as little-endian unsigned 32-bit integers, ``decoded_sha256`` of the decoded text. With
    ``content=False`` the ids and the decoded text stay in the task and only the digests leave it.

    A null text counts as empty and gives begin and end alone. Repeated rows each keep their row;
    columns of ``df`` outside ``keep`` and ``text`` are not touched. An empty table gives an empty one.
    """
    model = df.sparkSession.sparkContext.broadcast(file_bytes(path))

    def made(texts: list[str]) -> dict[str, pa.Array]:
        codec = codec_of(model.value)
        ids, counts = codec.encode(texts)
        decoded = codec.decode(ids, counts)
        data = ids.astype("<u4").tobytes()
        ends = (4 * np.cumsum(counts)).tolist()
        begins = [0, *ends[:-1]]
        out = {
            "n_tokens": pa.array(counts, pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(begins, ends, strict=True)], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for d in decoded], pa.string()),
        }
        if content:
            offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
            out["ids"] = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
            out["decoded"] = pa.array(decoded, pa.string())
        return out

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return by_portion(df, text, made, fields + (", ids array<int>, decoded string" if content else ""), keep, PORTION)
