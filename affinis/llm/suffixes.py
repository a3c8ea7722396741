"""Removal of every byte that lies in a long string which also starts elsewhere.

Suffixes that share a long string must meet in one shard. A string of ``length`` bytes goes to the
shard of its smallest hashed gram, so equal strings meet whatever texts they come from. Neighbouring
strings with the same smallest gram travel as one piece; a piece whose gram stands at no other place
repeats nothing and stays where it is. Equal pieces meet on a digest: they repeat as a whole, and one of
them stands for all. What is left are pieces that share a gram and differ: shards of them are sorted by
external induced sorting (``induced``), and neighbours in the order of suffixes whose common prefix
reaches ``length`` repeat.

A gram that very many different pieces hold, as at the border of a passage that many texts share,
would make a shard of its own that grows with the texts. Such pieces are cut into their strings,
which meet on their digests, spread over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.lookup import attach
from ..workspace import scratch_path, ship, written, written_and_measured
from .induced import Disk, repeated_places
from .texts import by_portion, portions, ragged, release

GRAM = 64  # bytes of a gram, a quarter of the length at most
SHARD_BYTES = 2 << 20  # pieces that are sorted together; a gram with more is cut into strings
TUPLES = 1 << 20  # suffix tuples that a task keeps in memory
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(count, _BASE), np.full(count, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_tables: list[np.ndarray] = []


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every string of ``gram`` bytes; equal strings have equal hashes."""
    if not _tables or len(_tables[0]) < len(data):
        _tables[:] = _powers(max(1 << 16, len(data)))
    up, down = _tables
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _sliding(values: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """Least (or largest) value of every ``width`` neighbours."""
    span, low = 1, values
    while 2 * span <= width:
        low = least(low[: len(low) - span], low[span:])
        span *= 2
    rest = width - span
    return least(low[: len(low) - rest], low[rest:]) if rest else low


def pieces(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First string, number of strings and smallest gram of every piece, and whether that gram stands
    at several places of the piece."""
    text = np.frombuffer(data, np.uint8)
    if len(text) < length:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(0, bool)
    h, width = gram_hashes(text, gram), length - gram + 1
    smallest = _sliding(h, width, np.minimum)
    first = np.flatnonzero(np.concatenate([[True], smallest[1:] != smallest[:-1]]))
    count = np.diff(np.concatenate([first, [len(smallest)]]))
    value = smallest[first]
    # Places whose gram is the smallest of some string: a piece has few of them.
    edge = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(_sliding(np.concatenate([edge, smallest, edge]), width, np.maximum) == h)
    a, b = np.searchsorted(chosen, first), np.searchsorted(chosen, first + count + width - 1)
    owner = np.repeat(np.arange(len(first)), b - a)
    hits = h[chosen[ragged(a, b - a)]] == value[owner]
    return first, count, value, np.bincount(owner, hits, len(first)) > 1


def _pieces_of(df: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    """``_text`` (digest of the text), ``first``, ``count``, ``gram``, ``many``, ``piece`` (digest)."""
    list_of = lambda kind, parts: pa.array(parts, pa.list_(kind))

    def cut(texts: list[str]) -> dict[str, pa.Array]:
        out: dict[str, list] = {"first": [], "count": [], "gram": [], "many": [], "piece": []}
        for t in texts:
            data = t.encode("utf-8", "surrogatepass")
            first, count, value, many = pieces(data, length, gram)
            out["first"].append(first.astype(np.int32))
            out["count"].append(count.astype(np.int32))
            out["gram"].append(value.view(np.int64))
            out["many"].append(many)
            ends = (first + count + length - 1).tolist()
            out["piece"].append([hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), ends, strict=True)])
        kinds = {"first": pa.int32(), "count": pa.int32(), "gram": pa.int64(), "many": pa.bool_(), "piece": pa.binary()}
        return {f"_{c}s": list_of(kinds[c], parts) for c, parts in out.items()}

    fields = "_firsts array<int>, _counts array<int>, _grams array<long>, _manys array<boolean>, _pieces array<binary>"
    names = ["first", "count", "gram", "many", "piece"]
    long = df.select(_digest(text).alias("_text"), F.col(f"`{text}`").alias("_t")).where(F.octet_length("_t") >= length)
    made = by_portion(long, "_t", cut, fields, ["_text"])
    zipped = F.arrays_zip(*[F.col(f"_{c}s").alias(c) for c in names])
    return made.select("_text", F.inline(zipped)).toDF("_text", *names)


def _digest(text: str) -> Column:
    """Texts are known by their SHA-256: what is removed depends on the text alone."""
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary"), 256))


def repeated_strings(df: DataFrame, text: str, length: int, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, tuples: int = TUPLES) -> DataFrame:
    """``_text``, ``first``, ``count``: runs of places where a repeated string of ``length`` bytes starts."""
    gram = max(1, min(gram, length // 4))
    found = written(_pieces_of(df, text, length, gram), "pieces")
    where = F.struct("_text", "first", "count")
    same, facts = written_and_measured(
        found.groupBy("gram", "piece").agg(F.count(F.lit(1)).alias("n"), F.min(where).alias("at"), F.max("many").alias("many")),
        "different-pieces",
        F.max("n").alias("copies"),
    )
    # Of each gram: does a piece need to be sorted, and do the pieces fit a shard.
    size = (F.col("at.count") + length).cast("long")
    grams, load = written_and_measured(
        same.groupBy("gram")
        .agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"), F.max("many").alias("many"), F.sum(size).alias("bytes"))
        .where((F.col("least") == 1) & ((F.col("kinds") > 1) | F.col("many"))),
        "open-grams",
        F.max("kinds").alias("widest"),
        F.sum(F.when(F.col("bytes") <= shard_bytes, F.col("bytes"))).alias("bytes"),
        F.count_if(F.col("bytes") > shard_bytes).alias("hot"),
    )
    copied = found.select("piece", "gram", "_text", "first", "count")
    twice = same.where("n > 1").select("gram", "piece")
    results = [attach(copied, twice, ["piece", "gram"], "inner", widest=facts["copies"] or 0).select("_text", "first", "count")]
    if load["widest"]:
        shards = max(1, -(-2 * (load["bytes"] or 0) // shard_bytes))
        open_pieces = attach(same.select("gram", "piece", "n", "at"), grams.select("gram", "bytes"), ["gram"], "inner", widest=load["widest"])
        shard = F.when(F.col("bytes") <= shard_bytes, F.pmod(F.xxhash64("gram"), F.lit(shards)).cast("int")).otherwise(-1)
        strings = _with_bytes(df, text, open_pieces.select("at.*", F.col("n"), shard.alias("shard")), length)
        strings = written(strings, "strings")
        results.append(_sorted_shards(strings.where("shard >= 0"), length, tuples))
        if load["hot"]:
            results.append(_cut_strings(strings.where("shard < 0"), length))
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionByName(more)
    return whole


def _with_bytes(df: DataFrame, text: str, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of pieces: ``_text``, ``first``, ``n``, ``shard``, ``bytes``. Equal texts count once; they
    meet on the map side first."""
    listed = wanted.groupBy("_text").agg(F.collect_list(F.struct("first", "count", "n", "shard")).alias("_wanted"))
    rows = df.select(_digest(text).alias("_text"), F.col(f"`{text}`").cast("string").alias("_t")).where(F.octet_length("_t") >= length)
    data = F.col("_t").cast("binary")
    cut = F.transform(
        "_wanted",
        lambda w: F.struct(
            w["first"].alias("first"), w["n"].alias("n"), w["shard"].alias("shard"), F.substring(data, w["first"] + 1, w["count"] + F.lit(length - 1)).alias("bytes")
        ),
    )
    once = rows.groupBy("_text").agg(F.first("_t").alias("_t"))
    return once.join(listed, "_text").select("_text", F.inline(cut))


RUNS = "_text binary, first int, count int"


def _runs(names: list[bytes], firsts: list[int], places: list[np.ndarray]) -> pa.Table:
    """Places of pieces as runs of neighbouring places in their texts."""
    text, first, count = [], [], []
    for name, start, at in zip(names, firsts, places, strict=True):
        if len(at):
            opens = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
            text += [name] * len(opens)
            first += (at[opens] + start).tolist()
            count += np.diff(np.concatenate([opens, [len(at)]])).tolist()
    return pa.table({"_text": pa.array(text, pa.binary()), "first": pa.array(first, pa.int32()), "count": pa.array(count, pa.int32())})


def _sorted_shards(strings: DataFrame, length: int, tuples: int) -> DataFrame:
    folder = scratch_path(strings.sparkSession, "suffixes")

    def sort(shard: pa.Table) -> pa.Table:
        disk = Disk(folder, tuples)
        try:
            at = repeated_places(shard["bytes"].to_pylist(), length, disk)
        finally:
            disk.close()
        # Pieces with copies repeat as a whole and are known already.
        alone = np.flatnonzero(shard["n"].to_numpy() == 1)
        names, firsts = shard["_text"].to_pylist(), shard["first"].to_pylist()
        found = _runs([names[i] for i in alone], [firsts[i] for i in alone], [at[i] for i in alone])
        release()
        return found

    return strings.select("shard", "_text", "first", "n", "bytes").groupBy("shard").applyInArrow(sort, RUNS)


def _cut_strings(strings: DataFrame, length: int) -> DataFrame:
    """Repeated strings of the pieces of hot grams, each string by itself."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in portions(batch.column("bytes").cast(pa.large_binary()), 1 << 15):
                part = batch.slice(first, rows)
                data = part.column("bytes").to_pylist()
                sizes = np.array([len(d) - length + 1 for d in data], np.int64)
                owner = np.repeat(np.arange(rows), sizes)
                digests = [hashlib.blake2b(d[i : i + length], digest_size=16).digest() for d, n in zip(data, sizes.tolist(), strict=True) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(digests, pa.binary()),
                        part.column("_text").take(pa.array(owner)),
                        pa.array((part.column("first").to_numpy()[owner] + ragged(np.zeros(rows, np.int64), sizes)).astype(np.int32)),
                        part.column("n").take(pa.array(owner)),
                    ],
                    names=["_string", "_text", "first", "n"],
                )

    each = written(strings.select("_text", "first", "n", "bytes").mapInArrow(cut, "_string binary, _text binary, first int, n long"), "cut")
    # Of a string that stands once, its place; of the others only that there are several.
    seen, facts = written_and_measured(
        each.groupBy("_string").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).where("n > 1").select("_string", "rows"), "repeated", F.max("rows").alias("widest")
    )
    met = attach(each.where("n = 1").select("_string", "_text", "first"), seen.select("_string"), ["_string"], "inner", widest=facts["widest"] or 0)
    return met.select("_text", "first", F.lit(1).alias("count"))


def without_repeats(
    df: DataFrame,
    text: str,
    length: int,
    keep: list[str],
    content: bool = True,
    gram: int = GRAM,
    shard_bytes: int = SHARD_BYTES,
    tuples: int = TUPLES,
) -> DataFrame:
    """The columns ``keep`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of each text,
    and with ``content`` the bytes that are left (``kept``) and the removed ``spans`` (start, end).

    Texts are their UTF-8 bytes; a null text is empty. Removed is every byte that lies in a string of
    ``length`` bytes which also starts at another place, of the same text or of any other; repeated rows
    repeat each other. Strings do not run over the end of a text, and are judged before anything is
    removed. Texts shorter than ``length`` stay as they are; an empty table gives an empty result. A
    made column takes the place of a kept one of the same name.
    """
    ship(df.sparkSession)
    if length < 4:
        raise ValueError("A repeated string has at least 4 bytes.")
    repeated = repeated_strings(df, text, length, gram, shard_bytes, tuples)
    spans = repeated.groupBy("_text").agg(F.collect_set(F.struct("first", "count")).alias("_runs"))
    names = [c for c in keep if c not in ("n_bytes", "n_removed", "n_spans", "kept_sha256", *(("kept", "spans") if content else ()))]
    given = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_given")
    rows = df.select(_digest(text).alias("_text"), given, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_t"))
    met = attach(rows, written(spans, "spans"), ["_text"])
    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    fields += ", kept binary, spans array<struct<start:long,end:long>>" if content else ""
    derived = T.StructType.fromDDL(fields)

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, firsts, counts in batches:
            parts = [_cut_out(texts.slice(a, n), firsts.slice(a, n), counts.slice(a, n), length, content) for a, n in portions(texts)]
            columns = [pa.concat_arrays([p[i] for p in parts]) for i in range(len(derived))] if parts else []
            yield pa.StructArray.from_arrays(columns, derived.names) if columns else pa.array([], to_arrow_type(derived))
            release()

    # arrow_udf reads the type hints at run time.
    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    derive = F.arrow_udf(run, derived).asNondeterministic()
    return met.select("_given", derive("_t", "_runs.first", "_runs.count").alias("_made")).select("_given.*", "_made.*")


def _cut_out(texts: pa.Array, firsts: pa.Array, counts: pa.Array, length: int, content: bool) -> list[pa.Array]:
    """What is left of each text without its repeated strings."""
    size, gone, number, digest, kept, spans = [], [], [], [], [], []
    for text, first, count in zip(texts.to_pylist(), firsts, counts, strict=True):
        data = (text or "").encode("utf-8", "surrogatepass")
        starts, ends = [], []
        if first.is_valid and len(first):
            a = first.values.to_numpy(zero_copy_only=False).astype(np.int64)
            b = a + count.values.to_numpy(zero_copy_only=False) + (length - 1)
            order = np.argsort(a, kind="stable")
            a, reach = a[order], np.maximum.accumulate(b[order])
            opens = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]]))
            starts = a[opens].tolist()
            ends = reach[np.concatenate([opens[1:], [len(a)]]) - 1].tolist()
        left = b"".join(data[i:j] for i, j in zip([0, *ends], [*starts, len(data)], strict=True))
        size.append(len(data))
        gone.append(len(data) - len(left))
        number.append(len(starts))
        digest.append(hashlib.sha256(left).hexdigest())
        if content:
            kept.append(left)
            spans.append([{"start": i, "end": j} for i, j in zip(starts, ends, strict=True)])
    columns = [pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(number, pa.int64()), pa.array(digest, pa.string())]
    if content:
        columns += [pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    return columns
