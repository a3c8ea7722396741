"""SimHash near-duplicate groups by pigeonring filtering.

A fingerprint has 64 bits, cut into ``segments`` that lie on a ring. If two fingerprints differ in
at most t bits, then from some segment on every chain of l consecutive segments differs in at
most l * t / segments bits (the pigeonring principle: chain budgets that hold in proportion). The
leading segments of such a chain have a budget below one and must be equal, so they are a join
key; the longer chains of the ring prune the pairs of a key before the full Hamming check.

A key that many different fingerprints share is not paired out. Its members are linked through
the words that lie one bit away from them: two fingerprints at distance two have such a word in
common, at most 65 fingerprints share one, and nothing but distances of at most two meets there.
That is exact, and linear in the number of members.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..workspace import written
from .texts import by_portion, whole

BITS = 64
SEGMENTS = 5
CROWD = 64  # different fingerprints of one key that are still paired out
SEED = 42


def fingerprints_of(texts: list[str], words: int = 3) -> np.ndarray:
    """The 64-bit fingerprint of every text, unsigned.

    Words are runs outside ASCII white space with A-Z in lower case; every shingle counts as often
    as it occurs. A bit is set if more than half of the shingle hashes have it.
    """
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        parts = text.encode("utf-8", "surrogatepass").lower().split()
        if not parts:
            continue
        joined = b" ".join(parts)
        if len(parts) <= words:
            hashes.append(digest(joined, SEED))
            counts[i] = 1
            continue
        ends = list(accumulate(map(len, parts), lambda a, b: a + b + 1))
        starts = [0, *[e + 1 for e in ends[: -words]]]
        hashes.extend([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=True)])
        counts[i] = len(starts)
    out = np.zeros(len(texts), np.uint64)
    filled = np.flatnonzero(counts)
    if len(filled):
        raw = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(raw, axis=1)
        starts = (np.cumsum(counts) - counts)[filled]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        majority = np.packbits(2 * ones > counts[filled, None], axis=1)
        out[filled] = np.ascontiguousarray(majority).view(">u8").ravel()
    return out


def with_fingerprints(df: DataFrame, text: str, words: int, keep: list[str]) -> DataFrame:
    """``keep`` and ``_fp``, the fingerprint as a signed 64-bit number; null texts have zero."""

    def made(texts: list[str]) -> dict[str, pa.Array]:
        return {"_fp": pa.array(fingerprints_of(texts, words).view(np.int64), pa.int64())}

    return by_portion(df, text, made, "_fp long", keep)


def ring(segments: int, max_bits: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For every segment: the mask that must be equal, and (mask, budget) of the longer chains."""
    edges = [BITS * k // segments for k in range(segments + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    out = []
    for first in range(segments):
        chain, equal, budgets = 0, 0, []
        for step in range(segments):
            chain |= masks[(first + step) % segments]
            budget = (step + 1) * max_bits // segments
            if budget == 0:
                equal = chain
            elif step + 1 < segments:
                budgets.append((chain, budget))
        out.append((equal, budgets))
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def near_fingerprints(
    distinct: DataFrame, max_bits: int, segments: int = SEGMENTS, crowd: int = CROWD
) -> DataFrame:
    """Edges ``_a``, ``_b`` that connect all fingerprints ``_fp`` within ``max_bits`` bits.

    ``distinct`` holds each fingerprint once. Pairs of keys with at most ``crowd`` members are
    listed; beyond that the members are linked in stars, which reach the same components.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("Fingerprints are linked at 0, 1 or 2 differing bits.")
    spark = distinct.sparkSession
    if max_bits == 0:
        return spark.createDataFrame([], "_a long, _b long")
    chains = ring(segments, max_bits)
    fp = F.col("_fp")
    keys = [
        F.struct(F.lit(k).cast("byte").alias("turn"), fp.bitwiseAND(F.lit(_signed(equal))).alias("same"))
        for k, (equal, _) in enumerate(chains)
    ]
    keyed = written(distinct.select("_fp", F.explode(F.array(*keys)).alias("_key")).select("_fp", "_key.*"), "ring")
    counts = keyed.groupBy("turn", "same").agg(F.count(F.lit(1)).alias("_n"))
    crowded = written(counts.where(F.col("_n") > crowd).drop("_n"), "crowds")
    sparse = counts.where((F.col("_n") > 1) & (F.col("_n") <= crowd)).drop("_n")
    members = keyed.join(sparse, ["turn", "same"])
    a, b = members.withColumnRenamed("_fp", "_a"), members.withColumnRenamed("_fp", "_b")
    apart = F.col("_a").bitwiseXOR(F.col("_b"))

    def within(mask: int, budget: int) -> Column:
        return F.bit_count(apart.bitwiseAND(F.lit(_signed(mask)))) <= budget

    chained = F.lit(False)
    for k, (_, budgets) in enumerate(chains):
        held = F.col("turn") == k
        for mask, budget in budgets:
            held &= within(mask, budget)
        chained |= held
    pairs = a.join(b, ["turn", "same"]).where((F.col("_a") < F.col("_b")) & chained & (F.bit_count(apart) <= max_bits))
    dense = keyed.join(crowded, ["turn", "same"], "left_semi").select("_fp").distinct()
    return pairs.select("_a", "_b").unionByName(_stars(dense, max_bits))


def _stars(dense: DataFrame, max_bits: int) -> DataFrame:
    """Edges between all fingerprints within ``max_bits`` bits, through words they share."""
    bits = F.sequence(F.lit(0), F.lit(BITS - 1))
    if max_bits == 2:  # words one bit away, and the fingerprint itself
        near = F.transform(bits, lambda k: F.col("_fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))
        words = F.concat(near, F.array("_fp"))
        shared = dense.select("_fp", F.explode(words).alias("_word")).groupBy("_word")
    else:  # the fingerprint without one of its bits
        near = F.transform(
            bits,
            lambda k: F.struct(
                k.alias("bit"),
                F.col("_fp").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), k))).alias("rest"),
            ),
        )
        shared = dense.select("_fp", F.explode(near).alias("_word")).groupBy("_word")
    met = shared.agg(F.collect_set("_fp").alias("_met")).where(F.size("_met") > 1)
    star = met.select(F.array_min("_met").alias("_a"), F.explode("_met").alias("_b"))
    return star.where("_a <> _b").distinct()


def _grouped(rows: DataFrame, max_bits: int, segments: int, crowd: int) -> DataFrame:
    """``_fp``, ``_root`` for every fingerprint of ``rows`` that is linked to another."""
    distinct = written(rows.select("_fp").distinct(), "fingerprints")
    edges = near_fingerprints(distinct, max_bits, segments, crowd)
    return components(edges).select(F.col("node").alias("_fp"), F.col("root").alias("_root"))


def simhash_groups(
    df: DataFrame, id: str, text: str, words: int = 3, max_bits: int = 2, segments: int = SEGMENTS, crowd: int = CROWD
) -> DataFrame:
    """``id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` of every row.

    Fingerprints link at ``max_bits`` or fewer differing bits; ``component_id`` is the smallest
    ``id`` that links reach, the row's own among them. Texts without a word, null ones too, have
    fingerprint zero and are linked like any other. A row without an id gets its group's smallest
    id, null if nobody has one. Repeated rows each keep their row; other columns are ignored; an
    empty table gives an empty result.

    Equal fingerprints are combined before the shuffle, so copies cost one row per task; the
    result reaches the rows by a join on the fingerprint, whose hot keys Spark splits (AQE).
    """
    named = df.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").alias("_content"))
    rows = written(with_fingerprints(named, "_content", words, ["_id"]), "simhash")
    roots = _grouped(rows, max_bits, segments, crowd)
    firsts = rows.groupBy("_fp").agg(F.min("_id").alias("_first"))
    linked = firsts.join(roots, "_fp", "left").withColumn("_root", F.coalesce("_root", "_fp"))
    lowest = linked.groupBy("_root").agg(F.min("_first").alias("component_id"))
    known = linked.select("_fp", "_root").join(lowest, "_root").select("_fp", "component_id")
    found = rows.join(known, "_fp")
    return found.select(F.col("_id").alias(id), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def simhash_kept(
    df: DataFrame, id: str, text: str, words: int = 3, max_bits: int = 2, segments: int = SEGMENTS, crowd: int = CROWD
) -> DataFrame:
    """The rows of ``df`` that stay when one row of each near-duplicate group is kept.

    The row with the smallest id stays; rows without an id come last, and of equal ids any one row
    stays. All columns are returned as they are.
    """
    # Numbered rows are written first: the text is read once more, and the rows are known by number.
    held = written(whole(df).select("_whole", F.monotonically_increasing_id().alias("_row")), "numbered")
    named = held.select("_row", F.col(f"_whole.`{id}`").alias("_id"), F.col(f"_whole.`{text}`").alias("_content"))
    rows = written(with_fingerprints(named, "_content", words, ["_row", "_id"]), "simhash")
    narrow = rows.select("_row", "_fp", "_id")
    roots = _grouped(narrow, max_bits, segments, crowd)
    best = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    firsts = narrow.groupBy("_fp").agg(best.alias("_best"))
    linked = firsts.join(roots, "_fp", "left").withColumn("_root", F.coalesce("_root", "_fp"))
    stay = linked.groupBy("_root").agg(F.min("_best").alias("_best")).select(F.col("_best.row").alias("_row"))
    # A merge join at every size: what a broadcast saves on small inputs would hide what large ones need.
    return held.join(stay.hint("merge"), "_row", "left_semi").select("_whole.*")
