"""Spelling variants: words one edit apart, found by a frontier that walks a trie level by level.

The trie is a table of edges (node, label, child). A path with one way on is a single edge, so its
depth is the number of branchings on a path and not the length of the longest word. States (word,
position, node, edits) are joined with the edges of their node, one level of branchings at a time:
an exact step follows the word, or one letter is replaced or deleted. A state that ends where a word
of the trie ends, with one edit, has found a neighbour; an inserted letter is one that the other word
has deleted, so neighbours are turned round at the end.

Near its root a trie has nearly every branch, and one edit there would keep a state for each of them.
So the words are in the trie forwards and backwards: the forward walk edits the second half of a word
only, the backward walk the first half. The first half of the way is then exact, and a state begins
at the last branching before it may be edited, where few branches are left. Edges carry bit masks of
the hashed rests of the words below them, so that a state whose edit is spent seldom goes astray.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import attach
from ..workspace import ship, written, written_and_measured
from .texts import by_portion

NOISE = 31  # one run in so many loses a letter
LEVELS = 100_000  # a guard against a faulty trie, far above the branchings on any path
HOPS = 64  # a form has at least ten times the occurrences, so no chain of forms is longer
MASKS = 4  # of 64 bits each: which rests of words go on below an edge
# In UTF-8: A-Z lower-cased, and U+00C0 to U+00FF as the two bytes they are.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def run_counts(texts: list[tuple[bytes, bytes]], length: int) -> Counter[bytes]:
    """Occurrences of the words of (id, text) pairs in UTF-8: lower-cased letter runs, of which those whose
    checksum with the id says so lose a letter. Words under ``length`` letters are left out."""
    words: Counter[bytes] = Counter()
    for id, text in texts:
        start = zlib.crc32(id + b":")
        for run, count in Counter(_RUN.findall(text.translate(_LOWER))).items():
            if len(run) < length:  # bytes, so its letters are no more
                continue
            mark = zlib.crc32(run, start)
            if mark % NOISE == 0:
                letters = run.decode()
                at = mark % len(letters)
                run = (letters[:at] + letters[at + 1 :]).encode()
            if len(run) - run.count(b"\xc3") >= length:
                words[run] += count
    return words


def frequent_words(df: DataFrame, id: str, text: str, length: int = 7, least: int = 2) -> DataFrame:
    """``word``, ``n`` of the words with enough letters and occurrences."""
    name = F.coalesce(F.col(f"`{id}`").cast("string"), F.lit(""))
    # The id goes before its text, and its length before both.
    sent = df.select(F.concat(F.octet_length(name).cast("string"), F.lit(":"), name, F.col(f"`{text}`").cast("string")).alias("_t"))

    def counted(texts: list[str]) -> dict[str, pa.Array]:
        parts = []
        for t in texts:
            size, _, rest = t.encode("utf-8", "surrogatepass").partition(b":")
            parts.append((rest[: int(size or b"0")], rest[int(size or b"0") :]))
        words = run_counts(parts, length)
        # The counts of a portion stand at its first row.
        none: list = [[]] * (len(texts) - 1)
        return {
            "_words": pa.array([list(words), *none], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
            "_counts": pa.array([list(words.values()), *none], pa.list_(pa.int64())),
        }

    made = by_portion(sent, "_t", counted, "_words array<string>, _counts array<long>", [])
    each = made.select(F.inline(F.arrays_zip("_words", "_counts"))).toDF("word", "n")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _marks(rest: Column) -> list[Column]:
    """One bit of each mask, by six bits of a hash of what is left of a word."""
    h = F.xxhash64(rest)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(MASKS)]


def _node(depth: Column) -> Column:
    """A node is known by a hash of its prefix. Should two share one, states are added and none is
    lost; the check of the words that were found removes what they add."""
    return F.xxhash64("side", F.substring("s", F.lit(1), depth))


def _free(first: int) -> Column:
    """From where on a spelling may be edited: the second half forwards, the rest backwards."""
    half = F.floor(F.length("s") / 2)
    return F.greatest(F.lit(first), F.when(F.col("side") == 0, half).otherwise(F.length("s") - half)).cast("int")


def trie(words: DataFrame, first: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the trie of all words forwards and backwards: the edges of each node, the nodes where words
    end, and the starting states. The first ``first`` letters are exact in both, so nodes begin there.

    ``words`` holds _wid and word.
    """
    sides = [F.struct(F.lit(0).alias("side"), F.col("word").alias("s")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("s"))]
    both = words.select("_wid", F.inline(F.array(*sides)))
    prefixes = both.select("_wid", "side", "s", F.explode(F.sequence(F.lit(first), F.length("s"))).alias("depth"))
    prefixes = prefixes.select("_wid", "side", "depth", _node(F.col("depth")).alias("node"), F.substring("s", F.col("depth") + 1, F.lit(1)).alias("next"))
    seen = prefixes.groupBy("node").agg(F.min("next").alias("low"), F.max("next").alias("high"), F.count(F.lit(1)).alias("words"))
    branching, facts = written_and_measured(
        seen.where("low <> high").select("node", "words"), "branchings", F.max("words").alias("widest")
    )
    # A prefix that many words share is a hot node.
    on_path = attach(prefixes.select("node", "_wid", "side", "depth"), branching.select("node"), ["node"], "inner", widest=facts["widest"] or 0)
    depths = on_path.groupBy("_wid", "side").agg(F.collect_list("depth").alias("depths"))
    ends = F.array(F.lit(first), F.length("s"))
    paths = both.join(depths, ["_wid", "side"], "left").withColumn(
        "depths", F.array_sort(F.array_union(F.coalesce("depths", F.array().cast("array<int>")), ends))
    )
    paths = written(paths, "paths")
    steps = paths.where(F.size("depths") > 1).select(
        "side", "s", F.inline(F.arrays_zip(F.slice("depths", F.lit(1), F.size("depths") - 1).alias("a"), F.slice("depths", 2, F.size("depths")).alias("b")))
    ).toDF("side", "s", "a", "b")
    edges = steps.select(
        _node(F.col("a")).alias("node"),
        F.substring("s", F.col("a") + 1, F.col("b") - F.col("a")).alias("label"),
        _node(F.col("b")).alias("child"),
        (F.col("b") == F.length("s")).alias("ends"),
        *[m.alias(f"m{i}") for i, m in enumerate(_marks(F.substring("s", F.col("b") + 1, F.length("s"))))],
    )
    masks = [f"m{i}" for i in range(MASKS)]
    edges = edges.groupBy("node", "label", "child").agg(F.max("ends").alias("ends"), *[F.bit_or(m).alias(m) for m in masks])
    # One row a node: its edges begin with different letters, so an alphabet bounds their number.
    children = written(edges.groupBy("node").agg(F.collect_list(F.struct("label", "child", "ends", *masks)).alias("_edges")), "edges")
    last = paths.select(_node(F.length("s")).alias("node"), F.col("_wid").alias("_near"))
    start = paths.withColumn("free", _free(first)).withColumn("at", F.array_max(F.filter("depths", lambda d: d <= F.col("free"))))
    states = start.select(
        "_wid",
        F.substring("s", F.col("at") + 1, F.length("s")).alias("rest"),
        (F.col("free") - F.col("at")).alias("wait"),
        _node(F.col("at")).alias("node"),
        F.lit(0).alias("edits"),
    )
    return children, last, states


def _stepped(met: DataFrame) -> DataFrame:
    """The states that follow from states and one edge of their node."""
    size, left = F.length("label"), F.length("rest")
    ahead = lambda skip, count: F.substring("rest", F.lit(skip + 1), count)
    own = ahead(0, size) == F.col("label")
    to = lambda holds, used, edits: F.when(holds, F.struct(F.substring("rest", used + 1, left).alias("rest"), edits.alias("edits")))
    exact, one, begins = F.col("edits") == 0, F.lit(1), F.substring("label", 1, 1)
    # The word itself is in the trie, so another edge than its own differs in the first letter. Of two
    # near words one finds the other: the longer, or the one with the smaller letter.
    edit = exact & (F.col("wait") <= 0) & (left > 0)
    larger, skipped = edit & (begins > ahead(0, F.lit(1))), edit & (begins == ahead(1, F.lit(1)))
    replaced = larger & (ahead(1, size - 1) == F.substring("label", F.lit(2), size))
    deleted = skipped & (ahead(1, size) == F.col("label"))
    last_deleted = exact & F.col("ends") & (left == size + 1)
    options = F.array(
        to(own | replaced, size, F.when(own, F.col("edits")).otherwise(one)),
        to(F.when(own, last_deleted).otherwise(deleted), size + 1, one),
    )
    masks = [f"m{i}" for i in range(MASKS)]
    moved = met.where(own | replaced | deleted).select(
        "_wid", F.greatest(F.lit(0), F.col("wait") - size).alias("wait"), F.col("child").alias("node"), "ends", *masks, F.inline(options)
    ).where("edits IS NOT NULL")
    done = (F.col("edits") == 1) & (F.col("rest") == "")
    # After its edit a state only goes where its rest may go on.
    goes_on = reduce(Column.__and__, [F.col(m).bitwiseAND(bit) != 0 for m, bit in zip(masks, _marks(F.col("rest")), strict=True)])
    kept = (F.col("edits") == 0) | F.when(done, F.col("ends")).otherwise(goes_on)
    return moved.where(kept).select("_wid", "rest", "wait", "node", "edits", done.alias("_done"))


def near_words(words: DataFrame, first: int = 3) -> DataFrame:
    """``_wid``, ``_near``: both ways of every two words that differ by one inserted, deleted or
    replaced letter. ``words`` holds _wid and word, each once, of at least 2 * ``first`` letters."""
    children, last, states = trie(words, first)
    states, facts = written_and_measured(states, "states", F.count(F.lit(1)).alias("open"))
    found = []
    for _ in range(LEVELS):
        if not facts["open"]:
            break
        # No node has more states than there are; where there are many, they are counted by node.
        bound = facts["open"] if facts["open"] <= 200_000 else None
        met = attach(states, children, ["node"], "inner", widest=bound)
        moved = _stepped(met.select("_wid", "rest", "wait", "edits", F.inline("_edges")))
        held, facts = written_and_measured(moved, "states", F.count_if(~F.col("_done")).alias("open"), F.count_if("_done").alias("done"))
        if facts["done"]:
            found.append(held.where("_done").select("_wid", "node"))
        states = held.where("NOT _done").drop("_done")
    else:
        raise RuntimeError(f"The frontier did not end in {LEVELS} levels.")
    if not found:
        return words.select("_wid", F.col("_wid").alias("_near")).limit(0)
    # The letters of a word and their places bound how many words can be near it, so no word is hot.
    one_way = reduce(DataFrame.unionByName, found).join(last, "node").select("_wid", "_near")
    both = F.array(F.struct("_wid", "_near"), F.struct(F.col("_near").alias("_wid"), F.col("_wid").alias("_near")))
    pairs = one_way.select(F.inline(both)).distinct()
    pairs = pairs.join(words.select("_wid", F.col("word").alias("_a")), "_wid")
    pairs = pairs.join(words.select(F.col("_wid").alias("_near"), F.col("word").alias("_b")), "_near")
    return written(pairs.where(F.levenshtein("_a", "_b", 1) == 1).select("_wid", "_near"), "near")


def spelling_forms(df: DataFrame, id: str, text: str, length: int = 7, least: int = 2, factor: int = 10) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word of the texts.

    Words are maximal runs of letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. A run whose
    checksum with the id is divisible by 31 loses a letter. Words with at least ``length`` letters
    and ``least`` occurrences count. Two are near if one edit apart. The form of a word is its near
    word of most occurrences (ties: smallest in code-point order), if that has at least ``factor`` times its
    occurrences, else null; ``root`` follows the forms to the last one.

    A null text has no words; a null id counts as the empty text. Repeated rows count each time.
    Texts without words, or an empty table, give an empty result. Other columns are ignored.
    """
    ship(df.sparkSession)
    counted = frequent_words(df, id, text, length, least)
    words = written(counted.withColumn("_wid", F.monotonically_increasing_id()), "words")
    pairs = near_words(words.select("_wid", "word"), length // 2)
    named = pairs.join(words.select(F.col("_wid").alias("_near"), F.col("word").alias("w"), F.col("n").alias("m")), "_near")
    best = named.groupBy("_wid").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "w", "_near")).alias("b"))
    rows = words.join(best, "_wid", "left")
    formed = F.coalesce(-F.col("b.m") >= factor * F.col("n"), F.lit(False))
    rows = written(
        rows.select(
            "_wid", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(formed, F.col("b.w")).alias("form"), F.when(formed, -F.col("b.m")).alias("form_n"),
            F.when(formed, F.col("b._near")).otherwise(F.col("_wid")).alias("_to"),
        ),
        "forms",
    )
    # Every round doubles the forms that a word has followed.
    links, moves = rows.where("_to <> _wid").select("_wid", "_to"), 1
    for _ in range(HOPS):
        onward = links.select(F.col("_wid").alias("_to"), F.col("_to").alias("_further"))
        followed = attach(links.select("_to", "_wid"), onward, ["_to"])
        links, facts = written_and_measured(
            followed.select("_wid", F.coalesce("_further", "_to").alias("_to"), F.col("_further").isNotNull().alias("_moved")), "roots",
            F.count_if("_moved").alias("moved"),
        )
        links = links.drop("_moved")
        if not facts["moved"]:
            break
    roots = attach(links.select("_to", "_wid"), words.select(F.col("_wid").alias("_to"), F.col("word").alias("_root")), ["_to"], "inner")
    whole = rows.join(roots.select("_wid", "_root"), "_wid", "left")
    return whole.select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")
