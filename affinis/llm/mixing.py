"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

The documents of a source are shuffled by a hash and lie one after another; the source's stream
runs through them once per epoch and is cut into blocks of equal numbers of words. A schedule of
N slots says which source gives its next block. Slot i owns the golden-ratio point i * a mod N,
with a next to N / phi and prime to N (``golden_step``); the source is the one in whose share of the cumulative
weights [0, N) the point falls. The points of a share are spread evenly over the slots, and there
are exactly as many of them as the source owes blocks. The k-th slot of a source takes block k.

Everything is DataFrame work. Ranks and running sums go over chunks of bounded size and then over
the sums of the chunks, so a source with a third of all rows is never sorted in one task.
"""

from __future__ import annotations

from fractions import Fraction
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import written, written_and_measured
from .texts import whole

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)  # of all words, that the mix takes
EPOCHS = 2  # times at most that a document is taken
BLOCK = 8192  # words
MOST_SLOTS = 1 << 31  # keeps slot * multiplier inside a long; beyond it blocks grow
CHUNK = 1 << 12  # rows that are ranked together


def source_targets(sizes: DataFrame, source: str, size: str, weights: tuple[int, ...], share: Fraction, epochs: int) -> DataFrame:
    """``sid``, ``weight`` and ``target`` for each row of ``sizes`` (one per source).

    Weights repeat over the sources in code-point order, null last. A target stops at ``epochs``
    times its source's size; the excess is reshared by weight. In the order of size per weight the
    sources that stop come first, so one pass of running sums finds them. The window covers the
    source table, which has one row per source.
    """
    n, d = share.numerator, share.denominator
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    place = F.row_number().over(by_name)
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(place - 1, F.lit(len(weights))) + 1)
    named = sizes.withColumn("sid", place).withColumn("weight", pick.cast("long"))
    # All amounts times the share's denominator, so that they are whole.
    whole = named.withColumn("_cap", F.col(size) * (epochs * d)).withColumn(
        "_all", F.sum(F.col(size) * n).over(Window.partitionBy())
    )
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    big = "decimal(38,0)"
    left = F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    stops = (left.cast(big) * F.col("weight").cast("decimal(10,0)")) > (
        F.col("_cap").cast(big) * F.sum("weight").over(after).cast("decimal(10,0)")
    )
    everywhere = Window.partitionBy()
    known = whole.withColumn("_stops", stops)
    rest = F.col("_all") - F.coalesce(F.sum(F.when(F.col("_stops"), F.col("_cap"))).over(everywhere), F.lit(0))
    open_weight = F.sum(F.when(~F.col("_stops"), F.col("weight"))).over(everywhere)
    target = F.when(F.col("_stops") | (F.col("_cap") == 0), F.col("_cap").cast("double") / float(d)).otherwise(
        (rest * F.col("weight")).cast("double") / (float(d) * open_weight.cast("double"))
    )
    return known.withColumn("target", target).drop("_cap", "_all", "_stops")


def _running(df: DataFrame, group: str, chunk: Column, order: list, amount: str, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over the earlier rows of its group, via sums of chunks."""
    cut = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy(group, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(group, "_chunk").agg(F.sum(amount).alias("_sum"))
    past = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(group, "_chunk", F.coalesce(F.sum("_sum").over(past), F.lit(0)).alias("_ahead"))
    placed = cut.withColumn(name, F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return placed.join(ahead, [group, "_chunk"]).withColumn(name, F.col(name) + F.col("_ahead")).drop("_chunk", "_ahead")


def golden_step(n: int) -> int:
    """A multiplier next to n / phi and prime to n whose multiples mod n lie as even as they can.

    How even is told by the largest quotient in the continued fraction of step / n; it is 1
    all along for the golden ratio itself.
    """

    def largest_quotient(a: int) -> int:
        b, most = n, 0
        while a:
            most, b, a = max(most, b // a), a, b % a
        return most

    near = round(n * 0.6180339887498949)
    prime = [a for a in range(max(1, near - 40), min(n, near + 41)) if gcd(a, n) == 1]
    return min(prime, key=lambda a: (largest_quotient(a), abs(a - near)), default=1)


class Mix:
    """A mix of the documents of several sources.

    ``rows`` has one row per document: ``id``, ``size`` in words, ``source_size``, ``target`` of its
    source, and ``_row``. ``slots()`` is the schedule: ``slot``, ``sid``, ``block``. ``pieces()`` joins it
    with the documents: for every slot the documents of its block, with the words taken of each.
    ``taken()`` is ``rows`` with the words that the mix takes, repeats counted.

    ``row`` may name unique row numbers that the caller has; else rows are numbered here.

    A null text has no words; a null source is a source of its own, the last one. Documents
    without words are in no block and take nothing. Repeated rows are documents of their own. Other
    columns are ignored, and an empty table gives an empty mix. A source's words differ from its
    target by rounding only, and no document is taken more often than ``epochs`` times.
    """

    def __init__(
        self,
        df: DataFrame,
        id: str,
        text: str,
        source: str,
        weights: tuple[int, ...] = WEIGHTS,
        share: Fraction = SHARE,
        epochs: int = EPOCHS,
        block: int = BLOCK,
        seed: int = 1,
        row: Column | None = None,
    ) -> None:
        self.id, self.spark = id, df.sparkSession
        shuffled = F.md5(F.concat_ws(":", F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(str(seed))))
        sized, facts = written_and_measured(
            df.select(
                F.col(f"`{id}`").alias("_id"),
                F.col(f"`{source}`").cast("string").alias("_source"),
                F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                *([] if row is None else [row.alias("_given_row")]),
            ).select("_id", "_source", "size", shuffled.alias("_order"), (F.monotonically_increasing_id() if row is None else F.col("_given_row")).alias("_row")),
            "words",
            F.count(F.lit(1)).alias("rows"),
            F.sum("size").alias("words"),
        )
        words = facts["words"] or 0
        self.block = max(block, -(-words * share.numerator // share.denominator // (MOST_SLOTS >> 1)))
        per_source = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
        targets = source_targets(per_source, "_source", "source_size", weights, share, epochs)
        takes = F.least(F.floor(F.col("target") + 0.5).cast("long"), F.col("source_size") * epochs)
        owed = targets.withColumn("_takes", takes).withColumn("_blocks", F.ceil(F.col("_takes") / self.block).cast("long"))
        past = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
        first = F.coalesce(F.sum("_blocks").over(past), F.lit(0))
        self.sources = written(owed.withColumn("_first", first), "sources")
        self.total = self.sources.agg(F.sum("_blocks")).first()[0] or 0
        known = self.sources.select(F.col("_source").alias("_named"), "sid", "source_size", "target", "_takes")
        joined = sized.join(known, F.col("_source").eqNullSafe(F.col("_named"))).drop("_named", "_source")
        chunks = max(1, -(-(facts["rows"] or 0) // CHUNK))
        spread = F.shiftright(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * chunks, 32)
        placed = _running(joined, "sid", spread, ["_order", "_id", "size", "_row"], "size", "_start")
        self.epochs = epochs
        self.rows = written(placed, "placed")

    def slots(self) -> DataFrame:
        n = self.total
        if not n:
            return self.spark.createDataFrame([], "slot long, sid int, block long")
        step = golden_step(n)
        back = pow(step, -1, n) if n > 1 else 0
        parts = self.sources.where("_blocks > 0").select(
            "sid", "_first", "_blocks", F.explode(F.sequence(F.lit(0), F.floor((F.col("_blocks") - 1) / CHUNK).cast("long"))).alias("_part")
        )
        shares = parts.repartition("sid", "_part").select(
            "sid",
            F.explode(
                F.sequence(
                    F.col("_first") + F.col("_part") * CHUNK,
                    F.col("_first") + F.least(F.col("_blocks"), (F.col("_part") + 1) * CHUNK) - 1,
                )
            ).alias("_point"),
        )
        dealt = shares.select("sid", F.pmod(F.col("_point") * F.lit(back), F.lit(n)).alias("slot"), F.lit(1).alias("_one"))
        return _running(dealt, "sid", F.floor(F.col("slot") / CHUNK).cast("long"), ["slot"], "_one", "block").drop("_one")

    def pieces(self) -> DataFrame:
        """``slot``, ``sid``, ``block``, ``id``, ``epoch``, ``from_word``, ``to_word``, ``_row``."""
        b = self.block
        runs = F.array(*[F.struct(F.lit(e).alias("epoch"), (F.col("source_size") * e + F.col("_start")).alias("lo")) for e in range(self.epochs)])
        passes = self.rows.where("size > 0").select("_row", "_id", "sid", "size", "_takes", F.explode(runs).alias("_run")).select(
            "*", "_run.*", F.least(F.col("_run.lo") + F.col("size"), F.col("_takes")).alias("hi")
        )
        blocks = F.sequence(F.floor(F.col("lo") / b).cast("long"), F.floor((F.col("hi") - 1) / b).cast("long"))
        cut = passes.where("hi > lo").select("_row", "_id", "sid", "epoch", "lo", "hi", F.explode(blocks).alias("block"))
        words = cut.select(
            "_row",
            F.col("_id").alias(self.id),
            "sid",
            "block",
            "epoch",
            (F.greatest(F.col("lo"), F.col("block") * b) - F.col("lo")).alias("from_word"),
            (F.least(F.col("hi"), (F.col("block") + 1) * b) - F.col("lo")).alias("to_word"),
        )
        return self.slots().join(words, ["sid", "block"])

    def taken(self) -> DataFrame:
        sums = self.pieces().groupBy("_row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("_sum"))
        return self.rows.join(sums, "_row", "left").select(
            F.col("_id").alias(self.id),
            "size",
            "source_size",
            "target",
            F.coalesce("_sum", F.lit(0)).cast("long").alias("taken"),
        )


def mixed_documents(df: DataFrame, id: str, text: str, source: str, **options: object) -> DataFrame:
    """The documents of the mix: a row of ``df`` comes once for every epoch that takes words of it.

    Rows that the mix takes nothing of are left out; the last document of a source, which its target
    may cut, comes whole. All columns are returned as they are.
    """
    held = written(whole(df).select("_whole", F.monotonically_increasing_id().alias("_row")), "mixed")
    named = held.select("_row", *[F.col(f"_whole.`{c}`").alias(n) for c, n in ((id, "_key"), (text, "_content"), (source, "_from"))])
    mix = Mix(named, "_key", "_content", "_from", row=F.col("_row"), **options)
    turns = mix.pieces().select("_row", "epoch").distinct()
    return held.join(turns.hint("merge"), "_row").select("_whole.*")
