"""Match two lists: all pairs within a bound, and a one-to-one assignment between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import ship, written, written_and_measured
from .copies import ID, PRINT, REP
from .lookup import attach
from .pairs import across
from .sparse import LISTED, _positive, component_order, meetings, postings, scored, sides_of, worth

ROUNDS = 100_000  # every round settles the best pair that is left, so they end; a guard only


def cross_pairs(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_vec: str, right_vec: str, bound: float, listed: int = LISTED
) -> DataFrame:
    """``left_id``, ``right_id``, ``score``: every row of one list with every row of the other whose
    cosine is at least ``bound`` above 0; the score is not rounded.

    Rows without a vector take no part, zero vectors are near nothing. Equal vectors are scored once.
    """
    _positive(bound)
    ship(left.sparkSession)
    (l_rows, l), (r_rows, r) = sides_of(left, left_id, left_vec), sides_of(right, right_id, right_vec)
    order, counts = component_order(l, r), [side.count() for side in (l, r)]
    lists = [written(postings(side, order, bound), "postings") for side in (l, r)]
    met = meetings(*lists, bound, listed, worth(*counts, len(order)))
    near = across(l, r, bound) if met is None else scored(written(met, "meetings"), l, r, bound)
    near = written(near, "cross")
    near = near.join(l.select(F.col(REP).alias("_a"), F.col(PRINT).alias("_p")), "_a").join(r.select(F.col(REP).alias("_b"), F.col(PRINT).alias("_q")), "_b")
    # Copies come back by their digest; the relation has the size of the answer.
    firsts = attach(l_rows.select(F.col(PRINT).alias("_p"), F.col(ID).alias("left_id")), near.groupBy("_p").agg(F.collect_list(F.struct("_q", "_good")).alias("_near")), ["_p"], "inner")
    firsts = firsts.select("left_id", F.inline("_near"))
    seconds = r_rows.select(F.col(PRINT).alias("_q"), F.col(ID).alias("right_id"))
    return firsts.join(seconds, "_q").select("left_id", "right_id", F.col("_good").alias("score"))


def _reachable(pairs: DataFrame) -> DataFrame:
    """The pairs that can be taken: of an id in a list of n, the n best.

    The others of its list take at most n - 1 of the ids that it would rather have.
    """
    facts = pairs.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(c).alias(c) for c in ("left_id", "right_id")]).first()
    short = min(("left_id", "right_id"), key=lambda c: facts[c])
    if facts[short] ** 2 >= facts["n"]:
        return pairs
    once = pairs.groupBy("left_id", "right_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy(short).orderBy(-F.col("score"), "left_id", "right_id")
    kept = once.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= max(1, facts[short]))
    return written(kept.select("left_id", "right_id", "score"), "proposals")


def one_to_one(pairs: DataFrame) -> DataFrame:
    """``left_id``, ``right_id``, ``score``, ``round``: the pairs that are taken when the best pair is taken
    first (ties: smaller left id, then smaller right id) and each id once.

    Rounds of proposals: every id proposes its best pair left, and a pair that both ends propose is
    taken, since no better pair touches either. The pairs of taken ids go, and the rest propose
    again. The result is that of the plain greedy order, whatever the number of rounds. An id on a third
    of the pairs costs one row a task: bests are map-side combined, and its pairs are dealt into shares
    where they are compared with the taken ids. Where one list is short, few pairs of its ids can be taken
    at all, and the rest is left out at the start.
    """
    best = F.struct((-F.col("score")).alias("_s"), "left_id", "right_id")
    left = _reachable(written(pairs.select("left_id", "right_id", "score"), "proposals"))
    degrees = [left.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0 for c in ("left_id", "right_id")]
    taken = []
    for number in range(1, ROUNDS + 1):
        firsts = left.groupBy("left_id").agg(F.min(best).alias("_b")).select("_b.*")
        seconds = left.groupBy("right_id").agg(F.min(best).alias("_b")).select("_b.*")
        both = firsts.join(seconds, ["_s", "left_id", "right_id"])
        chosen, facts = written_and_measured(
            both.select("left_id", "right_id", (-F.col("_s")).alias("score"), F.lit(number).alias("round")), "taken", F.count(F.lit(1)).alias("n")
        )
        if not facts["n"]:
            break
        taken.append(chosen)
        rest = left
        for side, widest in zip(("left_id", "right_id"), degrees, strict=True):
            gone = chosen.select(side, F.lit(True).alias("_gone"))
            rest = attach(rest.select(side, *[c for c in left.columns if c != side]), gone, [side], widest=widest).where("_gone IS NULL").drop("_gone")
        left, facts = written_and_measured(rest.select("left_id", "right_id", "score"), "proposals", F.count(F.lit(1)).alias("n"))
        if not facts["n"]:
            break
    if not taken:
        return left.select("*", F.lit(1).alias("round")).limit(0)
    whole = taken[0]
    for more in taken[1:]:
        whole = whole.unionByName(more)
    return whole
