"""Threshold match, transitive groups, annotation and their summaries."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DEFAULT_DECIMALS, DEFAULT_MATCH_THRESHOLD
from ..workspace import written
from .components import components
from .copies import ID, KEY, PRINT, REP, members
from .lookup import attach
from .numbering import numbered
from .pairs import Near, matching_copies, near_pairs, row_pairs


@dataclass(frozen=True)
class Matches:
    """Cosine matches of a table, kept on distinct vectors until rows are asked for.

    ``groups`` holds one row per matched distinct vector: _rep, group_id. Copies are counted and
    crowds of near copies are linked, so everything but ``pairs`` grows with the rows and not
    with their pairs.
    """

    near: Near
    threshold: float
    decimals: int
    groups: DataFrame
    # Where keys repeat: one row per pair of keys, of its first pair of rows, and groups of keys.
    keyed: DataFrame | None = None

    def pairs(self) -> DataFrame:
        """Every matching pair with positions: _i, _i_key, _j, _j_key, similarity, group_id.

        A pair of keys appears once, as its first pair of rows.
        """
        if self.keyed is not None:
            return self.keyed
        by_first = self.groups.withColumnRenamed(REP, "_a")
        grouped = attach(self.near.pairs, by_first, ["_a"], how="inner")
        same = matching_copies(self.near).join(self.groups, REP)
        whole = row_pairs(self.near, grouped, same)
        return whole.withColumn("similarity", F.round("_good", self.decimals)).drop("_good")

    def relation(self, ordered: bool = True) -> DataFrame:
        """query_key, match_key, similarity, group_id; by group, then best first."""
        pairs = self.pairs()
        if ordered:
            pairs = pairs.orderBy("group_id", F.desc("similarity"), "_i", "_j")
        return pairs.select(
            F.col("_i_key").alias("query_key"),
            F.col("_j_key").alias("match_key"),
            "similarity",
            "group_id",
        )

    def _facts(self) -> DataFrame:
        """_rep, match_count, best_score of every matched distinct vector."""
        same = matching_copies(self.near).select(
            REP, (F.col("_copies") - 1).alias("_n"), F.col("_good").alias("_best")
        )
        return (
            self.near.per_vector()
            .unionByName(same)
            .groupBy(REP)
            .agg(
                F.sum("_n").alias("match_count"),
                F.round(F.max("_best"), self.decimals).alias("best_score"),
            )
        )

    def rows(self) -> DataFrame:
        """Matched rows: _id, _key, group_id, match_count, best_score; where keys repeat, matched keys."""
        if self.keyed is not None:
            ends = self.keyed.select(
                "similarity",
                "group_id",
                F.explode(
                    F.array(
                        F.struct(F.col("_i").alias(ID), F.col("_i_key").alias(KEY)),
                        F.struct(F.col("_j").alias(ID), F.col("_j_key").alias(KEY)),
                    )
                ).alias("_end"),
            ).select("_end.*", "similarity", "group_id")
            return ends.groupBy(KEY).agg(
                F.min(ID).alias(ID),
                F.min("group_id").alias("group_id"),
                F.count(F.lit(1)).alias("match_count"),
                F.max("similarity").alias("best_score"),
            )
        facts = self._facts().join(self.groups, REP)
        if not self.near.has_copies:
            named = self.near.distinct.select(REP, KEY)
            return facts.join(named, REP).withColumnRenamed(REP, ID)
        everyone = written(
            members(self.near.rows, self.near.distinct, self.near.most_copies), "members"
        )
        return attach(everyone, facts, [REP], how="inner", widest=self.near.most_copies).drop(REP, "_copies")

    def summary(self) -> DataFrame:
        """One row: total_pairs and dedup_groups, counted without building the pairs."""
        if self.keyed is not None:
            return self.keyed.agg(
                F.count(F.lit(1)).alias("total_pairs"), F.coalesce(F.max("group_id"), F.lit(0)).alias("dedup_groups")
            )
        counted = self._facts().join(self.near.distinct.select(REP, "_copies"), REP)
        # Every pair is counted at both of its rows.
        ends = F.coalesce(F.sum(F.col("match_count") * F.col("_copies")), F.lit(0))
        pairs = counted.agg(
            F.expr("0L").alias("dedup_groups"), F.floor(ends / 2).cast("long").alias("total_pairs")
        )
        groups = self.groups.agg(
            F.coalesce(F.max("group_id"), F.lit(0)).alias("dedup_groups"),
            F.expr("0L").alias("total_pairs"),
        )
        both = pairs.unionByName(groups)
        return both.agg(
            F.sum("total_pairs").alias("total_pairs"), F.sum("dedup_groups").alias("dedup_groups")
        )


def match(
    df: DataFrame,
    id: str,
    vec: str,
    key: str | None = None,
    threshold: float = DEFAULT_MATCH_THRESHOLD,
    decimals: int = DEFAULT_DECIMALS,
    list_pairs: bool = False,
    rows_per_block: int | None = None,
) -> Matches:
    """Rows whose unrounded cosine reaches ``threshold``, and the groups they form.

    Groups are transitive and numbered 1, 2, ... by the lowest id of any member. With
    ``list_pairs=False`` the pairs are never listed, unless they are asked for later: enough for
    groups, counts and best scores.

    Where several rows have one key, matches are between keys: a pair of keys counts once, by its
    first pair of rows, and groups are groups of keys, numbered by their first pair.
    """
    near = near_pairs(df, id, vec, key, "cosine", threshold, rows_per_block)
    if key is not None and key != id and _repeat(near.rows.select(KEY)):
        return _between_keys(near, threshold, decimals)
    if list_pairs:
        near.pairs  # noqa: B018  listed once, and the groups follow from the list
    rooted = components(near.edges())
    if near.has_copies:
        same = matching_copies(near).select(F.col(REP).alias("node"), F.col(REP).alias("root"))
        rooted = rooted.unionByName(same.join(rooted, "node", "left_anti"))
    rooted = written(rooted, "rooted")
    roots = numbered(rooted.where("node = root").select("root"), ["root"], "group_id")
    groups = attach(rooted, roots, ["root"], how="inner").select(
        F.col("node").alias(REP), F.col("group_id").cast("long").alias("group_id")
    )
    return Matches(near, threshold, decimals, written(groups, "groups"))


def _repeat(keys: DataFrame) -> bool:
    """Whether a key has several rows; counted on the map side, so a hot key is no burden."""
    return not keys.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def _between_keys(near: Near, threshold: float, decimals: int) -> Matches:
    """Matches of a table whose keys repeat. Keys are nodes, known by their lowest id.

    The first pair of two keys lies between the lowest rows of each of their vectors, or, within a
    key, between the two lowest: only these are paired, so copies are not listed with each other.
    The rank limit works on the map side, too: a hot key sends two rows a vector and partition.
    """
    by_id = Window.partitionBy(PRINT, KEY).orderBy(ID)
    lowest = near.rows.select(ID, KEY, PRINT).withColumn("_nth", F.row_number().over(by_id)).where("_nth <= 2")
    few = replace(near, rows=written(lowest.drop("_nth"), "lowest"))
    few.__dict__["pairs"] = near.pairs
    whole = row_pairs(few)
    low, high = F.least("_i_key", "_j_key"), F.greatest("_i_key", "_j_key")
    first = F.min(F.struct("_i", "_j", "_i_key", "_j_key", "_good"))
    pairs = written(whole.groupBy(low.alias("_l"), high.alias("_h")).agg(first.alias("_p")).select("_p.*"), "key-pairs")
    ends = pairs.select(F.explode(F.array(F.struct(F.col("_i_key").alias(KEY), F.col("_i").alias(ID)),
                                          F.struct(F.col("_j_key").alias(KEY), F.col("_j").alias(ID)))).alias("_e")).select("_e.*")
    nodes = written(ends.groupBy(KEY).agg(F.min(ID).alias("_node")), "keys")
    edges = attach(pairs.select("_i_key", "_j_key"), nodes.select(F.col(KEY).alias("_i_key"), F.col("_node").alias("_a")), ["_i_key"], "inner")
    edges = attach(edges, nodes.select(F.col(KEY).alias("_j_key"), F.col("_node").alias("_b")), ["_j_key"], "inner")
    found = components(edges.select("_a", "_b")).select(F.col("node").alias("_node"), "root")
    rooted = nodes.join(found, "_node", "left").select(KEY, F.coalesce("root", "_node").alias("root"))
    grouped = written(attach(pairs, rooted.withColumnRenamed(KEY, "_i_key"), ["_i_key"], "inner"), "key-groups")
    starts = grouped.groupBy("root").agg(F.min(F.struct("_i", "_j")).alias("_s")).select("root", "_s.*")
    order = numbered(starts, ["_i", "_j"], "group_id").select("root", F.col("group_id").cast("long").alias("group_id"))
    named = attach(grouped, order, ["root"], "inner").withColumn("similarity", F.round("_good", decimals))
    keyed = written(named.select("_i", "_i_key", "_j", "_j_key", "similarity", "group_id"), "key-matches")
    return Matches(near, threshold, decimals, grouped.select("root"), keyed)


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every key, rows without an order last; combines on the map side."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    place = F.struct(F.col(f"`{order}`").isNull(), F.col(f"`{order}`"))
    return df.groupBy(F.col(f"`{key}`").cast("string").alias("_k")).agg(F.min_by(whole, place).alias("_r")).select("_r.*")


def annotated(
    df: DataFrame, key: str, matches: Matches, lists: bool = True, as_text: bool = False
) -> DataFrame:
    """``df`` with the matches of each row's key.

    Adds _match_count, _match_ids, _best_match_id, _best_match_score and _group_id; a row
    without a match gets 0, [], null, null, 0. ``as_text`` joins the ids with a comma.
    With ``lists=False`` the two id columns are left out: the rest grows with the rows, while
    the id lists hold every pair twice.
    """
    facts = _with_lists(matches) if lists else _without_lists(matches)
    joined = attach(
        df.withColumn("_k", F.col(f"`{key}`").cast("string")), facts, ["_k"]
    )
    columns: list[Column] = [F.col(f"`{c}`") for c in df.columns]
    columns.append(F.coalesce("_match_count", F.lit(0)).cast("long").alias("_match_count"))
    if lists:
        ids = F.coalesce("_match_ids", F.array().cast("array<string>"))
        columns.append((F.array_join(ids, ", ") if as_text else ids).alias("_match_ids"))
        columns.append(F.col("_best_match_id"))
    columns.append(F.col("_best_match_score"))
    columns.append(F.coalesce("_group_id", F.lit(0)).cast("long").alias("_group_id"))
    return joined.select(*columns)


def _without_lists(matches: Matches) -> DataFrame:
    return matches.rows().select(
        F.col(KEY).alias("_k"),
        F.col("match_count").alias("_match_count"),
        F.col("best_score").alias("_best_match_score"),
        F.col("group_id").alias("_group_id"),
    )


def _with_lists(matches: Matches) -> DataFrame:
    pairs = matches.pairs()

    def side(own: str, other: str, role: int) -> Column:
        return F.struct(
            F.col(own).alias("_k"),
            F.lit(role).alias("role"),
            (-F.col("similarity")).alias("worse"),
            "_i",
            "_j",
            F.col(other).alias("other"),
            "group_id",
        )

    both = pairs.select(
        F.explode(F.array(side("_i_key", "_j_key", 0), side("_j_key", "_i_key", 1))).alias("e")
    ).select("e.*")
    listed = F.sort_array(F.collect_list(F.struct("role", "worse", "_i", "_j", "other")))
    best = F.min(F.struct("worse", "role", "_i", "_j", "other"))
    return (
        both.groupBy("_k")
        .agg(
            listed.alias("_all"),
            best.alias("_best"),
            F.min("group_id").alias("_group_id"),
        )
        .select(
            "_k",
            F.size("_all").alias("_match_count"),
            F.col("_all")["other"].alias("_match_ids"),
            # A score of exactly -1 names no best match.
            F.when(F.col("_best")["worse"] < 1.0, F.col("_best")["other"]).alias("_best_match_id"),
            (-F.col("_best")["worse"]).alias("_best_match_score"),
            "_group_id",
        )
    )


def annotation_summary(df: DataFrame) -> DataFrame:
    """Rows with a match and distinct groups of an annotated table."""
    return df.agg(
        F.count_if(F.col("_match_count") > 0).alias("matched_rows"),
        F.count_distinct(F.when(F.col("_group_id") != 0, F.col("_group_id"))).alias("dedup_groups"),
    )
