"""Ranked lexical search: exact inner products found in sparse ball trees.

A document is a sparse vector over the terms that queries ask for: other terms add nothing to any
score. Documents are dealt into blocks of bounded size; a block is a ball tree, whose nodes hold the
centroid of their documents, the largest distance of one from it, and the terms that occur in them.
For a query q, restricted to the terms of a node, no document x of the node can score more than
q . centroid + |q| radius. Bounds are rounded up, so that floating point never hides a result.
Nodes are opened best bound first, until the best bound left is below the k-th best score; leaves
are scored in whole numbers. A query starts with its k-th best score over a bounded sample of rows,
so most blocks only have to be compared with that.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import ship, written, written_and_measured
from .texts import by_portion, ragged

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK = 2048  # documents of a tree
LEAF = 16  # documents of a leaf
ASKED = 512  # queries that search a block together
SEEDS = 2048  # documents, chosen by hash, that give every query its first bound
VOCABULARY = 50_000  # distinct query terms that one pass over the documents takes
CELLS = 1 << 24  # numbers that the centroids of a tree take at most; beyond it leaves grow
SCALE = 1_000_000_000
SLACK = 1e-9  # relative widening of a bound, far above the rounding of its sums

# Every byte outside a term is ASCII, so terms can be cut on the bytes of UTF-8.
_CUT = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256)
)


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in UTF-8, repeats included; only A-Z are lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_CUT).split()


def term_column(text: str) -> Column:
    """The terms of a text column, repeats included; only A-Z are lower-cased."""
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    found = F.regexp_extract_all(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(TERM), F.lit(0))
    return F.transform(found, lambda t: F.translate(t, upper, lower))


@dataclass
class Sparse:
    """Rows of term numbers and values: row i holds places starts[i] to starts[i + 1]."""

    starts: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def scores(self, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Inner products of some rows with a dense array of whole weights."""
        lengths = self.starts[rows + 1] - self.starts[rows]
        at = ragged(self.starts[rows], lengths)
        ends = np.cumsum(lengths)
        total = np.concatenate([[0], np.cumsum(weight[self.terms[at]] * self.values[at])])
        return total[ends] - total[ends - lengths]


def sparse_rows(terms: pa.ChunkedArray, values: pa.ChunkedArray) -> tuple[Sparse, np.ndarray]:
    """Rows of an Arrow block with terms numbered from 0 on, and the global term of each number."""
    lists = terms.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    known, local = np.unique(flat, return_inverse=True)
    numbers = values.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return Sparse(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), local, numbers.astype(np.int64)), known


@dataclass
class BallTree:
    """Node 0 is the root; node i has the children below[i], or the rows order[first[i]:last[i]]."""

    order: np.ndarray
    first: np.ndarray
    last: np.ndarray
    below: np.ndarray  # (nodes, 2), -1 at leaves
    centroid: np.ndarray  # (nodes, terms)
    radius: np.ndarray
    holds: np.ndarray  # (nodes, terms): whether a document of the node has the term


def ball_tree(docs: Sparse, terms: int, leaf: int = LEAF) -> BallTree:
    """Halve the rows along the line through two rows far apart, until leaves are small."""
    n = len(docs.starts) - 1
    leaf = max(leaf, 2 * n * terms // CELLS)
    lengths = np.diff(docs.starts)
    value = docs.values.astype(np.float64)
    owner = np.repeat(np.arange(n), lengths)
    square = np.bincount(owner, value * value, n)
    order, todo = np.arange(n), [(0, n, -1, 0)]
    spans, below, centroids, radii, holds = [], [], [], [], []
    while todo:
        a, b, parent, side = todo.pop()
        node = len(spans)
        if parent >= 0:
            below[parent][side] = node
        rows = order[a:b]
        at = ragged(docs.starts[rows], lengths[rows])
        who, term, x = np.repeat(np.arange(b - a), lengths[rows]), docs.terms[at], value[at]
        centre = np.bincount(term, x, terms) / max(1, b - a)

        def apart(point: np.ndarray, who=who, term=term, x=x, rows=rows) -> np.ndarray:
            """Squared distances of the node's rows from a point."""
            return np.maximum(square[rows] - 2 * np.bincount(who, x * point[term], len(rows)) + point @ point, 0)

        far = apart(centre)
        # The squares cancel: widened by what rounding of sums of this size can lose.
        loss = (square[rows].max(initial=0) + centre @ centre) * 1e-12
        spans.append((a, b))
        below.append([-1, -1])
        centroids.append(centre)
        radii.append(math.sqrt(far.max(initial=0) + loss) if b - a > 1 else math.sqrt(loss))
        present = np.zeros(terms, bool)
        present[term] = True
        holds.append(present)
        if b - a > leaf:
            ends = []
            for start in (int(far.argmax()), None):
                if start is None:
                    start = int(apart(ends[0]).argmax())
                point = np.zeros(terms)
                span = slice(docs.starts[rows[start]], docs.starts[rows[start] + 1])
                point[docs.terms[span]] = value[span]
                ends.append(point)
            lean = np.bincount(who, x * (ends[0] - ends[1])[term], b - a)
            order[a:b] = rows[np.argsort(lean, kind="stable")]
            middle = (a + b) // 2
            todo += [(middle, b, node, 1), (a, middle, node, 0)]
    first, last = np.array(spans).reshape(-1, 2).T
    return BallTree(order, first, last, np.array(below), np.array(centroids), np.array(radii), np.array(holds))


def bounds(tree: BallTree, nodes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """No document of a node scores more than this: Cauchy-Schwarz around the centroid, rounded up."""
    held = tree.holds[np.ix_(nodes, terms)]
    centre = tree.centroid[np.ix_(nodes, terms)] @ weights
    reach = np.sqrt(held @ (weights * weights)) * tree.radius[nodes]
    return np.where(held.any(axis=1), (centre + reach) * (1 + SLACK) + 1, 0)


def best_first(
    docs: Sparse, tree: BallTree, terms: np.ndarray, weights: np.ndarray, k: int, floor: int
) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows and scores of all that may be among the k best, and how many rows were scored.

    Every row with a positive score of at least ``floor`` and the k-th best score is in the result.
    """
    dense = np.zeros(tree.centroid.shape[1], np.int64)
    dense[terms] = weights
    real = weights.astype(np.float64)
    rows: list[np.ndarray] = []
    scores: list[np.ndarray] = []
    best: list[int] = []
    tried = 0
    least = max(1, floor)
    heap = [(-float(bounds(tree, np.array([0]), terms, real)[0]), 0)]
    while heap:
        bound, node = heapq.heappop(heap)
        if -bound < least:
            break
        children = tree.below[node]
        if children[0] < 0:
            here = tree.order[tree.first[node] : tree.last[node]]
            score = docs.scores(here, dense)
            tried += len(here)
            keep = score >= least
            rows.append(here[keep])
            scores.append(score[keep])
            for value in score[keep].tolist():
                if len(best) < k:
                    heapq.heappush(best, value)
                else:
                    heapq.heappushpop(best, value)
            if len(best) == k:
                least = max(least, best[0])
            continue
        for child, limit in zip(children, bounds(tree, children, terms, real), strict=True):
            if limit >= least:
                heapq.heappush(heap, (-float(limit), int(child)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), tried
    row, score = np.concatenate(rows), np.concatenate(scores)
    keep = score >= least
    return row[keep], score[keep], tried


def _search(k: int):
    def search(block: pa.Table, asked: pa.Table) -> pa.Table:
        item, found, points = [], [], []
        if len(block) and len(asked):
            docs, known = sparse_rows(block["_terms"], block["_values"])
            ids = block["_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
            tree = ball_tree(docs, len(known))
            for name, terms, weights, floor in zip(
                asked["_item"].to_pylist(), asked["_terms"], asked["_weights"], asked["_floor"].to_pylist(), strict=True
            ):
                wanted = terms.values.to_numpy(zero_copy_only=False)
                weight = weights.values.to_numpy(zero_copy_only=False)
                at = np.searchsorted(known, wanted)
                here = at < len(known)
                here[here] = known[at[here]] == wanted[here]
                row, score, _ = best_first(docs, tree, at[here], weight[here], k, floor)
                top = np.lexsort((ids[row], -score))[:k]
                item += [name] * len(top)
                found.append(ids[row[top]])
                points.append(score[top])
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        ids = join(found)
        return pa.table(
            {"_item": pa.array(item, pa.int64()), "doc_id": pa.array(ids, mask=ids == np.iinfo(np.int64).max), "score": pa.array(join(points))}
        )

    return search


def _weighted(documents: DataFrame, spark, words: list[str], id: str, text: str):
    """Documents as numbered terms with counts, and the corpus counts of the given terms.

    Returns (rows of _row, _id, _n, _terms, _counts, written; documents with a term; terms in all;
    number of term -> documents that hold it)."""
    number = spark.sparkContext.broadcast({w.encode(): i for i, w in enumerate(words)})

    def counted(texts: list[str]) -> dict[str, pa.Array]:
        known = number.value
        size, terms, counts = [], [], []
        for t in texts:
            every = terms_of(t)
            size.append(len(every))
            seen = sorted((known[w], c) for w, c in Counter(every).items() if w in known)
            terms.append([w for w, _ in seen])
            counts.append([c for _, c in seen])
        return {
            "_n": pa.array(size, pa.int64()),
            "_terms": pa.array(terms, pa.list_(pa.int32())),
            "_counts": pa.array(counts, pa.list_(pa.int64())),
        }

    rows = documents.select(F.col(f"`{id}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_text"))
    made = by_portion(rows, "_text", counted, "_n long, _terms array<int>, _counts array<long>", ["_id"])
    held, facts = written_and_measured(
        made.withColumn("_row", F.monotonically_increasing_id()),
        "terms",
        F.count_if(F.col("_n") > 0).alias("documents"),
        F.sum("_n").alias("total"),
        F.count_if(F.size("_terms") > 0).alias("rows"),
    )
    frequency = held.select(F.explode("_terms").alias("_term")).groupBy("_term").agg(F.count(F.lit(1)).alias("df"))
    return held, facts, frequency


def ranked_documents(
    documents: DataFrame,
    items: DataFrame,
    id: str,
    text: str,
    item: str,
    k: int = 10,
    block: int = BLOCK,
    vocabulary: int = VOCABULARY,
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the k best documents of each item.

    A term t weighs w = floor(1000 ln((2N + 2) / (2 df + 1))); a document of n terms has m = 10 + 90 n N
    div L; its score sums w * ((10^9 tf) div (1000 tf + 8 m)) over the item's different terms. Only
    positive scores count; ties go to the smaller id, a null id last. Repeated documents are ranked
    as rows of their own, and so are repeated items: each of them gets its own results.

    A null text has no term. An item without terms, or with none that any document holds, gets no
    row; empty tables give an empty result. Other columns are ignored. Items are taken in portions
    of at most ``vocabulary`` different terms (one item at least), each with a pass over the documents.
    """
    spark = documents.sparkSession
    ship(spark)
    asked = written(
        items.select(F.col(f"`{item}`").cast("long").alias("_item"), F.array_distinct(term_column(text)).alias("_words"))
        .where(F.size("_words") > 0)
        .withColumn("_ask", F.monotonically_increasing_id()),
        "items",
    )
    found = [
        _portion(documents, asked.where(chosen), words, id, text, k, block)
        for chosen, words in _portions(asked, vocabulary)
    ]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def _portions(asked: DataFrame, vocabulary: int) -> Iterator[tuple[Column, list[str]]]:
    """Conditions that split the items by hash, and the different terms of each portion."""
    place = F.xxhash64("_ask", F.lit(11))
    todo = [(1, 0)]
    while todo:
        parts, part = todo.pop()
        chosen = F.pmod(place, F.lit(parts)) == part
        words = asked.where(chosen).select(F.explode("_words").alias("w")).distinct()
        few = words.limit(vocabulary + 1).toArrow()["w"].to_pylist()
        if len(few) <= vocabulary or asked.where(chosen).limit(2).count() < 2:
            if few:
                yield chosen, sorted(few if len(few) <= vocabulary else words.toArrow()["w"].to_pylist())
            continue
        todo += [(2 * parts, part), (2 * parts, part + parts)]


def _portion(documents: DataFrame, asked: DataFrame, words: list[str], id: str, text: str, k: int, block: int) -> DataFrame:
    spark = documents.sparkSession
    held, facts, frequency = _weighted(documents, spark, words, id, text)
    n, total = facts["documents"] or 0, facts["total"] or 0
    # As many rows as the portion has different terms, which is bounded.
    df = {r["_term"]: r["df"] for r in frequency.toArrow().to_pylist()}
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(words))], np.int64)
    number = spark.sparkContext.broadcast((words, weight, np.array([i in df for i in range(len(words))], bool)))
    m = F.expr(f"10 + (90L * _n * {n}L) div {max(1, total)}L")
    values = F.transform("_counts", lambda c: F.call_function("div", c * F.lit(SCALE).cast("long"), c * 1000 + F.col("_m") * 8))
    count = facts["rows"] or 0
    blocks = max(1, -(-count // block))
    rows = (
        held.where(F.size("_terms") > 0)
        .withColumn("_m", m)
        .select("_row", "_id", "_terms", values.alias("_values"), F.pmod(F.xxhash64("_row", F.lit(7)), F.lit(blocks)).cast("int").alias("_block"))
    )
    share = min(1.0, SEEDS / max(1, count))
    chosen = F.pmod(F.xxhash64("_row", F.lit(3)), F.lit(1_000_000_000)) < int(share * 1_000_000_000)
    seeds = spark.sparkContext.broadcast(rows.where(chosen).select("_terms", "_values").toArrow())

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbered terms and weights of each item, and its k-th best score over the seeds."""
        names, w, held_by = number.value
        place = {t: i for i, t in enumerate(names)}
        docs, known = sparse_rows(seeds.value["_terms"], seeds.value["_values"]) if len(seeds.value) else (None, None)
        for batch in batches:
            terms, weights, floors = [], [], []
            for asked_words in batch.column(1).to_pylist():
                mine = np.array(sorted(i for i in (place[t] for t in asked_words) if held_by[i] and w[i] != 0), np.int64)
                floor = 0
                if docs is not None and len(docs.starts) > k and len(mine):
                    dense = np.zeros(len(names), np.int64)
                    dense[mine] = w[mine]
                    score = docs.scores(np.arange(len(docs.starts) - 1), dense[known])
                    floor = max(0, int(np.partition(score, len(score) - k)[len(score) - k]))
                terms.append(mine.astype(np.int32))
                weights.append(w[mine])
                floors.append(floor)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(terms, pa.list_(pa.int32())),
                    pa.array(weights, pa.list_(pa.int64())),
                    pa.array(floors, pa.int64()),
                ],
                names=["_item", "_terms", "_weights", "_floor"],
            )

    # The row of the item, not its id, tells results apart: ids may repeat.
    queries = asked.select("_ask", "_words").mapInArrow(weighed, "_item long, _terms array<int>, _weights array<long>, _floor long")
    queries = written(queries.where(F.size("_terms") > 0), "asked")
    groups = max(1, -(-queries.count() // ASKED))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = rows.select("_id", "_terms", "_values", "_block", every(groups).alias("_group"))
    sent = queries.select("*", F.pmod(F.xxhash64("_item", F.lit(5)), F.lit(groups)).cast("int").alias("_group"), every(blocks).alias("_block"))
    found = dealt.groupBy("_block", "_group").cogroup(sent.groupBy("_block", "_group")).applyInArrow(_search(k), "_item long, doc_id long, score long")
    best = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    named = asked.select(F.col("_ask").alias("_item"), F.col("_item").alias("item_id"))
    return top.join(named, "_item").select("item_id", "rank", "doc_id", "score")
