"""A stored table of vectors that grows by key and is searched by vector or by text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import blocks as B
from ..functions import vectors as V
from ..functions.text import joined_text
from ..operators.encode import EncoderSpec, encoded
from ..operators.matching import Matches, annotated, first_per_key, match
from ..operators.numbering import numbered_and_counted
from ..operators.topk import SCANNED_BYTES, SCANNED_QUERIES, nearest, probed, scanned
from ..settings import DEFAULT_DECIMALS, DEFAULT_MATCH_THRESHOLD, DEFAULT_TOP_K
from ..workspace import BROADCAST_BYTES, BROADCAST_ROWS, exists, few_rows, fill_cores, ship, written, written_and_measured
from .tables import require_columns
from .vector_index import HELD, ROWS_PER_CELL, VectorIndex, build, load

ROWS = T.StructType(
    [
        T.StructField("pos", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("row_data", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
SAMPLE = 256  # rows that the number of probes is measured with
META = "model_id string, dimensions int, key_column string, embed_columns array<string>"


@dataclass(frozen=True)
class Added:
    """What an add did; the skipped rows are counted when they are asked for."""

    added: int
    given: DataFrame

    @property
    def skipped(self) -> int:
        return self.given.count() - self.added


class VectorTable:
    """Parquet rows (pos, key, row_data, embedding) and one row of metadata.

    A deletion writes the positions of the rows that go and leaves the files alone; every read leaves
    these rows out, until ``compact`` writes the rows that are left once more. A position is never given
    twice. What was deleted or written anew counts once its folder is complete.

    Keys are unique. An add that is repeated, or that was cut off half-way, adds only what is
    still missing, so a retry is safe. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, meta: Row):
        self.spark = spark
        self.path = path.rstrip("/")
        self.model_id: str = meta["model_id"]
        self.dimensions: int = meta["dimensions"]
        self.key_column: str = meta["key_column"]
        self.embed_columns: list[str] = list(meta["embed_columns"])

    @classmethod
    def create(
        cls,
        spark: SparkSession,
        path: str,
        model_id: str,
        dimensions: int,
        key_column: str,
        embed_columns: list[str],
    ) -> VectorTable:
        """An empty table; a table that exists already is an error. Metadata is written last."""
        path = path.rstrip("/")
        try:
            few_rows(spark, [], ROWS).write.parquet(f"{path}/rows")
        except AnalysisException as e:
            if e.getCondition() == "PATH_ALREADY_EXISTS":
                raise FileExistsError(f"A vector table exists already: {path}") from None
            raise
        meta = [(model_id, dimensions, key_column, embed_columns)]
        few_rows(spark, meta, META).coalesce(1).write.parquet(f"{path}/meta")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorTable:
        try:
            meta = spark.read.schema(META).parquet(f"{path.rstrip('/')}/meta").first()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                raise FileNotFoundError(f"No vector table at {path}") from None
            raise
        return cls(spark, path, meta)

    @property
    def home(self) -> str:
        """The folder of the rows: the table's own, or that of the last compaction."""
        number = self._compactions()
        return f"{self.path}/compact={number}" if number else self.path

    def _compactions(self) -> int:
        return self._complete(f"{self.path}/compact=", "/upto/_SUCCESS")

    def _complete(self, start: str, end: str) -> int:
        """How many numbered folders in a row are complete."""
        number = 0
        while exists(self.spark, f"{start}{number + 1}{end}"):
            number += 1
        return number

    @property
    def rows(self) -> DataFrame:
        return self._without_deleted(self._files(self.home))

    def _files(self, home: str) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(f"{home}/rows")

    def _without_deleted(self, rows: DataFrame) -> DataFrame:
        """Rows of the table or of its index, less the deleted ones."""
        home = self.home
        batches = self._complete(f"{home}/deleted/batch=", "/_SUCCESS")
        if not batches:
            return rows
        paths = [f"{home}/deleted/batch={i}" for i in range(1, batches + 1)]
        return rows.join(self.spark.read.schema("pos long").parquet(*paths), "pos", "left_anti").select(*rows.columns)

    def delete(self, df: DataFrame, key: str | None = None) -> int:
        """Delete the rows with the keys in a column of ``df`` (the table's key column by default).

        Returns how many went; unknown keys and repeats change nothing, a null key deletes the row
        whose key is missing. The same key may be added again later.
        """
        asked = df.select(F.col(f"`{key or self.key_column}`").cast("string").alias("_a")).distinct()
        home = self.home
        path = f"{home}/deleted/batch={self._complete(f'{home}/deleted/batch=', '/_SUCCESS') + 1}"
        gone = self.rows.select("pos", "key").join(asked, F.col("key").eqNullSafe(F.col("_a")), "left_semi").select("pos")
        found, facts = written_and_measured(gone, "deleted", F.count(F.lit(1)).alias("n"))
        if facts["n"]:
            found.write.mode("overwrite").parquet(path)
        return facts["n"]

    def compact(self) -> int:
        """Write the rows that are left once more, and the index if there is one; returns how many there are.

        A compaction that is cut off changes nothing that is read. The old files stay for readers that
        began before; nothing refers to them afterwards.
        """
        upto = self._last_position()
        home = f"{self.path}/compact={self._compactions() + 1}"
        rows, facts = self.rows, Observation()
        rows.observe(facts, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{home}/rows")
        if self.index is not None:
            # Holds rows that are not deleted, so it is right before the new folder counts and after.
            build(self._files(home), self.path, self.dimensions, self.index.rows_per_cell)
            self.__dict__.pop("index", None)
        few_rows(self.spark, [(upto,)], "pos long").coalesce(1).write.mode("overwrite").parquet(f"{home}/upto")
        return facts.get["n"]

    def _last_position(self) -> int:
        """The largest position that was ever given, -1 without any."""
        given = [self._files(self.home).select("pos")]
        if self._compactions():
            given.append(self.spark.read.schema("pos long").parquet(f"{self.home}/upto"))
        last = reduce(DataFrame.unionByName, given).agg(F.max("pos")).first()[0]
        return -1 if last is None else last

    def count(self) -> int:
        return self.rows.count()

    def insert(self, df: DataFrame, vector: str, order: str) -> int:
        """Append the rows whose key is new, with the vector they carry; returns how many.

        Of several rows with one key the first by ``order`` is kept, as in ``add``. The row itself
        is kept as JSON, without the vector.
        """
        payload = [c for c in df.columns if c != vector]
        fresh, count = self._numbered(self._unseen(df, order), order)
        self._append(fresh, payload, F.col(f"`{vector}`"))
        return count

    def add(self, df: DataFrame, order: str, encoder: EncoderSpec) -> Added:
        """Append the rows whose key is new; only these are encoded.

        Of several rows with one key the first by ``order`` is kept. A missing key is a key like
        any other: one row may have it.
        """
        self._require(encoder)
        require_columns(df, [self.key_column, *self.embed_columns])
        ship(self.spark)
        fresh, count = self._numbered(self._unseen(df, order), order)
        texts = joined_text([F.col(f"`{c}`") for c in self.embed_columns])
        if count:
            self._append(fill_cores(fresh), df.columns, encoded(texts, encoder))
        return Added(count, df)

    def _require(self, encoder: EncoderSpec) -> None:
        """Vectors of different encoders cannot be compared, even where their sizes agree."""
        if encoder.dim != self.dimensions:
            raise ValueError(f"The encoder gives {encoder.dim} dimensions, the table holds {self.dimensions}.")
        if encoder.name != self.model_id:
            raise ValueError(f"The table holds vectors of {self.model_id!r}, not of {encoder.name!r}.")

    def _unseen(self, df: DataFrame, order: str) -> DataFrame:
        """The first row of every key that is not stored yet.

        The batch is read once: its first rows are written, with their number and the size of
        their keys. A small batch sends its keys to the stored ones, which are then only read;
        otherwise both sides are shuffled.
        """
        key = F.col(f"`{self.key_column}`").cast("string")
        first, facts = written_and_measured(
            first_per_key(df, self.key_column, order),
            "batch",
            F.count(F.lit(1)).alias("rows"),
            F.sum(F.octet_length(key)).alias("bytes"),
        )
        keyed = first.withColumn("_k", key)
        stored = self.rows.select(F.col("key").alias("_s"))
        asked = keyed.select(F.col("_k").alias("_a"))
        if facts["rows"] <= BROADCAST_ROWS and (facts["bytes"] or 0) <= BROADCAST_BYTES:
            stored = stored.join(F.broadcast(asked), F.col("_s").eqNullSafe(F.col("_a")), "left_semi")
        return keyed.join(stored, F.col("_k").eqNullSafe(F.col("_s")), "left_anti").drop("_k")

    def _numbered(self, df: DataFrame, order: str) -> tuple[DataFrame, int]:
        by = list(dict.fromkeys([order, self.key_column]))
        return numbered_and_counted(df, by, "_pos", self._last_position() + 1)

    def _append(self, fresh: DataFrame, payload: list[str], vector) -> None:
        fresh.select(
            F.col("_pos").alias("pos"),
            F.col(f"`{self.key_column}`").cast("string").alias("key"),
            F.to_json(F.struct(*[F.col(f"`{c}`") for c in payload])).alias("row_data"),
            vector.cast("array<float>").alias("embedding"),
        ).write.mode("append").parquet(f"{self.home}/rows")

    def build_index(self, rows_per_cell: int = ROWS_PER_CELL) -> None:
        """Write the rows by cell, so that a query reads only some of the partitions."""
        build(self.rows, self.path, self.dimensions, rows_per_cell)
        self.__dict__.pop("index", None)

    @cached_property
    def index(self) -> VectorIndex | None:
        return load(self.spark, self.path)

    def query(
        self,
        vector: list[float],
        top_k: int = DEFAULT_TOP_K,
        decimals: int = DEFAULT_DECIMALS,
        probes: int | None = None,
    ) -> DataFrame:
        """The stored rows closest to one vector by cosine: id, similarity, fields (JSON).

        Without an index this is one pass over the table; each partition keeps its best
        ``top_k`` rows. With one, the nearest cells give a score to beat and only cells that may
        beat it are read after that; ``probes`` reads just that many nearest cells instead, which
        is approximate. Rows added since the index was built are always read.
        """
        if len(vector) != self.dimensions:
            raise ValueError(f"The query has {len(vector)} dimensions, the table {self.dimensions}.")
        best = self._closest(self._candidates(vector, top_k, probes), vector, top_k)
        if self.index is not None:
            # The index holds no fields: the rows are read by the positions that were found, ``top_k`` at most.
            found = [tuple(r) for r in best.collect()]
            fields = self.rows.where(F.col("pos").isin([r[0] for r in found])).select("pos", "row_data")
            best = fields.join(F.broadcast(few_rows(self.spark, found, "pos long, key string, _s double")), "pos")
            best = best.orderBy(F.desc("_s"), "pos")
        return best.select(
            F.col("key").alias("id"),
            F.round("_s", decimals).alias("similarity"),
            F.col("row_data").alias("fields"),
        )

    def _candidates(self, vector: list[float], top_k: int, probes: int | None) -> DataFrame:
        index = self.index
        if index is None:
            return self.rows
        unit = B.prepared("cosine", np.array([vector], dtype=np.float64))
        late = self.rows.where(F.col("pos") > index.upto).select(*HELD)

        def held(cells: np.ndarray) -> DataFrame:
            return self._without_deleted(index.of_cells(cells)).unionByName(late)

        if probes is not None:
            return held(index.nearest_cells(unit)[:probes])
        start = held(index.first_cells(unit, top_k))
        found = [r["_s"] for r in self._closest(start, vector, top_k).select("_s").collect()]
        floor = found[-1] if len(found) == top_k else -1.0
        return held(index.cells_above(unit, floor))

    @staticmethod
    def _closest(rows: DataFrame, vector: list[float], top_k: int) -> DataFrame:
        asked = F.array(*[F.lit(float(x)) for x in vector])
        score = V.cosine_or_zero("embedding", asked)
        scored = rows.select("pos", "key", score.alias("_s"), *[c for c in rows.columns if c == "row_data"])
        return scored.orderBy(F.desc("_s"), "pos").limit(top_k)

    def query_text(
        self,
        text: str,
        top_k: int = DEFAULT_TOP_K,
        decimals: int = DEFAULT_DECIMALS,
        probes: int | None = None,
        *,
        encoder: EncoderSpec,
    ) -> DataFrame:
        """The stored rows closest to a text; the encoder is the one that made the table's vectors."""
        self._require(encoder)
        vector = encoder.factory().encode([text])[0]
        return self.query([float(x) for x in vector], top_k, decimals, probes)

    def query_many(
        self,
        queries: DataFrame,
        id: str,
        vector: str,
        top_k: int = DEFAULT_TOP_K,
        decimals: int = DEFAULT_DECIMALS,
        probes: int | None = None,
    ) -> DataFrame:
        """query_key, id, rank, similarity for a table of query vectors.

        A small table of queries is broadcast, and the stored rows are read once and stay where they
        are; with an index only the cells that can hold an answer are read. A larger one is joined.
        ``probes`` looks only into that many nearest cells of the index for each query, and at the
        rows added since, as ``query`` does; without an index into cells made for the occasion. The
        answer to a query is the same whatever others are asked with it.
        """
        held, facts = written_and_measured(
            queries.select(F.col(id).cast("string").alias("query_key"), F.col(vector).alias("_v")).where(F.col("_v").isNotNull()),
            "queries",
            F.count(F.lit(1)).alias("rows"),
        )
        if probes is not None and self.index is not None:
            return self._probe(held, top_k, decimals, probes)
        if probes is None and facts["rows"] <= min(SCANNED_QUERIES, SCANNED_BYTES // (8 * self.dimensions)):
            return self._scan(held, top_k, decimals)
        found = nearest(
            queries, id, vector, self.rows, "pos", "embedding", stored_key="key",
            top_k=top_k, decimals=decimals, probes=probes,
        )
        return found.select(
            "query_key",
            F.col("neighbor_key").alias("id"),
            "rank",
            F.col("score").alias("similarity"),
        )

    def probes_for(self, recall: float = 0.95, top_k: int = DEFAULT_TOP_K, sample: int = SAMPLE) -> int:
        """The least ``probes`` that find this share of the true ``top_k`` neighbours of stored rows.

        Asked are at most ``sample`` rows of the index, chosen by a hash of the key; their neighbours
        are searched among all rows, exactly. What is counted is the place of each neighbour's cell in
        the order in which its row visits the cells, so one search serves every number of probes.
        """
        if not 0.0 < recall <= 1.0:
            raise ValueError("recall must be above 0 and at most 1.")
        index = self.index
        if index is None:
            raise ValueError("The table has no index.")
        rows = self._without_deleted(index.rows).select("pos", "key", "embedding")
        share = int(min(1.0, (2 * sample + 64) / max(1, int(index.counts.sum()))) * 1_000_000_000)
        few = rows.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000_000)) < share)
        few = written(few.orderBy(F.xxhash64("key"), "pos").limit(min(sample, SCANNED_QUERIES)), "sample")
        near = self.query_many(few, "pos", "embedding", top_k + 1)
        own = few.select(F.col("pos").cast("string").alias("query_key"), F.col("key").alias("_own"))
        near = written(near.join(own, "query_key").where(~F.col("id").eqNullSafe(F.col("_own"))).select("query_key", "id"), "near")
        # Rows added since the index was built are always read.
        cells = index.rows.select("pos", "key", "cell").join(F.broadcast(near.select("id").distinct()), F.col("key").eqNullSafe(F.col("id")), "left_semi")
        cell = {r["key"]: r["cell"] for r in self._without_deleted(cells).collect()}  # at most sample * (top_k + 1)
        places = {str(r["pos"]): {int(c): n for n, c in enumerate(index.nearest_cells(B.prepared("cosine", np.array([r["embedding"]], dtype=np.float64))))} for r in few.collect()}
        depth = np.sort([places[r["query_key"]][cell[r["id"]]] + 1 if r["id"] in cell else 1 for r in near.collect()])
        return int(depth[max(0, int(np.ceil(recall * len(depth))) - 1)]) if len(depth) else 1

    def _probe(self, queries: DataFrame, top_k: int, decimals: int, probes: int) -> DataFrame:
        index = self.index
        sizes = queries.agg(F.min(F.size("_v")), F.max(F.size("_v"))).first()
        if set(sizes) - {None, self.dimensions}:
            raise ValueError(f"The queries have {min(sizes)} to {max(sizes)} dimensions, the table {self.dimensions}.")
        asked = written(queries.select(F.monotonically_increasing_id().alias("_rep"), F.col("query_key").alias("_key"), F.col("_v").alias("_vec")), "asked")
        plain = [F.col("pos").alias("_rep"), F.col("key").alias("_key"), F.col("embedding").alias("_vec")]
        stored = self._without_deleted(index.rows).select(*plain, "cell")
        late = self.rows.where(F.col("pos") > index.upto).select(*plain)
        found = probed(asked, stored, late, index.centres, index.counts, probes, top_k)
        return found.select(
            F.col("_key").alias("query_key"),
            F.col("_cand_key").alias("id"),
            F.col("rank").cast("int").alias("rank"),
            F.round("_good", decimals).alias("similarity"),
        )

    def _scan(self, queries: DataFrame, top_k: int, decimals: int) -> DataFrame:
        rows = queries.collect()  # bounded by the caller
        names = [(n, r["query_key"]) for n, r in enumerate(rows)]
        asked = np.array([r["_v"] for r in rows], dtype=np.float64).reshape(len(rows), -1)
        if len(rows) and asked.shape[1] != self.dimensions:
            raise ValueError(f"The queries have {asked.shape[1]} dimensions, the table {self.dimensions}.")
        best = self._best_of(asked, top_k)
        named = F.broadcast(few_rows(self.spark, names, "_q long, query_key string"))
        return best.join(named, "_q").select(
            "query_key",
            F.col("_cand_key").alias("id"),
            F.col("rank").cast("int").alias("rank"),
            F.round("_good", decimals).alias("similarity"),
        )

    def _best_of(self, asked: np.ndarray, top_k: int) -> DataFrame:
        """The best rows of every query by one pass over all rows, or over the cells that matter."""

        def scan(stored: DataFrame) -> DataFrame:
            return scanned(stored, "pos", "key", "embedding", asked, "cosine", top_k)

        index = self.index
        if index is None or not len(asked):
            return scan(self.rows)
        unit = B.prepared("cosine", asked)
        late = self.rows.where(F.col("pos") > index.upto).select(*HELD)

        def within(cells: np.ndarray) -> DataFrame:
            return scan(self._without_deleted(index.of_cells(cells)).unionByName(late))

        each = [u.reshape(1, -1) for u in unit]
        start = np.unique(np.concatenate([index.first_cells(u, top_k) for u in each]))
        first = within(start).where(F.col("rank") == top_k)
        floors = np.full(len(asked), -1.0)
        for r in first.select("_q", "_good").collect():
            floors[r["_q"]] = r["_good"]
        cells = np.unique(np.concatenate([index.cells_above(u, f) for u, f in zip(each, floors, strict=True)]))
        return within(np.union1d(cells, start))

    def match(
        self,
        threshold: float = DEFAULT_MATCH_THRESHOLD,
        decimals: int = DEFAULT_DECIMALS,
        list_pairs: bool = False,
    ) -> Matches:
        return match(self.rows, "pos", "embedding", "key", threshold, decimals, list_pairs)

    def annotate(
        self,
        df: DataFrame,
        threshold: float = DEFAULT_MATCH_THRESHOLD,
        decimals: int = DEFAULT_DECIMALS,
        lists: bool = True,
        as_text: bool = False,
    ) -> DataFrame:
        """``df`` with the matches among the stored rows, by key."""
        return annotated(df, self.key_column, self.match(threshold, decimals, lists), lists, as_text)

    def info(self) -> DataFrame:
        """One row: path, row_count, model_id, dimensions, key_column, embed_columns, size_on_disk."""
        return self.rows.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(self.path).alias("path"),
            "row_count",
            F.lit(self.model_id).alias("model_id"),
            F.lit(self.dimensions).alias("dimensions"),
            F.lit(self.key_column).alias("key_column"),
            F.array(*[F.lit(c) for c in self.embed_columns]).alias("embed_columns"),
            F.lit(self.size_on_disk()).cast("long").alias("size_on_disk"),
        )

    def size_on_disk(self) -> int:
        """Bytes of the table as the file system reports them."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        system = path.getFileSystem(context._jsc.hadoopConfiguration())
        return int(system.getContentSummary(path).getLength())
