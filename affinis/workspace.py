"""Session set-up and the shared folder that holds intermediate tables."""

from __future__ import annotations

import ctypes
import shutil
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# A side is broadcast only up to this many narrow rows; beyond it a shuffle join is used.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20  # ... and only with this many bytes of variable length

_shipped: set[str] = set()


def session(app: str = "affinis", cores: int | str = "*", **conf: str) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster use the session you are given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(
                "Set spark.checkpoint.dir to a folder every executor can reach: intermediate "
                "tables must survive the loss of an executor."
            )
        context.setCheckpointDir(tempfile.mkdtemp(prefix="affinis-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/affinis-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, below a folder of this application's own."""
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clear_workspace(spark: SparkSession) -> None:
    """Remove this application's intermediate tables, once its results have been read."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, survives lost executors, and later reads take only the columns
    they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_and_measured(df: DataFrame, label: str, *measures: Column) -> tuple[DataFrame, dict]:
    """``written``, with aggregates of the rows taken while they are written."""
    seen = Observation()
    table = written(df.observe(seen, *measures), label)
    return table, seen.get


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its file system."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place))


def few_rows(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """Driver rows as a local table: through Arrow, so no Python worker has to hand them back."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    records = [dict(zip(fields.names, row, strict=True)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(records, to_arrow_schema(fields)), fields)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a side whose row count is known and within the limit."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def fill_cores(df: DataFrame) -> DataFrame:
    """Spread an input that is too small to give every core a split.

    Only such an input is shuffled, so the move is bounded by one split per core; a large table
    keeps its partitions.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    bytes_of = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    split = int(bytes_of(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < cores * split else df


def release() -> None:
    """Hand freed memory back to the system: Spark keeps Python workers for the stages that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    if package.is_dir():
        archive = shutil.make_archive(
            str(Path(tempfile.mkdtemp(prefix="affinis-ship-")) / package.name),
            "zip",
            root_dir=package.parent,
            base_dir=package.name,
        )
        context.addPyFile(archive)
    _shipped.add(context.applicationId)
