"""Keep a vector table up to date from a stream of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.encode import EncoderSpec
from ..sources.vector_table import VectorTable


def add_stream(
    table: VectorTable,
    records: DataFrame,
    order: str,
    checkpoint: str,
    encoder: EncoderSpec,
) -> StreamingQuery:
    """Add every micro-batch to the table, by key.

    The stored keys are read again in each batch, so a key arrives once across batches and a
    replayed batch adds nothing twice. Runs until the input that is there has been read.
    """

    def add(batch: DataFrame, _: int) -> None:
        table.add(batch, order, encoder)

    return (
        records.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
