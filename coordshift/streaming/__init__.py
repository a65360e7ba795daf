"""Lifting of streams: it has no state, so a stream of records is lifted as a table is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from coordshift.operators.asof import Search, prepared, with_steps
from coordshift.operators.lift import lift_alignments, lift_bed


def _searched(index: DataFrame, allowed: int | None = None) -> None:
    if not isinstance(prepared(with_steps(index, allowed)), Search):
        raise ValueError("a stream is searched in place: the index has too many intervals")


def lifted_alignments(stream: DataFrame, index: DataFrame, allowed: int = 0, keep_mapq: bool = False) -> DataFrame:
    """``operators.lift.lift_alignments`` of a stream, by a static index."""
    _searched(index, allowed)
    return lift_alignments(stream, index, allowed, keep_mapq)


def lifted_bed(stream: DataFrame, index: DataFrame, allowed: int = 500) -> DataFrame:
    _searched(index)
    return lift_bed(stream, index, allowed)


def write(lifted: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts appending lifted rows to Parquet files, each once; ``checkpoint`` is a shared folder."""
    return lifted.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
