"""Helpers shared by the text operators: inputs, scratch tables, broadcasts behind a count."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import fresh_path, written

__all__ = ["BROADCAST_ROWS", "fresh_path", "id_and_text", "if_small", "spare", "table", "tidy", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only doc_id (long) and text (string, null kept): other columns, of whatever name, never reach an operator."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: Rows of a table of ids (or of a few numbers each) up to which it is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000


def if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """`df`, marked for broadcast if it has few rows (`rows`, or counted here: give a written table)."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def spare() -> None:
    """Give memory that was freed back to the system: Arrow's pool and the C library keep it otherwise."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, a function for mapInArrow, after which its Python worker, which later stages use too, holds no memory that it doesn't need."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            spare()

    return tidied
