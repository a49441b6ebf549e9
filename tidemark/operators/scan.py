"""Segmented prefix scans: places and carried values along ordered rows, with no task per key.

`cut` deals rows in ranges of (key, order), so a key with many rows lies in
several parts. What a part adds to a key is a small summary row; a window over a
key's summaries (at most one per part) gives what each part begins with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import written

#: The columns that cut() adds: the part of a row, and its number, which rises with the order over all parts.
PART, ROW = "__part", "__row"


def cut(df: DataFrame, by: list[str], order: list[Column], tag: str = "scan", keep: list[str] | None = None) -> DataFrame:
    """`df` (of its columns those in `keep`, if given) in the order of (by, order), written, with PART and ROW.

    There are as many parts as spark.sql.shuffle.partitions says. Rows alike in
    all of these lie in one part, in any order. Nulls in `by` are a key.
    """
    keys = [*map(F.col, by), *order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return written(ranged.select(*(keep or df.columns), F.spark_partition_id().alias(PART), F.monotonically_increasing_id().alias(ROW)), tag)


def earlier(by: list[str]):
    """The window over a key's summaries before a part."""
    return Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def joined(rows: DataFrame, summaries: DataFrame, by: list[str]) -> DataFrame:
    """Rows of cut() with their part's summary (by, PART, ...): dealt by (by, PART), so a hot key is spread as cut() spread it."""
    told = summaries.withColumnsRenamed({c: f"__of_{c}" for c in [*by, PART]})
    same = F.col(PART) == F.col(f"__of_{PART}")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return rows.join(told, same, "left").drop(*[f"__of_{c}" for c in [*by, PART]])


def placed(rows: DataFrame, by: list[str], *summaries: Column) -> DataFrame:
    """One row per key and part of cut() rows: `summaries`, `__first` (the first row there), `__n` rows, and `__before` (the key's rows in earlier parts)."""
    sizes = rows.groupBy(*by, PART).agg(F.min(ROW).alias("__first"), F.count(F.lit(1)).alias("__n"), *summaries)
    return sizes.withColumn("__before", F.coalesce(F.sum("__n").over(earlier(by)), F.lit(0)))


def place() -> Column:
    """The place of a row (from 0) within its key, where placed() is joined."""
    return F.col(ROW) - F.col("__first") + F.col("__before")


def positions(df: DataFrame, by: list[str], order: list[Column], name: str = "at", tag: str = "scan", keep: list[str] | None = None) -> DataFrame:
    """`df` (or its columns `keep`) with the place of every row (long, from 0) within its key; without `by`, within the whole table."""
    rows = cut(df, by, order, tag, keep)
    at = joined(rows, placed(rows, by).drop("__n"), by)
    return at.select(*(keep or df.columns), place().alias(name))
