"""Incremental walks over newest-first listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.status import status_settled
from tidemark.operators import scan


def _once(listing: DataFrame) -> DataFrame:
    """One row per (collection, id)."""
    return listing.dropDuplicates(["collection", "id"])


def _cut(listing: DataFrame) -> DataFrame:
    """Rows newest first, unknown times last, ties by id; a large collection lies in many parts."""
    return scan.cut(listing, ["collection"], [F.desc_nulls_last("created_at"), F.asc("id")], "walk")


def within_history(listing: DataFrame, count: int | None = None, oldest=None) -> DataFrame:
    """Rows among the first `count` of their collection, or not before `oldest`; repeated ids use one place. Without bounds, all."""
    recent = F.lit(False) if oldest is None else F.coalesce(F.col("created_at") >= oldest, F.lit(False))
    if count is None:
        return _once(listing) if oldest is None else _once(listing).filter(recent)
    rows = _cut(_once(listing))
    return scan.joined(rows, scan.placed(rows, ["collection"]), ["collection"]).filter(recent | (scan.place() < count)).select(listing.columns)


def incremental_walk(listing: DataFrame, ledger: DataFrame, collections: DataFrame, count: int | None = None) -> DataFrame:
    """The rows a run reads, with position `at` and `stops` on the one that ends a walk.

    A walk goes on to its first frozen row: done and final, in a collection that is
    complete and settled with nothing unsettled, with no row above it that isn't final.
    A bound on the count cuts first. listing has collection, id, path, created_at,
    terminal; collections has collection, complete, settled, unsettled.

    A part of a collection tells its first row that isn't final and its first that
    is done and final; of these few rows per collection one gives the stop.
    """
    by, row = ["collection"], F.col(scan.ROW)
    rows = _cut(_once(listing).join(ledger.select("path", "status"), "path", "left"))
    final = F.coalesce("terminal", F.lit(False))
    done = final & F.coalesce(F.col("status") == "done", F.lit(False))
    parts = scan.placed(rows, by, F.min(F.when(~final, row)).alias("live"), F.min(F.when(done, row)).alias("done"))
    allowed = collections.filter("complete AND settled AND NOT unsettled").select("collection", F.lit(True).alias("allowed"))
    live = F.least("live", F.min("live").over(scan.earlier(by)))
    parts = parts.join(allowed, "collection", "left").withColumn("frozen", F.when(F.col("allowed") & (live.isNull() | (F.col("done") < live)), F.col("done")))
    parts = parts.withColumn("stop", F.min("frozen").over(Window.partitionBy(*by))).drop("live", "done", "allowed", "frozen")
    bound = F.lit(True) if count is None else scan.place() < count
    kept = scan.joined(rows, parts, by).filter((F.col("stop").isNull() | (row <= F.col("stop"))) & bound)
    return kept.select("collection", "id", "path", "created_at", "terminal", "status", scan.place().alias("at"), F.coalesce(row == F.col("stop"), F.lit(False)).alias("stops"))


def collection_flags(walk: DataFrame, listing: DataFrame, folded: DataFrame, collections: DataFrame) -> DataFrame:
    """collection, complete, settled after a walk whose outcomes are folded into `folded` (path, status).

    Reaching the end completes a collection for good; it is settled if it stopped or ended
    with every row read final and nothing unsettled. A walk cut by a bound settles nothing.
    """
    read = walk.join(folded.select("path", F.col("status").alias("now")), "path", "left").groupBy("collection").agg(
        F.bool_and("terminal").alias("all_final"), F.bool_and(status_settled(F.col("now"))).alias("all_settled"), F.bool_or("stops").alias("stopped"), F.count(F.lit(1)).alias("n")
    )
    size = listing.select("collection", "id").distinct().groupBy("collection").agg(F.count(F.lit(1)).alias("size"))
    rows = size.join(read, "collection", "left").join(collections.select("collection", F.col("complete").alias("was")), "collection", "left")
    ended = F.coalesce(F.col("n") == F.col("size"), F.lit(False))
    stopped = F.coalesce("stopped", F.lit(False))
    return rows.select("collection", (F.coalesce("was", F.lit(False)) | ended).alias("complete"), F.coalesce((ended | stopped) & F.col("all_final") & F.col("all_settled"), F.lit(False)).alias("settled"))


def stable_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to serve, fetches after which the listing had shrunk) of fetched rows (fetch, pos, id, total).

    Each id is served once, where it came first; rows without id always.
    """
    order = Window.partitionBy("id").orderBy("fetch", "pos")
    first = pages.filter("id IS NOT NULL").withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k")
    totals = pages.filter("total IS NOT NULL").groupBy("fetch").agg(F.max("total").alias("total"))
    # One row per fetch: a listing's pages, not its rows.
    shed = totals.withColumn("lost", F.lag("total").over(Window.orderBy("fetch")) - F.col("total")).filter("lost > 0")
    return first.unionByName(pages.filter("id IS NULL")), shed.select("fetch", "lost")


def newest_first(df: DataFrame, created: str = "created_at", key: str = "id") -> DataFrame:
    """By time, newest first, unknown times last, ties by id."""
    return df.orderBy(F.desc_nulls_last(created), F.asc(key))
