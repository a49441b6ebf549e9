"""The audit feed: events after a cursor, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def events_after(events: DataFrame, since, archived: DataFrame) -> DataFrame:
    """Events (id, ts, …) not before `since` and not archived (id); at the cursor itself, only those with an id."""
    late = events.filter((F.col("ts") > since) | ((F.col("ts") == since) & F.col("id").isNotNull()))
    return late.join(archived.select("id").filter("id IS NOT NULL").distinct(), "id", "left_anti")


def audit_increment(events: DataFrame, since, archived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new events, their next cursor and how many): ids are served once; the cursor is the newest event's time."""
    new = events_after(events, since, archived)
    once = new.filter("id IS NOT NULL").dropDuplicates(["id"]).unionByName(new.filter("id IS NULL"))
    return once, once.agg(F.coalesce(F.max("ts"), F.lit(since)).alias("cursor"), F.count(F.lit(1)).alias("n"))
