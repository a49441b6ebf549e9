"""The audit feed and change capture as streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.audit import events_after


def audit_stream(events: DataFrame, folder: str, checkpoint: str, since=None) -> DataStreamWriter:
    """The stream's new events (id, ts, ...), each batch's under `folder`/events/batch=N, and its next cursor (cursor, n) under `folder`/cursor/batch=N.

    A batch continues at the cursor that the one before it left: what is older
    is left out, and so is what was served at the very time of the cursor, which
    its ids tell; events without an id are kept if they are later. Within a batch
    an id is served once. However late a repeat comes, it is not served again.

    What is kept between batches is the cursor and the ids at it, which a later
    cursor drops. A batch's files are written over when it is repeated, its
    cursor last, so a restart goes on from what the last complete batch left.
    Without `since` (a time or a column) the feed begins with its first event.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        at = lambda kind, n: f"{folder}/{kind}/batch={n}"
        start, known = since, None
        if number:
            start, known = spark.read.parquet(at("cursor", number - 1)).first().cursor, spark.read.parquet(at("boundary", number - 1))
        none = df.select("id").limit(0)
        new = df if start is None else events_after(df, F.lit(start), none if known is None else known)
        new.filter("id IS NOT NULL").dropDuplicates(["id"]).unionByName(new.filter("id IS NULL"), allowMissingColumns=False).write.mode("overwrite").parquet(at("events", number))
        served = spark.read.schema(df.schema).parquet(at("events", number))
        found = served.agg(F.max("ts").alias("cursor"), F.count(F.lit(1)).alias("n")).select(F.greatest("cursor", F.lit(start)).alias("cursor") if start is not None else "cursor", "n")
        now = found.first().cursor
        ids = served.filter((F.col("ts") == F.lit(now)) & F.col("id").isNotNull()).select("id") if now is not None else none
        if known is not None and now == start:
            ids = ids.unionByName(known)
        ids.write.mode("overwrite").parquet(at("boundary", number))
        found.coalesce(1).write.mode("overwrite").parquet(at("cursor", number))

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def keyed_state(spark: SparkSession) -> None:
    """Keyed state needs a store that keeps more than memory holds and whose checkpoints hold what a batch changed: RocksDB with a change log, unless the session names a store."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    default = "HDFSBackedStateStoreProvider"
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", default).endswith(default):
        for name, value in wanted.items():
            spark.conf.set(name, value)


class _LastHash(StatefulProcessor):
    """Keeps the hash of a path's newest content; a batch's newest observation is compared with it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hash string")

    def handleInitialState(self, key: Any, initialState: Any, timerValues: Any) -> None:
        self.last.update((initialState.hash,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        newest = max(((r.ord is not None, r.ord, r.hash is not None, r.hash) for r in rows), key=lambda x: (x[0], x[1] or 0, x[2], x[3] or ""))[3]
        there = self.last.exists()
        before = self.last.get()[0] if there else None
        if there and before == newest:
            return
        self.last.update((newest,))
        yield Row(path=key[0], action="changed" if there else "new", old_hash=before, hash=newest)

    def close(self) -> None:
        pass


def capture_changes(stream: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """path, action (new or changed), old_hash, hash: what each batch of (path, ord, content) changes.

    The newest observation of a path in a batch (by ord, nulls first; ties by
    hash) is compared with the hash that keyed state holds for it; only hashes
    reach the state, one per path, and a batch reads and writes those of its own
    paths. known(path, hash) are the objects that a new stream begins with. An
    absent content (null) has a null hash.
    """
    keyed_state(stream.sparkSession)
    signed = stream.select("path", F.col("ord").cast("long").alias("ord"), F.sha2(F.col("content").cast("binary"), 256).alias("hash"))
    first = None if known is None else known.select("path", "hash").groupBy("path")
    return signed.groupBy("path").transformWithState(_LastHash(), "path string, action string, old_hash string, hash string", "Update", "None", first)


def capture_stream(stream: DataFrame, changes_path: str, checkpoint: str, known: DataFrame | None = None) -> DataStreamWriter:
    """capture_changes with each batch's rows under `changes_path`/batch=N; a batch that is repeated writes the same rows over its first ones."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{changes_path}/batch={number}")

    return capture_changes(stream, known).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
