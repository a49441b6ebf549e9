"""Change capture and the history of objects: versions and tombstones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.status import status_settled
from tidemark.operators import scan


def capture_mutable(fresh: DataFrame, current: DataFrame) -> DataFrame:
    """path, action, old_hash of fresh (path, content) against current (path, content): new, changed or unchanged.

    Contents are hashed on their own side; only hashes meet in the join.
    """
    sign = lambda df, name: df.select("path", F.sha2(F.col("content").cast("binary"), 256).alias(name))
    both = sign(fresh, "hash").join(sign(current, "old_hash"), "path", "left")
    action = F.when(F.col("old_hash").isNull(), "new").when(F.col("hash") == F.col("old_hash"), "unchanged").otherwise("changed")
    return both.select("path", action.alias("action"), F.when(action == "changed", F.col("old_hash")).alias("old_hash"))


def superseded(changes: DataFrame, current: DataFrame) -> DataFrame:
    """path, content, old_hash of what a capture replaces: what goes to the objects' history. Contents are joined for changed paths only."""
    changed = changes.filter("action = 'changed'").select("path", "old_hash")
    return current.select("path", "content").join(changed, "path")


def capture_immutable(fresh: DataFrame, ledger: DataFrame) -> DataFrame:
    """path, status of fresh (path, content) whose entry isn't settled: an empty blob doesn't apply."""
    settled = ledger.filter(status_settled(F.col("status"))).select("path")
    empty = F.coalesce(F.octet_length("content"), F.lit(0)) == 0
    return fresh.join(settled, "path", "left_anti").select("path", F.when(empty, "not-applicable").otherwise("done").alias("status"))


def newest_per_path(df: DataFrame, key: str = "path", order: str = "ord") -> DataFrame:
    """The last row of each path, all columns; tasks combine before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__last")).select(*[F.col(c) if c == key else F.col(f"__last.{c}").alias(c) for c in df.columns])


def build_history(observations: DataFrame) -> DataFrame:
    """path, fetched_at, content, deleted: the versions that were superseded and the disappearances.

    observations has path, ord (without ties in a path), at, content; a null content means
    that the object was absent; an empty content, or one that isn't UTF-8, is no version worth keeping and is
    left out. Runs of equal observations are islands; absences before the first content are
    ignored. An absent island is one tombstone, at its first time. A content island is one
    version: at its first time if it follows an absence, else at its last, and left out if
    it is the current one and follows no absence.

    An island's row comes out where it begins or where it ends, so no task needs a whole
    path: a part of one tells its first and last state, which its neighbours begin and end with.
    Only digests are put in order; contents are joined to the versions that are left.
    """
    by, row = ["path"], F.col(scan.ROW)
    worth = F.col("content").isNull() | (F.is_valid_utf8(F.col("content").cast("string")) & (F.octet_length("content") > 0))
    signed = observations.filter(worth).select("path", "ord", "at", F.sha2(F.col("content").cast("binary"), 256).alias("sha"))
    rows = scan.cut(signed, by, [F.asc("ord")], "history")
    state = F.struct("sha")  # without a row it is null, in an absence only its field
    parts = rows.groupBy("path", scan.PART).agg(F.min_by(state, row).alias("first"), F.max_by(state, row).alias("last"), F.min(F.when(F.col("sha").isNotNull(), row)).alias("seen"))
    along = Window.partitionBy("path").orderBy(scan.PART)
    parts = parts.select("path", scan.PART, F.lag("last").over(along).alias("prior"), F.lead("first").over(along).alias("next"), F.min("seen").over(Window.partitionBy("path")).alias("seen"))
    here = Window.partitionBy("path", scan.PART).orderBy(scan.ROW)
    rows = scan.joined(rows, parts, by).filter(row >= F.col("seen"))
    rows = rows.withColumn("before", F.when(row > F.col("seen"), F.coalesce(F.lag(state).over(here), "prior"))).withColumn("after", F.coalesce(F.lead(state).over(here), "next"))
    begins = F.col("before").isNull() | ~F.col("before.sha").eqNullSafe(F.col("sha"))
    rows = rows.withColumn("begins", begins).withColumn("revived", F.when(begins, F.col("before").isNotNull() & F.col("before.sha").isNull()))
    # Whether the island that goes on into a part followed an absence.
    open_ = rows.groupBy("path", scan.PART).agg(F.max_by("revived", F.when(F.col("begins"), row)).alias("revived"))
    open_ = open_.select("path", scan.PART, F.last("revived", True).over(scan.earlier(by)).alias("open"))
    rows = scan.joined(rows, open_, by).withColumn("kept", F.coalesce(F.last("revived", True).over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "open"))
    deleted = F.col("sha").isNull()
    ends = F.col("after").isNotNull() & ~F.col("after.sha").eqNullSafe(F.col("sha"))
    out = rows.filter((F.col("begins") & (deleted | F.col("revived"))) | (ends & ~deleted & ~F.col("kept")))
    gone = out.filter(deleted).select("path", F.col("at").alias("fetched_at"), F.lit(None).cast(observations.schema["content"].dataType).alias("content"), F.lit(True).alias("deleted"))
    held = out.filter(~deleted).select("path", "ord", F.col("at").alias("fetched_at")).join(observations.filter("content IS NOT NULL").select("path", "ord", "content"), ["path", "ord"])
    return held.select("path", "fetched_at", "content", F.lit(False).alias("deleted")).unionByName(gone)


def history_as_of(versions: DataFrame, at) -> DataFrame:
    """path, content at a time, of versions (path, since, content, deleted): the last one not after it, unless a tombstone."""
    last = versions.filter(F.col("since") <= at).groupBy("path").agg(F.max_by(F.struct("content", "deleted"), "since").alias("v"))
    return last.filter("NOT v.deleted").select("path", F.col("v.content").alias("content"))
