"""Sealing: frozen small objects go to write-once bundles and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.content import signature
from tidemark.functions.paths import artifact_class, bundle_generation, leaf, parse_path, shard_key
from tidemark.functions.status import is_terminal
from tidemark.sources.scratch import written


def seal_plan(objects: DataFrame, ledger: DataFrame, collections: DataFrame, runs: DataFrame) -> DataFrame:
    """path, shard, target of loose objects to seal: `logs` and `state` bundles, or a roll-up.

    Only done entries of complete collections (shard, kind, complete); a run's own document
    only once that run (run_id, status) is final.

    What is told by a path is worked out once and written; the rest are joins on its columns.
    """
    p, name = parse_path(F.col("path")), leaf(F.col("path"))
    kind = artifact_class(F.col("path"))
    target = F.when(kind == "heavy", "logs").when(kind == "state_blob", "state").when(kind == "state_meta", "state-versions.ndjson").when(kind.endswith(".ndjson"), kind)
    done = objects.select("path").join(ledger.filter("status = 'done'").select("path"), "path", "left_semi")
    own = F.when(name == "run.json", p["run_id"])  # a run's own document waits for its run
    told = written(done.select("path", shard_key(F.col("path")).alias("shard"), p["kind"].alias("kind"), own.alias("run_id"), target.alias("target")), "seal")
    rows = _of_complete(told.filter("run_id IS NOT NULL OR target IS NOT NULL"), written(collections.filter("complete").select("shard", "kind").distinct(), "complete"))
    final = runs.filter(is_terminal(F.lit("run"), F.col("status"))).select("run_id")
    ended = rows.filter("run_id IS NOT NULL").join(final, "run_id", "left_semi").select("path", "shard", F.lit("runs.ndjson").alias("target"))
    return rows.filter("run_id IS NULL").select("path", "shard", "target").unionByName(ended)


#: Collections up to which their list is broadcast, and tasks that share one collection's objects where it isn't.
BROADCAST_ROWS, SHARES = 500_000, 64


def _of_complete(rows: DataFrame, complete: DataFrame) -> DataFrame:
    """The rows of collections in complete(shard, kind), a written table; a collection that holds most rows is spread over tasks."""
    if complete.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(complete), ["shard", "kind"], "left_semi")
    dealt = rows.withColumn("share", F.pmod(F.xxhash64("path"), F.lit(SHARES)).cast("int"))
    every = complete.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return dealt.join(every, ["shard", "kind", "share"], "left_semi").drop("share")


def next_generation(names: DataFrame, prefix: str) -> DataFrame:
    """shard, next: one more than the highest generation over bundles and their indexes (shard, name)."""
    return names.groupBy("shard").agg((F.coalesce(F.max(bundle_generation(F.col("name"), prefix)), F.lit(0)) + 1).alias("next"))


def verify_members(members: DataFrame, index: DataFrame) -> DataFrame:
    """name, state of indexed members (name, sha256) against their bytes (name, content): ok, missing or digest_mismatch."""
    found = members.select("name", signature(F.col("content"))["hash"].alias("hash"))
    state = F.when(F.col("hash").isNull(), "missing").when(F.col("hash") != F.col("sha256"), "digest_mismatch").otherwise("ok")
    return index.join(found, "name", "left").select("name", state.alias("state"))


def seal_workspaces(plan: DataFrame, objects: DataFrame, path: str, generation: int) -> DataFrame:
    """Write the planned objects' bytes (path, content) as one generation, read it back, and return path, state of each.

    All workspaces are one job, dealt by shard and a hash of the path, so a
    large workspace is spread too. A run that a crash ended is run again as it was.
    """
    from tidemark.sources.writers import read_generation, write_generation

    rows = plan.join(objects, "path").select("shard", "target", F.col("path").alias("name"), "content", signature(F.col("content"))["hash"].alias("sha256"))
    where = write_generation(rows.repartition("shard", F.pmod(F.xxhash64("name"), F.lit(16))), path, "seal", generation)
    members, index = read_generation(plan.sparkSession, where)
    return verify_members(members.select("name", "content"), index).select(F.col("name").alias("path"), "state")
