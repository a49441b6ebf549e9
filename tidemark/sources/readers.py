"""Readers of an archive's physical forms. None infers a schema."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.paths import bundle_generation, is_machinery, leaf, shard_key, stub_target
from tidemark.sources import snapshots
from tidemark.sources.scratch import written

ENTRY = "status string, firstSeen timestamp, fetchedAt timestamp, updatedAt timestamp, lastErrorAt timestamp, lastError string, signature struct<hash:string,size:bigint>, attempts int, transient boolean, derivedChildren array<string>"


def _relative(root: str, column: str = "path"):
    """A file's path below a root, whether or not either has a scheme."""
    bare = re.sub(r"\A[a-z0-9]+:/+", "/", root).rstrip("/")
    return F.regexp_replace(F.regexp_replace(F.col(column), r"\A[a-z0-9]+:/+", "/"), r"\A\Q" + bare + r"\E/", "")


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modificationTime of all files below a folder, without names that Spark's readers pass over. No bytes are read.

    A folder that all executors mount is listed in tasks, level by level, so no
    list comes to the driver; of one in another store Spark's own index is taken, which the driver holds.
    """
    import os

    if re.match(r"(?!file:)[a-z0-9]+:/", root):
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    fields = "path string, folder boolean, length long, modified long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.bool_(), pa.int64(), pa.int64()], strict=True)], [f.split()[0] for f in fields.split(", ")])

        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = []
                with os.scandir(folder) as there:
                    for e in there:
                        passed = e.name.startswith(".") or e.name.startswith("_") and "=" not in e.name and not e.name.startswith(("_metadata", "_common_metadata")) or e.name.endswith("._COPYING_")
                        if not passed:
                            told = e.stat()
                            found.append((e.path, e.is_dir(), told.st_size, told.st_mtime_ns // 1_000_000))
                        if len(found) >= 10_000:
                            yield rows(found)
                            found = []
                yield rows(found)

    tasks = spark.sparkContext.defaultParallelism
    top = re.sub(r"\Afile:/+", "/", root).rstrip("/") or "/"
    level = written(spark.range(1).select(F.lit(top).alias("path")).mapInArrow(run, fields), "listed")
    every = level
    while not (folders := level.filter("folder").select("path")).isEmpty():
        level = written(folders.repartition(tasks).mapInArrow(run, fields), "listed")
        every = every.unionByName(level)
    return every.filter("NOT folder").select("path", "length", F.timestamp_millis("modified").alias("modificationTime"))


def read_loose(spark: SparkSession, root: str) -> DataFrame:
    """path, form, size, mtime of an archive's loose files, machinery left out; stubs have form `stub`. No bytes are read."""
    files = _listed(spark, root)
    rows = files.select(_relative(root).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).filter(~is_machinery(F.col("path")))
    return rows.withColumn("form", F.when(stub_target(F.col("path")).isNotNull(), "stub").otherwise("loose"))


def _lines(spark: SparkSession, path: str, schema: str, names: str | None = None) -> DataFrame:
    """JSON lines with `file` and `ord`; torn and malformed lines are dropped.

    ord puts lines in the order of their batches (see append_rollup; lines of
    none come first), then of their files' modification, then of their names,
    then of their place, so the newest line is defined across files.
    """
    reader = spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE")
    if names:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", names)
    m = F.col("_metadata")
    batch = F.regexp_extract(m["file_path"], r"/batch=(\d+)/[^/]*\z", 1).try_cast("long")
    rows = reader.json(path).select(*[f.split()[0] for f in schema.split(", ")], "_corrupt_record", batch.alias("__batch"), m["file_path"].alias("file"), m["file_modification_time"].alias("__time"), m["file_block_start"].alias("__block"), F.monotonically_increasing_id().alias("__line"))
    return rows.filter("_corrupt_record IS NULL").withColumn("ord", F.struct("__batch", "__time", "file", "__block", "__line")).drop("_corrupt_record", "__batch", "__time", "__block", "__line")


def read_rollups(spark: SparkSession, glob: str) -> DataFrame:
    """path, sha256, content, file, ord of roll-up lines; lines without a path are dropped."""
    return _lines(spark, glob, "path string, sha256 string, content string").filter("path IS NOT NULL AND path <> ''")


def read_sidecars(spark: SparkSession, glob: str, prefix: str = "logs") -> DataFrame:
    """name, bundle, method, size, crc32, sha256, file, ord, gen of bundle members; rows without name or bundle are dropped."""
    rows = _lines(spark, glob, "name string, bundle string, method int, size bigint, crc32 bigint, sha256 string")
    return rows.filter("name <> '' AND bundle <> ''").withColumn("gen", bundle_generation(leaf(F.col("bundle")), prefix))


def read_history(spark: SparkSession, root: str, glob: str = "*.history.ndjson") -> DataFrame:
    """path, ord, fetched_at, sha256, content, deleted of the history files below an archive's root.

    path is that of the object, but for the `.json` that history_path cut: a
    history's name doesn't tell whether there was one.
    """
    rows = _lines(spark, root, "fetchedAt timestamp, sha256 string, content string, deleted boolean", glob)
    path = F.regexp_replace(_relative(root, "file"), r"\.history\.ndjson$", "")
    return rows.filter("fetchedAt IS NOT NULL").select(path.alias("path"), "ord", F.col("fetchedAt").alias("fetched_at"), "sha256", "content", F.coalesce("deleted", F.lit(False)).alias("deleted"))


#: The sections of a snapshot that say something of collections, by what they say.
_COLLECTIONS = {"high_water_mark": "highWaterMarks", "complete": "completedCollections", "settled": "settledCollections"}


def read_ledger(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """(entries, collections) of shard snapshots, each one JSON document.

    An indented document is read by splits, entry by entry, in one pass; one
    without indentation is a line, which a task parses whole. What isn't JSON is left out.
    """
    entry = ", ".join(f.strip().replace(" ", ":", 1) for f in ENTRY.split(", "))
    held, documents = snapshots.members(spark, glob)
    alone = F.concat(F.lit("{"), F.regexp_replace("text", r",\s*\z", ""), F.lit("}"))
    maps = F.from_json("text", f"entries map<string,struct<{entry}>>, " + ", ".join(f"{c} map<string,string>" for c in _COLLECTIONS.values()))
    whole = documents.select(maps.alias("d"))
    rows = held.filter("section = 'entries'").select(F.explode(F.from_json(alone, f"map<string,struct<{entry}>>")).alias("path", "e")).unionByName(whole.select(F.explode("d.entries").alias("path", "e")))
    entries = rows.filter("e IS NOT NULL").select(
        shard_key(F.col("path")).alias("shard"), "path", "e.status", F.col("e.firstSeen").alias("first_seen"), F.col("e.fetchedAt").alias("fetched_at"), F.col("e.updatedAt").alias("updated_at"),
        F.col("e.lastErrorAt").alias("last_error_at"), F.col("e.lastError").alias("last_error"), "e.signature", "e.attempts", "e.transient", F.col("e.derivedChildren").alias("derived_children"),
    )
    told = held.filter(F.col("section").isin(*_COLLECTIONS.values())).select("section", F.explode(F.from_json(alone, "map<string,string>")).alias("prefix", "value"))
    for c in _COLLECTIONS.values():
        told = told.unionByName(whole.select(F.lit(c).alias("section"), F.explode(f"d.{c}").alias("prefix", "value")))
    value = lambda c: F.max(F.when(F.col("section") == _COLLECTIONS[c], F.col("value")))
    flag = lambda c: F.coalesce(value(c) == "true", F.lit(False)).alias(c)
    collections = told.groupBy("prefix").agg(flag("complete"), flag("settled"), F.try_to_timestamp(value("high_water_mark")).alias("high_water_mark"))
    return entries, collections.select(shard_key(F.col("prefix")).alias("shard"), "prefix", "complete", "settled", "high_water_mark")


def read_runs(spark: SparkSession, glob: str) -> DataFrame:
    """shard, last_run_at, run_count and started_at, finished_at, totals, bytes_downloaded of the last run, of shard snapshots (see read_ledger); '' is the organisation's own.

    A field that a snapshot lacks is null, but the number of runs is 0.
    """
    run = {"startedAt": "timestamp", "finishedAt": "timestamp", "totals": "map<string,bigint>", "bytesDownloaded": "bigint"}
    own = "lastRunAt timestamp, runCount bigint"
    schema = f"{own}, lastRun struct<{','.join(f'{k}:{v}' for k, v in run.items())}>"
    pieces = snapshots.read_pieces(spark, glob)
    # The last run is written before all entries, so no split but a document's first holds it.
    held = pieces.filter("kind IN ('field', 'document') OR (kind = 'member' AND section = 'lastRun')")
    bare = F.regexp_replace("text", r",\s*\z", "")
    text = F.when(F.col("kind") == "document", F.col("text")).when(F.col("kind") == "field", F.concat(F.lit("{"), bare, F.lit("}"))).otherwise(F.concat(F.lit('{"lastRun":{'), bare, F.lit("}}")))
    rows = held.select("file", F.from_json(text, schema).alias("d"))
    first = lambda c, name: F.first(c, True).alias(name)
    per = rows.groupBy("file").agg(first("d.lastRunAt", "last_run_at"), F.coalesce(F.first("d.runCount", True), F.lit(0)).alias("run_count"), *[first(f"d.lastRun.{k}", re.sub("([A-Z])", r"_\1", k).lower()) for k in run])
    shard = F.regexp_extract("file", r"((?:projects/[^/]+/(?:workspaces|stacks)/[^/]+)|config-versions)/\.ledger/[^/]+\z", 1)
    return per.withColumn("shard", shard).select("shard", *[c for c in per.columns if c != "file"])


def read_inventory(spark: SparkSession, root: str) -> DataFrame:
    """key, size, md5, sha256 of a mirror's folder; a listing tells no digests."""
    files = _listed(spark, root)
    none = F.lit(None).cast("string")
    return files.select(_relative(root).alias("key"), F.col("length").alias("size"), none.alias("md5"), none.alias("sha256"))


def read_bundle_members(spark: SparkSession, glob: str, limit: int = 1 << 30) -> DataFrame:
    """bundle, name, method, size, content of the members of zip bundles; content is null for members over `limit` bytes."""
    import io
    import zipfile

    fields = "bundle string, name string, method int, size long, content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for m in z.infolist():
                        row = [[bundle], [m.filename], [m.compress_type], [m.file_size], [z.read(m) if m.file_size <= limit else None]]
                        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], [f.split()[0] for f in fields.split(", ")])

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInArrow(run, fields)


def read_audit_pages(spark: SparkSession, glob: str) -> DataFrame:
    """id, ts, cursor, page, body of the events of stored audit pages; cursor and page are parsed from the file's name."""
    docs = spark.read.option("wholetext", True).text(glob).select("value", F.col("_metadata.file_name").alias("file"))
    items = F.try_variant_get(F.try_parse_json("value"), "$.data", "array<variant>")
    rows = docs.select("file", F.explode(items).alias("body"))
    get = lambda k: F.try_variant_get(F.col("body"), k, "string")
    return rows.select(get("$.id").alias("id"), F.try_to_timestamp(get("$.timestamp")).alias("ts"), F.regexp_extract("file", r"\A(.*Z)-p[0-9]+\.json", 1).alias("cursor"), F.regexp_extract("file", r"-p([0-9]+)\.json", 1).try_cast("int").alias("page"), "body")
