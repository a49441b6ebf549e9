"""Registered round trips: tables written in an archive's physical forms and read back, and streams over tables.

A query of this kind writes at once, to a new folder of spark.checkpoint.dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.paths import audit_page_name, bundle_name
from tidemark.operators import sealing
from tidemark.queries import OBJECTS, objects, query, t
from tidemark.shape_queries import ARCHIVE, archive
from tidemark.sources import readers, writers
from tidemark.sources.scratch import fresh_path
from tidemark.streaming import feeds


def _files(spark: SparkSession, files: DataFrame, tag: str) -> str:
    """A new folder with the files (path, content)."""
    where = fresh_path(spark, tag)
    failed = writers.extract_objects(files, where).filter("error IS NOT NULL").count()
    if failed:
        raise OSError(f"{failed} files could not be written")
    return where


@query(f"SELECT path, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE size END AS bytes, CASE WHEN doc_id % 9 = 0 THEN 'unsafe name' END AS error FROM (SELECT doc_id, size, CASE WHEN doc_id % 9 = 0 THEN '../' || path ELSE path END AS path FROM ({OBJECTS}))")
def snk03_extract_objects(spark, d):
    rows = objects(spark, d).select(F.expr("CASE WHEN doc_id % 9 = 0 THEN '../' || path ELSE path END").alias("path"), "content")
    return writers.extract_objects(rows, fresh_path(spark, "extracted"))


@query(f"SELECT path, CASE m WHEN 3 THEN 'stub' ELSE 'loose' END AS form, size FROM ({ARCHIVE}) WHERE NOT (m = 0 OR (m = 1 AND g % 2 = 0) OR (m = 5 AND g % 5 < 2) OR m IN (4, 9))")
def src01_read_loose(spark, d):
    where = _files(spark, archive(spark, d).select("path", "content"), "loose")
    return readers.read_loose(spark, where).select("path", "form", "size")


@query("SELECT 'pages/' || page_id AS key, strlen(html) AS size, CAST(NULL AS VARCHAR) AS md5 FROM pages")
def src06_read_inventory(spark, d):
    where = _files(spark, t(spark, d, "pages").select(F.concat(F.lit("pages/"), "page_id").alias("path"), F.col("html").alias("content")), "mirror")
    return readers.read_inventory(spark, where).select("key", "size", "md5")


@query(f"SELECT path, sha256(content) AS sha256, content FROM ({OBJECTS}) WHERE doc_id % 10 <> 0")
def src02_read_rollups(spark, d):
    """Lines without a path and torn lines are passed over."""
    where = fresh_path(spark, "rollups")
    rows = objects(spark, d).select("doc_id", "path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), "content")
    lines = rows.select(F.when(F.col("doc_id") % 20 == 0, "{torn").otherwise(F.to_json(F.struct(F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("path")).alias("path"), "sha256", "content"))).alias("value"))
    lines.write.text(where)
    return readers.read_rollups(spark, where).select("path", "sha256", "content")


@query(f"SELECT path, content FROM ({OBJECTS})")
def snk02_append_rollup(spark, d):
    """Two appends to one roll-up, the first of which is tried twice."""
    where = fresh_path(spark, "rollup")
    rows = objects(spark, d).select("doc_id", "path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), F.col("content").cast("binary").alias("content"))
    for half in (0, 1, 0):
        writers.append_rollup(rows.filter(F.col("doc_id") % 2 == half), where, half)
    return readers.read_rollups(spark, where).select("path", "content")


@query("SELECT name, bundle, size, gen FROM (SELECT 'm' || l_orderkey || '-' || l_linenumber AS name, printf('logs.gen%04d.zip', l_suppkey) AS bundle, l_partkey AS size, l_suppkey AS gen, l_linenumber FROM lineitem) WHERE l_linenumber <> 7")
def src03_read_sidecars(spark, d):
    where = fresh_path(spark, "sidecars")
    bundle = bundle_name(F.col("l_suppkey"), "logs")
    rows = t(spark, d, "lineitem").select(
        F.concat(F.lit("m"), "l_orderkey", F.lit("-"), "l_linenumber").alias("name"), F.when(F.col("l_linenumber") == 7, "").otherwise(bundle).alias("bundle"), F.lit(8).alias("method"), F.col("l_partkey").alias("size"), F.crc32(F.lit("x").cast("binary")).alias("crc32"), F.lit("h").alias("sha256")
    )
    rows.write.json(where)
    return readers.read_sidecars(spark, where).select("name", "bundle", "size", F.col("gen").cast("long").alias("gen"))


@query("SELECT 'objects/' || conv_id AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, CASE WHEN role <> 'system' THEN role END AS content, role = 'system' AS deleted FROM conversations")
def src04_read_history(spark, d):
    """One history file per object, its lines in order, with a torn one at its end."""
    line = F.when(F.col("role") == "system", F.to_json(F.struct(F.lit("2024-01-01T00:00:00Z").alias("fetchedAt"), F.lit(True).alias("deleted")))).otherwise(F.to_json(F.struct(F.lit("2024-01-01T00:00:00Z").alias("fetchedAt"), F.sha2(F.col("role").cast("binary"), 256).alias("sha256"), F.col("role").alias("content"))))
    each = t(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    files = each.select(F.concat(F.lit("objects/"), "conv_id", F.lit(".history.ndjson")).alias("path"), F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit('\n{"fetchedAt":"2024')).alias("content"))
    found = readers.read_history(spark, _files(spark, files, "history"))
    numbered = found.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("ord", "content", "deleted"))).alias("lines"))
    return numbered.select("path", F.posexplode("lines").alias("k", "x")).select("path", (F.col("k") + 1).cast("long").alias("k"), "x.content", "x.deleted")


@query("SELECT 'projects/p/workspaces/w' || user_id AS shard, 'projects/p/workspaces/w' || user_id || '/' || event_id AS path, event_type AS status, sha256(props) AS hash, event_id AS size FROM events")
def src05_read_ledger(spark, d):
    """One snapshot document per shard, indented or not."""
    folder = F.concat(F.lit("projects/p/workspaces/w"), "user_id")
    entry = F.struct(F.col("event_type").alias("status"), F.struct(F.sha2(F.col("props").cast("binary"), 256).alias("hash"), F.col("event_id").alias("size")).alias("signature"), F.lit(1).alias("attempts"))
    docs = t(spark, d, "events").groupBy(folder.alias("shard")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat(folder, F.lit("/"), "event_id").alias("path"), entry.alias("e")))).alias("entries"))
    doc = F.struct("entries", F.create_map(F.lit("runs"), F.lit(True)).alias("completedCollections"))
    text = F.when(F.length("shard") % 2 == 0, F.to_json(doc)).otherwise(F.to_json(doc, {"pretty": "true"}))
    files = docs.select(F.concat("shard", F.lit("/.ledger/snapshot.json")).alias("path"), text.alias("content"))
    entries, _ = readers.read_ledger(spark, _files(spark, files, "ledger") + "/projects/p/workspaces/*/.ledger/*.json")
    return entries.select("shard", "path", "status", F.col("signature.hash").alias("hash"), F.col("signature.size").alias("size"))


@query("""SELECT 'projects/p/workspaces/w' || user_id AS shard, count(*) AS run_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_run, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started,
  CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN count(*) FILTER (event_type = 'error') END AS errored FROM events GROUP BY user_id""")
def src05_read_runs(spark, d):
    """The runs that snapshot documents tell of, indented or not."""
    at, error = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.count_if(F.col("event_type") == "error")
    per = t(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("runCount"), error.alias("errors"))
    totals = F.when(F.col("errors") > 0, F.create_map(F.lit("errored"), "errors"))
    run = F.struct(at(F.col("first")).alias("startedAt"), totals.alias("totals"))
    entries = F.create_map(F.lit("p"), F.struct(F.lit("done").alias("status"))).alias("entries")
    doc = F.struct(at(F.col("last")).alias("lastRunAt"), run.alias("lastRun"), entries, F.lit(2).alias("version"), "runCount")
    text = F.when(F.col("user_id") % 2 == 0, F.to_json(doc)).otherwise(F.to_json(doc, {"pretty": "true"}))
    files = per.select(F.concat(F.lit("projects/p/workspaces/w"), "user_id", F.lit("/.ledger/snapshot.json")).alias("path"), text.alias("content"))
    found = readers.read_runs(spark, _files(spark, files, "runs") + "/projects/p/workspaces/*/.ledger/*.json")
    cell = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return found.select("shard", "run_count", cell("last_run_at").alias("last_run"), cell("started_at").alias("started"), F.try_element_at("totals", F.lit("errored")).alias("errored"))


@query("SELECT CAST(event_id AS VARCHAR) AS id, event_id // 500 AS page, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, '20240101T000000.000000000Z' AS cursor FROM events")
def src08_read_audit_pages(spark, d):
    """Pages of 500 events, each a document named by the cursor and its number."""
    event = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")))
    pages = t(spark, d, "events").groupBy(F.expr("event_id DIV 500").alias("page")).agg(F.concat(F.lit('{"data":['), F.array_join(F.sort_array(F.collect_list(event)), ","), F.lit("]}")).alias("content"))
    files = pages.select(F.concat(F.lit("audit/"), audit_page_name(F.lit("2024-01-01").cast("timestamp"), F.col("page"))).alias("path"), "content")
    found = readers.read_audit_pages(spark, _files(spark, files, "audit") + "/audit/*.json")
    return found.select("id", F.col("page").cast("long").alias("page"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "cursor")


@query("SELECT CAST(doc_id AS VARCHAR) AS name, sha256(text) AS sha256, strlen(text) AS size FROM documents")
def snk01_write_generation(spark, d):
    """The index of a generation, joined with the bytes it was written with."""
    docs = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.col("text").cast("binary").alias("content"))
    where = writers.write_generation(docs, fresh_path(spark, "generation"), "logs", 1)
    members, index = writers.read_generation(spark, where)
    return index.select("name", "sha256").join(members.select("name", F.octet_length("content").cast("long").alias("size")), "name")


@query(f"SELECT path, org, 'loose' AS form, size, doc_id % 2 = 0 AS offloaded FROM ({OBJECTS})")
def snk04_listing_json(spark, d):
    where = fresh_path(spark, "listing")
    none = F.lit(None).cast("string")
    writers.write_listing_json(objects(spark, d).select("path", "org", F.lit("loose").alias("form"), none.alias("container"), F.lit("2024-01-01").cast("timestamp").alias("mtime"), "size", (F.col("doc_id") % 2 == 0).alias("offloaded")), where)
    return spark.read.schema("path string, org string, form string, size long, offloaded boolean").json(where)


@query(f"SELECT path, 'ok' AS state FROM ({ARCHIVE}) WHERE m IN (6, 7) AND g % 2 = 0")
def seal02_seal_workspaces(spark, d):
    """Runs' logs and states sealed, read back and verified."""
    rows = archive(spark, d).filter("m IN (6, 7)")
    led = rows.filter("g % 2 = 0").select("path", F.lit("done").alias("status"))
    kinds = F.explode(F.array(F.lit("runs"), F.lit("state-versions"))).alias("kind")
    plan = sealing.seal_plan(rows, led, rows.select(F.col("b").alias("shard"), kinds, F.lit(True).alias("complete")).distinct(), rows.limit(0).select(F.lit("").alias("run_id"), F.lit("").alias("status")))
    return sealing.seal_workspaces(plan, rows.select("path", F.col("content").cast("binary").alias("content")), fresh_path(spark, "sealed"), 1)


_SINCE = "TIMESTAMP '2024-01-05 00:00:00'"
_KEY = "CASE WHEN event_id % 13 <> 0 THEN 'e' || (event_id - event_id % 3) END"


@query(f"""SELECT {_KEY} AS id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day FROM events WHERE {_KEY} IS NOT NULL AND date_trunc('day', ts) >= {_SINCE} GROUP BY 1, 2
  UNION ALL SELECT NULL, strftime(date_trunc('day', ts), '%Y-%m-%d') FROM events WHERE {_KEY} IS NULL AND date_trunc('day', ts) > {_SINCE}""")
def str02_audit_stream(spark, d):
    """The feed as a stream in two batches, the second of which brings the first's events again: ids once, events without one all kept but at the cursor."""
    src, out, kept = (fresh_path(spark, x) for x in ("events", "feed", "feed-state"))
    events = t(spark, d, "events")
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    for part in (events.filter("ts < '2024-01-16'"), events):
        part.write.mode("append").parquet(src)
        stream = spark.readStream.schema(events.schema).parquet(src)
        # An id stands for one time here, as it does in the feed: ids that span two days are told apart by the day.
        rows = stream.select(F.expr(_KEY).alias("key"), day.alias("ts")).select(F.concat("key", F.lit("@"), F.date_format("ts", "yyyy-MM-dd")).alias("id"), "ts")
        feeds.audit_stream(rows, out, kept, F.lit("2024-01-05").cast("timestamp")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/events").select(F.substring_index("id", "@", 1).alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("""WITH h AS (SELECT conv_id, arg_max(role, turn) FILTER (turn < 2) AS a, arg_max(role, turn) FILTER (turn >= 2) AS b FROM conversations GROUP BY 1)
  SELECT 'c' || conv_id AS path, 0 AS batch, 'new' AS action FROM h WHERE a IS NOT NULL
  UNION ALL SELECT 'c' || conv_id, 1, CASE WHEN a IS NULL THEN 'new' ELSE 'changed' END FROM h WHERE b IS NOT NULL AND a IS DISTINCT FROM b""")
def str03_capture_stream(spark, d):
    """Two batches of observations; the second's changes are against what the first left."""
    src, out, kept = (fresh_path(spark, x) for x in ("observed", "changes", "capture"))
    rows = t(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("path"), F.col("turn").alias("ord"), F.col("role").alias("content"))
    for part in ("ord < 2", "ord >= 2"):
        rows.filter(part).write.mode("append").parquet(src)
        stream = spark.readStream.schema(rows.schema).parquet(src)
        feeds.capture_stream(stream, out, kept).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("path", F.col("batch").cast("int").alias("batch"), "action")
