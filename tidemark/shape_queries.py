"""Registered queries on an archive of every shape of path, made from `documents`, and on JSON documents made from other tables.

Paths and documents are SQL text that Spark and DuckDB read alike; what is
expected of them is told from the numbers they are made of, never from the path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import content as fc
from tidemark.functions import paths as fp
from tidemark.functions import status as fs
from tidemark.operators import ledger, listing, reconcile, refs, sealing
from tidemark.plans import reports
from tidemark.queries import OBJECTS, objects, query, t

_G = "CAST(floor(doc_id / 10) AS BIGINT)"
_B = f"'projects/p' || ({_G} % 3) || '/workspaces/w' || {_G}"
_ZIP = "b || '/bundles/logs.gen' || lpad(CAST(g AS STRING), 7, '0') || '.zip'"
#: Ten shapes of path by m, the last digit of doc_id; g, the rest, numbers the workspace b.
_SHAPE = f"""CASE m
  WHEN 0 THEN {_ZIP}
  WHEN 1 THEN CASE WHEN g % 2 = 0 THEN {_ZIP} || '.sidecar.ndjson' ELSE b || '/runs/r' || doc_id || '/run.json' END
  WHEN 2 THEN 'config-versions/cv-' || doc_id || '.tar.gz'
  WHEN 3 THEN 'config-versions/cv-' || doc_id || '.tar.gz.remote.json'
  WHEN 4 THEN b || '/.ledger/' || CASE g % 3 WHEN 0 THEN 'lock' WHEN 1 THEN 'log.ndjson' ELSE 'snapshot.json' END
  WHEN 5 THEN CASE WHEN g % 5 < 2 THEN b || '/rollups/runs.ndjson' ELSE b || '/variables.json' END
  WHEN 6 THEN b || '/runs/r' || doc_id || '/plan.log'
  WHEN 7 THEN b || '/state-versions/20240101T000000Z-sv-' || doc_id || CASE g % 3 WHEN 0 THEN '.meta.json' WHEN 1 THEN '.tfstate.json' ELSE '.json' END
  WHEN 8 THEN 'teams/t' || doc_id || '/team.json'
  ELSE b || '/.atomicfile-' || doc_id || '.tmp' END"""

ARCHIVE = f"SELECT doc_id, m, g, b, content, size, {_SHAPE} AS path FROM (SELECT doc_id, text AS content, strlen(text) AS size, doc_id % 10 AS m, {_G} AS g, {_B} AS b FROM documents)"
# What the shapes are, told from m and g.
_SEALED = "(m = 0 OR (m = 1 AND g % 2 = 0) OR (m = 5 AND g % 5 < 2))"
_ELIGIBLE = "NOT (m IN (3, 9) OR (m = 4 AND g % 3 < 2))"
_LOCAL = "(g + m) % 3 <> 0"


def archive(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, m, g, b, content, size, path."""
    base = t(spark, d, "documents").selectExpr("doc_id", "text AS content", "CAST(octet_length(text) AS BIGINT) AS size", "doc_id % 10 AS m", f"{_G} AS g", f"{_B} AS b")
    return base.selectExpr("doc_id", "m", "g", "b", "content", "size", f"{_SHAPE} AS path")


def _signed(spark, d):
    """The archive's files with their digests, without their bytes."""
    raw = F.col("content").cast("binary")
    return archive(spark, d).select("doc_id", "m", "g", "b", "path", "size", F.md5(raw).alias("md5"), F.sha2(raw, 256).alias("sha256"))


def _tarball_ledger(spark, d):
    """Of four tarballs one is recorded rightly, one with another size, one errored, one not at all."""
    rows = _signed(spark, d).filter("m = 2 AND g % 4 < 3")
    status = F.when(F.col("g") % 4 == 2, "errored").otherwise("done")
    return rows.select("path", status.alias("status"), F.struct(F.col("sha256").alias("hash"), (F.col("size") + (F.col("g") % 4 == 1).cast("int")).alias("size")).alias("signature"))


@query(f"""SELECT path, {_SEALED} OR m IN (4, 9) AS machinery, {_SEALED} AS sealed, m = 0 AS zip, m = 1 AND g % 2 = 0 AS sidecar, m = 2 AS tarball,
  CASE WHEN m = 3 THEN 'config-versions/cv-' || doc_id || '.tar.gz' END AS stub FROM ({ARCHIVE})""")
def sc13_shapes(spark, d):
    p = F.col("path")
    return archive(spark, d).select("path", fp.is_machinery(p).alias("machinery"), fp.in_sealed_form(p).alias("sealed"), fp.is_bundle_zip(p).alias("zip"), fp.is_bundle_sidecar(p).alias("sidecar"), fp.is_config_tarball(p).alias("tarball"), fp.stub_target(p).alias("stub"))


@query(f"""SELECT path, {_ELIGIBLE} AS eligible, {_ELIGIBLE} AND m NOT IN (0, 2) AS restorable, m IN (0, 2) AS evicted, m IN (3, 8) AS eager, m IN (0, 4) AS boundary FROM ({ARCHIVE})""")
def fil06_scopes(spark, d):
    p = F.col("path")
    return archive(spark, d).select(
        "path", reconcile.sync_eligible(p).alias("eligible"), reconcile.restorable(p).alias("restorable"), reconcile.evicted_surface(p).alias("evicted"), reconcile.eager_scope(p).alias("eager"), reconcile.seal_boundary_skip(p).alias("boundary")
    )


@query(f"""SELECT path, CASE m WHEN 2 THEN 'cv-' || doc_id WHEN 6 THEN 'plan' WHEN 7 THEN '20240101T000000Z-sv-' || doc_id ELSE 'team' END AS stem,
  CASE m WHEN 6 THEN 'heavy' WHEN 7 THEN CASE g % 3 WHEN 0 THEN 'state_meta' ELSE 'state_blob' END ELSE 'other' END AS class FROM ({ARCHIVE}) WHERE m IN (2, 6, 7, 8)""")
def sc03_stems(spark, d):
    p = F.col("path")
    return archive(spark, d).filter("m IN (2, 6, 7, 8)").select("path", fp.parse_path(p)["stem"].alias("stem"), fp.artifact_class(p).alias("class"))


@query(f"""SELECT path, CASE WHEN NOT ({_ELIGIBLE}) THEN 'skip' WHEN m = 0 THEN CASE WHEN g % 2 = 0 THEN 'evict' ELSE 'skip' END
  WHEN m = 2 THEN CASE g % 4 WHEN 0 THEN 'evict' WHEN 1 THEN 'suspect' ELSE 'skip' END ELSE 'sync' END AS action FROM ({ARCHIVE})""")
def jn04_classify_sync(spark, d):
    return reconcile.classify_sync(archive(spark, d).select("path", "size"), _tarball_ledger(spark, d))


_PRUNED = f"""WITH a AS ({ARCHIVE}), kept AS (SELECT * FROM a WHERE {_LOCAL}), sealed AS (SELECT DISTINCT b FROM kept WHERE {_SEALED}),
  stale AS (SELECT path AS key, CASE WHEN NOT ({_ELIGIBLE}) THEN 'ineligible' WHEN m IN (5, 6, 7) AND g % 2 = 0 AND (b IN (SELECT b FROM sealed) OR g % 3 = 2) THEN 'reshaped'
    WHEN m NOT IN (3, 8) AND g % 7 = 3 THEN 'shard-lost' ELSE 'unbacked' END AS class FROM a WHERE (NOT ({_LOCAL}) OR NOT ({_ELIGIBLE})) AND m NOT IN (0, 2) AND NOT (m = 1 AND g % 2 = 0)),
  counts AS (SELECT (SELECT count(*) FROM stale WHERE class = 'unbacked') AS unbacked, (SELECT count(*) FROM kept WHERE {_ELIGIBLE}) AS matched),
  pruned AS (SELECT key, class, CASE WHEN class = 'shard-lost' OR (class = 'unbacked' AND unbacked > 100 AND unbacked > matched) THEN 'refuse' ELSE 'prune' END AS action FROM stale, counts)"""


def _pruned(spark, d):
    """A mirror of the whole archive, two thirds of it local, some of it known, some shards lost, and one project renamed."""
    rows = _signed(spark, d)
    known = rows.filter("m IN (5, 6, 7) AND g % 2 = 0").select("path", F.lit("done").alias("status"), F.lit(None).cast("struct<hash:string,size:bigint>").alias("signature"))
    lost = rows.filter("g % 7 = 3").select(F.col("b").alias("shard")).distinct()
    former = rows.filter("g % 3 = 2").select(F.lit("projects/p2").alias("former")).distinct()
    return rows, rows.filter(_LOCAL), known, lost, former


@query(f"{_PRUNED} SELECT key, class, action FROM pruned")
def jn05_prune_plan(spark, d):
    rows, local, known, lost, former = _pruned(spark, d)
    return reconcile.prune_plan(rows.select(F.col("path").alias("key")), local, known, lost, former)


_MIRROR = "CASE WHEN g % 5 = 0 THEN size + 1 ELSE size END AS there, g % 2 <> 0 AS has_sha, g % 3 <> 0 AS has_md5, g % 7 = 0 AS altered"


def _mirrored(rows):
    """A mirror in which sizes, digests and what digests there are differ by workspace."""
    g = F.col("g")
    other = F.lit("other")
    return rows.select(F.col("path").alias("key"), (F.col("size") + (g % 5 == 0).cast("int")).alias("size"), F.when(g % 3 != 0, F.when(g % 7 == 0, other).otherwise(F.col("md5"))).alias("md5"), F.when(g % 2 != 0, F.when(g % 7 == 0, other).otherwise(F.col("sha256"))).alias("sha256"))


@query(f"""SELECT path, CASE WHEN NOT ({_LOCAL}) THEN 'create' WHEN there <> size THEN 'replace' WHEN (has_sha OR has_md5) AND altered THEN 'replace' ELSE 'skip' END AS action,
  CASE WHEN NOT ({_LOCAL}) THEN 'missing' WHEN there <> size THEN 'size' WHEN has_sha THEN 'sha256' WHEN has_md5 THEN 'md5' ELSE 'size only' END AS reason
  FROM (SELECT *, {_MIRROR} FROM ({ARCHIVE})) WHERE {_ELIGIBLE} AND m NOT IN (0, 2)""")
def jn08_restore_plan(spark, d):
    rows = _signed(spark, d)
    return reconcile.restore_plan(_mirrored(rows), rows.filter(_LOCAL).select("path", "size", "md5", "sha256"))


@query("""SELECT c_custkey AS org, CASE c_custkey % 6 WHEN 5 THEN 'projects/p/workspaces/w' ELSE '' END AS shard,
  CASE c_custkey % 6 WHEN 0 THEN 'create' WHEN 1 THEN 'replace' WHEN 2 THEN 'skip' ELSE 'refuse' END AS action FROM customer""")
def jn09_snapshot_conflict(spark, d):
    k = F.col("c_custkey")
    shard = F.when(k % 6 == 5, "projects/p/workspaces/w").otherwise("")
    c = t(spark, d, "customer").select(k.alias("org"), shard.alias("shard"), k.alias("last_run_at"), F.col("c_nationkey").alias("run_count"))
    # A later run with as many, an earlier one, the same, a later one with fewer, a later one of a shard that can't be ordered.
    at = F.col("last_run_at") + F.when(F.col("org") % 6 == 2, -1).when(F.col("org") % 6 == 3, 0).otherwise(1)
    m = c.select("org", "shard", at.alias("last_run_at"), (F.col("run_count") - (F.col("org") % 6 == 4).cast("int")).alias("run_count"))
    return reconcile.snapshot_conflict(c.filter("org % 6 <> 0"), m)


@query(f"SELECT path AS key FROM ({ARCHIVE}) WHERE NOT ({_ELIGIBLE}) OR (m = 0 AND g % 2 = 1)")
def jn10_mirror_leftovers(spark, d):
    rows = archive(spark, d)
    return reconcile.mirror_leftovers(rows.select(F.col("path").alias("key")), rows.filter(_LOCAL).select("path"))


_KEPT_ACTION = f"""CASE WHEN NOT ({_ELIGIBLE}) THEN 'skip' WHEN m = 0 AND (g % 2 = 1 OR (g + 1) % 3 = 0) THEN 'skip' WHEN m = 2 AND g % 4 > 1 THEN 'skip' WHEN m = 2 AND g % 4 = 1 THEN 'suspect'
  WHEN there <> size OR (has_md5 AND altered) THEN 'upload' WHEN m IN (0, 2) THEN 'evict' ELSE 'keep' END"""


@query(f"{_PRUNED} SELECT path, {_KEPT_ACTION} AS action FROM (SELECT *, {_MIRROR} FROM kept) UNION ALL SELECT key, action FROM pruned")
def seal05_sync_plan(spark, d):
    rows, local, known, lost, former = _pruned(spark, d)
    return reconcile.sync_plan(local, known.unionByName(_tarball_ledger(spark, d)), _mirrored(rows), lost, former)


@query(f"""SELECT path, there = size AND NOT altered AND (has_sha OR has_md5) AS safe_to_drop FROM (SELECT *, {_MIRROR} FROM ({ARCHIVE})) WHERE (m = 0 AND g % 2 = 0) OR (m = 2 AND g % 4 = 0)""")
def seal04_eviction_plan(spark, d):
    rows = _signed(spark, d)
    return reconcile.eviction_plan(rows.select("path", "size", "md5", "sha256"), _tarball_ledger(spark, d), _mirrored(rows))


@query(f"SELECT path, b AS shard, CASE g % 3 WHEN 0 THEN 'state-versions.ndjson' ELSE 'state' END AS target FROM ({ARCHIVE}) WHERE m = 7 AND g % 2 = 0 AND g % 5 <> 0")
def seal01_seal_states(spark, d):
    rows = archive(spark, d)
    led = rows.filter("g % 2 = 0").select("path", F.lit("done").alias("status"))
    cols = rows.select(F.col("b").alias("shard"), F.lit("state-versions").alias("kind"), (F.col("g") % 5 != 0).alias("complete")).distinct()
    return sealing.seal_plan(rows, led, cols, rows.limit(0).select(F.lit("").alias("run_id"), F.lit("").alias("status")))


_STATUS4 = "CASE doc_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'errored' WHEN 2 THEN 'absent' ELSE 'forbidden' END"


@query(f"""SELECT prefix, count(*) FILTER (status = 'done') AS n_done, count(*) FILTER (status = 'errored') AS n_errored, coalesce(bool_or(status IN ('errored', 'forbidden')), false) AS has_unsettled, coalesce(bool_or(status = 'absent'), false) AS has_absent
  FROM (SELECT DISTINCT b AS prefix FROM ({ARCHIVE})) LEFT JOIN (SELECT path, {_STATUS4} AS status FROM ({ARCHIVE})) ON path LIKE prefix || '/%' GROUP BY prefix""")
def fil08_under_workspaces(spark, d):
    rows = archive(spark, d)
    return ledger.under(rows.select("path", F.expr(_STATUS4).alias("status")), rows.select(F.col("b").alias("prefix")))


@query(f"""SELECT 'p' || (g % 3) AS org, CAST(m AS STRING) AS surface, count(*) FILTER (s = 'done') AS archived, count(*) FILTER (s = 'absent') AS absent, count(*) FILTER (s = 'forbidden') AS forbidden, count(*) FILTER (s = 'errored') AS errored, count(*) FILTER (s IS NULL) AS missing
  FROM (SELECT *, CASE WHEN g % 5 <> 4 THEN {_STATUS4} END AS s FROM ({ARCHIVE})) GROUP BY 1, 2""")
def agg12_surfaces(spark, d):
    rows = archive(spark, d)
    surfaces = rows.selectExpr("'p' || (g % 3) AS org", "CAST(m AS STRING) AS surface", "path")
    return ledger.surface_coverage(surfaces, rows.filter("g % 5 <> 4").select("path", F.expr(_STATUS4).alias("status")))


@query(f"SELECT 'cv-' || doc_id || CASE m WHEN 2 THEN '.tar.gz' ELSE '.tar.gz.remote.json' END AS name, false AS dir, size, doc_id % 4 = 0 AS remote FROM ({ARCHIVE}) WHERE m IN (2, 3)")
def agg09_tree_files(spark, d):
    return listing.tree_children(archive(spark, d).select("path", "size", (F.col("doc_id") % 4 == 0).alias("offloaded")), "config-versions")


# Paths that a cleaning changes.
_MESSY = "'/x/../' || source || '/./' || lang || '//' || doc_id || CASE doc_id % 4 WHEN 0 THEN '/..' WHEN 1 THEN '/../../../../z' WHEN 2 THEN '/' ELSE '' END"


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || '/' || lang WHEN 1 THEN 'z' ELSE source || '/' || lang || '/' || doc_id END AS path FROM documents")
def sc08_confine(spark, d):
    return t(spark, d, "documents").select("doc_id", fp.confine(F.expr(_MESSY)).alias("path"))


_STATUSES = list(fs.STATUSES) + ["other"]


@query("SELECT event_id, " + ", ".join(f"event_id % 10 IN ({', '.join(str(i) for i in where)}) AS {name}" for name, where in (("settled", (0, 1, 2, 3, 4, 5)), ("gate", (4, 5, 8)), ("valid", range(9)))) + " FROM events")
def sc16_statuses(spark, d):
    s = F.element_at(F.array(*[F.lit(x) for x in _STATUSES]), (F.col("event_id") % 10 + 1).cast("int"))
    return t(spark, d, "events").select("event_id", fs.status_settled(s).alias("settled"), fs.status_gate(s).alias("gate"), fs.status_valid(s).alias("valid"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '(sensitive)' ELSE coalesce(CASE WHEN event_id % 5 <> 0 THEN props END, '') END AS value FROM events")
def sc20_redacted(spark, d):
    i = F.col("event_id")
    return t(spark, d, "events").select("event_id", fc.redact_variable(F.when(i % 3 == 0, True).when(i % 3 == 1, False), F.when(i % 5 != 0, F.col("props"))).alias("value"))


_VERSION = "p_size || '.' || (p_partkey % 13) || '.0' || CASE p_partkey % 3 WHEN 0 THEN '-rc.' || (p_partkey % 11) ELSE '' END"


@query(f"""SELECT brand, version, prerelease FROM (SELECT p_brand AS brand, {_VERSION} AS version, p_partkey % 3 = 0 AS prerelease,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey % 13 DESC, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END DESC, p_partkey % 11 DESC) AS k FROM part) WHERE k = 1""")
def sc22_newest_version(spark, d):
    v = F.expr(_VERSION)
    best = t(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.max_by(v, fc.semver_key(v)).alias("version"))
    return best.select("brand", "version", fc.is_prerelease(F.col("version")).alias("prerelease"))


_SOURCE = "CASE page_id % 6 WHEN 0 THEN 'pol-' || page_id || '.sentinel' WHEN 1 THEN 'pol-' || page_id || '.20240101T000000Z.rego' WHEN 2 THEN 'pol-' || page_id || '.tf' WHEN 3 THEN 'pol-' || page_id || '.json' WHEN 4 THEN page_id || '.x.policy' ELSE 'pol-' || page_id || '.rego' END"


@query("SELECT page_id, CASE WHEN page_id % 6 IN (0, 2, 5) THEN 'pol-' || page_id WHEN page_id % 6 = 4 THEN page_id || '.x' END AS policy FROM pages")
def sc23_policy_sources(spark, d):
    return t(spark, d, "pages").select("page_id", fp.policy_source_id(F.expr(_SOURCE)).alias("policy"))


@query("""SELECT path, status, CASE WHEN page_id % 5 <> 0 AND page_id % 6 IN (0, 2, 5) AND page_id % 4 <> 0 THEN '2024-01-' || lpad(CAST(page_id % 28 + 1 AS STRING), 2, '0') END AS updated FROM
  (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'audit/20240101T000000.000000000Z-p' || lpad(CAST(page_id AS STRING), 9, '0') || '.json' ELSE 'policies/' || """ + _SOURCE + """ END AS path,
  CASE WHEN page_id % 5 = 0 AND page_id % 7 = 0 THEN 'errored' WHEN page_id % 5 = 0 THEN 'absent' ELSE 'done' END AS status FROM pages WHERE page_id % 7 <> 0 OR page_id % 5 = 0)""")
def cdc09_migrate_entries(spark, d):
    p = t(spark, d, "pages").filter("page_id % 7 <> 0 OR page_id % 5 = 0")
    i = F.col("page_id")
    path = F.when(i % 7 == 0, F.concat(F.lit("audit/20240101T000000.000000000Z-p"), F.lpad(i.cast("string"), 9, "0"), F.lit(".json"))).otherwise(F.concat(F.lit("policies/"), F.expr(_SOURCE)))
    led = p.select(path.alias("path"), F.when(i % 5 == 0, "absent").otherwise("done").alias("status"), F.lit(None).cast("date").alias("updated_at"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (i % 28).cast("int"))
    policies = t(spark, d, "pages").filter("page_id % 4 <> 0").select(F.when(i % 6 == 4, F.concat(i, F.lit(".y"))).otherwise(F.concat(F.lit("pol-"), i)).alias("id"), day.alias("updated_at"))
    return ledger.migrate_entries(led, policies).select("path", "status", F.col("updated_at").cast("string").alias("updated"))


@query("SELECT page_id, length(html) AS size FROM pages WHERE page_id % 4 = 1 AND page_id % 3 <> 0")
def fil10_valid_stubs(spark, d):
    i = F.col("page_id")
    rows = t(spark, d, "pages").select("page_id", F.concat(F.when(i % 3 == 0, "a/../").otherwise("config-versions/"), i).alias("path"), (i % 4).alias("version"), F.length("html").cast("long").alias("size"), F.lit("h").alias("sha256"))
    return listing.valid_stubs(rows).select("page_id", "size")


@query(f"SELECT path, spelling, depth FROM (SELECT path, path AS spelling, 0 AS depth FROM ({OBJECTS}) UNION ALL SELECT path, replace(path, 'projects/src1/', 'projects/old1/'), 1 FROM ({OBJECTS}) WHERE path LIKE 'projects/src1/%' UNION ALL SELECT path, replace(path, 'projects/src1/', 'projects/older1/'), 2 FROM ({OBJECTS}) WHERE path LIKE 'projects/src1/%')")
def jn07_alias_rewrites(spark, d):
    rows = objects(spark, d)
    name = lambda x: F.concat(F.lit("projects/"), F.lit(x), F.col("n"))
    one = rows.filter("org = 'src1'").select(F.regexp_extract("org", "([0-9]+)", 1).alias("n")).distinct()
    aliases = one.select(name("src").alias("current"), name("old").alias("former")).unionByName(one.select(name("old").alias("current"), name("older").alias("former")))
    return reconcile.alias_rewrites(rows.select("path"), aliases)


@query("SELECT 'c' || c_custkey AS path, c_custkey % 5 > 1 AND c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AS skip FROM customer")
def jn14_skippable_listings(spark, d):
    k = F.col("c_custkey")
    c = t(spark, d, "customer")
    own, kid = F.concat(F.lit("c"), k), F.concat(F.lit("k"), k)
    none = F.array().cast("array<string>")
    led = c.filter(k % 5 != 0).select(own.alias("path"), F.when(k % 5 == 1, "errored").otherwise("done").alias("status"), F.array(kid).alias("derived_children"))
    led = led.unionByName(c.select(kid.alias("path"), F.when(k % 11 == 0, "errored").otherwise("done").alias("status"), none.alias("derived_children")))
    gates = c.select(own.alias("path"), F.when(k % 3 == 0, "pending").otherwise("cleared").alias("state"))
    return refs.skippable_listings(c.select(own.alias("path")), led, gates, c.filter(k % 7 == 0).select(own.alias("path")))


@query("SELECT 'projects/new/x' || page_id AS path, 'projects/old/x' || page_id AS source, CASE WHEN page_id % 4 = 0 THEN 'release' WHEN page_id % 3 <> 0 THEN 'copy' ELSE 'leave' END AS action FROM pages WHERE page_id % 5 <> 0")
def jn24_heal_plan(spark, d):
    i = F.col("page_id")
    p = t(spark, d, "pages")
    key = lambda folder: F.concat(F.lit(f"projects/{folder}/x"), i).alias("key")
    md5 = F.when(i % 3 != 0, F.md5(F.col("html").cast("binary"))).alias("md5")
    inventory = p.filter(i % 5 != 0).select(key("old"), md5, F.lit(None).cast("string").alias("sha256")).unionByName(p.filter(i % 4 == 0).select(key("new"), md5, F.lit(None).cast("string").alias("sha256")))
    aliases = p.select(F.lit("projects/new").alias("current"), F.lit("projects/old").alias("former")).distinct()
    return reconcile.heal_plan(p.select(key("new")).withColumnRenamed("key", "path"), inventory, aliases)


_RESOURCE = "'{\"id\":\"o' || o_orderkey || '\",\"type\":\"runs\",\"attributes\":{\"n\":' || o_orderkey || '}}'"


@query("SELECT o_orderkey, pos, id, n FROM (SELECT o_orderkey, 0 AS pos, 'o' || o_orderkey AS id, o_orderkey AS n FROM orders WHERE o_orderkey % 4 < 2 UNION ALL SELECT o_orderkey, 1, 'o' || o_orderkey, o_orderkey FROM orders WHERE o_orderkey % 4 = 1)")
def sc01_decode(spark, d):
    data = f"CASE o_orderkey % 4 WHEN 0 THEN {_RESOURCE} WHEN 1 THEN '[' || {_RESOURCE} || ',' || {_RESOURCE} || ']' WHEN 2 THEN 'null' ELSE 'oops' END"
    docs = t(spark, d, "orders").select("o_orderkey", F.expr(f"'{{\"data\":' || {data} || '}}'").alias("content"))
    return fc.decode_jsonapi(docs).select("o_orderkey", F.col("pos").cast("int").alias("pos"), "id", fc.attr_int(F.col("attributes"), "n").alias("n"))


@query("SELECT 'o' || o_orderkey AS id, 'c' || o_custkey AS relation, CAST(NULL AS BIGINT) AS n FROM orders UNION ALL SELECT 'c' || o_custkey, NULL, o_custkey FROM orders WHERE o_custkey % 2 = 0")
def sc24_relations(spark, d):
    child = "'{\"id\":\"c' || o_custkey || '\"' || CASE WHEN o_custkey % 2 = 0 THEN ',\"attributes\":{\"n\":' || o_custkey || '}' ELSE '' END || '}'"
    text = f"'{{\"id\":\"o' || o_orderkey || '\",\"type\":\"runs\",\"relationships\":{{\"by\":{{\"data\":' || {child} || '}}}}}}'"
    parents, children = fc.split_relations(t(spark, d, "orders").select(F.try_parse_json(F.expr(text)).alias("resource")), "by")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return parents.select("id", F.col("relation_id").alias("relation"), none("bigint", "n")).unionByName(children.select("id", none("string", "relation"), fc.attr_int(F.col("attributes"), "n").alias("n")))


_TYPED = "CASE event_id % 6 WHEN 0 THEN '{\"k\": \"x\"}' WHEN 1 THEN '{\"k\": 3}' WHEN 2 THEN '{\"k\": 3.7}' WHEN 3 THEN '{\"k\": true}' WHEN 4 THEN '{\"k\": \"2024-01-02T03:04:05Z\"}' ELSE '{' END"


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'x' WHEN 4 THEN '2024-01-02T03:04:05Z' ELSE '' END AS text, CASE WHEN event_id % 6 IN (1, 2) THEN 3 ELSE 0 END AS number, event_id % 6 = 3 AS flag, CASE event_id % 6 WHEN 4 THEN '2024-01-02 03:04' ELSE '' END AS at FROM events")
def sc02_typed_attributes(spark, d):
    v = F.try_parse_json(F.expr(_TYPED))
    return t(spark, d, "events").select("event_id", fc.attr_string(v, "k").alias("text"), fc.attr_int(v, "k").alias("number"), fc.attr_bool(v, "k").alias("flag"), fc.fmt_time(fc.attr_time(v, "k")).alias("at"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS day, CASE o_orderkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '' END AS flag, 'loose' || CASE WHEN o_orderkey % 2 = 0 THEN ' (offloaded)' ELSE '' END AS form FROM orders")
def sc21_time_and_flags(spark, d):
    i = F.col("o_orderkey")
    return t(spark, d, "orders").select("o_orderkey", fc.fmt_time(F.col("o_orderdate")).alias("day"), fc.bool_cell(F.when(i % 3 == 0, True).when(i % 3 == 1, False)).alias("flag"), fc.display_form(F.lit("loose"), i % 2 == 0).alias("form"))


_DAMAGED = "'{oops'"


def _doc(key: str, attributes: str, good: str) -> str:
    """SQL of a document with an id and attributes where `good` holds, else of a damaged one."""
    return f"CASE WHEN {good} THEN '{{\"data\":{{\"id\":\"' || {key} || '\",\"attributes\":{{' || {attributes} || '}}}}}}' ELSE {_DAMAGED} END"


@query("""SELECT r_name || '/org.json' AS path, CASE WHEN r_regionkey % 4 <> 3 THEN 'org-' || r_regionkey ELSE '' END AS id, CASE WHEN r_regionkey % 4 <> 3 THEN 'The ' || r_name ELSE r_name END AS title,
  CASE WHEN r_regionkey % 4 <> 3 THEN r_regionkey || '@x' ELSE '' END AS email, CASE WHEN r_regionkey % 4 <> 3 THEN '2024-01-02 03:04' ELSE '' END AS created FROM region""")
def rep01_org_info(spark, d):
    doc = _doc("'org-' || r_regionkey", "'\"name\":\"The ' || r_name || '\",\"email\":\"' || r_regionkey || '@x\",\"created-at\":\"2024-01-02T03:04:05Z\"'", "r_regionkey % 4 <> 3")
    return reports.org_info(t(spark, d, "region").select(F.expr("r_name || '/org.json'").alias("path"), F.expr(doc).alias("content")))


@query("SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey % 6 <> 0 THEN s_name ELSE '' END AS name, CASE WHEN s_suppkey % 6 <> 0 THEN 'secret' ELSE '' END AS visibility, CASE WHEN s_suppkey % 6 <> 0 THEN s_nationkey END AS users FROM supplier")
def rep02_teams(spark, d):
    doc = _doc("'s' || s_suppkey", "'\"name\":\"' || s_name || '\",\"visibility\":\"secret\",\"users-count\":' || s_nationkey", "s_suppkey % 6 <> 0")
    return reports.teams_report(t(spark, d, "supplier").select(F.expr("'teams/s' || s_suppkey || '/team.json'").alias("path"), F.expr(doc).alias("content")))


_VAR = "'{\"id\":\"v\",\"attributes\":{\"key\":\"' || c_name || '\",\"value\":\"' || c_custkey || '\",\"category\":\"env\",\"sensitive\":' || CASE c_custkey % 3 WHEN 0 THEN 'true' ELSE 'false' END || ',\"hcl\":' || CASE c_custkey % 2 WHEN 0 THEN 'true' ELSE 'false' END || '}}'"
_VARS_SQL = "SELECT c_nationkey AS k, string_agg(c_name || '=' || CASE c_custkey % 3 WHEN 0 THEN '(sensitive)' ELSE CAST(c_custkey AS STRING) END || ',' || CASE c_custkey % 2 WHEN 0 THEN 'true' ELSE 'false' END, ' ' ORDER BY c_name) AS vars FROM customer GROUP BY 1"


def _variables(spark, d, folder: str, leaf: str):
    """A document of variables per nation."""
    rows = t(spark, d, "customer").select("c_nationkey", F.expr(_VAR).alias("v"))
    docs = rows.groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_list("v")), ",").alias("vs"))
    return docs.select(F.concat(F.lit(f"{folder}/"), "c_nationkey", F.lit(f"/{leaf}")).alias("path"), F.concat(F.lit('{"data":['), "vs", F.lit("]}")).alias("content"))


def _vars(c: str):
    return F.array_join(F.transform(c, lambda v: F.concat(v["key"], F.lit("="), v["value"], F.lit(","), v["hcl"])), " ").alias("vars")


@query(f"""SELECT CAST(n_nationkey AS STRING) AS set_id, CASE WHEN n_nationkey % 5 <> 0 THEN n_name ELSE CAST(n_nationkey AS STRING) END AS title, CASE WHEN n_nationkey % 5 <> 0 THEN 'vs' || n_nationkey ELSE '' END AS id,
  CASE WHEN n_nationkey % 5 = 0 THEN '' WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'false' END AS global, coalesce(vars, '') AS vars FROM nation LEFT JOIN ({_VARS_SQL}) ON k = n_nationkey""")
def rep03_variable_sets(spark, d):
    doc = _doc("'vs' || n_nationkey", "'\"name\":\"' || n_name || '\",\"global\":' || CASE n_nationkey % 2 WHEN 0 THEN 'true' ELSE 'false' END", "n_nationkey % 5 <> 0")
    sets = t(spark, d, "nation").select(F.expr("'variable-sets/' || n_nationkey || '/variable-set.json'").alias("path"), F.expr(doc).alias("content"))
    return reports.variable_sets_report(sets, _variables(spark, d, "variable-sets", "variables.json")).select("set_id", "title", "id", "global", _vars("variables"))


@query(f"""SELECT CAST(n_nationkey AS STRING) AS set_id, n_name AS title, 'sentinel' AS kind, CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE '' END AS global, CASE WHEN n_nationkey % 3 <> 0 THEN n_regionkey END AS policies, coalesce(vars, '') AS vars FROM nation LEFT JOIN ({_VARS_SQL}) ON k = n_nationkey""")
def rep03_policy_sets(spark, d):
    rest = "CASE n_nationkey % 2 WHEN 0 THEN ',\"global\":true' ELSE '' END || CASE WHEN n_nationkey % 3 <> 0 THEN ',\"policy-count\":' || n_regionkey ELSE '' END"
    doc = _doc("'ps' || n_nationkey", f"'\"name\":\"' || n_name || '\",\"kind\":\"sentinel\"' || {rest}", "true")
    sets = t(spark, d, "nation").select(F.expr("'policy-sets/' || n_nationkey || '/policy-set.json'").alias("path"), F.expr(doc).alias("content"))
    return reports.policy_sets_report(sets, _variables(spark, d, "policy-sets", "parameters.json")).select("set_id", "title", "kind", "global", "policies", _vars("variables"))


@query("""SELECT 'w' || c_custkey AS id, c_name AS description, '1.' || c_nationkey AS terraform_version, CASE c_custkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '' END AS auto_apply, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS resource_count,
  CASE WHEN c_custkey % 4 = 0 THEN 'org/' || c_custkey ELSE '' END AS repository FROM customer WHERE c_custkey % 7 <> 0""")
def rep04_workspaces(spark, d):
    rest = "CASE c_custkey % 3 WHEN 0 THEN ',\"auto-apply\":true' WHEN 1 THEN ',\"auto-apply\":false' ELSE '' END || CASE WHEN c_custkey % 2 = 0 THEN ',\"resource-count\":' || c_custkey ELSE '' END || CASE WHEN c_custkey % 4 = 0 THEN ',\"vcs-repo\":{\"identifier\":\"org/' || c_custkey || '\"}' ELSE '' END"
    doc = _doc("'w' || c_custkey", f"'\"description\":\"' || c_name || '\",\"terraform-version\":\"1.' || c_nationkey || '\"' || {rest}", "c_custkey % 7 <> 0")
    docs = t(spark, d, "customer").select(F.expr("'projects/p/workspaces/' || c_name || '/workspace.json'").alias("path"), F.expr(doc).alias("content"))
    return reports.workspace_overview(docs).select("id", "description", "terraform_version", "auto_apply", "resource_count", "repository")


@query("""SELECT CASE WHEN n_nationkey % 5 <> 0 THEN 'The ' || n_name ELSE n_name END AS title, CASE WHEN n_nationkey % 5 <> 0 THEN 'st' || n_nationkey ELSE '' END AS id, CASE WHEN n_nationkey % 5 <> 0 THEN '2024-02-03 04:05' ELSE '' END AS updated, count(s_suppkey) AS n_deployments,
  coalesce(string_agg('d' || s_suppkey || ' ' || CASE WHEN s_suppkey % 2 = 0 THEN '2024-01-02 03:04' ELSE '' END, ';' ORDER BY 'd' || s_suppkey), '') AS deployments FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name""")
def rep04_stacks(spark, d):
    n = t(spark, d, "nation")
    doc = _doc("'st' || n_nationkey", "'\"name\":\"The ' || n_name || '\",\"updated-at\":\"2024-02-03T04:05:06Z\"'", "n_nationkey % 5 <> 0")
    stacks = n.select(F.expr("'projects/p/stacks/' || n_name || '/stack.json'").alias("path"), F.expr(doc).alias("content"))
    made = _doc("'d' || s_suppkey", "'\"created-at\":\"2024-01-02T03:04:05Z\"'", "s_suppkey % 2 = 0")
    deployments = t(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.expr("'projects/p/stacks/' || n_name || '/deployments/d' || s_suppkey || '/deployment.json'").alias("path"), F.expr(made).alias("content"))
    each = F.array_join(F.transform("deployments", lambda x: F.concat(x["name"], F.lit(" "), x["created"])), ";").alias("deployments")
    return reports.stack_report(stacks, deployments).select("title", "id", "updated", F.col("n_deployments").cast("long").alias("n_deployments"), each)
