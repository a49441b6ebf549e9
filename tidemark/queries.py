"""The registered queries of the archive operators, with their DuckDB SQL. FIXTURES.md tells what each table plays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import content as fc
from tidemark.functions import paths as fp
from tidemark.functions import status as fs
from tidemark.operators import audit, gates, history, ledger, listing, reconcile, refs, sealing, walk
from tidemark.plans import reports

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its function's name."""

    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PATH = "'projects/' || source || '/workspaces/' || lang || '/runs/' || doc_id || '/run.json'"


def objects(spark: SparkSession, d: str) -> DataFrame:
    """Documents as an archive's objects."""
    path = F.concat_ws("/", F.lit("projects"), "source", F.lit("workspaces"), "lang", F.lit("runs"), F.col("doc_id").cast("string"), F.lit("run.json"))
    return t(spark, d, "documents").select("doc_id", path.alias("path"), F.col("source").alias("org"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("size"))


OBJECTS = f"SELECT doc_id, {_PATH} AS path, source AS org, text AS content, strlen(text) AS size FROM documents"


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Labels as the ledger of part of them."""
    status = F.when(F.col("toxic") == 1, "forbidden").when(F.col("quality") == 1, "done").otherwise("errored")
    return t(spark, d, "labels").join(objects(spark, d).select("doc_id", "path"), "doc_id").select("path", status.alias("status"), "doc_id")


ENTRIES = f"SELECT o.path, CASE WHEN toxic = 1 THEN 'forbidden' WHEN quality = 1 THEN 'done' ELSE 'errored' END AS status, doc_id FROM labels JOIN ({OBJECTS}) o USING (doc_id)"


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Events as outcomes of fetches."""
    e = F.col("event_type")
    status = F.when(e == "error", "errored").when(e == "signup", "absent").when(e == "click", "forbidden").otherwise("done")
    return t(spark, d, "events").select(
        F.concat(F.lit("objects/"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), status.alias("status"), F.md5(F.col("props").cast("binary")).alias("hash"),
        F.length("props").cast("long").alias("size"), F.when(e == "purchase", F.col("ts")).alias("updated_at"), F.when(status.isin("errored", "forbidden"), F.concat(F.lit("HTTP "), e)).alias("error"), (e == "error").alias("transient"),
        F.floor(F.col("event_id") / 1000).alias("run_id"), (e == "purchase").alias("changed"),
    )


OUTCOMES = """SELECT 'objects/' || user_id AS path, event_id AS seq, ts AS seen,
  CASE event_type WHEN 'error' THEN 'errored' WHEN 'signup' THEN 'absent' WHEN 'click' THEN 'forbidden' ELSE 'done' END AS status,
  md5(props) AS hash, length(props) AS size, CASE WHEN event_type = 'purchase' THEN ts END AS updated_at,
  CASE WHEN event_type IN ('error', 'click') THEN 'HTTP ' || event_type END AS error, event_type = 'error' AS transient, event_id // 1000 AS run_id, event_type = 'purchase' AS changed FROM events"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as runs listed by customer."""
    return t(spark, d, "orders").select(F.col("o_custkey").alias("collection"), F.col("o_orderkey").alias("id"), F.concat(F.lit("runs/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") == "F").alias("terminal"))


RUNS = "SELECT o_custkey AS collection, o_orderkey AS id, 'runs/' || o_orderkey AS path, o_orderdate AS created_at, o_orderstatus = 'F' AS terminal FROM orders"


@query(f"SELECT o.path FROM ({OBJECTS}) o LEFT JOIN ({ENTRIES}) e USING (doc_id) WHERE e.status IS NULL OR e.status NOT IN ('done')")
def fil01_should_fetch(spark, d):
    return ledger.should_fetch(objects(spark, d).select("path"), entries(spark, d))


@query(f"SELECT path, split_part(path, '/', 2) AS project, split_part(path, '/', 4) AS workspace, 'runs' AS kind, split_part(path, '/', 6) AS run_id, 'run.json' AS leaf, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3) || '/' || split_part(path, '/', 4) AS shard FROM ({OBJECTS})")
def sc03_parse_path(spark, d):
    p = fp.parse_path(F.col("path"))
    return objects(spark, d).select("path", p["project"].alias("project"), p["workspace"].alias("workspace"), p["kind"].alias("kind"), p["run_id"].alias("run_id"), p["leaf"].alias("leaf"), fp.shard_key(F.col("path")).alias("shard"))


@query(r"SELECT page_id, CASE WHEN regexp_full_match(regexp_replace(url, '[/\\\x00-\x1f\x7f]', '_', 'g'), '\.*') THEN '_' ELSE regexp_replace(url, '[/\\\x00-\x1f\x7f]', '_', 'g') END AS segment, url NOT LIKE '%\\%' AND len(list_filter(string_split(url, '/'), lambda s: s IN ('', '.', '..'))) = 0 AS valid FROM pages")
def sc05_segments(spark, d):
    return t(spark, d, "pages").select("page_id", fp.sanitize_segment(F.col("url")).alias("segment"), fp.is_valid_path(F.col("url")).alias("valid"))


@query(f"SELECT path, path LIKE 'projects/src1/%' AS below, regexp_replace(path, '\\.json$', '') || '.history.ndjson' AS history FROM ({OBJECTS})")
def sc07_under_prefix(spark, d):
    return objects(spark, d).select("path", fp.under_prefix(F.col("path"), F.lit("projects/src1")).alias("below"), fp.history_path(F.col("path")).alias("history"))


@query("SELECT doc_id, sha256(text) AS hash, strlen(text) AS size, md5(text) AS md5 FROM documents")
def sc09_signature(spark, d):
    s, g = fc.signature(F.col("text")), fc.digests(F.col("text"))
    return t(spark, d, "documents").select("doc_id", s["hash"].alias("hash"), s["size"].alias("size"), g["md5"].alias("md5"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '' AS text, 0 AS missing, false AS flag FROM events")
def sc02_attributes(spark, d):
    v = F.try_parse_json("props")
    return t(spark, d, "events").select("event_id", fc.attr_int(v, "k").alias("k"), fc.attr_string(v, "k").alias("text"), fc.attr_int(v, "none").alias("missing"), fc.attr_bool(v, "k").alias("flag"))


@query("SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S') || 'Z-' || event_type AS stem, strftime(ts, '%Y%m%dT%H%M%S.%f') || '000Z-p' || lpad(CAST(user_id AS VARCHAR), 9, '0') || '.json' AS page, true AS is_page FROM events")
def sc11_stems(spark, d):
    page = fp.audit_page_name(F.col("ts"), F.col("user_id"))
    return t(spark, d, "events").select("event_id", fp.state_stem(F.col("ts"), F.col("event_type")).alias("stem"), page.alias("page"), fp.is_page_name(page).alias("is_page"))


@query("SELECT l_orderkey, l_linenumber, printf('logs.gen%04d.zip', l_suppkey) AS name, l_suppkey AS generation FROM lineitem")
def sc12_bundle_generation(spark, d):
    name = fp.bundle_name(F.col("l_suppkey"), "logs")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", name.alias("name"), fp.bundle_generation(name, "logs").cast("long").alias("generation"))


_LEAVES = ["plan.log", "run.json", "apply.log", "comments.json", "policy-check-1.log", "run-events.json", "other.txt"]
_LEAF_SQL = "CASE l_linenumber " + " ".join(f"WHEN {i + 1} THEN '{x}'" for i, x in enumerate(_LEAVES)) + " END"


def _leaf():
    """The leaf a line stands for."""
    return F.element_at(F.array(*[F.lit(x) for x in _LEAVES]), F.col("l_linenumber"))


@query(f"SELECT l_orderkey, l_linenumber, {_LEAF_SQL} AS leaf, CASE l_linenumber WHEN 1 THEN 'heavy' WHEN 3 THEN 'heavy' WHEN 4 THEN 'comments.ndjson' WHEN 5 THEN 'heavy' WHEN 6 THEN 'run-events.ndjson' ELSE 'other' END AS class, CASE l_linenumber WHEN 1 THEN 0 WHEN 3 THEN 2 WHEN 4 THEN 6 WHEN 6 THEN 7 END AS rank FROM lineitem")
def sc14_artifacts(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _leaf().alias("leaf"), fp.artifact_class(F.concat(F.lit("projects/p/workspaces/w/runs/r/"), _leaf())).alias("class"), fp.artifact_rank(_leaf()).alias("rank"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'applied' WHEN 'P' THEN 'pending' ELSE 'planning' END AS status, o_orderstatus = 'F' AS terminal FROM orders")
def sc17_terminal(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "applied").when(F.col("o_orderstatus") == "P", "pending").otherwise("planning")
    return t(spark, d, "orders").select("o_orderkey", status.alias("status"), fs.is_terminal(F.lit("run"), status).alias("terminal"))


@query("SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'terminal' WHEN 1 THEN 'forbidden' WHEN 2 THEN 'transient' WHEN 3 THEN 'forbidden' ELSE 'unknown' END AS kind FROM events")
def sc18_classify_error(spark, d):
    k = F.col("user_id") % 5
    code = F.when(k == 0, 404).when(k == 1, 403).when(k == 2, 429).otherwise(500)
    # Only a line of its own refuses; a path that holds the word doesn't.
    message = F.when(k == 3, " Forbidden\nfor this token").when(k == 4, "path forbidden-experiments failed").otherwise("oops")
    return t(spark, d, "events").select("event_id", fs.classify_error(code, message, F.lit(None).cast("string")).alias("kind"))


@query("""SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN round(b / 1024.0, 1) < 1024 THEN printf('%.1f KiB', b / 1024.0) ELSE printf('%.1f MiB', b / 1048576.0) END AS size,
  CASE WHEN b = 1 THEN '1 byte' ELSE b || ' bytes' END AS noun, trim(split_part(text, chr(10), 1)) AS line FROM (SELECT doc_id, text, strlen(text) AS b FROM documents)""")
def sc21_cells(spark, d):
    b = F.octet_length("text")
    return t(spark, d, "documents").select("doc_id", fc.human_bytes(b).alias("size"), fc.count_noun(b, "byte", "bytes").alias("noun"), fc.first_line(F.col("text")).alias("line"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def fil02_filter_names(spark, d):
    names = t(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("name"))
    return listing.filter_names(t(spark, d, "customer"), names, "c_nationkey").select("c_custkey", "c_name")


@query("SELECT DISTINCT p_size AS name FROM part WHERE p_size NOT IN (SELECT c_nationkey FROM customer)")
def fil03_unmatched_names(spark, d):
    return listing.unmatched_names(t(spark, d, "customer"), t(spark, d, "part").select(F.col("p_size").alias("name")), "c_nationkey")


@query(f"SELECT collection, id FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY created_at DESC, id) AS k FROM ({RUNS})) WHERE k <= 3 OR created_at >= TIMESTAMP '1998-01-01'")
def fil04_within_history(spark, d):
    return walk.within_history(runs(spark, d), 3, F.lit("1998-01-01").cast("timestamp_ntz")).select("collection", "id")


_CUT = "TIMESTAMP '2024-01-02 00:00:00'"
_AUDIT = "SELECT CASE WHEN event_id % 13 <> 0 THEN event_id END AS id, event_id AS n, date_trunc('hour', ts) AS ts FROM events"


def _audit(spark, d):
    return t(spark, d, "events").select(F.when(F.col("event_id") % 13 != 0, F.col("event_id")).alias("id"), F.col("event_id").alias("n"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))


@query(f"SELECT n FROM ({_AUDIT}) WHERE (ts > {_CUT} OR (ts = {_CUT} AND id IS NOT NULL)) AND (id IS NULL OR id % 7 <> 0)")
def fil05_events_after(spark, d):
    rows = _audit(spark, d)
    return audit.events_after(rows, F.lit("2024-01-02").cast("timestamp_ntz"), rows.filter("id % 7 = 0").select("id")).select("n")


@query(f"SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS cursor, count(*) AS n FROM ({_AUDIT}) WHERE (ts > {_CUT} OR (ts = {_CUT} AND id IS NOT NULL)) AND (id IS NULL OR id % 7 <> 0)")
def str01_audit_increment(spark, d):
    rows = _audit(spark, d)
    _, cursor = audit.audit_increment(rows, F.lit("2024-01-02").cast("timestamp_ntz"), rows.filter("id % 7 = 0").select("id"))
    return cursor.select(F.date_format("cursor", "yyyy-MM-dd HH:mm:ss").alias("cursor"), "n")


@query(f"SELECT path, status FROM ({ENTRIES}) WHERE status IN ('errored', 'forbidden')")
def fil07_failures(spark, d):
    return ledger.failures(entries(spark, d)).select("path", "status")


@query(f"""SELECT prefix, count(*) FILTER (status = 'done') AS n_done, count(*) FILTER (status = 'errored') AS n_errored, coalesce(bool_or(status IN ('errored', 'forbidden')), false) AS has_unsettled, false AS has_absent
  FROM (SELECT DISTINCT 'projects/' || source AS prefix FROM documents) LEFT JOIN ({ENTRIES}) ON path LIKE prefix || '/%' GROUP BY prefix""")
def fil08_under(spark, d):
    return ledger.under(entries(spark, d), t(spark, d, "documents").select(F.concat(F.lit("projects/"), "source").alias("prefix")))


@query(f"SELECT org, path, size FROM ({OBJECTS}) WHERE path LIKE 'projects/src2/%'")
def fil09_list_objects(spark, d):
    return listing.list_objects(objects(spark, d), "projects/src2").select("org", "path", "size")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license')")
def fil11_search(spark, d):
    return listing.search(t(spark, d, "documents"), "License", "text").select("doc_id")


@query(f"""SELECT path, size, form, form IN ('stub', 'mirror') AS offloaded FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY r) AS k FROM (
  SELECT path, size, 'loose' AS form, 0 AS r FROM ({OBJECTS}) WHERE doc_id % 4 = 0 UNION ALL SELECT path, size + 1, 'stub', 1 FROM ({OBJECTS}) WHERE doc_id % 3 = 0
  UNION ALL SELECT path, size + 2, 'sealed', 2 FROM ({OBJECTS}) WHERE doc_id % 5 <> 0 UNION ALL SELECT path, size + 3, 'mirror', 3 FROM ({OBJECTS}))) WHERE k = 1""")
def jn01_merge_forms(spark, d):
    rows = objects(spark, d)
    form = lambda name, more, keep: rows.filter(keep).select("path", (F.col("size") + more).alias("size"), F.lit(name).alias("form"))
    return listing.merge_forms(form("loose", 0, "doc_id % 4 = 0"), form("stub", 1, "doc_id % 3 = 0"), form("sealed", 2, "doc_id % 5 <> 0"), form("mirror", 3, "true"))


@query("SELECT l_orderkey AS member, l_suppkey AS bundle, l_suppkey % 3 <> 0 AS offloaded FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)")
def jn02_bundle_offloaded(spark, d):
    members = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("member"), F.col("l_suppkey").alias("bundle")).distinct()
    return listing.bundle_offloaded(members, members.filter("bundle % 3 = 0").select(F.col("bundle").alias("path")).distinct())


def _local(spark, d):
    return objects(spark, d).select("doc_id", "path", "size", F.md5(F.col("content").cast("binary")).alias("md5"), F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))


def _inventory(spark, d):
    """A mirror in which every seventh object is missing, every eleventh has another size, and every thirteenth another digest."""
    i = F.col("doc_id")
    md5 = F.when(i % 13 == 0, "other").when(i % 2 == 0, F.col("md5"))
    return _local(spark, d).filter(i % 7 != 0).select(F.col("path").alias("key"), (F.col("size") + (i % 11 == 0).cast("int")).alias("size"), md5.alias("md5"), F.when(i % 3 == 0, F.col("sha256")).alias("sha256"), "doc_id")


@query(f"SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'absent' WHEN doc_id % 11 = 0 THEN 'size' WHEN doc_id % 13 = 0 THEN 'digest' ELSE 'equal' END AS reason FROM ({OBJECTS})")
def jn03_upload_needed(spark, d):
    return reconcile.upload_needed(_local(spark, d), _inventory(spark, d))


@query(f"SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'size_mismatch' ELSE 'ok' END AS state FROM ({OBJECTS}) WHERE doc_id % 5 <> 0")
def jn06_verify_evicted(spark, d):
    rows = _local(spark, d)
    return reconcile.verify_evicted(reconcile.evicted_obligations(rows, rows.filter("doc_id % 5 = 0")), _inventory(spark, d))


@query(f"""SELECT path, action, CASE action WHEN 'create' THEN 'missing' ELSE reason END AS reason FROM (SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'create' WHEN doc_id % 11 = 0 THEN 'replace' WHEN doc_id % 3 = 0 THEN 'skip' WHEN doc_id % 13 = 0 THEN 'replace' ELSE 'skip' END AS action,
  CASE WHEN doc_id % 11 = 0 THEN 'size' WHEN doc_id % 3 = 0 THEN 'sha256' WHEN doc_id % 13 = 0 OR doc_id % 2 = 0 THEN 'md5' ELSE 'size only' END AS reason FROM ({OBJECTS}) WHERE doc_id % 7 <> 0)""")
def jn08_restore_runs(spark, d):
    return reconcile.restore_plan(_inventory(spark, d), _local(spark, d).filter("doc_id % 5 <> 0"))


@query(f"SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'mismatch' WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN 'ok' ELSE 'needs_read_back' END AS state FROM ({OBJECTS})")
def jn23_confirm_copy(spark, d):
    return reconcile.confirm_copy(_local(spark, d), _inventory(spark, d))


@query("SELECT o_orderkey AS gate, CASE WHEN o_custkey % 5 = 0 THEN 'pending' WHEN o_custkey % 5 = 1 THEN 'absent' ELSE 'cleared' END AS state FROM orders")
def jn12_reference_gates(spark, d):
    who = F.col("c_custkey")
    led = t(spark, d, "customer").filter("c_custkey % 10 <> 0").select(who.alias("path"), F.when(who % 5 == 0, "errored").when(who % 5 == 1, "absent").otherwise("done").alias("status"))
    return refs.reference_gates(t(spark, d, "orders").select(F.col("o_orderkey").alias("gate"), F.col("o_custkey").alias("target_path")), led)


@query("SELECT o_custkey AS path, bool_and(o_orderstatus = 'F') AS settled FROM orders GROUP BY 1")
def jn13_derived_settled(spark, d):
    o = t(spark, d, "orders")
    kids = o.groupBy(F.concat(F.lit("c"), "o_custkey").alias("path")).agg(F.collect_list(F.concat(F.lit("o"), "o_orderkey")).alias("derived_children")).withColumn("status", F.lit("done"))
    own = o.select(F.concat(F.lit("o"), "o_orderkey").alias("path"), F.array().cast("array<string>").alias("derived_children"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("errored").alias("status"))
    return refs.derived_settled(kids.unionByName(own)).select(F.substring("path", 2, 99).cast("long").alias("path"), "settled")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS name, CASE WHEN doc_id % 3 = 0 THEN 'fresh' ELSE 'already_sealed' END AS state FROM ({OBJECTS})")
def jn16_reconcile_sealed(spark, d):
    rows = _local(spark, d).select(F.col("doc_id").cast("string").alias("name"), "sha256", "doc_id")
    index = rows.select("name", F.lit(1).alias("ord"), "sha256").unionByName(rows.filter("doc_id % 3 = 0").select("name", F.lit(2).alias("ord"), F.lit("newer").alias("sha256")))
    return reconcile.reconcile_sealed(rows, index)


@query("SELECT c_custkey, n_name AS project FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 0 UNION ALL SELECT c_custkey, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0")
def jn18_resolve_project(spark, d):
    items = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("project_id"), F.col("c_mktsegment").alias("relation_name"))
    projects = t(spark, d, "nation").filter("n_regionkey <> 0").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return refs.resolve_project(items, projects).select("c_custkey", "project")


@query("SELECT id, arg_max(name, ord) AS name FROM (SELECT user_id AS id, event_id AS ord, event_type AS name FROM events UNION ALL SELECT o_custkey, o_orderkey + 10000000, o_orderpriority FROM orders) GROUP BY id")
def jn19_collect_users(spark, d):
    a = t(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("ord"), F.col("event_type").alias("name"))
    b = t(spark, d, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") + 10000000).alias("ord"), F.col("o_orderpriority").alias("name"))
    return refs.collect_users(a, b)


@query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'renamed_from' WHEN 2 THEN 'mismatch' ELSE CASE c_custkey % 8 WHEN 3 THEN 'renamed_back' ELSE 'ok' END END AS claim FROM customer")
def jn20_claim_identities(spark, d):
    c, k = t(spark, d, "customer"), F.col("c_custkey")
    rows = c.select(F.col("c_nationkey").alias("parent"), F.col("c_name").alias("name"), k.alias("id"))
    bound = c.filter(k % 4 != 0).select(F.col("c_nationkey").alias("parent"), F.when(k % 4 == 1, F.concat("c_name", F.lit("-old"))).otherwise(F.col("c_name")).alias("name"), F.when(k % 4 == 2, -k).otherwise(k).alias("id"))
    bound = bound.unionByName(c.filter(k % 8 == 3).select(F.col("c_nationkey").alias("parent"), F.concat("c_name", F.lit("-old")).alias("name"), k.alias("id")))
    return refs.claim_identities(rows, bound).select("id", "claim")


@query(f"SELECT run_id, coalesce(list_aggregate(list_transform(list_sort(list_distinct(list(CASE WHEN l_linenumber IS NOT NULL AND l_linenumber <> 2 THEN [CASE l_linenumber WHEN 1 THEN '00' WHEN 3 THEN '02' WHEN 4 THEN '06' WHEN 6 THEN '07' ELSE '99' END, {_LEAF_SQL}] END))), lambda x: x[2]), 'string_agg', ', '), '') AS artifacts FROM (SELECT o_orderkey AS run_id FROM orders) LEFT JOIN lineitem ON l_orderkey = run_id GROUP BY run_id")
def jn21_run_artifacts(spark, d):
    found = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), _leaf().alias("leaf"))
    return reports.run_artifacts(t(spark, d, "orders").select(F.col("o_orderkey").alias("run_id")), found).select("run_id", F.array_join("artifacts", ", ").alias("artifacts"))


@query("SELECT o_orderkey AS stem, coalesce(bool_or(l_linenumber % 2 = 1), false) AS has_raw, coalesce(bool_or(l_linenumber % 2 = 0), false) AS has_json, concat_ws(', ', CASE WHEN bool_or(l_linenumber % 2 = 1) THEN 'raw' END, CASE WHEN bool_or(l_linenumber % 2 = 0) THEN 'json' END) AS forms FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def jn22_state_forms(spark, d):
    files = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("stem"), F.when(F.col("l_linenumber") % 2 == 1, "tfstate.json").otherwise("json").alias("suffix"))
    return reports.state_forms(t(spark, d, "orders").select(F.col("o_orderkey").alias("stem")), files)


@query(f"SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'new' WHEN doc_id % 11 = 0 THEN 'changed' ELSE 'unchanged' END AS action, CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 = 0 THEN sha256(content || 'x') END AS old_hash FROM ({OBJECTS})")
def cdc01_capture_mutable(spark, d):
    rows = objects(spark, d)
    old = rows.filter("doc_id % 7 <> 0").select("path", F.when(F.col("doc_id") % 11 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")).alias("content"))
    return history.capture_mutable(rows, old)


@query(f"SELECT o.path, CASE WHEN o.doc_id % 9 = 0 THEN 'not-applicable' ELSE 'done' END AS status FROM ({OBJECTS}) o LEFT JOIN ({ENTRIES}) e USING (path) WHERE e.status IS NULL OR e.status <> 'done'")
def cdc02_capture_immutable(spark, d):
    return history.capture_immutable(objects(spark, d).withColumn("content", F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("content"))), entries(spark, d))


@query("SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'absent' WHEN 1 THEN 'forbidden' WHEN 2 THEN 'errored' WHEN 3 THEN 'errored' ELSE 'done' END AS status, user_id % 5 = 2 AS transient FROM events")
def cdc03_map_outcome(spark, d):
    k = F.col("user_id") % 5
    code = F.when(k == 0, 404).when(k == 1, 403).when(k == 2, 429).when(k == 3, 500).otherwise(200)
    o = ledger.map_outcome(code, F.lit("oops"), F.lit(None).cast("string"), F.lit(True))
    return t(spark, d, "events").select("event_id", o["status"].alias("status"), o["transient"].alias("transient"))


@query("""WITH e AS (SELECT event_id // 100 AS run_id, user_id AS path, CASE WHEN event_type = 'error' THEN 404 ELSE 200 END AS c, row_number() OVER (PARTITION BY event_id // 100, user_id ORDER BY event_id) AS k FROM events),
  p AS (SELECT run_id, path, max(c) FILTER (k = 1) AS a, max(c) FILTER (k = 2) AS b FROM e GROUP BY 1, 2)
  SELECT run_id, path, CASE WHEN a = 404 AND b IS NOT NULL THEN b ELSE a END AS http_status, CASE WHEN a = 404 AND b IS NOT NULL THEN 1 ELSE 0 END AS retries, a = 404 AND b IS NOT NULL AND b = 404 AS confirmed FROM p""")
def cdc04_confirm_absent(spark, d):
    e = t(spark, d, "events").select(F.floor(F.col("event_id") / 100).alias("run_id"), F.col("user_id").alias("path"), F.col("event_id").alias("attempt"), F.when(F.col("event_type") == "error", 404).otherwise(200).alias("http_status"))
    return ledger.confirm_absent(e)


_STAMP = "'%Y-%m-%d %H:%M:%S.%f'"


@query(f"""SELECT path, arg_max(status, seq) AS status, strftime(min(seen), {_STAMP}) AS first_seen, strftime(arg_max(seen, seq) FILTER (status IN ('done', 'absent')), {_STAMP}) AS fetched_at,
  strftime((list(updated_at ORDER BY seq DESC) FILTER (status = 'done'))[1], {_STAMP}) AS updated_at, CASE WHEN arg_max(status, seq) IN ('errored', 'forbidden') THEN strftime(max(seen), {_STAMP}) END AS last_error_at,
  CASE WHEN arg_max(status, seq) IN ('errored', 'forbidden') THEN arg_max(error, seq) END AS last_error, arg_max(hash, seq) FILTER (status = 'done') AS hash, arg_max(size, seq) FILTER (status = 'done') AS size, count(*) AS attempts, arg_max(transient, seq) AS transient FROM ({OUTCOMES}) GROUP BY path""")
def cdc05_fold_outcomes(spark, d):
    o = ledger.fold_outcomes(outcomes(spark, d))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return o.select("path", "status", at("first_seen"), at("fetched_at"), at("updated_at"), at("last_error_at"), "last_error", F.col("signature.hash").alias("hash"), F.col("signature.size").alias("size"), "attempts", "transient")


_BEFORE = "2024-01-12"


@query(f"SELECT path, arg_max(status, seq) AS status FROM ({OUTCOMES}) GROUP BY path")
def cdc08_compact(spark, d):
    rows = outcomes(spark, d).select(F.substring_index("path", "/", 1).alias("shard"), "path", "status", F.col("seq").alias("ord"), "at")
    old = F.col("at") < F.lit(_BEFORE).cast("timestamp_ntz")
    before = history.newest_per_path(rows.filter(old).drop("at")).drop("ord")
    return ledger.compact(before, rows.filter(~old).drop("at")).select("path", "status")


_SOURCE = "'policies/pol-' || doc_id || CASE doc_id % 2 WHEN 0 THEN '.sentinel' ELSE '.rego' END"
_REVISION = "'policies/pol-' || doc_id || '.20240201T000000Z' || CASE doc_id % 2 WHEN 0 THEN '.sentinel' ELSE '.rego' END"


@query(f"""SELECT path, CASE WHEN NOT settled OR updated IS NULL THEN path WHEN errored_again OR updated > seen THEN revision ELSE path END AS key FROM (SELECT {_SOURCE} AS path, {_REVISION} AS revision,
  doc_id % 3 <> 0 AS settled, CASE WHEN doc_id % 11 <> 0 THEN TIMESTAMP '2024-02-01' END AS updated, doc_id % 5 = 0 AS errored_again,
  CASE doc_id % 4 WHEN 0 THEN TIMESTAMP '2024-01-15' WHEN 1 THEN TIMESTAMP '2024-03-01' WHEN 2 THEN TIMESTAMP '2024-02-01' END AS seen FROM documents)""")
def cdc10_revision_key(spark, d):
    """Sources that are settled or not, listed as newer, older or of unknown time, some with a revision that failed."""
    i, at = F.col("doc_id"), lambda s: F.lit(s).cast("timestamp_ntz")
    docs = t(spark, d, "documents").select("doc_id", F.expr(_SOURCE).alias("path"), F.expr(_REVISION).alias("revision"))
    # Of four, one knows no time of the source but that of its fetch, and one knows neither.
    updated = F.when(i % 4 == 0, at("2024-01-15")).when(i % 4 == 1, at("2024-03-01"))
    fetched = F.when(i % 4 == 2, at("2024-02-01")).when(i % 4 == 0, at("2024-03-01"))
    led = docs.select("path", F.when(i % 3 == 0, "errored").otherwise("done").alias("status"), updated.alias("updated_at"), fetched.alias("fetched_at"))
    failed = docs.select(F.col("revision").alias("path"), F.when(i % 5 == 0, "errored").otherwise("done").alias("status"), at(None).alias("updated_at"), at(None).alias("fetched_at"))
    return ledger.revision_key(docs.select("path", F.when(i % 11 != 0, at("2024-02-01")).alias("updated_at")), led.unionByName(failed))


@query(f"SELECT status, count(*) AS n FROM ({ENTRIES}) GROUP BY status")
def agg01_tally(spark, d):
    return ledger.tally(entries(spark, d))


@query(f"SELECT run_id, status, count(*) AS objects, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT run_id, path, arg_max(status, seq) AS status, coalesce(sum(size) FILTER (changed), 0) AS bytes FROM ({OUTCOMES}) GROUP BY 1, 2) GROUP BY 1, 2")
def agg02_run_totals(spark, d):
    return ledger.run_totals(outcomes(spark, d))


@query(f"SELECT run_id, run_id % 3 = 0 OR (count(*) FILTER (status = 'done') = 0 AND count(*) FILTER (status IN ('errored', 'forbidden')) > 0) AS incomplete FROM ({OUTCOMES}) GROUP BY run_id")
def agg03_run_incomplete(spark, d):
    o = outcomes(spark, d)
    return ledger.run_incomplete(o, o.filter("run_id % 3 = 0").select("run_id"))


@query("SELECT source AS org, 'workspaces' AS label, count(DISTINCT lang) AS n FROM documents GROUP BY 1 UNION ALL SELECT source, 'runs', count(DISTINCT lang || '/' || doc_id) FROM documents GROUP BY 1")
def agg04_inventory_counts(spark, d):
    return reports.inventory_counts(objects(spark, d), {"workspaces": ("projects", 4), "runs": ("projects", 6)})


@query("SELECT n_name AS project, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS workspaces, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS stacks FROM nation")
def agg05_project_counts(spark, d):
    n = t(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("project"))
    own = lambda table, key: t(spark, d, table).join(n, F.col(key) == F.col("n_nationkey")).select("project")
    return reports.project_counts(n, own("customer", "c_nationkey"), own("supplier", "s_nationkey"))


@query(f"SELECT collection, strftime(greatest(max(created_at), TIMESTAMP '1996-06-01'), '%Y-%m-%d') AS mark FROM ({RUNS}) GROUP BY 1")
def agg06_high_water_marks(spark, d):
    r = runs(spark, d)
    stored = r.select("collection", F.lit("1996-06-01").cast("timestamp_ntz").alias("high_water_mark")).distinct()
    return ledger.high_water_marks(r, stored).select("collection", F.date_format("high_water_mark", "yyyy-MM-dd").alias("mark"))


@query(f"SELECT CASE WHEN doc_id % 7 = 0 THEN 'absent' WHEN doc_id % 11 = 0 THEN 'size' WHEN doc_id % 13 = 0 THEN 'digest' ELSE 'equal' END AS action, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM ({OBJECTS}) GROUP BY 1")
def agg07_action_totals(spark, d):
    plan = reconcile.upload_needed(_local(spark, d), _inventory(spark, d)).join(_local(spark, d).select("path", "size"), "path")
    return reconcile.action_totals(plan.withColumnRenamed("reason", "action"), "size")


@query("SELECT c_custkey AS workspace, 1 + least((SELECT count(*) FROM orders WHERE o_custkey = c_custkey), 10) + (SELECT count(*) FROM events WHERE user_id = c_custkey) AS weight FROM customer")
def agg08_workspace_weights(spark, d):
    return reports.workspace_weights(t(spark, d, "customer").select(F.col("c_custkey").alias("workspace")), t(spark, d, "orders").select(F.col("o_custkey").alias("workspace")), t(spark, d, "events").select(F.col("user_id").alias("workspace")), 10)


@query("SELECT DISTINCT source AS name, true AS dir, CAST(NULL AS BIGINT) AS size, false AS remote FROM documents")
def agg09_tree_children(spark, d):
    return listing.tree_children(objects(spark, d).withColumn("offloaded", F.lit(False)), "projects")


_KIND = "CASE p_partkey % 7 WHEN 0 THEN 'latest' WHEN 1 THEN 'junk' || p_partkey WHEN 2 THEN '1.' || p_size || '.0-rc1' ELSE '1.' || p_size || '.0' END"


@query("""SELECT p_brand || '/' || p_partkey % 7 AS module, CASE p_partkey % 7 WHEN 1 THEN 'junk' || min(p_partkey) FILTER (p_partkey % 5 <> 0) WHEN 2 THEN '1.' || max(p_size) FILTER (p_partkey % 5 <> 0) || '.0-rc1'
  WHEN 0 THEN NULL ELSE '1.' || max(p_size) FILTER (p_partkey % 5 <> 0) || '.0' END AS latest FROM part GROUP BY p_brand, p_partkey % 7""")
def agg10_latest_versions(spark, d):
    rows = t(spark, d, "part").select(F.expr("p_brand || '/' || p_partkey % 7").alias("module"), F.expr(_KIND).alias("version"), (F.col("p_partkey") % 5 != 0).alias("ok"), F.col("p_partkey").alias("pos"))
    return reports.latest_versions(rows)


@query("SELECT o_custkey AS run_id, sum(o_totalprice) / 60 AS bytes_per_s, count(*) FILTER (o_orderstatus = 'F') / count(*) AS share, CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 60.0 * count(*) FILTER (o_orderstatus <> 'F') / count(*) FILTER (o_orderstatus = 'F') END AS eta_s, max(o_orderkey) FILTER (o_orderstatus <> 'F') AS largest FROM orders GROUP BY 1")
def agg11_run_rates(spark, d):
    f = F.col("o_orderstatus") == "F"
    return reports.run_rates(t(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("task"), f.cast("int").alias("done"), F.lit(1).alias("total"), F.col("o_totalprice").alias("bytes"), F.lit(60.0).alias("elapsed_s")))


@query(f"SELECT org, split_part(o.path, '/', 4) AS surface, count(*) FILTER (status = 'done') AS archived, 0 AS absent, count(*) FILTER (status = 'forbidden') AS forbidden, count(*) FILTER (status = 'errored') AS errored, count(*) FILTER (status IS NULL) AS missing FROM ({OBJECTS}) o LEFT JOIN ({ENTRIES}) e USING (path) GROUP BY 1, 2")
def agg12_surface_coverage(spark, d):
    return ledger.surface_coverage(objects(spark, d).select("org", F.split_part("path", F.lit("/"), F.lit(4)).alias("surface"), "path"), entries(spark, d))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def win01_newest_per_path(spark, d):
    return history.newest_per_path(t(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


@query("""WITH o AS (SELECT conv_id AS path, turn AS ord, CASE WHEN role <> 'system' THEN role END AS content FROM conversations),
  s AS (SELECT * FROM (SELECT *, bool_or(content IS NOT NULL) OVER (PARTITION BY path ORDER BY ord) AS seen FROM o) WHERE seen),
  c AS (SELECT *, lag(ord) OVER w IS NULL OR content IS DISTINCT FROM lag(content) OVER w AS change FROM s WINDOW w AS (PARTITION BY path ORDER BY ord)),
  n AS (SELECT *, sum(change::INT) OVER (PARTITION BY path ORDER BY ord) AS island FROM c),
  i AS (SELECT path, island, min(ord) AS f, max(ord) AS l, any_value(content) AS content, bool_or(content IS NULL) AS deleted FROM n GROUP BY 1, 2),
  j AS (SELECT *, coalesce(lag(deleted) OVER w, false) AS after, lead(island) OVER w IS NULL AS cur FROM i WINDOW w AS (PARTITION BY path ORDER BY island))
  SELECT path, CASE WHEN deleted OR after THEN f ELSE l END AS fetched_at, content, deleted FROM j WHERE deleted OR after OR NOT cur""")
def win02_build_history(spark, d):
    rows = t(spark, d, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("ord"), F.col("turn").alias("at"), F.when(F.col("role") != "system", F.col("role")).alias("content"))
    return history.build_history(rows)


@query("SELECT path, content FROM (SELECT conv_id AS path, arg_max(role, turn) AS content FROM conversations WHERE turn <= 2 GROUP BY 1) WHERE content <> 'system'")
def win03_history_as_of(spark, d):
    rows = t(spark, d, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("since"), F.col("role").alias("content"), (F.col("role") == "system").alias("deleted"))
    return history.history_as_of(rows, 2)


_WALK = f"""SELECT *, bool_or(NOT terminal) OVER (PARTITION BY collection ORDER BY pos) AS live FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY created_at DESC, id) - 1 AS pos, id % 3 = 0 AS done, collection % 2 = 0 AS allowed FROM ({RUNS}))"""


@query(f"SELECT collection, id, pos AS \"at\", pos = coalesce(stop, -1) AS stops FROM (SELECT *, min(pos) FILTER (done AND terminal AND allowed AND NOT live) OVER (PARTITION BY collection) AS stop FROM ({_WALK})) WHERE (stop IS NULL OR pos <= stop) AND pos < 8")
def win04_incremental_walk(spark, d):
    return _walked(spark, d).select("collection", "id", F.col("at").cast("long").alias("at"), "stops")


def _walked(spark, d):
    r = runs(spark, d)
    led = r.filter("id % 3 = 0").select("path", F.lit("done").alias("status"))
    even = F.col("collection") % 2 == 0
    cols = r.select("collection").distinct().select("collection", even.alias("complete"), even.alias("settled"), F.lit(False).alias("unsettled"))
    return walk.incremental_walk(r, led, cols, 8)


@query(f"""SELECT collection, collection % 2 = 0 OR n = size AS complete, (n = size OR stopped) AND all_final AS settled FROM (
  SELECT collection, count(*) AS size, count(*) FILTER (k) AS n, bool_and(terminal) FILTER (k) AS all_final, bool_or(pos = coalesce(stop, -1)) FILTER (k) AS stopped FROM (
    SELECT *, (stop IS NULL OR pos <= stop) AND pos < 8 AS k FROM (SELECT *, min(pos) FILTER (done AND terminal AND allowed AND NOT live) OVER (PARTITION BY collection) AS stop FROM ({_WALK}))) GROUP BY 1)""")
def win05_collection_flags(spark, d):
    r = runs(spark, d)
    was = r.select("collection").distinct().select("collection", (F.col("collection") % 2 == 0).alias("complete"))
    return walk.collection_flags(_walked(spark, d), r, r.select("path", F.lit("done").alias("status")), was)


@query("SELECT min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def win06_stable_pages(spark, d):
    e = t(spark, d, "events").select(F.floor(F.col("event_id") / 100).alias("fetch"), (F.col("event_id") % 100).alias("pos"), F.concat_ws("-", "user_id", "event_type").alias("id"), F.lit(10).alias("total"), "event_id")
    return walk.stable_pages(e)[0].select("event_id")


@query(f"SELECT id, strftime(created_at, '%Y-%m-%d') AS created FROM ({RUNS})")
def win07_newest_first(spark, d):
    return walk.newest_first(runs(spark, d)).select("id", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("SELECT l_partkey % 50 AS shard, max(l_suppkey) + 1 AS next FROM lineitem GROUP BY 1")
def win08_next_generation(spark, d):
    name = F.concat(fp.bundle_name(F.col("l_suppkey"), "logs"), F.lit(fp.SIDECAR_SUFFIX))
    return sealing.next_generation(t(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("shard"), name.alias("name")), "logs").select("shard", F.col("next").cast("long").alias("next"))


@query("SELECT 'a' AS org, c_custkey AS path FROM customer UNION ALL SELECT 'b', s_suppkey FROM supplier")
def set01_union_archives(spark, d):
    return listing.union_archives({"a": t(spark, d, "customer").select(F.col("c_custkey").alias("path")), "b": t(spark, d, "supplier").select(F.col("s_suppkey").alias("path"))})


@query("SELECT o_orderkey AS id FROM orders UNION SELECT l_orderkey FROM lineitem")
def set03_index_union(spark, d):
    return listing.index_union(t(spark, d, "orders").select(F.col("o_orderkey").alias("id")), t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")))


@query("SELECT url AS key FROM pages WHERE page_id % 4 <> 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 4 = 0)")
def set04_leftover_keys(spark, d):
    p = t(spark, d, "pages")
    return listing.leftover_keys(p.filter("page_id % 4 <> 0").select(F.col("url").alias("key")), p.filter("page_id % 4 = 0").select(F.col("url").alias("key")))


@query(f"SELECT 'projects/p/workspaces/w/runs/' || l_orderkey || '/' || leaf AS path, target FROM (SELECT DISTINCT l_orderkey, {_LEAF_SQL} AS leaf, CASE l_linenumber WHEN 1 THEN 'logs' WHEN 2 THEN CASE WHEN o_orderstatus = 'F' THEN 'runs.ndjson' END WHEN 3 THEN 'logs' WHEN 4 THEN 'comments.ndjson' WHEN 5 THEN 'logs' WHEN 6 THEN 'run-events.ndjson' END AS target FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 2 = 0) WHERE target IS NOT NULL")
def seal01_seal_plan(spark, d):
    path = F.concat(F.lit("projects/p/workspaces/w/runs/"), F.col("l_orderkey").cast("string"), F.lit("/"), _leaf())
    files = t(spark, d, "lineitem").select("l_orderkey", path.alias("path")).distinct()
    led = files.filter("l_orderkey % 2 = 0").select("path", F.lit("done").alias("status"))
    cols = spark.createDataFrame([("projects/p/workspaces/w", "runs", True)], "shard string, kind string, complete boolean")
    own = t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "applied").otherwise("pending").alias("status"))
    return sealing.seal_plan(files, led, cols, own).select("path", "target")


@query("SELECT CAST(doc_id AS VARCHAR) AS name, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 6 = 0 THEN 'digest_mismatch' ELSE 'ok' END AS state FROM documents")
def seal03_verify_members(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("content"), "doc_id")
    index = docs.select("name", F.when(F.col("doc_id") % 6 == 0, "wrong").otherwise(F.sha2(F.col("content").cast("binary"), 256)).alias("sha256"))
    return sealing.verify_members(docs.filter("doc_id % 5 <> 0"), index)


@query(f"SELECT path, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'upload' ELSE 'keep' END AS action FROM ({OBJECTS})")
def seal05_sync_runs(spark, d):
    none = spark.range(0).select(F.lit("").alias("shard"))
    return reconcile.sync_plan(_local(spark, d), entries(spark, d).withColumn("signature", F.lit(None).cast("struct<hash:string,size:bigint>")), _inventory(spark, d), none)


@query(f"""WITH a AS (SELECT l_orderkey, string_agg(leaf, ', ' ORDER BY rank, leaf) AS artifacts, count(*) AS n FROM (
    SELECT DISTINCT l_orderkey, {_LEAF_SQL} AS leaf, CASE l_linenumber WHEN 1 THEN 0 WHEN 3 THEN 2 WHEN 4 THEN 6 WHEN 6 THEN 7 ELSE 99 END AS rank FROM lineitem WHERE l_linenumber <> 2) GROUP BY 1)
  SELECT o_orderkey AS run_id, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS created, coalesce(artifacts, '') AS artifacts, coalesce(n, 0) AS n_artifacts, split_part(artifacts, ', ', 1) AS example
  FROM orders LEFT JOIN a ON l_orderkey = o_orderkey""")
def rep05_runs_report(spark, d):
    found = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), _leaf().alias("leaf"))
    r = t(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"))
    return reports.runs_report(r, found).withColumn("n_artifacts", F.col("n_artifacts").cast("long"))


@query("SELECT c_custkey, c_name AS name, n_name AS project FROM customer JOIN nation ON n_nationkey = c_nationkey")
def rep07_all_workspaces(spark, d):
    ws = t(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_nationkey").alias("project_id"))
    return reports.all_workspaces(ws, t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).select("c_custkey", "name", "project")


@query(f"SELECT url AS key FROM pages WHERE page_id % 9 = 0 AND page_id % 2 = 0")
def jn10_bare_bundles(spark, d):
    url = F.when(F.col("page_id") % 9 == 0, F.concat(F.lit("projects/p/workspaces/w/bundles/"), F.col("page_id"), F.lit(".zip"))).otherwise(F.concat(F.lit("plain/"), F.col("page_id")))
    p = t(spark, d, "pages").select("page_id", "url", url.alias("key"))
    index = p.filter("page_id % 2 = 1").select(F.concat("key", F.lit(".sidecar.ndjson")).alias("path"))
    return reconcile.mirror_leftovers(p, index).join(p, "key").select(F.col("url").alias("key"))


@query("SELECT 'config-versions/' || page_id || '.tar.gz' AS path, CASE WHEN page_id % 3 = 0 THEN 'write' WHEN page_id % 3 = 1 THEN 'keep' ELSE 'conflict' END AS action FROM pages WHERE page_id % 5 <> 0")
def jn11_reconcile_stubs(spark, d):
    i = F.col("page_id")
    inv = t(spark, d, "pages").select(F.concat(F.lit("config-versions/"), i, F.lit(".tar.gz")).alias("key"), F.octet_length("html").alias("size"), F.sha2(F.col("html").cast("binary"), 256).alias("sha256"), "page_id")
    plan = reconcile.stub_plan(inv, inv.filter(i % 5 == 0).select(F.col("key").alias("path")))
    stubs = inv.filter(i % 3 != 0).select(F.col("key").alias("path"), F.lit(1).alias("version"), "size", F.when(i % 3 == 2, "other").otherwise(F.col("sha256")).alias("sha256"))
    return reconcile.reconcile_stubs(plan, stubs)


@query(f"SELECT o.path FROM ({OBJECTS}) o JOIN ({ENTRIES}) e USING (path) WHERE e.status = 'done' AND o.doc_id % 3 <> 0")
def jn15_sealed_elsewhere(spark, d):
    fresh = _local(spark, d).select("path", F.col("sha256").alias("hash"), "size", "doc_id")
    led = entries(spark, d).select("path", "status").join(fresh.select("path", F.struct("hash", "size").alias("signature")), "path")
    return reconcile.sealed_elsewhere(fresh, led, fresh.filter("doc_id % 3 = 0")).select("path")


@query("SELECT l_suppkey AS bundle, CASE WHEN bool_and(l_partkey % 97 <> 0) THEN 'reclaim' ELSE 'keep' END AS action, count(*) FILTER (l_partkey % 97 = 0) AS unproven FROM lineitem GROUP BY 1")
def jn17_orphan_bundles(spark, d):
    m = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("bundle"), F.col("l_partkey").alias("name"), F.md5(F.col("l_partkey").cast("string").cast("binary")).alias("sha256"))
    return reconcile.orphan_bundles(m, m.filter("name % 97 <> 0").select("name", "sha256"))


@query("""WITH e AS (SELECT * FROM events WHERE event_type IN ('error', 'signup', 'click')), f AS (SELECT user_id, min(event_id) AS first FROM e WHERE event_type <> 'signup' GROUP BY 1)
  SELECT user_id AS path, CASE arg_max(event_type, event_id) WHEN 'error' THEN 'errored' WHEN 'signup' THEN 'reference-cleared' WHEN 'click' THEN 'reference-absent' END AS status FROM e JOIN f USING (user_id) WHERE event_id >= first GROUP BY 1""")
def cdc06_fold_gates(spark, d):
    e = F.col("event_type")
    rows = t(spark, d, "events").filter(e.isin("error", "signup", "click")).select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), F.when(e == "error", "fail").when(e == "signup", "clear").otherwise("absent").alias("event"))
    return gates.fold_gates(rows).select("path", "status")


_REVISIONS = "'policies/pol-' || user_id || CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN '.99999999T999999Z' WHEN 2 THEN '.json' ELSE '.{stamp}Z' END || '.rego'"


@query(f"""SELECT {_REVISIONS.format(stamp="' || strftime(ts, '%Y%m%dT%H%M%S') || '")} AS path, event_id, CASE WHEN event_type = 'error' AND event_id % 7 > 2 AND user_id % 4 <> 0 AND ts < TIMESTAMP '2024-01-10' THEN 'absent'
  WHEN event_type = 'error' THEN 'errored' ELSE 'done' END AS status FROM events""")
def cdc11_superseded_revisions(spark, d):
    """Revisions of every user's source, and names that only look like them; one source in four has no known time."""
    path = F.expr(_REVISIONS.format(stamp="' || date_format(ts, \"yyyyMMdd'T'HHmmss\") || '"))
    e = t(spark, d, "events").select(path.alias("path"), "event_id", F.when(F.col("event_type") == "error", "errored").otherwise("done").alias("status"))
    at = F.when(F.col("user_id") % 4 != 0, F.lit("2024-01-10").cast("timestamp_ntz"))
    return ledger.superseded_revisions(e, t(spark, d, "events").select(F.concat(F.lit("policies/pol-"), "user_id", F.lit(".rego")).alias("path"), at.alias("updated_at")).distinct())


@query(f"""SELECT path, arg_max(status, seq % 2 * 1000000000000 + seq) AS status, count(*) AS attempts FROM ({OUTCOMES}) WHERE seq % 2 = 0 OR path NOT IN
  (SELECT path FROM ({OUTCOMES}) WHERE seq % 2 = 0 AND status IN ('done', 'absent') AND CAST(split_part(path, '/', 2) AS BIGINT) % 2 = 0) GROUP BY path""")
def set02_union_tokens(spark, d):
    """Two identities' outcomes, the even ones from the first."""
    rows = outcomes(spark, d).withColumn("immutable", F.split_part("path", F.lit("/"), F.lit(2)).cast("long") % 2 == 0)
    return ledger.union_tokens(rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1")).select("path", "status", "attempts")


@query("""SELECT o_orderkey AS stem, o_orderkey % 97 AS serial, (o_orderkey % 1000 + 1) || '.0 KiB' AS size,
  concat_ws(', ', CASE WHEN bool_or(l_linenumber % 2 = 1) THEN 'raw' END, CASE WHEN bool_or(l_linenumber % 2 = 0) THEN 'json' END) AS forms FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def rep06_states_report(spark, d):
    files = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("stem"), F.when(F.col("l_linenumber") % 2 == 1, "tfstate.json").otherwise("json").alias("suffix"))
    states = t(spark, d, "orders").select(F.col("o_orderkey").alias("stem"), (F.col("o_orderkey") % 97).alias("serial"), ((F.col("o_orderkey") % 1000 + 1) * 1024).alias("size"))
    return reports.states_report(states, files).select("stem", "serial", "size", "forms")


@query(f"SELECT path, content || 'x' AS content FROM ({OBJECTS}) WHERE doc_id % 7 <> 0 AND doc_id % 11 = 0")
def cdc01_superseded(spark, d):
    rows = objects(spark, d)
    old = rows.filter("doc_id % 7 <> 0").select("path", F.when(F.col("doc_id") % 11 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")).alias("content"))
    return history.superseded(history.capture_mutable(rows, old), old).select("path", "content")


def _modules() -> None:
    """Register what the other query modules hold."""
    from tidemark import shape_queries, trip_queries  # noqa: F401


def queries() -> dict[str, Query]:
    """By name."""
    _modules()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by name."""
    _modules()
    return dict(_SQL)
