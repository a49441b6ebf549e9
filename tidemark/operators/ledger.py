"""The ledger: one current row per object, folded from the outcomes of all attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.paths import revision_of, revision_path, revision_stamp, shard_key, under_prefix
from tidemark.functions.status import classify_error, status_gate, status_settled


def should_fetch(candidates: DataFrame, ledger: DataFrame, retry_absent: bool = False) -> DataFrame:
    """Candidates (path, …) without an entry, with an unsettled one, or, if asked for, with an absent one."""
    settled = status_settled(F.col("status"))
    done = ledger.filter(settled & (F.col("status") != "absent") if retry_absent else settled)
    return candidates.join(done.select("path"), "path", "left_anti")


def failures(ledger: DataFrame) -> DataFrame:
    """Errored, then forbidden entries, each by path."""
    rank = F.when(F.col("status") == "errored", 0).otherwise(1)
    return ledger.filter(F.col("status").isin("errored", "forbidden")).orderBy(rank, "path")


def under(ledger: DataFrame, prefixes: DataFrame) -> DataFrame:
    """prefix and, over the entries below it: n_done, n_errored, has_unsettled, has_absent. `prefixes` is a short list.

    Each entry is expanded to its own ancestors, so prefixes are met by equality whatever their number.
    """
    parts = F.split("path", "/")
    ancestors = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    each = ledger.select("status", F.explode(ancestors).alias("prefix")).join(prefixes.select("prefix").distinct(), "prefix", "right")
    known = F.col("status").isNotNull()
    return each.groupBy("prefix").agg(
        F.count_if(F.col("status") == "done").alias("n_done"),
        F.count_if(F.col("status") == "errored").alias("n_errored"),
        F.coalesce(F.bool_or(known & ~status_settled(F.col("status"))), F.lit(False)).alias("has_unsettled"),
        F.coalesce(F.bool_or(F.col("status").isin("absent", "reference-absent")), F.lit(False)).alias("has_absent"),
    )


def done_under(ledger: DataFrame, prefix: str) -> DataFrame:
    """Paths of done entries at or under one prefix."""
    return ledger.filter((F.col("status") == "done") & under_prefix(F.col("path"), F.lit(prefix))).select("path")


def confirm_absent(attempts: DataFrame) -> DataFrame:
    """run_id, path, http_status, retries, confirmed: a first 404 is asked once more in its run, and that answer decides.

    Attempts (run_id, path, attempt, http_status) after the deciding one are other reads.
    """
    order = Window.partitionBy("run_id", "path").orderBy("attempt")
    two = attempts.withColumn("k", F.row_number().over(order)).filter("k <= 2").groupBy("run_id", "path")
    per = two.agg(F.max(F.when(F.col("k") == 1, F.col("http_status"))).alias("first"), F.max(F.when(F.col("k") == 2, F.col("http_status"))).alias("second"))
    again = F.coalesce((F.col("first") == 404) & F.col("second").isNotNull(), F.lit(False))
    decided = F.when(again, F.col("second")).otherwise(F.col("first"))
    return per.select("run_id", "path", decided.alias("http_status"), again.cast("long").alias("retries"), F.coalesce(again & (F.col("second") == 404), F.lit(False)).alias("confirmed"))


def map_outcome(http_status: Column, message: Column, cause: Column, wrote: Column) -> Column:
    """STRUCT<status, transient> of an attempt; a write that failed here is errored."""
    kind = classify_error(http_status, message, cause)
    failed = (http_status >= 400) | cause.isNotNull()
    status = F.when(~F.coalesce(failed, F.lit(False)), F.when(wrote, "done").otherwise("errored")).when(kind == "terminal", "absent").when(kind == "forbidden", "forbidden").otherwise("errored")
    return F.struct(status.alias("status"), (F.coalesce(failed, F.lit(False)) & (kind == "transient")).alias("transient"))


def fold_outcomes(outcomes: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Ledger rows by path from outcomes (path, seq, at, status, hash, size, updated_at, error, transient).

    first_seen is the earliest time and attempts the number of outcomes; status and the
    error fields are the last outcome's (an error's time only where it failed); fetched_at
    is the last done or absent one's; signature and updated_at are the last done one's,
    null included. seq orders outcomes and has no ties. `previous` has this function's
    columns; its rows are older than all outcomes. All partial aggregates: one shuffle.
    """
    done, settled = F.col("status") == "done", F.col("status").isin("done", "absent")
    failed = F.col("status").isin("errored", "forbidden")
    new = outcomes.groupBy("path").agg(
        F.max_by("status", "seq").alias("status"),
        F.min("at").alias("first_seen"),
        F.max_by("at", F.when(settled, F.col("seq"))).alias("fetched_at"),
        F.max_by("updated_at", F.when(done, F.col("seq"))).alias("updated_at"),
        F.max_by(F.when(failed, F.col("at")), "seq").alias("last_error_at"),
        F.max_by(F.when(failed, F.col("error")), "seq").alias("last_error"),
        F.max_by(F.struct("hash", "size"), F.when(done, F.col("seq"))).alias("signature"),
        F.count(F.lit(1)).alias("attempts"),
        F.max_by("transient", "seq").alias("transient"),
        F.bool_or(settled).alias("settled_here"),
        F.bool_or(done).alias("done_here"),
    )
    if previous is None:
        return new.drop("settled_here", "done_here")
    old = previous.select("path", *[F.col(c).alias(f"old_{c}") for c in previous.columns if c != "path"])
    both = new.join(old, "path", "full")
    fresh = F.col("attempts").isNotNull()
    last = {c: F.when(fresh, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in ("status", "last_error_at", "last_error", "transient")}
    return both.select(
        "path",
        last["status"],
        F.least("first_seen", "old_first_seen").alias("first_seen"),
        F.when(F.coalesce("settled_here", F.lit(False)), F.col("fetched_at")).otherwise(F.col("old_fetched_at")).alias("fetched_at"),
        F.when(F.coalesce("done_here", F.lit(False)), F.col("updated_at")).otherwise(F.col("old_updated_at")).alias("updated_at"),
        last["last_error_at"],
        last["last_error"],
        F.when(F.coalesce("done_here", F.lit(False)), F.col("signature")).otherwise(F.col("old_signature")).alias("signature"),
        (F.coalesce("attempts", F.lit(0)) + F.coalesce("old_attempts", F.lit(0))).alias("attempts"),
        last["transient"],
    )


def union_tokens(*runs: DataFrame) -> DataFrame:
    """The ledger of several identities' outcomes on one archive, in run order.

    Outcomes have fold_outcomes' columns. Immutable objects (`immutable`) that an earlier
    run settled aren't read again, so a later refusal can't replace them; of a mutable one
    the status may regress while its last good signature stays.
    """
    rows = runs[0].withColumn("run", F.lit(0))
    for i, r in enumerate(runs[1:], 1):
        rows = rows.unionByName(r.withColumn("run", F.lit(i)))
    earlier = rows.filter(F.col("immutable") & status_settled(F.col("status"))).groupBy("path").agg(F.min("run").alias("settled_in"))
    kept = rows.join(earlier, "path", "left").filter("settled_in IS NULL OR run <= settled_in")
    return fold_outcomes(kept.withColumn("seq", F.struct("run", "seq")).drop("run", "settled_in", "immutable"))


def tally(ledger: DataFrame) -> DataFrame:
    """status, n of objects (not gates)."""
    return ledger.filter(~status_gate(F.col("status"))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def run_totals(outcomes: DataFrame) -> DataFrame:
    """run_id, status, objects, bytes: each object of a run once, by its last status there; bytes of its changed writes."""
    per = outcomes.groupBy("run_id", "path").agg(F.max_by("status", "seq").alias("status"), F.coalesce(F.sum(F.when(F.col("changed"), F.col("size"))), F.lit(0)).alias("bytes"))
    return per.groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("objects"), F.sum("bytes").alias("bytes"))


def run_incomplete(outcomes: DataFrame, dropped: DataFrame) -> DataFrame:
    """run_id, incomplete: a surface was dropped, or nothing got done while something failed."""
    per = outcomes.groupBy("run_id").agg(F.count_if(F.col("status") == "done").alias("d"), F.count_if(F.col("status").isin("errored", "forbidden")).alias("f"))
    lost = dropped.groupBy("run_id").agg(F.count(F.lit(1)).alias("lost"))
    return per.join(lost, "run_id", "full").select("run_id", ((F.coalesce("lost", F.lit(0)) > 0) | ((F.coalesce("d", F.lit(0)) == 0) & (F.coalesce("f", F.lit(0)) > 0))).alias("incomplete"))


def high_water_marks(listing: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """collection, high_water_mark: the newest created_at, never before the stored one."""
    new = listing.groupBy("collection").agg(F.max("created_at").alias("mark"))
    if stored is None:
        return new.withColumnRenamed("mark", "high_water_mark")
    return new.join(stored, "collection", "full").select("collection", F.greatest("mark", "high_water_mark").alias("high_water_mark"))


def surface_coverage(surfaces: DataFrame, ledger: DataFrame) -> DataFrame:
    """org, surface and counts of archived, absent, forbidden, errored and missing objects (org, surface, path)."""
    s = F.col("status")
    return surfaces.join(ledger.select("path", "status"), "path", "left").groupBy("org", "surface").agg(
        F.count_if(s == "done").alias("archived"), F.count_if(s == "absent").alias("absent"), F.count_if(s == "forbidden").alias("forbidden"), F.count_if(s == "errored").alias("errored"), F.count_if(s.isNull()).alias("missing")
    )


def replay_log(log: DataFrame, present_shards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records to apply, dropped per shard): lines before the first corrupt one, of shards that still exist.

    log has ord, shard, path, corrupt and more; a line without shard is routed by its path.
    """
    torn = log.agg(F.min(F.when(F.col("corrupt"), F.col("ord")))).first()[0]
    good = (log if torn is None else log.filter(F.col("ord") < torn)).drop("corrupt")
    routed = good.withColumn("shard", F.coalesce("shard", shard_key(F.col("path"))))
    kept = routed.join(present_shards, "shard", "left_semi")
    return kept, routed.join(present_shards, "shard", "left_anti").groupBy("shard").agg(F.count(F.lit(1)).alias("dropped"))


def compact(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """The new snapshot rows of the shards a log touches: the last record of a path wins; other shards aren't returned."""
    touched = log.select("shard").distinct()
    cols = [c for c in snapshot.columns]
    rows = snapshot.join(touched, "shard", "left_semi").select(*cols, F.lit(-1).cast("long").alias("ord")).unionByName(log.select(*cols, "ord"))
    return rows.groupBy("shard", "path").agg(*[F.max_by(c, "ord").alias(c) for c in cols if c not in ("shard", "path")]).select(cols)


def migrate_entries(ledger: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    """Audit page slots recorded absent become errored, so they are read again; done sources of policies (id, updated_at) take over a time they lack."""
    from tidemark.functions.paths import is_page_name, leaf, policy_source_id

    slot = is_page_name(leaf(F.col("path"))) & (F.col("status") == "absent")
    rows = ledger.withColumn("status", F.when(slot, "errored").otherwise(F.col("status")))
    if policies is None:
        return rows
    source = F.when(F.startswith("path", F.lit("policies/")) & (F.col("status") == "done") & F.col("updated_at").isNull(), policy_source_id(leaf(F.col("path"))))
    known = policies.filter("id IS NOT NULL").groupBy(F.col("id").alias("policy")).agg(F.max("updated_at").alias("policy_at"))
    # Only the few rows that lack a time meet the policies.
    bare = rows.withColumn("policy", source)
    filled = bare.filter("policy IS NOT NULL").join(known, "policy", "left").withColumn("updated_at", F.col("policy_at"))
    return bare.filter("policy IS NULL").select(ledger.columns).unionByName(filled.select(ledger.columns))


def revision_key(listed: DataFrame, ledger: DataFrame) -> DataFrame:
    """path, key of listed (path, updated_at): where the listed revision is captured, at the plain path or at revision_path.

    Plain while that isn't settled, or the listed time is unknown; stamped where
    that very name still has to be fetched, or the listed time is later than the
    plain entry's updated_at (fetched_at where that is unknown).
    """
    old = ledger.select("path", "status", F.coalesce("updated_at", "fetched_at").alias("seen"))
    again = ledger.filter(~status_settled(F.col("status")) & revision_of(F.col("path")).isNotNull()).select(F.col("path").alias("stamped"), F.lit(True).alias("again")).distinct()
    rows = listed.select("path", "updated_at", revision_path(F.col("path"), F.col("updated_at")).alias("stamped"))
    rows = rows.join(old, "path", "left").join(again, "stamped", "left")
    stamped = status_settled(F.col("status")) & F.col("updated_at").isNotNull() & (F.coalesce("again", F.lit(False)) | (F.col("updated_at") > F.col("seen")))
    return rows.select("path", F.when(F.coalesce(stamped, F.lit(False)), F.col("stamped")).otherwise(F.col("path")).alias("key"))


def superseded_revisions(ledger: DataFrame, active: DataFrame) -> DataFrame:
    """Errored revisions of sources whose stamp is before the current one's, of active (path, updated_at: plain path and time), become absent; all else stays.

    What isn't stamped is never touched, nor is anything of a source whose time is unknown.
    """
    current = active.filter("updated_at IS NOT NULL").groupBy(F.col("path").alias("base")).agg(F.max(revision_stamp(F.col("updated_at"))).alias("current"))
    # Only the few errored revisions meet the sources.
    marked = ledger.withColumn("revision", F.when(F.col("status") == "errored", revision_of(F.col("path"))))
    met = marked.filter("revision IS NOT NULL").withColumn("base", F.col("revision.path")).join(current, "base", "left")
    settled = met.withColumn("status", F.when(F.col("revision.stamp") < F.col("current"), "absent").otherwise(F.col("status")))
    return marked.filter("revision IS NULL").select(ledger.columns).unionByName(settled.select(ledger.columns))
