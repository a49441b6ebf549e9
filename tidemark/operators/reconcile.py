"""Plans that compare a local tree with an inventory of its mirror. Every plan is a table; carrying it out is storage work."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paths import LEDGER_LOCK, LEDGER_LOG, in_ledger, in_sealed_form, is_bundle_sidecar, is_bundle_zip, is_config_tarball, is_temp, leaf, segments, shard_key, stub_target, under_workspace
from tidemark.sources.scratch import written


def sync_eligible(path: Column) -> Column:
    """What a mirror may hold: no half-written file, no stub, and of a ledger's folder neither lock nor log."""
    ledger_own = in_ledger(path) & leaf(path).isin(LEDGER_LOCK, LEDGER_LOG)
    return ~(is_temp(leaf(path)) | stub_target(path).isNotNull() | ledger_own)


def evicted_surface(path: Column) -> Column:
    """What may live in the mirror alone: bundles and uploaded configurations."""
    return is_bundle_zip(path) | is_config_tarball(path)


def restorable(path: Column) -> Column:
    """What a restore brings back: everything eligible that doesn't live in the mirror alone."""
    return sync_eligible(path) & ~evicted_surface(path)


def eager_scope(path: Column) -> Column:
    """What is uploaded as soon as it is written: nothing of a workspace, which waits for its seal, and nothing that is evicted."""
    return ~under_workspace(path) & ~evicted_surface(path)


def seal_boundary_skip(path: Column) -> Column:
    """Eligible files that the upload at a workspace's seal leaves to the closing sweep."""
    return in_ledger(path) | is_bundle_zip(path)


def _differ(a: Column, b: Column) -> Column:
    """Both known, and not the same."""
    return F.coalesce(a != b, F.lit(False))


def upload_needed(local: DataFrame, inventory: DataFrame) -> DataFrame:
    """path, reason: absent, size, digest or equal. local has path, size, md5; inventory has key, size, md5 (null: size decides)."""
    there = inventory.select(F.col("key").alias("path"), F.col("size").alias("there_size"), F.col("md5").alias("there_md5"))
    reason = F.when(F.col("there_size").isNull(), "absent").when(F.col("size") != F.col("there_size"), "size").when(_differ(F.col("md5"), F.col("there_md5")), "digest").otherwise("equal")
    return local.join(there, "path", "left").select("path", reason.alias("reason"))


def _side(df: DataFrame):
    """STRUCT<size, md5> of a table's object; what it doesn't tell is null."""
    cell = lambda c, kind: (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c)
    return F.struct(cell("size", "long"), cell("md5", "string"))


def _zip_of(sidecar: Column) -> Column:
    return F.regexp_replace(sidecar, r"\.sidecar\.ndjson$", "")


#: What tables tell of a path: its local file, the mirror's object, whether the ledger knows it, the size that is proven there, whether its bundle's index is local.
_FACTS = {"here": "struct<size:bigint,md5:string>", "there": "struct<size:bigint,md5:string>", "known": "boolean", "recorded": "bigint", "indexed": "boolean"}


def facts(local: DataFrame, ledger: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """path and _FACTS: one row for each path of any table, from one exchange, which every task's rows are combined before.

    local has path, size, md5; inventory key, size, md5; ledger path, status, signature. Absent columns count as null.
    """

    def told(df: DataFrame, path: str, **facts: Column) -> DataFrame:
        return df.select(F.col(path).alias("path"), *[facts.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in _FACTS.items()])

    proof = F.lit(None)
    if {"status", "signature"} <= {*ledger.columns}:
        proof = F.when((F.col("status") == "done") & F.col("signature").isNotNull() & is_config_tarball(F.col("path")), F.col("signature.size"))
    rows = told(local, "path", here=_side(local)).unionByName(told(ledger, "path", known=F.lit(True), recorded=proof))
    indexes = local.filter(is_bundle_sidecar(F.col("path"))).select(_zip_of(F.col("path")).alias("path"))
    rows = rows.unionByName(told(indexes, "path", indexed=F.lit(True)))
    if inventory is not None:
        rows = rows.unionByName(told(inventory, "key", there=_side(inventory)))
    return rows.groupBy("path").agg(*[F.max(c).alias(c) for c in _FACTS])


def _local_action() -> Column:
    """What a sweep does with a local file, told from facts."""
    p, size = F.col("path"), F.col("here.size")
    tarball = F.when(F.col("recorded").isNull(), "skip").when(F.col("recorded") == size, "evict").otherwise("suspect")
    return F.when(~sync_eligible(p), "skip").when(is_bundle_zip(p), F.when(F.col("indexed"), "evict").otherwise("skip")).when(is_config_tarball(p), tarball).otherwise("sync")


def classify_sync(local: DataFrame, ledger: DataFrame) -> DataFrame:
    """path, action of local files (path, size).

    skip: not eligible, a bundle without its index, a tarball without a done
    entry (path, status, signature); evict: a bundle with its index, a tarball
    of the recorded size; suspect: a tarball of another size; sync: the rest.
    """
    return facts(local, ledger).filter("here IS NOT NULL").select("path", _local_action().alias("action"))


def _below(stale: DataFrame, former: DataFrame) -> DataFrame:
    """Keys of stale(key) strictly below a name in former(former): by equality with a key's own ancestors."""
    k = F.col("key")
    ancestors = F.transform(F.sequence(F.lit(1), F.greatest(F.size(segments(k)) - 1, F.lit(1))), lambda i: F.array_join(F.slice(segments(k), F.lit(1), i), "/"))
    return stale.select("key", F.explode(ancestors).alias("former")).filter("former <> key").join(former, "former", "left_semi").select("key").distinct()


def _pruned(found: DataFrame, local: DataFrame, lost_shards: DataFrame, aliases: DataFrame | None, resumed: bool, restoring: bool, limit: int) -> DataFrame:
    """prune_plan from facts, which are read several times: give a written table."""
    p = F.col("path")
    held = found.filter("there IS NOT NULL")
    eligible = sync_eligible(p)
    stale = held.filter(~evicted_surface(p) & ~is_bundle_sidecar(p) & (~eligible | F.col("here").isNull()))
    stale = stale.select(p.alias("key"), F.coalesce("known", F.lit(False)).alias("known"), eligible.alias("eligible"), shard_key(p).alias("shard"))
    sealed = local.filter(in_sealed_form(p)).select(shard_key(p).alias("shard"), F.lit(True).alias("sealed"), F.lit(None).cast("boolean").alias("lost"))
    shards = sealed.unionByName(lost_shards.select("shard", F.lit(None).cast("boolean").alias("sealed"), F.lit(True).alias("lost")))
    rows = stale.join(shards.groupBy("shard").agg(F.max("sealed").alias("sealed"), F.max("lost").alias("lost")), "shard", "left")
    moved = F.lit(False)
    if aliases is not None:
        former = aliases.select("former").filter("former <> ''").distinct()
        below = _below(stale.filter("known AND eligible"), former)
        rows = rows.join(below.withColumn("moved", F.lit(True)), "key", "left")
        moved = F.coalesce("moved", F.lit(False))
    reshaped = F.col("known") & (F.coalesce("sealed", F.lit(False)) | moved)
    kind = F.when(~F.col("eligible"), "ineligible").when(reshaped, "reshaped").when(F.col("lost"), "shard-lost").otherwise("unbacked")
    rows = rows.select("key", kind.alias("class"))
    # Two numbers decide for all rows; they stay in the plan, which broadcasts their one row.
    unbacked = rows.agg(F.count_if(F.col("class") == "unbacked").alias("unbacked"))
    matched = held.agg(F.count_if(F.col("here").isNotNull() & eligible).alias("matched"))
    guarded = rows.crossJoin(F.broadcast(unbacked)).crossJoin(F.broadcast(matched))
    many = (F.col("unbacked") > limit) & (F.col("unbacked") > F.col("matched"))
    refuse = F.lit(restoring or not resumed) | (F.col("class") == "shard-lost") | ((F.col("class") == "unbacked") & many)
    return guarded.select("key", "class", F.when(refuse, "refuse").otherwise("prune").alias("action"))


def prune_plan(inventory: DataFrame, local: DataFrame, ledger: DataFrame, lost_shards: DataFrame, aliases: DataFrame | None = None, resumed: bool = True, restoring: bool = False, limit: int = 100) -> DataFrame:
    """key, class, action of mirror keys that no eligible local file backs.

    Bundles, their indexes and tarballs live in the mirror and are never
    pruned. Classes: ineligible (a mirror mustn't hold it, whether or not a
    local file has its name: a ledger's own lock, a half-written file, a stub),
    reshaped (known to the ledger, in a workspace that a local sealed form shows
    to be sealed, or below a former name in aliases(former)), shard-lost (its
    shard's records are gone), unbacked. Nothing is pruned during a restore or
    by a run that didn't resume; unbacked keys are refused if they are more than
    `limit` and more than the keys that match; keys of lost shards always are.
    """
    return _pruned(written(facts(local, ledger, inventory), "facts"), local, lost_shards, aliases, resumed, restoring, limit)


def evicted_obligations(index: DataFrame, local: DataFrame) -> DataFrame:
    """path, size of what only the mirror holds: indexed bundles and proven tarballs without a local file."""
    return index.select("path", "size").distinct().join(local.select("path"), "path", "left_anti")


def verify_evicted(obligations: DataFrame, inventory: DataFrame) -> DataFrame:
    """path, state of obligations: missing, size_mismatch or ok."""
    there = inventory.select(F.col("key").alias("path"), F.col("size").alias("there"))
    state = F.when(F.col("there").isNull(), "missing").when(F.col("size") != F.col("there"), "size_mismatch").otherwise("ok")
    return obligations.join(there, "path", "left").select("path", state.alias("state"))


#: Renames up to which every task carries their trie; more are followed round by round.
RENAMES = 20_000


class Renames:
    """Renames of directories as a trie of their current names, segment by segment."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.root: dict = {}
        self.most = len(pairs)
        for current, former in pairs:
            node = self.root
            for part in current.split("/"):
                node = node.setdefault(part, {})
            node.setdefault(None, []).append(former)

    def once(self, path: str) -> Iterator[str]:
        """The spellings one rename away: one descent finds every current name at or above the path."""
        node, parts = self.root, path.split("/")
        for i, part in enumerate(parts):
            node = node.get(part)
            if node is None:
                return
            for former in node.get(None, ()):
                yield "/".join([former, *parts[i + 1 :]])

    def spellings(self, path: str) -> Iterator[tuple[str, int]]:
        """Each spelling once, with the least number of renames to it; what a cycle leads back to was found before."""
        seen, last, depth = {path}, [path], 0
        yield path, 0
        while last and depth < self.most:
            depth += 1
            last = [s for s in dict.fromkeys(x for p in last for x in self.once(p)) if s not in seen]
            seen.update(last)
            for s in last:
                yield s, depth


def alias_rewrites(paths: DataFrame, aliases: DataFrame, most: int = RENAMES) -> DataFrame:
    """path, spelling, depth: every former spelling of distinct paths under renames of directories (current, former), the path itself with depth 0.

    A spelling has the least number of renames that lead to it, at most as many
    as there are; renames may stack and form cycles. The list of renames is
    short: its trie is built once, and every path is followed through it in one
    pass, so the plan is the same whatever the depth. A list of more than `most`
    is joined instead, a round for each depth.
    """
    aliases = aliases.select("current", "former").filter("current <> former").distinct()
    pairs = [(r.current, r.former) for r in aliases.limit(most + 1).collect()]
    if len(pairs) > most:
        return _rewrites_by_rounds(paths, aliases)
    renames = Renames(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, s, d) for p in batch.column(0).to_pylist() if p is not None for s, d in renames.spellings(p)]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int32()), strict=True)], ["path", "spelling", "depth"])

    return paths.select("path").mapInArrow(run, "path string, spelling string, depth int")


def _rewrites_by_rounds(paths: DataFrame, aliases: DataFrame) -> DataFrame:
    """alias_rewrites by joins: each round meets the renames by equality with a path's own ancestors, until one finds no new spelling."""
    found = paths.select("path", F.col("path").alias("spelling"), F.lit(0).alias("depth"))
    last = found
    for depth in range(1, aliases.count() + 1):
        parts = F.split("spelling", "/")
        each = last.select("path", "spelling", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("current"))
        renamed = F.concat(F.col("former"), F.substring("spelling", F.length("current") + 1, F.length("spelling")))
        new = each.join(aliases, "current").select("path", renamed.alias("spelling"), F.lit(depth).alias("depth")).distinct()
        last = written(new.join(found.select("path", "spelling"), ["path", "spelling"], "left_anti"), "spellings")
        if last.isEmpty():
            break
        found = found.unionByName(last)
    return found


def restore_plan(inventory: DataFrame, local: DataFrame) -> DataFrame:
    """path, action, reason of the mirror's restorable objects: create what is missing, skip what is equal, replace what differs.

    Both sides have size, md5, sha256; SHA-256 decides before MD5, MD5 before
    size. Bundles and tarballs stay in the mirror; see mirror_leftovers and
    stub_plan.
    """
    here = local.select(F.col("path").alias("key"), F.col("size").alias("s"), F.col("md5").alias("m"), F.col("sha256").alias("h"))
    both = inventory.filter(restorable(F.col("key"))).join(here, "key", "left")
    pair = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    action = F.when(F.col("s").isNull(), "create").when(F.col("s") != F.col("size"), "replace").when(pair("sha256", "h"), F.when(F.col("sha256") == F.col("h"), "skip").otherwise("replace"))
    action = action.when(pair("md5", "m"), F.when(F.col("md5") == F.col("m"), "skip").otherwise("replace")).otherwise("skip")
    reason = F.when(F.col("s").isNull(), "missing").when(F.col("s") != F.col("size"), "size").when(pair("sha256", "h"), "sha256").when(pair("md5", "m"), "md5").otherwise("size only")
    return both.select(F.col("key").alias("path"), action.alias("action"), reason.alias("reason"))


def snapshot_conflict(local: DataFrame, mirror: DataFrame) -> DataFrame:
    """org, shard, action of snapshots (org, shard, last_run_at, run_count) that differ on both sides.

    Only an organisation's own (shard '') can be ordered: one is newer if its
    run is later and it counts no fewer runs. A newer mirror's replaces, a newer
    local one is kept (skip), all else is refused. Where nothing is local, the
    mirror's is created.
    """
    m = mirror.select("org", "shard", F.col("last_run_at").alias("at"), F.col("run_count").alias("n"))
    here = local.select("org", "shard", "last_run_at", "run_count", F.lit(True).alias("here"))
    newer = (F.col("at") > F.col("last_run_at")) & (F.col("n") >= F.col("run_count"))
    older = (F.col("last_run_at") > F.col("at")) & (F.col("run_count") >= F.col("n"))
    action = F.when(F.col("here").isNull(), "create").when(F.col("shard") != "", "refuse").when(newer, "replace").when(older, "skip").otherwise("refuse")
    return m.join(here, ["org", "shard"], "left").select("org", "shard", action.alias("action"))


def mirror_leftovers(inventory: DataFrame, local: DataFrame) -> DataFrame:
    """Keys that no restored object accounts for: not restorable ones, and bundles without an index on either side. One exchange."""
    k = F.col("key")
    paths = inventory.select("key", F.lit(True).alias("held")).unionByName(local.select(F.col("path").alias("key"), F.lit(False).alias("held")))
    rows = paths.filter("held").select("key", "held", F.lit(False).alias("indexed"))
    rows = rows.unionByName(paths.filter(is_bundle_sidecar(k)).select(_zip_of(k).alias("key"), F.lit(False).alias("held"), F.lit(True).alias("indexed")))
    each = rows.groupBy("key").agg(F.max("held").alias("held"), F.max("indexed").alias("indexed")).filter("held")
    return each.filter((~restorable(k) & ~evicted_surface(k)) | (is_bundle_zip(k) & ~F.col("indexed"))).select("key")


def stub_plan(inventory: DataFrame, local: DataFrame) -> DataFrame:
    """path, size, sha256 of stubs to write: the mirror's tarballs that aren't local."""
    return inventory.filter(is_config_tarball(F.col("key"))).select(F.col("key").alias("path"), "size", "sha256").join(local.select("path"), "path", "left_anti")


def reconcile_stubs(plan: DataFrame, stubs: DataFrame, supported: int = 1) -> DataFrame:
    """path, action of planned stubs against present ones (path, version, size, sha256): write, keep, conflict or newer."""
    s = stubs.select("path", "version", F.col("size").alias("s"), F.col("sha256").alias("h"))
    action = F.when(F.col("version").isNull(), "write").when(F.col("version") > supported, "newer").when((F.col("s") != F.col("size")) | _differ(F.col("h"), F.col("sha256")), "conflict").otherwise("keep")
    return plan.join(s, "path", "left").select("path", action.alias("action"))


def confirm_copy(local: DataFrame, inventory: DataFrame) -> DataFrame:
    """path, state of local (path, size, md5, sha256): ok, mismatch, needs_read_back (no digest on both sides) or missing."""
    there = inventory.select(F.col("key").alias("path"), F.col("size").alias("s"), F.col("md5").alias("m"), F.col("sha256").alias("h"))
    any_digest = (F.col("m").isNotNull() & F.col("md5").isNotNull()) | (F.col("h").isNotNull() & F.col("sha256").isNotNull())
    wrong = (F.col("size") != F.col("s")) | _differ(F.col("md5"), F.col("m")) | _differ(F.col("sha256"), F.col("h"))
    state = F.when(F.col("s").isNull(), "missing").when(wrong, "mismatch").when(any_digest, "ok").otherwise("needs_read_back")
    return local.join(there, "path", "left").select("path", state.alias("state"))


def heal_plan(obligations: DataFrame, inventory: DataFrame, aliases: DataFrame) -> DataFrame:
    """path, source, action: an only copy under a former key is copied to its current one, then released there; without digests it stays."""
    spelled = alias_rewrites(obligations.select("path"), aliases).filter("depth > 0")
    here = inventory.select(F.col("key").alias("path"), F.lit(True).alias("present"))
    old = inventory.select(F.col("key").alias("spelling"), "md5", "sha256")
    rows = spelled.join(old, "spelling").join(here, "path", "left")
    digest = F.col("md5").isNotNull() | F.col("sha256").isNotNull()
    action = F.when(F.col("present"), "release").when(digest, "copy").otherwise("leave")
    return rows.select("path", F.col("spelling").alias("source"), action.alias("action"))


def action_totals(plan: DataFrame, size: str | None = None) -> DataFrame:
    """action, n, bytes of a plan."""
    total = F.coalesce(F.sum(size), F.lit(0)) if size else F.lit(0)
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("n"), total.cast("long").alias("bytes"))


def sealed_elsewhere(fresh: DataFrame, ledger: DataFrame, local: DataFrame) -> DataFrame:
    """Fresh objects (path, hash, size) that needn't be written: done with the same signature, and not loose."""
    same = ledger.filter("status = 'done'").select("path", F.col("signature.hash").alias("hash"), F.col("signature.size").alias("size"))
    return fresh.join(same, ["path", "hash", "size"], "left_semi").join(local.select("path"), "path", "left_anti")


def reconcile_sealed(members: DataFrame, index: DataFrame) -> DataFrame:
    """name, state of members (name, sha256) against all index rows (name, ord, sha256): sealed only if the newest row has their digest."""
    newest = index.groupBy("name").agg(F.max_by("sha256", "ord").alias("recorded"))
    state = F.when(F.col("recorded") == F.col("sha256"), "already_sealed").otherwise("fresh")
    return members.join(newest, "name", "left").select("name", state.alias("state"))


def orphan_bundles(members: DataFrame, indexed: DataFrame) -> DataFrame:
    """bundle, action, unproven of bundles without an index: members (bundle, name, sha256; a null name: no members) recorded elsewhere with one digest let it go."""
    known = indexed.select("name", "sha256", F.lit(True).alias("known")).distinct()
    per = members.join(known, ["name", "sha256"], "left").groupBy("bundle").agg(F.count("name").alias("n"), F.count_if(F.col("name").isNotNull() & F.col("known").isNull()).alias("unproven"))
    return per.select("bundle", F.when((F.col("n") > 0) & (F.col("unproven") == 0), "reclaim").otherwise("keep").alias("action"), "unproven")


def eviction_plan(local: DataFrame, ledger: DataFrame, inventory: DataFrame) -> DataFrame:
    """path, safe_to_drop of what could be evicted: proven here and confirmed in the mirror."""
    able = classify_sync(local, ledger).filter("action = 'evict'").select("path")
    return confirm_copy(local.join(able, "path", "left_semi"), inventory).select("path", (F.col("state") == "ok").alias("safe_to_drop"))


def sync_plan(local: DataFrame, ledger: DataFrame, inventory: DataFrame, lost_shards: DataFrame, aliases: DataFrame | None = None, resumed: bool = True, restoring: bool = False, limit: int = 100) -> DataFrame:
    """path, action of a whole synchronisation: upload, evict, suspect, skip, keep for local files; and prune or refuse for the mirror's own keys.

    All tables meet in one exchange by path (see facts); the flags are prune_plan's.
    """
    found = written(facts(local, ledger, inventory), "facts")
    own = _local_action()
    changed = F.col("there").isNull() | (F.col("here.size") != F.col("there.size")) | _differ(F.col("here.md5"), F.col("there.md5"))
    action = F.when(own.isin("skip", "suspect"), own).when(changed, "upload").when(own == "evict", "evict").otherwise("keep")
    mine = found.filter("here IS NOT NULL").select("path", action.alias("action"))
    return mine.unionByName(_pruned(found, local, lost_shards, aliases, resumed, restoring, limit).select(F.col("key").alias("path"), "action"))
