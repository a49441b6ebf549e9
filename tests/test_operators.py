import datetime as dt
import hashlib
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions import content
from tidemark.operators import audit, gates, history, ledger, listing, reconcile, refs, scan, sealing, walk
from tidemark.plans import reports
from tidemark.sources import files, readers, scratch, snapshots, writers
from tidemark.streaming import feeds


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_should_fetch(rows):
    led = rows([("a", "done"), ("b", "absent"), ("c", "errored"), ("d", "forbidden")], "path string, status string")
    cand = rows([(x,) for x in "abcde"], "path string")
    assert got(ledger.should_fetch(cand, led), "path") == [("c",), ("d",), ("e",)]
    assert got(ledger.should_fetch(cand, led, True), "path") == [("b",), ("c",), ("d",), ("e",)]


def fold_model(records):
    """The fold, one record after the other."""
    e = None
    for at, status, h, size, updated, error, transient in records:
        e = e or {"first_seen": at, "attempts": 0, "fetched_at": None, "updated_at": None, "signature": None}
        e |= {"status": status, "attempts": e["attempts"] + 1, "transient": transient, "last_error": error if status in ("errored", "forbidden") else None}
        if status in ("done", "absent"):
            e["fetched_at"] = at
        if status == "done":
            e |= {"updated_at": updated, "signature": (h, size)}
    return e


def test_fold_equals_a_sequential_fold_and_can_be_split(spark, rows):
    rng = random.Random(5)
    data = {p: [(p, i, rng.choice(["done", "absent", "errored", "forbidden"]), f"h{i}", i, rng.choice([None, i]), f"e{i}", rng.random() < 0.5) for i in range(rng.randint(1, 7))] for p in "abcdefgh"}
    schema = "path string, seq bigint, at bigint, status string, hash string, size bigint, updated_at bigint, error string, transient boolean"
    flat = [(p, s, s, *rest) for rs in data.values() for p, s, *rest in rs]
    want = {p: fold_model([r[1:] for r in rs]) for p, rs in data.items()}
    whole = ledger.fold_outcomes(rows(flat, schema))
    split = ledger.fold_outcomes(rows([r for r in flat if r[1] >= 3] or flat[:0], schema), ledger.fold_outcomes(rows([r for r in flat if r[1] < 3], schema)))
    for out in (whole, split):
        for r in out.collect():
            w = want[r.path]
            assert (r.status, r.attempts, r.first_seen, r.fetched_at, r.updated_at, r.last_error, r.transient) == tuple(w[k] for k in ("status", "attempts", "first_seen", "fetched_at", "updated_at", "last_error", "transient"))
            assert (tuple(r.signature) if r.signature else None) == w["signature"]


def test_gates_count_real_transitions_only(rows):
    events = [("g", 1, "open"), ("g", 2, "open"), ("g", 3, "clear"), ("g", 4, "clear"), ("g", 5, "open"), ("h", 1, "open"), ("h", 2, "fail"), ("h", 3, "open"), ("h", 4, "absent"), ("i", 1, "clear"), ("j", 1, "clear"), ("j", 2, "absent"), ("j", 3, "clear")]
    assert got(gates.fold_gates(rows(events, "path string, seq int, event string")), "path", "status", "attempts") == [("g", "pending", 3), ("h", "reference-absent", 3), ("j", "reference-cleared", 2)]


def test_replay_stops_at_the_tear(rows):
    log = rows([(1, None, "projects/p/workspaces/w/a", False), (2, "gone", "b", False), (3, "", "c", True), (4, "", "d", False)], "ord int, shard string, path string, corrupt boolean")
    kept, dropped = ledger.replay_log(log, rows([("projects/p/workspaces/w",), ("",)], "shard string"))
    assert got(kept, "ord") == [(1,)] and got(dropped, "shard", "dropped") == [("gone", 1)]


def history_model(contents):
    """Versions and tombstones, one observation after the other: (time, content or None)."""
    out, islands = [], []
    for at, c in enumerate(contents):
        if c is None and not islands:
            continue
        if islands and islands[-1][0] == c:
            islands[-1][2] = at
        else:
            islands.append([c, at, at])
    for i, (c, first, last) in enumerate(islands):
        after = i > 0 and islands[i - 1][0] is None
        if c is None:
            out.append((first, None))
        elif after or i < len(islands) - 1:
            out.append((first if after else last, c))
    return out


def test_history_equals_a_sequential_model(rows):
    rng = random.Random(7)
    data = {f"p{k}": [rng.choice(["x", "y", None]) for _ in range(rng.randint(1, 8))] for k in range(60)}
    flat = [(p, i, i, c) for p, cs in data.items() for i, c in enumerate(cs)]
    out = history.build_history(rows(flat, "path string, ord int, at int, content string"))
    assert got(out, "path", "fetched_at", "content") == sorted(((p, *v) for p, cs in data.items() for v in history_model(cs)), key=str)


def test_history_leaves_out_what_is_no_version(spark, rows):
    seen = rows([("a", 0, 0, b"x"), ("a", 1, 1, b""), ("a", 2, 2, None), ("a", 3, 3, b""), ("a", 4, 4, b"\xff"), ("a", 5, 5, None), ("a", 6, 6, b"y"), ("b", 0, 0, b""), ("b", 1, 1, b"z")], "path string, ord int, at int, content binary")
    assert got(history.build_history(seen), "path", "fetched_at", "content", "deleted") == [("a", 0, bytearray(b"x"), False), ("a", 2, None, True), ("a", 6, bytearray(b"y"), False)]


def test_as_of(rows):
    versions = rows([("a", 1, "x", False), ("a", 3, None, True), ("a", 5, "y", False), ("b", 4, "z", False)], "path string, since int, content string, deleted boolean")
    assert [got(history.history_as_of(versions, t), "path", "content") for t in (2, 3, 5)] == [[("a", "x")], [], [("a", "y"), ("b", "z")]]


def walk_model(items, done, allowed, count):
    out, live = [], False
    for at, (i, terminal) in enumerate(items):
        if count is not None and at >= count:
            break
        live |= not terminal
        out.append(i)
        if i in done and terminal and allowed and not live:
            break
    return out


def test_walk_equals_a_sequential_model(rows):
    rng = random.Random(11)
    listed, flags, want = [], [], {}
    done = {(c, i) for c in range(40) for i in range(8) if rng.random() < 0.6}
    for c in range(40):
        allowed, items = rng.random() < 0.7, [(i, rng.random() < 0.7) for i in range(rng.randint(1, 8))]
        listed += [(c, i, f"{c}/{i}", 100 - i, term) for i, term in items]
        flags.append((c, allowed, allowed, False))
        want[c] = walk_model(items, {i for k, i in done if k == c}, allowed, 6)
    led = rows([(f"{c}/{i}", "done") for c, i in done], "path string, status string")
    out = walk.incremental_walk(rows(listed + listed[:5], "collection int, id int, path string, created_at int, terminal boolean"), led, rows(flags, "collection int, complete boolean, settled boolean, unsettled boolean"), 6)
    found = {}
    for r in out.orderBy("collection", "at").collect():
        found.setdefault(r.collection, []).append(r.id)
    assert found == want


def test_pages_serve_once(rows):
    pages = rows([(1, 1, "a", 4), (1, 2, "b", 4), (2, 1, "b", 3), (2, 2, None, 3), (2, 3, None, 3), (3, 1, "c", 5)], "fetch int, pos int, id string, total int")
    served, shrunk = walk.stable_pages(pages)
    assert got(served, "fetch", "pos") == [(1, 1), (1, 2), (2, 2), (2, 3), (3, 1)] and got(shrunk, "fetch", "lost") == [(2, 1)]


def test_audit_boundary(rows):
    ev = rows([("a", 5), ("b", 5), (None, 5), (None, 6), ("c", 6), ("c", 6), ("d", 4)], "id string, ts int")
    new, cursor = audit.audit_increment(ev, 5, rows([("a",)], "id string"))
    assert got(new, "id", "ts") == [("b", 5), ("c", 6), (None, 6)] and got(cursor, "cursor", "n") == [(6, 3)]


def test_prune_guards(spark, rows):
    led, none = rows([("k1", "done")], "path string, status string"), rows([], "shard string")

    def plan(keys, local, **more):
        return reconcile.prune_plan(rows([(k,) for k in keys], "key string"), rows([(k,) for k in local], "path string"), led, none, limit=3, **more)

    many = [f"x{i}" for i in range(4)]
    assert got(plan(["k1", *many], ["l"]), "action") == [("refuse",)] * 5  # over the limit and over the matches; known alone reshapes nothing
    assert got(plan(many, []), "action") == [("refuse",)] * 4
    assert got(plan(many[:3], []), "action") == [("prune",)] * 3  # at the limit
    matched = [f"m{i}" for i in range(4)]
    assert got(plan(many + matched, matched), "action") == [("prune",)] * 4  # as many matches
    assert got(plan(many[:1], [], restoring=True), "action") == [("refuse",)] == got(plan(many[:1], [], resumed=False), "action")
    lost = reconcile.prune_plan(rows([("projects/p/workspaces/w/a",)], "key string"), rows([], "path string"), led, rows([("projects/p/workspaces/w",)], "shard string"))
    assert got(lost, "class", "action") == [("shard-lost", "refuse")]


def test_prune_keeps_what_lives_in_the_mirror_alone(rows):
    w = "projects/p/workspaces/w"
    keys = [f"{w}/bundles/logs.gen0001.zip", f"{w}/bundles/logs.gen0001.zip.sidecar.ndjson", "config-versions/cv.tar.gz", f"{w}/.ledger/log.ndjson", f"{w}/.ledger/snapshot.json", f"{w}/runs/r/plan.log", f"{w}/runs/r/new.log", "projects/old/workspaces/v/x.json", "projects/old"]
    led = rows([(f"{w}/runs/r/plan.log",), ("projects/old/workspaces/v/x.json",), ("projects/old",), ("config-versions/cv.tar.gz",)], "path string")
    local = rows([(f"{w}/rollups/runs.ndjson",)], "path string")
    plan = reconcile.prune_plan(rows([(k,) for k in keys], "key string"), local, led, rows([(w,)], "shard string"), rows([("projects/old",), ("",)], "former string"))
    assert dict(got(plan, "key", "class")) == {
        f"{w}/.ledger/log.ndjson": "ineligible",
        f"{w}/.ledger/snapshot.json": "shard-lost",
        f"{w}/runs/r/plan.log": "reshaped",
        f"{w}/runs/r/new.log": "shard-lost",
        "projects/old/workspaces/v/x.json": "reshaped",
        "projects/old": "unbacked",
    }


def test_prune_takes_what_a_mirror_must_not_hold(rows):
    """Whether or not a local file has its name; and a local file that is eligible guards its key."""
    w = "projects/p/workspaces/w"
    bad = [f"{w}/.ledger/lock", f"{w}/.ledger/log.ndjson", f"{w}/.atomicfile-1.tmp", "config-versions/cv.tar.gz.remote.json"]
    keys, led = [*bad, f"{w}/run.json", f"{w}/bundles/logs.gen0001.zip.sidecar.ndjson"], rows([], "path string, status string")
    for local in (keys, []):
        plan = reconcile.prune_plan(rows([(k,) for k in keys], "key string"), rows([(k,) for k in local], "path string"), led, rows([], "shard string"))
        assert got(plan, "key", "class", "action") == sorted([(k, "ineligible", "prune") for k in bad] + ([] if local else [(f"{w}/run.json", "unbacked", "prune")]))
    held = rows([(k, 1, "m") for k in keys], "path string, size bigint, md5 string")
    plan = reconcile.sync_plan(held, rows([], "path string, status string, signature struct<hash:string,size:bigint>"), held.withColumnRenamed("path", "key"), rows([], "shard string"))
    assert got(plan, "path", "action") == sorted([(k, a) for k in bad for a in ("skip", "prune")] + [(keys[4], "keep"), (keys[5], "keep")])


def test_a_sync_meets_its_tables_in_one_exchange(spark, rows):
    sides = rows([("a", 1, "m")], "path string, size bigint, md5 string")
    led = rows([("a", "done", ("h", 1))], "path string, status string, signature struct<hash:string,size:bigint>")
    found = reconcile.facts(sides, led, sides.withColumnRenamed("path", "key"))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [tuple(r) for r in found.collect()] == [("a", (1, "m"), (1, "m"), True, None, None)]
    # What decides about shards and former names has other keys.
    plan = reconcile.sync_plan(sides, led, sides.withColumnRenamed("path", "key"), rows([("s",)], "shard string"), rows([("x",)], "former string"))
    assert plan._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(path") == 0


def test_revisions_keep_the_names_a_retry_waits_for(rows):
    day = lambda n: dt.datetime(2024, 1, n)
    led = rows(
        [("p/a.rego", "done", day(2), day(9)), ("p/b.rego", "done", None, day(2)), ("p/c.rego", "errored", day(2), None), ("p/d.rego", "done", day(8), day(2)), ("p/d.20240105T000000Z.rego", "errored", None, None), ("p/e.rego", "done", day(8), None), ("p/e.20240105T000000Z.rego", "done", None, None), ("p/f.rego", "done", day(1), None)],
        "path string, status string, updated_at timestamp, fetched_at timestamp",
    )
    listed = rows([(f"p/{x}.rego", day(5)) for x in "abcdeg"] + [("p/f.rego", None)], "path string, updated_at timestamp")
    stamped = "p/{}.20240105T000000Z.rego".format
    want = {"a": stamped("a"), "b": stamped("b"), "c": "p/c.rego", "d": stamped("d"), "e": "p/e.rego", "f": "p/f.rego", "g": "p/g.rego"}
    assert dict(got(ledger.revision_key(listed, led), "path", "key")) == {f"p/{k}.rego": v for k, v in want.items()}
    errored = [stamped("a"), "p/a.20240104T235959Z.rego", "p/a.rego", "p/a.json", "p/a.20241399T000000Z.rego", "p/b.20240101T000000Z.rego", "p/z.20240101T000000Z.rego"]
    table = rows([(p, "errored") for p in errored] + [("p/a.20240101T000000Z.rego", "done")], "path string, status string")
    gone = ledger.superseded_revisions(table, rows([("p/a.rego", day(5)), ("p/b.rego", None)], "path string, updated_at timestamp"))
    assert gone.filter("status = 'absent'").select("path").collect() == [("p/a.20240104T235959Z.rego",)] and gone.count() == 8


def test_versions_beyond_64_bits(rows):
    big = "9" * 25
    versions = ["1.2.3", f"1.{big}.0", f"{big}.0.0", "1.2.3.4", "1.2", "1.2.0", f"1.2.3-{big}", "1.2.3-5", "1.2.3-a", "0", "v2", "x"]
    t = rows([(v,) for v in versions], "v string")
    parsed = [r.v for r in t.filter(content.semver_key(F.col("v")).isNotNull()).orderBy(content.semver_key(F.col("v")), "v").collect()]
    assert parsed == ["0", "1.2", "1.2.0", "1.2.3-5", f"1.2.3-{big}", "1.2.3-a", "1.2.3", "1.2.3.4", "v2"]


def test_sync_ladder(rows):
    b = "projects/p/workspaces/w/bundles/"
    tarball = "config-versions/{}.tar.gz".format
    local = [(b + "logs.gen0001.zip", 1), (b + "logs.gen0001.zip.sidecar.ndjson", 1), (b + "logs.gen0002.zip", 1), *((tarball(x), 999) for x in "abcd"), (tarball("a") + ".remote.json", 9), ("x/.ledger/lock", 0), ("x/.ledger/snapshot.json", 5), ("x/.atomicfile-1.tmp", 0), ("plain.json", 2)]
    sig = "path string, status string, signature struct<hash:string,size:bigint>"
    led = rows([(tarball("a"), "done", ("h", 999)), (tarball("b"), "done", ("h", 1)), (tarball("c"), "errored", ("h", 999))], sig)
    assert dict(got(reconcile.classify_sync(rows(local, "path string, size bigint"), led), "path", "action")) == {
        b + "logs.gen0001.zip": "evict",
        b + "logs.gen0001.zip.sidecar.ndjson": "sync",
        b + "logs.gen0002.zip": "skip",
        tarball("a"): "evict",
        tarball("b"): "suspect",
        tarball("c"): "skip",
        tarball("d"): "skip",
        tarball("a") + ".remote.json": "skip",
        "x/.ledger/lock": "skip",
        "x/.ledger/snapshot.json": "sync",
        "x/.atomicfile-1.tmp": "skip",
        "plain.json": "sync",
    }


def test_snapshots_are_ordered_by_run_and_count(rows):
    schema = "org string, shard string, last_run_at int, run_count int"
    cases = {"newer": ((1, 1), (2, 1), "", "replace"), "older": ((2, 1), (1, 1), "", "skip"), "equal": ((1, 1), (1, 1), "", "refuse"), "fewer": ((1, 5), (2, 4), "", "refuse"), "shard": ((1, 1), (2, 2), "projects/p/workspaces/w", "refuse")}
    local = rows([(k, s, *a) for k, (a, _, s, _) in cases.items()], schema)
    mirror = rows([(k, s, *b) for k, (_, b, s, _) in cases.items()] + [("none", "", 1, 1)], schema)
    assert dict(got(reconcile.snapshot_conflict(local, mirror), "org", "action")) == {k: c[3] for k, c in cases.items()} | {"none": "create"}


def test_an_absence_is_asked_for_once_more(rows):
    runs = {"once": [404], "twice": [404, 404], "found": [404, 200], "back": [404, 200, 404], "never": [200, 404, 404], "failed": [404, 500]}
    data = [(1, p, i, c) for p, cs in runs.items() for i, c in enumerate(cs)] + [(2, "twice", 0, 200)]
    out = {(r.run_id, r.path): (r.http_status, r.retries, r.confirmed) for r in ledger.confirm_absent(rows(data, "run_id int, path string, attempt int, http_status int")).collect()}
    assert out == {(1, "once"): (404, 0, False), (1, "twice"): (404, 1, True), (1, "found"): (200, 1, False), (1, "back"): (200, 1, False), (1, "never"): (200, 0, False), (1, "failed"): (500, 1, False), (2, "twice"): (200, 0, False)}


def test_migrations(rows):
    led = rows([("policies/pol-1.rego", "done", None), ("policies/pol-2.sentinel", "done", 5), ("policies/pol-3.tf", "absent", None), ("policies/pol-1.20240101T000000Z.rego", "done", None), ("x/pol-1.rego", "done", None), ("policies/pol-9.rego", "done", None), ("audit/20240101T000000.000000000Z-p000000001.json", "absent", None)], "path string, status string, updated_at int")
    policies = rows([("pol-1", 7), ("pol-2", 8), ("pol-3", 9), (None, 1)], "id string, updated_at int")
    assert got(ledger.migrate_entries(led, policies), "path", "status", "updated_at") == sorted([("policies/pol-1.rego", "done", 7), ("policies/pol-2.sentinel", "done", 5), ("policies/pol-3.tf", "absent", None), ("policies/pol-1.20240101T000000Z.rego", "done", None), ("x/pol-1.rego", "done", None), ("policies/pol-9.rego", "done", None), ("audit/20240101T000000.000000000Z-p000000001.json", "errored", None)], key=str)


def test_compaction_keeps_untouched_paths_of_touched_shards(rows):
    snapshot = rows([("s", "a", "done"), ("s", "b", "absent"), ("t", "c", "done")], "shard string, path string, status string")
    log = rows([("s", "a", "errored", 2), ("s", "a", "forbidden", 1), ("s", "d", "done", 3)], "shard string, path string, status string, ord long")
    assert got(ledger.compact(snapshot, log), "path", "status") == [("a", "errored"), ("b", "absent"), ("d", "done")]


def test_seal_plan_takes_states_and_final_runs(rows):
    w = "projects/p/workspaces/w"
    leaves = ["runs/r1/run.json", "runs/r2/run.json", "runs/r1/plan.log", "runs/r1/comments.json", "state-versions/20240102T030405Z-sv-1.json", "state-versions/20240102T030405Z-sv-1.meta.json", "variables.json"]
    objects = rows([(f"{w}/{x}",) for x in leaves], "path string")
    led = objects.withColumn("status", F.lit("done"))
    cols = rows([(w, "runs", True), (w, "state-versions", True)], "shard string, kind string, complete boolean")
    plan = sealing.seal_plan(objects, led, cols, rows([("r1", "applied"), ("r2", "planning")], "run_id string, status string"))
    assert dict(got(plan, "path", "target")) == {f"{w}/{x}": t for x, t in zip(leaves, ["runs.ndjson", None, "logs", "comments.ndjson", "state", "state-versions.ndjson", None], strict=True) if t}


def test_superseded_contents_go_to_history(rows):
    fresh, current = (rows(x, "path string, content string") for x in ([("a", "1"), ("b", "2"), ("c", "3")], [("a", "1"), ("b", "old")]))
    changes = history.capture_mutable(fresh, current)
    assert got(changes, "path", "action") == [("a", "unchanged"), ("b", "changed"), ("c", "new")] and got(history.superseded(changes, current), "path", "content") == [("b", "old")]


def test_reports_of_sets_and_stacks(rows):
    doc = "path string, content string"
    sets = rows([("policy-sets/ps-1/policy-set.json", '{"data":{"id":"ps-1","attributes":{"name":"one","kind":"opa","global":false,"policy-count":3}}}'), ("policy-sets/ps-2/policy-set.json", "{oops")], doc)
    params = rows([("policy-sets/ps-1/parameters.json", '{"data":[{"id":"a","attributes":{"key":"k","value":"v","sensitive":true,"hcl":true}},{"id":"b","attributes":{"key":"j","value":"w"}}]}')], doc)
    out = {r.set_id: r for r in reports.policy_sets_report(sets, params).collect()}
    assert (out["ps-1"].title, out["ps-1"].kind, out["ps-1"]["global"], out["ps-1"].policies) == ("one", "opa", "false", 3)
    assert [(v.key, v.value, v.hcl) for v in out["ps-1"].variables] == [("j", "w", ""), ("k", "(sensitive)", "true")]
    assert (out["ps-2"].title, out["ps-2"].id, out["ps-2"].kind, out["ps-2"]["global"], out["ps-2"].policies, out["ps-2"].variables) == ("ps-2", "", "", "", None, [])
    stacks = rows([("projects/p/stacks/s/stack.json", '{"data":{"id":"st","attributes":{"name":"S","created-at":"2024-01-02T03:04:05Z"}}}'), ("projects/p/stacks/t/stack.json", "{oops")], doc)
    deployments = rows([("projects/p/stacks/s/deployments/a/deployment.json", '{"data":{"id":"d","attributes":{"created-at":"2024-02-03T04:05:06Z"}}}'), ("projects/p/stacks/s/deployments/b/deployment.json", "x")], doc)
    out = {r.path: r for r in reports.stack_report(stacks, deployments).collect()}
    s, t = (out[f"projects/p/stacks/{x}/stack.json"] for x in "st")
    assert (s.title, s.id, s.created, s.n_deployments, [tuple(x) for x in s.deployments]) == ("S", "st", "2024-01-02 03:04", 2, [("a", "2024-02-03 04:05"), ("b", "")]) and (t.title, t.id, t.n_deployments) == ("t", "", 0)
    teams = reports.teams_report(rows([("teams/t-1/team.json", '{"data":{"id":"t-1","attributes":{"name":"n","users-count":2}}}'), ("teams/t-2/team.json", "{")], doc))
    assert got(teams, "id", "name", "users") == [("t-1", "n", 2), ("t-2", "", None)]


def test_alias_rewrites_stack(rows):
    out = reconcile.alias_rewrites(rows([("projects/c/x",), ("projects/cc/x",)], "path string"), rows([("projects/c", "projects/b"), ("projects/b", "projects/a")], "current string, former string"))
    deep = [(f"projects/n{i}", f"projects/n{i + 1}") for i in range(12)]
    chain = reconcile.alias_rewrites(rows([("projects/n0/x",)], "path string"), rows(deep, "current string, former string"))
    assert got(chain, "spelling", "depth") == sorted(((f"projects/n{i}/x", i) for i in range(13)), key=str)
    assert got(out, "path", "spelling", "depth") == [("projects/c/x", "projects/a/x", 2), ("projects/c/x", "projects/b/x", 1), ("projects/c/x", "projects/c/x", 0), ("projects/cc/x", "projects/cc/x", 0)]


def test_renames_of_any_depth_and_cycles(rows):
    chain = [(f"d{i}", f"d{i + 1}") for i in range(100)]
    cycle = [("x/a", "x/b"), ("x/b", "x/c"), ("x/c", "x/a"), ("x", "y"), ("", "never"), ("x/a", "x/a")]
    deeper = [("r/s", "q"), ("q/t", "r/s/u")]
    aliases = rows(chain + cycle + deeper, "current string, former string")
    paths = rows([(p,) for p in ("d0/f", "d99/f", "x/a/1", "x/b", "xx/a", "r/s/t/9", "plain", "d0")], "path string")
    found = reconcile.alias_rewrites(paths, aliases)
    by = {}
    for r in found.collect():
        by.setdefault(r.path, {})[r.spelling] = r.depth
    assert by["d0/f"] == {f"d{i}/f": i for i in range(101)} and by["d0"] == {f"d{i}": i for i in range(101)} and by["d99/f"] == {"d99/f": 0, "d100/f": 1}
    assert by["x/a/1"] == {"x/a/1": 0, "x/b/1": 1, "x/c/1": 2, "y/a/1": 1, "y/b/1": 2, "y/c/1": 3}
    assert by["x/b"] == {"x/b": 0, "x/c": 1, "x/a": 2, "y/b": 1, "y/c": 2, "y/a": 3} and by["xx/a"] == {"xx/a": 0} and by["plain"] == {"plain": 0}
    assert by["r/s/t/9"] == {"r/s/t/9": 0, "q/t/9": 1, "r/s/u/9": 2, "q/u/9": 3}
    few = rows(cycle + deeper, "current string, former string")
    assert got(reconcile.alias_rewrites(paths, few), "path", "spelling", "depth") == got(reconcile.alias_rewrites(paths, few, most=2), "path", "spelling", "depth")
    # As large a plan for two renames as for a hundred.
    size = lambda df: len(df._jdf.queryExecution().executedPlan().toString().splitlines())
    assert size(found) == size(reconcile.alias_rewrites(paths, rows(chain[:2], "current string, former string")))


def test_orphan_bundles_and_stubs(rows):
    members = rows([("b1", "m", "1"), ("b1", "n", "2"), ("b2", "m", "9"), ("b3", None, None)], "bundle string, name string, sha256 string")
    assert got(reconcile.orphan_bundles(members, rows([("m", "1"), ("n", "2")], "name string, sha256 string")), "bundle", "action") == [("b1", "reclaim"), ("b2", "keep"), ("b3", "keep")]
    plan = rows([("a", 1, "h"), ("b", 1, "h"), ("c", 1, None), ("d", 1, "h")], "path string, size int, sha256 string")
    stubs = rows([("b", 1, 1, "h"), ("c", 1, 2, None), ("d", 2, 1, "h")], "path string, version int, size int, sha256 string")
    assert got(reconcile.reconcile_stubs(plan, stubs), "path", "action") == [("a", "write"), ("b", "keep"), ("c", "conflict"), ("d", "newer")]


def test_identities(rows):
    seen = rows([("p", "a", 1), ("p", "new", 2), ("p", "c", 9), ("p", "d", 4)], "parent string, name string, id int")
    bound = rows([("p", "a", 1), ("p", "old", 2), ("p", "c", 3)], "parent string, name string, id int")
    assert got(refs.claim_identities(seen, bound), "name", "claim", "other") == [("a", "ok", None), ("c", "mismatch", None), ("d", "new", None), ("new", "renamed_from", "old")]


def test_tree_and_forms(rows):
    obj = rows([("a/f", 3, True), ("a/f/x", 1, False), ("a/g", 2, False), ("a/g/y", 1, True), ("b", 9, False)], "path string, size int, offloaded boolean")
    assert got(listing.tree_children(obj, "a"), "name", "dir", "size", "remote") == [("f", True, None, False), ("g", False, 2, False)]
    with pytest.raises(ValueError):
        listing.list_objects(obj, "a/../b")


def test_loose_files_are_listed_in_tasks(spark, tmp_path):
    """The driver's index holds none of the files; what is told of them is what Spark's reader tells, which leaves out empty files."""
    for name in ("a/b/c.json", "a/_b/d.json", "a/_k=1/e.json", "a/.f.json", "g h%20.json", "a/empty"):
        (tmp_path / "org" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "org" / name).write_text(name if "empty" not in name else "")
    (tmp_path / "org/none").mkdir()
    root = str(tmp_path / "org")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    for where in (root, f"file://{root}/"):
        loose, inventory = readers.read_loose(spark, where), readers.read_inventory(spark, where)
        assert not [f for found in (loose, inventory) for f in found.inputFiles() if f.startswith(f"file://{root}/")]
        want = {(r.path.split("/org/")[1], r.length, r.modificationTime) for r in read.collect()}
        assert {(r.path, r.size, r.mtime) for r in loose.filter("size > 0").collect()} == want and len(want) == 3
        assert {(r.key, r.size) for r in inventory.collect()} == {(path, size) for path, size, _ in want} | {("a/empty", 0)}
        assert [r.path for r in loose.filter("size = 0").collect()] == ["a/empty"]


def test_sources_and_sinks(spark, rows, tmp_path):
    root = tmp_path / "org"
    (root / "projects/p/workspaces/w/runs/r").mkdir(parents=True)
    (root / "projects/p/workspaces/w/runs/r/run.json").write_text("{}")
    (root / "config-versions").mkdir()
    (root / "config-versions/x.tar.gz.remote.json").write_text("{}")
    (root / "projects/p/workspaces/w/.identity.json").write_text("{}")
    (root / ".remote.json").write_text("{}")
    (root / ".ledger").mkdir()
    (root / ".ledger/s.json").write_text(json.dumps({"entries": {"a": {"status": "done", "attempts": 2, "signature": {"hash": "h", "size": 1}}}, "completedCollections": {"runs": True}, "highWaterMarks": {"runs": "2024-01-01T00:00:00Z"}}))
    assert got(readers.read_loose(spark, str(root)), "path", "form") == [("config-versions/x.tar.gz.remote.json", "stub"), ("projects/p/workspaces/w/runs/r/run.json", "loose")]
    entries, cols = readers.read_ledger(spark, str(root / ".ledger/*.json"))
    assert got(entries, "path", "status", "attempts") == [("a", "done", 2)] and got(cols, "prefix", "complete", "settled") == [("runs", True, False)]
    (root / "roll.ndjson").write_text('{"path":"a","sha256":"1","content":"x"}\n{"path":"","content":"y"}\n{torn\n{"path":"a","sha256":"2","content":"z"}\n')
    rolled = readers.read_rollups(spark, str(root / "roll.ndjson"))
    assert got(history.newest_per_path(rolled), "path", "sha256") == [("a", "2")]
    with zipfile.ZipFile(root / "b.zip", "w") as z:
        z.writestr("m1", b"abc")
        z.writestr("m2", b"toolong")
    assert got(readers.read_bundle_members(spark, str(root / "b.zip"), 5), "name", "size", "content") == [("m1", 3, bytearray(b"abc")), ("m2", 7, None)]
    members = rows([("a", "1", b"x"), ("b", "2", b"y")], "name string, sha256 string, content binary")
    where = writers.write_generation(members, str(tmp_path / "g"), "logs", 1)
    assert [got(x, "name") for x in writers.read_generation(spark, where)] == [[("a",), ("b",)]] * 2
    with pytest.raises(Exception, match="exist"):
        writers.write_generation(members, str(tmp_path / "g"), "logs", 1)
    with pytest.raises(ValueError):
        writers.append_rollup(rows([("a", "1", b"\xff")], "path string, sha256 string, content binary"), str(tmp_path / "r"), 1)
    out = writers.extract_objects(rows([("d/ok", b"12"), ("../no", b"3")], "path string, content binary"), str(tmp_path / "t"))
    assert got(out, "path", "bytes") == [("../no", 0), ("d/ok", 2)] and (tmp_path / "t/d/ok").read_bytes() == b"12"


def snapshot_document(rng, shard, n):
    """(document, its entries, its collections' flags) of a shard with odd strings."""
    entries, keys = {}, [f"{shard}/k{i}" for i in range(9)]
    for i in range(n):
        e = {"firstSeen": "2024-01-01T00:00:00Z", "status": rng.choice(["done", "errored"]), "attempts": i}
        if i % 3 == 0:
            e["signature"] = {"hash": f"h{i}", "size": i}
        if i % 5 == 0:
            e["lastError"] = 'odd }, {"x": [\n    "y": {' + "\u2028\u00e9" * (i % 7)
        if i % 4 == 0:
            e["derivedChildren"] = [f"c{k}" for k in range(i % 9)]
        entries[f'{shard}/{i}"{{'] = e
    doc = {"lastRun": {"startedAt": "2024-01-01T00:00:00Z", "totals": {"done": 1}}, "highWaterMarks": {k: "2024-01-02T00:00:00Z" for k in keys}, "entries": entries}
    doc |= {"completedCollections": {k: i % 2 == 0 for i, k in enumerate(keys)}, "settledCollections": {k: True for k in keys[::3]}, "version": 2}
    return doc, {p: (e["status"], e["attempts"], (e.get("signature") or {}).get("hash"), e.get("lastError"), e.get("derivedChildren")) for p, e in entries.items()}, {k: (i % 2 == 0, i % 3 == 0) for i, k in enumerate(keys)}


def test_members_of_a_snapshot_whatever_its_splits(rows):
    rng, flat, want = random.Random(42), [], []
    for size in (1, 2, 3, 5, 8, 13, 10_000):
        doc, _, _ = snapshot_document(rng, f"s{size}", 14)
        lines = json.dumps(doc, indent=2, ensure_ascii=False).split("\n")
        flat += snapshots.pieces((f"f{size}", i - i % size, line) for i, line in enumerate(lines))
        want += [(k, {m: v}) for k, ms in doc.items() if isinstance(ms, dict) for m, v in ms.items()]
    found = [(r.section, json.loads("{" + r.text.rstrip().rstrip(",") + "}")) for r in snapshots.stitched(rows(flat, snapshots.PIECE)).collect()]
    assert sorted(map(str, found)) == sorted(map(str, want))


def test_snapshots_are_read_by_splits(spark, tmp_path):
    want, flags, rng = {}, {}, random.Random(41)
    for n, (shard, size) in enumerate((("projects/p/workspaces/w", 60), ("config-versions", 1))):
        doc, entries, marks = snapshot_document(rng, shard, size)
        want |= entries
        flags |= marks
        (tmp_path / f"{n}.json").write_text(json.dumps(doc, indent=2, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "torn.json").write_text('{\n  "entries": {\n    "p": {\n      "sta')
    (tmp_path / "empty.json").write_text('{\n  "entries": {},\n  "version": 2\n}')
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]
    try:
        for n in names:
            spark.conf.set(n, "3000")
        entries, cols = readers.read_ledger(spark, str(tmp_path / "*.json"))
        assert spark.read.text(str(tmp_path / "0.json")).rdd.getNumPartitions() > 3
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    assert {r.path: (r.status, r.attempts, r.signature and r.signature.hash, r.last_error, r.derived_children) for r in entries.collect()} == want
    assert {r.prefix: (r.complete, r.settled) for r in cols.collect()} == flags and cols.filter("high_water_mark IS NULL").count() == 0


@pytest.mark.parametrize("indent", [2, None])
def test_runs_of_snapshots(spark, tmp_path, indent):
    doc, _, _ = snapshot_document(random.Random(43), "s", 5)
    doc = {"lastRunAt": "2024-01-03T00:00:00Z", **doc, "runCount": 7}
    for folder, d in (("projects/p/workspaces/w", doc), ("config-versions", {"entries": {}, "version": 2})):
        (tmp_path / folder / ".ledger").mkdir(parents=True)
        (tmp_path / folder / ".ledger/snapshot.json").write_text(json.dumps(d, indent=indent, separators=None if indent else (",", ":")))
    (tmp_path / ".ledger").mkdir()
    (tmp_path / ".ledger/snapshot.json").write_text(json.dumps({"runCount": 2, "version": 2}, indent=indent, separators=None if indent else (",", ":")))
    found = {r.shard: r for p in ("/.ledger/*.json", "/*/.ledger/*.json", "/*/*/*/*/.ledger/*.json") for r in readers.read_runs(spark, str(tmp_path) + p).collect()}
    w = found["projects/p/workspaces/w"]
    assert (w.run_count, w.last_run_at, w.started_at, w.finished_at, w.totals) == (7, dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 1), None, {"done": 1})
    assert found[""].run_count == 2 and found["config-versions"].run_count == 0 and found[""].last_run_at is None and len(found) == 3


def test_a_generation_is_committed_by_its_index(spark, rows, tmp_path, monkeypatch):
    members = rows([("a", "1", b"x"), ("b", "2", b"y")], "name string, sha256 string, content binary")
    folder = str(tmp_path / "g")

    def crash(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(writers, "_index", crash)
        with pytest.raises(KeyboardInterrupt):
            writers.write_generation(members, folder, "logs", 1)
    with pytest.raises(FileNotFoundError):
        writers.read_generation(spark, f"{folder}/logs.gen0001")
    (tmp_path / "g/logs.gen0001.index").mkdir()  # the crash may come while the index is written, too
    where = writers.write_generation(members, folder, "logs", 1)
    assert [got(x, "name", "sha256") for x in writers.read_generation(spark, where)] == [[("a", "1"), ("b", "2")]] * 2
    assert len(writers.reclaim_attempts(spark, folder, "logs")) == 1 and writers.reclaim_attempts(spark, folder, "logs") == []
    assert got(writers.read_generation(spark, where)[0], "content") == [(bytearray(b"x"),), (bytearray(b"y"),)]
    with pytest.raises(FileExistsError):
        writers.write_generation(members, folder, "logs", 1)


def test_a_batch_appended_again_adds_and_hides_nothing(spark, rows, tmp_path):
    schema, folder = "path string, sha256 string, content string", str(tmp_path / "r")
    writers.append_rollup(rows([("a", "1", "x"), ("b", "1", "y")], schema), folder, 1)
    writers.append_rollup(rows([("a", "2", "z")], schema), folder, 2)
    writers.append_rollup(rows([("a", "1", "x"), ("b", "1", "y")], schema), folder, 1)
    rolled = readers.read_rollups(spark, folder)
    assert rolled.count() == 3 and got(history.newest_per_path(rolled), "path", "sha256") == [("a", "2"), ("b", "1")]


def test_scratch_folders_go_together(spark, rows):
    kept = scratch.written(rows([(1,)], "x int"), "one")
    where = scratch.fresh_path(spark, "two").rpartition("/")[0]
    assert kept.count() == 1 and [n[:3] for n in files.names(spark, where)].count("one") >= 1
    assert scratch.clear(spark) and not files.exists(spark, where) and not scratch.clear(spark)


def test_seal_round_trip(spark, rows, tmp_path):
    plan = rows([("a", "s", "logs"), ("b", "s", "logs")], "path string, shard string, target string")
    assert got(sealing.seal_workspaces(plan, rows([("a", b"1"), ("b", b"2")], "path string, content binary"), str(tmp_path), 1), "path", "state") == [("a", "ok"), ("b", "ok")]


def audit_model(batches, since):
    """Batches one after the other: (served, cursor) of each, from (id, ts)."""
    out, cursor, boundary = [], since, set()
    for events in batches:
        served, ids = [], set()
        for i, ts in events:
            if cursor is not None and (ts < cursor or (ts == cursor and (i is None or i in boundary))):
                continue
            if i is None or i not in ids:
                served.append((i, ts))
                ids.add(i)
        newest = max([ts for _, ts in served] + ([cursor] if cursor is not None else []), default=None)
        boundary = {i for i, ts in served if ts == newest} | (boundary if newest == cursor else set())
        cursor = newest
        out.append((sorted(served, key=str), cursor))
    return out


@pytest.mark.parametrize("since", [None, dt.datetime(2024, 1, 1, 0, 0, 20)])
def test_audit_stream_equals_a_sequential_model(spark, rows, tmp_path, since):
    rng, t0 = random.Random(31), dt.datetime(2024, 1, 1)
    made = [(rng.choice([None, f"e{k}"]), t0 + dt.timedelta(seconds=k // 3)) for k in range(90)]
    made = [(i if i is None else f"{i}-{ts:%S}", ts) for i, ts in made]
    batches, at = [], 0
    for size in (20, 1, 30, 0, 25, 14):
        # What is new, repeats of any age, and the boundary again.
        new = made[at : at + size]
        batches.append(new + rng.sample(made[: at + size], min(8, at + size)) + new[-2:])
        at += size
    for n, events in enumerate(batches):
        rows(events, "id string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id string, ts timestamp").parquet(str(tmp_path / "in"))
        feeds.audit_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), since).trigger(availableNow=True).start().awaitTermination(120)
        want = audit_model(batches[: n + 1], since)[-1]
        assert sorted(((r.id, r.ts) for r in spark.read.parquet(str(tmp_path / f"out/events/batch={n}")).collect()), key=str) == want[0]
        assert tuple(spark.read.parquet(str(tmp_path / f"out/cursor/batch={n}")).first()) == (want[1], len(want[0]))


def test_capture_keeps_a_hash_per_path(spark, rows, tmp_path):
    schema = "path string, ord int, content string"
    rng, current, sizes = random.Random(32), {f"k{i}": "known" for i in range(3)}, []
    sign = lambda x: None if x is None else hashlib.sha256(x.encode()).hexdigest()
    known = rows([(p, sign(c)) for p, c in current.items()], "path string, hash string")
    places = [str(tmp_path / x) for x in ("in", "changes", "check")]

    def run():
        stream = spark.readStream.schema(schema).parquet(places[0])
        feeds.capture_stream(stream, places[1], places[2], known).trigger(availableNow=True).start().awaitTermination(120)

    def changes(n):
        return sorted((tuple(r) for r in spark.read.parquet(f"{places[1]}/batch={n}").collect()), key=str)

    for n, size in enumerate((400, 10, 10)):
        seen = [(rng.choice(["k0", "k1", f"p{rng.randrange(size)}"]), o, rng.choice(["x", "y", None])) for o in range(size)]
        rows(seen, schema).coalesce(1).write.mode("append").parquet(places[0])
        run()
        want = []
        for p, c in {p: c for p, _, c in seen}.items():
            if p not in current or current[p] != c:
                want.append((p, "changed" if p in current else "new", sign(current.get(p)), sign(c)))
            current[p] = c
        assert changes(n) == sorted(want, key=str)
        logs = [f for f in (tmp_path / "check/state").rglob("*") if f.is_file() and f.name.startswith(f"{n + 1}.") or f.name.startswith(f"{n + 1}_")]
        sizes.append(sum(f.stat().st_size for f in logs))
    assert 0 < sizes[2] < sizes[0]  # what a batch adds to the state follows the batch
    # A crash after a batch's files and before its commit: the restart runs it again, to the same rows.
    before = changes(2)
    for f in (tmp_path / "check/commits").iterdir():
        if f.name.strip(".").startswith("2"):
            f.unlink()
    run()
    assert changes(2) == before and not (tmp_path / "changes/batch=3").exists()


def test_empty_tables(spark, rows):
    none = rows([], "path string, seq bigint, at bigint, status string, hash string, size bigint, updated_at bigint, error string, transient boolean, run_id bigint, changed boolean")
    assert ledger.fold_outcomes(none).count() == ledger.run_totals(none).count() == 0
    assert history.build_history(rows([], "path string, ord int, at int, content string")).count() == 0
    assert F is not None


def test_tokens_give_the_union(rows):
    schema = "path string, seq bigint, at bigint, status string, hash string, size bigint, updated_at bigint, error string, transient boolean, immutable boolean"
    one = rows([("a", 1, 1, "done", "h", 1, None, None, False, True), ("b", 2, 2, "done", "g", 1, None, None, False, False), ("c", 3, 3, "forbidden", None, None, None, "no", False, True)], schema)
    two = rows([("a", 1, 4, "forbidden", None, None, None, "no", False, True), ("b", 2, 5, "forbidden", None, None, None, "no", False, False), ("c", 3, 6, "done", "i", 1, None, None, False, True)], schema)
    out = ledger.union_tokens(one, two)
    assert got(out, "path", "status", "signature.hash") == [("a", "done", "h"), ("b", "forbidden", "g"), ("c", "done", "i")]


def gate_model(events):
    state, n = None, 0
    for e in events:
        goal = {"open": "pending", "clear": "reference-cleared", "absent": "reference-absent", "fail": "errored"}[e]
        if (e == "clear" and state is None) or (e == "open" and state == "errored") or goal == state:
            continue
        state, n = goal, n + 1
    return state, n


def test_gates_equal_a_sequential_model_with_a_hot_path(rows):
    rng = random.Random(21)
    data = {f"g{k}": [rng.choice(["open", "clear", "absent", "fail"]) for _ in range(rng.randint(1, 9))] for k in range(80)}
    data["hot"] = [rng.choice(["open", "clear", "fail", "open", "absent"]) for _ in range(900)]
    data["late"] = ["clear"] * 40 + ["open"] * 40
    table = rows([(p, i, e) for p, es in data.items() for i, e in enumerate(es)], "path string, seq int, event string").repartition(5)
    out = gates.fold_gates(table)
    want = {p: m for p, es in data.items() if (m := gate_model(es))[0]}
    assert {r.path: (r.status, r.attempts) for r in out.collect()} == want
    assert "Window" not in out._jdf.queryExecution().toString()


def test_history_of_a_hot_path_is_spread(rows):
    rng = random.Random(8)
    data = {f"p{k}": [rng.choice(["x", "y", None]) for _ in range(rng.randint(1, 8))] for k in range(20)}
    data |= {"hot": [None] * 30 + [rng.choice(["x", "x", "x", "y", None]) for _ in range(700)], "still": ["x"] * 300, "revived": ["x"] * 90 + [None] * 150 + ["y"] * 200 + ["z"], "gone": [None] * 99}
    table = rows([(p, i, i, c) for p, cs in data.items() for i, c in enumerate(cs)], "path string, ord int, at int, content string").repartition(5)
    out = history.build_history(table)
    assert got(out, "path", "fetched_at", "content") == sorted(((p, *v) for p, cs in data.items() for v in history_model(cs)), key=str)
    parts = scan.cut(table, ["path"], [table["ord"]])
    assert parts.filter("path = 'hot'").select(scan.PART).distinct().count() > 1


def test_positions_go_on_from_part_to_part(rows):
    data = [(k, i) for k, n in (("a", 3), ("hot", 500), (None, 4), ("z", 1)) for i in range(n)]
    table = rows(data, "k string, at_time int").repartition(6)
    within = scan.positions(table, ["k"], [table["at_time"]])
    assert within.columns == ["k", "at_time", "at"] and all(r.at == r.at_time for r in within.collect()) and within.count() == len(data)
    whole = scan.positions(table, [], [table["k"].asc_nulls_first(), table["at_time"]]).collect()
    assert [r.at for r in sorted(whole, key=lambda r: (r.k or "", r.at_time))] == list(range(len(data)))
    assert scan.positions(table.limit(0), ["k"], [table["at_time"]]).count() == 0


def test_walk_of_a_hot_collection(rows):
    rng = random.Random(12)
    listed, flags, want, done = [], [], {}, set()
    for c, n in enumerate([600, 3, 5, 400, 700]):
        first = rng.randint(150, 350)
        items = [(i, i > first - 100) for i in range(n)]  # the first rows aren't final in some
        if c in (0, 3):
            items = [(i, True) for i, _ in items]
        done |= {(c, i) for i in range(first, n)}
        listed += [(c, i, f"{c}/{i}", 5000 - i, term) for i, term in items]
        flags.append((c, True, True, False))
        want[c] = walk_model(items, {i for k, i in done if k == c}, True, None)
    led = rows([(f"{c}/{i}", "done") for c, i in done], "path string, status string")
    table = rows(listed, "collection int, id int, path string, created_at int, terminal boolean").repartition(5)
    out = walk.incremental_walk(table, led, rows(flags, "collection int, complete boolean, settled boolean, unsettled boolean"))
    found = {}
    for r in out.orderBy("collection", "at").collect():
        found.setdefault(r.collection, []).append(r.id)
        assert r.at == r.id
    assert found == want and len(want[0]) < 600
    assert {r.collection: r["count"] for r in walk.within_history(table, 250).groupBy("collection").count().collect()} == {0: 250, 1: 3, 2: 5, 3: 250, 4: 250}
