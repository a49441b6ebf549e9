"""Functions of archive-relative paths; `/` separates segments and no function touches a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is cut from a leaf to give its stem.
_SUFFIX = r"(?:\.tfstate\.json|\.meta\.json|\.history\.ndjson|\.tar\.gz|\.json|\.ndjson|\.log)$"
_BUNDLE = r"\.gen(\d+)\.zip(?:\.sidecar\.ndjson)?$"


def segments(path: Column) -> Column:
    """The segments of a path."""
    return F.split(path, "/")


def leaf(path: Column) -> Column:
    """The last segment."""
    return F.element_at(segments(path), -1)


def parse_path(path: Column) -> Column:
    """STRUCT<project, workspace, stack, kind, run_id, leaf, stem>; fields that a path doesn't have are null."""
    s = segments(path)
    part = lambda i: F.get(s, F.lit(i))
    scoped = (F.size(s) >= 4) & (part(0) == "projects")
    ws, st = scoped & (part(2) == "workspaces"), scoped & (part(2) == "stacks")
    kind = F.when(ws | st, part(4)).otherwise(part(0))
    run = F.when(ws & (part(4) == "runs") & (F.size(s) >= 6), part(5))
    return F.struct(
        F.when(scoped, part(1)).alias("project"),
        F.when(ws, part(3)).alias("workspace"),
        F.when(st, part(3)).alias("stack"),
        kind.alias("kind"),
        run.alias("run_id"),
        leaf(path).alias("leaf"),
        F.regexp_replace(leaf(path), _SUFFIX, "").alias("stem"),
    )


def shard_key(path: Column) -> Column:
    """The shard that holds a path: its workspace or stack, `config-versions`, or '' for the organisation."""
    s = segments(path)
    scoped = (F.size(s) >= 4) & (s[0] == "projects") & F.get(s, F.lit(2)).isin("workspaces", "stacks")
    return F.when(scoped, F.array_join(F.slice(s, 1, 4), "/")).when(s[0] == "config-versions", "config-versions").otherwise("")


def sanitize_segment(name: Column) -> Column:
    """A name made safe as one segment: separators and control characters become `_`, and so does nothing but dots."""
    clean = F.regexp_replace(name, r"[/\\\x00-\x1f\x7f]", "_")
    return F.when(clean.rlike(r"\A\.*\z"), "_").otherwise(clean)


def is_valid_path(path: Column) -> Column:
    """Relative, clean, without backslash."""
    return ~F.contains(path, F.lit("\\")) & F.forall(segments(path), lambda s: ~s.isin("", ".", ".."))


def under_prefix(path: Column, prefix: Column) -> Column:
    """Segment-wise: `runs/run-10` isn't under `runs/run-1`; everything is under ''."""
    return (prefix == "") | (path == prefix) | F.startswith(path, F.concat(prefix, F.lit("/")))


def confine(path: Column) -> Column:
    """The path cleaned as if rooted: `..` takes a segment away, but not above the root."""
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(segments(path), F.array().cast("array<string>"), step), "/")


def history_path(path: Column) -> Column:
    """Where an object's history stands."""
    return F.concat(F.regexp_replace(path, r"\.json$", ""), F.lit(".history.ndjson"))


def state_stem(created_at: Column, state_id: Column) -> Column:
    """A stem that sorts by time: UTC stamp to the second, then the id."""
    return F.concat(F.date_format(created_at, "yyyyMMdd'T'HHmmss"), F.lit("Z-"), sanitize_segment(state_id))


def audit_page_name(since: Column, page: Column) -> Column:
    """The leaf of a stored audit page: cursor to nine fractional digits, page to nine digits."""
    return F.concat(F.date_format(since, "yyyyMMdd'T'HHmmss.SSSSSS"), F.lit("000Z-p"), F.lpad(page.cast("string"), 9, "0"), F.lit(".json"))


def is_page_name(name: Column) -> Column:
    """Whether a leaf is a stored audit page."""
    return name.rlike(r"\A[0-9]{8}T[0-9]{6}\.[0-9]{9}Z-p[0-9]{9}\.json\z")


def bundle_generation(name: Column, prefix: str) -> Column:
    """The number in `<prefix>.genNNNN.zip` or its sidecar, else 0; compared as a number, since it may widen."""
    number = F.regexp_extract(name, rf"\A{prefix}{_BUNDLE}", 1)
    return F.when(number == "", 0).otherwise(number.cast("int"))


def bundle_name(generation: Column, prefix: str) -> Column:
    """`<prefix>.genNNNN.zip`: four digits at least, and as many as the number has."""
    digits = generation.cast("string")
    return F.concat(F.lit(f"{prefix}.gen"), F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit("0")), F.lit(".zip"))


# Names of an archive's own files.
LEDGER_DIR, MARKER, IDENTITY, STUB_SUFFIX, SIDECAR_SUFFIX = ".ledger", ".remote.json", ".identity.json", ".remote.json", ".sidecar.ndjson"
LEDGER_LOCK, LEDGER_LOG = "lock", "log.ndjson"
_TEMP = r"\A\.atomicfile-.*\.tmp\z"
_WORKSPACE = r"\Aprojects/[^/]*/workspaces/[^/]*/"


def is_temp(name: Column) -> Column:
    """A leaf that a crash left half written."""
    return name.rlike(_TEMP)


def in_sealed_form(path: Column) -> Column:
    """Anything in the `bundles` or `rollups` folder of a workspace."""
    return path.rlike(_WORKSPACE + "(?:bundles|rollups)/")


def is_bundle_zip(path: Column) -> Column:
    """A sealed bundle: a zip right in the `bundles` folder of a workspace."""
    return path.rlike(_WORKSPACE + r"bundles/[^/]*\.zip\z")


def is_bundle_sidecar(path: Column) -> Column:
    """The member index of a bundle."""
    return path.rlike(_WORKSPACE + r"bundles/[^/]*\.zip\.sidecar\.ndjson\z")


def is_config_tarball(path: Column) -> Column:
    """An uploaded configuration."""
    return F.startswith(path, F.lit("config-versions/")) & F.endswith(path, F.lit(".tar.gz"))


def stub_target(path: Column) -> Column:
    """The tarball that an eviction stub stands for, or null; such a name anywhere else is an object."""
    target = F.regexp_replace(path, r"\.remote\.json$", "")
    return F.when(F.endswith(path, F.lit(STUB_SUFFIX)) & is_config_tarball(target), target)


def in_ledger(path: Column) -> Column:
    """A file right in a ledger's folder."""
    return F.coalesce(F.get(segments(path), F.size(segments(path)) - 2) == LEDGER_DIR, F.lit(False))


def is_machinery(path: Column) -> Column:
    """The archive's own files: ledgers, sealed forms, markers, identities, half-written files. (Stubs aren't: each stands for its object.)"""
    name = leaf(path)
    return in_sealed_form(path) | F.array_contains(segments(path), LEDGER_DIR) | name.isin(MARKER, IDENTITY) | is_temp(name)


def under_workspace(path: Column) -> Column:
    """Within a workspace."""
    return path.rlike(_WORKSPACE)


# Run-child files and the roll-up each goes to.
ROLLUPS = {
    "config-version.json": "config-versions.ndjson",
    "config-version-ingress.json": "config-versions.ndjson",
    "plan-summary.json": "plan-summaries.ndjson",
    "apply-summary.json": "apply-summaries.ndjson",
    "cost-estimate.json": "cost-estimates.ndjson",
    "comments.json": "comments.ndjson",
    "run-events.json": "run-events.ndjson",
    "policy-checks.json": "policy-checks.ndjson",
    "task-stages.json": "task-stages.ndjson",
    "tf-policy-evaluations.json": "tf-policy-evaluations.ndjson",
    "tf-policy-outcomes.json": "tf-policy-outcomes.ndjson",
}
# Run files that are sealed as they are.
HEAVY = ["plan.log", "plan.json", "apply.log", "cost-estimate.log"]
# Run artifacts in reading order, with what they are.
ARTIFACTS = {
    "plan.log": "plan output",
    "plan.json": "structured plan (JSON)",
    "apply.log": "apply output",
    "cost-estimate.log": "cost estimate breakdown",
    "config-version.json": "configuration version and ingress attributes",
    "cost-estimate.json": "cost estimate",
    "comments.json": "run comments",
    "run-events.json": "actor-attributed event timeline",
    "policy-checks.json": "Sentinel policy checks",
    "task-stages.json": "task stages and results",
    "tf-policy-outcomes.json": "native Terraform policy outcomes",
    "run.history.ndjson": "superseded run.json versions and tombstones",
}


def _lookup(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def artifact_class(path: Column) -> Column:
    """The sealed form a leaf goes to: `heavy`, a roll-up's name, `state_blob`, `state_meta` or `other`."""
    name = leaf(path)
    state = F.contains(path, F.lit("/state-versions/"))
    heavy = name.isin(HEAVY) | name.rlike(r"\Apolicy-check-.*\.log\z")
    return F.when(state & F.endswith(name, F.lit(".meta.json")), "state_meta").when(state & F.endswith(name, F.lit(".json")), "state_blob").when(heavy, "heavy").otherwise(F.coalesce(_lookup(ROLLUPS, name), F.lit("other")))


def artifact_rank(name: Column) -> Column:
    """Reading order from 0; null for a leaf that has none and comes last."""
    return _lookup({k: i for i, k in enumerate(ARTIFACTS)}, name)


def artifact_desc(name: Column) -> Column:
    """What an artifact is, else its name."""
    return F.coalesce(_lookup(ARTIFACTS, name), name)


def policy_source_id(name: Column) -> Column:
    """The id of a policy source file without a revision stamp, or null."""
    own = F.regexp_replace(name, r"\.(?:sentinel|rego|tf|policy)$", "")
    return F.when(name.rlike(r"\.(?:sentinel|rego|tf|policy)\z") & ~own.rlike(r"\.[0-9]{8}T[0-9]{6}Z\z"), own)


# How a revision's stamp is written.
_STAMP = "yyyyMMdd'T'HHmmss"
_STAMPED = r"\.([0-9]{8}T[0-9]{6})Z(\.[^./]*)\z"


def revision_stamp(at: Column) -> Column:
    """The stamp of a revision: its time to the second."""
    return F.concat(F.date_format(at, _STAMP), F.lit("Z"))


def revision_path(path: Column, at: Column) -> Column:
    """Where a later revision of a source stands: `<id>.<stamp>Z.<ext>` beside `<id>.<ext>`; null if the time is unknown."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*\z", ""), F.lit("."), revision_stamp(at), F.regexp_extract(path, r"\.[^./]*\z", 0))


def revision_of(path: Column) -> Column:
    """STRUCT<path, stamp> of a stamped revision: the plain path and the stamp; null for any other path, as where the stamp is no time."""
    bare = F.regexp_extract(path, _STAMPED, 1)
    there = (bare != "") & F.try_to_timestamp(bare, F.lit(_STAMP)).isNotNull()
    return F.when(there, F.struct(F.regexp_replace(path, _STAMPED, "$2").alias("path"), F.concat(bare, F.lit("Z")).alias("stamp")))
