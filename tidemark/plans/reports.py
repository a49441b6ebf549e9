"""Report tables over an archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.content import attr_bool, attr_bool_ok, attr_int_ok, attr_string, attr_time, bool_cell, decode_jsonapi, fmt_time, human_bytes, is_prerelease, redact_variable, semver_key
from tidemark.functions.paths import artifact_rank
from tidemark.operators.refs import resolve_project


def run_artifacts(runs: DataFrame, objects: DataFrame) -> DataFrame:
    """run_id, artifacts: the leaves of each run (run_id, leaf) in reading order, without its own document; [] if it has none."""
    rank = artifact_rank(F.col("leaf"))
    rows = objects.filter("leaf <> 'run.json'").select("run_id", F.struct(rank.isNull().alias("last"), F.coalesce(rank, F.lit(0)).alias("rank"), "leaf").alias("a")).distinct()
    lists = rows.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list("a")), lambda a: a["leaf"]).alias("artifacts"))
    return runs.join(lists, "run_id", "left").withColumn("artifacts", F.coalesce("artifacts", F.array().cast("array<string>")))


def state_forms(states: DataFrame, objects: DataFrame) -> DataFrame:
    """stem, has_raw, has_json, forms of state versions (stem), over any physical form of their files (stem, suffix)."""
    has = objects.groupBy("stem").agg(F.bool_or(F.col("suffix") == "tfstate.json").alias("has_raw"), F.bool_or(F.col("suffix") == "json").alias("has_json"))
    rows = states.join(has, "stem", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_raw", "has_json")})
    return rows.withColumn("forms", F.concat_ws(", ", F.when(F.col("has_raw"), "raw"), F.when(F.col("has_json"), "json")))


def inventory_counts(objects: DataFrame, depths: dict[str, tuple[str, int]]) -> DataFrame:
    """org, label, n: distinct directories at a depth below a prefix, by label; nothing counted, no row."""
    spec = F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.lit(prefix).alias("prefix"), F.lit(depth).alias("depth")) for label, (prefix, depth) in depths.items()])).alias("spec")
    rows = objects.select("org", "path", spec).filter(F.startswith(F.col("path"), F.concat(F.col("spec.prefix"), F.lit("/"))) & (F.size(F.split("path", "/")) > F.col("spec.depth")))
    entry = F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("spec.depth")), "/")
    return rows.groupBy("org", F.col("spec.label").alias("label")).agg(F.count_distinct(entry).alias("n"))


def project_counts(projects: DataFrame, workspaces: DataFrame, stacks: DataFrame) -> DataFrame:
    """project, workspaces, stacks; projects without either are kept."""
    count = lambda df, name: df.groupBy("project").agg(F.count(F.lit(1)).alias(name))
    rows = projects.select("project").distinct().join(count(workspaces, "workspaces"), "project", "left").join(count(stacks, "stacks"), "project", "left")
    return rows.select("project", F.coalesce("workspaces", F.lit(0)).alias("workspaces"), F.coalesce("stacks", F.lit(0)).alias("stacks"))


def workspace_weights(workspaces: DataFrame, runs: DataFrame, states: DataFrame, limit: int | None = None) -> DataFrame:
    """workspace, weight: 1 + its runs (at most `limit`, if given) + its states."""
    count = lambda df, name: df.groupBy("workspace").agg(F.count(F.lit(1)).alias(name))
    rows = workspaces.select("workspace").join(count(runs, "r"), "workspace", "left").join(count(states, "s"), "workspace", "left")
    r = F.coalesce("r", F.lit(0))
    return rows.select("workspace", (1 + (F.least(r, F.lit(limit)) if limit is not None else r) + F.coalesce("s", F.lit(0))).alias("weight"))


def latest_versions(versions: DataFrame) -> DataFrame:
    """module, latest of (module, version, ok, pos): the newest release, else the newest prerelease, else the first unparseable.

    Only ok and concrete versions (not empty, not `latest`) take part; a module
    without any has none.
    """
    key = semver_key(F.col("version"))
    able = F.coalesce(F.col("ok") & ~F.col("version").isin("", "latest"), F.lit(False))
    release = able & key.isNotNull() & ~is_prerelease(F.col("version"))
    pre = able & is_prerelease(F.col("version"))
    per = versions.groupBy("module").agg(
        F.max_by("version", F.when(release, F.struct(key, F.col("version")))).alias("a"),
        F.max_by("version", F.when(pre, F.struct(key, F.col("version")))).alias("b"),
        F.min_by("version", F.when(able & key.isNull(), F.col("pos"))).alias("c"),
    )
    return per.select("module", F.coalesce("a", "b", "c").alias("latest"))


def run_rates(runs: DataFrame) -> DataFrame:
    """run_id, bytes_per_s, share, eta_s, largest of tasks (run_id, task, done, total, bytes, elapsed_s)."""
    left = F.col("total") - F.col("done")
    per = runs.groupBy("run_id").agg(F.sum("bytes").alias("b"), F.sum("done").alias("d"), F.sum("total").alias("t"), F.max("elapsed_s").alias("e"), F.max_by("task", F.when(left > 0, F.struct(left, F.col("task")))).alias("largest"))
    return per.select(
        "run_id",
        F.when(F.col("e") > 0, F.col("b") / F.col("e")).alias("bytes_per_s"),
        F.when(F.col("t") > 0, F.col("d") / F.col("t")).alias("share"),
        F.when(F.col("d") > 0, F.col("e") * (F.col("t") - F.col("d")) / F.col("d")).alias("eta_s"),
        "largest",
    )


def teams_report(teams: DataFrame) -> DataFrame:
    """id, name, visibility, users of team documents (path, content), id being that of their folder; a damaged one keeps it."""
    rows = decode_jsonapi(teams.select("path", "content"))
    a = F.col("attributes")
    good = rows.filter("pos = 0").select("path", attr_string(a, "name").alias("name"), attr_string(a, "visibility").alias("visibility"), attr_int_ok(a, "users-count").alias("users"))
    every = teams.select("path", F.regexp_extract("path", r"\Ateams/([^/]+)/", 1).alias("id"))
    return every.join(good, "path", "left").select("id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("visibility", F.lit("")).alias("visibility"), "users")


def variables_report(variables: DataFrame) -> DataFrame:
    """path, key, value, category, hcl of documents of variables or parameters (path, content); sensitive values are withheld."""
    a = F.col("attributes")
    return decode_jsonapi(variables.select("path", "content")).select(
        "path", attr_string(a, "key").alias("key"), redact_variable(attr_bool(a, "sensitive"), attr_string(a, "value")).alias("value"), attr_string(a, "category").alias("category"), bool_cell(attr_bool_ok(a, "hcl")).alias("hcl")
    )


def _sets(sets: DataFrame, folder: str, leaf: str) -> DataFrame:
    """set_id, id, attributes of set documents (path, content): set_id is the folder's name, and a damaged document keeps it."""
    own = F.regexp_extract("path", rf"\A{folder}/([^/]+)/{leaf}\z", 1)
    every = sets.select("path", own.alias("set_id")).filter("set_id <> ''")
    return every.join(decode_jsonapi(sets.select("path", "content")).filter("pos = 0").select("path", "id", "attributes"), "path", "left")


def _of_sets(rows: DataFrame, variables: DataFrame, folder: str) -> DataFrame:
    """The sets with an array of their variables, in order of key."""
    own = F.regexp_extract("path", rf"\A{folder}/([^/]+)/", 1)
    per = variables_report(variables).groupBy(own.alias("set_id")).agg(F.sort_array(F.collect_list(F.struct("key", "value", "category", "hcl"))).alias("variables"))
    return rows.join(per, "set_id", "left").withColumn("variables", F.coalesce("variables", F.array().cast("array<struct<key:string,value:string,category:string,hcl:string>>")))


def variable_sets_report(sets: DataFrame, variables: DataFrame) -> DataFrame:
    """set_id, title, id, description, global, variables of variable sets: their documents and their variables' (path, content)."""
    a = F.col("attributes")
    rows = _sets(sets, "variable-sets", "variable-set.json").select(
        "set_id", F.coalesce(F.nullif(attr_string(a, "name"), F.lit("")), "set_id").alias("title"), F.coalesce("id", F.lit("")).alias("id"), F.coalesce(attr_string(a, "description"), F.lit("")).alias("description"), bool_cell(attr_bool_ok(a, "global")).alias("global")
    )
    return _of_sets(rows, variables, "variable-sets")


def policy_sets_report(sets: DataFrame, parameters: DataFrame) -> DataFrame:
    """set_id, title, id, kind, global, policies, variables of policy sets: their documents and their parameters' (path, content)."""
    a = F.col("attributes")
    rows = _sets(sets, "policy-sets", "policy-set.json").select(
        "set_id", F.coalesce(F.nullif(attr_string(a, "name"), F.lit("")), "set_id").alias("title"), F.coalesce("id", F.lit("")).alias("id"), F.coalesce(attr_string(a, "kind"), F.lit("")).alias("kind"), bool_cell(attr_bool_ok(a, "global")).alias("global"), attr_int_ok(a, "policy-count").alias("policies")
    )
    return _of_sets(rows, parameters, "policy-sets")


def workspace_overview(workspaces: DataFrame) -> DataFrame:
    """path, id and the settings of workspace documents (path, content) that a report shows; unknown ones are ''."""
    a = F.col("attributes")
    text = [attr_string(a, c).alias(c.replace("-", "_")) for c in ("description", "terraform-version", "execution-mode")]
    rows = decode_jsonapi(workspaces.select("path", "content"))
    return rows.select("path", "id", *text, bool_cell(attr_bool_ok(a, "auto-apply")).alias("auto_apply"), attr_int_ok(a, "resource-count").alias("resource_count"), fmt_time(attr_time(a, "created-at")).alias("created"), F.coalesce(F.try_variant_get(a, "$['vcs-repo'].identifier", "string"), F.lit("")).alias("repository"))


def stack_report(stacks: DataFrame, deployments: DataFrame) -> DataFrame:
    """path, title, id, description, created, updated, n_deployments, deployments (name, created) of stack documents and their deployments' (path, content)."""
    a = F.col("attributes")
    folder = F.regexp_extract("path", r"\A(projects/[^/]+/stacks/[^/]+)/", 1)
    made = decode_jsonapi(deployments.select("path", "content")).filter("pos = 0").select("path", fmt_time(attr_time(a, "created-at")).alias("created"))
    each = deployments.select("path", folder.alias("folder"), F.regexp_extract("path", r"/deployments/([^/]+)/", 1).alias("name")).join(made, "path", "left")
    per = each.groupBy("folder").agg(F.sort_array(F.collect_set(F.struct("name", F.coalesce("created", F.lit("")).alias("created")))).alias("deployments"))
    own = decode_jsonapi(stacks.select("path", "content")).filter("pos = 0").select("path", "id", attr_string(a, "name").alias("name"), attr_string(a, "description").alias("description"), fmt_time(attr_time(a, "created-at")).alias("created"), fmt_time(attr_time(a, "updated-at")).alias("updated"))
    rows = stacks.select("path", folder.alias("folder")).join(own, "path", "left").join(per, "folder", "left")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    title = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.element_at(F.split("folder", "/"), -1))
    none = F.array().cast("array<struct<name:string,created:string>>")
    return rows.select("path", title.alias("title"), blank("id"), blank("description"), blank("created"), blank("updated"), F.coalesce(F.size("deployments"), F.lit(0)).alias("n_deployments"), F.coalesce("deployments", none).alias("deployments"))


def runs_report(runs: DataFrame, objects: DataFrame) -> DataFrame:
    """Runs (run_id, created_at, status) newest first, with their artifacts, how many, and an example."""
    rows = run_artifacts(runs, objects)
    return rows.select("run_id", "status", fmt_time(F.col("created_at")).alias("created"), F.array_join("artifacts", ", ").alias("artifacts"), F.size("artifacts").alias("n_artifacts"), F.get("artifacts", F.lit(0)).alias("example"), "created_at").orderBy(F.desc_nulls_last("created_at"), "run_id").drop("created_at")


def states_report(states: DataFrame, objects: DataFrame) -> DataFrame:
    """State versions (stem, serial, size) newest first, with their forms and a readable size."""
    return state_forms(states, objects).select("stem", "serial", human_bytes(F.col("size")).alias("size"), "forms").orderBy(F.desc("stem"))


def all_workspaces(workspaces: DataFrame, projects: DataFrame) -> DataFrame:
    """Every workspace with its project, by project and name."""
    return resolve_project(workspaces, projects).orderBy("project", "name")


def org_info(orgs: DataFrame) -> DataFrame:
    """path, id, title, email, created of organisation documents (path, content); a damaged one keeps its folder's name."""
    a = F.col("attributes")
    own = decode_jsonapi(orgs.select("path", "content")).filter("pos = 0").select("path", "id", attr_string(a, "name").alias("name"), attr_string(a, "email").alias("email"), fmt_time(attr_time(a, "created-at")).alias("created"))
    rows = orgs.select("path").join(own, "path", "left")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select("path", blank("id"), F.coalesce(F.nullif(F.col("name"), F.lit("")), F.split_part("path", F.lit("/"), F.lit(1))).alias("title"), blank("email"), blank("created"))


def org_overview(objects: DataFrame, depths: dict[str, tuple[str, int]], projects: DataFrame, workspaces: DataFrame, stacks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contents by label, counts by project) of an organisation."""
    return inventory_counts(objects, depths), project_counts(projects, workspaces, stacks)
