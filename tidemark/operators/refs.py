"""References between objects: gates, derived children, projects, users and directory identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.status import status_settled


def reference_gates(refs: DataFrame, ledger: DataFrame) -> DataFrame:
    """gate, state of references (gate, target_path): pending if a target is unsettled, absent if one is absent, else cleared."""
    rows = refs.join(ledger.select(F.col("path").alias("target_path"), "status"), "target_path", "left")
    open_ = F.bool_or(~status_settled(F.col("status")))
    return rows.groupBy("gate").agg(F.when(open_, "pending").when(F.coalesce(F.bool_or(F.col("status") == "absent"), F.lit(False)), "absent").otherwise("cleared").alias("state"))


def derived_settled(ledger: DataFrame) -> DataFrame:
    """path, settled of entries that derive children (derived_children): every child has a settled entry."""
    each = ledger.filter(F.size("derived_children") > 0).select("path", F.explode("derived_children").alias("child"))
    child = ledger.select(F.col("path").alias("child"), "status")
    return each.join(child, "child", "left").groupBy("path").agg(F.bool_and(status_settled(F.col("status"))).alias("settled"))


def skippable_listings(listings: DataFrame, ledger: DataFrame, gates: DataFrame, retryable: DataFrame) -> DataFrame:
    """path, skip of listings (path): settled, no gate (path, state) pending, no retryable absence below (path), children settled."""
    rows = listings.join(ledger.select("path", "status"), "path", "left")
    rows = rows.join(gates.groupBy("path").agg(F.bool_or(F.col("state") == "pending").alias("pending")), "path", "left")
    rows = rows.join(retryable.select("path", F.lit(True).alias("again")).distinct(), "path", "left").join(derived_settled(ledger), "path", "left")
    skip = status_settled(F.col("status")) & ~F.coalesce("pending", F.lit(False)) & ~F.coalesce("again", F.lit(False)) & F.coalesce("settled", F.lit(True))
    return rows.select("path", skip.alias("skip"))


def resolve_project(items: DataFrame, projects: DataFrame, default: str = "unknown-project") -> DataFrame:
    """Rows of items with `project`: its name by project_id, else its own relation name, else the default."""
    named = projects.select(F.col("id").alias("project_id"), F.col("name").alias("__name")).distinct()
    own = F.nullif(F.col("relation_name"), F.lit("")) if "relation_name" in items.columns else F.lit(None).cast("string")
    return items.join(named, "project_id", "left").withColumn("project", F.coalesce(F.nullif(F.col("__name"), F.lit("")), own, F.lit(default))).drop("__name")


def collect_users(*sources: DataFrame) -> DataFrame:
    """One row per id over references (id, ord, name): the last one wins."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    return rows.filter("id IS NOT NULL").groupBy("id").agg(F.max_by("name", "ord").alias("name"))


def claim_identities(listing: DataFrame, identities: DataFrame) -> DataFrame:
    """parent, name, id, claim, other of listed directories against bound ones (parent, name, id).

    ok: bound to this id; mismatch: bound to another; renamed_from: the id is bound to another
    name (`other`) that is listed no more; renamed_back: bound to this name and another; new: neither.
    """
    bound = identities.select("parent", "name", F.col("id").alias("bound_id"))
    elsewhere = identities.select("parent", "id", F.col("name").alias("other"))
    rows = listing.join(bound, ["parent", "name"], "left").join(elsewhere, ["parent", "id"], "left")
    here = F.col("other") == F.col("name")
    per = rows.groupBy("parent", "name", "id").agg(F.first("bound_id").alias("bound_id"), F.max(F.when(~here, F.col("other"))).alias("other"))
    claim = (
        F.when(F.col("bound_id") == F.col("id"), F.when(F.col("other").isNotNull(), "renamed_back").otherwise("ok"))
        .when(F.col("bound_id").isNotNull(), "mismatch")
        .when(F.col("other").isNotNull(), "renamed_from")
        .otherwise("new")
    )
    return per.select("parent", "name", "id", claim.alias("claim"), "other")
