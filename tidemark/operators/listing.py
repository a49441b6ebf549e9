"""Listings over all physical forms of an archive's objects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paths import is_valid_path, under_prefix

# The form that wins where a path has several.
PRECEDENCE = {"loose": 0, "stub": 1, "sealed": 2, "mirror": 3}


def merge_forms(*forms: DataFrame) -> DataFrame:
    """One row per path from tables (path, form, size, …): loose over stub over sealed over mirror; `offloaded` says that a stub or the mirror won.

    One shuffle: the forms are united, and the best row of a path is an aggregate.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), forms)
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in PRECEDENCE.items() for x in kv]), F.col("form"))
    rest = [c for c in rows.columns if c != "path"]
    best = rows.groupBy("path").agg(F.min_by(F.struct(*rest), F.struct(rank, "size")).alias("b"))
    return best.select("path", "b.*").withColumn("offloaded", F.col("form").isin("stub", "mirror"))


def bundle_offloaded(members: DataFrame, local_files: DataFrame) -> DataFrame:
    """Members (bundle, name, …) with `offloaded`: their bundle has no local file (path)."""
    here = local_files.select(F.col("path").alias("bundle"), F.lit(True).alias("here")).distinct()
    return members.join(here, "bundle", "left").withColumn("offloaded", F.col("here").isNull()).drop("here")


def filter_names(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Rows whose `column` is in the short list names(name); an empty list admits all."""
    allowed = names.select(F.col("name").alias(column)).distinct()
    # Whether there is a name at all is one row of the plan.
    some = F.broadcast(allowed.agg(F.count(F.lit(1)).alias("__names")))
    rows = df.join(allowed.withColumn("__named", F.lit(True)), column, "left").crossJoin(some)
    return rows.filter("__named OR __names = 0").select(df.columns)


def unmatched_names(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Names of the list that no row has."""
    return names.select("name").distinct().join(df.select(F.col(column).alias("name")), "name", "left_anti")


def list_objects(objects: DataFrame, prefix: str = "") -> DataFrame:
    """Objects at or under a clean prefix, by organisation and path."""
    if prefix and (prefix.startswith("/") or "\\" in prefix or any(s in ("", ".", "..") for s in prefix.split("/"))):
        raise ValueError(f"not a clean prefix: {prefix!r}")
    return objects.filter(under_prefix(F.col("path"), F.lit(prefix))).orderBy("org", "path")


def valid_stubs(stubs: DataFrame, supported: int = 1) -> DataFrame:
    """Stubs (path, version, size, sha256) of a version that is known and a size that can be."""
    return stubs.filter(F.col("version").between(1, supported) & (F.col("size") >= 0) & is_valid_path(F.col("path")))


def search(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows of which a column holds the text, whatever the case."""
    return df.filter(reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(text.lower())) for c in columns]))


def tree_children(objects: DataFrame, directory: str = "") -> DataFrame:
    """name, dir, size, remote: one level of the tree, directories first.

    A name that is both a file and a directory is shown as the directory only if nothing local is the file.
    """
    below = objects.filter(under_prefix(F.col("path"), F.lit(directory)) & (F.col("path") != directory))
    rest = F.col("path") if not directory else F.substring("path", F.lit(len(directory) + 2), F.length("path"))
    rows = below.select(F.split_part(rest, F.lit("/"), F.lit(1)).alias("name"), F.contains(rest, F.lit("/")).alias("deep"), "size", "offloaded")
    file = ~F.col("deep")
    both = rows.groupBy("name").agg(F.bool_or("deep").alias("deep"), F.bool_or(file & ~F.col("offloaded")).alias("local"), F.max(F.when(file, F.col("size"))).alias("size"), F.bool_and("offloaded").alias("remote"))
    is_dir = F.col("deep") & ~F.col("local")
    return both.select("name", is_dir.alias("dir"), F.when(~is_dir, F.col("size")).alias("size"), F.when(is_dir, False).otherwise(F.col("remote")).alias("remote")).orderBy(F.desc("dir"), "name")


def union_archives(archives: dict[str, DataFrame]) -> DataFrame:
    """One listing of several organisations' objects."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("org", F.lit(org)) for org, df in archives.items()])


def index_union(*ids: DataFrame) -> DataFrame:
    """Distinct ids over several tables (id)."""
    return reduce(lambda a, b: a.unionByName(b), [df.select("id") for df in ids]).distinct()


def leftover_keys(inventory: DataFrame, accounted: DataFrame) -> DataFrame:
    """Keys that nothing accounts for."""
    return inventory.select("key").join(accounted.select("key"), "key", "left_anti")
