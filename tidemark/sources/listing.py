"""Files that a pattern names, listed and read in tasks, so that nothing of them comes to the driver."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import written

FOUND = "path string, folder boolean, length long"
#: Bytes read at a time of a line that began in an earlier split, and paths that a task hands on at a time.
_SKIPPED, _HELD = 1 << 20, 10_000
_WILD = re.compile(r"[*?\[{\\]")
#: Names that Spark's readers unpack.
_PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst|zstd)$"


def _passed_over(name: str) -> bool:
    """Whether Spark's readers leave a name out."""
    return name.startswith(".") or name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata")) or name.endswith("._COPYING_")


def name_pattern(glob: str) -> re.Pattern:
    """One name's pattern as Hadoop's globs have it: * ? [a-z] [^a] {a,b} and a backslash before what stands for itself."""
    out, i, braces = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        elif c in "*?":
            out.append(".*" if c == "*" else ".")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            out.append("[" + re.sub(r"\A[!^]", "^", glob[i + 1 : end]).replace("[", r"\[") + "]")
            i = end
        elif c == "{" or c == "}" and braces:
            braces += 1 if c == "{" else -1
            out.append("(?:" if c == "{" else ")")
        else:
            out.append("|" if c == "," and braces else re.escape(c))
        i += 1
    return re.compile("".join(out), re.DOTALL)


def _steps(names: list[str]) -> Iterator[tuple[list[str], str | None]]:
    """The way down: plain names, then a pattern (none after the last one)."""
    plain: list[str] = []
    for name in names:
        if _WILD.search(name):
            yield plain, name
            plain = []
        else:
            plain.append(name)
    if plain:
        yield plain, None


def _below(folder: str) -> Iterator[tuple[str, bool, int]]:
    """The files below a folder that Spark's readers find."""
    with os.scandir(folder) as there:
        for e in there:
            if not _passed_over(e.name):
                yield from _below(e.path) if e.is_dir() else [(e.path, False, e.stat().st_size)]


def _down(parent: str, plain: list[str], pattern: re.Pattern | None, last: bool) -> Iterator[tuple[str, bool, int]]:
    """What a step leads to from a folder: folders, and in the last step files."""
    where = os.path.join(parent, *plain)
    if pattern is None:
        yield from _told([where] if os.path.exists(where) else [], last)
    elif os.path.isdir(where):
        with os.scandir(where) as there:
            yield from _told((e.path for e in there if pattern.fullmatch(e.name)), last)


def _told(paths: Iterable[str], last: bool) -> Iterator[tuple[str, bool, int]]:
    for path in paths:
        if os.path.isdir(path):
            yield from _below(path) if last else [(path, True, 0)]
        elif last and not _passed_over(os.path.basename(path)):
            yield path, False, os.path.getsize(path)


def matching(spark: SparkSession, glob: str) -> DataFrame | None:
    """path, length of the files that a pattern names, listed in tasks, name by name of the pattern; None where only Spark's reader will do.

    That is in other stores than a folder that all executors mount, for packed
    files, for braces over several names, and where nothing is found.
    """
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):/", glob)
    if (scheme[1] if scheme else spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").partition(":")[0]) != "file" or re.search(r"\{[^}]*/", glob):
        return None
    names = [n for n in os.path.abspath(re.sub(r"\Afile:/+", "/", glob)).split("/") if n]
    fixed = next((i for i, n in enumerate(names) if _WILD.search(n)), len(names))
    steps = list(_steps(names[fixed:])) or [([], None)]
    level = spark.range(1).select(F.lit("/" + "/".join(names[:fixed])).alias("path"))
    for i, (plain, name) in enumerate(steps):

        def run(batches: Iterator[pa.RecordBatch], plain=plain, name=name, last=i == len(steps) - 1) -> Iterator[pa.RecordBatch]:
            def rows(found: list[tuple]) -> pa.RecordBatch:
                columns = list(zip(*found, strict=True)) or [[]] * 3
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.bool_(), pa.int64()], strict=True)], [f.split()[0] for f in FOUND.split(", ")])

            pattern, found = name and name_pattern(name), []
            for batch in batches:
                for parent in batch.column(0).to_pylist():
                    for row in _down(parent, plain, pattern, last):
                        found.append(row)
                        if len(found) >= _HELD:
                            yield rows(found)
                            found = []
            yield rows(found)

        dealt = level.select("path").repartition(spark.sparkContext.defaultParallelism) if i else level
        level = written(dealt.mapInArrow(run, FOUND), "listed")
    found = level.select("path", "length")
    return None if found.isEmpty() or not found.filter(F.col("path").rlike(_PACKED)).isEmpty() else found


def splits(found: DataFrame) -> DataFrame:
    """file, block, length of the splits of files (path, length), dealt to tasks."""
    spark = found.sparkSession
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-(found.agg(F.sum("length")).first()[0] or 0) // size))
    held = found.filter("length > 0").select(F.col("path").alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("block"), "length")
    return held.select("file", "block", F.least(F.lit(size).cast("long"), F.col("length") - F.col("block")).alias("length")).repartition(tasks)


def split_lines(file: str, block: int, length: int) -> Iterator[tuple[str, int, str]]:
    """(file, block, line) of the lines that begin in a split; a line ends at a line feed alone."""
    with open(file, "rb") as f:
        if block:
            f.seek(block - 1)
            while not (part := f.readline(_SKIPPED)).endswith(b"\n"):
                if not part or f.tell() >= block + length:
                    return
        at = f.tell()
        while at < block + length and (line := f.readline()):
            yield file, block, (line if at else line.removeprefix(b"\xef\xbb\xbf")).removesuffix(b"\n").decode(errors="replace")
            at += len(line)
