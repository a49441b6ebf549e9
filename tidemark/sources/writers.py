"""Writers of write-once generations, roll-ups, listings and extracted files."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.paths import is_valid_path
from tidemark.sources import files


def write_generation(df: DataFrame, folder: str, prefix: str, generation: int) -> str:
    """Write members (name, sha256, content, ...) as a numbered generation and return its path, for read_generation.

    A generation is written once: where its number is committed, this is an
    error. Data goes to a folder of this attempt alone; the index, which names
    that folder, comes last, and its end commits the generation. After a crash
    the same call writes it anew, and reclaim_attempts removes what the crash left.
    One writer at a time, as one process holds an archive's lock.
    """
    spark, where = df.sparkSession, f"{folder}/{prefix}.gen{generation:04d}"
    if _committed(spark, where):
        raise FileExistsError(f"the generation {where} exists")
    data = f"{where}.data-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(data)
    # The index is of what was written; the input isn't computed again.
    _index(spark.read.parquet(data).drop("content").withColumn("data", F.lit(data.rpartition("/")[2])), where)
    return where


def _index(members: DataFrame, where: str) -> None:
    members.write.mode("overwrite").parquet(f"{where}.index")


def _committed(spark: SparkSession, where: str) -> bool:
    return files.exists(spark, f"{where}.index/_SUCCESS")


def read_generation(spark: SparkSession, where: str) -> tuple[DataFrame, DataFrame]:
    """(members with their content, index) of a committed generation."""
    if not _committed(spark, where):
        raise FileNotFoundError(f"no generation is committed at {where}")
    index = spark.read.parquet(f"{where}.index")
    first = index.select("data").first()
    if first is None:  # a generation without members
        return index.drop("data").withColumn("content", F.lit(None).cast("binary")), index.drop("data")
    return spark.read.parquet(f"{where.rpartition('/')[0]}/{first.data}"), index.drop("data")


def reclaim_attempts(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """Remove the data of attempts that no committed index of the prefix names, and return their names. Not while a writer is at work."""
    found = [n for n in files.names(spark, folder) if re.fullmatch(rf"{re.escape(prefix)}\.gen\d+\.data-[0-9a-f]+", n)]
    named = set()
    for where in {n.rpartition(".data-")[0] for n in found}:
        if _committed(spark, f"{folder}/{where}"):
            named.update(r.data for r in spark.read.parquet(f"{folder}/{where}.index").select("data").limit(1).collect())
    gone = [n for n in found if n not in named]
    for n in gone:
        files.remove(spark, f"{folder}/{n}")
    return gone


def append_rollup(df: DataFrame, folder: str, batch: int) -> None:
    """Append (path, sha256, content) as a numbered batch; bytes that aren't UTF-8 and a path given twice are refused before anything is written.

    A batch that is appended again replaces itself, and readers put lines in the
    order of their batches, so a retry, however late, adds nothing and hides nothing.
    """
    wrong = ~F.is_valid_utf8(F.col("content").cast("string"))
    per = df.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.bool_or(wrong).alias("bad"))
    found = per.agg(F.bool_or("bad").alias("bad"), F.max("n").alias("n")).first()  # both questions in one pass
    if found.bad or (found.n or 0) > 1:
        raise ValueError("roll-up content must be UTF-8" if found.bad else "a path is given twice")
    df.select("path", "sha256", F.col("content").cast("string").alias("content")).write.mode("overwrite").json(f"{folder}/batch={batch:010d}")


def extract_objects(objects: DataFrame, target: str) -> DataFrame:
    """path, bytes, error: write each object's bytes (path, content) under a folder that all executors mount; a failure is a row."""
    import os

    fields = "path string, bytes long, error string"
    target = re.sub(r"\Afile:/+", "/", target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content, ok in (tuple(c[i].as_py() for c in batch.columns) for i in range(batch.num_rows)):  # one object's bytes at a time
                try:
                    if not ok or content is None:
                        raise ValueError("unsafe name" if not ok else "no content")
                    where = os.path.join(target, path)
                    os.makedirs(os.path.dirname(where), exist_ok=True)
                    with open(where, "wb") as f:
                        f.write(content)
                    rows.append((path, len(content), None))
                except (OSError, ValueError) as e:
                    rows.append((path, 0, str(e)))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.int64(), pa.string()], strict=True)], ["path", "bytes", "error"])

    safe = F.coalesce(is_valid_path(F.col("path")), F.lit(False))
    return objects.select("path", F.col("content").cast("binary"), safe.alias("safe")).mapInArrow(run, fields)


def write_listing_json(df: DataFrame, path: str) -> None:
    """A machine-readable listing; null columns are left out of a row."""
    df.select("path", "org", "form", "container", F.col("mtime").alias("modified"), "size", "offloaded").write.json(path)
