"""Ledger snapshots: one indented JSON document per shard, read by splits like any text.

Written with an indentation of two, a document has its sections' names one step
in and their members two steps in, so a line's indentation tells what begins
there. A task puts the lines of its split together to members; what a split's
border cuts through is put together afterwards, from two pieces a split.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources import listing
from tidemark.sources.scratch import written

#: Rows of a batch opened at a time, and rows and code points of pieces held until they go on: a document without indentation is one row.
OPENED, HELD_ROWS, HELD_CHARS = 32, 4096, 4 << 20
#: kind is member; head (what goes on from the split before) and tail (what goes on in the next); end (the section at a split's end); field (of the document itself, no section); or document (one that isn't indented). A section that began in an earlier split is null.
PIECE = "file string, block long, kind string, section string, text string"
_SECTION = re.compile(r'  ("(?:[^"\\]|\\.)*") ?: ')


def pieces(lines: Iterator[tuple[str, int, str]]) -> Iterator[tuple]:
    """PIECE rows of (file, block, line), each split's lines in order."""
    at, section = None, None
    held: list[str] | None = None  # of a member that isn't whole yet
    head: list[str] | None = None  # of what began before the split

    def rest() -> Iterator[tuple]:
        if head:
            yield (*at, "head", None, "\n".join(head))
        if held:
            yield (*at, "tail", section, "\n".join(held))
        if at is not None:
            yield (*at, "end", section, None)

    for file, block, line in lines:
        if at != (file, block):
            yield from rest()
            at, section, held, head = (file, block), None, None, [] if block else None
        depth = len(line) - len(line.lstrip(" "))
        closes = line[depth : depth + 1] in ("}", "]")
        if line.startswith('{"'):
            yield (*at, "document", None, line)
        elif depth < 4:
            if head:
                yield (*at, "head", None, "\n".join(head))
            named = _SECTION.match(line)
            if named and not line.rstrip().endswith(("{", "[")):
                yield (*at, "field", None, line)
            section, held, head = json.loads(named[1]) if named else section, None, None
        elif depth == 4 and not closes:
            if head:
                yield (*at, "head", None, "\n".join(head))
            held = head = None
            if line.endswith(("{", "[")):
                held = [line]
            else:
                yield (*at, "member", section, line)
        elif held is not None:
            held.append(line)
            if depth == 4:
                yield (*at, "member", section, "\n".join(held))
                held = None
        elif head is not None:
            head.append(line)
            if depth == 4:
                yield (*at, "head", None, "\n".join(head))
                head = None
    yield from rest()


def _lines(spark: SparkSession, glob: str) -> DataFrame:
    """file, block, value: every line; or, where all executors mount the files, every split's length, whose lines the task that gets it reads."""
    found = listing.matching(spark, glob)
    if found is not None:
        return listing.splits(found).withColumnRenamed("length", "value")
    return spark.read.option("lineSep", "\n").text(glob).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def read_pieces(spark: SparkSession, glob: str) -> DataFrame:
    """PIECE rows of snapshot documents."""
    names, kinds = [f.split()[0] for f in PIECE.split(", ")], [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*held, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        held, chars = [], 0
        parts = (batch.slice(i, OPENED) for batch in batches for i in range(0, batch.num_rows, OPENED))
        given = (x for part in parts for x in zip(*(c.to_pylist() for c in part.columns), strict=True))
        for row in pieces(line for x in given for line in ([x] if isinstance(x[2], str) else listing.split_lines(*x))):
            held.append(row)
            chars += len(row[-1] or "")
            if len(held) >= HELD_ROWS or chars >= HELD_CHARS:
                yield rows(held)
                held, chars = [], 0
        yield rows(held)

    return _lines(spark, glob).mapInArrow(run, PIECE)


def members(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """(section, text of all members; text of the documents that aren't indented), in one pass over the files."""
    rows = written(read_pieces(spark, glob), "pieces")
    return stitched(rows), rows.filter("kind = 'document'").select("text")


def stitched(rows: DataFrame) -> DataFrame:
    """section, text of the members in PIECE rows, which are read several times."""
    # The section that a split begins in, and members in pieces: a few rows per split.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = rows.filter("kind = 'end'").select("file", "block", F.last("section", True).over(before).alias("begun")).filter("begun IS NOT NULL")
    known = rows.filter("kind IN ('member', 'tail')")
    late = known.filter("section IS NULL").join(begins, ["file", "block"]).withColumn("section", F.col("begun")).drop("begun")
    whole = known.filter("section IS NOT NULL").unionByName(late)
    along = Window.partitionBy("file").orderBy("block", "kind")  # a split's head comes before its tail
    cut = whole.filter("kind = 'tail'").unionByName(rows.filter("kind = 'head'")).withColumn("number", F.count_if(F.col("kind") == "tail").over(along))
    joined = cut.groupBy("file", "number").agg(F.max("section").alias("section"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "kind", "text"))), lambda p: p["text"]), "\n").alias("text"))
    return whole.filter("kind = 'member'").select("section", "text").unionByName(joined.filter("number > 0").select("section", "text"))
