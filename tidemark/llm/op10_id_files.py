"""Token ids as compressed binary files.

Documents are dealt into ranges of doc_id, one file per range, so that files in
order hold the documents in ascending doc_id. A file is a run of chunks; a
chunk holds whole documents, their ids coded by id_coder in independent,
checksummed blocks. A chunk is self-contained: any task can decode any chunk,
and a lost one costs only itself. Chunks are rows of a Parquet container, since
storage that all executors share is reached through Spark's writers and readers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_and_text
from .id_coder import BLOCK_IDS, decode, encode
from .tokenizing import text_encoder, text_slices

#: Ids in a chunk, which is one block of the coder (a longer document has a chunk of several blocks to itself).
CHUNK_IDS = BLOCK_IDS
CHUNK = "file long, chunk long, start long, n_ids long, doc_ids array<long>, doc_tokens array<long>, payload binary"


def _chunk(file: int, chunk: int, start: int, docs: list, parts: list[np.ndarray]) -> pa.RecordBatch:
    ids = np.concatenate(parts)
    values = [[file], [chunk], [start], [len(ids)], [docs], [[len(p) for p in parts]], [encode(ids)]]
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], [f.split()[0] for f in CHUNK.split(", ")])


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, drops_space: bool = False) -> None:
    """Write the ids of every whole text, each followed by `end_id`, to a new folder.

    A null or empty text is `end_id` alone. Rows come in ascending doc_id (a
    null first; equal ones by text); repeated rows stay repeated; other columns
    are left out; an empty table gives an empty folder. One shuffle, by range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file, end = text_encoder(tokenizer_path, drops_space), TaskContext.get().partitionId(), np.array([end_id], np.int32)
        chunk = start = held = 0
        names: list = []
        parts: list[np.ndarray] = []
        for batch in batches:
            for some in text_slices(batch, 1):
                found = encoder.encode(some.column(1))
                for i, doc in enumerate(some.column(0).to_pylist()):
                    ids = np.concatenate([found.of(i), end])
                    if held and held + len(ids) > CHUNK_IDS:
                        yield _chunk(file, chunk, start, names, parts)
                        chunk, start, held, names, parts = chunk + 1, start + held, 0, [], []
                    names.append(doc)
                    parts.append(ids)
                    held += len(ids)
        if held:
            yield _chunk(file, chunk, start, names, parts)

    id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, CHUNK).write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and, if asked for, ids as bytes) per document of a folder.

    start counts the ids of all documents before it. Every block's checksum is
    compared; a damaged one fails the task.
    """
    fields = "doc_id long, file long, local long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                raw = decode(row["payload"].as_py()).tobytes()
                counts = row["doc_tokens"].as_py()
                ends = np.cumsum([0, *counts]).tolist()
                cut = [raw[4 * a : 4 * b] for a, b in zip(ends, ends[1:], strict=False)]
                base = row["start"].as_py()
                out = [row["doc_ids"].values, pa.array([row["file"].as_py()] * len(counts), pa.int64()), pa.array([base + e for e in ends[:-1]], pa.int64()), pa.array(counts, pa.int64()), pa.array([zlib.crc32(x) for x in cut], pa.int64())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(cut, pa.binary())] * with_ids, names)

    chunks = spark.read.schema(CHUNK).parquet(path)
    # One row per file: their number is that of the partitions written, not of the documents.
    sizes = chunks.groupBy("file").agg(F.sum("n_ids").alias("n"))
    bases = sizes.select("file", (F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("base"))
    docs = chunks.select("payload", "doc_ids", "doc_tokens", "file", "start").mapInArrow(run, fields)
    return docs.join(bases, "file").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
