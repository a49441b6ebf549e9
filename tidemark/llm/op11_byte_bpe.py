"""Byte-level BPE by a local rank file: the tiktoken library encodes whole texts and decodes ids to raw bytes.

A long text is given to the library in parts. It is cut between a character
that is no white space and white space: no match of the pattern goes over such
a place, and none looks beyond it, so the parts' ids are the text's ids.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text
from .tokenizing import text_slices

#: Characters after which a part ends at the next safe place.
PART_CHARS = 1 << 16
#: Bytes of text encoded at a time; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20
#: A place before white space of every kind of pattern engine, after what is white space for none.
_SAFE = re.compile(r"(?<=\S)(?=[\t-\r ])")


def safe_parts(text: str, size: int = PART_CHARS) -> list[str]:
    """A text in parts of `size` characters or a little more, cut where a match always ends; an unbroken run stays whole."""
    parts, begin = [], 0
    while len(text) - begin > size:
        found = _SAFE.search(text, begin + size)
        if found is None:
            break
        parts.append(text[begin : found.start()])
        begin = found.start()
    parts.append(text[begin:])
    return parts


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """The worker's encoder for a rank file: lines of a base64 token and its rank. It has no special tokens and asks no network."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(text: str, path: str, pattern: str, size: int = PART_CHARS) -> np.ndarray:
    """The ids of one whole text as unsigned 32-bit integers."""
    ordinary = encoding(path, pattern).encode_ordinary
    return np.concatenate([np.array(ordinary(part), "<u4") for part in safe_parts(text, size)])


def encode(docs: DataFrame, path: str, pattern: str, size: int = PART_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids of every whole text; ids are little-endian unsigned 32-bit integers in a binary.

    A null text counts as empty and has no ids; strings of special tokens are
    ordinary text; bytes that aren't UTF-8 count as U+FFFD. Rows are kept as
    they are, repeated ones and those without doc_id too; other columns are left
    out; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1, SLICE_BYTES):
                ids = [encode_text(t, path, pattern, size) for t in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids"])

    whole = F.make_valid_utf8(F.coalesce("text", F.lit(""))).alias("text")
    return id_and_text(docs).select("doc_id", whole).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of encoded(doc_id, n_tokens, ids) with `decoded`: the raw bytes of their ids, whether or not they are text.

    Null ids decode to null; an id that the rank file lacks is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = encoding(path, pattern).decode_bytes
        for batch in batches:
            for part in text_slices(batch, 2, SLICE_BYTES):
                made = [None if b is None else raw(np.frombuffer(b, "<u4").tolist()) for b in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and decoded again."""
    done = decode(encode(docs, path, pattern), path, pattern)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
