"""Packing documents into fixed-length sequences with bounded space.

Each partition keeps a fixed number of open windows. A document, cut only where
it is longer than a window, goes piece by piece into the open window it fills
best. When none can hold a piece, the fullest window is closed: if its room is
worth a cut, the piece's beginning fills it first. Windows still open at the
end, a bounded number per partition, are merged in groups of partitions, level
by level; what the last level leaves is cut at powers of two, which need no
padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, spare, tidy, written
from .tokenizing import text_encoder, text_slices

WINDOWS = 32
#: Room for fewer tokens than this is padded rather than filled by cutting a piece.
WORTH_A_CUT = 32
#: Bytes of text encoded at a time: fewer than where encoding is all a task does, as other stages' executors are full.
PACKED_BYTES = 3 << 20
#: Partitions whose open windows one merge task takes.
FAN_IN = 64
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = [f.split()[0] for f in PIECE.split(", ")]


class Window:
    """An open sequence: its pieces as (doc_id, start, ids, doc_tokens)."""

    __slots__ = ("pieces", "used")

    def __init__(self):
        self.pieces: list[tuple] = []
        self.used = 0

    def add(self, piece: tuple) -> None:
        self.pieces.append(piece)
        self.used += len(piece[2]) // 4


class Packer:
    """Bounded-space best fit; `close(window)` is called for every finished window."""

    def __init__(self, size: int, windows: int, close):
        self.size, self.most, self.close = size, windows, close
        self.open: list[Window] = []

    def place(self, piece: tuple) -> None:
        """piece: (doc_id, start, ids of at most `size` tokens as 4-byte integers, doc_tokens)."""
        doc, start, ids, total = piece
        while ids:
            need = len(ids) // 4
            fits = [w for w in self.open if self.size - w.used >= need]
            if fits:
                best = max(fits, key=lambda w: w.used)
                best.add((doc, start, ids, total))
                if best.used == self.size:
                    self.open.remove(best)
                    self.close(best)
                return
            if len(self.open) == self.most:
                fullest = max(self.open, key=lambda w: w.used)
                room = self.size - fullest.used
                if room >= WORTH_A_CUT:
                    fullest.add((doc, start, ids[: 4 * room], total))
                    start, ids = start + room, ids[4 * room :]
                self.open.remove(fullest)
                self.close(fullest)
                continue
            fresh = Window()
            fresh.add((doc, start, ids, total))
            if fresh.used == self.size:
                self.close(fresh)
            else:
                self.open.append(fresh)
            return

    def document(self, doc, ids: bytes) -> None:
        """Whole windows first, then the rest by best fit."""
        total = len(ids) // 4
        for start in range(0, total, self.size):
            self.place((doc, start, ids[4 * start : 4 * (start + self.size)], total))


def _rows(window: Window, sequence: int) -> list[tuple]:
    out, offset = [], 0
    for doc, start, ids, total in window.pieces:
        n = len(ids) // 4
        out.append((doc, start, n, zlib.crc32(ids), total, sequence, offset))
        offset += n
    return out


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, windows: int = WINDOWS, tag: str = "packed", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and its ids).

    A document's ids are those of its whole text without added special tokens,
    then `end_id`; a null or empty text is `end_id` alone. Each id lies in one
    piece. Pieces of a sequence follow each other from offset 0; it is padded
    to `size` unless its length is a power of two. Repeated rows are packed each
    for itself, a null doc_id is kept, other columns are left out and an empty
    table gives no rows. Sequence numbers are unique, not dense. `with_ids`
    adds the ids as bytes (4 each, little-endian). No shuffle but that of the
    windows left open, which the number of partitions bounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer_path, True)
        part, done, end = TaskContext.get().partitionId(), 0, end_id.to_bytes(4, "little")
        rows: list[tuple] = []

        def close(w: Window) -> None:
            nonlocal done
            rows.extend((*r, (p[2] if with_ids else None), 0) for r, p in zip(_rows(w, part << 32 | done), w.pieces, strict=True))
            done += 1

        packer = Packer(size, windows, close)
        for batch in batches:
            for some in text_slices(batch, 1, PACKED_BYTES):
                found = encoder.encode(some.column(1))
                spare()
                flat, starts, ends = found.flat.astype("<u4"), found.starts.tolist(), (found.starts + found.lengths).tolist()
                for doc, a, b in zip(some.column(0).to_pylist(), starts, ends, strict=True):
                    packer.document(doc, flat[a:b].tobytes() + end)
                    if len(rows) > 4096:
                        yield _batch(rows)
                        rows.clear()
        for w in packer.open:
            rows.extend((*r, p[2], part // FAN_IN + 1) for r, p in zip(_rows(w, part << 32 | done), w.pieces, strict=True))
            done += 1
        yield _batch(rows)

    table = written(id_and_text(docs).mapInArrow(tidy(run), PIECE + ", ids binary, merge long"), tag)
    out = [table.filter("merge = 0").drop("merge")]
    left, level = table.filter("merge > 0"), 1
    groups = left.agg(F.max("merge")).first()[0] or 0  # one number; it tells how many levels there are
    while groups:
        last = groups == 1
        base = level << 60
        left = written(left.groupBy("merge").applyInArrow(_merger(size, windows, base, last), PIECE + ", ids binary, merge long"), tag)
        out.append(left.filter("merge = 0").drop("merge"))
        left, level, groups = left.filter("merge > 0"), level + 1, 0 if last else -(-groups // FAN_IN)
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole if with_ids else whole.drop("ids")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 9
    kinds = [pa.int64()] * 7 + [pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*_FIELDS, "ids", "merge"])


def _merger(size: int, windows: int, base: int, last: bool):
    def merge(table: pa.Table) -> pa.Table:
        group, done, rows = table.column("merge")[0].as_py(), 0, []

        def number() -> int:
            nonlocal done
            done += 1
            return base | group << 24 | done

        def close(w: Window) -> None:
            rows.extend((*r, p[2], 0) for r, p in zip(_rows(w, number()), w.pieces, strict=True))

        packer = Packer(size, windows if not last else 1, close)
        for r in table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist():
            packer.place((r["doc_id"], r["start"], r["ids"], r["doc_tokens"]))
        for w in packer.open:
            if not last:
                n = number()
                rows.extend((*x, p[2], (group - 1) // FAN_IN + 1) for x, p in zip(_rows(w, n), w.pieces, strict=True))
                continue
            pending = w.pieces[::-1]
            for bit in range(w.used.bit_length() - 1, -1, -1):  # a sequence per power of two
                room, part = w.used & 1 << bit, Window()
                while room:
                    doc, start, ids, total = pending.pop()
                    n = min(room, len(ids) // 4)
                    part.add((doc, start, ids[: 4 * n], total))
                    if 4 * n < len(ids):
                        pending.append((doc, start + n, ids[4 * n :], total))
                    room -= n
                if part.pieces:
                    close(part)
        return pa.Table.from_batches([_batch(rows)])

    return merge
