"""Benchmark passages in documents, by q-gram lemma filtering and banded alignment.

Texts are compared as lower-cased letters and digits with single spaces
between. Benchmark items are cut into overlapping segments. A place where a
segment of m characters stands with at most e edits shares at least
m - q + 1 - e q of its q-grams, all on diagonals at most e apart; so shared
q-grams are counted in diagonal bands of width 2 (e + 1) that overlap by half,
and bands that reach the bound are verified by an alignment confined to them.
The filter can only pass too much: q-grams are compared by 64-bit keys made of
one byte per character.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import scan

from .common import id_and_text, if_small, tidy, written

Q = 8
#: An excerpt of SEGMENT + STRIDE - 1 characters or more holds a whole segment wherever it begins in its item.
SEGMENT, STRIDE = 80, 20
#: Edits allowed per character of a segment.
EDIT_RATE = 0.08
#: Segments handled in one pass over the documents, which bounds what is collected and broadcast: about a mebichar of benchmark text.
BLOCK_SEGMENTS = 50_000
#: Meetings of a text's q-grams with the block's that are held at once; a text that has more is looked at in parts.
MEETINGS = 1 << 20
MATCH = "doc_id long, item_id long, start long, end long, edits long"
_BITS = 21


@lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    """For each code point: its lower case if a letter or digit, else a space."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def normalize(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points compared, and where each stands in the text."""
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    points = _tables()[raw]
    space = points == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    at = np.flatnonzero(keep)
    return points[at], at


def grams(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit key per q-gram, q <= 8."""
    if len(points) < q:
        return np.empty(0, np.uint64)
    chars = ((points ^ (points >> 8)) & 0xFF).astype(np.uint64)
    out = np.zeros(len(points) - q + 1, np.uint64)
    for i in range(q):
        out = (out << np.uint64(8)) | chars[i : len(points) - q + 1 + i]
    return out


def banded_alignment(segment: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, begin, end) of the best place for the whole segment on diagonals low..high of text, or None if over budget."""
    width, m, n, shift = high - low + 1, len(segment), len(text), max(0, low)
    segment, text = segment.tolist(), text[shift : max(shift, high + m + 1)].tolist()
    far = budget + 1
    cost = [0 if 0 <= low + d <= n else far for d in range(width)]  # row 0: begin anywhere in the band
    begin = [low + d for d in range(width)]
    for i in range(m):
        c, new, start, left = segment[i], [far] * width, [0] * width, far
        for d in range(width):
            j = i + low + d  # text[j] is compared with segment[i]; cell (i + 1, j + 1)
            best, b = far, 0
            if 0 <= j < n and cost[d] + (text[j - shift] != c) < best:
                best, b = cost[d] + (text[j - shift] != c), begin[d]
            if d + 1 < width and cost[d + 1] + 1 < best:  # a segment character that the text lacks
                best, b = cost[d + 1] + 1, begin[d + 1]
            if d and 0 <= j < n and left + 1 < best:  # a text character that the segment lacks
                best, b = left + 1, start[d - 1]
            new[d], start[d], left = best, b, best
        cost, begin = new, start
        if min(cost) > budget:
            return None
    d = min(range(width), key=lambda k: (cost[k], abs(2 * k - width)))
    return cost[d], begin[d], m + low + d


def segments(text: str, q: int = Q) -> Iterator[tuple[int, np.ndarray]]:
    """(place, code points) of the overlapping segments of an item's compared text; the last ends with it."""
    points, _ = normalize(text)
    points = points[(points != 32).argmax() :] if len(points) and (points != 32).any() else points[:0]
    points = points[:-1] if len(points) and points[-1] == 32 else points
    if len(points) >= q:
        for s in dict.fromkeys([*range(0, max(1, len(points) - SEGMENT), STRIDE), max(0, len(points) - SEGMENT)]):
            yield s, points[s : s + SEGMENT]


class SegmentIndex:
    """q-grams of benchmark segments, given as (item, code points)."""

    def __init__(self, held: list[tuple[int, np.ndarray]], q: int, rate: float):
        self.q, keys, owner, offset = q, [], [], []
        self.item, self.segments, self.budget, self.least = [], [], [], []
        for item, part in held:
            edits = int(rate * len(part))
            while edits and len(part) - q + 1 - edits * q < 1:
                edits -= 1
            g = grams(part, q)
            keys.append(g)
            owner.append(np.full(len(g), len(self.segments)))
            offset.append(np.arange(len(g)))
            self.item.append(item)
            self.segments.append(part)
            self.budget.append(edits)
            self.least.append(len(part) - q + 1 - edits * q)
        none = np.empty(0, np.int64)
        keys = np.concatenate([np.empty(0, np.uint64), *keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner, self.offset = keys[order], np.concatenate([none, *owner])[order], np.concatenate([none, *offset])[order]
        self.budget, self.least = np.array(self.budget, np.int64), np.array(self.least, np.int64)
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self._slot(self.keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the regions of a text, in its own code points; regions of one item that meet are one."""
        points, at = normalize(text)
        keys = grams(points, self.q)
        where = np.flatnonzero(self.maybe[self._slot(keys)])
        low, high = np.searchsorted(self.keys, keys[where], "left"), np.searchsorted(self.keys, keys[where], "right")
        upto = np.concatenate([[0], np.cumsum(high - low)])
        found, parts = [], [(0, len(where))]
        while parts:
            a, b = parts.pop()
            if upto[a] == upto[b]:
                continue
            if upto[b] - upto[a] > MEETINGS and where[b - 1] - where[a] > 4 * SEGMENT:
                # Two halves that overlap by more than a segment with its edits.
                middle = (where[a] + where[b - 1]) // 2
                parts += [(a, int(np.searchsorted(where, middle + SEGMENT))), (int(np.searchsorted(where, middle - SEGMENT)), b)]
                continue
            found += self._near(points, at, where[a:b], low[a:b], (high - low)[a:b])
        found.sort()
        merged: list[tuple[int, int, int, int]] = []
        for item, a, b, edits in found:
            if merged and merged[-1][0] == item and a <= merged[-1][2]:
                old = merged[-1]
                merged[-1] = (item, old[1], max(b, old[2]), max(edits, old[3]))
            else:
                merged.append((item, a, b, edits))
        return merged

    def _near(self, points: np.ndarray, at: np.ndarray, where: np.ndarray, low: np.ndarray, times: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Regions that hold a segment, from the q-grams at some places; low and times: the block's equal ones."""
        total = int(times.sum())
        each = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(total)
        segment = self.owner[each]
        diagonal = np.repeat(where, times) - self.offset[each] + SEGMENT  # never negative
        # A band that can reach its bound holds half of it in one of its two halves: look at those first.
        half = self.budget[segment] + 1
        coarse = segment * np.int64(1 << 40) + diagonal // half
        cells, counts = np.unique(coarse, return_counts=True)
        after = np.searchsorted(cells, cells + 1)
        after[after == len(cells)] = len(cells) - 1
        both = counts + np.where(cells[after] == cells + 1, counts[after], 0)
        before = np.searchsorted(cells, cells - 1)
        before[before == len(cells)] = 0
        lone = cells[before] != cells - 1  # the band that begins one half earlier
        owner = cells >> 40
        found: list[tuple[int, int, int, int]] = []
        enough = np.flatnonzero((both >= self.least[owner]) | (lone & (counts >= self.least[owner])))
        for i in enough.tolist():
            s, width = int(owner[i]), int(self.budget[owner[i]]) + 1
            first = int(cells[i] & ((1 << 40) - 1)) * width - SEGMENT
            begin = first - (width if lone[i] else 0)
            hit = banded_alignment(self.segments[s], points, begin - 1, first + 2 * width, int(self.budget[s]))
            if hit:
                found.append((self.item[s], int(at[max(0, hit[1])]), int(at[min(hit[2], len(at)) - 1]) + 1, hit[0]))
        return found


def _cut(benchmark: DataFrame, q: int) -> DataFrame:
    """item_id, place, points of every segment; points as text of the compared code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(place, part.astype("<u4").tobytes().decode("utf-32-le")) for place, part in segments(text or "", q)]
                if rows:
                    places, texts = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(rows), pa.int64()), pa.array(places, pa.int64()), pa.array(texts, pa.string())], ["item_id", "place", "points"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(tidy(run), "item_id long, place long, points string")


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, block_segments: int = BLOCK_SEGMENTS) -> DataFrame:
    """doc_id, item_id, start, end, edits: every region of a document that holds a segment of a benchmark item.

    start and end are code points of the whole text; edits are those of the
    region's worst segment. An item shorter than a segment is one segment; one
    with fewer than q letters, digits and spaces can't be told apart and is
    never found. A null text holds nothing; repeated rows of documents give
    repeated regions; rows that repeat an item_id are one item of all their
    texts; null ids are kept; other columns are left out; empty tables give no rows.

    The benchmark's segments are a query set that is held against all documents
    in blocks of `block_segments`, one after the other: each block is one pass
    without a shuffle, and its index leaves memory before the next is made. With
    more than one block, regions of an item are merged over blocks, and repeated
    rows of documents give one region.
    """
    cut = written(_cut(benchmark, q), "segments")
    total = cut.count()
    if total <= block_segments:
        return _against(docs, cut.orderBy("item_id", "place"), q, rate)[0]
    numbered = written(scan.positions(cut, [], [F.asc("item_id"), F.asc("place"), F.asc("points")], "number"), "numbered")
    found = None
    for first in range(0, total, block_segments):
        block = numbered.filter((F.col("number") >= first) & (F.col("number") < first + block_segments)).orderBy("number")
        rows, shared = _against(docs, block, q, rate)
        rows = written(rows, "matches")
        shared.destroy()
        found = rows if found is None else found.unionByName(rows)
    return _merged(found)


def _merged(found: DataFrame) -> DataFrame:
    """MATCH rows of which those of one document and item that meet are one."""
    along = Window.partitionBy("doc_id", "item_id").orderBy("start", "end")
    begins = F.coalesce(F.col("start") > F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    regions = found.withColumn("begins", begins.cast("int")).withColumn("region", F.sum("begins").over(along))
    return regions.groupBy("doc_id", "item_id", "region").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("edits").alias("edits")).drop("region")


def _against(docs: DataFrame, block: DataFrame, q: int, rate: float):
    """(MATCH rows of all documents, the broadcast index) for a block of segments, a bounded number of rows."""
    held = [(r.item_id, np.frombuffer(r.points.encode("utf-32-le"), "<u4")) for r in block.toLocalIterator()]
    shared = docs.sparkSession.sparkContext.broadcast(SegmentIndex(held, q, rate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows = [(doc, *m) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for m in index.matches(text)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in MATCH.split(", ")])

    return id_and_text(docs).mapInArrow(tidy(run), MATCH), shared


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item is found, with their own columns.

    A row is judged by its own text: rows that share a doc_id with a row that
    goes may stay, and rows without doc_id may go. Rows without text stay; an
    empty table stays empty. Rows are told apart by a 64-bit hash of id and text.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = written(benchmark_matches(docs.select(key.alias("doc_id"), "text"), benchmark).select("doc_id").distinct(), "found")
    told = if_small(found.select(F.col("doc_id").alias("__found")))
    return docs.join(told, key == F.col("__found"), "left_anti").select(docs.columns)
