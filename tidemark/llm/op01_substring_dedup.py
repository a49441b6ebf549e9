"""Near-duplicate passages by compact windows.

A text is its sequence of word shingles. Under one hash function, all its
subsequences whose least hash stands at one place form a compact window
(begin, at, end): the place and how far its value stays the least. These are
the subtrees of the Cartesian tree of the hashes; only those as long as a
passage are kept, about 2 n / t of n shingles for passages of t. Two texts that
share a passage have, for most hash functions, a window each with one least
value around it.

One value alone is often shared by chance, as when its shingle stands in a
frequent line. But of the places left and right of it, t // 2 on one side lie
in the passage, so a window is keyed by its value and another hash function's
least value on the left, and again on the right: windows meet that agree under
two hash functions.

Windows with one key are linked to the smallest document that has it and to the
next smaller one, never to each other, so links are linear in windows. A pair's
links on nearby diagonals are joined to an interval; its shingles are then
compared place by place. The widest intervals of a document go first, and
others only where the passages found leave much of them.

The keys of intervals that turned out no passages are looked at once more, with
all their windows: if few documents share a key, each with every one before it,
else under keys that further minima of the same side split.

What is still open then under keys of more documents is compared with all
documents before it, exactly: windows with the same shingles are one class,
whose smallest document stands for it. An open window is compared with those
classes whose document holds one of the shingles that a passage around its
place can't do without: the rarest, such that with all others in common every
run of t shingles around the place still lacks too many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import scan

from .common import id_and_text, if_small, tidy, written
from .shingles import mix, powers, row_shingles, word_hashes
from .tokenizing import gathered, text_slices

#: Hash functions whose windows are keyed.
HASHES = 3
#: How far apart, in words, the diagonals of one passage's links may be.
DRIFT = 16
#: Documents up to which a key is linked pair by pair in the second look, and minima that split it there.
GROUP, FURTHER = 32, 4
#: Bytes of text hashed at a time, and windows that a task holds before it hands them on.
HASHED_BYTES, HELD_WINDOWS = 2 << 20, 400_000
#: Windows of one key in what a task holds from which it links them itself.
CROWD = 16
NO_CROWD = 1 << 62
#: kind says which hash function and which side a key is of (the side in its last bit) and whether the row seeks a source.
OPEN = 1 << 10
#: place packs a window: its least place, how far it begins before it and how far it ends after it.
#: Rows are dealt by `deal`, which is a window's key, and any number for a link, whose key stands apart.
WINDOW = "deal long, doc_id long, place long, kind int, source long, source_place long, key long"
PASSAGE = "doc_id long, start long, end long, source_doc_id long, source_start long, source_end long, similarity double"
CANDIDATE = "doc_id long, source long, a_begin long, a_end long, c_begin long, c_end long, diagonal long, first boolean, at long, key long"
_REACH = 18
_FAR = (1 << _REACH) - 1


def _names(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


def _extents(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """begin and end of every place's Cartesian subtree within its stretch bounds[i] .. bounds[i + 1].

    Each place looks for the next one that is less (or before it, not more); what
    stands there already looks further on, so its own next is where to go from it.
    """
    found = []
    for values, edges, equal in ((h, bounds, True), (h[::-1], len(h) - bounds[::-1], False)):
        place = np.arange(len(h))
        edge = np.repeat(edges[:-1], np.diff(edges)) - 1
        before = place - 1
        going = place
        while True:
            there = before[going]
            going, there = (x[there > edge[going]] for x in (going, there))
            past = values[there] > values[going] if equal else values[there] >= values[going]
            going, there = going[past], there[past]
            if not len(going):
                break
            before[going] = np.maximum(before[there], edge[going])
        found.append(before)
    return found[0] + 1, len(h) - 1 - found[1][::-1]


def compact_windows(h: np.ndarray, t: int, bounds: np.ndarray | None = None) -> np.ndarray:
    """(begin, at, end) of every Cartesian subtree of at least t hashes, the leftmost of equal hashes least.

    bounds: where the texts in h begin, and the last's end; each has a tree of
    its own. A place roots such a subtree just if it is the least of some t
    hashes in a row, and the ends of its subtree are its text's or other such
    places; so those are found first, and the tree is built over them alone.
    """
    bounds = np.array([0, len(h)]) if bounds is None else bounds
    count = np.maximum(np.diff(bounds) - t + 1, 0)  # of runs of t hashes
    runs = gathered(bounds[:-1], count)
    if not len(runs):
        return np.empty((0, 3), np.int64)
    # The least of every t hashes in a row, from the least of whole blocks of t up to and back from a place.
    padded = np.append(h, np.full(-len(h) % t, np.iinfo(h.dtype).max, h.dtype)).reshape(-1, t)
    upto = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[runs], upto[runs + t - 1])
    # Where that changes, or the least one before is left behind, its place is looked for.
    moved = np.ones(len(runs), bool)
    moved[1:] = (runs[1:] != runs[:-1] + 1) | (least[1:] != least[:-1]) | (h[runs[:-1]] == least[:-1])
    first = runs[moved]
    at = np.unique(first + (h[first[:, None] + np.arange(t)] == least[moved][:, None]).argmax(axis=1))
    nodes = np.searchsorted(at, bounds)
    begin, end = _extents(h[at], nodes)
    text = np.searchsorted(bounds, at, "right") - 1
    begin = np.where(begin > nodes[text], at[begin - 1] + 1, bounds[text])
    end = np.where(end < nodes[text + 1], at[np.minimum(end, len(at) - 1)], bounds[text + 1])
    return np.stack([begin, at, end], axis=1)


def pack_place(begin: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A window as one integer; what lies further from its place than 2 ** 18 is left to the windows there."""
    return at << 2 * _REACH | np.minimum(at - begin, _FAR) << _REACH | np.minimum(end - at, _FAR)


def open_place(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, at, end)."""
    at = place >> 2 * _REACH
    return at - (place >> _REACH & _FAR), at, at + (place & _FAR)


def _salted(s: np.ndarray, which: int) -> np.ndarray:
    return mix(s + mix(np.array([501 + which], np.uint64)))


def _side_minimum(h: np.ndarray, at: np.ndarray, side: int, half: int) -> np.ndarray:
    """The least of the `half` hashes before (side 0) or after (side 1) each place."""
    step = np.arange(1, half + 1)
    return h[at[:, None] + (step if side else -step)].min(axis=1)


def _keyed(value: np.ndarray, beside: np.ndarray, kind: int) -> np.ndarray:
    return mix(value * np.uint64(3) + mix(beside + np.uint64(kind + 1)))


def _keys(flat: np.ndarray, bounds: np.ndarray, t: int, hashes: int) -> Iterator[tuple]:
    """(kind, row, begin, at, end, key) of the windows of a slice of texts, places within their text."""
    half = t // 2
    salted = [_salted(flat, j) for j in range(hashes + 1)]
    for j in range(hashes):
        begin, at, end = compact_windows(salted[j], t, bounds).T
        row = np.searchsorted(bounds, at, "right") - 1
        for side in (0, 1):
            fits = at - half >= begin if side == 0 else at + half < end
            b, p, e, r = begin[fits], at[fits], end[fits], row[fits]
            key = _keyed(salted[j][p], _side_minimum(salted[j + 1], p, side, half), 2 * j + side)
            base = bounds[r]
            yield 2 * j + side, r, b - base, p - base, e - base, key.view(np.int64)


def _rows(columns: list[np.ndarray], fields: str, absent: tuple[str, ...] = ()) -> pa.RecordBatch:
    """A batch of whole numbers; where a column named in `absent` is negative it is null."""
    names, out = _names(fields), []
    for field, column in zip(fields.split(", "), columns, strict=True):
        name, kind = field.split()
        out.append(pa.array(column, {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[kind], mask=column == -(1 << 63) if name in absent else None))
    return pa.RecordBatch.from_arrays(out, names)


_NONE = -(1 << 63)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal numbers begin, and the run of each."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _linked(key: np.ndarray, doc: np.ndarray, place: np.ndarray, kind: np.ndarray, group: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, c) in rows in the order of (key, doc, place): a is linked to c, of a smaller document.

    c is the first and the last place of the key's smallest document and of the
    next smaller one; where a key has at most `group` documents, of all before.
    Only rows marked `open` are linked.
    """
    starts, run = _runs(key)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)  # of each document under each key
    last = np.append(first[1:], len(key)) - 1
    which = np.cumsum(new) - 1
    head = which[starts][run]
    docs = np.bincount(run[first], minlength=len(starts))[run]
    later = np.flatnonzero((which > head) & (kind & OPEN > 0))
    pairs = [(later, head[later])]
    for lag in range(1, max(group, 2)):
        some = later[(which[later] - lag > head[later]) & ((lag == 1) | (docs[later] <= group))]
        if not len(some):
            break
        pairs.append((some, which[some] - lag))
    a, c = (np.concatenate(x) for x in zip(*pairs, strict=True))
    twice = last[c] > first[c]
    return np.concatenate([a, a[twice]]), np.concatenate([first[c], last[c[twice]]])


def _crowds(held: list[tuple], crowd: int, group: int = 0) -> pa.RecordBatch:
    """Rows of what a task holds. Of a key that is crowded here only the smallest and the largest document go on; the others are linked here, as all are later."""
    key, doc, place, kind = map(np.concatenate, zip(*held, strict=True))
    if not len(key):
        return _rows([key, doc, place, kind, key, key, key], WINDOW)
    order = np.lexsort((place, doc, key))
    key, doc, place, kind = key[order], doc[order], place[order], kind[order]
    starts, run = _runs(key)
    crowded = (np.diff(np.append(starts, len(key))) > crowd)[run]
    on = ~crowded | (doc == doc[starts][run]) | (doc == doc[np.append(starts[1:], len(key)) - 1][run])
    here = np.flatnonzero(crowded)
    a, c = (here[x] for x in _linked(key[here], doc[here], place[here], kind[here], group))
    none = np.full(len(key), _NONE)
    columns = [(key, key), (doc, doc), (place, place), (kind, kind), (none, doc), (none, place)]
    parts = [np.concatenate([x[on], y[c] if i > 3 else y[a]]) for i, (x, y) in enumerate(columns)]
    # A link needs no other rows of its key, so it is dealt by its documents; its kind holds no more than that it is open.
    deal = parts[0].copy()
    deal[on.sum() :] = mix((doc[a] * 31 + doc[c] + place[a]).view(np.uint64)).view(np.int64)
    key = np.concatenate([none[on], key[a]])
    return _rows([deal, *parts[1:], key], WINDOW, ("source", "source_place", "key"))


def windows(docs: DataFrame, k: int, t: int, hashes: int = HASHES, crowd: int = CROWD, maybe=None) -> DataFrame:
    """WINDOW rows of every document; those with a source are links.

    maybe: a broadcast bit per slot of keys, to leave out keys that are surely not asked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for part in text_slices(batch, 1, HASHED_BYTES):
                flat, bounds = row_shingles(part.column(1), k)
                doc = part.column(0).to_numpy(zero_copy_only=False)
                for kind, row, begin, at, end, key in _keys(flat, bounds, t, hashes):
                    some = slice(None) if maybe is None else maybe.value[_slot(key)]
                    held.append(tuple(x[some] for x in (key, doc[row], pack_place(begin, at, end), np.full(len(key), kind | OPEN))))
                if sum(len(h[0]) for h in held) >= HELD_WINDOWS:
                    yield _crowds(held, crowd)
                    held = []
        if held:
            yield _crowds(held, crowd)

    rows = id_and_text(docs).filter("doc_id IS NOT NULL").select("doc_id", F.col("text").cast("binary"))
    return rows.mapInArrow(tidy(run), WINDOW)


def _split(docs: DataFrame, members: DataFrame, k: int, t: int, further: int, group: int) -> DataFrame:
    """The WINDOW rows of members(key, doc_id, place, kind), again under keys of as many further minima, each alone and all together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for part in text_slices(batch, 1, HASHED_BYTES):
                flat, bounds = row_shingles(part.column(1), k)
                found = part.column(2)
                count = np.diff(found.offsets.to_numpy())
                key, place, kind = (found.flatten().field(i).to_numpy() for i in range(3))
                doc, base = np.repeat(part.column(0).to_numpy(), count), np.repeat(bounds[:-1], count)
                rows = doc, place, kind
                held.append((key, *rows))
                salted = [_salted(flat, 100 + i) for i in range(further)]
                for side in (0, 1):
                    some = np.flatnonzero(kind & 1 == side)
                    old = key[some].view(np.uint64)
                    every, mine, at = old, [x[some] for x in rows], open_place(place[some])[1] + base[some]
                    for i in range(further):
                        beside = _side_minimum(salted[i], at, side, t // 2)
                        every = _keyed(every, beside, 50)
                        held.append((_keyed(old, beside, 60 + i).view(np.int64), *mine))
                    held.append((every.view(np.int64), *mine))
                if sum(len(h[0]) for h in held) >= HELD_WINDOWS:
                    yield _crowds(held, max(CROWD, group), group)
                    held = []
        if held:
            yield _crowds(held, max(CROWD, group), group)

    grouped = members.groupBy("doc_id").agg(F.collect_list(F.struct("key", "place", "kind")).alias("found"))  # at most the document's windows
    rows = _only(docs, members).join(grouped, "doc_id").select("doc_id", F.col("text").cast("binary"), "found")
    return rows.mapInArrow(tidy(run), WINDOW)


CLASSED = "key long, doc_id long, place long, kind int, content long"


def _fewest(flat: np.ndarray, bounds: np.ndarray, t: int) -> np.ndarray:
    """The number of different shingles in every run of t from each place on, within its text (beyond its last run: of what follows)."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((flat, text))  # stable: equal shingles of a text stay in order
    same = np.flatnonzero((flat[order][1:] == flat[order][:-1]) & (text[order][1:] == text[order][:-1]))
    before = bounds[text] - 1
    before[order[same + 1]] = order[same]
    # A place is its shingle's first in the runs that begin after the one before it.
    place = np.arange(len(flat))
    steps = np.bincount(np.maximum(before + 1, place - t + 1), minlength=len(flat) + 1) - np.bincount(place + 1, minlength=len(flat) + 1)
    return np.cumsum(steps)[: len(flat)]


def _stretches(place: np.ndarray, base: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, at, end) of windows with the margin that is compared with them, within a slice of texts; base, top: where their text begins and ends there."""
    begin, at, end = open_place(place)
    return base + np.maximum(0, begin - DRIFT), base + at, np.minimum(top, base + end + DRIFT)


def _found(docs: DataFrame, members: DataFrame) -> DataFrame:
    """doc_id, text, found: the members(key, doc_id, place, kind) of a document, at most its windows."""
    grouped = members.groupBy("doc_id").agg(F.collect_list(F.struct("key", "place", "kind")).alias("found"))
    return _only(docs, members).join(grouped, "doc_id").select("doc_id", F.col("text").cast("binary"), "found")


def _unpacked(part: pa.RecordBatch, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, key, place, kind, begin, at, end) of the windows in a slice of _found."""
    count = np.diff(part.column(2).offsets.to_numpy())
    row = np.repeat(np.arange(len(count)), count)
    key, place, kind = (part.column(2).flatten().field(i).to_numpy() for i in range(3))
    return row, key, place, kind, *_stretches(place, bounds[row], bounds[row + 1])


def _classed(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """CLASSED rows of members(key, doc_id, place, kind); content tells what the window and the margin that is compared with it hold."""
    base = pow(0x9E3779B97F4A7C15, 3, 1 << 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1, HASHED_BYTES):
                flat, bounds = row_shingles(part.column(1), k)
                row, key, place, kind, begin, at, end = _unpacked(part, bounds)
                # A polynomial of a stretch from those of all that begins where the slice does.
                upto = np.zeros(len(flat) + 1, np.uint64)
                np.cumsum(flat * powers(base, len(flat)), out=upto[1:])
                content = mix((upto[end] - upto[begin]) * powers(pow(base, -1, 1 << 64), len(flat) + 1)[begin])
                content = mix(content + mix(((end - begin) << 32 | at - begin).view(np.uint64))).view(np.int64)
                yield _rows([key, part.column(0).to_numpy()[row], place, kind, content], CLASSED)

    return _found(docs, members).mapInArrow(tidy(run), CLASSED)


def _seekers_needs(own: np.ndarray, n: np.ndarray, low: int, high: int, least: int, t: int, percent: int) -> np.ndarray:
    """Shingles, the rarest by `n`, of which a source has one at least if it shares a passage that holds the places low .. high - 1.

    own: the shingles of a window and its margin, n: how many documents hold
    each, least: how many different ones such a passage has in common. Who holds
    none of these shares too few at all; or, counting all others as shared,
    every run of t places or more around low .. high - 1 still lacks more than
    a passage may (of shingles that the window holds once).
    """
    different, first, inverse, count = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(n[first], kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ranks = np.where(count[inverse] == 1, rank[inverse], len(order))
    begin = np.arange(min(low, len(own) - t) + 1)
    ends = np.maximum(high, begin + t)
    upto = np.zeros(len(own) + 1, np.int64)

    def lacks(m: int) -> bool:
        np.cumsum((100 - percent) - 100 * (ranks < m), out=upto[1:])
        best = np.maximum.accumulate(upto[::-1])[::-1]
        return bool((best[ends] < upto[begin]).all())

    few, many = 0, max(0, len(order) - least + 1)
    if lacks(many):
        while few < many:  # the fewest that do
            middle = (few + many) // 2
            few, many = (few, middle) if lacks(middle) else (middle + 1, many)
    return different[order[:many]]


NEED = "key long, doc_id long, place long, tag long"


def _needs(docs: DataFrame, seekers: DataFrame, known: DataFrame, k: int, t: int, percent: int) -> DataFrame:
    """NEED rows of seekers(key, doc_id, place, kind): tags that a source has one of. known: doc_id, known: an array of (tag, n), in how many documents each is."""
    half = t // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1, HASHED_BYTES):
                flat, bounds = row_shingles(part.column(1), k)
                row, key, place, kind, begin, at, end = _unpacked(part, bounds)
                fewest = _fewest(flat, bounds, t)
                of = part.column(3).offsets.to_numpy()
                tags, ns = (part.column(3).flatten().field(i).to_numpy() for i in range(2))
                of = of - of[0]
                rows, needed = [], []
                for i, (r, b, p, e) in enumerate(zip(row.tolist(), begin.tolist(), at.tolist(), end.tolist(), strict=True)):
                    low, high = (p, p + half + 1) if kind[i] & 1 else (p - half, p + 1)
                    first, last = max(b, high - t), min(low, e - t)  # where runs of t that hold these places begin
                    if first > last:
                        continue
                    own, mine = flat[b:e], slice(of[r], of[r + 1])
                    spot = np.searchsorted(tags[mine], own.view(np.int64))
                    least = -(-percent * int(fewest[first : last + 1].min()) // 100)
                    needs = _seekers_needs(own, ns[mine][spot], low - b, high - b, least, t, percent).view(np.int64)
                    needs = needs[ns[mine][np.searchsorted(tags[mine], needs)] > 1]  # one is the document itself
                    rows.append(np.full(len(needs), i))
                    needed.append(needs)
                of_row = np.concatenate([np.empty(0, np.int64), *rows])
                yield _rows([key[of_row], part.column(0).to_numpy()[row[of_row]], place[of_row], np.concatenate([np.empty(0, np.int64), *needed])], NEED)

    return _found(docs, seekers).join(known, "doc_id").select("doc_id", "text", "found", "known").mapInArrow(tidy(run), NEED)


def _tags(docs: DataFrame, windows_: DataFrame, k: int, maybe=None) -> DataFrame:
    """doc_id, tag: the different shingles in windows_(key, doc_id, place, kind) and their margins; maybe: as in `windows`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1, HASHED_BYTES):
                flat, bounds = row_shingles(part.column(1), k)
                row, _, _, _, begin, _, end = _unpacked(part, bounds)
                inside = np.cumsum(np.bincount(begin, minlength=len(flat) + 1) - np.bincount(end, minlength=len(flat) + 1))[:-1] > 0
                text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                tag = flat.view(np.int64)
                some = np.flatnonzero(inside if maybe is None else inside & maybe.value[_slot(tag)])
                some = some[np.lexsort((tag[some], text[some]))]
                new = np.ones(len(some), bool)
                new[1:] = (tag[some][1:] != tag[some][:-1]) | (text[some][1:] != text[some][:-1])
                some = some[new]
                yield _rows([part.column(0).to_numpy()[text[some]], tag[some]], "doc_id long, tag long")

    return _found(docs, windows_).mapInArrow(tidy(run), "doc_id long, tag long")


#: Documents of one shingle, about, that stand in one row.
POSTED = 1024
#: A window and those of smaller documents that it may share a passage with, each (source, source_place), one after the other.
LINKED = "doc_id long, block long, place long, links array<long>"
#: The intervals of a document and a block of sources, the widest first, each (source, a_begin, a_end, c_begin, c_end, diagonal, first, last): the places of its first and last link.
PAIRED = "doc_id long, block long, pairs array<long>"
#: How many intervals of a document may cover a place in each round of the exact look; in the last, all that are left.
ROUNDS = (1, 8, NO_CROWD)


def _exact(docs: DataFrame, members: DataFrame, k: int, t: int, percent: int) -> DataFrame:
    """PAIRED rows of every open member and all classes under its key that have a smaller document and may share a passage around the key's place.

    A class has the same shingles around the key's place. Its smallest document
    stands for it as a source, and its other documents are linked to that one
    alone, in which they have a passage. An open member asks for the documents
    that hold one of the shingles without which it has no passage there
    (_seekers_needs), which are as rare as can be: lines that many share are
    not asked for. Who holds a shingle, or has a window under a key, stands in
    rows of some POSTED documents each, dealt by blocks of documents, so rows
    are as many as the members and what they ask for, not as the pairs.
    """
    spark = docs.sparkSession
    classed = written(_classed(docs, members, k), "classed")
    classes = classed.groupBy("key", "content").agg(F.min(F.struct("doc_id", "place")).alias("head"))
    light = written(classed.join(classes, ["key", "content"]).select("key", "doc_id", "place", "kind", "head"), "classes")
    same = light.filter((F.col("kind") >= OPEN) & (F.col("doc_id") > F.col("head.doc_id"))).select("key", "doc_id", "place", F.array("head").alias("heads"))
    first = light.filter((F.col("doc_id") == F.col("head.doc_id")) & (F.col("kind") >= OPEN)).select("key", "doc_id", "place", "kind")
    heads = light.filter((F.col("doc_id") == F.col("head.doc_id")) & (F.col("place") == F.col("head.place"))).select("key", "doc_id", "place", "kind")
    asked = spark.sparkContext.broadcast(_filter(_tags(docs, first, k).select(F.col("tag").alias("key"))))
    held = written(_tags(docs, heads.unionByName(first), k, asked), "tags")
    seeking = held.join(first.select("doc_id").distinct(), "doc_id", "left_semi")
    known = seeking.join(held.groupBy("tag").agg(F.count(F.lit(1)).alias("n")), "tag").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("tag", "n"))).alias("known"))  # at most a document's shingles
    needs = written(_needs(docs, first, known, k, t, percent), "needs")
    wanted = held.join(needs.groupBy("tag").agg(F.max("doc_id").alias("last")), "tag").filter("doc_id < last")
    most = wanted.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(1 + most // POSTED))
    posted = wanted.groupBy("tag", block("doc_id").alias("block")).agg(F.collect_list("doc_id").alias("sources"))
    smaller = F.filter("sources", lambda source: source < F.col("doc_id"))
    met = needs.join(posted, "tag").withColumn("sources", smaller).filter(F.size("sources") > 0).groupBy("key", "doc_id", "place", "block").agg(F.array_distinct(F.flatten(F.collect_list("sources"))).alias("sources"))
    under = heads.groupBy("key", block("doc_id").alias("block")).agg(F.collect_list(F.struct("doc_id", "place")).alias("heads"))
    both = met.join(under, ["key", "block"]).select("doc_id", "place", "block", "sources", "heads")
    own = same.select("doc_id", "place", block(F.col("heads")[0]["doc_id"]).alias("block"), F.transform("heads", lambda h: h["doc_id"]).alias("sources"), "heads")
    return _chained(_member_links(both, t).unionByName(_member_links(own, t)), t)


def _member_links(pairs: DataFrame, t: int) -> DataFrame:
    """LINKED rows of pairs(doc_id, place, block, sources, heads): with those heads, windows of smaller documents, whose document is one of the sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, place, block = (batch.column(i).to_numpy() for i in range(3))
            asked, asked_at = batch.column(3).values.to_numpy(), batch.column(3).offsets.to_pylist()
            at = batch.column(4).offsets.to_pylist()
            head_doc, head_place = (batch.column(4).values.field(i).to_numpy() for i in range(2))
            rows, links = [], [np.empty(0, np.int64)]
            for i in range(batch.num_rows):
                of, there = head_doc[at[i] : at[i + 1]], head_place[at[i] : at[i + 1]]
                some = (of < doc[i]) & np.isin(of, asked[asked_at[i] : asked_at[i + 1]])
                _, begin, end, _ = _room(place[i], there)
                some &= end - begin >= t - t // 4
                if some.any():
                    rows.append(i)
                    links.append(np.stack([of[some], there[some]], axis=1).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([len(x) for x in links]), pa.int32()), pa.array(np.concatenate(links)))
            yield pa.RecordBatch.from_arrays([*(pa.array(x[np.array(rows, np.int64)].astype(np.int64)) for x in (doc, block, place)), lists], _names(LINKED))

    return pairs.mapInArrow(tidy(run), LINKED)


def _chained(linked: DataFrame, t: int) -> DataFrame:
    """PAIRED rows of LINKED rows. Links of a document and one block of sources come to one task."""

    def of(group: tuple[int, int], held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        source, source_place = np.concatenate([x for _, x in held]).reshape(-1, 2).T
        place = np.repeat([p for p, _ in held], [len(x) // 2 for _, x in held])
        rows = [c.to_numpy() for c in _joined(np.full(len(place), group[0]), place, source, source_place, np.full(len(place), _NONE), t).select(_names(LINK)[:-1]).columns]
        order = np.lexsort((rows[-1], rows[1], rows[0]))
        _, *told = _covered(*(x[order] for x in rows))
        pairs = np.stack([told[0], *_margins(*told[1:5]), *told[5:]], axis=1)
        pairs = pairs[np.lexsort((pairs[:, 0], pairs[:, 1] - pairs[:, 2]))].ravel()
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in group), pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(pairs))], _names(PAIRED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            values, at = batch.column(3).values.to_numpy(), batch.column(3).offsets.to_pylist()
            for i, (doc, block, place) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if held and (doc, block) != group:
                    yield of(group, held)
                    held = []
                group = doc, block
                held.append((place, values[at[i] : at[i + 1]]))
        if held:
            yield of(group, held)

    return linked.repartition("doc_id", "block").sortWithinPartitions("doc_id", "block").mapInArrow(tidy(run), PAIRED)


def _picked(rows: np.ndarray, found: list[tuple[int, int]], deep: int, least: int) -> np.ndarray:
    """Which intervals of PAIRED are to be compared: in some place between their first and last link's, and in `least` places in a row (or all they have), the passages found don't hold them; and fewer than `deep` of those picked before hold some such place."""
    if not len(rows):
        return np.empty(0, np.int64)
    # Without the margin that was added to them.
    low = np.where(rows[:, 1] > 0, rows[:, 1] + 2 * DRIFT, 0)
    high, first, last = np.maximum(rows[:, 2] - 2 * DRIFT, low), rows[:, 6], rows[:, 7] + 1
    over = np.zeros(int(max(high.max(), last.max())) + 1, np.int64)
    for b, e in found:
        over[b:e] = NO_CROWD
    place = np.arange(len(over))
    run = place - np.maximum.accumulate(np.where(over, place, -1))  # of free places up to each
    free, wide = (np.concatenate([[0], np.cumsum(x)]) for x in (over == 0, run >= least))
    room = np.where(high - low < least, free[high] - free[low] == high - low, wide[high] > wide[np.minimum(low + least - 1, high)])
    some = np.flatnonzero(room & (free[last] > free[first]))
    if deep == NO_CROWD:
        return some
    picked = []
    for i, b, e, f, g in zip(*(x.tolist() for x in (some, low[some], high[some], first[some], last[some])), strict=True):
        if over[f:g].min() < deep:
            picked.append(i)
            over[min(b, f) : max(e, g)] += 1
    return np.array(picked, np.int64)


def _round(pairs: DataFrame, tried: DataFrame, found: DataFrame, k: int, t: int, deep: int) -> DataFrame:
    """CANDIDATE rows of those in PAIRED rows (with their `turn` among the document's) that weren't tried and that the passages found leave open; for each place about the `deep` widest. `first` means nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.empty((0, 7), np.int64)]
            values, at = batch.column(1).values.to_numpy(), batch.column(1).offsets.to_pylist()
            for i, (doc, before, spans) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True)):
                rows = values[at[i] : at[i + 1]].reshape(-1, 8)
                if before:
                    before = {(x["source"], x["diagonal"]) for x in before}
                    rows = rows[[x not in before for x in zip(rows[:, 0].tolist(), rows[:, 5].tolist(), strict=True)]]
                rows = rows[_picked(rows, [(x["begin"], x["end"]) for x in spans or ()], deep, t // 2)]
                out.append(np.column_stack([np.full(len(rows), doc), rows[:, :6]]))
            doc, source, a_begin, a_end, c_begin, c_end, diagonal = np.concatenate(out).T
            none = np.full(len(doc), _NONE)
            yield _rows([doc, source, a_begin, a_end, c_begin, c_end, diagonal, np.ones(len(doc), bool), none, none], CANDIDATE, ("at", "key"))

    turn = pairs.filter(F.col("turn") <= deep)
    before = tried.join(turn.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_set(F.struct("source", "diagonal")).alias("before"))  # at most a document's intervals
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct(F.col("start").alias("begin"), (F.col("end") - k + 1).alias("end"))).alias("spans"))
    return turn.join(before, "doc_id", "left").join(spans, "doc_id", "left").select("doc_id", "pairs", "before", "spans").mapInArrow(tidy(run), CANDIDATE)


#: Slots of the filter of open keys: its size on every executor is fixed, whatever the data; what it lets through is joined exactly.
SLOT_BITS = 25


def _slot(key: np.ndarray) -> np.ndarray:
    return key & ((1 << SLOT_BITS) - 1)


def _filter(keys: DataFrame) -> np.ndarray:
    """A bit per slot that some key falls into: at most 2 ** SLOT_BITS bits come to the driver, as packed bytes."""
    slot = F.col("key").bitwiseAND((1 << SLOT_BITS) - 1)
    packed = keys.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros((1 << SLOT_BITS) + 32768, bool)
    for r in packed.toLocalIterator():
        # Spark numbers buckets from 1, and slot 0 is the last place of bucket 0's.
        bits = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little")
        first = 32768 * (r.bucket - 1) + 1 if r.bucket else 0
        out[first : first + len(bits)] |= bits.astype(bool)[: len(out) - first]
    return out[: 1 << SLOT_BITS]


LINK = "doc_id long, source long, at long, begin long, end long, diagonal long, key long"


def links(rows: DataFrame, t: int, group: int = 0) -> DataFrame:
    """LINK rows of WINDOW rows: windows of one key, and those that were linked before.

    Rows come sorted, so a task holds one batch and a few rows of the key that goes on in the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            deal, doc, place, kind, source, source_place, key = (c.cast(pa.int64()).fill_null(_NONE).to_numpy(zero_copy_only=False) for c in batch.columns)
            done = source != _NONE
            key = np.where(done, key, deal)
            a_doc, a_place, c_doc, c_place, a_key = [doc[done]], [place[done]], [source[done]], [source_place[done]], [key[done]]
            columns = [x[~done] for x in (key, doc, place, kind)]
            carried = 0
            if carry is not None:
                carried = len(carry[0])
                columns = [np.concatenate(x) for x in zip(carry, columns, strict=True)]
            key, doc, place, kind = columns
            if len(key):
                a, c = _linked(key, doc, place, kind, group)
                fresh = a >= carried
                a, c = a[fresh], c[fresh]
                a_doc.append(doc[a])
                a_place.append(place[a])
                c_doc.append(doc[c])
                c_place.append(place[c])
                # Two documents under one key are compared by this; a key that goes on in another batch may have more.
                starts, run = _runs(key)
                docs = np.bincount(run, np.append(True, (doc[1:] != doc[:-1]) | (run[1:] != run[:-1])))
                docs[[0, -1]] = 3
                a_key.append(np.where(docs[run[a]] > 2, key[a], _NONE))
                carry = [x[_kept(key, doc, group)] for x in columns]
            yield _joined(*map(np.concatenate, (a_doc, a_place, c_doc, c_place, a_key)), t)

    return rows.repartition("deal").sortWithinPartitions("deal", "doc_id", "place").mapInArrow(tidy(run), LINK)


def _kept(key: np.ndarray, doc: np.ndarray, group: int) -> np.ndarray:
    """Of the last key's rows, those that later rows of it may be linked to: the first and last of its first and its latest documents."""
    begin = int(np.searchsorted(key, key[-1]))
    first = begin + np.flatnonzero(np.append(True, doc[begin + 1 :] != doc[begin:-1]))
    last = np.append(first[1:], len(key)) - 1
    runs = np.unique(np.append(0, np.arange(max(0, len(first) - max(group, 2)), len(first))))
    return np.unique(np.concatenate([first[runs], last[runs]]))


def _room(place: np.ndarray, source_place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(at, begin, end, diagonal): what pairs of windows have in common, in the first's places."""
    begin, at, end = open_place(place)
    c_begin, c_at, c_end = open_place(source_place)
    diagonal = at - c_at
    return at, np.maximum(begin, c_begin + diagonal), np.minimum(end, c_end + diagonal), diagonal


def _joined(doc: np.ndarray, place: np.ndarray, source: np.ndarray, source_place: np.ndarray, key: np.ndarray, t: int) -> pa.RecordBatch:
    """LINK rows of pairs of windows that have room for a passage in common."""
    at, begin, end, diagonal = _room(place, source_place)
    c_at = at - diagonal
    wide = (end - begin >= t - t // 4) & (source != doc)
    swap = source > doc  # one that a task linked of its own may be the other way round
    doc, source = np.where(swap, source, doc), np.where(swap, doc, source)
    at, begin, end, diagonal = np.where(swap, c_at, at), np.where(swap, begin - diagonal, begin), np.where(swap, end - diagonal, end), np.where(swap, -diagonal, diagonal)
    return _rows([x[wide] for x in (doc, source, at, begin, end, diagonal, key)], LINK)


def candidates(found: DataFrame) -> DataFrame:
    """CANDIDATE rows: intervals that a pair's links on nearby diagonals cover; `first` marks those of a document that hold the rest.

    Rows without a source are no intervals but the places and keys of a document's links under keys with more than two documents.

    The links of one document come to one task: at most a few for each of its windows.
    """
    names = _names(LINK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * len(names)
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
            last = np.flatnonzero(held[0][1:] != held[0][:-1])
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield _intervals(*(h[:cut] for h in held))
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield _intervals(*held)

    return found.repartition("doc_id").sortWithinPartitions("doc_id", "source", "diagonal").mapInArrow(tidy(run), CANDIDATE)


def _covered(doc, source, at, begin, end, diagonal) -> tuple[np.ndarray, ...]:
    """(doc, source, begin, end, low, high, middle, first, last) of the intervals that links cover: least, greatest and middle diagonal, places of the first and last link. Rows are in the order of (doc, source, diagonal)."""
    if not len(doc):
        return (doc,) * 9
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (source[1:] != source[:-1]) | (diagonal[1:] - diagonal[:-1] > DRIFT)
    starts = np.flatnonzero(new)
    # A chain of diagonals that drifts on is cut where it has drifted too far from where it began.
    part = (diagonal - diagonal[starts][np.cumsum(new) - 1]) // (2 * DRIFT)
    new[1:] |= part[1:] != part[:-1]
    order = np.lexsort((begin, np.cumsum(new)))  # along the text within a diagonal
    doc, source, at, begin, end, diagonal = (x[order] for x in (doc, source, at, begin, end, diagonal))
    run = np.cumsum(new) - 1
    size = int(end.max()) + 2 * DRIFT + 1
    reach = np.maximum.accumulate(end + run * size) - run * size  # of the run so far
    new[1:] |= begin[1:] > reach[:-1]
    starts = np.flatnonzero(new)
    begin, end = begin[starts], np.maximum.reduceat(end, starts)
    doc, source = doc[starts], source[starts]
    low, high = np.minimum.reduceat(diagonal, starts), np.maximum.reduceat(diagonal, starts)
    return doc, source, begin, end, low, high, (low + high) // 2, np.minimum.reduceat(at, starts), np.maximum.reduceat(at, starts)


def _margins(begin, end, low, high) -> tuple[np.ndarray, ...]:
    """a_begin, a_end, c_begin, c_end of intervals: what is compared."""
    return np.maximum(0, begin - DRIFT), end + DRIFT, np.maximum(0, begin - high - 2 * DRIFT), end - low + 2 * DRIFT


def _intervals(doc, source, at, begin, end, diagonal, key) -> pa.RecordBatch:
    """Rows are in the order of (doc, source, diagonal)."""
    order = np.flatnonzero(key != _NONE)
    order = order[np.lexsort((key[order], doc[order]))]
    once = np.ones(len(order), bool)
    once[1:] = (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    once = order[once]
    places = doc[once], at[once], key[once]
    doc, source, begin, end, low, high, middle, _, _ = _covered(doc, source, at, begin, end, diagonal)
    # The widest interval of a document, and what reaches beyond it.
    order = np.lexsort((source, begin - end, doc))
    widest = np.zeros(len(doc), np.int64)
    heads, of = _runs(doc[order])
    widest[order] = order[heads][of]
    inside = (begin >= begin[widest] - DRIFT) & (end <= end[widest] + DRIFT) & (np.arange(len(doc)) != widest)
    columns = [doc, source, *_margins(begin, end, low, high), middle, ~inside]
    none, nothing = np.full(len(doc), _NONE), np.full(len(once), _NONE)
    columns = [np.concatenate(x) for x in zip([*columns, none, none], [places[0], *[nothing] * 6, np.zeros(len(once), bool), *places[1:]], strict=True)]
    return _rows(columns, CANDIDATE, ("source", "a_begin", "a_end", "c_begin", "c_end", "diagonal", "at", "key"))


def _only(docs: DataFrame, named: DataFrame) -> DataFrame:
    """doc_id, text of the documents that named(doc_id) names: other texts needn't be shuffled, if the names are few enough to be told to every task."""
    return id_and_text(docs).join(if_small(written(named.select("doc_id").distinct(), "ids")), "doc_id", "left_semi")


def _slices(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """doc_id, parts(begin, shingles): the shingle hashes, cut to 32 bits, of the parts of documents that wanted(doc_id, begin, end) touches, parts that meet made one.

    They are only compared within a pair of passages that 64-bit values have brought together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1, HASHED_BYTES):
                flat, bounds = row_shingles(part.column(1), k)
                cut = (flat >> np.uint64(32)).astype(np.uint32).view(np.int32)
                at, begins, pieces = [0], [], []
                for base, top, spans in zip(bounds[:-1].tolist(), bounds[1:].tolist(), part.column(2).to_pylist(), strict=True):
                    low = high = None
                    for s in [*sorted((s["begin"], s["end"]) for s in spans), (top, top)]:
                        if low is not None and s[0] > high:
                            begins.append(low)
                            pieces.append(cut[base + low : min(base + high, top)])
                            low = None
                        low, high = (s[0], s[1]) if low is None else (low, max(high, s[1]))
                    if low is not None and low < top - base:
                        begins.append(low)
                        pieces.append(cut[base + low : min(base + high, top)])
                    at.append(len(begins))
                parts = pa.StructArray.from_arrays([pa.array(begins, pa.int64()), pa.array(pieces, pa.list_(pa.int32()))], ["begin", "shingles"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), parts)], ["doc_id", "parts"])

    spans = wanted.groupBy("doc_id").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    rows = _only(docs, wanted).join(spans, "doc_id").select("doc_id", F.col("text").cast("binary"), "spans")
    return rows.mapInArrow(tidy(run), "doc_id long, parts array<struct<begin: long, shingles: array<int>>>")


#: Diagonals beside the expected one, nearest first.
_BESIDE = np.array([s * d for d in range(1, 2 * DRIFT + 1) for s in (-1, 1)])


def _nearest(a: np.ndarray, c: np.ndarray, expected: int) -> np.ndarray:
    """For each place i of a, the place of c nearest to i - expected that holds the same, at most 2 * DRIFT away; -1 if there is none."""
    straight = np.arange(-expected, len(a) - expected)
    where = np.full(len(a), -1)
    first, last = max(0, expected), max(0, expected, min(len(a), len(c) + expected))
    same = first + np.flatnonzero(a[first:last] == c[first - expected : last - expected])
    where[same] = same - expected
    rest = np.flatnonzero(where < 0)
    for first in range(0, len(rest), 1 << 14):
        i = rest[first : first + (1 << 14)]
        spots = straight[i][:, None] + _BESIDE
        equal = (c.take(spots, mode="clip") == a[i][:, None]) & (spots >= 0) & (spots < len(c))
        best = equal.argmax(axis=1)
        row = np.arange(len(i))
        where[i] = np.where(equal[row, best], spots[row, best], -1)
    return where


def shared_passages(a: np.ndarray, c: np.ndarray, expected: int, k: int, t: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """(begin, end, source begin, source end, similarity) of passages of a that stand in c, about `expected` places earlier.

    Places of a whose shingle stands in c near that diagonal are taken in
    runs; a run joins the passage before it while enough of the whole matches on
    both sides. A joined passage that isn't similar enough is parted again.
    A passage has at least t shingles and a similarity of percent.
    """
    share = 2 * percent / (100 + percent)  # of places that must match for this similarity
    where = _nearest(a, c, expected)
    hit = np.flatnonzero(where >= 0)
    if len(hit) < share * t:  # what is joined to t places or more has so many
        return []
    new = np.ones(len(hit), bool)
    new[1:] = hit[1:] - hit[:-1] > 1
    starts, there = np.flatnonzero(new), where[hit]
    ends = np.append(starts[1:], len(hit)) - 1
    runs = zip(hit[starts].tolist(), (hit[ends] + 1).tolist(), np.minimum.reduceat(there, starts).tolist(), (np.maximum.reduceat(there, starts) + 1).tolist(), strict=True)
    merged: list[list[tuple[int, int, int, int]]] = []
    size = low = high = 0
    for b, e, cb, ce in runs:
        wide = max(e - merged[-1][0][0], max(high, ce) - min(low, cb)) if merged else 0
        if merged and size + e - b >= share * wide:
            merged[-1].append((b, e, cb, ce))
            size, low, high = size + e - b, min(low, cb), max(high, ce)
        else:
            merged.append([(b, e, cb, ce)])
            size, low, high = e - b, cb, ce
    out = []
    while merged:
        joined = merged.pop()
        b, e, cb, ce = joined[0][0], joined[-1][1], min(r[2] for r in joined), max(r[3] for r in joined)
        if e - b < t:
            continue
        if e - b == ce - cb and np.array_equal(a[b:e], c[cb:ce]):
            out.append((b, e, cb, ce, 1.0))
            continue
        x, y = np.unique(a[b:e]), np.unique(c[cb:ce])
        common = len(np.intersect1d(x, y, assume_unique=True))
        union = len(x) + len(y) - common
        if 100 * common >= percent * union:
            out.append((b, e, cb, ce, common / union))
        elif len(joined) > 1:
            # What was joined across the widest gap, on either side, may hold by itself.
            gaps = [max(r[0] - q[1], abs(r[2] - q[3])) for q, r in zip(joined, joined[1:], strict=False)]
            at = int(np.argmax(gaps)) + 1
            merged += [joined[:at], joined[at:]]
    return sorted(out)


def _parts(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """doc_id, parts of what candidates touch of any document; at most the document itself."""
    a = wanted.select("doc_id", F.col("a_begin").alias("begin"), F.col("a_end").alias("end"))
    c = wanted.select(F.col("source").alias("doc_id"), F.col("c_begin").alias("begin"), F.col("c_end").alias("end"))
    return written(_slices(docs, a.unionByName(c), k), "slices")


def _verify(parts: DataFrame, wanted: DataFrame, k: int, t: int, percent: int, even: int = 0) -> DataFrame:
    """PASSAGE rows of the candidates that hold; parts: of their documents. even: tasks to which they are dealt, where few documents have most of them."""

    def of(parts: str, begin: str, end: str):
        """The shingles begin..end, from the part that holds them."""
        found = F.filter(parts, lambda p: (p["begin"] <= F.col(begin)) & (F.col(begin) < p["begin"] + F.size(p["shingles"])))
        return F.slice(found[0]["shingles"], (F.col(begin) - found[0]["begin"] + 1).cast("int"), (F.col(end) - F.col(begin)).cast("int"))

    def needed(side: str) -> DataFrame:
        """The parts of the documents on one side: others needn't be shuffled."""
        ids = if_small(written(wanted.select(F.col(side).alias("doc_id")).distinct(), "ids"))
        return parts.join(ids, "doc_id", "left_semi").withColumnRenamed("doc_id", side)

    # Only a candidate's own shingles go on to the next shuffle.
    left = wanted.join(needed("doc_id").withColumnRenamed("parts", "sa"), "doc_id").withColumn("sa", of("sa", "a_begin", "a_end"))
    both = left.join(needed("source").withColumnRenamed("parts", "sc"), "source").withColumn("sc", of("sc", "c_begin", "c_end"))
    names = _names(PASSAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            sides = []
            for name in ("sa", "sc"):
                column = batch.column(batch.schema.get_field_index(name)).fill_null([])
                at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
                sides.append([values[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
            for r, sa, sc in zip(batch.drop_columns(["sa", "sc"]).to_pylist(), *sides, strict=True):
                expected = r["diagonal"] + r["c_begin"] - r["a_begin"]
                for b, e, cb, ce, similarity in shared_passages(sa, sc, expected, k, t, percent):
                    rows.append((r["doc_id"], r["a_begin"] + b, r["a_begin"] + e + k - 1, r["source"], r["c_begin"] + cb, r["c_begin"] + ce + k - 1, similarity))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 6 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names)

    rows = both.select("doc_id", "source", "a_begin", "c_begin", "diagonal", "sa", "sc")
    return (rows.repartition(even) if even else rows).mapInArrow(tidy(run), PASSAGE)


def _uncovered(wanted: DataFrame, passages: DataFrame, k: int, t: int) -> DataFrame:
    """The candidates (but for the margin that was added to them) of which their document's passages leave t // 2 shingles in a row or more."""
    span = F.struct("start", (F.col("end") - k + 1).alias("end"))
    spans = passages.groupBy("doc_id").agg(F.sort_array(F.collect_set(span)).alias("spans"))
    low = F.when(F.col("a_begin") > 0, F.col("a_begin") + 2 * DRIFT).otherwise(F.lit(0).cast("long"))
    high = F.greatest(F.col("a_end") - 2 * DRIFT, low)
    nothing = F.struct(low.alias("reach"), F.lit(0).cast("long").alias("gap"))
    step = lambda acc, s: F.struct(F.greatest(acc["reach"], s["end"]).alias("reach"), F.greatest(acc["gap"], F.least(s["start"], high) - acc["reach"]).alias("gap"))
    left = F.aggregate("spans", nothing, step, lambda acc: F.greatest(acc["gap"], high - acc["reach"]))
    return wanted.join(spans, "doc_id", "left").filter(F.coalesce(left >= t // 2, F.lit(True))).drop("spans")


def repeated_passages(docs: DataFrame, k: int = 5, min_words: int = 50, percent: int = 80, hashes: int = HASHES, group: int = GROUP, further: int = FURTHER) -> DataFrame:
    """PASSAGE rows: words start..end of doc_id repeat words source_start..source_end of a document with a smaller doc_id.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased and
    numbered from 0. A passage has at least `min_words` words and its set of
    k-word shingles a similarity of `percent` with the source's; a document has
    one row for each place, with its smallest source among those compared.
    Passages repeated within one document are not reported, nor are rows
    without doc_id; a null or short text has no passages; rows that repeat a
    doc_id and its text count once, and where an id has several texts, each is
    looked at (its rows tell the id, not which text); other columns are left
    out; an empty table gives no rows.
    """
    t = min_words - k + 1
    docs, numbers = _texts(id_and_text(docs))
    docs, copies = _alone(docs, min_words)
    both = written(candidates(links(windows(docs, k, t, hashes), t)), "candidates")
    every, places = both.filter("source IS NOT NULL").drop("at", "key"), both.filter("source IS NULL").select("doc_id", "at", "key")
    parts = _parts(docs, every, k)
    found = written(_verify(parts, every.filter("first"), k, t, percent), "passages")
    others = written(_uncovered(every.filter("NOT first"), found, k, t), "candidates")
    if not others.isEmpty():
        found = written(found.unionByName(_verify(parts, others, k, t, percent)), "passages")
    failed = _uncovered(every, found, k, t)
    spans = written(_spans(failed, found, k), "spans")
    keys = written(_open_keys(places, spans), "keys")
    rows = keys.count()
    if rows:
        maybe = docs.sparkSession.sparkContext.broadcast(_filter(keys))
        members = windows(docs, k, t, hashes, NO_CROWD, maybe).select(F.col("deal").alias("key"), "doc_id", "place", "kind").join(if_small(keys, rows), "key", "left_semi")
        members = written(_opened(members, spans), "members")
        # Two documents under one key were compared at first.
        more_docs = members.groupBy("key", "doc_id").agg(F.max("kind").alias("kind")).groupBy("key").agg(F.count("*").alias("docs"), F.max("kind").alias("kind")).filter((F.col("docs") > 2) & (F.col("kind") >= OPEN))
        members = members.join(more_docs.select("key"), "key", "left_semi")
        tried = every.select("doc_id", "source", "diagonal")

        def look(again: DataFrame, even: int = 0) -> DataFrame:
            """The passages found, with those of the candidates."""
            nonlocal tried
            again = written(again, "candidates")
            tried = tried.unionByName(again.select(tried.columns))
            return found if again.isEmpty() else written(found.unionByName(_verify(_parts(docs, again, k), again, k, t, percent, even)), "passages")

        again = candidates(links(_split(docs, members, k, t, further, group), t, group)).filter("source IS NOT NULL").drop("at", "key")
        found = look(_uncovered(again, found, k, t).join(tried, ["doc_id", "source", "diagonal"], "left_anti"))
        left = written(_large(_opened(members, _spans(failed, found, k)), group), "members")
        if not left.isEmpty():
            turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("block")).alias("turn")
            pairs = written(_exact(docs, left, k, t, percent).select("*", turn), "pairs")
            for deep in ROUNDS:
                found = look(_round(pairs, tried, found, k, t, deep).drop("at", "key"), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = found.unionByName(copies)
    if numbers is not None:
        names, told = found.columns, numbers.select("number", F.col("doc_id").alias("id"))
        for c in ("doc_id", "source_doc_id"):
            found = found.withColumnRenamed(c, "number").join(told, "number").drop("number").withColumnRenamed("id", c)
        found = found.select(names).filter("doc_id <> source_doc_id")
    return found.groupBy("doc_id", "start", "end").agg(F.min(F.struct("source_doc_id", "source_start", "source_end", "similarity")).alias("s")).select("doc_id", "start", "end", "s.*")


def _digest():
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)


def _texts(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text rows with one text for each id, None), each once; where an id has several texts, these are numbered in the order of ids and (number as doc_id, text; numbers(doc_id, digest, number)) is returned."""
    held = docs.filter("doc_id IS NOT NULL")
    per = held.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), (F.min(F.xxhash64("text")) != F.max(F.xxhash64("text"))).alias("differ"))
    odd = per.filter("rows > 1").agg(F.count(F.lit(1)).alias("repeated"), F.coalesce(F.bool_or("differ"), F.lit(False)).alias("differ")).first()
    if not odd.repeated:
        return docs, None
    if not odd.differ:
        return held.groupBy("doc_id").agg(F.min("text").alias("text")), None
    numbers = written(scan.positions(held.select("doc_id", _digest().alias("digest")).distinct(), [], [F.asc("doc_id"), F.asc("digest")], "number"), "numbers")
    signed = held.withColumn("digest", _digest()).groupBy("doc_id", "digest").agg(F.min("text").alias("text"))
    return written(signed.join(numbers, ["doc_id", "digest"]).select(F.col("number").alias("doc_id"), "text"), "texts"), numbers


def _alone(docs: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(docs without those whose text a smaller document has as it is, PASSAGE rows of these: all of such a text is one passage)."""
    texts = docs.filter(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * min_words - 1))
    digests = written(texts.select("doc_id", F.unhex(_digest()).alias("digest")), "digests")
    heads = digests.groupBy("digest").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    copies = written(digests.join(heads, "digest").filter("doc_id > head").select("doc_id", "head"), "copies")
    rows = copies.count()
    names = _names(PASSAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 2, HASHED_BYTES):
                words = np.diff(word_hashes(part.column(2))[1])
                some = np.flatnonzero(words >= min_words)
                doc, head = (part.column(i).to_numpy()[some] for i in range(2))
                none = np.zeros(len(some), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, none, words[some], head, none, words[some], np.ones(len(some)))], names)

    same = texts.join(if_small(copies, rows), "doc_id").select("doc_id", "head", F.col("text").cast("binary")).mapInArrow(tidy(run), PASSAGE)
    return docs.join(if_small(copies.select("doc_id"), rows), "doc_id", "left_anti") if rows else docs, same


def _spans(failed: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """doc_id, failed, found: arrays of (begin, end) in shingles, of the intervals that turned out no passages and of the passages."""
    tried = failed.groupBy("doc_id").agg(F.collect_set(F.struct(F.col("a_begin").alias("begin"), F.col("a_end").alias("end"))).alias("failed"))
    held = found.groupBy("doc_id").agg(F.collect_set(F.struct(F.col("start").alias("begin"), (F.col("end") - k + 1).alias("end"))).alias("found"))
    return tried.join(held, "doc_id", "left").withColumn("found", F.coalesce("found", F.array()))


def _opened(members: DataFrame, spans: DataFrame) -> DataFrame:
    """The members, as seekers only those whose place lies in a failed interval of their document and in no passage."""
    at = F.shiftright("place", 2 * _REACH)
    holds = lambda s: (s["begin"] <= at) & (at < s["end"])
    seeks = F.coalesce(F.exists("failed", holds) & ~F.exists("found", holds), F.lit(False))
    side = F.col("kind").bitwiseAND(OPEN - 1)
    return members.join(spans, "doc_id", "left").withColumn("kind", F.when(seeks, side + OPEN).otherwise(side)).select(members.columns)


def _large(members: DataFrame, group: int) -> DataFrame:
    """The members of keys under which some still seek a source and weren't linked to all before them: those of more than `group` documents."""
    per = members.groupBy("key", "doc_id").agg(F.max("kind").alias("kind"))
    keys = per.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("kind").alias("kind")).filter((F.col("docs") > group) & (F.col("kind") >= OPEN))
    return members.join(keys.select("key"), "key", "left_semi")


def _open_keys(places: DataFrame, spans: DataFrame) -> DataFrame:
    """key: of the links whose place (doc_id, at, key) lies in a failed interval of its document and in no passage."""
    holds = lambda s: (s["begin"] <= F.col("at")) & (F.col("at") < s["end"])
    return places.join(spans, "doc_id").filter(F.exists("failed", holds) & ~F.exists("found", holds)).select("key").distinct()


def cut_passages(docs: DataFrame, k: int = 5, min_words: int = 50, percent: int = 80) -> DataFrame:
    """The documents without the passages that repeat those of smaller documents; n_chars follows, if there is one.

    Words of a passage go with the white space before each of them; all else
    stays as it is. A row is cut by what was found in its own text: where rows
    share a doc_id, each keeps what the others' texts repeat. Of one id's texts
    the first in the order of their digests keeps a passage that they share.
    Null and short texts and rows without doc_id stay as they are, and so do
    columns of whatever name; an empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in ("text", "n_chars")]
    held = docs.select(F.struct(*kept).alias("held"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts, numbers = _texts(held.select("doc_id", "text"))
    if numbers is not None:
        held = held.withColumn("digest", _digest()).join(numbers, ["doc_id", "digest"], "left").select("held", F.col("number").alias("doc_id"), "text")
    found = written(repeated_passages(texts, k, min_words, percent).select("doc_id", "start", "end"), "spans")
    rows = found.count()
    spans = found.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    marked = held.join(if_small(spans, rows), F.col("doc_id") == F.col("of"), "left").select("held", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [without(t, s) if s else t for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["held", "text"])

    done = marked.mapInArrow(tidy(run), f"held {marked.schema['held'].dataType.simpleString()}, text string")
    sized = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return done.select(*[sized[c].alias(c) if c in sized else F.col(f"held.{c}").alias(c) for c in docs.columns])


def without(text: str, spans: list[dict]) -> str:
    """A text without the words of some spans and the white space before each of them."""
    import re

    gone = set()
    for s in spans:
        gone.update(range(s["start"], s["end"]))
    parts = re.findall(r"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+", text)
    tail = text[sum(map(len, parts)) :]
    return "".join(p for i, p in enumerate(parts) if i not in gone) + tail
