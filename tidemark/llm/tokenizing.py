"""Whole-text encoding with a public tokenizer file, one distinct word at a time.

A column of texts is cut into units at places where the tokenizer always starts
a new pre-token, so a unit's ids do not depend on its neighbours. Arrow cuts
the units and finds the distinct ones of a slice of the column; the tokenizers
library encodes each of those once, plain words many to a call, and the ids of
the texts are gathered from that table. A Python worker keeps the ids of a
bounded number of plain words, as Arrow and numpy arrays, for later slices.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text encoded at a time; a longer text is a slice of its own.
SLICE_BYTES = 6 << 20
#: Plain words given to the library in one string.
JOINED = 64
#: Plain words (for each way they are set off) whose ids a Python worker keeps: bounds its memory, not the result.
KEPT_WORDS = 300_000
#: What str.split() takes for white space and the tokenizers do not.
_ODD = re.compile("[\x1c-\x1f]")
_WHITE = "\t-\r\x85\xa0  -     　"
_SPACE = re.compile(f"[ {_WHITE}]+")
_RUN = f" [ {_WHITE}\x1c-\x1f]|[{_WHITE}\x1c-\x1f][{_WHITE}\x1c-\x1f]"
#: A word of Latin letters that have no other normal form, perhaps with marks after it: two pre-tokens under either tokenizer's pattern, which takes a run of marks as one.
_LATIN = "[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-įı-ȶ]"
_MARKS = ".,;:!?#$%&*"
#: Stands before the first unit of a text for tokenizers whose words carry the space before them.
_FIRST = "\x01"


def white_space_units(text: str) -> list[str]:
    """The parts of a text between white space, for tokenizers that drop it."""
    if _ODD.search(text):
        return [x for x in _SPACE.split(text) if x]
    return text.split()


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + lengths[i] - 1 of every i, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return np.empty(0, np.int64)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])


class Table:
    """Rows of ids: row i is flat[starts[i] : starts[i] + lengths[i]]."""

    def __init__(self, lengths: np.ndarray, flat: np.ndarray):
        self.lengths, self.flat = lengths, flat
        self.starts = np.cumsum(lengths) - lengths

    def take(self, rows: np.ndarray) -> Table:
        """Some of the rows, in this order."""
        lengths = self.lengths[rows]
        return Table(lengths, self.flat[gathered(self.starts[rows], lengths)])

    def of(self, row: int) -> np.ndarray:
        """One row's ids."""
        return self.flat[self.starts[row] : self.starts[row] + self.lengths[row]]


def stacked(tables: list[Table]) -> Table:
    """The rows of several tables, one table after the other."""
    return Table(np.concatenate([t.lengths for t in tables]), np.concatenate([t.flat for t in tables]))


class TextEncoder:
    """ids of whole texts, as the tokenizers library gives them without added special tokens."""

    def __init__(self, path: str, drops_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.drops_space = drops_space
        self.kept: dict[str, tuple[pa.Array, Table]] = {}
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = "|".join(map(re.escape, special)) if any(" " in s for s in special) else None
        size = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        #: Ids that end a word (or, where words carry the space before them, begin one).
        self.edge = np.zeros(size, bool)
        suffix = spec["model"].get("end_of_word_suffix")
        for token, i in spec["model"]["vocab"].items():
            self.edge[i] = token.endswith(suffix) if drops_space else token.startswith("Ġ")
        if drops_space and not suffix:
            raise ValueError("a tokenizer that drops white space must mark the ends of words")

    def _asked(self, texts: list[str]) -> Table:
        """The library's ids of each text."""
        lengths, flat = [], [np.empty(0, np.int32)]
        for i in range(0, len(texts), 1024):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + 1024], add_special_tokens=False)]
            lengths += map(len, ids)
            flat.append(np.fromiter(chain.from_iterable(ids), np.int32, sum(map(len, ids))))
        return Table(np.array(lengths, np.int64), np.concatenate(flat))

    def _words(self, words: pa.Array, separator: str) -> Table:
        """ids of distinct plain words, each after a space or after a line feed, which gets no ids here."""
        held, table = self.kept.get(separator, (words.slice(0, 0), Table(np.empty(0, np.int64), np.empty(0, np.int32))))
        row = pc.fill_null(pc.index_in(words, value_set=held), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = np.flatnonzero(row < 0)
        new = words.take(pa.array(fresh))
        row[fresh] = np.arange(len(fresh)) + len(held)
        both = stacked([table, self._encoded(new, separator)])
        if len(held) < KEPT_WORDS:  # those met first are the frequent ones
            more = new.slice(0, KEPT_WORDS - len(held))
            self.kept[separator] = pa.concat_arrays([held, more]), both.take(np.arange(len(held) + len(more)))
        return both.take(row)

    def _encoded(self, words: pa.Array, separator: str) -> Table:
        """As _words, from the library."""
        if not len(words):
            return Table(np.empty(0, np.int64), np.empty(0, np.int32))
        groups = np.append(np.arange(0, len(words), JOINED), len(words)).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(groups), words), separator)
        asked = self._asked([separator + x for x in joined.to_pylist()])
        ids = asked.flat
        if separator == "\n":
            feed = self._asked(["\n"]).flat[0]
            cuts = np.flatnonzero(ids == feed)
            keep = ids != feed
            lengths = np.diff(np.append(cuts, len(ids))) - 1
            ids = ids[keep]
        elif self.drops_space:
            lengths = np.diff(np.flatnonzero(self.edge[ids]), prepend=-1)
        else:
            lengths = np.diff(np.append(np.flatnonzero(self.edge[ids]), len(ids)))
        if len(lengths) != len(words) or lengths.sum() != len(ids):  # the vocabulary doesn't mark every word's edge
            before = " " if separator == " " and not self.drops_space else ""
            return self._asked([before + w for w in words.to_pylist()])
        return Table(lengths.astype(np.int64), ids)

    def _units(self, units: pa.Array) -> Table:
        """ids of distinct units."""
        body = units
        fed = np.zeros(len(units), bool)
        if not self.drops_space:
            fed = pc.starts_with(units, "\n").to_numpy(zero_copy_only=False)
            body = pc.if_else(pa.array(fed), pc.utf8_slice_codeunits(units, 1), units)
        plain = pc.match_substring_regex(body, f"^{_LATIN}+[{_MARKS}]*$").to_numpy(zero_copy_only=False)
        marked = plain & pc.match_substring_regex(body, f"[{_MARKS}]$").to_numpy(zero_copy_only=False)
        other = np.flatnonzero(~plain)
        bare = pc.utf8_rtrim(body, _MARKS)
        if self.drops_space:
            bare = pc.utf8_lower(bare)
        tables, row_of, base = [], np.zeros(len(units), np.int64), 0
        for which, separator in ((plain & ~fed, " "), (plain & fed, "\n")):
            rows = np.flatnonzero(which)
            words = bare.take(pa.array(rows)).dictionary_encode()
            tables.append(self._words(words.dictionary, separator))
            row_of[rows] = words.indices.to_numpy() + base
            base += len(words.dictionary)
        texts = units.take(pa.array(other)).to_pylist()
        if not self.drops_space:
            texts = [u[1:] if u[:1] == _FIRST else u if u[:1] == "\n" else " " + u for u in texts]
        tables.append(self._asked(texts))
        row_of[other] = np.arange(len(other)) + base
        base += len(other)
        tails = pc.replace_substring_regex(body.filter(pa.array(marked)), f"^{_LATIN}+", "").dictionary_encode()
        tables.append(self._asked([*tails.dictionary.to_pylist(), *([] if self.drops_space else ["\n"])]))
        words = stacked(tables)
        # A unit is up to three rows: a line feed, a word, its marks.
        parts = [row_of[:, None]]
        some = [np.ones((len(units), 1), bool)]
        if not self.drops_space:
            parts.insert(0, np.full((len(units), 1), base + len(tails.dictionary)))
            some.insert(0, (fed & plain)[:, None])
        if marked.any():
            tail_row = np.zeros(len(units), np.int64)
            tail_row[marked] = tails.indices.to_numpy() + base
            parts.append(tail_row[:, None])
            some.append(marked[:, None])
        rows, used = np.hstack(parts), np.hstack(some)
        each = words.take(rows[used])
        sizes = np.zeros(rows.shape, np.int64)
        sizes[used] = each.lengths
        return Table(sizes.sum(axis=1), each.flat)

    def encode(self, texts: pa.Array) -> Table:
        """A row of ids per text of a string array; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = np.zeros(len(texts), bool)  # texts the library gets as they are
        if self.special:
            whole |= pc.match_substring_regex(texts, self.special).to_numpy(zero_copy_only=False)
        if self.drops_space:
            cut = pc.ascii_split_whitespace(texts)
        else:
            whole |= pc.match_substring_regex(texts, f"{_RUN}|{_FIRST}").to_numpy(zero_copy_only=False)
            rest = pc.if_else(pa.array(whole), "", texts)
            cut = pc.split_pattern(pc.binary_join_element_wise(_FIRST, pc.replace_substring(rest, "\n", " \n"), ""), " ")
        units = cut.flatten().dictionary_encode()
        count = np.diff(cut.offsets.to_numpy())
        row = units.indices.to_numpy()
        if self.drops_space and whole.any():
            keep = np.repeat(~whole, count)
            row, count = row[keep], np.where(whole, 0, count)
        found = self._units(units.dictionary).take(row)
        upto = np.concatenate([[0], np.cumsum(found.lengths)])
        ends = np.cumsum(count)
        lengths = upto[ends] - upto[ends - count]
        if not whole.any():
            return Table(lengths, found.flat)
        asked = self._asked(texts.filter(pa.array(whole)).to_pylist())
        order = np.empty(len(texts), np.int64)
        order[np.flatnonzero(~whole)] = np.arange(int((~whole).sum()))
        order[np.flatnonzero(whole)] = np.arange(int(whole.sum())) + int((~whole).sum())
        return stacked([Table(lengths[~whole], found.flat), asked]).take(order)


@lru_cache(maxsize=2)
def text_encoder(path: str, drops_space: bool) -> TextEncoder:
    """The worker's encoder for a tokenizer file."""
    return TextEncoder(path, drops_space)


def text_slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts have about `most` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(sizes)
    first = 0
    while first < batch.num_rows:
        before = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, before + most, "right")))
        yield batch.slice(first, last - first)
        first = last
