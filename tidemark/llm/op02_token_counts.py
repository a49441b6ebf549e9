"""Token counts by a finite-state transducer.

A byte-pair tokenizer with word ends is compiled, step by step as its inputs
ask for it, into a deterministic transducer over byte symbols. Reading one
symbol changes the number of tokens of what has been read by a fixed amount
that depends on the state alone, and that amount stands on the transition.

Why this is finite: byte-pair merging gives every prefix of a word exactly one
last token, and it is the one that ends there and forms a stable pair with the
last token of what stands before it. So the future depends only on the starts
from which a vocabulary token can still reach beyond this place: how far back
they are, which token ended there, and how many tokens fewer they had. Token
length bounds them.

A text is cut into pieces that different tasks count, and these into chunks, at white space where there is any nearby. A chunk's
state map tells for each entry state the state it ends in and the tokens it
emits. White space leads every state back to the first, so a chunk that begins
after it needs one entry; a chunk cut from an unbroken run of letters has the
states that reading the symbols before it can lead to, and others are added
when they are met. Maps compose associatively; a prefix scan composes the maps
of a text's chunks, and its last element counts the text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text
from .tokenizing import text_slices, white_space_units

#: Characters of a text in one chunk, and symbols in one of an unbroken run.
CHUNK_CHARS = 2048
#: Symbols before a chunk that are read to guess the states it can be entered in.
LOOK_BACK = 64
#: Transducer states a worker keeps before compiling afresh: bounds its memory, not the result.
MAX_STATES = 250_000

#: Units whose counts a worker remembers before it starts afresh: bounds its memory, not the result.
MAX_UNITS = 200_000

_SPACES = re.compile(r"[ \t\n\r]")
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class CountTransducer:
    """Transitions state x symbol -> (state, tokens more or fewer), compiled when first asked for.

    Symbols 0..255 are bytes inside a word, 256..511 the same bytes at its end.
    """

    def __init__(self, model: dict):
        suffix, visible = model.get("end_of_word_suffix") or "", byte_symbols()
        self.end = 256 if suffix else 0
        self.number = {c: b for b, c in enumerate(visible)} | ({c + suffix: b + 256 for b, c in enumerate(visible)} if suffix else {})
        self.rank: dict[tuple[str, str], int] = {}
        for i, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[a, b] = i
        self.spelled = {n: c for c, n in self.number.items()}
        self.suffix = suffix
        self.unit = {c: (n,) for c, n in self.number.items()}
        for a, b in self.rank:  # a merge's parts are spelled before it
            self.unit[a + b] = self.unit[a] + self.unit[b]
        #: A trie of the tokens' symbols: (node * 512 + symbol) -> node; the token at a node; the nodes that go on.
        self.child: dict[int, int] = {}
        self.token: dict[int, str] = {}
        for t, s in self.unit.items():
            if len(s) == 1 or self._merged(s) == (t,):
                node = 0
                for symbol in s:
                    node = self.child.setdefault(node * 512 + symbol, len(self.child) + 1)
                self.token[node] = t
        self.inner = {k // 512 for k in self.child}
        self.stable: dict[tuple[str, str], bool] = {}
        self._restart()

    def _restart(self) -> None:
        #: A state: for each start still open, (trie node read to, last token before it, tokens it had less than now).
        self.states: list[tuple] = [((0, "", 0),)]
        self.number_of: dict[tuple, int] = {self.states[0]: 0}
        self.to: list[dict[int, tuple[int, int]]] = [{}]

    def _merged(self, symbols: tuple[int, ...]) -> tuple[str, ...]:
        """Tokens by merging the pair of lowest rank, leftmost first, until none is left."""
        parts = [self.spelled[s] for s in symbols]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return tuple(parts)

    def _pair(self, a: str, b: str) -> bool:
        """Whether a and b stay two tokens when they meet."""
        found = self.stable.get((a, b))
        if found is None:
            if len(self.stable) > 2 * MAX_STATES:
                self.stable.clear()
            found = self.stable[a, b] = self._merged(self.unit[a] + self.unit[b]) == (a, b)
        return found

    def _compile(self, state: int, symbol: int) -> tuple[int, int]:
        open_starts = []
        last = None
        for node, before, less in self.states[state]:
            node = self.child.get(node * 512 + symbol)
            if node is None:
                continue
            if last is None and (t := self.token.get(node)) and (not before or self._pair(before, t)):
                last = (t, 1 - less)
            if node in self.inner:
                open_starts.append((node, before, less))
        if last is None:
            raise ValueError("no token ends here: the vocabulary lacks a byte")
        token, more = last
        key = (*((node, before, less + more) for node, before, less in open_starts), (0, token, 0))
        to = self.number_of.get(key)
        if to is None:
            to = self.number_of[key] = len(self.states)
            self.states.append(key)
            self.to.append({})
        self.to[state][symbol] = to, more
        return to, more

    def symbols(self, word: bytes) -> list[int]:
        """The symbols of one pre-token."""
        return [*word[:-1], word[-1] + self.end] if word else []

    def read(self, state: int, symbols: list[int]) -> tuple[int, int]:
        """The state after some symbols and the tokens they emit; a word's end leads back to the first state."""
        total, to = 0, self.to
        for symbol in symbols:
            state, more = to[state].get(symbol) or self._compile(state, symbol)
            total += more
            if symbol > 255:
                state = 0
        return state, total

    def fresh(self) -> None:
        """Compile afresh if there are too many states; the numbers of states are good until then."""
        if len(self.states) > MAX_STATES:
            self._restart()

    def count(self, word: bytes) -> int:
        """Tokens of one pre-token."""
        return self.read(0, self.symbols(word))[1]


class StateMap:
    """entry state -> (exit state, tokens) of one chunk; a composed map asks its parts for entries it hasn't got."""

    __slots__ = ("ask", "found")

    def __init__(self, found: dict[int, tuple[int, int]], ask):
        self.found, self.ask = found, ask

    def __getitem__(self, state: int) -> tuple[int, int]:
        got = self.found.get(state)
        if got is None:
            got = self.found[state] = self.ask(state)
        return got


def compose(a: StateMap, b: StateMap) -> StateMap:
    """The map of two neighbouring chunks."""

    def ask(state: int) -> tuple[int, int]:
        middle, first = a[state]
        last, second = b[middle]
        return last, first + second

    return StateMap({state: ask(state) for state in a.found}, ask)


def scan(maps: list[StateMap]) -> list[StateMap]:
    """Inclusive prefix compositions, doubling the distance in each round."""
    out, step = list(maps), 1
    while step < len(out):
        out = [compose(out[i - step], out[i]) if i >= step else out[i] for i in range(len(out))]
        step *= 2
    return out


class TextCounter:
    """Tokens of whole texts and chunk maps."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"]["pretokenizers"]
        if spec["model"]["type"] != "BPE" or not spec["model"].get("end_of_word_suffix") or steps[0]["type"] != "Split":
            raise ValueError("only byte-pair tokenizers with word ends that drop white space are compiled")
        pattern = steps[0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.plain = pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.normalize = Tokenizer.from_file(path).normalizer.normalize_str
        self.transducer = CountTransducer(spec["model"])
        self.known: dict[str, int] = {}

    def words_of(self, unit: str) -> tuple[list[str], int]:
        """The pre-tokens of a text without white space, and how many special strings stand in it, a token each."""
        if self.special and self.special.search(unit):
            parts, special = self.special.split(unit), len(self.special.findall(unit))
        else:
            parts, special = [unit], 0
        words: list[str] = []
        for part in parts:
            if part.isascii() and self.plain:
                words += _ASCII_WORDS.findall(part.lower())
            else:
                words += self.words.findall(self.normalize(part))
        return words, special

    def text(self, text: str) -> int:
        """Tokens of a text that begins and ends at white space or at its ends."""
        known = self.known
        if len(known) > MAX_UNITS:
            known.clear()
        total = 0
        for u in white_space_units(text):
            n = known.get(u)
            if n is None:
                words, n = self.words_of(u)
                n += sum(self.transducer.count(w.encode()) for w in words)
                if len(u) <= 200:
                    known[u] = n
            total += n
        return total

    def _run_maps(self, run: str, size: int) -> list[StateMap]:
        """The maps of a long unbroken run: its symbols, `size` to a chunk."""
        found = [self.words_of(u) for u in white_space_units(run)]
        special = sum(n for _, n in found)
        symbols = [x for words, _ in found for w in words for x in self.transducer.symbols(w.encode())]
        maps = [StateMap({0: (0, special)}, lambda _: (0, special))]
        for at in range(0, len(symbols), size):
            part = symbols[at : at + size]
            entry = self.transducer.read(0, symbols[max(0, at - LOOK_BACK) : at])[0]
            ask = lambda state, part=part: self.transducer.read(state, part)
            maps.append(StateMap({state: ask(state) for state in {entry} | ({0} if not at else set())}, ask))
        return maps

    def maps(self, text: str, size: int = CHUNK_CHARS) -> list[StateMap]:
        """The maps of a text's chunks of about `size` characters."""
        out, at = [], 0
        while at < len(text):
            cut = at + size
            if cut >= len(text):
                cut = len(text)
            elif not _SPACES.match(text, cut):
                last = max(text.rfind(c, at, cut) for c in " \t\n\r")
                after = _SPACES.search(text, cut) if last <= at else None
                cut = last if last > at else after.start() if after else len(text)
            part = text[at:cut]
            if len(part) > 2 * size:  # nothing but one unbroken run, perhaps after one white space
                out += self._run_maps(part, size)
            else:
                n = self.text(part)
                out.append(StateMap({0: (0, n)}, lambda _, n=n: (0, n)))
            at = cut
        return out

    def total(self, text: str, size: int = CHUNK_CHARS) -> int:
        """Tokens of a whole text, by the scan of its chunks' maps."""
        self.transducer.fresh()
        prefixes = scan(self.maps(text, size))
        return prefixes[-1][0][1] if prefixes else 0


@lru_cache(maxsize=2)
def text_counter(path: str) -> TextCounter:
    """The worker's counter for a tokenizer file."""
    return TextCounter(path)


#: Characters of a text after which the next white space ends a piece; pieces of one text are counted by different tasks.
PIECE_CHARS = 1 << 20


def dealt_pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """A text in pieces that begin at white space, which leads every state back to the first; an unbroken run stays whole."""
    out, begin = [], 0
    while len(text) - begin > size:
        found = _SPACES.search(text, begin + size)
        if found is None:
            break
        out.append(text[begin : found.start()])
        begin = found.start()
    out.append(text[begin:])
    return out


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, chunk_chars: int = CHUNK_CHARS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per input row.

    n_bytes counts UTF-8 bytes; over_limit is n_tokens > limit. A null text
    counts as empty; a null doc_id is kept; repeated rows stay repeated; other
    columns are left out; an empty table gives an empty result. A text of any
    length is read whole, chunk by chunk. A text of one piece is counted where
    its row is read, and only its numbers are shuffled; the pieces of a longer
    one are dealt to all tasks.
    """
    names = ["row", "doc_id", "n_bytes", "number", "n_tokens", "piece"]
    kinds = [pa.int64()] * 5 + [pa.string()]

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = text_counter(tokenizer_path)
        for batch in batches:
            for part in text_slices(batch, 2):
                rows = []
                for row, doc, text, size in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    pieces = dealt_pieces(text or "", piece_chars)
                    if len(pieces) == 1:
                        rows.append((row, doc, size, 0, counter.total(pieces[0], chunk_chars), None))
                    else:
                        rows += [(row, doc, size, i, None, piece) for i, piece in enumerate(pieces)]
                yield rows_of(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = text_counter(tokenizer_path)
        for batch in batches:
            for part in text_slices(batch, 5):
                found = [n if piece is None else counter.total(piece, chunk_chars) for n, piece in zip(part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(found, pa.int64())], ["row", "doc_id", "n_bytes", "n_tokens"])

    rows = id_and_text(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    pieces = rows.mapInArrow(cut, "row long, doc_id long, n_bytes long, number long, n_tokens long, piece string").repartition("row", "number")
    counted = pieces.mapInArrow(count, "row long, doc_id long, n_bytes long, n_tokens long")
    whole = counted.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
    return whole.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
