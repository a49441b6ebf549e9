"""Spelling variants of a corpus' words by PartEnum signatures on letter multisets.

A word's letters are a multiset: a binary vector with a place for every k-th
occurrence of a letter. One inserted or deleted letter changes one place of it,
one replaced letter two. Letters are dealt to four parts; two words whose
vectors differ in two places at most agree on two parts at least, so every
choice of two parts gives a signature, and near words share one exactly.

A signature is refined by what one edit leaves as it is beside the letters:
half of the word (before or behind the edit) and the length of the longer word.
Words that share a signature are joined by equality and compared. Where a
signature is shared by very many words, these are joined on the words that one
deletion leaves, which only few can share.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, if_small, written
from .shingles import mix, odd_numbers
from .tokenizing import text_slices

#: Parts that letters are dealt to; two of them are the same in words that differ by one edit.
PARTS, SAME = 4, 2
#: Words under one signature beyond which they are joined on what a deletion leaves.
BUCKET = 500
#: Code points up to which a word's deletions are listed.
LISTED_CHARS = 256
#: Distinct words that a task holds before it passes their counts on.
HELD_WORDS = 300_000
#: Code points of one text whose words are found at a time.
PIECE_CHARS = 1 << 20
_LETTER = "a-zÀ-ÿ"
_OTHER = re.compile(f"[^{_LETTER}]")


def _pieces(text: str, size: int) -> Iterator[str]:
    """A text in pieces that cut no run of letters."""
    begin = 0
    while len(text) - begin > size:
        found = _OTHER.search(text, begin + size)
        if found is None:
            break
        yield text[begin : found.start()]
        begin = found.start()
    yield text[begin:]


def text_words(doc_id: int | None, raw: bytes, min_chars: int = 6, slip: int = 0, size: int = PIECE_CHARS) -> Counter:
    """Counts of the words of one text (UTF-8): runs of A-Z, a-z and U+00C0-U+00FF with `min_chars` code points or more, only A-Z lower-cased.

    slip: if it divides the CRC-32 of `<doc_id>:<word>`, the word loses the code point at that number's place; 0, or no doc_id: never.
    """
    runs: Counter = Counter()
    find = re.compile(f"[{_LETTER}]{{{min_chars},}}").findall
    for piece in _pieces(raw.lower().decode("utf-8", "replace"), size):  # bytes lower only A-Z
        runs.update(find(piece))
    if not slip or doc_id is None:
        return runs
    before, out = zlib.crc32(b"%d:" % doc_id), Counter()
    for word, n in runs.items():
        h = zlib.crc32(word.encode(), before)
        if h % slip == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < min_chars:
                continue
        out[word] += n
    return out


def word_counts(docs: DataFrame, min_chars: int = 6, min_count: int = 5, slip: int = 0) -> DataFrame:
    """word, n of the words (see text_words) with `min_count` occurrences or more in whole texts.

    A null or empty text has no words; repeated rows count again; other columns are left out; an empty table gives no rows.
    """

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for part in text_slices(batch, 1):
                for doc, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    held.update(text_words(doc, raw or b"", min_chars, slip))
                    if len(held) >= HELD_WORDS:
                        yield rows(held)
                        held = Counter()
        yield rows(held)

    each = id_and_text(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _signatures(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, own) with a row per word: own ones of its length, the others for its being the shorter of two."""
    lengths = pc.utf8_length(words).to_numpy().astype(np.int64)
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    letter = mix(points + np.uint64(77))
    part = points % np.uint64(PARTS)
    sums = [np.add.reduceat(np.where(part == p, letter, np.uint64(0)), starts) for p in range(PARTS)]
    # The halves: sums of letters weighted by their place from the word's front, or from its end.
    place = np.arange(len(points)) - np.repeat(starts, lengths)
    powers = odd_numbers(11, int(lengths.max()))
    front, back = (np.concatenate([[np.uint64(0)], np.cumsum(letter * powers[i])]) for i in (place, np.repeat(lengths, lengths) - 1 - place))
    numbers = odd_numbers(12, PARTS + 3)
    columns, own = [], []
    for shorter in (0, 1):
        longer = lengths + shorter
        half = longer // 2
        sides = front[starts + half] - front[starts], back[ends] - back[ends - (longer - half)]
        for number, chosen in enumerate(combinations(range(PARTS), SAME)):
            letters = sum((sums[p] * numbers[p] for p in chosen), mix(np.array([number], np.uint64)))
            for side, kept in enumerate(sides):
                columns.append(mix(letters + kept * numbers[PARTS + side] + longer.astype(np.uint64) * numbers[-1]))
                own.append(not shorter)
    return np.stack(columns, axis=1).view(np.int64), np.array(own)


SIGNED = "signature long, own boolean, word string, n long"


def signed(words: DataFrame) -> DataFrame:
    """SIGNED rows of words(word, n) with a code point or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                some = batch.slice(first, 4096)
                found, own = _signatures(some.column(0))
                row = pa.array(np.repeat(np.arange(some.num_rows), len(own)))
                columns = [pa.array(found.ravel()), pa.array(np.tile(own, some.num_rows)), some.column(0).take(row), some.column(1).take(row)]
                yield pa.RecordBatch.from_arrays(columns, ["signature", "own", "word", "n"])

    return words.filter("word <> ''").select("word", "n").mapInArrow(run, SIGNED)


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.withColumnsRenamed({"word": name, "n": f"{name}_n"})


def _by_deletion(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n of near words among words(word, n), joined on what is left without one code point."""
    w, i = F.col("word"), F.col("i")
    rest = F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))
    left = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i")).select("word", "n", "i", rest.alias("rest"))
    replaced = _side(left, "a").join(_side(left, "b"), ["i", "rest"]).filter("a < b")
    shorter = _side(left, "a").join(_side(words.withColumn("rest", w), "b"), "rest")
    names = ["a", "a_n", "b", "b_n"]
    return replaced.select(names).unionByName(shorter.select(names))


def near_words(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """word, near, near_n: every pair of words(word, n) that differ by exactly one inserted, deleted or replaced code point, in both directions.

    Distinct words are asked for; an empty one is near to nothing; an empty table gives no rows.
    """
    rows = signed(words)
    crowded = written(rows.groupBy("signature").agg(F.count(F.lit(1)).alias("words")).filter(F.col("words") > bucket).select("signature"), "crowded")
    n_crowded = crowded.count()
    if n_crowded:
        crowded = if_small(crowded, n_crowded)
        many = rows.filter(F.length("word") <= LISTED_CHARS).join(crowded, "signature", "left_semi").select("word", "n").distinct()
        # A long word stays under every signature, and so does the longest that is listed: it may be near to one that isn't.
        long = F.length("word") >= LISTED_CHARS
        rows = rows.filter(long).unionByName(rows.filter(~long).join(crowded, "signature", "left_anti"))
    a, b = _side(rows.filter("own").drop("own"), "a"), _side(rows, "b")
    found = a.join(b, "signature").filter((~F.col("own") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")
    if n_crowded:
        found = found.unionByName(_by_deletion(many))
    both = found.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("r")).select("r.*")
    return both.groupBy("word", "near").agg(F.min("near_n").alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of forms(word, form): the last form that is reached. Each round doubles the steps; counts rise along a chain, so it has an end."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        step = written(now.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, ratio: int = 5, bucket: int = BUCKET) -> DataFrame:
    """word, form, root, n, n_near, form_n of words(word, n).

    form is the near word with the largest n (ties: the smallest in code-point
    order) if that is `ratio` times the word's or more, else null; root is the
    last word that forms lead to, the word itself if it has none; n_near counts
    near words; form_n is the form's n. Words are distinct; an empty table gives no rows.
    """
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = near_words(words, bucket).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    led = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    form, form_n = F.when(led, F.col("best.near")).alias("form"), F.when(led, -F.col("best.less")).alias("form_n")
    rows = written(words.join(near, "word", "left").select("word", form, "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form_n), "forms")
    roots = _roots(rows.filter("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_variants(docs: DataFrame, min_chars: int = 6, min_count: int = 5, ratio: int = 5, slip: int = 0) -> DataFrame:
    """spelling_variants of the words of whole texts (see word_counts)."""
    return spelling_variants(written(word_counts(docs, min_chars, min_count, slip), "words"), ratio)
