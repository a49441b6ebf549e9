"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document: its measurements and a failure bit
are stored. Policies are versioned masks over those bits, so a new policy, or
the question what one rule alone costs, is answered from the ledger with
bitwise operations and never reads a text again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, tidy
from .tokenizing import text_slices

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper"]
_SYMBOLS = b"#*$%&|<>"
_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])


@dataclass(frozen=True)
class Rule:
    """A rule's bit, its name and, as SQL over the measurements, when a document fails it."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "4 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule(5, "shouting", "10 * n_upper > 4 * n_letters"),
)
#: Versions of the policy: the bits that reject a document.
POLICIES = {"base": 0b000011, "v1": 0b111111}


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen: set = set()
    again = {w for w in windows if w in seen or seen.add(w)}
    if not again:
        return 0
    total = upto = 0
    for i, w in enumerate(windows):
        if w in again:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of one UTF-8 text, in the order of MEASURES."""
    words = text.split()  # bytes split at exactly 0x20 and 0x09-0x0D
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(b"".join(words).decode("utf-8", "replace")),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(text) - len(text.translate(None, _LETTERS)),
        len(text) - len(text.translate(None, _UPPER)),
    )


def fail_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    """The failure bits of a row of measurements."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def _measured(docs: DataFrame, rules: tuple[Rule, ...], held: list[str]) -> DataFrame:
    """held (a struct of columns, unchanged), doc_id, the measurements, fail_bits."""
    rows = docs.select(F.struct(*held).alias("held") if held else F.lit(None).cast("string").alias("held"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    out = "held " + rows.schema["held"].dataType.simpleString() + ", doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 2):
                found = [measure(t or b"") for t in part.column(2).to_pylist()]
                columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["held", "doc_id", *MEASURES])

    return rows.mapInArrow(tidy(run), out).withColumn("fail_bits", fail_bits(rules))


def quality_ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measurements, fail_bits: one row per input row, no shuffle.

    Words are runs of anything but the bytes 0x20 and 0x09-0x0D; lines are cut
    at \\n and count if they hold a word. A null or empty text has no words and
    no lines. Repeated rows stay repeated, a null doc_id is kept, an empty
    table gives an empty ledger; other columns are left out, so they may bear
    any name.
    """
    return _measured(docs, rules, []).drop("held")


def rejected(policy: str | int, bits: str = "fail_bits") -> Column:
    """Whether a policy (a version's name, or a mask) rejects a ledger row."""
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy] if isinstance(policy, str) else policy)) != 0


def policy_totals(ledger: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """policy, documents, kept: every version from one pass; documents are first counted per bit pattern."""
    patterns = ledger.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    masks = F.explode(F.create_map(*[F.lit(x) for kv in (policies or POLICIES).items() for x in kv])).alias("policy", "mask")
    spread = patterns.select("fail_bits", "n", masks)
    free = F.col("fail_bits").bitwiseAND(F.col("mask")) == 0
    return spread.groupBy("policy").agg(F.sum("n").alias("documents"), F.coalesce(F.sum(F.when(free, F.col("n"))), F.lit(0)).alias("kept"))


def ablations(ledger: DataFrame, policy: str | int = "v1", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """rule, failed, only_this: documents failing each rule of a policy, and those that it alone rejects.

    At most one row per bit pattern is shuffled by each task, whatever the number of documents.
    """
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    patterns = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    per_rule = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules if mask >> r.bit & 1])).alias("r")
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return patterns.select("bits", "n", per_rule).groupBy(F.col("r.rule").alias("rule")).agg(F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("failed"), F.coalesce(F.sum(F.when(hit & (F.bit_count("bits") == 1), F.col("n"))), F.lit(0)).alias("only_this"))


def rescued_by(policy: str | int, bits: str = "fail_bits") -> Column:
    """The bit of the rule without which a policy would keep a ledger row that it rejects; 0 if there is none."""
    mask = F.lit(POLICIES[policy] if isinstance(policy, str) else policy)
    hit = F.col(bits).bitwiseAND(mask)
    return F.when(F.bit_count(hit) == 1, hit).otherwise(F.lit(0).cast("long"))


def verdicts(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """doc_id, the measurements, base_failed, kept, fail_bits, rescued_by. Base failures are rejected whatever the policy.

    Nulls, repeated rows, empty tables and other columns are treated as in quality_ledger.
    """
    ledger = quality_ledger(docs).withColumn("base_failed", rejected("base")).withColumn("kept", ~rejected("base") & ~rejected(policy))
    return ledger.withColumn("rescued_by", rescued_by(policy))


def keep_good(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The documents a policy keeps, with their own columns, of whatever name.

    A null or empty text has too few words and goes; repeated rows and null ids
    are judged each for itself; an empty table stays empty.
    """
    ledger = _measured(docs, RULES, docs.columns)
    return ledger.filter(~rejected("base") & ~rejected(policy)).select("held.*")
