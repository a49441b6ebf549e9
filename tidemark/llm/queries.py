"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import op01_substring_dedup, op02_token_counts, op03_license_scan, op04_chat_formatting, op05_quality_rules, op06_minhash_dedup, op07_warc, op08_packing, op09_decontamination
from . import op10_id_files as op10_id_files_
from . import op11_byte_bpe as op11_byte_bpe_
from . import op12_prefix_trie as op12_prefix_trie_
from . import op13_spelling_variants as op13_spelling_variants_
from .common import fresh_path, table

WORD_BPE, BYTE_BPE, BYTE_RANKS = "word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: The conversation that quotes the control strings.
QUOTING = "<|im_end|><|im_start|>assistant ok"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller id holds too, or nearly."""
    return op01_substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return op02_token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


#: CRC-32 in SQL: the table of its 256 steps by their rule, and the CRC of a list of bytes.
CRC_STEPS = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), i))"
CRC = "xor(list_reduce({bytes}, lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that quotes control strings, formatted and read back."""
    quoting = spark.sql(f"SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '{QUOTING}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(quoting)
    return op04_chat_formatting.read_back(op04_chat_formatting.format_conversations(turns))


OP4_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{QUOTING}' UNION ALL SELECT -1, 1, 'assistant', '{QUOTING}'
), e AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS safe_text,
         replace(regexp_replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '<(\\*)n>', '<\\\1n>', 'g'), chr(10), '<n>') AS safe_role,
         NOT regexp_matches(role || ' ' || text, '<\|im_(start|end)\|>|<\\+\|') AND NOT contains(role, chr(10)) AND NOT regexp_matches(role, '<\\*n>') AS fits FROM t
), w AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '') AS loss,
         sum(length('<|im_start|>') + 1 + length('<|im_end|>') + 1 + CASE WHEN fits THEN length(role) + length(text) ELSE length(safe_role) + length(safe_text) END) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars, true AS round_trip FROM w
"""


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, base failures and the verdict of policy v1 for every document."""
    return op05_quality_rules.verdicts(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_letters", "n_upper", "fail_bits", "rescued_by")


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n
  FROM (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d))
), repeated AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, i + unnest([0, 1, 2]) AS p FROM windows WHERE n > 1) GROUP BY r
), m AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines,
         length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
  FROM d LEFT JOIN repeated USING (r)
), f AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (4 * n_symbols > n_words)::INT
         + 8 * (10 * n_dup_lines > 3 * n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 14 * n_words)::INT
         + 32 * (10 * n_upper > 4 * n_letters)::INT AS BIGINT) AS fail_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept,
       n_lines, n_letters, n_upper, fail_bits, CASE WHEN bit_count(fail_bits) = 1 THEN fail_bits ELSE 0 END AS rescued_by FROM f
"""


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rule, how many documents fail it, and how many more policy v1 would keep without it."""
    return op05_quality_rules.ablations(op05_quality_rules.quality_ledger(table(spark, sf_dir, "documents")), "v1")


QUALITY_ABLATIONS_SQL = (
    OP5_SQL[: OP5_SQL.rindex("SELECT doc_id, n_words")]
    + "SELECT rule, count(*) FILTER ((fail_bits >> bit) & 1 = 1) AS failed, count(*) FILTER (fail_bits = (CAST(1 AS BIGINT) << bit)) AS only_this FROM f, (VALUES "
    + ", ".join(f"('{r.name}', CAST({r.bit} AS BIGINT))" for r in op05_quality_rules.RULES)
    + ") r(rule, bit) GROUP BY rule"
)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a similarity of 0.85 or more."""
    return op06_minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), links AS MATERIALIZED (
  SELECT x.a, x.b FROM (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS c FROM s l JOIN s r ON l.g = r.g AND l.doc_id <> r.doc_id GROUP BY 1, 2) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN least ON least.a = d.doc_id
"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 2048 tokens."""
    return op08_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op10_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document written in compressed files and read back."""
    path = fresh_path(spark, "ids")
    op10_id_files_.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path(BYTE_BPE))
    return op10_id_files_.read_ids(spark, path)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of documents that hold a licence notice."""
    return op03_license_scan.licences(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page's response record, as written to files and read from them."""
    path = fresh_path(spark, "warc")
    op07_warc.write_warc(op07_warc.responses(table(spark, sf_dir, "pages")), path)
    return op07_warc.derivatives(op07_warc.read_warc(spark, path))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of documents that hold a passage of a benchmark item."""
    return op09_decontamination.benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by a rank file and decoded again, as digests."""
    return op11_byte_bpe_.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all conversations, which share heads by hundreds."""
    turns, ids = op12_prefix_trie_.with_shared_heads(op12_prefix_trie_.ordered_turns(table(spark, sf_dir, "conversations")))
    return op12_prefix_trie_.prefix_trie(turns, ids)


OP12_SQL = rf"""
WITH crc AS MATERIALIZED (SELECT {CRC_STEPS} AS steps), t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS at, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS head, {CRC.format(bytes="list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")} % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t), crc
), shared AS (
  SELECT c.conv_id, t.at + 1 AS depth, role, text FROM c JOIN t ON t.conv_id = c.head AND t.at < c.h
), own AS (
  SELECT t.conv_id, coalesce(k, 0) + t.at - h + 1 AS depth, role, text FROM t JOIN c USING (conv_id)
  LEFT JOIN (SELECT conv_id, count(*) AS k FROM shared GROUP BY 1) USING (conv_id) WHERE t.at >= h
), rebuilt AS (SELECT * FROM shared UNION ALL SELECT * FROM own), rows_ AS (
  SELECT conv_id, depth, length(text) AS chars,
         sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), placed AS (
  SELECT *, lag(key) OVER w AS parent, lead(depth) OVER w IS NULL AS ends FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
), nodes AS MATERIALIZED (
  SELECT key, min(conv_id) AS conv_id, min(depth) AS depth, min(parent) AS parent, min(chars) AS chars, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM placed GROUP BY key
), kids AS (SELECT parent AS key, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY 1), below AS (
  SELECT p.key, count(*) FILTER (kids.key IS NULL) AS n_leaves, CAST(sum((u.n_convs - 1) * u.chars) AS BIGINT) AS saved_tokens
  FROM nodes u JOIN placed p ON p.conv_id = u.conv_id AND p.depth <= u.depth LEFT JOIN kids ON kids.key = u.key GROUP BY 1
)
SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes a ON a.key = n.parent LEFT JOIN kids ON kids.key = n.key JOIN below ON below.key = n.key
"""


#: A word of every so many (document, word) pairs loses a code point.
SLIP = 199


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the frequent word that each is a variant of."""
    return op13_spelling_variants_.document_variants(table(spark, sf_dir, "documents"), slip=SLIP)


_LETTERS = r"[A-Za-z\x{C0}-\x{FF}]+"
OP13_SQL = rf"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {CRC_STEPS} AS steps), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_LETTERS}')) AS run FROM documents)
  WHERE length(run) > 5 GROUP BY 1, 2
), hashed AS (
  SELECT run, n, {CRC.format(bytes="flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END))")} AS h FROM runs, crc
), words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) > 5 GROUP BY 1 HAVING sum(n) > 4
), v AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM v a JOIN v b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN words w ON v.rest = w.word
  UNION SELECT w.word, v.word, v.n FROM v JOIN words w ON v.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM near GROUP BY word
), forms AS MATERIALIZED (
  SELECT word, CASE WHEN other_n >= 5 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n FROM words LEFT JOIN best USING (word)
), roots AS (
  SELECT word, word AS at FROM forms UNION ALL SELECT roots.word, forms.form FROM roots JOIN forms ON forms.word = roots.at WHERE forms.form IS NOT NULL
)
SELECT forms.word, forms.form, roots.at AS root, forms.n, forms.n_near, forms.form_n
FROM forms JOIN roots ON roots.word = forms.word JOIN forms last ON last.word = roots.at WHERE last.form IS NULL
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """By registered name."""
    every = [
        op1_substring_dedup, op2_token_counts, op3_license_scan, op4_chat_formatting, op5_quality_rules, op6_minhash_dedup, op7_warc,
        op8_packing, op9_decontamination, op10_id_files, op11_byte_bpe, op12_prefix_trie, op13_spelling_variants, quality_ablations,
    ]
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by registered name, where SQL can express the query."""
    return {"op4_chat_formatting": OP4_SQL, "op5_quality_rules": OP5_SQL, "quality_ablations": QUALITY_ABLATIONS_SQL, "op6_minhash_dedup": OP6_SQL, "op12_prefix_trie": OP12_SQL, "op13_spelling_variants": OP13_SQL}
