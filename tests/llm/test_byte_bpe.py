"""Byte-level BPE: equal to the library on whole texts, however they are cut, and back to the bytes."""

import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken

from tidemark.llm import op11_byte_bpe

from .test_text_ops import EDGE, prose

PATH = P.path("byte_bpe_50k.tiktoken")


def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_parts_have_the_ids_of_the_whole():
    own, rng = library(), random.Random(7)
    letters = [*"ab'1!-. \t\n\r\x0b\x1c\x1f\x85\xa0 　", "'ll", "don't", "  ", " \n ", "é", "日本", "\U0001f600", "́"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        size = rng.randint(1, 9)
        parts = op11_byte_bpe.safe_parts(text, size)
        assert "".join(parts) == text
        assert op11_byte_bpe.encode_text(text, PATH, P.PATTERN, size).tolist() == own.encode_ordinary(text)


def test_long_texts_are_cut_and_unbroken_ones_are_not():
    own = library()
    for text in (" ".join(prose(5, 60_000)), "x" * 200_000, " \n" * 90_000, "\n".join(["word"] * 50_000) + " " * 70_000 + "end"):
        assert op11_byte_bpe.encode_text(text, PATH, P.PATTERN).tolist() == own.encode_ordinary(text)
    assert len(op11_byte_bpe.safe_parts(" ".join(prose(5, 60_000)))) > 3 and len(op11_byte_bpe.safe_parts("x" * 200_000)) == 1


def test_round_trip_of_edge_rows(edge, rows, spark):
    own = library()

    def of(i, text):
        ids = own.encode_ordinary(text or "")
        return i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    found = op11_byte_bpe.round_trip(edge, PATH, P.PATTERN)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted((of(i, t) for i, t in EDGE), key=str)
    assert op11_byte_bpe.round_trip(edge.limit(0), PATH, P.PATTERN).count() == 0
    broken = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    assert op11_byte_bpe.round_trip(broken, PATH, P.PATTERN).first().decoded_sha256 == hashlib.sha256("a�b".encode()).hexdigest()


def test_ids_that_are_no_text_decode_to_their_bytes(rows):
    own = library()
    some = [(1, own.encode_single_token(b"\xff")), (2, own.encode_single_token(b"\xc3"))]
    table = rows([(i, 1, bytearray(x.to_bytes(4, "little"))) for i, x in some] + [(3, 0, bytearray()), (4, 0, None)], "doc_id bigint, n_tokens bigint, ids binary")
    assert {r.doc_id: r.decoded and bytes(r.decoded) for r in op11_byte_bpe.decode(table, PATH, P.PATTERN).collect()} == {1: b"\xff", 2: b"\xc3", 3: bytearray(), 4: None}
