"""Spelling variants against a version that compares every pair of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import op13_spelling_variants as op13

from .test_text_ops import EDGE


def counted(docs, slip):
    """Every occurrence by itself."""
    out = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{word}".encode())
            if slip and i is not None and h % slip == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            out[word] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(words, ratio=5):
    near = {a: [b for b in words if one_edit(a, b)] for a in words}
    form = {}
    for a, bs in near.items():
        best = min(bs, key=lambda b: (-words[b], b), default=None)
        form[a] = best if best is not None and words[best] >= ratio * words[a] else None
    out = set()
    for a in words:
        root = a
        while form[root] is not None:
            root = form[root]
        out.add((a, form[a], root, words[a], len(near[a]), words.get(form[a])))
    return out


def vocabulary(seed, size, letters="abcé÷"):
    rng, out = random.Random(seed), {}
    while len(out) < size:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
        out[w] = rng.choice([5, 6, 25, 30, 150, 800, 5000])
    return out


@pytest.mark.parametrize("bucket", [op13.BUCKET, 3])
def test_variants_equal_brute_force(rows, bucket):
    words = vocabulary(1, 700) | {"x" * 300: 40, "x" * 299: 5, "x" * 150 + "y" + "x" * 149: 7, **{"x" * k: k for k in (254, 255, 256, 257, 258)}, **{"x" * 255 + c: 9 for c in "abc"}, "x" * 256 + "d": 8, "x": 5, "é": 30}
    found = op13.spelling_variants(rows(list(words.items()), "word string, n bigint"), bucket=bucket)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(words) and set(got) == brute(words)


def test_documents_equal_brute_force(rows):
    rng, known = random.Random(2), sorted(vocabulary(3, 60, "abcdefÀé"))
    docs = []
    for i in range(60):
        text = "".join((w.upper() if rng.random() < 0.3 else w) + rng.choice([" ", "\n", "9", "_", ", ", "'"]) for w in rng.choices(known, weights=[1 / (j + 1) for j in range(60)], k=120))
        docs.append((rng.choice([i, i, None, -i]), text))
    docs += EDGE + [(77, "Straße " * 30 + "strasse STRASSe " * 5 + "×÷abcdef " * 6)]
    table = rows([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, n bigint, word string")
    for slip in (0, 3):
        want = counted(docs, slip)
        assert {r.word: r.n for r in op13.word_counts(table, slip=slip).collect()} == want and len(want) > 20
        assert {tuple(r) for r in op13.document_variants(table, slip=slip).collect()} == brute(want)
    assert op13.document_variants(table.limit(0)).count() == 0


def test_roots_follow_forms_to_the_last(rows):
    words = {"a" * 6: 5, "a" * 7: 25, "a" * 8: 125, "a" * 9: 625, "a" * 10: 3125, "ab" * 4: 4}
    got = {r.word: (r.form, r.root) for r in op13.spelling_variants(rows(list(words.items()), "word string, n bigint")).collect()}
    assert got["a" * 6] == ("a" * 7, "a" * 10) and got["a" * 9] == ("a" * 10, "a" * 10) and got["ab" * 4] == (None, "ab" * 4)


def test_long_texts_are_cut_between_words():
    text = "Abcdefgh ijklmnop-" * 500
    assert op13.text_words(1, text.encode(), size=50) == Counter({"abcdefgh": 500, "ijklmnop": 500}) == op13.text_words(1, text.encode())
    assert op13.text_words(1, b"q" * 5000, size=50) == Counter({"q" * 5000: 1})
