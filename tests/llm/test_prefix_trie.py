"""The trie of conversation prefixes against one that is built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import op12_prefix_trie as op12

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, n_convs int"


def in_order(turns):
    """Turns by conversation, from (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            by[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(ts)] for c, ts in by.items()}


def with_heads(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, cs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[: len(x)] == x and len(y) == len(x) + 1 for y in below)]
        saved = sum((len(members[x]) - 1) * (len(x[-1][1]) if x else 0) for x in below)
        ends = ",".join(str(c) for c in cs if len(convs[c]) == len(node))
        out.append((cs[0], len(node), members[node[:-1]][0] if node else None, len(cs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, n):
    rng, out = random.Random(seed), []
    for i in range(n):
        c = rng.choice([i, 100 * (i % 7), 1000 + i])
        for t in range(rng.randint(0, 7)):
            out.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None, ""]) if rng.random() < 0.2 else ["user", "assistant"][t % 2], rng.choice(["a", "b", "é日", None])))
    out += [(2000 + i, t, "user", "same") for i in range(40) for t in range(3)]  # a hot path
    out += [(3000, t, "user", "x" * (t % 3)) for t in range(40)] + [(3001, t, "user", "x" * (t % 3)) for t in range(32)] + [(3002, t, "user", "x" * (t % 3)) for t in range(16)]
    out += [(None, 1, "user", "no id"), (5, 0, "user", "twice"), (5, 0, "user", "twice"), (777, 0, "user", "only one")]
    return out


@pytest.mark.parametrize(("shard", "band"), [(op12.SHARD, op12.BAND), (7, 8), (1, 1)])
def test_trie_equals_brute_force(rows, shard, band):
    data = made(shard, 60)
    table = rows([(*r, "clash", 1) for r in data], SCHEMA)
    convs = in_order(data)
    found = op12.conversation_trie(table, shard, band)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(convs)
    turns, ids = op12.with_shared_heads(op12.ordered_turns(table))
    shared = op12.prefix_trie(turns, ids, shard, band)
    want = brute(with_heads(convs))
    assert sorted((tuple(r) for r in shared.collect()), key=str) == want
    assert any(not t for t in with_heads(convs).values())  # turnless ones are members of the root


def test_no_conversations(rows):
    assert op12.conversation_trie(rows([], SCHEMA)).count() == 0
    only = rows([(13, None, None, None, None, None)], SCHEMA)
    assert [tuple(r)[:7] for r in op12.conversation_trie(only).orderBy("depth").collect()] == [(13, 0, None, 1, 1, 1, 0), (13, 1, 13, 1, 0, 1, 0)]
