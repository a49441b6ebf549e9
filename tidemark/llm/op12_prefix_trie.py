"""A trie of conversation prefixes from vertical bitmaps.

A node is a distinct sequence of first turns; its members are the conversations
that start with it. Conversations are numbered by id and dealt to shards of a
fixed number. Within a shard each (position, turn) has a bitset of the
conversations that hold it. From the root's bitset a depth-first walk goes on:
the first member of what is left names a turn, and the intersection with that
turn's bitset is a child; popcounts are its members, and those without a
further turn end there. Shards' nodes are then added up by node.

A node is known by the sums of two hashes of its (position, turn) pairs, which
add up in any grouping, so a very long conversation is walked in bands of
positions: a band begins with the sums of the turns before it.

Sums over a node's subtree need no walk from the leaves. A node belongs to its
smallest member, so a conversation owns the nodes from some depth on. What
stands below a node is, over its members, the text that follows, and each node
below once is what its members own of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.operators import scan

from .common import if_small, written

#: Conversations of a shard and turns of a band: bounds what a task holds.
SHARD, BAND = 512, 256
_KEY = ["key1", "key2"]
_MASK = (1 << 64) - 1
_NOTHING = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at, digest, chars: the turns of every conversation by turn (null first), then role and text, numbered from 0.

    A null role or text is empty; a row that repeats another is a turn of its
    own; rows without conv_id are left out, and so are other columns. Equal
    digests (128 bits of SHA-256) are taken for equal turns.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")
    rows = rows.withColumn("digest", F.unhex(F.substring(F.sha2(whole, 256), 1, 32))).withColumn("chars", F.length("text").cast("long"))
    return scan.positions(rows, ["conv_id"], [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")], keep=["conv_id", "digest", "chars"], tag="turns")


def with_shared_heads(ordered: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each conversation c after the first h turns of c - c % every, without its own first h; h is the CRC-32 of c in decimals, modulo `most`.

    turns has conv_id, depth (from 1), digest, chars; conversations has every conv_id, with or without turns.
    """
    ordered = written(ordered, "ordered")
    c, h = F.col("conv_id"), F.col("h")
    heads = ordered.filter((c % every == 0) & (F.col("at") < most - 1)).groupBy(c.alias("head")).agg(F.sort_array(F.collect_list(F.struct("at", "digest", "chars"))).alias("first"))
    each = ordered.filter("at = 0").select("conv_id", F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(most)).cast("int").alias("h"), (c - c % every).alias("head"))
    each = each.join(heads, "head", "left").select("conv_id", "h", F.coalesce(F.slice("first", F.lit(1), h), F.array()).alias("first"))
    each = written(each, "heads")
    shared = each.select("conv_id", F.posexplode("first").alias("depth", "t")).select("conv_id", (F.col("depth") + 1).cast("long").alias("depth"), "t.digest", "t.chars")
    known = if_small(each.select("conv_id", "h", F.size("first").alias("shared")), each.count())
    own = ordered.join(known, "conv_id").filter(F.col("at") >= h).select("conv_id", (F.col("at") - h + F.col("shared") + 1).alias("depth"), "digest", "chars")
    return shared.unionByName(own), each.select("conv_id")


def _parts(turns: DataFrame, conversations: DataFrame, shard: int, band: int) -> DataFrame:
    """A row per conversation and band of its turns: shard, band, conv_id, turns; the sums of hashes before it, the characters after it, and whether it is the last."""
    numbered = scan.positions(conversations, [], [F.asc("conv_id")], tag="shards").select("conv_id", F.expr(f"at div {shard}").alias("shard"))
    hashed = F.struct("depth", F.xxhash64("digest", "depth").alias("k1"), F.xxhash64("depth", "digest", F.lit(1)).alias("k2"), "chars")
    held = turns.groupBy("conv_id", F.expr(f"(depth - 1) div {band}").alias("band")).agg(F.sort_array(F.collect_list(hashed)).alias("turns"))  # at most `band` turns
    rows = numbered.join(held, "conv_id", "left").withColumn("band", F.coalesce("band", F.lit(0).cast("long"))).withColumn("turns", F.coalesce("turns", F.array()))
    total = lambda f, kind: F.aggregate("turns", F.lit(0).cast(kind), lambda acc, t: (acc + t[f]).cast(kind))
    wide = "decimal(38,0)"
    rows = rows.withColumn("s1", total("k1", wide)).withColumn("s2", total("k2", wide)).withColumn("s3", total("chars", "long"))
    along = Window.partitionBy("conv_id").orderBy("band")
    before, after = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    sums = [F.coalesce(F.sum(s).over(before), F.lit(0)).cast(wide).alias(name) for s, name in (("s1", "entry1"), ("s2", "entry2"))]
    return rows.select("shard", "band", "conv_id", "turns", *sums, F.coalesce(F.sum("s3").over(after), F.lit(0)).alias("chars_after"), F.lead("band").over(along).isNull().alias("last"))


def bits_of(bits: int) -> Iterator[int]:
    """The places of a bitset's members, the smallest first."""
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def walk(parts: list[dict], band: int) -> Iterator[tuple]:
    """(key, parent's key or None, depth, members, place in the band, members that end there) of every node of one shard and band, parents first.

    parts: rows of _parts in the order of conv_id; members are bitsets of places in that list.
    """
    postings: dict[tuple[int, int], int] = {}
    ended, entries = [0] * (band + 1), {}
    for i, p in enumerate(parts):
        bit = 1 << i
        for t in p["turns"]:
            postings[t["k1"], t["k2"]] = postings.get((t["k1"], t["k2"]), 0) | bit
        if p["last"]:
            ended[len(p["turns"])] |= bit
        entry = int(p["entry1"]), int(p["entry2"])
        entries[entry] = entries.get(entry, 0) | bit
    base = parts[0]["band"] * band
    stack = [(key, None, 0, bits) for key, bits in entries.items()]
    while stack:
        key, parent, j, bits = stack.pop()
        ends = bits & ended[j]
        if j or not base:  # a later band's entries were nodes of the band before it
            yield key, parent, base + j, bits, j, ends
        left = bits ^ ends if j < band else 0
        while left:
            t = parts[(left & -left).bit_length() - 1]["turns"][j]
            child = left & postings[t["k1"], t["k2"]]
            left ^= child
            stack.append(((key[0] + t["k1"], key[1] + t["k2"]), key, j + 1, child))


def _signed(n: int) -> int:
    """A sum as a 64-bit value."""
    n &= _MASK
    return n - (1 << 64) if n >> 63 else n


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * len(schema), schema, strict=True)], schema=schema)


def _in_order(group: pa.Table) -> list[dict]:
    return group.sort_by("conv_id").to_pylist()


_LONG = pa.int64()
_NODE = pa.schema([("key1", _LONG), ("key2", _LONG), ("parent1", _LONG), ("parent2", _LONG), ("depth", _LONG), ("chars", _LONG), ("n_convs", _LONG), ("conv_id", _LONG), ("shard", _LONG), ("ends", pa.list_(_LONG))])
_SUMS = pa.schema([("key1", _LONG), ("key2", _LONG), ("n_leaves", _LONG), ("saved_tokens", _LONG)])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'array<long>' if pa.types.is_list(f.type) else 'long'}" for f in schema)


def _shard_nodes(parts: DataFrame, band: int) -> DataFrame:
    """Every shard's nodes, with the conversations that end there in order."""

    def run(group: pa.Table) -> pa.Table:
        own, rows = _in_order(group), []
        for key, parent, depth, bits, j, ends in walk(own, band):
            first = own[(bits & -bits).bit_length() - 1]
            chars = first["turns"][j - 1]["chars"] if j else 0
            above = (None, None) if parent is None else map(_signed, parent)
            rows.append((*map(_signed, key), *above, depth, chars, bits.bit_count(), first["conv_id"], first["shard"], [own[i]["conv_id"] for i in bits_of(ends)]))
        return _table(rows, _NODE)

    return parts.groupBy("shard", "band").applyInArrow(run, _ddl(_NODE))


def _shard_sums(parts: DataFrame, band: int) -> DataFrame:
    """Every shard's share of the sums over nodes' subtrees; parts also have owned_from, owned_chars (both null: owns no node) and leaf."""

    def run(group: pa.Table) -> pa.Table:
        own, rows, follow = _in_order(group), [], []
        for p in own:
            after = [p["chars_after"]]
            for t in reversed(p["turns"]):
                after.append(after[-1] + t["chars"])
            follow.append(after[::-1])
        for key, _, depth, bits, j, _ in walk(own, band):
            leaves = saved = 0
            for i in bits_of(bits):
                p = own[i]
                leaves += bool(p["leaf"])
                if p["owned_from"] is None or depth <= p["owned_from"]:
                    saved += follow[i][max(j - 1, 0)] - (p["owned_chars"] or 0)
            rows.append((*map(_signed, key), leaves, saved))
        return _table(rows, _SUMS)

    return parts.groupBy("shard", "band").applyInArrow(run, _ddl(_SUMS)).groupBy(*_KEY).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def _end_digests(nodes: DataFrame) -> DataFrame:
    """key1, key2, ends_sha256 of the nodes where conversations end. A digest is a chain, so a node's ids go through one task, a shard's list after the other; none is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            done = []
            for k1, k2, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (k1, k2):
                    if at is not None:
                        done.append((*at, digest.hexdigest()))
                    at, digest = (k1, k2), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(",".join(map(str, ends)).encode())
            yield _digests(done)
        if at is not None:
            yield _digests([(*at, digest.hexdigest())])

    def _digests(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (_LONG, _LONG, pa.string()), strict=True)], [*_KEY, "ends_sha256"])

    rows = nodes.filter("size(ends) > 0").repartition(*_KEY).sortWithinPartitions(*_KEY, "shard").select(*_KEY, "ends")
    return rows.mapInArrow(run, "key1 long, key2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame, shard: int = SHARD, band: int = BAND) -> DataFrame:
    """A row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns has conv_id, depth (from 1, without gaps), digest, chars; conversations
    has each conv_id once, with or without turns. n_leaves counts nodes without
    children in the subtree, saved_tokens sums (n_convs - 1) * chars over it, and
    ends_sha256 is of the ids of the members that have no further turn, rising
    and joined by commas. The root has no parent; without conversations there is no row.
    """
    parts = written(_parts(turns, conversations, shard, band), "parts")
    found = written(_shard_nodes(parts, band), "shard-nodes")
    same = [F.min(c).alias(c) for c in ("parent1", "parent2", "depth", "chars", "conv_id")]
    nodes = found.groupBy(*_KEY).agg(F.sum("n_convs").alias("n_convs"), *same)
    nodes = written(nodes, "nodes")
    children = nodes.filter("parent1 IS NOT NULL").groupBy(F.col("parent1").alias("key1"), F.col("parent2").alias("key2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("owned_from"), F.sum("chars").alias("owned_chars"), F.bool_or(F.col("n_children") == 0).alias("leaf"))
    sums = _shard_sums(parts.join(owned, "conv_id", "left"), band)
    above = nodes.select(F.col("key1").alias("parent1"), F.col("key2").alias("parent2"), F.col("conv_id").alias("parent_conv_id"))
    rows = nodes.join(above, ["parent1", "parent2"], "left").join(sums, _KEY).join(_end_digests(found), _KEY, "left")
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, shard: int = SHARD, band: int = BAND) -> DataFrame:
    """prefix_trie of conversations as they are (conv_id, turn, role, text)."""
    ordered = written(ordered_turns(conversations), "ordered")
    turns = ordered.select("conv_id", (F.col("at") + 1).alias("depth"), "digest", "chars")
    return prefix_trie(turns, ordered.filter("at = 0").select("conv_id"), shard, band)
