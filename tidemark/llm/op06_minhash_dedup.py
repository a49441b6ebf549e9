"""Near-duplicate documents by one-permutation hashing.

1. Each text's set of word shingles is hashed once; one permutation splits the
   hash space into bins and each bin keeps its least value. An empty bin takes
   the value of the first non-empty bin in a random order of its own (optimal
   densification), so bins agree with probability equal to the similarity even
   for the smallest sets.
2. Texts with the same set are one class from here on.
3. Bins are banded; each band's bucket offers star-shaped candidates only: its
   members against one centre, the member met most often over all buckets. The
   number of candidates is linear in the number of classes.
4. Candidates are confirmed on full sets, and the confirmed links' components
   are taken.
5. What a star can't see is handled exactly. For two members a, b of one bucket
   with centre c, write M for what c has and they lack and D for what they have
   and c lacks. They share |c| - |Ma| - |Mb| + |Ma & Mb| + |Da & Db| shingles, so
   a link needs a number of common differences that follows from the sizes and
   the counts of step 4. Members of different components are joined on their
   differences from the centre, rarest first, on as many as that number can't
   do without: copies edited each in its own way meet nowhere.
   Steps 4 and 5 repeat until no unseen pair is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, if_small, tidy, written
from .components import components
from .shingles import mix, odd_numbers, row_shingles
from .tokenizing import text_slices

BANDS = 32
#: Bytes of text hashed at a time.
HASHED_BYTES = 2 << 20
#: The chance that a link exactly at the threshold meets in no band stays below this.
MISS = 1e-7


def rows_per_band(threshold: float) -> int:
    """The most rows per band that keep MISS."""
    return max([r for r in range(1, 9) if (1 - threshold**r) ** BANDS <= MISS], default=1)


class Signer:
    """Band hashes of a shingle set."""

    def __init__(self, rows: int):
        self.bins, self.rows = BANDS * rows, rows
        rng = np.random.default_rng(20240229)
        self.orders = np.stack([rng.permutation(self.bins) for _ in range(self.bins)])
        self.weights = odd_numbers(11, rows)
        self.salts = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))

    def bands(self, unique: np.ndarray) -> np.ndarray:
        """One signed 64-bit hash per band of a sorted, non-empty set."""
        bin_of = ((unique >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)
        first = np.searchsorted(bin_of, np.arange(self.bins, dtype=np.uint64))
        first[first == len(unique)] = 0
        values = unique[first]
        full = bin_of[first] == np.arange(self.bins, dtype=np.uint64)
        empty = np.flatnonzero(~full)
        if len(empty):
            order = self.orders[empty]
            values[empty] = values[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
        grouped = (values.reshape(BANDS, self.rows) * self.weights).sum(axis=1, dtype=np.uint64)
        return mix(grouped + self.salts).view(np.int64)


def signatures(docs: DataFrame, k: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_id (128-bit digest of the set, null if empty), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(rows)
        for batch in batches:
            for part in text_slices(batch, 1, HASHED_BYTES):
                flat, at = row_shingles(part.column(1), k)
                sizes, ids, bands = [], [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    unique = np.unique(flat[a:b])
                    sizes.append(len(unique))
                    ids.append(xxhash.xxh3_128_digest(unique.tobytes()) if len(unique) else None)
                    bands.append(signer.bands(unique) if len(unique) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_id", "bands"])

    rows_in = id_and_text(docs).select("doc_id", F.col("text").cast("binary"))
    return rows_in.mapInArrow(tidy(run), "doc_id long, n_shingles long, set_id binary, bands array<long>")


def shingle_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, shingles (sorted distinct hashes) of the documents named in nodes(node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1, HASHED_BYTES):  # sets are as large as their texts: hand them on in small batches
                flat, at = row_shingles(part.column(1), k)
                sets = [np.unique(flat[a:b]).view(np.int64) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    wanted = id_and_text(docs).join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    return wanted.select("doc_id", F.col("text").cast("binary")).mapInArrow(tidy(run), "node long, shingles array<long>")


def _similar(common: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * common >= percent * (a + b - common)


def _sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


#: Rows of one node that meet one copy of its set; a node with more (a centre) has its set copied.
SPREAD = 500


def with_sets(rows: DataFrame, counted: DataFrame, sets: DataFrame, node: str, name: str, spread: int) -> DataFrame:
    """`rows` with the set of `node` as `name`: rows of a hot node are dealt to as many tasks as there are copies of its set, one for each `spread` rows.

    counted: the same rows as they are written, to find hot nodes in.
    """
    each = counted.groupBy(node).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > spread)
    hot = written(each.select(node, F.ceil(F.col("rows") / spread).cast("int").alias("copies")), "hot")
    n = hot.count()
    held = sets.select(F.col("node").alias(node), F.col("shingles").alias(name))
    if not n:
        return rows.join(held, node)
    hot = if_small(hot, n)
    salt = F.when(F.col("copies").isNull(), 0).otherwise(F.pmod(F.xxhash64(*[c for c in rows.columns if c in ("a", "b", "node", "centre")]), F.col("copies"))).cast("int")
    dealt = rows.join(hot, node, "left").withColumn("salt", salt).drop("copies")
    copied = held.join(hot, node, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("copies") - 1, F.lit(0))))).drop("copies")
    return dealt.join(copied, [node, "salt"]).drop("salt")


def verified(sets: DataFrame, pairs: DataFrame, spread: int = SPREAD) -> DataFrame:
    """a, b, na, nb, common for pairs (a, b): the sizes of both full sets and of what they share."""
    both = with_sets(with_sets(pairs.select("a", "b"), pairs, sets, "a", "sa", spread), pairs, sets, "b", "sb", spread)
    return both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, spread: int = SPREAD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased;
    a set holds the distinct k-word shingles, or the whole sequence if there are
    fewer words. Documents whose sets have |A & B| * 100 >= percent * |A | B|
    are linked; component_id is the smallest doc_id reachable and kept says
    that it is the document's own. A null, empty or blank text has no shingles
    and is linked with nothing. Rows that repeat a doc_id are one document.
    A row without doc_id keeps its n_shingles, has a null component_id and is
    not kept. Other columns are left out; an empty table gives no rows.
    """
    rows = rows_per_band(percent / 100)
    signed = written(signatures(docs, k, rows), "signatures")
    real = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = written(real.groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    in_band = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = in_band.groupBy("bucket").agg(F.count(F.lit(1)).alias("met"), F.min("node").alias("low"), F.max("node").alias("high")).filter("met > 1 AND low < high").select("bucket", "met")
    members = written(in_band.join(shared, "bucket"), "members")

    weight = members.groupBy("node").agg(F.sum("met").alias("weight"))
    centres = members.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"), "n")).alias("best"))
    centres = centres.select("bucket", (-F.col("best.minus")).alias("centre"), F.col("best.n").alias("n_centre"))
    spokes = written(members.join(centres, "bucket").filter(F.col("node") != F.col("centre")), "spokes")
    pairs = written(spokes.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), "pairs")
    sets = written(shingle_sets(docs, weight.select("node"), k), "sets")
    same_id = real.join(classes.select("set_id", "node"), "set_id").filter("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))

    seen = None
    while True:  # each round verifies pairs not seen before, of which there are only so many
        found = written(verified(sets, pairs, spread), "verified")
        seen = found if seen is None else written(seen.unionByName(found), "seen")
        links = seen.filter(_similar(F.col("common"), F.col("na"), F.col("nb"), percent)).select(F.col("a").alias("u"), F.col("b").alias("v"))
        reached = written(components(links), "components")
        pairs = written(_unseen(sets, spokes, reached, seen, percent, spread), "pairs")
        if pairs.isEmpty():
            break
    # Rows that repeat a doc_id with another text join their classes; a copy's link to its class changes nothing else.
    repeated = real.select("doc_id", "set_id").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    if not repeated.isEmpty():
        links = links.unionByName(same_id)
        reached = written(components(links), "components")
    named = classes.select("set_id", "node").join(reached, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    full = real.select("doc_id", "n_shingles", "set_id").join(named, "set_id").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    bare = signed.filter("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(bare).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _unseen(sets: DataFrame, spokes: DataFrame, reached: DataFrame, seen: DataFrame, percent: int, spread: int) -> DataFrame:
    """Pairs around one centre that are in different components, may be links and haven't been verified."""
    q = percent / (100 + percent)
    placed = spokes.select("node", "centre").distinct().join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    torn = placed.groupBy("centre").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("centre")
    known = seen.select(F.col("a").alias("node"), F.col("b").alias("centre"), F.col("na").alias("n"), F.col("nb").alias("n_centre"), "common")
    known = known.unionByName(seen.select(F.col("b").alias("node"), F.col("a").alias("centre"), F.col("nb").alias("n"), F.col("na").alias("n_centre"), "common"))
    placed = placed.join(torn, "centre").join(known, ["node", "centre"])
    lacks, adds = F.col("n_centre") - F.col("common"), F.col("n") - F.col("common")
    short = q * (F.col("n") + F.col("n_centre")) - F.col("common")  # shingles a link with the centre is short of
    # Common differences that any link to another component needs at least; one of the two is not linked to the centre.
    need = F.greatest(F.lit(1), F.ceil(F.when(short <= 0, q * adds + (1 - q) * lacks).otherwise(short / (1 - q)) - 1e-9))
    placed = placed.select("centre", "node", "component", "n", "n_centre", lacks.alias("lacks"), adds.alias("adds"), short.alias("short"), (lacks + adds - need + 1).cast("int").alias("most"))
    placed = written(placed.filter("most > 0"), "placed")
    pairs = with_sets(placed.join(sets.select("node", "shingles"), "node"), placed, sets, "centre", "of_centre", spread)
    sides = [F.transform(F.array_except(x, y), lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("s"))) for kind, x, y in ((0, "of_centre", "shingles"), (1, "shingles", "of_centre"))]
    each = written(pairs.select("centre", "node", F.explode(F.concat(*sides)).alias("x")).select("centre", "node", "x.*"), "differences")
    held = each.groupBy("centre", "kind", "s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # A member's own differences come first in its order and take up places, though no other member can meet them.
    alone = F.col("most") - (F.col("lacks") + F.col("adds") - F.size("x")).cast("int")
    listed = each.join(held, ["centre", "kind", "s"]).groupBy("centre", "node").agg(F.sort_array(F.collect_list(F.struct("df", "kind", "s"))).alias("x"))
    prefix = listed.join(placed, ["centre", "node"]).withColumn("take", alone).filter("take > 0").select("centre", "node", "component", "n", "n_centre", "lacks", "adds", "short", F.size("x").alias("of"), F.posexplode(F.slice("x", F.lit(1), F.col("take"))).alias("at", "x"))
    prefix = written(prefix.select("centre", "x.kind", "x.s", "node", "component", "n", "n_centre", "lacks", "adds", "short", (F.col("of") - F.col("at")).alias("left")), "prefix")
    mixed = prefix.groupBy("centre", "kind", "s").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("centre", "kind", "s")
    prefix = prefix.join(mixed, ["centre", "kind", "s"])
    other = prefix.select("centre", "kind", "s", *[F.col(c).alias(f"{c}_b") for c in ("node", "component", "n", "lacks", "adds", "short", "left")])
    needed = F.col("short") + F.col("short_b") + F.col("n_centre") * (1 - 2 * q)
    can = F.least(F.least("lacks", "lacks_b") + F.least("adds", "adds_b"), "left", "left_b") >= needed - 1e-9  # at their first meeting, what is left of either list bounds the rest
    met = prefix.join(other, ["centre", "kind", "s"]).filter((F.col("component") < F.col("component_b")) & _sizes_allow(F.col("n"), F.col("n_b"), percent) & can)
    return met.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct().join(seen.select("a", "b"), ["a", "b"], "left_anti")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents of which each group keeps the one with the smallest doc_id, with their own columns.

    Documents without doc_id or without words are in no group and stay, as do
    all rows of a kept doc_id; an empty table stays empty.
    """
    gone = written(near_duplicates(docs, k, percent).filter(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "gone")
    return docs.join(if_small(gone), "doc_id", "left_anti").select(docs.columns)
