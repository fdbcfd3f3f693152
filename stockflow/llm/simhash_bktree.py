"""SimHash near-duplicates found with BK-trees.

A document's fingerprint has the majority bits of the hashes of its word shingles. Distinct fingerprints are
cut into blocks of bits: two of them within a radius of 2 agree on at least two of four 16-bit blocks, so they
share one of six keys of two blocks. Each key's fingerprints form a shard. A shard's BK-tree has children
keyed by their Hamming distance to the parent, and a search follows only edges within the radius.

Shard trees travel to their queries through the shuffle, not by a driver's broadcast: the fingerprints grow
with the documents. A shard with more than ``TREE_SIZE`` fingerprints is split into several trees and its
queries into blocks; every block meets every tree, in a group of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import id_key, known, per_text, staged, unused
from .components import components

RADIUS = 2
SHINGLE = 3
SEED = 42
TREE_SIZE = 4096
BLOCK_SIZE = 16 * TREE_SIZE
BLOCKS = 4
BLOCK_BITS = 64 // BLOCKS
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 15

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64 majority bits of a text's shingle hashes; 0 of a text without words."""
    parts = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not parts:
        return 0
    if len(parts) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(parts), seed)
    joined, ends = b" ".join(parts), np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate(([0], ends[:-1]))
    digest, n = xxhash.xxh64_intdigest, len(parts) - shingle + 1
    first, last = starts[:n].tolist(), (ends[shingle - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.fromiter(
            (digest(joined[a:b], seed) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK])), np.uint64
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, digest) of every row: fp as a signed 64-bit number, digest as SHA-256; null texts count as empty."""

    def run(rows):
        for key, text in rows:
            yield key, _signed(fingerprint(text, shingle)), hashlib.sha256(text.encode()).digest()

    found = per_text(docs, id_col, text_col, run, {"fp": pa.int64(), "digest": pa.binary()})
    return found.toDF("id", "fp", "digest")


class BKTree:
    """Distinct numbers under the Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Insert a value; gives its place, or that of the equal value already there."""
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return 0
        at = 0
        while distance := (self.values[at] ^ value).bit_count():
            below = self.children[at].get(distance)
            if below is None:
                self.children[at][distance] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return len(self.values) - 1
            at = below
        return at

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Places of all values at most ``radius`` bits away."""
        open_ = [0] if self.values else []
        while open_:
            at = open_.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                yield at
            for d in range(distance - radius, distance + radius + 1):
                if d in self.children[at]:
                    open_.append(self.children[at][d])


def _shard_links(values: list[int], queries: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links that join every query with all values of a tree within the radius.

    Values that already hang together need no second link, so a dense shard gives out a forest, not its pairs.
    """
    tree, parent, places = BKTree(), {}, {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for value in values:
        places[value] = tree.add(value)
    for query in queries:
        for at in tree.within(query, radius):
            a, b = root(query), root(tree.values[at])
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield query, tree.values[at]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(hi, lo): enough links between distinct fingerprints to connect all that are within the radius.

    ``fps`` has the column fp without repeats. Radii above 2 would need more blocks, and raise.
    """
    if not 0 <= radius <= BLOCKS - 2:
        raise ValueError(f"the radius must be 0 to {BLOCKS - 2}")
    mask = (1 << BLOCK_BITS) - 1
    keys = []
    for which, (i, j) in enumerate(combinations(range(BLOCKS), 2)):
        part = [F.shiftrightunsigned("fp", BLOCK_BITS * b).bitwiseAND(F.lit(mask)) for b in (i, j)]
        keys.append(F.struct(F.lit(which).alias("which"), (F.shiftleft(part[0], BLOCK_BITS) + part[1]).alias("key")))
    shards = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.which", "k.key")
    sizes = shards.groupBy("which", "key").agg(F.count("*").alias("n")).where("n > 1")
    for name, most in (("trees", TREE_SIZE), ("blocks", BLOCK_SIZE)):
        sizes = sizes.withColumn(name, F.ceil(F.col("n") / most).cast("int"))
    rows = shards.join(sizes, ["which", "key"])
    # A row is a value of its own tree, sent to every block of queries, and in its own block a query of every tree.
    tree, block = (F.pmod(F.xxhash64("fp", F.lit(n)), F.col(n)).cast("int") for n in ("trees", "blocks"))
    as_value = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda b: F.struct(tree.alias("tree"), b.alias("block"), F.lit(True).alias("is_value")),
    )
    as_query = F.transform(
        F.sequence(F.lit(0), F.col("trees") - 1),
        lambda t: F.struct(t.alias("tree"), block.alias("block"), F.lit(False).alias("is_value")),
    )
    rows = rows.select("which", "key", "fp", F.explode(F.concat(as_value, as_query)).alias("to"))
    rows = rows.select("which", "key", "to.tree", "to.block", "fp", "to.is_value")

    def search(group: pa.Table) -> pa.Table:
        # Sorted, so that a repeated task builds the same tree.
        by_role = {True: [], False: []}
        for value, is_value in sorted(zip(group["fp"].to_pylist(), group["is_value"].to_pylist(), strict=True)):
            by_role[is_value].append(value & (2**64 - 1))
        found = [(_signed(a), _signed(b)) for a, b in _shard_links(by_role[True], by_role[False], radius)]
        return pa.table({"hi": pa.array([max(x) for x in found], pa.int64()), "lo": pa.array([min(x) for x in found], pa.int64())})

    return rows.groupBy("which", "key", "tree", "block").applyInArrow(search, "hi bigint, lo bigint")


def _rooted(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints by row, and (fp, least_id, root) by distinct fingerprint."""
    prints = staged(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min("id").alias("least_id")), "distinct-fingerprints")
    reached = staged(components(links(distinct.select("fp"), radius)), "components")
    roots = distinct.join(reached, distinct["fp"] == reached["node"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    return prints, staged(roots, "roots")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (least id reachable).

    Texts without words have the fingerprint zero and are linked like any other. A null id stands for a
    component only if it has no other; repeated rows get equal results.
    """
    prints, roots = _rooted(docs, id_col, text_col, shingle, radius)
    least = staged(roots.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    classes = staged(roots.join(least, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """The row with the least id of each group, with all its columns; of equal ids the text with the least digest.

    Representatives meet the rows by id and digest, which spreads a large group over all tasks. Of rows
    repeated with the same id and text, one stays.
    """
    prints, roots = _rooted(docs, id_col, text_col, shingle, radius)
    first = F.struct(F.col("id").isNull(), F.col("id").alias("id"), F.col("digest").alias("digest"))
    # By fingerprint first: copies then leave their tasks as one row.
    firsts = staged(prints.groupBy("fp").agg(F.min(first).alias("first")), "firsts")
    stay = firsts.join(roots.select("fp", "root"), "fp").groupBy("root").agg(F.min("first").alias("first"))
    key, digest = unused(docs, "id_key", "digest")
    stay = stay.select(id_key("first.id").alias(key), F.col("first.digest").alias(digest))
    rows = docs.withColumn(key, id_key(id_col)).withColumn(digest, F.unhex(F.sha2(known(F.col(text_col)), 256)))
    return rows.join(stay, [key, digest], "left_semi").dropDuplicates([key, digest]).select(*docs.columns)
