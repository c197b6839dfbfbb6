"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position of a fingerprint gets a nonzero code of radius + 1 bits. For
each nonzero vector v of as many bits, one mask keeps the positions whose code
has an odd product with v. Two fingerprints that differ in at most ``radius``
positions agree under some mask: that few codes leave a nonzero v with an even
product with all of them. So 2**(radius + 1) - 1 tables find every pair.

Equal fingerprints are one node from the start. A bucket gives the links of a
spanning forest of its nodes, not its pairs. A bucket of too many nodes is cut
again by masks over the bits that its key leaves open; after a few cuts so few
bits are open that no bucket of distinct fingerprints can be too large.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, id_text, utf8_buffer, written

BITS = 64
#: Nodes of a bucket that one call compares.
BUCKET = 4096
#: Stands in for the id of fingerprints that only rows without an id have.
NO_ID = 1 << 62


def covering_masks(radius: int, positions: list[int], turn: int = 0) -> list[int]:
    """The masks over these bit positions."""
    codes = (1 << (radius + 1)) - 1
    code = {p: 1 + (i + turn) % codes for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (code[p] & v).bit_count() % 2) for v in range(1, codes + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the 64-bit fingerprint (as a signed long) of every whole text; null or no words: zero."""
    lower = ASCII_LOWER.tobytes()

    def run(batches):
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            data, offsets = utf8_buffer(batch.column(1))
            raw, out = data.tobytes(), np.zeros(len(offsets) - 1, np.uint64)
            ends, at = offsets.tolist(), 0
            while at < len(out):
                hashes, begins, rows, first = [], [], [], at
                while at < len(out) and (at == first or len(hashes) < 200_000):
                    words = raw[ends[at] : ends[at + 1]].translate(lower).split()
                    if words:
                        begins.append(len(hashes))
                        rows.append(at)
                        if len(words) < shingle:
                            hashes.append(digest(b" ".join(words), seed))
                        else:
                            hashes += [digest(x, seed) for x in map(b" ".join, zip(*[words[k:] for k in range(shingle)]))]
                    at += 1
                if rows:
                    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
                    ones = np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
                    counts = np.diff([*begins, len(hashes)])
                    out[rows] = np.packbits(2 * ones > counts[:, None], axis=1).view(">u8").ravel()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64), pa.int64())], names=["doc_id", "fp"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def forest(values: np.ndarray, nodes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect just what pairs within the radius connect."""
    links, rest = [], np.arange(len(values))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            near = np.bitwise_count(values[rest] ^ values[i]) <= radius
            if near.any():
                found = rest[near]
                links += [(int(nodes[i]), int(nodes[j])) for j in found]
                queue += found.tolist()
                rest = rest[~near]
    return links


def near_links(nodes: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """a, b: links between the nodes (node, fp: distinct fingerprints) that connect what lies within the radius."""

    def compare(batches):
        for batch in batches:
            out = []
            for members in batch.column(0).to_pylist():
                out += forest(np.array([m["fp"] for m in members], np.int64).view(np.uint64), np.array([m["node"] for m in members]), radius)
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    found = None
    # each level: the rows still to be dealt, with the bits that their bucket has fixed
    level = nodes.select("node", "fp", F.lit(0).cast("long").alias("fixed"), F.lit(0).cast("long").alias("bucket"))
    open_masks = [0]
    for depth in range(3):
        masks = {fixed: [fixed | m for m in covering_masks(radius, [p for p in range(BITS) if not fixed >> p & 1], depth)] for fixed in open_masks}
        table = F.create_map(*[x for fixed, ms in masks.items() for x in (F.lit(signed(fixed)), F.array(*[F.lit(signed(m)) for m in ms]))])
        dealt = level.withColumn("mask", F.explode(table[F.col("fixed")])).select("node", "fp", F.col("mask").alias("fixed"), F.xxhash64("bucket", "mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"))
        sizes = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        if depth < 2:
            # few buckets have company; only their rows go on
            shared = written(dealt.join(sizes, "bucket"), narrow=True)
            large = shared.where(F.col("n") > bucket)
            small = shared.where(F.col("n") <= bucket)
        else:
            small, large = dealt.join(sizes, "bucket"), None
        lists = small.groupBy("bucket").agg(F.collect_list(F.struct("node", "fp")).alias("members")).select("members")
        links = lists.mapInArrow(compare, "a long, b long")
        found = links if found is None else found.unionByName(links)
        if large is None or large.isEmpty():
            break
        level, open_masks = large.drop("n"), sorted({m for ms in masks.values() for m in ms})
    return found.distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node it is connected to) for every node that has a link: large and small stars in turn.

    Each round keeps the edges in a table in the shared folder; minima are pre-aggregated, so a hub is no hot key.
    """

    def both_ways(edges: DataFrame) -> DataFrame:
        return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def tangled(edges: DataFrame) -> bool:
        """Whether a node with a smaller neighbour has another neighbour too: in a star no leaf has."""
        found = both_ways(edges).groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).where("m < u AND n > 1")
        return found.agg(F.count("*")).first()[0] > 0

    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), narrow=True)
    while tangled(edges):
        both = both_ways(edges)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        stars = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = stars.groupBy("u").agg(F.min("v").alias("m"))
        edges = stars.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = written(edges, narrow=True)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest id linked, over any number of links.

    Two rows are linked if their fingerprints differ in at most ``radius`` bits. One row for each row of ``docs``:
    repeated rows and rows without an id keep theirs (component_id is null if no row of the component has an id); rows
    without words have fingerprint zero and are linked like any other. An empty table gives no rows. Ids must be below
    2**62. Other columns are not read.
    """
    own = written(fingerprints(docs, shingle, id_col=id_col, text_col=text_col))
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("least")).select("fp", F.coalesce("least", F.lit(NO_ID).bitwiseOR(F.col("fp").bitwiseAND(F.lit(NO_ID - 1)))).alias("node"))
    nodes = written(nodes)
    roots = components(near_links(nodes, radius, bucket))
    of = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    named = F.when(F.col("component_id") < NO_ID, F.col("component_id"))
    return own.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), named.alias("component_id"))


def one_of_each_group(docs: DataFrame, radius: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the first of their component; a row without an id stays."""
    found = near_duplicates(docs, radius, shingle, id_col, text_col)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_kept")).distinct()
    key = docs[id_col]
    return docs.join(kept, key == F.col("_kept"), "left_semi").unionByName(docs.where(key.isNull()))
