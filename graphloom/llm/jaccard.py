"""The SimHash near-duplicate search completed to a Jaccard similarity of word shingles.

Covering tables of SimHash fingerprints of the same shingles (see simhash) come
first: what they find within the radius is compared exactly, and what is similar
is linked, which connects most of a group of close copies at once. A similarity of
0.8 leaves fingerprints about ten bits apart, which no covering of feasible size
guarantees; the rest is found as follows, so that no pair is lost.

Sets of a similarity of at least t share one of the first n - ceil(t n) + 1 of
their n members, in any order that is the same for all sets. Members go in the
order of their frequency in the corpus, so that these prefixes hold few members
that other sets have; only those meet. What meets is compared exactly, so every
pair is found and no other.

Equal sets are one node from the start. The members of a bucket (of the sets that
meet in one shingle) stand in a random order, and the rest is compared with a few of
them at a time: the first, then the next seven, and so on, eight times as many each
time, until a bucket has no more. Sets that are connected by then are not compared, so
a large group is one node after a few comparisons a set, and what is left over has few
that it meets and is not connected to; but every pair has its turn.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Blocks, cut_by_bucket, pack, pack_counts, unpack, unpack_counts
from .common import ASCII_LOWER, NOT_BLANK, chunks_of, files_removed, id_text, mix, narrow_files, span_hashes, utf8_buffer, word_spans, written
from .simhash import NO_ID, components, fingerprints
from .simhash import near_links as near_fingerprints

SHINGLE = 5
#: The least similarity, as a fraction of whole numbers.
LEAST = (4, 5)
#: So many times as many of a bucket are compared with in each round as in all before.
GROWTH = 8
#: Bits that fingerprints of the covering tables may differ in.
RADIUS = 3
#: Text of a block, and text whose shingles one bucket answers for. Shingles take a third more than their text and are one row
#: a block, of which an executor holds several copies at once.
BLOCK_BYTES, BUCKET_BYTES = 2 << 20, 12 << 20


def shingle_sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of every text end to end, and where each text's begin; fewer words are one shingle."""
    data, offsets = utf8_buffer(column)
    n = len(offsets) - 1
    sets, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in chunks_of(offsets, 1 << 19):
        part, own = ASCII_LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends, rows = word_spans(part, own, NOT_BLANK)
        words = span_hashes(part, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        count = np.bincount(rows, minlength=j - i)
        first = np.cumsum(count) - count
        # a shingle begins at each word but the last few of a text, or at the first
        place = np.arange(len(words)) - first[rows]
        begin = np.flatnonzero((place == 0) | (place + shingle <= count[rows]))
        h = np.zeros(len(begin), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(shingle):
                inside = place[begin] + k < count[rows[begin]]
                h = mix(h ^ np.where(inside, words[np.minimum(begin + k, len(words) - 1)], np.uint64(0))) + np.uint64(k + 1)
        order = np.lexsort((h, rows[begin]))
        h, row = h[order], rows[begin][order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        sets.append(h[new])
        sizes.append(np.bincount(row[new], minlength=j - i))
    return np.concatenate(sets), np.append(0, np.cumsum(np.concatenate(sizes))).astype(np.int64)[: n + 1]


def with_digest(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, digest of the set of shingles, text."""

    def run(batches):
        for batch in batches:
            sets, at = shingle_sets(batch.column(1), shingle)
            at = at.tolist()
            digest = [xxhash.xxh3_128_digest(sets[i:j].tobytes()) for i, j in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), batch.column(1)], names=["doc_id", "digest", "text"])

    return docs.mapInArrow(run, "doc_id long, digest binary, text string")


def _state(shingle: int):
    def run(docs: pa.Table) -> bytes:
        sets, at = shingle_sets(docs.column("text").combine_chunks(), shingle)
        return pack(docs.column("doc_id").to_numpy(), sets, at)

    return run


def _ask(kept: pa.Table, buckets: np.ndarray) -> list[tuple]:
    """In how many of the block's sets each shingle is."""
    keys, count = np.unique(unpack(kept.column("state")[0].as_py())[1], return_counts=True)
    cut = cut_by_bucket(keys, len(buckets))
    return [(int(buckets[b]), pack(keys[x:y], *pack_counts(count[x:y]))) for b, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]


def _frequencies(payloads: list[bytes]) -> list[bytes]:
    """In how many sets of all blocks."""
    parts = [unpack(p) for p in payloads]
    uniq, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([unpack_counts(*p[1:4]) for p in parts]).astype(float), len(uniq)).astype(np.int64)
    return [pack(*pack_counts(x)) for x in np.split(total[inverse], np.cumsum([len(p[0]) for p in parts])[:-1])]


def _prefixes(kept: pa.Table, got: dict, buckets: np.ndarray, least: tuple[int, int]) -> pa.Table:
    """The prefix of each set, without what no other set has; and the sets that have such a prefix (shingle is null)."""
    ids, sets, at = unpack(kept.column("state")[0].as_py())
    keys, inverse = np.unique(sets, return_inverse=True)
    cut = cut_by_bucket(keys, len(buckets))
    found = [unpack_counts(*unpack(got[1][int(buckets[b])])) for b, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
    often = np.concatenate([np.zeros(0, np.int64), *found])[inverse]
    size = np.diff(at)
    row = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((sets, often, row))
    rank = np.arange(len(sets)) - at[row]
    length = size - -(-size * least[0] // least[1]) + 1
    chosen = order[(rank < length[row]) & (often[order] > 1)]
    member = row[chosen]
    live = np.unique(member)
    whole = [sets[at[i] : at[i + 1]].tobytes() for i in live.tolist()]
    return pa.table({
        "shingle": pa.concat_arrays([pa.array(sets[chosen].view(np.int64)), pa.nulls(len(live), pa.int64())]),
        "node": np.concatenate([ids[member], ids[live]]), "n": np.concatenate([size[member], size[live]]),
        "rest": np.concatenate([size[member] - rank[(rank < length[row]) & (often[order] > 1)], size[live]]),
        "members": pa.concat_arrays([pa.nulls(len(chosen), pa.binary()), pa.array(whole, pa.binary())]),
    })


def similar(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b) whose sets are as similar as that; written."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(both * least[1] >= (len(x) + len(y) - both) * least[0])
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    one = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
    other = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    found = pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")
    return written(found.repartition(narrow_files(pairs.sparkSession)))


def by_fingerprint(nodes: DataFrame, sets: DataFrame, shingle: int, least: tuple[int, int]) -> DataFrame:
    """Similar pairs (a, b) that connect, or are, those whose SimHash fingerprints differ in RADIUS bits at most."""
    prints = written(fingerprints(nodes, shingle).withColumnRenamed("doc_id", "node"))
    # different sets may share a fingerprint: they are compared with the first that has it
    first = written(prints.groupBy("fp").agg(F.min("node").alias("a")), narrow=True)
    same = prints.join(first, "fp").where("node != a").select("a", F.col("node").alias("b"))
    near = near_fingerprints(first.select(F.col("a").alias("node"), "fp"), RADIUS)
    return similar(same.unionByName(near), sets, least)


def near_links(nodes: DataFrame, shingle: int, least: tuple[int, int]) -> DataFrame:
    """node, root for every one of the nodes (doc_id, text; distinct sets) that is similar to another."""
    blocks = Blocks(nodes, keep=_state(shingle), block_bytes=BLOCK_BYTES, bucket_bytes=BUCKET_BYTES)
    buckets = blocks.buckets
    often = blocks.answer(blocks.ask(lambda d, _: _ask(d, buckets)), 1, _frequencies)
    both = written(blocks.each(lambda _, d, g: _prefixes(d, g, buckets, least), "shingle long, node long, n long, rest long, members binary", often))
    blocks.drop()
    sets = both.where("shingle IS NULL").select("node", "members")
    met = both.where("shingle IS NOT NULL").select("shingle", "node", "n", "rest")
    # sizes of similar sets differ by so much at most; and at the first member that both have, so many must be left in either
    near = (F.least("n", "n_") * least[1] >= F.greatest("n", "n_") * least[0]) & (F.least("rest", "rest_") * sum(least) >= (F.col("n") + F.col("n_")) * least[0])
    roots = components(by_fingerprint(nodes, sets, shingle, least))
    # of what is too far on in its own order to be similar even to the smallest set of the bucket, no pair is found here
    about = met.groupBy("shingle").agg(F.min("n").alias("least_n"), F.count("*").alias("count")).where("count > 1")
    met = met.join(about, "shingle").where(F.col("rest") * sum(least) >= (F.col("n") + F.col("least_n")) * least[0])
    # about so many of the bucket stand before it
    place = (F.xxhash64("node", "shingle") / 2.0**64 + 0.5) * F.col("count")
    met = written(met.select("shingle", "node", "n", "rest", place.alias("place")), narrow=True)
    begin, end = 0, 1
    while True:
        rooted = met.join(roots, "node", "left").select("shingle", "node", "n", "rest", "place", F.coalesce("root", "node").alias("root"))
        several = rooted.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle")
        live = written(rooted.join(several, "shingle", "left_semi"), narrow=True)
        files_removed(met.sparkSession, met)
        last = live.agg(F.max("place")).first()[0]
        if last is None or last < begin:
            break
        chosen = live.where((F.col("place") >= begin) & (F.col("place") < end))
        chosen = chosen.select("shingle", *[F.col(c).alias(f"{c}_") for c in ("node", "n", "rest", "place", "root")])
        # each pair in the round of the one that stands before the other
        pairs = live.join(chosen, "shingle").where((F.col("root") != F.col("root_")) & (F.struct("place", "node") > F.struct("place_", "node_")) & near)
        pairs = pairs.select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b")).distinct()
        links = similar(pairs, sets, least)
        if not links.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))
        met, begin, end = live.drop("root"), end, end * GROWTH
    files_removed(both.sparkSession, both, live)
    return roots


def one_of_each_group(docs: DataFrame, shingle: int = SHINGLE, least: tuple[int, int] = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that have the smallest id of their group; a row without an id stays.

    Rows are linked, over any number of links, if the Jaccard similarity of their sets of shingles (words of the lower
    case text) is at least ``least``; rows with fewer words than a shingle have one shingle of all their words, and rows
    without words are alike. Ids must be below 2**62.
    """
    own = written(with_digest(id_text(docs, id_col, text_col), shingle).groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("text").alias("text")))
    # only rows without an id have the set: a number of its own
    nodes = own.select(F.coalesce("least", F.lit(NO_ID).bitwiseOR(F.xxhash64("digest").bitwiseAND(F.lit(NO_ID - 1)))).alias("doc_id"), "text")
    roots = near_links(nodes, shingle, least)
    gone = roots.where("node != root").select("node")
    kept = nodes.select(F.col("doc_id").alias("_kept")).where(F.col("_kept") < NO_ID).join(gone, F.col("_kept") == F.col("node"), "left_anti").distinct()
    key = docs[id_col]
    return docs.join(kept, key == F.col("_kept"), "left_semi").unionByName(docs.where(key.isNull()))
