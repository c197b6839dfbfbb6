"""Blocks of documents that ask keyed questions of the whole corpus.

Documents are dealt to blocks of so many bytes and kept in a bucketed table, so
that a later grouping by block shuffles nothing. A block sends, for each bucket
of keys, one row with its distinct keys there (packed arrays); whoever holds a
bucket sees the keys of all blocks, and answers each block with one row. What is
shuffled is thus pre-aggregated by block, and a key that is frequent everywhere
comes once from each block. There is at most one message for a distinct key of a
block, however many blocks and buckets there are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, files_removed, id_text, removed, shuffle_partitions, shuffles_deleted, written

#: Text in a block, and text whose keys one bucket answers for.
BLOCK_BYTES, BUCKET_BYTES = 16 << 20, 24 << 20
#: Up to so many groups are named so that hash partitioning deals them evenly; more are even by their number.
NAMED = 1 << 14
ASK = "bucket long, block long, payload binary"
ANSWER = "block long, kind int, bucket long, payload binary"


def group_names(spark: SparkSession, count: int) -> np.ndarray:
    """Numbers for ``count`` groups, such that grouping by them fills the shuffle partitions evenly."""
    if count > NAMED:
        return np.arange(count)
    partitions = shuffle_partitions(spark)
    each = -(-count // partitions)
    found: dict[int, list[int]] = {p: [] for p in range(partitions)}
    begin, size = 0, 4 * partitions * each + 64
    while any(len(v) < each for v in found.values()):
        for r in spark.range(begin, begin + size).select("id", F.pmod(F.hash("id"), F.lit(partitions)).alias("p")).collect():
            if len(found[r["p"]]) < each:
                found[r["p"]].append(r["id"])
        begin += size
    return np.array([found[p][k] for k in range(each) for p in range(partitions)][:count], np.int64)


class Blocks:
    """The documents (doc_id, text) by block, and the names of the buckets."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Callable[[pa.Table], bytes] | None = None, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES):
        """With ``keep``, a block is one row with what that makes of its documents (column state), in place of the texts."""
        spark = self.spark = docs.sparkSession
        parts = shuffle_partitions(spark)
        rows = id_text(docs, id_col, text_col)
        total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
        # small inputs still use all partitions, as long as a megabyte is left for each
        least = min(parts, -(-total // (1 << 20)))
        names = group_names(spark, max(1, least, -(-total // block_bytes))).tolist()
        self.buckets = group_names(spark, max(1, least, -(-total // bucket_bytes)))
        number = F.pmod(F.xxhash64("doc_id", "text"), F.lit(len(names)))
        block = F.element_at(F.lit(names), (number + 1).cast("int")).cast("long") if len(names) <= NAMED else number
        rows = rows.withColumn("block", block).repartition(parts, "block")
        if keep:
            rows = rows.groupBy("block").applyInArrow(lambda key, t: pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "state": pa.array([keep(t)], pa.binary())}), "block long, state binary")
        self.name = f"blocks_{uuid.uuid4().hex}"
        self.path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{self.name}"
        with shuffles_deleted(spark):
            rows.write.option("compression", "zstd").option("path", self.path).bucketBy(parts, "block").sortBy("block").saveAsTable(self.name)
        self.docs = spark.table(self.name)

    def ask(self, fn: Callable[[pa.Table, dict], list[tuple]], answers: DataFrame | None = None) -> DataFrame:
        """What each block asks: ``fn`` gets its documents, and {kind: {bucket: payload}}; gives (bucket name, payload)."""

        def run(block: int, docs: pa.Table, got: dict) -> pa.Table:
            rows = fn(docs, got)
            return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([block] * len(rows), pa.int64()), "payload": pa.array([r[1] for r in rows], pa.binary())})

        return self.each(run, ASK, answers)

    def each(self, run: Callable[[int, pa.Table, dict], pa.Table], schema: str, answers: DataFrame | None = None) -> DataFrame:
        if answers is None:
            return self.docs.groupBy("block").applyInArrow(lambda key, t: run(key[0].as_py(), t, {}), schema)
        return self.docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda key, docs, answers: run(key[0].as_py(), docs, by_kind(answers, "bucket")), schema)

    def answer(self, asked: DataFrame, kind: int, fn: Callable[[list[bytes]], list[bytes]], whole: bool = False) -> DataFrame:
        """For each bucket, ``fn`` gets the payloads of all blocks and gives as many answers; kept as a table. ``whole``: small
        partitions are not put together, as buckets take much time for their size."""
        if whole:
            asked = asked.repartition(shuffle_partitions(self.spark), "bucket")
        return self.answer_with(asked, None, kind, lambda payloads, bucket, got: fn(payloads))

    def answer_with(self, asked: DataFrame, told: DataFrame | None, kind: int, fn: Callable[[list[bytes], int, dict], list[bytes]]) -> DataFrame:
        """The same, where the holder of a bucket is also told rows (block: the bucket; kind, bucket: the sender, payload)."""

        def run(key, t, got):
            # the same order whatever order the rows arrive in
            order = np.argsort(t.column("block").to_numpy(), kind="stable")
            payloads = t.column("payload").to_pylist()
            name = key[0].as_py()
            out = fn([payloads[i] for i in order], name, got) if len(order) else []
            return pa.table({"block": t.column("block").to_numpy()[order], "kind": pa.array([kind] * len(out), pa.int32()), "bucket": pa.array([name] * len(out), pa.int64()), "payload": pa.array(out, pa.binary())})

        if told is None:
            return written(asked.groupBy("bucket").applyInArrow(lambda key, t: run(key, t, {}), ANSWER))
        both = asked.groupBy("bucket").cogroup(told.withColumnRenamed("bucket", "sender").groupBy("block"))
        return written(both.applyInArrow(lambda key, t, told: run(key, t, by_kind(told, "sender")), ANSWER))

    def drop(self, *tables: DataFrame) -> None:
        """Removes the blocks' table and the given ``written`` ones; what was derived from them must have been written."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        removed(self.spark, self.path)
        files_removed(self.spark, *tables)


def by_kind(answers: pa.Table, sender: str) -> dict[int, dict[int, bytes]]:
    """{kind: {sender: payload}}."""
    got: dict[int, dict] = {}
    for kind, name, payload in zip(*[answers.column(c).to_pylist() for c in ("kind", sender, "payload")]):
        got.setdefault(kind, {})[name] = payload
    return got


def cut_by_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's part of sorted hashes begins (and the end): the bucket is given by the leading bits."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def parts_of(cut: np.ndarray):
    """(bucket, begin, end) of the parts that hold something."""
    for b in np.flatnonzero(np.diff(cut)).tolist():
        yield b, int(cut[b]), int(cut[b + 1])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays end to end, each with its length and type."""
    out = [bytes([len(arrays)])]
    for a in arrays:
        a = np.ascontiguousarray(a)
        out += [a.dtype.str.encode().ljust(4), len(a).to_bytes(8, "little"), a.tobytes()]
    return b"".join(out)


def unpack(raw: bytes) -> list[np.ndarray]:
    out, at = [], 1
    for _ in range(raw[0]):
        kind, n = np.dtype(raw[at : at + 4].decode().strip()), int.from_bytes(raw[at + 4 : at + 12], "little")
        at += 12
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * kind.itemsize
    return out


def pack_counts(counts: np.ndarray) -> list[np.ndarray]:
    """Counts that are mostly small: one byte each, and those from 255 on apart."""
    big = np.flatnonzero(counts >= 255)
    return [np.minimum(counts, 255).astype(np.uint8), big.astype(np.uint32), counts[big].astype(np.int64)]


def unpack_counts(small: np.ndarray, big: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = small.astype(np.int64)
    out[big] = values
    return out


def grouped(hashes: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys that consist of ``columns``, one row of each distinct key, in the order of their hashes, and each row's
    group. Keys that share a hash stay apart."""
    order = np.argsort(hashes, kind="stable")
    new, same = _changes(order, hashes, columns)
    if (new & same).any():
        order = np.lexsort((*columns, hashes))
        new, _ = _changes(order, hashes, columns)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


def _changes(order: np.ndarray, hashes: np.ndarray, columns: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Where a row's key differs from that of the row before it, and where the hash does not."""
    new, same = np.zeros(len(order), bool), np.zeros(len(order), bool)
    new[:1] = True
    same[1:] = hashes[order[1:]] == hashes[order[:-1]]
    for c in (hashes, *columns):
        new[1:] |= c[order[1:]] != c[order[:-1]]
    return new, same
