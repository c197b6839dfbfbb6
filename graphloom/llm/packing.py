"""Best-fit packing of tokenised documents into sequences of one length.

Vector best-fit: a sequence has three capacities - tokens, documents, and
attention cost (the sum of squared lengths) - and a piece is put, longest first,
into the open sequence that it fits under every capacity and that scores best,
by the smallest norm of what would be left, or by the largest weighted dot
product of the piece and what is left.

A piece's demands follow from its length alone, so the plan needs only the
number of pieces of each length (at most ``capacity`` numbers), however many
pieces there are: equal sequences are filled together. The plan is a list of
runs - of the pieces of one length, numbers a to b go, q at a time, to
sequences s, s+1, ... from a given place on - and each piece looks up its run
by its length and its number among the pieces of that length.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .bpe import load, text_groups
from .common import id_text, shuffle_partitions, written


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds. By default neither documents nor attention cost bind before tokens do."""

    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None

    @property
    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)


def plan_runs(counts: dict[int, int], capacity: Capacity, rule: str = "residual_norm", weights=(1.0, 1.0, 1.0)) -> list[tuple]:
    """Runs (length, first number, pieces, first sequence, pieces a sequence, place of the first) for so many pieces of each length.

    Items go longest first. A class of open sequences has one residual vector, and so one score for the item; the best
    class takes all it can before the next, as single placing would: after an item a sequence's residual is smaller, so
    by its norm it stays the best until the item no longer fits. (By dot product a fuller sequence scores lower, so
    there each sequence of the class takes one item before any takes two.)
    """
    if rule not in ("residual_norm", "dot_product"):
        raise ValueError(f"unknown rule: {rule}")
    full, weights = capacity.vector, np.asarray(weights, float)
    scale = full.astype(float)
    open_: dict[tuple, list[tuple[int, int]]] = {}  # residual vector -> ranges of sequences (first, how many)
    runs, fresh = [], 0
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left, done = counts[length], 0
        item = np.array([length, 1, length * length], np.int64)
        if (item > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        while left:
            keys = list(open_)
            best = None
            if keys:
                residual = np.array(keys, np.int64)
                fits = (residual >= item).all(axis=1)
                if fits.any():
                    if rule == "residual_norm":
                        score = -(weights * ((residual - item) / scale) ** 2).sum(axis=1)
                    else:
                        score = (weights * (residual / scale) * (item / scale)).sum(axis=1)
                    # ties go to fewer tokens left
                    order = np.lexsort((residual[:, 0], -score))
                    best = next(keys[k] for k in order if fits[k])
            if best is None:
                most = int((full // item).min()) if rule == "residual_norm" else 1
                per = min(most, left)
                bins = max(1, left // per)
                first, residual = fresh, tuple(full.tolist())
                fresh += bins
            else:
                ranges = open_[best]
                first, bins = ranges.pop()
                if not ranges:
                    del open_[best]
                residual = best
                most = int((np.array(residual) // item).min()) if rule == "residual_norm" else 1
                per = min(most, left)
                take = min(bins, max(1, left // per))
                if take < bins:
                    open_.setdefault(residual, []).append((first + take, bins - take))
                bins = take
            placed = per * bins
            runs.append((length, done, placed, first, per, int(full[0] - residual[0])))
            after = np.array(residual, np.int64) - per * item
            if after[0] > 0 and after[1] > 0 and after[2] > 0:
                open_.setdefault(tuple(after.tolist()), []).append((first, bins))
            done, left = done + placed, left - placed
    return runs


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, tokens: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, ids (binary, little-endian 32-bit).

    A document is its ids and then ``end_id``; one of more than ``tokens`` ids is cut into pieces of ``tokens``, of which
    the first may be shorter. Null and empty texts make one piece of one id.
    """
    end = np.array([end_id], "<i4").tobytes()

    def run(batches):
        bpe = load(tokenizer)
        for batch in batches:
            names, at = batch.column(0).to_pylist(), 0
            for group in text_groups(batch.column(1)):
                rows = []
                for name, ids in zip(names[at:], bpe.encode_batch(group)):
                    ids += end
                    size = len(ids) // 4
                    edges = [0, *range(size % tokens or min(size, tokens), size + 1, tokens)]
                    rows += [(name, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), ids[4 * a : 4 * b]) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
                at += len(group)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def pack_pieces(pieces: DataFrame, capacity: Capacity = Capacity(), rule: str = "residual_norm") -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length and any other columns but those two).

    Pieces that tie (repeated rows, null ids) still get places of their own, since they are numbered by row. An empty
    table gives an empty table. Pieces are numbered inside (length, salt), with as many salts as it takes, so the pieces
    of full length, often half of all, are spread over all tasks; the numbers of salts before are then added.
    """
    spark = pieces.sparkSession
    salts = 8 * shuffle_partitions(spark)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    by = Window.partitionBy("length", "_salt")
    # one row for each length and salt; the running sum is over at most `salts` rows a length
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `tokens` rows
    runs = plan_runs(counts, capacity, rule)
    table: dict[int, list] = {}
    for length, first, n, sequence, per, place in runs:
        table.setdefault(length, []).append((first, sequence, per, place))
    schema = T.StructType([T.StructField("_length", T.LongType()), T.StructField("_first", T.ArrayType(T.LongType())), T.StructField("_sequence", T.ArrayType(T.LongType())), T.StructField("_per", T.ArrayType(T.LongType())), T.StructField("_place", T.ArrayType(T.LongType()))])
    plan = spark.createDataFrame([(k, *map(list, zip(*v))) for k, v in table.items()], schema)
    numbered = (
        salted.withColumn("_rank", F.row_number().over(by.orderBy("doc_id", "piece")))
        .join(before.select("length", "_salt", "_before"), ["length", "_salt"])
        .withColumn("_number", F.coalesce("_before", F.lit(0)) + F.col("_rank") - 1)
    )
    # the plan has one row for each length: its size is bounded by the capacity, not by the data
    placed = numbered.join(F.broadcast(plan), numbered["length"] == plan["_length"])
    run = F.size(F.filter("_first", lambda x: x <= F.col("_number"))) - 1
    placed = placed.withColumn("_run", run).withColumn("_in", F.col("_number") - F.element_at("_first", F.col("_run") + 1))
    per = F.element_at("_per", F.col("_run") + 1)
    return placed.select(
        *[F.col(c) for c in pieces.columns],
        (F.element_at("_sequence", F.col("_run") + 1) + F.floor(F.col("_in") / per)).cast("long").alias("sequence_id"),
        (F.element_at("_place", F.col("_run") + 1) + (F.col("_in") % per) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), end_id: int = 2, rule: str = "residual_norm", id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Cuts, then packs: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset; cases as in the two steps.

    The pieces are written once to the shared folder, since they are read twice.
    """
    pieces = cut_documents(docs, tokenizer, end_id, capacity.tokens, id_col, text_col)
    return pack_pieces(written(pieces if keep_ids else pieces.drop("ids")), capacity, rule)
