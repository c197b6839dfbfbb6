"""Exact top-k search by inner product with KD-trees.

Vectors are dealt to shards by the upper part of a KD-tree over a bounded sample:
median splits on the widest side, so that a shard holds what lies close together.
Each shard's own tree (median splits, a tight bounding box at every node) is built
once and written, with its root box in a small table apart. A box bounds a query's
product from above by sum(max(q*low, q*high)).

Queries go in blocks. Each block first searches the shard that its root boxes
promise most; the k-th products found there are its floors. Of the other shards a
block visits only those whose box reaches the floor of one of its queries, best
first inside: nodes whose bound does not reach the k-th best product so far are
left out. The sample decides only where vectors lie; every row is in a shard.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import files_removed, written

LEAF, SHARD_ROWS, BLOCK_ROWS = 64, 2048, 256
#: Rows of the sample that the shards' borders come from, for each size of vectors, and the most shards they make; with
#: more rows than that, a shard is cut further by a hash.
SAMPLE_ROWS, REGIONS = 20_000, 1024
#: Products are whole numbers; doubles hold them exactly below this.
EXACT = float(1 << 53)


class KDTree:
    """A tree over whole-number vectors; nodes are numbered from the root, leaves hold ranges of ``order``."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order, nodes, todo = np.arange(len(ids)), [], [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own = vectors[order[a:b]]
            low, high = own.min(axis=0), own.max(axis=0)
            number = len(nodes)
            nodes.append([a, b, -1, -1, low, high])
            if parent >= 0:
                nodes[parent][2 + side] = number
            if b - a > leaf and vectors.shape[1]:
                axis, middle = int((high.astype(float) - low).argmax()), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, axis], middle)]
                todo += [(a + middle, b, number, 1), (a, a + middle, number, 0)]
        self.rows, self.ids, self.vectors = rows[order], ids[order], vectors[order]
        self.span = np.array([n[:2] for n in nodes])
        self.child = np.array([n[2:4] for n in nodes])
        self.low, self.high = (np.array([n[k] for n in nodes], np.int64).reshape(len(nodes), -1) for k in (4, 5))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **self.__dict__)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> KDTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(raw)) as f:
            tree.__dict__.update({k: f[k] for k in f.files})
        return tree

    def search(self, queries: np.ndarray, query_rows: np.ndarray, k: int, floor: list) -> list[list[tuple[int, int, int]]]:
        """Each query's best (score, -id, -row), at least its ``floor``; the query's own row is no candidate."""
        number = exact_type(self.vectors, queries)
        # bounds in doubles, wider by what rounding can take
        q, low, high = queries.astype(float), self.low.astype(float), self.high.astype(float)
        bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        if number is not float:
            bound += (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T) * 1e-12 + 1
        values, asked = self.vectors.astype(number), queries.astype(number)
        out = []
        for i in range(len(q)):
            best: list[tuple] = []  # a heap: its smallest is the k-th
            kth, reach = floor[i], bound[i]
            queue = [(-reach[0], 0)]
            while queue:
                upper, node = heapq.heappop(queue)
                if -upper < kth:
                    break
                left, right = self.child[node]
                if left >= 0:
                    for n in (left, right):
                        if reach[n] >= kth:
                            heapq.heappush(queue, (-reach[n], n))
                    continue
                a, b = self.span[node]
                scores = values[a:b] @ asked[i]
                for j in np.flatnonzero(scores >= kth):
                    if self.rows[a + j] == query_rows[i]:
                        continue
                    entry = (int(scores[j]), -int(self.ids[a + j]), -int(self.rows[a + j]))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                    if len(best) == k:
                        kth = max(kth, best[0][0])
            out.append(sorted(best, reverse=True))
        return out


def exact_type(a: np.ndarray, b: np.ndarray):
    """In which numbers products of these rows are exact: doubles, 64-bit whole numbers, or Python's."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return float if most < EXACT else np.int64 if most < 2.0**62 else object


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """row (a number of its own), vec_id and floor(scale * x) of every component; vectors that are null, or hold null or
    non-finite components, or have no id, are left out. Components beyond 2**62 after scaling count as 2**62."""
    v = F.col(f"`{vector_col}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & fine)
    most = float(1 << 62)
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.least(F.lit(float(scale)) * x.cast("double"), F.lit(most)), F.lit(-most))).cast("long"))
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), whole.alias("v")).withColumn("row", F.monotonically_increasing_id())


def _matrix(column) -> np.ndarray:
    """Rows of a column of lists; no rows of no components have no axis."""
    return np.stack([np.asarray(x, np.int64) for x in column])


def region_borders(sample: np.ndarray, regions: int) -> list[tuple[int, int, int, int]]:
    """Median splits of a sample into ``regions``: (axis, border, left, right), children as splits or, negative, regions."""
    splits, count = [], 0

    def cut(own: np.ndarray, parts: int) -> int:
        nonlocal count
        spread = own.max(axis=0).astype(float) - own.min(axis=0) if len(own) else np.zeros(1)
        if parts <= 1 or len(own) < 2 or not spread.max(initial=0):
            count += 1
            return -count
        axis = int(spread.argmax())
        border = int(np.sort(own[:, axis])[len(own) // 2])
        left = own[:, axis] < border
        if not left.any():
            border += 1
            left = own[:, axis] < border
        number = len(splits)
        splits.append(None)
        splits[number] = (axis, border, cut(own[left], parts // 2), cut(own[~left], parts - parts // 2))
        return number

    cut(sample, regions)
    return splits


def regions_of(vectors: np.ndarray, splits: list) -> np.ndarray:
    """The region of each vector; 0 without splits."""
    out = np.zeros(len(vectors), np.int64)
    todo = [(0, np.arange(len(vectors)))] if splits else []
    while todo:
        node, who = todo.pop()
        axis, border, left, right = splits[node]
        low = vectors[who, axis] < border
        for child, part in ((left, who[low]), (right, who[~low])):
            if child < 0:
                out[part] = -child - 1
            elif len(part):
                todo.append((child, part))
    return out


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", report: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products, ties to the smaller id.

    ``is_query`` is a condition on vec_id. Vectors of several lengths are searched apart, each among its own; those without
    components all have product 0. An empty table, or one without queries, gives no rows; a query without candidates gives
    none. Every row is a query and a candidate of its own: a repeated row has its own ranks, and finds its twin, but not
    itself. Products are exact for all finite components (within 64 bits). With ``report``, instead: dims, block, shards
    (all there are), searched (those whose box reached a floor, the first included).
    """
    rows = written(whole_vectors(vectors, id_col, vector_col, scale).withColumn("dims", F.size("v")))
    spark = rows.sparkSession
    sizes = {r["dims"]: r["count"] for r in rows.groupBy("dims").count().collect()}
    splits, slices = {}, {}
    for d, n in sizes.items():
        # a bounded sample: SAMPLE_ROWS rows for each of the few sizes of vectors
        sample = rows.where(F.col("dims") == d).orderBy(F.xxhash64("row")).select("v").limit(SAMPLE_ROWS).collect() if n > SHARD_ROWS and d else []
        splits[d] = region_borders(_matrix([r["v"] for r in sample]), min(REGIONS, -(-n // SHARD_ROWS))) if sample else []
        slices[d] = -(-n // (SHARD_ROWS * REGIONS))

    def deal(batches):
        for b in batches:
            dims = b.column("dims").to_numpy()
            shard = np.zeros(len(dims), np.int64)
            for d in np.unique(dims).tolist():
                who = np.flatnonzero(dims == d)
                region = regions_of(_matrix(b.column("v").take(pa.array(who)).to_pylist()), splits[d]) if splits[d] else 0
                shard[who] = region * slices[d] + b.column("row").to_numpy()[who] % slices[d]
            yield b.append_column("shard", pa.array(shard))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        # equal vectors, or a sample that missed a part of the space, may fill one shard: its tree comes in pieces
        out = []
        for at in range(0, len(pdf), 4 * SHARD_ROWS):
            part = pdf.iloc[at : at + 4 * SHARD_ROWS]
            tree = KDTree(part["row"].to_numpy(np.int64), part["vec_id"].to_numpy(np.int64), _matrix(part["v"]))
            out.append((part["dims"].iloc[0], part["shard"].iloc[0] << 20 | at // (4 * SHARD_ROWS), tree.dump(), tree.low[0].tolist(), tree.high[0].tolist()))
        return pd.DataFrame(out, columns=["dims", "shard", "tree", "low", "high"])

    dealt = rows.select("row", "vec_id", "v", "dims").mapInArrow(deal, "row long, vec_id long, v array<long>, dims int, shard long")
    trees = written(dealt.groupBy("dims", "shard").applyInPandas(build, "dims int, shard long, tree binary, low array<long>, high array<long>"))
    asked = rows.where(is_query(F.col("vec_id")))
    block_count = {d: max(1, -(-n // (8 * BLOCK_ROWS))) for d, n in sizes.items()}
    blocks_of = F.coalesce(*[F.when(F.col("dims") == d, F.lit(n)) for d, n in block_count.items()], F.lit(1)) if sizes else F.lit(1)
    blocks = written(asked.withColumn("block", F.pmod(F.xxhash64("row"), blocks_of)).groupBy("dims", "block").agg(F.collect_list(F.struct("row", "vec_id", "v")).alias("asked")))
    boxes = trees.select("dims", "shard", "low", "high")

    def bounds(asked_: list, low: list, high: list) -> np.ndarray:
        q = _matrix([x["v"] for x in asked_]).astype(float)
        low, high = np.array(low, float), np.array(high, float)
        return np.maximum(q, 0) @ high + np.minimum(q, 0) @ low + np.abs(q) @ np.maximum(np.abs(low), np.abs(high)) * 1e-12

    def promise(batches):
        """For each block and box, how much the box promises, and whether it reaches a floor."""
        for b in batches:
            out = []
            for d, block, shard, asked_, low, high, floor in zip(*[b.column(i).to_pylist() for i in range(7)]):
                reach = bounds(asked_, low, high)
                floors = {x["row"]: x["kth"] for x in floor or ()}
                least = np.array([float("-inf") if floors.get(x["row"]) is None else floors[x["row"]] for x in asked_])
                out.append((d, block, shard, float(reach.mean()), bool((reach + 1 >= least).any())))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], names=["dims", "block", "shard", "promise", "reaches"])

    def search(batches):
        kept: dict[tuple, KDTree] = {}
        for batch in batches:
            out = []
            for d, b, s, tree, asked_, floor in zip(*[batch.column(i) for i in range(6)]):
                name = (d.as_py(), s.as_py())
                if name not in kept:
                    kept.clear()
                    kept[name] = KDTree.load(tree.as_py())
                asked_ = asked_.as_py()
                floors = {x["row"]: x["kth"] for x in floor.as_py() or ()}
                start = [float("-inf") if floors.get(x["row"]) is None else floors[x["row"]] for x in asked_]
                found = kept[name].search(_matrix([x["v"] for x in asked_]), np.array([x["row"] for x in asked_], np.int64), k, start)
                out += [(d.as_py(), b.as_py(), q["row"], q["vec_id"], -n, -r, score) for q, best in zip(asked_, found) for score, n, r in best]
            cols = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), *[pa.int64()] * 6))], names=["dims", "block", "query", "query_id", "vec_id", "row", "score"])

    def visit(chosen: DataFrame, floors: DataFrame | None) -> DataFrame:
        # chosen pairs are small rows; they meet the trees, then the blocks, each of bounded size
        with_tree = chosen.select("dims", "block", "shard").join(trees.select("dims", "shard", "tree"), ["dims", "shard"]).join(blocks, ["dims", "block"])
        with_floor = with_tree.join(floors, ["dims", "block"], "left") if floors is not None else with_tree.withColumn("floor", F.lit(None).cast("array<struct<row:bigint,kth:bigint>>"))
        return with_floor.select("dims", "block", "shard", "tree", "asked", "floor").mapInArrow(search, "dims int, block long, query long, query_id long, vec_id long, row long, score long")

    def promises(floors: DataFrame | None) -> DataFrame:
        pairs = blocks.join(boxes, "dims")
        pairs = pairs.join(floors, ["dims", "block"], "left") if floors is not None else pairs.withColumn("floor", F.lit(None).cast("array<struct<row:bigint,kth:bigint>>"))
        return pairs.select("dims", "block", "shard", "asked", "low", "high", "floor").mapInArrow(promise, "dims int, block long, shard long, promise double, reaches boolean")

    home = written(promises(None).groupBy("dims", "block").agg(F.max_by("shard", F.struct("promise", "shard")).alias("shard")))
    first = written(visit(home, None))
    floors = written(
        first.groupBy("dims", "block", "query").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
        .groupBy("dims", "block").agg(F.collect_list(F.struct(F.col("query").alias("row"), F.when(F.col("n") == k, F.col("kth")).alias("kth"))).alias("floor"))
    )
    others = written(promises(floors).where("reaches").join(home.select("dims", "block", "shard"), ["dims", "block", "shard"], "left_anti"))
    if report:
        all_ = boxes.groupBy("dims").agg(F.count("*").alias("shards"))
        return home.join(others.groupBy("dims", "block").agg(F.count("*").alias("n")), ["dims", "block"], "left").join(all_, "dims").select("dims", "block", "shards", (1 + F.coalesce("n", F.lit(0))).alias("searched"))
    found = first.unionByName(visit(others, floors))
    by = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    result = written(found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    files_removed(spark, rows, trees, blocks, home, first, floors, others)
    return result
