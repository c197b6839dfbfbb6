"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import hashlib
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only on one machine (a local master) whose session names no checkpoint folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. On a cluster it must be set; a local master may do without."""
    context = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not place:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = LOCAL_CHECKPOINTS
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(place)
    return place


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of intermediate data, on whatever file system they are."""
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_deleted(spark: SparkSession):
    """Inside, Spark deletes a job's shuffle files when it ends: what it wrote stands for them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, by: str | None = None, narrow: bool = False) -> DataFrame:
    """``df``, written once as a table in the shared folder and read again (cuts the lineage); in folders by a column if given.
    ``narrow``: its rows are a few numbers each, so a file takes what several partitions have."""
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(narrow_files(spark))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    schema = df.schema
    with shuffles_deleted(spark):
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
    return spark.read.schema(schema).parquet(path)


def files_removed(spark: SparkSession, *tables: DataFrame, folder: str = "") -> None:
    """Deletes the files of ``written`` tables that are not needed any more; with ``folder``, those of one value only."""
    removed(spark, *{f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles() if f"/{folder}" in f})


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def narrow_files(spark: SparkSession) -> int:
    """Files for a table of narrow rows: many small ones cost more than their rows."""
    parts = shuffle_partitions(spark)
    return max(min(parts, 12), parts // 16)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on, so that no other column can clash; null texts become empty."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    )


def held_out(column: str, modulus: int, remainder: int = 2):
    """Whether crc32(id as text) mod ``modulus`` is ``remainder``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column end to end, and where each text begins (one more entry for the end)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks_of(offsets: np.ndarray, most_bytes: int = 4 << 20):
    """Ranges (i, j) of rows of about ``most_bytes`` together; one longer row makes a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most_bytes, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


# ---- words of many texts at once ------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverses modulo 2**64 for i < n, kept for later calls."""
    if len(_POWERS[0]) < n:
        # kept for good, so hardly more than is asked for
        size = max(n + (n >> 4), 1 << 19)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                out = np.full(size, base, np.uint64)
                out[0] = 1
                np.multiply.accumulate(out, out=out)
                _POWERS[k] = out
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (multiply and shift, twice)."""
    h = h.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F)):
            h ^= h >> np.uint64(shift)
            h *= np.uint64(factor)
        h ^= h >> np.uint64(32)
    return h


ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Bytes of words under [^\x20\x09-\x0D]+.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[32, *range(9, 14)]] = False
#: Letters, digits and every byte of a character beyond ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[128:] = True
for _a, _b in (b"09", b"AZ", b"az"):
    WORD_BYTE[_a : _b + 1] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of ``inside`` bytes; no run crosses the end of a text."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    mask = inside[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (~before | first[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    ends = np.flatnonzero(mask & (~after | first[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each span, equal only for equal bytes: up to 15 bytes are the key themselves, with their
    number on top; of longer ones it is 120 bits of a cryptographic digest."""
    wide = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.ndarray((len(data) + 9,), "<u8", wide, strides=(1,))
    size = ends - starts
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    a = words[starts] & mask[np.minimum(size, 8)]
    b = words[starts + np.minimum(size, 8)] & mask[np.clip(size - 8, 0, 7)] | (np.minimum(size, 15).astype(np.uint64) << np.uint64(56))
    for i in np.flatnonzero(size > 15).tolist():
        d = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
        a[i], b[i] = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:15], "little") | 255 << 56
    return a, b


def span_hashes(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, from one running sum over all of them."""
    up, down = _powers(len(lowered) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(lowered) + 1, np.uint64)
        np.cumsum((lowered.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        return mix(h ^ (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
