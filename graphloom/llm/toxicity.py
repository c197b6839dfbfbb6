"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its words, pairs of neighbours, and pairs with one word
between, each hashed into 2**BITS places and counted once a text. FTRL-proximal
keeps a learning rate for each coordinate, and its L1 term leaves most weights
at zero, so the model that goes to the workers is short.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ASCII_LOWER, WORD_BYTE, chunks_of, id_text, mix, span_hashes, utf8_buffer, word_spans
from .training import SAMPLE_ROWS, sample_rows, shuffled

BITS = 20
#: The bound on the labelled rows that are learnt from.
ROWS = 2 * SAMPLE_ROWS
THRESHOLD = 0.3


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every word, neighbour pair and skip pair of these texts, repeats included."""
    lowered = ASCII_LOWER[data]
    starts, ends, rows = word_spans(lowered, offsets, WORD_BYTE)
    h = span_hashes(lowered, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    out_rows, out = [rows], [h]
    with np.errstate(over="ignore"):
        for gap, factor in ((1, 0x9DDFEA08EB382D69), (2, 0xC3A5C85C97CB3127)):
            same = np.flatnonzero(rows[gap:] == rows[:-gap])
            out_rows.append(rows[same])
            out.append(mix(h[same] * np.uint64(factor) ^ h[same + gap]))
    return np.concatenate(out_rows), (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class SparseModel:
    places: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.places] = self.weights
        return out

    def scores(self, column: pa.Array, dense: np.ndarray) -> np.ndarray:
        """Probability of every text of a column; null and empty texts get that of the bias alone."""
        data, offsets = utf8_buffer(column)
        out = np.full(len(offsets) - 1, self.bias)
        for i, j in chunks_of(offsets):
            rows, places = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            used = np.flatnonzero(dense[places])
            once = np.unique(rows[used] << BITS | places[used])
            np.add.at(out, i + (once >> BITS), dense[once & ((1 << BITS) - 1)])
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def fit(texts: list[bytes], y: np.ndarray, alpha: float = 5.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0, passes: int = 2, least_texts: int = 4) -> SparseModel:
    """FTRL-proximal, one example at a time; places that fewer texts have are not included. Without examples, or with one label only, the model is its bias."""
    offsets = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    row_parts, place_parts = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for i, j in chunks_of(offsets, 1 << 20):
        rows, places = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        once = np.unique((rows + i) << BITS | places)
        row_parts.append((once >> BITS).astype(np.int32))
        place_parts.append((once & ((1 << BITS) - 1)).astype(np.int32))
    rows, places = np.concatenate(row_parts), np.concatenate(place_parts)
    del row_parts, place_parts
    common = (np.bincount(places, minlength=1 << BITS) >= least_texts)[places]
    rows, places = rows[common], places[common]
    at = np.searchsorted(rows, np.arange(len(texts) + 1))
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias, bias_n = float(np.log(share / (1 - share))), 1.0

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        w[np.abs(zi) <= l1] = 0
        return w

    for _ in range(passes):
        for k in range(len(texts)):
            i = places[at[k] : at[k + 1]]
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -60, 60))) - y[k]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
            bias_n += g * g
            bias -= 0.05 * g / np.sqrt(bias_n)
    kept = np.flatnonzero(np.abs(z) > l1)
    return SparseModel(kept, weights(kept).astype(np.float32), float(bias))


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> SparseModel:
    """Fits on a bounded sample of the labelled documents that are not held out; in one task, so that the driver gets the weights only."""

    def run(batches):
        model = fit(*shuffled([r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(3)))]))
        yield pa.RecordBatch.from_arrays([pa.array([model.places]), pa.array([model.weights]), pa.array([model.bias])], names=["places", "weights", "bias"])

    found = sample_rows(docs, labels, "toxic", rows).repartition(1).mapInArrow(run, "places array<long>, weights array<float>, bias double").collect()
    if not found:
        return fit([], np.zeros(0))
    return SparseModel(np.array(found[0]["places"], np.int64), np.array(found[0]["weights"], np.float32), found[0]["bias"])


def score_documents(docs: DataFrame, model: SparseModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, one row for each row of ``docs``; null and empty texts are scored too."""

    def run(batches):
        dense = model.dense()
        for batch in batches:
            s = model.scores(batch.column(1), dense)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: SparseModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below the threshold."""
    place = docs.columns.index(text_col)

    def run(batches):
        dense = model.dense()
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(place), dense) < threshold))

    return docs.mapInArrow(run, docs.schema)
