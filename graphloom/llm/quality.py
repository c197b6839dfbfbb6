"""Quality classifier: a byte-level convolutional network in numpy.

Every byte is embedded (a learnt vector, and a flag that says whether the word
it stands in repeats the word before). Filters over 16 bytes move in steps of
four; their outputs, rectified, are max-pooled over overlapping chunks that
cover the whole document. The pooled values of all chunks are combined - their
largest and their mean - into one probability by a last layer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD_BYTE, chunks_of, id_text, span_hashes, utf8_buffer, word_spans
from .training import SAMPLE_ROWS, sample_rows, shuffled

#: Bytes in a step; steps in a filter, in a chunk, and between the beginnings of chunks.
STEP, TAPS, CHUNK, HOP = 4, 4, 64, 56
EMBED, FILTERS = 5, 16
THRESHOLD = 0.7


def layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (plus one; zero is padding) and repeat flags with every text at a whole step, the first step of each chunk, its text.

    A text fills at least one chunk; padding after each text keeps filters from reaching into the next.
    """
    size = np.diff(offsets)
    steps = -(-size // STEP)
    chunks = np.maximum(1, -(-(steps - (CHUNK - HOP)) // HOP))
    room = (chunks - 1) * HOP + CHUNK + TAPS - 1
    first = np.concatenate([[0], np.cumsum(room)])
    x = np.zeros(first[-1] * STEP, np.int16)
    flag = np.zeros(first[-1] * STEP, np.float32)
    if len(data):
        to = np.arange(len(data)) + np.repeat(first[:-1] * STEP - offsets[:-1], size)
        x[to] = data
        x[to] += 1
        starts, ends, rows = word_spans(data, offsets, WORD_BYTE)
        if len(starts) > 1:
            h = span_hashes(data, starts, ends)
            again = np.flatnonzero((h[1:] == h[:-1]) & (rows[1:] == rows[:-1])) + 1
            mark = np.zeros(len(data) + 1, np.int32)
            np.add.at(mark, starts[again], 1)
            np.add.at(mark, ends[again], -1)
            flag[to] = np.cumsum(mark[:-1])
    text = np.repeat(np.arange(len(size)), chunks)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    return x, flag, first[text] + nth * HOP, text


@dataclass
class ByteCNN:
    embedding: np.ndarray  # 257 x EMBED
    filters: np.ndarray  # TAPS x (STEP * (EMBED + 1)) x FILTERS
    filter_bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS
    bias: float

    def steps(self, x: np.ndarray, flag: np.ndarray) -> np.ndarray:
        e = np.empty((len(x), EMBED + 1), np.float32)
        e[:, :EMBED] = self.embedding[x]
        e[:, EMBED] = flag
        return e.reshape(-1, STEP * (EMBED + 1))

    def convolve(self, s: np.ndarray) -> np.ndarray:
        n = len(s) - TAPS + 1
        y = s[:n] @ self.filters[0]
        for k in range(1, TAPS):
            y += s[k : n + k] @ self.filters[k]
        y += self.filter_bias
        return np.maximum(y, 0, out=y)

    def pooled(self, chunk_max: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        begin = np.searchsorted(text, np.arange(n))
        most = np.maximum.reduceat(chunk_max, begin, axis=0)
        mean = np.add.reduceat(chunk_max, begin, axis=0) / np.bincount(text, minlength=n)[:, None]
        return np.concatenate([most, mean], axis=1)

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, flag, first, text = layout(data, offsets)
        y = self.convolve(self.steps(x, flag))
        # overlapping ranges: every other entry is a range, those between are single rows; a spare row stands after the last
        edges = np.stack([first, first + CHUNK], axis=1).ravel()
        chunk_max = np.maximum.reduceat(np.concatenate([y, np.zeros((1, FILTERS), np.float32)]), edges, axis=0)[::2]
        return self.pooled(chunk_max, text, len(offsets) - 1) @ self.out + self.bias

    def scores(self, column: pa.Array) -> np.ndarray:
        """Probability of every text of a column; null and empty texts are one chunk of padding."""
        data, offsets = utf8_buffer(column)
        out = np.zeros(len(offsets) - 1)
        for i, j in chunks_of(offsets, 1 << 20):
            out[i:j] = self.logits(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def _batches(sizes: np.ndarray, order: np.ndarray, rows: int, most_bytes: int):
    """Runs of the order of ``rows`` texts, of fewer where texts are long."""
    at = 0
    while at < len(order):
        total = np.cumsum(sizes[order[at : at + rows]])
        count = max(1, int(np.searchsorted(total, most_bytes, side="right")))
        yield order[at : at + min(rows, count)]
        at += min(rows, count)


def fit(texts: list[bytes], y: np.ndarray, passes: int = 5, batch: int = 32, rate: float = 0.01, seed: int = 3, batch_bytes: int = 1 << 18) -> ByteCNN:
    """Adam on the log loss, over whole texts; a step takes ``batch`` texts, or fewer with ``batch_bytes`` in all (one text
    at least), so that memory depends on the longest text only. Without examples the model answers one half."""
    rng = np.random.default_rng(seed)
    width = STEP * (EMBED + 1)
    net = ByteCNN(rng.normal(0, 0.5, (257, EMBED)).astype(np.float32), rng.normal(0, (2 / (TAPS * width)) ** 0.5, (TAPS, width, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)
    net.embedding[0] = 0
    params = {"embedding": net.embedding, "filters": net.filters, "filter_bias": net.filter_bias, "out": net.out, "bias": np.zeros(1, np.float32)}
    first_moment, second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    sizes = np.array([len(t) for t in texts], np.int64)
    turn, seen, total = 0, 0, max(1, passes * len(texts))
    for _ in range(passes):
        for chosen in _batches(sizes, rng.permutation(len(texts)), batch, batch_bytes):
            part = [texts[i] for i in chosen]
            x, flag, first, text = layout(np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)]))
            s = net.steps(x, flag)
            conv = net.convolve(s)
            at, chunk_max = _highest(conv, first)
            pooled = net.pooled(chunk_max, text, len(part))
            p = 1 / (1 + np.exp(-(pooled @ net.out + params["bias"][0])))
            g = ((p - y[chosen]) / len(part)).astype(np.float32)
            grads = {"out": pooled.T @ g, "bias": g.sum(keepdims=True)}
            # to the chunks: all share the mean, the largest takes the rest
            begin = np.searchsorted(text, np.arange(len(part)))
            down = np.repeat((g / np.bincount(text, minlength=len(part)))[:, None] * net.out[FILTERS:], np.diff([*begin, len(text)]), axis=0)
            top = chunk_max == pooled[text, :FILTERS]
            down += top * (g[:, None] * net.out[:FILTERS])[text]
            down *= chunk_max > 0
            rows, filters = first[:, None] + at, np.broadcast_to(np.arange(FILTERS), at.shape)
            live = down != 0
            rows, filters, d = rows[live], filters[live], down[live]
            grads["filter_bias"] = np.bincount(filters, d, FILTERS).astype(np.float32)
            one_hot = np.zeros((len(d), FILTERS), np.float32)
            one_hot[np.arange(len(d)), filters] = d
            grads["filters"] = np.stack([s[rows + k].T @ one_hot for k in range(TAPS)])
            to_embedding = np.zeros((257, EMBED), np.float32)
            for k in range(TAPS):
                back = (one_hot @ net.filters[k].T).reshape(-1, STEP, EMBED + 1)[:, :, :EMBED].reshape(-1, EMBED)
                places = x[((rows + k) * STEP)[:, None] + np.arange(STEP)].ravel()
                for c in range(EMBED):
                    to_embedding[:, c] += np.bincount(places, back[:, c], 257)
            to_embedding[0] = 0
            grads["embedding"] = to_embedding
            turn, seen = turn + 1, seen + len(part)
            step = rate * min(1, 2 * (1 - seen / (total + 1)))
            for k, v in params.items():
                first_moment[k] += 0.1 * (grads[k] - first_moment[k])
                second[k] += 0.01 * (grads[k] ** 2 - second[k])
                v -= step * (first_moment[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-6)
            net.bias = float(params["bias"][0])
    if not len(texts):
        net.out[:] = 0
    return net


def _highest(conv: np.ndarray, first: np.ndarray, some: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """For each chunk and filter, at which of the chunk's steps the output is highest, and how high; so many chunks at a time."""
    at, most = [np.zeros((0, FILTERS), np.int64)], [np.zeros((0, FILTERS), np.float32)]
    for i in range(0, len(first), some):
        window = conv[first[i : i + some, None] + np.arange(CHUNK)]
        at.append(window.argmax(axis=1))
        most.append(np.take_along_axis(window, at[-1][:, None], axis=1)[:, 0])
    return np.concatenate(at), np.concatenate(most)


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ByteCNN:
    """Fits on a bounded sample of the labelled documents that are not held out; in one task, so that the driver gets the
    parameters only. The bound is on rows; their texts are whole."""
    names = ["embedding", "filters", "filter_bias", "out"]

    def run(batches):
        model = fit(*shuffled([r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(3)))]))
        yield pa.RecordBatch.from_arrays([pa.array([getattr(model, n).ravel().astype(float)]) for n in names] + [pa.array([model.bias])], names=[*names, "bias"])

    found = sample_rows(docs, labels, "quality", rows).repartition(1).mapInArrow(run, ", ".join(f"{n} array<double>" for n in names) + ", bias double").collect()
    if not found:
        return fit([], np.zeros(0))
    shapes = [(257, EMBED), (TAPS, STEP * (EMBED + 1), FILTERS), (FILTERS,), (2 * FILTERS,)]
    return ByteCNN(*(np.array(found[0][n], np.float32).reshape(shape) for n, shape in zip(names, shapes)), float(found[0]["bias"]))


def score_documents(docs: DataFrame, model: ByteCNN, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, one row for each row of ``docs``; null and empty texts are scored too."""

    def run(batches):
        for batch in batches:
            s = model.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: ByteCNN, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least the threshold."""
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(place)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
