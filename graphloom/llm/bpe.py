"""Byte-level BPE encoding and decoding with a published vocabulary.

A word is short, so its parts stay in one contiguous row: the ids of its parts
and, beside them, the rank of each adjacent pair. The row is scanned for the
smallest rank (leftmost on ties), that boundary is deleted, and only the ranks
of the two neighbours are looked up again, until no pair can be merged. Rows of
many words lie under each other in one array, so that one scan serves them all.

Texts repeat their words, so a worker keeps the ids of the words it has seen in
a table of bounded size. A word is cut from the text with the space before it;
the pattern of the pre-tokenizer cannot match across such a border.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_text

#: The pattern of byte-level pre-tokenizers (fixed by the vocabulary's format).
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: White space other than spaces and line feeds, and the pairs that make a longer run of it.
OTHER_SPACE = [chr(c) for c in (*range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000) if c != 10]
WIDE_SPACE = ["  ", " \n", "\n ", "\n\n", *OTHER_SPACE]
SINGLE_SPACE = regex.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")
NO_RANK = np.int32(2**31 - 1)
#: Words kept by a worker (about 120 MB).
KEPT_WORDS = 600_000
#: Longer pre-tokens are merged one by one, so that no row is padded to their length.
LONG_WORD = 64


def printable_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, inverted."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """The vocabulary of one tokenizers file, and a table of the words encoded so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, back = spec["model"]["vocab"], printable_bytes()
        self.bytes_of = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[ch] for ch in token) if all(ch in back for ch in token) else token.encode()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.byte_id = np.zeros(256, np.int32)
        for ch, b in back.items():
            self.byte_id[b] = vocab[ch]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.width = len(self.bytes_of)
        keys = left * self.width + right
        # an open-addressed table of pairs: slot -> key, rank
        self.bits = 18
        while (1 << self.bits) < 4 * len(keys):
            self.bits += 1
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, NO_RANK, np.int32)
        todo = np.arange(len(keys))
        place = self._slot(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.slot_key[place[todo]] < 0
            _, first = np.unique(place[todo][free], return_index=True)
            won = todo[free][first]
            self.slot_key[place[won]], self.slot_rank[place[won]] = keys[won], won
            todo = np.setdiff1d(todo, won, assume_unique=True)
            place[todo] = (place[todo] + 1) & ((1 << self.bits) - 1)
        self.words: dict[str, bytes] = {}
        self.marks = {c: self.byte_id[[ord(c)]].astype("<i4").tobytes() for c in ",.;:!?"}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; NO_RANK if the pair has no merge."""
        keys = left.astype(np.int64) * self.width + right
        place = self._slot(keys)
        found = self.slot_key[place]
        rank = np.where(found == keys, self.slot_rank[place], NO_RANK)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            place[open_] = (place[open_] + 1) & ((1 << self.bits) - 1)
            found = self.slot_key[place[open_]]
            hit = found == keys[open_]
            rank[open_[hit]] = self.slot_rank[place[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return rank

    def merge_rows(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges columns of equally many byte ids (one word a column); gives the parts, closed up to the top, and their count."""
        span, n = parts.shape
        size = np.ones(n, np.int64)
        if span < 2 or n == 0:
            return parts, size
        parts, out, live = parts.copy(), parts.copy(), np.arange(n)
        rank = self.ranks(parts[:-1].ravel(), parts[1:].ravel()).reshape(span - 1, n)
        while True:
            # scan for the smallest rank, leftmost on ties
            best, at = rank[0].copy(), np.zeros(len(live), np.int64)
            for j in range(1, span - 1):
                less = rank[j] < best
                np.copyto(best, rank[j], where=less)
                at[less] = j
            more = best != NO_RANK
            if not more.all():
                done = live[~more]
                out[:span, done], size[done] = parts[:span, ~more], span
                parts, rank, live, at, best = parts[:span, more], rank[: span - 1, more], live[more], at[more], best[more]
            if not len(live):
                return out, size
            # delete the boundary: the pair becomes one part, all beyond it moves up by one
            column = np.arange(len(live))
            parts[at, column] = self.merged[best]
            for j in range(1, span - 1):
                np.copyto(parts[j], parts[j + 1], where=at < j)
            for j in range(span - 2):
                np.copyto(rank[j], rank[j + 1], where=at <= j)
            span -= 1
            if span == 1:
                out[0, live] = parts[0]
                return out, size
            # refresh the ranks of the neighbours
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side < span - 1))
                k = side[ok]
                rank[k, ok] = self.ranks(parts[k, ok], parts[k + 1, ok])
            rank = rank[: span - 1]

    def merge_one(self, word: bytes) -> np.ndarray:
        """The same for one long pre-token; a heap names the smallest rank, so that long runs stay near-linear."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        rank = self.ranks(np.array(ids[:-1]), np.array(ids[1:])) if n > 1 else np.zeros(0, np.int32)
        queue = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(rank) if r != NO_RANK]
        heapq.heapify(queue)

        @functools.lru_cache(4096)
        def look(a: int, b: int) -> int:
            return int(self.ranks(np.array([a]), np.array([b]))[0])

        while queue:
            r, i, a, b = heapq.heappop(queue)
            k = after[i]
            if not alive[i] or k >= n or ids[i] != a or ids[k] != b:
                continue
            ids[i], alive[k], after[i] = int(self.merged[r]), False, after[k]
            if after[k] < n:
                before[after[k]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    r = look(ids[x], ids[y])
                    if r != NO_RANK:
                        heapq.heappush(queue, (r, x, ids[x], ids[y]))
        return np.array([v for v, live in zip(ids, alive) if live], np.int32)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as little-endian 32-bit numbers."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        size, places = size[order], order.tolist()
        text = self.byte_id[np.frombuffer(b"".join([words[i] for i in places]), np.uint8)]
        begin = np.append(0, np.cumsum(size))
        # words of one length lie side by side
        out: list[bytes] = [b""] * len(words)
        short = int(np.searchsorted(size, LONG_WORD, side="right"))
        a = int(np.searchsorted(size, 1))
        while a < short:
            length = int(size[a])
            b = min(int(np.searchsorted(size, length, side="right")), a + 20_000)
            ids, count = self.merge_rows(np.ascontiguousarray(text[begin[a] : begin[b]].reshape(-1, length).T))
            raw, ends = ids.T[np.arange(length) < count[:, None]].astype("<i4").tobytes(), np.cumsum(4 * count).tolist()
            for i, x, y in zip(places[a:b], [0, *ends], ends):
                out[i] = raw[x:y]
            a = b
        for i in places[short:]:
            out[i] = self.merge_one(words[i]).astype("<i4").tobytes()
        return out

    def learn(self, pieces) -> None:
        """Puts the ids of these pieces of text into the table."""
        words = self.words
        # most pieces are one word, or a word and a mark; only the others need the pattern
        whole, marked, cut = [], [], {}
        for p in pieces:
            if p.isalpha():
                whole.append(p)
            elif p[-1:] in self.marks and p[:-1].isalpha():
                marked.append(p)
            else:
                cut[p] = PATTERN.findall(p if p[:1] == "\n" else " " + p)
        whole += {p[:-1] for p in marked}.difference(words, whole)
        flat = list({w for ws in cut.values() for w in ws})
        ids = self.encode_words([w.encode("utf-8", "surrogatepass") for w in [*map(" ".__add__, whole), *flat]])
        words.update(zip(whole, ids))
        words.update({p: words[p[:-1]] + self.marks[p[-1]] for p in marked})
        of = dict(zip(flat, ids[len(whole) :]))
        words.update({p: b"".join([of[w] for w in ws]) for p, ws in cut.items()})

    def pieces(self, text: str) -> tuple[str, list[str]]:
        """The text before the first border, then the pieces: a piece begins with a line feed or lacks the space before it.

        Borders are single spaces and line feeds between two characters that are no white space; the pattern matches
        nothing across them. Texts with other white space are cut only at the first kind of border.
        """
        if not any(map(text.__contains__, WIDE_SPACE)) and text[-1:] not in (" ", "\n") and text[:1] not in (" ", "\n"):
            head, *rest = text.replace("\n", " \n").split(" ")
            return head, rest
        head, *rest = SINGLE_SPACE.split(text)
        return head, rest

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit numbers."""
        gc.disable()  # the tables hold no cycles, and walking them costs more than the encoding
        try:
            return self._encode_batch(texts)
        finally:
            gc.enable()

    def _encode_batch(self, texts: list[str]) -> list[bytes]:
        out, special = [], []
        for t in texts:
            if any(s in t for s in self.special):
                special.append(len(out))
                out.append(b"".join(np.array([self.special[p]], "<i4").tobytes() if p in self.special else self.encode_plain([p])[0] for p in self.special_split.split(t)))
            else:
                out.append(None)
        plain = iter(self.encode_plain([t for t, done in zip(texts, out) if done is None]))
        return [next(plain) if x is None else x for x in out]

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        cut = [self.pieces(t) for t in texts]
        heads = [PATTERN.findall(head) for head, _ in cut]
        flat = list({w for ws in heads for w in ws})
        ids = dict(zip(flat, self.encode_words([w.encode("utf-8", "surrogatepass") for w in flat])))
        met = set().union(*[rest for _, rest in cut])
        missed = met.difference(self.words)
        if missed:
            if len(self.words) + len(missed) > KEPT_WORDS:
                self.words, missed = {}, met
            self.learn(missed)
        get = self.words.__getitem__
        return [b"".join([*[ids[w] for w in ws], *map(get, rest)]) for ws, (_, rest) in zip(heads, cut)]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(2)
def load(path: str) -> ByteBPE:
    """One table a worker and path."""
    return ByteBPE(path)


def text_groups(column: pa.Array, most: int = 4 << 20):
    """The texts of a column, a few MB at a time; null becomes the empty text."""
    group, size = [], 0
    for t in column.to_pylist():
        t = t or ""
        group.append(t)
        size += len(t)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text: doc_id, ids (binary, little-endian 32-bit), n_tokens.

    Nulls and empty texts have no tokens. Rows with the same id, or a null id, are encoded each for itself. Other
    columns are not read. ``tokenizer`` is the vocabulary's path on the workers.
    """

    def run(batches):
        bpe = load(tokenizer)
        for batch in batches:
            ids = [x for group in text_groups(batch.column(1)) for x in bpe.encode_batch(group)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=["doc_id", "ids", "n_tokens"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, n_tokens long")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """The inverse: doc_id, ids -> doc_id, text. Bytes that are no UTF-8 become U+FFFD."""

    def run(batches):
        bpe = load(tokenizer)
        for batch in batches:
            texts = [bpe.decode_bytes(np.frombuffer(x or b"", "<i4").tolist()).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, then decodes from the ids alone, and returns digests of both (see ``encode_documents`` for the cases)."""

    def run(batches):
        bpe = load(tokenizer)
        for batch in batches:
            counts, id_sums, text_sums = [], [], []
            for raw in batch.column(1).to_pylist():
                ids = np.frombuffer(raw, "<i4").tolist()
                counts.append(len(ids))
                id_sums.append(hashlib.sha256(",".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest())
                text_sums.append(hashlib.sha256(bpe.decode_bytes(ids).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode_documents(docs, tokenizer, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
