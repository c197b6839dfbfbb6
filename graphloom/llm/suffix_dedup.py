"""Removal of repeated passages with suffix arrays.

A byte goes if it is covered by a string of ``length`` bytes that also starts in
a document with a smaller id. Strings that are equal have the same minimiser:
the smallest hash of the k-grams inside. So a text is cut into stretches whose
windows share a minimiser, and a stretch is of interest only if its minimiser
occurs in more than one text. The stretches that do are dealt to shards by their
minimiser; equal windows meet in one shard. The stretches of a minimiser that is
frequent (a footer, a common phrase, each time with other surroundings) are dealt
window by window instead, by a hash of the whole window, so that no shard grows
with one phrase. A distinct piece that is alone under what it is dealt by has no
window in common with another; a shard sorts all suffixes of the rest by induced
sorting, the leftmost-smaller substrings by the same sorting again, computes the
permuted common prefixes, and so finds for each window the smallest document that
has it.

Before that, equal texts are found by their digests: only one of them (that of
the smallest id) is cut, and of all the others every window is known to repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Blocks, cut_by_bucket, pack, pack_counts, parts_of, unpack, unpack_counts
from .common import chunks_of, mix, span_hashes, utf8_buffer, written

LENGTH, GRAM = 50, 20
#: Windows in one stretch at most; stretches from which on a minimiser's windows are dealt one by one.
STRETCH, FREQUENT = 64, 2048
#: Bytes of one suffix array: a shard with more is split by further bits of what its pieces are dealt by.
SHARD_BYTES = 1 << 18
#: Text of a block, and text for each bucket of stretches. Blocks and buckets send each other a message a round, so their
#: number grows with the square of the input over both sizes; a bucket cuts what it has into suffix arrays anyway.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
#: Stands for a null id: later than every other, and not before another null.
LAST = (1 << 63) - 1


# ---- suffix arrays ----------------------------------------------------------------------------------


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it (S); the end of the text counts as S."""
    n = len(t)
    out = np.zeros(n, bool)
    out[-1] = True
    # a run of equal characters has the type of its last one
    last = np.where(t[:-1] != t[1:], np.arange(n - 1, dtype=np.int32), np.int32(n - 1))
    last = np.minimum.accumulate(last[::-1])[::-1]
    out[:-1] = t[last] < t[np.minimum(last + 1, n - 1)]
    return out


def _scan(t: np.ndarray, goes: np.ndarray, order: np.ndarray, free: np.ndarray) -> None:
    """One pass of induced sorting, from left to right: an entry puts the suffix before its own, if that ``goes``, to the
    free front of its character's bucket. ``order`` has -1 where nothing is yet, ``free`` each bucket's next free place.

    Entries go in batches: as many as stand before every place that the batch itself fills.
    """
    n, at, size = len(order), 0, 1024
    # nothing goes from where nothing is yet (-1), or from the beginning (0)
    goes = np.concatenate([goes, [False, False]])
    while at < n:
        before = order[at : at + size] - 1
        done = len(before)
        who = goes[before].nonzero()[0]
        if len(who):
            before = before[who]
            bucket = t[before]
            bound = np.minimum.accumulate(free[bucket]) - at
            late = (who[1:] >= bound[:-1]).nonzero()[0]
            if len(late):
                count = int(late[0]) + 1
                before, bucket, bound = before[:count], bucket[:count], bound[:count]
            by = bucket.argsort(kind="stable")
            before, bucket = before[by], bucket[by]
            edges = (bucket[1:] != bucket[:-1]).nonzero()[0] + 1
            first = np.zeros(len(edges) + 1, np.int32)
            first[1:] = edges
            sizes = np.empty_like(first)
            sizes[:-1] = edges - first[:-1]
            sizes[-1] = len(bucket) - first[-1]
            target = bucket[first]
            order[np.repeat(free[target] - first, sizes) + np.arange(len(bucket), dtype=np.int32)] = before
            free[target] += sizes
            done = min(done, int(bound[-1]))
        at += done
        size = min(2 * size, 1 << 16) if done >= size else max(256, 2 * done)


def _induce(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """All suffixes in the order that the given order of the leftmost-smaller ones induces: larger ones from left to
    right, then smaller ones from right to left (the same pass over mirrored places and characters)."""
    n = len(t)
    size = np.bincount(t, minlength=k)
    end = np.cumsum(size)
    number = np.bincount(t[lms], minlength=k)
    order = np.full(n, -1, np.int32)
    order[np.arange(len(lms)) + np.repeat(end - np.cumsum(number), number)] = lms[np.argsort(t[lms], kind="stable")]
    _scan(t, ~s_type, order, (end - size).astype(np.int32))
    _scan((k - 1 - t.astype(np.int32)).astype(t.dtype), s_type, order[::-1], (n - end)[::-1].astype(np.int32))
    return order


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Suffixes of ``t`` (whole numbers below ``k``; the last one unique and smallest) in order, by induced sorting."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    # up to 16 bits numpy sorts by radix
    t = t.astype(np.uint16 if k <= 1 << 16 else np.int32)
    s_type = _types(t)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    if len(lms) > 1:
        rough = _induce(t, s_type, lms, k)
        mark = np.full(n, -1, np.int32)
        mark[lms] = np.arange(len(lms))
        in_order = mark[rough]
        in_order = in_order[in_order >= 0]
        # name the leftmost-smaller substrings: equal neighbours get one name
        length = np.append(lms[1:] + 1, n) - lms
        same = length[in_order[1:]] == length[in_order[:-1]]
        todo, depth = np.flatnonzero(same), 0
        while len(todo):
            todo = todo[depth < length[in_order[todo]]]
            equal = t[lms[in_order[todo + 1]] + depth] == t[lms[in_order[todo]] + depth]
            same[todo[~equal]] = False
            todo = todo[equal]
            depth += 1
        name = np.empty(len(lms), np.int32)
        name[in_order] = np.concatenate([[0], np.cumsum(~same)])
        names = int(name[in_order[-1]]) + 1
        # where names repeat, the text of names is sorted in the same way
        lms = lms[suffix_array(name, names) if names < len(lms) else in_order]
    return _induce(t, s_type, lms, k)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position, how many bytes its suffix shares with the one before it in the order, up to either piece's end.

    The common prefix of position i is at least that of i-1 less one; the pieces go side by side, a column at a time.
    """
    n = len(t)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    wide = np.concatenate([t.astype(np.uint8), np.zeros(16, np.uint8)])
    words = np.ndarray((n + 8,), "<u8", wide, strides=(1,))
    out = np.zeros(n, np.int32)
    # how far it is from each position to the end of its piece; marks have nowhere to go
    reach = np.zeros(n, np.int32)
    reach[: ends[-1]] = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - np.arange(ends[-1])
    reach[ends[:-1]] = 0
    by = np.argsort(begins - ends, kind="stable")  # longest first, so that live pieces are a prefix
    begins, ends = begins[by], ends[by]
    size, carried = ends - begins, np.zeros(len(begins), np.int64)
    live = len(begins)
    for column in range(int(size.max(initial=0))):
        live = int(np.searchsorted(-size[:live], -column, side="left"))
        i = begins[:live] + column
        p = before[i]
        room = np.minimum(size[:live] - column, np.where(p >= 0, reach[p], 0))
        got = np.minimum(np.maximum(carried[:live] - 1, 0), room)
        todo = np.flatnonzero(got < room)
        while len(todo):
            x = words[i[todo] + got[todo]] ^ words[p[todo] + got[todo]]
            add = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
            got[todo] += add
            todo = todo[(add == 8) & (got[todo] < room[todo])]
        got = np.minimum(got, room)
        out[i] = got
        carried[:live] = got
    return out


def smallest_owner(pieces: list[bytes], owner: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For every window of every piece the smallest owner of a piece that has it; windows end to end, and where each
    piece's begin."""
    size = np.array([len(p) for p in pieces], np.int64)
    begins = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    t = text.astype(np.uint16) + 2
    t[begins + size] = 1  # pieces end in a mark of their own
    t = np.append(t, 0).astype(np.uint16)
    sa = suffix_array(t, 258)
    plcp = permuted_common_prefixes(np.append(text, 0), sa, begins, begins + size)
    piece = np.repeat(np.arange(len(pieces)), size + 1)
    sa = sa[sa < len(text)]
    left = (begins + size)[piece[sa]] - sa
    sa = sa[left >= length]
    shared = plcp[sa] >= length
    groups = np.flatnonzero(~shared)
    if len(sa) and not (len(groups) and groups[0] == 0):
        groups = np.concatenate([[0], groups])
    least = np.minimum.reduceat(owner[piece[sa]], groups) if len(sa) else np.zeros(0, np.int64)
    out = np.full(len(text), LAST, np.int64)
    out[sa] = np.repeat(least, np.diff(np.append(groups, len(sa))))
    windows = size - length + 1
    first = np.concatenate([[0], np.cumsum(windows)])
    return out[np.repeat(begins, windows) + np.arange(first[-1]) - np.repeat(first[:-1], windows)], first


# ---- stretches of texts -----------------------------------------------------------------------------


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of each stretch of these texts. Smallest hashes are small numbers, so
    they are scrambled once more: what follows deals by their leading bits."""
    keys, firsts, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # so much at a time that the hashes stay in a core's cache
    for i, j in chunks_of(offsets, 1 << 18):
        base, end = offsets[i], offsets[j]
        part = data[base:end]
        if len(part) < length:
            continue
        wide = np.concatenate([part, np.zeros(8, np.uint8)])
        words = np.ndarray((len(part),), "<u8", wide, strides=(1,))
        with np.errstate(over="ignore"):
            h = words[: len(part) - gram + 1] * np.uint64(0x9E3779B97F4A7C15) ^ mix(words[gram - 8 : len(part) - 8 + 1] + np.uint64(0x632BE59BD9B4E019))
            h = mix(h)
        across, m, width = length - gram + 1, h, 1
        while 2 * width <= across:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if across > width:
            m = np.minimum(m[: len(m) - (across - width)], m[across - width :])
        # windows that cross the end of a text are none
        own = offsets[i : j + 1] - base
        valid = np.zeros(len(m) + 1, np.int8)
        a, b = own[:-1], np.minimum(np.maximum(own[1:] - length + 1, own[:-1]), len(m))
        np.add.at(valid, a[a < b], 1)
        np.add.at(valid, b[a < b], -1)
        ok = np.cumsum(valid[:-1], dtype=np.int8) > 0
        new = np.ones(len(m), bool)
        new[1:] = (m[1:] != m[:-1]) | ~ok[:-1]
        new[a[a < len(m)]] = True
        at = np.flatnonzero(new & ok)
        stop = np.flatnonzero(ok & np.append(new[1:] | ~ok[1:], True)) + 1
        pieces = -(-(stop - at) // STRETCH)
        start = np.repeat(at, pieces) + STRETCH * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        keys.append(np.repeat(mix(m[at]), pieces))
        firsts.append(start + base)
        counts.append(np.minimum(STRETCH, np.repeat(stop, pieces) - start))
    return np.concatenate(keys), np.concatenate(firsts), np.concatenate(counts)


def read(docs: pa.Table) -> bytes:
    """A block's documents as ids, sizes, digests and the bytes of all texts."""
    data, offsets = utf8_buffer(docs.column("text").combine_chunks())
    ids = docs.column("doc_id").combine_chunks()
    null = ids.is_null().to_numpy(zero_copy_only=False)
    ids = np.where(null, LAST, ids.fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    raw, at = data.tobytes(), offsets.tolist()
    digests = b"".join([hashlib.sha256(raw[a:b]).digest()[:16] for a, b in zip(at, at[1:])])
    return pack(ids, null.astype(np.uint8), np.diff(offsets), np.frombuffer(digests, "<u8"), data)


class Block:
    """One block's texts, ids, and what it has been told so far."""

    def __init__(self, kept: pa.Table, got: dict, buckets: np.ndarray, length: int):
        self.buckets, self.length, self.got = buckets, length, got
        self.ids, self.null, size, digests, self.data = unpack(kept.column("state")[0].as_py())
        self.offsets = np.append(0, np.cumsum(size))
        self.digests = digests.reshape(-1, 2)

    def by_digest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows that are the first of each digest, in the order of digests and of ids in it; each row's digest; the cut into buckets."""
        order = np.lexsort((self.ids, self.digests[:, 1], self.digests[:, 0]))
        new = np.append(True, (self.digests[order[1:]] != self.digests[order[:-1]]).any(axis=1))[: len(order)]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        first = order[new]
        return first, group, cut_by_bucket(self.digests[first, 0], len(self.buckets))

    def ask_digests(self) -> list[tuple]:
        """Each distinct text's digest and its smallest id here."""
        first, _, cut = self.by_digest()
        return [(int(self.buckets[b]), pack(self.digests[first[x:y], 0], self.digests[first[x:y], 1], self.ids[first[x:y]])) for b, x, y in parts_of(cut)]

    def first_ids(self) -> np.ndarray:
        """For each text the smallest id that has it."""
        _, group, cut = self.by_digest()
        return np.concatenate([np.zeros(0, np.int64)] + [unpack(self.got[0][int(self.buckets[b])])[0] for b, _, _ in parts_of(cut)])[group]

    def cut(self) -> None:
        """Stretches of the texts that are the first of their kind, each text once."""
        self.first = self.first_ids()
        own = self.first == self.ids
        keys, start, count = stretches(self.data, self.offsets, self.length)
        row = np.searchsorted(self.offsets, start, side="right") - 1
        keep = own[row]
        self.keys, self.start, self.count, self.row = keys[keep], start[keep], count[keep], row[keep]

    def distinct_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted minimisers, and the index of each stretch's."""
        return np.unique(self.keys, return_inverse=True)

    def ask_keys(self) -> list[tuple]:
        """Minimisers, whether each occurs under several ids here, and the number of its stretches."""
        self.cut()
        uniq, inverse = self.distinct_keys()
        low, high = np.full(len(uniq), LAST, np.int64), np.full(len(uniq), -LAST - 1, np.int64)
        np.minimum.at(low, inverse, self.ids[self.row])
        np.maximum.at(high, inverse, self.ids[self.row])
        count = np.bincount(inverse, minlength=len(uniq))
        return [(int(self.buckets[b]), pack(uniq[x:y], np.packbits((low < high)[x:y]), *pack_counts(count[x:y]))) for b, x, y in parts_of(cut_by_bucket(uniq, len(self.buckets)))]

    def candidates(self) -> None:
        """Leaves the stretches whose minimiser is in several texts, those of frequent ones window by window; finds the
        distinct contents, in order, by bucket."""
        self.cut()
        uniq, inverse = self.distinct_keys()
        flag, frequent = np.zeros(len(uniq), bool), np.zeros(len(uniq), bool)
        for b, x, y in parts_of(cut_by_bucket(uniq, len(self.buckets))):
            flag[x:y], frequent[x:y] = (np.unpackbits(k, count=y - x).astype(bool) for k in unpack(self.got[1][int(self.buckets[b])]))
        keep = flag[inverse]
        single = frequent[inverse][keep]
        keys, start, count, row = self.keys[keep], self.start[keep], self.count[keep], self.row[keep]
        if single.any():
            each = np.where(single, count, 1)
            of = np.repeat(np.arange(len(each)), each)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
            keys, start, count, row, single = keys[of], start[of] + nth, np.where(single, 1, count)[of], row[of], single[of]
            keys = keys.copy()
            keys[single] = span_hashes(self.data, start[single], start[single] + self.length)
        self.start, self.count, self.row = start, count, row
        home = np.searchsorted(np.array([(b << 64) // len(self.buckets) for b in range(1, len(self.buckets))], np.uint64), keys, side="right")
        seen: dict[bytes, int] = {}
        raw, more = self.data.tobytes(), self.length - 1
        self.content = np.fromiter((seen.setdefault(raw[s : s + c + more], len(seen)) for s, c in zip(start.tolist(), count.tolist())), np.int64, len(start))
        self.pieces = list(seen)
        self.owner = np.full(len(seen), LAST, np.int64)
        np.minimum.at(self.owner, self.content, self.ids[row])
        bucket, self.part = np.zeros(len(seen), np.int64), np.zeros(len(seen), np.uint32)
        bucket[self.content] = home
        self.part[self.content] = keys & np.uint64(0xFFFFFFFF)
        self.order = np.argsort(bucket, kind="stable")
        self.edges = np.searchsorted(bucket[self.order], np.arange(len(self.buckets) + 1))

    def ask_pieces(self) -> list[tuple]:
        """Distinct pieces; one message, not to the same bucket from all blocks, also has what the block needs to know of them
        later, which comes back with the answer."""
        self.candidates()
        out, own = [], [self.start.astype(np.uint32), self.count.astype(np.uint8), *[x.astype(np.uint32) for x in (self.content, self.order, self.edges)]]
        parts = list(parts_of(self.edges))
        bearer = int(mix(self.digests[:1, 0])[0]) % len(parts) if parts else 0
        for k, (b, x, y) in enumerate(parts):
            pieces = [self.pieces[i] for i in self.order[x:y]]
            out.append((int(self.buckets[b]), pack(np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces], np.uint16), self.owner[self.order[x:y]], self.part[self.order[x:y]], *(own if k == bearer else []))))
        return out

    def removed(self) -> np.ndarray:
        """Which bytes go."""
        first = self.first_ids()
        mark = np.zeros(len(self.data) + 1, np.int32)
        answers = {name: unpack(p) for name, p in self.got.get(2, {}).items()}
        for start, count, content, order, edges in [[x.astype(np.int64) for x in p[3:]] for p in answers.values() if len(p) > 3]:
            row = np.searchsorted(self.offsets, start, side="right") - 1
            windows = np.zeros(len(order), np.int64)
            windows[content] = count
            # answers come by bucket; what each piece is told begins at
            told, begin, at = [], np.zeros(len(order), np.int64), 0
            for b, x, y in parts_of(edges):
                _, size, value = answers[int(self.buckets[b])][:3]
                told.append(np.repeat(value, size))
                own = order[x:y]
                begin[own] = at + np.cumsum(windows[own]) - windows[own]
                at += len(told[-1])
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            values = np.concatenate(told)[np.repeat(begin[content], count) + nth]
            position = np.repeat(start, count) + nth
            hit = position[values < np.repeat(self.ids[row], count)]
            np.add.at(mark, hit, 1)
            np.add.at(mark, hit + self.length, -1)
        out = np.cumsum(mark[:-1]) > 0
        # later copies of a whole text
        size = np.diff(self.offsets)
        out |= np.repeat((first < self.ids) & (size >= self.length), size)
        return out


def _first_ids(payloads: list[bytes]) -> list[bytes]:
    parts = [unpack(p) for p in payloads]
    a, b, ids = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.lexsort((ids, b, a))
    a, b, ids = a[order], b[order], ids[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    first = np.empty(len(ids), np.int64)
    first[order] = ids[new][np.cumsum(new) - 1]
    return [pack(x) for x in np.split(first, np.cumsum([len(p[2]) for p in parts])[:-1])]


def _in_several(payloads: list[bytes]) -> list[bytes]:
    """Which minimisers are in several texts, and which of them are frequent."""
    parts = [unpack(p) for p in payloads]
    several = np.concatenate([np.unpackbits(p[1], count=len(p[0])).astype(bool) for p in parts])
    _, inverse, blocks = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True, return_counts=True)
    total = np.bincount(inverse, np.concatenate([unpack_counts(*p[2:]) for p in parts]))
    flag = blocks > 1
    flag[inverse[several]] = True
    return [pack(np.packbits(flag[x]), np.packbits(total[x] > FREQUENT)) for x in np.split(inverse, np.cumsum([len(p[0]) for p in parts])[:-1])]


def _owners(length: int):
    def run(payloads: list[bytes]) -> list[bytes]:
        parts = [unpack(p) for p in payloads]
        seen: dict[bytes, int] = {}
        index = []
        for text, size, *_ in parts:
            raw, ends = text.tobytes(), np.cumsum(size.astype(np.int64)).tolist()
            index.append(np.fromiter((seen.setdefault(raw[a:b], len(seen)) for a, b in zip([0, *ends], ends)), np.int64, len(size)))
        pieces = list(seen)
        del seen
        owner = np.full(len(pieces), LAST, np.int64)
        part = np.zeros(len(pieces), np.int64)
        for i, (_, _, own, bits, *_) in zip(index, parts):
            np.minimum.at(owner, i, own)
            part[i] = bits
        windows = np.array([len(p) for p in pieces], np.int64) - length + 1
        first = np.concatenate([[0], np.cumsum(windows)])
        # equal windows have one minimiser, and so are in one part; a piece alone there shares none
        least = np.repeat(owner, windows)
        _, inverse, together = np.unique(part, return_inverse=True, return_counts=True)
        met = together[inverse] > 1
        part = np.where(met, part % max(1, -(-int((windows + length)[met].sum()) // SHARD_BYTES)), -1)
        for p in np.unique(part[met]):
            members = np.flatnonzero(part == p)
            found, begin = smallest_owner([pieces[i] for i in members], owner[members], length)
            count = windows[members]
            least[np.repeat(first[members] - begin[:-1], count) + np.arange(begin[-1])] = found
        out = []
        for i, sent in zip(index, parts):
            count = windows[i]
            w = least[np.repeat(first[i], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            # runs of equal values
            new = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, np.int64)
            out.append(pack(np.array([len(new)], np.int64), np.diff(np.append(new, len(w))).astype(np.uint32), w[new], *sent[4:]))
        return out

    return run


def mark_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; one row for each row. With ``texts`` also kept_text, what remains
    of a text that loses something, and the first 32 digits of the whole text's SHA-256.

    Null texts count as empty; texts shorter than ``length`` lose nothing. A null id is later than all others, and equal
    ids (repeated rows) do not remove from each other. Ids must be below 2**63 - 1. In the remaining text a character
    goes only if all its bytes do, so that it stays valid; digests and counts are of bytes. Other columns are not read.
    """
    blocks = Blocks(docs, id_col, text_col, keep=read, block_bytes=BLOCK_BYTES, bucket_bytes=BUCKET_BYTES)
    names = blocks.buckets
    first = blocks.answer(blocks.ask(lambda d, g: Block(d, g, names, length).ask_digests()), 0, _first_ids)
    several = blocks.answer(blocks.ask(lambda d, g: Block(d, g, names, length).ask_keys(), first), 1, _in_several)
    told = first.unionByName(several)
    owners = blocks.answer(blocks.ask(lambda d, g: Block(d, g, names, length).ask_pieces(), told), 2, _owners(length), whole=True)

    def finish(_, d, got):
        block = Block(d, got, names, length)
        gone = block.removed()
        at = block.offsets.tolist()
        total = np.concatenate([[0], np.cumsum(gone)])
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        inside = block.offsets[:-1][block.offsets[:-1] < len(gone)]
        begin[inside] = gone[inside]
        spans = np.concatenate([[0], np.cumsum(begin)])
        kept = [block.data[a:b][~gone[a:b]].tobytes() for a, b in zip(at, at[1:])]
        out = {
            "doc_id": pa.array(block.ids, mask=block.null.astype(bool)), "n_bytes": np.diff(block.offsets), "n_removed": total[block.offsets[1:]] - total[block.offsets[:-1]],
            "n_spans": spans[block.offsets[1:]] - spans[block.offsets[:-1]], "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept],
        }
        if texts:
            # whole characters: one that keeps any byte keeps all
            lead = (block.data & 0xC0) != 0x80
            lead[inside] = True
            char = np.cumsum(lead) - 1
            stays = np.zeros(char[-1] + 1 if len(char) else 0, bool)
            stays[char[~gone]] = True
            keep = stays[char] if len(char) else gone
            out["kept_text"] = [block.data[a:b][keep[a:b]].tobytes().decode("utf-8", "replace") if total[b] > total[a] else None for a, b in zip(at, at[1:])]
            out["digest"] = [block.digests[k].tobytes().hex() for k in range(len(at) - 1)]
        return pa.table({k: v if isinstance(v, pa.Array) else pa.array(v, pa.int64() if k[:2] == "n_" else pa.string()) for k, v in out.items()})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string, digest string" * texts
    result = written(blocks.each(finish, schema, told.unionByName(owners)))
    blocks.drop(first, several, owners)
    return result


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with what remains of each text (and its number of characters); documents that lose everything go.

    Rows are told apart by id and text, so repeated rows stay repeated.
    """
    marked = mark_repeats(docs, length, id_col, text_col, texts=True).where("n_removed > 0")
    rest = marked.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("kept_text").alias("_kept")).dropDuplicates(["_id", "_digest"])
    digest = F.substring(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), 1, 32)
    joined = docs.join(rest, docs[id_col].eqNullSafe(F.col("_id")) & (digest == F.col("_digest")), "left")
    joined = joined.withColumn(text_col, F.coalesce("_kept", F.col(text_col))).where(F.col("_kept").isNull() | (F.trim("_kept") != ""))
    if chars_col in docs.columns:
        joined = joined.withColumn(chars_col, F.when(F.col("_kept").isNull(), F.col(chars_col)).otherwise(F.char_length("_kept").cast(docs.schema[chars_col].dataType)))
    return joined.select(docs.columns)
