"""Language-model scoring with a hierarchical Pitman-Yor model of word pairs.

Every word is the context of a restaurant whose customers are the tokens seen
after it. The restaurants share one parent, the restaurant of single words, which
gets a customer for each of their tables, and whose own base is uniform over the
vocabulary and one unknown word.

The state of the sampler is the number of tables of every pair and, in the parent,
of every word. A Gibbs sweep goes as follows. Given the tables t of a restaurant,
x ~ Gamma(strength / discount + t); given x, its dishes depend on each other no
more, and the tables of a dish with n customers follow the law S(n, t) * a**t with
a = discount * x * (what the parent predicts). Those are drawn exactly (see tables),
all pairs side by side, one draw a pair whatever its count. Their sums by word are
the parent's new customers; the parent's tables are drawn in the same way, and with
its new predictions the next sweep begins. Within a sweep what the parent predicts
stays as it was at the beginning, as usual where a Gibbs sampler runs in parallel.
Sampling starts with one table a pair. Each kept sample is one state - tables of
pairs, their sums by context, and the parent that goes with them - so its
predictions add up to one, and probabilities are averaged over the samples.

The counts come from the whole corpus: blocks of documents, kept as words' numbers,
ask for the numbers of their words and, at the end, for what their pairs and words
have come to (see blocks). Pairs are dealt by a hash of both words, words by theirs,
so that no group grows with a frequent word or context; a bucket of pairs and a
bucket of words exchange one message a sweep, with sums.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ANSWER, Blocks, by_kind, cut_by_bucket, grouped, pack, pack_counts, parts_of, unpack, unpack_counts
from .common import ASCII_LOWER, NOT_BLANK, chunks_of, files_removed, mix, utf8_buffer, word_keys, word_spans, written
from .tables import draw

#: Keys of what is no word: the end of a text, and the context at its beginning (no word's second number is like these).
END, START = (0, 254 << 56), (1, 254 << 56)
HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 7, 2
#: Kinds of messages: numbers of words, pairs' answers, words' answers, sums of tables, parents' answers, where a bucket has
#: the pairs that blocks asked for, its own draws of pairs, a sample's parent.
WORDS, PAIRS, PARENTS, SUMS, SWEEP, PLACES, DRAWN, SAMPLE = range(1, 9)
ROW = "block long, kind int, bucket long, payload binary"
#: Tokens whose pairs are made distinct at once.
AT_ONCE = 1 << 19
STEP = ROW + ", about array<double>, stays boolean"


@dataclass(frozen=True)
class Model:
    """Discounts and strengths of the context restaurants and of their parent; sweeps of burn-in, samples after them."""

    discount: float = 0.8
    strength: float = 2.0
    parent_discount: float = 0.5
    parent_strength: float = 10.0
    burn_in: int = 4
    samples: int = 6
    seed: int = 11

    def rng(self, *numbers: int) -> np.random.Generator:
        return np.random.default_rng([self.seed, *[n % (1 << 64) for n in numbers]])

    def predicted(self, gain: np.ndarray, vocabulary: int, totals: np.ndarray) -> np.ndarray:
        """What the parent predicts, given customers less discounted tables of the words, and all its customers and tables."""
        base = 1 / (vocabulary + 1)
        return (gain.astype(float) + (self.parent_strength + self.parent_discount * totals[1]) * base) / (self.parent_strength + totals[0])


@dataclass(frozen=True)
class Words:
    """What everyone knows of the words: tokens, vocabulary, the buckets' names, where each bucket's numbers begin."""

    tokens: int
    vocabulary: int
    names: np.ndarray
    begin: np.ndarray

    @property
    def dtype(self):
        return np.uint32 if self.begin[-1] < 1 << 32 else np.uint64

    def parts(self, numbers: np.ndarray):
        """(bucket name, begin of its numbers, begin, end) of sorted numbers."""
        for b, x, y in parts_of(np.searchsorted(numbers, self.begin)):
            yield int(self.names[b]), self.begin[b], x, y


def word_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0x9DDFEA08EB382D69) ^ mix(b))


def pair_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(context.astype(np.uint64) * np.uint64(0x9DDFEA08EB382D69) ^ mix(word))


# ---- blocks -----------------------------------------------------------------------------------------


def read(docs: pa.Table, modulus: int) -> bytes:
    """A block's documents as ids, numbers of tokens, keys of distinct words in the order of their hashes, each token's word."""
    data, offsets = utf8_buffer(docs.column("text").combine_chunks())
    n = len(offsets) - 1
    # the end, then, as no token, the context at the beginning of texts
    a, b = [np.array([END[0], START[0]], np.uint64)], [np.array([END[1], START[1]], np.uint64)]
    counts, chosen, known = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], 2
    for i, j in chunks_of(offsets, 2 << 20):
        part, own = ASCII_LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends, rows = word_spans(part, own, NOT_BLANK)
        keys = word_keys(part, starts, ends)
        # words are made distinct a part of the texts at a time: nothing wide is held of all tokens
        first, word = grouped(word_hash(*keys), *keys)
        a.append(keys[0][first])
        b.append(keys[1][first])
        chosen.append((word + known).astype(np.int32))
        counts.append(np.bincount(rows, minlength=j - i))
        known += len(first)
    per = np.concatenate(counts).astype(np.int64) + 1
    key_a, key_b = np.concatenate(a), np.concatenate(b)
    first, group = grouped(word_hash(key_a, key_b), key_a, key_b)
    group = group.astype(np.uint16 if len(first) <= 1 << 16 else np.uint32)
    word = np.full(int(per.sum()) + 1, group[0], group.dtype)
    is_word = np.ones(len(word), bool)
    is_word[np.cumsum(per) - 1] = False
    is_word[-1] = False
    word[is_word] = group[np.concatenate(chosen)]
    word[-1] = group[1]
    ids = docs.column("doc_id").combine_chunks()
    null = ids.is_null().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
    held = np.array([zlib.crc32(b"" if no else str(i).encode()) % modulus == HELD_OUT_REMAINDER for i, no in zip(ids.tolist(), null.tolist())], bool)
    return pack(ids, null.astype(np.uint8), held.astype(np.uint8), per.astype(np.int32), key_a[first], key_b[first], word)


class Block:
    """One block's tokens, as distinct words and distinct pairs, and the answers it has."""

    def __init__(self, kept: pa.Table, got: dict, names: np.ndarray):
        self.got, self.names = got, names
        self.ids, self.null, held, self.per, self.a, self.b, word = unpack(kept.column("state")[0].as_py())
        self.trains, self.n, self.token, self.start = held == 0, len(self.per), word[:-1], int(word[-1])
        self.doc = np.repeat(np.arange(self.n, dtype=np.int32), self.per)
        self.token_trains = self.trains[self.doc]

    def ask_words(self) -> list[tuple]:
        """Distinct words with how often they are learnt from here."""
        count = np.bincount(self.token[self.token_trains], minlength=len(self.a))
        cut = cut_by_bucket(word_hash(self.a, self.b), len(self.names))
        return [(int(self.names[b]), pack(self.a[x:y], self.b[x:y], *pack_counts(count[x:y]))) for b, x, y in parts_of(cut)]

    def know_words(self, words: Words) -> None:
        """Each word's number and count, and the customers of each context: as often as the word, but that the end is no
        context, and every text has a beginning."""
        n = len(self.a)
        self.number, self.known = np.empty(n, words.dtype), np.empty(n, np.int64)
        for b, x, y in parts_of(cut_by_bucket(word_hash(self.a, self.b), len(self.names))):
            numbers, *counts, _ = unpack(self.got[WORDS][int(self.names[b])])
            self.number[x:y], self.known[x:y] = numbers + words.begin[b].astype(words.dtype), unpack_counts(*counts)
        self.customers = self.known.copy()
        end = np.flatnonzero((self.a == END[0]) & (self.b == END[1]))
        self.customers[self.start] = self.known[end].sum()
        self.customers[end] = 0

    def find_pairs(self) -> None:
        """Distinct (context, word) pairs in the order of their hashes, and each token's."""
        v = len(self.a)
        context = np.empty_like(self.token)
        context[1:] = self.token[:-1]
        context[np.append(0, np.cumsum(self.per)[:-1])] = self.start
        # a part of the tokens at a time, then what is distinct in the parts
        parts, chosen, known = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], 0
        for at in range(0, len(context), AT_ONCE):
            codes, pair = np.unique(context[at : at + AT_ONCE].astype(np.int64) * v + self.token[at : at + AT_ONCE], return_inverse=True)
            parts.append(codes)
            chosen.append((pair + known).astype(np.int32))
            known += len(codes)
        del context
        codes = np.concatenate(parts)
        del parts
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        new = np.ones(len(codes), bool)
        new[1:] = codes[1:] != codes[:-1]
        pair = np.empty(len(codes), np.int32)
        pair[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        del order
        codes = codes[new]
        context, word = (codes // v).astype(np.int32), (codes % v).astype(np.int32)
        del codes, new
        hashes = pair_hash(self.number[context], self.number[word])
        order = np.argsort(hashes, kind="stable")
        self.context, self.word = context[order], word[order]
        self.cut = cut_by_bucket(hashes[order], len(self.names))
        del hashes
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.pair = place[pair][np.concatenate(chosen)]

    def ask_pairs(self, words: Words) -> list[tuple]:
        """Distinct pairs with how often they are learnt from here."""
        self.know_words(words)
        self.find_pairs()
        share = np.bincount(self.pair[self.token_trains], minlength=len(self.context))
        return [
            (int(self.names[b]), pack(self.number[self.context[x:y]], self.number[self.word[x:y]], *pack_counts(share[x:y])))
            for b, x, y in parts_of(self.cut)
        ]

    def ask_parents(self, words: Words) -> list[tuple]:
        """Words' numbers only, for what the samples say of them."""
        self.know_words(words)
        return [(int(self.names[b]), pack((self.number[x:y] - words.begin[b].astype(words.dtype)))) for b, x, y in parts_of(cut_by_bucket(word_hash(self.a, self.b), len(self.names)))]

    def predict(self, words: Words, totals: list[np.ndarray], model: Model) -> np.ndarray:
        """Each token's probability, averaged over the samples."""
        self.know_words(words)
        self.find_pairs()
        pairs = [unpack(self.got[PAIRS][int(self.names[b])]) for b, _, _ in parts_of(self.cut)]
        count = np.concatenate([unpack_counts(*p[:3]) for p in pairs])
        tables = np.concatenate([unpack_counts(*p[3:]) for p in pairs]) / model.samples
        parents = [unpack(self.got[PARENTS][int(self.names[b])]) for b, _, _ in parts_of(cut_by_bucket(word_hash(self.a, self.b), len(self.names)))]
        customers = (model.strength + self.customers)[self.context]
        p = np.maximum(count - model.discount * tables, 0) / customers
        for s in range(model.samples):
            likely = model.predicted(np.concatenate([x[2 * s] for x in parents]), words.vocabulary, totals[s])
            own = np.concatenate([x[2 * s + 1] for x in parents]).astype(float)
            p += (model.strength + model.discount * own)[self.context] / customers * likely[self.word] / model.samples
        return p[self.pair]

    def score(self, words: Words, totals: list[np.ndarray], model: Model, per_token: bool) -> pa.Table:
        log_p = np.log10(np.maximum(self.predict(words, totals, model), 1e-300))
        smooth = np.log10((self.known + 1) / (words.tokens + words.vocabulary + 1))[self.token]
        out = {
            "doc_id": pa.array(self.ids, pa.int64(), mask=self.null.astype(bool)), "held_out": pa.array(~self.trains), "n_tokens": np.bincount(self.doc, minlength=self.n),
            "n_known": np.bincount(self.doc, self.known[self.token] > 0, self.n).astype(np.int64), "train_tokens": np.full(self.n, words.tokens),
            "base_score": np.bincount(self.doc, smooth, self.n), "score": np.bincount(self.doc, log_p, self.n),
        }
        if per_token:
            out["token_log10"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(self.per)), pa.int32()), pa.array(log_p))
        return pa.table(out)


# ---- holders of words -------------------------------------------------------------------------------


def number_words(payloads: list[bytes]) -> list[bytes]:
    """Numbers and counts of words over all blocks; last come the bucket's tokens, known words, all words, by number their counts."""
    parts = [unpack(p) for p in payloads]
    a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    first, group = grouped(word_hash(a, b), a, b)
    total = np.bincount(group, np.concatenate([unpack_counts(*p[2:]) for p in parts]).astype(float), len(first)).astype(np.int64)
    about = np.array([total.sum(), (total > 0).sum(), len(first)], np.int64)
    return [pack(g.astype(np.uint32), *pack_counts(total[g]), about) for g in np.split(group, np.cumsum([len(p[0]) for p in parts])[:-1])]


@dataclass
class Sums:
    """Sums of tables by word and by context that a bucket of pairs has, and the words it sends them to."""

    dish: np.ndarray
    context: np.ndarray

    def messages(self, words: Words, dish_sum: np.ndarray, context_sum: np.ndarray) -> dict[int, bytes]:
        out: dict[int, list] = {}
        for k, (numbers, sums) in enumerate(((self.dish, dish_sum), (self.context, context_sum))):
            for name, begin, x, y in words.parts(numbers):
                parts = out.setdefault(name, [np.zeros(0, np.uint32), np.zeros(0, np.uint8), np.zeros(0, np.uint32), np.zeros(0, np.int64)] * 2)
                parts[4 * k : 4 * k + 4] = [(numbers[x:y] - begin).astype(np.uint32), *pack_counts(sums[x:y])]
        return {name: pack(*parts) for name, parts in out.items()}

    def answers(self, words: Words, got: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """What the holders say of these words and of these contexts."""
        parts = {name: unpack(p) for name, p in got.items()}
        return tuple(np.concatenate([np.zeros(0, np.float32)] + [parts[name][k] for name, _, _, _ in words.parts(numbers)]) for k, numbers in enumerate((self.dish, self.context)))


def rows_of(name: int, out: list[tuple[int, int, bytes]]) -> pa.Table:
    """Messages (to, kind, payload) of a bucket."""
    to, kind, payload = zip(*out) if out else ((), (), ())
    return pa.table({"block": pa.array(to, pa.int64()), "kind": pa.array(kind, pa.int32()), "bucket": pa.array([name] * len(to), pa.int64()), "payload": pa.array(payload, pa.binary())})


def seat_parent(words: Words, model: Model, sweep: int, scale: float, fixed: dict[int, bytes], further: dict[int, bytes], name: int) -> tuple[list[tuple], bytes, list[float]]:
    """A bucket of words: adds up the tables of its words and contexts (``fixed``: one a pair; ``further``: those beyond),
    draws the parent's tables and the contexts' x. Gives the answers to buckets of pairs, the sample, and its customers and tables."""
    bucket = int(np.flatnonzero(words.names == name)[0])
    size = int(words.begin[bucket + 1] - words.begin[bucket])
    dish, own, asked = np.zeros(size), np.zeros(size), []
    for source in (fixed, further):
        for sender, payload in sorted(source.items()):
            p = unpack(payload)
            # a message has each number once
            dish[p[0]] += unpack_counts(*p[1:4])
            own[p[4]] += unpack_counts(*p[5:8])
            if source is further:
                asked.append((sender, p[0], p[4]))
    rng = model.rng(1, sweep, name)
    weight = np.full(size, np.log(model.parent_discount * scale / (words.vocabulary + 1)))
    tables = draw(dish.astype(np.int64), weight, model.parent_discount, rng)
    x = (model.discount * rng.standard_gamma(model.strength / model.discount + own)).astype(np.float32)
    gain = (dish - model.parent_discount * tables).astype(np.float32)
    return [(sender, SWEEP, pack(gain[d], x[c])) for sender, d, c in asked], pack(gain, own.astype(np.float32)), [float(dish.sum()), float(tables.sum())]


# ---- holders of pairs -------------------------------------------------------------------------------


class Pairs:
    """Pairs of a bucket with several customers: their words, contexts and counts. All others have one table."""

    def __init__(self, context: np.ndarray, word: np.ndarray, n: np.ndarray):
        self.n = n
        dish, self.word = np.unique(word, return_inverse=True)
        own, self.context = np.unique(context, return_inverse=True)
        self.sums = Sums(dish, own)

    def seat(self, words: Words, model: Model, sweep: int, name: int, totals: np.ndarray, got: dict[int, bytes]) -> np.ndarray:
        gain, x = self.sums.answers(words, got)
        likely = model.predicted(gain, words.vocabulary, totals)
        return draw(self.n, np.log(x.astype(float)[self.context] * likely[self.word]), model.discount, model.rng(2, sweep, name))

    def further(self, words: Words, tables: np.ndarray) -> dict[int, bytes]:
        """Tables beyond the first, to the holders of words."""
        more = (tables - 1).astype(float)
        return self.sums.messages(words, np.bincount(self.word, more, len(self.sums.dish)).astype(np.int64), np.bincount(self.context, more, len(self.sums.context)).astype(np.int64))


def count_pairs(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs over all blocks and their counts; each sent pair's place among them; how many each block sent."""
    parts = [unpack(p) for p in payloads]
    context, word = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    if context.dtype == np.uint32:
        codes, group = np.unique(context.astype(np.uint64) << np.uint64(32) | word, return_inverse=True)
        context, word = (codes >> np.uint64(32)).astype(np.uint32), codes.astype(np.uint32)
    else:
        first, group = grouped(pair_hash(context, word), context, word)
        context, word = context[first], word[first]
    n = np.bincount(group, np.concatenate([unpack_counts(*p[2:]) for p in parts]).astype(float), len(context)).astype(np.int64)
    return context, word, n, group.astype(np.uint32 if len(n) <= 1 << 32 else np.uint64), np.array([len(p[0]) for p in parts], np.int64)


def score_documents(docs: DataFrame, model: Model = Model(), id_col: str = "doc_id", text_col: str = "text", modulus: int = HELD_OUT_MODULUS, per_token: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row for each row of ``docs``. With
    ``per_token`` also token_log10, the log10 probability of each token.

    Learns from the rows that are not held out. Null texts count as empty and have one token, the end. Repeated rows
    are learnt and scored each; a null id counts as the id ''. An empty table gives no rows; if nothing is left to learn
    from, all probabilities are uniform. Words and pairs are told apart by their bytes (words of more than 15 bytes by 120
    bits of a cryptographic digest). Other columns are not read. ``base_score`` smooths single words by adding one.
    """
    blocks = Blocks(docs, id_col, text_col, keep=lambda t: read(t, modulus))
    names = blocks.buckets
    answered = blocks.answer(blocks.ask(lambda d, g: Block(d, g, names).ask_words()), WORDS, number_words)
    tokens, vocabulary, begin = _totals(answered, names)
    words = Words(tokens, vocabulary, names, begin)

    def begin_pairs(key, t):
        context, word, n, group, sent = count_pairs(t.column("payload").to_pylist())
        name, some, several = key[0].as_py(), n > 0, n > 1
        # all pairs by word and by context; those with something to draw stay with this bucket
        everyone, rest = Pairs(context[some], word[some], n[some]), Pairs(context[several], word[several], n[several])
        out = [(to, SUMS, p) for to, p in everyone.further(words, np.full(len(everyone.n), 2)).items()]
        out += [(to, SWEEP, p) for to, p in rest.further(words, np.ones(len(rest.n))).items()]
        out.append((name, PAIRS, pack(context[several], word[several], *pack_counts(n[several]))))
        # blocks need not ask again when the tables are known
        return rows_of(name, [*out, (name, PLACES, pack(t.column("block").to_numpy(), sent, group, *pack_counts(n)))])

    asked = blocks.ask(lambda d, g: Block(d, g, names).ask_pairs(words), answered)
    # each sweep reads some kinds only
    counted = written(asked.groupBy("bucket").applyInArrow(begin_pairs, ROW), by="kind")
    state, fixed = counted.where(F.col("kind") == PAIRS), counted.where(F.col("kind") == SUMS)

    def seat_pairs(told: DataFrame, sweep: int, totals: np.ndarray) -> DataFrame:
        """The draws of one sweep, and their sums for the holders of words."""

        def run(key, own, told):
            name = key[0].as_py()
            out = []
            for payload in own.column("payload").to_pylist():
                context, word, *n = unpack(payload)
                pairs = Pairs(context, word, unpack_counts(*n))
                tables = pairs.seat(words, model, sweep, name, totals, by_kind(told, "bucket").get(SWEEP, {}))
                out = [(to, SWEEP, p) for to, p in pairs.further(words, tables).items()] + [(name, DRAWN, pack(*pack_counts(tables)))]
            return rows_of(name, out)

        return state.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, ROW)

    def seat_parents(further: DataFrame, sweep: int, tables: float) -> tuple[DataFrame, np.ndarray]:
        """What a sweep leads to: rows for the next one, and, after the burn-in, rows that stay: the sample's parent and the
        draws of pairs that it comes from, which only pass through here."""
        scale = float(model.rng(3, sweep).standard_gamma(model.parent_strength / model.parent_discount + tables))
        sample = sweep > model.burn_in

        def run(key, t):
            got, name = by_kind(t, "bucket"), key[0].as_py()
            answers, parent, about = seat_parent(words, model, sweep, scale, got.get(SUMS, {}), got.get(SWEEP, {}), name)
            stay = [(name, SAMPLE, parent)] + [(name, DRAWN, p) for p in got.get(DRAWN, {}).values()] if sample else []
            out = rows_of(name, [*answers, *stay, (name, 0, b"")])
            return out.append_column("about", pa.array([None] * (len(out) - 1) + [about], pa.list_(pa.float64()))).append_column("stays", pa.array([False] * len(answers) + [True] * len(stay) + [False]))

        out = written(fixed.unionByName(further).groupBy("block").applyInArrow(run, STEP), by="stays")
        return out, np.array([x or 0.0 for x in out.agg(*[F.sum(F.get("about", F.lit(i))) for i in range(2)]).first()])

    further, tables, kept, totals = counted.where(F.col("kind") == SWEEP), float(vocabulary), [], []
    before = None
    for sweep in range(model.burn_in + model.samples + 1):
        step, total = seat_parents(further, sweep, tables)
        if before is not None:
            files_removed(blocks.spark, before, folder="stays=false")
        if sweep > model.burn_in:
            kept.append(step.where("stays").select("block", (F.col("kind") + 2 * len(kept)).alias("kind"), "bucket", "payload"))
            totals.append(total)
        before, tables = step.where("NOT stays"), float(total[1])
        further = seat_pairs(before.where(F.col("kind") == SWEEP).select("block", "kind", "bucket", "payload"), sweep, total)
    files_removed(blocks.spark, before, folder="stays=false")
    samples = reduce(DataFrame.unionByName, kept)

    def answer_pairs(key, own, drawn):
        """Counts of pairs and their tables summed over the samples."""
        name, draws, to, out = key[0].as_py(), drawn.column("payload").to_pylist(), np.zeros(0, np.int64), []
        for payload in own.column("payload").to_pylist():
            to, sent, group, *n = unpack(payload)
            n = unpack_counts(*n)
            tables, several = np.minimum(n, 1) * model.samples, n > 1
            if several.any():
                tables[several] = sum(unpack_counts(*unpack(p)) for p in draws)
            out = [pack(*pack_counts(n[g]), *pack_counts(tables[g])) for g in np.split(group, np.cumsum(sent)[:-1])]
        return pa.table({"block": to, "kind": pa.array([PAIRS] * len(out), pa.int32()), "bucket": pa.array([name] * len(out), pa.int64()), "payload": pa.array(out, pa.binary())})

    def answer_parents(payloads: list[bytes], name: int, got: dict) -> list[bytes]:
        """What the samples say of the words: what they gain in the parent, and their own tables."""
        parents = [x for s in range(model.samples) for x in unpack(got[SAMPLE + 2 * s][name])] if got else []
        return [pack(*[x[unpack(p)[0]] for x in parents]) if parents else pack(*[np.zeros(len(unpack(p)[0]), np.float32)] * (2 * model.samples)) for p in payloads]

    drawn = samples.where(F.col("kind") % 2 == DRAWN % 2)
    of_pairs = written(counted.where(F.col("kind") == PLACES).groupBy("block").cogroup(drawn.groupBy("block")).applyInArrow(answer_pairs, ANSWER))
    files_removed(blocks.spark, counted)
    asked = blocks.ask(lambda d, g: Block(d, g, names).ask_parents(words), answered)
    of_words = blocks.answer_with(asked, samples.where(F.col("kind") % 2 == SAMPLE % 2), PARENTS, answer_parents)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double" + ", token_log10 array<double>" * per_token
    told = answered.unionByName(of_pairs).unionByName(of_words)
    result = written(blocks.each(lambda _, d, g: Block(d, g, names).score(words, totals, model, per_token), schema, told))
    blocks.drop(answered, of_pairs, of_words, *kept)
    return result


def _totals(answered: DataFrame, names: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Tokens, vocabulary, and where each bucket's numbers begin: three numbers a bucket."""

    def run(batches):
        for b in batches:
            about = [unpack(x)[-1].tolist() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(about, pa.list_(pa.int64()))], names=["bucket", "x"])

    one = answered.groupBy("bucket").agg(F.first("payload").alias("payload")).mapInArrow(run, "bucket long, x array<long>").collect()
    found = {r["bucket"]: r["x"] for r in one}
    about = np.array([found.get(int(n), (0, 0, 0)) for n in names], np.int64).reshape(-1, 3)
    return int(about[:, 0].sum()), int(about[:, 1].sum()), np.append(0, np.cumsum(about[:, 2])).astype(np.uint64)
