"""The hierarchical Pitman-Yor model: the law of tables, predictions that add up, and a brute-force sampler of the same model."""

import collections
import random
import zlib
from math import lgamma

import numpy as np
import pytest

from graphloom.llm import hpyp, tables
from graphloom.llm.blocks import grouped, pack, unpack

HELD_OUT = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 7 == 2]
LEARNT = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 7 != 2]


@pytest.mark.parametrize("d", [0.3, 0.5, 0.8])
def test_stirling_by_contour(d):
    """The integral against the recurrence."""
    exact = tables.log_stirling(d, 2000)
    for n in (65, 700, 1025, 2000):
        t = np.arange(1, n + 1)
        error = np.abs(tables.log_stirling_by_contour(d, np.full(n, n), t) + lgamma(n + 1) - exact[n, 1 : n + 1])
        assert error[: int(0.9 * n)].max() < 1e-8 and error.max() < 2e-4


@pytest.mark.parametrize("d, n, a", [(0.8, 2, 0.3), (0.6, 12, 1.7), (0.8, 60, 0.5), (0.5, 900, 3.0), (0.8, 1500, 0.5), (0.8, 1500, 50.0), (0.5, 2000, 0.01), (0.5, 2000, 1e4), (0.3, 1100, 3.0)])
def test_draws_follow_the_law(d, n, a):
    """Frequencies of drawn numbers of tables against S(n, t) * a**t, on both sides of the recurrence's table."""
    log_p = tables.log_stirling(d, 2000)[n, 1 : n + 1] + np.arange(1, n + 1) * np.log(a)
    p = np.exp(log_p - log_p.max())
    p /= p.sum()
    size = 8000
    got = np.bincount(tables.draw(np.full(size, n), np.full(size, np.log(a)), d, np.random.default_rng(1)), minlength=n + 1)[1:]
    often = p * size > 10
    z = (got - p * size)[often] / np.sqrt((p * (1 - p) * size)[often] + 1e-9)
    assert abs((z**2).mean() - 1) < 5 * np.sqrt(2 / often.sum()) or (often.sum() <= 2 and np.abs(z).max() < 4)
    assert abs(got[~often].sum() - p[~often].sum() * size) < 5 * np.sqrt(p[~often].sum() * size + 1)


def test_draws_at_large_counts():
    """A draw costs the same whatever the count, and few and no customers are trivial."""
    got = tables.draw(np.array([0, 1, 10**6, 10**12, 10**12]), np.log([1.0, 1.0, 1.0, 5.0, 1e6]), 0.8, np.random.default_rng(0))
    assert got[:2].tolist() == [0, 1] and (got[2:] >= 1).all() and got[4] > 1e6


def test_keys_with_one_hash_stay_apart():
    first, group = grouped(np.array([7, 7, 7, 3, 7], np.uint64), np.array([1, 2, 1, 9, 2], np.uint64))
    assert len(first) == 3 and group[0] == group[2] and group[1] == group[4] and len(set(group.tolist())) == 3


def brute_force(corpus, model, sweeps, burn_in, seed=0):
    """Customers reseated one by one, the parent's with them; averaged predictions {(context, word): p} and of an unknown word."""
    rng = random.Random(seed)
    pairs = [(u, w) for text in corpus for u, w in zip([None, *text], [*text, "<end>"])]
    vocabulary = sorted({w for _, w in pairs})
    base = 1 / (len(vocabulary) + 1)
    own = collections.defaultdict(lambda: collections.defaultdict(list))
    parent = collections.defaultdict(list)

    def likely(w):
        c, t = sum(map(sum, parent.values())), sum(map(len, parent.values()))
        return (sum(parent[w]) - model.parent_discount * len(parent[w]) + (model.parent_strength + model.parent_discount * t) * base) / (model.parent_strength + c)

    def sit(tables_, discount, new):
        weights = [n - discount for n in tables_] + [new]
        k = rng.choices(range(len(weights)), weights)[0]
        if k == len(tables_):
            tables_.append(1)
            return True
        tables_[k] += 1
        return False

    def leave(tables_):
        k = rng.choices(range(len(tables_)), tables_)[0]
        tables_[k] -= 1
        if not tables_[k]:
            del tables_[k]
            return True
        return False

    def add(u, w):
        t = sum(map(len, own[u].values()))
        if sit(own[u][w], model.discount, (model.strength + model.discount * t) * likely(w)):
            t0 = sum(map(len, parent.values()))
            sit(parent[w], model.parent_discount, (model.parent_strength + model.parent_discount * t0) * base)

    def predict(u, w, p0):
        c, t = sum(map(sum, own[u].values())), sum(map(len, own[u].values()))
        return (sum(own[u][w]) - model.discount * len(own[u][w]) + (model.strength + model.discount * t) * p0) / (model.strength + c)

    for u, w in pairs:
        add(u, w)
    total = collections.Counter()
    for sweep in range(burn_in + sweeps):
        for u, w in pairs:
            if leave(own[u][w]):
                leave(parent[w])
            add(u, w)
        if sweep >= burn_in:
            p0 = {w: likely(w) for w in [*vocabulary, "<?>"]}
            for u in list(own):
                for w in p0:
                    total[u, w] += predict(u, w, p0[w]) / sweeps
    return total


def in_process(corpus, model, sweeps, burn_in):
    """The operator's own steps on one bucket, sweep after sweep, without Spark."""
    pairs = collections.Counter((u, w) for text in corpus for u, w in zip([None, *text], [*text, "<end>"]))
    names = sorted({w for _, w in pairs}) + [None]
    number = {w: i for i, w in enumerate(names)}
    v = len(names) - 1
    words = hpyp.Words(sum(pairs.values()), v, np.array([0]), np.array([0, v + 1], np.uint64))
    context, word, n = (np.array(x) for x in zip(*[(number[u], number[w], c) for (u, w), c in pairs.items()]))
    everyone, some = hpyp.Pairs(context.astype(np.uint32), word.astype(np.uint32), n), n > 1
    rest = hpyp.Pairs(context[some].astype(np.uint32), word[some].astype(np.uint32), n[some])
    fixed = everyone.further(words, np.full(len(n), 2))
    further, drawn, t0, out, kept = rest.further(words, np.ones(len(rest.n))), np.ones(some.sum()), float(v), collections.Counter(), 0
    customers = np.bincount(context, n, v + 1)
    for sweep in range(burn_in + sweeps + 1):
        scale = float(model.rng(3, sweep).standard_gamma(model.parent_strength / model.parent_discount + t0))
        answers, parent, about = hpyp.seat_parent(words, model, sweep, scale, {0: fixed[0]}, {0: further[0]}, 0)
        t0 = about[1]
        if sweep > burn_in:
            gain, own = unpack(parent)
            likely = model.predicted(np.append(gain[:-1], 0), v, np.array(about))
            tables_ = np.ones(len(n))
            tables_[some] = drawn
            p = (model.strength + model.discount * own.astype(float))[:, None] * likely[None, :]
            p[context, word] += n - model.discount * tables_
            p /= (model.strength + customers)[:, None]
            assert np.allclose(p.sum(axis=1), 1, atol=1e-6)
            for u in names:
                for w in [*names[:-1], "<?>"]:
                    out[u, w] += p[number[u], number.get(w, v)] / sweeps
        drawn = rest.seat(words, model, sweep, 0, np.array(about), {0: answers[0][2]})
        further = rest.further(words, drawn)
    return out


def small_corpus():
    rng = random.Random(3)
    return [[rng.choice("aaaabbbccd") for _ in range(rng.randint(2, 9))] for _ in range(25)] + [["a", "b"] * 12, ["e", "f"]]


def test_sampler_against_brute_force():
    corpus, model = small_corpus(), hpyp.Model()
    want, got = brute_force(corpus, model, 400, 50), in_process(corpus, model, 400, 50)
    assert max(abs(want[k] - got[k]) for k in want) < 0.02
    # the query's own sweeps
    short = in_process(corpus, model, model.samples, model.burn_in)
    assert max(abs(want[k] - short[k]) for k in want) < 0.05


def test_predictions_sum_to_one(spark):
    """score_documents itself: in every context the vocabulary, the end and an unknown word have probability one together."""
    corpus = [" ".join(t) for t in small_corpus()]
    rows = list(zip(LEARNT, corpus))
    vocabulary = sorted({w for t in corpus for w in t.split()})
    probes = [""] + [f"{u} {w}".strip() for u in ["", *vocabulary] for w in [*vocabulary, "unknown-word-of-many-letters"]]
    rows += list(zip(HELD_OUT, probes))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in hpyp.score_documents(df, per_token=True).collect()}
    p = {probe: [10**x for x in got[i]["token_log10"]] for i, probe in zip(HELD_OUT, probes)}
    assert all(abs(sum(r["token_log10"]) - r["score"]) < 1e-9 and len(r["token_log10"]) == r["n_tokens"] for r in got.values())
    words = [*vocabulary, "unknown-word-of-many-letters"]
    assert abs(p[""][0] + sum(p[w][0] for w in words) - 1) < 1e-6
    for u in vocabulary:
        assert abs(sum(p[f"{u} {w}"][1] for w in words) + p[u][1] - 1) < 1e-6
    want = brute_force([t.split() for t in corpus], hpyp.Model(), 300, 50)
    assert max(abs(p[f"{u} {w}"][1] - want[u, w]) for u in vocabulary for w in vocabulary) < 0.05
    # buckets and partitions do not change what is counted; nothing to learn from is the uniform law
    none = spark.createDataFrame([(HELD_OUT[0], "x y")], "doc_id long, text string")
    assert abs(hpyp.score_documents(none).first()["score"]) < 1e-9


def test_long_and_colliding_words(spark):
    """Words that differ in one byte only, far into a long one, are two words; a long text is read whole."""
    long = "q" * 5000
    rows = [(LEARNT[0], f"{long}a {long}b " + "x " * 60_000), (LEARNT[1], f"{long}a"), (HELD_OUT[0], f"{long}c {long}a")]
    got = {r["doc_id"]: r for r in hpyp.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[LEARNT[0]]["n_tokens"] == 60_003 and got[HELD_OUT[0]]["n_known"] == 2 and got[LEARNT[0]]["train_tokens"] == 60_005


def test_blocks_hold_nothing_wide_of_all_tokens():
    """Reading a block and finding its pairs takes memory for its distinct words and pairs, and little for each token."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(5)
    own = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(300)]
    docs = pa.table({"doc_id": list(range(400)), "text": [" ".join(rng.choices(own, k=5000)) for _ in range(400)]})
    tokens = 400 * 5001
    tracemalloc.start()
    kept = pa.table({"state": pa.array([hpyp.read(docs, 7)], pa.binary())})
    # before: 79 bytes a token
    assert tracemalloc.get_traced_memory()[1] < 48 * tokens
    names = np.arange(3)
    answered = {b: hpyp.number_words([p])[0] for b, p in hpyp.Block(kept, {}, names).ask_words()}
    begin = np.append(0, np.cumsum([unpack(answered[b])[-1][2] for b in range(3)])).astype(np.uint64)
    tracemalloc.reset_peak()
    block = hpyp.Block(kept, {hpyp.WORDS: answered}, names)
    asked = block.ask_pairs(hpyp.Words(tokens, 301, names, begin))
    assert tracemalloc.get_traced_memory()[1] < 48 * tokens
    tracemalloc.stop()
    pairs = collections.Counter()
    for i, text in enumerate(docs.column("text").to_pylist()):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            pairs.update(zip([None, *text.split()], [*text.split(), None]))
    # what is held out asks too, with a count of zero
    counts = [c for _, p in asked for c in hpyp.unpack_counts(*unpack(p)[2:])]
    assert sorted(c for c in counts if c) == sorted(pairs.values())
    assert len(block.pair) == tokens and block.pair.max() == len(counts) - 1


def test_pairs_are_asked_for_once(spark, monkeypatch):
    """Blocks send their words, their pairs and their words' numbers, each once; buckets keep where each block's pairs are."""
    asks, ask = [], hpyp.Blocks.ask

    def counted(self, *args):
        asks.append(ask(self, *args))
        return asks[-1]

    monkeypatch.setattr(hpyp.Blocks, "ask", counted)
    rows = [(i, " ".join(f"w{(i * k) % 7}" for k in range(i + 1))) for i in range(40)]
    got = hpyp.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(40)) and all(r["score"] < 0 for r in got)
    assert len(asks) == 3
