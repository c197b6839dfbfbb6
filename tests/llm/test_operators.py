"""Operators against brute force, exact round trips and held-out accuracy, with nulls, ties, repeats and empty tables."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from graphloom.llm import bpe, hpyp, jaccard, licenses, media_ts, packing, quality, simhash, suffix_dedup, topk, toxicity
from graphloom.llm.queries import tokenizer_path
from graphloom.llm.training import sample_rows, shuffled

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, piece int, block int"


def words(rng, n):
    stock = ["alpha", "beta", "gamma", "Delta", "épsilon", "zeta,", "eta.", "theta", "iota!", "kappa"]
    return " ".join(rng.choice(stock) + rng.choice(["", "x", "yy"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    passage = words(rng, 30)
    out = [words(rng, rng.randint(1, 120)) for _ in range(40)]
    out += [words(rng, 20) + " " + passage + " " + words(rng, 9) for _ in range(5)]
    out += [out[3], out[3], out[7] + " tail", "x " + out[7], "", None, "  ", "a", passage, "日本語 テキスト", "aaaa" * 60, "aaaa" * 50, "one\ntwo\tthree  four", "<|endoftext|> x"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None, None, 0.5, 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd_docs(spark, texts):
    """Null ids, repeated rows, everything else null."""
    rows = [(None, texts[0], *[None] * 6), (None, None, *[None] * 6), (1, texts[1], *[None] * 6), (1, texts[1], *[None] * 6), (2, texts[0], *[None] * 6)]
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df):
    rows = {r["doc_id"]: r for r in df.collect()}
    return rows


def top_k_by_brute_force(rows, is_query, k=5):
    """rows: (id, whole vector), every row a query and a candidate of its own."""
    out = []
    for i, (q, v) in enumerate(rows):
        if is_query(q):
            scores = [(-sum(x * y for x, y in zip(v, w)), c, j) for j, (c, w) in enumerate(rows) if j != i and len(w) == len(v)]
            out += [(q, r + 1, c, -s) for r, (s, c, _) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(0, 0.2, (900, 8)).astype(np.float32)
    v[100:140] = v[50]  # ties
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)]
    rows += [(50, rows[50][1], 1), (50, rows[51][1], 1)]  # a query row twice, and another with its id
    good = [(i, [math.floor(256 * x) for x in r]) for i, r, _ in rows]
    odd = [(2000, None, 0), (2050, [1.0, None], 0), (2100, [float("nan")] * 8, 0), (2150, [], 0), (2151, [], 0), (2200, [float("inf")] * 8, 0), (None, [0.1] * 8, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int")
    got = sorted(tuple(r) for r in topk.top_k(df, lambda i: i % 50 == 0).collect())
    assert got == top_k_by_brute_force(good + [(2150, []), (2151, [])], lambda i: i % 50 == 0)
    assert topk.top_k(df.limit(0), lambda i: i % 50 == 0).collect() == []


@pytest.mark.parametrize("dims, large", [(2, 20_000.0), (1024, 20_000.0), (3, 1e12)])
def test_top_k_of_large_components(spark, dims, large):
    """Products beyond what doubles hold exactly, that differ in their last digits only."""
    rng = np.random.default_rng(2)
    rows = [(i, [large + float(x) / 256 for x in rng.integers(0, 3, dims)]) for i in range(60)]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0).collect()) if large < 1e6 else None
    if got is None:
        with np.errstate(over="ignore"):
            assert topk.exact_type(np.array([[2**50]]), np.array([[2**50]])) is object
        return
    assert got == top_k_by_brute_force([(i, [math.floor(256 * x) for x in v]) for i, v in rows], lambda i: i % 20 == 0)


def test_shards_that_cannot_help_are_not_searched(spark):
    """Clusters far apart: most shards' boxes stay below every floor."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (40, 6))
    rows = [(i, [float(x) for x in centres[i % 40] * 3 + rng.normal(0, 0.02, 6)]) for i in range(12_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    told = topk.top_k(df, lambda i: i % 4000 == 0, report=True).collect()
    assert all(r["searched"] <= r["shards"] for r in told) and sum(r["searched"] for r in told) < sum(r["shards"] for r in told)


def test_transport_stream(docs, texts, odd_docs):
    got = by_id(media_ts.read(media_ts.store(docs)))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = media_ts.padded(raw)
        r = got[i]
        assert bytes(r["payload"]) == payload and r["n_bytes"] == len(raw) and r["payload_bytes"] == len(payload)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_bytes"] % 188 == 0 and r["discontinuities"] == 0
    assert media_ts.read(media_ts.store(odd_docs)).count() == 5
    assert media_ts.read(media_ts.store(docs.limit(0))).collect() == []


@pytest.mark.parametrize("n", [0, 1, 63, 64, 150, 168, 169, 170, 184, 352, 354, 16383, 16384, 16385, 300_001])
def test_mux(n):
    data = np.random.default_rng(n).integers(0, 256, n, np.uint8).tobytes()
    stream = media_ts.mux(data)
    got = media_ts.demux(stream)
    assert got["payload"] == data and got["discontinuities"] == 0 and got["random_access"][0] == 0
    units = max(1, -(-n // media_ts.UNIT_BYTES))
    assert len(got["pts"]) == units and got["pts"] == sorted(got["pts"])
    assert got["random_access"] == list(range(0, units, media_ts.ACCESS_EVERY))


def test_damaged_streams():
    stream = bytearray(media_ts.mux(b"x" * 5000))
    with pytest.raises(media_ts.BrokenStream):
        media_ts.demux(bytes(stream[:-1]))
    lost = bytes(stream[: 188 * 5]) + bytes(stream[188 * 6 :])
    with pytest.raises(media_ts.BrokenStream):
        media_ts.demux(lost)
    stream[10] ^= 1
    with pytest.raises(media_ts.BrokenStream):
        media_ts.demux(bytes(stream))


def test_bpe(docs, texts, odd_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = by_id(bpe.round_trip(docs, tokenizer_path()))
    plain = by_id(bpe.decode_documents(bpe.encode_documents(docs, tokenizer_path()), tokenizer_path()))
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert plain[i]["text"] == (text or "")
    assert bpe.round_trip(odd_docs, tokenizer_path()).count() == 5
    assert bpe.round_trip(docs.limit(0), tokenizer_path()).collect() == []


def test_bpe_merges_a_word_once(monkeypatch):
    """A word with a mark behind it is not merged again, whether the bare word came before or comes along."""
    own, merged = bpe.ByteBPE(tokenizer_path()), []
    plain = own.encode_words
    monkeypatch.setattr(own, "encode_words", lambda words: merged.extend(words) or plain(words))
    texts = ["x alphabet betamax", "x alphabet, betamax! gammaray. alphabet", "x gammaray; deltawing?"]
    got = [own.encode_batch([t])[0] for t in texts]
    for w in (b" alphabet", b" betamax", b" gammaray", b" deltawing"):
        assert merged.count(w) == 1
    assert got == bpe.ByteBPE(tokenizer_path()).encode_batch(texts)
    assert [own.decode_bytes(np.frombuffer(g, "<i4").tolist()).decode() for g in got] == texts


def test_bpe_odd_spaces():
    from tokenizers import Tokenizer

    t, own, rng = Tokenizer.from_file(tokenizer_path()), bpe.load(tokenizer_path()), random.Random(3)
    alphabet = ["a", "Bé", "12", ".", ",", "!?", " ", " ", "  ", "\n", "\t", " ", " ", "'s", "'ll", "日", "\x1c", "\x85", "\r\n", "x" * 70]
    cases = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for case, ids in zip(cases, own.encode_batch(cases)):
        assert np.frombuffer(ids, "<i4").tolist() == t.encode(case, add_special_tokens=False).ids, repr(case)


@pytest.mark.parametrize("rule", ["residual_norm", "dot_product"])
@pytest.mark.parametrize("capacity", [packing.Capacity(32), packing.Capacity(32, documents=3), packing.Capacity(32, attention=700)])
def test_packing(spark, rule, capacity):
    rng = random.Random(2)
    longest = 26 if capacity.attention else 32
    rows = [(rng.choice([i, 7, None]), 0, rng.randint(1, longest), "x") for i in range(3000)] + [(i, 1, longest, "y") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long, other string")
    got = packing.pack_pieces(df, capacity, rule).collect()
    assert len(got) == len(rows)
    inside = collections.defaultdict(list)
    for r in got:
        inside[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for parts in inside.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 32 and len(parts) <= (capacity.documents or 32) and sum(n * n for _, n in parts) <= (capacity.attention or 1024)
        total += at
    if capacity == packing.Capacity(32) and rule == "residual_norm":
        assert len(inside) <= 1.02 * total / 32
    assert packing.pack_pieces(df.limit(0), capacity, rule).collect() == []


def test_pack_documents(docs, texts, odd_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = packing.pack_documents(docs, tokenizer_path(), packing.Capacity(64)).collect()
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(pieces[i], key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(own):
            assert (r["piece"], r["start"]) == (k, at) and (r["length"] == 64 or k == 0)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert packing.pack_documents(odd_docs, tokenizer_path()).count() == 5
    assert packing.pack_documents(docs.limit(0), tokenizer_path()).collect() == []


def removed_by_brute_force(rows, length):
    first = {}
    for i, t in rows:
        for k in range(len(t) - length + 1):
            s = t[k : k + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        out.append((i, len(t), sum(gone), sum(g and not p for g, p in zip(gone, [False, *gone])), hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out)


def test_suffix_dedup(docs, texts, odd_docs):
    rows = [(i, (t or "").encode()) for i, t in enumerate(texts)]
    got = sorted(tuple(r) for r in suffix_dedup.mark_repeats(docs).collect())
    assert got == removed_by_brute_force(rows, 50)
    last = suffix_dedup.LAST
    odd = [(last if r["doc_id"] is None else r["doc_id"], (r["text"] or "").encode()) for r in odd_docs.collect()]
    got = sorted((last if r[0] is None else r[0], *r[1:]) for r in map(tuple, suffix_dedup.mark_repeats(odd_docs).collect()))
    assert got == removed_by_brute_force(odd, 50)
    assert suffix_dedup.mark_repeats(docs.limit(0)).collect() == []


def test_suffix_dedup_on_few_letters(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 150))) * rng.choice([1, 1, 4])) for i in range(60)]
    got = sorted(tuple(r) for r in suffix_dedup.mark_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect())
    assert got == removed_by_brute_force([(i, t.encode()) for i, t in rows], 20)


def test_remaining_text(docs, texts):
    out = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert out[0]["text"] == texts[0] and set(out[0].asDict()) == set(docs.columns)
    later = texts.index(texts[3], 4)
    assert later not in out  # a copy of which nothing is left


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(150):
        t = [rng.randint(1, rng.choice([1, 2, 250])) for _ in range(rng.randint(0, 70))] + [0]
        assert suffix_dedup.suffix_array(np.array(t, np.uint16), 258).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_licenses(spark, docs):
    mit = dict(licenses.KNOWN_LICENSES)["MIT"]
    rows = [(0, mit), (1, "Copyright (c) 2020 A. Person\nAll rights reserved.\n\n" + mit.upper().replace(",", " ;")), (2, mit + " x"), (3, None), (4, ""), (5, mit.replace("and/or", "and - or")), (None, mit), (0, mit)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["license_id"]) for r in licenses.scan(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(0, "MIT"), (1, "MIT"), (2, None), (3, None), (4, None), (5, "MIT"), (None, "MIT"), (0, "MIT")]))
    other = licenses.known_licenses(spark, [("Own", "The Licence"), ("Z", "the  license!")])
    assert [r["license_id"] for r in licenses.scan(spark.createDataFrame([(1, "The license.")], "doc_id long, text string"), other).collect()] == ["Own"]
    assert licenses.scan(docs.limit(0)).collect() == []


def simhash_by_brute_force(rows):
    fps = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)].append(d)
    return sorted(str((d, f"{fps[i]:016x}", min(ids[find(i)], default=None))) for i, (d, _) in enumerate(rows))


def test_simhash(docs, texts, odd_docs):
    assert sorted(str(tuple(r)) for r in simhash.near_duplicates(docs).collect()) == simhash_by_brute_force(list(enumerate(texts)))
    odd = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert sorted(str(tuple(r)) for r in simhash.near_duplicates(odd_docs).collect()) == simhash_by_brute_force(odd)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns and kept.count() == len({r["component_id"] for r in simhash.near_duplicates(docs).collect()})


def test_covering_masks():
    rng, masks = random.Random(4), simhash.covering_masks(3, list(range(64)))
    assert len(masks) == 15
    for _ in range(3000):
        d = sum(1 << p for p in rng.sample(range(64), rng.randint(1, 3)))
        assert any(d & m == 0 for m in masks)


@pytest.mark.parametrize("bucket", [4, 4096])
def test_links_of_crowded_buckets(spark, bucket):
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    fps = {centre} | {centre ^ sum(1 << p for p in rng.sample(range(64), rng.randint(1, 9))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)}
    nodes = list(enumerate(sorted(fps)))
    df = spark.createDataFrame([(i, simhash.signed(f)) for i, f in nodes], "node long, fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.near_links(df, 3, bucket)).collect()}
    parent = {i: i for i, _ in nodes}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i, f in nodes:
        for j, g in nodes[:i]:
            if (f ^ g).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert all(roots.get(i, i) == find(i) for i, _ in nodes)


def first_of_groups_by_jaccard(rows):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[find(i)] = min(d, first.get(find(i), d))
    return set(first.values())


def test_near_copies_by_jaccard(spark, docs, texts, odd_docs):
    """The pipeline's stage against brute force: copies with a few words changed, most of them over 3 bits apart by simhash."""
    import corpus_pipeline

    rng = random.Random(12)
    rows = []
    for k in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(30, 200))]
        for copy in range(25 if k == 0 else 5):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = f"n{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(w + ["the", "same", "footer", "in", "every", "text"])))
    whole = [(i, t, *[None] * 6) for i, t in rows]
    rng.shuffle(whole)
    got = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(whole, SCHEMA).repartition(3), None)
    kept = {r["doc_id"] for r in got.collect()}
    assert kept == first_of_groups_by_jaccard(rows)
    assert len(kept) < simhash.one_of_each_group(spark.createDataFrame(whole, SCHEMA)).count()
    assert {r["doc_id"] for r in jaccard.one_of_each_group(docs).collect()} == first_of_groups_by_jaccard(list(enumerate(texts)))
    odd = jaccard.one_of_each_group(odd_docs)
    assert odd.columns == odd_docs.columns and sorted(str(r["doc_id"]) for r in odd.collect()) == ["1", "1", "2", "None", "None"]
    assert jaccard.one_of_each_group(docs.limit(0)).collect() == []


def labelled(spark, n=700):
    rng, rows, labels = random.Random(6), [], []
    for i in range(n):
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        w = words(rng, rng.randint(5, 80)).split()
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["nastyword", "uglyterm", "badthing"])
        t = " ".join(w) if good else "!! ".join(w).upper() + "!!"
        rows.append((i, t if i else None, "en", None, None, 0.0, 0, 0))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + [(None, 1, 1), (5, None, None), (9999, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifiers(spark, kind):
    docs, labels = labelled(spark)
    module = quality if kind == "quality" else toxicity
    model = module.fit_on(docs, labels)
    truth = {r["doc_id"]: r[kind] for r in labels.collect() if r[kind] is not None}
    got = module.score_documents(docs, model).collect()
    out = [(r["doc_id"], r["predicted"]) for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and r["doc_id"]]
    assert len(out) > 100 and np.mean([truth[i] == p for i, p in out]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == 700
    kept = (quality.keep_good if kind == "quality" else toxicity.keep_clean)(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == (kind == "quality") for r in got)
    assert module.score_documents(docs.limit(0), model).collect() == []
    nothing = module.fit_on(docs, labels.limit(0))
    assert module.score_documents(docs, nothing).count() == 700


def test_sample_is_bounded_and_not_held_out(spark):
    docs, labels = labelled(spark)
    texts_, y = shuffled(sample_rows(docs, labels, "quality", rows=50).collect())
    assert len(texts_) <= 50 and len(y) == len(texts_)
    own = {(r["text"] or "").encode(): r["doc_id"] for r in docs.collect()}
    assert all(zlib.crc32(str(own[t]).encode()) % 4 != 2 for t in texts_)


def score_one_by_one(model, text):
    """The network on one text, byte by byte and step by step."""
    data = np.frombuffer(text, np.uint8)
    spans = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", text)]
    flag = np.zeros(len(data))
    for (a, b), (c, d) in zip(spans, spans[1:]):
        if text[a:b] == text[c:d]:
            flag[c:d] = 1
    steps = -(-len(data) // quality.STEP)
    chunks = max(1, -(-(steps - (quality.CHUNK - quality.HOP)) // quality.HOP))
    room = (chunks - 1) * quality.HOP + quality.CHUNK + quality.TAPS - 1
    rows = np.zeros((room * quality.STEP, quality.EMBED + 1))
    rows[:, :-1] = model.embedding[0]
    for i, x in enumerate(data):
        rows[i] = [*model.embedding[int(x) + 1], flag[i]]
    rows = rows.reshape(room, -1)
    most = []
    for c in range(chunks):
        out = [np.maximum(sum(rows[p + k] @ model.filters[k] for k in range(quality.TAPS)) + model.filter_bias, 0) for p in range(c * quality.HOP, c * quality.HOP + quality.CHUNK)]
        most.append(np.max(out, axis=0))
    z = np.concatenate([np.max(most, axis=0), np.mean(most, axis=0)]) @ model.out + model.bias
    return 1 / (1 + np.exp(-z))


def test_quality_scores_do_not_depend_on_neighbours():
    """Against a plain form of the network, for texts that just fill chunks and end in what no other text has, in any order."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    width = quality.STEP * (quality.EMBED + 1)
    model = quality.ByteCNN(rng.normal(0, 0.5, (257, quality.EMBED)).astype(np.float32), rng.normal(0, 0.2, (quality.TAPS, width, quality.FILTERS)).astype(np.float32), rng.normal(0, 0.1, quality.FILTERS).astype(np.float32), rng.normal(0, 0.3, 2 * quality.FILTERS).astype(np.float32), 0.1)
    model.embedding[0] = 0
    texts = [("same same other " * 100)[: n - 4] + "~#}{" for n in (4, 100, 255, 256, 257, 480, 704, 705, 1500)] + ["", None, "é" * 300]
    want = {t: score_one_by_one(model, (t or "").encode()) for t in texts}
    for order in (range(len(texts)), reversed(range(len(texts))), [6], [3, 3], [5, 0]):
        chosen = [texts[i] for i in order]
        assert np.allclose(model.scores(pa.array(chosen, pa.string())), [want[t] for t in chosen], atol=1e-5)


def test_quality_learns_from_whole_texts():
    """What tells the labels apart stands beyond the first 16 KB of a text."""
    rng = random.Random(4)
    texts_ = [(words(rng, 3000) + (" !!!!####" * 40 if i % 2 else "") + words(rng, 50)).encode() for i in range(60)]
    model = quality.fit(texts_, np.array([i % 2 for i in range(60)], float), passes=12)
    import pyarrow as pa

    got = model.scores(pa.array([t.decode() for t in texts_]))
    assert np.mean((got > 0.5) == (np.arange(60) % 2 == 1)) > 0.9


def test_long_text_is_read_to_its_end(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit_on(docs, labels)
    clean = "alpha beta gamma " * 60_000
    df = spark.createDataFrame([(1, clean), (2, clean + "nastyword")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(df, model).collect()}
    assert got[2] > got[1]


def test_hpyp(docs, texts, odd_docs):
    got = by_id(hpyp.score_documents(docs))
    rows = {i: [*re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())), None] for i, t in enumerate(texts)}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in rows}
    count = collections.Counter(w for i, ws in rows.items() if not out[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in rows.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(ws), sum(w in count for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert -1e9 < r["score"] < 0
    trained = [i for i in rows if not out[i]]
    assert sum(got[i]["score"] for i in trained) > sum(got[i]["base_score"] for i in trained)
    assert hpyp.score_documents(odd_docs).count() == 5
    assert hpyp.score_documents(docs.limit(0)).collect() == []


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark)
    docs = docs.drop("score", "piece", "block")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, now = now, spark.read.parquet(str(tmp_path / name))
        if name == "near_duplicates":
            groups = {r["component_id"] for r in simhash.near_duplicates(before).collect()}
            assert {r["doc_id"] for r in now.collect()} == groups
        if name == "repeats":
            kept = {r["doc_id"]: r["text"] for r in now.collect()}
            brute = removed_by_brute_force([(r["doc_id"], (r["text"] or "").encode()) for r in before.collect()], 50)
            assert set(kept) == {i for i, n, gone, *_ in brute if gone < n or not gone}
    assert now.agg({"length": "max"}).first()[0] <= 1024


@pytest.mark.parametrize("shape", ["path", "random", "star", "loops", "empty"])
def test_components_of_any_shape(spark, shape):
    rng = np.random.default_rng(5)
    order = rng.permutation(300).tolist()
    links = {
        "path": list(zip(order, order[1:])), "random": rng.integers(0, 300, (200, 2)).tolist(), "star": [(7, i) for i in range(300)],
        "loops": [(3, 3), (1, 2), (2, 1), (1, 2)], "empty": [],
    }[shape]
    parent = {x: x for pair in links for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame([tuple(p) for p in links], "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


#: Where a machine may have the texts, and the identifiers of their file names.
LICENSE_FILES = "/usr/share/common-licenses"
LICENSE_NAMES = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


def test_whole_license_files(spark, tmp_path):
    """Longer licences are known in other case, punctuation and spelling; titled ones with their titles; the SQL agrees."""
    rows = [(f"{title}\n\nCopyright (c) 2020 Someone\n\n{text}", name) for name, text in licenses.KNOWN_LICENSES for title in licenses.TITLES.get(name, [])]
    for file, name in LICENSE_NAMES.items():
        path = os.path.join(LICENSE_FILES, file)
        if os.path.exists(path):
            with open(path) as f:
                text = f.read()
            rows += [(text, name), (re.sub(r"\bLICENSE(S?)\b", r"LICENCE\1", text.upper()).replace(",", " ; "), name), (text + " and more", None)]
    rows += [("Copyright 2020 by nobody", None), (None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: (r["digest"], r["license_id"]) for r in licenses.scan(df).collect()}
    assert [got[i][1] for i in range(len(rows))] == [name for _, name in rows]
    df.coalesce(1).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    assert {i: (d, n) for i, d, n in con.execute(f"SELECT doc_id, digest, license_id FROM ({licenses.oracle_sql()})").fetchall()} == got


def test_repeats_send_few_messages(spark, monkeypatch):
    """A bucket of stretches answers for four blocks, so that messages grow slower; results do not depend on either size."""
    asked = []

    class Counted(suffix_dedup.Blocks):
        def __init__(self, *args, **kwargs):
            super().__init__(*args, **kwargs)
            asked.append((self.docs.count(), len(self.buckets)))

    rng = random.Random(8)
    shared = words(rng, 60)
    docs = spark.createDataFrame([(i, words(rng, 40) + shared[: 40 + 8 * (i % 30)] + words(rng, 40)) for i in range(400)], "doc_id long, text string")
    want = by_id(suffix_dedup.mark_repeats(docs))
    monkeypatch.setattr(suffix_dedup, "Blocks", Counted)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", suffix_dedup.BUCKET_BYTES >> 10)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", suffix_dedup.BLOCK_BYTES >> 10)
    assert by_id(suffix_dedup.mark_repeats(docs)) == want
    blocks, buckets = asked[0]
    assert blocks > 20 and buckets <= blocks // 3


def test_near_copies_keep_small_states(spark, monkeypatch):
    """What a block keeps of its documents is one row, so it is bounded; so is what a worker keeps for hashes."""
    import pyarrow as pa

    from graphloom.llm import common, jaccard

    rng = random.Random(12)
    rows = [(i, words(rng, 3000)) for i in range(400)]
    sizes = []

    class Watched(jaccard.Blocks):
        def __init__(self, *args, **more):
            super().__init__(*args, **more)
            sizes.append(self.docs.selectExpr("max(length(state))", "sum(length(state))").first())

    monkeypatch.setattr(jaccard, "Blocks", Watched)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        docs = spark.createDataFrame([*rows, (1000, rows[7][1] + " end")], "doc_id long, text string")
        assert sorted(r[0] for r in jaccard.one_of_each_group(docs).select("doc_id").collect()) == list(range(400))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    most, total = sizes[0]
    assert total > 9_000_000 and most < 4_000_000
    monkeypatch.setattr(common, "_POWERS", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    jaccard.shingle_sets(pa.array([t for _, t in rows]), 5)
    assert sum(x.nbytes for x in common._POWERS) < 16 << 20


def test_large_groups_of_near_copies_meet_in_few_pairs(spark, monkeypatch):
    """Copies of one text with a few words changed: some are alone, the others one group; pairs grow with their number."""
    from graphloom.llm import jaccard

    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 1500):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 3, 4, 5])):
            w[rng.randrange(24) * 5] = f"x{rng.randrange(3)}"
        rows.append((i, " ".join(w)))
    number, members = {}, np.zeros((len(rows), 5000), np.float32)
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 4):
            members[i, number.setdefault(tuple(w[k : k + 5]), len(number))] = 1
    both, size = members @ members.T, members.sum(axis=1)
    alike = 5 * both >= 4 * (size[:, None] + size - both)
    want, left = set(), np.ones(len(rows), bool)
    for i in range(len(rows)):
        reached = np.zeros(len(rows), bool)
        reached[i] = left[i]
        while (more := alike[reached].any(axis=0) & ~reached).any():
            reached |= more
        left &= ~reached
        want |= {i} if reached[i] else set()
    compared, similar = [], jaccard.similar

    def counted(pairs, *args):
        compared.append(pairs.count())
        return similar(pairs, *args)

    monkeypatch.setattr(jaccard, "similar", counted)
    got = {r["doc_id"] for r in jaccard.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id").collect()}
    assert got == want and 1 < len(want) < len(rows)
    assert sum(compared) < 60 * len(rows)


def test_pieces_alone_are_not_sorted(monkeypatch):
    """Only pieces that share what they are dealt by go into suffix arrays; answers are the same as with all of them in."""
    from graphloom.llm.blocks import pack, unpack

    rng = random.Random(3)
    many = [b"%03d " % i + words(rng, 15).encode()[:70] for i in range(200)]
    pair = [many[0], many[0][4:] + b" end"]
    pieces, bits = [*pair, *many[1:]], np.array([7, 7, *range(100, 299)], np.uint32)
    owner = np.arange(len(pieces), dtype=np.int64)[::-1].copy()
    seen = []
    plain = suffix_dedup.smallest_owner
    monkeypatch.setattr(suffix_dedup, "smallest_owner", lambda p, *rest: seen.extend(p) or plain(p, *rest))
    payload = pack(np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces], np.uint16), owner, bits)
    _, size, value = unpack(suffix_dedup._owners(50)([payload])[0])[:3]
    assert seen == pair
    assert np.array_equal(np.repeat(value, size), plain(pieces, owner)[0])


def test_blocks_hand_what_they_keep_to_different_buckets():
    """What a block gets back goes once, and not to one bucket from all blocks."""
    import pyarrow as pa

    from graphloom.llm.blocks import pack, unpack

    rng, names, bearers = random.Random(8), np.arange(8), []
    for n in range(12):
        docs = pa.table({"doc_id": pa.array(range(20), pa.int64()), "text": [words(rng, 60) for _ in range(20)]})
        kept = pa.table({"state": [suffix_dedup.read(docs)]})
        got = {0: {b: pack(unpack(p)[2]) for b, p in suffix_dedup.Block(kept, {}, names, 50).ask_digests()}, 1: {}}
        for b, p in suffix_dedup.Block(kept, got, names, 50).ask_keys():
            here = np.packbits(np.ones(len(unpack(p)[0]), bool))
            got[1][b] = pack(here, np.zeros_like(here))
        block = suffix_dedup.Block(kept, got, names, 50)
        with_more = [b for b, p in block.ask_pieces() if len(unpack(p)) > 4]
        assert len(with_more) == 1
        bearers += with_more
    assert len(set(bearers)) > 3
