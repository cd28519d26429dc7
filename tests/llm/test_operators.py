"""Each operator against a brute-force version or an exact round trip, with the hard cases in one small table."""

import collections
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from framewise.llm import byte_bpe, exact_dedup, langid, lm, near_dedup, packing, pii, repeats, topk, warc
from framewise.llm.common import new_path, saved

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, name string, found string"


def texts() -> list[tuple[int, str | None]]:
    """Copies, near copies, shared passages, repeated lines, nulls, empty and very long texts, odd white space."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(("the", "ing", "on", "st", "ré", "ou", "A")) for _ in range(rng.randrange(1, 5)))
    line = lambda n: " ".join(word() for _ in range(n)) + "."
    passage, base = line(60), line(120)
    out = [line(rng.randrange(1, 60)) for _ in range(12)]
    out += [passage, "x " + passage + " y", line(5) + passage + line(9), base, base, base + " more", base.replace(" ", "  ", 3)]
    out += [None, "", "", " ", "a", "1 2 3", "\t\n", "tab\tand  two\n\n lines ", "it's odd’s ñ 日本語 \U0001f600", "the the the", "the the", "ab " * 9000, "z" * 3000]
    for k in range(5):  # near copies: one word of many differs
        words = base.split(" ")
        words[10 * k] = f"changed{k}"
        out.append(" ".join(words))
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark):
    langs = ("de", "en", None)
    rows = [(i, t, langs[i % 3], "s", len(t or ""), "b", "n", "f") for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# -- 1 ---------------------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("crowded", [0, repeats.CROWDED])
def test_repeats(docs, empty, monkeypatch, crowded):
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    monkeypatch.setattr(repeats.resolved, "__defaults__", (crowded,))
    monkeypatch.setattr(repeats, "SHARD", 8)
    data = {i: (t or "").encode() for i, t in texts()}
    n = repeats.LENGTH
    seen = collections.Counter(x[k : k + n] for x in data.values() for k in range(len(x) - n + 1))
    got = by_id(repeats.remove_repeats(docs))
    for i, x in data.items():
        hit = np.zeros(len(x) + 1, int)
        for k in range(len(x) - n + 1):
            if seen[x[k : k + n]] > 1:
                hit[k] += 1
                hit[k + n] -= 1
        on = hit.cumsum()[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], on.astype(int)])) == 1).sum())
        kept = hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~on])).hexdigest()
        assert tuple(got[i])[1:5] == (len(x), int(on.sum()), runs, kept), i
    assert repeats.remove_repeats(empty).count() == 0


def test_merged_order_sorts():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, (500, 6)).astype(np.uint64)
    gram = rng.integers(0, 4, 500)
    at = repeats.merged_order(gram, words)
    keys = [(gram[i], *words[i]) for i in at]
    assert keys == sorted(keys) and sorted(at) == list(range(500))


# -- 2 ---------------------------------------------------------------------------------------------------------------------------------------

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    want, total = {}, 0
    for i, x in texts():
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
        total += len(ids)
        for k in range(0, len(ids), 512):
            want[i, k // 512] = (k, len(ids[k : k + 512]), zlib.crc32(ids[k : k + 512].tobytes()))
    got = packing.pack_documents(docs, WORDS, size=512).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(sequences) <= -(-total // 512) + 1
    assert packing.pack_documents(empty, WORDS).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_whole_and_close_to_optimal(seed):
    rng = random.Random(seed)
    counts = collections.Counter(rng.choice((rng.randrange(1, 101), 34, 51)) for _ in range(rng.randrange(1, 300)))
    plan = packing.bin_completion(dict(counts), 100)
    held = collections.Counter()
    for lengths, n in plan:
        assert sum(k * c for k, c in lengths.items()) <= 100
        for k, c in lengths.items():
            held[k] += c * n
    assert held == counts
    bins = sum(n for _, n in plan)
    assert bins <= sum(n for _, n in packing.best_fit_decreasing(dict(counts), 100)) and bins >= -(-sum(k * c for k, c in counts.items()) // 100)
    assert packing.bin_completion({6: 2, 4: 2}, 10) and sum(n for _, n in packing.bin_completion({6: 2, 4: 2}, 10)) == 2


def test_branch_and_bound_beats_best_fit():
    """Exact triples: best-fit decreasing wastes, the search finds plans without waste or nearly so, and whole."""
    better = 0
    for seed in range(4):
        rng, counts = random.Random(seed), collections.Counter()
        for _ in range(60):
            a, b = sorted(rng.sample(range(1, 1000), 2))
            counts.update((a, b - a, 1000 - b))
        plan = packing.bin_completion(dict(counts), 1000)
        held = collections.Counter()
        for lengths, n in plan:
            assert sum(k * c for k, c in lengths.items()) <= 1000
            for k, c in lengths.items():
                held[k] += c * n
        fit, found = sum(n for _, n in packing.best_fit_decreasing(dict(counts), 1000)), sum(n for _, n in plan)
        assert held == counts and 60 <= found <= min(fit, 61)
        better += found < fit
    assert better
    assert sum(n for _, n in packing.bin_completion({6: 300, 5: 300, 4: 300, 3: 300, 2: 300}, 10)) == 600


# -- 3 ---------------------------------------------------------------------------------------------------------------------------------------


def test_lm(docs, empty):
    data = dict(texts())
    words = {i: re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in x or "").encode()) + [b"\n"] for i, x in data.items()}
    held = {i for i in data if zlib.crc32(str(i).encode()) % 5 == 1}
    count = collections.Counter(w for i, ws in words.items() if i not in held for w in ws)
    n, v = sum(count.values()), len(count)
    got = by_id(lm.score_documents(docs))
    for i, ws in words.items():
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"], got[i]["held_out"]) == (len(ws), sum(count[w] > 0 for w in ws), n, i in held)
        assert got[i]["base_score"] == pytest.approx(base) and got[i]["score"] < 0
    assert lm.score_documents(empty).count() == 0


def test_lm_probabilities_sum_to_one(docs, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 4)
    model, words = lm.fit(docs)
    rows = {bytes(r["word"]): r for r in words.collect()}
    rest = {w: r for w, r in rows.items() if w not in model.frequent}
    assert len(rest) > 50 and len(model.frequent) == 4
    assert sum(10 ** r["score"] for r in rest.values()) + 10 ** model.log10_unknown() == pytest.approx(1, abs=1e-9)
    assert (10**model.outcomes).sum(axis=1) == pytest.approx(np.ones(5), abs=1e-9)


def test_lm_scores_by_hand(docs, monkeypatch):
    """The same numbers from dictionaries of customers and tables, and the same with any partitioning."""
    monkeypatch.setattr(lm, "FREQUENT", 4)
    count: collections.Counter = collections.Counter()
    pair: collections.Counter = collections.Counter()
    for i, x in texts():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            ws = lm.tokens(x)
            count.update(ws)
            pair.update(zip([lm.END, *ws], ws, strict=False))
    top = [lm.END, *sorted((w for w in count if w != lm.END), key=lambda w: (-count[w], w))[:3]]
    name = {w: k for k, w in enumerate(top)}
    square = np.zeros((5, 5), np.int64)
    for (a, b), k in pair.items():
        square[name.get(a, 4), name.get(b, 4)] += k
    contexts, samples = lm.Contexts(square), []
    for number in range(lm.BURN + lm.SAMPLES):
        contexts.sweep(number)
        assert ((contexts.tables >= np.minimum(square, 1)) & (contexts.tables <= square)).all()
        (d, s), (pd, ps), held = lm.CONTEXT, lm.PARENT, contexts.tables.sum(axis=0)
        up = [(held[o] - pd * contexts.up[o] + (ps + pd * contexts.up.sum()) / 5) / (ps + held.sum()) for o in range(5)]
        samples.append([[(square[u, o] - d * contexts.tables[u, o] + (s + d * contexts.tables[u].sum()) * up[o]) / (s + square[u].sum()) for o in range(5)] for u in range(5)])
    outcome = np.mean(samples[-lm.SAMPLES :], axis=0)
    rest = sorted(w for w in count if w not in name)
    n, others = np.array([count[w] for w in rest]), lm.Others(sum(count[w] for w in rest), len(rest))
    for _ in range(lm.BURN + lm.SAMPLES):
        others.totals.append(int(others.tables(rest, n)[-1].sum()))
    seats, (d, s) = others._before().tables(rest, n), lm.WORDS
    share = {w: np.mean([(n[i] - d * t[i] + (s + d * total) / (len(rest) + 1)) / (s + others.customers) for t, total in list(zip(seats, others.totals, strict=True))[-lm.SAMPLES :]]) for i, w in enumerate(rest)}
    scores = [by_id(lm.score_documents(docs.repartition(k))) for k in (1, 9)]
    for i, x in texts():
        ws = lm.tokens(x)
        want = sum(math.log10(outcome[name.get(a, 4), name.get(b, 4)] * (1 if b in name else share.get(b, others.unknown()))) for a, b in zip([lm.END, *ws], ws, strict=False))
        for got in scores:
            assert got[i]["score"] == pytest.approx(want, rel=1e-9)


def test_lm_of_rows_that_share_an_id(spark):
    rows = [(None, "a b c"), (None, "d"), (3, "a a"), (3, "zz yy xx"), (3, "a a"), (4, "q " * 100_000)]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted([("None", 4), ("None", 2), ("3", 3), ("3", 4), ("3", 3), ("4", 100_001)])
    assert all(r["score"] < 0 and r["held_out"] is (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in got)


def test_lm_gives_every_word_a_context(spark, docs, empty):
    """All pairs of words count: the same score from dictionaries, one for each context; held-out words and contexts too."""
    train, count = [(i, x) for i, x in texts() if zlib.crc32(str(i).encode()) % 5 != 1], collections.Counter()
    name = lambda w: lm.xxhash.xxh3_64_intdigest(w)
    for _, x in train:
        ws = lm.tokens(x)
        count.update(zip([lm.END, *ws], ws, strict=False))
    at = sorted(count)
    total = lambda values, side: {w: sum(v for k, v in zip(at, values, strict=True) if k[side] == w) for w in {k[side] for k in at}}
    (d, s), (pd, ps), n = lm.CONTEXT, lm.PARENT, np.array([count[k] for k in at])
    names = np.array([(name(u) * 0xA0761D6478BD642F + name(w)) % 2**64 for u, w in at], np.uint64)
    t = np.ones(len(at), np.int64)
    customers, up = total(n, 0), {w: 1 for _, w in at}
    v, samples = len(up), []
    for number in range(lm.BURN + lm.SAMPLES):
        rooms, m, ups = total(t, 0), total(t, 1), sum(up.values())
        guests = np.array([m[w] for _, w in at]) - t
        own = np.array([up[w] for _, w in at])
        kept = np.minimum(own, guests)
        parent = (np.maximum(guests - pd * kept, 0) + (ps + pd * (ups - own + kept)) / (v + 1)) / (ps + t.sum() - t)
        t = lm.seat(names, n, np.array([rooms[u] for u, _ in at]) - t, parent, d, s, number)
        assert ((t >= 1) & (t <= n)).all()
        m = total(t, 1)
        up = {w: int(lm.seat(np.array([name(w)], np.uint64), np.array([m[w]]), np.array([ups - min(up[w], m[w])]), np.array([1 / (v + 1)]), pd, ps, number)[0]) for w in m}
        samples.append((dict(zip(at, t.tolist(), strict=True)), total(t, 0), m, up))

    def probability(u, w):
        out = []
        for seats, rooms, m, up in samples[-lm.SAMPLES :]:
            low = (m.get(w, 0) - pd * up.get(w, 0) + (ps + pd * sum(up.values())) / (v + 1)) / (ps + sum(m.values()))
            out.append((count[u, w] - d * seats.get((u, w), 0) + (s + d * rooms.get(u, 0)) * low) / (s + customers.get(u, 0)))
        return np.mean(out)

    for u in (lm.END, b"the", b"never-seen"):
        assert sum(probability(u, w) for w in [*up, b"\0unknown"]) == pytest.approx(1, abs=1e-9)
    capped = by_id(lm.score_documents(docs))
    for k in (1, 9):
        got = by_id(lm.score_by_word_contexts(docs.repartition(k), most=200 if k == 9 else 0))
        for i, x in texts():
            ws = lm.tokens(x)
            want = sum(math.log10(probability(u, w)) for u, w in zip([lm.END, *ws], ws, strict=False))
            assert got[i]["score"] == pytest.approx(want, rel=1e-9)
            for c in ("held_out", "n_tokens", "n_known", "train_tokens"):
                assert got[i][c] == capped[i][c]
            assert got[i]["base_score"] == pytest.approx(capped[i]["base_score"])
    assert lm.score_by_word_contexts(empty).count() == 0
    rows = [(None, "a b c"), (None, "d"), (3, "a a"), (3, "zz yy xx"), (3, "a a"), (4, "q " * 1000)]
    got = lm.score_by_word_contexts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted([("None", 4), ("None", 2), ("3", 3), ("3", 4), ("3", 3), ("4", 1001)])


def shuffled(spark):
    """Rows that the session's tasks have given to exchanges so far."""
    jvm = spark._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
    return sum(x.shuffleWriteRecords() for x in jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages))


def test_lm_sends_pairs_in_few_messages(spark):
    """Pairs of words go from place to place as arrays, not as rows."""
    rows = [(i, " ".join(f"w{x}" for x in np.random.default_rng(i).integers(0, 5000, 500))) for i in range(40)]
    pairs = {p for _, x in rows for ws in [lm.tokens(x)] for p in zip([lm.END, *ws], ws, strict=False)}
    docs, before = spark.createDataFrame(rows, "doc_id long, text string"), shuffled(spark)
    assert len(lm.score_by_word_contexts(docs).collect()) == 40
    assert shuffled(spark) - before < len(pairs) / 10


def test_lm_scores_by_any_chunks(spark, docs, monkeypatch):
    """Chunks of a few texts, words with short numbers, contexts in several places, and places that all own words: the same scores."""
    want = by_id(lm.score_by_word_contexts(docs))
    monkeypatch.setattr(lm, "CHUNK", 3000)
    monkeypatch.setattr(lm, "PLACES", 1)
    monkeypatch.setattr(lm, "SHARE", 100)
    for look, most in ((1, 100_000), (1, 0), (1 << 40, 0)):
        monkeypatch.setattr(lm, "LOOK", look)
        top, wide = lm.frequent_words(docs, 4, most, 0)
        assert (len(top) > 100, len(wide) > 1) == (look == 1, most > 0)
        got = by_id(lm.score_by_word_contexts(docs.repartition(5), most=most))
        assert got.keys() == want.keys()
        for i, row in want.items():
            assert got[i].asDict() == pytest.approx(row.asDict(), rel=1e-9)


def test_lm_tells_words_of_one_name_apart(spark, docs, monkeypatch):
    name = lm.named
    monkeypatch.setattr(lm, "named", lambda words, count, seed: name(words, count, seed + 1))
    want = by_id(lm.score_by_word_contexts(docs))
    # under the first seed, many words share a name
    monkeypatch.setattr(lm, "named", lambda words, count, seed: name(words, count, seed) >> np.uint64(50 * (seed == 0)) << np.uint64(50 * (seed == 0)))
    got = by_id(lm.score_by_word_contexts(docs))
    for i, row in want.items():
        assert got[i].asDict() == pytest.approx(row.asDict(), rel=1e-9)


# -- 4 ---------------------------------------------------------------------------------------------------------------------------------------


def test_warc(spark):
    html = [None, "", "short", "short", "é" * 60, "é" * 60, "x" * 100, "x" * 99, "x" * 99, "x" * 100]
    rows = [(i, None if i == 3 else f"http://h/{i}", h, "extra") for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    path = new_path(spark, "t")
    warc.write_archive(pages, path)
    got = by_id(warc.read_archive(spark, path), "page_id")
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items() if r["record_type"] == "revisit"} == {5: ("revisit", 4), 9: ("revisit", 6)}
    originals = by_id(warc.original_records(spark, path), "page_id")
    for i, h in enumerate(html):
        body = (h or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["url"]) == (len(body), hashlib.sha256(body).hexdigest(), rows[i][1])
        record = bytes(originals[i]["record"])
        assert bytes(originals[i]["payload"]) == body and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        length = int(re.search(rb"\r\nContent-Length: (\d+)\r\n\r\n", record)[1])
        assert len(record) == record.index(b"\r\n\r\n") + 4 + length + 4
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for h in html})
    assert warc.archived(pages.limit(0)).count() == 0


# -- 5 ---------------------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shard", [7, 1000])
def test_top_k(spark, shard):
    rng = np.random.default_rng(2)
    vectors = [[float(x) for x in rng.normal(0, 0.1, 8)] for _ in range(60)]
    vectors[3] = vectors[40] = vectors[20]
    vectors[5], vectors[6], vectors[7], vectors[41] = None, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [0.5, -0.5]
    rows = [(i, v, "q") for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    good = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all()}
    good = {i: np.pad(v, (0, 8 - len(v))) for i, v in good.items()}
    want = {}
    for q in (i for i in good if i % 20 == 0):
        ranked = sorted(((-int(good[q] @ good[c]), c) for c in good if c != q))[:20]
        want |= {(q, k + 1): (c, -s) for k, (s, c) in enumerate(ranked)}
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, shard=shard, block=2).collect()
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# -- 6 ---------------------------------------------------------------------------------------------------------------------------------------


def test_language_id(spark, docs, empty):
    rng = random.Random(3)
    parts = {"xx": ("der", "sch", "und", "ß"), "yy": ("ción", "ñ", "los", "que")}
    rows = [(k, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(rng.randrange(3, 90))), lang) for k in range(160) for lang in [("xx", "yy")[k % 2]]]
    rows += [(200, None, "xx"), (201, "12 34", "yy"), (202, "", "xx"), (203, "der und schder", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(langid.training_rows(df))
    got = by_id(langid.predict(df.select("doc_id", "text"), net))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (200, 201, 202)) and got[203]["lang_pred"] in parts
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows[:160]]) > 0.97 and all(0 <= r["score"] <= 1 for r in got.values())
    assert by_id(langid.predict(df.select("doc_id", "text"), langid.train(df.filter("lang is null"))))[0]["lang_pred"] == "und"
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, t in texts() if t and re.search(r"[^\W\d_]", t)}
    assert langid.keep_known(empty).count() == 0


# -- 7 ---------------------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bucket_keys", [1, 5, 1 << 20])
def test_exact_dedup(docs, empty, bucket_keys):
    data = {i: t or "" for i, t in texts()}
    groups = collections.defaultdict(list)
    for i, t in data.items():
        groups[t].append(i)
    got = by_id(exact_dedup.exact_dedup(docs, bucket_keys=bucket_keys))
    for i, t in data.items():
        assert tuple(got[i]) == (i, max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.keep_one(docs).columns == docs.columns


@pytest.mark.parametrize("most", [2, 20])
def test_directory_splits_overfull_buckets(spark, most):
    keys = spark.range(2000).select(F.xxhash64("id").alias("key"))
    rounds = exact_dedup.directory(keys, 100, most)
    assert (len(rounds) > 1) == (most == 2)
    found = exact_dedup.placed(keys, rounds).collect()
    held = collections.Counter(r["bucket"] for r in found)
    assert len(found) == 2000 and None not in held and max(held.values()) <= 100 and len(held) >= 20
    for r in found:  # a bucket's number is a one and then the key's leading bits
        bits = f"{r['bucket']:b}"[1:]
        assert f"{r['key'] % (1 << 64):064b}".startswith(bits)


# -- 8 ---------------------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [1, byte_bpe.CHUNK])
def test_byte_bpe(docs, empty, monkeypatch, chunk):
    import tiktoken

    monkeypatch.setattr(byte_bpe, "CHUNK", chunk)
    monkeypatch.setattr(byte_bpe, "SLICE", 7 if chunk == 1 else byte_bpe.SLICE)
    monkeypatch.setattr(byte_bpe, "BLOCK", 50 if chunk == 1 else byte_bpe.BLOCK)
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(byte_bpe.digests(docs, ranks, public_tokenizers.PATTERN))
    for i, t in texts():
        ids = enc.encode_ordinary(t or "")
        assert tuple(got[i])[1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()), (i, t)
    if chunk == 1:
        back = by_id(byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks))
        assert all(bytes(back[i]["bytes"]) == (t or "").encode() for i, t in texts())
        assert byte_bpe.digests(empty, ranks, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_of_long_words_and_odd_white_space(spark):
    import tiktoken

    rng = random.Random(8)
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    data = ["z" * 100_000, "".join(rng.choice("abcdefgh") for _ in range(3000)), "ab" * 500 + "é" * 70, "=" * 300, "\n\nx\n y \n", "a\u00a0 b\u3000c\x0bd", "x\0y z", "'s 't's I'll", " lead", "trail ", "1\n2", "a\n\nb"]
    data += ["".join(rng.choice("ab1. \n\t'é日!") for _ in range(60)) for _ in range(300)]
    got = by_id(byte_bpe.encode(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string"), ranks, public_tokenizers.PATTERN))
    for i, t in enumerate(data):
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == enc.encode_ordinary(t), t[:80]


# -- 9 ---------------------------------------------------------------------------------------------------------------------------------------


def brute_components(data: dict[int, str | None], width: int) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, x in data.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in x or "").encode())
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup(docs, empty, width):
    want = brute_components(dict(texts()), width)
    got = by_id(near_dedup.near_dedup(docs, width, broadcast_ids=0 if width == 5 else 2_000_000))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    assert near_dedup.near_dedup(empty).count() == 0 and near_dedup.keep_one(docs).columns == docs.columns


def test_near_dedup_of_a_crowded_region(spark, monkeypatch):
    """Many documents just below the limit hide a few pairs above it from each other."""
    rng = random.Random(11)
    line = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    template = line(172)
    data = {i: " ".join(template + line(24)) for i in range(300)}
    for i in range(0, 40, 4):  # the copy has two of the tail's words more, so the pair is above
        data[299 - i] = " ".join(data[i].split()[:176] + line(20))
    want = brute_components(data, 5)
    assert len({c for _, c in want.values()}) == 290
    for block in (near_dedup.BLOCK, 40):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got = by_id(near_dedup.near_dedup(spark.createDataFrame(list(data.items()), "doc_id long, text string"), broadcast_ids=0 if block == 40 else 1000))
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want


def test_meetings_of_regions_that_share_most_documents(spark, monkeypatch):
    """Twenty orders' regions of much the same documents are compared once, and all their pairs whose sizes allow a link meet."""
    monkeypatch.setattr(near_dedup, "BLOCK", 40)
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 1 << 32, (300, 20, 6)).astype(">u4")
    inside = rng.random((300, 20)) < 0.95
    sig[inside, :3] = 7
    sizes = rng.integers(80, 400, 300).tolist()
    rows = [(i, sizes[i], sig[i].tobytes()) for i in range(300)]
    reps = spark.createDataFrame(rows, "doc_id long, n_shingles long, sig binary")
    comps = [0 if i < 120 else i for i in range(300)]
    labels = spark.createDataFrame(list(enumerate(comps)), "node long, comp long")
    for few in (0, 1000):
        met = near_dedup.meetings(reps, labels, 80, few).collect()
        assert len(met) < 6000  # 20 regions by themselves: some 285 documents each, in eight blocks or more
        groups = collections.defaultdict(list)
        for r in met:
            groups[r["region"], r["i"], r["j"]].append((r["block"], r["doc_id"]))
        pairs = {(a, b) for (_, i, j), held in groups.items() for x, a in held for y, b in held if a < b and (i == j or x != y)}
        want = {(a, b) for a in range(300) for b in range(a + 1, 300) if comps[a] != comps[b] and 10 * min(sizes[a], sizes[b]) >= 8 * max(sizes[a], sizes[b]) and (inside[a] & inside[b]).any()}
        assert want <= pairs


def test_components_of_chains_and_stars(spark):
    rng = random.Random(9)
    ids = list(range(200))
    rng.shuffle(ids)
    links = [tuple(sorted(p)) for p in zip(ids[:120], ids[1:120], strict=False)] + [tuple(sorted((ids[150], x))) for x in ids[151:]]
    got = {r["node"]: r["comp"] for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: min(ids[:120]) for i in ids[:120]} | {i: min(ids[150:]) for i in ids[150:]}


# -- 10 --------------------------------------------------------------------------------------------------------------------------------------


KEY = "a key"


def luhn(s: str) -> bool:
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def test_pii(spark, docs, empty):
    values = ["4532015112830366", "4532 0151 1283 0366", "8.196.197.208", "2024-02-29", "123-45-6789", "+1 (663) 555-6869", "jo.52@mail1.example.com", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "415-555-2671"]
    left = ["4532015112830367", "300.1.1.1", "2023-02-29", "000-12-3456", "12345", "v1.2", "a@b", "deadbeef"]
    body = lambda v: f"Ab {v} cd,\n{v}."
    rows = [(i, body(v)) for i, v in enumerate(values)] + [(100 + i, body(v)) for i, v in enumerate(left)] + [(200, None), (201, ""), (202, " ".join(values) * 200)]
    got = by_id(pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY))
    for i, v in enumerate(values):
        m = re.fullmatch(r"Ab (.*) cd,\n(.*)\.", got[i]["text"])
        assert m and m[1] == m[2] != v and got[i]["n_pii"] == 2, (v, got[i]["text"])
        shape = lambda s: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "0", s)))
        if i in (0, 1, 5, 6, 8):
            assert shape(m[1].split("@")[0]) == shape(v.split("@")[0])
        if i < 2:
            assert luhn(m[1])
        if i == 2:
            assert all(0 <= int(x) < 256 for x in m[1].split("."))
        if i == 3:
            __import__("datetime").date.fromisoformat(m[1])
    assert all(got[100 + i]["text"] == body(v) and got[100 + i]["n_pii"] == 0 for i, v in enumerate(left))
    assert got[200]["text"] is None and got[201]["text"] == "" and got[202]["n_pii"] > 200
    out = pii.pseudonymise(docs, KEY, count_col=None)
    assert out.columns == docs.columns and {r["doc_id"]: r["text"] for r in out.collect()} == dict(texts())
    assert pii.pseudonymise(empty, KEY).count() == 0


def test_pii_without_three_digits_in_a_row(spark):
    values = ["a1b2c3d4e5f6a7b8c9d0e1f2a3b4c5d6", "+44 20 79 46 09 58"]
    got = by_id(pii.pseudonymise(spark.createDataFrame([(i, f"Ab {v} cd") for i, v in enumerate(values)], "doc_id long, text string"), KEY))
    assert all(got[i]["n_pii"] == 1 and v not in got[i]["text"] for i, v in enumerate(values))


def test_pseudonyms_dont_meet(spark):
    rows = spark.range(3000).select(F.format_string("10.0.%d.%d", F.expr("id div 250"), F.col("id") % 250).alias("m"))
    assert rows.select(F.expr(pii.pseudonym("m", KEY)).alias("p")).distinct().count() == 3000


def shifted(places: list[int], radix: list[int], kind: str, key: str) -> list[int]:
    """The Feistel network by hand."""
    half = len(places) // 2
    for r in range(pii.ROUNDS):
        other = places[half:] if r % 2 == 0 else places[:half]
        moved = range(half) if r % 2 == 0 else range(half, len(places))
        out = list(places)
        for i in moved:
            digest = hashlib.sha256("|".join([key, kind, str(r), str(i // 8), ",".join(map(str, other))]).encode()).hexdigest()
            out[i] = (places[i] + int(digest[8 * (i % 8) : 8 * (i % 8) + 8], 16)) % radix[i]
        places = out
    return places


def test_pseudonyms_by_hand(spark):
    secret, mail, phone, address = "24be64439E3e49cf46b2d7c90f3602a3", "jo.52@mail1.example.com", "+44 20 79 46 09 58", "8.196.197.208"
    rows = spark.createDataFrame([(0, secret), (1, mail), (2, phone), (3, address), (4, "2024-02-29")], "i long, m string")
    got = {r["i"]: r["p"] for r in rows.select("i", F.expr(pii.pseudonym("m", KEY)).alias("p")).collect()}

    def char(c: str, letters: int) -> tuple[int, int]:
        return (int(c), 10) if c.isdigit() else (ord(c.lower()) - 97, letters) if c.isalpha() else (0, 1)

    def written(text: str, letters: int, kind: str) -> str:
        pairs = [char(c, letters) for c in text]
        out = shifted([v for v, _ in pairs], [r for _, r in pairs], kind, KEY)
        return "".join(str(v) if c.isdigit() else chr((97 if c.islower() else 65) + v) if c.isalpha() else c for c, v in zip(text, out, strict=True))

    assert got[0] == written(secret, 6, "secret")
    assert got[1] == written("jo.52", 26, "email") + "@mail1.example.com"
    assert got[2] == "+44" + written(phone[3:], 26, "phone")
    assert got[3] == ".".join(map(str, shifted([8, 196, 197, 208], [256] * 4, "ip", KEY)))
    import datetime

    day = (datetime.date(2024, 2, 29) - datetime.date(1800, 1, 1)).days
    a, b = shifted([day // 773, day % 773], [189, 773], "date", KEY)
    assert got[4] == str(datetime.date(1800, 1, 1) + datetime.timedelta(days=a * 773 + b))


def test_pii_of_many_forms(spark):
    values = ["josé.ñandú@example.org", "李小龙@example.cn", "+33 1 23 45 67 89", "555 234 5678", "3782 822463 10005", "02/28/2024", "2001:db8:85a3:0:0:8a2e:370:7334", "2001:db8::8a2e:370", "+14155550100"]
    left = ["01.2.3.4", "13/45/2024", "1 2 3 4 5 6 7 8", "de:ad", "3782 822463 10006", "12:34:56"]
    rows = [(i, f"Ab {v} cd") for i, v in enumerate(values + left)]
    got = by_id(pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY))
    for i, v in enumerate(values):
        assert got[i]["n_pii"] == 1 and v not in got[i]["text"] and re.fullmatch("Ab .+ cd", got[i]["text"]), (v, got[i])
        assert len(got[i]["text"]) == len(rows[i][1])
    assert got[8]["text"].startswith("Ab +1") and got[2]["text"].startswith("Ab +33 ")
    for i, v in enumerate(left, len(values)):
        assert got[i]["text"] == rows[i][1] and got[i]["n_pii"] == 0, v


# -- hard rows through all operators ---------------------------------------------------------------------------------------------------------------

HARD_SCHEMA = "doc_id long, text string, lang string, key string, row string, kept string, n_pii string, node string, bucket string, whole string"


def hard_rows() -> list[tuple]:
    """Null ids, repeated ids and rows, a run of a million letters, a very long text, nulls, blanks, and names that operators use."""
    base = " ".join(f"word{k}" for k in range(80))
    data = [(None, base), (None, base + " end"), (None, None), (1, base), (1, base), (1, "quite another text here, mail jo.52@mail.example.com"), (2, "y" * 1_000_000)]
    data += [(3, ""), (4, " "), (5, "1 2 3"), (6, "ab cd " * 40_000), (7, base + " end"), (None, "alone"), (8, "alone"), (None, "only null")]
    return [(i, t, ("en", None)[k % 2], "k", "r", "x", "n", "o", "b", "w") for k, (i, t) in enumerate(data)]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(hard_rows(), HARD_SCHEMA).repartition(3).cache()


def ids_of(df) -> list[str]:
    return sorted(str(r["doc_id"]) for r in df.select("doc_id").collect())


def test_hard_rows_of_row_wise_operators(spark, hard):
    want = sorted(str(r[0]) for r in hard_rows())
    assert ids_of(pii.pseudonymise(hard, KEY)) == want
    assert ids_of(exact_dedup.exact_dedup(hard)) == want
    assert ids_of(packing.pack_documents(hard, WORDS).filter("piece = 0")) == want
    assert ids_of(langid.predict(hard.select("doc_id", "text"), langid.train(hard))) == want
    assert len(by_id(exact_dedup.keep_one(hard), "text")) == exact_dedup.keep_one(hard).count() == len({r[1] or "" for r in hard_rows()})
    assert exact_dedup.keep_one(hard).columns == hard.columns


def test_hard_rows_of_byte_bpe(hard):
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["decoded_sha256"]) for r in byte_bpe.digests(hard, ranks, public_tokenizers.PATTERN).collect())
    assert got == sorted((str(r[0]), len(enc.encode_ordinary(r[1] or "")), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in hard_rows())


def test_hard_rows_of_near_dedup(hard):
    got = near_dedup.near_dedup(hard).collect()
    seen = sorted((str(r["doc_id"]), str(r["component_id"]), r["n_shingles"], r["kept"]) for r in got)
    want = [("None", "1", 76, False), ("None", "1", 77, False), ("None", "None", 0, False), ("1", "1", 76, True), ("1", "1", 76, True), ("1", "1", 2, True), ("2", "2", 1, True), ("3", "3", 0, True), ("4", "4", 0, True), ("5", "5", 1, True)]
    want += [("6", "6", 2, True), ("7", "1", 77, False), ("None", "8", 1, False), ("8", "8", 1, True), ("None", "None", 1, False)]
    assert seen == sorted(want)
    kept = near_dedup.keep_one(hard)
    assert kept.columns == hard.columns
    stay = collections.Counter((str(r["doc_id"]), (r["text"] or "")[:30]) for r in kept.collect())
    base = hard_rows()[0][1][:30]
    assert stay == {("1", base): 1, ("1", "quite another text here, mail "): 1, ("2", "y" * 30): 1, ("3", ""): 1, ("4", " "): 1, ("5", "1 2 3"): 1, ("6", ("ab cd " * 5)): 1, ("8", "alone"): 1, ("None", ""): 1, ("None", "only null"): 1}


def test_hard_rows_of_repeats(hard):
    data = [(str(r[0]), (r[1] or "").encode()) for r in hard_rows()]
    n = repeats.LENGTH
    seen = collections.Counter(x[k : k + n] for _, x in data for k in range(len(x) - n + 1))
    want = []
    for i, x in data:
        hit = np.zeros(len(x) + 1, int)
        for k in range(len(x) - n + 1):
            if seen[x[k : k + n]] > 1:
                hit[k] += 1
                hit[k + n] -= 1
        on = hit.cumsum()[:-1] > 0
        want.append((i, len(x), int(on.sum()), hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~on])).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in repeats.remove_repeats(hard).collect()) == sorted(want)


def test_hard_rows_of_warc(spark):
    html = "x" * 200
    rows = [(1, "http://a\r\nWARC-Payload-Digest: sha256:" + "0" * 64, html), (2, "http://b%0D%25", html), (None, "http://c", html), (None, "u", "z" * 100), (3, "", "s"), (4, None, "s"), (4, None, "s"), (5, "http://long", "q" * 1_000_000)]
    got = warc.archived(spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")).collect()
    seen = sorted((str(r["page_id"]), str(r["url"]), r["payload_bytes"], r["record_type"], str(r["refers_to"])) for r in got)
    kind = lambda i, h: ("revisit", "1") if h == html and i != 1 else ("response", "None")
    assert seen == sorted((str(i), str(u), len(h), *kind(i, h)) for i, u, h in rows)


# -- pipeline ----------------------------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as cp

    data = {i: t for i, t in texts()}
    stage = dict(cp.STAGES)
    now = saved(stage["language_id"](spark, docs, ""), "t")
    known = {i: t for i, t in data.items() if t and re.search(r"[^\W\d_]", t)}
    assert by_id(now).keys() == known.keys() and now.columns == docs.columns
    now = saved(stage["exact_dedup"](spark, now, ""), "t")
    once = {max(i for i, u in known.items() if u == t): t for t in set(known.values())}
    assert by_id(now).keys() == once.keys()
    now = saved(stage["near_dedup"](spark, now, ""), "t")
    near = {i for i, (_, c) in brute_components(once, 5).items() if i == c}
    assert by_id(now).keys() == near
    now = saved(stage["pii"](spark, now, ""), "t")
    assert {i: r["text"] for i, r in by_id(now).items()} == {i: data[i] for i in near} and now.columns == docs.columns
    packed = stage["packing"](spark, now, "").collect()
    assert {r["doc_id"] for r in packed} == near and json.dumps([r.asDict() for r in packed])
