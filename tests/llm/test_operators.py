"""Edges of every operator, and brute force where SQL can't express it."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwright.llm import labelled as labelled_module
from inkwright.llm import bm25, chat, components, jaccard, lines, masked_lm, mixing, packing, quality, queries, telephony, tokens, toxicity

EXTRA = ["score", "key", "size", "rank", "first", "_doc", "_runs", "_key", "_lines", "_gone", "epochs", "last", "t_source", "t_last", "rows", "turn", "chunk", "target", "range", "part", "y", "class_id", "shard", "cluster"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
WS = " \t\n\x0b\x0c\r"


def split(text):
    for c in WS[1:]:
        text = (text or "").replace(c, " ")
    return [w for w in (text or "").split(" ") if w]


def frame(spark, rows):
    """Documents with further columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, None, s, 0, *EXTRA) for i, t, s in rows], DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x{rng.randrange(9)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Null and empty texts, null ids and sources, spaces only, ties, repeated rows, a very long text."""
    rng = random.Random(1)
    long = "\n".join(words(rng, 12) for _ in range(3000))
    base = words(rng, 80)
    near = base.split(" ")
    near[40] = "changed"
    return [
        (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one", "b"), (5, "one", "b"), (5, "one", "b"), (6, long, "a"),
        (7, base, "a"), (8, base, "b"), (9, " ".join(near), "c"), (10, "ä ö ü 中 🙂", "c"), (None, "no id at all", None), (11, "one two three four", "a"), (11, "another text with the same id", "a"),
    ]


# Words and shingles


def test_words_and_shingles():
    texts = ["", "a", "a b  c\td\ne f", None, "\x0ba b c d e\r", "a b c d e", "é x"]
    data, offsets = tokens.flat(pa.array(texts))
    w = tokens.words(data, offsets)
    said = [bytes(data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)]
    assert said == [x for t in texts for x in split(t)] and w.doc.tolist() == [k for k, t in enumerate(texts) for _ in split(t)]
    assert len(set(w.hash.tolist())) == len(set(said))
    h, doc = tokens.shingles(w, 5, len(texts))
    assert Counter(doc.tolist()) == {1: 1, 2: 2, 4: 1, 5: 1, 6: 1} and h[doc == 4][0] == h[doc == 5][0] == h[doc == 2][0]
    for limit in (1, 3, 1000):
        got = [(lo, x) for lo, p in tokens.pieces(pa.array(texts), limit) for x in p.to_pylist()]
        assert [x for _, x in got] == texts


# 1: line dedup


def brute_lines(rows, least):
    docs = sorted({(i, t) for i, t, _ in rows if t is not None}, key=lambda d: (d[0] is not None, d[0] or 0))
    seen, gone = {}, defaultdict(set)
    runs = []
    for d in docs:
        ls = d[1].split("\n")
        n = [len(split(x)) for x in ls]
        wanted = set()
        for s in range(len(ls)):
            if n[s]:
                e = next((e for e in range(s + 1, len(ls) + 1) if sum(n[s:e]) >= least), None)
                wanted |= {(s, e)} if e else set()
                b = next((b for b in range(s, -1, -1) if sum(n[b : s + 1]) >= least), None)
                wanted |= {(b, s + 1)} if b is not None else set()
        runs += [(d, s, e, tuple(ls[s:e])) for s, e in sorted(wanted)]
    for d, s, e, body in runs:
        first = seen.setdefault(body, (d, s))
        if first != (d, s) and not (first[0] == d and s < first[1] + e - s):
            gone[d].update(range(s, e))
    return {d: "\n".join(x for k, x in enumerate(d[1].split("\n")) if k not in gone[d]) for d in docs}


def test_line_dedup_by_brute_force(spark):
    rng = random.Random(3)
    pool = [words(rng, rng.choice([0, 1, 4, 9, 35])) for _ in range(14)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12))), "a") for i in range(60)]
    got = {(r["doc_id"], r["o"]): r["text"] for r in lines.dedup_lines(frame(spark, rows).withColumn("o", F.col("text")), 10).collect()}
    assert got == brute_lines(rows, 10) and any(len(t) < len(d[1]) for d, t in got.items())


def test_fingerprints_are_window_minima():
    rng = random.Random(8)
    texts = ["\n".join(rng.choice(["", "one two", "a b c d", "x", "one two", "long line of seven words it is"]) for _ in range(rng.randrange(1, 40))) for _ in range(30)]
    data, offsets = tokens.flat(pa.array(texts))
    f = lines.winnow(data, offsets, 6)
    hashes = lambda x: tokens.span_hash(*tokens.flat(pa.array(x))[:1], *(lambda o: (o[:-1], o[1:]))(tokens.flat(pa.array(x))[1])) if x else []
    seen = set()
    for k in range(len(f.doc)):
        ls = texts[f.doc[k]].split("\n")
        h = [int(v) for v in hashes(ls)]
        for j in range(f.at[k], f.at[k + 1]):
            window = range(f.first[j], f.first[j] + f.lines[j])
            assert f.line[k] == min((i for i in window if split(ls[i])), key=lambda i: (h[i], i)) and int(f.mark[k]) == h[f.line[k]]
            assert sum(len(split(ls[i])) for i in window) >= 6
            seen.add((int(f.doc[k]), window[0], window[-1] + 1))
    want = set()
    for d, t in enumerate(texts):
        n = [len(split(x)) for x in t.split("\n")]
        for s in range(len(n)):
            if n[s]:
                want |= {(d, s, e) for e in [next((e for e in range(s + 1, len(n) + 1) if sum(n[s:e]) >= 6), None)] if e}
                want |= {(d, b, s + 1) for b in [next((b for b in range(s, -1, -1) if sum(n[b : s + 1]) >= 6), None)] if b is not None}
    assert seen == want and len(f.doc) < sum(len(t.split("\n")) for t in texts)


def test_line_dedup_edges(spark, odd):
    passage = words(random.Random(5), 55)
    rows = odd + [(20, f"own start\n{passage}\nown end", "a"), (21, f"{passage}", "a"), (22, f"other\n{passage}", "a"), (23, "short\nline", "a"), (24, "short\nline", "a")]
    out = lines.dedup_lines(frame(spark, rows))
    n = len(out.columns) - 3
    assert out.columns[:n] == frame(spark, rows).columns and out.columns[n:] == lines.report_columns(frame(spark, rows)) == ["_lines_", "_gone_", "_lost"]
    assert all(list(r[5:n]) == EXTRA for r in out.collect())
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got[1] == [None] and got[2] == [""] and got[5] == ["one", "one"] and got[6] == [odd[6][1]]
    assert got[7] == [odd[7][1]] and got[8] == [""] and len(got[9][0]) > 100
    assert passage in got[20][0] and got[21] == [""] and got[22] == ["other"] and got[24] == ["short\nline"]
    assert lines.dedup_lines(frame(spark, [])).count() == 0


# 2: media


def test_media_round_trip(spark, odd):
    out = telephony.read_media(telephony.encode_media(frame(spark, odd))).collect()
    assert len(out) == len(odd)
    texts = Counter((t or "").encode() for _, t, _ in odd)
    for r in out:
        stored = bytes(r["pcm"])
        assert telephony.wav_data(stored)[:2] == (1, 16000) and len(telephony.wav_data(stored)[2]) == 4 * r["payload_bytes"]
    kept = telephony.store_pcm(telephony.read_media(telephony.encode_media(frame(spark, odd)))).collect()
    assert sorted((r["payload_sha256"], r["pcm"]) for r in kept) == sorted((r["payload_sha256"], r["pcm"]) for r in out)
    for text in texts:
        data = text + b"\0" * (-len(text) % 64 or (0 if text else 64))
        same = [r for r in out if r["payload_sha256"] == hashlib.sha256(data).hexdigest()]
        assert len(same) == texts[text] and len({r["feature"] for r in same}) == 1
        assert {(r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) for r in same} == {(len(text), len(data), zlib.crc32(data[-64:]))}
    assert telephony.read_media(telephony.encode_media(frame(spark, []))).count() == 0


def test_broken_media_is_null(spark):
    bad = spark.createDataFrame([(1, 1, bytearray(b"RIFFxxxxWAVE")), (2, 1, None)], "doc_id long, n_bytes long, media binary")
    assert all(r["payload_sha256"] is None for r in telephony.read_media(bad).collect())


def slow_adpcm(block):
    level, index = int(np.frombuffer(block[:2], "<i2")[0]), min(88, block[2])
    out = [level]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            change = (step >> 3) + sum(step >> s for s, bit in ((0, 4), (1, 2), (2, 1)) if nibble & bit)
            level = max(-32768, min(32767, level - change if nibble & 8 else level + change))
            index = max(0, min(88, index + int(telephony.TURNS[nibble & 7])))
            out.append(level)
    return out


def test_features_and_pcm_by_formula(spark):
    text = "Feature strings, byte by byte: äöü " * 9
    data = telephony.payload(text.encode())
    r = telephony.read_media(telephony.encode_media(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    mu, a = ([int(t[b]) for b in data] for t in (telephony.mulaw_table(), telephony.alaw_table()))
    coded = [x for k in range(0, len(data), 64) for x in slow_adpcm(data[k : k + 64])]
    power = lambda x: round(math.sqrt(sum(v * v for v in x) / len(x)), 1)
    crc = lambda x: f"{zlib.crc32(np.array(x, '<i2').tobytes()):08x}"
    turns = sum((p ^ q) < 0 for p, q in itertools.pairwise(mu))
    assert r["feature"] == f"mulaw rms={power(mu)} peak={max(map(abs, mu))} turns={turns}; alaw rms={power(a)} crc={crc(a)}; adpcm rms={power(coded)} crc={crc(coded)}"
    wide = []
    for k, v in enumerate(mu):
        at = lambda j: mu[min(max(j, 0), len(mu) - 1)]
        wide += [v, max(-32768, min(32767, (9 * (v + at(k + 1)) - at(k - 1) - at(k + 2) + 8) >> 4))]
    assert np.frombuffer(telephony.wav_data(bytes(r["pcm"]))[2], "<i2").tolist() == wide


def test_files_are_read_by_their_tags(spark):
    rng = np.random.RandomState(1)
    some = [rng.bytes(n) for n in (1, 63, 200, 64, 100)]
    tags = [telephony.MULAW, telephony.ALAW, telephony.ALAW, telephony.ADPCM, telephony.ADPCM]
    rows = [(k, 0, bytearray(telephony.wav(x, t, 8000, 4 if t == telephony.ADPCM else 8))) for k, (x, t) in enumerate(zip(some, tags, strict=True))]
    rows += [(8, 0, bytearray(telephony.wav(b"abcd", 3, 8000, 8))), (9, 0, bytearray(telephony.wav(b"x" * 60, telephony.ADPCM, 8000, 4)))]
    got = {r["doc_id"]: r for r in telephony.read_media(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    pcm = lambda k: np.frombuffer(telephony.wav_data(bytes(got[k]["pcm"]))[2], "<i2")[::2].tolist()
    mu, a = telephony.mulaw_table(), telephony.alaw_table()
    assert pcm(0) == [int(mu[b]) for b in some[0]] and pcm(1) == [int(a[b]) for b in some[1]] and pcm(2) == [int(a[b]) for b in some[2]]
    assert pcm(3) == slow_adpcm(some[3]) and pcm(4) == slow_adpcm(some[4][:64]) and got[4]["payload_bytes"] == 100
    assert got[8]["payload_sha256"] is None and got[8]["pcm"] is None and got[9]["pcm"] is None
    for tag in (telephony.ALAW, telephony.ADPCM):
        r = telephony.read_media(telephony.encode_media(spark.createDataFrame([(1, "hello")], "doc_id long, text string"), tag)).first()
        assert r["payload_sha256"] == hashlib.sha256(telephony.payload(b"hello")).hexdigest()


def test_tables_and_adpcm_by_formula():
    mu, a = telephony.mulaw_table(), telephony.alaw_table()
    assert mu[0xFF] == 0 and mu[0x80] == 32124 and mu[0] == -32124 and a[0xD5] == 8 and a[0x55] == -8 and abs(a.astype(int)).max() == 32256
    rng = np.random.RandomState(0)
    blocks = rng.randint(0, 256, (5, 64), dtype=np.uint8)
    got = telephony.decode_adpcm(blocks)
    for k in range(5):
        assert got[k].tolist() == slow_adpcm(bytes(blocks[k]))
    x = np.array([0, 100, -100, 32767, 32767], np.int16)
    assert telephony.double_rate(x)[::2].tolist() == x.tolist() and len(telephony.double_rate(x)) == 10


# 3 and 7: classifiers


def labelled(spark, rng, bad):
    rows, labels = [], []
    for i in range(300):
        y = i % 3 == 0
        rows.append((i, bad(rng) if y else words(rng, 40), "s"))
        labels.append((i, int(y)))
    return rows, labels


def test_quality_learns_and_takes_edges(spark, odd):
    rng = random.Random(2)
    rows, labels = labelled(spark, rng, lambda r: " ".join(["same"] * 30) if r.random() < 0.5 else words(r, 30).upper().replace(" ", "!! "))
    table = spark.createDataFrame([(i, 1 - y, None) for i, y in labels] + [(None, 1, 1), (3, 1 - labels[3][1], None), (9999, 1, None)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows + [(i + 1000 if i else None, t, s) for i, t, s in odd])
    model = quality.fit(docs, table)
    got = quality.score(docs, *model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    truth = dict(labels)
    held = [r for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 40 and np.mean([(r["score"] >= 0.7) == (truth[r["doc_id"]] == 0) for r in held]) > 0.95
    assert len({r["score"] for r in got if r["doc_id"] in (1001, 1002)}) == 1
    assert quality.kept(docs, *model, least=0.5).count() == sum(r["score"] >= 0.5 for r in got)
    none = spark.createDataFrame([], table.schema)
    assert {round(r["score"], 6) for r in quality.score(docs, *quality.fit(docs, none)).collect()} == {0.5}
    assert quality.score(frame(spark, []), *quality.fit(frame(spark, []), table)).count() == 0


def test_quality_shortcut_is_the_network():
    rng = np.random.RandomState(0)
    data, offsets = tokens.flat(pa.array(["some words here", "", "more more more"]))
    bags = []
    kinds = list(quality.families(data, offsets))
    for d in range(3):
        u, c = np.unique(np.concatenate([x[a[d] : b[d]] for x, a, b in kinds]), return_counts=True)
        bags.append((u, c, d % 2))
    vectors, out, bias = quality.train([b for b in bags if len(b[0])], epochs=2)
    z = quality.logits(data, offsets, vectors @ (out[1] - out[0]), float(bias[1] - bias[0]))
    for d, (u, c, _) in enumerate(bags):
        mean = (c / max(1, c.sum())) @ vectors[u] if len(u) else np.zeros(quality.WIDTH)
        both = out @ mean + bias
        assert z[d] == pytest.approx(both[1] - both[0], abs=1e-4)
    assert rng is not None


def test_training_by_brute_force():
    """The same steps with one vector an n-gram and no shortcuts."""
    rng = np.random.RandomState(3)
    bags = [(np.unique(rng.randint(0, 30, 8)).astype(np.int32), None, k % 2) for k in range(12)]
    bags = [(u, rng.randint(1, 4, len(u)), y) for u, _, y in bags]
    vectors, out, bias = quality.train(bags, buckets=30, width=4, epochs=3, rate=0.3, seed=5)
    draw = np.random.RandomState(5)
    v = [list(map(float, x)) for x in draw.uniform(-1 / 4, 1 / 4, (30, 4)).astype(np.float32)]
    o, b, step = [[0.0] * 4, [0.0] * 4], [0.0, 0.0], 0
    for _ in range(3):
        for k in draw.permutation(12):
            ids, counts, y = bags[k]
            eta = 0.3 * (1 - step / 36)
            step += 1
            share = [c / counts.sum() for c in counts]
            mean = [sum(s * v[i][d] for s, i in zip(share, ids, strict=True)) for d in range(4)]
            z = [sum(o[c][d] * mean[d] for d in range(4)) + b[c] for c in (0, 1)]
            p = [math.exp(x) / sum(map(math.exp, z)) - (c == y) for c, x in enumerate(z)]
            back = [sum(p[c] * o[c][d] for c in (0, 1)) for d in range(4)]
            for c in (0, 1):
                b[c] -= eta * 0.1 * p[c]
                o[c] = [o[c][d] - eta * p[c] * mean[d] for d in range(4)]
            size = math.sqrt(sum(s * s for s in share))
            for s, i in zip(share, ids, strict=True):
                v[i] = [v[i][d] - eta / size * s * back[d] for d in range(4)]
    assert np.allclose(vectors, v, atol=1e-4) and np.allclose(out, o, atol=1e-4) and np.allclose(bias, b, atol=1e-4)


def test_grams_are_of_characters():
    data, offsets = tokens.flat(pa.array(["中文字", "abc", "", "äöüß"]))
    three, four = list(quality.families(data, offsets))[:2]
    assert [int(b - a) for a, b in zip(three[1], three[2], strict=True)] == [1, 1, 0, 2] and [int(b - a) for a, b in zip(four[1], four[2], strict=True)] == [0, 0, 0, 1]


def test_samples_are_bounded(spark):
    rows = [(1, "b", "s")] * 3 + [(1, "a", "s")] + [(k, "x" * 40, "s") for k in range(2, 60)]
    table = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1)], "doc_id long, quality int")
    got = labelled_module.sample(frame(spark, rows), table, "quality", 4, 2, 50, 400).collect()
    assert max(Counter(r["y"] for r in got).values()) <= 11 and len({r["doc_id"] for r in got}) == len(got)
    assert all(r["text"] == "a" for r in got if r["doc_id"] == 1)


def test_toxicity_learns_and_takes_edges(spark, odd):
    rng = random.Random(4)
    rows, labels = labelled(spark, rng, lambda r: words(r, 30) + " Zorgblat " + words(r, 5))
    table = spark.createDataFrame([(i, 1, y) for i, y in labels] + [(None, 1, 1), (9999, None, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows + [(i + 1000 if i else None, t, s) for i, t, s in odd] + [(5000, "x " * 50000 + "zorgblat", "a")])
    model = toxicity.fit(docs, table)
    assert len(model[0]) == 1 << toxicity.BITS
    got = toxicity.score(docs, *model).collect()
    truth = dict(labels)
    held = [r for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 60 and all((r["score"] >= 0.7) == (truth[r["doc_id"]] == 1) for r in held)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["score"])
    assert by[1001] == by[1002] and len(by[1001]) == 1 and min(by[5000]) > 0.5 and len(got) == docs.count()
    assert {r["score"] for r in toxicity.score(docs, *toxicity.fit(docs, spark.createDataFrame([], table.schema))).collect()} == {0.5}
    assert toxicity.score(frame(spark, []), *model).count() == 0


def slow_grams(text):
    out = set()
    for n in toxicity.SIZES:
        for k in range(len(text.lower()) - n + 1):
            h = 1
            for c in text.lower()[k : k + n]:
                h = (h * toxicity._BASE + ord(c)) % 2**64
            out.add((h * toxicity._ODD % 2**64) >> (64 - toxicity.BITS))
    return out


def test_toxicity_by_brute_force(spark):
    texts = ["Ab", "abc abc", None, "", "ÄÖÜ 中文字符 x", "the same the same the same", "🙂🙂🙂"]
    found = [set(f.tolist()) for f in toxicity.gram_sets(pa.array(texts))]
    assert found == [slow_grams(t or "") for t in texts] and len(found[4]) == 8 + 7 + 6 + 5  # of characters, not of bytes
    rng = random.Random(6)
    rows = [(i, words(rng, 12, 25) + (" vile" if i % 4 == 0 else ""), "a") for i in range(120)]
    table = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _, _ in rows], "doc_id long, toxic int")
    weights, bias = toxicity.fit(frame(spark, rows), table)
    mine = [(slow_grams(t), int(i % 4 == 0)) for i, t, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    n, many = len(mine), [sum(y == k for _, y in mine) for k in (0, 1)]
    counts = [Counter(g for s, y in mine if y == k for g in s) for k in (0, 1)]
    ratio = {g: math.log((counts[1][g] + toxicity.SMOOTH * many[1] / n) / many[1]) - math.log((counts[0][g] + toxicity.SMOOTH * many[0] / n) / many[0]) for g in counts[0] | counts[1]}
    used = sorted(ratio)
    assert set(np.flatnonzero(weights).tolist()) <= set(used)
    x = np.array([[ratio[g] if g in s else 0.0 for g in used] + [1.0] for s, _ in mine])
    y = np.array([y for _, y in mine], float)
    w = np.zeros(x.shape[1])
    hessian = lambda p: x.T @ (x * (p * (1 - p))[:, None]) + np.eye(x.shape[1])
    for _ in range(30):  # Newton's method on the same loss
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(hessian(p), x.T @ (p - y) + w)
    want = x @ w
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame(spark, rows), weights, bias).collect()}
    kept = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    assert np.allclose([math.log(got[i] / (1 - got[i])) for i in kept], want, atol=0.05)


# 4: packing


def brute_pack(rows, capacity):
    """The tightest compatible bin by looking at all of them."""
    bins, where = [], []
    for k, (size, source, cluster) in enumerate(rows):
        for p in range(size // capacity):
            bins.append([0, {source}, {cluster}])
            where.append((k, p, len(bins) - 1))
    for k in sorted(range(len(rows)), key=lambda k: (-(rows[k][0] % capacity), k)):
        size, source, cluster = rows[k]
        rest = size % capacity
        if size and not rest:
            continue
        fits = [(b[0], n) for n, b in enumerate(bins) if b[0] >= rest and source not in b[1] and cluster not in b[2]]
        n = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([capacity, set(), set()])
        bins[n][0] -= rest
        bins[n][1].add(source)
        bins[n][2].add(cluster)
        where.append((k, size // capacity, n))
    return sorted(where)


def test_best_fit_by_brute_force():
    rng = random.Random(7)
    for _ in range(20):
        rows = sorted([(rng.choice([0, 3, 10, 20, 25, 47]) + rng.randrange(4), rng.randrange(5), rng.randrange(12)) for _ in range(60)], reverse=True)
        got = packing.best_fit(rows, 20)
        assert sorted((k, p[0], p[3]) for k, pieces in enumerate(got) for p in pieces) == brute_pack(rows, 20)


def test_packing_is_whole_and_without_conflicts(spark, odd):
    rng = random.Random(8)
    rows = odd + [(100 + i, words(rng, rng.randrange(1, 90), 30), rng.choice(["hot", "hot", "b", None])) for i in range(400)] + [(100, "copy copy", "z")] * 3
    out = packing.pack(frame(spark, rows), capacity=64, shard_docs=50).collect()
    sizes = defaultdict(list)
    for i, t, _ in rows:
        sizes[i].append(len(split(t)))
    assert Counter({i: sum(s) for i, s in sizes.items()}) == Counter({i: sum(r["size"] for r in out if r["doc_id"] == i) for i in sizes})
    load = defaultdict(list)
    for r in out:
        load[r["bin"]].append((r["offset"], r["size"]))
    for parts in load.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 64
    source = {i: s for i, _, s in rows if i not in (None, 5, 11, 100)}
    for _, group in itertools.groupby(sorted((r["bin"], r["doc_id"]) for r in out if r["doc_id"] in source), key=lambda x: x[0]):
        names = [source[d] for _, d in group]
        assert len(names) == len(set(names))
    assert packing.pack(frame(spark, [])).count() == 0


def test_shards_are_bounded(spark):
    rows = [(None, f"word{i}", "a") for i in range(6000)] + [(7, "same text", "b")] * 10_000
    out = packing.pack(frame(spark, rows), shard_docs=500).collect()
    assert len(out) == 16_000 and max(Counter(r["bin"] >> 32 for r in out).values()) < 700


# 5: mixing


def test_mixing_meets_targets(spark, odd):
    rng = random.Random(9)
    rows = odd + [(100 + i, words(rng, rng.randrange(1, 60)) + ("!!! 12345" if i % 5 == 0 else ""), rng.choice(["a", "b", "c", "c", "c", "c", "d"])) for i in range(1500)] + [(9000, "", "empty")]
    out = mixing.mix(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(split(t))
    order = sorted([s for s in size if s is not None]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, free, target = sum(size.values()), set(size), {}
    while True:  # step by step, as it is put
        rest = total - sum(3 * size[s] for s in size if s not in free)
        share = {s: weight[s] * rest / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            target = {s: share.get(s, 3 * size[s]) for s in size}
            break
        free -= over
    for s in size:
        mine = [r for r in out if r["source"] == s]
        assert mine[0]["source_size"] == size[s] and mine[0]["target"] == pytest.approx(target[s])
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= max(r["size"] for r in mine)
    assert all(r["taken"] <= 3 * r["size"] and r["copies"] >= r["epochs"] for r in out)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(frame(spark, rows).repartition(7)).collect()))
    times = Counter((r["doc_id"], r["size"]) for r in out for _ in range(r["copies"]))
    mixed = mixing.mixed_documents(frame(spark, rows))
    assert mixed.columns == frame(spark, rows).columns
    assert Counter((r["doc_id"], len(split(r["text"]))) for r in mixed.collect()) == times
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.mixed_documents(frame(spark, [])).count() == 0


def test_ranges_are_even(spark):
    rng = random.Random(10)
    noisy = lambda i: f"{i}" + "#" * rng.randrange(40)
    rows = [(None, f"w{i} and more words", "a") for i in range(6000)] + [(i, noisy(i), "b") for i in range(6000)] + [(3, "again", "c")] * 10_000
    placed = mixing._placed(frame(spark, rows), (5, 2, 1), 3, None)
    widest = {(r["source"], r["range"]): r["count"] for r in placed.groupBy("source", "range").count().collect()}
    assert max(widest.values()) < 400 and sum(n for (s, _), n in widest.items() if s == "c") == 1
    out = mixing.mix(frame(spark, rows)).collect()
    assert len(out) == 22_000 and abs(sum(r["taken"] for r in out if r["source"] == "c") - next(r["target"] for r in out if r["source"] == "c")) <= 1
    times = Counter(r["copies"] for r in out if r["source"] == "c")
    assert Counter(r["doc_id"] for r in mixing.mixed_documents(frame(spark, rows)).where("source = 'c'").collect()) == {3: sum(k * n for k, n in times.items())} and len(times) == 2


def test_no_fraction_of_a_full_source(spark):
    rows = [(1, "", "a"), (2, "one two", "a"), (3, "x " * 500, "b")]
    assert {r["doc_id"]: r["copies"] for r in mixing.mix(frame(spark, rows)).collect()}[1] == 3


def test_weights_may_be_a_column(spark):
    rows = [(i, "some words here", "a") for i in range(3000)] + [(5000 + i, "some words here", "b") for i in range(3000)]
    docs = frame(spark, rows).withColumn("score", F.when(F.col("doc_id") % 2 == 0, 0.1).otherwise(0.9))
    got = [r for r in mixing.mix(docs, weights=(1, 9), weight=F.col("score")).collect() if r["source"] == "a"]
    share = [np.mean([r["copies"] for r in got if r["doc_id"] % 2 == k]) for k in (0, 1)]
    assert share[1] > 3 * share[0]


def test_better_documents_come_more_often(spark):
    good = "plain words in a row " * 4
    rows = [(i, good if i % 2 else "$$$ 123 ### 456 %%% 789 &&& 000 |", "a") for i in range(2000)] + [(5000 + i, good, "b") for i in range(2000)]
    got = [r for r in mixing.mix(frame(spark, rows), weights=(1, 40)).collect() if r["source"] == "a"]
    share = [np.mean([r["copies"] for r in got if r["doc_id"] % 2 == k]) for k in (0, 1)]
    assert share[1] > 1.5 * share[0] > 0


# 6: search


def brute_bm25(rows, k):
    docs = [(i, Counter(split((t or "").lower()))) for i, t, _ in rows]
    n, mean = len(docs), sum(sum(c.values()) for _, c in docs) / max(1, len(docs))
    df = Counter(t for _, c in docs for t in c)
    out = defaultdict(list)
    for q, asked in docs:
        if q is not None and q % 20 == 0 and asked:
            found = []
            for d, c in docs:
                length = sum(c.values())
                s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * length / mean)) for t in asked if t in c)
                if s > 0:
                    found.append((-round(s, 6), -(2**63) if d is None else d))
            out[q] += [(n, d, -s) for n, (s, d) in enumerate(sorted(found)[:k], 1)]
    return {q: sorted(x) for q, x in out.items()}


@pytest.mark.parametrize("small", [False, True])
def test_search_by_brute_force(spark, odd, monkeypatch, small):
    if small:  # several shards, rounds, blocks of queries and columns on few rows
        for name, value in (("SHARD_POSTINGS", 400), ("CHAMPION_POSTINGS", 700), ("BLOCK_TERMS", 300), ("BLOCK_DOCS", 4), ("GROUP", 3), ("COLUMNS", 5)):
            monkeypatch.setattr(bm25, name, value)
    rng = random.Random(11)
    rows = [x for x in odd if x[0] != 6] + [(40, "a second text of an id that asks", "a"), (60, "w1x1 w2x2 w3x3", "a"), (60, "w1x1 w2x2 w3x3", "a")] + [(20 + i, words(rng, rng.randrange(1, 70), 60), "a") for i in range(300)] + [(900 + i, "Tie tie two", "a") for i in range(30)]
    got = defaultdict(list)
    for r in bm25.search(frame(spark, rows), F.col("doc_id") % 20 == 0, 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], -(2**63) if r["doc_id"] is None else r["doc_id"], r["score"]))
    want = brute_bm25(rows, 5)
    assert set(got) == set(want) and len(want) > 10 and len(want[60]) == 15 and len(want[40]) > 5
    for q in want:
        mine = sorted(got[q])
        assert [x[:2] for x in mine] == [x[:2] for x in want[q]] and [x[2] for x in mine] == pytest.approx([x[2] for x in want[q]], abs=2e-6)
    assert bm25.search(frame(spark, []), F.col("doc_id") % 20 == 0).count() == 0


# 8: language model


def plain_scores(text, model):
    """log P of every word, one at a time, by the whole softmax."""
    bucket, _ = masked_lm.buckets(*tokens.flat(pa.array([text])))
    said = [int(model.outputs[b]) for b in bucket]
    at = lambda k: said[k] if 0 <= k < len(said) else masked_lm.EDGE
    net, w, out = model.net.astype(float), masked_lm.WIDTH, []
    for k, y in enumerate(said):
        h = np.tanh(sum(net[p * (masked_lm.OUTPUTS + 1) + at(k + off), :w] for p, off in enumerate(masked_lm.PLACES)))
        total, level = model.within[bucket[k]], masked_lm.AT_LEVEL
        for step, (digit, fork) in enumerate(((y // 512, 8), (y // 32, 16), (y, 32))):
            rows = net[level[step] + digit // fork * fork :][:fork]
            z = rows[:, :w] @ h + rows[:, w]
            total += z[digit % fork] - np.log(np.exp(z).sum())
        out.append(total)
    return out


def test_pseudo_likelihood(spark, odd):
    rng = random.Random(12)
    rows = odd + [(100 + i, " ".join("the cat sat on the mat" if rng.random() < 0.7 else words(rng, 3) for _ in range(9)), "a") for i in range(400)]
    docs = frame(spark, rows)
    encoded = masked_lm.encode(docs)
    model = masked_lm.fit(encoded, rounds=3)
    counts = Counter(b for _, t, _ in rows for b in masked_lm.buckets(*tokens.flat(pa.array([t], pa.string())))[0].tolist())
    top = sorted(counts, key=lambda b: (-counts[b], b))[: masked_lm.OWN]
    assert [model.outputs[b] for b in top] == list(range(len(top)))  # counts are of all words
    shares = np.bincount(model.outputs, np.exp(model.within.astype(float)), minlength=masked_lm.OUTPUTS)
    assert np.allclose(shares[np.unique(model.outputs)], 1, atol=1e-3)
    got = {(r["doc_id"], r["n_words"]): r for r in masked_lm.score(encoded, model).collect()}
    assert len(got) == len({(i, len(split(t))) for i, t, _ in rows})
    assert got[(1, 0)]["log_likelihood"] == 0 and got[(1, 0)]["mean_log_likelihood"] is None and got[(3, 0)]["n_words"] == 0
    for want in (100, 4, 10):
        text = next(t for i, t, _ in rows if i == want)
        r = got[(want, len(split(text)))]
        assert r["log_likelihood"] == pytest.approx(sum(plain_scores(text, model)), rel=1e-4) and r["mean_log_likelihood"] == pytest.approx(r["log_likelihood"] / r["n_words"])
    usual, odd_one = (sum(plain_scores(t, model)) for t in ("the cat sat on the mat", "mat the on sat cat the"))
    assert usual > odd_one + 5  # the order counts, from both sides
    empty = masked_lm.encode(frame(spark, []))
    assert np.isfinite(masked_lm.fit(empty).net).all() and masked_lm.score(empty, masked_lm.fit(empty)).count() == 0


def test_gradient_by_differences():
    rng = np.random.RandomState(0)
    outputs = np.sort(rng.choice([0, 1, 5, 70, 71, 4000], 40)).astype(np.int32)
    around = rng.choice([0, 5, 71, masked_lm.EDGE], (4, 40)).astype(np.int32)
    counts = np.zeros(masked_lm.BUCKETS)
    net = masked_lm.untrained(counts, masked_lm.outputs_of(counts))
    net[masked_lm.AT_TREE :, : masked_lm.WIDTH] = rng.normal(0, 0.3, (masked_lm.ROWS - masked_lm.AT_TREE, masked_lm.WIDTH))
    rows, grads, words_ = masked_lm.gradient(net, outputs, around)
    loss = lambda x: -masked_lm.log_probabilities(x, outputs, around).sum()
    assert len(set(rows.tolist())) == len(rows) and words_[:8].tolist() == [40] * 8
    for k in [*range(3), 10, 30, 40, 50, *range(len(rows) - 6, len(rows))]:
        column = masked_lm.WIDTH if rows[k] >= masked_lm.AT_TREE and k % 2 else 3
        more, less = net.copy(), net.copy()
        more[rows[k], column] += 0.01
        less[rows[k], column] -= 0.01
        assert grads[k, column] == pytest.approx((loss(more) - loss(less)) / 0.02, abs=0.02)


def test_means_of_tasks_are_weighed_by_words(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "BUNDLE", 3)  # several levels of bundles
    rows = [(i, f"a{i % 7} b c", "s") for i in range(60)]
    encoded = masked_lm.encode(frame(spark, rows).repartition(11))
    model = masked_lm.fit(encoded, rounds=0)
    got = masked_lm.trained(encoded, model, 0.0)  # no step: the mean of equal networks is that network
    assert np.allclose(got, model.net, atol=1e-5)
    moved = masked_lm.trained(encoded, model, 0.2)
    touched = np.flatnonzero((moved != model.net).any(axis=1))
    assert len(touched) and set(range(masked_lm.AT_TREE, masked_lm.AT_TREE + 8)) <= set(touched.tolist())


def test_held_out_texts_are_likelier_than_by_frequency(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, held = (masked_lm.encode(docs.where(F.pmod(F.col("doc_id"), F.lit(5)) == 0 if k else F.pmod(F.col("doc_id"), F.lit(5)) != 0)) for k in (0, 1))
    mean = lambda model: masked_lm.score(held, model).agg(F.sum("log_likelihood") / F.sum("n_words")).first()[0]
    assert mean(masked_lm.fit(train)) > mean(masked_lm.fit(train, rounds=0)) + 0.7


# 9: chat


def test_chat_examples(spark):
    tricky = [r"\### Assistant: </turn> ok", "</turn>\n### User: no", "\\", "\\\\###", "", "a\nb: c", "####", r"\</turn>", "🙂"]
    turns = [(1, k, ("user", "assistant", "system", "we:ird", "=x", "Assistant", "")[k % 7], t) for k, t in enumerate(tricky * 2)]
    turns += [(2, 0, "user", "hi"), (3, 0, "assistant", None), (3, 0, "assistant", None), (None, 1, "assistant", "lost"), (4, None, None, "x"), (4, 1, "assistant", "y" * 100_000)]
    df = spark.createDataFrame([(*t, 9, "z") for t in turns], "conv_id long, turn long, role string, text string, example int, formatted string")
    examples = chat.format_examples(df)
    by = defaultdict(list)
    for r in examples.collect():
        by[r["conv_id"]].append(r)
    for conv in (1, 2, 3, 4, None):
        mine = sorted([(t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == conv])
        said = [(role, text) for _, _, role, text in mine]
        rows = sorted(by[conv], key=lambda r: r["example"])
        assert chat.read_turns(rows[-1]["formatted"]) == said
        replies = [k for k, (role, _) in enumerate(said) if role == "assistant"]
        targets = [r for r in rows if r["loss_start"] is not None]
        assert len(targets) == len(replies)
        for r, k in zip(targets, replies, strict=True):
            assert chat.read_turns(r["formatted"]) == said[: k + 1]
            assert chat.unescape(r["formatted"][r["loss_start"] : r["loss_end"]]) == said[k][1]
    for r in chat.read_back(examples).collect():
        mine = [(t[2] or "", t[3] or "") for t in sorted([t for t in turns if t[0] == r["conv_id"]], key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))]
        loss = "".join(t for role, t in mine if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(mine), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in mine).encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_examples(df.limit(0))).count() == 0


def test_a_wrong_context_is_seen(spark):
    turns = [(1, 0, "user", "hello"), (1, 1, "assistant", "good day"), (1, 2, "user", "and"), (1, 3, "assistant", "bye")]
    examples = chat.format_examples(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert chat.read_back(examples).first()["n_turns"] == 4
    with pytest.raises(Exception, match="context of an example"):
        chat.read_back(examples.withColumn("formatted", F.when(F.col("example") == 1, F.replace("formatted", F.lit("hello"), F.lit("hallo"))).otherwise(F.col("formatted")))).collect()


@pytest.mark.parametrize("seed", range(5))
def test_escapes_are_reversible(seed):
    rng = random.Random(seed)
    for _ in range(500):
        text = "".join(rng.choice(["\\", "#", "###", "</turn>", "<", "/", ":", " ", "\n", "a", "### User: "]) for _ in range(rng.randrange(12)))
        assert chat.unescape(chat.escape(text)) == text
        assert chat.read_turns(chat.format_turn(text, text)[0] + chat.format_turn("user", text)[0]) == [(text, text), ("user", text)]


# 10: similarity join


def sets(text):
    w = split(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(rows, least=0.8):
    kinds = list({sets(t) for _, t, _ in rows})
    root = {s: s for s in kinds}
    find = lambda s: s if root[s] is s else find(root[s])
    links = Counter()
    for a, b in itertools.combinations([s for s in kinds if s], 2):
        if len(a & b) >= least * len(a | b):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    name = lambda same: min((i for i, t, _ in rows if i is not None and same(sets(t))), default=None)
    return Counter((i, name(lambda s, m=sets(t): find(s) is find(m)), name(lambda s, m=sets(t): s == m), links[sets(t)]) for i, t, _ in rows)


def test_join_by_brute_force(spark, odd):
    rng = random.Random(13)
    rows = list(odd)
    for g in range(12):
        base = words(rng, 60 + 10 * g).split(" ")
        for k in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            rows.append((1000 + 20 * g + k, " ".join(copy), "a"))
    got = Counter((r["doc_id"], r["class_id"], r["copy_id"], r["n_links"]) for r in jaccard.near_duplicates(frame(spark, rows)).collect())
    assert got == brute_classes(rows)
    assert jaccard.near_duplicates(frame(spark, [])).count() == 0


def test_large_groups_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TASK_ROWS", 700)  # groups lie across the edges of tasks
    rng = random.Random(14)
    base = words(rng, 150).split(" ")
    rows = []
    for k in range(220):
        copy = list(base)
        copy[rng.randrange(150)] = f"new{k}"
        rows.append((k, " ".join(copy), "a"))
    rows += [(1000 + k, words(rng, 100), "b") for k in range(100)]
    got = {r["doc_id"]: r["class_id"] for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert {got[k] for k in range(220)} == {0} and all(got[k] == k for k in range(1000, 1100))


def edited(base, rng, edits, k):
    copy = list(base)
    for spot in rng.sample(range(0, len(base) - 4, 5), edits):
        copy[spot + 2] = f"new{k}x{spot}"
    return " ".join(copy)


def star_of(n, edits):
    """An original of 300 words, its copies with that many words apart from each other changed."""
    rng = random.Random(16)
    base = words(rng, 300, 10**6).split(" ")
    return [(0, " ".join(base), "a")] + [(k, edited(base, rng, edits, k), "a") for k in range(1, n + 1)]


def test_star_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TASK_ROWS", 700)
    monkeypatch.setattr(jaccard, "BLOCK", 60)  # crowded prefixes lie in several blocks
    monkeypatch.setattr(jaccard, "STRIP", 50)
    rows = star_of(300, 6)  # 0.82 similar to the original, less to each other
    got = Counter((r["doc_id"], r["class_id"], r["copy_id"], r["n_links"]) for r in jaccard.near_duplicates(frame(spark, rows)).collect())
    assert got == brute_classes(rows) and got[0, 0, 0, 300] == 1 and {r[1] for r in got} == {0}


def test_star_of_3000(spark):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(frame(spark, star_of(3000, 6))).collect()}
    whole = sum(c == 0 for c, _ in got.values())
    assert got[0][1] == whole - 1 >= jaccard.RECALL * 3000


def test_no_link_of_a_large_group_is_lost(spark):
    got = [r["n_links"] for r in jaccard.near_duplicates(frame(spark, star_of(1000, 1))).collect()]
    assert got == [1000] * 1001  # 500,500 pairs, each 0.93 similar or more


def test_templates_keep_their_pairs(spark):
    """Texts of one template, 0.76 similar by what they share, and planted pairs that are 0.82."""
    rng, n, pairs = random.Random(17), 8000, 200
    shared = words(rng, 142, 10**6).split(" ")
    own = lambda k, m: [f"own{k}x{j}" for j in range(m)]
    rows = [(k, " ".join(shared + own(k, 22)), "a") for k in range(n)]
    rows += [(10**6 + k, " ".join(shared + own(k, 6) + own(10**6 + k, 16)), "a") for k in range(pairs)]
    a, b = sets(rows[0][1]), sets(rows[1][1])
    assert len(a & b) / len(a | b) < 0.8 <= len(a & sets(rows[n][1])) / len(a | sets(rows[n][1]))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
    met = sum(got[10**6 + k] == (k, 1) == got[k] for k in range(pairs))
    assert met >= 0.99 * pairs and sum(c == (k, 0) for k, c in got.items()) >= n - pairs


def test_keys_that_meet_are_told_apart(spark, odd):
    rows = odd + [(100 + k, words(random.Random(k // 2), 40), "a") for k in range(60)]
    got = Counter((r["doc_id"], r["class_id"], r["copy_id"], r["n_links"]) for r in jaccard.near_duplicates(frame(spark, rows), bits=3).collect())
    assert got == brute_classes(rows)


def test_depth_follows_recall():
    d = jaccard.shortest(0.8, 0.999)
    meet = lambda d: 1 - (1 - 0.8**d) ** jaccard.TREES
    assert meet(d) >= 0.999 > meet(d + 1)


def test_components(spark):
    rng = random.Random(15)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5001 + k) for k in range(100)] + [(7, 7)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for view in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {view} AS SELECT * FROM '{sf}/{view}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    rel = con.sql(queries.ORACLE[name])
    clean = lambda names, found: sorted([tuple((n, f"{v:.9g}" if isinstance(v, float) else v) for n, v in sorted(zip(names, r, strict=True))) for r in found], key=str)
    assert clean(df.columns, map(tuple, df.collect())) == clean(rel.columns, rel.fetchall())


def test_outputs_are_sorted_as_they_were():
    assert masked_lm.EDGE < 1 << 16
    given = np.random.RandomState(3).randint(0, masked_lm.EDGE + 1, 20_000).astype(np.int32)
    given[:2] = masked_lm.EDGE, 0
    assert (masked_lm._sorted(given) == np.argsort(given, kind="stable")).all()
    assert len(masked_lm._sorted(given[:0])) == 0


def test_exact_scores_of_some_documents():
    """Any documents in any order, one without words among them, against sums term by term."""
    rng = np.random.RandomState(5)
    terms = [np.sort(rng.choice(60, n, replace=False)).astype("<u8") for n in (7, 0, 30, 1, 12)]
    tfs = [rng.randint(1, 9, len(t)).astype("<i4") for t in terms]
    length, many = np.array([t.sum() for t in tfs]), np.array([len(t) for t in terms])
    q = bm25.Queries(np.zeros(1, np.int64), np.ones(1), np.array([0, 20]), np.arange(20), np.arange(0, 60, 3, dtype="<u8"), np.linspace(0.1, 2, 20))
    shard = bm25.Shard([np.arange(5), length, np.zeros(5, np.int64), many, np.concatenate(terms), np.concatenate(tfs)], 10.0, q)
    asked = np.isin(shard.terms, q.terms)
    for docs in (np.arange(5), np.array([3]), np.array([4, 1, 0])):
        want = []
        for d in shard.ids[docs]:
            weigh = 1.2 * (0.25 + 0.75 * length[d] / 10)
            want.append(sum(q.idf[t // 3] * f * 2.2 / (f + weigh) for t, f in zip(terms[d].astype(int), tfs[d], strict=True) if t % 3 == 0))
        assert shard.exact(docs, asked) == pytest.approx(want, abs=1e-12)


def test_few_shards_are_dealt_to_all_cores():
    shard = bm25.SHARD_POSTINGS
    assert [bm25.tasks(n, 6) for n in (0, 1, shard, shard + 1, 4 * shard, 24 * shard, 25 * shard, 400 * shard)] == [1, 1, 1, 2, 4, 6, 7, 100]
