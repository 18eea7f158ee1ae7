import math
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bytelane.llm import labelled, quality, toxicity, words
from bytelane.sources.tables import table

SF = "/root/testdata/sf0.1"


def held_out_rows(spark, module, out, label):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = module.fit(docs, labels)
    rows = module.score(docs, model, out).join(labels, "doc_id").select("doc_id", out, label).collect()
    rows = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    return np.array([r[out] for r in rows]), np.array([r[label] for r in rows])


def auc(score, y):
    order = np.argsort(np.argsort(score))
    pos = y == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_toxicity_held_out(spark):
    score, y = held_out_rows(spark, toxicity, "p", "toxic")
    assert auc(score, y) > 0.97
    assert np.mean((score >= 0.5) == y) > 0.97


def test_quality_held_out(spark):
    score, y = held_out_rows(spark, quality, "p", "quality")
    assert auc(score, y) > 0.93
    assert np.mean((score >= 0.3) == y) > 0.95


def test_the_machine_learns_a_pair_that_no_sum_tells_apart():
    # label 1: exactly one of the two terms... or both: only the pair decides
    features = [np.array(f, np.int64) for f in ([0], [1], [0, 1], [])] * 600
    y = np.array([1.0, 1.0, 0.0, 0.0] * 600)
    m = toxicity._learn(features, y, np.full(1 << toxicity.BITS, -1), 0.0, 2)
    for f, want in zip(features[:4], y[:4]):
        p = labelled.sigmoid(m.logits(np.zeros(len(f), np.int64), f, 1))[0]
        assert (p > 0.5) == (want == 1)


def test_fit_learns_a_pair_among_more_terms_than_any_cut(spark):
    # label 1: exactly one of the two words; each alone tells nothing
    rng = np.random.default_rng(17)
    cases = [("zeppelin", 1), ("aardvark", 1), ("zeppelin aardvark", 0), ("", 0)]
    rows = [(i, " ".join([cases[i % 4][0], *(f"{w:05d}x" for w in rng.integers(0, 6000, 8))]), cases[i % 4][1]) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert [int(p > 0.5) for p in m.scores(pa.array([c[0] for c in cases]))] == [c[1] for c in cases]


def test_every_term_of_the_sample_is_an_input(spark):
    # 1,500 insults, each in two documents
    rows = [(i, f"common words {i // 2:04d}" if i < 3000 else f"common words {i:05d}", int(i < 3000)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    seen = [t for i, t, _ in docs.collect() if zlib.crc32(str(i).encode()) % 5]
    _, bucket = toxicity.terms(pa.array(seen))
    assert (m.slots[np.unique(bucket)] >= 0).all() and len(m.weights) == len(np.unique(bucket)) > 1024


def test_logits_against_the_formula():
    rng = np.random.default_rng(3)
    m = toxicity.Machine(0.3, None, rng.normal(size=6), rng.normal(size=(6, 4)))
    sets = [[0, 2, 5], [], [1], [3, 4]]
    text = np.repeat(np.arange(4), [len(s) for s in sets])
    got = m.logits(text, np.concatenate([np.array(s, np.int64) for s in sets]), 4)
    for s, g in zip(sets, got):
        want = 0.3 + sum(m.weights[i] for i in s) + sum(m.factors[i] @ m.factors[j] for i in s for j in s if i < j)
        assert g == pytest.approx(want)


def test_chunks_cover_every_window_of_the_whole_text():
    offsets = np.array([0, 0, 5, 5 + quality.CHUNK, 5 + quality.CHUNK + 10_000])
    starts, ends, owner = quality.chunk_spans(offsets)
    for t in range(4):
        a, b = starts[owner == t], ends[owner == t]
        assert a[0] == offsets[t] and b[-1] == offsets[t + 1]
        assert all(x - y >= quality.WIDTH - 1 for x, y in zip(b[:-1], a[1:]))
        assert all(b - a <= quality.CHUNK)


def test_network_gradients():
    net = quality.Network()
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    docs, y = [[b"some text here, longer than a window", b"x"], [b"!!!! ????"], [b""]], np.array([1.0, 0.0, 1.0])

    def loss():
        out = 0.0
        for d, t in zip(docs, y):
            chunks = [np.frombuffer(c, np.uint8) for c in d]
            ends = np.cumsum([len(c) for c in chunks])
            sizes = np.array([len(c) for c in chunks])
            h = net.chunk_values(quality.chunk_bytes(np.concatenate(chunks), ends - sizes, ends), sizes)
            p = labelled.sigmoid(np.concatenate([h.max(axis=0), h.mean(axis=0)]) @ net.p["out"] + net.p["out_b"])[0]
            out -= (t * np.log(p) + (1 - t) * np.log(1 - p)) / 3
        return out

    grads = quality._gradients(net, docs, y)
    rng = np.random.default_rng(0)
    for k in ("out", "hidden", "hidden_b", "conv", "conv_b", "bytes"):
        flat, g = net.p[k].reshape(-1), grads[k].reshape(-1)
        for i in rng.permutation(len(flat))[:12]:
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert g[i] == pytest.approx((up - down) / 2e-5, abs=2e-4)


def test_fit_reads_every_chunk_of_a_long_document(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "learn", lambda docs, y: seen.extend(docs))
    text = "".join(f"{i:07d} " for i in range(12_500))
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    quality.fit(docs, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int"))
    raw = max(seen, key=len)
    assert raw[0] + b"".join(c[quality.WIDTH:] for c in raw[1:]) == text.encode()


def test_gradients_do_not_depend_on_blocks(monkeypatch):
    docs = [[b"some text %d" % i for i in range(9)], [b"x"], [b"!!!! %d ????" % i for i in range(7)]]
    y = np.array([1.0, 0.0, 1.0], np.float32)
    whole = quality._gradients(quality.Network(), docs, y)
    monkeypatch.setattr(quality, "AT_ONCE", 4)
    parts = quality._gradients(quality.Network(), docs, y)
    assert all(np.allclose(whole[k], parts[k], atol=1e-5) for k in whole)


@pytest.mark.parametrize("module,out,label", [(toxicity, "toxicity", "toxic"), (quality, "p", "quality")])
def test_edge_cases(spark, module, out, label):
    docs = spark.createDataFrame(
        [(1, "good words here", "a"), (2, None, None), (None, "", "b"), (3, "x" * 100_000, "c"), (1, "good words here", "a")],
        "doc_id long, text string, label string")
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    rows = module.score(docs, module.fit(docs, none), out).collect()
    assert len(rows) == 5 and all(r[out] == 0.5 for r in rows) and rows[0].__fields__ == [*docs.columns, out]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (4, 1), (None, 1), (3, 0), (5, None)], f"doc_id long, {label} int")
    rows = module.score(docs, module.fit(docs, labels), out).collect()
    assert all(0 <= r[out] <= 1 for r in rows)
    assert module.score(docs.limit(0), module.fit(docs, labels), out).count() == 0
    with pytest.raises(ValueError):
        module.score(docs.withColumnRenamed("label", out), module.fit(docs, labels), out)


def test_held_out_ids_are_never_sampled(spark):
    labels = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    ids = [r["_id"] for r in labelled.sample_of(labels, "toxic", 300).collect()]
    assert len(ids) == 300 and all(zlib.crc32(str(i).encode()) % 5 for i in ids)
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
               for r in labels.select("doc_id", labelled.held_out(F.col("doc_id")).alias("h")).collect())


def test_repeated_ids_stay_within_the_bounds(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(i, "x" * i) for i in range(2, 30)], "doc_id long, text string")
    labels = spark.range(1, 30).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    rows = labelled.labelled_texts(docs, labels, "toxic", 100, "doc_id", "text")
    assert rows.count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(1, 30))
    assert not rows.where("text like 'text %'").count() or [r["text"] for r in rows.where("text like 'text %'").collect()] == ["text 0"]
    ordered = [(r["h"], len(r["text"])) for r in rows.orderBy("h").collect()]
    for limit in (0, 5, 40, 200, 10_000):
        want, total = [], 0
        for h, n in ordered:
            if n <= limit:
                total += n
                if total > limit:
                    break
                want.append(h)
        assert sorted(r["h"] for r in labelled.within(rows, F.length("text"), limit).collect()) == want


def hashed(word):
    """The terms' hash in whole numbers."""
    mask = (1 << 64) - 1
    h = (sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(word)) + len(word)) & mask
    return finish(h)


def finish(h):
    mask = (1 << 64) - 1
    h = ((h ^ h >> 33) * 0xFF51AFD7ED558CCD) & mask
    h = ((h ^ h >> 33) * 0xC4CEB9FE1A85EC53) & mask
    return h ^ h >> 33


def plain_terms(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    out, shift = [], 64 - toxicity.BITS
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", low):
        out.append(hashed(w) >> shift)
        out += [finish((hashed(w[:n]) + n) & ((1 << 64) - 1)) >> shift for n in toxicity.PREFIXES if len(w) >= n]
    return out


def test_terms_and_scores_against_plain_python():
    texts = ["Hello, WORLD hello", "", None, "été été-abcdef 12", "a b c", "!!", "toxicword toxicwords x9"]
    owner, bucket = toxicity.terms(pa.array(texts))
    for i, t in enumerate(texts):
        assert sorted(bucket[owner == i].tolist()) == sorted(plain_terms(t))
    known = sorted({b for t in texts[:4] for b in plain_terms(t)})
    slots = np.full(1 << toxicity.BITS, -1, np.int64)
    slots[known] = np.arange(len(known))
    rng = np.random.default_rng(5)
    m = toxicity.Machine(-0.4, slots, rng.normal(size=len(known)), rng.normal(size=(len(known), 4)))
    for t, got in zip(texts, m.scores(pa.array(texts)), strict=True):
        own = sorted({slots[b] for b in plain_terms(t)} - {-1})
        z = -0.4 + sum(m.weights[i] for i in own) + sum(m.factors[i] @ m.factors[j] for i in own for j in own if i < j)
        assert got == pytest.approx(1 / (1 + math.exp(-z)))


def test_the_forward_pass_against_plain_python():
    net = quality.Network(3)
    net.p["hidden_b"] += 0.1
    net.p["conv_b"] -= 0.2
    p = {k: v.astype(float).tolist() for k, v in net.p.items()}
    texts = ["short", "", "x" * 255 + "é", "many words, " * 60, "0123456789" * 77]
    for text, got in zip(texts, net.scores(pa.array(texts)), strict=True):
        data, hidden = list(text.encode()), []
        at = 0
        while True:
            chunk = data[at:at + 256]
            symbols = chunk + [256] * (256 - len(chunk))
            values = []
            for f in range(quality.FILTERS):
                sums = []
                for place in range(0, 256 - 8 + 1, 2):
                    row = [x for s in symbols[place:place + 8] for x in p["bytes"][s]]
                    sums.append(sum(a * p["conv"][i][f] for i, a in enumerate(row)))
                values.append(max(0.0, max(sums) + p["conv_b"][f]))
            values.append(math.log1p(len(chunk)) / math.log1p(256))
            hidden.append([max(0.0, sum(v * p["hidden"][i][j] for i, v in enumerate(values)) + p["hidden_b"][j]) for j in range(quality.HIDDEN)])
            if at + 256 >= len(data):
                break
            at += 248
        pooled = [max(h[j] for h in hidden) for j in range(quality.HIDDEN)] + [sum(h[j] for h in hidden) / len(hidden) for j in range(quality.HIDDEN)]
        z = sum(a * b for a, b in zip(pooled, p["out"], strict=True)) + p["out_b"][0]
        assert got == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def test_scores_do_not_depend_on_blocks():
    net = quality.Network()
    texts = ["a b c " * n for n in (0, 1, 50, 3000)] + ["été\n" * 700]
    whole = net.scores(pa.array(texts))
    assert np.allclose(whole, [net.scores(pa.array([t]))[0] for t in texts], atol=1e-5)


def test_a_task_takes_little_memory_and_keeps_less(monkeypatch):
    monkeypatch.setattr(words, "_powers", np.ones(1, np.uint64))
    monkeypatch.setattr(words, "_inverse", np.ones(1, np.uint64))
    batch = pa.record_batch({"text": ["some words that a document may hold " * 100] * 1200})
    machine = toxicity.Machine(0.0, np.arange(1 << toxicity.BITS), np.zeros(1 << toxicity.BITS), np.zeros((1 << toxicity.BITS, toxicity.FACTORS)))
    tracemalloc.start()
    try:
        scores = [machine.scores(block.column("text")) for block in words.text_blocks(iter([batch]), "text")]
        kept, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert sum(map(len, scores)) == batch.num_rows and batch.nbytes > 4 << 20
    # before, blocks of 2 MB: 105 MB at most, 40 MB kept
    assert most < 50 << 20
    assert kept < 20 << 20
