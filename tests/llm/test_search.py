import math
import random
from collections import Counter

import numpy as np
import pytest

from bytelane.llm import search
from test_decontam import words


def brute(docs, queries, k):
    bags = [(i, Counter(words(t))) for i, t in docs]
    df = Counter(t for _, b in bags for t in b)
    mean = sum(sum(b.values()) for _, b in bags) / max(len(bags), 1)
    out = []
    text = {}
    for i, t in queries:
        text[i] = min(text.get(i, t or ""), t or "")
    for qid, t in text.items():
        found = []
        for i, b in bags:
            n = sum(b.values())
            s = sum(math.log(1 + (len(bags) - df[x] + 0.5) / (df[x] + 0.5)) * b[x] * 2.2 / (b[x] + 1.2 * (0.25 + 0.75 * n / mean))
                    for x in set(words(t)) if x in b)
            if s > 0:
                found.append((-round(s, 6), i is None, i or 0, i))
        out += [(qid, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(out, key=str)


def cases(seed, n=160):
    rnd = random.Random(seed)
    common, rare = ["the", "Of", "und", "été", "x1"], ["r%d" % i for i in range(300)]
    text = lambda: " ".join(rnd.choice(common if rnd.random() < 0.6 else rare) for _ in range(rnd.randrange(60)))
    docs = [(i, text()) for i in range(n)]
    docs += [(1000 + i, docs[3][1]) for i in range(25)] + [(None, docs[4][1]), (None, None), (7, docs[7][1]), (2000, "the " * 5000), (2001, "")]
    return docs


@pytest.mark.parametrize("block,chunk,frequent,terms", [(64, 256, 48, 1 << 22), (4, 3, 2, 1 << 22), (8, 16, 10 ** 9, 300)])
def test_against_brute_force(spark, monkeypatch, block, chunk, frequent, terms):
    for name, value in (("BLOCK", block), ("CHUNK", chunk), ("FREQUENT", frequent), ("QUERY_TERMS", terms), ("SHARD_BYTES", 700)):
        monkeypatch.setattr(search, name, value)
    docs = cases(block)
    queries = [d for d in docs if d[0] is not None and d[0] % 4 == 0] + [(5000, "no such words"), (None, "the r1 r2"), (4, "zzz the")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, score int").repartition(3, "doc_id")
    q = spark.createDataFrame(queries, "doc_id long, text string")
    got = sorted((tuple(r) for r in search.top_k(d, q, 5).collect()), key=str)
    want = brute(docs, queries, 5)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert search.top_k(d.limit(0), d).count() == 0
    assert search.top_k(d, d.limit(0)).count() == 0


def test_blocks_are_skipped_and_nothing_is_lost():
    import pyarrow as pa

    rnd = random.Random(1)
    docs = [(i, " ".join(f"{'abcd'[i % 4]}{rnd.randrange(30)}" for _ in range(40))) for i in range(2000)]
    shard = search.Shard.of(search._packed([([i for i, _ in docs], *search.block_terms(pa.array([t for _, t in docs])))]), 0)
    text, term, _, _ = search.block_terms(pa.array([docs[0][1]]))
    q = search.Queries(np.array([0]), np.unique(term), np.zeros(len(term), np.int64), np.arange(len(term)), np.ones(len(term)), 40.0)
    best = search.Best(1, 10)
    first = search.search_shard(shard, q, best)
    again = search.search_shard(shard, q, best)
    n = -(-len(docs) // search.BLOCK)
    assert first < n and again <= first
    want = sorted(((-s, i) for s, i in zip(best.scores[0].tolist(), best.ids[0].tolist())))[:1]
    assert want[0][1] == 0


@pytest.mark.parametrize("shared,cells,postings,wide", [(1, 64, 8, 1), (10 ** 9, 1 << 20, 1 << 18, 4), (20, 500, 1, 50)])
def test_every_way_of_scoring_against_brute_force(spark, monkeypatch, shared, cells, postings, wide):
    for name, value in (("SHARED", shared), ("CELLS", cells), ("POSTINGS", postings), ("WIDE", wide), ("BLOCK", 8), ("SHARD_BYTES", 3000)):
        monkeypatch.setattr(search, name, value)
    docs = cases(shared % 7, 300)
    queries = [d for d in docs if d[0] is not None and d[0] % 4 == 0]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2, "doc_id")
    got = sorted((tuple(r) for r in search.top_k(d, spark.createDataFrame(queries, "doc_id long, text string"), 5).collect()), key=str)
    want = brute(docs, queries, 5)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)


def test_shared_terms_are_not_added_posting_by_posting(monkeypatch):
    """Terms that most queries and documents of a small shard share are multiplied by block, not listed for each query."""
    import pyarrow as pa

    rnd = random.Random(2)
    docs = [(i, " ".join(f"w{j}" for j in rnd.sample(range(50), 40))) for i in range(100)]
    shard = search.Shard.of(search._packed([([i for i, _ in docs], *search.block_terms(pa.array([t for _, t in docs])))]), 0)
    text, term, _, _ = search.block_terms(pa.array([t for _, t in docs[:64]]))
    vocabulary, number = np.unique(term, return_inverse=True)
    q = search.Queries(np.arange(64), vocabulary, text, number, np.ones(len(vocabulary)), 40.0)
    listed = []

    def counted(starts, counts, whole=search.expand):
        listed.append(int(np.sum(counts)))
        return whole(starts, counts)

    monkeypatch.setattr(search, "expand", counted)
    best = search.Best(64, 5)
    search.search_shard(shard, q, best)
    assert sum(listed) <= 4 * len(shard.docs)
    bags = [set(t.split()) for _, t in docs]
    for i in range(64):
        n = sorted((-len(bags[i] & b), j) for j, b in enumerate(bags))[:5]
        assert best.ids[i].tolist() == [j for _, j in n]
