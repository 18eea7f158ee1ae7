import math
import random
from collections import Counter

import numpy as np
import pytest

from bytelane.llm import ranked
from test_decontam import words


def brute(docs, items, k=20):
    bags = [(i, Counter(words(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    df = Counter(t for _, b in bags for t in b)
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    text, out = {}, []
    for i, t in items:
        text[i] = min(text.get(i, t or ""), t or "")
    for item, t in text.items():
        found = []
        for i, b in bags:
            m = 75 + 25 * sum(b.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * b[x] // (1000 * b[x] + 12 * m)) for x in words(t) if x in b)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(out, key=str)


def corpus(seed, n=400, vocabulary=60):
    rnd = random.Random(seed)
    terms = [f"w{i}" for i in range(vocabulary)] + ["é", "Ünï", "10"]
    weights = [1 / (i + 1) for i in range(len(terms))]
    docs = [(i, " ".join(rnd.choices(terms, weights, k=rnd.randint(1, 60)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " ,;"), (None, docs[0][1]), (None, "w50 w51"), (5, docs[5][1]), (7, "W1 w1 W1-w1")]
    items = [(i, " ".join(rnd.choices(terms, weights, k=rnd.randint(1, 25)))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "nothing of this"), (3, "w1"), (None, "w50 w2 w2"), (33, "w1 " * 40 + "w55")]
    return docs, items


def answer(spark, docs, items, k=20):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item_id long, score long").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    return sorted([tuple(r) for r in ranked.top_k(d, q, k).collect()], key=str)


@pytest.mark.parametrize(("shard", "terms", "k"), [(4 << 20, 1_000_000, 20), (2000, 1_000_000, 5), (500, 90, 3)])
def test_against_brute_force(spark, monkeypatch, shard, terms, k):
    monkeypatch.setattr(ranked, "SHARD_BYTES", shard)
    monkeypatch.setattr(ranked, "QUERY_TERMS", terms)
    monkeypatch.setattr("bytelane.llm.words.BLOCK_BYTES", 500)
    docs, items = corpus(4)
    assert answer(spark, docs, items, k) == brute(docs, items, k)


def test_empty_tables(spark):
    docs, items = corpus(1, 9)
    assert answer(spark, [], items) == []
    assert answer(spark, docs, []) == []


def shard_of(docs):
    import pyarrow as pa

    texts = pa.array([t or "" for _, t in docs])
    batch = ranked._shard([(np.array([i if i is not None else ranked.LAST for i, _ in docs]), *ranked._bags(texts))])
    shard = ranked.Shard.of(batch, 0)
    scorer = ranked.Scorer(int(batch.column("n_docs")[0].as_py()), int(batch.column("n_terms")[0].as_py()))
    df = np.diff(shard.upto)
    lists = ranked.pair_lists(shard, shard.terms, scorer.weights(df), scorer)
    for c, v in lists.items():
        setattr(shard, c, v)
    return shard, scorer, df


def queries_of(items, shard, scorer, df):
    import pyarrow as pa

    text, term, times, _ = ranked._bags(pa.array([t or "" for _, t in items]))
    vocabulary, number = np.unique(term, return_inverse=True)
    weight = np.zeros(len(vocabulary), np.int64)
    at, found = shard.find(vocabulary)
    weight[found] = scorer.weights(df[at])
    return ranked.Queries(np.arange(len(items)), vocabulary, weight, np.searchsorted(text, np.arange(len(items) + 1)), number, times)


def test_pair_lists_hold_the_joint_maxima(monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK", 8)
    docs, _ = corpus(2)
    shard, scorer, df = shard_of(docs)
    m = scorer.m(shard.lengths)
    doc, impact, upto = shard.impacts(np.arange(len(shard.terms)), scorer.weights(df), m)
    of = [dict(zip(doc[a:b].tolist(), impact[a:b].tolist(), strict=True)) for a, b in zip(upto, upto[1:], strict=False)]
    pairs = shard.pair_terms.reshape(-1, 2).tolist()
    assert pairs
    for p, (a, b) in enumerate(pairs):
        want = {}
        for d in of[a].keys() & of[b].keys():
            want[d // 8] = max(want.get(d // 8, 0), of[a][d] + of[b][d])
        lo, hi = shard.pair_upto[p], shard.pair_upto[p + 1]
        assert dict(zip(shard.pair_blocks[lo:hi].tolist(), shard.pair_peaks[lo:hi].tolist(), strict=True)) == want
        at = ranked.Pairs(shard)
        assert at.of(a, b) == p == at.of(b, a) and at.most[p] == max(want.values(), default=-1)


def test_bounds_hold_and_pairs_tighten_them(monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK", 8)
    docs, items = corpus(3)
    shard, scorer, df = shard_of(docs)
    queries = queries_of(items, shard, scorer, df)
    number, found = shard.find(queries.vocabulary)
    doc, impact, upto = shard.impacts(number, queries.weight[found], scorer.m(shard.lengths))
    top = np.maximum.reduceat(impact, upto[:-1])
    slot = np.full(len(queries.vocabulary), -1)
    slot[found] = np.arange(len(found))
    tighter = 0
    for q in range(len(items)):
        lo, hi = queries.upto[q], queries.upto[q + 1]
        own, times = slot[queries.term[lo:hi]], queries.times[lo:hi]
        own, times = own[own >= 0], times[own >= 0]
        order = np.argsort(top[own] * times, kind="stable")
        own, times = own[order], times[order]
        b = ranked.Bounds(shard, ranked.Pairs(shard), number[own], top[own] * times, times)
        score = np.zeros(len(shard.ids), np.int64)
        for r in range(len(own) + 1):
            assert (score <= b.of(r, np.arange(len(score)))).all() and score.max(initial=0) <= b.upto[r]
            assert r == 0 or b.upto[r] >= b.upto[r - 1]
            tighter += b.upto[r] < (top[own] * times)[:r].sum()
            if r < len(own):
                t = own[r]
                score[doc[upto[t]:upto[t + 1]]] += impact[upto[t]:upto[t + 1]] * times[r]
    assert tighter > 0


def test_a_score_to_beat_skips_postings():
    docs, items = corpus(5, 3000)
    shard, scorer, df = shard_of(docs)
    queries = queries_of(items, shard, scorer, df)
    first = ranked.Best(len(items), 3)
    all_used, seen = ranked.search_shard(shard, queries, scorer, first)
    floor = np.array([s[-1] if len(s) == 3 else 0 for s in first.scores])
    again = ranked.Best(len(items), 3, floor)
    used, _ = ranked.search_shard(shard, queries, scorer, again)
    assert all(a.tolist() == b.tolist() for a, b in zip(first.ids, again.ids, strict=True))
    assert all_used == seen and used < 0.8 * seen
