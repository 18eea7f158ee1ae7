import random
from itertools import combinations

import numpy as np
import xxhash

from bytelane.llm import golay, simhash
from bytelane.llm.components import components


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_golay_words_within_two_bits_share_an_index():
    reps = golay.PATTERNS[:, 0]  # one word of each coset; a codeword shifts all indices alike

    def sets(words):
        index, source = golay.indices(words)
        out = [set() for _ in words]
        for i, s in zip(index.tolist(), source.tolist()):
            out[s].add(i)
        return out

    base = sets(reps)
    for flips in [()] + list(combinations(range(23), 1)) + list(combinations(range(23), 2)):
        mask = sum(1 << i for i in flips)
        assert all(a & b for a, b in zip(base, sets(reps ^ mask)))


def test_fingerprint_block():
    texts = ["", None, "one", "A b\tc\nd  e f", "x " * 500, "Été İ K z", "\x00 \x0b a b c d"]
    assert simhash.fingerprint_block(texts).tolist() == [fingerprint(t) for t in texts]


def test_components_of_chains_stars_and_cycles(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(-20, 60)] + [(100, x) for x in range(101, 160)] + [(7, 7), (300, 299), (299, 300)]
    edges += [(rnd.randrange(1000, 1300), rnd.randrange(1000, 1300)) for _ in range(170)]
    want = roots({x for e in edges if e[0] != e[1] for x in e}, edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id string")
    got = sorted(map(tuple, simhash.near_duplicates(df).select("doc_id", "fp", "component_id").collect()), key=str)
    fps = [fingerprint(r[1]) for r in rows]
    distinct = sorted(set(fps))
    edges = [(a, b) for a, b in combinations(distinct, 2) if (a ^ b).bit_count() <= 2]
    root = roots(distinct, edges)
    least = {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            least[root[f]] = min(least.get(root[f], r[0]), r[0])
    want = [(r[0], int(np.uint64(f).astype(np.int64)), least.get(root[f])) for r, f in zip(rows, fps)]
    assert got == sorted(want, key=str)


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = ["w%d" % i for i in range(50)]
    rows = []
    for i in range(60):
        words = [rnd.choice(vocabulary) for _ in range(300)]
        rows.append((i, " ".join(words), "x", "y"))
        for j in range(2):
            copy = list(words)
            copy[rnd.randrange(300)] = "edited"
            rows.append((1000 + 10 * i + j, " ".join(copy), None, None))
    rows += [(None, "one two", "", ""), (5, "", "", ""), (6, None, "", ""), (7, "one two", "", ""), (7, "one two", "", ""), (None, None, "", "")]
    check(spark, rows)
    check(spark, [])
    check(spark, [(None, "", "", "")])


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    rnd = random.Random(9)
    centre = rnd.getrandbits(64)
    values = {centre} | {centre ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(150)}
    values |= {v ^ (1 << rnd.randrange(64)) for v in list(values)[:40]} | {rnd.getrandbits(64) for _ in range(100)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    want = roots(signed, [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2])
    for bucket in (2, 1000):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        got = {r["node"]: r["root"] for r in components(simhash.links(df)).collect()}
        assert all(got.get(s, s) == want[s] for s in signed)
