import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from bytelane.llm import anchors, substrings


def brute(rows, window=35):
    texts = [(t or "").encode().split() for _, t in rows]
    # separators other than blanks stay with str semantics: bytes.split() cuts at \x20 and \x09-\x0D
    count = Counter(tuple(w[i:i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, texts):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def cases(seed, vocabulary):
    rnd = random.Random(seed)
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passages = [words(n) for n in (34, 35, 36, 60, 200)]
    rows = []
    for i in range(50):
        parts = words(rnd.randrange(80))
        for _ in range(rnd.randrange(3)):
            parts += rnd.choice(passages) + words(rnd.randrange(3))
        rows.append((i, "".join(w + rnd.choice([" ", "\n", " \t", "\x0b"]) for w in parts)))
    own = words(300)
    rows += [(100, " ".join(own)), (101, " ".join(own[:150] + ["edit"] + own[151:])), (102, " ".join(own[40:260]))]
    rows += [(103, " ".join(own)), (104, " ".join(own))] + [(105, "x " * 400), (106, "y " * 34), (107, "z " * 35), (108, "a b " * 100)]
    rows += [(None, " ".join(own)), (None, None), (110, ""), (110, " ".join(words(90))), (110, " ".join(words(90))), (111, rows[3][1]), (111, rows[3][1])]
    return rows


def check(spark, rows):
    df = spark.createDataFrame([(a, b, "k", 1) for a, b in rows], "doc_id long, text string, key string, id int")
    got = [tuple(r) for r in substrings.dedup(df).select("id", "n_words", "n_removed", "kept_sha").collect()]
    assert sorted(got, key=str) == brute(rows)


def test_against_brute_force(spark):
    check(spark, cases(1, ["w%d" % i for i in range(400)] + ["é", "日本"]))
    check(spark, cases(2, ["a", "b", "c"]))


def test_crowded_prefixes_are_split(spark, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", 3)
    check(spark, cases(3, ["a", "b", "c", "d"]))


def quoted(n, seed=9):
    """A passage in many documents, with other text around it each time."""
    rnd = random.Random(seed)
    words = lambda k: [f"u{rnd.randrange(10**9)}" for _ in range(k)]
    passage = words(40)
    return [(i, " ".join(words(rnd.randrange(3, 30)) + passage + words(rnd.randrange(3, 30)))) for i in range(n)]


def test_a_passage_in_many_documents(spark, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", 20)
    rows = quoted(300) + cases(4, ["a", "b", "c", "d"]) + [(None, quoted(1)[0][1]), (None, quoted(2)[1][1] + " tail")]
    check(spark, rows)


def test_no_group_grows_with_the_places_of_a_gram(spark, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", 200)
    seen = {}
    kept = substrings.suffix_records

    def watch(rows, crowded, partitions):
        out = kept(rows, crowded, partitions)
        seen["records"] = max([r["count"] for r in out.groupBy("part").count().collect()], default=0)
        seen["crowded"] = len(crowded[-1])
        return out

    monkeypatch.setattr(substrings, "suffix_records", watch)
    rows = quoted(3000)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.dedup(df).select("n_removed").collect()
    assert all(r["n_removed"] == 40 for r in got)
    assert seen["crowded"] > 0 and seen["records"] <= 400


def test_many_rows_without_an_id(spark):
    rows = [(None, t) for _, t in quoted(120)] + [(7, t) for _, t in quoted(60, 10)]
    check(spark, rows)


def test_edges(spark):
    check(spark, [])
    check(spark, [(1, None)])
    check(spark, [(1, "w " * 35), (1, "w " * 35)])


def test_stretches_own_every_window_once_and_equal_windows_agree():
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("ab") for _ in range(n)) for n in (0, 5, 49, 50, 51, 300, 900)] + ["ab" * 90, "a" * 120]
    units = anchors.byte_units(pa.array(texts), 16)
    s = anchors.stretches(units, 50, 16)
    at, whole = {}, "".join(texts)
    for t, a, lo, hi, g in zip(s.text, s.anchor, s.first, s.last, s.gram):
        for i in range(lo, hi + 1):
            assert units.bounds[t] <= i and i + 50 <= units.bounds[t + 1] and i <= a <= i + 34
            assert at.setdefault(i, (a - i, g)) == (a - i, g)
    want = [units.bounds[t] + i for t, x in enumerate(texts) for i in range(len(x) - 49)]
    assert sorted(at) == want
    by = {}
    for i in want:
        assert by.setdefault(whole[i:i + 50], at[i]) == at[i]


def test_deep_nodes_group_equal_windows():
    rng = np.random.default_rng(1)
    numbers = rng.integers(0, 2, 4000)
    bounds = np.array([0, 3, 10, 200, 200, 1500, 4000])
    for depth in (1, 2, 3, 5, 7, 8, 13):
        places, node = substrings.deep_nodes(numbers, bounds, depth)
        windows = [tuple(numbers[p:p + depth]) for p in places]
        assert windows == sorted(windows)
        groups = {}
        assert all(groups.setdefault(w, n) == n for w, n in zip(windows, node.tolist())) and len(set(node.tolist())) == len(groups)
        assert sorted(places) == [i for a, b in zip(bounds, bounds[1:]) for i in range(a, b - depth + 1)]
