import random
import re

import numpy as np
import pytest

from bytelane.llm import decontam


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = []
    for item, text in items:
        w = words(text)
        n = min(len(w), 13)
        windows += [(item, tuple(w[i:i + n])) for i in range(len(w) - n + 1) if n]
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i:i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(item)
        out.append((doc, len(w), len(hit), sorted(str(f) for f in found if f is not None), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(a, b, "s") for a, b in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.contamination(d, b, **kw).collect()
    return sorted([(r["id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in rows], key=str), d, b


def cases(seed):
    rnd = random.Random(seed)
    vocabulary = ["Aa", "b", "été", "d9", "e", "K", "日本"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(rnd.choice([14, 13, 20, 30]))) for i in range(12)] + [(50, "b b d9"), (51, ""), (52, None), (None, text(13)), (7, text(15))]
    docs = [(i, text(rnd.randrange(0, 60)) + " " + rnd.choice(items)[1].__str__().upper() + "; " + text(rnd.randrange(0, 9))) for i in range(60)]
    docs += [(0, None), (0, ""), (None, items[0][1]), (3, "!!! ??"), (4, text(3000) + "\t" + items[1][1]), (4, items[2][1]), (4, items[2][1])]
    return docs, items


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs, items = cases(seed)
        got, d, b = run(spark, docs, items)
        assert got == brute(docs, items)
        kept = decontam.decontaminate(d, b)
        assert kept.columns == d.columns
        clean = [x for x in docs if not brute([x], items)[0][4]]
        assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == sorted((str(x), t or "") for x, t in clean)


def test_single_words_and_long_items_only(spark):
    docs = [(1, "a b a c"), (2, "c"), (3, "x")]
    assert run(spark, docs, [(1, "a"), (2, "C")])[0] == brute(docs, [(1, "a"), (2, "C")])


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")])[0] == []
    assert run(spark, [(1, "a b")], [])[0] == [(1, 2, 0, [], False)]


def test_benchmark_in_blocks_gives_the_same(spark, monkeypatch):
    docs, items = cases(4)
    docs = docs[:30]
    monkeypatch.setattr(decontam, "TEST_BYTES", 300)
    got, d, b = run(spark, docs, items)
    assert decontam.block_count(b) > 3
    assert got == brute(docs, items)
    clean = [x for x in docs if not brute([x], items)[0][4]]
    clashing = d.withColumn("row", d["text"]).withColumn("doc", d["doc_id"])
    kept = decontam.decontaminate(clashing, b)
    assert kept.columns == clashing.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == sorted((str(x), t or "") for x, t in clean)


@pytest.mark.parametrize("n", [254, 255, 256])
def test_vocabularies_that_fill_the_digits(spark, n):
    ordered = [f"w{i}" for i in range(n)]
    test = decontam.build_tests([0], [" ".join(ordered)])
    # the word with the largest number, alone in a window and in a one-word item
    last = next(w for w in ordered if decontam.word_numbers(*one_word(w), test)[0] == n)
    items = [(0, " ".join(ordered)), (1, " ".join([last] * 13)), (2, last)]
    docs = [(1, " ".join([last] * 20)), (2, f"x {last} y"), (3, " ".join([last] * 12 + ["x"])), (4, " ".join(ordered[5:30]))]
    assert run(spark, docs, items)[0] == brute(docs, items)
    assert run(spark, docs, items[:2])[0] == brute(docs, items[:2])


def one_word(w):
    raw = np.frombuffer(w.encode(), np.uint8)
    return raw, np.array([0]), np.array([len(raw)])


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def hard_cases(seed):
    docs, items = cases(seed)
    items = items + [(70, items[0][1]), (71, items[3][1] + " " + items[4][1])]  # repeated and overlapping passages
    docs = [d for d in docs if len(d[1] or "") < 2000][:40] + [(200, items[-1][1]), (201, "b " * 40)]
    return docs, items


def test_maximal_matches(spark):
    for seed in (5, 6):
        docs, items = hard_cases(seed)
        want = []
        for d, t in docs:
            w = words(t)
            for item, x in items:
                v = words(x)
                for i in range(len(v)):
                    for j in range(len(w)):
                        if i and j and v[i - 1] == w[j - 1]:
                            continue
                        n = common(v[i:], w[j:])
                        if n >= 13 or 0 < n == len(v):
                            want.append((d, None if item is None else str(item), i, j, n))
        _, df, b = run(spark, docs, items)
        got = [tuple(r) for r in decontam.matches(df, b).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_longest_match_of_every_suffix(spark, monkeypatch):
    for seed, size in ((5, 1 << 20), (6, 400)):
        monkeypatch.setattr(decontam, "TEST_BYTES", size)
        docs, items = hard_cases(seed)
        bags = [(d, words(t)) for d, t in docs]
        want = []
        for item, x in items:
            v = words(x)
            for i in range(len(v)):
                n = max(common(v[i:], w[j:]) for _, w in bags for j in range(len(w)))
                if n:
                    want.append((None if item is None else str(item), i, n))
        _, df, b = run(spark, docs, items)
        rows = decontam.longest_matches(df, b).collect()
        assert sorted(((r["item"], r["item_place"], r["length"]) for r in rows), key=str) == sorted(want, key=str)
        texts = [(d, w) for d, w in bags]
        by_item = {}
        for item, x in items:
            by_item.setdefault(None if item is None else str(item), []).append(words(x))
        for r in rows:
            n, p = r["length"], r["place"]
            assert any(d == r["id"] and any(v[r["item_place"]:r["item_place"] + n] == w[p:p + n] and len(w) >= p + n for v in by_item[r["item"]]) for d, w in texts)
    assert decontam.longest_matches(df, b.where("false")).collect() == [] == decontam.matches(df, b.where("false")).collect()
