import math
import random

import numpy as np
import pytest

from bytelane.llm import pigeonhole

SCHEMA = "vec_id long, embedding array<float>, label int, cid long, copies long, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, 1, 2, "x") for i, v, l in rows], SCHEMA).repartition(3)


def brute(rows, threshold=0.93):
    ok = [v is not None and l is not None and all(c is not None and math.isfinite(c) for c in v) and any(c for c in v) for _, v, l in rows]
    x = [np.array(v, np.float32).astype(float) if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    n = len(rows)
    near = [[] for _ in rows]
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]):
                a, b = x[i] / np.abs(x[i]).max(), x[j] / np.abs(x[j]).max()
                if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= threshold:
                    near[i].append(j)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), c, rows[i][0] == c))
    return sorted(out, key=str)


def answer(spark, rows, **more):
    return sorted([tuple(r) for r in pigeonhole.near_duplicates(frame(spark, rows), **more).collect()], key=str)


def clustered(seed, n=300, d=24, clusters=8, spread=0.07):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(clusters, d))
    rows = []
    for i in range(n):
        c = int(rnd.integers(clusters)) if rnd.random() < 0.6 else None
        v = centres[c] + spread * rnd.normal(size=d) * 2.5 if c is not None else rnd.normal(size=d)
        rows.append((i, v.astype(np.float32).tolist(), 0 if rnd.random() < 0.5 else int(rnd.integers(4))))
    return rows


def odd_rows():
    v = [1.0, 2.0, 3.0]
    return [(1000, None, 1), (1001, [0.0, 0.0], 1), (1002, [1.0, None], 1), (1003, [float("nan"), 1.0], 1), (1004, [float("inf"), 1.0], 1), (1005, v, None),
            (1006, v, None), (1007, v, 9), (1008, [2.0, 4.0, 6.0], 9), (1008, v, 9), (None, v, 9), (None, [0.0, 1.0], 9), (None, [0.0, 2.0], 9), (1009, [], 9),
            (1010, [1e-30, 0.0], 8), (1011, [1e30, 0.0], 8), (1012, [1e-30, -0.0], 8), (1013, [1.0], 8), (1014, [2.0], 8), (1015, [-2.0], 8)]


@pytest.mark.parametrize(("piece", "sample"), [(4096, 20_000), (20, 20_000), (20, 100)])
def test_against_brute_force(spark, monkeypatch, piece, sample):
    monkeypatch.setattr(pigeonhole, "PIECE", piece)
    monkeypatch.setattr(pigeonhole, "SAMPLE", sample)
    monkeypatch.setattr(pigeonhole, "PAIRS", 50)
    rows = clustered(3) + odd_rows()
    rows += [(2000 + i, rows[0][1], rows[0][2]) for i in range(30)]  # exact copies
    assert answer(spark, rows) == brute(rows)


def test_other_thresholds_and_a_chain(spark):
    rows = [(i, [math.cos(i / 8), math.sin(i / 8)], 1) for i in range(20)]
    assert answer(spark, rows) == brute(rows)
    assert answer(spark, rows, threshold=0.99) == brute(rows, 0.99)


def test_empty_table(spark):
    assert answer(spark, []) == []


def test_rotation_keeps_distances():
    x = np.random.default_rng(1).normal(size=(20, 13))
    y = pigeonhole.rotated(x)
    assert y.shape == (20, 16)
    assert np.allclose(x @ x.T, y @ y.T)
    assert (pigeonhole.rotated(x[3:4]) == y[3:4]).all()


def test_every_visit_within_the_share_is_made():
    rnd = np.random.default_rng(2)
    points, leaves = rnd.normal(size=(400, 8)), []
    tree = pigeonhole.Node.grow(points, 1000.0, leaves)
    assert len(leaves) > 20
    share, home, visits = 3.0, {}, set()
    for leaf, rows, at_home in tree.visit(points, np.arange(400), np.zeros_like(points), np.ones(400, bool), share):
        visits |= {(leaf.number, r) for r in rows.tolist()}
        for r in rows[at_home].tolist():
            assert home.setdefault(r, leaf.number) == leaf.number
    assert len(home) == 400 and len(visits) < 400 * len(leaves)
    apart = ((points[:, None] - points) ** 2).sum(axis=2)
    assert all((home[i], j) in visits for i, j in zip(*np.nonzero(apart <= share), strict=True))


def test_groups_stay_small_in_a_crowded_cluster(spark, monkeypatch):
    monkeypatch.setattr(pigeonhole, "PIECE", 50)
    rnd = np.random.default_rng(5)
    rows = [(i, (np.ones(16) + 0.01 * rnd.normal(size=16)).tolist(), 1) for i in range(800)]
    groups = pigeonhole.classes(frame(spark, rows), "vec_id", "embedding", "label")
    p = pigeonhole.placed(groups, pigeonhole.layout(groups, 0.93), 0.93)
    sizes = [r["count"] for r in p.groupBy("label", "size", "block", "leaf", "p", "q").count().collect()]
    assert max(sizes) < 4 * 2 * 50
    assert {r[1] for r in answer(spark, rows)} == {799}
