import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from bytelane.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x long, copies long, _d string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 5, 6, "x") for i, v in rows], SCHEMA)


def fitted(rows, weight="distinct"):
    xs = [tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for _, v in rows if usable(v)]
    keep = xs if weight == "copies" else sorted(set(xs))
    n, d = len(keep), len(keep[0])
    sums = [sum(x[i] for x in keep) for i in range(d)]
    y = np.array([[x[i] - sums[i] / n for i in range(d)] for x in keep])
    return n, sums, y.T @ y / n


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def some(seed, n=150, d=6):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, 1 + j) for j in range(d)]) for i in range(n)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000, rows[5][1])]
    return rows


@pytest.mark.parametrize("weight", ["distinct", "copies"])
def test_whitened_against_numpy(spark, weight):
    rows = some(1)
    n, sums, v = fitted(rows, weight)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = whitening.component_rows(*whitening.whiten(frame(spark, rows), 4, weight)).collect()
    assert sorted((r.vec_id, r.component) for r in out) == sorted((i, c) for i, _ in rows for c in range(1, 5))
    sign = {}
    by = dict(rows)
    for r in out:
        x = [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in by[r.vec_id]]
        assert r.n == n
        assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        want = float((np.array(x) - np.array(sums) / n) @ vectors[:, r.component - 1] / math.sqrt(values[r.component - 1]))
        sign.setdefault(r.component, 1 if want * r.whitened >= 0 else -1)
        assert r.whitened == pytest.approx(sign[r.component] * want, abs=1e-9)
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(v))
        assert r.identity_error < 1e-9


def test_rows_that_are_dropped_and_lengths_apart(spark):
    rows = [(1, [0.5, 1.0]), (2, [0.25, -1.0]), (3, None), (4, [0.5, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [0.5, 2.0]),
            (1, [0.5, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [])]
    whitened, table = whitening.whiten(frame(spark, rows))
    out = whitening.component_rows(whitened, table).collect()
    assert sorted((str(r.vec_id), r.component, r.n) for r in out) == sorted(
        [(str(i), c, 3) for i in (1, 1, 2, None) for c in (1, 2)] + [("7", c, 1) for c in (1, 2, 3)])
    alone = [r for r in out if r.vec_id == 7]
    assert all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error == 0 for r in alone)
    assert all(r.identity_error < 1e-9 for r in out)


def test_empty_table(spark):
    assert whitening.component_rows(*whitening.whiten(frame(spark, []))).collect() == []


def test_no_variance_in_some_directions(spark):
    rows = [(i, [float(i % 5), float(i % 5), 2.0]) for i in range(20)]
    out = whitening.component_rows(*whitening.whiten(frame(spark, rows))).collect()
    by = {r.component: r for r in out if r.vec_id == 0}
    assert by[1].whitened is not None and by[2].whitened is None and by[3].whitened is None
    assert by[1].n == 5 and by[1].identity_error < 1e-9 and by[1].explained == pytest.approx(1)


def test_packing_by_width_and_large_entries(spark):
    rows = [(1, [1.0, 2.0]), (2, [1e5, 2.0]), (3, [1e9, -1e9]), (4, [3e38, 1.0])]
    df = spark.createDataFrame(rows, T._parse_datatype_string("vec_id long, embedding array<double>"))
    q = {r.id: r.x for r in whitening.quantised(df).collect()}
    assert [len(q[i]) for i in (1, 2, 3, 4)] == [5, 9, 17, 17]
    out = {r.vec_id: r for r in whitening.component_rows(*whitening.whiten(df, 1)).collect()}
    assert out[1].deviation is None and out[1].n == 4


def test_many_copies_are_joined_back(spark):
    rows = [(i, [1.0, 2.0]) for i in range(3000)] + [(3000 + i, [float(i), float(i * i % 7)]) for i in range(50)]
    out = whitening.component_rows(*whitening.whiten(frame(spark, rows), 2)).collect()
    assert len(out) == 2 * len(rows)
    assert {r.n for r in out} == {len({tuple(v) for _, v in rows})}
