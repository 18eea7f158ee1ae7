import random

import pytest

from bytelane.operators import dictionary as D
from bytelane.operators import params as PM


def coded(rows, start):
    values = sorted({v for _, v in rows if v is not None})
    codes = {v: start + i for i, v in enumerate(values)}
    return sorted(((k, v, codes.get(v)) for k, v in rows), key=str)


@pytest.mark.parametrize("kind", ["long", "string", "double"])
def test_codes_are_dense_and_turn_back(spark, kind):
    rnd = random.Random(kind)
    make = {"long": lambda: rnd.randrange(-500, 500), "string": lambda: f"v{rnd.randrange(700)}é", "double": lambda: rnd.randrange(900) / 7}[kind]
    heavy = make()
    rows = [(i, heavy if i % 3 == 0 else None if i % 50 == 1 else make()) for i in range(4000)]
    df = spark.createDataFrame([(k, v, "x") for k, v in rows], f"k long, v {kind}, code2 string").repartition(5)
    d = D.dense_dictionary(df, "v", 11)
    got = D.encode(df, "v", d)
    assert got.columns == ["k", "v", "code2", "code"]
    assert sorted(((r.k, r.v, r.code) for r in got.collect()), key=str) == coded(rows, 11)
    back = D.decode(got.select("k", "code"), "code", d, "w").collect()
    assert sorted(((r.k, r.w) for r in back), key=str) == sorted(rows, key=str)


def test_values_that_the_dictionary_lacks(spark):
    d = D.dense_dictionary(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), "v")
    df = spark.createDataFrame([(1, "b"), (2, "c"), (3, None)], "k long, v string")
    assert sorted((r.k, r.code) for r in D.encode(df, "v", d).collect() if r.code is not None) == [(1, 1)]
    assert D.encode(df, "v", d).count() == 3
    assert D.encode(df.limit(0), "v", D.dense_dictionary(df.limit(0), "v")).count() == 0


def test_a_heavy_value_makes_no_hot_task(spark):
    rows = [(i, 7 if i % 3 == 0 else i) for i in range(30_000)]
    df = spark.createDataFrame(rows, "k long, v long")
    plan = D.encode(df, "v", D.dense_dictionary(df, "v"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    out = D.encode(df, "v", D.dense_dictionary(df, "v"))
    assert out.where("v = 7").select("code").distinct().count() == 1 and out.count() == 30_000


def test_a_mapped_state_tells_what_it_mapped(spark, tmp_path):
    tgt = spark.createDataFrame([(k, r, [float(r), 0.0]) for k in ("a.x", "a.y", "c") for r in range(4)], "key string, row int, vec array<float>")
    src = tgt.where("row < 3").selectExpr("key", "row", "transform(vec, v -> v + 10) as vec")
    state, seen = PM.mapped_state(src, tgt, [("a.", "new.")], ["new.x"])
    said = []
    counts = PM.write_mapped(state, seen, str(tmp_path / "s"), said.append)
    assert counts == {"rows": 12, "renamed": 8, "extended": 3, "kept": 9}
    assert said == ["8 of 12 rows renamed", "3 of 12 rows extended", "9 of 12 rows kept"]
    rows = {(r.key, r.row): r.vec for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    assert rows["new.x", 2] == [12.0, 10.0] and rows["new.x", 3] == [3.0, 0.0] and rows["new.y", 1] == [1.0, 0.0]
    state, seen = PM.mapped_state(src, tgt, [], [])
    assert PM.write_mapped(state, seen, str(tmp_path / "t"), lambda s: None) == {"rows": 12, "renamed": 0, "extended": 0, "kept": 12}
