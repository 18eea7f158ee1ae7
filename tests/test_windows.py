import random

import pytest
from pyspark.sql import functions as F

from bytelane.operators import windows as W
from corpus_helpers import corpus_df, ref_windows


def split_random(data: bytes, n_docs: int, seed: int):
    rnd = random.Random(seed)
    cuts = sorted(rnd.randint(0, len(data)) for _ in range(n_docs - 1))
    parts, prev = [], 0
    for c in cuts + [len(data)]:
        parts.append(data[prev:c])  # empty documents included
        prev = c
    return parts


def spark_windows(spark, parts, L, workers, worker=None, offset=0, tail=False):
    w, spec = W.byte_windows(corpus_df(spark, parts), L, workers=workers, worker=worker, offset=offset, include_tail=tail)
    rows = w.select("worker", "idx", "tokens").collect()
    got = {}
    for r in rows:
        got.setdefault(r.worker, {})[r.idx] = bytes(r.tokens)
    return got, spec


def test_sequence_windows_one_worker(spark):
    data = bytes(range(14))
    got, spec = spark_windows(spark, [data[:5], data[5:9], data[9:]], 3, 1)
    assert spec.count == 4
    assert [got[0][i] for i in sorted(got[0])] == [bytes([0, 1, 2]), bytes([3, 4, 5]), bytes([6, 7, 8]), bytes([9, 10, 11])]


@pytest.mark.parametrize("L,end", [(4, 33), (8, 55), (7, 42), (5, 21), (5, 20)])
def test_two_workers_all_offsets(spark, L, end):
    data = bytes(range(end))
    parts = split_random(data, 5, end)
    for off in (0, 1, L - 1, L + 2):
        got, _ = spark_windows(spark, parts, L, 2, offset=off)
        for w in (0, 1):
            exp = ref_windows(data, L, 2, w, off)
            assert [got.get(w, {})[i] for i in range(len(exp))] == exp
            assert len(got.get(w, {})) == len(exp)
    got, _ = spark_windows(spark, parts, L, 2, worker=1, offset=1)
    assert set(got) <= {1}


def test_each_element_first_exactly_twice_over_two_cycles(spark):
    # offset cycling: over L epochs every position is the first of a window as often as the reference allows
    data = bytes(range(13))
    L = 6
    firsts = []
    for epoch in range(2 * L):
        got, _ = spark_windows(spark, [data], L, 1, offset=epoch)
        firsts += [got[0][i][0] for i in sorted(got.get(0, {}))]
    exp = []
    for epoch in range(2 * L):
        exp += [w[0] for w in ref_windows(data, L, 1, 0, epoch)]
    assert sorted(firsts) == sorted(exp)


def test_tail_window_and_partition_invariance(spark):
    rnd = random.Random(3)
    data = bytes(rnd.randrange(256) for _ in range(3000))
    parts = split_random(data, 40, 9)
    expected = None
    for n in (1, 4, 17):
        df = corpus_df(spark, parts).repartition(n)
        w, _ = W.byte_windows(df, 97, workers=3, offset=5, include_tail=True)
        got = sorted((r.worker, r.idx, bytes(r.tokens)) for r in w.collect())
        exp = sorted((wk, i, t) for wk in range(3) for i, t in enumerate(ref_windows(data, 97, 3, wk, 5, tail=True)))
        assert got == exp
        expected = expected or got
        assert got == expected


def test_windows_reconcatenate_to_corpus_prefix(spark):
    data = ("héllo wörld 日本 🥰 " * 50).encode()
    parts = split_random(data, 7, 1)
    w, spec = W.byte_windows(corpus_df(spark, parts), 64)
    joined = b"".join(bytes(r.tokens) for r in w.orderBy("idx").collect())
    assert joined == data[: spec.count * 64]


def test_argument_checks(spark):
    with pytest.raises(ValueError):
        W.shard_spec(10, 3, workers=0)
    with pytest.raises(ValueError, match="smaller than one window"):
        W.shard_spec(10, 6, workers=2)
    with pytest.raises(ValueError):
        W.byte_windows(corpus_df(spark, [bytes(range(20))]), 3, workers=2, worker=2)


def test_item_mode_shards(spark):
    df = spark.range(21).select(F.col("id").alias("k"))
    one = W.row_shards(df, "k", workers=1).orderBy("k").collect()
    assert [r.item for r in one] == list(range(21))
    two = W.row_shards(df, "k", workers=2).orderBy("k").collect()
    assert [(r.worker, r.item) for r in two] == [(i // 10, i % 10) for i in range(20)]


def test_offsets_match_running_sum(spark):
    parts = [b"a" * n for n in (0, 3, 5, 0, 7, 1)]
    offs, tot = W.corpus_offsets(corpus_df(spark, parts))
    got = [(r.doc_id, r.start) for r in offs.orderBy("doc_id").collect()]
    starts, acc = [], 0
    for i, p in enumerate(parts):
        starts.append((i, acc))
        acc += len(p)
    assert got == starts and tot.total == acc and tot.rows == len(parts)


def test_masked_samples(spark):
    data = bytes(range(256)) * 40
    w, spec = W.byte_windows(corpus_df(spark, [data[:5000], data[5000:]]), 1000, include_tail=True)
    m = W.masked_sample(w, 1000, mask_token_id=-100, pad_token_id=-101, masking_proba=0.15, seed=1, epoch=0)
    rows = m.orderBy("idx").collect()
    assert all(len(r.masked_ids) == 1000 and len(r.mask) == 1000 and len(r.labels) == 1000 for r in rows)
    tail = rows[-1]
    n_real = len(data) - spec.count * 1000
    assert tail.labels[n_real:] == [-101] * (1000 - n_real)
    assert not any(tail.mask[n_real:])  # padding is never masked
    for r in rows:
        for t, m_, l in zip(r.masked_ids, r.mask, r.labels):
            assert (t == -100) == m_ or (l == -101)
    masked = sum(sum(r.mask) for r in rows)
    total = len(data)
    p = 0.15
    assert abs(masked - p * total) < 4 * (total * p * (1 - p)) ** 0.5
    # a new epoch draws a new mask; the same epoch reproduces it
    again = W.masked_sample(w, 1000, seed=1, epoch=0).orderBy("idx").collect()
    other = W.masked_sample(w, 1000, seed=1, epoch=1).orderBy("idx").collect()
    assert [r.mask for r in again] == [r.mask for r in rows]
    assert [r.mask for r in other] != [r.mask for r in rows]
    with pytest.raises(ValueError):
        W.masked_sample(w, 1000, mask_token_id=5, pad_token_id=5)


def test_mlm_targets(spark):
    df = spark.createDataFrame([([5, 6, 7], [True, False, True])], "labels ARRAY<INT>, mask ARRAY<BOOLEAN>")
    assert df.select(W.mlm_targets("labels", "mask", -100).alias("t")).first().t == [5, -100, 7]


def test_random_windows(spark):
    rnd = random.Random(5)
    data = bytes(rnd.randrange(256) for _ in range(2000))
    parts = split_random(data, 9, 2)
    r = W.random_windows(corpus_df(spark, parts), 50, 200, seed=3).collect()
    assert len(r) == 200
    for row in r:
        assert 0 <= row.start <= len(data) - 50 - 1
        assert bytes(row.tokens) == data[row.start: row.start + 50]


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_prefix_sum_with_repeated_keys(spark, buckets):
    from bytelane.operators.offsets import prefix_sum

    rnd = random.Random(buckets)
    # one key holds a third of the rows; ties are ordered by the tie-break column
    rows = [(0 if i % 3 == 0 else rnd.randrange(1, 50), i, rnd.randrange(0, 100)) for i in range(300)]
    df = spark.createDataFrame(rows, "k BIGINT, tb BIGINT, v BIGINT")
    out, tot = prefix_sum(df, "k", "v", "start", tiebreak=["tb"], buckets=buckets)
    got = {(r.k, r.tb): r.start for r in out.collect()}
    acc, exp = 0, {}
    for k, tb, v in sorted(rows):
        exp[(k, tb)] = acc
        acc += v
    assert got == exp and tot.total == acc and tot.rows == 300


def test_hot_key_is_split_over_buckets(spark):
    from pyspark.sql import functions as F

    from bytelane.operators.offsets import _tuple_bucket_of, tuple_bounds

    rows = [(0 if i % 3 == 0 else i, i) for i in range(3000)]  # key 0 holds a third of the rows
    df = spark.createDataFrame(rows, "k BIGINT, tb BIGINT")
    bounds = tuple_bounds(df, ["k", "tb"], 8)
    b = df.withColumn("_b", _tuple_bucket_of(["k", "tb"], [df.schema["k"].dataType, df.schema["tb"].dataType], bounds))
    hot = b.where(F.col("k") == 0).select("_b").distinct().count()
    sizes = [r["count"] for r in b.groupBy("_b").count().collect()]
    assert hot >= 2 and max(sizes) < 0.4 * len(rows)


def test_random_starts_reach_any_corpus_size(spark):
    from bytelane.functions.hashing import uniform, uniform_int

    for mode in ("md5", "xxhash64"):
        r = spark.range(20_000).select(uniform_int(F.lit(1), F.col("id"), upper=10**14, mode=mode).alias("s"), uniform(F.col("id"), mode=mode).alias("u"))
        top = r.agg(F.max("s").alias("s"), F.max("u").alias("u"), F.min("u").alias("v")).first()
        assert top.s > 9.9 * 10**13 and 0.999 < top.u < 1 and 0 <= top.v < 0.001


def test_duplicate_document_ids_are_refused(spark):
    docs = spark.createDataFrame([(1, "a", b"x" * 50), (1, "b", b"y" * 50)], "doc_id LONG, name STRING, content BINARY")
    with pytest.raises(ValueError, match="unique"):
        W.byte_windows(docs, 10)


def test_masking_holds_a_bounded_number_of_positions():
    """However many windows an Arrow batch has, only `MASK_POSITIONS` positions are masked at a time."""
    import pyarrow as pa
    from pyspark.sql import types as T

    class Windows:
        schema = T.StructType([T.StructField("worker", T.IntegerType()), T.StructField("idx", T.LongType()), T.StructField("tokens", T.BinaryType())])
        columns = schema.names

        def mapInArrow(self, run, schema):
            return run

    run = W.masked_sample(Windows(), 2048, seed=1)
    batch = pa.record_batch({"worker": pa.array([0] * 1500, pa.int32()), "idx": pa.array(range(1500)), "tokens": pa.array([bytes(2048)] * 1499 + [b"x"])})
    got = list(run([batch]))
    assert max(b.num_rows for b in got) * 2048 <= W.MASK_POSITIONS
    one_by_one = [r for i in range(0, 1500, 500) for b in run([batch.slice(i, 1)]) for r in b.to_pylist()]
    rows = [r for b in got for r in b.to_pylist()[:1] if r["idx"] % 500 == 0]
    assert [i for b in got for i in b.column("idx").to_pylist()] == list(range(1500))
    assert all(r in one_by_one for r in rows)
