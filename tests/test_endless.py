import random

import pytest

from bytelane.operators import windows as W
from bytelane.streaming import endless as E
from bytelane.streaming import runner as RN
from corpus_helpers import corpus_df


@pytest.mark.parametrize("stretch", [40, 1 << 20])
def test_any_prefix_equals_the_finite_draws(spark, tmp_path, monkeypatch, stretch):
    monkeypatch.setattr(E, "STRETCH", stretch)
    rnd = random.Random(stretch)
    files = [rnd.randbytes(n) for n in (700, 0, 3, 90, 1, 1200)]
    for i, data in enumerate(files):
        (tmp_path / f"{i}.bin").write_bytes(data)
    store = E.WindowStore(spark, str(tmp_path), "*.bin")
    assert store.total == sum(map(len, files))
    out, checkpoint = RN.scratch(spark, "endless"), RN.scratch(spark, "endless-c")
    whole = b"".join(files)
    for runs in (1, 2, 3):
        q = E.endless_windows(store, spark, out, checkpoint, 64, seed=3, draws_per_batch=20, trigger={"availableNow": True})
        q.awaitTermination()
        got = sorted((r.draw, r.start, bytes(r.tokens)) for r in spark.read.parquet(out).collect())
        want = W.random_windows(corpus_df(spark, files), 64, 20 * runs, seed=3).collect()
        assert got == sorted((r.draw, r.start, bytes(r.tokens)) for r in want)
        assert all(t == whole[s:s + 64] for _, s, t in got)


def test_a_corpus_shorter_than_a_window(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"abc")
    store = E.WindowStore(spark, str(tmp_path))
    with pytest.raises(ValueError, match="shorter"):
        store.draws(spark.range(1).toDF("draw"), 3, 0)
