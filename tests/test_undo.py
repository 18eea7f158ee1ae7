import random

import pandas as pd
import pytest

from bytelane.sources import logs
from bytelane.streaming import runner as RN
from bytelane.streaming import undo as U


def operations(seed, writers=5, n=60, close=True):
    rnd, out, left = random.Random(seed), [], []
    for w in range(writers):
        stack = []
        for seq in range(n):
            op = "undo" if rnd.random() < 0.35 else "put"
            out.append((w, seq, op, f"{w}/{seq}" if op == "put" else None))
            if op == "put":
                stack.append((w, seq, f"{w}/{seq}"))
            elif stack:
                stack.pop()
        if close:
            out.append((w, n, "close", None))
        left += stack
    return out, sorted(left)


def follow(spark, batches, reach):
    path = RN.scratch(spark, "undo-in")
    for rows in batches:
        spark.createDataFrame(rows, U.OPERATIONS).coalesce(1).write.mode("append").parquet(path)
    src = spark.readStream.schema(U.OPERATIONS).option("maxFilesPerTrigger", 1).parquet(path)
    out = RN.run_available(U.live_view(src, reach), "undo-out")
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize(("reach", "batches", "seed"), [(60, 1, 1), (60, 7, 2), (12, 5, 3)])
def test_any_batching_gives_the_rows_of_the_finished_log(spark, reach, batches, seed):
    ops, left = operations(seed)
    rnd = random.Random(seed)
    rnd.shuffle(ops)
    ops += rnd.sample(ops, 40)  # some arrive twice
    cuts = sorted(rnd.sample(range(1, len(ops)), batches - 1))
    got = follow(spark, [ops[a:b] for a, b in zip([0, *cuts], [*cuts, len(ops)], strict=True)], reach)
    assert got == left
    finished = spark.createDataFrame([o for o in set(ops) if o[2] != "close"], U.OPERATIONS)
    assert sorted((r.writer_id, r.seq) for r in logs.jsonl_view(finished).collect()) == [x[:2] for x in left]


def test_rows_leave_once_out_of_reach(spark):
    ops = [(1, i, "put", str(i)) for i in range(10)]
    assert follow(spark, [ops], 3) == [(1, i, str(i)) for i in range(7)]
    more = [(1, 10, "undo", None), (1, 11, "undo", None), (1, 12, "put", "x")]
    assert follow(spark, [ops, more], 3) == [(1, i, str(i)) for i in range(7)]
    assert follow(spark, [ops, more, [(1, 13, "close", None)]], 3) == [(1, i, str(i)) for i in range(8)] + [(1, 12, "x")]


def test_an_undo_beyond_reach_is_an_error(spark):
    ops = [(1, i, "put", str(i)) for i in range(5)] + [(1, 5 + i, "undo", None) for i in range(3)]
    assert follow(spark, [ops], 3) == []
    with pytest.raises(Exception, match="has left"):
        follow(spark, [ops[:5], ops[5:]], 2)


def test_an_undo_on_an_empty_log_is_nothing(spark):
    ops = [(1, 0, "undo", None), (1, 1, "put", "a"), (1, 2, "close", None), (1, 3, "put", "late")]
    assert follow(spark, [ops], 1) == [(1, 1, "a")]


def test_a_silent_writer_is_final(spark):
    path = RN.scratch(spark, "undo-ttl")
    spark.createDataFrame([(1, 0, "put", "a"), (1, 1, "put", "b")], U.OPERATIONS).coalesce(1).write.parquet(path)
    src = spark.readStream.schema(U.OPERATIONS).parquet(path)
    out = RN.scratch(spark, "undo-ttl-out")
    q = U.live_view(src, 10, ttl_ms=200).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-c").trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(60):
            q.awaitTermination(1)
            if spark.read.schema(U.OUTPUT).parquet(out).count() == 2:
                break
        assert sorted(r.item for r in spark.read.parquet(out).collect()) == ["a", "b"]
    finally:
        q.stop()


def test_reach_is_checked(spark):
    with pytest.raises(ValueError, match="reach"):
        U.live_view(spark.createDataFrame([], U.OPERATIONS), -1)


class CountedState:
    """A list state that counts the requests it gets."""

    def __init__(self):
        self.rows, self.requests = None, 0

    def getListState(self, name, schema):
        return self

    def exists(self):
        self.requests += 1
        return self.rows is not None

    def get(self):
        self.requests += 1
        return iter(self.rows)

    def put(self, rows):
        self.requests += 1
        self.rows = rows


def test_requests_to_the_state_do_not_grow_with_writers_or_waiting_operations():
    ops, left = operations(4, writers=8, n=200)
    table = pd.DataFrame(ops, columns=["writer_id", "seq", "op", "item"])
    state, log, got = CountedState(), U.UndoLog(200), []
    log.init(state)
    for part in (2, 1, 0):  # all wait until the last third is there
        for pdf in log.handleInputRows((0,), iter([table[table["seq"] % 3 == part]]), None):
            got += [(r.writer_id, r.seq, r.item) for r in pdf.itertuples()]
    assert sorted(got) == left
    assert state.requests <= 3 * 3


def test_writers_far_apart_and_side_by_side(spark):
    ops, left = operations(5, writers=40, n=12)
    far = {w: (w - 20) * (1 if w % 2 else 10**17) for w in range(40)}
    ops, left = [(far[w], *x) for w, *x in ops], sorted((far[w], *x) for w, *x in left)
    ops += [(far[3], None, "put", "no number"), *((None, i, "put", "no writer") for i in range(20))]
    random.Random(5).shuffle(ops)
    assert follow(spark, [ops[:150], ops[150:300], ops[300:]], 12) == left  # no writer without an id, and none lost beside it
