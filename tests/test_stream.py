import pandas as pd
import pytest
from pyspark.sql import functions as F

from bytelane.streaming import bytestream as BS
from bytelane.streaming import runner as RN


def run_stream(spark, batches, mode="utf8", **kw):
    """Feed token rows as successive files (one micro-batch each) and decode."""
    path = RN.scratch(spark, "t-in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, RN.TOKEN_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    out = RN.run_available(BS.decode_stream(RN.token_stream(spark, path), mode, **kw), "t-out")
    rows = sorted(out.collect(), key=lambda r: (r.stream_id, r.first_seq))
    res = {}
    for r in rows:
        res[r.stream_id] = res.get(r.stream_id, "") + r.text
    return res


def to_rows(sid, data: bytes, start=0, end=False):
    rows = [(sid, start + i, b) for i, b in enumerate(data)]
    if end:
        rows.append((sid, start + len(data), BS.END))
    return rows


def test_emoji_cut_between_batches(spark):
    text = "👉🏽 bytes generated by a 🤖".encode()
    cut = 2  # inside the first emoji
    got = run_stream(spark, [to_rows(1, text[:cut]), to_rows(1, text[cut:], cut, end=True)])
    assert got[1] == text.decode()


@pytest.mark.parametrize(
    "raw,expected",
    [(b"h\xc3\xc9llo world", "h��llo world"), (b"\xe2\xe2\xe2\xe2\x86\x91", "���↑"), ("🤖".encode()[:3], "�")],
)
def test_malformed_and_flush(spark, raw, expected):
    got = run_stream(spark, [to_rows(7, raw[:2]), to_rows(7, raw[2:], 2, end=True)])
    assert got[7] == expected


def test_no_flush_keeps_dangling_bytes(spark):
    got = run_stream(spark, [to_rows(3, b"ab" + "🤖".encode()[:2])])
    assert got[3] == "ab"


def test_int_mode_overflow_and_out_of_order(spark):
    rows = to_rows(5, bytes([1, 2, 3, 4]))
    rows.insert(2, (5, 99, 300))  # overflowing id far ahead: ignored when reached? not reached
    b1 = [r for r in rows if r[1] in (2, 3)]  # later rows first
    b2 = [r for r in rows if r[1] in (0, 1)]
    got = run_stream(spark, [b1, b2], mode="int")
    assert got[5] == "1 2 3 4"
    over = [(6, 0, 65), (6, 1, 256), (6, 2, 66)]
    assert run_stream(spark, [over])[6] == "AB"


def test_stop_token_and_max_tokens(spark):
    rows = to_rows(1, b"ab\ncd\nef")
    assert run_stream(spark, [rows[:3], rows[3:]], eos_token=10)[1] == "ab\n"
    assert run_stream(spark, [rows], max_tokens=4)[1] == "ab\nc"
    df = spark.createDataFrame([([1, 2, 10, 3],)], "a ARRAY<INT>")
    assert df.select(BS.stop_at(F.col("a"), 10).alias("s")).first().s == [1, 2, 10]
    assert df.select(BS.stop_at(F.col("a"), 7, 2).alias("s")).first().s == [1, 2]


def test_raw_bytes_and_overflow_rows(spark):
    df = spark.createDataFrame([(1, 0, 65), (1, 1, 400)], RN.TOKEN_SCHEMA)
    assert [bytes(r.byte) for r in BS.raw_bytes(df).collect()] == [b"A"]
    assert BS.drop_overflow_rows(df).count() == 1


def test_running_top_n(spark):
    path = RN.scratch(spark, "top")
    schema = "run LONG, loss DOUBLE, cum_batch LONG, item STRING"
    for rows in ([(1, 0.5, 1, "a"), (1, 0.7, 2, "b")], [(1, 0.1, 3, "c"), (1, 0.5, 4, "d")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = RN.run_available(BS.running_top_n(src, 2), "top-out", mode="update")
    last = out.where(F.col("batch_id") == out.agg(F.max("batch_id")).first()[0]).orderBy("rank").collect()
    assert [(r.item, r.loss) for r in last] == [("c", 0.1), ("a", 0.5)]


def test_stop_tokens_above_bytes_and_counting(spark):
    rows = [(1, i, t) for i, t in enumerate([65, 300, 66])]
    assert run_stream(spark, [rows], eos_token=300)[1] == "A"
    rows = [(1, i, t) for i, t in enumerate([65, 300, 66, 67])]
    assert run_stream(spark, [rows[:1], rows[1:]], max_tokens=2)[1] == "A"
    assert run_stream(spark, [rows], mode="int", ignore_overflowing=False)[1] == "65 300 66 67"
    assert run_stream(spark, [rows[:2], rows[2:]], mode="int")[1] == "65 66 67"


def test_a_replayed_batch_leaves_its_rows_once(spark):
    out = RN.scratch(spark, "replay")
    sink = RN.batch_sink(out)
    for batch_id, n in ((0, 3), (1, 2), (0, 3)):
        sink(spark.range(n), batch_id)
    assert spark.read.parquet(out).count() == 5


class State:
    """A stand-in for the engine's group state."""

    def __init__(self, timed_out=False, value=None):
        self.hasTimedOut, self.value, self.removed, self.timeout = timed_out, value, False, None
        self.exists = value is not None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def setTimeoutDuration(self, ms):
        self.timeout = ms

    def remove(self):
        self.removed = True


def test_timeouts_flush_gaps_and_remove_finished_state():
    fn = BS.make_processor(ttl_ms=1000)
    state = State()
    rows = pd.DataFrame({"seq": [0, 1, 5], "token": [65, 0xF0, 66]})
    assert [d["text"][0] for d in fn((1,), iter([rows]), state)] == ["A"] and state.timeout == 1000
    late = State(True, state.value)
    out = list(fn((1,), iter([]), late))
    assert out[0]["text"][0] == "�" and bool(out[0]["finished"][0]) and late.removed
    state = State()
    list(BS.make_processor(ttl_ms=1000, max_tokens=1)((1,), iter([rows]), state))
    late = State(True, state.value)
    assert list(fn((1,), iter([]), late)) == [] and late.removed


def test_every_row_is_a_stream_of_its_own(spark, tmp_path):
    from bytelane import catalog as C

    rows = [(0, 1000, "late turn\n"), (1, 0, "next"), (-3, 2400, "é"), (-1, 400, "own"), (2, 3, "x"), (1, 0, "other text"), (1, 0, "other text"), (1, 0, ""),
            (1, None, "no turn"), (None, None, "no conversation"), (None, 3, None), (9_000_000_000_000_000, 9_000_000_000_000_000, "large")]
    spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want = sorted(((c, t, x or "") for c, t, x in rows), key=str)

    def got(q, text):
        return sorted(((r.conv_id, r.turn, text(r)) for r in q(spark, str(tmp_path)).collect()), key=str)

    for q in (C.q_stream_decode, C.q_stream_stop):
        assert got(q, lambda r: r.text) == want
    assert got(C.q_stream_int, lambda r: r.text) == sorted(((c, t, " ".join(map(str, x.encode()))) for c, t, x in want), key=str)
    assert got(C.q_raw_bytes, lambda r: bytes.fromhex(r.hex).decode()) == want


def test_neighbouring_streams_share_a_call():
    """A call takes many streams, keeps each one's state apart, and goes on with them in the next batch."""
    import pandas as pd

    class State:
        held = None
        exists = property(lambda self: self.held is not None)
        get = property(lambda self: self.held)

        def update(self, held):
            self.held = held

    texts = {i: "é€ü"[: 1 + i % 3] * (i + 1) for i in range(40)}
    rows = [(i, n, b) for i, t in texts.items() for n, b in enumerate([*t.encode(), BS.END])]
    fn, state, got = BS.make_processor(grouped=True), State(), {}
    for odd in (1, 0):  # the first batch holds every other row, so that most rows wait
        part = pd.DataFrame([r for r in rows if r[1] % 2 == odd or r[0] % 7 == 0 and not odd], columns=["stream_id", "seq", "token"])
        pieces = [part.iloc[:11], part.iloc[11:]]
        for out in fn((0,), iter(pieces), state):
            for r in out.itertuples():
                got[r.stream_id] = got.get(r.stream_id, "") + r.text
    assert got == texts and all(state.held[4]) and not any(state.held[6])
