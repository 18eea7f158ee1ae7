import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual, StringContains

from bytelane.sources import samples as S
from bytelane.streaming import runner as RN


def numbers(reader):
    return sorted(i for p in reader.partitions() for i, *_ in reader.read(p))


def item(i):
    return (i * 10, f"s{i}")


@pytest.mark.parametrize(("filters", "want"), [
    ([], range(100)),
    ([EqualTo(("idx",), 7)], [7]),
    ([EqualTo(("idx",), 700)], []),
    ([GreaterThan(("idx",), 90), LessThan(("idx",), 93)], [91, 92]),
    ([GreaterThanOrEqual(("idx",), -5), LessThanOrEqual(("idx",), 2)], [0, 1, 2]),
    ([In(("idx",), (5, 3, None, 400)), IsNotNull(("idx",))], [3, 5]),
    ([In(("idx",), (5, 3)), In(("idx",), (5, 8)), GreaterThan(("idx",), 4)], [5]),
])
def test_filters_narrow_what_is_planned(filters, want):
    reader = S.ItemReader(item, 100, 7)
    assert list(reader.pushFilters(filters)) == []
    assert numbers(reader) == list(want)


def test_other_filters_are_left_to_spark():
    reader = S.ItemReader(item, 5, 2)
    others = [EqualTo(("text",), "x"), StringContains(("text",), "1"), GreaterThan(("idx",), 1.5)]
    assert list(reader.pushFilters(others)) == others
    assert numbers(reader) == list(range(5))


def test_only_the_asked_range_is_read(spark, tmp_path):
    log = str(tmp_path)

    def get_sample(i):
        open(f"{log}/{i}", "w").close()
        return (i * i,)

    df = S.load(spark, S.item_source("squares", get_sample, lambda: 1000, "sq BIGINT"), partitions=4)
    got = df.where((F.col("idx") >= 10) & (F.col("idx") < 14)).where("sq <> 121").orderBy("idx").collect()
    assert [(r.idx, r.sq) for r in got] == [(10, 100), (12, 144), (13, 169)]
    assert sorted(int(p.name) for p in tmp_path.iterdir()) == [10, 11, 12, 13]


def drain(df, out, checkpoint):
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def test_a_restarted_stream_repeats_and_loses_nothing(spark, tmp_path):
    there, broken = tmp_path / "n", tmp_path / "broken"

    def available():
        return int(there.read_text())

    def get_sample(i):
        if i == 47 and broken.exists():
            raise OSError("a task is lost")
        return (i * 10, f"s{i}")

    source = S.item_source("growing", get_sample, available, "n BIGINT, text STRING")
    out, checkpoint = RN.scratch(spark, "grow"), RN.scratch(spark, "grow-ckpt")
    there.write_text("30")
    drain(S.stream(spark, source), out, checkpoint)
    there.write_text("70")
    broken.write_text("")
    with pytest.raises(Exception):  # noqa: B017
        drain(S.stream(spark, source), out, checkpoint)
    there.write_text("90")  # the broken batch still ends at 70
    broken.unlink()
    for _ in range(2):
        drain(S.stream(spark, source), out, checkpoint)
    rows = spark.read.parquet(out).orderBy("idx").collect()
    assert [(r.idx, r.n, r.text) for r in rows] == [(i, *item(i)) for i in range(90)]


def test_sequences_keep_their_order_and_resume(spark, tmp_path):
    shards = {"a": 5, "b": 0, "c": 8}

    def open_shard(shard, start):
        return ((f"{shard}{i}",) for i in range(start, 100))

    def finite(shard, start):
        return ((f"{shard}{i}",) for i in range(start, {"a": 5, "b": 0, "c": 8}[shard]))

    source = S.sequence_source("seq", lambda: list(shards), finite, "text STRING")
    rows = S.load(spark, source).collect()
    assert sorted((r.shard, r.position, r.text) for r in rows) == [(s, i, f"{s}{i}") for s, n in shards.items() for i in range(n)]

    counts = tmp_path / "counts"

    def available():
        pairs = (line.split("=") for line in counts.read_text().split())
        return {shard: int(n) for shard, n in pairs}

    live = S.sequence_source("live_seq", lambda: [], open_shard, "text STRING", available)
    out, checkpoint = RN.scratch(spark, "seq"), RN.scratch(spark, "seq-ckpt")
    for text in ("a=3 c=1", "a=3 c=9", "a=4 c=9 d=2"):
        counts.write_text(text)
        drain(S.stream(spark, live), out, checkpoint)
    got = sorted((r.shard, r.position, r.text) for r in spark.read.parquet(out).collect())
    assert got == [(s, i, f"{s}{i}") for s, n in (("a", 4), ("c", 9), ("d", 2)) for i in range(n)]
    with pytest.raises(ValueError, match="have been read"):
        S.StreamReader(lambda: {}, None, 2).partitions({"done": {"a": 5}}, {"done": {"a": 4}})


def test_a_sequence_without_counts_is_not_streamed(spark):
    source = S.sequence_source("mute", lambda: ["a"], lambda s, i: iter([]), "x LONG")
    with pytest.raises(ValueError, match="cannot be streamed"):
        source({}).streamReader(None)
