"""Custom sources with pushed filters, sequences and streams (U-1).

* `item_source`: samples by number, `get_sample(idx) -> tuple`. A filter on
  `idx` narrows the numbers that are planned at all; read as a stream, the
  source serves the numbers that have become available.
* `sequence_source`: samples that only come one after another,
  `open_shard(shard, start) -> iterator of tuples`, a shard being one sequence
  (a file, a partition of a queue). Shards are read side by side.

A stream's offsets say how much of each shard is done. They come from
`available`, which must never fall, and go into the query's checkpoint with
every batch; a restarted query plans the very same batch again, so nothing is
lost, and with a sink that knows its batches nothing is repeated. The user's
functions run on executors and stay small per-row helpers; `available` runs on
the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan,
    LessThanOrEqual)

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Part(InputPartition):
    """Samples `start` to `end` of a shard, or the numbers in `only`."""

    def __init__(self, shard: str, start: int, end: int, only: tuple[int, ...] | None = None):
        self.shard, self.start, self.end, self.only = shard, start, end, only


def cut(start: int, end: int, parts: int, shard: str = "") -> list[Part]:
    """At most `parts` ranges of nearly equal size."""
    step = max(1, -(-(end - start) // max(parts, 1)))
    return [Part(shard, s, min(s + step, end)) for s in range(start, end, step)]


class ItemReader(DataSourceReader):
    def __init__(self, get_sample: Callable[[int], tuple], n: int, parts: int):
        self.get_sample, self.start, self.end, self.parts = get_sample, 0, n, parts
        self.only: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of `idx` with numbers; all other filters are left to Spark."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("idx",) or not (isinstance(f, (IsNotNull, In)) or isinstance(value, int)):
                yield f
            elif isinstance(f, IsNotNull):
                pass  # a number is never null
            elif isinstance(f, EqualTo):
                self._at_least(value)
                self._below(value + 1)
            elif isinstance(f, GreaterThan):
                self._at_least(value + 1)
            elif isinstance(f, GreaterThanOrEqual):
                self._at_least(value)
            elif isinstance(f, LessThan):
                self._below(value)
            elif isinstance(f, LessThanOrEqual):
                self._below(value + 1)
            elif isinstance(f, In):
                asked = {v for v in f.value if v is not None}
                self.only = asked if self.only is None else self.only & asked
            else:
                yield f

    def _at_least(self, value: int) -> None:
        self.start = max(self.start, value)

    def _below(self, value: int) -> None:
        self.end = min(self.end, value)

    def partitions(self) -> list[Part]:
        if self.only is None:
            found = cut(self.start, self.end, self.parts)
        else:
            ids = sorted(i for i in self.only if self.start <= i < self.end)
            found = [Part("", 0, 0, tuple(ids[p.start:p.end])) for p in cut(0, len(ids), self.parts)]
        return found or [Part("", 0, 0)]  # Spark wants one partition at least

    def read(self, partition: Part) -> Iterator[tuple]:
        for i in range(partition.start, partition.end) if partition.only is None else partition.only:
            yield (i, *self.get_sample(i))


class StreamReader(DataSourceStreamReader):
    """Batches of what has become available in each shard."""

    def __init__(self, available: Callable[[], dict[str, int]], serve: Callable[[str, int, int], Iterator[tuple]], parts: int):
        self.available, self.serve, self.parts = available, serve, parts

    def initialOffset(self) -> dict:
        return {"done": {}}

    def latestOffset(self) -> dict:
        return {"done": dict(self.available())}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        found = []
        for shard, upto in sorted(end["done"].items()):
            done = start["done"].get(shard, 0)
            if upto < done:
                raise ValueError(f"{upto} samples of {shard!r} are available, {done} have been read")
            found += cut(done, upto, self.parts, shard) if self.parts else [Part(shard, done, upto)] * (upto > done)
        return found

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.serve(partition.shard, partition.start, partition.end)

    def commit(self, end: dict) -> None:
        """Nothing is held for batches that are done."""


def item_source(name: str, get_sample: Callable[[int], tuple], available: Callable[[], int], schema: str, partitions: int = 8) -> type[DataSource]:
    """A data source of `(idx, *get_sample(idx))` rows for the `available()` numbers; `schema` names the sample's fields."""

    def serve(_: str, start: int, end: int) -> Iterator[tuple]:
        return ((i, *get_sample(i)) for i in range(start, end))

    class ItemSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return f"idx BIGINT, {schema}"

        def reader(self, schema) -> DataSourceReader:
            return ItemReader(get_sample, available(), max(int(self.options.get("partitions", partitions)), 1))

        def streamReader(self, schema) -> DataSourceStreamReader:
            return StreamReader(lambda: {"": available()}, serve, max(int(self.options.get("partitions", partitions)), 1))

    return ItemSource


class SequenceReader(DataSourceReader):
    def __init__(self, shards: list[str], open_shard: Callable[[str, int], Iterator[tuple]]):
        self.shards, self.open_shard = shards, open_shard

    def partitions(self) -> list[Part]:
        return [Part(s, 0, -1) for s in self.shards] or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.end:
            for i, sample in enumerate(self.open_shard(partition.shard, 0)):
                yield (partition.shard, i, *sample)


def sequence_source(
    name: str, shards: Callable[[], list[str]], open_shard: Callable[[str, int], Iterator[tuple]], schema: str,
    available: Callable[[], dict[str, int]] | None = None,
) -> type[DataSource]:
    """A data source of `(shard, position, *sample)` rows, each shard read in its order by one task.

    A stream needs `available`: the samples that each shard holds by now.
    """

    def serve(shard: str, start: int, end: int) -> Iterator[tuple]:
        at = start
        for sample in islice(open_shard(shard, start), end - start):
            yield (shard, at, *sample)
            at += 1
        if at < end:
            raise ValueError(f"shard {shard!r} ended at {at}, before {end}")

    class SequenceSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return f"shard STRING, position BIGINT, {schema}"

        def reader(self, schema) -> DataSourceReader:
            return SequenceReader(shards(), open_shard)

        def streamReader(self, schema) -> DataSourceStreamReader:
            if available is None:
                raise ValueError(f"{name} cannot be streamed: it does not say what is available")
            return StreamReader(available, serve, 0)

    return SequenceSource


def load(spark: SparkSession, source: type[DataSource], **options) -> DataFrame:
    """The source's samples; filters on `idx` reach it."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**options).load()


def stream(spark: SparkSession, source: type[DataSource], **options) -> DataFrame:
    """The source's samples as a stream."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(source)
    return spark.readStream.format(source.name()).options(**options).load()
