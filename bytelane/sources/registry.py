"""Extension surface: named source builders and user-defined sample sources (U-1, U-2, U-7).

* `register` / `retrieve`: builders `(spark, **options) -> DataFrame` by id;
  an unknown id is a KeyError, as in the reference's registries.
* `SampleSource`: a Python data source around a user function
  `get_sample(index) -> tuple`, the counterpart of a map-style dataset.
  Index ranges are planned as input partitions, so samples are produced in
  parallel on the executors; the user function stays a small per-row helper.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_BUILDERS: dict[str, Callable[..., DataFrame]] = {}
_MASKED: dict[str, Callable[..., DataFrame]] = {}
_WITHOUT_TEST: set[str] = set()


def register(name: str, builder: Callable[..., DataFrame], *, masked: bool = False, supports_test: bool = True) -> None:
    """Add a builder; masked sources have names of their own.

    `supports_test` tells whether the test split has all that a sample needs (U-7).
    """
    (_MASKED if masked else _BUILDERS)[name] = builder
    (_WITHOUT_TEST.discard if supports_test else _WITHOUT_TEST.add)(name)


def retrieve(name: str, *, masked: bool = False) -> Callable[..., DataFrame]:
    found = (_MASKED if masked else _BUILDERS).get(name)
    if found is None:
        raise KeyError(f"no {'masked ' if masked else ''}source registered under {name!r}")
    return found


def registered(*, masked: bool = False) -> list[str]:
    return sorted(_MASKED if masked else _BUILDERS)


def supports_test(name: str) -> bool:
    """U-7: whether the source can be used for a test run."""
    if name not in _BUILDERS and name not in _MASKED:
        raise KeyError(f"no source registered under {name!r}")
    return name not in _WITHOUT_TEST


def _books(spark: SparkSession, root: str, split: str = "train", **kw) -> DataFrame:
    from bytelane.sources.corpus import corpus_from_files

    return corpus_from_files(spark, root, split, family="books", **kw)


def _questions(spark: SparkSession, path: str, **kw) -> DataFrame:
    from bytelane.operators.qa import read_questions

    return read_questions(spark, path, **kw)


def _masked_books(
    spark: SparkSession, root: str, split: str = "train", *, seq_len: int, workers: int = 1, worker: int | None = None,
    epoch: int = 0, seed: int = 0, include_tail: bool = False, hash_mode: str = "xxhash64", **options
) -> DataFrame:
    """IO-2: windows of a split's books with masked ids, mask and labels."""
    from bytelane.operators.windows import byte_windows, masked_sample
    from bytelane.sources.corpus import corpus_from_files, masked_corpus_options

    opts = masked_corpus_options(**options)
    docs = corpus_from_files(spark, root, split, family="books")
    w, _ = byte_windows(docs, seq_len, workers=workers, worker=worker, offset=epoch, include_tail=include_tail)
    return masked_sample(w, seq_len, seed=seed, epoch=epoch, hash_mode=hash_mode, **opts)


register("books", _books)
register("questions", _questions, supports_test=False)  # the test split has no answers
register("masked_books", _masked_books, masked=True)


# ---------------------------------------------------------------------------
class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _SampleReader(DataSourceReader):
    def __init__(self, fn: Callable[[int], tuple], n: int, parts: int):
        self.fn, self.n, self.parts = fn, n, parts

    def partitions(self):
        step = -(-self.n // self.parts) if self.n else 1
        return [_Range(s, min(s + step, self.n)) for s in range(0, self.n, step)]

    def read(self, partition: _Range):
        for i in range(partition.start, partition.end):
            yield (i, *self.fn(i))


def sample_source(name: str, get_sample: Callable[[int], tuple], num_items: int, schema: str, partitions: int = 8) -> type:
    """Build a data source class serving `(idx, *get_sample(idx))` for idx in [0, num_items).

    `schema` describes the sample fields (without `idx`). Register the result
    with `spark.dataSource.register(cls)` and read it with
    `spark.read.format(name).load()`.
    """

    class SampleSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return f"idx BIGINT, {schema}"

        def reader(self, schema: Any) -> DataSourceReader:
            parts = int(self.options.get("partitions", partitions))
            return _SampleReader(get_sample, num_items, max(parts, 1))

    return SampleSource
