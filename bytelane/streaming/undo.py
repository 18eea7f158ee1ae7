"""An append log with undo, followed live (IO-11).

`jsonl_view` finds the rows that are left in a finished log. Here the log is a
stream `(writer_id, seq, op, item)`: `put` appends a row, `undo` removes the
writer's last row (none on an empty log), `close` ends the log. `seq` numbers a
writer's operations from 0 without gaps, so they may arrive in any order and
in any batches, also twice; each is applied once, when those before it are in.

A row is handed out when no later undo can reach it: `reach` rows of its
writer stand above it, or the log is closed, or nothing came for `ttl_ms`. The
contract behind this is that undos never remove more than `reach` rows in
excess of those that are put meanwhile; one that would is an error, for the
row it means is gone. State for a writer: the rows within reach, and
operations that wait for earlier ones, in one row of state. A closed writer
keeps its numbers only. A few neighbouring writers share a call and its
requests to the state store, which cost more than the operations of one; with
`ttl_ms` each writer keeps a call, and so a timer, of its own.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OPERATIONS = "writer_id LONG, seq LONG, op STRING, item STRING"
OUTPUT = "writer_id LONG, seq LONG, item STRING"
# of the operations held, the first `present` are rows, oldest first; the others wait
WRITER = "writer_id LONG, next LONG, released LONG, closed BOOLEAN, present INT, seqs ARRAY<LONG>, ops ARRAY<STRING>, items ARRAY<STRING>"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WRITERS_A_CALL = 16


@dataclass
class Log:
    """What is known of one writer."""

    next: int = 0
    released: int = 0
    closed: bool = False
    present: list[tuple] = field(default_factory=list)  # rows that an undo can reach, oldest first
    early: dict[int, tuple] = field(default_factory=dict)  # operations that wait for earlier ones

    def advance(self, writer_id: int, reach: int) -> list[tuple]:
        """Apply what is in order; the rows that are out of reach by now."""
        next_, released, closed, present, early = self.next, self.released, self.closed, self.present, self.early
        out: list[tuple] = []
        while not closed and next_ in early:
            op, item = early.pop(next_)
            if op == "put":
                present.append((next_, item))
            elif op == "undo":
                if present:
                    present.pop()
                elif released:
                    raise ValueError(f"operation {next_} of writer {writer_id} undoes a row that has left: more than {reach} rows back")
            elif op == "close":
                closed = True
            else:
                raise ValueError(f"unknown operation {op!r}")
            next_ += 1
            # nothing below the last `reach` rows can be undone any more
            n = len(present) - (0 if closed else reach)
            if n > reach or closed:
                out, present, released = out + present[:n], present[n:], released + n
        n = max(len(present) - (0 if closed else reach), 0)
        out, present, released = out + present[:n], present[n:], released + n
        self.next, self.released, self.closed, self.present, self.early = next_, released, closed, present, {} if closed else early
        return out


class UndoLog(StatefulProcessor):
    def __init__(self, reach: int, ttl_ms: int | None = None):
        self.reach, self.ttl_ms = reach, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.writers = handle.getListState("writers", WRITER)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        logs = self._logs()
        for pdf in rows:
            for writer, seq, op, item in zip(*(pdf[c].tolist() for c in ("writer_id", "seq", "op", "item")), strict=True):
                log = logs.get(writer)
                if log is None:
                    log = logs[writer] = Log()
                if seq >= log.next and not log.closed:
                    log.early[seq] = (op, item)
        out = [(writer, *row) for writer, log in logs.items() for row in log.advance(writer, self.reach)]
        self._hold(logs)
        if self.ttl_ms is not None and not all(log.closed for log in logs.values()):
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The writer has fallen silent: what it holds is final."""
        logs, out = self._logs(), []
        for writer, log in logs.items():
            out += [(writer, *row) for row in log.present]
            log.released, log.present = log.released + len(log.present), []
        self._hold(logs)
        yield self._rows(out)

    def _logs(self) -> dict[int, Log]:
        logs = {}
        for writer, next_, released, closed, n, seqs, ops, items in self.writers.get() if self.writers.exists() else ():
            early = dict(zip(seqs[n:], zip(ops[n:], items[n:], strict=True), strict=True))
            logs[writer] = Log(next_, released, closed, list(zip(seqs[:n], items[:n], strict=True)), early)
        return logs

    def _hold(self, logs: dict[int, Log]) -> None:
        self.writers.put([(
            writer, log.next, log.released, log.closed, len(log.present), [seq for seq, _ in log.present] + list(log.early),
            ["put"] * len(log.present) + [op for op, _ in log.early.values()],
            [item for _, item in log.present] + [item for _, item in log.early.values()]) for writer, log in logs.items()])

    def _rows(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({
            "writer_id": pd.Series([r[0] for r in rows], dtype="int64"), "seq": pd.Series([r[1] for r in rows], dtype="int64"),
            "item": pd.Series([r[2] for r in rows], dtype="object")})

    def close(self) -> None:
        pass


def live_view(operations: DataFrame, reach: int, ttl_ms: int | None = None) -> DataFrame:
    """The rows of a stream of operations that are left for good, each handed out once.

    State of several kinds needs the RocksDB state store, which is set for the
    session's streams that start from now on.
    """
    if reach < 0:
        raise ValueError("reach counts rows")
    operations.sparkSession.conf.set(STATE_STORE, ROCKSDB)
    # Spark starts the processor in a worker that does not get files sent to the executors
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    neighbours = F.expr(f"writer_id div {WRITERS_A_CALL}") if ttl_ms is None else F.col("writer_id")
    # an operation without a writer or a number has no place in a log, and a null makes its neighbours' keys floats in pandas
    numbered = operations.where(F.col("writer_id").isNotNull() & F.col("seq").isNotNull()).withColumn("neighbours", neighbours)
    return numbered.groupBy("neighbours").transformWithStateInPandas(
        statefulProcessor=UndoLog(reach, ttl_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime" if ttl_ms is not None else "None")
