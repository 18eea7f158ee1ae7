"""Byte streams with Structured Streaming (ST-1 .. ST-6, ST-8).

A stream is a table `(stream_id BIGINT, seq BIGINT, token BIGINT)` that grows
while a model generates. Stateless steps (overflow filter, raw bytes) are
plain column expressions. Decoding needs state per stream: the undecoded
bytes of a character cut by a micro-batch boundary, whether the stream has
started, stopped or been flushed, and rows that arrived before their
predecessors. `applyInPandasWithState` keeps that state in the state store, for
a few neighbouring streams a row, so it survives executor loss and restarts
from the checkpoint. One stream is in one group by nature: its bytes must be
decoded in order.

End of stream: Structured Streaming has no end-of-input event, so a marker
row with token = `END` (-1) flushes a stream (ST-2): a dangling partial
character becomes U+FFFD, as an incremental decoder does at `final=True`.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from bytelane.functions.bytes import int_to_byte

END = -1  # end-of-stream marker token

OUTPUT_SCHEMA = "stream_id LONG, first_seq LONG, text STRING, finished BOOLEAN"
STATE_SCHEMA = (
    "next_seq LONG, pending BINARY, started BOOLEAN, done BOOLEAN, emitted LONG, "
    "buf_seq ARRAY<LONG>, buf_tok ARRAY<LONG>"
)
# the same for several streams, one entry a stream
GROUPED_STATE_SCHEMA = (
    "ids ARRAY<LONG>, next_seq ARRAY<LONG>, pending ARRAY<BINARY>, started ARRAY<BOOLEAN>, done ARRAY<BOOLEAN>, "
    "emitted ARRAY<LONG>, buf_seq ARRAY<ARRAY<LONG>>, buf_tok ARRAY<ARRAY<LONG>>"
)
OUTPUT_COLUMNS = ["stream_id", "first_seq", "text", "finished"]
NEW = (0, b"", False, False, 0, [], [])  # the state of a stream that has no row yet
STREAMS_A_CALL = 64


def drop_overflow_rows(stream: DataFrame, token: str = "token") -> DataFrame:
    """ST-5: ids above 255 are not bytes; drop them (markers stay)."""
    return stream.where(F.col(token) <= 255)


def raw_bytes(stream: DataFrame, token: str = "token") -> DataFrame:
    """ST-4: one raw byte per row, no decoding (a BINARY column for a file sink)."""
    return stream.where((F.col(token) >= 0) & (F.col(token) <= 255)).withColumn("byte", int_to_byte(F.col(token)))


def cut_point(tokens: np.ndarray, emitted: int, eos_token: int | None, max_tokens: int | None) -> tuple[int, bool, bool]:
    """How many of the tokens are taken, whether the stream stops there, and whether by its end marker.

    The stop token is looked for among all tokens, bytes or not, and every
    token counts towards the limit, as each of them was generated (ST-6).
    """
    n, stop, ended = len(tokens), False, False
    marks = np.flatnonzero(tokens == END)
    if len(marks):
        n, stop, ended = int(marks[0]), True, True
    if eos_token is not None:
        hits = np.flatnonzero(tokens[:n] == eos_token)
        if len(hits):
            n, stop, ended = int(hits[0]) + 1, True, False
    if max_tokens is not None and n >= max_tokens - emitted:
        n, stop, ended = max(max_tokens - emitted, 0), True, False
    return n, stop, ended


def make_processor(
    mode: str = "utf8",
    *,
    eos_token: int | None = None,
    max_tokens: int | None = None,
    ignore_overflowing: bool = True,
    ttl_ms: int | None = None,
    grouped: bool = False,
):
    """Build the per-stream function for `applyInPandasWithState`.

    mode: "utf8" (ST-1/ST-2, U+FFFD for malformed bytes) or "int" (ST-3,
    decimal values separated by one space across batches).
    eos_token: stop after this token, which may be no byte (it is emitted if
    it is one; later rows are ignored). max_tokens: stop after this many
    generated tokens (ST-6).
    ignore_overflowing: leave out ids that are no byte; else "int" prints them
    and "utf8" refuses them (ST-5).
    ttl_ms: the state of a stream that saw no row for so long is removed. If
    rows before a gap never came, the stream ends at the gap: the pending
    bytes are flushed and the rows behind the gap are dropped. For live
    streams; `None` keeps the state (a drain with `availableNow` would go on
    with empty batches until every timeout had passed).
    grouped: the function takes several streams a call, without timeouts.

    The contiguous run of tokens of a call is sorted, cut at its stop and
    decoded with one call.
    """
    if mode not in ("utf8", "int"):
        raise ValueError(f"unknown mode {mode!r}")

    def render(tokens: np.ndarray, pending: bytes, started: bool, final: bool, stream_id) -> tuple[str, bytes]:
        fits = (tokens >= 0) & (tokens <= 255)
        if mode == "int":
            shown = tokens[fits] if ignore_overflowing else tokens
            text = " ".join(map(str, shown.tolist()))
            return (" " + text if started and text else text), b""
        if not ignore_overflowing and not fits.all():
            raise ValueError(f"token {int(tokens[~fits][0])} of stream {stream_id} is not a byte")
        dec = codecs.getincrementaldecoder("utf-8")(errors="replace")
        text = dec.decode(pending + tokens[fits].astype(np.uint8).tobytes(), final=final)
        return text, b"" if final else dec.getstate()[0]

    def step(stream_id, held: tuple, seq: np.ndarray, tok: np.ndarray) -> tuple[tuple, tuple | None]:
        """The state of one stream after these rows, and its row of output if there is one."""
        next_seq, pending, started, done, emitted, buf_seq, buf_tok = held
        pending = bytes(pending or b"")
        if done:
            seq, tok = seq[:0], tok[:0]
        seq, first = np.unique(np.concatenate([np.asarray(buf_seq or [], np.int64), seq]), return_index=True)
        tok = np.concatenate([np.asarray(buf_tok or [], np.int64), tok])[first]
        seq, tok = seq[seq >= next_seq], tok[seq >= next_seq]
        run = int((seq == next_seq + np.arange(len(seq))).sum())
        first_seq, text, stop = next_seq, "", False
        if not done:
            n, stop, _ = cut_point(tok[:run], emitted, eos_token, max_tokens)
            text, pending = render(tok[:n], pending, started, stop and mode == "utf8", stream_id)
            started, emitted, next_seq, done = started or bool(text), emitted + n, next_seq + run, stop
        left = slice(len(seq), None) if done else slice(run, None)
        held = (next_seq, b"" if done else pending, started, done, emitted, seq[left].tolist(), tok[left].tolist())
        return held, (stream_id, first_seq, text, stop) if text or stop else None

    def one(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (stream_id,) = key
        held = state.get if state.exists else NEW
        if ttl_ms is not None and state.hasTimedOut:
            next_seq, pending, started, done = held[:4]
            text = "" if done else render(np.zeros(0, np.int64), bytes(pending or b""), started, True, stream_id)[0]
            state.remove()
            if not done:
                yield pd.DataFrame({"stream_id": [stream_id], "first_seq": [next_seq], "text": [text], "finished": [True]})
            return
        seqs, toks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for pdf in pdfs:
            if not held[3]:
                seqs.append(pdf["seq"].to_numpy(np.int64))
                toks.append(pdf["token"].to_numpy(np.int64))
        held, row = step(stream_id, held, np.concatenate(seqs), np.concatenate(toks))
        state.update(held)
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        if row:
            yield pd.DataFrame([row], columns=OUTPUT_COLUMNS)

    def several(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(state.get[0], zip(*state.get[1:], strict=True), strict=True)) if state.exists else {}
        parts = [[np.zeros(0, np.int64)] for _ in range(3)]
        for pdf in pdfs:
            ids = pdf["stream_id"].to_numpy(np.int64) if key[0] is not None else np.zeros(len(pdf), np.int64)
            for part, x in zip(parts, (ids, pdf["seq"].to_numpy(np.int64), pdf["token"].to_numpy(np.int64)), strict=True):
                part.append(x)
        ids, seq, tok = map(np.concatenate, parts)
        order = np.argsort(ids, kind="stable")
        ids, seq, tok = ids[order], seq[order], tok[order]
        starts = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1))
        out = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
            stream_id = int(ids[a]) if key[0] is not None else None
            held[stream_id], row = step(stream_id, held.get(stream_id, NEW), seq[a:b], tok[a:b])
            out += [row] if row else []
        state.update((list(held), *map(list, zip(*held.values(), strict=True))))
        if out:
            yield pd.DataFrame(out, columns=OUTPUT_COLUMNS).astype({"stream_id": "Int64"})

    return several if grouped else one


def decode_stream(stream: DataFrame, mode: str = "utf8", **kw) -> DataFrame:
    """ST-1 / ST-2 / ST-3 / ST-6 on a (streaming or batch) token DataFrame.

    A call of a processor costs milliseconds, however short its stream is, so
    streams of `STREAMS_A_CALL` neighbouring ids share a call and a row of
    state. With a timeout, which is a stream's own, each has its own call.
    """
    if kw.get("ttl_ms") is not None:
        return stream.groupBy("stream_id").applyInPandasWithState(
            make_processor(mode, **kw), OUTPUT_SCHEMA, STATE_SCHEMA, "append", "ProcessingTimeTimeout")
    near = stream.withColumn("_near", F.floor(F.col("stream_id") / STREAMS_A_CALL))
    return near.groupBy("_near").applyInPandasWithState(
        make_processor(mode, grouped=True, **kw), OUTPUT_SCHEMA, GROUPED_STATE_SCHEMA, "append", "NoTimeout")


def stop_at(tokens: Column, eos: int | None = None, max_len: int | None = None) -> Column:
    """ST-6 on whole arrays: keep tokens up to and including the first `eos`, at most `max_len`."""
    out = tokens
    if eos is not None:
        pos = F.array_position(tokens, F.lit(eos))
        out = F.slice(tokens, 1, F.when(pos > 0, pos).otherwise(F.size(tokens)).cast("int"))
    if max_len is not None:
        out = F.slice(out, 1, max_len)
    return out


# ---------------------------------------------------------------------------
TOP_STATE = "vals ARRAY<DOUBLE>, seqs ARRAY<LONG>, items ARRAY<STRING>"
TOP_OUTPUT = "run LONG, rank INT, loss DOUBLE, cum_batch LONG, item STRING"


def running_top_n(stream: DataFrame, n: int, *, group: str = "run", value: str = "loss", seq: str = "cum_batch", item: str = "item") -> DataFrame:
    """ST-8: the n smallest values per group of a live stream (update output).

    State per group is at most n entries; ties keep the earlier `seq` (Q9).
    """

    def fn(key, pdfs, state: GroupState):
        (g,) = key
        if state.exists:
            vals, seqs, items = state.get
            entries = list(zip(vals, seqs, items))
        else:
            entries = []
        for pdf in pdfs:  # trimmed with every Arrow batch, so at most n entries and one batch are held
            best = pdf.sort_values([value, seq], kind="stable").head(max(n, 0))
            entries.extend(zip(best[value].tolist(), best[seq].tolist(), best[item].tolist()))
            entries = sorted(entries, key=lambda e: (e[0], e[1]))[: max(n, 0)]
        state.update(([e[0] for e in entries], [e[1] for e in entries], [e[2] for e in entries]))
        yield pd.DataFrame(
            {
                "run": [g] * len(entries),
                "rank": list(range(1, len(entries) + 1)),
                "loss": [e[0] for e in entries],
                "cum_batch": [e[1] for e in entries],
                "item": [e[2] for e in entries],
            }
        )

    return stream.groupBy(group).applyInPandasWithState(fn, TOP_OUTPUT, TOP_STATE, "update", "NoTimeout")
