"""SentencePiece (BPE) encoding with byte offsets, and decoding.

The model file is read by its public protobuf layout. Normalisation takes, at
each place, the longest prefix that the compiled character map (a double-array
trie) knows, and records for every normalised byte the source byte it came
from. Pieces are cut from the normalised text, so each piece is projected to
its span of original bytes through that record.

If no piece holds a blank mark behind another character, merges never cross
the place before a run of blank marks. The text is then cut there and equal
stretches are segmented once per worker (a bounded cache); otherwise the
whole text is one stretch.

Defined results: null texts count as empty and have no tokens; any characters
and lengths are encoded whole; rows keep their number; an empty table gives no
rows; only the id and the text are read.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import heapq
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelane.llm.words import expand, give_back, text_blocks

BLANK = "▁"
SHORT = 96
NEVER = float("inf")
NO_RANK = np.iinfo(np.int32).max
CACHE_STRETCHES = 250_000  # or as many as one block of texts holds
TOKENS = "array<struct<id:int,start:int,end:int>>"

# Piece types and field numbers of the public model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


# byte pieces that make no character decode to one U+FFFD a byte
codecs.register_error("each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """`(number, value)` of the fields of a protobuf message."""
    at = 0

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at:at + n], at + n
        elif kind == 5:
            value, at = struct.unpack("<f", data[at:at + 4])[0], at + 4
        elif kind == 1:
            value, at = data[at:at + 8], at + 8
        else:
            raise ValueError("the model file is damaged")
        yield tag >> 3, value


class CharMap:
    """Longest-prefix replacement through a compiled character map."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self.texts = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of `data[at:]` and its replacement."""
        units = self.units
        if not units:
            return None
        best = None
        node = self._offset(units[0])
        for n in range(at, len(data)):
            node ^= data[n]
            if node >= len(units):
                break
            unit = units[node]
            # the label of the unit must be the byte; bit 31 marks values
            if unit & 0x800000FF != data[n]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                best = (n + 1 - at, self.texts[value:self.texts.index(b"\0", value)])
        return best

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)


class Model:
    def __init__(self, blob: bytes):
        self.pieces: list[str] = []
        self.costs: dict[str, float] = {}  # of normal pieces: less is merged first
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.unknown = 0
        kinds: list[int] = []
        trainer, norm = {}, {}
        for number, value in _fields(blob):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f[1].decode())
                kinds.append(f.get(3, NORMAL))
                if kinds[-1] == NORMAL:
                    self.costs[self.pieces[-1]] = -f.get(2, 0.0)
                    self.ids[self.pieces[-1]] = len(kinds) - 1
                elif kinds[-1] == UNKNOWN:
                    self.unknown = len(kinds) - 1
                elif kinds[-1] == BYTE:
                    self.byte_ids[int(self.pieces[-1][3:5], 16)] = len(kinds) - 1
                elif kinds[-1] != CONTROL:
                    raise ValueError("user-defined and unused pieces are not supported")
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0):
            raise ValueError("a BPE model with byte fallback and blank marks as prefixes is needed")
        self.kinds = kinds
        self.id_texts = [str(i) for i in range(len(kinds))]
        # texts of the ids that decode alone: pieces and the bytes of ASCII
        self.plain = [p.replace(BLANK, " ") if k == NORMAL else None for p, k in zip(self.pieces, kinds, strict=True)]
        for byte in range(128):
            self.plain[self.byte_ids[byte]] = chr(byte)
        self.char_map = CharMap(norm.get(2, b""))
        self.dummy_prefix = bool(norm.get(3, 1))
        self.squeeze = bool(norm.get(4, 1))
        self.mark_blanks = bool(norm.get(5, 1))
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        # normalised bytes of each piece
        self.sizes = np.array([1 if k == BYTE else len(p.encode()) for p, k in zip(self.pieces, kinds, strict=True)], np.int64)
        self.cuts = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids)
        self.odd = np.array([x is None for x in self.plain])  # ids that do not decode alone
        self.forget()
        self._pair_table()

    def forget(self) -> None:
        """Empty the cache of segmented stretches: a number for each, and their ids end to end."""
        self.cache: dict[str, int] = {}
        self.flat, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    # -- normalisation -----------------------------------------------------

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and for each of its bytes (and its end) the source byte."""
        data = text.encode("utf-8", "surrogatepass")
        if not data:
            return "", np.zeros(1, np.int64)
        if not self.char_map.units and not self.squeeze and self.mark_blanks:
            return self._plain(text, data)
        out: list[bytes] = []
        source: list[int] = []
        at, end = 0, len(data)
        blank = BLANK.encode() if self.mark_blanks else b" "

        def prefix(at: int) -> tuple[int, bytes]:
            found = self.char_map.longest(data, at)
            if found:
                return found
            n = 1
            while at + n < end and data[at + n] & 0xC0 == 0x80:
                n += 1
            return n, data[at:at + n]

        if self.squeeze:
            while at < end and (p := prefix(at))[1] == b" ":
                at += p[0]
            if at == end:
                return "", np.zeros(1, np.int64)
        if self.dummy_prefix:
            out.append(blank)
            source += [at] * len(blank)
        after_blank = self.squeeze
        while at < end:
            n, piece = prefix(at)
            if after_blank:
                piece = piece.lstrip(b" ")
            if piece:
                marked = piece.replace(b" ", blank)
                out.append(marked)
                source += [at] * len(marked)
                after_blank = self.squeeze and piece.endswith(b" ")
            at += n
        result = b"".join(out)
        if self.squeeze:
            while result.endswith(blank):
                result = result[:-len(blank)]
                at = source[len(result)]
        return result.decode("utf-8", "surrogatepass"), np.array(source[:len(result)] + [at], np.int64)

    def _plain(self, text: str, data: bytes) -> tuple[str, np.ndarray]:
        """The same for models that change nothing but blanks."""
        raw = np.frombuffer(data, np.uint8)
        width = np.where(raw == 0x20, len(BLANK.encode()), 1)
        lead = len(BLANK.encode()) if self.dummy_prefix else 0
        source = np.concatenate([np.zeros(lead, np.int64), np.repeat(np.arange(len(raw)), width), [len(raw)]])
        return (BLANK if self.dummy_prefix else "") + text.replace(" ", BLANK), source

    # -- segmentation ------------------------------------------------------

    def segment(self, stretch: str) -> list[int]:
        """Merge the best-scored neighbouring pair until none is a piece; leftmost first among equals."""
        symbols = self._merge_short(stretch) if len(stretch) <= SHORT else self._merge_long(stretch)
        out: list[int] = []
        for s in symbols:
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            else:
                out += [self.byte_ids[b] for b in s.encode("utf-8", "surrogatepass")]
        return out

    def _merge_short(self, stretch: str) -> list[str]:
        """All pairs' costs in a list: least work for words."""
        cost, symbols = self.costs.get, list(stretch)
        costs = [cost(a + b, NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
        while costs:
            best = min(costs)
            if best == NEVER:
                break
            i = costs.index(best)
            symbols[i] += symbols.pop(i + 1)
            del costs[i]
            if i < len(costs):
                costs[i] = cost(symbols[i] + symbols[i + 1], NEVER)
            if i:
                costs[i - 1] = cost(symbols[i - 1] + symbols[i], NEVER)
        return symbols

    def _merge_long(self, stretch: str) -> list[str]:
        """A heap of pairs over linked symbols: n log n for stretches of any length."""
        symbols: list[str] = list(stretch)
        left, right = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        costs, agenda = self.costs, []

        def offer(a: int, b: int) -> None:
            pair = symbols[a] + symbols[b]
            found = costs.get(pair)
            if found is not None:
                heapq.heappush(agenda, (found, a, b, len(pair)))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while agenda:
            _, a, b, size = heapq.heappop(agenda)
            if not symbols[a] or not symbols[b] or len(symbols[a]) + len(symbols[b]) != size:
                continue
            symbols[a] += symbols[b]
            symbols[b] = ""
            right[a] = right[b]
            if right[a] < len(symbols):
                left[right[a]] = a
                offer(a, right[a])
            if left[a] >= 0:
                offer(left[a], a)
        return [s for s in symbols if s]

    def stretches(self, normal: str) -> list[str]:
        if not self.cuts:
            return [normal] if normal else []
        if BLANK * 2 in normal or not normal.startswith(BLANK):
            return re.findall(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", normal)
        return [BLANK + s for s in normal[1:].split(BLANK)]

    def learn(self, stretches: Iterable[str]) -> None:
        """Put all these stretches into the cache."""
        wanted = set(stretches)
        missing = [x for x in wanted if x not in self.cache]
        if len(self.cache) + len(missing) > CACHE_STRETCHES:
            self.forget()
            missing = list(wanted)
        if missing:
            ids, bounds = self.segment_all(missing)
            self.cache.update(zip(missing, range(len(self.cache), len(self.cache) + len(missing)), strict=True))
            self.bounds = np.concatenate([self.bounds, bounds[1:] + len(self.flat)])
            self.flat = np.concatenate([self.flat, ids.astype(np.int32)])

    def ids_of(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of learned stretches, end to end, and the places where each stretch begins, with the end."""
        at = np.fromiter(map(self.cache.__getitem__, stretches), np.int64, len(stretches))
        sizes = self.bounds[at + 1] - self.bounds[at]
        return self.flat[expand(self.bounds[at], sizes)], np.concatenate([[0], np.cumsum(sizes)])

    def segment_all(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """`segment` of each stretch, end to end, and the bounds of each.

        Short stretches are merged side by side, one pair of each a round.
        """
        short = [i for i, x in enumerate(stretches) if 0 < len(x) <= SHORT]
        points = np.frombuffer("".join([stretches[i] for i in short]).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.symbol_of[points]
        sizes = np.array([len(stretches[i]) for i in short], np.int32)
        owner = np.repeat(np.arange(len(short), dtype=np.int32), sizes)
        # characters that are no piece and longer than a byte: one by one, below
        odd = np.zeros(len(short), bool)
        odd[owner[symbols < 0]] = True
        keep = ~odd[owner]
        symbols, owner = symbols[keep], owner[keep]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        cost, merged = self._pairs(symbols, owner, np.arange(len(symbols)))
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(cost, first)
            counts = np.diff(np.concatenate([first, [len(symbols)]]))
            least = np.repeat(best, counts)
            rest = least < NO_RANK
            if not rest.all():
                done.append((owner[~rest], symbols[~rest]))
                symbols, owner, cost, merged, least = symbols[rest], owner[rest], cost[rest], merged[rest], least[rest]
                if not len(symbols):
                    break
            at = np.flatnonzero(cost == least)
            at = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])]
            symbols[at] = merged[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner, cost, merged = symbols[keep], owner[keep], cost[keep], merged[keep]
            at = at - np.arange(len(at))
            touched = np.concatenate([at, at[at > 0] - 1])
            cost[touched], merged[touched] = self._pairs(symbols, owner, touched)
        # what was not merged here goes the long way
        merged_here = np.zeros(len(stretches), bool)
        merged_here[np.array(short, np.int64)[~odd]] = True
        rest = np.flatnonzero(~merged_here).tolist()
        for i in rest:
            ids = self.segment(stretches[i])
            done.append((np.full(len(ids), i), np.array(ids, np.int64)))
        place = np.array(short, np.int64)
        owner = np.concatenate([np.zeros(0, np.int64)] + [place[o] for o, _ in done[:len(done) - len(rest)]] + [o for o, _ in done[len(done) - len(rest):]])
        order = np.argsort(owner, kind="stable")
        ids = np.concatenate([np.zeros(0, np.int64)] + [d[1] for d in done])[order]
        bounds = np.searchsorted(owner[order], np.arange(len(stretches) + 1))
        return ids, bounds

    def _pairs(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost and result of merging each place with the next one of the same stretch."""
        after = np.minimum(at + 1, len(symbols) - 1)
        keys = np.where((after > at) & (owner[after] == owner[at]), symbols[at].astype(np.int64) * len(self.pieces) + symbols[after], -1)
        found = np.searchsorted(self.pair_keys, keys)
        found[found == len(self.pair_keys)] = 0
        same = self.pair_keys[found] == keys
        return np.where(same, self.pair_ranks[found], NO_RANK), self.pair_results[found]

    def _pair_table(self) -> None:
        """All ways to make a piece of two pieces, and the symbol of each character."""
        rows = []
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    rows.append((a * len(self.pieces) + b, i, self.costs[piece]))
                elif (a is None and k == 1) or (b is None and k == len(piece) - 1):
                    raise ValueError("a character of a piece is no piece itself")
        rows.sort()
        self.pair_keys = np.array([r[0] for r in rows], np.int64)
        self.pair_results = np.array([r[1] for r in rows], np.int32)
        # the costs' order, equal ones alike: half the bytes to compare
        self.pair_ranks = np.unique(np.array([r[2] for r in rows]), return_inverse=True)[1].astype(np.int32)
        self.symbol_of = np.full(0x110000, -1, np.int32)
        self.symbol_of[:128] = self.byte_ids[:128]
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i

    def encode(self, text: str) -> list[int]:
        stretches = self.stretches(self.normalize(text)[0])
        self.learn(stretches)
        return self.ids_of(stretches)[0].tolist()

    def spans(self, ids, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Original byte span of each piece."""
        ends = np.cumsum(self.sizes[np.asarray(ids, np.int64)]) if len(ids) else np.zeros(0, np.int64)
        starts = np.concatenate([[0], ends[:-1]]) if len(ids) else ends
        return source[starts], source[ends]

    # -- decoding ----------------------------------------------------------

    def text_of(self, ids) -> str:
        """Text of the pieces, without the rule for the first one."""
        if not self.odd[ids].any():
            return "".join(map(self.plain.__getitem__, ids))
        out, pending = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "each-byte"))
                pending = bytearray()
            if self.plain[i] is not None:
                out.append(self.plain[i])
            elif self.kinds[i] == UNKNOWN:
                out.append(" ⁇ ")
        if pending:
            out.append(pending.decode("utf-8", "each-byte"))
        return "".join(out)

    def decode(self, ids) -> str:
        text = self.text_of(ids)
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def blocks(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids and its source record."""
        normal = [self.normalize(t) for t in texts]
        stretches = [self.stretches(n) for n, _ in normal]
        together = list(chain.from_iterable(stretches))
        self.learn(together)
        ids, begins = self.ids_of(together)
        upto = begins[np.cumsum([0, *map(len, stretches)])].tolist()
        for a, b, (_, source) in zip(upto, upto[1:], normal, strict=False):
            yield ids[a:b], source

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str, int]]:
        """Token count, hash of the ids, hash of the decoded text, original bytes covered by spans."""
        for ids, source in self.blocks(texts):
            listed = ids.tolist()
            decoded = self.decode(listed)
            starts, ends = self.spans(ids, source)
            yield (len(listed), hashlib.sha256(",".join(map(self.id_texts.__getitem__, listed)).encode()).hexdigest(),
                   hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest(), int((ends - starts).sum()))

    def tokens(self, texts: list[str]) -> Iterator[tuple[list[dict], str]]:
        """Tokens with original byte spans, and the decoded text."""
        for ids, source in self.blocks(texts):
            starts, ends = self.spans(ids, source)
            yield ([{"id": i, "start": a, "end": b} for i, a, b in zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True)],
                   self.decode(ids.tolist()))


_models: dict[bytes, Model] = {}


def model_of(blob: bytes) -> Model:
    """The model of these bytes, built once per worker."""
    key = hashlib.sha256(blob).digest()
    if key not in _models:
        _models.clear()
        _models[key] = Model(blob)
    return _models[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _each_block(docs: DataFrame, id_col: str, text_col: str, blob: bytes, row, columns: dict[str, pa.DataType], schema: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(blob)
        gc.disable()  # nothing here makes cycles, and the cache is large to walk
        for block in text_blocks(batches, "text"):
            rows = list(row(model, [t or "" for t in block.column("text").to_pylist()]))
            arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate(columns.values())]
            yield pa.RecordBatch.from_arrays([block.column("id"), *arrays], names=["id", *columns])
        model.forget()
        gc.enable()
        give_back()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, blob: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(id, tokens, decoded)`: every token with its span of original bytes."""
    token = pa.struct([("id", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    return _each_block(docs, id_col, text_col, blob, Model.tokens, {"tokens": pa.list_(token), "decoded": pa.string()}, f"tokens {TOKENS}, decoded string")


def digests(docs: DataFrame, blob: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(id, n_tokens, ids_sha256, decoded_sha256, covered_bytes)` of the same tokens."""
    return _each_block(
        docs, id_col, text_col, blob, Model.digests,
        {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "covered_bytes": pa.int64()},
        "n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long")
