"""Benchmark decontamination with training suffix arrays.

Each block of documents (a shard of a few MB) is turned into word numbers
over the benchmark's vocabulary; words outside it end every match. The shard's
suffixes, compared over the window length, are sorted into a suffix array.

- `contamination` and `decontaminate` binary-search every test window in it:
  the two bounds give all its places. Only suffixes whose leading words begin
  some window are sorted; no other suffix can hold one.
- `matches` reports where: the places of an item's neighbouring windows that
  are neighbours in a document too are one verbatim match, which is maximal at
  both ends, with the item, both places, and its length.
- `longest_matches` binary-searches every test suffix, down to the last word of
  an item, among all suffixes that begin with a word of the benchmark. The
  neighbours of the bound give its longest match below a window's length, the
  maximal matches that cover it any longer one.

Nothing but the found matches is shuffled.

The benchmark travels to the tasks in blocks of at most `TEST_BYTES` of text
(the bound of what is on the driver and broadcast); a larger benchmark is
searched block by block. The result of a block is written before the next
block is read, and the results are merged per document.

Words are mapped by a 64-bit hash and then compared byte by byte, so no
collision can make a match.

Defined results: null or empty texts have no words and are never contaminated;
items without words match nothing; items shorter than the window are one
window; repeated items and rows each count for themselves; empty tables give
no rows (documents) or no contamination (benchmark). Null item ids are left
out of the list of items, but their windows hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelane.llm.store import settle
from bytelane.llm.words import ALNUM, LOWER, expand, prefix_hash, span_hashes, split_words, text_blocks, text_buffer

WINDOW = 13
TEST_BYTES = 16 << 20
SHARE = 20  # contaminated: at least one word in this many is hit


@dataclass
class TestSet:
    """Vocabulary, windows and items of one block of the benchmark."""

    hashes: np.ndarray  # sorted word hashes; a word's number is its place + 1
    raw: np.ndarray
    word_starts: np.ndarray
    word_lengths: np.ndarray
    keys: np.ndarray  # distinct windows as fixed-width byte strings, sorted
    lengths: np.ndarray  # words in each window
    item_first: np.ndarray  # windows -> slice of items
    items: np.ndarray
    names: list[str | None]
    leads: np.ndarray  # bitmap of the hashes of the windows' leading words
    lead: int  # number of leading words
    width: int  # words in a suffix key
    digits: int  # bytes of a word number
    numbers: np.ndarray  # word numbers of all items, end to end
    item_words: np.ndarray  # item i has words item_words[i]:item_words[i + 1]
    place_window: np.ndarray  # windows by item and place: the distinct window, the item, and the place
    place_item: np.ndarray
    place_at: np.ndarray


def lead_slots(numbers: np.ndarray, lead: int, bits: int) -> np.ndarray:
    """Hash slots of the first `lead` word numbers at each place (0-padded at the end)."""
    h = np.zeros(len(numbers), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(lead):
            x = np.zeros(len(numbers), np.uint64)
            x[:len(numbers) - j] = numbers[j:]
            h = (h + x) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


LEAD_BITS = 22


def pack(numbers: np.ndarray, places: np.ndarray, lengths: np.ndarray, width: int, digits: int) -> np.ndarray:
    """Keys of `width` big-endian word numbers from each place; past `lengths` they are 0."""
    padded = np.concatenate([numbers, np.zeros(width, numbers.dtype)])
    out = np.zeros((len(places), width, digits), np.uint8)
    for j in range(width):
        n = np.where(j < lengths, padded[places + j], 0)
        for d in range(digits):
            out[:, j, d] = (n >> (8 * (digits - 1 - d))) & 255
    return out.reshape(len(places), width * digits).view(f"S{width * digits}").ravel()


def build_tests(ids: list, texts: list[str | None], window: int = WINDOW) -> TestSet | None:
    """Index one block of benchmark items; None if they have no words."""
    raw, offsets = text_buffer(pa.array([t or "" for t in texts], pa.large_string()))
    raw = LOWER[raw]
    starts, ends, first = split_words(raw, offsets, ALNUM)
    if not len(starts):
        return None
    h = span_hashes(prefix_hash(raw), starts, ends)
    hashes, one = np.unique(h, return_index=True)
    numbers = np.searchsorted(hashes, h) + 1
    n = np.diff(first)
    size = np.minimum(n, window)
    per_item = np.where(n > 0, n - size + 1, 0)
    places = expand(first[:-1], per_item)
    owner = np.repeat(np.arange(len(n)), per_item)
    lengths = size[owner]
    # the largest value of the digits stays free: `_after` relies on it
    digits = max(1, (int(len(hashes) + 1).bit_length() + 7) // 8)
    keys = pack(numbers, places, lengths, window, digits)
    distinct, at = np.unique(keys, return_inverse=True)
    pairs = np.unique(np.stack([at, owner], axis=1), axis=0)
    window_length = np.zeros(len(distinct), np.int64)
    window_length[at] = lengths
    lead = int(min(2, lengths.min()))
    bitmap = np.zeros(1 << LEAD_BITS, bool)
    bitmap[lead_slots(numbers, lead, LEAD_BITS)[places]] = True
    return TestSet(
        hashes, raw, starts[one], (ends - starts)[one], distinct, window_length,
        np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1],
        [None if i is None else str(i) for i in ids], bitmap, lead, window, digits, numbers, first, at, owner, places - first[owner])


def word_numbers(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, tests: TestSet) -> np.ndarray:
    """Number of each word in the benchmark's vocabulary, 0 if it isn't there."""
    h = span_hashes(prefix_hash(raw), starts, ends)
    slots = np.zeros(1 << 16, bool)
    slots[tests.hashes >> np.uint64(48)] = True
    maybe = np.flatnonzero(slots[h >> np.uint64(48)])
    at = np.searchsorted(tests.hashes, h[maybe])
    at[at == len(tests.hashes)] = 0
    sizes = (ends - starts)[maybe]
    known = (tests.hashes[at] == h[maybe]) & (tests.word_lengths[at] == sizes)
    maybe, at, sizes = maybe[known], at[known], sizes[known]
    # the same bytes, not just the same hash
    differ = raw[expand(starts[maybe], sizes)] != tests.raw[expand(tests.word_starts[at], sizes)]
    wrong = np.searchsorted(np.cumsum(sizes), np.flatnonzero(differ), "right")
    at[wrong] = -1
    numbers = np.zeros(len(h), np.int64)
    numbers[maybe] = at + 1
    return numbers


def search_shard(texts: pa.Array, tests: TestSet):
    """Hits of one shard.

    Returns the words per text, hit words per text, the distinct
    `(text, item)` pairs, which words are hit, and the texts' first words.
    """
    starts, numbers, first, room = _numbered_words(texts, tests)
    array, places = _suffix_array(numbers, room, tests)
    match, window, count = _window_places(array, places, tests)
    covered = np.zeros(len(starts) + 1, np.int64)
    np.add.at(covered, match, 1)
    np.add.at(covered, match + tests.lengths[window], -1)
    hit = np.cumsum(covered[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    text = np.searchsorted(first, match, "right") - 1
    found = np.unique(text * np.int64(len(count)) + window)
    text, window = found // max(len(count), 1), found % max(len(count), 1)
    per = tests.item_first[window + 1] - tests.item_first[window]
    pairs = np.unique(np.repeat(text, per) * np.int64(len(tests.names)) + tests.items[expand(tests.item_first[window], per)])
    return np.diff(first), total[first[1:]] - total[first[:-1]], pairs // len(tests.names), pairs % len(tests.names), hit, first


def _numbered_words(texts: pa.Array, tests: TestSet) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shard's words: byte starts, numbers, first word of each text, and words left in the text."""
    raw, offsets = text_buffer(texts)
    raw = LOWER[raw]
    starts, ends, first = split_words(raw, offsets, ALNUM)
    room = np.repeat(first[1:], np.diff(first)) - np.arange(len(starts))
    return starts, word_numbers(raw, starts, ends, tests), first, room


def _suffix_array(numbers: np.ndarray, room: np.ndarray, tests: TestSet, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes and their places: those whose leading words begin some window, or all that begin with a known word."""
    possible = numbers > 0
    if not whole:
        possible &= tests.leads[lead_slots(numbers, tests.lead, LEAD_BITS)] & (room >= tests.lead)
    places = np.flatnonzero(possible)
    suffixes = pack(numbers, places, room[places], tests.width, tests.digits)
    order = np.argsort(suffixes, kind="stable")
    return suffixes[order], places[order]


def _window_places(array: np.ndarray, places: np.ndarray, tests: TestSet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary search of every test window: `(place, window)` of all suffixes that begin with it, and the count of each."""
    low = np.searchsorted(array, tests.keys, "left")
    high = np.searchsorted(array, _after(tests), "left")
    count = np.maximum(high - low, 0)
    return places[expand(low, count)], np.repeat(np.arange(len(count)), count), count


def _maximal(match: np.ndarray, window: np.ndarray, first: np.ndarray, tests: TestSet) -> tuple[np.ndarray, ...]:
    """`(text, item, place in the item, place in the text, length)` of the maximal matches."""
    # the items' places of each distinct window
    order = np.argsort(tests.place_window, kind="stable")
    begin = np.searchsorted(tests.place_window[order], np.arange(len(tests.keys) + 1))
    n = begin[window + 1] - begin[window]
    own = order[expand(begin[window], n)]
    place, window = np.repeat(match, n), np.repeat(window, n)
    item, at = tests.place_item[own], tests.place_at[own]
    text = np.searchsorted(first, place, "right") - 1
    # neighbours on one diagonal of a text and an item
    by = np.lexsort((place, place - at, item, text))
    place, item, at, text, size = place[by], item[by], at[by], text[by], tests.lengths[window[by]]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1] + 1) | (at[1:] != at[:-1] + 1) | (item[1:] != item[:-1]) | (text[1:] != text[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(place))[:len(lo)] - 1
    return text[lo], item[lo], at[lo], place[lo] - first[text[lo]], place[hi] + size[hi] - place[lo]


MATCH = "item string, item_place int, place int, length int"


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(id, item, item_place, place, length)` in words: every maximal verbatim match of at least a window (or a whole shorter item)."""
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def found(tests: TestSet) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in text_blocks(batches, "text"):
                _, numbers, first, room = _numbered_words(block.column("text"), tests)
                match, window, _ = _window_places(*_suffix_array(numbers, room, tests), tests)
                text, item, *rest = _maximal(match, window, first, tests)
                yield pa.RecordBatch.from_arrays(
                    [block.column("id").take(pa.array(text)), pa.array([tests.names[i] for i in item.tolist()], pa.string()), *[pa.array(r.astype(np.int32)) for r in rest]],
                    names=["id", "item", "item_place", "place", "length"])

        return d.mapInArrow(run, f"id {kind}, {MATCH}")

    parts = [settle(found(t), "matches") for t in test_blocks(benchmark) if t is not None]
    out = parts[0] if parts else d.where("false").selectExpr("id", "cast(null as string) item", "0 item_place", "0 place", "0 length")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _longest_in_shard(array: np.ndarray, places: np.ndarray, numbers: np.ndarray, room: np.ndarray, tests: TestSet) -> tuple[np.ndarray, np.ndarray]:
    """For every test suffix its longest match, of a window's length at most, and a word place where it is."""
    n = np.diff(tests.item_words)
    at = np.arange(len(tests.numbers))
    left = np.repeat(tests.item_words[1:], n) - at
    keys = pack(tests.numbers, at, left, tests.width, tests.digits)
    low = np.searchsorted(array, keys, "left")
    best, where = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    padded, test_padded = np.concatenate([numbers, np.zeros(tests.width, np.int64)]), np.concatenate([tests.numbers, np.zeros(tests.width, np.int64)])
    for side in (low - 1, low):
        ok = (side >= 0) & (side < len(array))
        place = places[np.where(ok, side, 0)] if len(places) else np.zeros(len(at), np.int64)
        common, open_ = np.zeros(len(at), np.int64), ok.copy()
        for j in range(tests.width if len(places) else 0):
            open_ &= (j < left) & (j < room[place]) & (padded[place + j] == test_padded[at + j])
            common += open_
        better = common > best
        best, where = np.where(better, common, best), np.where(better, place, where)
    return best, where


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(item, item_place, length, id, place)` for every suffix of every item: its longest verbatim match in `docs` and one document that has it.

    A suffix whose first word is in no document has no row. Of several longest
    matches the one with the least id and place is reported among those that
    the shards report, one a shard.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def found(tests: TestSet) -> DataFrame:
        owner = np.repeat(np.arange(len(tests.names)), np.diff(tests.item_words))
        item_place = np.arange(len(tests.numbers)) - tests.item_words[owner]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in text_blocks(batches, "text"):
                _, numbers, first, room = _numbered_words(block.column("text"), tests)
                array, places = _suffix_array(numbers, room, tests, whole=True)
                best, where = _longest_in_shard(array, places, numbers, room, tests)
                # maximal matches give the lengths beyond a window to all suffixes that they cover
                match, window, _ = _window_places(array, places, tests)
                text, item, at, place, length = _maximal(match, window, first, tests)
                covered = np.repeat(np.arange(len(text)), length)
                step = expand(np.zeros(len(text), np.int64), length)
                suffix = tests.item_words[item[covered]] + at[covered] + step
                rest, spot = length[covered] - step, first[text[covered]] + place[covered] + step
                order = np.lexsort((spot, -rest, suffix))
                suffix, rest, spot = suffix[order], rest[order], spot[order]
                lead = np.flatnonzero(np.concatenate([[True], suffix[1:] != suffix[:-1]])) if len(suffix) else np.zeros(0, np.int64)
                longer = rest[lead] > best[suffix[lead]]
                best[suffix[lead][longer]], where[suffix[lead][longer]] = rest[lead][longer], spot[lead][longer]
                got = np.flatnonzero(best)
                text = np.searchsorted(first, where[got], "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owner[got].astype(np.int32)), pa.array([tests.names[i] for i in owner[got].tolist()], pa.string()), pa.array(item_place[got].astype(np.int32)),
                     pa.array(best[got].astype(np.int32)), block.column("id").take(pa.array(text)), pa.array((where[got] - first[text]).astype(np.int32))],
                    names=["number", "item", "item_place", "length", "id", "place"])

        rows = d.mapInArrow(run, f"number int, item string, item_place int, length int, id {kind}, place int")
        # items are told apart by their number, for ids may repeat
        best = rows.groupBy("number", "item", "item_place").agg(F.min(F.struct((-F.col("length")).alias("n"), "id", "place")).alias("b"))
        return best.select("item", "item_place", (-F.col("b.n")).alias("length"), F.col("b.id").alias("id"), F.col("b.place").alias("place"))

    parts = [settle(found(t), "longest") for t in test_blocks(benchmark) if t is not None]
    out = parts[0] if parts else d.where("false").selectExpr("cast(null as string) item", "0 item_place", "0 length", "id", "0 place")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _after(tests: TestSet) -> np.ndarray:
    """For each window, a key just above all keys that begin with it."""
    size = tests.width * tests.digits
    table = np.frombuffer(tests.keys.tobytes(), np.uint8).reshape(len(tests.keys), size).copy()
    table[np.arange(size)[None, :] >= (tests.lengths * tests.digits)[:, None]] = 255
    # word numbers never reach the largest value of their digits
    full = tests.lengths == tests.width
    out = table.reshape(-1)
    last = table[:, ::-1]
    carry = full.copy()
    for j in range(size):
        last[carry, j] += 1
        carry = carry & (last[:, j] == 0)
    return out.view(f"S{size}").ravel()


def hits(docs: DataFrame, tests: TestSet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: `id, row, n_words, hit_runs, items`.

    `hit_runs`: start, end (words, end exclusive) of the maximal hit stretches.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            if tests is None:
                _, offsets = text_buffer(block.column("text"))
                raw = LOWER[text_buffer(block.column("text"))[0]]
                n = np.diff(split_words(raw, offsets, ALNUM)[2])
                runs, items = [[] for _ in n], [[] for _ in n]
            else:
                n, _, text, item, hit, first = search_shard(block.column("text"), tests)
                runs, items = [[] for _ in n], [[] for _ in n]
                for t, i in zip(text.tolist(), item.tolist(), strict=True):
                    if tests.names[i] is not None:
                        items[t].append(tests.names[i])
                for t in np.unique(text).tolist():
                    h = np.concatenate([[False], hit[first[t]:first[t + 1]], [False]]).astype(np.int8)
                    edge = np.flatnonzero(np.diff(h))
                    runs[t] = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), pa.array(n.astype(np.int64)),
                 pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                 pa.array(items, pa.list_(pa.string()))],
                names=["id", "n_words", "hit_runs", "items"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, n_words long, hit_runs array<struct<start:int,end:int>>, items array<string>")


def block_count(benchmark: DataFrame, text_col: str = "text") -> int:
    """Blocks of about `TEST_BYTES` that the benchmark is searched in."""
    return -(-int(benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // TEST_BYTES) or 1


def test_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[TestSet | None]:
    """The benchmark block by block, one on the driver at a time."""
    b = benchmark.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = block_count(benchmark, text_col)
    for i in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i)
        rows = part.orderBy("id", "text").collect()
        yield build_tests([r["id"] for r in rows], [r["text"] for r in rows])


def _merged(rows: DataFrame, tests: Iterator[TestSet | None]) -> DataFrame:
    """Results of several benchmark blocks, united per `(row, id)` of `rows (row, id, text)`.

    A block's result is written before the next block is read: all rows for
    the first block, those with hits for the others.
    """
    parts = None
    for t in tests:
        one = hits(rows.select(F.struct("row", "id").alias("id"), "text"), t, "id", "text")
        one = settle(one if parts is None else one.where(F.size("hit_runs") > 0), "hits")
        parts = one if parts is None else parts.union(one)
    g = parts.groupBy("id").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("items")).alias("items"),
        F.array_sort(F.flatten(F.collect_list("hit_runs"))).alias("runs"))

    def step(acc, r):
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], r["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (r["start"] <= F.element_at(acc, -1)["end"]), grown).otherwise(F.concat(acc, F.array(r)))

    merged = F.aggregate("runs", F.expr("cast(array() as array<struct<start:int,end:int>>)"), step)
    return g.select(F.col("id.row").alias("row"), F.col("id.id").alias("id"), "n_words", merged.alias("hit_runs"), "items")


def _with_verdict(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda s, r: s + (r["end"] - r["start"]))
    found = found.withColumn("n_hit", n_hit).withColumn("items", F.array_sort(F.array_distinct("items")))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: `id, n_words, hit_runs, items, n_hit, contaminated`."""
    if block_count(benchmark) == 1:
        return _with_verdict(hits(docs, next(test_blocks(benchmark)), id_col, text_col))
    rows = settle(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.expr("uuid()").alias("row")), "rows")
    return _with_verdict(_merged(rows, test_blocks(benchmark))).drop("row")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are not contaminated, with all their columns."""
    if block_count(benchmark) > 1:
        # all columns in one, so that none can clash with the key of the row
        rows = settle(docs.select(F.expr("uuid()").alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), "rows")
        doc = lambda c: F.col("doc").getField(c)
        found = _merged(rows.select("row", doc(id_col).alias("id"), doc(text_col).cast("string").alias("text")), test_blocks(benchmark))
        bad = _with_verdict(found).where("contaminated").select("row")
        return rows.join(bad, "row", "left_anti").select("doc.*")
    test = next(test_blocks(benchmark))
    if test is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, text_col):
            n, n_hit, *_ = search_shard(block.column(text_col), test)
            yield block.filter(pa.array((n_hit == 0) | (SHARE * n_hit < n)))

    return docs.mapInArrow(run, docs.schema)
