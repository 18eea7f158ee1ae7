"""Substring dedup of words by prefix-partitioned suffix trees.

A word goes if a window of `WINDOW` consecutive words covers it whose words
also start anywhere else, in the same document or another one.

1. Equal texts are counted first (by SHA-256). A text that occurs twice loses
   all words of its windows; only one row of it goes on, for the others' sake.
2. `anchors.shared_grams` finds the windows that can be repeated at all.
3. Suffixes are partitioned by variable-length prefixes: the first word of a
   window's anchor gram, or as many more words as it takes until no more than
   `GROUP` suffixes share the prefix. Groups are packed into partitions of a
   size set by their counts. Where even the whole gram has more suffixes, its
   windows are counted one by one instead (`crowded`), so that no group is
   larger than `GROUP`.
4. In a partition equal stretches of text are merged, their suffixes sorted,
   and the tree's nodes read from neighbours' common prefixes: an internal
   node at least `WINDOW` words deep holds the places of one repeated window.
5. Places go back to their documents as word spans, which are united.

Defined results: null and empty texts have no words; documents with fewer
words than a window lose none; null ids and repeated ids are documents like
others (rows are told apart by id and text); repeated rows are copies of one
another; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelane.llm import crowded as crowded_windows
from bytelane.llm.anchors import BLOCK, Units, candidate_stretches, merged, shared_grams, stretches, word_units
from bytelane.llm.store import settle
from bytelane.llm.words import BLANK, expand, mix, split_words, text_blocks, text_buffer

WINDOW = 35
GRAM = 8
PREFIXES = (1, 2, 4, 8)  # words; the last one is the gram
GROUP = 200_000  # suffixes, at most, under one prefix
PARTITION = 1_000_000  # words of text, about, in one partition
SEPARATORS = r"[\x20\x09-\x0D]+"
PLACES = "array<struct<start:int,end:int>>"


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row `(id, key, sha, n_words, kept_sha)`; `kept_sha` of all words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    line = F.btrim(F.regexp_replace(text, SEPARATORS, " "), F.lit(" "))
    return docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), F.sha2(text, 256).alias("sha"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"), F.sha2(line, 256).alias("kept_sha"))


def _prefix_hashes(units: Units, places: np.ndarray) -> np.ndarray:
    """Hashes of the first 1, 2, 4 and 8 words at each place (columns)."""
    out = np.zeros((len(places), len(PREFIXES)), np.int64)
    words = units.words
    h = np.zeros(len(places), np.uint64)
    with np.errstate(over="ignore"):
        for at in range(GRAM):
            h = mix((h ^ words[places + at]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
            if at + 1 in PREFIXES:
                out[:, PREFIXES.index(at + 1)] = h.view(np.int64)
    return out


def _block(block: pa.RecordBatch, grams: np.ndarray | None = None, inside: bool = True):
    """Units, candidate stretches and prefix hashes of a block of `(text, grams)`; only those whose whole gram is (not) in `grams`."""
    units = word_units(block.column("text"), GRAM)
    s = stretches(units, WINDOW, GRAM)
    keep = candidate_stretches(s, block.column("grams").to_pylist())
    first, last, anchor, text = s.first[keep], s.last[keep], s.anchor[keep], s.text[keep]
    prefixes = _prefix_hashes(units, anchor)
    if grams is not None:
        some = np.isin(prefixes[:, -1], grams) == inside
        text, anchor, first, last, prefixes = text[some], anchor[some], first[some], last[some], prefixes[some]
    return units, text, anchor, first, last, prefixes


def windows_under(grams: np.ndarray):
    """`(words of each window, text, place)` of a block's windows whose anchor's gram is in `grams`."""

    def of(block: pa.RecordBatch):
        units, text, _, first, last, _ = _block(block, grams)
        stretch, start = crowded_windows.starts_of(first, last)
        raw = units.raw.tobytes()
        lo, hi = units.starts[start].tolist(), units.ends[start + WINDOW - 1].tolist()
        return (b" ".join(raw[a:b].split()) for a, b in zip(lo, hi, strict=True)), text[stretch], start - units.bounds[text[stretch]]

    return of


def crowded_prefixes(rows: DataFrame) -> list[np.ndarray]:
    """For each prefix length the sorted hashes under which more than `GROUP` suffixes lie.

    At most one in `GROUP` suffixes has such a prefix of its own, so the lists
    that travel to the tasks are bounded by the corpus' suffixes / `GROUP`.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text", BLOCK):
            _, _, _, first, last, prefixes = _block(block)
            for level in range(len(PREFIXES)):
                values, at = np.unique(prefixes[:, level], return_inverse=True)
                n = np.bincount(at, last - first + 1, len(values)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values), level, np.int32)), pa.array(values), pa.array(n)], names=["level", "prefix", "n"])

    counts = rows.select("text", "grams").mapInArrow(count, "level int, prefix long, n long")
    crowded = counts.groupBy("level", "prefix").agg(F.sum("n").alias("n")).where(F.col("n") > GROUP).collect()
    return [np.array(sorted(r["prefix"] for r in crowded if r["level"] == i), np.int64) for i in range(len(PREFIXES))]


def group_of(prefixes: np.ndarray, crowded: list[np.ndarray]) -> np.ndarray:
    """Each suffix' group: its shortest prefix that isn't crowded, or the whole gram (crowded grams are left out before)."""
    out = prefixes[:, -1].copy()
    open_ = np.ones(len(prefixes), bool)
    for level in range(len(PREFIXES) - 1):
        fits = open_ & ~np.isin(prefixes[:, level], crowded[level])
        out[fits] = prefixes[fits, level]
        open_ &= ~fits
    return out


def suffix_records(rows: DataFrame, crowded: list[np.ndarray], partitions: int) -> DataFrame:
    """`(part, words, lead, ids, keys, places)`: each distinct stretch of a block with all its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text", BLOCK):
            units, text, anchor, first, last, prefixes = _block(block, crowded[-1], False)
            part = mix(group_of(prefixes, crowded).view(np.uint64)) % np.uint64(partitions)
            ids, keys = block.column("id").to_pylist(), block.column("key").to_pylist()
            raw, begin = units.raw.tobytes(), units.bounds
            # the words' bytes without their blanks: equal windows are equal strings
            found: dict[tuple, list] = {}
            lo, hi = units.starts[first].tolist(), units.ends[last + WINDOW - 1].tolist()
            for i, (a, b, p, lead, t, at) in enumerate(zip(
                    lo, hi, part.tolist(), (anchor - first).tolist(), text.tolist(), (first - begin[text]).tolist(), strict=True)):
                found.setdefault((p, lead, b" ".join(raw[a:b].split())), []).append((t, at))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in found], pa.int32()), pa.array([k[2] for k in found], pa.binary()),
                     pa.array([k[1] for k in found], pa.int32()),
                     pa.array([[ids[t] for t, _ in v] for v in found.values()], pa.list_(pa.int64())),
                     pa.array([[keys[t] for t, _ in v] for v in found.values()], pa.list_(pa.int64())),
                     pa.array([[at for _, at in v] for v in found.values()], pa.list_(pa.int32()))],
                    names=["part", "words", "lead", "ids", "keys", "places"])

    return rows.select("id", "key", "text", "grams").mapInArrow(
        run, "part int, words binary, lead int, ids array<long>, keys array<long>, places array<int>")


def deep_nodes(numbers: np.ndarray, bounds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at least `depth` words long inside their stretch, by tree node.

    `numbers`: word numbers of all stretches, end to end; `bounds` cuts them.
    Returns the suffixes' places in suffix order and, for each, the number of
    its node at `depth`: neighbours in the suffix array whose longest common
    prefix reaches `depth` lie below one node.
    """
    room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(numbers))
    # ranks of the first 1, 2, 4, ... words; 0 stands for the stretch's end
    rank, size, ranks = numbers + 1, 1, [numbers + 1]
    while size * 2 <= depth:
        after = np.zeros(len(rank), np.int64)
        after[:-size or None] = rank[size:]
        after[room <= size] = 0
        rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + after, return_inverse=True)[1] + 1
        size *= 2
        ranks.append(rank)
    places = np.flatnonzero(room >= depth)
    rest = depth - size
    order = np.lexsort((rank[places + rest], rank[places])) if rest else np.argsort(rank[places], kind="stable")
    places = places[order]
    # common prefix of neighbours, by halving steps over the ranks
    a, b = places[:-1].copy(), places[1:].copy()
    common = np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        step = 1 << level
        for _ in range(2 if level == len(ranks) - 1 else 1):
            fits = common + step <= depth
            same = fits & (ranks[level][np.where(fits, a, 0)] == ranks[level][np.where(fits, b, 0)])
            a, b, common = a + same * step, b + same * step, common + same * step
    node = np.concatenate([[0], np.cumsum(common < depth)]) if len(places) else np.zeros(0, np.int64)
    return places, node


def repeated_places(key, table):
    """The word spans that repeated windows cover, per document, from one partition of stretches."""
    words, leads = table.column("words").to_pylist(), table.column("lead").to_pylist()
    entries: dict[tuple, int] = {}
    which = np.array([entries.setdefault((w, lead), len(entries)) for w, lead in zip(words, leads, strict=True)], np.int64)
    split = [w.split(b" ") for w, _ in entries]
    vocabulary: dict[bytes, int] = {}
    numbers = np.array([vocabulary.setdefault(w, len(vocabulary)) for s in split for w in s], np.int64)
    sizes = np.array([len(s) for s in split], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    lists = [table.column(c).combine_chunks() for c in ("ids", "keys", "places")]
    counts = np.diff(lists[0].offsets.to_numpy())
    ids, keys = lists[0].flatten(), lists[1].flatten().to_numpy()
    at = lists[2].flatten().to_numpy()
    entry = np.repeat(which, counts)
    times = np.bincount(entry, minlength=len(entries))
    places, node = deep_nodes(numbers, bounds, WINDOW)
    owner = np.searchsorted(bounds, places, "right") - 1
    leaves = np.bincount(node, times[owner]) if len(node) else np.zeros(0)
    hit = places[leaves[node] > 1]
    hit.sort()
    # runs of repeated window starts inside a stretch
    own = np.searchsorted(bounds, hit, "right") - 1
    new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (own[1:] != own[:-1])]) if len(hit) else np.zeros(0, bool)
    run = np.flatnonzero(new)
    lo = hit[run] - bounds[own[run]]
    hi = hit[np.append(run[1:] - 1, len(hit) - 1)] - bounds[own[run]] + WINDOW if len(hit) else lo
    per_entry = np.searchsorted(own[run], np.arange(len(entries) + 1))
    n = np.diff(per_entry)[entry]
    place = np.repeat(np.arange(len(entry)), n)
    span = expand(per_entry[:-1][entry], n)
    starts, ends = at[place] + lo[span], at[place] + hi[span]
    return spans_by_row(ids, keys, place, starts, ends)


def spans_by_row(ids: pa.Array, keys: np.ndarray, place: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Table:
    """`(id, key, spans)`: united spans of each row; `place` picks its id and key."""
    no_id = ids.is_null().to_numpy(zero_copy_only=False)
    number = ids.fill_null(0).to_numpy(zero_copy_only=False)
    order = np.lexsort((starts, keys[place], number[place], no_id[place]))
    place, starts, ends = place[order], starts[order].astype(np.int64), ends[order].astype(np.int64)
    a, b = place[1:], place[:-1]
    row = np.concatenate([[0], np.cumsum((number[a] != number[b]) | (keys[a] != keys[b]) | (no_id[a] != no_id[b]))]) if len(place) else place
    # one axis for all rows, far enough apart never to touch
    gap = int(ends.max(initial=0)) + 1
    lo, hi = merged(starts + row * gap, ends + row * gap)
    row_of = lo // gap
    first = np.searchsorted(row, np.arange(int(row[-1]) + 1)) if len(row) else np.zeros(0, np.int64)
    items = pa.StructArray.from_arrays(
        [pa.array((lo - row_of * gap).astype(np.int32)), pa.array((hi - row_of * gap).astype(np.int32))], names=["start", "end"])
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row_of, np.arange(len(first) + 1)).astype(np.int32)), items)
    taken = place[first]
    return pa.table({"id": ids.take(pa.array(taken)), "key": pa.array(keys[taken]), "spans": spans})


def cut_words(rows: DataFrame) -> DataFrame:
    """`(id, key, n_removed, kept_sha, kept)` of rows `(id, key, text, spans)`; spans in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text", BLOCK):
            raw, offsets = text_buffer(block.column("text"))
            first = split_words(raw, offsets, BLANK)[2]
            removed, kept = [], []
            for text, spans, a, b in zip(block.column("text").to_pylist(), block.column("spans").to_pylist(), first[:-1], first[1:], strict=True):
                stay = np.ones(b - a, bool)
                for s in spans:
                    stay[s["start"]:s["end"]] = False
                words = (text or "").encode("utf-8", "surrogatepass").split()
                kept.append(b" ".join([words[i] for i in np.flatnonzero(stay).tolist()]))
                removed.append(int((~stay).sum()))
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), block.column("key"), pa.array(removed, pa.int64()),
                 pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array([k.decode("utf-8", "surrogatepass") for k in kept])],
                names=["id", "key", "n_removed", "kept_sha", "kept"])

    return rows.mapInArrow(run, "id long, key long, n_removed long, kept_sha string, kept string")


def candidate_rows(docs: DataFrame, rows: DataFrame, shared: DataFrame, by: str, id_col: str, text_col: str) -> DataFrame:
    """`(id, key, text, grams)` of the rows `(id, key)` that have shared grams, written once; `by`: which of the two `shared` goes by."""
    wanted = rows.join(shared, rows[by] == shared["id"]).select(
        rows["id"].alias("_id"), rows["key"].alias("_key"), "grams").distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    return settle(d.join(wanted, d["id"].eqNullSafe(F.col("_id")) & (d["key"] == F.col("_key"))).select(
        "id", "key", "text", "grams"), "candidates")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows measured (with `copies` of their text), the candidate rows, and the spans found in them."""
    rows = settle(measured(docs, id_col, text_col), "measured")
    groups = settle(rows.groupBy("sha").agg(
        F.count(F.lit(1)).alias("copies"), F.min_by(F.struct("id", "key"), F.struct(F.col("id").isNull(), "id")).alias("rep")), "copies")
    rows = settle(rows.join(groups, "sha"), "counted")
    total = int(rows.agg(F.sum("n_words")).first()[0] or 0)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # places are told apart by their text, so that no list of grams grows with the rows of one id
    d = docs.select(F.xxhash64(text).alias("id"), text.alias("text"))
    shared = shared_grams(d, word_units, WINDOW, GRAM, total, distinct_ids=False)
    reps = rows.where(F.col("id").eqNullSafe(F.col("rep.id")) & (F.col("n_words") >= WINDOW)).select("id", "key")
    own = candidate_rows(docs, reps, shared, "key", id_col, text_col)
    crowded = crowded_prefixes(own)
    # a stretch repeats its window's words: about three times the candidates' text
    n = int(own.agg(F.sum(F.size("grams"))).first()[0] or 0)
    partitions = max(24, n * (WINDOW + GRAM) // PARTITION + 1)
    records = suffix_records(own, crowded, partitions)
    found = records.groupBy("part").applyInArrow(repeated_places, f"id long, key long, spans {PLACES}")
    if len(crowded[-1]):
        hot = crowded_windows.window_rows(own, windows_under(crowded[-1]))
        found = found.unionByName(crowded_windows.spans(
            hot, WINDOW, F.sum(F.size("ids")), lambda _: F.col("_fact") > 1, "crowded-words"))
    spans = found.groupBy("id", "key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return rows, own, spans


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row `id, n_words, n_removed, kept_sha` (SHA-256 of the kept words, joined by blanks)."""
    rows, own, spans = repeated_spans(docs, id_col, text_col)
    s = spans.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "spans")
    hit = own.join(s, own["id"].eqNullSafe(F.col("_id")) & (own["key"] == F.col("_key"))).select("id", "key", "text", "spans")
    cut = cut_words(hit).select(F.col("id").alias("_id"), F.col("key").alias("_key"), "n_removed", F.col("kept_sha").alias("_sha"))
    whole = (F.col("copies") > 1) & (F.col("n_words") >= WINDOW)
    r = rows.join(cut.dropDuplicates(["_id", "_key"]), rows["id"].eqNullSafe(F.col("_id")) & (rows["key"] == F.col("_key")), "left")
    return r.select(
        "id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("_sha", "kept_sha")).alias("kept_sha"))
