"""Exact BM25 top-k by an inverted index with block-max pruning, shard by shard.

1. Every shard (`SHARD_BYTES` of documents) is indexed once: its terms with the
   documents and counts of each. Documents of a shard are put in order of
   their most frequent term, so that a block of `BLOCK` neighbours shares a
   vocabulary and its maxima are tight.
2. Global statistics: the number of documents, their mean length, and the
   document frequency of each query term, summed over all shards.
3. Search, per shard and chunk of queries: the terms that many of the chunk's
   queries and the shard's documents share are summed by matrix products, the
   others by their postings. The latter's sums are exact; for the former the
   block's greatest weight bounds what a document of the block can get. A block
   whose bound stays below the k-th best score that the task knows is left out;
   the others are summed in single precision, and what can reach that score
   within the error of this is summed again in double precision. The k-th best
   score rises from shard to shard, and starts from that of a pilot: one shard
   in `PILOT`, searched before the others.
4. The tasks' lists are merged by score, then id. Every document that can be
   in the answer was scored with the global statistics, so the merge is exact.

Queries travel in blocks of at most `QUERY_TERMS` terms; more queries mean
more passes over the index. Scores are rounded to `DIGITS` digits before they
are compared, so that the order of summation cannot decide.

Defined results: null and empty texts have no terms and are found by no query;
a document that shares no term with a query is not in its answer, which may
thus be shorter than k; a null id is reported as null, after equal scores with
an id; of query rows that share an id the one with the least text counts;
repeated documents are ranked one by one; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytelane.llm.store import settle
from bytelane.llm.words import ALNUM, LOWER, expand, give_back, prefix_hash, span_hashes, split_words, text_blocks, text_buffer

K1, B = 1.2, 0.75
DIGITS = 6
SHARD_BYTES = 16 << 20
BLOCK = 32  # documents under one maximum
FREQUENT = 16  # terms in at least one in so many documents of a shard can be scored by block
SHARED = 125  # they are, if one in so many pairs of a chunk's queries and the shard's documents share them
CHUNK = 256  # queries scored together
CELLS = 1 << 20  # pairs of queries and documents scored together
POSTINGS = 1 << 18  # added together
WIDE = 4  # a block that at least one in so many queries needs is scored for the whole chunk
QUERY_TERMS = 4_000_000
PILOT = 8  # one shard in so many is searched first
SHARDS_PER_PILOT_TASK = 2
LAST = (1 << 63) - 1  # stands for a null id in comparisons


def _by_number(x: np.ndarray, n: int) -> np.ndarray:
    """Stable order of numbers below `n`; short ones are sorted by their digits."""
    return np.argsort(x.astype(np.uint16) if n <= 1 << 16 else x, kind="stable")


def block_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`(text, term, count)` of the distinct terms of each text, by text; and the texts' lengths in words."""
    raw, offsets = text_buffer(texts)
    raw = LOWER[raw]
    starts, ends, first = split_words(raw, offsets, ALNUM)
    h = span_hashes(prefix_hash(raw), starts, ends)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.argsort(h, kind="stable")
    order = order[_by_number(text[order], len(first) - 1)]
    h, text = h[order], text[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])) if len(h) else np.zeros(0, np.int64)
    return text[new], h[new], np.diff(np.append(new, len(h))), np.diff(first)


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per shard: documents, and postings by term, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for block in text_blocks(batches, "text"):
            text, term, count, length = block_terms(block.column("text"))
            held.append((block.column("id").to_pylist(), text.astype(np.int32), term, count.astype(np.int32), length))
            size += int(block.column("text").nbytes)
            if size >= SHARD_BYTES:
                yield _packed(held)
                held, size = [], 0
        if held:
            yield _packed(held)

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return settle(d.mapInArrow(run, "n_docs long, n_words long, ids binary, lengths binary, terms binary, upto binary, docs binary, counts binary"), "index")


def _packed(held: list) -> pa.RecordBatch:
    """One shard of blocks of documents, which `held` is emptied of."""
    ids = np.array([LAST if i is None else i for h in held for i in h[0]], np.int64)
    sizes = np.cumsum([0] + [len(h[0]) for h in held])
    doc = np.concatenate([h[1] + s for h, s in zip(held, sizes.tolist(), strict=False)])
    term, count = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
    lengths = np.concatenate([h[4] for h in held])
    held.clear()
    # order the documents by their most frequent term, the first of these; terms are in order in a document
    lead = np.zeros(len(ids), np.uint64)
    if len(doc):
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        most = np.repeat(np.maximum.reduceat(count, first), np.diff(np.append(first, len(doc))))
        top = np.flatnonzero(count == most)
        top = top[np.concatenate([[True], doc[top][1:] != doc[top][:-1]])]
        lead[doc[top]] = term[top]
    order = np.lexsort((lengths, lead))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    doc = place[doc]
    by_term = _by_number(doc, len(ids))
    by_term = by_term[np.argsort(term[by_term], kind="stable")]
    doc, term, count = doc[by_term], term[by_term], count[by_term]
    new = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    columns = (ids[order], lengths[order].astype(np.int64), term[new], np.append(new, len(term)).astype(np.int64), doc.astype(np.int32), count.astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array([len(ids)]), pa.array([int(lengths.sum())]), *[pa.array([c.tobytes()], pa.binary()) for c in columns]],
        names=["n_docs", "n_words", "ids", "lengths", "terms", "upto", "docs", "counts"])


@dataclass
class Shard:
    ids: np.ndarray
    lengths: np.ndarray
    terms: np.ndarray
    upto: np.ndarray
    docs: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int) -> Shard:
        kinds = (np.int64, np.int64, np.uint64, np.int64, np.int32, np.int32)
        names = ("ids", "lengths", "terms", "upto", "docs", "counts")
        return cls(*(np.frombuffer(batch.column(c)[i].as_py(), k) for c, k in zip(names, kinds, strict=True)))


@dataclass
class Queries:
    ids: np.ndarray
    vocabulary: np.ndarray  # sorted distinct terms
    query: np.ndarray  # (query, term number) pairs, by query
    term: np.ndarray
    weight: np.ndarray | None = None  # of each vocabulary term
    mean_length: float = 1.0

    def known(self, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
        """Places in the shard's term list of the vocabulary, and the term numbers found."""
        if not len(shard.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(shard.terms, self.vocabulary), len(shard.terms) - 1)
        found = np.flatnonzero(shard.terms[at] == self.vocabulary)
        return at[found], found


def query_blocks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[Queries]:
    """The queries' distinct terms, in blocks of about `QUERY_TERMS`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            text, term, _, _ = block_terms(block.column("text"))
            upto = np.searchsorted(text, np.arange(block.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), pa.ListArray.from_arrays(pa.array(upto), pa.array(term.view(np.int64)))], names=["id", "terms"])

    q = queries.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    q = q.groupBy("id").agg(F.min("text").alias("text"))
    terms = settle(q.mapInArrow(run, "id long, terms array<long>").where(F.size("terms") > 0), "queries")
    total = int(terms.agg(F.sum(F.size("terms"))).first()[0] or 0)
    blocks = total // QUERY_TERMS + 1
    for i in range(blocks):
        part = terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i)
        rows = part.toArrow().combine_chunks()
        if rows.num_rows == 0:
            continue
        lists = rows.column("terms").combine_chunks()
        flat = lists.flatten().to_numpy().view(np.uint64)
        sizes = np.diff(lists.offsets.to_numpy())
        ids = np.array([LAST if x is None else x for x in rows.column("id").to_pylist()], np.int64)
        # neighbours share a vocabulary and need the same blocks: by their commonest term of the block, then by size
        vocabulary, term = np.unique(flat, return_inverse=True)
        query = np.repeat(np.arange(len(ids)), sizes)
        often = np.bincount(term)
        lead = np.lexsort((-often[term], query))
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        order = np.lexsort((ids, sizes, term[lead][first]))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        query = place[query]
        by = np.lexsort((term, query))
        yield Queries(ids[order], vocabulary, query[by].astype(np.int32), term[by].astype(np.int32))


def with_statistics(queries: Queries, shards: DataFrame) -> Queries:
    """Weights of the vocabulary from all shards."""
    total = shards.agg(F.sum("n_docs").alias("n"), F.sum("n_words").alias("w")).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(queries.vocabulary), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard.of(batch, i)
                at, found = queries.known(shard)
                df[found] += shard.upto[at + 1] - shard.upto[at]
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(df[used])], names=["term", "df"])

    counts = shards.select("ids", "lengths", "terms", "upto", "docs", "counts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    rows = counts.toArrow()  # at most QUERY_TERMS numbers
    df = np.zeros(len(queries.vocabulary))
    df[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    n = int(total["n"] or 0)
    queries.weight = np.log(1 + (n - df + 0.5) / (df + 0.5))
    queries.mean_length = max((total["w"] or 0) / max(n, 1), 1e-9)
    return queries


class Best:
    """The best k of each query so far: rounded score, then id. Empty places score 0."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.scores, self.ids = np.zeros((n, k)), np.full((n, k), LAST)
        self.floor = np.zeros(n) if floor is None else floor  # no lower score can be among the k best

    def least(self, lo: int, hi: int) -> np.ndarray:
        """What a score has to reach, for each of the queries `lo:hi`."""
        return np.maximum(self.scores[lo:hi, -1], self.floor[lo:hi])[:, None]

    def add(self, lo: int, hi: int, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge candidates of the queries `lo:hi` (`query` counts from `lo`)."""
        old = self.scores[lo:hi] > 0
        query = np.concatenate([np.nonzero(old)[0], query])
        score, ids = np.concatenate([self.scores[lo:hi][old], score]), np.concatenate([self.ids[lo:hi][old], ids])
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        nth = np.arange(len(query)) - np.searchsorted(query, np.arange(hi - lo))[query]
        keep = nth < self.k
        self.scores[lo:hi], self.ids[lo:hi] = 0, LAST
        self.scores[lo + query[keep], nth[keep]] = score[keep]
        self.ids[lo + query[keep], nth[keep]] = ids[keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, nth = np.nonzero(self.scores > 0)
        return query, self.scores[query, nth], self.ids[query, nth]


def _padded(doc: np.ndarray, value: np.ndarray, upto: np.ndarray, size: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Postings as tables of rows of one width, so that many lists are read as whole rows.

    Returns each term's table and its row there, and the tables `(documents, values)`;
    rows are filled up with the document `none` and the value 0.
    """
    widths = [1]
    while widths[-1] < size.max():
        widths.append(max(widths[-1] + 1, int(widths[-1] * 1.3)))
    kind = np.searchsorted(widths, size).astype(np.int8)
    row, tables = np.zeros(len(size), np.int64), []
    for k, width in enumerate(widths):
        terms = np.flatnonzero(kind == k)
        row[terms] = np.arange(len(terms))
        d, v = np.full((len(terms), width), none, np.int32), np.zeros((len(terms), width))
        place = expand(np.arange(len(terms)) * width, size[terms])
        post = expand(upto[terms], size[terms])
        d.ravel()[place], v.ravel()[place] = doc[post], value[post]
        tables.append((d, v))
    return kind, row, tables


def search_shard(shard: Shard, queries: Queries, best: Best) -> int:
    """Add the shard's documents that can be among the best; returns the number of (query, block) pairs scored."""
    at, number = queries.known(shard)
    if not len(at):
        return 0
    n_docs = len(shard.ids)
    n_blocks = -(-n_docs // BLOCK)
    df = shard.upto[at + 1] - shard.upto[at]
    post = expand(shard.upto[at], df)
    term, doc = np.repeat(np.arange(len(at)), df), shard.docs[post].astype(np.int64)
    tf = shard.counts[post].astype(np.float64)
    del post
    norm = K1 * (1 - B + B * shard.lengths / queries.mean_length)
    value = queries.weight[number][term] * tf * (K1 + 1) / (tf + norm[doc])
    del tf
    # frequent terms by document, in blocks: exact, and in single precision for all but what is reported
    often = df * FREQUENT >= n_docs
    column = np.cumsum(often) - 1
    f = often[term]
    dense = np.zeros((int(often.sum()), n_blocks * BLOCK))
    dense[column[term[f]], doc[f]] = value[f]
    light = dense.astype(np.float32).reshape(-1, n_blocks, BLOCK)
    peak = light.max(axis=2)
    # one block more takes what rows are filled up with
    kind, place, tables = _padded(doc, value, np.cumsum(df) - df, df, n_blocks * BLOCK)
    stride = (n_blocks + 1) * BLOCK
    del term, doc, value, f
    slot = np.full(len(queries.vocabulary), -1, np.int32)
    slot[number] = np.arange(len(at))
    chunk = max(1, min(CHUNK, CELLS // n_docs))
    scored = 0
    for lo in range(0, len(queries.ids), chunk):
        hi = min(lo + chunk, len(queries.ids))
        a, b = np.searchsorted(queries.query, np.array([lo, hi], queries.query.dtype))
        q, s = queries.query[a:b].astype(np.int64) - lo, slot[queries.term[a:b]]
        found = s >= 0
        q, s = q[found], s[found]
        if not len(s):
            continue
        # only the frequent terms that this chunk asks for often
        by_block = often[s]
        asked = np.bincount(column[s[by_block]], minlength=len(dense))
        shared = asked * df[often] * SHARED >= (hi - lo) * n_docs
        by_block[by_block] = shared[column[s[by_block]]]
        used = np.flatnonzero(shared)
        wants = np.zeros((hi - lo, len(used)), np.float32)
        wants[q[by_block], (np.cumsum(shared) - 1)[column[s[by_block]]]] = 1
        # the others by their postings
        q, s = q[~by_block], s[~by_block]
        order = np.argsort(kind[s], kind="stable")
        q, s = q[order], s[order]
        cuts = np.searchsorted(kind[s], np.arange(len(tables) + 1)).tolist()
        rare = np.zeros((hi - lo) * stride)
        for (docs, values), x, y in zip(tables, cuts, cuts[1:], strict=False):
            step = max(1, POSTINGS // docs.shape[1])
            for i in range(x, y, step):
                at_once = slice(i, min(i + step, y))
                rows = place[s[at_once]]
                to = docs.take(rows, axis=0) + (q[at_once] * stride)[:, None]
                np.add.at(rare, to.ravel(), values.take(rows, axis=0).ravel())
        rare = rare.reshape(hi - lo, n_blocks + 1, BLOCK)
        # no sum of so many positive numbers in single precision is off by more
        off = 1 + (len(used) + 8) * 2.0 ** -23
        least = best.least(lo, hi)
        bound = wants @ peak[used] + rare[:, :-1].max(axis=2)
        open_ = (bound > 0) & (bound * off >= least - 10.0 ** -DIGITS)
        scored += int(open_.sum())
        needed = open_.sum(axis=0)
        wide = needed * WIDE >= hi - lo
        for picked in (np.flatnonzero(wide), np.flatnonzero((needed > 0) & ~wide)):
            rows = np.flatnonzero(open_[:, picked].any(axis=1))
            if not len(rows):
                continue
            size = len(picked) * BLOCK
            score = wants[rows] @ light[used[:, None], picked].reshape(len(used), size) + rare[rows[:, None], picked].reshape(len(rows), size)
            reach = np.maximum((best.least(lo, hi)[rows] - 10.0 ** -DIGITS) / off, np.finfo(float).tiny)
            row, col = np.nonzero(score >= reach)
            # the k-th best here or so far, whichever is higher
            if len(row) > 4 * best.k * len(rows) and size > best.k:
                here = -np.partition(-score, best.k - 1, axis=1)[:, best.k - 1:best.k]
                row, col = np.nonzero(score >= np.maximum(reach, (here / off - 10.0 ** -DIGITS) / off))
            if not len(row):
                continue
            block, nth = picked[col // BLOCK], col % BLOCK
            row, doc = rows[row], block * BLOCK + nth
            exact = rare[row, block, nth]
            step = max(1, CELLS // max(len(used), 1))
            for i in range(0, len(row), step):
                exact[i:i + step] += np.einsum("ij,ji->i", wants[row[i:i + step]], dense[used[:, None], doc[i:i + step]])
            exact = np.round(exact, DIGITS)
            fits = (exact > 0) & (exact >= best.floor[lo + row])
            best.add(lo, hi, row[fits], exact[fits], shard.ids[doc[fits]])
    return scored


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
          query_id: str = "doc_id", query_text: str = "text") -> DataFrame:
    """`(query_id, rank, doc_id, score)`: the k best documents of each query."""
    shards = index(docs, id_col, text_col)
    parts = None
    for block in query_blocks(queries, query_id, query_text):
        q = with_statistics(block, shards)
        # written before the next block is read, so that one block at a time is on the driver
        found = settle(_ranked(_pilot_then_rest(shards, q, k), k), "answers")
        parts = found if parts is None else parts.union(found)
    if parts is None:
        return docs.sparkSession.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    return parts  # a query is in one block


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _pilot_then_rest(shards: DataFrame, queries: Queries, k: int) -> DataFrame:
    """Candidates from all shards: one in `PILOT` first, whose k-th best scores are the floor for the others.

    A task then reports only what can still be among the best, instead of its
    own k best for each query.
    """
    pilot = F.pmod(F.xxhash64("ids"), F.lit(PILOT)) == 0
    tasks = shards.where(pilot).count() // SHARDS_PER_PILOT_TASK + 1
    first = settle(_ranked(_searched(shards.where(pilot).coalesce(tasks), queries, k), k).drop("rank"), "pilot")
    # one number a query of the block
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).where(F.col("n") == k).toArrow()
    place = {x: i for i, x in enumerate(queries.ids.tolist())}
    floor = np.zeros(len(queries.ids))
    for query, score in zip(kth.column("query_id").to_pylist(), kth.column("score").to_pylist(), strict=True):
        floor[place[LAST if query is None else query]] = score
    return first.union(_searched(shards.where(~pilot), queries, k, floor))


def _searched(shards: DataFrame, queries: Queries, k: int, floor: np.ndarray | None = None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries.ids), k, floor)
        for batch in batches:
            for i in range(batch.num_rows):
                search_shard(Shard.of(batch, i), queries, best)
        give_back()
        query, score, ids = best.rows()
        columns = [queries.ids[query], ids]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(c, mask=c == LAST) for c in columns], pa.array(score)], names=["query_id", "doc_id", "score"])

    return shards.select("ids", "lengths", "terms", "upto", "docs", "counts").mapInArrow(run, "query_id long, doc_id long, score double")
