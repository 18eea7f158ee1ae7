"""Ranked lexical search: MaxScore whose bounds come from pairs of terms.

The score of a document for an item is a sum over the item's terms, repeats
included, of w * ((10**9 * tf) div (1000 * tf + 12 * m)); see `weights` and
`Scorer` for w and m. All of it is integer arithmetic.

1. `index`: one row per shard (a few MB of text) with the postings of each
   term, the documents in order of their most frequent term.
2. `statistics`: document counts of all terms, the number of documents, and of
   their terms, over all shards.
3. `with_pairs`: in each shard the `HEAVY` longest lists among the corpus's
   `COMMON` most frequent terms are intersected pair by pair. A pair's list
   holds, for each block of `BLOCK` documents where both terms meet, the
   greatest joint impact of one document. Where no document has both terms,
   the list is empty and the pair's bound is that of the better term alone.
4. `search_shard`: the terms of a query stand in order of their greatest
   impact. Terms form couples where the pair list lowers the bound; the bound
   of a set of terms is the sum over its couples and single terms. The longest
   beginning of the order whose bound is below the k-th best score so far is
   not essential: a document with none of the other terms cannot be among the
   best. Documents of the other terms are completed term by term, and dropped
   when their score and what the rest can add in their block is below it.
5. A first pass over one shard in `PILOT` gives each query a score to beat in
   all others; the tasks' lists are merged by score, then id.

Queries travel in blocks of at most `QUERY_TERMS` terms; the result of a block
is written before the next one is read. Terms are compared by 64-bit hashes.

Defined results: null and empty texts have no terms, are not counted and are
found by no query; a document with score 0 is in no answer; a null document id
is reported as null, after equal scores with an id; of items that share an id
the one with the least text counts; repeated documents are ranked one by one;
empty tables give no rows; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytelane.llm.store import settle
from bytelane.llm.words import ALNUM, LOWER, expand, prefix_hash, span_hashes, split_words, text_blocks, text_buffer

SHARD_BYTES = 4 << 20
BLOCK = 64  # documents under one joint maximum
COMMON = 4096  # terms of the whole corpus that may form pairs
HEAVY = 48  # of these, the longest lists of a shard, paired with each other
QUERY_TERMS = 1_000_000
PILOT = 8
SHARDS_PER_PILOT_TASK = 8
LAST = (1 << 63) - 1  # stands for a null id


def _bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`(text, term, count)` of the texts' terms, by text and term; and the number of terms of each text."""
    raw, offsets = text_buffer(texts)
    raw = LOWER[raw]
    starts, ends, first = split_words(raw, offsets, ALNUM)
    term, text = span_hashes(prefix_hash(raw), starts, ends), np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((term, text))
    term, text = term[order], text[order]
    new = np.flatnonzero(_changes(text) | _changes(term))
    return text[new], term[new], np.diff(np.append(new, len(term))), np.diff(first)


def _changes(x: np.ndarray) -> np.ndarray:
    """True where a value differs from the one before."""
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1]
    return out


SHARD = "ids binary, lengths binary, terms binary, upto binary, docs binary, counts binary"
PAIRS = "pair_terms binary, pair_upto binary, pair_blocks binary, pair_peaks binary"
KINDS = {"ids": np.int64, "lengths": np.int64, "terms": np.uint64, "upto": np.int64, "docs": np.int32, "counts": np.int32,
         "pair_terms": np.int32, "pair_upto": np.int32, "pair_blocks": np.int32, "pair_peaks": np.int64}


def _row(n_docs: int, n_terms: int, **columns: np.ndarray) -> pa.RecordBatch:
    packed = [pa.array([np.ascontiguousarray(columns[c].astype(KINDS[c])).tobytes()], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64()), *packed], names=["n_docs", "n_terms", *columns])


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per shard; documents without terms are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for block in text_blocks(batches, "text"):
            held.append((block.column("id").to_numpy(zero_copy_only=False), *_bags(block.column("text"))))
            size += int(block.column("text").nbytes)
            if size >= SHARD_BYTES:
                yield _shard(held)
                held, size = [], 0
        if held:
            yield _shard(held)

    d = docs.where(F.length(text_col) > 0).select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.col(text_col).alias("text"))
    return settle(d.mapInArrow(run, f"n_docs long, n_terms long, {SHARD}"), "ranked-index")


def _shard(held: list) -> pa.RecordBatch:
    before = np.cumsum([0] + [len(h[0]) for h in held])
    ids, lengths = np.concatenate([h[0] for h in held]), np.concatenate([h[4] for h in held])
    doc = np.concatenate([h[1] + b for h, b in zip(held, before, strict=False)])
    term, count = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
    # neighbours share their most frequent term, so that a block's maxima are tight
    by = np.lexsort((term, -count, doc))
    lead = np.zeros(len(ids), np.uint64)
    lead[doc[by][_changes(doc[by])]] = term[by][_changes(doc[by])]
    order = np.lexsort((lengths, lead))
    order = order[lengths[order] > 0]
    place = np.full(len(ids), -1, np.int64)
    place[order] = np.arange(len(order))
    doc = place[doc]
    by = np.lexsort((doc, term))
    doc, term, count = doc[by], term[by], count[by]
    new = np.flatnonzero(_changes(term))
    return _row(len(order), int(lengths.sum()), ids=ids[order], lengths=lengths[order], terms=term[new], upto=np.append(new, len(term)), docs=doc, counts=count)


@dataclass
class Shard:
    ids: np.ndarray
    lengths: np.ndarray
    terms: np.ndarray
    upto: np.ndarray
    docs: np.ndarray
    counts: np.ndarray
    pair_terms: np.ndarray | None = None  # 2 term numbers a pair
    pair_upto: np.ndarray | None = None
    pair_blocks: np.ndarray | None = None
    pair_peaks: np.ndarray | None = None

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int) -> Shard:
        return cls(**{c: np.frombuffer(batch.column(c)[i].as_py(), KINDS[c]) for c in KINDS if c in batch.schema.names})

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers in this shard of those `terms` that it has, and their places among `terms`."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        found = np.flatnonzero(self.terms[at] == terms)
        return at[found], found

    def impacts(self, number: np.ndarray, weight: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`(docs, impacts, upto)` of the postings of the given terms, term after term."""
        n = self.upto[number + 1] - self.upto[number]
        post = expand(self.upto[number], n)
        doc, tf = self.docs[post].astype(np.int64), self.counts[post].astype(np.int64)
        return doc, np.repeat(weight, n) * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])), np.concatenate([[0], np.cumsum(n)])


@dataclass
class Scorer:
    """Corpus statistics: N documents and L terms in all."""

    n: int
    length: int

    def weights(self, df: np.ndarray) -> np.ndarray:
        return np.floor(1000 * np.log((2 * self.n + 2) / (2 * df + 1))).astype(np.int64)

    def m(self, lengths: np.ndarray) -> np.ndarray:
        return 100 - 25 + (25 * lengths * self.n) // max(self.length, 1)


def statistics(shards: DataFrame) -> tuple[Scorer, DataFrame]:
    """The corpus's size, and `(term, df)` of every term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                terms, upto = (np.frombuffer(batch.column(c)[i].as_py(), KINDS[c]) for c in ("terms", "upto"))
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(np.diff(upto))], names=["term", "df"])

    total = shards.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    counts = shards.select("terms", "upto").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return Scorer(int(total["n"] or 0), int(total["l"] or 0)), settle(counts, "ranked-terms")


def with_pairs(shards: DataFrame, scorer: Scorer, counts: DataFrame) -> DataFrame:
    """The shards with their pair lists."""
    common = counts.orderBy(F.desc("df"), "term").limit(COMMON).toArrow()  # at most COMMON rows
    terms = common.column("term").to_numpy().view(np.uint64)
    order = np.argsort(terms)
    terms, weight = terms[order], scorer.weights(common.column("df").to_numpy()[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lists = pair_lists(Shard.of(batch, i), terms, weight, scorer)
                row = batch.slice(i, 1)
                packed = [pa.array([np.ascontiguousarray(v.astype(KINDS[c])).tobytes()], pa.binary()) for c, v in lists.items()]
                yield pa.RecordBatch.from_arrays([*row.columns, *packed], names=[*row.schema.names, *lists])

    names = [c.split()[0] for c in SHARD.split(", ")]
    return settle(shards.select(*names).mapInArrow(run, f"{SHARD}, {PAIRS}"), "ranked-pairs")


def pair_lists(shard: Shard, terms: np.ndarray, weight: np.ndarray, scorer: Scorer) -> dict[str, np.ndarray]:
    """Blocks where the shard's heaviest terms meet, pair by pair, with the greatest joint impact."""
    number, found = shard.find(terms)
    n = shard.upto[number + 1] - shard.upto[number] if len(number) else np.zeros(0, np.int64)
    heavy = np.sort(np.lexsort((number, -n))[:HEAVY])
    number, weight = number[heavy], weight[found][heavy]
    doc, impact, upto = shard.impacts(number, weight, scorer.m(shard.lengths))
    n_docs, k = len(shard.ids), len(number)
    dense = np.zeros((k, n_docs), np.int64)
    dense[np.repeat(np.arange(k), np.diff(upto)), doc] = impact
    # a weight of 0 still is a list of the term, so presence is kept apart
    there = np.zeros((k, n_docs), bool)
    there[np.repeat(np.arange(k), np.diff(upto)), doc] = True
    cuts = np.arange(0, n_docs, BLOCK)
    pairs, sizes, blocks, peaks = [], [], [], []
    for a in range(k - 1):
        joint = np.where(there[a + 1:] & there[a], dense[a + 1:] + dense[a], -1)
        peak = np.maximum.reduceat(joint, cuts, axis=1)
        b, block = np.nonzero(peak >= 0)
        pairs += [(number[a], number[c]) for c in range(a + 1, k)]
        sizes += np.bincount(b, minlength=k - 1 - a).tolist()
        blocks.append(block)
        peaks.append(peak[b, block])
    empty = [np.zeros(0, np.int64)]
    return {"pair_terms": np.array(pairs, np.int64).reshape(-1, 2).ravel(), "pair_upto": np.cumsum([0, *sizes]),
            "pair_blocks": np.concatenate(blocks or empty), "pair_peaks": np.concatenate(peaks or empty)}


@dataclass
class Queries:
    """A block of queries: `(query, term number, times)` by query."""

    ids: np.ndarray
    vocabulary: np.ndarray
    weight: np.ndarray
    upto: np.ndarray
    term: np.ndarray
    times: np.ndarray


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`(id, part, terms, times)`: the items' terms as a table; `part` deals the items to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            text, term, times, _ = _bags(block.column("text"))
            upto = pa.array(np.searchsorted(text, np.arange(block.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), pa.ListArray.from_arrays(upto, pa.array(term.view(np.int64))), pa.ListArray.from_arrays(upto, pa.array(times.astype(np.int64)))],
                names=["id", "terms", "times"])

    q = items.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    q = q.groupBy("id").agg(F.min("text").alias("text"))
    return settle(q.mapInArrow(run, "id long, terms array<long>, times array<long>").where(F.size("terms") > 0), "ranked-queries")


def query_blocks(queries: DataFrame, counts: DataFrame, scorer: Scorer) -> Iterator[Queries]:
    """Blocks of about `QUERY_TERMS` terms, one on the driver at a time."""
    total = int(queries.agg(F.sum(F.size("terms"))).first()[0] or 0)
    blocks = total // QUERY_TERMS + 1
    for i in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i)
        rows = part.toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        asked = part.select(F.explode("terms").alias("term")).distinct()
        known = counts.join(asked, "term", "left_semi").toArrow()  # at most a block's terms
        terms, times = (rows.column(c).combine_chunks() for c in ("terms", "times"))
        vocabulary, term = np.unique(terms.flatten().to_numpy().view(np.uint64), return_inverse=True)
        weight = np.zeros(len(vocabulary), np.int64)
        weight[np.searchsorted(vocabulary, known.column("term").to_numpy().view(np.uint64))] = scorer.weights(known.column("df").to_numpy())
        yield Queries(rows.column("id").to_numpy(), vocabulary, weight, terms.offsets.to_numpy(), term, times.flatten().to_numpy())


class Best:
    """The best k documents of each query so far: score, then id."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.scores, self.ids = k, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n
        self.floor = np.ones(n, np.int64) if floor is None else np.maximum(floor, 1)

    def least(self, q: int) -> int:
        """A document needs this score at least."""
        return max(int(self.floor[q]), int(self.scores[q][-1]) if len(self.scores[q]) == self.k else 1)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        top = np.lexsort((ids, -scores))[:self.k]
        self.scores[q], self.ids[q] = scores[top], ids[top]


class Pairs:
    """Where a shard's pair of terms has its list, and the list's greatest joint impact."""

    def __init__(self, shard: Shard):
        # the pairs stand in the order (0, 1), (0, 2) .. (1, 2) ..
        pairs = shard.pair_terms.reshape(-1, 2)
        heavy = np.unique(pairs)
        self.slot = {t: i for i, t in enumerate(heavy.tolist())}
        self.k = len(heavy)
        sizes = np.diff(shard.pair_upto)
        self.most = np.full(len(pairs), -1, np.int64)
        if sizes.any():
            self.most[sizes > 0] = np.maximum.reduceat(shard.pair_peaks, shard.pair_upto[:-1][sizes > 0])

    def of(self, s: int, t: int) -> int:
        a, b = sorted((self.slot[s], self.slot[t]))
        return a * self.k - a * (a + 1) // 2 + b - a - 1


class Bounds:
    """What the first terms of a query's order can add, from single maxima and couples.

    `order` holds the terms' numbers in the shard by rising `peak` (greatest
    impact, times included). Couples are chosen once for a query, those that
    lower the bound most first, each term in one couple at most. A couple
    counts for a beginning of the order that holds both its terms.
    """

    def __init__(self, shard: Shard, pairs: Pairs, order: np.ndarray, peak: np.ndarray, times: np.ndarray):
        n_blocks = -(-len(shard.ids) // BLOCK)
        heavy = [i for i in range(len(order)) if int(order[i]) in pairs.slot]
        saved = []
        for x, i in enumerate(heavy):
            for j in heavy[x + 1:]:
                p = pairs.of(int(order[i]), int(order[j]))
                gain = int(peak[i] + peak[j] - self._joint(pairs.most[p:p + 1], peak[[i, j]], times[[i, j]])[0])
                if gain > 0:
                    saved.append((gain, i, j, p))
        taken: set[int] = set()
        # bound of the first r terms, over the shard and in each block
        self.upto = np.concatenate([[0], np.cumsum(peak)])
        self.in_block = np.repeat(self.upto[:, None], n_blocks, axis=1) if saved else None
        for gain, i, j, p in sorted(saved, reverse=True):
            if i in taken or j in taken:
                continue
            taken |= {i, j}
            self.upto[j + 1:] -= gain
            lo, hi = shard.pair_upto[p], shard.pair_upto[p + 1]
            cut = np.full(n_blocks, min(peak[i], peak[j]))  # where the two never meet
            cut[shard.pair_blocks[lo:hi]] = peak[i] + peak[j] - self._joint(shard.pair_peaks[lo:hi], peak[[i, j]], times[[i, j]])
            self.in_block[j + 1:] -= cut

    @staticmethod
    def _joint(most: np.ndarray, peak: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Greatest sums of two terms that together reach `most` (-1: they never meet), each asked for `times`."""
        both = times.min()
        met = both * most + (peak // times * (times - both)).sum()
        return np.where(most < 0, peak.max(), np.clip(met, peak.max(), peak.sum()))

    def of(self, r: int, docs: np.ndarray) -> np.ndarray | int:
        """What the first `r` terms can add to each of the documents."""
        return self.upto[r] if self.in_block is None else self.in_block[r][docs // BLOCK]


def search_shard(shard: Shard, queries: Queries, scorer: Scorer, best: Best) -> tuple[int, int]:
    """Add the shard's documents that can be among the best; returns the numbers of postings used and of all postings of the queries' terms."""
    number, found = shard.find(queries.vocabulary)
    if not len(number):
        return 0, 0
    doc, impact, upto = shard.impacts(number, queries.weight[found], scorer.m(shard.lengths))
    slot = np.full(len(queries.vocabulary), -1, np.int64)
    slot[found] = np.arange(len(found))
    top = np.maximum.reduceat(impact, upto[:-1])
    pairs = Pairs(shard)
    used = seen = 0
    score = np.zeros(len(shard.ids), np.int64)
    for q in range(len(queries.ids)):
        lo, hi = queries.upto[q], queries.upto[q + 1]
        own, times = slot[queries.term[lo:hi]], queries.times[lo:hi]
        own, times = own[own >= 0], times[own >= 0]
        if not len(own):
            continue
        order = np.argsort(top[own] * times, kind="stable")
        own, times = own[order], times[order]
        peak = top[own] * times
        bounds = Bounds(shard, pairs, number[own], peak, times)
        least = best.least(q)
        # the first r terms are not essential; couples make the bound of a longer beginning the smaller one at times
        r = int(np.flatnonzero(bounds.upto < least)[-1])
        seen += int((upto[own + 1] - upto[own]).sum())
        if r == len(own):
            continue
        for t, c in zip(own[r:], times[r:], strict=True):
            score[doc[upto[t]:upto[t + 1]]] += impact[upto[t]:upto[t + 1]] * c
            used += int(upto[t + 1] - upto[t])
        docs = np.flatnonzero(score)  # a document that the essential terms give nothing is below `least`
        while True:
            docs_score = score[docs]
            keep = docs_score + bounds.of(r, docs) >= least
            if not keep.all():
                score[docs[~keep]] = 0
                docs = docs[keep]
            if r == 0 or not len(docs):
                break
            r -= 1
            t = own[r]
            d = doc[upto[t]:upto[t + 1]]
            at = np.minimum(np.searchsorted(d, docs), len(d) - 1)
            hit = d[at] == docs
            score[docs[hit]] += impact[upto[t] + at[hit]] * times[r]
            used += int(hit.sum())
        if len(docs):
            best.add(q, score[docs], shard.ids[docs])
            score[docs] = 0
    return used, seen


def _searched(shards: DataFrame, queries: Queries, scorer: Scorer, k: int, floor: np.ndarray | None = None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries.ids), k, floor)
        for batch in batches:
            for i in range(batch.num_rows):
                search_shard(Shard.of(batch, i), queries, scorer, best)
        sizes = [len(s) for s in best.scores]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(queries.ids, sizes)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))],
            names=["item_id", "doc_id", "score"])

    return shards.mapInArrow(run, "item_id long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def top_k(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
          item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """`(item_id, rank, doc_id, score)`: the k best documents of each item."""
    shards = index(docs, id_col, text_col)
    scorer, counts = statistics(shards)
    shards = with_pairs(shards, scorer, counts)
    queries = query_terms(items, item_id, item_text)
    parts = []
    for block in query_blocks(queries, counts, scorer):
        pilot = F.pmod(F.xxhash64("ids"), F.lit(PILOT)) == 0
        tasks = shards.where(pilot).count() // SHARDS_PER_PILOT_TASK + 1
        first = settle(_ranked(_searched(shards.where(pilot).coalesce(tasks), block, scorer, k), k).drop("rank"), "ranked-pilot")
        # one number a query of the block
        floor = np.zeros(len(block.ids), np.int64)
        place = {x: i for i, x in enumerate(block.ids.tolist())}
        for r in first.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).where(F.col("n") == k).collect():
            floor[place[r["item_id"]]] = r["score"]
        rest = _searched(shards.where(~pilot), block, scorer, k, floor)
        parts.append(settle(_ranked(first.union(rest), k), "ranked-answers"))
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    null = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
    return out.select(null("item_id"), "rank", null("doc_id"), "score")
