"""Near-duplicate vectors by a subspace pigeonhole join.

Two unit vectors with cosine c are at squared distance 2 - 2 c. The vectors are
rotated and cut into blocks of `BLOCK_DIMS` coordinates; each block has its
share of the squared distance that `threshold` allows, in proportion to its
coordinates. Two vectors within the whole budget are within the share of at
least one block, so the union of the blocks' range joins loses no link.

1. `classes`: rows with equal label and vector are one class with its copies.
2. Layout: a bounded sample gives, for each label and block, a k-d tree whose
   leaves hold about `PIECE` vectors. It decides where work is done, never
   what is found.
3. Range join of a block: a vector is at home in one leaf and visits every
   leaf within the block's radius. Leaves with more than `PIECE` homes or
   visitors are cut into pieces by a hash, and each pair of pieces is a task
   group of its own, so a crowded label or cluster is spread.
4. In a group, pairs within the block's share are candidates. A pair is looked
   at in one block only, the one where it is closest in proportion (least
   number first), which the pigeonhole principle puts among its candidates; so
   the union needs no comparison of pair lists. The cosine of every candidate
   is then computed in double precision from the vectors themselves.
5. A group reports the number of links of each home vector, and a spanning
   forest of its links (fewer edges than vectors) instead of the links.
   Components of the forests are found by `components`.

The rotation is a seeded sign flip and a Walsh-Hadamard transform, made of
sums in a fixed order, so every task sees the same coordinates. Cluster cost:
pairs of different vectors that are close are compared in numpy one by one,
which grows with the square of a cluster; no pair is ever a row of a table.

Defined results: null vectors, zero vectors and those with null or non-finite
entries link with nothing, and so do rows with a null label, and vectors of
different lengths; each row counts by itself, also with a null or repeated id;
a component with no id at all has null as component id; a row is kept if its
id is the component's (for null ids: if the component has none); columns
beside id, vector and label are dropped; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelane.llm.components import components
from bytelane.llm.copies import join_back
from bytelane.llm.store import settle

THRESHOLD = 0.93
BLOCK_DIMS = 8
PIECE = 16_384  # vectors of one kind in a group
SAMPLE = 20_000  # rows that the layout is made from
LEAF_SAMPLE = 8  # a leaf is not cut further below so many sampled vectors
PAIRS = 1 << 16  # candidates that are verified at once
SEED = 11
SLACK = 1e-9  # of squared distances, far above their rounding


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    """Unit vectors, summed coordinate by coordinate, so that a row's result does not depend on its neighbours."""
    x = x / np.abs(x).max(axis=1, initial=0)[:, None]
    total = np.zeros(len(x))
    for i in range(x.shape[1]):
        total += x[:, i] * x[:, i]
    return x / np.sqrt(total)[:, None]


def rotated(units: np.ndarray) -> np.ndarray:
    """The vectors after sign flips and a Walsh-Hadamard transform, padded with zeros to a power of two."""
    n, d = units.shape
    size = max(BLOCK_DIMS, 1 << max(d - 1, 0).bit_length())
    signs = np.random.default_rng(SEED).integers(0, 2, size) * 2.0 - 1
    out = np.zeros((n, size))
    out[:, :d] = units * signs[:d]
    h = 1
    while h < size:
        pairs = out.reshape(n, -1, 2, h)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
        h *= 2
    return out / np.sqrt(size)


def _share(size: int, threshold: float) -> float:
    """Squared distance that one block of the rotated vectors may use."""
    return (2 - 2 * threshold) * BLOCK_DIMS / size + SLACK


@dataclass
class Leaf:
    number: int
    homes: float
    home_pieces: int = 1
    visitor_pieces: int = 1


@dataclass
class Node:
    """A cut of one block's space, or a leaf."""

    leaf: Leaf | None = None
    dim: int = 0
    at: float = 0.0
    low: Node | None = None
    high: Node | None = None

    @classmethod
    def grow(cls, points: np.ndarray, scale: float, leaves: list[Leaf]) -> Node:
        """`scale`: rows that a sampled point stands for."""
        if len(points) * scale > PIECE and len(points) >= 2 * LEAF_SAMPLE:
            dim = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
            at = float(np.median(points[:, dim]))
            low = points[:, dim] < at
            if 0 < low.sum() < len(points):
                return cls(None, dim, at, cls.grow(points[low], scale, leaves), cls.grow(points[~low], scale, leaves))
        leaves.append(Leaf(len(leaves), len(points) * scale))
        return cls(leaves[-1])

    def visit(self, x: np.ndarray, rows: np.ndarray, away: np.ndarray, home: np.ndarray, share: float) -> Iterator[tuple[Leaf, np.ndarray, np.ndarray]]:
        """`(leaf, rows, at home)` for every leaf within the share; `away`: distance to the node's box in each coordinate."""
        if not len(rows):
            return
        if self.leaf is not None:
            yield self.leaf, rows, home
            return
        beyond = x[rows, self.dim] - self.at
        for child, own in ((self.low, beyond < 0), (self.high, beyond >= 0)):
            far = away.copy()
            far[~own, self.dim] = np.maximum(far[~own, self.dim], np.abs(beyond[~own]))
            near = (far * far).sum(axis=1) <= share + SLACK
            yield from child.visit(x, rows[near], far[near], (home & own)[near], share)


@dataclass
class Layout:
    """Trees by (label, length), one for each block."""

    trees: dict[tuple[int, int], list[Node]]

    def by_tree(self, labels: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, list[Node] | None]]:
        """The rows of each label that has trees, and the rows of all others together."""
        known = [label for label, s in self.trees if s == size]
        for label in np.intersect1d(labels, known).tolist():
            yield np.flatnonzero(labels == label), self.trees[label, size]
        rest = np.flatnonzero(~np.isin(labels, known))
        if len(rest):
            yield rest, None


def layout(groups: DataFrame, threshold: float) -> Layout:
    """Trees from at most about `SAMPLE` sampled classes."""
    total = groups.count()
    rows = groups.select("label", "v").where(F.pmod(F.xxhash64("cid"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / max(total, 1)))).limit(2 * SAMPLE).toArrow().combine_chunks()
    if not rows.num_rows:
        return Layout({})
    scale = total / rows.num_rows
    labels, sizes = rows.column("label").to_numpy(), np.array([len(v) for v in rows.column("v")])
    trees: dict[tuple[int, int], list[Node]] = {}
    for label, size in {*zip(labels.tolist(), sizes.tolist(), strict=True)}:
        own = pa.array(np.flatnonzero((labels == label) & (sizes == size)))
        if len(own) * scale <= PIECE:
            continue
        x = rotated(_units(_matrix(rows.column("v").combine_chunks().take(own))))
        share = _share(x.shape[1], threshold)
        trees[label, x.shape[1]] = own_trees = []
        for b in range(x.shape[1] // BLOCK_DIMS):
            part, leaves = x[:, b * BLOCK_DIMS:(b + 1) * BLOCK_DIMS], []
            tree = Node.grow(part, scale, leaves)
            for leaf, at, _ in tree.visit(part, np.arange(len(part)), np.zeros_like(part), np.ones(len(part), bool), share):
                leaf.home_pieces, leaf.visitor_pieces = int(leaf.homes / PIECE) + 1, int(len(at) * scale / PIECE) + 1
            own_trees.append(tree)
    return Layout(trees)


def classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """`(cid, label, v, copies, least_id)`: the distinct vectors of each label, numbered."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = v.where(_usable())
    return settle(usable.groupBy("label", "v").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least_id"))
                  .withColumn("cid", F.monotonically_increasing_id()), "classes")


def _usable() -> F.Column:
    """Labelled, whole, finite and not all zero."""
    sound = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & sound & F.exists("v", lambda e: e != 0), F.lit(False))


PLACED = "label long, block int, size int, leaf int, p int, q int, home boolean, visitor boolean, cid long, copies long, v array<double>"


def placed(groups: DataFrame, plan: Layout, threshold: float) -> DataFrame:
    """The classes at their leaves: once at home, once at each leaf they visit, for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            for d in np.unique(sizes).tolist():
                own = batch.take(pa.array(np.flatnonzero(sizes == d)))
                x, labels = rotated(_units(_matrix(own.column("v")))), own.column("label").to_numpy()
                mixed = _mixed(own.column("cid").to_numpy())
                for rows, trees in plan.by_tree(labels, x.shape[1]):
                    for block in range(x.shape[1] // BLOCK_DIMS):
                        for leaf, at, home in _places(x[rows], trees, block, _share(x.shape[1], threshold)):
                            yield from _sent(own, block, x.shape[1], leaf, rows[at], home, mixed[rows[at]])

    return groups.select("label", "cid", "copies", "v").mapInArrow(run, PLACED)


def _mixed(cid: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = cid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(33)).astype(np.int64)


def _places(x: np.ndarray, trees: list[Node] | None, block: int, share: float) -> Iterator[tuple[Leaf, np.ndarray, np.ndarray]]:
    rows, home = np.arange(len(x)), np.ones(len(x), bool)
    if trees is None:
        yield Leaf(0, 0.0), rows, home  # one piece
    else:
        part = x[:, block * BLOCK_DIMS:(block + 1) * BLOCK_DIMS]
        yield from trees[block].visit(part, rows, np.zeros_like(part), home, share)


def _sent(own: pa.RecordBatch, block: int, size: int, leaf: Leaf, rows: np.ndarray, home: np.ndarray, mixed: np.ndarray) -> Iterator[pa.RecordBatch]:
    a, b = leaf.home_pieces, leaf.visitor_pieces
    p, q = mixed % a, mixed // 64 % b
    if a == b == 1:
        out = [(rows, p, q, home, np.ones(len(rows), bool))]
    else:
        out = [(rows[home], p[home], np.full(int(home.sum()), j), home[home], ~home[home]) for j in range(b)]
        out += [(rows, np.full(len(rows), i), q, np.zeros(len(rows), bool), np.ones(len(rows), bool)) for i in range(a)]
    for at, p_, q_, is_home, is_visitor in out:
        if len(at):
            part = own.take(pa.array(at))
            block_, size_, leaf_ = (pa.array(np.full(len(at), x, np.int32)) for x in (block, size, leaf.number))
            yield pa.RecordBatch.from_arrays(
                [part.column("label"), block_, size_, leaf_, pa.array(p_, pa.int32()), pa.array(q_, pa.int32()),
                 pa.array(is_home), pa.array(is_visitor), part.column("cid"), part.column("copies"), part.column("v")],
                names=[c.split()[0] for c in PLACED.split(", ")])


class Forest:
    """Least reachable node of each of `n` nodes under links that come in batches."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def join_group(cid: np.ndarray, copies: np.ndarray, x: np.ndarray, home: np.ndarray, visitor: np.ndarray, block: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`(links of each home row, ends a, ends b of a spanning forest)` among the links that belong to `block`."""
    units = _units(x)
    turned = rotated(units)
    share = _share(turned.shape[1], threshold)
    blocks = turned.reshape(len(x), -1, BLOCK_DIMS)
    part = blocks[:, block]
    norm = (part * part).sum(axis=1)
    h, v = np.flatnonzero(home), np.flatnonzero(visitor)
    links, forest = np.zeros(len(x), np.int64), Forest(len(x))
    step = max(1, (1 << 22) // max(len(h), 1))
    for at in range(0, len(v), step):
        w = v[at:at + step]
        near = norm[h][:, None] + norm[w] - 2 * (part[h] @ part[w].T) <= share + SLACK
        near &= cid[h][:, None] != cid[w]
        i, j = np.nonzero(near)
        for lo in range(0, len(i), PAIRS):
            a, b = h[i[lo:lo + PAIRS]], w[j[lo:lo + PAIRS]]
            apart = blocks[a] - blocks[b]
            apart = (apart * apart).sum(axis=2)
            own = np.argmin(apart, axis=1) == block
            a, b = a[own], b[own]
            linked = np.einsum("ij,ij->i", units[a], units[b]) >= threshold
            a, b = a[linked], b[linked]
            links += np.bincount(a, copies[b], len(x)).astype(np.int64)
            forest.link(a, b)
    below = np.flatnonzero(forest.root != np.arange(len(x)))
    return links[h], below, forest.root[below]


def links(groups: DataFrame, threshold: float) -> DataFrame:
    """`(kind, a, b)`: kind 0 says that class a has b links in one group, kind 1 that the classes a and b are linked."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        cid, home = group.column("cid").to_numpy(), group.column("home").to_numpy()
        column = lambda c: group.column(c).to_numpy()
        found, a, b = join_group(
            cid, column("copies"), _matrix(group.column("v").combine_chunks()), home, column("visitor"), int(column("block")[0]), threshold)
        some = found > 0
        kind = np.repeat([0, 1], [int(some.sum()), len(a)])
        return pa.table({
            "kind": pa.array(kind, pa.int32()), "a": np.concatenate([cid[home][some], cid[a]]), "b": np.concatenate([found[some], cid[b]])})

    keys = ["label", "size", "block", "leaf", "p", "q"]
    p = placed(groups, layout(groups, threshold), threshold)
    # classes of different lengths that are padded to one size do not meet
    return settle(p.withColumn("d", F.size("v")).groupBy(*keys, "d").applyInArrow(run, "kind int, a long, b long"), "links")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """`(id, n_links, component_id, kept)` for every row."""
    groups = classes(vectors, id_col, vector_col, label_col)
    found = links(groups, threshold)
    counts = found.where("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("n"))
    roots = components(found.where("kind = 1").select("a", "b")).withColumnRenamed("node", "cid")
    g = settle(
        groups.select("cid", "label", "v", "copies", "least_id").join(counts, "cid", "left").join(roots, "cid", "left")
        .withColumn("root", F.coalesce("root", "cid")).withColumn("n_links", F.coalesce("n", F.lit(0)) + F.col("copies") - 1), "linked")
    least = g.groupBy("root").agg(F.min("least_id").alias("component_id"))
    g = settle(g.join(least, "root").select("label", "v", "copies", "n_links", "component_id"), "linked-classes")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = lambda d: d.select("id", "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    alone = rows.where(~_usable()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return kept(join_back(rows.where(_usable()), g, ["label", "v"])).unionByName(kept(alone))
