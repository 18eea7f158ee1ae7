"""Token-level scoring and sampling on logit arrays (A-3 .. A-5, T-5, F-24).

Logits arrive as ARRAY<FLOAT|DOUBLE> per position; every function here is a
higher-order SQL expression evaluated per row, so it runs wherever the rows
already are (no shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bytelane.functions.arrays import let
from bytelane.functions.hashing import uniform

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cross_entropy(logits: ColumnOrName, target: ColumnOrName, ignore_index: int | None = None) -> Column:
    """A-3: -log softmax(logits)[target], computed as logsumexp - logit; 0 when target = ignore_index."""
    t = _c(target)

    def body(l: Column) -> Column:
        return let(
            F.array_max(l),
            lambda m: F.log(F.aggregate(F.transform(l, lambda x: F.exp(x - m)), F.lit(0.0), lambda a, x: a + x))
            + m
            - F.element_at(l, t.cast("int") + 1),
        )

    ce = let(_c(logits).cast("array<double>"), body)
    return ce if ignore_index is None else F.when(t == F.lit(ignore_index), F.lit(0.0)).otherwise(ce)


def nonzero_weighted_mean(loss: ColumnOrName, weight: ColumnOrName) -> Column:
    """A-4 (aggregate): mean of loss*weight over the non-zero products; 0 when none (Q11)."""
    lw = _c(loss) * _c(weight)
    return F.coalesce(F.avg(F.when(lw != 0, lw)), F.lit(0.0))


def masked_mean(loss: ColumnOrName, mask: ColumnOrName) -> Column:
    """A-5 (aggregate): mean loss over masked positions; NaN when none is masked (Q12)."""
    return F.coalesce(F.avg(F.when(_c(mask), _c(loss))), F.lit(float("nan")))


def top_k_count(vocab: int, thres: float = 0.5) -> int:
    """Number of logits T-5 keeps: max(int((1 - thres) * V), 1)."""
    return max(int((1 - thres) * vocab), 1)


def top_k_indices(logits: ColumnOrName, k: int) -> Column:
    """0-based indices of the k largest logits; ties go to the smaller index."""
    l = _c(logits)
    ranked = F.sort_array(F.transform(l, lambda x, i: F.struct((-x.cast("double")).alias("v"), i.alias("i"))))
    return F.array_sort(F.transform(F.slice(ranked, 1, k), lambda s: s["i"]))


def top_k_filter(logits: ColumnOrName, k: int) -> Column:
    """T-5: logits outside the top k become -inf."""
    def body(l: Column) -> Column:
        return let(
            top_k_indices(l, k),
            lambda keep: F.transform(l, lambda x, i: F.when(F.array_contains(keep, i), x).otherwise(F.lit(float("-inf")))),
        )

    return let(_c(logits).cast("array<double>"), body)


def gumbel_argmax(
    logits: ColumnOrName, temperature: float, *keys: Column, hash_mode: str = "xxhash64", eps: float = 1e-20
) -> Column:
    """F-24: argmax(logits / T + Gumbel noise), noise from a hash of (keys, position).

    -inf logits (filtered by T-5) are never drawn. Returns a 0-based index.
    """
    l = _c(logits).cast("array<double>")

    def noisy(x, i):
        u = uniform(*keys, i, mode=hash_mode)
        g = -F.log(F.greatest(-F.log(F.greatest(u, F.lit(eps))), F.lit(eps)))
        return x / F.lit(temperature) + g

    scored = F.transform(l, noisy)
    return (F.array_position(scored, F.array_max(scored)) - 1).cast("int")
