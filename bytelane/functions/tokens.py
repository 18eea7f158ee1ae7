"""Special tokens, padding and loss weights on ARRAY columns (F-10 .. F-14, F-17).

A token id of `None` means "no such token": the step is a no-op, as in the
reference's tokenizer options.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class TokenIds:
    pad: int
    eom: int | None = None
    som_text: int | None = None
    som_image: int | None = None

    def specials(self) -> list[int]:
        return [x for x in (self.pad, self.eom, self.som_text, self.som_image) if x is not None]


def _one(token: int) -> Column:
    return F.array(F.lit(token).cast("bigint"))


def as_long(a: ColumnOrName) -> Column:
    """F-12: ARRAY<BIGINT>."""
    return _c(a).cast("array<bigint>")


def with_eom(a: ColumnOrName, eom: int | None) -> Column:
    """F-10: append the end-of-modality token."""
    return as_long(a) if eom is None else F.concat(as_long(a), _one(eom))


def with_som(a: ColumnOrName, som: int | None) -> Column:
    """F-10: prepend a start-of-modality token (text or image)."""
    return as_long(a) if som is None else F.concat(_one(som), as_long(a))


def pad_right_to(a: ColumnOrName, length: int, pad: int | float, strict: bool = True) -> Column:
    """F-11: right-pad to `length`; longer input raises (strict) or is cropped (Q6)."""
    a = _c(a)
    n = F.size(a)
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - n, F.lit(0)))
    padded = F.slice(F.concat(a, fill.cast(a_type_hint(pad))), 1, length)
    if strict:
        return F.when(
            F.assert_true(n <= F.lit(length), f"a row is longer than {length}").isNull(),
            padded,
        )
    return padded


def a_type_hint(pad: int | float) -> str:
    return "array<double>" if isinstance(pad, float) else "array<bigint>"


def loss_weights(parts: Sequence[tuple[ColumnOrName, float]]) -> Column:
    """F-13: one constant run per part, as ARRAY<FLOAT>."""
    runs = [F.array_repeat(F.lit(float(w)).cast("float"), F.size(_c(p))) for p, w in parts]
    return F.concat(*runs)


def qa_sample(
    question: ColumnOrName,
    image: ColumnOrName,
    answer: ColumnOrName,
    ids: TokenIds,
    seq_len: int,
    weights: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 1.0),
    strict: bool = True,
) -> Column:
    """F-17: STRUCT(tokens, loss_mask, q, i, a, len_padding).

    tokens = som_text q eom . som_image i eom . som_text q eom . som_text a eom,
    right-padded with `ids.pad`; the loss mask carries one weight per part and
    is padded with 0.0 (the reference pads it with the pad id and truncates
    weights to integers, which only its loss then ignores).
    """
    q = with_eom(with_som(question, ids.som_text), ids.eom)
    i = with_eom(with_som(image, ids.som_image), ids.eom)
    a = with_eom(with_som(answer, ids.som_text), ids.eom)
    full = F.concat(q, i, q, a)
    mask = loss_weights([(q, weights[0]), (i, weights[1]), (q, weights[2]), (a, weights[3])])
    tokens = pad_right_to(full, seq_len, ids.pad, strict)
    mask_p = F.slice(
        F.concat(mask, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(seq_len) - F.size(mask), F.lit(0)))),
        1,
        seq_len,
    )
    return F.struct(
        tokens.alias("tokens"),
        mask_p.alias("loss_mask"),
        q.alias("q"),
        i.alias("i"),
        a.alias("a"),
        (F.lit(seq_len) - F.size(full)).alias("len_padding"),
    )
