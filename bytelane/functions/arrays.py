"""Array helpers that keep higher-order functions linear.

Catalyst inlines a projected column into a lambda body, and a lambda body is
evaluated once per element, so `transform(xs, i -> slice(expensive, ...))`
recomputes `expensive` for every element. `let` binds a value to a lambda
variable instead: the argument of the outer `transform` is evaluated once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and pass it to `body` as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chunk(arr: Column, size: int) -> Column:
    """Split an array whose length is a multiple of `size` into consecutive chunks."""

    def body(a: Column) -> Column:
        n = (F.size(a) / F.lit(size)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.slice(a, i * F.lit(size) + 1, F.lit(size)),
        )

    # an empty input gives no chunk: sequence(0, -1) counts down, so guard it
    return let(arr, lambda a: F.filter(body(a), lambda c: F.size(a) > 0))
