"""Rows that share a key, and the way back from one row a key to all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot if it holds more than one in so many rows, so there are fewer
# than HOT_KEYS hot keys, however large the input.
HOT_KEYS = 1000


def join_back(rows: DataFrame, groups: DataFrame, keys: list[str], copies: str = "copies") -> DataFrame:
    """Each of `rows` with the columns of its group; `groups` holds one row a key and the number of rows there are.

    Fewer than `HOT_KEYS` groups are hot; these are broadcast, so that their
    rows stay where they are read. The others join by shuffle, and no key of
    that shuffle holds more than one row in `HOT_KEYS`. Both inputs should be
    settled tables, for both are read twice.
    """
    total = int(groups.agg(F.sum(copies)).first()[0] or 0)
    hot = groups.where(F.col(copies) * HOT_KEYS > total)
    cold = groups.where(F.col(copies) * HOT_KEYS <= total)
    here = rows.join(F.broadcast(hot), keys)
    there = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return here.unionByName(there)
