"""Keyed vector tables: (key STRING, row INT, vec ARRAY<FLOAT>) (PF-4, J-4, A-11).

A model state is read as an ordinary table with one row per embedding /
weight row. Checks run as aggregations whose results hold one row per key,
so only per-key summaries reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def rename_keys(df: DataFrame, rules: Sequence[tuple[str, str]], key: str = "key") -> DataFrame:
    """PF-4: replace a matching source prefix by the target prefix, rules in order.

    A key matched by two rules is rejected (the reference fails on it with a
    KeyError); otherwise the first matching rule applies.
    """
    if rules:
        hits = sum((F.col(key).startswith(src).cast("int") for src, _ in rules), F.lit(0))
        clash = df.where(hits > 1).select(key).limit(1).collect()
        if clash:
            raise ValueError(f"key {clash[0][0]!r} matches more than one rename rule")
    expr: Column | None = None
    for src, dst in rules:
        renamed = F.concat(F.lit(dst), F.substring(F.col(key), len(src) + 1, 1 << 30))
        cond = F.col(key).startswith(src)
        expr = F.when(cond, renamed) if expr is None else expr.when(cond, renamed)
    return df if expr is None else df.withColumn(key, expr.otherwise(F.col(key)))


def extend_embeddings(
    src: DataFrame,
    tgt: DataFrame,
    keys: Sequence[str],
    *,
    key: str = "key",
    row: str = "row",
    vec: str = "vec",
    carry_unlisted: bool = False,
) -> DataFrame:
    """J-4: source rows overwrite the first N rows of the target for the listed keys.

    Errors (as the reference): key lists differ, a listed key's source has a
    different width or more rows than the target. Unlisted keys keep the
    target values unless `carry_unlisted` copies them from the source.
    """
    s_keys = src.select(key).distinct()
    t_keys = tgt.select(key).distinct()
    if s_keys.exceptAll(t_keys).limit(1).count() or t_keys.exceptAll(s_keys).limit(1).count():
        raise ValueError("source and target hold different keys")
    shape = lambda d: d.groupBy(key).agg(F.max(F.size(vec)).alias("w"), F.max(row).alias("r"))
    cmp = shape(src).alias("s").join(shape(tgt).alias("t"), key).where(F.col(key).isin(list(keys)))
    bad = cmp.where((F.col("s.w") != F.col("t.w")) | (F.col("s.r") > F.col("t.r"))).select(key, "s.w", "t.w", "s.r", "t.r").limit(1).collect()
    if bad:
        b = bad[0]
        if b[1] != b[2]:
            raise ValueError("the vectors of a key differ in width")
        raise ValueError("the source has more rows than the target")
    moved = list(keys)
    s = src.select(key, row, F.col(vec).alias("_src_vec"))
    j = tgt.join(s, [key, row], "left")
    listed = F.col(key).isin(moved) if moved else F.lit(False)
    take = (listed | F.lit(carry_unlisted)) & F.col("_src_vec").isNotNull()
    return j.select(
        key, row, F.when(take, F.col("_src_vec")).otherwise(F.col(vec)).alias(vec), take.alias("from_source")
    )


def param_count(df: DataFrame, prefix: Column, *, trainable: Column | None = None, vec: str = "vec") -> DataFrame:
    """A-11: number of elements per key prefix, with the total as the rollup row (prefix NULL)."""
    x = df if trainable is None else df.where(trainable)
    return x.rollup(prefix.alias("prefix")).agg(F.sum(F.size(vec)).cast("bigint").alias("n_params"))


def mapped_state(
    src: DataFrame, tgt: DataFrame, rules: Sequence[tuple[str, str]], keys: Sequence[str], *, key: str = "key", row: str = "row", vec: str = "vec"
) -> tuple[DataFrame, Observation]:
    """U-6: PF-4 then J-4, with counts that the very pass that uses the rows fills in.

    The observation holds `rows`, and of these `renamed` (rows of a key that a
    rule has changed), `extended` (taken from the source) and `kept`. Both
    tables are renamed alike, so that their keys still agree.
    """
    changed = [F.col(key).startswith(dst) for _, dst in rules]
    renamed = changed[0] if changed else F.lit(False)
    for c in changed[1:]:
        renamed = renamed | c
    out = extend_embeddings(rename_keys(src, rules, key), rename_keys(tgt, rules, key), keys, key=key, row=row, vec=vec)
    seen = Observation()
    taken = F.col("from_source")
    observed = out.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(renamed).alias("renamed"), F.count_if(taken).alias("extended"), F.count_if(~taken).alias("kept"))
    return observed, seen


def write_mapped(state: DataFrame, seen: Observation, path: str, notify: Callable[[str], object]) -> dict[str, int]:
    """Write a mapped state and tell `notify` what was mapped; no job beside the write."""
    state.write.parquet(path)
    counts = dict(seen.get)
    for name in ("renamed", "extended", "kept"):
        notify(f"{counts[name]} of {counts['rows']} rows {name}")
    return counts
