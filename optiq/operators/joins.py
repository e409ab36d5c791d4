"""Join helpers with duplicate policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from optiq.session import cut_lineage


def join_bounded(big: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join ``small``, usually an aggregate, onto ``big`` without a hint: adaptive
    execution broadcasts it when its measured bytes are below the session's
    threshold, and otherwise splits hot keys of the shuffle join."""
    return big.join(small, on, how)


def dedupe_first(df: DataFrame, key, order: str | Column) -> DataFrame:
    """Keep the first row per key by ``order`` (``next(...)`` lookup semantics).

    A rank of 1 by window: Spark keeps one row per key in each task before the
    shuffle, so a key with many duplicates reaches its task as a few rows. Ties
    in ``order`` are settled by the other columns.
    """
    return _ranked_first(df, key, order, descending=False)


def _ranked_first(df: DataFrame, key, order: str | Column, descending: bool) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    order_col = F.col(order) if isinstance(order, str) else order
    rest = [F.col(c) for c in df.columns if c not in keys]
    by = [c.desc() if descending else c.asc() for c in (order_col, *rest)]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    return df.withColumn("__rank", first).where("__rank = 1").select(*keys, *rest)


def dedupe_last(df: DataFrame, key, order: str | Column) -> DataFrame:
    """Keep the last row per key by ``order`` (dict-comprehension semantics)."""
    return _ranked_first(df, key, order, descending=True)


def join_reference_answers(sets: DataFrame, originals: DataFrame, key: str = "question",
                           order: str = "load_pos") -> DataFrame:
    """Inner join on question text; duplicate originals: last one wins."""
    ref = dedupe_last(originals, key, order)
    ref = ref.select(key, *[F.col(c).alias(f"ref_{c}") for c in ref.columns if c != key])
    return join_bounded(sets, ref, key, "inner")


def join_original_first(sets: DataFrame, originals: DataFrame, key: str = "question",
                        order: str = "load_pos") -> DataFrame:
    """Inner join on question text; duplicate originals: first one wins."""
    ref = dedupe_first(originals, key, order)
    ref = ref.select(key, *[F.col(c).alias(f"orig_{c}") for c in ref.columns if c != key])
    return join_bounded(sets, ref, key, "inner")


def unmatched_questions(sets: DataFrame, originals: DataFrame, key: str = "question") -> DataFrame:
    """Rows of ``sets`` whose key has no original (the reference skips them)."""
    return join_bounded(sets, originals.select(key).distinct(), key, "left_anti")


def left_join_small(small: DataFrame, big: DataFrame, key: str,
                    materialize: bool = False) -> DataFrame:
    """``small LEFT JOIN big`` on a key with few values (e.g. one row per set
    against all questions of the set) without shuffling ``big`` by that key:
    an inner join (broadcast by measured size), plus the
    ``small`` rows that have no match. ``big`` is read twice; with
    ``materialize`` it is checkpointed first (for an expensive, already
    aggregated ``big``)."""
    if materialize:
        big = cut_lineage(big)
    matched = join_bounded(big, small, key, "inner")
    keys_in_big = big.select(key).distinct()
    missing = join_bounded(small, keys_in_big, key, "left_anti")
    return matched.unionByName(missing, allowMissingColumns=True)


def union_all(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
