"""Reshape (melt / pivot / explode) and distribution summaries (describe, box plots).

Exact quantiles come from (group, value) counts, which combine map-side, so a
value that most rows share is one row. The distinct values are range-partitioned
on (group, value), which splits a hot group over sorted partitions; the first
rank of a value is the count before it in its partition plus the counts of the
same group in earlier partitions (a table of partitions x groups). Everything
else (mean, deviation, whiskers, outliers) is weighted by the same counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from optiq.operators.joins import join_bounded
from optiq.session import cut_lineage


def melt(df: DataFrame, ids: list[str], values: list[str], var: str = "metric",
         value: str = "value") -> DataFrame:
    """Wide -> long; value columns are cast to double first."""
    cast = df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values])
    return cast.unpivot(ids, values, var, value)


def explode_list_metric(df: DataFrame, col: str, out: str = "value") -> DataFrame:
    """List column -> one row per element; empty/NULL lists keep one NULL row."""
    return df.select(*[c for c in df.columns if c != col], F.explode_outer(col).alias(out))


def pivot_wide(long: DataFrame, index: list[str], column: str, values: list[str] | None = None,
               value: str = "value", agg: str = "avg", dropna: bool = False) -> DataFrame:
    """(index x column) matrix of ``agg(value)``. The columns are the distinct
    values of ``column`` unless a list is given; given a list, a value outside
    it is an error when the matrix is read, never a silent loss."""
    if values is None:
        g = long.groupBy(*index).pivot(column)
    else:
        listed = F.col(column).isin(list(values)) | F.col(column).isNull()
        checked = F.when(listed, F.col(column)).otherwise(F.raise_error(
            F.concat(F.lit(f"{column} has a value that is not listed: "), F.col(column))))
        g = long.withColumn(column, checked).groupBy(*index).pivot(column, values)
    out = g.agg(F.avg(value)) if agg == "avg" else g.agg(F.first(value, ignorenulls=True))
    return out.na.drop(subset=[c for c in out.columns if c not in index]) if dropna else out


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, _v, _c): the distinct non-null values of each group and their counts."""
    return (df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
            .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))


def _same(keys: list[str], other: str = "_k_") -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{other}{k}")) for k in keys])


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_k_{k}" for k in keys})


def _ranked(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts with ``_rank``, the 0-based rank of the value's first row in its group."""
    # partition ids are only meaningful for one materialisation
    base = cut_lineage(counts.repartitionByRange(*keys, "_v").withColumn("_pid", F.spark_partition_id()))
    inside = (Window.partitionBy("_pid", *keys).orderBy("_v")
              .rowsBetween(Window.unboundedPreceding, -1))
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (base.groupBy("_pid", *keys).agg(F.sum("_c").alias("_n"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(earlier), F.lit(0))))
    offsets = _keyed(offsets.select(F.col("_pid").alias("_p"), *keys, "_off"), keys)
    placed = base.withColumn("_in", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    joined = join_bounded(placed, offsets, (F.col("_pid") == F.col("_p")) & _same(keys))
    return joined.select(*keys, "_v", "_c", (F.col("_off") + F.col("_in")).alias("_rank"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str,
                    probs: list[float]) -> DataFrame:
    """Linear-interpolated quantiles (pandas / quantile_cont definition) per group,
    plus count, mean, sample std, min and max of the non-null values."""
    return quantiles_of_counts(value_counts(df, keys, value), keys, probs)


def quantiles_of_counts(counts: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """``exact_quantiles`` from the groups' value counts."""
    r = _ranked(counts, keys)
    whole = r.groupBy(*keys).agg(F.sum("_c").alias("_n"),
                                 (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("_mean"))
    rn = join_bounded(r, _keyed(whole, keys), _same(keys))
    off = F.col("_v") - F.col("_mean")
    n = F.first("_n")
    aggs = [n.alias("count"), F.first("_mean").alias("mean"),
            F.when(n > 1, F.sqrt(F.sum(F.col("_c") * off * off) / (n - 1))).alias("std"),
            F.min("_v").alias("min"), F.max("_v").alias("max")]
    last = F.col("_rank") + F.col("_c") - 1
    for i, q in enumerate(probs):
        h = (F.col("_n") - 1) * q
        for at, name in ((F.floor(h), "lo"), (F.ceil(h), "hi")):
            here = (F.col("_rank") <= at) & (at <= last)
            aggs.append(F.max(F.when(here, F.col("_v"))).alias(f"_{name}{i}"))
        aggs.append(F.first(h - F.floor(h)).alias(f"_f{i}"))
    g = rn.groupBy(*keys).agg(*aggs)
    cols = [F.col(c) for c in keys] + [F.col(c) for c in ("count", "mean", "std", "min", "max")]
    for i, q in enumerate(probs):
        lo, hi, fr = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_f{i}")
        cols.append((lo + (hi - lo) * fr).alias(f"q{int(round(q * 100)):02d}"))
    return g.select(*cols)


def describe_by_group(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """pandas ``describe()`` per group: count, mean, std, min, 25%, 50%, 75%, max."""
    return exact_quantiles(long, keys, value, [0.25, 0.5, 0.75])


def boxplot_stats(df: DataFrame, category: str, hue: str, value: str) -> DataFrame:
    """Box-plot data per (category, hue): quartiles, whiskers at the most extreme
    values within 1.5 IQR of the box, and the number of outliers."""
    keys = [category, hue]
    counts = value_counts(df, keys, value)
    q = quantiles_of_counts(counts, keys, [0.25, 0.5, 0.75]).select(
        *keys, "count", F.col("q25").alias("q1"), F.col("q50").alias("median"),
        F.col("q75").alias("q3"))
    lo_f = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi_f = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    j = join_bounded(counts, _keyed(q, keys), _same(keys))
    inside = (F.col("_v") >= lo_f) & (F.col("_v") <= hi_f)
    return j.groupBy(*keys).agg(
        F.first("count").alias("count"), F.first("q1").alias("q1"),
        F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("_c"))).cast("long").alias("n_outliers"))
