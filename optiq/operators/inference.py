"""One-way ANOVA, Tukey HSD and correlation matrices.

Everything is computed from sufficient statistics: one aggregation over the
responses gives (n, mean, variance) per (model, variable, set); the tests are
arithmetic on that table (rows = models x variables x sets), so the size of
the response table only affects the first, partially aggregated pass.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from optiq.functions.distributions import f_pvalue, tukey_pvalue
from optiq.session import cut_lineage

DVS = {"accuracy": "is_correct", "confidence": "confidence", "response_time": "response_time"}


def group_stats(responses: DataFrame, by: str = "model", factor: str = "distractor_set",
                dvs: dict[str, str] = DVS) -> DataFrame:
    """(by, dependent_var, level) -> n, mean, sample variance; NULL values dropped per variable.

    A single groupBy with three aggregates per variable, then the small result
    is turned long; the response rows are never multiplied.
    """
    df = responses.where(F.col(by).isNotNull() & F.col(factor).isNotNull())
    aggs = []
    for name, col in dvs.items():
        v = F.col(col).cast("double")
        aggs += [F.count(v).alias(f"{name}__n"), F.avg(v).alias(f"{name}__m"),
                 F.var_samp(v).alias(f"{name}__v")]
    wide = df.groupBy(by, factor).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(name).alias("dependent_var"),
                              F.col(f"{name}__n").alias("n"), F.col(f"{name}__m").alias("mean"),
                              F.col(f"{name}__v").alias("var"))
                     for name in dvs])
    return (wide.select(by, factor, F.explode(rows).alias("s"))
            .select(by, "s.dependent_var", F.col(factor).alias("level"), "s.n", "s.mean", "s.var")
            .where(F.col("n") > 0))


def _anova_parts(stats: DataFrame, by: str) -> DataFrame:
    """Totals per (by, variable) by a window over the group-stats table (one row
    per level), so the responses behind ``stats`` are read once."""
    keys = [by, "dependent_var"]
    w = Window.partitionBy(*keys)
    withtot = (stats.withColumn("n_total", F.sum("n").over(w))
               .withColumn("n_levels", F.count(F.lit(1)).over(w))
               .withColumn("grand", F.sum(F.col("n") * F.col("mean")).over(w) / F.col("n_total")))
    return (withtot.groupBy(*keys)
            .agg(F.first("n_total").alias("n_total"), F.first("n_levels").alias("n_levels"),
                 F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("ssb"),
                 F.sum((F.col("n") - 1) * F.coalesce(F.col("var"), F.lit(0.0))).alias("ssw")))


def anova_table(stats: DataFrame, by: str = "model", factor_name: str = "distractor_set",
                with_p: bool = False) -> DataFrame:
    """Two rows per (by, variable): the factor and Within, with SS, DF, MS, F, np2.

    Degenerate cases are reported, not raised: one level or no within-group
    variance gives NULL F and a status.
    """
    parts = _anova_parts(stats, by)
    dfb = F.col("n_levels") - 1
    dfw = F.col("n_total") - F.col("n_levels")
    msb = F.try_divide(F.col("ssb"), dfb.cast("double"))
    msw = F.try_divide(F.col("ssw"), dfw.cast("double"))
    status = (F.when(F.col("n_levels") < 2, F.lit("single_level"))
              .when(dfw <= 0, F.lit("no_within_df"))
              .when(F.col("ssw") == 0, F.lit("no_within_variance"))
              .otherwise(F.lit("ok")))
    fval = F.when(status == "ok", msb / msw)
    np2 = F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw"))
    rows = F.array(
        F.struct(F.lit(factor_name).alias("source"), F.col("ssb").alias("ss"),
                 dfb.cast("long").alias("df"), msb.alias("ms"), fval.alias("f"), np2.alias("np2")),
        F.struct(F.lit("Within").alias("source"), F.col("ssw").alias("ss"),
                 dfw.cast("long").alias("df"), msw.alias("ms"),
                 F.lit(None).cast("double").alias("f"), F.lit(None).cast("double").alias("np2")))
    out = (parts.select(by, "dependent_var", status.alias("status"),
                        dfb.alias("_d1"), dfw.alias("_d2"), F.explode(rows).alias("r"))
           .select(by, "dependent_var", "r.*", "status", "_d1", "_d2"))
    if with_p:
        out = out.withColumn("p_unc", f_pvalue(F.col("f"), F.col("_d1"), F.col("_d2")))
    return out.drop("_d1", "_d2")


def anova_oneway(responses: DataFrame, by: str = "model", factor: str = "distractor_set",
                 dvs: dict[str, str] = DVS, with_p: bool = False) -> DataFrame:
    return anova_table(group_stats(responses, by, factor, dvs), by, factor, with_p)


def tukey_hsd(stats: DataFrame, by: str = "model", alpha: float | None = None,
              with_p: bool = False) -> DataFrame:
    """All pairs A < B of levels within (by, variable): means, diff, se, T, hedges.

    se = sqrt(MSw (1/nA + 1/nB)); p (optional) = studentized-range tail at
    sqrt(2)|T| with k levels and N-k df. With ``alpha`` only variables whose
    ANOVA p is below alpha are kept (the evaluator's gate).
    Pairs are of *groups* (levels), so the self-join is on the small stats table.
    """
    keys = [by, "dependent_var"]
    # the group-stats table is small (levels x variables x groups): materialise
    # it once so the pair self-join and the ANOVA parts do not re-read responses
    stats = cut_lineage(stats)
    parts = _anova_parts(stats, by).select(
        *keys, "n_levels", "n_total", (F.col("ssw") / (F.col("n_total") - F.col("n_levels"))).alias("msw"))
    a = stats.select(*keys, F.col("level").alias("A"), F.col("n").alias("nA"),
                     F.col("mean").alias("mA"), F.col("var").alias("vA"))
    b = stats.select(*keys, F.col("level").alias("B"), F.col("n").alias("nB"),
                     F.col("mean").alias("mB"), F.col("var").alias("vB"))
    pairs = a.join(b, keys).where(F.col("A") < F.col("B")).join(parts, keys)
    diff = F.col("mA") - F.col("mB")
    se = F.sqrt(F.col("msw") * (1.0 / F.col("nA") + 1.0 / F.col("nB")))
    pooled = F.sqrt(((F.col("nA") - 1) * F.coalesce(F.col("vA"), F.lit(0.0))
                     + (F.col("nB") - 1) * F.coalesce(F.col("vB"), F.lit(0.0)))
                    / (F.col("nA") + F.col("nB") - 2))
    hedges = F.try_divide(diff, pooled) * (1.0 - 3.0 / (4.0 * (F.col("nA") + F.col("nB")) - 9.0))
    out = pairs.select(*keys, "A", "B", F.col("mA").alias("mean_a"), F.col("mB").alias("mean_b"),
                       diff.alias("diff"), se.alias("se"), F.try_divide(diff, se).alias("t"),
                       hedges.alias("hedges"), "n_levels", "n_total")
    if with_p:
        out = out.withColumn("p_tukey", tukey_pvalue(F.col("t"), F.col("n_levels"),
                                                     F.col("n_total") - F.col("n_levels")))
    if alpha is not None:
        gate = anova_table(stats, by, with_p=True).where(F.col("source") != "Within").select(
            *keys, F.col("p_unc").alias("_p"))
        out = out.join(gate, keys).where(F.col("_p") < alpha).drop("_p")
    return out.drop("n_levels", "n_total")


def correlation_long(df: DataFrame, metrics: list[str],
                     pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Pearson matrix in long form (metric_a, metric_b, r), pairwise-complete rows.

    One aggregation pass: for each ordered pair the covariance and the two
    standard deviations over rows where both values are present. Constant
    columns give NULL, never an error.
    """
    aggs = []
    for a, b in (pairs if pairs is not None else product(metrics, metrics)):
        x = F.when(F.col(b).isNotNull(), F.col(a).cast("double"))
        y = F.when(F.col(a).isNotNull(), F.col(b).cast("double"))
        r = F.try_divide(F.covar_samp(x, y),
                         F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0)))
        aggs.append(F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"),
                             r.alias("r")))
    return df.agg(F.array(*aggs).alias("m")).select(F.explode("m").alias("c")).select("c.*")


def argmax_abs(df: DataFrame, metrics: list[str], target: str,
               exclude_self: bool = True) -> DataFrame:
    """Metrics with the largest and smallest |r| against ``target`` (ties: by name)."""
    pairs = [(target, m) for m in metrics if not (exclude_self and m == target)]
    corr = correlation_long(df, metrics, pairs)
    c = corr.where(F.col("r").isNotNull())
    if exclude_self:
        c = c.where(F.col("metric_b") != target)
    # ties broken by metric name for a deterministic answer
    hi = F.max(F.struct(F.abs("r").alias("a"), F.col("metric_b").alias("m"), F.col("r").alias("r")))
    lo = F.min(F.struct(F.abs("r").alias("a"), F.col("metric_b").alias("m"), F.col("r").alias("r")))
    return c.agg(hi.alias("hi"), lo.alias("lo")).select(
        F.col("hi.m").alias("top_metric"), F.col("hi.r").alias("top_r"),
        F.col("lo.m").alias("lowest_metric"), F.col("lo.r").alias("lowest_r"))
