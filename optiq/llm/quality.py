"""Quality rules with robust multivariate outliers, in column expressions only.

Each text gives counts (words, characters in words, symbols, repeated lines,
words in repeated three-word windows). Two base rules reject on their own;
the other documents are judged against their kind: per language and source, a
minimum-covariance-determinant estimate of the transformed counts' centre and
covariance, and a cut on the squared Mahalanobis distance.

An estimate's subset is the ``share`` of its group with the least determinant
of the covariance that can be found: concentration steps (the nearest ``share``
by the present estimate gives the next mean and covariance) go on until the
determinant stops falling, from several starts (``_starts``: quartile spreads,
all rows, spatial signs, bounded scores, the level above). After two steps the
two starts of least determinant go on, at the end the least one stands.
Distances are binned by their logarithm and each step is one aggregation by
(group, start, bin) of counts, sums and products, so a step never sorts a group
and a hot source is combined before it is shuffled; of the last bin the part
that fills the share counts, so every subset has the same weight.

Groups nest: all documents, languages, sources of a language. Each estimate
holds ``prior`` pseudo-documents with the mean and covariance of the level above,
which always are in the subset. So groups of any size are judged alike: a small
one mostly by the level above, a large one by its own rows. For a group of n rows
far from the level above, the pseudo-documents alone bring no squared distance
over prior / (share * n): a document alone in its language is never rejected, nor
are three alike of one source. Null languages and sources are groups of their own.

Covariances are scaled to be consistent under normality and the diagonal gets
small floors (``FLOORS``), since many counts are 0 for most documents of a kind;
the determinant compared is that of the matrix so regularised, for which the steps
still never raise it, but for the width of a bin.
The cut is the 1 - 1e-4 quantile of chi-squared, 5.1 deviations of one feature:
where a count is 0 for a kind, 4 symbols per 100 words or 4 repeated lines reject,
and words of 1.3 times the usual length; one repeated line does not.

Null texts are empty. Rows are judged one by one: repeated rows, repeated or
null ids get the verdict of their counts. Extra columns are not read.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from optiq.session import cut_lineage
from optiq.sources.tables import table

SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Least standard deviations of the features below, in their own units.
FLOORS = (0.05, 0.30, 0.30, 0.05, 0.30)
N = len(FLOORS)


def words_of(text: Column) -> Column:
    spaced = F.translate(text, SPACES, " " * len(SPACES))
    return F.array_remove(F.split(spaced, " "), "")


def _repeat_words(windows: Column) -> Column:
    """Words covered by windows of three that stand twice or more; ``windows``
    is the sorted array of (hash, place)."""
    n = F.size(windows)

    def place(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(windows, i - 1)["h"] == x["h"])
        after = F.when(i < n - 1, F.get(windows, i + 1)["h"] == x["h"])
        return F.when(F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)), x["i"])

    places = F.sort_array(F.array_compact(F.transform(windows, place)))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        places, start,
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(i - a["last"], F.lit(3))).alias("n")),
        lambda a: a["n"])


def statistics(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the counts of each text: n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words (all long)."""
    text = docs.select(*keys, F.coalesce("text", F.lit("")).alias("text"))
    counted = text.select(
        *keys, words_of(F.col("text")).alias("words"),
        F.char_length(F.translate("text", " " + SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long")
        .alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " " + SPACES, "")) > 0)
        .alias("lines"))
    n = F.size("words")
    w = F.col("words")
    window = F.transform(
        F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    windowed = counted.select(
        *keys, "word_chars", "n_symbols", n.cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        window.alias("windows"))
    some = F.size(F.array_distinct("windows.h")) < F.size("windows")
    ordered = windowed.withColumn("windows", F.when(some, F.sort_array("windows")))
    return ordered.select(
        *keys, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.col("windows").isNull(), F.lit(0).cast("long"))
        .otherwise(_repeat_words(F.col("windows"))).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> list[Column]:
    """The transformed counts of a document with words."""
    n = F.col("n_words")
    return [F.log(F.col("word_chars") / n), F.log1p(100 * F.col("n_symbols") / n),
            F.log1p(F.col("n_dup_lines").cast("double")), F.col("n_repeat_words") / n, F.log(n.cast("double"))]


def chi2_cdf(x: float, k: int) -> float:
    """P(chi-squared with k degrees of freedom <= x), by the power series."""
    a, half = k / 2, x / 2
    term = total = 1 / a
    i = a
    while term > total * 1e-16:
        i += 1
        term *= half / i
        total += term
    return total * math.exp(-half + a * math.log(half) - math.lgamma(a)) if x > 0 else 0.0


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


PAIRS = [(i, j) for i in range(N) for j in range(i + 1)]
CENTRE = [f"m_{i}" for i in range(N)]
SPREAD = [f"r_{i}_{j}" for i, j in PAIRS]
#: Estimates that are broadcast to the rows at most (some 400 bytes each).
FEW_ESTIMATES = 50_000


def _factor(estimate: DataFrame, consistent: float) -> DataFrame:
    """``estimate`` with l_i_j, the lower factor of the regularised covariance (from
    the raw one, r_i_j), and logdet, the logarithm of its determinant."""
    factor = []  # each column uses those before it in the same select
    for i, j in PAIRS:
        rest = f"{consistent!r}D * r_{i}_{j}" + (f" + {FLOORS[i] ** 2!r}D" if i == j else "")
        rest += "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j))
        factor.append(f"sqrt({rest}) AS l_{i}_{j}" if i == j else f"({rest}) / l_{j}_{j} AS l_{i}_{j}")
    logdet = " + ".join(f"2 * ln(l_{i}_{i})" for i in range(N))
    return estimate.selectExpr("*", *factor, f"{logdet} AS logdet")


def _distance(rows: DataFrame, estimate: DataFrame, few: bool) -> DataFrame:
    """``rows`` with d2, the squared Mahalanobis distance to each estimate of their group."""
    known = estimate.withColumnRenamed("g", "eg")
    found = rows.join(F.broadcast(known) if few else known, F.col("g") == F.col("eg"))
    solved = [f"(x_{i} - m_{i}" + "".join(f" - l_{i}_{j} * y_{j}" for j in range(i)) + f") / l_{i}_{i} AS y_{i}"
              for i in range(N)]
    return found.selectExpr("*", *solved, " + ".join(f"y_{i} * y_{i}" for i in range(N)) + " AS d2")


def _moments(weight: str) -> list[str]:
    """Mean and raw covariance from sums t_i and products q_i_j of ``weight`` rows."""
    return [*[f"t_{i} / {weight} AS m_{i}" for i in range(N)],
            *[f"q_{i}_{j} / {weight} - t_{i} * t_{j} / ({weight} * {weight}) AS r_{i}_{j}" for i, j in PAIRS]]


def _sums() -> list[Column]:
    """t_i and q_i_j, the sums and the sums of products of the features."""
    return [*[F.expr(f"sum(x_{i}) AS t_{i}") for i in range(N)],
            *[F.expr(f"sum(x_{i} * x_{j}) AS q_{i}_{j}") for i, j in PAIRS]]


def _starts(rows: DataFrame, above: DataFrame | None, few: bool) -> DataFrame:
    """First estimates (g, start, n, m_i, r_i_j) of each group: medians with quartile
    spreads, mean and covariance of all rows, medians with the covariance of the
    spatial signs and of bounded scores (hyperbolic tangents) of the standardised
    rows, and the estimate ``above``."""
    quartiles = rows.groupBy("g").agg(
        F.count("*").alias("n"),
        *[F.expr(f"percentile_approx(x_{i}, array(0.25, 0.5, 0.75), 2000) AS p_{i}") for i in range(N)])
    known = quartiles.selectExpr(
        "g AS eg", "n", *[f"p_{i}[1] AS m_{i}" for i in range(N)],
        *[f"hypot((p_{i}[2] - p_{i}[0]) / 1.349D, {FLOORS[i]}D) AS s_{i}" for i in range(N)])
    z = rows.join(F.broadcast(known) if few else known, F.col("g") == F.col("eg"))
    z = z.selectExpr("*", *[f"(x_{i} - m_{i}) / s_{i} AS z_{i}" for i in range(N)])
    norm = " + ".join(f"z_{i} * z_{i}" for i in range(N))
    both = cut_lineage(z.selectExpr("*", f"{norm} + 1e-12D AS norm").groupBy("g").agg(
        F.count("*").alias("k"), F.first("n").alias("n"),
        *[F.first(f"{c}_{i}").alias(f"{c}_{i}") for c in "ms" for i in range(N)], *_sums(),
        *[F.expr(f"{N} * sum(z_{i} * z_{j} / norm) AS u_{i}_{j}") for i, j in PAIRS],
        *[F.expr(f"sum(tanh(z_{i}) * tanh(z_{j})) AS h_{i}_{j}") for i, j in PAIRS]))
    shapes = {"quartiles": [*CENTRE, *[f"{f's_{i} * s_{j}' if i == j else '0D'} AS r_{i}_{j}" for i, j in PAIRS]],
              "rows": _moments("k"),
              "signs": [*CENTRE, *[f"u_{i}_{j} / k * s_{i} * s_{j} AS r_{i}_{j}" for i, j in PAIRS]],
              "tanh": [*CENTRE, *[f"h_{i}_{j} / k * s_{i} * s_{j} AS r_{i}_{j}" for i, j in PAIRS]]}
    starts = [both.selectExpr("g", f"'{name}' AS start", "n", *columns) for name, columns in shapes.items()]
    if above is not None:
        starts.append(above.selectExpr("g", "'above' AS start", "n", *[f"p{c} AS {c}" for c in (*CENTRE, *SPREAD)]))
    return functools.reduce(DataFrame.unionByName, starts)


def _step(rows: DataFrame, estimate: DataFrame, above: DataFrame | None, share: float, prior: float,
          consistent: float, few: bool) -> DataFrame:
    """One concentration step of each estimate: mean and covariance of the nearest
    ``share`` of its group, together with the ``prior`` pseudo-documents of ``above``."""
    binned = _distance(rows, estimate, few).selectExpr("*", "floor(ln(d2 + 1e-9D) * 100) AS bin")
    sums = binned.groupBy("g", "start", "bin").agg(F.count("*").alias("k"), F.first("n").alias("n"),
                                                  F.first("logdet").alias("was"), *_sums())
    nearer = "sum(k) OVER (PARTITION BY g, start ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    part = sums.selectExpr("*", f"least(1D, ({share!r}D * n - coalesce({nearer}, 0)) / k) AS part").where("part > 0")
    names = [*[f"t_{i}" for i in range(N)], *[f"q_{i}_{j}" for i, j in PAIRS]]
    total = part.groupBy("g", "start").agg(F.max("n").alias("n"), F.max("was").alias("was"), *[F.expr(f"sum(part * {c}) AS {c}") for c in names])
    weight = f"({share!r}D * n)"
    if above is not None:
        total = total.join(above.drop("n"), "g").selectExpr(
            "g", "start", "n", "was", *[f"t_{i} + {prior!r}D * pm_{i} AS t_{i}" for i in range(N)],
            *[f"q_{i}_{j} + {prior!r}D * (pr_{i}_{j} + pm_{i} * pm_{j}) AS q_{i}_{j}" for i, j in PAIRS])
        weight = f"({share!r}D * n + {prior!r}D)"
    return _factor(total.selectExpr("g", "start", "n", "was", *_moments(weight)), consistent)


def _least(rows: DataFrame, above: DataFrame | None, share: float, prior: float, few: bool,
           tol: float = 1e-3) -> DataFrame:
    """The estimate of least determinant of each group g of ``rows`` (x_i): g, start,
    n, m_i, r_i_j, l_i_j, logdet. ``above``: g, n, pm_i and pr_i_j of each group."""
    consistent = share / chi2_cdf(chi2_quantile(share, N), N + 2)

    def step(estimate: DataFrame) -> DataFrame:
        new = _step(rows, estimate, above, share, prior, consistent, few)
        return new.withColumn("falling", F.col("was") - F.col("logdet") > tol).drop("was")

    # each step is cut: a plan of two steps takes longer to plan than two jobs take
    once = cut_lineage(step(cut_lineage(_factor(_starts(rows, above, few), consistent))))
    state = cut_lineage(_ranked(step(once), 2))  # the two best starts go on
    while not state.where("falling").isEmpty():
        state = cut_lineage(step(state.where("falling")).unionByName(state.where("NOT falling")))
    return _ranked(state, 1).drop("falling")


def _ranked(state: DataFrame, few: int) -> DataFrame:
    """The ``few`` estimates of least determinant of each group."""
    rank = F.row_number().over(W.partitionBy("g").orderBy("logdet", "start"))
    return state.withColumn("rank", rank).where(F.col("rank") <= few).drop("rank")


def few_groups(rows: DataFrame, level: str) -> bool:
    """Whether the estimates from all starts of the groups of ``level`` may be broadcast."""
    bound = FEW_ESTIMATES // 5
    return rows.select(level).distinct().limit(bound + 1).count() <= bound


def estimates(rows: DataFrame, few: bool, share: float = 0.75,
              prior: tuple[float, float] = (16.0, 50.0)) -> DataFrame:
    """The estimate of each language and source of ``rows`` (from ``with_features``), one
    level after another. ``few``: ``few_groups`` of the last level; where it holds, it
    holds for the levels above, which have no more groups."""
    above = found = None
    levels = ("all", "by_lang", "by_kind")
    for depth, level in enumerate(levels):
        g = rows.withColumn("g", F.col(level))
        if found is not None:
            upper = levels[depth - 1]
            held = found.select(F.col("g").alias(upper), *[F.col(c).alias(f"p{c}") for c in (*CENTRE, *SPREAD)])
            above = cut_lineage(g.groupBy("g", upper).agg(F.count("*").alias("n")).join(held, upper).drop(upper))
        found = _least(g, above, share, prior[depth - 1] if depth else 0.0,
                       few or depth == 0 or few_groups(rows, level))
    return found


def with_features(judged: DataFrame) -> DataFrame:
    """The rows of ``judged`` as one column, the names of their groups and their features x_i."""
    return judged.select(
        F.struct(*judged.columns).alias("row"), F.lit("").alias("all"), F.to_json(F.struct("lang")).alias("by_lang"),
        F.to_json(F.struct("lang", "source")).alias("by_kind"), *[x.alias(f"x_{i}") for i, x in enumerate(features())])


def judge(counts: DataFrame, share: float = 0.75, tail: float = 1e-4,
          prior: tuple[float, float] = (16.0, 50.0)) -> DataFrame:
    """``counts`` (with lang and source) with base_failed, d2 (null where it failed) and kept."""
    marked = cut_lineage(counts.withColumn("base_failed", base_failed()))
    rows = cut_lineage(with_features(marked.where("NOT base_failed")))
    few = few_groups(rows, "by_kind")
    estimate = estimates(rows, few, share, prior)
    known = _distance(rows.withColumn("g", F.col("by_kind")), estimate, few).select("row.*", "d2")
    failed = marked.where("base_failed").withColumn("d2", F.lit(None).cast("double"))
    cut = chi2_quantile(1 - tail, N)
    return known.unionByName(failed).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= cut, F.lit(True)))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = statistics(table(spark, sf_dir, "documents"), ["doc_id", "lang", "source"])
    return judge(counts).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                "n_repeat_words", "base_failed", "kept", "d2")
