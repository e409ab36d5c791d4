"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the number of times the mix takes it in the mean,
between 0 and ``most``. Among all rates that give each source its target number
of words, entropy balancing takes those nearest to one copy each in the sense
of (bounded) entropy. These are exponential tilts,

    odds(rate / most) = odds(1 / most) * exp(lambda * size / mean size),

with one multiplier per source, the root of the convex dual's gradient. Newton
steps find it: each is one aggregation over the distinct (source, size) cells,
and all sources step at once. A step that leaves the bracket known so far is
replaced by its middle, so it always converges. Sums are exact decimals, so
reruns agree whatever the order of the rows.

Targets: sources in code point order (null last) have ``weights`` in turn and
share ``share`` times all words by weight; a target stops at ``most`` times the
source's words, and the excess is shared again by weight until none is above.

Rounding: the rates are cumulated over each source's documents from the largest
to the smallest; a document takes the integer steps of the cumulated rate.
Partial sums are off by half a copy at most at any size, so a source's words
miss their target by less than its largest document. Then one document of each
source, of a size near that rest, is taken once more or once less.

Scale: the documents are aggregated to cells (a hot source shrinks to its
distinct sizes). A large cell is split by hash into parts of about ``PART``
documents before its documents are numbered, so no cell lands in one task.
Only the greatest step of a round reaches the driver.

Null texts have size 0; documents of size 0 are taken 0 times; sources without
words have target 0. Each row of ``allot`` is a document of its own, also where
ids repeat or are null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from optiq.session import cut_lineage
from optiq.sources.tables import table

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
PART = 50_000
#: Rates are kept as integer multiples of 1 / UNIT.
UNIT = 1 << 30
SUM = "decimal(38,9)"


def size_of(text: Column) -> Column:
    """Number of words of a text, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(cells: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target from the (source, size, n) cells.

    The excess is shared until none is above: sources are capped in order of
    cap / weight, so the level all others stand at is a closed form over the
    sorted sources (one row per source)."""
    per = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)),
                          (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("double")).withColumn(
        "cap", (F.col("source_size") * most).cast("double"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = ((F.sum("source_size").over(W.partitionBy()) * share
              - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / F.sum("weight").over(rest))
    # capped while the level offered exceeds the cap; from the first uncapped one on it is fixed
    per = per.withColumn("level", level).withColumn(
        "open", F.col("level") * F.col("weight") < F.col("cap"))
    fixed = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(
        order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    met = F.max(F.col("open").cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return per.select("source", "source_size", F.when(met == 1, F.least(fixed * F.col("weight"), "cap"))
                      .otherwise(F.col("cap")).alias("target"))


def tilt(multiplier: Column, size: Column, mean: Column, most: int = MOST) -> Column:
    """The rate of a document of this size, as a share of ``most``."""
    odds_of_one = -math.log(most - 1)
    return 1.0 / (1.0 + F.exp(-(F.lit(odds_of_one) + multiplier * size / mean)))


def solve(cells: DataFrame, wanted: DataFrame, most: int = MOST, rounds: int = 60) -> DataFrame:
    """source, multiplier by safeguarded Newton steps on the dual. A target of
    ``most`` times the source, or 0, has its root at infinity and needs none."""
    inner = wanted.where("target > 0").where(F.col("target") < most * F.col("source_size"))
    count = cells.groupBy(F.col("source").alias("c")).agg(F.sum("n").alias("docs"))
    dual = cut_lineage(
        inner.join(count, F.col("source").eqNullSafe(F.col("c")))
        .select("source", "target", (F.col("source_size") / F.col("docs")).alias("mean"),
                F.lit(0.0).alias("x"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"),
                F.lit(1.0).alias("step")))
    # the cells are read once a round
    points = cut_lineage(cells.where("size > 0").withColumnRenamed("source", "s"))
    for _ in range(rounds):
        p = tilt(F.col("x"), F.col("size"), F.col("mean"), most)
        words = F.col("size") * F.col("n") * most
        sums = (points.join(dual, F.col("s").eqNullSafe(F.col("source")))
                .groupBy("source", "target", "mean", "x", "low", "high")
                .agg(F.sum((words * p).cast(SUM)).alias("got"),
                     F.sum((words * p * (1 - p) * F.col("size") / F.col("mean")).cast(SUM))
                     .alias("slope")))
        gap = F.col("got").cast("double") - F.col("target")
        slope = F.col("slope").cast("double")
        # the bracket holds the root; a first bound comes from doubling
        moved = (sums.withColumn("gap", gap)
                 .withColumn("low", F.when(F.col("gap") < 0, F.col("x")).otherwise(F.col("low")))
                 .withColumn("high", F.when(F.col("gap") >= 0, F.col("x")).otherwise(F.col("high")))
                 .withColumn("newton", F.col("x") - F.when(slope > 0, F.col("gap") / slope)))
        wide = 2 * F.abs(F.col("x")) + 4
        middle = (F.when(F.col("high") > 5e8, F.col("low") + wide)
                  .when(F.col("low") < -5e8, F.col("high") - wide)
                  .otherwise((F.col("low") + F.col("high")) / 2))
        inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high")) \
            & (F.abs(F.col("newton") - F.col("x")) <= wide)
        to = F.when(F.abs(F.col("gap")) <= 1e-9 * F.col("target"), F.col("x")) \
            .when(inside, F.col("newton")).otherwise(middle)
        moved = moved.withColumn("to", to).select(
            "source", "target", "mean", F.col("to").alias("x"), "low", "high",
            F.abs(F.col("to") - F.col("x")).alias("step"))
        dual = cut_lineage(moved)
        if not dual.where("step > 1e-10 * greatest(1, abs(x))").take(1):
            break
    return dual.select("source", "mean", F.col("x").alias("multiplier"))


def _rates(cells: DataFrame, weights, share: float, most: int) -> DataFrame:
    """The (source, size) cells with source_size, target, rate in UNITs and parts."""
    wanted = cut_lineage(targets(cells, weights, share, most))
    dual = solve(cells, wanted, most).withColumnRenamed("source", "d")
    wanted = wanted.withColumnRenamed("source", "w")
    tilted = F.round(tilt(F.col("multiplier"), F.col("size"), F.col("mean"), most) * most * UNIT)
    rate = (F.when((F.col("size") == 0) | (F.col("target") <= 0), 0)
            .when(F.col("multiplier").isNull(), most * UNIT).otherwise(tilted))
    return cut_lineage(
        cells.join(wanted, F.col("source").eqNullSafe(F.col("w")))
        .join(dual, F.col("source").eqNullSafe(F.col("d")), "left")
        .select(F.col("source").alias("s"), F.col("size").alias("z"), "source_size", "target",
                rate.cast("long").alias("rate"), F.ceil(F.col("n") / PART).cast("int").alias("parts")))


def allot(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target and copies (how often the mix
    takes the row) for each row of ``docs``, which has doc_id, source and size."""
    if most < 2:
        raise ValueError("most must be at least 2")
    docs = docs.select("doc_id", "source", "size")
    cells = cut_lineage(docs.groupBy("source", "size").agg(F.count("*").alias("n")))
    rates = _rates(cells, weights, share, most)
    placed = (docs.join(rates, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
              .withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), "parts").cast("int"))
              .drop("s", "z", "parts"))
    # the rates cumulated up to each (size, part) group of a source, exactly
    groups = placed.groupBy("source", "size", "part").agg(F.count("*").alias("n"),
                                                          F.max("rate").alias("rate"))
    before = W.partitionBy("source").orderBy(F.desc("size"), "part").rowsBetween(W.unboundedPreceding, -1)
    group_rate = (F.col("n") * F.col("rate")).cast("decimal(38,0)")
    base = groups.select(F.col("source").alias("s"), F.col("size").alias("z"),
                         F.col("part").alias("p"),
                         F.coalesce(F.sum(group_rate).over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(W.partitionBy("source", "size", "part")
                               .orderBy(F.xxhash64("doc_id"), "doc_id"))
    after = F.col("base") + (F.col("rank") * F.col("rate")).cast("decimal(38,0)") + UNIT // 2
    steps = F.floor(after / UNIT) - F.floor((after - F.col("rate")) / UNIT)
    rounded = cut_lineage(
        placed.withColumn("rank", rank)
        .join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
              & (F.col("part") == F.col("p")))
        .select("doc_id", "source", "size", "source_size", "target", "part", "rank",
                steps.cast("long").alias("copies")))
    return _settle(rounded, most)


def _settle(rounded: DataFrame, most: int) -> DataFrame:
    """Take one document of each source once more or once less, the one whose
    size is nearest to the words still missing or in excess, where that helps.
    The first document of each (size, part) group is a candidate."""
    rest = (rounded.groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("got"))
            .select(F.col("source").alias("s"), (F.round("target") - F.col("got")).cast("long").alias("rest")))
    able = ((F.col("rest") > 0) & (F.col("copies") < most)) | ((F.col("rest") < 0) & (F.col("copies") > 0))
    off = F.abs(F.col("size") - F.abs("rest"))
    change = (rounded.where("rank = 1 AND size > 0")
              .join(rest, F.col("source").eqNullSafe(F.col("s")))
              .where(able & (off < F.abs("rest"))).groupBy("s")
              .agg(F.min(F.struct(off.alias("off"), "size", "part", F.signum("rest").alias("by"))).alias("c"))
              .select("s", F.col("c.size").alias("z"), F.col("c.part").alias("p"), F.col("c.by").cast("long").alias("by")))
    return (rounded.join(change, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
                         & (F.col("part") == F.col("p")) & (F.col("rank") == 1), "left")
            .select("doc_id", "source", "size", "source_size", "target",
                    (F.col("copies") + F.coalesce("by", F.lit(0))).alias("copies")))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``docs`` (doc_id, text, source and any others), each row as often as the
    mix takes it. Rows that share doc_id, source and size are taken alike: they are
    one document of all their words."""
    slim = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"))
    groups = slim.groupBy("doc_id", "source", "size").agg((F.col("size") * F.count("*")).alias("words")).select(
        F.struct("doc_id", "size").alias("doc_id"), "source", F.col("words").alias("size"))
    taken = (allot(groups, weights, share, most).where("copies > 0")
             .select(F.col("doc_id.doc_id").alias("d"), F.col("source").alias("s"),
                     F.col("doc_id.size").alias("z"), "copies"))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", size_of(F.col("text")).alias("size"))
    return (rows.join(taken, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s"))
                      & (F.col("size") == F.col("z")))
            .select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
            .select("row.*"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"))
    return allot(sized).select("doc_id", "size", "source_size", "target",
                               (F.col("copies") * F.col("size")).alias("taken"))
