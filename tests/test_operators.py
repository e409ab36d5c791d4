"""Edge fixtures for aggregation operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from optiq.operators import psychometrics as P
from optiq.operators import reshape as RS
from optiq.operators import summary as S

RESP = ("response_id long, model string, question string, subject string, llm_answer string, "
        "is_correct boolean, confidence int, response_time double, distractor_set string")


def test_item_analysis_edges(spark):
    rows = [
        (1, "m1", "all_right", "s", "A", True, 90, 1.0, "x"),
        (2, "m2", "all_right", "s", "A", True, 80, 2.0, "x"),
        (3, "m1", "mixed", "t", "B", False, 50, 1.0, "x"),
        (4, "m2", "mixed", "u", "A", True, 70, 3.0, "y"),
        (5, "m1", "mixed", "t", "C", False, None, 2.0, "y"),
        (6, "m2", "mixed", "t", "B", False, 40, 1.0, "y"),
        (7, "m1", "mixed", "t", "C", False, 30, 1.0, "y"),
    ]
    df = spark.createDataFrame(rows, RESP)
    got = {r.question: r for r in P.item_analysis(df).collect()}
    a = got["all_right"]
    assert a.discrimination is None and a.most_chosen_wrong == "N/A" and a.wrong_count == 0
    m = got["mixed"]
    assert m.subject == "t"                       # first row by response_id
    assert m.most_chosen_wrong == "B" and m.wrong_count == 2   # tie B/C -> smallest
    # discrimination = corr(is_correct, model accuracy) over the item's rows
    acc = {"m1": 0.25, "m2": 2 / 3}
    x = np.array([0, 1, 0, 0, 0], float)
    y = np.array([acc["m1"], acc["m2"], acc["m1"], acc["m2"], acc["m1"]])
    assert math.isclose(m.discrimination, np.corrcoef(x, y)[0, 1], abs_tol=1e-12)
    assert math.isclose(m.confidence_discrimination, 70 - np.mean([50, 40, 30]), abs_tol=1e-12)


def test_bins_and_calibration(spark):
    df = spark.createDataFrame([(c,) for c in (0, 10, 11, 100)], "c int")
    assert [r.b for r in df.select(P.bin_fixed(F.col("c")).alias("b")).collect()] == [0, 0, 1, 9]


def test_bins_of_any_number(spark):
    df = spark.createDataFrame([(c,) for c in range(101)], "c int")
    for n in (7, 20):
        got = [r.b for r in df.select(P.bin_fixed(F.col("c"), n).alias("b")).collect()]
        assert got == [max(0, -(-c * n // 100) - 1) for c in range(101)]


def test_quantiles_of_one_value(spark):
    """95 % of a group is one value: it is one row of the counts, in any partition."""
    df = spark.range(20_000).select(F.lit("g").alias("g"), F.when(F.col("id") % 20 > 0, 99)
                                    .otherwise(F.col("id") % 97).alias("v"))
    counts = RS.value_counts(df, ["g"], "v")
    assert counts.count() <= 98
    row = RS.exact_quantiles(df, ["g"], "v", [0.01, 0.5]).first()
    values = np.array([99 if i % 20 else i % 97 for i in range(20_000)], float)
    assert row["count"] == 20_000 and row.q50 == 99 and row.q01 == np.quantile(values, 0.01)
    assert math.isclose(row["std"], values.std(ddof=1), rel_tol=1e-12)


def test_pivot_of_unlisted_value(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0)], "i string, c string, value double")
    assert set(RS.pivot_wide(df, ["i"], "c").columns) == {"i", "x", "y"}
    with pytest.raises(Exception, match="not listed"):
        RS.pivot_wide(df, ["i"], "c", ["x"]).collect()


def test_summary_levels_and_topk(spark):
    rows = [(i, f"m{i % 2}", "q", "s", "A", i % 3 == 0, 50, 1.0, f"d{i % 3}") for i in range(12)]
    df = spark.createDataFrame(rows, RESP)
    out = S.model_distractor_summary(df).collect()
    levels = sorted({r.level for r in out})
    assert levels == ["distractor_set", "model", "model_distractor_set"]
    assert sum(r["count"] for r in out if r.level == "model") == 12


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = rng.normal(size=500).round(2)
    grp = ["hot"] * 400 + ["cold"] * 100
    df = spark.createDataFrame([(g, float(v)) for g, v in zip(grp, vals)], "g string, v double")
    got = {r.g: r for r in RS.exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.9]).collect()}
    for g in ("hot", "cold"):
        xs = np.array([v for gg, v in zip(grp, vals) if gg == g])
        for q, col in ((0.1, "q10"), (0.5, "q50"), (0.9, "q90")):
            assert math.isclose(got[g][col], float(np.quantile(xs, q)), abs_tol=1e-9)
