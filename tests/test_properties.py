"""Property checks (hypothesis generates the cases; each property is evaluated
for all cases in one DataFrame so Spark runs once per property)."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from optiq.operators import inference as INF
from optiq.operators import psychometrics as P
from optiq.operators import textsim as TS

WORDS = st.sampled_from(["law", "the", "court", "rule", "a", "fraud", "case", "of"])
TEXT = st.lists(WORDS, min_size=0, max_size=12).map(" ".join)


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), min_size=30, max_size=30))
def test_meteor_bounds_and_identity(spark, cases):
    rows = [(i, r, h) for i, (r, h) in enumerate(cases)] + \
           [(1000 + i, r, r) for i, (r, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, reference string, hypothesis string")
    got = {r.id: r.meteor for r in TS.meteor(df, ["id"]).collect()}
    for i, (r, _) in enumerate(cases):
        assert 0.0 <= got[i] <= 1.0
        m = len(r.split())
        expected = 0.0 if m == 0 else 1 - 0.5 / m ** 3   # identical text: one chunk
        assert math.isclose(got[1000 + i], expected, abs_tol=1e-12)


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["m1", "m2", "m3"]), st.booleans(),
                          st.one_of(st.none(), st.integers(0, 100))), min_size=50, max_size=200))
def test_calibration_properties(spark, rows):
    df = spark.createDataFrame(
        [(i, m, ok, c) for i, (m, ok, c) in enumerate(rows)],
        "response_id long, model string, is_correct boolean, confidence int")
    bins = P.reliability_bins(df).groupBy("model").agg(F.sum("n").alias("n")).collect()
    have = {m: sum(1 for mm, _, c in rows if mm == m and c is not None) for m in {"m1", "m2", "m3"}}
    assert {r.model: r.n for r in bins} == {m: n for m, n in have.items() if n > 0}
    for r in P.calibration_metrics(df).collect():
        assert 0.0 <= r.ece <= 1.0 and 0.0 <= r.brier_score <= 1.0


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", "d"]),
                          st.floats(-100, 100, allow_nan=False)), min_size=20, max_size=100))
def test_anova_partitions_total_sum_of_squares(spark, rows):
    df = spark.createDataFrame([("m", lvl, v) for lvl, v in rows],
                               "model string, distractor_set string, response_time double")
    t = INF.anova_oneway(df, dvs={"response_time": "response_time"}).collect()
    ss = {r.source: r.ss for r in t}
    vals = np.array([v for _, v in rows])
    total = float(((vals - vals.mean()) ** 2).sum())
    assert math.isclose(ss["distractor_set"] + ss["Within"], total, rel_tol=1e-9, abs_tol=1e-6)
