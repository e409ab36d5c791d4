"""Results that must equal the committed reference outputs."""

import csv
import math
import os

from pyspark.sql import functions as F

from optiq.functions.distributions import f_sf, studentized_range_sf
from optiq.operators import inference as INF
from optiq.operators import reshape as RS
from optiq.operators import textsim as TS
from optiq.sources import files as FS

from conftest import FIXTURES

GOLD = os.path.join(FIXTURES, "golden")


def _csv(name):
    with open(os.path.join(GOLD, name)) as f:
        return list(csv.DictReader(f))


def _group_stats(spark):
    """(model, dependent_var, level, n, mean, var) from the published per-cell stats."""
    rows = []
    for r in _csv("type_stats.csv"):
        n = int(r["is_correct_count"])
        m = float(r["is_correct_mean"])
        rows.append((r["model"], "accuracy", r["distractor_set"], n, m, m * (1 - m) * n / (n - 1)))
        rows.append((r["model"], "response_time", r["distractor_set"], n,
                     float(r["response_time_mean"]), float(r["response_time_std"]) ** 2))
    return spark.createDataFrame(rows, "model string, dependent_var string, level string, "
                                       "n long, mean double, var double")


def test_anova_matches_golden(spark):
    got = {(r.model, r.dependent_var, r.source): r for r in
           INF.anova_table(_group_stats(spark), with_p=True).collect()}
    checked = 0
    for g in _csv("anova.csv"):
        key = (g["model"], g["dependent_var"], g["Source"])
        if key not in got:
            continue  # confidence: per-cell non-null counts are not published
        r = got[key]
        assert math.isclose(r.ss, float(g["SS"]), rel_tol=1e-9)
        assert r.df == int(g["DF"])
        if g["F"]:
            assert math.isclose(r.f, float(g["F"]), rel_tol=1e-9)
            assert math.isclose(r.p_unc, float(g["p-unc"]), rel_tol=1e-9, abs_tol=1e-12)
            assert math.isclose(r.np2, float(g["np2"]), rel_tol=1e-9)
        checked += 1
    assert checked == 12


def test_tukey_matches_golden(spark):
    stats = _group_stats(spark)
    got = {(r.model, r.dependent_var, r.A, r.B): r for r in
           INF.tukey_hsd(stats, with_p=True).collect()}
    checked = 0
    for g in _csv("posthoc.csv"):
        key = (g["model"], g["dependent_var"], g["A"], g["B"])
        sign = 1.0
        if key not in got:  # fixture names sort differently: same pair, other orientation
            key, sign = (g["model"], g["dependent_var"], g["B"], g["A"]), -1.0
        r = got[key]
        for col, gcol, s in (("diff", "diff", sign), ("se", "se", 1.0), ("t", "T", sign),
                             ("hedges", "hedges", sign), ("p_tukey", "p-tukey", 1.0)):
            assert math.isclose(s * getattr(r, col), float(g[gcol]), rel_tol=1e-7,
                                abs_tol=1e-10), (key, col)
        checked += 1
    assert checked == 45


def test_tail_functions():
    assert math.isclose(f_sf(1.4771551724137937, 5, 894), 0.19469449533695643, rel_tol=1e-10)
    assert 0 < studentized_range_sf(3.0, 6, 894) < 1


def test_lexicon_relevance_describe_matches_golden(spark):
    sets = FS.scan_distractor_sets(spark, FIXTURES, glob="set*.json")
    d = sets.select("distractor_set", F.explode(F.map_values("distractors")).alias("d"))
    long = d.select("distractor_set", F.lit("legal_relevance_scores").alias("metric"),
                    TS.lexicon_relevance(F.col("d")).alias("value"))
    got = {r.distractor_set: r for r in
           RS.describe_by_group(long, ["distractor_set", "metric"]).collect()}
    rows = [g for g in _csv("quality_summary.csv") if g["metric"] == "legal_relevance_scores"]
    assert len(rows) == 5
    for g in rows:
        r = got[g["distractor_set"]]
        assert r["count"] == int(float(g["count"]))
        for col, gcol in (("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"),
                          ("q50", "50%"), ("q75", "75%"), ("max", "max")):
            assert math.isclose(r[col], float(g[gcol]), abs_tol=1e-12), (g["distractor_set"], col)


def test_tukey_gate_keeps_significant_anovas(spark):
    """With the p < 0.05 gate, exactly the published post-hoc pairs remain."""
    got = INF.tukey_hsd(_group_stats(spark), alpha=0.05, with_p=True).collect()
    have = {(r.model, r.dependent_var) for r in got}
    want = {(g["model"], g["dependent_var"]) for g in _csv("posthoc.csv")}
    assert have == want and len(got) == 45
