"""The analysis stage as one call: every statistics table of the analyser,
computed from graded replies and written with the parquet sink."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from optiq.operators import inference as INF
from optiq.operators import psychometrics as P
from optiq.operators import summary as S
from optiq.session import cut_lineage
from optiq.sources.files import sink_parquet


def write_analysis(responses: DataFrame, out_dir: str, with_p: bool = True) -> dict[str, str]:
    """Item analysis, per (model, set) statistics, ANOVA and gated Tukey
    post-hoc tests, reliability bins and calibration metrics.

    The responses are materialised once (reliable checkpoint) because every
    table reads them; each table is its own job and is written as parquet.
    """
    r = cut_lineage(responses)
    stats = INF.group_stats(r)
    tables = {
        "psychometric_analysis": P.item_analysis(r),
        "distractor_type_analysis": S.distractor_stats(r),
        "anova_results": INF.anova_table(stats, with_p=with_p),
        "posthoc_results": INF.tukey_hsd(stats, alpha=0.05 if with_p else None, with_p=with_p),
        "reliability_bins": P.reliability_bins(r),
        "calibration_metrics": P.calibration_metrics(r),
    }
    paths = {}
    for name, df in tables.items():
        paths[name] = os.path.join(out_dir, name)
        sink_parquet(df, paths[name])
    return paths
