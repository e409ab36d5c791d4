"""Overlap of a hypothesis with a reference: n-gram precision and longest common subsequence.

Both work inside the row on Arrow batches, linear in memory and without exploding a
pair's tokens, so long pairs are fine; nothing is shuffled but the corpus-level sums,
which are combined in each task.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optiq.operators.textsim import tokenize

#: Longest n-grams.
ORDER = 4


def _ids(hs: pa.Array, rs: pa.Array):
    """The tokens of each pair as numbers of one dictionary (a null list: none)."""
    words = pa.concat_arrays([pc.list_flatten(hs), pc.list_flatten(rs)]).dictionary_encode()
    ids = words.indices.to_numpy(zero_copy_only=False)

    def cuts(lists):
        return np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(
            zero_copy_only=False)))).tolist()

    a, b = cuts(hs), cuts(rs)
    for i in range(len(hs)):
        yield ids[a[i]:a[i + 1]].tolist(), ids[a[-1] + b[i]:a[-1] + b[i + 1]].tolist()


def clipped(h: list, r: list, n: int) -> int:
    """n-grams of ``h`` that ``r`` has as well, each as often as in both at most."""
    grams = [Counter(zip(*(x[k:] for k in range(n)), strict=False)) for x in (h, r)]
    return sum((grams[0] & grams[1]).values())


def lcs_length(h: list, r: list) -> int:
    """Length of the longest common subsequence: a row of the table as one number's bits."""
    if len(h) < len(r):
        h, r = r, h
    places: dict = {}
    for j, x in enumerate(r):
        places[x] = places.get(x, 0) | 1 << j
    whole = row = (1 << len(r)) - 1
    for x in h:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & whole
    return len(r) - row.bit_count()


def ngram_counts(pairs: DataFrame, keys: list[str], reference: str = "reference", hypothesis: str = "hypothesis",
                 mode: str = "lower", order: int = ORDER) -> DataFrame:
    """keys, h_len, r_len, ``matched`` and ``total``: clipped matches and number of the
    hypothesis' n-grams for n = 1..order."""
    kind = pa.struct([("h_len", pa.int64()), ("r_len", pa.int64()), ("matched", pa.list_(pa.int64())),
                      ("total", pa.list_(pa.int64()))])

    def run(hs: pa.Array, rs: pa.Array) -> pa.Array:
        return pa.array([{"h_len": len(h), "r_len": len(r), "matched": [clipped(h, r, n) for n in range(1, order + 1)],
                          "total": [max(0, len(h) - n + 1) for n in range(1, order + 1)]}
                         for h, r in _ids(hs, rs)], type=kind)

    made = F.arrow_udf(run, "h_len long, r_len long, matched array<long>, total array<long>").asNondeterministic()
    return pairs.select(*keys, made(tokenize(F.col(hypothesis), mode), tokenize(F.col(reference), mode)).alias("c")) \
        .select(*keys, "c.*")


def _bleu(matched: list[Column], total: list[Column], h_len: Column, r_len: Column, smooth: bool) -> Column:
    """Brevity penalty times the geometric mean of the precisions. ``smooth`` adds one to
    both counts of n-grams longer than one; without it a count of 0 makes 0."""
    add = [0.0 if i == 0 or not smooth else 1.0 for i in range(len(matched))]
    some = matched[0] > 0
    for m, a in zip(matched, add, strict=True):
        some = some & (m + a > 0)
    logs = sum((F.ln((m + a) / (t + a)) for m, t, a in zip(matched, total, add, strict=True)), F.lit(0.0))
    short = F.least(F.lit(0.0), F.lit(1.0) - r_len / h_len)
    return F.when(some & (h_len > 0), F.exp(short + logs / len(matched))).otherwise(F.lit(0.0))


def ngram_precision(pairs: DataFrame, keys: list[str], order: int = ORDER, **how) -> DataFrame:
    """keys, precision_1..order and ``bleu`` (smoothed) of each pair; precisions of n-grams
    that the hypothesis is too short for are null, and bleu is 0 without a common word."""
    counts = ngram_counts(pairs, keys, order=order, **how)
    m = [F.get("matched", F.lit(i)) for i in range(order)]
    t = [F.get("total", F.lit(i)) for i in range(order)]
    each = [F.try_divide(a, b).alias(f"precision_{i + 1}") for i, (a, b) in enumerate(zip(m, t, strict=True))]
    return counts.select(*keys, *each, _bleu(m, t, F.col("h_len"), F.col("r_len"), True).alias("bleu"))


def corpus_bleu(pairs: DataFrame, by: list[str], order: int = ORDER, **how) -> DataFrame:
    """by, n_pairs and ``bleu`` of all pairs of a group together: counts are summed first."""
    counts = ngram_counts(pairs, by, order=order, **how)
    sums = [F.sum(F.get(c, F.lit(i))).alias(f"{c}_{i}") for c in ("matched", "total") for i in range(order)]
    whole = counts.groupBy(*by).agg(F.count("*").alias("n_pairs"), F.sum("h_len").alias("h_len"),
                                    F.sum("r_len").alias("r_len"), *sums)
    bleu = _bleu([F.col(f"matched_{i}") for i in range(order)], [F.col(f"total_{i}") for i in range(order)],
                 F.col("h_len"), F.col("r_len"), False)
    return whole.select(*by, "n_pairs", bleu.alias("bleu"))


def lcs_overlap(pairs: DataFrame, keys: list[str], reference: str = "reference", hypothesis: str = "hypothesis",
                mode: str = "lower") -> DataFrame:
    """keys, lcs (tokens of the longest common subsequence), precision, recall and f (their
    harmonic mean); 0 where a text has no tokens or none in common."""
    kind = pa.struct([("lcs", pa.int64()), ("h", pa.int64()), ("r", pa.int64())])

    def run(hs: pa.Array, rs: pa.Array) -> pa.Array:
        return pa.array([{"lcs": lcs_length(h, r), "h": len(h), "r": len(r)} for h, r in _ids(hs, rs)], type=kind)

    made = F.arrow_udf(run, "lcs long, h long, r long").asNondeterministic()
    got = pairs.select(*keys, made(tokenize(F.col(hypothesis), mode), tokenize(F.col(reference), mode)).alias("c")) \
        .select(*keys, "c.*")
    p, r = (F.coalesce(F.try_divide(F.col("lcs"), F.col(n)), F.lit(0.0)) for n in ("h", "r"))
    return got.select(*keys, "lcs", p.alias("precision"), r.alias("recall"),
                      F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f"))
