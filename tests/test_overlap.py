"""N-gram precision and common subsequences by hand and by brute force."""

import math
import random

from optiq.operators import overlap as OV


def slow_lcs(h, r):
    best = [[0] * (len(r) + 1) for _ in range(len(h) + 1)]
    for i, x in enumerate(h):
        for j, y in enumerate(r):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def slow_clipped(h, r, n):
    left = [tuple(r[i:i + n]) for i in range(len(r) - n + 1)]
    found = 0
    for i in range(len(h) - n + 1):
        if tuple(h[i:i + n]) in left:
            left.remove(tuple(h[i:i + n]))
            found += 1
    return found


def test_pair_scores_equal_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        h, r = ([rng.randrange(6) for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert OV.lcs_length(h, r) == slow_lcs(h, r)
        assert [OV.clipped(h, r, n) for n in range(1, 5)] == [slow_clipped(h, r, n) for n in range(1, 5)]


PAIRS = [  # reference, hypothesis, lcs, precisions, bleu
    ("the cat is on the mat", "the the the the the the the", 2, [2 / 7, 0.0, 0.0, 0.0],
     math.exp((math.log(2 / 7) + math.log(1 / 7) + math.log(1 / 6) + math.log(1 / 5)) / 4)),
    ("a b c d", "a b c d", 4, [1.0, 1.0, 1.0, 1.0], 1.0),
    ("a b c d", "a b", 2, [1.0, 1.0, None, None], math.exp(1 - 4 / 2)),
    ("a b", "c", 0, [0.0, None, None, None], 0.0),
    ("", "a", 0, [0.0, None, None, None], 0.0),
    ("a", "", 0, [None] * 4, 0.0),
    (None, None, 0, [None] * 4, 0.0),
]


def test_scores_by_hand(spark):
    df = spark.createDataFrame([(i, r, h) for i, (r, h, *_) in enumerate(PAIRS)], "id int, reference string, hypothesis string")
    lcs = {r.id: r for r in OV.lcs_overlap(df, ["id"]).collect()}
    grams = {r.id: r for r in OV.ngram_precision(df, ["id"]).collect()}
    for i, (_, _, n, precisions, bleu) in enumerate(PAIRS):
        assert lcs[i].lcs == n and [grams[i][f"precision_{k}"] for k in range(1, 5)] == precisions
        assert math.isclose(grams[i].bleu, bleu, abs_tol=1e-12)
    assert math.isclose(lcs[2].f, 2 / 3) and lcs[2].precision == 1 and lcs[2].recall == 0.5 and lcs[5].f == 0


def test_corpus_score_sums_counts_first(spark):
    rows = [(0, "a b c d e", "a b c d x"), (0, "v w x y", "w x y z"), (1, "a b", "c d"), (1, None, "a")]
    df = spark.createDataFrame(rows, "g int, reference string, hypothesis string").repartition(3)
    got = {r.g: r for r in OV.corpus_bleu(df, ["g"]).collect()}
    # matches 7, 5, 3, 1 of 9, 7, 5, 3
    assert got[0].n_pairs == 2 and math.isclose(got[0].bleu, (7 / 9 * 5 / 7 * 3 / 5 * 1 / 3) ** 0.25)
    assert got[1].n_pairs == 2 and got[1].bleu == 0


def test_long_pairs(spark):
    text = " ".join(f"w{i % 977}" for i in range(20_000))
    df = spark.createDataFrame([(1, text, text + " end")], "id int, reference string, hypothesis string")
    assert OV.lcs_overlap(df, ["id"]).first().lcs == 20_000 and OV.ngram_precision(df, ["id"]).first().bleu > 0.99
