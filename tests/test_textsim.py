"""METEOR scores worked out by hand, equality of its routes, vector metrics edges."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from optiq.functions import alignment as AL
from optiq.operators import textsim as TS


# score = (1 - 0.5 * (chunks / m) ** 3) * P * R / (0.9 * P + 0.1 * R)
PAIRS = [  # reference, hypothesis, score
    # 6 of 6 matched in 1 chunk
    ("the cat sat on the mat", "the cat sat on the mat", 1 - 0.5 / 216),
    # last "the" to last "the": on(3) the(4) mat(5) / the(0) cat(1) sat(2), 6 matches in
    # hypothesis order at 3, 0, 5, 4, 1, 2: chunks 3 | 0 | 5 | 4 | 1 2
    ("the cat sat on the mat", "on the mat the cat sat", 1 - 0.5 * (5 / 6) ** 3),
    ("one two three", "four five six", 0.0),
    ("", "anything", 0.0),
    # y x y against the last y x y but one: x y x y x, matches 1 2 3 or, from the
    # end, y -> 3, x -> 4, y -> 1: three chunks; P = 1, R = 3/5
    ("x y x y x", "y x y", (1 - 0.5) * (1 * 0.6) / (0.9 * 1 + 0.1 * 0.6)),
    # 1 of 2 words on either side
    ("red car", "red bus", (1 - 0.5) * 0.5),
]


def test_meteor_by_hand(spark):
    df = spark.createDataFrame([(i, r, h) for i, (r, h, _) in enumerate(PAIRS)],
                               "id int, reference string, hypothesis string")
    for cells in (TS.INLINE_MAX_CELLS, 0):
        got = {r.id: r.meteor for r in TS.meteor(df, ["id"], inline_max_cells=cells).collect()}
        for i, (reference, hypothesis, score) in enumerate(PAIRS):
            assert math.isclose(got[i], score, abs_tol=1e-12), (reference, hypothesis)


def test_meteor_null_texts_and_carried_columns(spark):
    df = spark.createDataFrame([(1, None, "a b", 0.5), (2, "a b", None, None), (3, None, None, 0.25),
                                (4, "a b", "a b", 1.0)], "id int, reference string, hypothesis string, w double")
    for cells in (TS.INLINE_MAX_CELLS, 0):
        got = TS.meteor(df, ["id"], inline_max_cells=cells, carry=("w",)).collect()
        assert {r.id: r.w for r in got} == {1: 0.5, 2: None, 3: 0.25, 4: 1.0}
        assert {r.id: r.meteor for r in got} == {1: 0.0, 2: 0.0, 3: 0.0, 4: 1 - 0.5 / 8}


def test_diversity_of_any_length(spark):
    rng = np.random.default_rng(3)
    for size in (32, 64, 384):
        vectors = rng.normal(size=(5, size))
        df = spark.createDataFrame([(1, i + 1, "s", v.tolist()) for i, v in enumerate(vectors)],
                                   "item_id long, slot int, distractor_set string, vector array<double>")
        u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        pairwise = [1 - u[i] @ u[j] for i in range(5) for j in range(i)]
        assert math.isclose(TS.diversity(df).first().diversity, np.mean(pairwise), abs_tol=1e-12)


def test_diversity_closed_form(spark):
    rng = np.random.default_rng(0)
    rows = []
    for item in range(4):
        for slot in range(1, 1 + (1 if item == 3 else 6)):
            rows.append((item, slot, "s", rng.normal(size=8).tolist()))
    df = spark.createDataFrame(rows, "item_id long, slot int, distractor_set string, vector array<double>")
    got = {r.item_id: r.diversity for r in TS.diversity(df).collect()}
    for item in range(3):
        vs = np.array([r[3] for r in rows if r[0] == item])
        u = vs / np.linalg.norm(vs, axis=1, keepdims=True)
        sims = [u[i] @ u[j] for i in range(len(u)) for j in range(i + 1, len(u))]
        assert math.isclose(got[item], 1 - np.mean(sims), abs_tol=1e-12)
    assert got[3] == 0.0  # a single distractor


def test_cosine_zero_vector_and_lexicon(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0], "Theft, and law!"), ([1.0, 0.0], [1.0, 1.0], "...")],
                               "a array<double>, b array<double>, t string")
    rows = df.select(TS.cosine(F.col("a"), F.col("b")).alias("c"),
                     TS.lexicon_relevance(F.col("t")).alias("l")).collect()
    assert rows[0].c is None and math.isclose(rows[1].c, 1 / math.sqrt(2))
    assert math.isclose(rows[0].l, 2 / 3) and rows[1].l == 0.0


STEM_PAIRS = [  # reference, hypothesis, score with the stem stage
    # "cat" and "runs" match "cats" and "running" by stem, "fast" as it is, "a" nothing:
    # m = 3 in two chunks (cat | run fast); P = 3/4, R = 3/5
    ("the cats were running fast", "a cat runs fast",
     (1 - 0.5 * (2 / 3) ** 3) * (0.75 * 0.6) / (0.9 * 0.75 + 0.1 * 0.6)),
    # both words match by stem from the end, in one chunk; P = 1, R = 2/3
    ("connected connections connect", "connecting connection",
     (1 - 0.5 / 8) * (2 / 3) / (0.9 + 0.1 * 2 / 3)),
    # both match, in the other order: two chunks of two; P = 1, R = 2/3
    ("generalizations of oscillators", "oscillator generalization",
     (1 - 0.5) * (2 / 3) / (0.9 + 0.1 * 2 / 3)),
]


def test_meteor_stem_stage_by_hand(spark):
    df = spark.createDataFrame([(i, r, h) for i, (r, h, _) in enumerate(STEM_PAIRS)],
                               "id int, reference string, hypothesis string")
    got = {r.id: r.meteor for r in TS.meteor(df, ["id"], stem_stage=True).collect()}
    for i, (reference, hypothesis, score) in enumerate(STEM_PAIRS):
        assert math.isclose(got[i], score, abs_tol=1e-12), (reference, hypothesis)


def test_meteor_routes_agree(spark):
    """Inline (short pairs) and set-based (long pairs) alignments give equal scores."""
    df = spark.createDataFrame([(i, r, h) for i, (r, h, _) in enumerate([*PAIRS, *STEM_PAIRS])],
                               "id int, reference string, hypothesis string")
    inline = {r.id: r.meteor for r in TS.meteor(df, ["id"], inline_max_cells=10 ** 6).collect()}
    setwise = {r.id: r.meteor for r in TS.meteor(df, ["id"], inline_max_cells=0).collect()}
    assert inline.keys() == setwise.keys()
    for k in inline:
        assert math.isclose(inline[k], setwise[k], abs_tol=1e-12)


SYNONYMS = [("car", "auto.n"), ("automobile", "auto.n"), ("big", "large.a"), ("large", "large.a"), ("grand", "large.a"),
            ("bank", "slope.n"), ("bank", "money.n"), ("hill", "slope.n"), ("fund", "money.n"), (None, "x"), ("x", None)]
SYNONYM_PAIRS = [  # reference, hypothesis, score with the synonym stage
    # the = the, automobile ~ car, big ~ large; 3 of 3 in one chunk
    ("the big car", "the large automobile", 1 - 0.5 / 27),
    # the last "grand" takes "big", the first nothing is left for: m = 1, P = 1/2, R = 1/2
    ("big tree", "grand grand", 0.5 * 0.5),
    # last first: fund takes bank (the only money word); hill finds no free slope word
    ("a bank", "hill fund", 0.5 * 0.5),
    # equal words match first: car to car, automobile is left without a partner
    ("car", "automobile car", 0.5 * (0.5 * 1) / (0.9 * 0.5 + 0.1 * 1)),
    ("x y", "z w", 0.0),
]


def test_meteor_synonym_stage_by_hand(spark):
    df = spark.createDataFrame([(i, r, h, float(i)) for i, (r, h, _) in enumerate(SYNONYM_PAIRS)] + [(99, None, "car", 9.0)],
                               "id int, reference string, hypothesis string, w double")
    syn = spark.createDataFrame(SYNONYMS * 2, "token string, synset string")
    rows = TS.meteor(df, ["id"], synonyms=syn, carry=("w",)).collect()
    got = {r.id: r.meteor for r in rows}
    assert len(rows) == len(SYNONYM_PAIRS) + 1 and got[99] == 0.0 and all(r.w == r.id for r in rows if r.id < 99)
    for i, (reference, hypothesis, score) in enumerate(SYNONYM_PAIRS):
        assert math.isclose(got[i], score, abs_tol=1e-12), (reference, hypothesis, got[i])


def test_shared_members_equal_a_scan():
    rng = random.Random(5)
    for _ in range(500):
        h = [(i, rng.sample("abcdefg", rng.randint(1, 3))) for i in range(rng.randint(0, 8))]
        r = [(i, rng.sample("abcdefg", rng.randint(1, 3))) for i in range(rng.randint(0, 8))]
        free, want = dict(r), []
        for i, members in reversed(h):
            hits = [j for j in sorted(free, reverse=True) if set(free[j]) & set(members)]
            if hits:
                want.append((i, hits[0]))
                free.pop(hits[0])
        assert AL.by_members(h, r) == want


def test_synonyms_after_stems(spark):
    df = spark.createDataFrame([(1, "large cars", "big automobile car")], "id int, reference string, hypothesis string")
    syn = spark.createDataFrame(SYNONYMS, "token string, synset string")
    # car matches cars by stem, big ~ large by synset: m = 2, two chunks; P = 2/3, R = 1
    want = (1 - 0.5) * (2 / 3) / (0.9 * 2 / 3 + 0.1)
    assert math.isclose(TS.meteor(df, ["id"], stem_stage=True, synonyms=syn).first().meteor, want)


def test_stem_stage_of_both_alignments(spark):
    df = spark.createDataFrame([(i, r, h) for i, (r, h, _) in enumerate([*PAIRS, *STEM_PAIRS])],
                               "id int, reference string, hypothesis string")
    rows = [{r.id: r.meteor for r in TS.meteor(df, ["id"], stem_stage=True, inline_max_cells=c).collect()} for c in (1, 0)]
    assert rows[0].keys() == rows[1].keys() and all(math.isclose(rows[0][k], rows[1][k], abs_tol=1e-12) for k in rows[0])


TREEBANK = [  # text, tokens
    ("They'll save and invest more.", "they 'll save and invest more ."),
    ("hi, my name can't hello,", "hi , my name ca n't hello ,"),
    ('"We beat some pretty good teams," he said.', "`` we beat some pretty good teams , '' he said ."),
    ("Good muffins cost $3.88 in New York.", "good muffins cost $ 3.88 in new york ."),
    ("Wait... what? No!", "wait ... what ? no !"),
    ("cannot gimme [x] (y) {z} <w>", "can not gim me [ x ] ( y ) { z } < w >"),
    ("the dogs' bone, the dog's bone", "the dogs ' bone , the dog 's bone"),
    ("one--two; three: four 10:30 1,000", "one -- two ; three : four 10:30 1,000"),
    ("e.g. Mr. X lives here.", "e.g. mr. x lives here ."),
    ("'tis a “quoted” word.", "'t is a “ quoted ” word ."),
    ("", ""), ("  ", ""), (".", "."),
]


def test_treebank_tokens(spark):
    df = spark.createDataFrame([(t,) for t, _ in TREEBANK] + [(None,)], "t string")
    got = [r[0] for r in df.select(F.array_join(TS.tokenize(F.col("t"), "treebank"), " ")).collect()]
    assert got == [want for _, want in TREEBANK] + [None]


def test_plain_texts_skip_rewrites_that_change_nothing(spark):
    rng = random.Random(9)
    parts = ["word", "Wort", "é", ".", "..", "...", ",", ":", "!", "?", "3,5", "10:30", " ", "  ", "\n", "-", "'s", "can't", "(x)", "cannot", "a--b", ";"]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 14)))) for i in range(1500)]
    df = spark.createDataFrame(rows, "i int, t string")
    fast = [r[1] for r in df.select("i", F.array_join(TS.tokenize(F.col("t"), "treebank"), " ")).orderBy("i").collect()]
    held = TS.TREEBANK_MARKS
    TS.TREEBANK_MARKS = ""  # every text takes all rewrites
    try:
        full = [r[1] for r in df.select("i", F.array_join(TS.tokenize(F.col("t"), "treebank"), " ")).orderBy("i").collect()]
    finally:
        TS.TREEBANK_MARKS = held
    assert fast == full


def test_equal_texts_are_cut_into_words_once():
    import pyarrow as pa
    from optiq.functions import alignment as AL
    seen = []

    def words(texts):
        seen.extend(texts.to_pylist())
        return TS.treebank("treebank")(texts)

    h, r = AL.token_lists(pa.array(["A b.", "c, d", None]), pa.array(["A b."] * 3), words)
    assert sorted(seen) == ["A b.", "c, d"]
    assert h.to_pylist() == [["a", "b", "."], ["c", ",", "d"], None] and r.to_pylist() == [["a", "b", "."]] * 3


def test_synonym_stage_holds_one_pair_at_a_time():
    import tracemalloc
    import pyarrow as pa
    from optiq.functions import alignment as AL
    entries = [{"side": 1 + i % 2, "p": i // 2, "members": [f"set-{i // 2}", f"other-{i}"]} for i in range(60)]
    rest = pa.array([entries] * 1500)
    found = pa.array([{"h": [], "r": []}] * 1500, type=AL.MATCHES)
    tracemalloc.start()
    got = AL.added(found, rest)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [{"m": 30, "chunks": 1}] * 1500 and peak < 5_000_000
