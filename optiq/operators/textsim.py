"""Distractor quality: token overlap (METEOR), embedding cosine, diversity,
lexicon relevance and rule-based grammar scores.

METEOR aligns each pair inside its row (Arrow batches, linear in tokens, no
shuffle); a set-based alignment with equal scores (tokens exploded once,
occurrences numbered by a window, positions paired by grouping, chunks counted
with a window over each pair's matches) needs no Python. Diversity uses the
closed form over unit vectors instead of emitting all pairs of a group.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from optiq.functions import alignment as AL
from optiq.functions.treebank import tokenizer
from optiq.session import cut_lineage

# ---- fixed values --------------------------------------------------------------
# keyword set of the legacy relevance metric
LEGAL_KEYWORDS = ["theft", "robbery", "assault", "battery", "fraud", "trespassing", "burglary",
                  "law", "jurisdiction"]
# Python's string.punctuation (ASCII)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# words (letters, digits, underscore of any script) and single marks
WORD_OR_MARK = r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"
# Treebank word tokens: rewrites in order, the text then has a space at either end before
# those of TREEBANK_ENDS; tokens are what white space separates
TREEBANK = [
    (r"([«“‘„]|`+)", r" \1 "),
    (r'^"', "``"),
    (r"(``)", r" \1 "),
    (r"""([ (\[{<])("|'{2})""", r"\1 `` "),
    (r"""([^.])(\.)([\])}>"'»”’ ]*)\s*$""", r"\1 \2 \3 "),
    (r"([:,])([^0-9])", r" \1 \2"),
    (r"([:,])$", r" \1 "),
    (r"(\.{2,})", r" \1 "),
    (r"([;@#$%&])", r" \1 "),
    (r"([?!])", r" \1 "),
    (r"([^'])' ", r"\1 ' "),
    (r"([*])", r" \1 "),
    (r"([\]\[(){}<>])", r" \1 "),
    (r"--", " -- "),
]
TREEBANK_ENDS = [
    (r"([»”’])", r" \1 "),
    (r"''", " '' "),
    (r'"', " '' "),
    (r"\s+", " "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", r"\1 \2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1 \2 "),
    (r" ([Cc][Aa][Nn])([Nn][Oo][Tt]) ", r" \1 \2 "),
    (r" ([Gg][Ii][Mm])([Mm][Ee]) ", r" \1 \2 "),
    (r" ([Gg][Oo][Nn])([Nn][Aa]) ", r" \1 \2 "),
    (r" ([Gg][Oo][Tt])([Tt][Aa]) ", r" \1 \2 "),
    (r" ([Ll][Ee][Mm])([Mm][Ee]) ", r" \1 \2 "),
    (r" ([Ww][Aa][Nn])([Nn][Aa]) ", r" \1 \2 "),
    (r" ('[Tt])([Ii][Ss]|[Ww][Aa][Ss]) ", r" \1 \2 "),
]
# a text without any of these needs the rewrites of final stops, colons and commas,
# ellipses, question and exclamation marks only (their places in TREEBANK)
TREEBANK_MARKS = r"""[«“‘„`"'\[\](){}<>;@#$%&*»”’]|--|(?i:cannot|gimme|gonna|gotta|lemme|wanna)"""
TREEBANK_PLAIN = (4, 5, 6, 7, 9)
TREEBANK_STOPS = "[.,:?!]"   # without any of these it needs none
# METEOR parameters (Lavie & Agarwal 2007 defaults)
ALPHA, BETA, GAMMA = 0.9, 3.0, 0.5
# Grammar rule table (regex rules counted per text); re-aimed from a parser-based check
GRAMMAR_RULES = {
    "double_space": r"  ",
    "space_before_punct": r" [,.;:!?]",
    "lowercase_start": r"^[a-z]",
    "missing_final_stop": r"[^.!?]$",
}
# ---------------------------------------------------------------------------------


def treebank(mode: str):
    """Arrow strings to token lists: ``treebank`` or ``treebank_cased``."""
    return tokenizer(TREEBANK, TREEBANK_ENDS, TREEBANK_MARKS, TREEBANK_PLAIN, TREEBANK_STOPS, mode == "treebank")


def tokenize(text: Column, mode: str = "lower") -> Column:
    """``lower``: lower().split(); ``raw``: split(); ``punct``: words and single
    punctuation marks as separate tokens; ``treebank``: the ordered rewrites of
    treebank tokenizers (clitics, quotes, brackets, final stop, ellipses), lower-cased;
    ``treebank_cased``: the same with the case kept."""
    if mode.startswith("treebank"):
        run = treebank(mode)
        return F.arrow_udf(lambda texts: run(texts), "array<string>").asNondeterministic()(text)
    if mode == "punct":
        return F.regexp_extract_all(text, F.lit(WORD_OR_MARK), 1)
    t = F.lower(text) if mode == "lower" else text
    return F.filter(F.split(t, r"(?U)\s+"), lambda x: x != "")


def lexicon_relevance(text: Column, lexicon: list[str] = LEGAL_KEYWORDS) -> Column:
    """|distinct tokens in lexicon| / |distinct tokens|; 0 without tokens.
    Tokens: lower-case, ASCII punctuation deleted, whitespace split.
    One fold over the distinct tokens counts both sides (tokens built once)."""
    toks = F.array_distinct(F.filter(
        F.split(F.translate(F.lower(text), PUNCTUATION, ""), r"\s+"), lambda x: x != ""))
    lex = F.array(*[F.lit(w) for w in lexicon])
    init = F.struct(F.lit(0).alias("n"), F.lit(0).alias("hit"))
    return F.aggregate(
        toks, init,
        lambda acc, x: F.struct((acc["n"] + 1).alias("n"),
                                (acc["hit"] + F.array_contains(lex, x).cast("int")).alias("hit")),
        lambda acc: F.when(acc["n"] > 0, acc["hit"] / acc["n"]).otherwise(F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; NULL for a zero vector."""
    return F.try_divide(dot(a, b), F.nullif(norm(a) * norm(b), F.lit(0.0)))


def unit(a: Column, n: Column) -> Column:
    """``a`` scaled to length 1, given its norm ``n`` as a column (computing the
    norm inside the lambda would redo it for every element)."""
    return F.when(n > 0, F.transform(a, lambda x: x / n))


def cosine_to_answer(slots: DataFrame) -> DataFrame:
    """cos(correct answer, each distractor) per item: slot 0 joined to slots 1..n
    on item_id (unique per side, so no hot key)."""
    ans = slots.where(F.col("slot") == 0).select("item_id", F.col("vector").alias("answer_vec"))
    dis = slots.where(F.col("slot") > 0)
    return (dis.join(ans, "item_id")
            .select("item_id", "slot", "distractor_set",
                    cosine(F.col("answer_vec"), F.col("vector")).alias("similarity")))


def vector_sums(rows: DataFrame, by: list[str], groups: int = 4096) -> DataFrame:
    """by, n, s: number and sum of the vectors (last column of ``rows``) of each group, a row
    from every task that holds any; a task sends on what it has after ``groups`` groups."""
    out = T.StructType([*rows.select(*by).schema.fields, T.StructField("n", T.LongType()),
                        T.StructField("s", T.ArrayType(T.DoubleType()))])

    def run(batches):
        kinds = None
        held: dict = {}

        def flush():
            keys = list(zip(*held, strict=True))
            return pa.RecordBatch.from_arrays(
                [*[pa.array(k, t) for k, t in zip(keys, kinds, strict=True)], pa.array([n for n, _ in held.values()], pa.int64()),
                 pa.array([s for _, s in held.values()], pa.list_(pa.float64()))], names=[*by, "n", "s"])

        for batch in batches:
            kinds = [c.type for c in batch.columns[:-1]]
            vectors = batch.column(len(by))
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.list_value_length(vectors).to_numpy(zero_copy_only=False)).tolist()
            for key, a, b in zip(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True), [0, *ends[:-1]], ends, strict=True):
                n, s = held.get(key, (0, None))
                v = flat[a:b]
                if s is not None and len(s) != len(v):
                    size = max(len(s), len(v))
                    s, v = (np.pad(x, (0, size - len(x))) for x in (s, v))
                held[key] = (n + 1, v.copy() if s is None else s + v)
            if len(held) >= groups:
                yield flush()
                held = {}
        if held:
            yield flush()

    return rows.mapInArrow(run, out)


def diversity(slots: DataFrame, group: str = "item_id",
              empty_value: float | None = 0.0) -> DataFrame:
    """1 - mean pairwise cosine of a group's distractors (= mean cosine distance).

    Closed form: with unit vectors u_i, sum_{i<j} u_i.u_j = (|sum u|^2 - n) / 2,
    so sums of vectors of any length, made in each task and then merged as arrays,
    replace all pairs. The grouping is (``group``, distractor_set).
    Groups with fewer than two vectors get ``empty_value``.
    """
    u = (slots.where(F.col("slot") > 0).withColumn("_norm", norm(F.col("vector")))
         .withColumn("_u", unit(F.col("vector"), F.col("_norm"))).where(F.col("_u").isNotNull()))
    by = [group, "distractor_set"]
    partial = vector_sums(u.select(*by, "_u"), by)
    # a group has a row from each task that holds any of it: these are few, whatever its size
    sums = partial.groupBy(*by).agg(F.sum("n").alias("n"), F.collect_list("s").alias("_parts")).select(
        *by, "n", F.aggregate(F.slice("_parts", 2, F.size("_parts")), F.get("_parts", F.lit(0)), lambda a, x: F.zip_with(
            a, x, lambda p, q: F.coalesce(p, F.lit(0.0)) + F.coalesce(q, F.lit(0.0)))).alias("_s"))
    sums = sums.select(*by, "n", dot(F.col("_s"), F.col("_s")).alias("_sq"))
    n = F.col("n")
    mean_cos = (F.col("_sq") - n) / (n * (n - 1))
    return sums.select(group, "distractor_set", n.alias("n_distractors"),
                       F.when(n >= 2, F.lit(1.0) - mean_cos)
                       .otherwise(F.lit(empty_value).cast("double")).alias("diversity"))


def cosine_paired(orig: DataFrame, new: DataFrame, key: str = "question") -> DataFrame:
    """i-th original option vs i-th new distractor, mean per question; 0 if none.

    Positional pairing is an equi-join on (question, position): lists of
    unequal length are truncated to the shorter, as zip() does.
    """
    o = orig.select(key, "pos", F.col("vector").alias("a"))
    n = new.select(key, "pos", F.col("vector").alias("b"))
    sims = o.join(n, [key, "pos"]).select(key, cosine(F.col("a"), F.col("b")).alias("s"))
    keys = orig.select(key).union(new.select(key)).distinct()
    per = sims.groupBy(key).agg(F.avg("s").alias("semantic_similarity"))
    return keys.join(per, key, "left").select(
        key, F.coalesce(F.col("semantic_similarity"), F.lit(0.0)).alias("semantic_similarity"))


# ---------------------------------------------------------------- METEOR
def _meteor_setwise(pairs: DataFrame, keys: list[str], reference: str = "reference",
                    hypothesis: str = "hypothesis", mode: str = "lower",
                    alpha: float = ALPHA, beta: float = BETA, gamma: float = GAMMA,
                    stem_stage: bool = False, tokenized: bool = False,
                    carry: tuple[str, ...] = ()) -> DataFrame:
    """Unigram METEOR per pair of texts: exact-match stage, and with
    ``stem_stage`` a second stage that re-matches leftover tokens on their
    Porter stem (the stemmer runs once per distinct leftover token).

    Alignment: the k-th last hypothesis occurrence of a token matches its k-th
    last reference occurrence (the greedy scan's result), found by grouping
    on (pair, token, occurrence). Chunks are counted over matches in
    hypothesis order: a new chunk starts where either position does not
    continue the previous match.
    Score = F_mean * (1 - gamma * (chunks/m)^beta), F_mean = PR / (alpha P + (1-alpha) R);
    0 without matches or with an empty side.

    One linear plan, two shuffles, the pair table read once: both token lists
    are exploded together (side 1 = hypothesis, 2 = reference) with one
    sentinel row per pair that carries the lengths; a window on (pair, token)
    numbers occurrences per side; an aggregate on (pair, token, occurrence)
    pairs the positions; a window on the pair counts chunk breaks.
    """
    arr_t = "array<struct<side:int,p:int,tok:string>>"

    def side(arr: Column, code: int) -> Column:
        n = F.size(arr)
        z = F.arrays_zip(F.array_repeat(F.lit(code), n),
                         F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), arr).cast(arr_t)
        return F.when(n > 0, z).otherwise(F.array().cast(arr_t))  # also for a null text

    if tokenized:
        toks = pairs.select(*keys, *carry, F.col(hypothesis).alias("_h"), F.col(reference).alias("_r"))
    else:
        toks = pairs.select(*keys, *carry, tokenize(F.col(hypothesis), mode).alias("_h"),
                            tokenize(F.col(reference), mode).alias("_r"))
    sentinel = F.array(F.struct(F.lit(0).alias("side"), F.lit(-1).alias("p"),
                                F.lit(None).cast("string").alias("tok")))
    rows = F.concat(side(F.col("_h"), 1), side(F.col("_r"), 2), sentinel)
    # lengths and carried columns ride on the sentinel row alone
    lengths = [F.coalesce(F.size(c), F.lit(0)).alias(n) for c, n in (("_h", "h_len"), ("_r", "r_len"))]
    tok = toks.select(*keys, *carry, *lengths, F.explode(rows).alias("e")).select(
        *keys, *[F.when(F.col("e.side") == 0, F.col(c)).alias(c) for c in carry],
        "h_len", "r_len", "e.side", "e.p", "e.tok")
    sd = F.col("side")
    hp, rp = F.col("hp"), F.col("rp")

    def align(rows: DataFrame, key: str) -> DataFrame:
        """Greedy last-to-last alignment on ``key``: occurrences are numbered
        from the end per side inside one (pair, key) partition, then grouped."""
        w_occ = (Window.partitionBy(*keys, key).orderBy(sd, F.col("p").desc())
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        occ = F.when(sd == 1, F.sum((sd == 1).cast("int")).over(w_occ)).otherwise(
            F.sum((sd == 2).cast("int")).over(w_occ))
        return (rows.withColumn("occ", occ).groupBy(*keys, key, "occ")
                .agg(F.max(F.when(sd == 1, F.col("p"))).alias("hp"),
                     F.max(F.when(sd == 2, F.col("p"))).alias("rp"),
                     F.max(F.when(sd == 0, F.col("h_len"))).alias("h_len"),
                     F.max(F.when(sd == 0, F.col("r_len"))).alias("r_len"),
                     *[F.max(c).alias(c) for c in carry]))

    g = align(tok, "tok")
    both = hp.isNotNull() & rp.isNotNull()
    out_cols = [*keys, *carry, "h_len", "r_len", "h_pos", "r_pos"]
    if stem_stage and carry:
        raise ValueError("carried columns are not supported with the stem stage")
    if not stem_stage:
        # one branch: the length row and unmatched rows get NULL positions
        g = g.select(*keys, *carry, "h_len", "r_len", F.when(both, hp).alias("h_pos"),
                     F.when(both, rp).alias("r_pos"))
    else:
        from optiq.functions.stemmer import stem
        from optiq.operators.joins import join_bounded
        base = cut_lineage(g)  # one materialisation feeds the three branches below
        lens_exact = base.select(*keys, "h_len", "r_len", F.when(both, hp).alias("h_pos"),
                                 F.when(both, rp).alias("r_pos"))
        left = base.where(hp.isNull() != rp.isNull()).select(
            *keys, F.when(hp.isNotNull(), F.lit(1)).otherwise(F.lit(2)).alias("side"),
            F.coalesce(hp, rp).alias("p"), "tok",
            F.lit(None).cast("long").alias("h_len"), F.lit(None).cast("long").alias("r_len"))
        vocab = left.select("tok").distinct().withColumn("stem", stem(F.col("tok")))
        g2 = align(join_bounded(left, vocab, "tok"), "stem")
        g = lens_exact.unionByName(g2.where(both).select(
            *keys, F.lit(None).cast("long").alias("h_len"), F.lit(None).cast("long").alias("r_len"),
            hp.alias("h_pos"), rp.alias("r_pos")))
    g = g.select(*out_cols)
    # matches in hypothesis order; the length row has NULL h_pos and sorts first
    w = Window.partitionBy(*keys).orderBy(F.col("h_pos").asc_nulls_first())
    brk = F.when(F.col("h_pos").isNotNull(),
                 (F.lag("h_pos").over(w).isNull()
                  | (F.col("h_pos") != F.lag("h_pos").over(w) + 1)
                  | (F.col("r_pos") != F.lag("r_pos").over(w) + 1)).cast("int"))
    j = (g.withColumn("_b", brk).groupBy(*keys)
         .agg(F.count("h_pos").alias("m"), F.sum("_b").alias("chunks"),
              F.max("h_len").alias("h_len"), F.max("r_len").alias("r_len"),
              *[F.max(c).alias(c) for c in carry]))
    return j.select(*keys, *carry, _score(F.col("m"), F.col("chunks"), F.col("h_len"), F.col("r_len"),
                                  alpha, beta, gamma).alias("meteor"))


def _score(m: Column, chunks: Column, h_len: Column, r_len: Column,
           alpha: float, beta: float, gamma: float) -> Column:
    mm = m.cast("double")
    p = mm / h_len
    rc = mm / r_len
    fmean = p * rc / (alpha * p + (1 - alpha) * rc)
    pen = gamma * F.pow(chunks / mm, F.lit(beta))
    return F.when((mm > 0) & (h_len > 0) & (r_len > 0), (F.lit(1.0) - pen) * fmean).otherwise(
        F.lit(0.0))


def _meteor_rows(pairs: DataFrame, keys: list[str], reference: str, hypothesis: str, mode: str, alpha: float,
                 beta: float, gamma: float, stems: bool, synonyms: DataFrame | None,
                 carry: tuple[str, ...]) -> DataFrame:
    """Alignment inside the row (``functions/alignment.py``), one pass over the pairs.

    With ``synonyms`` (token, synset; many to many) the tokens that stay free are
    exploded beside one row a pair that carries its matches, meet their synsets in an
    equi-join on the token, and are aligned per pair on shared synsets."""
    h, r = tokenize(F.col(hypothesis), mode), tokenize(F.col(reference), mode)
    if synonyms is None:
        sides, words = ((F.col(hypothesis), F.col(reference)), treebank(mode)) if mode.startswith("treebank") else ((h, r), None)
        counted = pairs.select(*keys, *carry, AL.match_counts(*sides, stems, words).alias("_c")).select(*keys, *carry, "_c.*")
    else:
        toks = pairs.select(*keys, *carry, h.alias("_h"), r.alias("_r"))
        found = toks.select(*keys, *carry, *[F.coalesce(F.size(c), F.lit(0)).alias(n) for c, n in
                                             (("_h", "h_len"), ("_r", "r_len"))],
                            "_h", "_r", AL.matched_places(F.col("_h"), F.col("_r"), stems).alias("_m"))

        def free(tokens: str, taken: Column, side: int) -> Column:
            places = F.transform(F.col(tokens), lambda t, i: F.struct(F.lit(side).alias("side"), i.alias("p"), t.alias("tok")))
            rest = F.filter(places, lambda e: ~F.array_contains(taken, e["p"]))
            return F.coalesce(rest, F.array().cast("array<struct<side:int,p:int,tok:string>>"))

        whole = F.array(F.struct(F.lit(0).alias("side"), F.lit(-1).alias("p"), F.lit(None).cast("string").alias("tok")))
        left = F.concat(whole, free("_h", F.col("_m.h"), 1), free("_r", F.col("_m.r"), 2))
        held = (*carry, "h_len", "r_len", "_m")
        rows = found.select(*keys, *held, F.explode(left).alias("e")).select(
            *keys, *[F.when(F.col("e.side") == 0, F.col(c)).alias(c) for c in held], "e.side", "e.p", "e.tok")
        sets = (synonyms.where("token IS NOT NULL AND synset IS NOT NULL").groupBy(F.col("token").alias("tok"))
                .agg(F.collect_set("synset").alias("members")))
        entry = F.when(F.col("members").isNotNull() & (F.col("side") > 0), F.struct("side", "p", "members"))
        pair = rows.join(sets, "tok", "left").groupBy(*keys).agg(
            F.collect_list(entry).alias("_left"), *[F.max_by(c, F.col("side") == 0).alias(c) for c in held])
        counted = pair.select(*keys, *carry, "h_len", "r_len",
                              AL.with_members(F.col("_m"), F.col("_left")).alias("_c")).select(
            *keys, *carry, "h_len", "r_len", "_c.*")
    return counted.select(*keys, *carry, _score(F.col("m"), F.col("chunks"), F.col("h_len"), F.col("r_len"),
                                                alpha, beta, gamma).alias("meteor"))


#: ``inline_max_cells`` of the in-row alignment; 0 takes the set-based one.
INLINE_MAX_CELLS = 1


def meteor(pairs: DataFrame, keys: list[str], reference: str = "reference",
           hypothesis: str = "hypothesis", mode: str = "lower",
           alpha: float = ALPHA, beta: float = BETA, gamma: float = GAMMA,
           stem_stage: bool = False, inline_max_cells: int = INLINE_MAX_CELLS,
           carry: tuple[str, ...] = (), synonyms: DataFrame | None = None) -> DataFrame:
    """Unigram METEOR per pair of texts (exact stage; optional Porter stem and synonym stages).

    Pairs are aligned inside their row, in one pass and linear in their tokens. With
    ``inline_max_cells`` 0 the alignment is set-based instead: tokens are exploded and
    matched by windows and grouping, without Python; the scores are equal (no synonym
    stage there). A pair with a null text scores 0. Columns in ``carry`` come along
    without being grouped on. ``synonyms`` has columns token and synset.
    """
    if inline_max_cells <= 0:
        if synonyms is not None:
            raise ValueError("the set-based alignment has no synonym stage")
        return _meteor_setwise(pairs, keys, reference, hypothesis, mode, alpha, beta, gamma,
                               stem_stage, carry=carry)
    return _meteor_rows(pairs, keys, reference, hypothesis, mode, alpha, beta, gamma, stem_stage, synonyms, carry)


def meteor_max_ref(pairs: DataFrame, keys: list[str], ref_key: str, **kw) -> DataFrame:
    """Best score of one hypothesis over several references."""
    s = meteor(pairs, [*keys, ref_key], **kw)
    return s.groupBy(*keys).agg(F.max("meteor").alias("meteor"))


# ---------------------------------------------------------------- grammar rules
def _regex_hits(text: Column, rules: dict[str, str]) -> Column:
    return reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(p)) for p in rules.values()])


def _token_fold(text: Column, finish) -> Column:
    """One pass over the lower-case tokens counting tokens and doubled adjacent
    words; ``finish(n, doubled)`` builds the result (tokens are split once)."""
    init = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).alias("n"),
                    F.lit(0).alias("rep"))

    def step(acc, x):
        same = F.coalesce((x == acc["prev"]).cast("int"), F.lit(0))
        return F.struct(x.alias("prev"), (acc["n"] + 1).alias("n"), (acc["rep"] + same).alias("rep"))

    return F.aggregate(tokenize(text, "lower"), init, step,
                       lambda acc: finish(acc["n"], acc["rep"]))


def grammar_hits(text: Column, rules: dict[str, str] = GRAMMAR_RULES) -> Column:
    """Number of rule hits in a text (regex rules + doubled adjacent word)."""
    return _token_fold(text, lambda n, rep: (_regex_hits(text, rules) + rep).cast("int"))


def grammar_inverse(text: Column, rules: dict[str, str] = GRAMMAR_RULES) -> Column:
    """1 / (1 + number of hits)."""
    return _token_fold(text, lambda n, rep: F.lit(1.0) / (F.lit(1.0) + _regex_hits(text, rules) + rep))


def grammar_ratio(text: Column, rules: dict[str, str] = GRAMMAR_RULES) -> Column:
    """1 - flagged tokens / tokens (hits capped at the token count); 1 for no tokens."""
    return _token_fold(text, lambda n, rep: F.when(
        n > 0, F.lit(1.0) - F.least(_regex_hits(text, rules) + rep, n) / n).otherwise(F.lit(1.0)))
