"""Distractor-quality compositions over the bound tables.

Text metrics (METEOR, grammar, lexicon relevance) come from ``text_items``;
embedding metrics (semantic similarity, diversity) from ``vector_slots``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from optiq.operators import textsim as TS
from optiq.plans import bindings as B

# Lexicon for the driver tables: frequent function words of the four languages.
TEST_LEXICON = ["the", "of", "and", "de", "la", "der", "to", "in"]


def text_distractors(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (item, distractor position) with the item's correct answer."""
    items = B.text_items(spark, sf)
    return items.select("doc_id", "block", "question", "correct_answer", "distractor_set",
                        F.posexplode("distractors").alias("pos", "distractor"))


def text_quality_per_question(spark: SparkSession, sf: str) -> DataFrame:
    """Per question: METEOR of i-th original vs i-th new distractor (mean, 0 if none)
    and grammar 1/(1+hits) mean of the new distractors.

    The new distractor set of item (doc, b) is the distractor list of item
    (doc, b + 1); items without a successor have no new set and no row. An
    item with a successor is a full block, so every new distractor has a
    positional partner: its grammar score is carried beside the pair.
    """
    it = B.text_item_successors(spark, sf)
    z = it.select("question", "distractor_set", "doc_id", "subject",
                  F.posexplode(F.arrays_zip(F.col("orig").alias("o"), F.col("new").alias("n")))
                  .alias("pos", "pr"))
    pairs = z.where(F.col("pr.o").isNotNull() & F.col("pr.n").isNotNull()).select(
        "question", "distractor_set", "doc_id", "subject", "pos",
        TS.grammar_inverse(F.col("pr.n")).alias("gram"),
        F.col("pr.o").alias("reference"), F.col("pr.n").alias("hypothesis"))
    keys = ["question", "distractor_set", "doc_id", "subject"]
    met = TS.meteor(pairs, [*keys, "pos"], carry=("gram",))
    return (met.groupBy(*keys)
            .agg(F.avg("meteor").alias("meteor_score"), F.avg("gram").alias("grammar_score"))
            .select("question", "doc_id", "subject", F.col("distractor_set").alias("distractor_type"),
                    F.coalesce("meteor_score", F.lit(0.0)).alias("meteor_score"),
                    F.coalesce("grammar_score", F.lit(0.0)).alias("grammar_score")))


def vector_quality_per_question(spark: SparkSession, sf: str) -> DataFrame:
    """Per vector question m: cosine of item m's distractors vs item m+1's
    distractors by slot (mean), and the diversity of item m+1's distractors.
    Every item is the original for its successor and the new set for its
    predecessor; the last item has no new set and no row."""
    v = B.vector_slots(spark, sf).where(F.col("slot") > 0)
    orig = v.select(F.col("item_id").alias("question_id"), F.col("slot").alias("pos"), "vector",
                    "distractor_set")
    new = v.select((F.col("item_id") - 1).alias("question_id"), F.col("slot").alias("pos"),
                   "vector", "slot", F.col("distractor_set").alias("new_set"))
    has_new = new.select("question_id").distinct()
    sem = TS.cosine_paired(orig.join(has_new, "question_id"), new, key="question_id")
    div = TS.diversity(new.select("question_id", "slot", "vector",
                                  F.col("new_set").alias("distractor_set")), group="question_id")
    types = (orig.groupBy("question_id").agg(F.first("distractor_set").alias("distractor_type"))
             .join(has_new, "question_id"))
    return (types.join(sem, "question_id", "left").join(div.select("question_id", "diversity"),
                                                         "question_id", "left")
            .select("question_id", "distractor_type",
                    F.coalesce("semantic_similarity", F.lit(0.0)).alias("semantic_similarity"),
                    F.coalesce("diversity", F.lit(0.0)).alias("diversity_score")))


def quality_per_question(spark: SparkSession, sf: str) -> DataFrame:
    """All four enhanced metrics and the subject per (question, type). Questions of
    document d have the vectors of vector question d mod their number (the last
    vector item has no successor, so it is no question)."""
    t = text_quality_per_question(spark, sf)
    v = vector_quality_per_question(spark, sf).drop("distractor_type")
    n = max(B.vector_items(spark, sf) - 1, 1)
    return (t.join(v, F.pmod(F.col("doc_id"), F.lit(n)) == F.col("question_id"), "left")
            .select("question", "subject", "distractor_type", "meteor_score", "semantic_similarity",
                    "grammar_score", "diversity_score"))


def vector_item_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Per vector item: mean cosine of the answer and each distractor, and the
    diversity of the distractors."""
    slots = B.vector_slots(spark, sf)
    sem = TS.cosine_to_answer(slots).groupBy("item_id").agg(F.avg("similarity").alias("semantic_scores"))
    return sem.join(TS.diversity(slots).select("item_id", "diversity"), "item_id", "left")


def with_item_vectors(spark: SparkSession, sf: str, questions: DataFrame, vectors: DataFrame) -> DataFrame:
    """``questions`` (with doc_id) and the columns of their vector item."""
    n = max(B.vector_items(spark, sf), 1)
    return questions.join(vectors, F.pmod(F.col("doc_id"), F.lit(n)) == F.col("item_id"),
                          "left").drop("item_id", "doc_id")


def quality_agg(per_question: DataFrame) -> DataFrame:
    metrics = ["meteor_score", "semantic_similarity", "grammar_score", "diversity_score"]
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return per_question.groupBy("distractor_type").agg(*aggs)


def legacy_quality(spark: SparkSession, sf: str, lexicon=TEST_LEXICON, stem_stage: bool = False) -> DataFrame:
    """Per (question, set): mean METEOR of word tokens (correct answer vs each distractor),
    mean lexicon relevance and grammar ratio of the distractors, mean cosine and
    diversity of the bound vector item.

    Every distractor is in exactly one METEOR pair, so its lexicon and grammar
    scores are computed in the pair projection and carried beside the pair."""
    d = text_distractors(spark, sf)
    pairs = d.select("question", "distractor_set", "doc_id", "pos",
                     TS.lexicon_relevance(F.col("distractor"), lexicon).alias("lex"),
                     TS.grammar_ratio(F.col("distractor")).alias("gram"),
                     F.col("correct_answer").alias("reference"),
                     F.col("distractor").alias("hypothesis"))
    keys = ["question", "distractor_set", "doc_id"]
    met = TS.meteor(pairs, [*keys, "pos"], mode="treebank", stem_stage=stem_stage, carry=("lex", "gram"))
    means = met.groupBy(*keys).agg(
        F.avg("lex").alias("legal_relevance_scores"),
        F.avg("gram").alias("grammar_scores"),
        F.avg("meteor").alias("meteor_scores"))
    return with_item_vectors(spark, sf, means, vector_item_quality(spark, sf))


def quality_legacy(spark: SparkSession, sf: str, lexicon=TEST_LEXICON, stem_stage: bool = False) -> DataFrame:
    """Per (question, set): the list-valued quality record in distractor order
    (METEOR of word tokens vs the correct answer, lexicon relevance, grammar ratio, cosines of the
    bound vector item) and the vector item's diversity. Lists are per item
    (bounded by the item's distractor count)."""
    d = text_distractors(spark, sf)
    pairs = d.select("question", "distractor_set", "doc_id", "pos",
                     TS.lexicon_relevance(F.col("distractor"), lexicon).alias("lex"),
                     TS.grammar_ratio(F.col("distractor")).alias("gram"),
                     F.col("correct_answer").alias("reference"),
                     F.col("distractor").alias("hypothesis"))
    keys = ["question", "distractor_set", "doc_id"]
    met = TS.meteor(pairs, [*keys, "pos"], mode="treebank", stem_stage=stem_stage, carry=("lex", "gram"))
    rec = F.array_sort(F.collect_list(F.struct("pos", "meteor", "lex", "gram")))
    g = met.groupBy(*keys).agg(rec.alias("r"))
    slots = B.vector_slots(spark, sf)
    cosines = TS.cosine_to_answer(slots).groupBy("item_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "similarity"))),
                    lambda x: x["similarity"]).alias("semantic_scores"))
    vectors = cosines.join(TS.diversity(slots).select("item_id", "diversity"), "item_id", "left")
    g = with_item_vectors(spark, sf, g, vectors)
    return g.select("question", "distractor_set", "semantic_scores", "diversity",
                    F.transform("r", lambda x: x["meteor"]).alias("meteor_scores"),
                    F.transform("r", lambda x: x["lex"]).alias("legal_relevance_scores"),
                    F.transform("r", lambda x: x["gram"]).alias("grammar_scores"))
