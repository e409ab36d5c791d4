"""Derive the reference's entities from the driver tables.

The reference works on questions, distractor sets, graded model replies and
embeddings. The graded tables only provide generic tables (events, embeddings,
documents, conversations), so each entity is defined here as a projection of
one of them. Every definition is mirrored one-to-one by a SQL view in
``optiq.plans.oracle`` so the DuckDB oracle computes from identical inputs.

All bindings are narrow projections (no shuffle); the operators decide where
data moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from optiq.sources.tables import spread, table

# Fixed values of the bindings (shared with the SQL oracle).
N_QUESTIONS = 200          # responses.question = 'q' || event_id % N_QUESTIONS
N_SUBJECTS = 10
N_MODELS = 3
N_OPTIONS = 4
OPTION_NAMES = ("Alpha", "Beta", "Gamma", "Delta")
ITEM_WIDTH = 10            # embeddings: 1 correct answer + 9 distractors per item
N_SETS = 5
SET_NAMES = ("click", "error", "purchase", "signup", "view")   # same names as events.event_type
PIECE_SPLIT = r"\. |\n"    # documents: sentence / line pieces
WS = r"^[ \t\r\n]+|[ \t\r\n]+$"


def _s(c: Column) -> Column:
    return c.cast("string")


def _set_name(i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in SET_NAMES]), (i % N_SETS + 1).cast("int"))


def _chosen_index(event_id: Column, is_correct: Column) -> Column:
    correct = (event_id % N_QUESTIONS) % N_OPTIONS
    wrong = (correct + 1 + event_id % 3) % N_OPTIONS
    return F.when(is_correct, correct).otherwise(wrong)


def _is_correct(event_id: Column, user_id: Column) -> Column:
    """A rule by model and by set (its name's length), so that sets do differ."""
    by_set = (F.length("event_type") % 4) * 5
    return (event_id * 31 + user_id * 17) % 100 < F.lit(50) + (user_id % N_MODELS) * 15 + by_set


def _k(props: Column) -> Column:
    return F.get_json_object(props, "$.k").try_cast("int")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded replies: one row per (model, question, set) answer."""
    return responses_from_events(table(spark, sf_dir, "events"))


def responses_from_events(ev: DataFrame) -> DataFrame:
    """The responses projection; works on batch and streaming event frames alike."""
    eid, uid = F.col("event_id"), F.col("user_id")
    ok = _is_correct(eid, uid)
    k = _k(F.col("props"))
    qn = eid % N_QUESTIONS
    return ev.select(
        eid.alias("response_id"),
        F.col("ts"),
        F.concat(F.lit("model_"), _s(uid % N_MODELS)).alias("model"),
        F.concat(F.lit("q"), _s(qn)).alias("question"),
        F.concat(F.lit("subj_"), _s(qn % N_SUBJECTS)).alias("subject"),
        F.concat(F.lit("opt"), _s(qn % N_OPTIONS)).alias("correct_answer"),
        F.concat(F.lit("opt"), _s(_chosen_index(eid, ok))).alias("llm_answer"),
        ok.alias("is_correct"),
        F.when(k % 10 == 0, F.lit(None).cast("int")).otherwise(k + 1).alias("confidence"),
        (F.col("value") / F.lit(100.0)).alias("response_time"),
        F.col("event_type").alias("distractor_set"),
        F.col("event_type").alias("distractor_type"),
    )


def _options(qname: Column) -> Column:
    return F.array(*[F.concat(F.lit(n + " "), qname) for n in OPTION_NAMES])


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ungraded replies: free text as a model would return it (see
    ``raw_responses_from_events``)."""
    return raw_responses_from_events(spread(table(spark, sf_dir, "events"), "event_id"))


def raw_responses_from_events(ev: DataFrame) -> DataFrame:
    """The raw-reply projection; works on batch and streaming event frames alike.

    Six reply shapes (by event_id % 6) exercise every parser branch: reasoning
    with upper-case labels, inline lower-case labels, prose "answer is:",
    no answer label, absurd confidence digits, and an error message.
    """
    eid, uid = F.col("event_id"), F.col("user_id")
    qname = F.concat(F.lit("q"), _s(eid % N_QUESTIONS))
    opts = _options(qname)
    ok = _is_correct(eid, uid)
    pick = F.element_at(opts, (_chosen_index(eid, ok) + 1).cast("int"))
    correct = F.element_at(opts, ((eid % N_QUESTIONS) % N_OPTIONS + 1).cast("int"))
    k = _s(_k(F.col("props")))
    t = eid % 6
    nl = F.lit("\n")
    reply = (
        F.when(t == 0, F.concat(
            F.lit("Reasoning: First, the question asks about "), qname, F.lit(".\nSecond, "),
            pick, F.lit(" might fit best.\nThird, the others are unlikely.\nAnswer: "), pick,
            F.lit("\nConfidence: "), k))
        .when(t == 1, F.concat(F.lit("answer: "), F.lower(pick), F.lit(" confidence: "), k))
        .when(t == 2, F.concat(F.lit("Let me think.\nThe answer is:\n"), pick,
                               F.lit("\nConfidence: 250")))
        .when(t == 3, F.concat(F.lit("Step 1: perhaps "), pick,
                               F.lit(" could be right, not sure.\n\nFinally, I pick "), pick,
                               F.lit(".\nconfidence: 0"), k))
        .when(t == 4, F.concat(F.lit("Thinking: maybe "), pick, nl, F.lit("confidence: "), k,
                               F.lit("000000000000000000000000000000000000000000")))
        .otherwise(F.lit("Error: the service timed out"))
    )
    return ev.select(
        eid.alias("response_id"),
        F.concat(F.lit("model_"), _s(uid % N_MODELS)).alias("model"),
        qname.alias("question"),
        opts.alias("options"),
        correct.alias("correct_answer"),
        reply.alias("raw_response"),
        (F.col("value") / F.lit(100.0)).alias("response_time"),
        F.col("event_type").alias("distractor_set"),
        F.col("ts"),
    )


def vector_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as answer options: item = vec_id div 10, slot 0 = correct answer."""
    emb = table(spark, sf_dir, "embeddings")
    vid = F.col("vec_id")
    item = F.floor(vid / ITEM_WIDTH).cast("long")
    return emb.select(
        item.alias("item_id"),
        (vid % ITEM_WIDTH).cast("int").alias("slot"),
        _set_name(item).alias("distractor_set"),
        F.col("label"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )


def vector_items(spark: SparkSession, sf_dir: str) -> int:
    """Number of vector items (one number read from the table). Text questions
    of document d are bound to vector item d mod this number."""
    last = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]
    return 0 if last is None else last // ITEM_WIDTH + 1


def text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-empty sentence/line of every document, numbered within the document.

    Pieces are grouped ten at a time into question items: piece 0 of a block is
    the correct answer, pieces 1..9 are its distractors. Whole texts are used.
    """
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    pieces = _doc_pieces(docs)
    return (docs.select("doc_id", "source", "lang", F.posexplode(pieces).alias("pos", "piece"))
            .select(
                "doc_id", "source", "lang",
                F.floor(F.col("pos") / ITEM_WIDTH).cast("int").alias("block"),
                (F.col("pos") % ITEM_WIDTH).cast("int").alias("slot"),
                F.col("piece").alias("text"),
                _set_name(F.col("doc_id")).alias("distractor_set"),
            ))


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(reference, hypothesis) text pairs: each turn against the next turn of its conversation.

    An equi-join on (conv_id, turn + 1): keys are unique per side, so a very
    long conversation spreads over many tasks instead of one window partition.
    """
    conv = spread(table(spark, sf_dir, "conversations"), "conv_id")
    a = conv.select("conv_id", "turn", F.col("text").alias("reference"))
    b = conv.select("conv_id", (F.col("turn") - 1).alias("turn"),
                    F.col("text").alias("hypothesis"))
    return a.join(b, ["conv_id", "turn"], "inner")


def _doc_pieces(docs: DataFrame) -> Column:
    """The text split on PIECE_SPLIT, every piece stripped of WS, empty ones dropped.
    Both separators become line breaks first, so no regular expression is needed."""
    lines = F.split(F.replace("text", F.lit(". "), F.lit("\n")), "\n")
    return F.array_remove(F.transform(lines, lambda t: F.btrim(t, F.lit(" \t\r\n"))), "")


def text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question items cut from whole documents, ten pieces per item.

    Built by slicing each document's piece array (no shuffle): piece 0 of a
    block is the correct answer, the rest (up to 9) are its distractors in order.
    """
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    # the piece array is materialised once per document before slicing blocks
    with_p = docs.select("doc_id", "source", "lang", _doc_pieces(docs).alias("p"))
    p = F.col("p")
    nblocks = F.floor((F.size(p) + (ITEM_WIDTH - 1)) / ITEM_WIDTH).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), nblocks - 1),
                         lambda b: F.slice(p, b * ITEM_WIDTH + 1, ITEM_WIDTH))
    return (with_p.where(F.size(p) > 0)
            .select("doc_id", "source", "lang", F.posexplode(blocks).alias("block", "piece"))
            .select(
                "doc_id", "source", "lang", F.col("block").cast("int").alias("block"),
                F.concat(F.lit("doc"), _s(F.col("doc_id")), F.lit("/"), _s(F.col("block")))
                .alias("question"),
                F.col("piece")[0].alias("correct_answer"),
                F.slice(F.col("piece"), 2, ITEM_WIDTH - 1).alias("distractors"),
                F.lit(None).cast("array<string>").alias("options"),
                F.col("source").alias("subject"),
                _set_name(F.col("doc_id")).alias("distractor_set"),
            ))


def text_item_successors(spark: SparkSession, sf_dir: str, keep_empty: bool = False) -> DataFrame:
    """Each text item with the distractor list of the next item of its document
    (the "new" distractor set for that question), cut from the document's piece
    array in one pass: no self-join of the items."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    with_p = docs.select("doc_id", F.col("source").alias("subject"), _doc_pieces(docs).alias("p"))
    p = F.col("p")
    nblocks = F.floor((F.size(p) + (ITEM_WIDTH - 1)) / ITEM_WIDTH).cast("int")
    pair = F.transform(
        F.sequence(F.lit(0), nblocks - 2),
        lambda b: F.struct(b.alias("block"),
                           F.slice(p, b * ITEM_WIDTH + 2, ITEM_WIDTH - 1).alias("orig"),
                           F.slice(p, (b + 1) * ITEM_WIDTH + 2, ITEM_WIDTH - 1).alias("new")))
    return (with_p.where(nblocks >= 2)
            .select("doc_id", "subject", F.explode(pair).alias("s"))
            .select("doc_id", "subject", F.col("s.block").cast("int").alias("block"),
                    F.concat(F.lit("doc"), _s(F.col("doc_id")), F.lit("/"), _s(F.col("s.block")))
                    .alias("question"),
                    _set_name(F.col("doc_id")).alias("distractor_set"),
                    F.col("s.orig").alias("orig"), F.col("s.new").alias("new"))
            .where(F.lit(keep_empty) | (F.size("new") > 0)))
