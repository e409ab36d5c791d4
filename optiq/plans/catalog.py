"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator key.

Each query binds the driver tables to the reference's entities
(``optiq.plans.bindings``) and applies one operator over the whole tables.
``stable`` rounds double outputs to IEEE single precision, the comparison
precision shared with the SQL oracle (see ``optiq.plans.oracle``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from optiq.operators import joins as J
from optiq.operators import psychometrics as P
from optiq.operators import summary as S
from optiq.plans import bindings as B
from optiq.session import cut_lineage, scratch_path
from optiq.sources.tables import dealt, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def stable(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            cols.append(c.cast("float").cast("double").alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: stable(fn(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        return fn
    return deco


# ---------------------------------------------------------------- summaries
@register("model_distractor_summary")
def _mds(spark, sf):
    """Flagship: model / set / model x set summary in one GROUPING SETS pass."""
    return S.model_distractor_summary(B.responses(spark, sf))


@register("summary_cube")
def _cube(spark, sf):
    return S.summary_cube(B.responses(spark, sf))


@register("model_summary")
def _ms(spark, sf):
    return S.model_summary(B.responses(spark, sf))


@register("distractor_summary")
def _ds(spark, sf):
    return S.distractor_summary(B.responses(spark, sf))


@register("set_summary")
def _ss(spark, sf):
    return S.set_summary(B.responses(spark, sf))


@register("distractor_stats")
def _dstats(spark, sf):
    return S.distractor_stats(B.responses(spark, sf))


# ---------------------------------------------------------------- psychometrics
@register("item_analysis")
def _items(spark, sf):
    return P.item_analysis(B.responses(spark, sf))


@register("reliability_bins")
def _rbins(spark, sf):
    return P.reliability_bins(B.responses(spark, sf))


@register("calibration_metrics")
def _cal(spark, sf):
    return P.calibration_metrics(B.responses(spark, sf))


# ---------------------------------------------------------------- reply parsing
from optiq.functions import parse as PF  # noqa: E402
from optiq.plans import evaluate as EV  # noqa: E402


@register("extract_answer")
def _extract_answer(spark, sf):
    raw = B.raw_responses(spark, sf)
    return raw.select("response_id", PF.extract_answer(F.col("raw_response")).alias("extracted"))


@register("snap_to_option")
def _snap(spark, sf):
    raw = B.raw_responses(spark, sf)
    a = PF.extract_answer(F.col("raw_response"))
    return raw.select("response_id", F.when(a.isNotNull(), PF.snap_to_option(a, F.col("options")))
                      .alias("snapped"))


@register("fallback_answer")
def _fallback(spark, sf):
    raw = B.raw_responses(spark, sf)
    return raw.select("response_id",
                      PF.parse_answer(F.col("raw_response"), F.col("options")).alias("llm_answer"))


@register("extract_confidence")
def _conf(spark, sf):
    raw = B.raw_responses(spark, sf)
    return raw.select("response_id", PF.extract_confidence(F.col("raw_response")).alias("confidence"))


@register("extract_reasoning")
def _reasoning(spark, sf):
    raw = B.raw_responses(spark, sf)
    return raw.select("response_id",
                      PF.extract_reasoning(F.col("raw_response")).alias("reasoning_text"))


def _flat_metrics(df):
    m = F.col("reasoning_metrics")
    return [m["reasoning_length"].alias("reasoning_length"), m["steps_count"].alias("steps_count"),
            m["uncertainty_markers"].alias("uncertainty_markers")]


@register("reasoning_metrics")
def _rmetrics(spark, sf):
    raw = B.raw_responses(spark, sf)
    t = PF.extract_reasoning(F.col("raw_response"))
    return raw.select("response_id", PF.reasoning_metrics(t).alias("reasoning_metrics")).select(
        "response_id", *_flat_metrics(None))


@register("grade_exact")
def _grade(spark, sf):
    g = EV.grade_replies(B.raw_responses(spark, sf))
    return g.select("response_id", "model", "question", "distractor_set", "correct_answer",
                    "llm_answer", "is_correct", "confidence", "response_time")


def _received(raw):
    return raw.where(~F.col("raw_response").startswith("Error:"))


@register("error_rows")
def _errors(spark, sf):
    raw = B.raw_responses(spark, sf)
    g = EV.grade_with_errors(raw.drop("raw_response"), _received(raw))
    return g.select("response_id", "model", "distractor_set", "error", "llm_answer", "is_correct",
                    "confidence", "response_time", *_flat_metrics(g))


@register("parse_metrics_column")
def _pmc(spark, sf):
    g = EV.grade_replies(B.raw_responses(spark, sf))
    m = F.col("reasoning_metrics")
    as_repr = F.concat(F.lit("{'reasoning_length': "), m["reasoning_length"].cast("string"),
                       F.lit(", 'steps_count': "), m["steps_count"].cast("string"),
                       F.lit(", 'uncertainty_markers': "), m["uncertainty_markers"].cast("string"),
                       F.lit("}"))
    stored = F.when(F.col("response_id") % 2 == 0, as_repr).otherwise(F.lit("not a dict"))
    p = PF.parse_metrics_column(stored)
    return g.select("response_id", p["reasoning_length"].alias("reasoning_length"),
                    p["steps_count"].alias("steps_count"),
                    p["uncertainty_markers"].alias("uncertainty_markers"))


def _reasoning_rows(spark, sf):
    """Graded replies with parsed reasoning metrics and seconds per step."""
    g = EV.grade_replies(B.raw_responses(spark, sf))
    return (g.select("response_id", "model", "distractor_set", "is_correct", "response_time",
                     *_flat_metrics(g))
            .withColumn("time_per_step",
                        F.col("response_time") / F.greatest(F.col("steps_count"), F.lit(1))))


def _reasoning_table(spark, sf):
    # non-empty reasoning <=> reasoning_length > 0
    return _reasoning_rows(spark, sf).where(F.col("reasoning_length") > 0)


@register("reasoning_table")
def _rtable(spark, sf):
    return _reasoning_table(spark, sf)


@register("reasoning_by_outcome")
def _rbo(spark, sf):
    """Accuracy and time per step by (model, steps, uncertainty markers) over
    replies with reasoning. Written as conditional aggregates over all replies
    (a row filter would be pushed below the projection and run the reasoning
    fold twice); groups with no reasoning rows are dropped after aggregation."""
    r = _reasoning_rows(spark, sf)
    has = F.col("reasoning_length") > 0
    return (r.groupBy("model", "steps_count", "uncertainty_markers")
            .agg(F.count(F.when(has, F.lit(1))).alias("n"),
                 F.avg(F.when(has, F.col("is_correct").cast("double"))).alias("accuracy"),
                 F.avg(F.when(has, F.col("time_per_step"))).alias("avg_time_per_step"))
            .where(F.col("n") > 0))


# ---------------------------------------------------------------- inference
from optiq.operators import inference as INF  # noqa: E402


@register("anova_oneway")
def _anova(spark, sf):
    return INF.anova_oneway(B.responses(spark, sf))


@register("anova_pvalues")
def _anova_p(spark, sf):
    """ANOVA with the F-tail p-value (pandas UDF on the result table)."""
    return INF.anova_oneway(B.responses(spark, sf), with_p=True)


@register("anova_error_isolated")
def _anova_iso(spark, sf):
    """A degenerate variable (constant option count) is reported with a status, not raised."""
    r = B.responses(spark, sf).withColumn("n_options", F.lit(B.N_OPTIONS))
    dvs = {"accuracy": "is_correct", "n_options": "n_options"}
    t = INF.anova_oneway(r, by="model", factor="distractor_set", dvs=dvs)
    return t.where(F.col("source") != "Within").select("model", "dependent_var", "status", "f")


@register("tukey_hsd")
def _tukey(spark, sf):
    return INF.tukey_hsd(INF.group_stats(B.responses(spark, sf)))


@register("tukey_pvalues")
def _tukey_p(spark, sf):
    """All Tukey pairs with their studentized-range p-values."""
    return INF.tukey_hsd(INF.group_stats(B.responses(spark, sf)), with_p=True)


@register("tukey_gated")
def _tukey_gated(spark, sf):
    """The evaluator's post-hoc: pairs only for variables whose ANOVA p < 0.05
    (``tukey_pvalues`` has the pairs' own p-values)."""
    return INF.tukey_hsd(INF.group_stats(B.responses(spark, sf)), alpha=0.05)


# ---------------------------------------------------------------- text quality
from optiq.operators import overlap as OV  # noqa: E402
from optiq.operators import textsim as TS  # noqa: E402
from optiq.plans import quality as QL  # noqa: E402


@register("tokenize")
def _tokenize(spark, sf):
    p = B.text_pieces(spark, sf)
    return p.select("doc_id", "block", "slot",
                    F.size(TS.tokenize(F.col("text"), "lower")).alias("n_lower"),
                    F.size(TS.tokenize(F.col("text"), "raw")).alias("n_raw"),
                    F.array_join(TS.tokenize(F.col("text"), "punct"), " ").alias("punct_tokens"))


@register("lexicon_relevance")
def _lex(spark, sf):
    d = QL.text_distractors(spark, sf)
    return d.select("question", "pos", TS.lexicon_relevance(F.col("distractor"), QL.TEST_LEXICON)
                    .alias("relevance"))


@register("grammar_inverse")
def _ginv(spark, sf):
    p = B.text_pieces(spark, sf)
    return p.select("doc_id", "block", "slot", TS.grammar_hits(F.col("text")).alias("hits"),
                    TS.grammar_inverse(F.col("text")).alias("grammar_score"))


@register("grammar_ratio")
def _gratio(spark, sf):
    p = B.text_pieces(spark, sf)
    return p.select("doc_id", "block", "slot", TS.grammar_ratio(F.col("text")).alias("grammar_score"))


@register("grammar_spans")
def _gspans(spark, sf):
    """Matches of the rule table in every text piece (an automaton: checked against a
    brute-force matcher)."""
    from optiq.operators.grammar import grammar_spans
    return grammar_spans(B.text_pieces(spark, sf), ["doc_id", "block", "slot"])


@register("grammar_rule_scores")
def _gscores(spark, sf):
    """Faults of the rule table in every text piece, and the scores made of them."""
    from optiq.operators.grammar import grammar_scores
    return grammar_scores(B.text_pieces(spark, sf), ["doc_id", "block", "slot"])


@register("cosine_to_answer")
def _cos(spark, sf):
    return TS.cosine_to_answer(B.vector_slots(spark, sf))


@register("diversity_pairwise")
def _div(spark, sf):
    return TS.diversity(B.vector_slots(spark, sf))


@register("mine_distractors")
def _mine(spark, sf):
    """The nine most similar vectors of other labels, for every id against all rows."""
    from optiq.operators.mining import mine_distractors
    v = B.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("group"),
                                                F.col("embedding").alias("vector"))
    found = mine_distractors(v, v.select("id"))
    return found.select(F.col("id").alias("item"), "rank", "candidate", "similarity")


@register("cosine_paired")
def _cpaired(spark, sf):
    question = F.concat(F.lit("vec"), F.col("question_id").cast("string")).alias("question")
    return QL.vector_quality_per_question(spark, sf).select(question, "semantic_similarity")


@register("meteor")
def _meteor(spark, sf):
    return TS.meteor(B.conversation_pairs(spark, sf), ["conv_id", "turn"])


@register("meteor_synonym")
def _meteor_syn(spark, sf):
    """METEOR with a synonym stage: words of five letters or more are in the synset of
    their first three letters and in that of their last three."""
    pairs = B.conversation_pairs(spark, sf)
    words = pairs.select(F.explode(F.array_union(
        F.coalesce(TS.tokenize(F.col("hypothesis")), F.array().cast("array<string>")),
        F.coalesce(TS.tokenize(F.col("reference")), F.array().cast("array<string>")))).alias("token")).distinct()
    synonyms = words.where(F.length("token") >= 5).select("token", F.explode(F.array(
        F.concat(F.left("token", F.lit(3)), F.lit("-")), F.concat(F.lit("-"), F.right("token", F.lit(3))))).alias("synset"))
    return TS.meteor(pairs, ["conv_id", "turn"], synonyms=synonyms)


@register("tokenize_treebank")
def _treebank(spark, sf):
    p = B.text_pieces(spark, sf)
    return p.select("doc_id", "block", "slot", F.array_join(TS.tokenize(F.col("text"), "treebank"), " ").alias("tokens"))


@register("ngram_precision")
def _ngrams(spark, sf):
    return OV.ngram_precision(B.conversation_pairs(spark, sf), ["conv_id", "turn"])


@register("corpus_bleu")
def _corpus_bleu(spark, sf):
    pairs = B.conversation_pairs(spark, sf).withColumn("after", F.pmod(F.col("turn"), F.lit(2)))
    return OV.corpus_bleu(pairs, ["after"])


@register("lcs_overlap")
def _lcs(spark, sf):
    return OV.lcs_overlap(B.conversation_pairs(spark, sf), ["conv_id", "turn"])


@register("meteor_max_ref")
def _meteor_max(spark, sf):
    d = QL.text_distractors(spark, sf)
    pairs = d.select("question", "pos", F.col("correct_answer").alias("hypothesis"),
                     F.col("distractor").alias("reference"))
    return TS.meteor_max_ref(pairs, ["question"], "pos")


@register("quality_per_question")
def _qpq(spark, sf):
    return QL.quality_per_question(spark, sf)


@register("quality_agg")
def _qagg(spark, sf):
    return QL.quality_agg(QL.quality_per_question(spark, sf))


@register("quality_summary_row")
def _qsr(spark, sf):
    return QL.legacy_quality(spark, sf)


def _fanout(spark, sf):
    """Set summary LEFT JOIN per-question quality (1:N): the few set rows are
    broadcast by measured size instead of shuffling questions by set."""
    return J.left_join_small(S.set_summary(B.responses(spark, sf)),
                             QL.legacy_quality(spark, sf), "distractor_set", materialize=True)


@register("join_quality_fanout")
def _jqf(spark, sf):
    return _fanout(spark, sf).select("distractor_set", "question", "accuracy", "response_time",
                                     "meteor_scores", "legal_relevance_scores", "grammar_scores",
                                     "semantic_scores", "diversity")


@register("fanout_means")
def _fm(spark, sf):
    """Only accuracy and time are averaged: the questions per set are enough."""
    questions = B.text_items(spark, sf).where(F.size("distractors") > 0).select(
        "question", "distractor_set")
    return S.fanout_means(J.left_join_small(S.set_summary(B.responses(spark, sf)), questions,
                                            "distractor_set"))


LEGACY_METRICS = ["accuracy", "response_time", "meteor_scores", "legal_relevance_scores",
                  "grammar_scores", "semantic_scores", "diversity"]


@register("corr_matrix_quality")
def _cmq(spark, sf):
    return INF.correlation_long(_fanout(spark, sf), LEGACY_METRICS)


@register("argmax_abs")
def _amax(spark, sf):
    return INF.argmax_abs(_fanout(spark, sf), LEGACY_METRICS, "accuracy")


@register("corr_matrix_metrics")
def _cmm(spark, sf):
    return INF.correlation_long(QL.quality_per_question(spark, sf),
                                ["meteor_score", "semantic_similarity", "grammar_score",
                                 "diversity_score"])


# ---------------------------------------------------------------- reshape / charts
from optiq.operators import charts as CH  # noqa: E402
from optiq.operators import reshape as RS  # noqa: E402

MODELS = [f"model_{i}" for i in range(B.N_MODELS)]
SETS = list(B.SET_NAMES)


def _responses_long(spark, sf):
    r = B.responses(spark, sf)
    return RS.melt(r, ["question", "distractor_set", "model"], ["confidence", "response_time"])


@register("melt")
def _melt(spark, sf):
    return RS.melt(S.distractor_stats(B.responses(spark, sf)), ["model", "distractor_set"],
                   ["is_correct_mean", "confidence_mean", "response_time_mean",
                    "calibration_error"])


@register("describe_by_group")
def _describe(spark, sf):
    return RS.describe_by_group(_responses_long(spark, sf), ["distractor_set", "metric"])


@register("boxplot_stats")
def _box(spark, sf):
    return RS.boxplot_stats(B.responses(spark, sf), "model", "distractor_set", "response_time")


@register("pivot_heatmap")
def _heat(spark, sf):
    st = S.distractor_stats(B.responses(spark, sf))
    return RS.pivot_wide(st, ["distractor_set"], "model", value="is_correct_mean", agg="first")


@register("pivot_mean")
def _pmean(spark, sf):
    return RS.pivot_wide(_responses_long(spark, sf), ["question", "distractor_set"], "metric",
                         ["confidence", "response_time"], dropna=True)


@register("explode_list_metric")
def _explode(spark, sf):
    items = B.text_items(spark, sf).select("question", "distractors")
    return RS.explode_list_metric(items, "distractors", "distractor")


@register("explode_distractors")
def _explode_map(spark, sf):
    """Numbered distractor map -> one row per (question, key, value)."""
    from optiq.operators.bank import number_distractors
    items = B.text_items(spark, sf).select(
        "question", number_distractors(F.col("distractors")).alias("m"))
    return items.select("question", F.explode("m").alias("key", "distractor"))


@register("item_scatter")
def _scatter(spark, sf):
    return CH.item_scatter(P.item_analysis(B.responses(spark, sf)))


@register("calibration_compare")
def _calcmp(spark, sf):
    return P.calibration_compare(P.calibration_metrics(B.responses(spark, sf)))


@register("metric_bars")
def _bars(spark, sf):
    return CH.metric_bars(QL.quality_agg(QL.quality_per_question(spark, sf)))


@register("quality_vs_accuracy")
def _qva(spark, sf):
    return CH.quality_vs_accuracy(_fanout(spark, sf))


# ---------------------------------------------------------------- bank preparation
from optiq.operators import bank as BK  # noqa: E402
from optiq.operators import joins as J  # noqa: E402


def _items(spark, sf):
    return B.text_items(spark, sf)


@register("sample_exact_n")
def _sample(spark, sf):
    return BK.sample_exact_n(_items(spark, sf).select("question", "subject"), 150, seed=0)


@register("sample_balanced")
def _balanced(spark, sf):
    return BK.sample_balanced(_items(spark, sf).select("question", "subject"), 5, "subject", 0)


@register("cycle_fill")
def _cycle(spark, sf):
    return BK.cycle_fill(_items(spark, sf).select("question"), 150, seed=0)


@register("replicate_bank")
def _replicate(spark, sf):
    return BK.replicate_bank(_items(spark, sf).select("question"), 3)


@register("union_subjects")
def _union(spark, sf):
    it = _items(spark, sf).select("question", "subject", "lang")
    english = F.col("lang").eqNullSafe("en")
    return BK.union_subjects(it.where(english), it.where(~english))


def _assembled(spark, sf):
    return BK.assemble_options(_items(spark, sf), seed=0)


@register("assemble_options")
def _assemble(spark, sf):
    return _assembled(spark, sf).select(
        "question", F.concat_ws(" | ", "presented_options").alias("presented_options"))


def _plan(spark, sf):
    return BK.build_eval_plan(_assembled(spark, sf), MODELS, 5)


@register("build_eval_plan")
def _bplan(spark, sf):
    return _plan(spark, sf).select("question", "plan_set", "model", "request_reasoning")


@register("format_prompt")
def _prompt(spark, sf):
    p = _plan(spark, sf)
    return p.select("question", "plan_set", "model",
                    BK.format_prompt(F.col("question"), F.col("presented_options"),
                                     F.col("request_reasoning")).alias("prompt"))


def _fixed_reply(rows):
    """The responder of the registered query: the option at the question's length; it
    fails on questions whose length is a multiple of eleven."""
    out = []
    for r in rows:
        n, options = len(r["question"]), r["presented_options"]
        if n % 11 == 0:
            raise RuntimeError("no answer")
        out.append(f"Answer: {options[n % len(options)]}\nConfidence: {50 + n % 50}")
    return out


@register("score_with")
def _score_with(spark, sf):
    """The evaluation plan answered by a responder in the tasks, in three written rounds."""
    from optiq.plans.responder import score_with
    # each round reads the plan: its items are made once, their six rows each time
    items = scratch_path(spark, "items")
    _assembled(spark, sf).select("doc_id", "block", "distractor_set", "question", "presented_options").write.parquet(items)
    plan = BK.build_eval_plan(spark.read.parquet(items), MODELS, 5, firsts_dir=scratch_path(spark, "firsts"))
    p = plan.select(
        F.concat_ws("|", "question", "plan_set", "model").alias("response_id"), "question", "presented_options")
    return score_with(p, _fixed_reply, scratch_path(spark, "replies"), rounds=3)


@register("prompt_styles")
def _prompt_styles(spark, sf):
    """The first evaluator's and the generator's prompt of each item."""
    a = _assembled(spark, sf)
    return a.select("question", BK.legacy_prompt(F.col("question"), F.col("presented_options")).alias("legacy"),
                    BK.generate_prompt(F.col("question"), F.col("correct_answer"),
                                       F.size("distractors")).alias("generate"))


@register("parse_generated_lines")
def _gen_lines(spark, sf):
    conv = B.table(spark, sf, "conversations")
    lines = BK.parse_generated_lines(F.col("text"), 9, F.col("text").isNull())
    return conv.select("conv_id", "turn", F.size(lines).alias("n_lines"),
                       F.concat_ws(" | ", lines).alias("lines"))


@register("strip_enumeration")
def _strip_enum(spark, sf):
    conv = B.table(spark, sf, "conversations")
    lines = F.split(F.col("text"), "\n")
    return conv.select("conv_id", "turn", F.posexplode(lines).alias("line_no", "line")).select(
        "conv_id", "turn", "line_no", BK.strip_enumeration(F.col("line")).alias("line"))


@register("pool_pick")
def _pool(spark, sf):
    it = _items(spark, sf)
    weak, moderate = F.slice("distractors", 1, 4), F.slice("distractors", 5, 5)
    return it.select("question",
                     F.when(F.size(weak) > 0, BK.pool_pick(weak, "weak", F.col("question")))
                     .alias("weak"),
                     F.when(F.size(moderate) > 0, BK.pool_pick(moderate, "moderate",
                                                               F.col("question")))
                     .alias("moderate"))


# ---------------------------------------------------------------- joins and dedupe
def _bench_pieces(spark, sf):
    bm = B.table(spark, sf, "benchmark")
    return bm.select("item_id", F.posexplode(F.split("text", B.PIECE_SPLIT)).alias("pos", "t")) \
        .select("item_id", "pos", F.regexp_replace("t", B.WS, "").alias("correct_answer")) \
        .where(F.col("correct_answer") != "") \
        .withColumn("load_pos", F.struct("item_id", "pos"))


@register("dedupe_first")
def _dfirst(spark, sf):
    it = _items(spark, sf).select("correct_answer", "question",
                                  F.struct("doc_id", "block").alias("load_pos"))
    return J.dedupe_first(it, "correct_answer", "load_pos").select("correct_answer", "question")


@register("dedupe_last")
def _dlast(spark, sf):
    it = _items(spark, sf).select("correct_answer", "question",
                                  F.struct("doc_id", "block").alias("load_pos"))
    return J.dedupe_last(it, "correct_answer", "load_pos").select("correct_answer", "question")


@register("join_reference_answers")
def _jref(spark, sf):
    sets = _items(spark, sf).select("question", "correct_answer")
    j = J.join_reference_answers(sets, _bench_pieces(spark, sf), "correct_answer")
    return j.select("question", "correct_answer", F.col("ref_item_id").alias("ref_item_id"))


@register("join_original_first")
def _jfirst(spark, sf):
    sets = _items(spark, sf).select("question", "correct_answer")
    j = J.join_original_first(sets, _bench_pieces(spark, sf), "correct_answer")
    return j.select("question", "correct_answer", F.col("orig_item_id").alias("orig_item_id"))


@register("unmatched_questions")
def _unmatched(spark, sf):
    sets = _items(spark, sf).select("question", "correct_answer")
    return J.unmatched_questions(sets, _bench_pieces(spark, sf), "correct_answer").select("question")


@register("join_index")
def _jindex(spark, sf):
    s = cut_lineage(S.set_summary(B.responses(spark, sf)))  # one row per set, one scan
    return s.select("distractor_set", "accuracy").join(
        s.select("distractor_set", "response_time"), "distractor_set", "left")


@register("value_counts_top1")
def _vc(spark, sf):
    r = B.responses(spark, sf)
    return S.value_counts_top1(r.where(~F.col("is_correct")), "question", "llm_answer")


@register("conditional_mean")
def _cm(spark, sf):
    return S.conditional_mean(B.responses(spark, sf), "question", "confidence",
                              F.col("is_correct"))


@register("filter_in")
def _fin(spark, sf):
    """Membership filter on the set, then one summary row per set."""
    return S.set_summary(B.responses(spark, sf).where(F.col("distractor_set").isin("click", "view")))


@register("round_n")
def _rounded(spark, sf):
    """The summaries rounded as the evaluator reports them."""
    return S.model_distractor_summary(B.responses(spark, sf), rounded=True)


@register("nunique")
def _nu(spark, sf):
    return B.responses(spark, sf).groupBy("question").agg(
        F.countDistinct("is_correct").alias("n_distinct_outcomes"))


@register("first_value")
def _fv(spark, sf):
    return J.dedupe_first(B.responses(spark, sf).select("question", "response_id", "subject"),
                          "question", "response_id").select("question", "subject")


# ---------------------------------------------------------------- sources / sinks
from optiq.sources import files as FS  # noqa: E402


@register("scan_items")
def _scan_items(spark, sf):
    """Round trip: the bound bank is written as JSON to the shared folder and read back."""
    it = _items(spark, sf).select("question", "correct_answer",
                                  F.col("distractors").alias("options"), "subject")
    path = scratch_path(spark, "items-json")
    FS.sink_json(it, path)
    back = FS.scan_items(spark, path, multiline=False)
    return back.select("question", "correct_answer",
                       F.concat_ws(" | ", "options").alias("options"), "subject")


@register("scan_distractor_sets")
def _scan_sets(spark, sf):
    """Round trip: one folder of JSON files per distractor set; set name from the path."""
    it = _items(spark, sf)
    path = scratch_path(spark, "sets-json")
    (it.select("question", "correct_answer",
               BK.number_distractors(F.col("distractors")).alias("distractors"),
               "subject", F.col("distractor_set").alias("set"))
     .write.partitionBy("set").json(path))
    df = FS.scan_distractor_sets(spark, path, prefix="set=", multiline=False, name_from="folder")
    return df.select("question", "distractor_set", F.size("distractors").alias("n_distractors"))


@register("load_results")
def _load_results(spark, sf):
    """Round trip of graded responses through the flat CSV sink and loader; the
    answers hold quotes, commas and line breaks, confidences hold nulls."""
    g = EV.grade_replies(B.raw_responses(spark, sf))
    flat = g.select("question", F.lit("unknown").alias("subject"), "correct_answer",
                    F.concat("llm_answer", F.lit(' "so",\nthen')).alias("llm_answer"),
                    "is_correct", "confidence", "response_time", "reasoning_text",
                    "reasoning_metrics", "distractor_set",
                    F.col("distractor_set").alias("distractor_type"), "model")
    path = scratch_path(spark, "responses-csv")
    FS.sink_csv(flat, path)
    return FS.load_results(spark, csv_path=path).select(
        "model", "distractor_set", "question", "correct_answer", "llm_answer", "is_correct",
        "confidence", "response_time")


@register("load_results_envelope")
def _load_envelope(spark, sf):
    """Round trip of graded responses through JSON envelopes, one from each task, whose
    ``detailed_results`` arrays are read back in splits."""
    import pyarrow as pa
    g = EV.grade_replies(B.raw_responses_from_events(dealt(table(spark, sf, "events"))))
    rows = g.select(F.to_json(F.struct(
        "question", "correct_answer", F.concat("llm_answer", F.lit(' }{"so",\n[then]')).alias("llm_answer"), "is_correct",
        "confidence", "response_time", "reasoning_text", "reasoning_metrics", "distractor_set", "model")).alias("value"))

    def envelope(batches):
        yield pa.RecordBatch.from_pydict({"value": ['{"summary": {"n": {"of": 1}}, "detailed_results": [']})
        comma = ""
        for batch in batches:
            lines = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"value": [comma + lines[0], *("," + x for x in lines[1:])] if lines else []},
                                             schema=pa.schema([("value", pa.string())]))
            comma = "," if lines else comma
        yield pa.RecordBatch.from_pydict({"value": ['], "more": [{"question": "no"}]}']})

    path = scratch_path(spark, "responses-envelope")
    rows.mapInArrow(envelope, "value string").write.text(path)
    return FS.load_results(spark, json_path=path).select(
        "model", "distractor_set", "question", "correct_answer", "llm_answer", "is_correct", "confidence",
        "response_time", "reasoning_metrics.steps_count")


@register("scan_split_csv_pair")
def _split_pairs(spark, sf):
    """Question and answer files of every subject in the order of the items, the last answer of
    each subject left out; read back in splits and paired by line number. A subject's lines go to
    several files where it is large; these follow each other by name."""
    a = _assembled(spark, sf).withColumn("subject", F.coalesce("subject", F.lit("none")))

    def q(c):
        return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))

    opts = F.col("presented_options")
    lines = a.select("subject", "question", (F.array_position(opts, F.col("correct_answer")) - 1).cast("string").alias("at"),
                     F.concat_ws(",", q(F.col("question")), F.array_join(F.transform(opts, q), ",")).alias("line"))
    # written once: the last questions, the ranges and both sides are taken from it
    path = scratch_path(spark, "split-pairs")
    lines.write.option("compression", "zstd").parquet(f"{path}/lines")
    lines = spark.read.parquet(f"{path}/lines")
    lines.groupBy("subject").agg(F.max("question").alias("last")).write.parquet(f"{path}/last")
    question, answer = (F.struct(F.lit(side).alias("side"), F.col(value).alias("value"))
                        for side, value in (("questions", "line"), ("answers", "at")))
    sides = (J.join_bounded(lines, spark.read.parquet(f"{path}/last"), "subject", "left")
             .select("subject", "question", F.inline(F.when(F.col("question") == F.col("last"), F.array(question))
                                                     .otherwise(F.array(question, answer)))))
    for side in ("questions", "answers"):  # the folder of a side without rows
        spark.createDataFrame([], "value string").write.text(f"{path}/sides/side={side}")
    (sides.repartitionByRange("subject", "question").sortWithinPartitions("side", "subject", "question").drop("question")
     .write.mode("append").partitionBy("side", "subject").text(f"{path}/sides"))
    out = FS.scan_split_csv_folders(spark, f"{path}/sides/side=questions", f"{path}/sides/side=answers", prefix="subject=")
    return out.select("subject", "pos", "question", F.concat_ws(" | ", "options").alias("options"), "correct_answer")


@register("scan_reading_sets")
def _scan_reading(spark, sf):
    """Round trip of items with a passage through JSON files."""
    it = _items(spark, sf)
    path = scratch_path(spark, "reading-json")
    FS.sink_json(it.select(F.concat_ws(" / ", "question", "correct_answer").alias("passage"), "question",
                           "correct_answer", BK.number_distractors(F.col("distractors")).alias("distractors"),
                           "subject"), path)
    back = FS.scan_reading_sets(spark, path, multiline=False)
    return back.select("passage", "question", "correct_answer", F.size("distractors").alias("n_distractors"))


@register("scan_tolerant")
def _scan_tolerant(spark, sf):
    """JSON lines of which every other one is cut off: good rows and quarantined records."""
    it = _items(spark, sf).select("question", "correct_answer", "block")
    whole = F.to_json(F.struct("question", "correct_answer"))
    cut = F.concat(F.lit('{"question": "'), F.col("question"))
    path = scratch_path(spark, "tolerant-json")
    it.select(F.when(F.col("block") % 2 == 0, whole).otherwise(cut).alias("value")).write.text(path)
    good, bad = FS.scan_tolerant(spark, path, multiline=False, glob="*.txt")
    return good.select("question", F.lit(True).alias("good")).unionByName(
        bad.select(F.col("_corrupt_record").alias("question"), F.lit(False).alias("good")))


@register("gate_dataset")
def _gate(spark, sf):
    return FS.gate_dataset(_items(spark, sf))


# ---------------------------------------------------------------- helpers as queries
from optiq.functions import arrays as AR  # noqa: E402


@register("item_discrimination")
def _idisc(spark, sf):
    return P.item_discrimination(B.responses(spark, sf))


@register("list_mean")
def _lmean(spark, sf):
    it = _items(spark, sf)
    return it.select("question", AR.list_mean(F.transform("distractors", lambda d: F.length(d)))
                     .alias("mean_distractor_length"))


@register("array_except")
def _aexcept(spark, sf):
    a = _assembled(spark, sf)
    wrong = AR.array_except_value(F.col("presented_options"), F.col("correct_answer"))
    return a.select("question", F.size(wrong).alias("n_wrong"),
                    F.concat_ws(" | ", wrong).alias("wrong_options"))


@register("zip_positional")
def _zip(spark, sf):
    z = B.text_item_successors(spark, sf, keep_empty=True).select(
        "question", AR.zip_positional(F.col("orig"), F.col("new")).alias("z"))
    return z.select("question", F.size("z").alias("n_pairs"),
                    F.concat_ws(" | ", F.transform("z", lambda p: F.concat(p["a"], F.lit(" -> "),
                                                                           p["b"]))).alias("pairs"))


@register("set_trend")
def _trend(spark, sf):
    """Per-set accuracy and latency with the set's rank by accuracy (chart order).
    The window runs on the aggregated table: one row per set."""
    s = S.set_summary(B.responses(spark, sf))
    return s.withColumn("accuracy_rank", F.rank().over(Window.orderBy(F.col("accuracy").desc())))


@register("scan_summary_maps")
def _maps(spark, sf):
    """Round trip of the legacy {set: value} envelope through JSON."""
    s = S.set_summary(B.responses(spark, sf))
    env = s.agg(F.map_from_entries(F.collect_list(F.struct("distractor_set", "accuracy")))
                .alias("accuracy_summary"),
                F.map_from_entries(F.collect_list(F.struct("distractor_set", "response_time")))
                .alias("response_time_summary"))
    path = scratch_path(spark, "summary-maps")
    FS.sink_json(env, path)
    return FS.scan_summary_maps(spark, path)


@register("normalize_json")
def _norm(spark, sf):
    """Nested replies written as JSON, read with a schema and flattened."""
    g = EV.grade_replies(B.raw_responses(spark, sf)).select("response_id", "reasoning_metrics")
    path = scratch_path(spark, "nested-json")
    FS.sink_json(g, path)
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("response_id", T.LongType()),
                           T.StructField("reasoning_metrics", FS.METRICS)])
    return FS.normalize_json(spark.read.schema(schema).json(path))


@register("distinct_values")
def _distinct(spark, sf):
    names = ["model", "distractor_set"]
    both = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in names])
    return B.responses(spark, sf).select(F.inline(both)).distinct()


@register("json_extract")
def _jx(spark, sf):
    ev = B.table(spark, sf, "events")
    return ev.select("event_id", PF.json_extract(F.col("props"), "$.k", "-1").alias("k"),
                     PF.json_extract(F.col("props"), "$.missing", "none").alias("missing"))


@register("cross_models")
def _xmodels(spark, sf):
    """Items x models as a generator column; counted per model and set."""
    it = _items(spark, sf).select("question", "distractor_set")
    x = it.withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS])))
    return x.groupBy("model", "distractor_set").agg(F.count(F.lit(1)).alias("n_calls"))


@register("meteor_stem")
def _meteor_stem(spark, sf):
    """METEOR with the Porter stem stage (no SQL stemmer: checked by unit tests)."""
    return TS.meteor(B.conversation_pairs(spark, sf), ["conv_id", "turn"], stem_stage=True)


@register("parse_csv_line")
def _csv_lines(spark, sf):
    """Each assembled item written as a quoted CSV line plus its answer index,
    then parsed back (fields with commas and quotes survive the round trip)."""
    a = _assembled(spark, sf)

    def q(c):
        return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))

    opts = F.col("presented_options")
    line = F.concat_ws(",", q(F.col("question")), F.array_join(F.transform(opts, q), ","))
    idx = (F.array_position(opts, F.col("correct_answer")) - 1).cast("string")
    lines = a.select(F.col("question").alias("pos"), line.alias("line"), idx.alias("answer_line"))
    out = FS.parse_csv_line(lines)
    return out.select(F.col("pos").alias("item"), "question",
                      F.concat_ws(" | ", "options").alias("options"), "correct_answer")


@register("sink_parquet")
def _sink_parquet(spark, sf):
    """Graded responses written as parquet partitioned by model (one folder per
    model), read back whole and summarised per model and set."""
    g = EV.grade_replies(B.raw_responses(spark, sf), with_reasoning=False).select(
        "response_id", "model", "distractor_set", "is_correct", "confidence", "response_time")
    path = scratch_path(spark, "responses-parquet")
    FS.sink_parquet(g, path, partition_by=("model",))
    back = spark.read.parquet(path)
    return back.groupBy("model", "distractor_set").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_correct").cast("int")).alias("n_correct"),
        F.avg("confidence").alias("avg_confidence"))


@register("quality_legacy")
def _qlegacy(spark, sf):
    """List-valued quality records. For the value comparison each list is rendered as
    text: elements at single precision, in units of 1e-7 rounded half up (``%e`` rounds
    ties of exact binary fractions differently in the two engines), comma-joined."""
    q = QL.quality_legacy(spark, sf)

    def text(c):
        return F.concat_ws(",", F.transform(
            c, lambda x: F.round(x.cast("float").cast("double") * 1e7).cast("long").cast("string")))

    return q.select("question", "distractor_set", text(F.col("meteor_scores")).alias("meteor_scores"),
                    text(F.col("legal_relevance_scores")).alias("legal_relevance_scores"),
                    text(F.col("grammar_scores")).alias("grammar_scores"),
                    text(F.col("semantic_scores")).alias("semantic_scores"), "diversity")
