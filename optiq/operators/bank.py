"""Question-bank preparation: union, replication, seeded sampling, option assembly,
evaluation plan, prompt text, generated-line parsing.

Randomness is always ``md5(seed || key)``: deterministic, identical in every
engine, and independent of partitioning (``rand()`` is none of these).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from optiq.operators.joins import join_bounded, union_all
from optiq.functions.parse import strip


def seeded_hash(seed, *cols: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def union_subjects(*dfs: DataFrame) -> DataFrame:
    """Append per-subject banks (union all, no dedupe)."""
    return union_all(*dfs)


def replicate_bank(items: DataFrame, times: int = 50) -> DataFrame:
    """Each row ``times`` times, numbered by ``copy`` (a generator, not a join)."""
    return items.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def top_k_per_group(df: DataFrame, keys, order: list[Column], k: int) -> DataFrame:
    """Rows ranked 1..k per group by ``order`` (ties broken by the order list).

    Spark limits each group to k rows in every task before the shuffle
    (``WindowGroupLimit``), so a hot group arrives as k rows per input split.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def sample_exact_n(items: DataFrame, n: int = 150, seed=0, id_col: str = "question") -> DataFrame:
    """Exactly n rows without replacement (fewer if the bank is smaller).

    A limit over a seeded hash order: Spark runs it as a per-partition top-n
    followed by one merge of n rows per task.
    """
    return items.orderBy(seeded_hash(seed, F.col(id_col)), F.col(id_col)).limit(n)


def sample_balanced(items: DataFrame, per_group: int, by: str = "subject", seed=0,
                    id_col: str = "question") -> DataFrame:
    """Equal quota per group (the stated intent of the bank builder)."""
    order = [seeded_hash(seed, F.col(id_col)), F.col(id_col)]
    return top_k_per_group(items, by, order, per_group).drop("rank")


def cycle_fill(items: DataFrame, n: int = 150, seed=0, id_col: str = "question",
               bank_size: int | None = None) -> DataFrame:
    """Repeat the bank, each round in its own seeded shuffle, and keep the first n."""
    size = bank_size if bank_size is not None else items.count()
    rounds = max(1, n // max(size, 1) + 1)
    rep = items.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    return (rep.orderBy(F.col("round"), seeded_hash(seed, F.col("round"), F.col(id_col)),
                        F.col(id_col))
            .limit(n))


def number_distractors(lines: Column) -> Column:
    """list -> {"1": first, "2": second, ...}."""
    keys = F.transform(F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))),
                       lambda i: i.cast("string"))
    return F.when(F.size(lines) > 0,
                  F.map_from_arrays(F.slice(keys, 1, F.size(lines)), lines)).otherwise(
        F.create_map().cast("map<string,string>"))


def map_values_in_key_order(m: Column) -> Column:
    """Values of a {"1": .., "2": ..} map ordered by the integer key."""
    entries = F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(
        e["key"].try_cast("int").alias("k"), e["key"].alias("s"), e["value"].alias("v"))))
    return F.transform(entries, lambda e: e["v"])


def assemble_options(items: DataFrame, seed=0, key: str = "question") -> DataFrame:
    """Options if present, else the distractors; the correct answer appended when
    missing; then a seeded shuffle per question."""
    base = F.coalesce(F.col("options"), F.col("distractors"))
    with_ok = F.when(F.array_contains(base, F.col("correct_answer")), base).otherwise(
        F.concat(base, F.array(F.col("correct_answer"))))
    q = F.col(key)
    shuffled = F.transform(
        F.array_sort(F.transform(with_ok, lambda o: F.struct(
            seeded_hash(seed, q, o).alias("h"), o.alias("o")))),
        lambda s: s["o"])
    return items.withColumn("presented_options", shuffled)


def build_eval_plan(items: DataFrame, models: list[str], detailed: int = 5,
                    order: tuple[str, ...] = ("doc_id", "block"), firsts_dir: str | None = None) -> DataFrame:
    """(original bank + every distractor set) x models; the first ``detailed``
    items of each set (load order) ask for reasoning. The keys of those items are
    written to ``firsts_dir`` if given: then their size is known when the join is
    planned, and while they are few the items are not shuffled.

    Models are a generator column, not a join. The first-k flag is computed on
    the items once (it does not depend on the model).
    """
    original = items.withColumn("plan_set", F.lit("original"))
    typed = items.withColumn("plan_set", F.col("distractor_set"))
    plan = original.unionByName(typed)
    firsts = (top_k_per_group(plan.select("plan_set", *order), "plan_set",
                              [F.col(c) for c in order], detailed)
              .select("plan_set", *order, F.lit(True).alias("request_reasoning")))
    if firsts_dir is not None:
        firsts.write.parquet(firsts_dir)
        firsts = items.sparkSession.read.parquet(firsts_dir)
    # k rows per set
    flagged = (join_bounded(plan, firsts, ["plan_set", *order], "left")
               .withColumn("request_reasoning",
                           F.coalesce(F.col("request_reasoning"), F.lit(False))))
    return flagged.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


# ---- fixed values: prompt wording of the evaluator -----------------------------
PROMPT_REASONING = (
    "Please think through this step-by-step before answering. "
    "First provide your reasoning, then clearly state your final answer.\n\n"
    "Please end your response with:\n"
    "Answer: [exact text of your chosen option]\n"
    "Confidence: [0-100] (your confidence in this answer)\n")
PROMPT_SHORT = (
    "Respond with your answer choice exactly as it appears in the options.\n"
    "Also rate your confidence from 0-100, where 100 means absolutely certain.\n\n"
    "Format: Answer: [your answer]\nConfidence: [0-100]\n")
# wording of the first evaluator and of the distractor generator
PROMPT_LEGACY = (
    "Read the question and select the best answer from the provided options.\n\n",
    "Question: ", "\n\nOptions: ", "\n\nRespond with the best answer choice exactly as it appears.")
PROMPT_GENERATE = (
    "Given the following multiple-choice question and correct answer, generate ",
    " plausible but incorrect distractors.\n\nQuestion: ", "\nCorrect Answer: ", "\nDistractors:\n")
# --------------------------------------------------------------------------------


def legacy_prompt(question: Column, options: Column) -> Column:
    intro, q, o, end = map(F.lit, PROMPT_LEGACY)
    return F.concat(intro, q, question, o, F.concat_ws(", ", options), end)


def generate_prompt(question: Column, correct: Column, n: Column) -> Column:
    intro, q, answer, end = map(F.lit, PROMPT_GENERATE)
    return F.concat(intro, n.cast("string"), q, question, answer, correct, end)


def format_prompt(question: Column, options: Column, request_reasoning: Column) -> Column:
    head = F.concat(F.lit("Question: "), question, F.lit("\nOptions: "),
                    F.concat_ws(", ", options), F.lit("\n\n"))
    return F.concat(head, F.when(request_reasoning, F.lit(PROMPT_REASONING))
                    .otherwise(F.lit(PROMPT_SHORT)))


def parse_generated_lines(raw: Column, n: int, failed: Column | None = None) -> Column:
    """Model output -> first n non-empty stripped lines; on failure n x "Failed to generate"."""
    lines = F.filter(F.transform(F.split(strip(raw), "\n"), strip), lambda s: s != "")
    out = F.slice(lines, 1, n)
    fallback = F.array_repeat(F.lit("Failed to generate"), n)
    return out if failed is None else F.when(failed, fallback).otherwise(out)


def strip_enumeration(c: Column) -> Column:
    """Drop a leading "1. " / "2) " enumeration (off by default for parity)."""
    return F.regexp_replace(c, r"^\d+[.)]\s*", "")


def pool_pick(pool: Column, seed, key: Column) -> Column:
    """One seeded entry of an array pool per key."""
    idx = F.pmod(F.conv(F.substring(seeded_hash(seed, key), 1, 8), 16, 10).cast("long"),
                 F.size(pool)) + 1
    return F.element_at(pool, idx.cast("int"))
