"""Reply parsing as Column expressions (JVM-side, no Python UDFs).

Every function takes and returns Columns, so a whole grading step is one
projection inside whole-stage codegen (array lambdas are interpreted but stay
in the JVM and need no shuffle).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the evaluator's rules) -------------------------
ANSWER_PATTERN = r"(?iU)answer:?\s*([^\n]+?)(?:\n|$|confidence)"
STRICT_ANSWER_PATTERN = r"(?im)^answer:[ \t]*([^\n]+)$"
CONFIDENCE_PATTERN = r"(?U)confidence:?\s*([0-9]+)"
NO_ANSWER = "Error: No clear answer"
ERROR_ANSWER = "Error"
REASONING_MARKERS = ["reasoning:", "step ", "thinking:", "first,", "second,", "third,"]
REASONING_STOPS = ["confidence:", "answer:"]
STEP_PATTERN = r"step \d|first[,:]|second[,:]|third[,:]|finally[,:]"
UNCERTAINTY_WORDS = ["maybe", "perhaps", "possibly", "likely", "unlikely", "might", "could",
                     "not sure", "unclear"]
# ------------------------------------------------------------------------------

_WS = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Python ``str.strip()``: Unicode white space (Spark ``trim`` only cuts spaces)."""
    return F.regexp_replace(c, _WS, "")


def extract_answer(reply: Column, strict: bool = False) -> Column:
    """Text after the first ``answer`` label, stripped; NULL when there is none.

    Compat mode keeps the evaluator's optional colon, so prose such as
    "The answer is:" yields ``is:``. Strict mode needs a line starting with
    ``answer:`` and takes the last such line.
    """
    if strict:
        found = F.regexp_extract_all(reply, F.lit(STRICT_ANSWER_PATTERN), 1)
        return F.when(F.size(found) > 0, strip(F.element_at(found, -1)))
    g = F.regexp_extract(reply, ANSWER_PATTERN, 1)
    return F.when(g != "", strip(g))


def snap_to_option(answer: Column, options: Column) -> Column:
    """First option (presented order) contained in the answer, case-insensitively."""
    hit = F.get(F.filter(options, lambda o: F.contains(F.lower(answer), F.lower(o))), 0)
    return F.coalesce(hit, answer)


def fallback_answer(reply: Column, options: Column) -> Column:
    """No answer label: first option appearing verbatim in the reply, else the error text."""
    hit = F.get(F.filter(options, lambda o: F.contains(reply, o)), 0)
    return F.coalesce(hit, F.lit(NO_ANSWER))


def parse_answer(reply: Column, options: Column) -> Column:
    """The evaluator's full answer rule: label -> snap, else verbatim option, else error."""
    a = extract_answer(reply)
    return F.when(a.isNotNull(), snap_to_option(a, options)).otherwise(
        fallback_answer(reply, options))


def extract_confidence(reply: Column) -> Column:
    """Integer after ``confidence`` (lower-cased text), clamped to 0..100, NULL if absent.

    Digits are clamped as text first, so arbitrarily long digit runs never
    overflow; NULLs are never fed to least/greatest (they would skip them).
    """
    c = F.regexp_extract(F.lower(reply), CONFIDENCE_PATTERN, 1)
    z = F.regexp_replace(c, "^0+", "")
    return (F.when(c == "", F.lit(None).cast("int"))
            .when(F.length(z) == 0, F.lit(0))
            .when(F.length(z) > 3, F.lit(100))
            .otherwise(F.least(F.lit(100), z.cast("int"))))


def _any_contains(text: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def _any_prefix(text: Column, prefixes) -> Column:
    return reduce(lambda a, b: a | b, [text.startswith(p) for p in prefixes])


def extract_reasoning(reply: Column) -> Column:
    """Reasoning lines of a reply, as the evaluator's line state machine keeps them.

    A stripped line containing a marker (case-insensitive) starts or continues
    the capture and is kept; while capturing, non-empty lines are kept until a
    line starting with lower-case ``confidence:``/``answer:`` ends it.
    Runs as a fold over the reply's lines (``aggregate``), per row, no shuffle.
    """
    init = F.struct(F.lit(False).alias("on"),
                    F.array().cast("array<string>").alias("out"))

    # each in a step of its own: a lambda computes an expression anew at each place of use
    stripped = F.transform(F.split(reply, "\n"), strip)
    lowered = F.transform(stripped, lambda t: F.struct(t.alias("line"), F.lower(t).alias("low")))
    lines = F.transform(lowered, lambda t: F.struct(
        t["line"].alias("line"), _any_contains(t["low"], REASONING_MARKERS).alias("marker"),
        _any_prefix(t["line"], REASONING_STOPS).alias("stop")))

    def step(acc, t):
        line, marker, stop = t["line"], t["marker"], t["stop"]
        keep = marker | (acc["on"] & (line != "") & ~stop)
        on = F.when(marker, F.lit(True)).when(acc["on"] & stop, F.lit(False)).otherwise(acc["on"])
        out = F.when(keep, F.concat(acc["out"], F.array(line))).otherwise(acc["out"])
        return F.struct(on.alias("on"), out.alias("out"))

    return F.aggregate(lines, init, step,
                       lambda acc: F.array_join(acc["out"], "\n"))


def count_substring(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of ``word`` (``str.count``)."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit(""))))
                   / len(word)).cast("int")


def reasoning_metrics(reasoning: Column) -> Column:
    """struct<reasoning_length, steps_count, uncertainty_markers>; zeros for empty text."""
    low = F.lower(reasoning)
    steps = F.regexp_count(low, F.lit(STEP_PATTERN)).cast("int")
    unc = reduce(lambda a, b: a + b, [count_substring(low, w) for w in UNCERTAINTY_WORDS])
    empty = reasoning.isNull() | (reasoning == "")
    return F.struct(
        F.when(empty, 0).otherwise(F.length(reasoning)).cast("int").alias("reasoning_length"),
        F.when(empty, 0).otherwise(F.greatest(F.lit(1), steps)).cast("int").alias("steps_count"),
        F.when(empty, 0).otherwise(unc).cast("int").alias("uncertainty_markers"))


METRICS_SCHEMA = "struct<reasoning_length:int,steps_count:int,uncertainty_markers:int>"


def parse_metrics_column(c: Column) -> Column:
    """Metrics stored as a Python-repr string (single quotes) or JSON; zeros otherwise."""
    parsed = F.from_json(F.regexp_replace(c, "'", '"'), METRICS_SCHEMA)
    return F.struct(*[F.coalesce(parsed[f], F.lit(0)).alias(f)
                      for f in ("reasoning_length", "steps_count", "uncertainty_markers")])


def json_extract(c: Column, path: str, default=None) -> Column:
    """Nested JSON field lookup with a default."""
    v = F.get_json_object(c, path)
    return v if default is None else F.coalesce(v, F.lit(default))


def grade_exact(answer: Column, correct: Column) -> Column:
    """Case- and space-sensitive equality; NULL answers are simply wrong."""
    return F.coalesce(answer == correct, F.lit(False))
