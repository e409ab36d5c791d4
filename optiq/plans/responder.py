"""Scoring a plan of calls with the user's own responder.

``respond`` takes a list of rows (dicts) and returns one reply for each; it runs in the
tasks, on batches of ``batch_rows`` rows at most. A batch that raises is tried again
``retries`` times, then row by row, so one bad call costs no other one; what still
fails becomes an error row. The plan goes through in ``rounds``, each written as a whole
into ``out_dir``: a run that was stopped goes on after the last written round, and calls
that have a reply are not made again. Error rows are tried again by the next run. The plan
is read once a round, so a plan that is costly to make is best written first.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Respond = Callable[[list[dict]], list[str]]


def _answers(rows: list[dict], respond: Respond, retries: int) -> list[tuple[str | None, str | None, int]]:
    """(reply, error, attempts) for each row."""
    error, tries = None, 0
    for tries in range(1, retries + 2):
        try:
            replies = list(respond(rows))
            if len(replies) != len(rows):
                raise ValueError(f"{len(replies)} replies to {len(rows)} rows")
            return [(None if r is None else str(r), None, tries) for r in replies]
        except Exception as e:  # noqa: BLE001  whatever the user's code raises is that call's result
            error = f"{type(e).__name__}: {e}"[:500]
    if len(rows) == 1:
        return [(None, error, tries)]
    return [(reply, why, tries + n) for row in rows for reply, why, n in _answers([row], respond, 0)]


def replies_of(plan: DataFrame, respond: Respond, key: str, batch_rows: int = 64, retries: int = 2) -> DataFrame:
    """key, raw_response, error (null where there is a reply) and attempts for each row of ``plan``."""
    names = plan.columns
    at = names.index(key)

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), batch_rows):
                part = batch.slice(a, batch_rows)
                got = _answers(part.to_pylist(), respond, retries)
                reply, error, tries = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(at), pa.array(reply, pa.string()), pa.array(error, pa.string()), pa.array(tries, pa.int32())],
                    names=[key, "raw_response", "error", "attempts"])

    out = T.StructType([plan.schema[key], T.StructField("raw_response", T.StringType()),
                        T.StructField("error", T.StringType()), T.StructField("attempts", T.IntegerType())])
    return plan.mapInArrow(run, out)


def _written(plan: DataFrame, out_dir: str) -> DataFrame | None:
    try:
        return plan.sparkSession.read.parquet(out_dir)
    except AnalysisException:  # nothing written yet
        return None


def score_with(plan: DataFrame, respond: Respond, out_dir: str, key: str = "response_id", rounds: int = 1,
               batch_rows: int = 64, retries: int = 2) -> DataFrame:
    """key, raw_response and error of every row of ``plan`` (distinct keys): replies that
    ``out_dir`` holds already, and new ones for the rest, which are added to it."""
    before = _written(plan, out_dir)  # the rounds of one run have no keys in common
    for n in range(rounds):
        mine = plan.where(F.pmod(F.xxhash64(key), F.lit(rounds)) == n)
        if before is not None:
            mine = mine.join(before.where("error IS NULL").select(key), key, "left_anti").select(*plan.columns)
        replies_of(mine, respond, key, batch_rows, retries).write.mode("append").parquet(out_dir)
    held = _written(plan, out_dir).select(key, "raw_response", "error")
    if before is None:
        return held
    # a call that failed in an earlier run has rows of both kinds: the reply stands
    last = held.groupBy(key).agg(F.min_by(F.struct("raw_response", "error"), F.col("error").isNotNull()).alias("r"))
    return plan.select(key).join(last, key).select(key, "r.raw_response", "r.error")
