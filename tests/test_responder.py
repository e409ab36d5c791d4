"""The responder hook: batches, retries, error rows and resumption."""

import os
import tempfile
from pathlib import Path

from optiq.plans.responder import replies_of, score_with


def plan(spark, n=100, parts=4):
    return spark.range(n).selectExpr("id response_id", "concat('q', id) question").repartition(parts)


def test_batches_are_bounded_and_bad_calls_cost_no_others(spark):
    def respond(rows):
        assert len(rows) <= 7
        if any(r["response_id"] % 10 == 3 for r in rows):
            raise ValueError("no")
        return [f"{r['question']} of {len(rows)}" for r in rows]

    got = {r.response_id: r for r in replies_of(plan(spark), respond, "response_id", batch_rows=7, retries=1).collect()}
    assert len(got) == 100
    for i, r in got.items():
        assert (r.raw_response is None) == (i % 10 == 3) == (r.error == "ValueError: no")
        assert i % 10 == 3 or r.raw_response.startswith(f"q{i} of ")
    assert all(got[i].attempts == 3 for i in range(3, 100, 10))  # two of the batch, one alone


def test_a_flaky_responder_is_tried_again(spark):
    folder = tempfile.mkdtemp(prefix="optiq-calls-")

    def respond(rows):
        mark = Path(folder, "-".join(str(r["response_id"]) for r in rows[:1]))
        if not mark.exists():
            mark.touch()
            raise TimeoutError
        return ["ok"] * len(rows)

    got = replies_of(plan(spark, 20, 2), respond, "response_id", batch_rows=5, retries=2).collect()
    assert {(r.raw_response, r.error, r.attempts) for r in got} == {("ok", None, 2)}


def test_wrong_number_of_replies_is_an_error(spark):
    got = replies_of(plan(spark, 4, 1), lambda rows: ["x"] * (len(rows) + 1), "response_id").collect()
    assert all(r.raw_response is None and "replies to" in r.error for r in got)


def test_a_stopped_run_goes_on_after_what_is_written(spark):
    folder, out = tempfile.mkdtemp(prefix="optiq-calls-"), os.path.join(tempfile.mkdtemp(prefix="optiq-out-"), "replies")

    def calls(names):
        return [int(p.name.split("-")[0]) for n in names for p in Path(folder, n).iterdir()]

    def logged(name, good):
        os.makedirs(os.path.join(folder, name), exist_ok=True)

        def respond(rows):
            for r in rows:
                Path(folder, name, f"{r['response_id']}-{os.getpid()}-{os.urandom(4).hex()}").touch()
            if not all(good(r["response_id"]) for r in rows):
                raise RuntimeError("down")
            return [f"{name} {r['response_id']}" for r in rows]
        return respond

    first = score_with(plan(spark), logged("a", lambda i: i % 4 != 1), out, rounds=3, batch_rows=1, retries=0).collect()
    assert sum(r.error is None for r in first) == 75
    second = score_with(plan(spark, 120), logged("b", lambda i: True), out, rounds=2, batch_rows=8).collect()
    assert len(second) == 120 and all(r.error is None for r in second)
    assert sorted(calls("b")) == sorted([i for i in range(100) if i % 4 == 1] + list(range(100, 120)))
    assert {r.response_id: r.raw_response for r in second}[0] == "a 0"
    assert score_with(plan(spark, 120), logged("c", lambda i: True), out).count() == 120 and not calls("c")


def test_an_empty_plan(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="optiq-out-"), "replies")
    assert score_with(plan(spark).where("false"), lambda rows: rows, out, rounds=2).collect() == []
