"""File sources and sinks on small fixtures written by the tests themselves."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from optiq.sources import files as FS

from conftest import FIXTURES


def _tmp():
    return tempfile.mkdtemp(prefix="optiq-src-")


def test_parse_csv_line_quoting_and_naive(spark):
    lines = spark.createDataFrame(
        [(0, '"What, exactly, is law?",A,B,C,D', "2"),
         (1, "Q2,w,x,y,z", "9"),          # index out of range -> dropped
         (2, "Q3,w,x,y,z", "b"),          # not an integer -> dropped
         (3, "Q4,w,x", "0"),              # fewer than 5 fields -> dropped
         (4, "Q5,w,x,y,z", "-1")],        # negative index -> dropped
        "pos int, line string, answer_line string")
    q = {r.pos: r for r in FS.parse_csv_line(lines).collect()}
    assert set(q) == {0}
    assert q[0].question == "What, exactly, is law?" and q[0].correct_answer == "C"
    naive = {r.pos: r for r in FS.parse_csv_line(lines, naive=True).collect()}
    assert naive[0].question == "What" and naive[0].options[0] == " exactly"


def test_scan_split_csv_pair_truncates(spark):
    d = _tmp()
    with open(os.path.join(d, "q.csv"), "w") as f:
        f.write("Q1,a,b,c,d\nQ2,a,b,c,d\nQ3,a,b,c,d\n")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("0\n3\n")
    rows = FS.scan_split_csv_pair(spark, os.path.join(d, "q.csv"), os.path.join(d, "a.csv"),
                                  "law").orderBy("pos").collect()
    assert [(r.question, r.correct_answer, r.subject) for r in rows] == [("Q1", "a", "law"),
                                                                         ("Q2", "d", "law")]


def test_scan_tolerant_quarantines(spark):
    d = _tmp()
    good = [{"question": "q", "correct_answer": "a", "distractors": {"1": "b"}}]
    with open(os.path.join(d, "good.json"), "w") as f:
        json.dump(good, f)
    with open(os.path.join(d, "broken.json"), "w") as f:
        f.write('[{"question": "q", "correct_answer": ')
    ok, bad = FS.scan_tolerant(spark, d)
    assert ok.count() == 1
    assert [r.file_name for r in bad.collect()] == ["broken.json"]


def test_reading_sets_and_set_names(spark):
    df = FS.scan_reading_sets(spark, os.path.join(FIXTURES, "reading"))
    names = {r.distractor_set for r in df.select("distractor_set").distinct().collect()}
    assert names == {"weak", "moderate"}
    assert df.where(F.col("passage").isNull()).count() == 0
    assert df.select(F.size("distractors").alias("n")).distinct().collect()[0].n == 3


def test_load_results_envelope_and_csv_sink(spark):
    d = _tmp()
    env = {"detailed_results": [
        {"question": "q", "subject": "s", "correct_answer": "a", "llm_answer": "a",
         "is_correct": True, "confidence": 90, "response_time": 0.5, "reasoning_text": "x",
         "reasoning_metrics": {"reasoning_length": 1, "steps_count": 1, "uncertainty_markers": 0},
         "distractor_set": "original", "distractor_type": "original", "model": "m"}]}
    with open(os.path.join(d, "results.json"), "w") as f:
        json.dump(env, f)
    df = FS.load_results(spark, json_path=os.path.join(d, "results.json"))
    assert df.first().reasoning_metrics.steps_count == 1
    out = os.path.join(d, "csv")
    FS.sink_csv(df, out)
    back = FS.load_results(spark, csv_path=out)
    assert back.first().confidence == 90 and "reasoning_text" not in spark.read.option(
        "header", True).csv(out).columns


def test_empty_bank_gate(spark):
    d = _tmp()
    with open(os.path.join(d, "empty.json"), "w") as f:
        f.write("[]")
    gate = FS.gate_dataset(FS.scan_items(spark, os.path.join(d, "empty.json"))).first()
    assert gate.usable is False


def test_parse_csv_line_doubled_quotes(spark):
    lines = spark.createDataFrame([(0, '"Say ""hi"", then go",A,"B, b","C ""c""",D', "3")],
                                  "pos int, line string, answer_line string")
    r = FS.parse_csv_line(lines).first()
    assert r.question == 'Say "hi", then go'
    assert list(r.options) == ["A", "B, b", 'C "c"', "D"] and r.correct_answer == "D"


def test_split_csv_pair_line_ends_and_several_files(spark):
    d = _tmp()
    for name, text in (("q.csv", 'Q1,a,b,c,d\r\nQ2,"e, ""f""",g,h,i\r\n'), ("a.csv", "3\r\n0\r\n")):
        with open(os.path.join(d, name), "w", newline="") as f:
            f.write(text)
    got = FS.scan_split_csv_pair(spark, os.path.join(d, "q.csv"), os.path.join(d, "a.csv"), "s").orderBy("pos").collect()
    assert [(r.question, r.correct_answer) for r in got] == [("Q1", "d"), ("Q2", 'e, "f"')]
    with pytest.raises(Exception, match="more than one file"):
        FS.scan_split_csv_pair(spark, d, os.path.join(d, "a.csv"), "s").collect()


def test_results_csv_of_other_tools(spark):
    d = _tmp()
    with open(os.path.join(d, "r.csv"), "w", newline="") as f:
        f.write("question,subject,correct_answer,llm_answer,is_correct,confidence,response_time,distractor_set,"
                'distractor_type,model\n"a ""b"",\nc",s,x,y,True,95.0,0.5,o,o,m\nq2,s,x,y,False,,0.5,o,o,m\n')
    rows = FS.load_results(spark, csv_path=os.path.join(d, "r.csv")).collect()
    assert [(r.question, r.confidence) for r in rows] == [('a "b",\nc', 95), ("q2", None)]
