"""Sources read in splits: the same rows however a file is cut."""

import csv
import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from optiq.sources import files as FS
from optiq.sources import splits


@pytest.fixture(params=["134217728", "61", "700"])
def cut(spark, request):
    """Readers take splits of so many bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield int(request.param)
    for k, v in old.items():
        spark.conf.set(k, v)


def folder():
    return tempfile.mkdtemp(prefix="optiq-splits-")


def test_split_csv_pairs_of_many_subjects(spark, cut):
    rng = random.Random(4)
    root, want = folder(), []
    for s in ("law one", "a+b", "bio%20", "ünï"):
        os.mkdir(os.path.join(root, s))
        n, end = rng.randint(20, 60), rng.choice(["\n", "\r\n"])
        lines = [f'"Q{i}, {s}","o {i}, ""x""",b,c,é' for i in range(n)]
        answers = [str(rng.choice([0, 1, 3, 4, "z"])) for _ in range(n + rng.choice([-3, 0, 2]))]
        lines[4], answers[5] = "", ""
        with open(os.path.join(root, s, "test.csv"), "w", newline="", encoding="utf-8") as f:
            f.write(rng.choice(["", end * 2]) + end.join(lines) + end * rng.randint(0, 3))
        with open(os.path.join(root, s, "test_answers.csv"), "w", newline="", encoding="utf-8") as f:
            f.write(end.join(answers) + end)
        for i, (line, a) in enumerate(zip(lines, answers, strict=False)):
            if line and a in ("0", "1", "3"):
                want.append((s, i, f"Q{i}, {s}", [f'o {i}, "x"', "b", "c", "é"][int(a)]))
    df = FS.scan_split_csv_pairs(spark, root)
    got = [(r.subject, r.pos, r.question, r.correct_answer) for r in df.collect()]
    assert sorted(got) == sorted(want)
    if cut < 100:
        assert splits.pieces(spark, root, glob="test.csv").select("file", "block").distinct().count() > 20


def test_files_of_a_subject_follow_each_other(spark, cut):
    root = folder()
    for side, parts in (("q", ["\n\nQ0,a,b,c,d\n", "Q1,a,b,c,d\n\nQ3,a,b,c,d"]), ("a", ["0\n1\n2\n3\n"])):
        os.makedirs(os.path.join(root, "s"), exist_ok=True)
        for i, text in enumerate(parts):
            with open(os.path.join(root, "s", f"{side}-{i}.csv"), "w") as f:
                f.write(text)
    got = FS.scan_split_csv_pairs(spark, root, "q-*.csv", "a-*.csv").collect()
    assert sorted((r.pos, r.question, r.correct_answer) for r in got) == [(0, "Q0", "a"), (1, "Q1", "b"), (3, "Q3", "d")]


ODD = ['plain', 'a "quoted" one', 'two\nlines', 'three\r\nlines\n\n', ', and "x",\n"y"', '', 'é{"}\\', '"', '""\n""', "}{][,:", "\\"]


def records(n=40):
    rng = random.Random(9)
    return [{"question": f"{i} {rng.choice(ODD)} {rng.choice(ODD)}", "subject": rng.choice(ODD) or None, "correct_answer": rng.choice(ODD[1:5]),
             "llm_answer": "x", "is_correct": i % 2 == 0, "confidence": None if i % 5 == 0 else i, "response_time": i / 4,
             "reasoning_text": rng.choice(ODD), "reasoning_metrics": {"reasoning_length": i, "steps_count": 1, "uncertainty_markers": 0},
             "distractor_set": "o", "distractor_type": "o", "model": "m"} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 0, 2])
def test_json_envelope(spark, cut, indent):
    want, root = records(), folder()
    envelope = {"model_info": {"name": "m", "deep": {"a": [{"question": "no"}], "b": "}"}}, "n": 3, "list": [{"question": "other"}, {}],
                "detailed_results": want, "empty": [], "after": [{"question": "after"}], "last": {"x": 1}}
    for name, e in (("a.json", envelope), ("b.json", {"detailed_results": want[:3]}), ("c.json", {"detailed_results": []}),
                    ("d.json", {"other": [{"question": "no"}]})):
        with open(os.path.join(root, name), "w", encoding="utf-8") as f:
            json.dump(e, f, indent=indent, ensure_ascii=name == "a.json")
    df = FS.load_results(spark, json_path=root)
    got = [{**r.asDict(recursive=True)} for r in df.collect()]
    key = lambda r: json.dumps(r, sort_keys=True)
    assert sorted(map(key, got)) == sorted(map(key, want + want[:3]))


def test_results_csv(spark, cut):
    want, root = records(), folder()
    names = [f.name for f in FS.FLAT_RESPONSES.fields]
    for part, (rows, order) in enumerate(((want[:25], names), (want[25:], names[::-1]))):
        with open(os.path.join(root, f"r{part}.csv"), "w", newline="", encoding="utf-8") as f:
            w = csv.DictWriter(f, order, extrasaction="ignore", lineterminator="\n")
            w.writeheader()
            w.writerows(rows)
    got = [r.asDict() for r in FS.load_results(spark, csv_path=root).collect()]
    key = lambda r: json.dumps({n: r[n] or None if isinstance(r[n], str) else r[n] for n in names}, sort_keys=True)
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_empty_files(spark, cut):
    root = folder()
    for name in ("x.csv", "y.json"):
        open(os.path.join(root, name), "w").close()
    assert FS.load_results(spark, csv_path=os.path.join(root, "x.csv")).collect() == []
    assert FS.load_results(spark, json_path=os.path.join(root, "y.json")).collect() == []
    assert splits.numbered_lines(spark, root, F.lit("s")).collect() == []


def test_json_envelope_after_a_string_with_a_brace(spark, cut):
    root = folder()
    for name, text in (("a.json", '{"note": "a}b{\\"}", "detailed_results": [{"question": "1"}, {"question": "{2}"}], "o": [{"question": "no"}]}'),
                       ("b.json", '{"o": [{"question": "no"}], "detailed_results": [' + ",".join('{"question": "%s}"}' % ("x" * 300)
                                                                                           for _ in range(30)) + "]}\n"),
                       ("c.json", '{"n": 1}\n{"detailed_results": [{"question": "4"}]}\n')):
        with open(os.path.join(root, name), "w") as f:
            f.write(text)
    got = [r.question for r in FS.load_results(spark, json_path=root).select("question").collect()]
    assert sorted(got) == sorted(["1", "{2}", *["x" * 300 + "}"] * 30, "4"])


def scans(df):
    """Text scans of a plan; what is read from written tables is not counted."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [value")


def test_files_are_not_scanned_again_for_each_sum(spark):
    root = folder()
    with open(os.path.join(root, "a.json"), "w") as f:
        json.dump({"detailed_results": records(5)}, f)
    with open(os.path.join(root, "b.csv"), "w") as f:
        f.write('question,model\n"a\nb",m\n')
    assert scans(splits.pieces(spark, root)) == 1
    assert scans(FS.load_results(spark, json_path=os.path.join(root, "a.json"))) <= 1
    assert scans(FS.load_results(spark, csv_path=os.path.join(root, "b.csv"))) <= 1


def test_csv_fields_of_a_line_are_made_once(spark):
    root = folder()
    spark.createDataFrame([(0, 'q,"a ""b""",c,d,e', "1")], "pos int, line string, answer_line string").write.parquet(f"{root}/lines")
    df = FS.parse_csv_line(spark.read.parquet(f"{root}/lines"))
    assert [(r.question, r.options, r.correct_answer) for r in df.collect()] == [("q", ['a "b"', "c", "d", "e"], "c")]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_split_walks_meet_at_any_cut():
    rng = random.Random(3)
    text = json.dumps({"s": 'a}b"{', "detailed_results": records(12), "o": [{"x": {"y": "}"}}]})
    cells = text.split("}")
    whole = [(first, key, text) for first, _, _, key, text in splits._json_walk(cells, 0, 0)]
    assert [json.loads(t + "}") for _, key, t in whole if key == "detailed_results"] == records(12)
    for _ in range(20):
        at, inside, depth, parts = sorted(rng.sample(range(1, len(cells)), 3)), 0, 0, []
        for low, high in zip([0, *at], [*at, len(cells)], strict=True):
            parts += [(low + first, begun, t) for first, begun, _, _, t in splits._json_walk(cells[low:high], inside, depth)]
            plain = [c for c in splits._ESCAPED.sub("", "}".join([*cells[low:high], ""])).split('"')]
            out = "".join(plain[inside::2])
            inside, depth = (inside + len(plain) - 1) % 2, depth + out.count("{") - out.count("}")
        joined = []
        for first, begun, t in parts:
            joined = [*joined, (first, t)] if begun else [*joined[:-1], (joined[-1][0], joined[-1][1] + "}" + t)]
        assert joined == [(first, t) for first, _, t in whole]


@pytest.mark.parametrize("texts", [[], ["one. two. three. four. five"], ["one. two. three. four. five"] * 2 + [None]])
def test_split_pairs_query_without_answers(spark, texts):
    from optiq.plans.catalog import QUERIES
    root = folder()
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    got = [(r.subject, r.pos, r.question, r.correct_answer) for r in QUERIES["scan_split_csv_pair"](spark, root).collect()]
    assert got == ([("s", 0, "doc0/0", "one")] if len(texts) == 3 else [])
