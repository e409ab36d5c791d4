"""Each stage of the pipeline on all that its predecessor kept, against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from optiq.llm import bpe, language, mixing, vocab
from optiq.session import scratch_path
from test_llm_exact import linked_groups, shingle_set, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """name -> rows after the stage, starting with the documents."""
    now = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10 ** 6, "12 34 !", "en", "src0", 7), (10 ** 6 + 1, None, None, None, None)], now.schema)
    now = now.unionByName(extra)
    out = {"documents": now}
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, name)
        stage(spark, now, SF).write.parquet(path)
        out[name] = now = spark.read.parquet(path)
    return out


def test_columns(steps):
    names = list(steps)
    assert names[1:] == ["language_id", "near_dedup", "substring_dedup", "mixing", "byte_bpe"]
    assert all(steps[n].columns == steps["documents"].columns for n in names[:-1])


def test_language_stage(steps):
    model = language.learn(steps["documents"])
    parser = language.Parser(model.samples.value)
    rows = steps["documents"].collect()
    found = parser.predict([r.text for r in rows])
    want = {r.doc_id for r, (lang, _) in zip(rows, found, strict=True) if lang != "und"}
    kept = {r.doc_id for r in steps["language_id"].collect()}
    assert kept == want and not kept & {10 ** 6, 10 ** 6 + 1} and len(kept) > 0.95 * len(rows)


def test_near_dedup_stage(steps):
    low = linked_groups({r.doc_id: shingle_set(r.text) for r in steps["language_id"].collect()})
    assert sorted(r.doc_id for r in steps["near_dedup"].collect()) == sorted(set(low.values()))


def test_substring_stage(steps):
    before = {r.doc_id: r for r in steps["near_dedup"].collect()}
    after = {r.doc_id: r for r in steps["substring_dedup"].collect()}
    assert before.keys() == after.keys()
    eights = Counter(g for r in before.values() for g in {tuple(words(r.text)[i:i + 8]) for i in range(len(words(r.text)) - 7)})
    for i, r in before.items():
        w, left = words(r.text), words(after[i].text)
        assert after[i].n_chars == len(after[i].text) or r.text == after[i].text
        if w == left:
            continue
        # what went is repeated text: eight words in a row that another text or place has too
        gone = len(w) - len(left)
        repeated = np.zeros(len(w), dtype=bool)
        for k in range(len(w) - 7):
            if eights[tuple(w[k:k + 8])] > 1 or tuple(w[k:k + 8]) in {tuple(w[j:j + 8]) for j in range(k)}:
                repeated[k:k + 8] = True
        assert 20 <= gone <= repeated.sum()


def test_mixing_stage(steps):
    before = steps["substring_dedup"]
    slim = before.select("doc_id", "source", mixing.size_of(F.col("text")).alias("size"))
    want = {r.doc_id: r.copies for r in mixing.allot(slim).collect() if r.copies}
    assert Counter(r.doc_id for r in steps["mixing"].collect()) == want
    sizes = {r.doc_id: len(words(r.text)) for r in before.collect()}
    total = sum(sizes.values())
    assert abs(sum(sizes[d] * c for d, c in want.items()) - 1.5 * total) < 0.02 * total


def test_bpe_stage(steps):
    token = {i: t for t, i in vocab.rank_table(vocab.read_bytes(vocab.default_path(bpe.RANK_FILE))).items()}
    texts = Counter((r.doc_id, r.text) for r in steps["mixing"].collect())
    rows = steps["byte_bpe"].collect()
    decoded = Counter((r.doc_id, b"".join(token[i] for i in np.frombuffer(r.ids, "<u4").tolist()).decode()) for r in rows)
    assert decoded == texts and all(r.round_trip and 4 * r.n_tokens == len(r.ids) for r in rows)


def test_registered(spark, steps):
    assert E.queries()["pipeline"] is corpus_pipeline.run
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r.round_trip for r in rows)
