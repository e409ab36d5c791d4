"""Every operator on nulls, empty and long texts, ties, repeats, empty tables
and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from optiq.llm import (bpe, chat, fingerprints, language, mixing, near_dedup, quality,
                       substring_dedup, token_counts, warc)
from optiq.session import scratch_path

LONG = "word another " * 30_000 + "x" * 50_000
ROWS = [(1, "the cat sat on the mat and the dog ran", "en", "a", 38), (2, None, "en", "a", None),
        (3, "", "en", None, 0), (4, " \n\t ", None, "b", 4), (5, LONG, None, None, len(LONG)),
        (6, "12 34", "fr", "b", 5), (7, "the cat sat on the mat and the dog ran", "en", "a", 38),
        (7, "the cat sat on the mat and the dog ran", "en", "a", 38), (None, "der Hund und die Katze", "de", "b", 22),
        (None, None, None, None, None), (8, "Ünï ☃ 😀", "de", "c", 7)]
EXTRA = ["row", "id", "gone", "size", "copies", "target", "found", "score", "lang_pred", "spans", "of",
         "cut", "digest", "at", "d", "s", "z", "copy", "ids", "decoded", "n_tokens", "component_id",
         "kept", "bucket", "lent", "g", "n", "key", "rep", "node", "words", "lines", "windows"]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return plain.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where(F.lit(False))


def test_bpe(spark, docs, empty):
    codec = bpe.Codec(spark)
    out = bpe.decode(bpe.encode(docs, codec), codec).select("text", "ids", "decoded").collect()
    assert len(out) == len(ROWS)
    for r in out:
        assert (r.ids is None) == (r.text is None)
        assert r.text is None or bytes(r.decoded).decode() == r.text
    assert bpe.token_digests(empty, codec).collect() == []
    assert bpe.token_digests(docs, codec).where("n_tokens IS NULL").count() == 0


def test_token_counts(spark, docs, empty):
    counter = token_counts.Counter(spark)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, counter).collect() if r.doc_id}
    assert got[2] == got[3] == 0 and got[5] > 60_000
    assert token_counts.count_tokens(empty, counter).collect() == []


def test_near_dedup(docs, empty):
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[7].component_id == 1 and not by[7].kept and by[1].kept
    assert [by[i].n_shingles for i in (2, 3, 4)] == [0, 0, 0] and by[6].n_shingles == 1
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert near_dedup.near_duplicates(empty).collect() == []
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 2


def test_language(docs, empty, spark):
    model = language.learn(docs)
    found = language.identify(docs, model)
    by = {r.doc_id: r for r in found.collect() if r.doc_id}
    assert [by[i].lang_pred for i in (2, 3, 4, 6)] == ["und"] * 4 and by[2].score == 0
    assert by[1].lang_pred in model.languages and set(found.columns) == set(docs.columns)
    kept = language.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id IN (2, 3, 4, 6)").count() == 0
    none = language.learn(empty)
    assert none.languages == [] and language.identify(empty, none).collect() == []
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}


def test_substring(docs, empty):
    assert substring_dedup.repeated_passages(empty).collect() == []
    out = substring_dedup.cut_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text == ROWS[0][1] and rows[2].text is None and rows[2].n_chars is None
    assert len(rows[5].text) < len(LONG) and rows[5].n_chars == len(rows[5].text)
    assert rows[5].text.startswith("word another") and rows[5].text.endswith("x" * 50_000)


def test_mixing(docs, empty):
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    slim = docs.select("doc_id", "source", mixing.size_of(F.col("text")).alias("size"))
    got = mixing.allot(slim).collect()
    assert len(got) == len(ROWS) and all(0 <= r.copies <= 2 for r in got)
    assert all(r.copies == 0 for r in got if r["size"] == 0)
    assert mixing.allot(slim.where(F.lit(False))).collect() == [] and mixing.mix(empty).collect() == []


def test_fingerprints(docs, empty):
    pairs = fingerprints.with_next(docs)
    got = fingerprints.compare_edits(pairs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[7].fingerprint and by[2].fingerprint == "" and by[2].near_next == 1.0
    assert fingerprints.compare_edits(fingerprints.with_next(empty)).collect() == []
    one = fingerprints.with_next(docs.where("doc_id = 1")).collect()
    assert [r.next_text for r in one] == [ROWS[0][1]]
    assert "fingerprint" in fingerprints.fingerprint(docs).columns


def test_quality(docs, empty):
    got = quality.judge(quality.statistics(docs, ["doc_id", "lang", "source"])).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[2].n_words == 0 and by[2].base_failed and not by[2].kept
    assert by[5].n_repeat_words >= 60_000 and by[5].base_failed
    assert quality.judge(quality.statistics(empty, ["doc_id", "lang", "source"])).collect() == []


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", None), (1, 2, None, "<|im_end|> <~|x"),
            (1, 2, "assistant", "same"), (1, 2, "assistant", "same"), (1, None, "user", "first"),
            (None, 0, "a\nb%0A", "x"), (2, 0, "assistant", "w " * 3000), (2, 1, "assistant", "")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string") \
        .withColumn("window", F.lit(1)).withColumn("pos", F.lit(1))
    made = chat.windows(conv)
    turns = made.select("conv_id", "window", F.explode(chat.new_turns(
        F.col("formatted"), F.col("n_repeated"))).alias("t")).select("conv_id", "t.*").collect()
    assert sorted((r.conv_id or 0, r.role, r.text) for r in turns) == sorted(
        (c or 0, r or "", t or "") for c, _, r, t in rows)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    assert got[1].loss_chars == 8 and got[1].n_turns == 6 and got[2].loss_chars == 6000
    assert got[None].n_turns == 1
    assert chat.digests(chat.windows(conv.where(F.lit(False)))).collect() == []


def test_warc(spark):
    same = "<p>" + "é" * 60_000
    rows = [(1, "http://a/ b\r\n", same), (2, None, None), (3, "u", ""), (4, "u", same), (4, "u", same),
            (None, "u", same), (5, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\nabc"), (6, "v", "x" * 99), (7, "v", "x" * 99)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    path = scratch_path(spark, "warc-test")
    warc.write(pages, path, segment_bytes=1000, chunk_bytes=77)
    got = warc.resolved(warc.reassemble(warc.read_records(spark, path))).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in got) == sorted([
        (1, 120_003, "response", None), (2, 0, "response", None), (3, 0, "response", None),
        (4, 120_003, "revisit", 1), (4, 120_003, "revisit", 1), (0, 120_003, "revisit", 1),
        (5, 36, "response", None), (6, 99, "response", None), (7, 99, "response", None)])
    none = scratch_path(spark, "warc-none")
    warc.write(pages.where(F.lit(False)), none)
    assert warc.resolved(warc.reassemble(warc.read_records(spark, none))).collect() == []


def test_stages(spark, docs, empty):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for start in (docs, empty):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            path = scratch_path(spark, name)
            before, now = now, stage(spark, now, "")
            now.write.parquet(path)
            now = spark.read.parquet(path)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert now.columns == before.columns and set(names) <= set(now.columns)
        assert now.where("NOT round_trip").count() == 0
