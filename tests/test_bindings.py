"""Bindings: the lambda-free document split equals split / strip / drop-empty."""

import re

from pyspark.sql import functions as F

from optiq.plans import bindings as B

TEXTS = [
    "One. Two.\nThree",
    "  lead. \n\n trail.  ",
    "x.  . y",
    "a . b\t.\tc",
    "no separators here",
    "",
    ". \n. ",
    "dots...and. more",
    "tab\t\n\tline",
    "trail.  ",
    ". ",
    "a.\t b",
    "a .\nb",
    "a\r\nb",
    "a. \t. b",
    "  lead. \n\n trail.  ",
]


def py_pieces(t):
    return [p.strip(" \t\r\n") for p in re.split(r"\. |\n", t) if p.strip(" \t\r\n") != ""]


def test_doc_pieces_equal_plain_rule(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: list(r.p) for r in df.select("doc_id", B._doc_pieces(df).alias("p")).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == py_pieces(t), repr(t)


def test_conversation_pairs_are_consecutive(spark):
    pairs = B.conversation_pairs(spark, "/root/testdata/sf0.001")
    conv = B.table(spark, "/root/testdata/sf0.001", "conversations")
    expected = conv.groupBy("conv_id").agg((F.count("*") - 1).alias("n")).agg(F.sum("n")).first()[0]
    assert pairs.count() == expected
