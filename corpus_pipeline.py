"""From raw documents to token ids, in five stages.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame. ``run`` writes each stage's result as Parquet into the
shared folder and reads it back as the next one's input, so a lost executor
never reaches back over a stage. All stages but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from optiq.llm import bpe, language, mixing, near_dedup, substring_dedup
from optiq.session import scratch_path
from optiq.sources.tables import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; others (no letters, no text) go."""
    return language.keep_known(docs, language.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of smallest id."""
    return near_dedup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document before them has."""
    return substring_dedup.cut_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, packed ids, n_tokens, and whether decoding gives the text back."""
    codec = bpe.Codec(spark)
    texts = docs.select("doc_id", "source", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    both = bpe.round_trip(texts.withColumn("sha", F.sha2("text", 256)), codec, ["doc_id", "source", "sha"])
    return both.select("doc_id", "source", "ids", bpe.n_ids(F.col("ids")).alias("n_tokens"),
                       (F.sha2("decoded", 256) == F.col("sha")).alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing", mixture),
    ("byte_bpe", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Cross-parsing, chunk boundaries and merges have no SQL form; the stages are
#: tested against brute-force versions in tests/llm.
ORACLE_SQL = None
