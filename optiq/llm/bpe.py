"""Byte-level BPE encoding and decoding with a local rank file.

``encode`` cuts each text where the pre-tokenizing pattern always ends a token
(``vocab.units``) and lets the tiktoken library encode the pieces, so the
pattern never runs over one long text and repeated words are merged once per
worker. A run of ``LONG_SPACE`` white-space characters or more, on which the library's
pattern engine would overflow its stack, is cut by the pattern's own rule (all of it
at the end of a text, all but the last character elsewhere) and encoded as one piece. ``decode`` joins the raw bytes of the ids; a sequence of ids may end
inside a character, so its result is binary.

Rows are independent: no shuffle, one Arrow batch in memory at a time, and a
lost executor's splits are simply read and encoded again.

Null texts have null ids in the operators (the query takes them as empty);
empty texts have empty ids. Other columns pass through untouched; a column
that already has the output's name is replaced. Ids outside the vocabulary
raise an error in ``decode``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from optiq.llm import vocab
from optiq.sources.tables import table

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
SLICE = 1 << 19
LONG_SPACE = 4096
# White_Space of Unicode
SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_RUN = re.compile(f"[{SPACE}]{{{LONG_SPACE},}}")


def pieces(text: str) -> list[str]:
    """``vocab.units`` with long white-space runs as pieces of their own; joined they
    give the text again."""
    out, at = [], 0
    for run in SPACE_RUN.finditer(text) if len(text) >= LONG_SPACE else ():
        stop = run.end() - (run.end() < len(text))
        if run.start() > at:
            out += vocab.units(text[at:run.start()])
        out.append(text[run.start():stop])
        at = stop
    return out + vocab.units(text[at:]) if at < len(text) or not out else out


def default_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


class Codec:
    """The rank file and pattern, as a broadcast that tasks build a codec from."""

    def __init__(self, spark: SparkSession, rank_file: str | None = None,
                 pattern: str | None = None):
        data = vocab.read_bytes(rank_file or vocab.default_path(RANK_FILE))
        self.ranks: Broadcast[bytes] = spark.sparkContext.broadcast(data)
        self.pattern = pattern or default_pattern()
        self.key = (vocab.digest(data), self.pattern)


def _encoder(ranks, pattern: str, key) -> vocab.Memo:
    """piece -> its ids as little-endian unsigned 32-bit integers."""
    cache = vocab.worker_cache("bpe")
    if ("encoder", key) not in cache:
        import tiktoken
        enc = tiktoken.Encoding("ranks", pat_str=pattern, special_tokens={},
                                mergeable_ranks=vocab.rank_table(ranks.value))

        def encoded(piece: str) -> bytes:
            run = len(piece) >= LONG_SPACE - 1 and SPACE_RUN.fullmatch(piece + " ")
            ids = enc._encode_single_piece(piece) if run else enc.encode_ordinary(piece)
            return np.array(ids, dtype="<u4").tobytes()

        cache["encoder", key] = vocab.Memo(encoded)
    return cache["encoder", key]


def _decoder(ranks, key) -> dict[int, bytes]:
    cache = vocab.worker_cache("bpe")
    if ("decoder", key) not in cache:
        cache["decoder", key] = {i: tok for tok, i in vocab.rank_table(ranks.value).items()}
    return cache["decoder", key]


def encode_packed(codec: Codec, text: Column) -> Column:
    """Ids of each text as binary: little-endian unsigned 32-bit integers.

    Marked non-deterministic only so that the optimizer never evaluates it once
    more for each expression that uses the ids."""
    ranks, pattern, key = codec.ranks, codec.pattern, codec.key

    def run(texts: pa.Array) -> pa.Array:
        ids = _encoder(ranks, pattern, key).__getitem__
        return pa.array((None if t is None else b"".join(map(ids, pieces(t)))
                         for t in (x.as_py() for x in texts)), type=pa.binary())

    return F.arrow_udf(run, "binary").asNondeterministic()(text)


def decode_packed(codec: Codec, ids: Column) -> Column:
    """The raw bytes of packed ids."""
    ranks, key = codec.ranks, codec.key

    def run(packed: pa.Array) -> pa.Array:
        token = _decoder(ranks, key).__getitem__
        return pa.array((None if p is None else
                         b"".join(map(token, np.frombuffer(p, dtype="<u4").tolist()))
                         for p in (x.as_py() for x in packed)), type=pa.binary())

    return F.arrow_udf(run, "binary")(ids)


def n_ids(packed: Column) -> Column:
    return (F.octet_length(packed) / 4).cast("long")


def unpack(packed: Column) -> Column:
    """Packed ids as array<int>."""
    def run(values: pa.Array) -> pa.Array:
        return pa.array((None if v is None else np.frombuffer(v, dtype="<u4").astype("int32")
                         for v in (x.as_py() for x in values)), type=pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(packed)


def encode(df: DataFrame, codec: Codec, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the packed ids of column ``text`` in column ``out``."""
    return df.withColumn(out, encode_packed(codec, F.col(text)))


def decode(df: DataFrame, codec: Codec, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of packed ids in ``ids`` in column ``out``."""
    return df.withColumn(out, decode_packed(codec, F.col(ids)))


def round_trip(df: DataFrame, codec: Codec, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, ids and decoded for each text, encoded and decoded in one pass
    that holds about ``SLICE`` characters of texts at a time."""
    ranks, pattern, key = codec.ranks, codec.pattern, codec.key
    rows = df.select(F.struct(*keys).alias("row"), F.col(text).alias("text"))

    def run(batches):
        ids, token = _encoder(ranks, pattern, key).__getitem__, _decoder(ranks, key).__getitem__
        for batch in batches:
            row, texts = batch.column(0), batch.column(1)
            packed, decoded, size, at = [], [], 0, 0
            for i in range(len(texts)):
                t = texts[i].as_py()
                p = None if t is None else b"".join(map(ids, pieces(t)))
                packed.append(p)
                decoded.append(None if p is None else
                               b"".join(map(token, np.frombuffer(p, dtype="<u4").tolist())))
                size += len(t or "")
                if size >= SLICE or i + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays(
                        [row.slice(at, i + 1 - at), pa.array(packed, pa.binary()),
                         pa.array(decoded, pa.binary())], names=["row", "ids", "decoded"])
                    packed, decoded, size, at = [], [], 0, i + 1

    out = T.StructType([rows.schema["row"], T.StructField("ids", T.BinaryType()),
                        T.StructField("decoded", T.BinaryType())])
    return rows.mapInArrow(run, out).select("row.*", "ids", "decoded")


def token_digests(df: DataFrame, codec: Codec) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of documents (null text: empty)."""
    docs = df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    both = round_trip(docs, codec, ["doc_id"])
    return both.select("doc_id", n_ids(F.col("ids")).alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), Codec(spark))
