"""Token counts by a whole-token shortcut.

Offline, on the driver, every vocabulary string of a byte-level BPE file is
encoded alone by the library; those that the pre-tokenizer keeps in one piece
and that come back as exactly their own id are proven *whole tokens*. A text is
then cut into pre-tokens; pre-tokens that are whole tokens count one each with
no merging, and only the rest go through the library's merges.

Why this equals the library's count: merges never cross pre-tokens, so a
text's count is the sum over its pre-tokens, and a pre-token that is a proven
string gives one token wherever it stands. Added tokens (such as
``<|endoftext|>``) are matched first in the text, as the library does by
default, and count one each.

Pre-tokens beyond U+024F may be classed differently by different versions of
the Unicode tables, so pieces with such characters are counted by the library
itself.

Rows are independent (no shuffle). Null texts count as empty: 0 bytes and 0
tokens. Input columns other than the key and the text are not needed and not
read.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from optiq.llm import vocab
from optiq.sources.tables import table

TOKENIZER_FILE = "byte_bpe_50k.json"

# Letters and numbers up to U+024F, fixed by Unicode.
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
#: The byte-level pre-tokenizer's pattern over those characters.
PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
#: Beyond U+024F, and control characters that not every engine calls white space.
ELSEWHERE = re.compile("[ɐ-\U0010ffff\x1c-\x1f\x85]")


def _check(spec: dict) -> None:
    pre = spec.get("pre_tokenizer") or {}
    plain = (spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel"
             and pre.get("use_regex", True) and not pre.get("add_prefix_space")
             and not spec.get("normalizer") and not spec["model"].get("dropout"))
    if not plain:
        raise ValueError("the whole-token shortcut needs a byte-level BPE file without "
                         "normalizer, prefix space or dropout")


def whole_tokens(data: bytes) -> frozenset[str]:
    """The vocabulary strings proven to be one pre-token and one token alone."""
    from tokenizers import Tokenizer
    spec = json.loads(data)
    _check(spec)
    tok = Tokenizer.from_str(data.decode("utf-8"))
    added = {a["content"] for a in spec.get("added_tokens", ())}
    ids = sorted(i for s, i in tok.get_vocab(with_added_tokens=False).items() if s not in added)
    strings = tok.decode_batch([[i] for i in ids], skip_special_tokens=False)
    alone = tok.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for i, s, e in zip(ids, strings, alone, strict=True)
                     if e.ids == [i] and not ELSEWHERE.search(s) and PRE_TOKEN.fullmatch(s)
                     and PRE_TOKEN.findall(s) == [s])


class Counter:
    """The tokenizer file and its proven strings, as a broadcast."""

    def __init__(self, spark: SparkSession, tokenizer_file: str | None = None):
        data = vocab.read_bytes(tokenizer_file or vocab.default_path(TOKENIZER_FILE))
        self.payload = spark.sparkContext.broadcast((data, whole_tokens(data)))
        self.key = vocab.digest(data)


def _counter(payload, key):
    """A function text -> number of tokens, built once per worker."""
    cache = vocab.worker_cache("token_counter")
    if key not in cache:
        from tokenizers import Tokenizer
        data, whole = payload.value
        spec = json.loads(data)
        added = sorted((a["content"] for a in spec.get("added_tokens", ())), key=len, reverse=True)
        special = re.compile("|".join(map(re.escape, added))) if added else None
        tok = Tokenizer.from_str(data.decode("utf-8"))

        def merged(piece: str) -> int:
            return len(tok.encode(piece, add_special_tokens=False).ids)

        def piece_tokens(piece: str) -> int:
            if piece in whole:
                return 1
            if ELSEWHERE.search(piece):
                return merged(piece)
            return sum(1 if p in whole else merged(p) for p in PRE_TOKEN.findall(piece))

        memo = vocab.Memo(piece_tokens)

        def count(text: str) -> int:
            if special is None or not special.search(text):
                return sum(map(memo.__getitem__, vocab.units(text)))
            parts = special.split(text)
            return len(parts) - 1 + sum(sum(map(memo.__getitem__, vocab.units(p)))
                                        for p in parts if p)

        cache[key] = count
    return cache[key]


def n_tokens(counter: Counter, text: Column) -> Column:
    """Number of tokens of each text; null texts stay null."""
    payload, key = counter.payload, counter.key

    def run(texts: pa.Array) -> pa.Array:
        count = _counter(payload, key)
        return pa.array((None if t is None else count(t)
                         for t in (x.as_py() for x in texts)), type=pa.int64())

    return F.arrow_udf(run, "long")(text)


def count_tokens(df: DataFrame, counter: Counter, text: str = "text",
                 out: str = "n_tokens") -> DataFrame:
    """``df`` with the token count of column ``text`` in ``out`` (null: 0)."""
    return df.withColumn(out, F.coalesce(n_tokens(counter, F.col(text)), F.lit(0)).cast("long"))


def op6_token_counts(spark: SparkSession, sf_dir: str, limit: int = 512) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    counted = count_tokens(docs, Counter(spark))
    return counted.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
                          "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
