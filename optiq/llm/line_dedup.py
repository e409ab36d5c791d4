"""Repeated lines by two Bloom filters, confirmed exactly.

A text is cut at line feeds. A line's key is the line without the white space
(space and the controls 9 to 13) at its ends, A-Z lower-cased; keys of fewer than
``min_chars`` code points are never dropped. A key that stands in at least
``min_docs`` documents loses all its lines but those in one document, the one of
largest (``keep="last"``) or smallest (``keep="first"``) ``doc_id``.

1. One pass over the texts writes a 128-bit digest of each document's distinct
   long keys (16 bytes a line) to the shared folder.
2. Two Bloom filters (``bloom.py``) go over the digests, one of what was seen once
   and one of what was seen twice.
3. Only digests that the twice-seen filter holds are shuffled. There they are
   counted by document, so the filters' false hits change nothing.
4. Documents that lose lines get the digests of these; the others stay as they are.

With more lines than the largest filter has bits none is made and all digests are
shuffled, 24 bytes a line; the result is the same.

Skew: a line in a third of all documents is counted by (digest, document) first
and then by digest, with partial sums in each task. Digests that hold more than one
in ``HOT_DIGESTS`` of the repeated lines are fewer than ``HOT_DIGESTS``, so their
verdicts are broadcast; the documents of the rarer ones meet theirs by a join.

Null and empty texts are one empty line. Rows that share a ``doc_id`` are one
document. Rows with a null ``doc_id`` keep all their lines and count as no
document. Ties cannot occur: documents differ in their ids. Other columns pass
through untouched, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from optiq.llm import bloom, vocab
from optiq.session import cut_lineage
from optiq.sources.tables import table

MIN_CHARS, MIN_DOCS = 40, 5
#: Bytes of text cut at once.
SLICE_BYTES = 1 << 20
#: Digests that hold over one in so many repeated lines are broadcast: fewer than this number.
HOT_DIGESTS = 10_000

DIGESTS = pa.schema([("doc_id", pa.int64()), ("digests", pa.binary())])
SUSPECT = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("doc_id", pa.int64())])


def keys_of(lines: pa.Array) -> pa.Array:
    """The key of each line."""
    return pc.ascii_lower(pc.ascii_trim_whitespace(lines))


def digest(key: str) -> bytes:
    return hashlib.blake2b(key.encode(), digest_size=16).digest()


def _ranges(texts: pa.Array):
    """(first row, end row) of about ``SLICE_BYTES`` of texts; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = size = 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > SLICE_BYTES:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(sizes):
        yield at, len(sizes)


def line_digests(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id and the packed digests of the distinct long keys of each row that has any."""
    def run(batches):
        vocab.worker_cache("lines")
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in _ranges(texts):
                cut = pc.split_pattern(texts.slice(a, b - a), "\n")
                keys, row = keys_of(pc.list_flatten(cut)), pc.list_parent_indices(cut)
                long = pc.greater_equal(pc.utf8_length(keys), min_chars)
                keys, row = keys.filter(long).to_pylist(), row.filter(long).to_numpy(zero_copy_only=False)
                if not keys:
                    continue
                rows, first = np.unique(row, return_index=True)
                ends = [*first[1:].tolist(), len(keys)]
                packed = [b"".join({digest(k): None for k in keys[x:y]})
                          for x, y in zip(first.tolist(), ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a).take(pa.array(rows)), pa.array(packed, pa.binary())], schema=DIGESTS)

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return known.where(f"doc_id IS NOT NULL AND octet_length(text) >= {min_chars}").mapInArrow(
        run, "doc_id long, digests binary")


def suspects(digests: DataFrame, seen: Broadcast[bytes] | None) -> DataFrame:
    """(d1, d2, doc_id) of the digests that ``seen`` holds (None: of all)."""
    def run(batches):
        for batch in batches:
            both = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u8").reshape(-1, 2)
            count = pc.divide(pc.binary_length(batch.column(1)), 16).to_numpy(zero_copy_only=False)
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), count)
            if seen is not None:
                hit = bloom.holds(seen.value, both[:, 0])
                both, ids = both[hit], ids[hit]
            half = np.ascontiguousarray(both.T).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(half[0]), pa.array(half[1]), pa.array(ids)], schema=SUSPECT)

    return digests.mapInArrow(run, "d1 long, d2 long, doc_id long")


def dropped_digests(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                    keep: str = "last") -> DataFrame:
    """``of`` (a doc_id) and ``gone``, the digests of the keys whose lines it loses."""
    digests = cut_lineage(line_digests(docs, min_chars))
    n_lines = digests.agg(F.sum(F.octet_length("digests"))).first()[0] or 0
    bits = bloom.filter_bits(n_lines // 16)
    found = suspects(digests, bloom.seen_twice(digests, "digests", bits, 2) if bits else None)
    best = F.max if keep == "last" else F.min
    repeated = cut_lineage(
        found.groupBy("d1", "d2").agg(F.countDistinct("doc_id").alias("n"), best("doc_id").alias("stays"))
        .where(F.col("n") >= min_docs))
    total = repeated.agg(F.sum("n")).first()[0] or 0
    hot = repeated.where(F.col("n") * HOT_DIGESTS > total).select("d1", "d2", F.col("stays").alias("hot_stays"))
    split = found.join(F.broadcast(hot), ["d1", "d2"], "left")
    rare = repeated.where(F.col("n") * HOT_DIGESTS <= total).select("d1", "d2", "stays")
    held = (split.where("hot_stays IS NULL").drop("hot_stays").join(rare, ["d1", "d2"])
            .union(split.where("hot_stays IS NOT NULL")))
    packed = F.struct("d1", "d2")
    return (held.where("doc_id <> stays").groupBy(F.col("doc_id").alias("of"))
            .agg(F.collect_set(packed).alias("gone")))


def without_lines(text: str, gone: set[bytes]) -> tuple[str, int]:
    """``text`` without the lines whose key's digest is in ``gone``, and their number."""
    lines = text.split("\n")
    keys = keys_of(pa.array(lines)).to_pylist()
    kept = [line for line, key in zip(lines, keys, strict=True) if digest(key) not in gone]
    return "\n".join(kept), len(lines) - len(kept)


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                        keep: str = "last") -> DataFrame:
    """``row`` (the columns of ``docs``, ``text`` without its repeated lines), ``n_lines``
    (before) and ``n_dropped``. A text that loses all lines becomes empty."""
    def run(texts: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for t, g in zip(texts, gone, strict=True):
            lost = g.as_py()
            if lost is None:
                out.append(None)
                continue
            lost = {np.array([x["d1"], x["d2"]], dtype="<i8").tobytes() for x in lost}
            out.append(dict(zip(("kept", "n"), without_lines(t.as_py() or "", lost), strict=True)))
        return pa.array(out, type=pa.struct([("kept", pa.string()), ("n", pa.int64())]))

    gone = dropped_digests(docs, min_chars, min_docs, keep)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    joined = rows.join(gone, F.col("id") == F.col("of"), "left")
    cut = F.arrow_udf(run, "kept string, n long").asNondeterministic()(
        F.when(F.col("gone").isNotNull(), F.col("row.text")), F.col("gone"))
    done = joined.select("row", cut.alias("cut"))
    text = F.coalesce(F.col("cut.kept"), F.col("row.text"))
    return done.select(
        F.col("row").withField("text", text).alias("row"),
        F.size(F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.col("cut.n"), F.lit(0)).cast("long").alias("n_dropped"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped",
        F.sha2(F.coalesce(F.col("row.text"), F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM rows),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (SELECT key, max(doc_id) AS stays FROM keyed WHERE length(key) >= 40 AND doc_id IS NOT NULL
             GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT k.*, coalesce(k.doc_id <> p.stays, false) AS gone FROM keyed k LEFT JOIN repeated p ON k.key = p.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r
"""
