"""Document fingerprints by one-permutation MinHash.

The word shingles of a text (five words, ``shingles.py``) are hashed once. The
high bits of a hash name one of ``bins`` bins and the rest is its value; a bin
keeps its smallest value. Empty bins borrow by optimal densification: bin i
tries the bins ``h(i, 1), h(i, 2), ...`` of a fixed hash until one is filled,
the same for every text. Of each bin the low ``bits`` bits are packed into the
fingerprint (hexadecimal). Two bins of different shingles agree by chance once
in ``2**bits``, so the share m of equal bins estimates the Jaccard similarity
as ``(m - 2**-bits) / (1 - 2**-bits)``, cut to 0..1.

Equal sets have equal fingerprints. A text without words has the fingerprint
of no bins, an empty string; its likeness to another empty one is 1, to any
other 0. Likeness is computed by column expressions or, in tasks, in numpy.

``with_next`` puts the next document (ascending id) beside each one: ids are
split into ranges of about equal counts, the first document of a range is given
to the range before as well, and ``lead`` runs inside ranges. Texts are
shuffled once; only the range bounds and the first ids, one per range, reach
the driver.

Null texts are empty. Rows of equal ids are ordered by text; null ids come
last. A single row is its own next document. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from optiq.llm.shingles import Shingler, mix64, slices
from optiq.sources.tables import table

BINS, BITS, WIDTH = 256, 4, 5


class Fingerprinter:
    def __init__(self, bins: int = BINS, bits: int = BITS, width: int = WIDTH):
        if bins & (bins - 1) or bits not in (1, 2, 4, 8):
            raise ValueError("bins must be a power of two, bits 1, 2, 4 or 8")
        self.bins, self.bits = bins, bits
        self.shingler = Shingler(width)
        self.shift = np.uint64(64 - bins.bit_length() + 1)
        # tries[j, i]: the bin that an empty bin i asks in try j
        place = np.arange(bins, dtype=np.uint64)[None, :]
        attempt = np.arange(1, 8 * bins + 1, dtype=np.uint64)[:, None]
        self.tries = (mix64(place * np.uint64(0x9E3779B97F4A7C15) + attempt * np.uint64(0xD1B54A32D192ED03))
                      >> self.shift).astype(np.int64)

    def _densify(self, low: np.ndarray, filled: np.ndarray) -> None:
        empty = np.flatnonzero(~filled)
        source = empty.copy()
        for tried in self.tries:
            open_ = ~filled[source]
            if not open_.any():
                break
            source[open_] = tried[empty[open_]]
        else:  # practically never: the smallest filled bin
            source[~filled[source]] = np.flatnonzero(filled)[0]
        low[empty] = low[source]

    def low_bits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(low bits of each bin by text, whether the text has any shingle)."""
        hashes, offsets = self.shingler.shingles(texts)
        n = len(texts)
        owner = np.repeat(np.arange(n), np.diff(offsets))
        best = np.full(n * self.bins, np.iinfo(np.uint64).max, dtype=np.uint64)
        cell = owner * self.bins + (hashes >> self.shift).astype(np.int64)
        np.minimum.at(best, cell, hashes)
        filled = np.zeros(n * self.bins, dtype=bool)
        filled[cell] = True
        low = (best & np.uint64((1 << self.bits) - 1)).astype(np.uint8).reshape(n, self.bins)
        filled = filled.reshape(n, self.bins)
        some = filled.any(axis=1)
        for i in np.flatnonzero(some & ~filled.all(axis=1)):
            self._densify(low[i], filled[i])
        return low, some

    def packed(self, low: np.ndarray, some: np.ndarray) -> list[str]:
        wide = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - self.bits:]
        rows = np.packbits(wide.reshape(len(low), -1), axis=1)
        return [r.tobytes().hex() if s else "" for r, s in zip(rows, some, strict=True)]

    def likeness(self, a: np.ndarray, has_a: np.ndarray, b: np.ndarray, has_b: np.ndarray) -> np.ndarray:
        chance = 2.0 ** -self.bits
        est = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
        return np.where(has_a & has_b, est, np.where(has_a == has_b, 1.0, 0.0))


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", bins: int = BINS,
                bits: int = BITS, width: int = WIDTH) -> DataFrame:
    """``docs`` with the packed fingerprint of column ``text`` (hexadecimal)."""
    def run(texts: pa.Array) -> pa.Array:
        maker, out_ = Fingerprinter(bins, bits, width), []
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
        for a, b in slices(raw):
            out_ += maker.packed(*maker.low_bits(raw[a:b]))
        return pa.array(out_, type=pa.string())

    return docs.withColumn(out, F.arrow_udf(run, "string").asNondeterministic()(F.col(text)))


def likeness(a: str, b: str, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity of two fingerprint columns of equal make."""
    per = {1: 8, 2: 4, 4: 2, 8: 1}[bits]
    mask = (1 << bits) - 1
    byte = lambda c: F.transform(F.split(F.regexp_replace(c, "(..)", "$1 "), " "),
                                 lambda h: F.conv(h, 16, 10).cast("int"))
    same = F.aggregate(F.zip_with(byte(a), byte(b), lambda x, y: sum(
        (F.when(F.shiftright(x.bitwiseXOR(y), i * bits).bitwiseAND(mask) == 0, 1).otherwise(0)
         for i in range(per)), F.lit(0))), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    m = same / (F.length(a) / 2 * per)
    chance = 2.0 ** -bits
    est = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (m - chance) / (1 - chance)))
    return (F.when((F.length(a) > 0) & (F.length(b) > 0), est)
            .when(F.length(a) == F.length(b), 1.0).otherwise(0.0))


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, text and next_text, the text of the next document by id."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)],
                                          1 / (4 * ranges))))
    # number of cuts below the id, by halving; null ids in the last range
    bucket = F.coalesce(_cuts_below(F.col("doc_id"), cuts), F.lit(len(cuts) + 1))
    placed = docs.withColumn("bucket", bucket)
    firsts = placed.groupBy("bucket").agg(F.min("doc_id").alias("first")).orderBy("bucket").collect()
    if not firsts:
        return docs.withColumn("next_text", F.lit(""))
    before = {firsts[i].bucket: firsts[i - 1].bucket for i in range(len(firsts))}
    starts = spark.createDataFrame(
        [(r.bucket, r.first, before[r.bucket]) for r in firsts], "sb int, sf long, sp int")
    order = [F.asc_nulls_last("doc_id"), "text"]
    # the first row of each range: of rows with its first id, the one of least text
    lead_rows = (placed.join(F.broadcast(starts), (F.col("bucket") == F.col("sb"))
                             & F.col("doc_id").eqNullSafe(F.col("sf")))
                 .withColumn("r", F.row_number().over(W.partitionBy("bucket").orderBy("text")))
                 .where("r = 1").select("doc_id", "text", F.col("sp").alias("bucket"), F.lit(True).alias("lent")))
    both = placed.select("doc_id", "text", "bucket", F.lit(False).alias("lent")).unionByName(lead_rows)
    inside = W.partitionBy("bucket").orderBy("lent", *order)
    return (both.withColumn("next_text", F.lead("text").over(inside)).where("NOT lent")
            .select("doc_id", "text", "next_text"))


def _cuts_below(value: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts are at most ``value``."""
    if not cuts:
        return F.when(value.isNotNull(), F.lit(0))
    at = F.array(*[F.lit(c) for c in cuts])
    return F.when(value.isNotNull(), F.size(F.filter(at, lambda c: c <= value)))


def edited(text: str, after: str) -> str:
    """``text`` whose last half is replaced by as many characters of ``after``."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                 ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                 ("near_edited", pa.float64()), ("near_next", pa.float64())])


def compare_edits(pairs: DataFrame, bins: int = BINS, bits: int = BITS, width: int = WIDTH) -> DataFrame:
    """The fingerprints of texts, of their edited texts, and their likeness to
    these and to the next documents, from ``with_next``."""
    def run(batches):
        maker = Fingerprinter(bins, bits, width)

        def encoded(texts):
            return [t.encode("utf-8", "surrogatepass") for t in texts]

        for batch in batches:
            ids, texts, nexts = (c.to_pylist() for c in batch.columns)
            for a, b in slices(texts):
                own, after = texts[a:b], nexts[a:b]
                changed = encoded(map(edited, own, after))
                x, has_x = maker.low_bits(encoded(own))
                y, has_y = maker.low_bits(changed)
                z, has_z = maker.low_bits(encoded(after))
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[a:b], pa.int64()), pa.array(map(len, own), pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in changed]),
                    pa.array(maker.packed(x, has_x)), pa.array(maker.packed(y, has_y)),
                    pa.array(maker.likeness(x, has_x, y, has_y)),
                    pa.array(maker.likeness(x, has_x, z, has_z))], schema=OUT)

    return pairs.select(F.col("doc_id").cast("long"), "text", "next_text").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(with_next(table(spark, sf_dir, "documents")))
