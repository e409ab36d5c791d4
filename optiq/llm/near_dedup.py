"""Near-duplicate documents by circulant MinHash.

A document's set holds its distinct word shingles (``shingles.py``: five
words, A-Z lower-cased). Two permutations of the 32-bit integers make all
coordinates of a signature: the first scatters the set, the second is shifted
by one place for each further coordinate, and the coordinate is the minimum::

    h_k(S) = min over x in S of second((first(x) + k) mod 2**32)

1. One pass over the texts gives the set's size, a 128-bit digest and a key
   for each band of ``rows`` coordinates. Documents of equal sets form a class
   and go on as one, so copies cost nothing more.
2. Classes that share a band key are a bucket. Each bucket compares all its
   classes with its smallest and its largest one: links in proportion to the
   bucket, never all pairs within it. Pairs are confirmed on the full sets.
3. Components of the confirmed links. A bucket that still spans several
   components may hide a link between two other classes, so the pairs across
   components are confirmed as well: row by row in buckets of few classes, in
   blocks of members (matrix products, of which only links that join components
   leave a block) in larger ones. Then the components are updated.

With 32 bands of 4 rows a pair of similarity 0.75 shares no key with
probability 0.684**32 = 5e-6, one of 0.8 with 5e-8; nothing is lost after that.

Skew: sets of classes met by many others are copied over salted keys in
proportion to their number of pairs; buckets are aggregated before they are
joined; equal sets are collapsed first.

Null or blank texts have an empty set and link with nothing. Rows with a null
``doc_id`` link with nothing, have a null component and are kept. Rows that
share a ``doc_id`` count as one document. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from optiq.llm.components import components
from optiq.llm.shingles import Shingler, mix64, text_slices
from optiq.session import cut_lineage
from optiq.sources.tables import table

BANDS, ROWS, WIDTH = 32, 4, 5
#: Pairs of one class that meet its set in one task.
PAIRS_A_SALT = 2000
#: Members of a bucket that are still paired row by row across components.
FEW = 16
#: Members of a block in larger buckets, and tokens in one product of matrices.
BLOCK, COLUMNS = 512, 8192
#: Repeated ids that are broadcast (8 bytes each); more of them are joined by a shuffle.
FEW_IDS = 100_000


def _first(x: np.ndarray) -> np.ndarray:
    """The scattering permutation, on the low halves of shingle hashes."""
    y = x.astype(np.uint32)
    y ^= y >> np.uint32(16)
    y *= np.uint32(0x85EBCA6B)
    y ^= y >> np.uint32(13)
    y *= np.uint32(0xC2B2AE35)
    y ^= y >> np.uint32(16)
    return y


def _second(y: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """The permutation that is shifted (in place; ``spare`` is work space)."""
    np.right_shift(y, np.uint32(16), out=spare)
    np.bitwise_xor(y, spare, out=y)
    np.multiply(y, np.uint32(0x7FEB352D), out=y)
    np.right_shift(y, np.uint32(15), out=spare)
    np.bitwise_xor(y, spare, out=y)
    np.multiply(y, np.uint32(0x846CA68B), out=y)
    np.right_shift(y, np.uint32(16), out=spare)
    np.bitwise_xor(y, spare, out=y)
    return y


def signatures(hashes: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """One row of k coordinates for each non-empty range of ``hashes``."""
    scattered = _first(hashes)
    out = np.empty((len(offsets) - 1, k), dtype=np.uint32)
    shifted, spare = np.empty_like(scattered), np.empty_like(scattered)
    for i in range(k):
        np.add(scattered, np.uint32(i), out=shifted)
        out[:, i] = np.minimum.reduceat(_second(shifted, spare), offsets[:-1])
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` coordinates, different between bands."""
    n, k = signature.shape
    parts = signature.reshape(n, k // rows, rows).astype(np.uint64)
    key = np.arange(k // rows, dtype=np.uint64)[None, :] + np.uint64(1)
    for j in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.view(np.int64)


SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set1", pa.int64()),
                    ("set2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _signed(batches, bands: int, rows: int, width: int):
    shingler = Shingler(width)
    for batch in batches:
        for a, b, texts in text_slices(batch.column(1)):
            sets = shingler.sets(texts)
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            keys = iter(())
            if len(full):
                offsets = np.concatenate(([0], np.cumsum(sizes[full])))
                keys = iter(band_keys(signatures(np.concatenate([sets[i] for i in full]), offsets,
                                                 bands * rows), rows))
            digests = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(),
                                     dtype=np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()),
                pa.array([d[0] for d in digests], pa.int64()),
                pa.array([d[1] for d in digests], pa.int64()),
                pa.array([next(keys) if n else [] for n in sizes], pa.list_(pa.int64()))],
                schema=SIGNED)


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, the set's digest (set1, set2) and its band keys."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(
        lambda it: _signed(it, bands, rows, width),
        "doc_id long, n_shingles long, set1 long, set2 long, bands array<long>")


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and its distinct shingles as 64-bit hashes."""
    schema = pa.schema([("doc_id", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches):
        shingler = Shingler(width)
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1)):
                sets = [s.view(np.int64) for s in shingler.sets(texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sets, pa.list_(pa.int64()))],
                    schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(
        run, "doc_id long, items array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    salts = (pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS_A_SALT).cast("int").alias("salts")))
    left = (pairs.join(salts, "b").withColumn("salt", F.pmod(F.xxhash64("a"), "salts").cast("int"))
            .join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("items_a")), "a")
            .select("a", "b", "salt", "items_a"))
    right = (sets.select(F.col("doc_id").alias("b"), F.col("items").alias("items_b"))
             .join(salts, "b").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
             .drop("salts"))
    common = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - F.col("common")
    return (left.join(right, ["b", "salt"]).withColumn("common", common)
            .where(100 * F.col("common") >= percent * union).select("a", "b"))


def _block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across components in buckets of many members.

    A bucket is split by hash into blocks of about ``BLOCK`` members, and each
    pair of blocks is one group: its overlaps are a product of incidence
    matrices, and of the links found only those leave it that join components
    not yet joined there, fewer than it has members."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    placed = members.select("key", "rep", "n", "component", own.alias("own"),
                            F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    placed = placed.select("key", "rep", "n", "component", "own", F.least("own", "other").alias("low"),
                           F.greatest("own", "other").alias("high"))
    rows = placed.join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        own, low, high, rep, n, part = (table.column(c).to_numpy() for c in
                                        ("own", "low", "high", "rep", "n", "component"))
        items = table.column("items").combine_chunks()
        found = _links_between(np.flatnonzero(own == low[0]), np.flatnonzero(own == high[0]), n, part,
                               items.offsets.to_numpy(), items.values.to_numpy(), percent)
        return pa.Table.from_arrays([pa.array(rep[[i for i, _ in found]], pa.int64()),
                                     pa.array(rep[[j for _, j in found]], pa.int64())], schema=schema) \
            if found else schema.empty_table()

    return rows.groupBy("key", "low", "high").applyInArrow(run, "a long, b long")


def _links_between(left: np.ndarray, right: np.ndarray, n: np.ndarray, part: np.ndarray,
                   offsets: np.ndarray, values: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Index pairs that link different parts, a spanning choice of them."""
    owner = np.repeat(np.arange(len(n)), np.diff(offsets))
    _, token, count = np.unique(values[offsets[0]:offsets[-1]], return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    owner, token = owner[shared[token]], number[token[shared[token]]]
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, int(shared.sum()), COLUMNS):
        here = (token >= at) & (token < at + COLUMNS)
        has = np.zeros((len(n), COLUMNS), dtype=np.float32)
        has[owner[here], token[here] - at] = 1
        common += has[left] @ has[right].T
    common = common.astype(np.int64)
    linked = 100 * common >= percent * (n[left][:, None] + n[right][None, :] - common)
    linked &= part[left][:, None] != part[right][None, :]
    x, y = np.nonzero(linked)
    ends = np.stack((part[left[x]], part[right[y]]))
    _, one = np.unique(ends, axis=1, return_index=True)
    parent: dict[int, int] = {}

    def root(p: int) -> int:
        while parent.get(p, p) != p:
            p = parent[p]
        return p

    found = []
    for i in one:
        p, q = root(int(ends[0, i])), root(int(ends[1, i]))
        if p != q:
            parent[p] = q
            found.append((left[x[i]], right[y[i]]))
    return found


def near_duplicates(docs: DataFrame, percent: int = 75, bands: int = BANDS, rows: int = ROWS,
                    width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``."""
    signed = cut_lineage(sign(docs, bands, rows, width))
    known = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("set1", "set2").agg(F.min("doc_id").alias("rep"))
    heads = classes.join(known.select(F.col("doc_id").alias("rep"), "set1", "set2", "n_shingles",
                                      "bands"), ["rep", "set1", "set2"])
    keyed = heads.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")) \
        .where("low < high")
    members = cut_lineage(keyed.join(shared, "key"))

    # texts of the classes in shared buckets, once for both rounds
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = cut_lineage(shingle_sets(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(wanted, "doc_id", "left_semi"), width))

    def fits(n, m):
        return 100 * F.least(n, m) >= percent * F.greatest(n, m)

    size = members.select(F.col("rep").alias("b"), F.col("n").alias("m")).distinct()
    stars = (members.select(F.col("rep").alias("a"), "n", F.explode(F.array("low", "high")).alias("b"))
             .where("a <> b").groupBy("a", "b").agg(F.max("n").alias("n")))
    tested = cut_lineage(stars.join(size, "b").where(fits(F.col("n"), F.col("m"))).select("a", "b"))
    links = cut_lineage(confirm(tested, sets, percent))
    parts = components(links)

    labelled = members.join(parts, members.rep == parts.node, "left").select(
        "key", "rep", "n", F.coalesce("component", "rep").alias("component"))
    mixed = (labelled.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"),
                                         F.count("*").alias("members"))
             .where("c1 < c2").select("key", "members"))
    labelled = cut_lineage(labelled.join(mixed, "key"))
    few = labelled.where(F.col("members") <= FEW)
    x, y = few.alias("x"), few.alias("y")
    across = (x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep"))
                     & (F.col("x.component") != F.col("y.component"))
                     & fits(F.col("x.n"), F.col("y.n")))
              .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct())
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = confirm(cut_lineage(across.join(done, ["a", "b"], "left_anti")), sets, percent)
    more = more.union(_block_links(labelled.where(F.col("members") > FEW), sets, percent))
    parts = components(parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
                       .union(more))

    of_class = classes.join(parts, classes.rep == parts.node, "left").select(
        "set1", "set2", F.coalesce("component", "rep").alias("component"))
    linked = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component")) \
        .otherwise(F.col("doc_id"))
    return (signed.select("doc_id", "n_shingles", "set1", "set2")
            .join(of_class, ["set1", "set2"], "left")
            .select("doc_id", "n_shingles", linked.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the rows whose component has a smaller ``doc_id``; of rows that share
    ``doc_id`` and text one stays, any where they differ in other columns."""
    gone = near_duplicates(docs, **parameters).where("NOT kept").select(
        F.col("doc_id").alias("gone")).distinct()
    # the ids that stand more than once, without their texts; few are broadcast
    many = cut_lineage(docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("many"))
                       .agg(F.count("*").alias("n")).where("n > 1").select("many"))
    if many.limit(FEW_IDS + 1).count() <= FEW_IDS:
        many = F.broadcast(many)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))

    def stay(part: DataFrame) -> DataFrame:
        return part.join(gone, F.col("id") == F.col("gone"), "left_anti")

    once = stay(rows.join(many, F.col("id") == F.col("many"), "left_anti")).select("row.*")
    text = F.sha2(F.coalesce(F.concat(F.lit("t"), F.col("row.text")), F.lit("")), 256)
    again = (stay(rows.join(many, F.col("id") == F.col("many"), "left_semi")).withColumn("sha", text)
             .groupBy("id", "sha").agg(F.first("row").alias("row")))
    return once.unionByName(again.select("row.*"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle are counted, and components follow by
#: spreading the smallest id along the links.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(CASE WHEN len(words) < 5 THEN array_to_string(words, ' ')
    ELSE array_to_string(words[i:i + 4], ' ') END) AS sh
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, least(len(words), 1)) + 1)) AS i
        FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT c.a, c.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
    FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2) c
  JOIN n na ON na.doc_id = c.a JOIN n nb ON nb.doc_id = c.b
  WHERE 100 * c.common >= 75 * (na.n + nb.n - c.common)),
reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles,
  least(w.doc_id, coalesce(m.low, w.doc_id)) AS component_id,
  w.doc_id = least(w.doc_id, coalesce(m.low, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY 1) m ON m.a = w.doc_id
"""
