"""Distractor mining: the most similar other candidates of each item, through an
inverted-list index over unit vectors.

``fit`` learns centroids from a bounded sample (``sample`` rows, those of smallest
hash); ``build`` puts *every* row into the list of its nearest centroid and records
each list's angle (the widest one between a member and the centroid). A list of more
rows than a block has room for is split, so one that holds a third of all rows is
many blocks.

``search`` compares a query with its ``probes`` nearest lists and keeps the k best. With
``exact`` a second round follows: a list at angle t from the query and of angle r holds
nothing more similar than cos(t - r), so lists that could still beat the query's k-th best
are compared as well, and the result is that of comparing all rows. How many lists that
are depends on the data: few where vectors cluster, most where they are spread evenly;
then the products grow with queries times rows. Without ``exact`` a query costs
``probes`` lists whatever the data.

Lists that follow each other share a shelf, as many as a block has room for. A cell, one
group of a task, is a block and the queries that want a list of its shelf, so a query is
sent once to a shelf and not once to each list. Products are made in single precision;
what comes within their error of the k best is compared in double precision, and only
that counts.

Shelves with more queries than a cell holds are dealt by salt, larger lists in parts.
Rows with a null id, a null or zero vector, null or non-finite entries or another length
than most are left out. A candidate has another id, another group and another vector
than the query; ties go to the smallest id. Rows that share an id count once, by their
best similarity. Null groups are one group.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from optiq.session import cut_lineage

#: Rows of a block and of a batch of queries; batches that meet a block in one cell.
BLOCK, BATCH, BATCHES = 4096, 1024, 32
#: Large tables have blocks of up to LARGER times these rows, and SHELVES of them at least.
LARGER, SHELVES = 16, 8
#: Queries whose shelves are told in one batch: it has a row for each shelf and query.
PROBED = 128
DIGITS = 9


class Index:
    """Centroids, angles and sizes of the lists (bounded by their number), and the rows."""

    def __init__(self, centroids: np.ndarray, rows: DataFrame, angle: np.ndarray, size: np.ndarray):
        self.centroids, self.rows, self.angle, self.size = centroids, rows, angle, size

    def shelves(self) -> tuple[np.ndarray, list[int]]:
        """The shelf of each list, and into how many parts each shelf's rows are dealt."""
        room = int(min(max(BLOCK, self.size.sum() // SHELVES), LARGER * BLOCK))
        shelf, rows = [], []
        for n in self.size:
            if not rows or rows[-1] + n > room:
                rows.append(0)
            rows[-1] += n
            shelf.append(len(rows) - 1)
        return np.array(shelf), [max(1, -(-int(n) // room)) for n in rows]


def _usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(id, own, same, v) of the usable rows, and the number of dimensions."""
    v = F.col("vector").cast("array<double>")
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.xxhash64("group").alias("own"),
                          F.xxhash64("vector").alias("same"), v.alias("v"))
    good = rows.where(F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                      & F.exists("v", lambda x: x != 0))
    most = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most.d if most else 0
    return good.where(F.size("v") == d), d


def _unit(column: pa.Array, d: int) -> np.ndarray:
    m = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def fit(rows: DataFrame, d: int, lists: int, sample: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids by k-means on the directions of ``sample`` rows."""
    held = rows.select("v", F.xxhash64("id", "same").alias("h")).orderBy("h").limit(sample).select("v").collect()
    u = np.array([r.v for r in held]).reshape(-1, d)
    u /= np.abs(u).max(axis=1, keepdims=True)
    u = np.unique(u / np.linalg.norm(u, axis=1, keepdims=True), axis=0)
    c = u[np.random.default_rng(7).permutation(len(u))[:lists]]
    for _ in range(rounds):
        near = (u @ c.T).argmax(axis=1)
        for j in range(len(c)):
            total = u[near == j].sum(axis=0)
            if (length := np.linalg.norm(total)) > 0:
                c[j] = total / length
    return c


def build(vectors: DataFrame, lists: int = 256, sample: int = 8192) -> Index | None:
    """The index of all usable rows of (id, group, vector); None where there are none."""
    rows, d = _usable(vectors)
    if not d:
        return None
    centroids = fit(rows, d, lists, sample)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            u = _unit(batch.column(3), d)
            cos = u @ centroids.T
            near = cos.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(near.astype(np.int32)),
                 pa.array(np.arccos(np.clip(cos[np.arange(len(u)), near], -1, 1))),
                 pa.array([x.tobytes() for x in u], pa.binary())],
                names=["id", "own", "same", "list", "angle", "u"])

    placed = cut_lineage(rows.mapInArrow(run, "id long, own long, same long, list int, angle double, u binary"))
    angle, size = np.zeros(len(centroids)), np.zeros(len(centroids))
    for r in placed.groupBy("list").agg(F.max("angle").alias("a"), F.count("*").alias("n")).collect():
        angle[r.list], size[r.list] = r.a, r.n
    return Index(centroids, placed, angle, size)


def best(sims: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, equal ones from the left; -1 for none."""
    out = np.full((len(sims), k), -1)
    least = np.partition(sims, -k, axis=1)[:, -k, None] if sims.shape[1] > k else np.full((len(sims), 1), -np.inf)
    over, level = sims > least, (sims == least) & (sims > -np.inf)
    row, col = np.nonzero(over | level & (np.cumsum(level, axis=1, dtype=np.int32) <= k - over.sum(axis=1)[:, None]))
    out[row, np.arange(len(row)) - np.searchsorted(row, row)] = col
    return out


FOUND = pa.schema([("id", pa.int64()), ("candidate", pa.int64()), ("similarity", pa.float64())])


class Rows(NamedTuple):
    """Rows of a block or queries of a batch, by column."""

    id: np.ndarray
    own: np.ndarray
    same: np.ndarray
    u: np.ndarray

    def at(self, places) -> Rows:
        return Rows(*(x[places] for x in self))


def _matrix(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    chunks = [np.frombuffer(b"".join(c.to_pylist()), dtype=dtype) for c in column.chunks]
    return np.concatenate(chunks).reshape(len(column), -1)


def _rows(table: pa.Table) -> Rows:
    return Rows(*(table.column(c).to_numpy() for c in ("id", "own", "same")), _matrix(table.column("u"), np.float64))


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Whether a row begins another run of equal keys."""
    new = np.ones(len(sorted_keys[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_keys])
    return new


def _first(rows: Rows, lists: np.ndarray, k: int) -> np.ndarray:
    """Places, by list, of the rows that can be among the k best of a query: of one group and
    vector the k + 1 smallest ids, since all of them are as similar and one may be the query's."""
    at = np.lexsort((rows.id, rows.same, rows.own, lists))
    keys = lists[at], rows.own[at], rows.same[at]
    at = at[_starts(*keys, rows.id[at])]
    new = _starts(lists[at], rows.own[at], rows.same[at])
    begin = np.flatnonzero(new)
    return at[np.arange(len(at)) - begin[np.cumsum(new) - 1] <= k]


def _tiles(lists: np.ndarray, wants: np.ndarray) -> Iterator[tuple[np.ndarray, slice]]:
    """Queries and rows compared in one product: all of them, or list by list where few are wanted."""
    begin = np.flatnonzero(_starts(lists))
    end = np.append(begin[1:], len(lists))
    want = wants[:, lists[begin]]
    if 2 * (want.sum(axis=0) * (end - begin)).sum() >= len(want) * len(lists):
        spans = [(np.flatnonzero(want.any(axis=1)), 0, len(lists))]
    else:
        spans = [(np.flatnonzero(want[:, j]), begin[j], end[j]) for j in range(len(begin))]
    for rows, a, z in spans:
        for c in range(a, z, BLOCK) if len(rows) else ():
            yield rows, slice(c, min(c + BLOCK, z))


def _kth(sims: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, ids that come again counted once; -inf where there are fewer."""
    at = np.argsort(ids, kind="stable")
    begin = np.flatnonzero(_starts(ids[at]))
    if len(begin) < len(ids):
        sims = np.maximum.reduceat(sims[:, at], begin, axis=1)
    places = best(sims, k)
    return np.where(places[:, -1] >= 0, np.take_along_axis(sims, places, axis=1).min(axis=1), -np.inf)


def _kept(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """(query, candidate, similarity) of the k best candidates of each query, and the places of the k-th ones."""
    query, candidate, sim = (np.concatenate(x) for x in zip(*found, strict=True))
    at = np.lexsort((-sim, candidate, query))
    at = at[_starts(query[at], candidate[at])]
    at = at[np.lexsort((candidate[at], -sim[at], query[at]))]
    rank = np.arange(len(at)) - np.searchsorted(query[at], query[at])
    at, rank = at[rank < k], rank[rank < k]
    return (query[at], candidate[at], sim[at]), np.flatnonzero(rank == k - 1)


def _nearest(q: Rows, kth: np.ndarray, wants: np.ndarray, rows: Rows, single: np.ndarray, lists: np.ndarray,
             k: int) -> tuple[np.ndarray, ...]:
    """(query, candidate, similarity): the k best rows for each query, no worse than ``kth``,
    of the lists that it wants. ``single``: the rows' vectors in single precision."""
    d = q.u.shape[1]
    slack = 2 * (d + 4) * 2.0 ** -24 + 1e-7   # twice the error of a product of unit vectors, and rounding
    some = max(1, 2 ** 20 // d)
    floor, least, q_single = kth.copy(), kth - slack, q.u.astype(np.float32)
    found, n = [(np.empty(0, int), np.empty(0, np.int64), np.empty(0))], 0
    for mine, cols in _tiles(lists, wants):
        sims = q_single[mine] @ single[cols].T
        over = sims >= least[mine, None].astype(np.float32)
        if np.count_nonzero(over) > 4 * k * len(mine):
            for a, b in zip(q[:3], rows[:3], strict=True):
                sims[a[mine, None] == b[None, cols]] = -np.inf
            sims[~wants[mine][:, lists[cols]]] = -np.inf
            over = sims >= least[mine, None].astype(np.float32)
            if np.count_nonzero(over) > 4 * k * len(mine):
                least[mine] = np.maximum(least[mine], _kth(sims, rows.id[cols], k) - slack)
                over = sims >= least[mine, None].astype(np.float32)
        at, col = np.divmod(np.flatnonzero(over), over.shape[1])   # several times as fast as nonzero of a table
        at, col = mine[at], col + cols.start
        fit = (q.id[at] != rows.id[col]) & (q.own[at] != rows.own[col]) & (q.same[at] != rows.same[col]) & wants[at, lists[col]]
        at, col = at[fit], col[fit]
        for a in range(0, len(at), some):
            i, j = at[a:a + some], col[a:a + some]
            sim = np.round(np.einsum("ij,ij->i", q.u[i], rows.u[j]), DIGITS)
            up = sim >= floor[i]
            found.append((i[up], rows.id[j[up]], sim[up]))
            n += np.count_nonzero(up)
        if n > 8 * k * len(q.id):
            held, last = _kept(found, k)
            found, n = [held], 0
            floor[held[0][last]] = held[2][last]
            least = np.maximum(least, floor - slack)
    return _kept(found, k)[0]


def _cell(block: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The k best of a block for each query that meets it."""
    if not (len(block) and len(asked)):
        return FOUND.empty_table()
    rows, lists = _rows(block), block.column("list").to_numpy()
    at = _first(rows, lists, k)
    rows, lists = rows.at(at), lists[at]
    single = rows.u.astype(np.float32)
    queries, kth = _rows(asked), asked.column("kth").to_numpy()
    bits = _matrix(asked.column("lists"), np.uint8)
    out = []
    for a in range(0, len(asked), BATCH):
        b = slice(a, a + BATCH)
        q = queries.at(b)
        at, candidate, sim = _nearest(q, kth[b], np.unpackbits(bits[b], axis=1).astype(bool), rows, single, lists, k)
        out.append(pa.table([q.id[at], candidate, sim], schema=FOUND))
    return pa.concat_tables(out)


def _of(values, column: str):
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col(column) + 1)


def _compared(index: Index, asked: DataFrame, k: int, probes: int, second: bool) -> DataFrame:
    """The k best of every block for each query row (id, own, same, u, kth) that wants a list of it."""
    shelf, parts = index.shelves()
    held = (index.centroids, index.angle, index.size, probes, second, shelf)

    def count(batches):
        for batch in all_probed(batches, *held):
            shelves, n = np.unique(batch.column(5), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shelves), pa.array(n)], names=["shelf", "n"])

    wanted_by = {r.shelf: r.n for r in asked.mapInArrow(count, "shelf int, n long").groupBy("shelf").agg(F.sum("n").alias("n")).collect()}
    salts = [-(-wanted_by.get(j, 0) // (BATCH * BATCHES)) for j in range(len(parts))]
    queries = asked.mapInArrow(lambda batches: all_probed(batches, *held),
                               "id long, own long, same long, u binary, kth double, shelf int, lists binary")
    queries = queries.withColumn("salt", F.pmod(F.xxhash64("same", "id"), _of(salts, "shelf"))).withColumn(
        "part", F.explode(F.sequence(F.lit(0), _of(parts, "shelf") - 1).cast("array<long>")))
    blocks = index.rows.select("id", "own", "same", "u", "list", _of(shelf, "list").alias("shelf")).where(_of(salts, "shelf") > 0)
    blocks = blocks.withColumn("part", F.pmod(F.xxhash64("id"), _of(parts, "shelf"))).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), _of(salts, "shelf") - 1).cast("array<long>")))
    key = ["shelf", "part", "salt"]
    return blocks.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(
        lambda block, some: _cell(block, some, k), "id long, candidate long, similarity double")


def _top(found: DataFrame, k: int) -> DataFrame:
    once = found.repartition("id").groupBy("id", "candidate").agg(F.max("similarity").alias("similarity"))
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "candidate")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def probed(batch: pa.RecordBatch, centroids: np.ndarray, angle: np.ndarray, size: np.ndarray, probes: int,
           second: bool, shelf: np.ndarray | None = None) -> pa.RecordBatch:
    """The queries of a batch (id, own, same, u, kth) with each shelf that has lists they want,
    and a bit for each list that they want. Without ``shelf`` each list has its own."""
    u = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.float64).reshape(len(batch), -1)
    cos = u @ centroids.T
    order = np.argsort(-cos, axis=1, kind="stable")
    wants = np.zeros(cos.shape, dtype=bool)
    np.put_along_axis(wants, order[:, :probes], True, axis=1)
    if second:
        kth = batch.column(4).to_numpy(zero_copy_only=False)
        apart = np.maximum(0.0, np.arccos(np.clip(cos, -1, 1)) - angle - 1e-7)
        wants = ~wants & (np.cos(np.minimum(apart, np.pi)) + 10.0 ** -DIGITS >= kth[:, None])
    wants &= size > 0
    begin = np.flatnonzero(_starts(np.arange(len(size)) if shelf is None else shelf))
    row, col = np.nonzero(np.logical_or.reduceat(wants, begin, axis=1))
    bits = pa.array([x.tobytes() for x in np.packbits(wants, axis=1)], pa.binary())
    taken = pa.RecordBatch.from_arrays([*batch.columns, bits], names=["id", "own", "same", "u", "kth", "lists"]).take(pa.array(row))
    return pa.RecordBatch.from_arrays([*taken.columns[:5], pa.array(col.astype(np.int32)), taken.column(5)],
                                      names=["id", "own", "same", "u", "kth", "shelf", "lists"])


def all_probed(batches, *index):
    """``probed`` of every query, so many queries at a time that memory does not grow with the batch."""
    for batch in batches:
        for a in range(0, len(batch), PROBED):
            yield probed(batch.slice(a, PROBED), *index)


def search(index: Index, queries: DataFrame, k: int, probes: int = 8, exact: bool = True) -> DataFrame:
    """id, rank, candidate, similarity of the k best candidates of each query id
    (``queries``: column ``id``, rows of the index)."""
    ids = queries.select(F.col("id").cast("long").alias("id")).distinct()
    asked = cut_lineage(index.rows.join(ids, "id").select("id", "own", "same", "u", F.lit(-2.0).alias("kth")))
    found = _compared(index, asked, k, probes, False)
    if exact:
        found = cut_lineage(_top(found, k).drop("rank"))
        kth = found.groupBy("id").agg(F.min("similarity").alias("least"), F.count("*").alias("n"))
        more = asked.drop("kth").join(kth.where(F.col("n") >= k).select("id", F.col("least").alias("kth")), "id", "left")
        more = cut_lineage(more.select("id", "own", "same", "u", F.coalesce("kth", F.lit(-2.0)).alias("kth")))
        found = found.unionByName(_compared(index, more, k, probes, True))
    return _top(found, k).select("id", "rank", "candidate", "similarity")


def mine_distractors(vectors: DataFrame, queries: DataFrame, k: int = 9, lists: int = 256, sample: int = 8192,
                     probes: int = 8, exact: bool = True) -> DataFrame:
    """id, rank, candidate, similarity: the k most similar candidates of other groups
    for each id in ``queries`` among all rows of ``vectors`` (id, group, vector)."""
    index = build(vectors, lists, sample)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "id long, rank int, candidate long, similarity double")
    return search(index, queries, k, probes, exact)
