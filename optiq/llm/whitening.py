"""Whitening of embeddings with Spark MLlib's BlockMatrix.

Entries become integers ``x = floor(scale * c) + shift``. The distinct x vectors are
the fit list; its size n and its sums S per dimension are exact integers, so
``n * x - S`` is exact and ``x - S / n`` has one rounding.

1. Rows are gathered in blocks of ``ROWS`` vectors, numbered over all partitions, and
   written to the shared folder; so are the distinct vectors.
2. Blocks are centred and become a distributed BlockMatrix A (short blocks end in
   rows of zeros, which add nothing). ``A.transpose() * A`` is the scatter matrix;
   the middle dimension is cut in as many parts as blocks need, so no task holds
   more than ``SPLIT`` pairs of blocks.
3. The scatter matrix, d x d whatever the number of rows, is decomposed on the driver
   (``numpy.linalg.eigh``). The whitening matrix W has the unit eigenvectors of the
   largest eigenvalues, each over the root of its eigenvalue.
4. All rows' blocks, centred alike, are multiplied by W as BlockMatrices, and the
   products meet their row ids block by block. The same product over the fit list
   gives ``identity_error``.

Skew: copies of one vector are one row of the fit list, after partial distinct in
each task; all other work is by blocks of equal size.

Defined cases: vectors that are null or hold null or non-finite entries are dropped,
and so are those of another length than most (ties: the longest). Entries are
clamped to +-2**62 before they are shifted. ``deviation`` is null where it exceeds a
long. Components without variance (eigenvalue below d * 2**-52 of the largest) have
no whitened value and are left out; without any, the result is empty, as it is for
an empty table. Repeated rows and null ids are rows of their own. Eigenvectors of
equal eigenvalues are any orthonormal basis of their space. Other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from optiq.llm import vocab
from optiq.session import cut_lineage
from optiq.sources.tables import table

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Vectors in a block, and pairs of blocks that one task multiplies.
ROWS, SPLIT = 1024, 64
CLAMP = float(1 << 62)
SAFE = 1 << 62
LONG_MAX = (1 << 63) - 1

PLACED = T.StructType([
    T.StructField("block", T.StructType([T.StructField("i", T.LongType()), T.StructField("j", T.LongType())])),
    T.StructField("matrix", MatrixUDT())])


def integers(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
             scale: int = SCALE, shift: int = SHIFT) -> tuple[DataFrame, int]:
    """(rows of ``id`` and ``x``, number of dimensions)."""
    entry = F.col("v")
    real = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        entry.isNotNull() & F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    most = real.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most.d if most else 0
    at = F.transform(entry, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(CLAMP)), F.lit(-CLAMP))) + shift)
    return real.where(F.size("v") == d).select("id", at.alias("x")), d


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, d)


def in_blocks(rows: DataFrame, d: int) -> tuple[DataFrame, int]:
    """(numbered blocks of rows, how many): ``i``, ``ids`` and ``x``, the vectors as
    packed little-endian longs. Written, so the numbers stay."""
    kind = pa.schema([("part", pa.int64()), ("at", pa.int64()), ("ids", pa.list_(pa.int64())), ("x", pa.binary())])

    def run(batches):
        part, n, ids, parts, held = TaskContext.get().partitionId(), 0, [], [], 0
        def block(size):
            nonlocal n, ids, parts, held
            whole = np.concatenate(parts)
            made = pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([n]), pa.array([ids[:size]], pa.list_(pa.int64())),
                 pa.array([whole[:size].astype("<i8").tobytes()], pa.binary())], schema=kind)
            n, ids, parts, held = n + 1, ids[size:], [whole[size:]], held - size
            return made
        for batch in batches:
            ids += batch.column(0).to_pylist()
            parts.append(_matrix(batch.column(1), d))
            held += len(batch)
            while held >= ROWS:
                yield block(ROWS)
        if held:
            yield block(held)

    made = cut_lineage(rows.select("id", "x").mapInArrow(run, "part long, at long, ids array<long>, x binary"))
    count = {r.part: r.n for r in made.groupBy("part").agg(F.count("*").alias("n")).collect()}
    offset, total = [], 0
    for part in sorted(count):
        offset.append((part, total))
        total += count[part]
    offsets = made.sparkSession.createDataFrame(offset, "part long, before long")
    numbered = made.join(F.broadcast(offsets), "part")  # a row for each partition
    return numbered.select((F.col("before") + F.col("at")).alias("i"), "ids", "x"), total


def distinct_vectors(blocks: DataFrame, d: int) -> DataFrame:
    """Each distinct x vector once, as ``id`` null and ``x``."""
    kind = pa.schema([("x", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for packed in batch.column(0):
                whole = np.unique(np.frombuffer(packed.as_py(), dtype="<i8").reshape(-1, d), axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.FixedSizeListArray.from_arrays(pa.array(whole.ravel()), d).cast(kind.field(0).type)], schema=kind)

    return (blocks.select("x").mapInArrow(run, "x array<long>").distinct()
            .select(F.lit(None).cast("long").alias("id"), "x"))


class Centre:
    """n and S of the fit list: centred values and exact deviations."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.base = [s // n for s in sums]
        self.rest = [s - n * b for s, b in zip(sums, self.base, strict=True)]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as longs where they hold it, else as Python integers."""
        x = x.reshape(-1, len(self.base))
        top = max((max(abs(int(lo) - b), abs(int(hi) - b)) for lo, hi, b in
                   zip(x.min(0, initial=SAFE), x.max(0, initial=-SAFE), self.base, strict=True)), default=0)
        kind = np.int64 if (top + 1) * self.n < SAFE else object
        return (x.astype(kind) - np.array(self.base, dtype=kind)) * self.n - np.array(self.rest, dtype=kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.n).astype(np.float64)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        s = self.scaled(x)
        if s.dtype != object and (not s.size or int(np.abs(s).max()) ** 2 * s.shape[1] < SAFE):
            return (s * s).sum(axis=1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in s]
        return [v if v <= LONG_MAX else None for v in exact]


def centre_of(fit: DataFrame, d: int) -> Centre | None:
    """n and S of blocks, from exact partial sums; None where there are no rows."""
    def run(batches):
        n, sums = 0, [0] * d
        for batch in batches:
            for packed in batch.column(0):
                x = np.frombuffer(packed.as_py(), dtype="<i8").reshape(-1, d)
                n += len(x)
                low = x.min(axis=0)
                for j, (b, extra) in enumerate(zip(low.tolist(), (x - low).astype(object).sum(axis=0)
                                                   if int(x.max()) - int(x.min()) >= SAFE // ROWS
                                                   else (x - low).sum(axis=0).tolist(), strict=True)):
                    sums[j] += b * len(x) + int(extra)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int64()), pa.array([n] * d, pa.int64()),
                                              pa.array([str(s) for s in sums])], names=["dim", "n", "s"])

    parts = fit.select("x").mapInArrow(run, "dim long, n long, s string")
    got = (parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
           .orderBy("dim").collect())
    return Centre(got[0].n, [int(r.s) for r in got]) if got else None


def _dense(n_rows: int, n_cols: int, values: np.ndarray) -> dict:
    """A dense matrix, its values row by row, in the stored form of MLlib matrices."""
    return {"type": 1, "numRows": n_rows, "numCols": n_cols, "colPtrs": None, "rowIndices": None,
            "values": values.ravel(), "isTransposed": True}


STORED = pa.struct([("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()),
                    ("colPtrs", pa.list_(pa.int32())), ("rowIndices", pa.list_(pa.int32())),
                    ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_())])
AT = pa.struct([("i", pa.int64()), ("j", pa.int64())])


def block_matrix(blocks: DataFrame, total: int, d: int, centre: Centre) -> BlockMatrix:
    """The centred rows of numbered blocks as a distributed matrix; short blocks get rows of zeros."""
    def run(batches):
        for batch in batches:
            for i, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = centre.centred(np.frombuffer(packed.as_py(), dtype="<i8").reshape(-1, d))
                whole = np.zeros((ROWS, d))
                whole[:len(x)] = x
                yield pa.RecordBatch.from_arrays(
                    [pa.array([{"i": i, "j": 0}], AT), pa.array([_dense(ROWS, d, whole)], STORED)],
                    names=["block", "matrix"])

    return _built(blocks.select("i", "x").mapInArrow(run, PLACED), ROWS, d, total)


def _built(placed: DataFrame, rows: int, cols: int, total: int) -> BlockMatrix:
    # the DataFrame goes to MLlib as it is: an RDD of Python matrices would pickle every entry
    return BlockMatrix(callMLlibFunc("createBlockMatrix", placed, rows, cols, total * rows, cols), rows, cols)


def local_matrix(spark: SparkSession, m: np.ndarray) -> BlockMatrix:
    """A small matrix as a single block."""
    from pyspark.mllib.linalg import DenseMatrix
    rows, cols = m.shape
    block = DenseMatrix(rows, cols, m.ravel(order="F"))
    return BlockMatrix(spark.sparkContext.parallelize([((0, 0), block)], 1), rows, cols)


def scatter(a: BlockMatrix, total: int) -> np.ndarray:
    """``a.transpose() * a`` as a local matrix of its columns' size. MLlib's own method
    is called for its last argument, the parts of the middle dimension."""
    t = a.transpose()
    product = t._java_matrix_wrapper._java_model.multiply(
        a._java_matrix_wrapper._java_model, max(1, -(-total // SPLIT)))
    return BlockMatrix(product, a.colsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def whitening(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, whitening matrix d x k) of a covariance matrix."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = int((e[:components] > max(e[0], 0) * len(e) * 2.0 ** -52).sum())
    return e[:k], u[:, :k] / np.sqrt(e[:k])


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, shift: int = SHIFT) -> tuple[DataFrame, dict]:
    """(``id``, ``deviation`` and ``z``, the whitened coordinates, of every remaining row;
    n, explained, identity_error and the eigenvalues of the fit)."""
    spark = df.sparkSession
    rows, d = integers(df, id_col, vector, scale, shift)
    blocks, total = in_blocks(rows, d) if d else (None, 0)
    none = spark.createDataFrame([], "id long, deviation long, z array<double>")
    if not total:
        return none, {"n": 0, "explained": [], "identity_error": None, "eigenvalues": []}
    fit, fitted = in_blocks(distinct_vectors(blocks, d), d)
    centre = centre_of(fit, d)
    a = block_matrix(fit, fitted, d, centre)
    v = scatter(a, fitted) / centre.n
    e, w = whitening(v, components)
    k = len(e)
    if not k:
        return none, {"n": centre.n, "explained": [], "identity_error": None, "eigenvalues": []}
    turn = local_matrix(spark, w)
    error = float(np.abs(scatter(a.multiply(turn), fitted) / centre.n - np.eye(k)).max())
    product = block_matrix(blocks, total, d, centre).multiply(turn)
    projected = callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model)
    return _by_row(blocks, projected, d, k, centre), {
        "n": centre.n, "explained": (e / np.trace(v)).tolist(), "identity_error": error, "eigenvalues": e.tolist()}


def _by_row(blocks: DataFrame, projected: DataFrame, d: int, k: int, centre: Centre) -> DataFrame:
    """The rows of each block beside their row of the product."""
    kind = pa.schema([("id", pa.int64()), ("deviation", pa.int64()), ("z", pa.list_(pa.float64()))])

    def run(batches):
        vocab.worker_cache("whitening")
        for batch in batches:
            for ids, packed, m in zip(*batch.columns, strict=True):
                ids, x = ids.as_py(), np.frombuffer(packed.as_py(), dtype="<i8").reshape(-1, d)
                values, by_row = m["values"].values.to_numpy(), m["isTransposed"].as_py()
                z = values.reshape((ROWS, k), order="C" if by_row else "F")[:len(ids)]
                flat = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(z).ravel()), k)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(centre.deviation(x), pa.int64()),
                                                  flat.cast(pa.list_(pa.float64()))], schema=kind)

    place, matrix = (F.col(c) for c in projected.columns)
    joined = blocks.join(projected.select(place["_1"].cast("long").alias("i"), matrix.alias("m")), "i")
    return joined.select("ids", "x", "m").mapInArrow(run, "id long, deviation long, z array<double>")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fit = whiten(table(spark, sf_dir, "embeddings"))
    explained = F.array(*[F.lit(x) for x in fit["explained"]]).cast("array<double>")
    return rows.select("id", "deviation", F.posexplode("z").alias("at", "whitened")).select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"),
        F.lit(fit["n"]).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(fit["identity_error"]).cast("double").alias("identity_error"))
