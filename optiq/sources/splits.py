"""Records of large text files, read in parallel.

A text file is read in splits, and what a line means can depend on everything
before it: its number, whether a quoted field is open, how deep the brackets are.
Each of these is a running sum, taken in two steps: the splits' totals (one row a
split), then a second pass over the splits, each from the totals of those before it.
So a file of any size is as many tasks as it has splits. Records that lie in one split
are done there; only the ends of those that cross a split are shuffled.

``file_block_start`` of ``_metadata`` names a split; lines of a split keep their order.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from optiq.session import cut_lineage, scratch_path

SPLIT = ["file", "block"]
#: Splits whose offsets are broadcast (under 100 bytes each and a path); more are joined by a shuffle.
FEW_SPLITS = 50_000


def pieces(spark: SparkSession, path: str, sep: str = "\n", glob: str | None = None) -> DataFrame:
    """file, block, no (order inside the split), value: the pieces of all files under
    ``path`` that end with ``sep`` (one character, removed)."""
    read = spark.read.option("recursiveFileLookup", True)
    if glob:
        read = read.option("pathGlobFilter", glob)
    return read.text(path, lineSep=sep).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_block_length").alias("length"), F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("no"), "value")


def folder_of(file: Column, up: int = 1) -> Column:
    """The name of the folder that holds a file (``up`` levels above), decoded."""
    name = F.element_at(F.split(file, "/"), -1 - up)
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _split_anew() -> Column:
    return F.raise_error(F.lit("the files were split anew between two passes; read them again")).cast("long")


def numbered_lines(spark: SparkSession, path: str, source: Column, glob: str | None = None,
                   single: bool = False) -> DataFrame:
    """source, pos, value: lines of each source, counted from its first line that is not
    blank to its last such line. Several files of a source follow each other by name;
    with ``single`` they are an error."""
    value = F.col("value")
    lines = pieces(spark, path, glob=glob).select(
        source.alias("source"), "file", "block", "length", "no",
        F.when(value.contains("\r"), F.regexp_replace(value, "\r$", "")).otherwise(value).alias("value"))
    # the lines of a split follow each other in its task, so where it begins is all that is
    # missing: a row for each split
    full = F.when(F.col("value").rlike(r"\S"), F.col("no"))
    whole = Window.partitionBy("source")
    ahead = whole.orderBy(*SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    ends = (lines.groupBy("source", *SPLIT, "length").agg(F.count("*").alias("n"), F.min("no").alias("base"),
                                                F.min(full).alias("low"), F.max(full).alias("high"))
            .withColumn("shift", F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("base"))
            .withColumn("first", F.min(F.col("low") + F.col("shift")).over(whole))
            .withColumn("last", F.max(F.col("high") + F.col("shift")).over(whole)))
    if single:
        several = F.min("file").over(whole) < F.max("file").over(whole)
        ends = ends.withColumn("first", F.when(several, F.raise_error(
            F.lit(f"{path} is more than one file"))).otherwise(F.col("first")))
    ends = cut_lineage(ends.select(F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("length").alias("_length"),
                                   "base", "n", "shift", "first", "last"))
    if ends.limit(FEW_SPLITS + 1).count() <= FEW_SPLITS:
        ends = F.broadcast(ends)
    line = F.col("no") + F.col("shift")
    # both passes see the same splits in the same tasks, unless the number of cores changed in between
    same = F.coalesce(F.col("no").between(F.col("base"), F.col("base") + F.col("n") - 1), F.lit(False))
    placed = lines.join(ends, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))
                        & (F.col("length") == F.col("_length")), "left").where(
        ~same | line.between(F.col("first"), F.col("last")))
    pos = F.when(same, line - F.col("first")).otherwise(_split_anew())
    return placed.select("source", pos.alias("pos"), "value")


def _by_split(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, Iterator[list]]]:
    """For each split in a task its ``names`` columns, which do not change inside of it, and its
    values, some at a time."""
    def stretches():
        for batch in batches:
            n = batch.num_rows
            ids = [batch.column(c) for c in SPLIT]
            moved = [pc.not_equal(c.slice(1), c.slice(0, max(n - 1, 0))).to_numpy(zero_copy_only=False) for c in ids]
            edges = [0, *(np.flatnonzero(moved[0] | moved[1]) + 1), n] if n else [0]
            for low, high in itertools.pairwise(map(int, edges)):
                yield (tuple(batch.column(c)[low].as_py() for c in names),
                       batch.column("value").slice(low, high - low).to_pylist())

    for split, some in itertools.groupby(stretches(), lambda x: x[0]):
        yield split, (values for _, values in some)


_ESCAPED = re.compile(r"\\.", re.DOTALL)


def _starts(cut: DataFrame, sep: str, escapes: bool) -> DataFrame:
    """_file, _block, _length, and what lies before a split in its file: ``inside`` (1 if a quote is
    open), ``depth`` (braces opened outside of quotes, less those closed), ``ahead`` (pieces).
    A row for each split but those that begin a file.

    A split is counted for both cases, that it starts outside and inside of quotes."""
    def run(batches):
        for split, some in _by_split(batches, [*SPLIT, "length"]):
            n, quotes, deeper = 0, 0, [0, 0]
            for values in some:
                text = sep.join([*values, ""])
                runs = (_ESCAPED.sub("", text) if escapes else text).split('"')
                for i in (0, 1):  # the text outside of quotes, if the split starts outside, inside
                    outside = "".join(runs[(i + quotes) % 2::2])
                    deeper[i] += outside.count("{") - outside.count("}")
                n, quotes = n + len(values), quotes + len(runs) - 1
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "block", "length", "n", "quotes", "d0", "d1"),
                                                       (*split, n, quotes, *deeper), strict=True))])

    counted = (cut.where((F.col("block") > 0) | (F.col("length") < F.col("size"))).select(*SPLIT, "length", "value")
               .mapInArrow(run, "file string, block long, length long, n long, quotes long, d0 long, d1 long"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    told = counted.select("*", (F.sum("quotes").over(ahead) % 2).cast("int").alias("inside"), F.sum("n").over(ahead).alias("ahead"))
    deep = told.withColumn("depth", F.sum(F.when(F.col("inside") == 1, F.col("d1")).otherwise(F.col("d0"))).over(ahead))
    return cut_lineage(deep.where("block > 0").select(
        F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("length").alias("_length"), "inside", "depth", "ahead"))


SPANS = "file string, block long, start long, begun boolean, shut boolean, key string, record string"
#: A task hands on its records by so many characters.
_HANDED = 1 << 22


def _spans(spark: SparkSession, cut: DataFrame, sep: str, escapes: bool, walk: Callable) -> DataFrame:
    """Records of all files, as far as each lies in one split: ``walk`` is given the pieces of a
    split and its ``inside`` and ``depth``, and gives for each record the place of its first
    piece, whether it begins and ends in this split, its key and its pieces, joined.
    They are written once, because the ends of splits are then joined apart."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("start", pa.int64()), ("begun", pa.bool_()),
                        ("shut", pa.bool_()), ("key", pa.string()), ("record", pa.string())])

    def handed(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches):
        held, size = [], 0
        for (file, block, inside, depth, ahead), some in _by_split(batches, [*SPLIT, "inside", "depth", "ahead"]):
            for first, *rest in walk(itertools.chain.from_iterable(some), inside, depth):
                held.append((file, block, ahead + first, *rest))
                size += len(rest[-1]) + 64
                if size > _HANDED:
                    yield handed(held)
                    held, size = [], 0
        if held:
            yield handed(held)

    # a row for each split of many bytes, none for a file of one split
    starts = F.broadcast(_starts(cut, sep, escapes))
    known = (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")) & (F.col("length") == F.col("_length"))

    def before(name: str) -> Column:
        return F.when(F.col("block") == 0, F.lit(0)).otherwise(F.coalesce(name, _split_anew())).cast("long").alias(name)

    path = scratch_path(spark, "spans")
    (cut.join(starts, known, "left").select(*SPLIT, *map(before, ("inside", "depth", "ahead")), "value")
     .mapInArrow(run, SPANS).write.parquet(path))
    return spark.read.schema(SPANS).parquet(path)


def _whole(spans: DataFrame, sep: str) -> DataFrame:
    """file, start, key, record: records that lie in one split as they are, the others joined.
    Of those each split has two at most."""
    done = F.col("begun") & F.col("shut")
    parts = spans.where(~done)
    so_far = Window.partitionBy("file").orderBy("start")
    owners = parts.select("file", "start", F.last(F.when(F.col("begun"), F.col("start")), ignorenulls=True).over(so_far).alias("owner"))
    pieced = F.array_sort(F.collect_list(F.struct("start", "record")))
    joined = (parts.join(owners.where(F.col("owner").isNotNull()), ["file", "start"]).groupBy("file", "owner")
              .agg(F.min_by("key", "start").alias("key"), pieced.alias("p"))
              .select("file", F.col("owner").alias("start"), "key", F.array_join(F.transform("p", lambda p: p["record"]), sep).alias("record")))
    return spans.where(done).select("file", "start", "key", "record").union(joined)


def _csv_walk(lines: Iterable[str], inside: int, depth: int) -> Iterator[tuple]:
    parts, begun, first = [], False, 0
    for no, line in enumerate(lines):
        if not inside:
            parts, begun, first = [], True, no
        parts.append(line)
        inside ^= line.count('"') & 1
        if not inside:
            yield first, begun, True, None, "\n".join(parts)
            parts = []
    if parts:
        yield first, begun, False, None, "\n".join(parts)


def csv_records(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """file, start (number of the first line), record: CSV records of all files; line
    breaks inside quotes belong to the record. A line starts one where the number of
    quotes before it is even."""
    spans = _spans(spark, pieces(spark, path, glob=glob), "\n", False, _csv_walk)
    return _whole(spans, "\n").select("file", "start", "record").where(F.col("record").rlike(r"\S"))


_REST = re.compile(r'(?:[^"\\]++|\\.)*+"', re.DOTALL)
_ROOT = re.compile(r"\s*\{", re.ASCII)
_LEAD = re.compile(r'((?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+)\{', re.DOTALL)
_KEY = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*\[?\s*$', re.DOTALL | re.ASCII)


def _object_in(piece: str, inside: int, depth: int) -> tuple[str, str] | None:
    """What stands before the first brace of depth 2, and what after it; None if there is none."""
    at = 0
    for rest in ([_REST] if inside else []) + ([_ROOT] if depth == 0 else []):
        if not (skipped := rest.match(piece, at)):
            return None
        at = skipped.end()
    found = _LEAD.match(piece, at)
    return found and (found[1], piece[found.end():])


def _json_walk(values: Iterable[str], inside: int, depth: int) -> Iterator[tuple]:
    # pieces of the object that is open, which may have begun in a split before
    parts, begun, first, key = [] if depth > 1 else None, False, 0, None
    for no, piece in enumerate(values):
        runs = (_ESCAPED.sub("", piece) if "\\" in piece else piece).split('"')
        opened = "".join(runs[inside::2]).count("{")
        if parts is None and opened and depth in (0, 1) and (found := _object_in(piece, inside, depth)):
            named = _KEY.search(found[0])
            # an element of an array that has begun before has no key of its own
            key = named[1] if named and named[1] else key
            parts, begun, first, piece = [], True, no, "{" + found[1]
        if parts is not None:
            parts.append(piece)
        inside ^= (len(runs) - 1) & 1
        # a piece that ends inside a string was cut at a brace of that string
        depth += opened - (not inside)
        if parts is not None and depth <= 1:
            yield first, begun, True, key, "}".join(parts)
            parts = None
    if parts:
        yield first, begun, False, key, "}".join(parts)


def json_elements(spark: SparkSession, path: str, key: str, glob: str | None = None) -> DataFrame:
    """file, start, record: the objects in the array ``key`` at the top of each JSON file.

    Files are cut at closing braces. Quotes before a piece (without escaped ones) tell
    whether it starts inside a string, braces outside of strings how deep it lies. An
    object of the array starts in a piece of depth 1 that opens a brace, and goes on
    up to the piece that closes its depth; the last key before it names the array."""
    spans = _spans(spark, pieces(spark, path, sep="}", glob=glob), "}", True, _json_walk)
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # the last key of the splits before: a row for each split but those that begin a file
    named = (spans.groupBy(*SPLIT).agg(F.max_by("key", F.when(F.col("key").isNotNull(), F.col("start"))).alias("last"))
             .select(*SPLIT, F.last("last", ignorenulls=True).over(ahead).alias("carried")).where("block > 0"))
    owned = spans.join(F.broadcast(named), SPLIT, "left").withColumn("key", F.coalesce("key", "carried")).drop("carried")
    return _whole(owned, "}").where(F.col("key") == key).select(
        "file", "start", F.concat("record", F.lit("}")).alias("record"))
