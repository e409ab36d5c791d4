"""File sources and sinks for question banks, distractor sets and results.

All readers take an explicit schema (no inference pass over the data) and
read directories or globs in one job; file-derived attributes come from the
``_metadata`` column, not from a driver-side listing loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from optiq.session import cut_lineage
from optiq.sources import splits

ITEMS = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("correct_answer", T.StringType()),
    T.StructField("options", T.ArrayType(T.StringType())),
    T.StructField("subject", T.StringType()),
])
DISTRACTOR_SET = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("correct_answer", T.StringType()),
    T.StructField("distractors", T.MapType(T.StringType(), T.StringType())),
    T.StructField("subject", T.StringType()),
    T.StructField("distractor_type", T.StringType()),
])
READING_SET = T.StructType([T.StructField("passage", T.StringType()), *DISTRACTOR_SET.fields])
METRICS = T.StructType([T.StructField(n, T.IntegerType()) for n in
                        ("reasoning_length", "steps_count", "uncertainty_markers")])
RESPONSES = T.StructType([
    T.StructField("question", T.StringType()), T.StructField("subject", T.StringType()),
    T.StructField("correct_answer", T.StringType()), T.StructField("llm_answer", T.StringType()),
    T.StructField("is_correct", T.BooleanType()), T.StructField("confidence", T.IntegerType()),
    T.StructField("response_time", T.DoubleType()), T.StructField("reasoning_text", T.StringType()),
    T.StructField("reasoning_metrics", METRICS), T.StructField("distractor_set", T.StringType()),
    T.StructField("distractor_type", T.StringType()), T.StructField("model", T.StringType()),
])
FLAT_RESPONSES = T.StructType([f for f in RESPONSES.fields
                               if f.name not in ("reasoning_text", "reasoning_metrics")])


def _json(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = True,
          glob: str | None = None) -> DataFrame:
    r = spark.read.schema(schema).option("multiLine", multiline)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.json(path)


def scan_items(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Question bank (JSON array files, or JSON lines with multiline=False)."""
    return _json(spark, path, ITEMS, multiline)


def scan_distractor_sets(spark: SparkSession, path: str, prefix: str = "",
                         multiline: bool = True, glob: str = "*.json",
                         name_from: str = "file") -> DataFrame:
    """All set files under ``path`` in one read; the set name is the file name
    without ``.json``, or with ``name_from="folder"`` the name of the folder that
    holds the file, each without ``prefix``."""
    df = _json(spark, path, DISTRACTOR_SET, multiline, glob)
    if name_from == "folder":
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    else:
        name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?$", 1)
    if prefix:
        name = F.regexp_replace(name, "^" + prefix, "")
    return df.withColumn("distractor_set", name)


def scan_reading_sets(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    df = _json(spark, path, READING_SET, multiline, "*.json")
    return df.withColumn("distractor_set",
                         F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?$", 1))


def scan_tolerant(spark: SparkSession, path: str, multiline: bool = True,
                  glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows): malformed records are kept aside with
    their file name instead of silently skipping the file."""
    schema = T.StructType([*DISTRACTOR_SET.fields, T.StructField("_corrupt_record", T.StringType())])
    df = (spark.read.schema(schema).option("multiLine", multiline)
          .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
          .option("pathGlobFilter", glob).json(path)
          .withColumn("file_name", F.col("_metadata.file_name")))
    # The parse is materialised once (reliable checkpoint in the shared folder):
    # both outputs then come from the same parse, and Spark forbids queries on
    # raw JSON that reference only the corrupt-record column.
    df = cut_lineage(df)
    bad = F.col("_corrupt_record").isNotNull()
    return (df.where(~bad).drop("_corrupt_record"),
            df.where(bad).select("file_name", "_corrupt_record"))


def load_results(spark: SparkSession, csv_path: str | None = None,
                 json_path: str | None = None) -> DataFrame:
    """Flat CSV if given, else the ``detailed_results`` array of the JSON envelope. Either
    is read in splits (``splits.py``), so one large file is many tasks."""
    if csv_path:
        rows = _by_header(splits.csv_records(spark, csv_path))
        # a column with nulls is written as 95.0 by other tools
        return rows.select(*[
            (F.col(f.name).try_cast("double").try_cast("int") if f.name == "confidence"
             else F.col(f.name).try_cast(f.dataType)).alias(f.name) for f in FLAT_RESPONSES.fields])
    found = splits.json_elements(spark, json_path, "detailed_results")
    return found.select(F.from_json("record", RESPONSES).alias("r")).select("r.*")


def _by_header(records: DataFrame) -> DataFrame:
    """A string column for each flat response field, found by each file's header record;
    empty fields are null. Headers are a row for each file. Rows keep the files' order."""
    at = (records.groupBy("file").agg(F.min_by("record", "start").alias("first"), F.min("start").alias("head"))
          .select("file", csv_fields(F.col("first")).alias("header"), "head"))
    rows = (records.join(at, "file").where(F.col("start") > F.col("head"))
            .select("file", "start", "header", F.explode(F.array(csv_fields(F.col("record")))).alias("f")))

    def field(name: str) -> Column:
        place = F.array_position("header", F.lit(name)).cast("int")
        return F.when(place > 0, F.nullif(F.get(F.col("f"), place - 1), F.lit("")))

    return rows.orderBy("file", "start").select(*[field(f.name).alias(f.name) for f in FLAT_RESPONSES.fields])


def scan_summary_maps(spark: SparkSession, path: str) -> DataFrame:
    """Legacy envelope: {accuracy_summary: {set: x}, response_time_summary: {set: x}}
    -> (distractor_set, accuracy, response_time), left-joined on the set."""
    env = T.StructType([T.StructField("accuracy_summary", T.MapType(T.StringType(), T.DoubleType())),
                        T.StructField("response_time_summary",
                                      T.MapType(T.StringType(), T.DoubleType()))])
    df = _json(spark, path, env)
    acc = df.select(F.explode("accuracy_summary").alias("distractor_set", "accuracy"))
    rt = df.select(F.explode("response_time_summary").alias("distractor_set", "response_time"))
    return acc.join(rt, "distractor_set", "left")


def normalize_json(df: DataFrame) -> DataFrame:
    """Flatten one level of struct columns into ``parent.child`` names."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            cols += [F.col(f"`{f.name}`.`{c.name}`").alias(f"{f.name}.{c.name}")
                     for c in f.dataType.fields]
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def gate_dataset(items: DataFrame, min_rows: int = 5) -> DataFrame:
    """One-row quality report: usable iff at least ``min_rows`` parsed rows."""
    ok = F.col("question").isNotNull() & F.col("correct_answer").isNotNull()
    return items.agg(F.sum(ok.cast("int")).alias("valid_rows"),
                     F.sum((~ok).cast("int")).alias("invalid_rows")).withColumn(
        "usable", F.coalesce(F.col("valid_rows"), F.lit(0)) >= min_rows)


def scan_split_csv_pairs(spark: SparkSession, path: str, questions: str = "test.csv",
                         answers: str = "test_answers.csv", naive: bool = False) -> DataFrame:
    """Question CSV and answer CSV of every subject (folder) under ``path`` in one run,
    paired by line position inside the subject (truncated to the shorter), then parsed
    by ``parse_csv_line``. ``questions`` and ``answers`` are file name patterns; files of
    a subject follow each other by name. Blank lines at either end do not count."""
    return _paired(spark, (path, questions), (path, answers), "", naive)


def scan_split_csv_folders(spark: SparkSession, questions_path: str, answers_path: str, prefix: str = "",
                           naive: bool = False) -> DataFrame:
    """``scan_split_csv_pairs`` where questions and answers lie in two trees, each with a
    folder for each subject, named ``prefix`` and the subject."""
    return _paired(spark, (questions_path, None), (answers_path, None), prefix, naive)


def _paired(spark: SparkSession, questions: tuple, answers: tuple, prefix: str, naive: bool) -> DataFrame:
    subject = F.regexp_replace(splits.folder_of(F.col("file")), "^" + prefix, "")

    def lines(side: tuple, name: str) -> DataFrame:
        return splits.numbered_lines(spark, side[0], subject, side[1]).select(
            F.col("source").alias("subject"), "pos", F.col("value").alias(name))

    return parse_csv_line(lines(questions, "line").join(lines(answers, "answer_line"), ["subject", "pos"]),
                          naive, carry=("subject",))


def scan_split_csv_pair(spark: SparkSession, questions_path: str, answers_path: str,
                        subject: str, naive: bool = False) -> DataFrame:
    """``scan_split_csv_pairs`` of one subject by its two paths, each of one file."""
    def lines(path: str, name: str) -> DataFrame:
        return splits.numbered_lines(spark, path, F.lit(subject), single=True).select(
            "pos", F.col("value").alias(name))

    q, a = lines(questions_path, "line"), lines(answers_path, "answer_line")
    return parse_csv_line(q.join(a, "pos"), naive).withColumn("subject", F.lit(subject))


# One RFC 4180 field: quoted (quotes inside written twice) or unquoted.
# Possessive quantifiers keep long quoted fields from deep regex backtracking.
_CSV_FIELD = r'(?:^|,)("(?:[^"]++|"")*+"|[^,]*+)'


def csv_fields(line: Column) -> Column:
    """Fields of one CSV line (RFC 4180 quoting; no field-length limit)."""
    bare = F.when(line.contains("\r"), F.regexp_replace(line, "\r$", "")).otherwise(line)
    raw = F.regexp_extract_all(bare, F.lit(_CSV_FIELD), 1)

    def unquote(f: Column) -> Column:
        inner = F.substr(f, F.lit(2), F.length(f) - 2)
        quoted = f.startswith('"') & f.endswith('"') & (F.length(f) >= 2)
        return F.when(quoted, F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(f)

    return F.transform(raw, unquote)


def parse_csv_line(lines: DataFrame, naive: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """line -> question, options, correct_answer. Naive mode splits on every
    comma and strips quotes; default honours CSV quoting. Rows with fewer
    than 5 fields, a non-integer answer or an out-of-range index are dropped."""
    if naive:
        parts = F.transform(F.split("line", ","), lambda p: F.regexp_replace(p, '^"+|"+$', ""))
    else:
        parts = csv_fields(F.col("line"))
    idx = F.regexp_replace(F.col("answer_line"), r"^\s+|\s+$", "").try_cast("int")
    # as a generator's output the fields are made once; a column's expression would be
    # copied into each condition below
    df = lines.select("pos", *carry, F.explode(F.array(parts)).alias("parts"), idx.alias("idx"))
    opts = F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(1)))
    return (df.where((F.size("parts") >= 5) & F.col("idx").isNotNull() & (F.col("idx") >= 0)
                     & (F.col("idx") < F.size("parts") - 1))
            .select("pos", *carry, F.col("parts")[0].alias("question"), opts.alias("options"),
                    F.element_at(opts, (F.col("idx") + 1).cast("int")).alias("correct_answer")))


def sink_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def sink_csv(df: DataFrame, path: str, drop=("reasoning_text", "reasoning_metrics"),
             mode: str = "overwrite") -> None:
    """CSV drops long / nested text columns, like the evaluator's CSV."""
    keep = [c for c in df.columns if c not in drop
            and not isinstance(df.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType))]
    (df.select(*keep).write.mode(mode).option("header", True).option("quote", '"')
     .option("escape", '"').csv(path))


def sink_parquet(df: DataFrame, path: str, partition_by=(), mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
