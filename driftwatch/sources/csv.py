"""Delimited snapshot reader (A1-A5).

Reads any Hadoop-FS path with Spark's CSV source, all columns as strings
(no schema inference pass), doubled-quote escaping as in RFC 4180, and maps
the NA tokens of pandas' reader to null so both readers agree on "empty".
Headers are canonicalised through the profile's alias map in one rename.
"""

from __future__ import annotations

import csv as pycsv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import na_to_null
from ..operators.schema import standardize_columns
from ..profiles import Profile
from . import quoted

READ_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "mode": "PERMISSIVE",
    "inferSchema": "false",
}

#: The same for a record held in a column; line breaks are data there.
PARSE_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true", "lineSep": "\n"}


def first_line(spark: SparkSession, path) -> str | None:
    """The first line of ``path`` (one line reaches the driver)."""
    row = spark.read.text(path).limit(1).first()
    return None if row is None else row["value"]


def delimiter_from_line(line: str | None) -> str:
    """A1 on one line held by the driver: ``|`` wins over tab wins over comma.

    The same rule as ``operators.schema.delimiter_of``, which applies it to a
    column of lines.
    """
    if line and "|" in line:
        return "|"
    if line and "\t" in line:
        return "\t"
    return ","


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """A1: delimiter of the first line of ``path``."""
    return delimiter_from_line(first_line(spark, path))


def header_names(line: str | None, sep: str) -> list:
    """Header fields of a header line, repeated names suffixed ``.1``, ``.2``…

    Spark renames repeated header names by appending their position, which
    would cost the first of them its alias; this keeps the first as is, as
    pandas does.
    """
    if line is None:
        return []
    fields = next(pycsv.reader([line], delimiter=sep, quotechar='"'), [])
    seen: dict = {}
    out = []
    for f in fields:
        key = f.lower()                 # Spark's names do not tell case apart
        if key in seen:
            seen[key] += 1
            out.append(f"{f}.{seen[key]}")
        else:
            seen[key] = 0
            out.append(f)
    return out


CORRUPT_COL = "_corrupt_record"
SOURCE_FILE = "source_file"


def read_delimited(spark: SparkSession, path: str, sep: str | None = None,
                   multiline: bool = False, partitions: int | None = None,
                   keep_malformed: bool = False, source_file: bool = False) -> DataFrame:
    """A2-A4: all-string delimited scan, NA tokens -> null.

    ``multiline``: records may hold quoted line breaks.  The files are then looked through once (``quoted.layout``): where
    no record holds one, they are read line by line; where some do, the records are put together by all cores; only files
    whose quotes are irregular are left to Spark's multi-line reader (one task per file), whose rows are spread afterwards
    (over ``partitions``, or the session's parallelism).
    ``keep_malformed`` reads in PERMISSIVE mode with a corrupt-record column
    (``_corrupt_record``) holding the raw text of rows whose field count is
    wrong, so they can be reported rather than silently padded with nulls.
    ``source_file`` adds a column of that name: the file of each row.
    """
    line = first_line(spark, path)
    sep = sep or delimiter_from_line(line)
    names = header_names(line, sep)
    distinct = bool(names) and len(set(names)) == len(names)
    how = quoted.PLAIN
    if multiline:
        # a header that holds a line break, or repeats a name in another case, is left to Spark's reader
        how = quoted.layout(spark, path, sep) if distinct and line.count('"') % 2 == 0 else quoted.IRREGULAR
    if how == quoted.BROKEN:
        schema = _schema(names, keep_malformed)
        df = quoted.read_broken(spark, path, schema, PARSE_OPTIONS | {"sep": sep, "columnNameOfCorruptRecord": CORRUPT_COL})
        file = F.col("_file")
    else:
        whole = how == quoted.IRREGULAR
        reader = (spark.read.options(**READ_OPTIONS).option("sep", sep)
                       .option("multiLine", "true" if whole else "false"))
        if keep_malformed and distinct:
            df = (reader.schema(_schema(names, True)).option("enforceSchema", "true")
                        .option("columnNameOfCorruptRecord", CORRUPT_COL).csv(path))
        else:
            df = reader.csv(path)
            if len(names) == len(df.columns) and distinct:
                df = df.toDF(*names)
        file = F.col("_metadata.file_path")
        if whole:
            df = df.withColumn("_file", file).repartition(partitions or spark.sparkContext.defaultParallelism)
            file = F.col("_file")
    kept = [c for c in df.columns if c != "_file"]
    return df.select(*[(F.col(f"`{c}`") if c == CORRUPT_COL else na_to_null(F.col(f"`{c}`"))).alias(c)
                       for c in kept], *([file.alias(SOURCE_FILE)] if source_file else []))


def _schema(names, keep_malformed: bool) -> StructType:
    extra = [CORRUPT_COL] if keep_malformed else []
    return StructType([StructField(n, StringType(), True) for n in [*names, *extra]])


def read_snapshot(spark: SparkSession, path: str, profile: Profile, sep: str | None = None,
                  multiline: bool = False, keep_malformed: bool = False, source_file: bool = False):
    """Read one snapshot and canonicalise its header: ``(df, collisions)``."""
    df = read_delimited(spark, path, sep, multiline, keep_malformed=keep_malformed, source_file=source_file)
    extra = [c for c in (CORRUPT_COL, SOURCE_FILE) if c in df.columns]
    if not extra:
        return standardize_columns(df, profile)
    body, collisions = standardize_columns(df.drop(*extra), profile)
    return df.toDF(*body.columns, *extra), collisions


def read_snapshots(spark: SparkSession, current: str, previous: str, profile: Profile,
                   sep: str | None = None, per_file_delimiter: bool = False,
                   multiline: bool = False, keep_malformed: bool = False):
    """A5: both snapshots; the current file's delimiter is used for both unless
    ``per_file_delimiter``."""
    sep_c = sep or detect_delimiter(spark, current)
    sep_p = sep or (detect_delimiter(spark, previous) if per_file_delimiter else sep_c)
    cur, col_c = read_snapshot(spark, current, profile, sep_c, multiline, keep_malformed)
    prev, col_p = read_snapshot(spark, previous, profile, sep_p, multiline, keep_malformed)
    return cur, prev, col_c + col_p


#: Different headers of one folder at most: each costs a scan of its own in the plan.
MAX_HEADERS = 200


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): the header line of every file under ``path``.

    Only the first block of a file can hold it; of that the line that comes first is taken.
    """
    lines = (spark.read.option("recursiveFileLookup", "true").text(path)
             .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value",
                     F.monotonically_increasing_id().alias("place")))
    return (lines.where("start = 0").groupBy("file").agg(F.min(F.struct("place", "value")).alias("first"))
            .select("file", F.col("first.value").alias("line")))


def read_folder(spark: SparkSession, path: str, profile: Profile, multiline: bool = False, keep_malformed: bool = False):
    """A folder of delimited files with headers of their own as one snapshot: ``(df, collisions)``.

    Files are grouped by their header line; each group is read with its own delimiter and alias map, and the groups are united by
    canonical name (columns that a group lacks are null).  ``source_file`` names each row's file.  The driver holds the
    files' names and header lines, as it does for any listing of files.
    """
    groups = file_headers(spark, path).groupBy("line").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("line").collect()
    if not groups:
        raise ValueError(f"no file with a header under {path}")
    if len(groups) > MAX_HEADERS:
        raise ValueError(f"{len(groups)} different headers under {path}; at most {MAX_HEADERS} are read together")
    out, collisions = None, []
    for g in groups:
        df, own = read_snapshot(spark, g["files"], profile, delimiter_from_line(g["line"]), multiline, keep_malformed, True)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        collisions += [c for c in own if c not in collisions]
    return out, collisions


def csv_round_trip(df: DataFrame, columns, sep: str = ",") -> DataFrame:
    """Serialise rows with ``to_csv`` and parse them back with ``from_csv``.

    The same parser options as the file reader, applied to data held in a
    column; used to check quoting and NA handling on whole tables.
    """
    opts = {"sep": sep, "quote": '"', "escape": '"'}
    schema = ", ".join(f"`{c}` string" for c in columns)
    line = F.to_csv(F.struct(*[F.col(c) for c in columns]), opts)
    parsed = F.from_csv(line, schema, opts)
    return df.select(parsed.alias("r")).select(*[na_to_null(F.col(f"r.`{c}`")).alias(c) for c in columns])
