"""Delimited files with quoted line breaks, read by all cores (A2, A4).

Spark's ``multiLine`` reader gives a file to one task.  Here lines are read as text, which splits, and one narrow pass
(``layout``) counts quotes to find out which of three ways a set of files can be read:

* ``plain``: no record holds a line break, so the splittable line reader gives the same rows;
* ``broken``: some do; ``records`` puts their lines together again, and every record is parsed by itself;
* ``irregular``: quotes don't follow RFC 4180 (``12" pipe``, an unclosed quote), so counting them proves nothing.

A line's state (inside or outside a quoted field at its start) is the parity of the quotes before it in its file: the
parity of the ranges before (one row for each range, summed up along the file) plus the parity of the lines before it
in its range.  A record that crosses ranges belongs to the last range before in which a record begins.

Line breaks are ``\\n`` or ``\\r\\n``; a lone ``\\r`` is data.  Blank lines outside quotes are no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PLAIN, BROKEN, IRREGULAR = "plain", "broken", "irregular"
RANGE = ("file", "start")


def file_lines(spark: SparkSession, path) -> DataFrame:
    """(file, start, place, value): every line with the byte range it was read from and its place there."""
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                    F.monotonically_increasing_id().alias("place"), "value"))


def _odd(line: Column) -> Column:
    return F.length(F.regexp_replace(line, '[^"]+', "")) % 2


def _regular(line: Column, sep: str, inside: bool) -> Column:
    """Whether every quote of a line opens a field, closes one, or is half of a doubled one.

    Doubled quotes and whole quoted fields are taken out; what may be left is one quote that opens a field and isn't
    closed on the line.  A line that begins inside a field is given the quote that opened it.
    """
    s = "\\Q" + sep + "\\E"
    t = F.regexp_replace(line, '""', "")
    if inside:
        t = F.concat(F.lit('"'), t)
    rest = F.regexp_replace(t, f'(?<=^|{s})"[^"]*"(?={s}|\\r?$)', "")
    return ~F.contains(rest, F.lit('"')) | rest.rlike(f'(?s)^(?:[^"]*{s})?"[^"]*$')


def layout(spark: SparkSession, path, sep: str) -> str:
    """How the files under ``path`` can be read; one row reaches the driver."""
    lines = file_lines(spark, path)
    v, quoted = F.col("value"), F.contains("value", F.lit('"'))
    odd = F.when(quoted, _odd(v)).otherwise(0)
    each = lines.select(*RANGE, odd.alias("odd"), (quoted & ~_regular(v, sep, False)).alias("bad"),
                        F.contains(F.regexp_replace(v, "\\r$", ""), F.lit("\r")).alias("cr"))
    found = each.agg(F.max("odd").alias("odd"), F.max("bad").alias("bad"), F.max("cr").alias("cr")).first()
    if not found["odd"] and not found["cr"]:
        return IRREGULAR if found["bad"] else PLAIN
    placed = with_state(lines)
    wrong = quoted & F.when(F.col("inside") == 1, ~_regular(v, sep, True)).otherwise(~_regular(v, sep, False))
    unclosed = ranges(lines).groupBy("file").agg((F.sum("odd") % 2).alias("odd")).agg(F.max("odd").alias("open")).first()
    if unclosed["open"] or placed.agg(F.max(wrong).alias("wrong")).first()["wrong"]:
        return IRREGULAR
    return BROKEN


def _in_range(lines: DataFrame) -> DataFrame:
    """Adds ``odd`` and ``before``: the parity of the quotes on a line, and on the lines before it in its range."""
    w = Window.partitionBy(*RANGE).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return (lines.withColumn("odd", _odd(F.col("value")))
            .withColumn("before", F.coalesce(F.sum("odd").over(w), F.lit(0)) % 2))


def ranges(lines: DataFrame) -> DataFrame:
    """One row for each byte range with a line: its state at the start, and the last range before where a record begins.

    ``begins``: records that begin in it.  ``owner``, ``owner_begins``: that last range and its ``begins``.
    """
    r = _in_range(lines).groupBy(*RANGE).agg((F.sum("odd") % 2).alias("odd"),
                                             F.sum(F.when(F.col("before") == 0, 1).otherwise(0)).alias("if_out"),
                                             F.sum(F.when(F.col("before") == 1, 1).otherwise(0)).alias("if_in"))
    w = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("state", F.coalesce(F.sum("odd").over(w), F.lit(0)) % 2)
    r = r.withColumn("begins", F.when(F.col("state") == 0, F.col("if_out")).otherwise(F.col("if_in")))
    here = F.when(F.col("begins") > 0, F.struct(F.col("start").alias("s"), F.col("begins").alias("b")))
    r = r.withColumn("last", F.last(here, ignorenulls=True).over(w))
    return r.select(*RANGE, "odd", "state", "begins", F.col("last.s").alias("owner"), F.col("last.b").alias("owner_begins"))


def with_state(lines: DataFrame) -> DataFrame:
    """Adds ``inside``: 1 for lines that begin within a quoted field; and the columns of ``ranges``."""
    return (_in_range(lines).join(ranges(lines).drop("odd"), list(RANGE))
            .withColumn("inside", (F.col("state") + F.col("before")) % 2))


def records(spark: SparkSession, path) -> DataFrame:
    """(file, start, record, text): one row for each record; ``record`` counts from 1 in the range where it begins.

    Lines that are whole records pass straight through; only lines of broken records are grouped, by record.
    """
    w = Window.partitionBy(*RANGE).orderBy("place")
    own = F.sum(F.when(F.col("inside") == 0, 1).otherwise(0)).over(w)
    lines = with_state(file_lines(spark, path)).withColumn("own", own)
    crossing = F.col("own") == 0
    lines = lines.select("file", F.when(crossing, F.col("owner")).otherwise(F.col("start")).alias("start"),
                         F.when(crossing, F.col("owner_begins")).otherwise(F.col("own")).alias("record"),
                         F.col("start").alias("at"), "place", "value", "inside", "odd")
    alone = (F.col("inside") == 0) & (F.col("odd") == 0)
    whole = lines.where(alone & (F.trim(F.regexp_replace("value", "\\r$", "")) != "")).select("file", "start", "record", F.col("value").alias("text"))
    parts = F.sort_array(F.collect_list(F.struct("at", "place", "value")))
    joined = (lines.where(~alone).groupBy("file", "start", "record").agg(parts.alias("parts"))
              .select("file", "start", "record", F.array_join(F.col("parts.value"), "\n").alias("text")))
    return whole.unionByName(joined).withColumn("text", F.regexp_replace("text", "\\r$", ""))


def read_broken(spark: SparkSession, path, schema: StructType, options: dict) -> DataFrame:
    """Rows of files whose records hold line breaks, and ``_file``; the first record of each file is its header."""
    body = records(spark, path).where(~((F.col("start") == 0) & (F.col("record") == 1)))
    row = F.from_csv("text", _ddl(schema), options)
    return body.select("file", row.alias("r")).select(*[F.col(f"r.`{c.replace('`', '``')}`") for c in schema.names], F.col("file").alias("_file"))


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` string" for n in schema.names)
