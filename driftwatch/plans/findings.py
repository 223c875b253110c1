"""Findings and metrics tables, the text report and the bounded sample.

Every check's natural result is mapped to one findings schema, so a suite is a
``unionByName`` of check outputs and every report is a projection of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..profiles import SEVERITY

FINDINGS_SCHEMA = ("check_id string, severity string, column_name string, "
                   "entity_id string, value string, detail string")
METRICS_SCHEMA = ("check_id string, metric string, current_value double, previous_value double, "
                  "measured double, threshold double, status string")
FINDING_COLUMNS = ("check_id", "severity", "column_name", "entity_id", "value", "detail")
METRIC_COLUMNS = ("check_id", "metric", "current_value", "previous_value", "measured", "threshold", "status")


def _s(x) -> Column:
    if x is None:
        return F.lit(None).cast("string")
    if isinstance(x, Column):
        return x.cast("string")
    return F.col(x).cast("string")


def as_findings(df: DataFrame, check_id: str, severity: str, column_name=None,
                entity=None, value=None, detail=None) -> DataFrame:
    """Project a check's result onto the findings schema.

    ``column_name`` is a literal column name or a Column; ``entity``/``value``
    /``detail`` are column names or Columns of ``df``.
    """
    col_name = column_name if isinstance(column_name, Column) else F.lit(column_name).cast("string")
    return df.select(F.lit(check_id).alias("check_id"), F.lit(severity).alias("severity"),
                     col_name.cast("string").alias("column_name"), _s(entity).alias("entity_id"),
                     _s(value).alias("value"), _s(detail).alias("detail"))


def plan_findings(spark: SparkSession, rows) -> DataFrame:
    """Findings known at plan time (missing columns, skipped checks): a handful of rows."""
    return spark.createDataFrame([tuple(r) for r in rows], FINDINGS_SCHEMA)


def union_all(frames, spark: SparkSession, schema: str = FINDINGS_SCHEMA) -> DataFrame:
    frames = [f for f in frames if f is not None]
    if not frames:
        return spark.createDataFrame([], schema)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def metric_rows(df: DataFrame, check_id: str, metric: str, current=None, previous=None,
                measured=None, threshold=None, status=None) -> DataFrame:
    """Project a 1-row (or few-row) check result onto the metrics schema."""
    def d(x):
        if x is None:
            return F.lit(None).cast("double")
        if isinstance(x, (int, float)):
            return F.lit(float(x))
        return (x if isinstance(x, Column) else F.col(x)).cast("double")

    st = F.lit(None).cast("string") if status is None else (
        status if isinstance(status, Column) else F.col(status)).cast("string")
    m = metric if isinstance(metric, Column) else F.lit(metric)
    return df.select(F.lit(check_id).alias("check_id"), m.cast("string").alias("metric"),
                     d(current).alias("current_value"), d(previous).alias("previous_value"),
                     d(measured).alias("measured"), d(threshold).alias("threshold"), st.alias("status"))


def findings_by_severity(findings: DataFrame) -> DataFrame:
    """Findings per (severity, check)."""
    return findings.groupBy("severity", "check_id").agg(F.count(F.lit(1)).alias("n"))


def summary(findings: DataFrame) -> DataFrame:
    """Findings per check."""
    return findings.groupBy("check_id").agg(F.count(F.lit(1)).alias("n"))


def findings_sample(findings: DataFrame, n: int = 5) -> DataFrame:
    """At most ``n`` findings per check, deterministic order (unlike ``show``).

    The window is partitioned by check; the per-check top-n is computed with a
    bounded buffer, and Spark pre-filters per task before the shuffle when it
    can (``WindowGroupLimit``).
    """
    w = Window.partitionBy("check_id").orderBy(
        F.col("entity_id").asc_nulls_first(), F.col("value").asc_nulls_first(),
        F.col("column_name").asc_nulls_first(), F.col("detail").asc_nulls_first())
    return (findings.withColumn("rn", F.row_number().over(w))
                    .where(F.col("rn") <= n).drop("rn"))


def report_lines(findings: DataFrame, keep=()) -> DataFrame:
    """One readable line per finding, after the columns to ``keep``."""
    line = F.format_string(
        "[%s] %s%s%s%s%s",
        F.upper("severity"), F.col("check_id"),
        F.coalesce(F.concat(F.lit(" column="), F.col("column_name")), F.lit("")),
        F.coalesce(F.concat(F.lit(" entity="), F.col("entity_id")), F.lit("")),
        F.coalesce(F.concat(F.lit(" value="), F.col("value")), F.lit("")),
        F.coalesce(F.concat(F.lit(" "), F.col("detail")), F.lit("")))
    return findings.select(*keep, line.alias("line"))


#: Parts of a section, in order; the whole report's first and last lines stand in sections of their own.
HEAD, OUTCOME, METRICS, FINDINGS, TAIL = range(5)
REPORT_FIRST, REPORT_LAST = "===== STARTING VALIDATION =====", "===== VALIDATION COMPLETE ====="


def _number(name: str, label: str) -> Column:
    return F.when(F.col(name).isNotNull(), F.format_string(f" {label}=%.2f", F.col(name))).otherwise("")


def metric_lines(metrics: DataFrame) -> DataFrame:
    """(check_id, line): one readable line per metric."""
    line = F.concat(F.lit("[METRIC] "), F.coalesce("metric", F.lit("")), _number("current_value", "current"),
                    _number("previous_value", "previous"), _number("measured", "measured"), _number("threshold", "threshold"),
                    F.coalesce(F.concat(F.lit(" status="), F.col("status")), F.lit("")))
    return metrics.select("check_id", line.alias("line"))


def report(findings: DataFrame, metrics: DataFrame, checks: list[str]) -> DataFrame:
    """(section, part, line), the report as it reads when sorted by all three.

    ``checks`` names the checks that were run, in the order of their sections; each has a heading, its outcome (a pass line
    if it found nothing), its metrics, all its findings and an end line.  What has an id that isn't among them (a failed
    check, a missing column) gets a section after them, in order of its id.
    """
    spark = findings.sparkSession
    named = spark.createDataFrame([(c, i + 1) for i, c in enumerate(dict.fromkeys(checks))], "check_id string, section int")
    found = (findings.groupBy("check_id").agg(F.count(F.lit(1)).alias("n"), F.max("severity").alias("severity"))
             .unionByName(metrics.select("check_id", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("string").alias("severity")))
             .groupBy("check_id").agg(F.sum("n").alias("n"), F.max("severity").alias("severity")))
    # one row for each check: the number of checks, not of findings
    sections = named.join(found, "check_id", "full").withColumn("n", F.coalesce("n", F.lit(0)))
    later = F.row_number().over(Window.partitionBy(F.col("section").isNull()).orderBy("check_id"))
    sections = sections.withColumn("section", F.coalesce("section", later + F.lit(len(set(checks)))).cast("int"))
    outcome = (F.when(F.col("n") == 0, F.concat(F.lit("[PASS] "), F.col("check_id"), F.lit(": nothing found")))
               .otherwise(F.format_string("[%s] %s: %d found", F.upper("severity"), F.col("check_id"), F.col("n"))))
    frame = sections.select("section", F.explode(F.array(
        _line(HEAD, F.concat(F.lit("----- Start: "), F.col("check_id"), F.lit(" -----"))), _line(OUTCOME, outcome),
        _line(TAIL, F.concat(F.lit("----- End: "), F.col("check_id"), F.lit(" -----"))))).alias("l")).select("section", "l.part", "l.line")
    ids = F.broadcast(sections.select("check_id", "section"))       # as many rows as there are checks
    body = (metric_lines(metrics).select("check_id", F.lit(METRICS).alias("part"), "line")
            .unionByName(report_lines(findings, keep=("check_id",)).select("check_id", F.lit(FINDINGS).alias("part"), "line")))
    ends = spark.createDataFrame([(0, HEAD, REPORT_FIRST), (LAST_SECTION, TAIL, REPORT_LAST)], "section int, part int, line string")
    return frame.unionByName(body.join(ids, "check_id").select("section", "part", "line")).unionByName(ends)


LAST_SECTION = 1_000_000


def _line(part: int, text: Column) -> Column:
    return F.struct(F.lit(part).alias("part"), text.alias("line"))


def write_report(findings: DataFrame, metrics: DataFrame, path: str, checks: list[str] | None = None) -> str:
    """A6 sink: findings and metrics as parquet, plus the text report; overwrite.

    The report is sorted over all its part files: one after the other they read from the first line to the last.
    ``checks``: those that were run (all known ones unless told).
    """
    base = path.rstrip("/")
    findings.write.mode("overwrite").parquet(f"{base}/findings")
    metrics.write.mode("overwrite").parquet(f"{base}/metrics")
    # from the written findings: the checks are not run a second time
    spark = findings.sparkSession
    written = spark.read.schema(findings.schema).parquet(f"{base}/findings")
    measured = spark.read.schema(metrics.schema).parquet(f"{base}/metrics")
    lines = report(written, measured, list(SEVERITY) if checks is None else checks)
    lines.orderBy("section", "part", "line").select("line").write.mode("overwrite").text(f"{base}/report")
    return base
