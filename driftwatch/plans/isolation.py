"""Error isolation per check (M6): a check that fails costs its own findings and no others.

A suite is a list of ``Part``s, one for each check's findings or metrics.  A part makes its frame when asked, so
an error in planning stays with it; ``write_parts`` runs each part as a job of its own with its own folder, so an
error while running does too.  Either becomes one ``check_failed`` finding with the check's id and the error.

A folder's name depends only on the part's place and check, and is overwritten as a whole: running a suite again,
or after a lost driver, gives the same folders, and a check that failed can be run again alone (``only``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..profiles import SEVERITY
from .findings import FINDINGS_SCHEMA, METRICS_SCHEMA, as_findings, metric_rows, plan_findings, union_all

#: What a check may raise without ending the suite; anything else (a stopped session, a full driver) isn't the check's.
CHECK_ERRORS = (PySparkException, Py4JJavaError, ValueError, TypeError, KeyError, ArithmeticError)
DETAIL_CHARS = 500


@dataclass(frozen=True)
class Part:
    """Findings or metrics of one check, made on demand.  ``instead``: what is run if a part of several checks fails."""

    kind: str                       # "findings" or "metrics"
    check_id: str
    make: Callable[[], DataFrame]
    instead: tuple["Part", ...] = ()


def _frame(df) -> DataFrame:
    return df() if callable(df) else df


def finding(df, check_id: str, **columns) -> Part:
    """``df`` is a frame or what makes one; ``columns`` as in ``as_findings``."""
    return Part("findings", check_id, lambda: as_findings(_frame(df), check_id, SEVERITY[check_id], **columns))


def metric(df, check_id: str, name, **columns) -> Part:
    return Part("metrics", check_id, lambda: metric_rows(_frame(df), check_id, name, **columns))


def ready(df: DataFrame, check_id: str) -> Part:
    """A frame that has the findings schema already."""
    return Part("findings", check_id, lambda: df)


def once(make: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
    """``make`` that is run once for all parts that share its frame."""
    held: list[DataFrame] = []

    def get() -> DataFrame:
        if not held:
            held.append(make())
        return held[0]

    return get


def check_ids(parts: Iterable[Part]) -> list[str]:
    """The checks of a suite in the order in which they are run; a part of several checks stands for each."""
    return list(dict.fromkeys(i for p in parts for i in ([e.check_id for e in p.instead] or [p.check_id])))


def error_text(error: BaseException) -> str:
    """One line: the error's class and message, without the stack."""
    if isinstance(error, Py4JJavaError):
        message = str(error.java_exception.toString())
    else:
        message = str(error)
    lines = [x.strip() for x in message.splitlines() if x.strip() and not x.strip().startswith(("at ", "JVM stacktrace"))]
    return f"{type(error).__name__}: {' '.join(lines)}"[:DETAIL_CHARS]


def failed(spark: SparkSession, check_id: str, error: BaseException) -> DataFrame:
    """The finding that stands for a check that couldn't be done: ``value`` is its id, ``detail`` the error."""
    return plan_findings(spark, [("check_failed", SEVERITY["check_failed"], None, None, check_id, error_text(error))])


def _alive(spark: SparkSession) -> bool:
    return not spark.sparkContext._jsc.sc().isStopped()


def planned(spark: SparkSession, parts: Iterable[Part]) -> tuple[DataFrame, DataFrame]:
    """Lazy (findings, metrics) of all parts; those that can't be planned are ``check_failed`` rows."""
    out: dict[str, list[DataFrame]] = {"findings": [], "metrics": []}
    for part in parts:
        try:
            out[part.kind].append(part.make())
        except CHECK_ERRORS as error:
            out["findings"].append(failed(spark, part.check_id, error))
    return union_all(out["findings"], spark), union_all(out["metrics"], spark, METRICS_SCHEMA)


def folder(base: str, n: int, part: Part) -> str:
    return f"{base.rstrip('/')}/{part.kind}/{n:03d}-{re.sub('[^A-Za-z0-9_-]', '_', part.check_id)}"


def _attempt(spark: SparkSession, part: Part, path: str) -> list[tuple[str, BaseException]]:
    """Write one part; the (check id, error) of what failed.  The folder is left whole in any case."""
    try:
        part.make().write.mode("overwrite").parquet(path)
        return []
    except CHECK_ERRORS as raised:
        if not _alive(spark):
            raise
        error = raised
    schema = FINDINGS_SCHEMA if part.kind == "findings" else METRICS_SCHEMA
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)       # also clears what was written before
    if not part.instead:
        return [(part.check_id, error)]
    return [e for k, each in enumerate(part.instead) for e in _attempt(spark, each, f"{path}/{k:03d}")]


def write_parts(spark: SparkSession, parts: list[Part], base: str, only: set[str] | None = None) -> list[str]:
    """Run each part by itself and write it to its folder under ``base``; returns the ids of the checks that failed.

    ``only``: ids of the parts to run (again); the other folders stay as they are.
    """
    broken: list[str] = []
    for n, part in enumerate(parts):
        if only is not None and part.check_id not in only:
            continue
        errors = _attempt(spark, part, folder(base, n, part))
        broken += [i for i, _ in errors]
        rows = union_all([failed(spark, i, e) for i, e in errors], spark)
        rows.write.mode("overwrite").parquet(f"{base.rstrip('/')}/failed/{n:03d}")
    return broken


def written(spark: SparkSession, parts: list[Part], base: str) -> tuple[DataFrame, DataFrame]:
    """(findings, metrics) of the folders that ``write_parts`` wrote."""
    at = {kind: [folder(base, n, p) for n, p in enumerate(parts) if p.kind == kind] for kind in ("findings", "metrics")}
    at["findings"] += [f"{base.rstrip('/')}/failed/{n:03d}" for n in range(len(parts))]

    def read(kind: str, schema: str) -> DataFrame:
        if not at[kind]:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*at[kind])

    return read("findings", FINDINGS_SCHEMA), read("metrics", METRICS_SCHEMA)
