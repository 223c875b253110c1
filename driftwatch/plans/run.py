"""Entry points with the shape of the reference's: paths in, report path out.

``run_validation`` (price listings, two snapshots), ``run_review_validation``
(store reviews), ``validate_data`` (one snapshot) and ``run_stat_validation``
(the statistical suite).  Each reads the delimited files with the snapshot
reader, runs the suite's checks one by one (one that fails costs no other its
findings) and writes findings, metrics and the text report under ``output_path`` (any Hadoop-FS path); the path is returned.

``previous_state`` names a folder that an earlier run wrote as its ``state_out``; the previous snapshot's file is then not
read.
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from ..operators.state import SnapshotState, read_state, state_of, write_state
from ..profiles import Profile, listing_profile, review_profile
from ..sources.csv import read_snapshot, read_snapshots
from . import isolation as iso
from . import suite as su
from .findings import plan_findings, write_report


def _collision_findings(spark, collisions):
    if not collisions:
        return None
    return plan_findings(spark, [("header_collision", "warning", canon, None, header, f"renamed to {new}")
                                 for header, canon, new in collisions])


def _write(spark, res: su.SuiteResult, collisions, output_path: str) -> str:
    """Each check by itself under ``checks``, then findings, metrics and the report from what these wrote."""
    extra = _collision_findings(spark, collisions)
    parts = res.parts + ([] if extra is None else [iso.ready(extra, "header_collision")])
    checks = f"{output_path.rstrip('/')}/checks"
    iso.write_parts(spark, parts, checks)
    return write_report(*iso.written(spark, parts, checks), output_path, iso.check_ids(parts))


def _snapshots(spark, current: str, previous: str | None, profile: Profile, multiline: bool, previous_state: str | None,
               state_out: str | None) -> tuple[DataFrame, DataFrame | SnapshotState, list]:
    """Both snapshots, the previous one as read or as kept; the current one's state is written where asked for."""
    if (previous is None) == (previous_state is None):
        raise ValueError("name either the previous snapshot or its state")
    if previous_state is None:
        cur, prev, collisions = read_snapshots(spark, current, previous, profile, multiline=multiline, keep_malformed=True)
    else:
        cur, collisions = read_snapshot(spark, current, profile, multiline=multiline, keep_malformed=True)
        prev = read_state(spark, previous_state, profile)
    if state_out is not None:
        write_state(state_of(cur, profile), state_out, profile)
    return cur, prev, collisions


def run_validation(spark: SparkSession, current: str, previous: str | None, country: str,
                   output_path: str, ftype: str = "FRG", multiline: bool = True,
                   previous_state: str | None = None, state_out: str | None = None) -> str:
    """Price-listing suite on two snapshot files (feed type ``ftype``)."""
    profile = listing_profile(country=country, feed_type=ftype)
    cur, prev, collisions = _snapshots(spark, current, previous, profile, multiline, previous_state, state_out)
    return _write(spark, su.listing_suite(cur, prev, profile), collisions, output_path)


def validate_data(spark: SparkSession, input_path: str, output_path: str, country: str,
                  ftype: str = "FRG", multiline: bool = True) -> str:
    """Single-snapshot form of the price-listing suite."""
    profile = listing_profile(country=country, feed_type=ftype)
    cur, collisions = read_snapshot(spark, input_path, profile, multiline=multiline, keep_malformed=True)
    return _write(spark, su.listing_suite(cur, None, profile), collisions, output_path)


def run_review_validation(spark: SparkSession, current: str, previous: str | None, country: str,
                          output_path: str, multiline: bool = True,
                          previous_state: str | None = None, state_out: str | None = None) -> str:
    """Store-review suite on two snapshot files."""
    profile = review_profile(country=country)
    cur, prev, collisions = _snapshots(spark, current, previous, profile, multiline, previous_state, state_out)
    return _write(spark, su.review_suite(cur, prev, profile), collisions, output_path)


def run_stat_validation(spark: SparkSession, current: str, previous: str | None, output_path: str,
                        as_of: dt.date | None = None, country: str = "USA", multiline: bool = True,
                        previous_state: str | None = None, state_out: str | None = None) -> str:
    """Statistical suite; ``as_of`` defaults to today (the month under check)."""
    profile = listing_profile(country=country)
    cur, prev, collisions = _snapshots(spark, current, previous, profile, multiline, previous_state, state_out)
    res = su.stat_suite(cur, prev, profile, as_of or dt.date.today())
    return _write(spark, res, collisions, output_path)


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="python -m driftwatch", description=__doc__)
    ap.add_argument("suite", choices=["listing", "single", "review", "stat"])
    ap.add_argument("current")
    ap.add_argument("previous", nargs="?")
    ap.add_argument("--out", required=True)
    ap.add_argument("--country", default="USA")
    ap.add_argument("--ftype", default="FRG")
    ap.add_argument("--single-line", action="store_true",
                    help="no quoted line breaks in the files: large files are then split over tasks")
    ap.add_argument("--previous-state", help="state of the previous snapshot, in place of its file")
    ap.add_argument("--state-out", help="where to keep the current snapshot's state for the next run")
    ap.add_argument("--as-of", type=dt.date.fromisoformat, default=None)
    a = ap.parse_args(argv)
    multi = not a.single_line
    kept = {"previous_state": a.previous_state, "state_out": a.state_out}
    if a.suite == "single" and any(kept.values()):
        ap.error("a single snapshot is compared with nothing and keeps no state")
    spark = SparkSession.builder.appName("driftwatch").getOrCreate()
    if a.suite == "listing":
        out = run_validation(spark, a.current, a.previous, a.country, a.out, a.ftype, multi, **kept)
    elif a.suite == "single":
        out = validate_data(spark, a.current, a.out, a.country, a.ftype, multi)
    elif a.suite == "review":
        out = run_review_validation(spark, a.current, a.previous, a.country, a.out, multi, **kept)
    else:
        out = run_stat_validation(spark, a.current, a.previous, a.out, a.as_of, a.country, multi, **kept)
    print(out)
