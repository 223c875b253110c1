"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (every row computed, no
row shipped to the driver).  Suites execute both their findings and metrics
tables.  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from driftwatch.plans import registry  # noqa: E402
from driftwatch.plans import findings as fnd  # noqa: E402
from driftwatch.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# Individual operators timed next to the three suites.
OPERATORS = [
    "invalid_zip", "null_violations", "symbol_violations", "price_quartiles", "price_outliers",
    "store_metadata_conflicts", "duplicate_products", "categories_not_in_current",
    "price_change_with_product_id", "stores_with_fewer_rows", "text_symbol_counts", "duplicate_rows",
    "missing_columns", "read_listing_csv",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    scratch = tempfile.mkdtemp(prefix="driftwatch-bench-")
    spark = local_session(CPUS, app="driftwatch-bench",
                          **{"spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
                             "spark.driver.memory": "16g"})
    spark.sparkContext.setCheckpointDir(os.path.join(scratch, "ckpt"))
    qs = registry.queries()
    # Warm-up: JVM, parquet footer cache, codegen classes.
    run(qs["zip_numeric_count"](spark, SF_DIR))

    times = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t0, 3)

    def suite(builder):
        def go():
            res = builder(spark, SF_DIR)
            run(res.findings)
            run(res.metrics)
        return go

    timed("listing_suite", suite(registry.listing_suite))
    timed("review_suite", suite(registry.review_suite))
    timed("stat_suite", suite(registry.stat_suite))
    timed("findings_by_severity", lambda: run(fnd.findings_by_severity(
        registry.listing_suite(spark, SF_DIR).findings)))
    for name in OPERATORS:
        timed(name, lambda n=name: run(qs[n](spark, SF_DIR)))

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec",
                      "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).replace("sf", ""),
                      "cpus": int(CPUS)}))
    spark.stop()


if __name__ == "__main__":
    main()
