"""Landing tables: write a DataFrame once to the shared checkpoint folder.

A suite runs twenty-odd checks over the same cleaned snapshot.  Writing it
once as parquet under ``spark.checkpoint.dir`` (shared storage on a cluster)
cuts the lineage — a lost executor re-reads files instead of recomputing the
scan, join, cleaning and de-duplication — and lets every later check prune
columns and push filters into a columnar scan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def landing_folder(spark: SparkSession, name: str) -> str:
    """A new folder of the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/driftwatch-landing/{name}-{uuid.uuid4().hex}"


def land(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the checkpoint folder and return a scan of it."""
    path = landing_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def land_delimited(df: DataFrame, name: str, sep: str = ",") -> str:
    """Write ``df`` under the checkpoint folder as delimited files with headers, quoted as in RFC 4180; returns the folder."""
    path = landing_folder(df.sparkSession, name)
    (df.write.mode("overwrite").options(header="true", sep=sep, quote='"', escape='"', ignoreLeadingWhiteSpace="false",
                                        ignoreTrailingWhiteSpace="false").csv(path))
    return path
