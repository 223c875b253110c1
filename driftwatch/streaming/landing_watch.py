"""Row rules over snapshot files as they land (Structured Streaming).

The reference validates files in batch; no operator here is new.  This module
runs the same fused row pass (``fused_row_findings``) on every micro-batch of
delimited files arriving in a folder, so a feed is checked as soon as its
file lands.  Row rules are stateless, so no streaming state is kept; each
micro-batch is written with its batch id as a partition and ``overwrite`` of
that partition, which makes a retried batch idempotent.  Group and drift
checks need whole snapshots and stay in the batch suites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import na_to_null
from ..operators.clean import clean_snapshot
from ..operators.row_rules import fused_row_findings
from ..operators.schema import canonical_names
from ..profiles import Profile
from ..sources.csv import READ_OPTIONS


def header_schema(headers) -> StructType:
    """All-string schema for a stream (streams need the schema up front)."""
    return StructType([StructField(h, StringType(), True) for h in headers])


def snapshot_stream(spark: SparkSession, folder: str, headers, profile: Profile, sep: str = ",",
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of canonicalised snapshot rows, tagged by source file.

    Columns are read by position, so repeated headers and headers that share a canonical
    name are kept apart as in ``canonical_names``.
    """
    names, _ = canonical_names(headers, profile)
    reader = (spark.readStream.schema(header_schema(names)).options(**READ_OPTIONS)
                   .option("sep", sep))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.csv(folder)
    return raw.select(*[na_to_null(F.col(f"`{c}`")).alias(c) for c in names],
                      F.col("_metadata.file_path").alias("source_file"))


def start_row_checks(spark: SparkSession, folder: str, headers, profile: Profile, sink: str,
                     checkpoint_location: str, sep: str = ",", available_now: bool = False):
    """Start the query; findings go to ``sink`` partitioned by batch id."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        findings = fused_row_findings(clean_snapshot(batch, profile), profile, extra_keys=("source_file",))
        (findings.withColumn("batch_id", F.lit(batch_id))
                 .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                 .partitionBy("batch_id").parquet(sink))

    w = (snapshot_stream(spark, folder, headers, profile, sep).writeStream
         .foreachBatch(write_batch).option("checkpointLocation", checkpoint_location))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
