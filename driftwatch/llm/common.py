"""Helpers shared by the operators of this subpackage.

Conventions that hold for every operator here:

* Only the columns an operator names are read; any further columns of the input
  (also ones that clash with an operator's own output names) are ignored.
* A null ``doc_id`` is a document of its own, ordered before all others.
* Rows that repeat both ``doc_id`` and text are one document; each gets the same
  result row.  Rows that share a ``doc_id`` but not the text are ordered by a hash
  of the text.
"""

from __future__ import annotations

import gc
import sys
import types
import uuid
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.tables import read_table

LEAST_ID = -(2 ** 63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def id_key(name: str = "doc_id") -> Column:
    """The id used for ordering and joins: null becomes the least long."""
    return F.coalesce(F.col(name), F.lit(LEAST_ID))


def land(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage, so a lost executor costs a re-read instead of a re-run, and
    fixes results that later steps read more than once.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.landed_in = path
    return out


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps.

    Spark's cleaner removes them from the executors' disks once the driver's JVM has
    collected the plans; a job of many passes asks for that between them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_landed(df: DataFrame) -> None:
    """Delete the folder of a table that ``land`` returned, once nothing reads it any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df.landed_in)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_cache(key: Hashable, make: Callable[[], object]):
    """The object of one operator, kept by a Python worker across its tasks; another operator's takes its place.

    Functions reach a worker by value, so a global of theirs would last for one task.
    """
    name = "_driftwatch_llm_worker"
    held = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if held.get("key") != key:
        held["made"] = None                      # let go of the old one before the new one is made
        held["key"], held["made"] = key, make()
    return held["made"]


class Remembered:
    """What has been computed, by key, in the plain dictionary ``table``; emptied when keys and values pass ``limit`` bytes.

    ``keep`` tests the limit at each entry.  Entries over ``longest`` bytes aren't kept.
    """

    ENTRY = 160                                  # of the table and the two objects' heads

    def __init__(self, limit: int = 64 << 20, longest: int = 1024):
        self.table: dict = {}
        self.limit, self.longest, self.held = limit, longest, 0

    def clear(self) -> None:
        self.table.clear()
        self.held = 0

    def keep(self, key, value) -> None:
        """``key`` is a string or bytes, ``value`` too or a number."""
        size = len(key) + (0 if isinstance(value, int) else len(value))
        if size > self.longest:
            return
        if self.held + size + self.ENTRY > self.limit:
            self.clear()
        self.held += size + self.ENTRY
        self.table[key] = value


def byte_groups(texts: pa.Array, size: int = 4_000_000) -> Iterator[pa.Array]:
    """Consecutive texts of about so many bytes together."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        upto = int(np.searchsorted(total, size + (total[at - 1] if at else 0))) + 1
        yield texts.slice(at, upto - at)
        at = min(upto, len(texts))


def joined_values(values: pa.Array, codes: pa.Array, bounds: np.ndarray) -> list[bytes]:
    """The values (``large_binary``) of codes[bounds[i]:bounds[i + 1]] one after the other, for each i."""
    flat = values.take(codes)
    joined = memoryview(flat.buffers()[2] or b"")
    at = np.frombuffer(flat.buffers()[1], dtype=np.int64, count=len(flat) + 1)[bounds].tolist() if len(flat) else [0] * len(bounds)
    return [bytes(joined[start:end]) for start, end in zip(at, at[1:])]
