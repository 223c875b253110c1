"""Session helpers: a local session for tests/bench and the shared checkpoint dir.

Library code never creates a session; callers pass theirs in.  The helpers here
are for tests, the bench and command-line use.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", app: str = "driftwatch", **conf) -> SparkSession:
    """A local session configured for checks on small and medium data."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        # Wide rule projections generate methods just over HotSpot's 8000-byte
        # JIT limit; let the JIT compile them (on a cluster: executor options).
    )
    if os.environ.get("DRIFTWATCH_JIT_HUGE", "1") != "0":
        builder = (builder.config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
                          .config("spark.executor.extraJavaOptions", "-XX:-DontCompileHugeMethods"))
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is left
    as it is.  Only when it is unset (local tests) a scratch folder is made.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:          # Spark Connect: the server owns checkpointing
        sc = None
    sc_dir = sc.getCheckpointDir() if sc is not None else None
    if conf_dir:
        if sc is not None and not sc_dir:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if sc_dir:
        return sc_dir
    if sc is not None and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="driftwatch-ckpt-", dir=os.environ.get("DRIFTWATCH_SCRATCH"))
    if sc is not None:
        sc.setCheckpointDir(path)
    try:
        spark.conf.set("spark.checkpoint.dir", path)
    except Exception:          # core conf locked at runtime: the context setting suffices
        pass
    return path
