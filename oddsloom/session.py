"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "oddsloom", cores: str | None = None) -> SparkSession:
    """A session for tests and the local bench; a cluster passes its own session instead."""
    cpus = cores or os.environ.get("BENCH_CPUS") or "8"
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables: the shared one that spark.checkpoint.dir names.

    Without it a local session takes a fresh temporary folder; on a cluster that would be another
    folder on each machine, so there it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured and not current:
        spark.sparkContext.setCheckpointDir(configured)
    elif not current:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="oddsloom-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder so that its plan restarts from files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


_KEPT: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Cache a frame that several branches of a plan read. Lost blocks are rebuilt from the plan."""
    kept = df.persist()
    _KEPT.append(kept)
    return kept


def release_kept() -> None:
    """Drop the caches that ``keep`` made so far."""
    while _KEPT:
        _KEPT.pop().unpersist()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate files, inside the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` over all cores ahead of Python work.

    The rows are few bytes but much computation, so the size-based coalescing of small shuffles
    would leave most cores idle; an explicit partition count is kept as it is.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(max(cores * 3, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
