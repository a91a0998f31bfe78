"""Files in the shared folder that the cluster names in spark.checkpoint.dir.

Tables between two jobs are Parquet written and read by Spark. Files of a format of its own are opened by the
tasks through pyarrow's file systems, so the folder may be local to all, HDFS or an object store.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_folder


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run's files."""
    return scratch_folder(spark, name)


_passing: list[list[str]] = []


@contextmanager
def passing_tables() -> Iterator[None]:
    """Tables settled inside are deleted at the end, but those that a result is read from (``stays``): within another
    such block these pass with that one."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            fs, place = file_system(path)
            fs.delete_dir(place)


def settled(df: DataFrame, name: str, stays: bool = False, small_pages: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there and lost executors lose none of it. ``small_pages``: for
    large rows; a page's size is looked at after each row, not after a hundred, which a codec would need buffers for."""
    path = folder(df.sparkSession, name)
    checks = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"} if small_pages else {}
    df.write.options(**checks).parquet(path)
    owners = _passing[: -1 if stays else None]
    if owners:
        owners[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def local_path(uri: str) -> str | None:
    """The path to map into memory where the shared folder is mounted on every machine, else None."""
    fs, path = file_system(uri)
    return path if isinstance(fs, pafs.LocalFileSystem) and os.path.exists(path) else None
