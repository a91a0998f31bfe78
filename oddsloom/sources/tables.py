"""Table scans and sinks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def league_rows(
    matches: DataFrame, leagues: Sequence[str] | None = None, before: date | str | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Played rows, filtered and pruned so that both reach the file scan."""
    rows = matches.filter(F.col("fthg").isNotNull() & F.col("ftag").isNotNull())
    if leagues is not None:
        rows = rows.filter(F.col("league").isin(list(leagues)))
    if before is not None:
        rows = rows.filter(F.col("date") < F.lit(str(before)).cast("date"))
    return rows.select(*columns) if columns else rows


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a parquet table. Rows are clustered by the partition columns first, so that every
    task writes few files; the number of files per partition value still follows the data size."""
    writer = df.repartition(*partition_by, F.pmod(F.xxhash64(*df.columns), F.lit(8))) if partition_by else df
    out = writer.write.mode("overwrite")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
