"""Writing results per run, and reading the runs that are wanted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CSV_WRITE = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_results(df: DataFrame, path: str, run: str = "run") -> None:
    """Parquet, one folder per run; a run written again replaces its folder only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)


def read_results(spark: SparkSession, path: str, runs: Sequence[str] | None = None, run: str = "run") -> DataFrame:
    """All results, or those of some runs, for which only their folders are read."""
    df = spark.read.parquet(path)
    return df if runs is None else df.filter(F.col(run).isin(*runs))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV_WRITE).csv(path)
