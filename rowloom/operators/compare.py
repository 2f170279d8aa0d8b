"""Bringing the results of several runs together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.templates import INPUT_FIELD, OUTPUT_FIELD

# Fixed value: marks columns that the user asked to carry along.
USER_MARK = "_$useradded$"


def join_results(source: DataFrame, results: DataFrame, key: str = "row_id") -> DataFrame:
    """Metrics back to their source rows, by row key, so equal texts do not multiply."""
    return source.join(results, key)


def compare_aggregates(reports: DataFrame, run: str, runs: Sequence[str]) -> DataFrame:
    """One row per metric that every run has, one score column per run."""
    scores = [F.max(F.when(F.col(run) == r, F.col("score"))).alias(r) for r in runs]
    present = [F.bool_or(F.col(run) == r).alias(f"__in_{i}") for i, r in enumerate(runs)]
    return _in_all(reports.groupBy("metric").agg(*scores, *present), len(runs))


def _in_all(wide: DataFrame, n_runs: int) -> DataFrame:
    """Rows that every run has, without the columns that say so."""
    flags = [f"__in_{i}" for i in range(n_runs)]
    for flag in flags:
        wide = wide.filter(F.col(flag))
    return wide.drop(*flags)


def compare_rows(
    source: DataFrame, results: DataFrame, run: str, runs: Sequence[str], metrics: Sequence[str], key: str = "row_id"
) -> DataFrame:
    """One row per source row that every run has, one column ``metric run`` per metric and run.

    The narrow metric columns are pivoted first; the texts travel once, in the final join.
    """
    named = {f"__{i}_{j}": f"{m} {r}" for i, r in enumerate(runs) for j, m in enumerate(metrics)}
    cells = [
        F.max(F.when(F.col(run) == r, F.col(m))).alias(f"__{i}_{j}")
        for i, r in enumerate(runs)
        for j, m in enumerate(metrics)
    ]
    present = [F.bool_or(F.col(run) == r).alias(f"__in_{i}") for i, r in enumerate(runs)]
    wide = _in_all(results.groupBy(key).agg(*cells, *present), len(runs))
    return source.join(wide.withColumnsRenamed(named), key)


def mark_user_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: c + USER_MARK for c in columns})


def unmark_user_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: c.split(USER_MARK)[0] for c in df.columns if USER_MARK in c})


def eval_select(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The columns an evaluation keeps: those asked for, the input and the expected output."""
    return df.select(*extra, INPUT_FIELD, OUTPUT_FIELD)


def first_non_null(df: DataFrame, parent: str, value: str, position: str) -> DataFrame:
    """Per parent the first value in list order that is not null."""
    present: Column = F.when(F.col(value).isNotNull(), F.col(position))
    return df.groupBy(parent).agg(F.min_by(value, present).alias(value))
