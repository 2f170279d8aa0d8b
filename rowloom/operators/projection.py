"""Column and row selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def filter_with_fallback(df: DataFrame, matches: Column, only: Column | None = None) -> DataFrame:
    """The rows that match; all of them if none does. ``only`` narrows the rows before.

    Whether any row matches is one boolean, read as a scalar subquery.
    """
    rows = df if only is None else df.filter(only)
    hit = F.coalesce(matches, F.lit(False))
    any_hit = F.coalesce(rows.agg(F.bool_or(hit).alias("hit")).scalar(), F.lit(False))
    return rows.filter(hit | ~any_hit)


def prefix_columns(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*[prefix + c for c in df.columns])


def ensure_columns(df: DataFrame, columns: Sequence[str], value: str = "Unknown") -> DataFrame:
    """Exactly these columns; those the table lacks hold ``value``."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(value).alias(c) for c in columns])


def evolve_schema(df: DataFrame, added: T.StructType) -> DataFrame:
    """Add the columns the table does not have yet, as nulls of their type."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in added if f.name not in df.columns}
    return df.withColumns(missing) if missing else df


def nested_or(column: Column, default: str = "Unknown") -> Column:
    return F.coalesce(column.cast("string"), F.lit(default))


def union_pages(pages: Sequence[DataFrame]) -> DataFrame:
    """All rows of all pages; a page may lack columns."""
    if not pages:
        raise ValueError("no pages")
    result = pages[0]
    for page in pages[1:]:
        result = result.unionByName(page, allowMissingColumns=True)
    return result


def normalize_splits(df: DataFrame) -> DataFrame:
    """A table without splits is all train."""
    if "split" not in df.columns:
        return df.withColumn("split", F.lit("train"))
    return df.withColumn("split", F.coalesce("split", F.lit("train")))
