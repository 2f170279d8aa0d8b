"""A hash order that every engine with md5 can reproduce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_BITS = 60


def bucket(seed: str | int, key: Column | str) -> Column:
    """The first 15 hex digits of ``md5(seed:key)`` as a BIGINT in [0, 2^60)."""
    key = F.col(key) if isinstance(key, str) else key
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def with_row_key(df: DataFrame, name: str = "row_key", copies_per_task: int = 100_000) -> DataFrame:
    """Give rows without an id a unique key: content hash and copy number.

    Copies of a row are interchangeable, so they are counted instead of numbered in a window:
    equal rows collapse before the shuffle, and a row with very many copies is spread over
    tasks again in runs of ``copies_per_task``.
    """
    rows, run, per = "__copies", "__run", copies_per_task
    counted = df.groupBy(*df.columns).agg(F.count("*").alias(rows))
    runs = counted.withColumn(run, F.explode(F.sequence(F.lit(0), F.floor((F.col(rows) - 1) / per))))
    # Only rows with more copies than one run need to move; the others keep their place.
    long = runs.filter(F.col(rows) > per).repartition(*df.columns, run)
    short = runs.filter(F.col(rows) <= per)
    first = F.col(run) * per
    last = F.least(first + per, F.col(rows)) - 1
    content = F.md5(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    return (
        short.unionByName(long)
        .withColumn("__copy", F.explode(F.sequence(first, last)))
        .select(*df.columns, F.concat(content, F.lit("-"), F.col("__copy").cast("string")).alias(name))
    )
