"""Numbering rows of any table without a window over a key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rowloom.session import written

# `monotonically_increasing_id` has the number of the partition above this bit.
PART_BITS = 33
ARROW_ROWS = 512


def driver_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows the driver made, as one Arrow batch."""
    kinds = T._parse_datatype_string(schema)
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    arrow = to_arrow_schema(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), kinds)


def positioned(df: DataFrame, order: Sequence[Column] | None = None, name: str = "position") -> DataFrame:
    """Add ``name``: the rows' numbers from 0 on, in ``order``, or in the order in which they are read.

    Rows are range partitioned by the order and, last, a running number: equal rows have any order among
    themselves and are still dealt to several tasks. The sorted rows are written to the shared folder; the counts of the
    tasks, one row each on the driver, shift the numbers inside a task. No window, no row through the driver.
    """
    spark = df.sparkSession
    if order is not None:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = df.withColumn("__spread", F.monotonically_increasing_id())
        df = dealt.repartitionByRange(parts, *order, "__spread").sortWithinPartitions(*order, "__spread").drop("__spread")
    placed = written(df.withColumn("__place", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("__place", PART_BITS)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).orderBy("__part").collect()
    shifts, before = [], 0
    for row in counts:
        # What turns `__place` of this task into a position.
        shifts.append((row["__part"], before - (row["__part"] << PART_BITS)))
        before += row["n"]
    shift = driver_table(spark, shifts, "__of bigint, __shift bigint")
    found = placed.join(F.broadcast(shift), part == F.col("__of"))
    return found.withColumn(name, F.col("__place") + F.col("__shift")).drop("__place", "__of", "__shift")


def running(df: DataFrame, order: Sequence[Column], value: Column, size: str, before: str) -> DataFrame:
    """Add ``size``, made of the sorted rows by ``value``, and ``before``: its total over all earlier rows in ``order``.

    As ``positioned``, with sizes instead of counts: sizes are made after the shuffle, so a costly one is made once, each
    task adds up its own rows, and the totals of the tasks shift them. Rows of size 0 are left out.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("__spread", F.monotonically_increasing_id())
    rows = dealt.repartitionByRange(parts, *order, "__spread").sortWithinPartitions(*order, "__spread").drop("__spread")
    sized = rows.withColumn(size, value.cast("bigint")).filter(F.col(size) > 0)
    schema = T.StructType([*sized.schema.fields, T.StructField(before, T.LongType()), T.StructField("__part", T.IntegerType())])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, so_far = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch.column(size).to_numpy(zero_copy_only=False)
            total = so_far + np.cumsum(sizes)
            own = [pa.array(total - sizes), pa.array(np.full(batch.num_rows, part, np.int32))]
            so_far = int(total[-1]) if len(total) else so_far
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=schema.names)

    # Rows may carry long texts: few at a time, so that a batch fits a worker.
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(batch)
    spark.conf.set(batch, str(ARROW_ROWS))
    try:
        placed = written(sized.mapInArrow(add_up, schema), "running")
    finally:
        spark.conf.set(batch, kept)
    totals = placed.groupBy("__part").agg(F.sum(size).alias("n")).orderBy("__part").collect()
    shifts, total = [], 0
    for row in totals:
        shifts.append((row["__part"], total))
        total += row["n"]
    shift = driver_table(spark, shifts, "__of int, __shift bigint")
    found = placed.join(F.broadcast(shift), F.col("__part") == F.col("__of"))
    return found.withColumn(before, F.col(before) + F.col("__shift")).drop("__part", "__of", "__shift")
