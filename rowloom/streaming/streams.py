"""Operators on streams: training progress kept current, and rendering rows as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.templates import render_train
from rowloom.session import delete, finished, names_in


def read_stream(spark: SparkSession, path: str, kind: str, schema: T.StructType, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return {"parquet": reader.parquet, "jsonl": reader.json}[kind](path)


def latest_values(series: DataFrame, keys: list[str], value: str, ts: str, tie: str) -> DataFrame:
    """The newest value per key. The state is one row per key."""
    return series.groupBy(*keys).agg(F.max(F.struct(ts, tie, value)).alias("last"))


def write_latest(latest: DataFrame, path: str, checkpoint: str) -> None:
    """Run what is available; after each batch there is one snapshot with a row per key.

    A batch merges the keys that changed into the snapshot before it. One that is run again after a failure
    replaces its own snapshot. The snapshot before stays, for readers that have opened it; older ones go.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, keys = batch.sparkSession, [c for c in batch.columns if c != "last"]
        done = [n for n in _snapshots(spark, path) if n < number]
        if done:
            batch = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/snapshot-{done[-1]}"))
        batch.groupBy(*keys).agg(F.max("last").alias("last")).write.mode("overwrite").parquet(f"{path}/snapshot-{number}")
        for old in done[:-1]:
            delete(spark, f"{path}/snapshot-{old}")

    query = (
        latest.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The current value per key, from the newest finished snapshot alone."""
    return spark.read.parquet(f"{path}/snapshot-{_snapshots(spark, path)[-1]}").select(*keys, "last.*")


def _snapshots(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished snapshots, in order."""
    numbers = [int(n.removeprefix("snapshot-")) for n in names_in(spark, path) if n.startswith("snapshot-")]
    return sorted(n for n in numbers if finished(spark, f"{path}/snapshot-{n}"))


def render_stream(stream: DataFrame, template: str, path: str, checkpoint: str) -> None:
    """Render the rows that are available and append them as parquet."""
    query = (
        render_train(stream, template)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
