"""Session settings and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every session should carry, on a laptop or on a cluster.
CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where a later step then needs a shuffle of its own.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "rowloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the session names it in ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named.rstrip("/")


def work_in(spark: SparkSession, folder: str) -> None:
    """Name the working folder of a session that has none yet."""
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        spark.conf.set("spark.checkpoint.dir", folder)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; every call gives another one."""
    return f"{shared_dir(spark)}/rowloom/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder, read from there."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _store(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder of any store Spark knows; nothing if there is none."""
    store, at = _store(spark, path), _path(spark, path)
    return sorted(status.getPath().getName() for status in store.listStatus(at)) if store.exists(at) else []


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table that Spark writes is whole."""
    return _store(spark, path).exists(_path(spark, f"{path}/_SUCCESS"))


def delete(spark: SparkSession, path: str) -> None:
    _store(spark, path).delete(_path(spark, path), True)
