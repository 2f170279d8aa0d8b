"""Running a batch model over a table, for one or for several models."""

from __future__ import annotations

import sys
import time
import types
import uuid
from collections.abc import Callable, Sequence
from typing import Iterator, Tuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.session import finished, fresh_path

# Fixed value: rows per model call.
BATCH_SIZE = 2
# Into how many tables the rows to be answered are cut; at most one of them is lost with the driver.
WAVES = 16

Predict = Callable[[list[str]], Sequence[str]]


def fanout_models(df: DataFrame, models: Sequence[tuple[str, str | None]]) -> DataFrame:
    """Every row once per (model, adapter), by a map-side explode of a literal list."""
    pairs = [
        F.struct(F.lit(model).alias("model"), F.lit(adapter).cast("string").alias("adapter"))
        for model, adapter in models
    ]
    return df.withColumn("__run", F.explode(F.array(*pairs))).select(*df.columns, "__run.model", "__run.adapter")


def batch_predict(
    df: DataFrame,
    prompt: str,
    load: Callable[[str | None, str | None], Predict],
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Add ``prediction`` and ``latency`` (seconds per row of the batch).

    Rows are range partitioned by model, adapter and a hash of the prompt, so a task has one model or
    a few in a row, and a model with most of the rows is split. ``load(model, adapter)`` is called when a worker
    process first meets that pair; the process keeps the last model over all its tasks. Inside a task prompts go by their
    length, so that the rows of a batch are about equally long.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = [c for c in ("model", "adapter") if c in df.columns]
    place = df.withColumn("__place", F.xxhash64(prompt)).repartitionByRange(parts, *runs, "__place")
    df = place.sortWithinPartitions(*runs, F.length(prompt)).drop("__place")
    plan = uuid.uuid4().hex

    def run(batches: Iterator[Tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        # A module of the process outlives the task; what is unpickled with the task does not.
        loaded = sys.modules.setdefault("rowloom_loaded_models", types.ModuleType("rowloom_loaded_models")).__dict__.setdefault("models", {})
        for prompts, models, adapters in batches:
            outputs, seconds = [None] * len(prompts), [0.0] * len(prompts)
            runs = pd.DataFrame({"m": models, "a": adapters}).reset_index(drop=True)
            for (model, adapter), rows in runs.groupby(["m", "a"], dropna=False, sort=False).groups.items():
                name = (plan, None if pd.isna(model) else model, None if pd.isna(adapter) else adapter)
                if name not in loaded:
                    loaded.clear()
                    loaded[name] = load(*name[1:])
                rows = list(rows)
                for at in range(0, len(rows), batch_size):
                    part = rows[at : at + batch_size]
                    began = time.perf_counter()
                    answers = loaded[name]([prompts.iloc[i] for i in part])
                    spent = (time.perf_counter() - began) / len(part)
                    for i, answer in zip(part, answers):
                        outputs[i], seconds[i] = answer, spent
            yield pd.DataFrame({"prediction": outputs, "latency": seconds})

    call = F.pandas_udf(run, "prediction string, latency double")
    model = F.col("model") if "model" in df.columns else F.lit(None).cast("string")
    adapter = F.col("adapter") if "adapter" in df.columns else F.lit(None).cast("string")
    return df.withColumn("__out", call(F.col(prompt), model, adapter)).select("*", "__out.*").drop("__out")


def predict_missing(
    df: DataFrame,
    key: str,
    prompt: str,
    load: Callable[[str | None, str | None], Predict],
    path: str,
    batch_size: int = BATCH_SIZE,
    waves: int = WAVES,
) -> DataFrame:
    """``batch_predict`` that keeps what is finished: rows with an answer below ``path`` are not asked again.

    The rows still missing go in waves, ranges of the hash of their key. A wave's answers are one table, and when it is whole a row in the manifest
    names it; what a lost driver leaves without such a row is never read. A later call leaves out the rows that
    a finished wave answered: same model, adapter, key and prompt, null equal to null. Rows that are alike in these get
    one answer each, as they are asked or left out together. Returns all rows of ``df`` with their answers.
    """
    spark = df.sparkSession
    runs = [c for c in ("model", "adapter") if c in df.columns]
    own = df.columns
    named = df.withColumn("__asked", _asked(runs, key, prompt))
    missing = named
    done = _answers(spark, path, named)
    if done is not None:
        missing = named.join(done.select("__asked").distinct(), "__asked", "left_anti")
    # Written once, so that each wave reads its own rows only.
    wave = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(waves)).cast("int")
    rows = fresh_path(spark, "unanswered")
    missing.withColumn("__wave", wave).write.partitionBy("__wave").parquet(rows)
    schema = T.StructType([*named.schema.fields, T.StructField("__wave", T.IntegerType())])
    todo = spark.read.schema(schema).parquet(rows)
    for number in sorted(r["__wave"] for r in todo.select("__wave").distinct().collect()):
        name = f"wave-{uuid.uuid4().hex}"
        asked = todo.filter(F.col("__wave") == number).drop("__wave")
        batch_predict(asked, prompt, load, batch_size).write.parquet(f"{path}/{name}")
        spark.createDataFrame([(name,)], "wave string").coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    answers = _answers(spark, path, named)
    if answers is None:
        return batch_predict(df.limit(0), prompt, load, batch_size)
    return answers.join(named.select("__asked").distinct(), "__asked", "left_semi").select(*[F.col(f"`{c}`") for c in own], "prediction", "latency")


def _asked(runs: list[str], key: str, prompt: str) -> Column:
    """128 bits that say which model was asked what for which row."""
    fields = [F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate([*runs, key, prompt])]
    return F.unhex(F.md5(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})))


def _answers(spark: SparkSession, path: str, named: DataFrame) -> DataFrame | None:
    """The answers of all finished waves; None before the first."""
    if not finished(spark, f"{path}/manifest"):
        return None
    waves = [r["wave"] for r in spark.read.schema("wave string").parquet(f"{path}/manifest").collect()]
    schema = T.StructType([*named.schema.fields, T.StructField("prediction", T.StringType()), T.StructField("latency", T.DoubleType())])
    return spark.read.schema(schema).parquet(*[f"{path}/{w}" for w in waves]) if waves else None


def strip_prompt(output: Column, prompt: Column) -> Column:
    """The output behind the echoed prompt."""
    return F.substring(output, F.length(prompt) + 1, F.lit(2**31 - 1))


def side_by_side(df: DataFrame, key: str, run: str, runs: Sequence[str], value: str = "prediction") -> DataFrame:
    """One column per run; the runs are named up front, so no extra job looks for them."""
    return df.groupBy(key).pivot(run, list(runs)).agg(F.first(value))
