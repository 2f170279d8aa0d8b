"""The seven registry tables and their snapshots."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Rows of a snapshot's file at most: a packed file is read by one task.
FILE_ROWS = 1 << 20

# Table and column names of the registry.
SCHEMAS: dict[str, str] = {
    "models": (
        "id string, type string, framework string, name string, description string, huggingface_model_name string, "
        "location string, cml_registered_model_id string, mlflow_experiment_id string, mlflow_run_id string"
    ),
    "datasets": (
        "id string, type string, name string, description string, huggingface_name string, location string, "
        "features string"
    ),
    "adapters": (
        "id string, type string, name string, description string, huggingface_name string, model_id string, "
        "location string, fine_tuning_job_id string, prompt_id string, cml_registered_model_id string, "
        "mlflow_experiment_id string, mlflow_run_id string"
    ),
    "prompts": (
        "id string, type string, name string, description string, dataset_id string, prompt_template string, "
        "input_template string, completion_template string"
    ),
    "fine_tuning_jobs": (
        "id string, base_model_id string, dataset_id string, prompt_id string, num_workers int, cml_job_id string, "
        "adapter_id string, num_cpu int, num_gpu int, num_memory int, num_epochs int, learning_rate double, "
        "out_dir string, training_arguments_config_id string, model_bnb_config_id string, "
        "adapter_bnb_config_id string, lora_config_id string, training_arguments_config string, "
        "model_bnb_config string, adapter_bnb_config string, lora_config string, dataset_fraction double, "
        "train_test_split double, user_script string, user_config_id string, framework_type string, "
        "axolotl_config_id string, gpu_label_id int, adapter_name string"
    ),
    "evaluation_jobs": (
        "id string, type string, cml_job_id string, parent_job_id string, base_model_id string, dataset_id string, "
        "prompt_id string, num_workers int, adapter_id string, num_cpu int, num_gpu int, num_memory int, "
        "evaluation_dir string, model_bnb_config_id string, adapter_bnb_config_id string, "
        "generation_config_id string, model_bnb_config string, adapter_bnb_config string, generation_config string"
    ),
    "configs": "id string, type string, description string, config string, model_family string, is_default int",
}

# Referencing table and column, referenced table.
EDGES = (
    ("adapters", "model_id", "models"),
    ("adapters", "fine_tuning_job_id", "fine_tuning_jobs"),
    ("adapters", "prompt_id", "prompts"),
    ("prompts", "dataset_id", "datasets"),
    ("fine_tuning_jobs", "base_model_id", "models"),
    ("fine_tuning_jobs", "dataset_id", "datasets"),
    ("fine_tuning_jobs", "prompt_id", "prompts"),
    ("fine_tuning_jobs", "adapter_id", "adapters"),
    ("fine_tuning_jobs", "training_arguments_config_id", "configs"),
    ("fine_tuning_jobs", "model_bnb_config_id", "configs"),
    ("fine_tuning_jobs", "adapter_bnb_config_id", "configs"),
    ("fine_tuning_jobs", "lora_config_id", "configs"),
    ("fine_tuning_jobs", "user_config_id", "configs"),
    ("fine_tuning_jobs", "axolotl_config_id", "configs"),
    ("evaluation_jobs", "base_model_id", "models"),
    ("evaluation_jobs", "dataset_id", "datasets"),
    ("evaluation_jobs", "prompt_id", "prompts"),
    ("evaluation_jobs", "adapter_id", "adapters"),
    ("evaluation_jobs", "model_bnb_config_id", "configs"),
    ("evaluation_jobs", "adapter_bnb_config_id", "configs"),
    ("evaluation_jobs", "generation_config_id", "configs"),
)


def check_table(table: str) -> str:
    if table not in SCHEMAS:
        raise ValueError(f"the registry has no table '{table}'")
    return SCHEMAS[table]


def columns_of(table: str) -> list[tuple[str, str]]:
    """Names and types of a registry table."""
    return [tuple(part.split()) for part in check_table(table).split(",")]


def as_table(df: DataFrame, table: str) -> DataFrame:
    """The columns of a registry table, absent ones as nulls."""
    return df.select(
        *[(F.col(n) if n in df.columns else F.lit(None)).cast(kind).alias(n) for n, kind in columns_of(table)]
    )


def export_snapshot(tables: Mapping[str, DataFrame], path: str, compression: str = "lz4") -> None:
    """Each table as packed JSON lines with its nulls, and its schema beside it.

    Every line repeats all names, so packed lines take a seventh of their bytes. Spark reads ``lz4`` for as little work as
    plain lines; ``gzip`` takes half of that and is for readers other than Spark.
    """
    for table, df in tables.items():
        check_table(table)
        lines = df.write.mode("overwrite").options(ignoreNullFields="false", compression=compression, maxRecordsPerFile=FILE_ROWS)
        lines.json(f"{path}/{table}/data")
        spark = df.sparkSession
        spark.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{path}/{table}/schema"
        )


def read_snapshot(spark: SparkSession, path: str, table: str) -> DataFrame:
    check_table(table)
    written = spark.read.text(f"{path}/{table}/schema", wholetext=True).first()["value"]
    return spark.read.schema(T.StructType.fromJson(json.loads(written))).json(f"{path}/{table}/data")


def export_compact(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Every row of every table as (table, record), with nulls left out of the record."""
    parts = [
        df.select(F.lit(table).alias("table"), F.to_json(F.struct(*df.columns)).alias("record"))
        for table, df in tables.items()
        if check_table(table)
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def import_snapshot(spark: SparkSession, path: str, current: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables of a written snapshot merged into the current ones.

    The folders of the snapshot say which tables it has; an unknown one is refused before anything
    is read. A table that is not current yet consists of the snapshot's rows.
    """
    folders = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path).select("path")
    names = sorted({row["path"].rstrip("/").split("/")[-3] for row in folders.collect()})
    for name in names:
        check_table(name)
    merged = dict(current)
    for name in names:
        incoming = read_snapshot(spark, path, name)
        merged[name] = merge_snapshot(name, current[name] if name in current else incoming.limit(0), incoming)
    return merged


def merge_snapshot(table: str, current: DataFrame, incoming: DataFrame, position: str | None = None) -> DataFrame:
    """Current rows and the incoming rows with new ids.

    Of incoming rows with one id the first by ``position`` is taken; without a position, the
    first in the order of all columns.
    """
    check_table(table)
    columns = current.columns
    order = F.col(position) if position else F.to_json(F.struct(*incoming.columns))
    row = F.struct(*[c for c in incoming.columns if c != position])
    # Only rows with new ids are reduced, in the order the join has put them: an order within an id would sort them all again.
    new = incoming.join(current.select("id"), "id", "left_anti")
    added = new.groupBy("id").agg(F.min_by(row, F.struct(order)).alias("__row")).select("__row.*")
    return current.unionByName(added, allowMissingColumns=True).select(*columns)
