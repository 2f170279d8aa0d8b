"""Reading datasets and listing their features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.operators.projection import normalize_splits
from rowloom.sources.records import JsonScan, first_record, keys_of, read_csv_records, read_json_records, read_table_records

# A quote inside a quoted field is doubled.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}


def read_dataset(
    spark: SparkSession,
    path: str,
    kind: str,
    schema: T.StructType | str | None = None,
    multiline: bool = False,
    whole_files: bool = False,
) -> DataFrame:
    """A dataset with a ``split`` column; without splits every row is train.

    ``kind`` is csv, json (a file holds an array of objects, or one object), jsonl or parquet; a
    parquet dataset may be partitioned by ``split``. Give ``schema`` to save the pass that infers
    it. Every file is read by many tasks. JSON files, and CSV files with line breaks inside fields (``multiline=True``), are cut
    into records first, in the shared folder; with ``whole_files`` Spark's own reader takes them, a task for each file.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv" and multiline and not whole_files:
        inferred = {} if schema is not None else {"inferSchema": "true"}
        df = read_csv_records(spark, path, CSV_OPTIONS | inferred, schema)
    elif kind == "csv":
        reader = reader.options(**CSV_OPTIONS, multiLine=str(multiline).lower())
        if schema is None:
            reader = reader.option("inferSchema", "true")
        df = reader.csv(path)
    elif kind == "json" and not whole_files:
        df = read_json_records(spark, path, schema)
    elif kind == "json":
        df = reader.option("multiLine", "true").json(path)
    elif kind == "jsonl":
        df = reader.json(path)
    elif kind == "parquet":
        df = reader.parquet(path)
    else:
        raise ValueError(f"cannot load a dataset of kind '{kind}'")
    return normalize_splits(df)


def dataset_features(spark: SparkSession, path: str, kind: str) -> list[str]:
    """Column names in source order, from the header, the first record or the file footer."""
    if kind == "csv":
        return spark.read.options(**CSV_OPTIONS, multiLine="true").csv(path).columns
    if kind == "parquet":
        return [c for c in spark.read.parquet(path).columns if c != "split"]
    if kind == "jsonl":
        record = spark.read.text(path).filter(F.length(F.trim("value")) > 0).limit(1)
        keys = record.select(F.json_object_keys("value")).first()
    elif kind == "json":
        record = first_record(spark, path, JsonScan())
        keys = [keys_of(record)] if record else None
    else:
        raise ValueError(f"cannot list features of a dataset of kind '{kind}'")
    if keys is None or not keys[0]:
        raise ValueError(f"no record with columns in {path}")
    return list(keys[0])


def record_features(df: DataFrame, record: str) -> DataFrame:
    """The features of each record of a table of JSON texts, in their order."""
    return df.withColumn("features", F.json_object_keys(F.col(record)))


def parsed_features(df: DataFrame, features: str) -> DataFrame:
    """Replace a JSON list of names by an array."""
    return df.withColumn(features, F.from_json(F.col(features), "array<string>"))


def read_split_orient(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of files that hold ``{"columns": [...], "data": [[...], ...]}`` each.

    Values are found by the position of their column name and cast to the schema. A file that is
    not such a table is an error. Every file is read by many tasks.
    """
    rows = read_table_records(spark, path)
    at = lambda name: F.nullif(F.array_position("columns", F.lit(name)), F.lit(0)).cast("int")
    return rows.select(
        *[F.try_element_at("row", at(f.name)).cast(f.dataType).alias(f.name) for f in schema]
    )


def format_catalog(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """One row per format of documents that map a key to name, description and columns.

    A file is one document, or with ``multiline=False`` every line is.
    """
    entry = "struct<name: string, description: string, format: map<string, string>>"
    docs = spark.read.schema(f"dataset_formats map<string, {entry}>").option("multiLine", multiline).json(path)
    return docs.select(F.explode("dataset_formats").alias("key", "f")).select(
        "key", "f.name", "f.description", F.map_keys("f.format").alias("columns")
    )
