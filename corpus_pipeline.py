"""From raw documents to shards of training text, each stage on all that the one before has kept.

Every stage takes the documents as a DataFrame with the columns of ``documents`` and returns the same
columns; only the last adds ``shard`` and ``slot``. Each result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowloom.llm.byte_cnn import accepted
from rowloom.llm.common import written
from rowloom.llm.decontaminate import clean
from rowloom.llm.hamming_join import keep_one
from rowloom.llm.mixing import mixed
from rowloom.llm.resharding import reshard


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters and texts of no recognised language go."""
    return accepted(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share four fifths of their runs of five words, directly or through others, one stays."""
    return keep_one(docs, words=5, percent=80)


def test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; a document may come up to three times or not at all."""
    return mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """24 shards of nearly equal bytes."""
    return reshard(docs, shards=24)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("test_items", test_items),
    ("sources", sources),
    ("shards", shards),
]

# A trained network, signatures and alignments cannot be said in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
