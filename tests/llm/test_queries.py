"""The registered queries of the package on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
import check
from rowloom.llm import queries as llm

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
COLUMNS = {
    "op1_reshard": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op2_decontaminate": ["doc_id", "item_id", "score", "from_word", "to_word"],
    "op5_pseudo_likelihood": ["doc_id", "n_tokens", "log_prob", "mean_log_prob"],
    "op8_byte_cnn": ["doc_id", "held_out", "lang_pred", "score"],
    "op11_simple8b": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op10_secret_novelty": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
}


@pytest.fixture(scope="module")
def connection():
    found = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    yield found
    found.close()


def test_each_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in llm.QUERIES) == list(range(1, 14))
    assert {*llm.QUERIES, "pipeline"} <= set(driver.queries()) and set(llm.ORACLES) | set(COLUMNS) == set(llm.QUERIES)


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_equals_its_sql(spark, connection, name):
    told = check.compare(spark, connection, FOLDER, name)
    assert told.startswith("same") and "TYPES" not in told, told


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_has_all_documents(spark, name):
    found = driver.queries()[name](spark, FOLDER)
    assert found.columns == COLUMNS[name]
    rows = found.collect()
    want = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
    have = [r["doc_id"] for r in rows]
    assert set(have) <= want if name.startswith("op2_") else sorted(have) == sorted(want)


def test_held_out_accuracy_on_given_documents(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = [r for r in driver.queries()["op8_byte_cnn"](spark, FOLDER).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in found) >= 0.95 * len(found)
