"""Inputs of the registered queries, derived from the given tables.

Each is one SQL text for Spark and for the checking engine. ``@name`` stands for a table,
``#name`` for another input, ``@b(seed;key)`` for the hash bucket, which is the one thing the two
spell differently.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

INPUTS: dict[str, str] = {
    # User turns with the assistant turn that follows.
    "pairs": """
        SELECT u.conv_id * 1000 + u.turn AS row_id, u.text AS instruction, a.text AS response
        FROM @conversations u JOIN @conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant'""",
    # Two stub models: one is mostly right, one mostly gives the question back.
    "predictions": """
        SELECT row_id, 'good' AS run, instruction AS model_input, response AS expected_output,
               CASE WHEN @b(good;row_id) % 10 < 7 THEN response ELSE concat(response, ' ', instruction) END AS prediction,
               CAST(@b(lat;row_id) % 1000 AS DOUBLE) / 1000 AS latency
        FROM #pairs
        UNION ALL
        SELECT row_id, 'weak' AS run, instruction AS model_input, response AS expected_output,
               CASE WHEN @b(weak;row_id) % 10 < 3 THEN response ELSE instruction END AS prediction,
               CAST(@b(slow;row_id) % 1000 AS DOUBLE) / 1000 AS latency
        FROM #pairs""",
    # Documents that bring some splits along.
    "split_documents": """
        SELECT doc_id, text, CASE WHEN @b(given;doc_id) % 10 < 7 THEN 'train' WHEN @b(given;doc_id) % 10 = 7 THEN 'eval'
               WHEN @b(given;doc_id) % 10 = 8 THEN 'test' ELSE 'extra' END AS split
        FROM @documents""",
    "models": """
        SELECT concat('m', p_partkey) AS id, 'huggingface' AS type, 'legacy' AS framework, concat(p_name, ' ', p_brand) AS name,
               CASE WHEN p_size > 25 THEN p_type END AS description, concat('org/', p_name) AS huggingface_model_name
        FROM @part""",
    "datasets": """
        SELECT concat('d', o_orderkey) AS id,
               CASE o_orderkey % 4 WHEN 0 THEN 'huggingface' WHEN 1 THEN 'project_csv' WHEN 2 THEN 'project_json'
                    ELSE 'project_jsonl' END AS type,
               CASE WHEN @b(name;o_orderkey) % 50 = 0 THEN '   ' ELSE concat(' set ', o_custkey) END AS name,
               CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS description,
               CASE WHEN o_orderkey % 4 = 0 THEN concat('org/', o_custkey) END AS huggingface_name,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN @b(end;o_orderkey) % 9 = 0 THEN concat('/data/', o_orderkey, '.txt')
                    WHEN o_orderkey % 4 = 1 THEN concat('/data/', o_orderkey, '.csv')
                    WHEN o_orderkey % 4 = 2 THEN concat('/data/', o_orderkey, '.json')
                    ELSE concat('/data/', o_orderkey, '.jsonl') END AS location,
               concat('["',
                      CASE WHEN @b(f;o_orderkey) % 2 = 0 THEN 'question","' ELSE 'instruction","' END,
                      CASE WHEN @b(f;o_orderkey) % 4 >= 2 THEN 'context","' ELSE '' END,
                      CASE WHEN @b(f;o_orderkey) % 8 >= 4 THEN 'Response","' ELSE '' END,
                      CASE WHEN @b(f;o_orderkey) % 16 >= 8 THEN 'answer","' ELSE '' END,
                      CASE WHEN @b(f;o_orderkey) % 32 >= 16 THEN 'final_toxicity","' ELSE '' END,
                      CASE WHEN @b(f;o_orderkey) % 64 >= 32 THEN 'input","' ELSE '' END,
                      lower(o_orderstatus), '_meta"]') AS features
        FROM @orders""",
    "prompts": """
        SELECT concat('p', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS id, 'in_place' AS type,
               concat('prompt ', l_partkey) AS name, CAST(NULL AS STRING) AS description,
               concat('d', l_orderkey) AS dataset_id,
               concat('Q: {', CASE WHEN l_returnflag = 'A' THEN 'question' ELSE 'instruction' END, '} ',
                      CASE WHEN l_linenumber % 2 = 0 THEN '{context}' ELSE 'plain' END, ' {answer}') AS prompt_template,
               CASE WHEN l_quantity > 48 THEN ' ' ELSE concat('Q: {', lower(l_linestatus), '_meta}') END AS input_template,
               CASE WHEN l_tax > 0 THEN '{answer}' END AS completion_template
        FROM @lineitem""",
    "adapters": """
        SELECT concat('a', c_custkey) AS id, 'project' AS type, replace(c_name, '#', '-') AS name,
               CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS description,
               concat('m', c_custkey * 2) AS model_id, concat('/adapters/', c_nationkey, '/', c_custkey) AS location,
               CASE WHEN c_nationkey > 4 THEN concat('j', c_custkey * 11) END AS fine_tuning_job_id
        FROM @customer""",
    "fine_tuning_jobs": """
        SELECT concat('j', o_orderkey) AS id, concat('m', o_custkey) AS base_model_id, concat('d', o_orderkey) AS dataset_id,
               CAST(o_orderkey % 5 AS INT) AS num_workers, concat('s', o_orderkey) AS cml_job_id,
               concat('a', o_custkey) AS adapter_id, CAST(o_orderkey % 7 AS INT) AS num_cpu,
               CAST(o_custkey % 4 - 1 AS INT) AS num_gpu, CAST(o_custkey % 9 AS INT) AS num_memory,
               CAST(o_orderkey % 6 AS INT) AS num_epochs, CAST(o_custkey % 20 AS DOUBLE) / 8 AS learning_rate,
               CASE WHEN o_orderkey % 3 = 0 THEN concat('c', o_orderkey) END AS axolotl_config_id,
               CAST(o_orderkey % 13 AS DOUBLE) / 10 AS dataset_fraction, CAST(o_custkey % 12 AS DOUBLE) / 10 AS train_test_split,
               CASE o_orderstatus WHEN 'F' THEN 'legacy' WHEN 'O' THEN 'axolotl' ELSE 'other' END AS framework_type,
               CASE WHEN o_orderkey % 10 = 0 THEN concat('my adapter ', o_custkey)
                    ELSE concat('Customer-', lpad(CAST(o_custkey AS STRING), 9, '0')) END AS adapter_name
        FROM @orders""",
    "evaluation_jobs": """
        SELECT concat('e', event_id) AS id, event_type AS type, concat('s', event_id) AS cml_job_id,
               concat('u', user_id) AS parent_job_id, concat('m', event_id % 3000) AS base_model_id,
               concat('d', event_id) AS dataset_id, CAST(event_id % 3 AS INT) AS num_workers,
               CASE WHEN value > 10 THEN concat('a', event_id % 400) END AS adapter_id
        FROM @events""",
    "configs": """
        SELECT concat('c', event_id) AS id, event_type AS type, CAST(NULL AS STRING) AS description,
               CASE @b(cfg;event_id) % 5
                    WHEN 0 THEN concat('{"lr": ', event_id % 20, ', "b": {"k": ', user_id % 5, ', "on": true}}')
                    WHEN 1 THEN concat('{"b":{"on":true,"k":', user_id % 5, '},"lr":', event_id % 20, '}')
                    WHEN 2 THEN concat('{"lr": ', event_id % 20, '.0, "b": {"k": ', user_id % 5, '.0, "on": true}}')
                    WHEN 3 THEN concat('{''lr'': ', event_id % 20, '}')
                    ELSE concat('{"lr": ', event_id % 20) END AS config,
               CASE WHEN user_id % 3 > 0 THEN concat('family-', user_id % 3) END AS model_family,
               CAST(event_id % 2 AS INT) AS is_default
        FROM @events""",
    # Events as metric points; a few lack their time or value.
    "series": """
        SELECT user_id AS run, CASE event_type WHEN 'click' THEN 'epoch' WHEN 'view' THEN 'loss' WHEN 'error' THEN 'eval_loss'
               ELSE event_type END AS key,
               CASE WHEN @b(ts;event_id) % 40 <> 0 THEN ts END AS ts, CASE WHEN @b(v;event_id) % 40 <> 1 THEN value END AS value,
               event_id AS seq
        FROM @events""",
}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

_INPUT = re.compile(r"#(\w+)")
_BUCKET = re.compile(r"@b\((\w+);([\w.]+)\)")
_TABLE = re.compile(r"@(\w+)")


def _expanded(sql: str) -> str:
    while _INPUT.search(sql):
        sql = _INPUT.sub(lambda m: f"({INPUTS[m.group(1)]})" if m.group(1) in INPUTS else f"\0{m.group(1)}", sql)
    return sql.replace("\0", "#")


def for_duckdb(sql: str) -> str:
    sql = _expanded(sql)
    sql = _BUCKET.sub(r"(('0x' || substr(md5('\1:' || CAST(\2 AS VARCHAR)), 1, 15))::BIGINT)", sql)
    return _TABLE.sub(r"\1", sql).strip()


def for_spark(sql: str, source: Callable[[str], str]) -> str:
    sql = _expanded(sql)
    sql = _BUCKET.sub(
        r"CAST(conv(substr(md5(CAST(concat('\1:', CAST(\2 AS STRING)) AS BINARY)), 1, 15), 16, 10) AS BIGINT)", sql
    )
    return _TABLE.sub(lambda m: source(m.group(1)), sql).strip()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """An input by name."""

    def source(table_name: str) -> str:
        # The view is bound when the text below is analysed, so the next call may replace it.
        view = f"given_{table_name}"
        table(spark, folder, table_name).createOrReplaceTempView(view)
        return view

    return spark.sql(for_spark(INPUTS[name], source))
