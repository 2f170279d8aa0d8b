"""Queries over vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.llm.queries import query, table
from rowloom.llm.vector_file import top_k

OP7_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum([q.e[i] * v.e[i] for i in range(1, len(v.e) + 1)])::BIGINT AS score
           FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op7_vector_file", OP7_SQL)
def op7(spark, folder):
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)
