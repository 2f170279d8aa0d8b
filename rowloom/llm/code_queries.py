"""Queries that compress vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.llm.queries import query, table
from rowloom.llm.vector_codes import PARTS, ROUNDS, books_digest, compress, with_label_errors


def _codes_sql() -> str:
    def assigned(book):
        distance = "list_sum([(part[i] - c[i]) * (part[i] - c[i]) for i in range(1, len(c) + 1)])"
        return f"SELECT p, part, min({{'d': {distance}, 'e': e}}) AS best FROM kinds JOIN {book} USING (p) GROUP BY p, part"

    steps = [
        """kept AS (SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"parts AS (SELECT vec_id, label, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS part FROM kept, range({PARTS}) AS r(p))",
        "kinds AS (SELECT p, part, count(*) AS n FROM parts GROUP BY p, part)",
        "book0 AS (SELECT p, (dense_rank() OVER (ORDER BY vec_id) - 1) AS e, part AS c FROM parts QUALIFY e < 64)",
    ]
    for k in range(ROUNDS):
        steps += [
            f"near{k} AS ({assigned(f'book{k}')})",
            f"""dims{k} AS (SELECT p, best.e AS e, j, floor(sum(n * part[j])::DOUBLE / sum(n)::DOUBLE)::BIGINT AS x
                FROM near{k} JOIN kinds USING (p, part), range(1, len(part) + 1) AS r(j) GROUP BY p, best.e, j)""",
            f"moved{k} AS (SELECT p, e, list(x ORDER BY j) AS c FROM dims{k} GROUP BY p, e)",
            f"book{k + 1} AS (SELECT p, e, coalesce(moved{k}.c, book{k}.c) AS c FROM book{k} LEFT JOIN moved{k} USING (p, e))",
        ]
    steps += [
        f"last AS ({assigned(f'book{ROUNDS}')})",
        f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})",
        """coded AS (SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error
            FROM parts JOIN last USING (p, part) GROUP BY vec_id, label)""",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, digest"


@query("op13_code_trie", _codes_sql())
def op13(spark, folder):
    codes, books = compress(table(spark, folder, "embeddings"))
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
