"""Queries that filter, mix and store the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.llm.decontaminate import contaminated
from rowloom.llm.mixing import fair_mix
from rowloom.llm.queries import query, table
from rowloom.llm.resharding import RECORD_BYTES, reshard


@query("op1_reshard")
def op1(spark, folder):
    stored = reshard(table(spark, folder, "documents"), shards=24)
    return stored.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + RECORD_BYTES).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op2_decontaminate")
def op2(spark, folder):
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


OP3_SQL = r"""
WITH words AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM words GROUP BY source),
weighed AS (SELECT source, s, 1 + (r - 1) % 3 AS w FROM sources),
ordered AS (SELECT *, s::DOUBLE / w AS ratio, sum(s) OVER (ORDER BY s::DOUBLE / w, r2 ROWS UNBOUNDED PRECEDING) - s AS full_before,
                   sum(w) OVER (ORDER BY s::DOUBLE / w, r2 ROWS UNBOUNDED PRECEDING) - w AS w_before
            FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS r2 FROM weighed)),
-- The sources with the least words per weight are full; the level is that of the first one that is not.
levels AS (SELECT ((SELECT sum(s) FROM weighed) - 3 * full_before)::DOUBLE / ((SELECT sum(w) FROM weighed) - w_before)::DOUBLE AS level, ratio, r2 FROM ordered),
level AS (SELECT coalesce((SELECT level FROM levels WHERE level <= 3 * ratio ORDER BY ratio, r2 LIMIT 1), 0) AS level),
targets AS (SELECT source, s, least(w * level, 3.0::DOUBLE * s) AS target FROM weighed, level),
-- Every source three times over, each copy with the words of its source up to its end over the target; all in that order, cut at all words.
queued AS (SELECT doc_id, size, s, target, row_number() OVER (ORDER BY words.source NULLS LAST, md5('mix:' || coalesce(doc_id::VARCHAR, '')), doc_id, size) AS r,
                  sum(size) OVER (PARTITION BY words.source ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS begun
           FROM words JOIN targets ON words.source IS NOT DISTINCT FROM targets.source),
copies AS (SELECT r, size, c, (c * s + begun + size)::DOUBLE / target AS finish FROM queued, range(3) AS t(c) WHERE size > 0 AND target > 0),
stream AS (SELECT r, size, sum(size) OVER (ORDER BY finish, r, c ROWS UNBOUNDED PRECEDING) - size AS earlier FROM copies),
served AS (SELECT r, sum(greatest(0, least(size, budget - earlier))) AS taken FROM stream, (SELECT round(sum(target))::BIGINT AS budget FROM targets) GROUP BY r)
SELECT doc_id, size, s AS source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM queued LEFT JOIN served USING (r)
"""


@query("op3_fair_mix", OP3_SQL)
def op3(spark, folder):
    return fair_mix(table(spark, folder, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken")
