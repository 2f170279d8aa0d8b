"""Queries over web pages."""

from __future__ import annotations

from rowloom.llm.queries import query, table
from rowloom.llm.warc_zip import round_trip

OP4_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
-- Five hexadecimal digits are four digits to the base of 32.
fives AS (SELECT *, [('0x' || substr(h, i, 5))::BIGINT for i in [1, 6, 11, 16, 21, 26, 31, 36]] AS v FROM p),
named AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
          array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> s) & 31)::INTEGER + 1, 1) for s in [15, 10, 5, 0]], '') for x in v], '') AS payload_digest,
          min(page_id) OVER (PARTITION BY body) AS first FROM fives)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM named
"""


@query("op4_warc_zip", OP4_SQL)
def op4(spark, folder):
    return round_trip(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
