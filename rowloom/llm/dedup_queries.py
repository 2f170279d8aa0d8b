"""Queries that find repeated text."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.llm.hamming_join import near_duplicates
from rowloom.llm.line_runs import drop_repeated_lines
from rowloom.llm.queries import query, table

OP6_SQL = r"""
WITH each AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM each),
repeated AS (SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT keyed.*, repeated.k IS NOT NULL AND doc_id <> holder AS gone FROM keyed LEFT JOIN repeated USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op6_line_runs", OP6_SQL)
def op6(spark, folder):
    found = drop_repeated_lines(table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH RECURSIVE
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
           ELSE list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS whole FROM runs GROUP BY doc_id),
classes AS (SELECT whole, min(doc_id) AS c, any_value(n) AS n FROM sizes GROUP BY whole),
sets AS (SELECT c, s FROM classes JOIN runs ON doc_id = c),
pairs AS (SELECT x.c AS a, y.c AS b, count(*) AS i FROM sets x JOIN sets y ON x.s = y.s AND x.c < y.c GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN classes p ON p.c = a JOIN classes q ON q.c = b WHERE 100 * i >= 80 * (p.n + q.n - i)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT c, c FROM classes UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.b),
parts AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(p.m, d.doc_id)::BIGINT AS component_id, coalesce(p.m, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN classes USING (whole) LEFT JOIN parts p ON p.a = classes.c
"""


@query("op9_hamming_join", OP9_SQL)
def op9(spark, folder):
    return near_duplicates(table(spark, folder, "documents"), words=4, percent=80).drop("text_hash")
