"""Queries over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.conversations import cheapest_edits, digests, faults, repaired, summary
from rowloom.llm.queries import query, table

OP12_SQL = r"""
WITH RECURSIVE
-- CRC-32 of `conv_id:turn`, bit by bit.
crcs AS (SELECT *, xor(list_reduce(list_concat([4294967295], [ord(c)::BIGINT for c in string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')]),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT for i in range(8)]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS code
    FROM conversations),
dealt AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text
    FROM crcs, range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM dealt),
marked AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault,
    coalesce(lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] NOT IN ('su', 'ua', 'au'), FALSE) AS illegal FROM ordered),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n FROM marked GROUP BY conv_id),
-- The state before a row (0 nothing yet, 1 after s, 2 after u, 3 after a), what it cost and how: the best way per state; first insertions, then an edit.
next(state, after) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)),
inserted AS (SELECT state AS a, state AS b, 0 AS paid, '' AS letters, '' AS said FROM next UNION ALL SELECT state, after, 2, 'I', CASE after WHEN 2 THEN 'u' ELSE 'a' END FROM next
    UNION ALL SELECT n.state, m.after, 4, 'II', CASE n.after WHEN 2 THEN 'ua' ELSE 'au' END FROM next n JOIN next m ON m.state = n.after
    UNION ALL SELECT n.state, o.after, 6, 'III', CASE n.after WHEN 2 THEN 'uau' ELSE 'aua' END FROM next n JOIN next m ON m.state = n.after JOIN next o ON o.state = m.after),
ways AS (SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit FROM counted
    UNION ALL SELECT conv_id, i + 1, state, best.cost, best.audit FROM (
        SELECT w.conv_id, w.i, e.state, min({'cost': w.cost + n.paid + e.paid, 'audit': w.audit || n.letters || e.letter}) AS best
        FROM ways w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1 JOIN inserted n ON n.a = w.state,
        LATERAL (SELECT n.b AS state, 3 AS paid, 'D' AS letter UNION ALL
            SELECT CASE WHEN m.role[1] = 's' THEN 1 WHEN m.role[1] = 'u' THEN 2 ELSE 3 END, CASE WHEN m.fault = 'truncated' THEN 1 ELSE 0 END, 'K'
            WHERE coalesce(m.fault, '') NOT IN ('blank', 'duplicate') AND ((m.role[1] = 's' AND n.b = 0) OR (m.role[1] = 'u' AND n.b <> 2) OR (m.role[1] = 'a' AND n.b = 2)) UNION ALL
            SELECT CASE WHEN n.b = 2 THEN 3 ELSE 2 END, CASE WHEN m.fault = 'truncated' THEN 3 ELSE 2 END, 'R' WHERE coalesce(m.fault, '') NOT IN ('blank', 'duplicate')) e
        GROUP BY w.conv_id, w.i, e.state)),
closed AS (SELECT conv_id, min({'cost': w.cost + n.paid, 'audit': w.audit || n.letters}) AS best
    FROM ways w JOIN counted c USING (conv_id) JOIN inserted n ON n.a = w.state AND n.b IN (0, 3) WHERE w.i = c.n GROUP BY conv_id
    UNION ALL SELECT NULL, min({'cost': w.cost + n.paid, 'audit': w.audit || n.letters}) FROM ways w JOIN counted c ON c.conv_id IS NULL AND w.conv_id IS NULL
    JOIN inserted n ON n.a = w.state AND n.b IN (0, 3) WHERE w.i = c.n HAVING count(*) > 0),
-- Follow each audit: the row a letter is about, and the state after it.
edits AS (SELECT conv_id, 0::BIGINT AS k, best.audit AS audit, 0::BIGINT AS i, 0 AS state, NULL::VARCHAR AS line FROM closed
    UNION ALL SELECT e.conv_id, k + 1, audit, e.i + (x <> 'I')::INTEGER, CASE x WHEN 'D' THEN e.state WHEN 'K' THEN CASE m.role[1] WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE e.state WHEN 2 THEN 3 ELSE 2 END END,
        CASE x WHEN 'D' THEN NULL WHEN 'K' THEN m.role || ':' || m.text ELSE CASE e.state WHEN 2 THEN 'assistant:' ELSE 'user:' END || CASE x WHEN 'R' THEN m.text ELSE '' END END
    FROM (SELECT *, audit[k + 1] AS x FROM edits WHERE k < length(audit)) e LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM e.conv_id AND m.i = e.i + 1),
hashed AS (SELECT conv_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY k), '')) AS repaired_sha256 FROM edits GROUP BY conv_id),
originals AS (SELECT DISTINCT conv_id FROM conversations)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
    coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM originals o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN closed b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN hashed h ON h.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows spoilt by a checksum of conversation and turn: some dropped, emptied, cut, repeated or given the role of a user."""
    blank = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    code = F.crc32(F.concat(blank["conv_id"], F.lit(":"), blank["turn"])) % 20
    rows = conversations.select("conv_id", "turn", blank["role"].alias("role"), blank["text"].alias("text"), code.alias("code")).filter("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``conversations``: what is wrong with its ``rows``, and their cheapest repair."""
    found = faults(rows)
    repair = digests(repaired(rows, cheapest_edits(found), whole=True))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = conversations.select("conv_id").unionByName(summary(found), allowMissingColumns=True).unionByName(repair, allowMissingColumns=True)
    told = [F.coalesce(F.max(n), F.lit(0).cast("bigint")).alias(n) for n in numbers]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return every.groupBy("conv_id").agg(*told, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), nothing).alias("repaired_sha256"))


@query("op12_path_ranking", OP12_SQL)
def op12(spark, folder):
    conversations = table(spark, folder, "conversations")
    return report(conversations, damaged(conversations))
