"""Samples, splits and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.functions.hashing import with_row_key
from rowloom.operators import packing, sample_packing, sampling
from rowloom.plans import query
from rowloom.plans.fixtures import given, table
from rowloom.session import fresh_path

FRACTION, SPLIT, EVAL_FRACTION = 0.7, 0.8, 0.1


def ranked_sql(source: str, key: str, salt: str, columns: str, where: str = "TRUE") -> str:
    bucket = f"('0x' || substr(md5('{salt}:' || CAST({key} AS VARCHAR)), 1, 15))::BIGINT"
    return (
        f"SELECT {columns}, row_number() OVER (ORDER BY {bucket}, CAST({key} AS VARCHAR)) AS r, COUNT(*) OVER () AS n "
        f"FROM {source} WHERE {where}"
    )


def up(share: float) -> str:
    return f"CAST(ceil((1.0::DOUBLE - {share}::DOUBLE) * n) AS BIGINT)"


DOCS = "doc_id, text, source"
SAMPLED = f"SELECT {DOCS} FROM ({ranked_sql('@documents', 'doc_id', '42:frac', DOCS)}) WHERE r > {up(FRACTION)}"
SPLIT_DOCS = (
    f"SELECT {DOCS}, CASE WHEN r <= {up(SPLIT)} THEN 'test' ELSE 'train' END AS split "
    f"FROM ({ranked_sql('@documents', 'doc_id', '42:split', DOCS)})"
)
BOTH = (
    f"SELECT {DOCS}, CASE WHEN r <= {up(SPLIT)} THEN 'test' ELSE 'train' END AS split "
    f"FROM ({ranked_sql(f'({SAMPLED})', 'doc_id', '42:split', DOCS)})"
)


@query("downsample", SAMPLED)
def downsample(spark, sf):
    return sampling.downsample(table(spark, sf, "documents").select("doc_id", "text", "source"), "doc_id", FRACTION)


@query("train_test_split", SPLIT_DOCS)
def train_test_split(spark, sf):
    return sampling.train_test_split(table(spark, sf, "documents").select("doc_id", "text", "source"), "doc_id", SPLIT)


@query(
    "holdout",
    f"""SELECT conv_id, turn, CASE WHEN r <= {up(0.95)} THEN 'test' ELSE 'train' END AS split
        FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY ('0x' || substr(md5('42:split:' || k), 1, 15))::BIGINT, k) AS r, COUNT(*) OVER () AS n
              FROM (SELECT *, concat(conv_id, '-', turn) AS k FROM @conversations))""",
)
def holdout(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("k"))
    return sampling.holdout(turns, "k", 0.05).drop("k")


@query(
    "split_precedence",
    f"""SELECT doc_id, 'train' AS split FROM ({ranked_sql('#split_documents', 'doc_id', '42:frac', 'doc_id', "split = 'train'")}) WHERE r > {up(FRACTION)}
        UNION ALL SELECT doc_id, 'test' FROM #split_documents WHERE split = 'eval'""",
)
def split_precedence(spark, sf):
    docs = given(spark, sf, "split_documents").select("doc_id", "split")
    return sampling.sample_and_split(docs, "doc_id", FRACTION, SPLIT)


@query("sample_and_split", BOTH)
def sample_and_split(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source", F.lit("train").alias("split"))
    return sampling.sample_and_split(docs, "doc_id", FRACTION, SPLIT)


@query(
    "eval_sample",
    f"""SELECT doc_id, text FROM ({ranked_sql('@documents', 'doc_id', '420:eval', 'doc_id, text')})
        WHERE r <= CAST(round_even({EVAL_FRACTION}::DOUBLE * n, 0) AS BIGINT)""",
)
def eval_sample(spark, sf):
    return sampling.eval_sample(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", EVAL_FRACTION)


@query(
    "split_params",
    """WITH j AS (SELECT *, row_number() OVER (PARTITION BY adapter_name ORDER BY id) AS rn FROM #fine_tuning_jobs)
       SELECT a.id AS adapter_id, coalesce(j.dataset_fraction, 1.0::DOUBLE) AS dataset_fraction,
              coalesce(j.train_test_split, 0.9::DOUBLE) AS train_test_split
       FROM #adapters a LEFT JOIN j ON j.adapter_name = a.name AND j.rn = 1""",
)
def split_params(spark, sf):
    return sampling.split_params(given(spark, sf, "adapters"), given(spark, sf, "fine_tuning_jobs"))


@query(
    "leakage",
    f"""WITH s AS ({SPLIT_DOCS})
        SELECT 'row_key' AS "check", COUNT(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM s WHERE split = 'train')) AS leaked_rows, COUNT(*) AS test_rows
        FROM s WHERE split = 'test'
        UNION ALL
        SELECT 'text', COUNT(*) FILTER (WHERE text IN (SELECT text FROM s WHERE split = 'train')), COUNT(*) FROM s WHERE split = 'test'""",
)
def leakage(spark, sf):
    return sampling.leakage(train_test_split(spark, sf), "doc_id", F.col("text"))


LINES = """SELECT l_orderkey, l_linenumber, concat(md5(concat('{"l_orderkey":', l_orderkey, ',"l_linenumber":', l_linenumber, '}')), '-',
        row_number() OVER (PARTITION BY l_orderkey, l_linenumber) - 1) AS row_key FROM @lineitem"""


@query(
    "sample_without_key",
    f"""SELECT l_orderkey, l_linenumber, row_key
        FROM ({ranked_sql(f'({LINES})', 'row_key', '42:frac', 'l_orderkey, l_linenumber, row_key')}) WHERE r > {up(FRACTION)}""",
)
def sample_without_key(spark, sf):
    # The two columns are no key: a line number occurs more than once per order.
    keyed = with_row_key(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))
    path = fresh_path(spark, "keyed")
    keyed.write.parquet(path)
    return sampling.downsample(spark.read.parquet(path), "row_key", FRACTION)


@query("split_sizes", f"SELECT split, COUNT(*) AS n_rows FROM ({BOTH}) GROUP BY split")
def split_sizes(spark, sf):
    return sampling.split_sizes(sample_and_split(spark, sf))


LENGTH = packing.SHORT_BLOCK
TOKENS = """
    t AS (SELECT @b(pack;doc_id) AS h, doc_id, list_append(regexp_extract_all(text, '\\S+'), '</s>') AS tokens FROM @documents),
    u AS (SELECT h, doc_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS i FROM t),
    p AS (SELECT *, row_number() OVER (ORDER BY h, doc_id, i) - 1 AS pos FROM u)"""


def _packed_sql(length: int) -> str:
    return f"""WITH {TOKENS}
        SELECT pos // {length} AS block, COUNT(*) AS n_tokens, COUNT(DISTINCT doc_id) AS n_pieces,
               md5(string_agg(token, ' ' ORDER BY pos)) AS content FROM p GROUP BY 1"""


def _packed(spark, sf, length):
    packed = packing.pack_sequences(table(spark, sf, "documents"), "doc_id", "text", length)
    content = F.md5(F.array_join("tokens", " ")).alias("content")
    return packed.select("block", "n_tokens", F.col("n_pieces").cast("bigint").alias("n_pieces"), content)


@query("pack_sequences", _packed_sql(packing.SHORT_BLOCK))
def pack_sequences(spark, sf):
    return _packed(spark, sf, packing.SHORT_BLOCK)


@query("pack_long_sequences", _packed_sql(packing.LONG_BLOCK))
def pack_long_sequences(spark, sf):
    return _packed(spark, sf, packing.LONG_BLOCK)


@query(
    "dropped_tokens",
    f"""WITH {TOKENS}
        SELECT COUNT(*) AS n_tokens, COUNT(*) // {LENGTH} AS n_blocks, COUNT(*) % {LENGTH} AS dropped FROM p""",
)
def dropped_tokens(spark, sf):
    return packing.dropped_tokens(table(spark, sf, "documents"), "text", LENGTH)


@query(
    "split_repeated_keys",
    """WITH n AS (SELECT COUNT(*) AS n FROM @lineitem)
       SELECT n - CAST(ceil(n * (1.0::DOUBLE - 0.7::DOUBLE)) AS BIGINT) AS n_train, CAST(ceil(n * (1.0::DOUBLE - 0.7::DOUBLE)) AS BIGINT) AS n_test FROM n""",
)
def split_repeated_keys(spark, sf):
    """Order keys repeat over the lines of an order; the sizes are exact all the same."""
    split = sampling.train_test_split(table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_shipdate"), "l_orderkey", 0.7)
    return split.agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"))


def _whole_sql(length: int, longer: str) -> str:
    """First fit decreasing, one sample after another."""
    cut = f"range((len(tokens) - 1) // {length} + 1)" if longer == "cut" else f"range(CASE WHEN len(tokens) <= {length} THEN 1 ELSE 0 END)"
    return f"""WITH RECURSIVE {TOKENS.split("u AS")[0].strip().rstrip(",")},
        s AS (SELECT h, doc_id, k, tokens[k * {length} + 1 : (k + 1) * {length}] AS piece FROM t, {cut} AS r(k)),
        o AS (SELECT piece, len(piece) AS size, row_number() OVER (ORDER BY len(piece) DESC, h, doc_id, k) AS i FROM s),
        fit AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS room, 0::BIGINT AS block, 0::BIGINT AS place
                UNION ALL
                SELECT i + 1, CASE WHEN b = 0 THEN list_append(room, {length} - size) ELSE list_concat(room[: b - 1], [room[b] - size], room[b + 1 :]) END,
                       CASE WHEN b = 0 THEN len(room) ELSE b - 1 END, CASE WHEN b = 0 THEN 0 ELSE {length} - room[b] END
                FROM (SELECT f.i, room, size, coalesce(list_position([x >= size for x in room], TRUE), 0) AS b FROM fit f JOIN o ON o.i = f.i + 1)),
        l AS (SELECT block, place, size, piece, row_number() OVER (PARTITION BY block ORDER BY place) AS n FROM fit JOIN o USING (i)),
        g AS (SELECT block, sum(size)::INTEGER AS n_tokens, count(*)::INTEGER AS n_samples, ({length} - sum(size))::INTEGER AS padding,
                     string_agg(array_to_string(piece, ' ') || ' ', '' ORDER BY place) AS content, string_agg(repeat(n || ',', size), '' ORDER BY place) AS ids,
                     string_agg(array_to_string(range(size), ',') || ',', '' ORDER BY place) AS positions FROM l GROUP BY block)"""


def _whole(spark, sf, length, longer):
    blocks = sample_packing.pack_samples(table(spark, sf, "documents"), "doc_id", "text", length, longer=longer)
    digest = {"content": ("tokens", " "), "ids": ("sample_ids", ","), "positions": ("position_ids", ",")}
    told = [F.md5(F.concat(F.array_join(F.col(c).cast("array<string>"), mark), F.lit(mark))).alias(name) for name, (c, mark) in digest.items()]
    return blocks.select("block", "n_tokens", "n_samples", "padding", *told)


_BLOCKS_SQL = """ SELECT block, n_tokens, n_samples, padding, md5(content || repeat('<pad> ', padding)) AS content,
        md5(ids || repeat('0,', padding)) AS ids, md5(positions || repeat('0,', padding)) AS positions FROM g"""


@query("pack_samples", _whole_sql(packing.LONG_BLOCK, "cut") + _BLOCKS_SQL)
def pack_samples(spark, sf):
    return _whole(spark, sf, packing.LONG_BLOCK, "cut")


@query(
    "pack_short_samples",
    _whole_sql(packing.SHORT_BLOCK, "drop")
    + f""" SELECT count(*) AS n_blocks, coalesce(sum(n_tokens), 0)::BIGINT AS n_tokens, coalesce(sum(n_samples), 0)::BIGINT AS n_samples,
        round(sum(n_tokens)::DOUBLE / (count(*) * {packing.SHORT_BLOCK})::DOUBLE, 9) AS fill FROM g""",
)
def pack_short_samples(spark, sf):
    """How well blocks are filled when samples longer than a block are left out."""
    blocks = sample_packing.pack_samples(table(spark, sf, "documents"), "doc_id", "text", packing.SHORT_BLOCK, longer="drop")
    return sample_packing.fill_rate(blocks, packing.SHORT_BLOCK).withColumn("fill", F.round("fill", 9))
