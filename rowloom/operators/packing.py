"""Concatenating tokenised rows into blocks of one length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.hashing import bucket
from rowloom.operators.ordering import running

# Block lengths of the two training paths, and the marker between examples.
SHORT_BLOCK = 512
LONG_BLOCK = 4096
SEPARATOR = "</s>"

# Characters of a text that take part in the order of rows with one key.
PREFIX = 64


def words(text: Column) -> Column:
    """The default tokens: runs of non-blank characters."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), 0)


def _tokens(text: str, tokenizer: Callable[[Column], Column], separator: str | None) -> Column:
    end = F.array(F.lit(separator)) if separator is not None else F.array().cast("array<string>")
    return F.concat(tokenizer(F.col(text)), end)


def pack_sequences(
    df: DataFrame,
    key: str,
    text: str,
    length: int = SHORT_BLOCK,
    tokenizer: Callable[[Column], Column] = words,
    separator: str | None = SEPARATOR,
    drop_tail: bool = False,
) -> DataFrame:
    """Blocks of ``length`` tokens, one row each: block, tokens, n_tokens, n_pieces.

    All rows are one stream in the order of the hash of their key, then key and text (by its first characters, then
    its hash), and block ``b`` has the tokens from ``b * length`` on. Only the very last block may be shorter; ``drop_tail`` leaves it out.

    Texts are range partitioned in that order, so rows of one key, or equal rows, go to as many tasks as they need; each
    task adds up its sizes, and the tasks' totals give each row its place. The tokens meet in their
    block. A block is at most its length, so what is collected is bounded.
    """
    tokens = _tokens("text", tokenizer, separator)
    rows = df.select(bucket("pack", key).alias("h"), F.col(key).alias("k"), F.col(text).alias("text"))
    order = [F.col("h"), F.col("k"), F.substring("text", 1, PREFIX), F.xxhash64("text")]
    placed = running(rows, order, F.size(tokens), "size", "start").withColumn("tokens", tokens)
    first = F.floor(F.col("start") / length)
    last = F.floor((F.col("start") + F.col("size") - 1) / length)

    def piece(block: Column) -> Column:
        low = F.greatest(block * length - F.col("start"), F.lit(0))
        high = F.least((block + 1) * length - F.col("start"), F.col("size"))
        cut = F.slice("tokens", (low + 1).cast("int"), (high - low).cast("int"))
        return F.struct(block.alias("block"), F.struct(F.col("start"), cut.alias("tokens")).alias("piece"))

    # Cut first and explode then: a row repeated per block would carry all its tokens each time.
    pieces = placed.select(F.explode(F.transform(F.sequence(first, last), piece)).alias("cut")).select("cut.block", "cut.piece")
    blocks = pieces.groupBy("block").agg(F.array_sort(F.collect_list("piece")).alias("pieces"), F.sum(F.size("piece.tokens")).alias("n_tokens"))
    if drop_tail:
        blocks = blocks.filter(F.col("n_tokens") == length)
    joined = F.flatten(F.transform("pieces", lambda p: p.getField("tokens"))).alias("tokens")
    return blocks.select("block", joined, "n_tokens", F.size("pieces").alias("n_pieces"))


def dropped_tokens(
    df: DataFrame, text: str, length: int = SHORT_BLOCK, tokenizer: Callable[[Column], Column] = words, separator: str | None = SEPARATOR
) -> DataFrame:
    """All tokens, full blocks, and the tokens that ``drop_tail`` would leave out."""
    total = F.coalesce(F.sum(F.size(_tokens("text", tokenizer, separator))), F.lit(0))
    return df.select(F.col(text).alias("text")).agg(
        total.alias("n_tokens"), F.floor(total / length).alias("n_blocks"), F.pmod(total, F.lit(length)).alias("dropped")
    )
