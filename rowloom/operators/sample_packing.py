"""Packing whole samples into blocks of one length: no sample is cut to fill a block."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.hashing import bucket
from rowloom.operators.ordering import driver_table, positioned
from rowloom.operators.packing import LONG_BLOCK, SEPARATOR, _tokens, words

# What a block is filled up with.
PADDING = "<pad>"


@dataclass
class Bins:
    """Neighbouring bins with equal contents."""

    first: int
    count: int
    left: int


@dataclass(frozen=True)
class Share:
    """Samples of one size, by rank from ``low`` on, that fill neighbouring bins ``each`` at a time from ``offset`` on."""

    size: int
    low: int
    high: int
    first: int
    each: int
    offset: int


def first_fit_decreasing(counts: Iterable[tuple[int, int]], length: int) -> tuple[list[Share], int]:
    """Place samples, given as (size, how many), largest first, each in the first bin with room; return shares and the number of bins.

    The same bins as placing sample by sample, but equal samples go into runs of equal bins at once: the work
    and the result depend on the number of sizes, which is at most ``length``, not on the number of samples.
    """
    sizes = sorted(((s, n) for s, n in counts if n), reverse=True)
    runs: list[Bins] = []
    shares: list[Share] = []
    bins = 0
    for at, (size, count) in enumerate(sizes):
        done, kept = 0, []
        for run in runs:
            each = run.left // size
            if done == count or not each:
                kept.append(run)
                continue
            whole, rest = divmod(min(count - done, each * run.count), each)
            offset, first = length - run.left, run.first
            if whole:
                shares.append(Share(size, done, done + whole * each, first, each, offset))
                kept.append(Bins(first, whole, run.left - each * size))
            if rest:
                shares.append(Share(size, done + whole * each, done + whole * each + rest, first + whole, rest, offset))
                kept.append(Bins(first + whole, 1, run.left - rest * size))
            used = whole + bool(rest)
            done += whole * each + rest
            if used < run.count:
                kept.append(Bins(first + used, run.count - used, run.left))
        each = length // size
        whole, rest = divmod(count - done, each)
        for number, filled in ((whole, each), (1 if rest else 0, rest)):
            if number:
                shares.append(Share(size, done, done + number * filled, bins, filled, 0))
                kept.append(Bins(bins, number, length - filled * size))
                done += number * filled
                bins += number
        smallest = sizes[-1][0] if at + 1 < len(sizes) else length + 1
        runs = [run for run in kept if run.left >= smallest]
    return shares, bins


def _samples(df: DataFrame, key: str, text: str, length: int, tokenizer: Callable[[Column], Column], separator: str | None, longer: str) -> DataFrame:
    """``h, k, piece, size, tokens``: samples, those longer than a block cut at its length or left out."""
    rows = df.select(bucket("pack", key).alias("h"), F.col(key).alias("k"), F.col(text).alias("text"))
    rows = rows.select("h", "k", _tokens("text", tokenizer, separator).alias("tokens")).withColumn("size", F.size("tokens")).filter("size > 0")
    if longer == "drop":
        return rows.filter(F.col("size") <= length).select("h", "k", F.lit(0).alias("piece"), "size", "tokens")
    pieces = F.sequence(F.lit(0), F.floor((F.col("size") - 1) / length).cast("int"))
    # Cut first and explode then: a row repeated per piece would carry all its tokens each time.
    cut = F.explode(F.transform(pieces, lambda p: F.struct(p.alias("piece"), F.slice("tokens", p * length + 1, length).alias("tokens")))).alias("cut")
    return rows.select("h", "k", cut).select("h", "k", "cut.piece", F.size("cut.tokens").alias("size"), "cut.tokens")


def pack_samples(
    df: DataFrame,
    key: str,
    text: str,
    length: int = LONG_BLOCK,
    tokenizer: Callable[[Column], Column] = words,
    separator: str | None = SEPARATOR,
    longer: str = "cut",
    pad: str | None = PADDING,
) -> DataFrame:
    """Blocks of whole samples, a row each: ``block, tokens, sample_ids, position_ids, n_tokens, n_samples, padding``.

    First fit decreasing: samples in order of falling size, then of the hash of their key, then of key and text, each into the first block that
    has room. ``sample_ids`` numbers the samples of a block from 1, 0 is padding; ``position_ids`` counts from 0 in
    each sample, and is 0 on padding. ``pad`` fills blocks up to ``length``; None leaves them short.

    A sample longer than a block is cut at the block length, so it fills blocks of its own and only its last piece is packed with
    others (``longer="cut"``, nothing is lost), or it is left out as trainers do (``longer="drop"``). A null text has
    only the separator. Rows without tokens make no sample.

    The histogram of sizes, at most ``length`` rows, is packed on the driver; what comes back says which ranks of which size go to
    which blocks and is joined by size. Ranks come from one sort, so one size, one key, or equal rows with a third of the table
    are dealt to many tasks. Tokens cross the network twice, to their rank and to their block.
    """
    if longer not in ("cut", "drop"):
        raise ValueError(f"longer must be 'cut' or 'drop', not '{longer}'")
    order = [F.col("size").desc(), F.col("h"), F.col("k"), F.col("piece"), F.xxhash64("tokens")]
    ranked = positioned(_samples(df, key, text, length, tokenizer, separator, longer), order)
    histogram = [(r["size"], r["n"]) for r in ranked.groupBy("size").agg(F.count("*").alias("n")).collect()]
    shares, _ = first_fit_decreasing(histogram, length)
    larger, begin = 0, {}
    for size, n in sorted(histogram, reverse=True):
        begin[size], larger = larger, larger + n
    rows = [(s.size, begin[s.size] + s.low, begin[s.size] + s.high, s.first, s.each, s.offset) for s in shares]
    plan = driver_table(df.sparkSession, rows, "of int, low bigint, high bigint, first bigint, each int, offset int")
    # The plan has a few rows per size, and there are at most `length` sizes.
    placed = ranked.join(F.broadcast(plan), (F.col("size") == F.col("of")) & (F.col("position") >= F.col("low")) & (F.col("position") < F.col("high")))
    nth = F.col("position") - F.col("low")
    block = (F.col("first") + F.floor(nth / F.col("each"))).alias("block")
    at = (F.col("offset") + F.pmod(nth, F.col("each")) * F.col("size")).alias("at")
    filled = placed.select(block, F.struct(at, "tokens").alias("sample")).groupBy("block").agg(F.array_sort(F.collect_list("sample")).alias("samples"))
    return _laid_out(filled, length, pad)


def _laid_out(filled: DataFrame, length: int, pad: str | None) -> DataFrame:
    size = F.aggregate("samples", F.lit(0), lambda total, s: total + F.size(s["tokens"]))
    sized = filled.withColumn("n_tokens", size).withColumn("padding", F.lit(length) - F.col("n_tokens") if pad is not None else F.lit(0))

    def padded(values: Column, filler: Column) -> Column:
        return F.concat(values, F.array_repeat(filler, F.col("padding")))

    tokens = F.flatten(F.transform("samples", lambda s: s["tokens"]))
    ids = F.flatten(F.transform("samples", lambda s, i: F.array_repeat(i + 1, F.size(s["tokens"]))))
    positions = F.flatten(F.transform("samples", lambda s: F.sequence(F.lit(0), F.size(s["tokens"]) - 1)))
    return sized.select(
        "block",
        padded(tokens, F.lit(pad if pad is not None else "")).alias("tokens"),
        padded(ids, F.lit(0)).alias("sample_ids"),
        padded(positions, F.lit(0)).alias("position_ids"),
        "n_tokens",
        F.size("samples").alias("n_samples"),
        "padding",
    )


def fill_rate(blocks: DataFrame, length: int = LONG_BLOCK) -> DataFrame:
    """Blocks, tokens, samples and the share of the blocks' room that tokens take; null without blocks."""
    rate = F.sum("n_tokens") / (F.count("*") * length)
    return blocks.agg(F.count("*").alias("n_blocks"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum("n_samples"), F.lit(0)).alias("n_samples"), rate.alias("fill"))
