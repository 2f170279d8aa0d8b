"""Exact-count samples and splits that do not depend on partitioning or on row order.

Rows are ordered by a salted hash of their key and the first ``k`` of that order are taken.
Nothing is sorted as a whole: histograms of the hash narrow down the slice in which the
``k``-th row lies until the slice is known to be small, and only that slice is ranked. Each
step is a job over the key column alone that returns one row, and there is one step for up to
2^20 rows, two up to 2^30, three up to 2^46. The bound goes into the plan as a literal, so the
pass over the full rows is a filter or a projection without a shuffle. A costly input is best
written out (or checkpointed) first, since the steps and the final pass each read it. Keys may repeat and may
be null; counts stay exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from rowloom.functions.hashing import BUCKET_BITS, bucket
from rowloom.operators.ordering import positioned

# Seeds and default fractions.
TRAIN_SEED = 42
EVAL_SEED = 420
DEFAULT_FRACTION = 1.0
DEFAULT_SPLIT = 0.9

# Width of each histogram in bits: the first one sees all rows and stays small in every task,
# the later ones see one slice of the one before.
STEP_BITS = (10, 16, 16, 16)
RANKED_ROWS = 1 << 20
PREVIEW_BITS = 12

TRAIN, TEST, EVAL = "train", "test", "eval"


def train_salt(step: str) -> str:
    """Sampling and splitting draw with different salts, so the draws are independent."""
    return f"{TRAIN_SEED}:{step}"


def cut_after(df: DataFrame, key: str, salt: str, wanted: int, n: int) -> tuple[int, str, int, int] | None:
    """Where the ``wanted``-th of ``n`` rows lies in hash order: hash, key, how many rows of that key are wanted, how many there are.

    None if no row is wanted. Rows with one key are counted, never ranked.
    """
    if wanted <= 0 or n <= 0:
        return None
    rows = df.select(bucket(salt, key).alias("h"), _text(key).alias("k"))
    left = BUCKET_BITS
    for bits in STEP_BITS:
        if n <= RANKED_ROWS or left < bits:
            break
        left -= bits
        slot = F.shiftright("h", left)
        found = _first_over(rows.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")), "slot", wanted)  # at most 2^bits rows
        rows = rows.filter(slot == found["slot"])
        wanted, n = wanted - (found["upto"] - found["n"]), found["n"]
    last = _first_over(rows.groupBy("h", "k").agg(F.count("*").alias("n")), ["h", "k"], wanted)
    return last["h"], last["k"], wanted - (last["upto"] - last["n"]), last["n"]


def _first_over(sizes: DataFrame, order: str | list[str], wanted: int) -> Row:
    """The first row at which the running sum of ``n`` reaches ``wanted``."""
    order = [order] if isinstance(order, str) else order
    upto = sizes.withColumn("upto", F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return upto.filter(F.col("upto") >= wanted).orderBy(*order).first()


def _text(key: str) -> Column:
    """The key as it is compared: null is a key, the same as empty text."""
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def _marked(df: DataFrame, key: str, salt: str, wanted: int, n: int) -> DataFrame:
    """Add ``__head``: true for exactly ``wanted`` rows, the first in hash order.

    With keys that tell rows apart this is a comparison with two literals. If the last key is only
    wanted in part, its rows are ordered by a hash of all columns, and of rows that are equal in
    all of them as many as needed are taken by count.
    """
    cut = cut_after(df, key, salt, wanted, n)
    if cut is None:
        return df.withColumn("__head", F.lit(False))
    h, k, take, there = cut
    at = bucket(salt, key)
    before, same = (at < h) | ((at == h) & (_text(key) < k)), (at == h) & (_text(key) == k)
    if take == there:
        return df.withColumn("__head", before | same)
    others = df.filter(~same).withColumn("__head", before)
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("__row")
    tied = df.filter(same).withColumn("__row", row)
    last = cut_after(tied, "__row", salt, take, there)
    at = bucket(salt, "__row")
    before, same = (at < last[0]) | ((at == last[0]) & (F.col("__row") < last[1])), F.col("__row") == last[1]
    rest = tied.filter(~same).withColumn("__head", before).drop("__row")
    # These rows are all the same: they are numbered where they are.
    equal = positioned(tied.filter(same).drop("__row"), name="__at").withColumn("__head", F.col("__at") < last[2]).drop("__at")
    return others.unionByName(rest).unionByName(equal)


def _share_up(share: float, n: int) -> int:
    return math.ceil((1.0 - share) * n)


def _check(name: str, share: float) -> None:
    if not 0.0 <= share:
        raise ValueError(f"{name} must not be negative")


def downsample(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """Drop ``ceil((1 - fraction) * n)`` rows; every row stays for a fraction of 1 or more."""
    _check("fraction", fraction)
    if fraction >= 1.0:
        return df
    n, salt = df.count(), train_salt("frac")
    return _marked(df, key, salt, _share_up(fraction, n), n).filter("NOT __head").drop("__head")


def _split(df: DataFrame, key: str, split: float, n: int) -> DataFrame:
    _check("split", split)
    marked = _marked(df, key, train_salt("split"), 0 if split >= 1.0 else _share_up(split, n), n)
    return marked.withColumn("split", F.when(F.col("__head"), TEST).otherwise(TRAIN)).drop("__head")


def train_test_split(df: DataFrame, key: str, split: float = DEFAULT_SPLIT) -> DataFrame:
    """Add ``split``: ``ceil((1 - split) * n)`` rows are test, the others train."""
    return _split(df, key, split, df.count() if split < 1.0 else 0)


def holdout(df: DataFrame, key: str, validation: float = 0.05) -> DataFrame:
    """Hold out a validation share, as a split by what is left."""
    return train_test_split(df, key, 1.0 - validation)


def sample_and_split(
    df: DataFrame, key: str, fraction: float = DEFAULT_FRACTION, split: float = DEFAULT_SPLIT
) -> DataFrame:
    """Sample the train rows, then take the test rows that are there or split them off.

    The column ``split`` is read and rewritten. Rows of ``eval`` win over rows of ``test``, both
    win over splitting, and neither is sampled. Rows of other splits are not part of the result.
    """
    if "split" not in df.columns:
        raise ValueError("expected a table with a 'split' column")
    sizes = df.agg(*[F.count_if(F.col("split") == s).alias(s) for s in (TRAIN, EVAL, TEST)]).first()
    if not sizes[TRAIN]:
        raise ValueError("the table has no 'train' rows")
    n, salt = sizes[TRAIN], train_salt("frac")
    train = df.filter(F.col("split") == TRAIN)
    if fraction < 1.0:
        _check("fraction", fraction)
        dropped = _share_up(fraction, n)
        train = _marked(train, key, salt, dropped, n).filter("NOT __head").drop("__head")
        n -= dropped
    if sizes[EVAL] or sizes[TEST]:
        given = EVAL if sizes[EVAL] else TEST
        return train.unionByName(df.filter(F.col("split") == given).withColumn("split", F.lit(TEST)))
    return _split(train, key, split, n)


def eval_sample(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """Keep ``fraction * n`` rows, the half-way case rounded to even."""
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("fraction must lie between 0 and 1")
    n, salt = df.count(), f"{EVAL_SEED}:eval"
    return _marked(df, key, salt, round(fraction * n), n).filter("__head").drop("__head")


def preview(df: DataFrame, key: str, n: int, seed: int | str = 0) -> DataFrame:
    """``n`` rows for a look, the same on every call."""
    order = bucket(seed, key)
    return df.orderBy(order, F.col(key).cast("string")).limit(n)


def preview_each(df: DataFrame, group: str, key: str, n: int, seed: int | str = 0) -> DataFrame:
    """``n`` rows of each group for a look, the same on every call; all rows of a smaller group. Null is a group.

    Per group a histogram of the hash says below which slot the ``n`` smallest lie. Only those rows are ranked, and every task
    drops what is not among its own first ``n`` of a group before the shuffle, so a group with most of the rows, or a key
    with most of a group, sends no more than any other. Rows of one key are told apart by a hash of all columns.
    """
    place = df.select("*", bucket(seed, key).alias("__h"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"))
    slot = F.shiftright("__h", BUCKET_BITS - PREVIEW_BITS)
    sizes = place.groupBy(F.col(group).alias("__group"), slot.alias("__slot")).agg(F.count("*").alias("__n"))
    # At most 2^PREVIEW_BITS rows of a group.
    upto = F.sum("__n").over(Window.partitionBy("__group").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1))
    last = sizes.withColumn("__before", F.coalesce(upto, F.lit(0))).filter(F.col("__before") < n).groupBy("__group").agg(F.max("__slot").alias("__last"))
    near = place.join(last, F.col(group).eqNullSafe(F.col("__group")) & (slot <= F.col("__last")))
    rank = F.row_number().over(Window.partitionBy("__group").orderBy("__h", _text(key), "__row"))
    return near.withColumn("__rank", rank).filter(F.col("__rank") <= n).select(*[F.col(f"`{c}`") for c in df.columns])


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n_rows"))


def split_params(adapters: DataFrame, jobs: DataFrame) -> DataFrame:
    """The fractions each adapter was trained with: its first job by id, else the defaults."""
    first = jobs.groupBy("adapter_name").agg(
        F.min_by(F.struct("dataset_fraction", "train_test_split"), F.col("id")).alias("used")
    )
    return adapters.join(first, adapters["name"] == first["adapter_name"], "left").select(
        adapters["id"].alias("adapter_id"),
        F.coalesce(F.col("used.dataset_fraction"), F.lit(DEFAULT_FRACTION)).alias("dataset_fraction"),
        F.coalesce(F.col("used.train_test_split"), F.lit(DEFAULT_SPLIT)).alias("train_test_split"),
    )


def leakage(df: DataFrame, key: str, text: Column) -> DataFrame:
    """How many test rows share their key or their text with a train row.

    Only hashes are shuffled, and equal ones collapse before the shuffle.
    """
    checks = F.array(
        F.struct(F.lit("row_key").alias("check"), F.md5(F.col(key).cast("string")).alias("h")),
        F.struct(F.lit("text").alias("check"), F.md5(text).alias("h")),
    )
    seen = (
        df.select("split", F.explode(checks).alias("c"))
        .groupBy("c.check", "c.h")
        .agg(F.count_if(F.col("split") == TEST).alias("test"), F.count_if(F.col("split") == TRAIN).alias("train"))
    )
    return seen.groupBy("check").agg(
        F.sum(F.when(F.col("train") > 0, F.col("test")).otherwise(0)).alias("leaked_rows"),
        F.sum("test").alias("test_rows"),
    )
