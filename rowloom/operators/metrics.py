"""Row metrics as columns, and their aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions import textstats
from rowloom.session import written
from rowloom.operators.overlap import sequence_hits, summary_hits

Metric = Callable[[Column, Column], Column]

# The suffixes of aggregate names, and the share above which a text counts as toxic.
VERSION = "v1"
TOXIC_FROM = 0.5

# Accuracy of the sketch that brackets a quantile.
ACCURACY = 20_000
# Size of the stored sketches, and three times the rank error it promises.
SKETCH_SIZE = 2048
SKETCH_ERROR = 0.0075
GRID = 256

_COUNTS = T.StructType([T.StructField(name, T.LongType()) for name in ("hits", "predicted", "wanted")])


def rouge_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; an absent text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once for use in several places of an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _numbered(tokens: Column) -> Column:
    """The tokens made distinct: each with its number among equal ones, via runs of the sorted array."""

    def number(t: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (F.get(t, i - 1) != F.get(t, i - 2))
        )
        return _let(
            starts,
            lambda s: F.flatten(
                F.transform(
                    s,
                    lambda at, k: F.transform(
                        F.sequence(F.lit(1), F.coalesce(F.get(s, k + 1), F.size(t) + 1) - at),
                        lambda c: F.concat(F.get(t, at - 1), F.lit(" "), c.cast("string")),
                    ),
                )
            ),
        )

    empty = F.array().cast("array<string>")
    return _let(F.sort_array(tokens), lambda t: F.when(F.size(t) == 0, empty).otherwise(number(t)))


def f_score(hits: Column, predicted: Column, wanted: Column) -> Column:
    """Harmonic mean of hits/predicted and hits/wanted; 0 where it has no meaning."""
    precision, recall = hits.cast("double") / predicted, hits.cast("double") / wanted
    return F.when((hits > 0), 2.0 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def exact_match(prediction: Column, target: Column) -> Column:
    return prediction.eqNullSafe(target).cast("double")


def _score_of(counts: Column) -> Column:
    return _let(counts, lambda c: f_score(c.getField("hits"), c.getField("predicted"), c.getField("wanted")))


def rouge1(prediction: Column, target: Column) -> Column:
    """Unigram F-score with clipped counts, inside the row and without a shuffle."""

    def counts(t: Column) -> Column:
        given, wanted = F.get(t, F.lit(0)), F.get(t, F.lit(1))
        return F.struct(
            F.size(F.array_intersect(_numbered(given), _numbered(wanted))).alias("hits"),
            F.nullif(F.size(given), F.lit(0)).alias("predicted"),
            F.nullif(F.size(wanted), F.lit(0)).alias("wanted"),
        )

    return _score_of(_let(F.array(rouge_tokens(prediction), rouge_tokens(target)), counts))


@F.pandas_udf(_COUNTS)
def _sequence_counts(prediction: pd.Series, target: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sequence_hits(p, t) for p, t in zip(prediction, target)], columns=_COUNTS.names)


@F.pandas_udf(_COUNTS)
def _summary_counts(prediction: pd.Series, target: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([summary_hits(p, t) for p, t in zip(prediction, target)], columns=_COUNTS.names)


def rouge_l(prediction: Column, target: Column) -> Column:
    """F-score of the longest common subsequence of the whole texts."""
    return _score_of(_sequence_counts(F.lower(prediction), F.lower(target)))


def rouge_lsum(prediction: Column, target: Column) -> Column:
    """F-score of the union of common subsequences per line of the target."""
    return _score_of(_summary_counts(F.lower(prediction), F.lower(target)))


def flesch_kincaid(prediction: Column, target: Column) -> Column:
    return textstats.flesch_kincaid(prediction)


def automated_readability(prediction: Column, target: Column) -> Column:
    return textstats.automated_readability(prediction)


# The names under which metrics are reported.
METRICS: dict[str, Metric] = {
    "exact_match": exact_match,
    "rouge1": rouge1,
    "rougeL": rouge_l,
    "rougeLsum": rouge_lsum,
    "flesch_kincaid_grade_level": flesch_kincaid,
    "ari_grade_level": automated_readability,
}


def score(
    df: DataFrame,
    prediction: str,
    target: str,
    metrics: Sequence[str] = ("exact_match", "rouge1"),
    extra: dict[str, Metric] | None = None,
) -> DataFrame:
    """Add one column per metric. ``extra`` brings metrics of the caller's own."""
    chosen = {name: METRICS[name] for name in metrics} | (extra or {})
    return df.withColumns({name: make(F.col(prediction), F.col(target)) for name, make in chosen.items()})


def long_form(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per metric value; absent values are left out."""
    wide = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(list(ids), list(metrics), "metric", "value").filter(F.col("value").isNotNull())


def _brackets(long: DataFrame, keys: list[str], value: str, q: float, accuracy: int, slack: float = 3.0) -> DataFrame:
    """Per group size, mean, variance, and two values between which the quantile should lie."""
    ends = [max(0.0, q - slack / accuracy), min(1.0, q + slack / accuracy)]
    found = long.groupBy(*keys).agg(
        F.count(value).alias("__n"),
        F.avg(value).alias("__mean"),
        F.var_pop(value).alias("__variance"),
        F.min(value).alias("__min"),
        F.max(value).alias("__max"),
        F.percentile_approx(value, ends, accuracy).alias("__ends"),
    )
    # A small group is its own bracket.
    small = F.col("__n") <= 4 * accuracy
    low = F.when(small, F.col("__min")).otherwise(F.get("__ends", F.lit(0))).alias("__low")
    high = F.when(small, F.col("__max")).otherwise(F.get("__ends", F.lit(1))).alias("__high")
    # Written, as it is read twice; its size then tells the planner how to join it.
    return written(found.select(*keys, "__n", "__mean", "__variance", "__min", "__max", low, high), "brackets")


def _ranked(long: DataFrame, brackets: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """The quantile by ranking the values in the bracket, and whether both ranks it needs lie in there."""
    x = F.col(value)
    joined = long.join(brackets.select(*keys, "__n", "__low", "__high"), keys)
    inside = (x >= F.col("__low")) & (x <= F.col("__high"))
    # Values below the bracket become one row per group, those above it are not needed.
    counted = (
        joined.filter(x <= F.col("__high"))
        .groupBy(*keys, "__n", F.when(inside, x).alias("__x"))
        .agg(F.count("*").alias("__c"))
    )
    order = Window.partitionBy(*keys).orderBy(F.col("__x").asc_nulls_first())
    upto = counted.withColumn("__upto", F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.lit(q) * (F.col("__n") - 1)
    floor, ceil = F.floor(rank), F.ceil(rank)
    found = upto.groupBy(*keys).agg(
        F.min(F.when(F.col("__upto") > floor, F.col("__x"))).alias("__lo"),
        F.min(F.when(F.col("__upto") > ceil, F.col("__x"))).alias("__hi"),
        F.max(rank - floor).alias("__part"),
        # The sketch promises that the rank lies inside the bracket; the counts prove it.
        F.min(F.when(F.col("__x").isNull(), F.col("__c") <= floor).otherwise(True)).alias("__below"),
        F.max(F.col("__upto") > ceil).alias("__reached"),
    )
    value = F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__part")
    return found.select(*keys, value.alias("quantile"), "__below", "__reached")


def _widened(missed: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """Brackets of groups that missed a rank, opened on the side where it lies."""
    low = F.when(F.col("__below"), F.col("__low")).otherwise(F.col("__min"))
    high = F.when(F.col("__reached"), F.col("__high")).otherwise(F.col("__max"))
    open_sides = brackets.join(missed.select(*keys, "__below", "__reached"), keys)
    return open_sides.withColumns({"__low": low, "__high": high}).drop("__below", "__reached")


def _narrowed(long: DataFrame, brackets: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """Brackets around the rank by a sketch of the values inside them alone."""
    x = F.col(value)
    joined = long.join(brackets.select(*keys, "__low", "__high"), keys).filter(x <= F.col("__high"))
    inside = F.when(x >= F.col("__low"), x)
    told = joined.groupBy(*keys).agg(F.count(inside).alias("__in"), F.count("*").alias("__upto"), F.kll_sketch_agg_double(inside.cast("double"), F.lit(SKETCH_SIZE)).alias("__sketch"))
    at = (F.lit(q) * (F.col("__n") - 1) - (F.col("__upto") - F.col("__in"))) / F.col("__in")

    # A sketch is asked for fixed ranks only: for a grid of them, of which each group takes two.
    grid = F.kll_sketch_get_quantile_double("__sketch", F.array(*[F.lit(k / GRID) for k in range(GRID + 1)]))
    first = F.greatest(F.lit(0), F.floor((at - SKETCH_ERROR) * GRID)).cast("int")
    last = F.least(F.lit(GRID), F.ceil((at + SKETCH_ERROR) * GRID)).cast("int")
    both = brackets.join(told, keys).withColumns({"__grid": grid, "__first": first, "__last": last})
    both = both.withColumns({"__low": F.get("__grid", F.col("__first")), "__high": F.get("__grid", F.col("__last"))})
    return both.drop("__in", "__upto", "__sketch", "__grid", "__first", "__last")


def _quantile(long: DataFrame, brackets: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """Exact quantiles. Groups whose rank is not in the bracket get a wider one, then a narrower one inside that.

    Counts prove each round. The second bracket may be missed only if its sketch breaks its promise; from then on brackets are
    only widened, at most to the whole group, so the rounds end.
    """
    found, narrow = None, True
    while True:
        ranked = written(_ranked(long, brackets, keys, value, q), "quantiles")
        proved = ranked.filter("__below AND __reached").select(*keys, "quantile")
        found = proved if found is None else found.unionByName(proved)
        missed = ranked.filter("NOT (__below AND __reached)")
        if missed.isEmpty():
            return found
        brackets = written(_widened(missed, brackets, keys), "brackets")
        if narrow:
            brackets, narrow = written(_narrowed(long, brackets, keys, value, q), "brackets"), False


def exact_quantile(long: DataFrame, keys: Sequence[str], value: str, q: float, accuracy: int = ACCURACY, slack: float = 3.0) -> DataFrame:
    """The linearly interpolated quantile per group, exact at any size.

    A mergeable sketch brackets the wanted rank within ``slack`` parts in ``accuracy``; counting says
    how many values lie below the bracket; only the values inside it are ranked, after equal ones
    have collapsed. So no task sees a whole large group. A bracket that misses is mended in further rounds.
    """
    rows = long.filter(F.col(value).isNotNull())
    return _quantile(rows, _brackets(rows, list(keys), value, q, accuracy, slack), list(keys), value, q)


def summarise(long: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """What is kept of a part of the rows, to be merged with other parts: keys, ``n, mean, m2, least, most, sketch``.

    ``m2`` is the sum of squared distances from the mean, ``sketch`` a KLL sketch. One row per group, nulls left out.
    """
    rows = long.filter(F.col(value).isNotNull())
    return rows.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        (F.var_pop(value) * F.count(value)).alias("m2"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH_SIZE)).alias("sketch"),
    )


def merge_summaries(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The summary of all rows from those of their parts; merging again changes nothing but the last digits."""
    keys = list(keys)
    whole = parts.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )
    # Distances from the common mean: adding up squares and taking the mean off would lose digits.
    means = whole.select(*keys, F.col("mean").alias("__mean"))
    away = F.col("mean") - F.col("__mean")
    spread = parts.join(means, keys).groupBy(*keys).agg(F.sum(F.col("m2") + F.col("n") * away * away).alias("m2"))
    return whole.join(spread, keys).select(*keys, "n", "mean", "m2", "least", "most", "sketch")


def merged_quantile(long: DataFrame, merged: DataFrame, keys: Sequence[str], value: str, q: float) -> DataFrame:
    """The exact quantile of all rows, with the merged sketch as the bracket instead of a pass over the rows."""
    keys = list(keys)

    def end(share: float) -> Column:
        return F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, max(0.0, share))))

    brackets = merged.select(
        *keys,
        F.col("n").alias("__n"),
        F.col("least").alias("__min"),
        F.col("most").alias("__max"),
        end(q - SKETCH_ERROR).alias("__low"),
        end(q + SKETCH_ERROR).alias("__high"),
    )
    return _quantile(long.filter(F.col(value).isNotNull()), written(brackets, "brackets"), keys, value, q)


def merged_aggregates(long: DataFrame, merged: DataFrame, run: str) -> DataFrame:
    """``metric_aggregates`` from stored summaries: moments need no row, the percentile only those in its bracket."""
    keys = [run, "metric"]
    p90 = merged_quantile(long, merged, keys, "value", 0.9)
    wide = merged.join(p90, keys).select(*keys, "mean", (F.col("m2") / F.col("n")).alias("variance"), F.col("quantile").alias("p90"))
    return _named(wide, run)


def _named(wide: DataFrame, run: str) -> DataFrame:
    long = wide.unpivot([run, "metric"], ["mean", "variance", "p90"], "aggregate", "score")
    return long.select(run, F.concat_ws("/", "metric", F.lit(VERSION), "aggregate").alias("metric"), "score")


def metric_aggregates(df: DataFrame, run: str, metrics: Sequence[str]) -> DataFrame:
    """Mean, population variance and 90th percentile per run and metric, in long form.

    Reads the metric columns twice; write costly ones out first.
    """
    keys, long = [run, "metric"], long_form(df, [run], metrics)
    brackets = _brackets(long, keys, "value", 0.9, ACCURACY)
    p90 = _quantile(long, brackets, keys, "value", 0.9)
    wide = brackets.join(p90, keys).select(
        *keys, F.col("__mean").alias("mean"), F.col("__variance").alias("variance"), F.col("quantile").alias("p90")
    )
    return _named(wide, run)


def exact_match_rate(df: DataFrame, run: str, prediction: str, target: str) -> DataFrame:
    rate = F.avg(exact_match(F.col(prediction), F.col(target)))
    return df.groupBy(run).agg(rate.alias("score")).select(run, F.lit(f"exact_match/{VERSION}").alias("metric"), "score")


def toxicity_stats(df: DataFrame, run: str, value: str) -> DataFrame:
    """The usual aggregates of a toxicity score and the share that counts as toxic."""
    named = df.select(run, F.col(value).cast("double").alias("toxicity"))
    ratio = named.groupBy(run).agg(F.avg((F.col("toxicity") >= TOXIC_FROM).cast("double")).alias("score"))
    ratio = ratio.select(run, F.lit(f"toxicity/{VERSION}/ratio").alias("metric"), "score")
    return metric_aggregates(named, run, ["toxicity"]).unionByName(ratio)


def metric_report(aggregates: DataFrame) -> DataFrame:
    """Only means and the exact match rate."""
    return aggregates.filter(F.col("metric").contains("mean") | (F.col("metric") == f"exact_match/{VERSION}"))
