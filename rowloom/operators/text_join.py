"""Bringing runs together by their texts, where equal pairs multiply."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.templates import INPUT_FIELD, OUTPUT_FIELD
from rowloom.session import written

PAIR = (INPUT_FIELD, OUTPUT_FIELD)
# Result rows that one task makes of one hot pair.
ROWS_PER_TASK = 1_000_000
COPIES, PRINT, CELL = "__copies", "__print", "__cell"


def fingerprint(on: Sequence[str], kinds: dict[str, T.DataType]) -> Column:
    """128 bits of MD5 over the columns, null apart from any text; NaN is missing, as null is, and -0.0 is 0.0."""

    def value(name: str) -> Column:
        found = F.col(f"`{name}`").cast(kinds[name])
        if isinstance(kinds[name], (T.FloatType, T.DoubleType)):
            return F.when(F.isnan(found), None).when(found == 0, F.lit(0.0).cast(kinds[name])).otherwise(found)
        return found

    fields = [value(name).alias(f"c{i}") for i, name in enumerate(on)]
    return F.unhex(F.md5(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})))


def counted(df: DataFrame) -> DataFrame:
    """Equal rows once, with their number; rows counted before keep it."""
    columns = [c for c in df.columns if c != COPIES]
    n = F.sum(COPIES) if COPIES in df.columns else F.count("*")
    return df.groupBy(*[f"`{c}`" for c in columns]).agg(n.alias(COPIES))


def merge_counted(left: DataFrame, right: DataFrame, on: Sequence[str], per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Inner join of two tables of ``counted`` rows by equal values of ``on``, null equal to null; numbers multiply.

    Both sides meet by fingerprints, so the columns of ``on`` travel with the left side only. A pair with very many different
    rows on both sides is cut into cells: its left rows are dealt to the cells by a hash of the row, its right
    rows, which have no texts, go to each. No cell makes more than about ``per_task`` rows, and no
    row depends on which task it came from. Columns of one name get ``_x`` and ``_y``.
    """
    both = (set(left.columns) & set(right.columns)) - set(on) - {COPIES}
    kinds = {name: left.schema[name].dataType for name in on}
    own = [c for c in right.columns if c not in on and c != COPIES]
    a = left.withColumnsRenamed({c: f"{c}_x" for c in both}).withColumn(PRINT, fingerprint(on, kinds))
    print_of = fingerprint(on, kinds).alias(PRINT)
    b = right.select(print_of, *[F.col(f"`{c}`").alias(f"{c}_y" if c in both else c) for c in own], F.col(COPIES).alias("__more"))
    # Rows that differ in texts of equal meaning only (NaN and null) were counted apart; they stay apart.
    sizes = a.groupBy(PRINT).agg(F.count("*").alias("n")).join(b.groupBy(PRINT).agg(F.count("*").alias("m")), PRINT)
    cells = F.ceil(F.col("n").cast("double") * F.col("m") / per_task)
    hot = written(sizes.filter(F.col("n").cast("double") * F.col("m") > per_task).select(PRINT, F.least(cells, "n").cast("bigint").alias("__cells")), "hot-pairs")
    row = F.xxhash64(*[F.col(f"`{c}`") for c in a.columns])
    one = F.lit(1).cast("bigint")
    a = a.withColumn("__row", row).join(hot, PRINT, "left").withColumn(CELL, F.pmod("__row", F.coalesce("__cells", one))).drop("__row", "__cells")
    b = b.join(hot, PRINT, "left").withColumn(CELL, F.explode(F.sequence(one - one, F.coalesce("__cells", one) - one))).drop("__cells")
    return a.join(b, [PRINT, CELL]).withColumn(COPIES, F.col(COPIES) * F.col("__more")).drop(PRINT, CELL, "__more")


def repeated(df: DataFrame, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Each row as often as its number says. Rows with very many copies are dealt to tasks in runs."""
    columns = [F.col(f"`{c}`") for c in df.columns if c != COPIES]
    runs = df.withColumn("__run", F.explode(F.sequence(F.lit(0), F.floor((F.col(COPIES) - 1) / per_task))))
    many = runs.filter(F.col(COPIES) > per_task).withColumn("__deal", F.xxhash64(*columns))
    many = many.repartition(F.col("__deal"), F.col("__run")).drop("__deal")
    n = F.least(F.lit(per_task), F.col(COPIES) - F.col("__run") * per_task).cast("int")
    return runs.filter(F.col(COPIES) <= per_task).unionByName(many).withColumn("__copy", F.explode(F.sequence(F.lit(1), n))).select(*columns)


def join_results_by_text(source: DataFrame, results: DataFrame, on: Sequence[str] = PAIR, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Inner join of source rows and results by input and expected output, as data frame libraries merge.

    A pair that stands k times in the source and m times in the results gives k * m rows; null matches null.
    For tables with a row key ``join_results`` is the one that does not multiply.
    """
    return repeated(merge_counted(counted(source), counted(results), on, per_task), per_task)


def compare_rows_by_text(
    results: DataFrame, run: str, runs: Sequence[str], metrics: Sequence[str], on: Sequence[str] = PAIR, per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """The rows of several runs side by side by the columns ``on``: one column ``metric run`` per metric and run.

    Runs are merged one after another, and a pair's rows multiply over them. Equal rows stay one row with
    a number until the end, so copies cost nothing on the way.
    """
    merged = None
    for name in runs:
        rows = results.filter(F.col(run) == name).select(*[f"`{c}`" for c in on], *[F.col(f"`{m}`").alias(f"{m} {name}") for m in metrics])
        merged = counted(rows) if merged is None else merge_counted(merged, counted(rows), on, per_task)
    return repeated(merged, per_task)
