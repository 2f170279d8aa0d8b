"""Exact top-k search by inner product with vector-approximation files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import arrow_batches, smallest, written

CELLS = 64  # per dimension
BLOCK = 4096  # vectors whose cells are scanned together
QUERIES = 1024  # queries that a block is scanned for together
TOGETHER = 16  # blocks of one task
FIRST = 4  # times k exact vectors are read before the next bound is looked at


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of every query with all other rows.

    Components become ``floor(scale * x)`` and scores are 64-bit integers; ties go to the smaller id.
    Vectors that are null or empty or hold a null or non-finite component, and rows without an id, take
    no part. Rows with the query's id are its own. Repeated rows count once. Vectors of another
    length than the query's take no part in its search.

    Equal vectors are one: the ``k + 1`` smallest ids of each are all that a result can name. Every
    block of vectors has a grid of 64 cells per dimension. A scan of the cells bounds each score from both sides; a
    vector can only be a result if its upper bound reaches the (k + 1)th largest lower bound. The exact vectors of
    those are read by falling upper bound: first ``4 * k`` of each query, then those whose bound
    still reaches the kth exact score, after which the result is certain.

    Blocks of queries meet blocks of vectors; neither side is broadcast, a task holds 1,024 queries and one
    block at a time, and only candidates leave it.
    """
    spark = vectors.sparkSession
    arrow_batches(spark, BLOCK)
    sound = F.forall(column, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    ints = F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("ints")
    valid = vectors.filter(F.col(id_column).isNotNull() & F.col(column).isNotNull() & (F.size(column) > 0) & sound)
    rows = valid.select(F.col(id_column).cast("bigint").alias("id"), ints, F.coalesce(is_query, F.lit(False)).alias("asked"))
    place = F.dense_rank().over(Window.partitionBy("ints").orderBy("id"))
    few = rows.select("ints", "id").withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("ints").agg(F.collect_set("id").alias("ids"))
    classes = written(few.withColumn("class", F.xxhash64("ints")), "vector-classes")
    queries = written(rows.filter("asked").select(F.col("id").alias("query_id"), "ints").distinct().withColumn("query", F.xxhash64("query_id", "ints")), "vector-queries")
    blocks = written(classes.select("class", "ints").repartition("class").mapInArrow(_pack, "block bigint, length int, classes binary, cells binary, low binary, step binary"), "vector-cells")
    query_blocks, groups = -(-max(1, queries.count()) // QUERIES), -(-max(1, blocks.count()) // TOGETHER)
    to_groups, to_blocks = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (groups, query_blocks))
    asked = queries.groupBy(F.pmod(F.xxhash64("query"), F.lit(query_blocks)).cast("int").alias("asked"), F.size("ints").alias("length"))
    asked = asked.agg(F.collect_list(F.struct("query", "ints")).alias("queries")).withColumn("group", to_groups)
    scanned = blocks.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).withColumn("asked", to_blocks)
    met = scanned.join(asked, ["asked", "length", "group"])
    bounds = met.select("length", "classes", "cells", "low", "step", F.col("queries.query").alias("query"), F.flatten("queries.ints").alias("ints"))
    arrow_batches(spark, 4)  # each row is a block
    candidates = written(bounds.mapInArrow(_scan(k), "query bigint, class bigint, low double, high double"), "candidates")
    arrow_batches(spark)
    sure = smallest(candidates, ["query"], [F.col("low").desc()], k + 1).groupBy("query").agg(F.min("low").alias("sure"))
    possible = candidates.join(sure, "query").filter("high >= sure").select("query", "class", "high")
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.col("high").desc(), "class"))
    possible = written(possible.withColumn("place", order), "possible")
    exact = classes.select("class", "ids", F.col("ints").alias("theirs"))

    def scores(part: DataFrame) -> DataFrame:
        product = F.aggregate(F.zip_with("ints", "theirs", lambda x, y: x * y), F.lit(0).cast("bigint"), lambda total, x: total + x)
        both = part.join(queries, "query").join(exact, "class")
        each = both.select("query", "query_id", product.alias("score"), F.explode("ids").alias("vec_id"))
        return each.filter("vec_id <> query_id")

    best = [F.col("score").desc(), F.col("vec_id")]
    first = written(scores(possible.filter(F.col("place") <= FIRST * k)), "first-scores")
    kth = smallest(first, ["query"], best, k).groupBy("query").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
    rest = possible.filter(F.col("place") > FIRST * k).join(kth, "query", "left")
    rest = rest.filter(F.col("kth").isNull() | (F.col("n") < k) | (F.col("high") >= F.col("kth"))).select("query", "class")
    found = smallest(first.unionByName(scores(rest)).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*best))), ["query"], best, k)
    return found.select("query_id", "rank", "vec_id", "score")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        lists = batch.column("ints")
        lengths = np.diff(lists.offsets.to_numpy())
        values = lists.flatten().to_numpy().astype(np.float64)
        starts = lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
        names = batch.column("class").to_numpy()
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            data = values[starts[own][:, None] + np.arange(length)]
            low, high = data.min(0), data.max(0)
            step = np.maximum((high - low) / CELLS, 1e-9)
            cells = np.minimum((data - low) / step, CELLS - 1).astype(np.uint8)
            columns = [part * (1 << 32) + number, length, names[own].tobytes(), cells.tobytes(), low.tobytes(), step.tobytes()]
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, kinds)], names=["block", "length", "classes", "cells", "low", "step"])


def _scan(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                length = batch.column("length")[i].as_py()
                classes, cells, low, step = (
                    np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in (("classes", np.int64), ("cells", np.uint8), ("low", np.float64), ("step", np.float64))
                )
                asked = np.asarray(batch.column("query")[i].values)
                questions = np.asarray(batch.column("ints")[i].values).astype(np.float64).reshape(-1, length)
                middle = low + (cells.reshape(-1, length) + 0.5) * step
                # Cells have the same width everywhere, so both bounds lie equally far from the score of the middle.
                slack = np.abs(questions) @ (step / 2) * (1 + 1e-9) + 1e-3
                score = questions @ middle.T
                size = score.shape[1]
                floor = np.full(len(asked), -np.inf)
                if size > k + 1:
                    floor = np.partition(score, size - k - 1, axis=1)[:, size - k - 1] - slack
                q, v = np.nonzero(score + slack[:, None] >= floor[:, None])
                near = score[q, v]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked[q]), pa.array(classes[v]), pa.array(near - slack[q]), pa.array(near + slack[q])], names=["query", "class", "low", "high"]
                )

    return run
