"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import WORD, running, with_place, written

WEIGHTS = (1, 2, 3)
MOST = 3  # times a document may be taken
SEED = "mix"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, budget: int | None = None) -> DataFrame:
    """Add ``target`` and ``start`` (sizes of earlier sources) to one row per source (``source, size``).

    Sources in code point order, null last, weigh ``weights`` in turn and share ``budget`` (by default
    the sum of all sizes). A target stops at ``most`` times its source's size and the excess is shared
    again by weight until none is above. Each sharing is one aggregate over the table of sources, so
    there may be any number of them; the level only rises, so the loop ends.
    """
    ranked = running(sizes.withColumn("one", F.lit(1).cast("bigint")), [F.col("source").isNull(), F.col("source")], ["size", "one"], "sources")
    choice = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (F.col("one_before") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", choice)
    level, full = 0.0, -1
    while True:
        capped = F.col("weight") * F.lit(level) > F.lit(float(most)) * F.col("size") if full >= 0 else F.lit(False)
        row = ranked.agg(
            F.sum("size"), F.sum(F.when(capped, most * F.col("size"))), F.sum(F.when(capped, 0).otherwise(F.col("weight"))), F.sum(F.when(capped, 1).otherwise(0))
        ).first()
        total, kept, weight, count = (x or 0 for x in row)
        if count == full or not weight:
            break
        level, full = float((total if budget is None else budget) - kept) / float(weight), count
    share = F.least(F.col("weight") * F.lit(level), F.lit(float(most)) * F.col("size"))
    return ranked.select("source", "size", share.alias("target"), F.col("size_before").alias("start"))


def fair_mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    budget: int | None = None,
    seed: str = SEED,
) -> tuple[DataFrame, DataFrame]:
    """What a mix takes of every document, and the mix itself.

    The first table has one row per document: ``doc_id, source, size`` (words ``[^\\x20\\x09-\\x0D]+``),
    ``source_size, target, taken`` and ``file, at`` (where the row is stored). The second has one row
    per document and copy taken: ``rank`` of the document, ``copy, words, finish`` (virtual finish
    time) and ``words_before`` (words that the mix takes earlier).

    Every source is a queue of its documents in hash order, ``most`` times over. A copy's virtual
    finish time is the words of its source up to its end, divided by the source's target. Copies of
    all sources are range sorted by finish time, ties by source and queue, and the stream is cut at the budget, by default the sum of
    the targets. Only the cut says what is taken: at any point of the stream all queues have been served to nearly the
    same virtual time, so at the cut each source is within one document of its target. The copy in service at
    the cut counts in part; a reader that wants whole documents takes it if at least half of it is in.

    Sorting and running totals touch ids, sources and sizes only. A source that holds most rows is
    split by the hash order like any other range. Null or empty texts have no words and are never
    taken; a null source is a source; a null id is an id; repeated rows queue one after another. The
    order is by id and size alone, so reruns agree.
    """
    return _fair_mix(with_place(docs), weights, most, budget, seed)


def _fair_mix(rows: DataFrame, weights: tuple[int, ...], most: int, budget: int | None, seed: str) -> tuple[DataFrame, DataFrame]:
    narrow = rows.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("row.source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("row.text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        "file",
        "at",
    )
    narrow = written(narrow.withColumn("hash", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))), "sizes")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("size"))
    targets = written(source_targets(sizes, weights, most, budget), "targets")
    # The row's place breaks ties of ids that repeat, for the ranges only: equal ids and sizes may swap.
    order = [F.col("source").isNull(), F.col("source"), F.col("hash"), F.col("doc_id"), F.col("size"), F.xxhash64("file"), F.col("at")]
    queued = running(narrow.withColumn("one", F.lit(1).cast("bigint")), order, ["size", "one"], "queued")
    own = targets.select(F.col("source").alias("own"), F.col("size").alias("source_size"), "target", "start")
    queued = queued.join(own, F.col("source").eqNullSafe(F.col("own")), "left").withColumn("begin", F.col("size_before") - F.col("start"))
    queued = queued.withColumnRenamed("one_before", "rank").select("rank", "doc_id", "source", "size", "source_size", "target", "begin", "file", "at")
    copies = queued.withColumn("copy", F.explode(F.array(*[F.lit(c).cast("bigint") for c in range(most)])))
    copies = copies.withColumn("from", F.col("copy") * F.col("source_size") + F.col("begin"))
    finish = (F.col("from") + F.col("size")) / F.col("target")
    copies = copies.filter("size > 0 AND target > 0").select("rank", "copy", F.col("size").alias("words"), finish.alias("finish"))
    stream = running(copies, [F.col("finish"), F.col("rank"), F.col("copy")], ["words"], "stream")
    if budget is None:
        # The sizes that targets share; what sources cannot take is in no target.
        budget = round(targets.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0])
    stream = stream.filter(F.col("words_before") < budget).withColumn("words", F.least("words", F.lit(budget) - F.col("words_before")))
    taken = stream.groupBy("rank").agg(F.sum("words").alias("taken"))
    per_document = queued.join(taken, "rank", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("bigint")))
    return per_document.select("doc_id", "source", "size", "source_size", "target", "taken", "file", "at"), stream


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The whole documents of the mix, each as often as it is taken, rounded to the nearest copy.

    A document without words is no part of a mix of words; it stays once, as nothing speaks against it.
    """
    rows = with_place(docs)
    plan = _fair_mix(rows, weights, most, None, SEED)[0]
    copies = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size")).cast("int"))
    chosen = plan.select("file", "at", copies.alias("__copies")).filter("__copies > 0")
    return rows.join(chosen, ["file", "at"]).withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select("row.*")
