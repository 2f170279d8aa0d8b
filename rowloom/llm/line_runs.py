"""Line deduplication with levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import quoted, with_place, written
from rowloom.session import fresh_path

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["k1", "k2"]


class LineRuns:
    """Line keys seen so far, as runs that are bucketed and sorted by key, so joins merge them in place.

    A run's row is ``k1, k2, docs, holder``: how many documents of its batch hold the line, and the
    document that keeps it, set by the batch that met the line first. ``fan`` runs of one level
    are compacted into one of the next, so the number of runs grows with the logarithm of the batches.
    """

    def __init__(self, spark: SparkSession, fan: int = 2, buckets: int | None = None) -> None:
        self.spark, self.fan = spark, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, list[str]] = defaultdict(list)

    def add(self, batch: DataFrame) -> None:
        """Merge-anti-join a batch (``k1, k2, doc``) with the runs and add it as a run of its own.

        Batches come with falling document numbers, so the largest document of the batch that first
        holds a line is the largest of all. Lines that a run knows add to its count only.
        """
        own = written(batch.distinct().groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("doc").alias("holder")), "batch-lines")
        fresh = own
        for name in self.names():
            fresh = fresh.join(self.spark.table(name), KEY, "left_anti")
        first = fresh.select(*KEY, F.col("holder").alias("mine"))
        # Without earlier runs all lines are fresh.
        entries = own if not self.names() else own.join(first, KEY, "left").select(*KEY, "docs", F.col("mine").alias("holder"))
        self._store(entries, 0)
        level = 0
        while len(self.levels[level]) >= self.fan:
            merging, self.levels[level] = self.levels[level], []
            self._store(self._merged(merging), level + 1)
            for name in merging:
                self.spark.sql(f"DROP TABLE {name}")
            level += 1

    def names(self) -> list[str]:
        return [name for level in sorted(self.levels) for name in self.levels[level]]

    def repeated(self, least: int) -> DataFrame:
        """``k1, k2, holder`` of the lines that at least ``least`` documents hold."""
        if not self.names():
            return self.spark.createDataFrame([], "k1 bigint, k2 bigint, holder bigint")
        return self._merged(self.names()).filter(F.col("docs") >= least).drop("docs")

    def close(self) -> None:
        """Forget the tables' names."""
        for name in self.names():
            self.spark.sql(f"DROP TABLE {name}")
        self.levels.clear()

    def _merged(self, names: list[str]) -> DataFrame:
        """The sorted runs merged bucket by bucket; a key of several runs adds up its documents."""
        rows = self.spark.table(names[0])
        for name in names[1:]:
            more = self.spark.table(name).withColumnsRenamed({"docs": "docs2", "holder": "holder2"})
            docs = (F.coalesce("docs", F.lit(0)) + F.coalesce("docs2", F.lit(0))).alias("docs")
            rows = rows.join(more, KEY, "full").select(*KEY, docs, F.greatest("holder", "holder2").alias("holder"))
        return rows

    def _store(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        placed = rows.select(*KEY, "docs", "holder").repartition(self.buckets, *KEY)
        placed.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", fresh_path(self.spark, "line-run")).saveAsTable(name)
        self.levels[level].append(name)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def drop_repeated_lines(docs: DataFrame, least_length: int = 40, least_docs: int = 5, batches: int = 4) -> DataFrame:
    """All columns of ``docs`` with ``n_lines``, ``n_dropped`` and ``kept`` (the text that is left).

    A text is split at line feeds; a null or empty one has one empty line. A line's key is the line
    without blanks ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Keys of at least ``least_length`` code points
    that at least ``least_docs`` documents hold lose their lines in all documents but the
    one with the largest ``doc_id``, which keeps all of them.

    Keys are 128 bits of hash. The documents come in ``batches`` of falling ids, as a growing corpus
    would: each merge-anti-joins the sorted runs of earlier ones and adds its own; see ``LineRuns``. A line in
    very many documents is counted per task before the shuffle, and finding its rows is a join with
    one row per key, whose hot left keys adaptive execution splits. Only the numbers of dropped
    lines are gathered per document. Rows with equal ids are one document; a null id is one document, smaller than any other.
    """
    spark = docs.sparkSession
    placed = with_place(docs)
    doc = F.coalesce(F.col("row.doc_id").cast("bigint"), F.lit(-(2**63)))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    each = placed.select("file", "at", doc.alias("doc"), F.posexplode(F.split(text, "\n", -1)).alias("line", "value"))
    keyed = each.select("file", "at", "doc", "line", line_key(F.col("value")).alias("key")).filter(F.char_length("key") >= least_length)
    hashes = [F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), F.reverse("key")).alias("k2")]
    lines = written(keyed.select("file", "at", "doc", "line", *hashes), "lines")
    runs = LineRuns(spark)
    ends = lines.agg(F.min("doc").alias("low"), F.max("doc").alias("high")).first()
    if ends["low"] is not None:
        low, width = ends["low"], -(-(ends["high"] - ends["low"] + 1) // batches)
        for number in reversed(range(batches)):
            runs.add(lines.filter(F.col("doc").between(low + number * width, min(low + (number + 1) * width - 1, 2**63 - 1))).select("doc", *KEY))
    repeated = written(runs.repeated(least_docs), "repeated-lines")
    runs.close()
    gone = lines.join(repeated, KEY).filter("doc <> holder").groupBy("file", "at").agg(F.collect_list("line").alias("gone"))
    split = F.split(F.coalesce(F.col("row.text").cast("string"), F.lit("")), "\n", -1)
    found = placed.join(gone, ["file", "at"], "left").withColumn("lines", split).withColumn("n", F.size("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.col("n") - 1), "gone")
    kept = F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(left, lambda i: F.get("lines", i))), "\n")
    dropped = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    found = found.withColumns({"__lines": F.col("n").cast("bigint"), "__dropped": dropped.cast("bigint"), "__kept": kept})
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept")]
    added = [F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.col("__kept").alias("kept")]
    return found.select(*[F.col(f"row.{quoted(c)}") for c in names], *added)
