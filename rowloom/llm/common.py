"""What several operators of this package share: working tables, running totals, words as hashes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rowloom.session import written

# Whole texts cross to Python in small batches, so that a worker's memory does not depend on the table.
ARROW_ROWS = 256
PIECE = 1 << 17  # bytes whose words are hashed at once
WORD = "[^\\x20\\x09-\\x0D]+"
U64 = np.uint64


def arrow_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound what one Arrow batch holds; it stays set, as results are evaluated later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows the driver made, as one Arrow batch."""
    kinds = T._parse_datatype_string(schema)
    columns = list(zip(*rows)) if rows else [() for _ in kinds.fields]
    arrow = to_arrow_schema(kinds)
    return spark.createDataFrame(pa.table([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow), kinds)


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns but those an operator adds itself, compared as Spark does, without case."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def running(df: DataFrame, order: Sequence[Column], sums: Sequence[str], label: str) -> DataFrame:
    """Add ``<s>_before`` for each long column: its total over all rows that come earlier in ``order``.

    Rows are range partitioned and sorted, each task adds up its own rows, and the totals of the
    tasks (one row per partition) shift them. No row passes the driver, no group meets in one task
    because it is large, only because its rows are equal in every order column. Null counts 0.
    The order should tell rows apart; rows that are equal in it share the totals in any order.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = [f"{s}_before" for s in sums]
    schema = T.StructType([*df.schema.fields, *[T.StructField(b, T.LongType()) for b in before], T.StructField("__part", T.IntegerType())])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, so_far = TaskContext.get().partitionId(), dict.fromkeys(sums, 0)
        for batch in batches:
            more = []
            for s in sums:
                values = batch.column(s).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(values)
                more.append(pa.array(so_far[s] + total - values))
                so_far[s] += int(total[-1]) if len(total) else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, *more, pa.array(np.full(batch.num_rows, part, np.int32))], names=schema.names)

    sorted_rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = written(sorted_rows.mapInArrow(add_up, schema), label)
    ends = found.groupBy("__part").agg(*[F.sum(F.coalesce(F.col(s), F.lit(0))).alias(s) for s in sums]).orderBy("__part").collect()
    shifts, total = [], [0] * len(sums)
    for row in ends:
        shifts.append((row["__part"], *total))
        total = [t + row[s] for t, s in zip(total, sums)]
    shift = small_table(spark, shifts, ", ".join(["__part int", *[f"`__{b}` bigint" for b in before]]))
    moved = {b: F.col(b) + F.col(f"__{b}") for b in before}
    return found.join(F.broadcast(shift), "__part").withColumns(moved).drop("__part", *[f"__{b}" for b in before])


def smallest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], count: int) -> DataFrame:
    """The first ``count`` rows of each key. A hot key is cut down in every map task before the shuffle."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("__rank") <= count).drop("__rank")


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words:
    """Words of UTF-8 texts as 64-bit hashes, with A-Z lower-cased; all with numpy over many bytes."""

    def __init__(self) -> None:
        self.white = np.zeros(256, bool)
        self.white[[9, 10, 11, 12, 13, 32]] = True
        self.value = np.arange(1, 257, dtype=np.uint64)
        self.value[65:91] += U64(32)
        self._grow(PIECE)

    def _grow(self, size: int) -> None:
        p = 0x9E3779B97F4A7C15
        for name, base in (("power", p), ("inverse", pow(p, -1, 1 << 64))):
            table = np.full(size + 1, base, np.uint64)
            table[0] = 1
            setattr(self, name, np.cumprod(table))

    def _piece(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(data) >= len(self.power):
            self._grow(len(data))
        edge = np.concatenate(([True], self.white[data], [True]))
        change = np.flatnonzero(edge[1:] != edge[:-1])
        starts, ends = change[::2], change[1::2]
        total = np.concatenate(([U64(0)], np.cumsum(self.value[data] * self.power[: len(data)])))
        return mix((total[ends] - total[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64)), starts, ends

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, first bytes and end bytes of the words of one text; long texts go piece by piece."""
        data = np.frombuffer(text, np.uint8)
        if len(data) <= PIECE:
            return self._piece(data)
        found, at = [], 0
        while at < len(data):
            end = min(at + PIECE, len(data))
            while end < len(data) and not self.white[data[end]]:
                end += 1
            h, s, e = self._piece(data[at:end])
            found.append((h, s + at, e + at))
            at = end
        return tuple(np.concatenate(x) for x in zip(*found))

    def of_many(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """The word hashes of each text in turn; short texts are hashed together."""
        waiting: list[bytes] = []
        size = 0
        for text in [*texts, None]:
            text = text or b""
            if waiting and size + len(text) > PIECE:
                yield from self._together(waiting)
                waiting, size = [], 0
            if len(text) > PIECE:
                yield self.of(text)[0]
            else:
                waiting.append(text)
                size += len(text) + 1
        yield from self._together(waiting[:-1])

    def _together(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if not texts:
            return
        hashes, starts, _ = self._piece(np.frombuffer(b"\n".join(texts), np.uint8))
        ends = np.cumsum([len(t) + 1 for t in texts])
        cuts = np.searchsorted(starts, ends)
        yield from np.split(hashes, cuts)[: len(texts)]


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of the whole sequence if it is shorter; none without words."""
    size = min(size, len(words))
    if not size:
        return words
    out = np.zeros(len(words) - size + 1, np.uint64)
    factor = 0xD6E8FEB86659FD93
    for j in range(size):
        out += words[j : len(words) - size + 1 + j] * U64(pow(factor, j + 1, 1 << 64))
    return mix(out + U64(size))


def text_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    column = batch.column(name)
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def with_place(df: DataFrame) -> DataFrame:
    """``row`` (all columns as one struct, so no name can clash), ``file`` and ``at``: where the row is stored.

    File and row number tell repeated rows apart and stay the same when a task runs again. Rows that
    do not come straight from files are written to the shared folder first.
    """
    packed = F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]
    if "_metadata" not in df.columns:
        try:
            return df.select(packed, *place)
        except AnalysisException:
            pass
    return written(df.select(packed), "placed").select("row", *place)
