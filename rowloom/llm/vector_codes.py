"""Codes of vectors by a codebook per part, trained and assigned exactly in whole numbers.

The parts of a block of vectors at one position form a trie: its distinct parts in lexicographic order, whose common
beginnings are shared. The walk goes depth first and carries, for the beginning it stands on, the distances to
all entries so far; a step down adds one dimension. At the leaves the smallest distance decides, and the leaf's
components count as often as the part occurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import arrow_batches
from rowloom.session import written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = 1 << 24  # of a component, so that no distance or sum leaves 64 bits
BLOCK_ROWS = 1 << 14
LEAVES = 1 << 12  # leaves that are walked together
FAN_IN = 64


def trie(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct parts in order, the first dimension in which each differs from the one before, counts, and each row's leaf."""
    order = np.lexsort(parts.T[::-1]) if parts.shape[1] else np.arange(len(parts))
    rows = parts[order]
    unequal = rows[1:] != rows[:-1]
    first = np.ones(len(rows), bool)
    first[1:] = unequal.any(axis=1)
    branch = np.zeros(len(rows), np.int64)
    if parts.shape[1]:
        branch[1:] = unequal.argmax(axis=1)
    leaf = np.empty(len(rows), np.int64)
    leaf[order] = np.cumsum(first) - 1
    begins = np.flatnonzero(first)
    return rows[begins], branch[begins], np.diff(np.append(begins, len(rows))), leaf


def nearest(leaves: np.ndarray, branch: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each leaf, the lowest of equally near ones, and its squared distance."""
    codes, errors = np.empty(len(leaves), np.int64), np.empty(len(leaves), np.int64)
    # (dimensions shared, first leaf, end, distances over the shared dimensions); the last entry is walked next.
    waiting = [(0, 0, len(leaves), np.zeros(len(book), np.int64))] if len(leaves) else []
    while waiting:
        depth, begin, end, so_far = waiting.pop()
        if end - begin <= LEAVES:
            _descend(leaves, branch, book, depth, begin, end, so_far, codes, errors)
            continue
        children = begin + np.flatnonzero(branch[begin:end] <= depth)
        children = np.append(children if len(children) and children[0] == begin else np.insert(children, 0, begin), end)
        at = 0
        while at < len(children) - 1:
            # Neighbouring small children are walked together; a large one goes down by itself.
            to = max(at + 1, int(np.searchsorted(children, children[at] + LEAVES, "right")) - 1)
            if children[to] - children[at] <= LEAVES:
                _descend(leaves, branch, book, depth, children[at], children[to], so_far, codes, errors)
            else:
                step = leaves[children[at], depth] - book[:, depth]
                waiting.append((depth + 1, children[at], children[to], so_far + step * step))
            at = to
    return codes, errors


def _descend(leaves, branch, book, depth, begin, end, so_far, codes, errors) -> None:
    """Walk all leaves from ``begin`` to ``end``, which share ``depth`` dimensions, one dimension at a time."""
    distances, parent = so_far[None, :], np.zeros(end - begin, np.int64)
    for dimension in range(depth, leaves.shape[1]):
        new = branch[begin:end] <= dimension
        new[0] = True
        nodes = np.flatnonzero(new)
        step = leaves[begin + nodes, dimension][:, None] - book[None, :, dimension]
        distances = distances[parent[nodes]] + step * step
        parent = np.cumsum(new) - 1
    best = distances.argmin(axis=1)
    codes[begin:end] = best[parent]
    errors[begin:end] = distances[np.arange(len(best)), best][parent]


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray]]:
    """Batches that make a block, and its vectors cut into parts: row, position, dimension."""

    def block():
        flat = np.concatenate([b.column("vector").flatten().to_numpy(zero_copy_only=False) for b in held])
        return held, flat.astype(np.int64).reshape(sum(b.num_rows for b in held), PARTS, width)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK_ROWS:
            yield block()
            held = []
    if any(b.num_rows for b in held):
        yield block()


def _sums(books: np.ndarray) -> Callable:
    """One row per task: for each position and entry how many parts are nearest, and their sums."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, books.shape[1], 1 + width), np.int64)
        for _, vectors in _blocks(batches, width):
            for position in range(PARTS):
                leaves, branch, counts, _ = trie(vectors[:, position])
                codes, _ = nearest(leaves, branch, books[position])
                weighted = np.concatenate((counts[:, None], leaves * counts[:, None]), axis=1)
                np.add.at(total[position], codes, weighted)
        slot = pa.array([TaskContext.get().partitionId()], pa.int32())
        yield pa.RecordBatch.from_arrays([slot, pa.array([total.tobytes()], pa.binary())], names=["slot", "total"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for data in batch.column("total").to_pylist():
            found = np.frombuffer(data, np.int64)
            total = found if total is None else total + found
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])


def _codes(books: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, vectors in _blocks(batches, books.shape[2]):
            codes, errors = np.empty((len(vectors), PARTS), np.uint8), np.zeros(len(vectors), np.int64)
            for position in range(PARTS):
                leaves, branch, _, leaf = trie(vectors[:, position])
                best, distance = nearest(leaves, branch, books[position])
                codes[:, position] = best[leaf]
                errors += distance[leaf]
            digits, at = codes.tobytes().hex(), 0
            for batch in held:
                rows = range(at, at + batch.num_rows)
                told = [digits[2 * PARTS * r : 2 * PARTS * (r + 1)] for r in rows]
                columns = [batch.column("vec_id"), batch.column("label"), pa.array(told, pa.string()), pa.array(errors[at : rows.stop])]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])
                at = rows.stop

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, vector``: vectors without null or non-finite components, times 256 and rounded down."""
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return kept.filter(whole).select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x * SCALE)).alias("vector"), F.array_max(F.transform("embedding", F.abs)).alias("largest"))


def first_entries(kept: DataFrame, count: int) -> list[list[int]]:
    """The vectors of the ``count`` smallest ids; the least vector where an id has several."""
    ids = kept.filter("vec_id IS NOT NULL").select("vec_id").distinct().orderBy("vec_id").limit(count)
    found = kept.join(F.broadcast(ids), "vec_id").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return [row["vector"] for row in found.orderBy("vec_id").collect()]


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Codes of all usable rows of ``vec_id, embedding, label``, and the codebooks: position, entry, dimension.

    Returns ``vec_id, label, code, error``; ``code`` has two hexadecimal digits per part, ``error`` is the squared distance to
    the coded vector. Rows whose vector is null or has null or non-finite components are left out. Entries start as
    the vectors of the smallest ids and move to the mean of their parts, rounded down; rows without an id are
    coded, but never start an entry. Repeated rows count as often as they occur. No usable row with an id: no entries and no
    rows. All vectors need one length that the number of parts divides, and components below 65,536; others are an
    error before training.

    Each round reads the vectors once. What a task adds up has a fixed size; tasks' sums are added in
    parallel before the last few reach the driver, which also sees the first entries. No vector is shuffled.
    """
    spark = vectors.sparkSession
    arrow_batches(spark, 4096)
    kept = usable(vectors)
    told = kept.agg(F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most"), F.max("largest").alias("largest")).first()
    length = told["least"] or 0
    if told["most"] is not None and (told["most"] != length or length % PARTS):
        raise ValueError(f"vectors of {length} to {told['most']} components cannot be cut into {PARTS} equal parts")
    if (told["largest"] or 0) * SCALE >= LARGEST:
        raise ValueError(f"a component of {told['largest']} is too large")
    start = first_entries(kept, entries)
    width = length // PARTS
    # position, entry, dimension
    books = np.array(start, np.int64).reshape(len(start), PARTS, width).transpose(1, 0, 2)
    rows = kept.select("vec_id", "label", "vector") if start else kept.select("vec_id", "label", "vector").limit(0)
    for _ in range(rounds if start else 0):
        sums = rows.select("vector").mapInArrow(_sums(books), "slot int, total binary")
        added = sums.repartition(FAN_IN, "slot").select("total").mapInArrow(_add, "total binary").collect()
        total = sum(np.frombuffer(row["total"], np.int64) for row in added).reshape(PARTS, len(start), 1 + width)
        counts, totals = total[:, :, :1], total[:, :, 1:]
        books = np.where(counts > 0, totals // np.maximum(counts, 1), books)
    return rows.mapInArrow(_codes(books), "vec_id bigint, label int, code string, error bigint"), books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal by position, entry and dimension, with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Add ``label_error``, the sum of ``error`` over the rows of a label; rows without a label are together."""
    kept = written(codes, "vector-codes")
    sums = kept.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return kept.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")
