"""Resharding that moves the fewest bytes: a minimum-cost flow over shard sizes, then rewritten files."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm.common import quoted, small_table, with_place, written
from rowloom.session import fresh_path

OLD_SHARDS = 1024  # more files than that are bundled, neighbours by name together
LARGE = 256  # a text of more than this fraction of a shard is placed by itself
BINS = 65536  # counts that one step of the search for cuts may return
FEW = 10_000  # rows of a table of files that is broadcast
RECORD_BYTES = 8


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost: np.ndarray) -> np.ndarray:
    """Cheapest flow that ships every supply within the capacities; ``cost`` is per unit, not negative.

    Successive shortest paths with potentials on the bipartite graph of shards. The sum of the
    capacities must reach the sum of the supplies.
    """
    m, n = cost.shape
    if sum(capacity) < sum(supply):
        raise ValueError("the new shards hold less than the old ones")
    flow = np.zeros((m, n), np.int64)
    left, room = np.array(supply, np.int64), np.array(capacity, np.int64)
    high_left, high_right = np.zeros(m), np.zeros(n)
    endless = np.inf
    while left.any():
        far_left = np.where(left > 0, 0.0, endless)
        far_right, from_left, from_right = np.full(n, endless), np.full(n, -1), np.full(m, -1)
        open_left, open_right = np.ones(m, bool), np.ones(n, bool)
        while True:
            a = int(np.argmin(np.where(open_left, far_left, endless)))
            b = int(np.argmin(np.where(open_right, far_right, endless)))
            da, db = (far_left[a] if open_left[a] else endless), (far_right[b] if open_right[b] else endless)
            if min(da, db) == endless:
                break
            if da <= db:
                open_left[a] = False
                reach = da + np.maximum(cost[a] + high_left[a] - high_right, 0)
                better = reach < far_right
                far_right[better], from_left[better] = reach[better], a
            else:
                open_right[b] = False
                reach = np.where(flow[:, b] > 0, db + np.maximum(high_right[b] - high_left - cost[:, b], 0), endless)
                better = reach < far_left
                far_left[better], from_right[better] = reach[better], b
        true_far = np.where(room > 0, far_right + high_right, endless)
        end = int(np.argmin(true_far))
        path, b = [], end
        while True:
            a = int(from_left[b])
            path.append((a, b, 1))
            if from_right[a] < 0:
                break
            b = int(from_right[a])
            path.append((a, b, -1))
        amount = min([int(left[a]), int(room[end]), *[int(flow[i, j]) for i, j, sign in path if sign < 0]])
        for i, j, sign in path:
            flow[i, j] += sign * amount
        left[a] -= amount
        room[end] -= amount
        high_left += np.where(far_left < endless, far_left, 0)
        high_right += np.where(far_right < endless, far_right, 0)
    return flow


def even_capacities(total: int, shards: int, large: Sequence[int]) -> tuple[list[int], int]:
    """Equal capacities, but for texts larger than an equal share: each of those gets a shard of its own size.

    Returns the capacities of the other shards and how many texts (the largest) have their own.
    """
    alone, rest = 0, total
    ordered = sorted(large, reverse=True)
    while alone < min(len(ordered), shards - 1) and ordered[alone] * (shards - alone) > rest:
        rest -= ordered[alone]
        alone += 1
    base, more = divmod(rest, shards - alone)
    return [base + (j < more) for j in range(shards - alone)], alone


def reshard(docs: DataFrame, shards: int = 24, text_column: str = "text", cost: Callable[[int, int], int] | None = None) -> DataFrame:
    """Write ``docs`` anew as ``shards`` shards of nearly equal bytes, moving as few bytes as possible.

    The files that ``docs`` is stored in are the old shards. A row weighs the UTF-8 bytes of its text
    and 8 more; a null text has none. Returns all columns with ``shard`` and ``slot`` (0, 1, ... in a
    shard), read from the shards' files; columns of these names are replaced.

    The largest old shards live on as new ones. A minimum-cost flow from old sizes to new capacities
    (0 within a shard, else ``cost(old, new)``, by default 1, per byte) says how many bytes go where. Flows
    become blocks: texts of more than 1/256 of a shard are placed one by one into the flow
    with most room left, all others in runs of neighbouring rows, which are cut at row numbers
    found by a few histograms. Shards then miss their capacity by about half a small text per run.

    Rows that stay are rewritten where they are read, without a shuffle; an old shard that loses nothing is not
    rewritten at all. Rows that move are range partitioned by shard and place, so a shard of any size is
    written by many tasks. The driver holds one row per file, as it does for any scan, at most
    6,144 large texts and 65,536 histogram counts. A text larger than a shard gets one of its own. Null ids,
    repeated rows and empty tables need no special care, as rows are told apart by where they are stored.
    """
    spark = docs.sparkSession
    placed = with_place(docs)
    size = (F.coalesce(F.octet_length(F.col(f"row.{quoted(text_column)}").cast("string")), F.lit(0)) + RECORD_BYTES).cast("bigint").alias("size")
    sizes = written(placed.select("file", "at", size), "row-sizes")
    plan = _Plan(spark, sizes, shards, cost)
    targets = _targets(plan, placed.join(plan.file_table(), "file").withColumn("pos", F.col("first") + F.col("at")))
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    out = fresh_path(spark, "shards")
    columns = [F.col(f"row.{quoted(c)}") for c in names]
    rewritten = targets.filter(F.col("touched"))
    stays = rewritten.filter("shard = home").select(*columns, F.col("shard").alias("__shard"))
    moves = rewritten.filter("home IS NULL OR shard <> home")
    parts = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    moves = moves.repartitionByRange(parts, "shard", "old", "pos").select(*columns, F.col("shard").alias("__shard"))
    stays.write.partitionBy("__shard").parquet(out)
    moves.write.mode("append").partitionBy("__shard").parquet(out)
    # Partition folders are read as they were written, and an empty table has none.
    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField("__shard", T.IntegerType())])
    new = spark.read.schema(schema).parquet(out).select(
        F.struct(*[F.col(quoted(c)) for c in names]).alias("row"),
        F.col("__shard").alias("shard"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("at"),
    )
    if plan.untouched:
        kept = targets.filter(~F.col("touched")).select(F.struct(*columns).alias("row"), "shard", "file", "at")
        new = new.unionByName(kept)
    found = new.groupBy("shard", "file").agg(F.count("*").alias("n")).orderBy("shard", "file").collect()
    bases, so_far = [], defaultdict(int)
    for row in found:
        bases.append((row["shard"], row["file"], so_far[row["shard"]]))
        so_far[row["shard"]] += row["n"]
    base = _checked(small_table(spark, bases, "shard int, file string, base bigint"), len(bases))
    return new.join(base, ["shard", "file"]).select("row.*", "shard", (F.col("base") + F.col("at")).alias("slot"))


def _checked(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df


def _targets(plan: _Plan, rows: DataFrame) -> DataFrame:
    """Rows with ``old, pos, home, touched`` and their new ``shard``."""
    spark = rows.sparkSession
    single = small_table(spark, plan.single, "old int, pos bigint, own int")
    runs = small_table(spark, plan.runs, "old int, low bigint, high bigint, run int")
    homes = small_table(spark, plan.homes, "old int, home int, touched boolean")
    found = rows.join(F.broadcast(single), ["old", "pos"], "left")
    # Every row lies in one run of its old shard, also those that are placed by themselves.
    found = found.join(F.broadcast(runs), (found["old"] == runs["old"]) & (F.col("pos") >= F.col("low")) & (F.col("pos") < F.col("high"))).drop(runs["old"])
    return found.join(F.broadcast(homes), "old").withColumn("shard", F.coalesce("own", "run"))


class _Plan:
    """What the driver decides from sizes alone."""

    def __init__(self, spark: SparkSession, sizes: DataFrame, shards: int, cost: Callable[[int, int], int] | None) -> None:
        self.spark = spark
        self.files = sizes.groupBy("file").agg(F.sum("size").alias("bytes"), (F.max("at") + 1).alias("rows")).orderBy("file").collect()
        self._bundle()
        total = sum(self.old_bytes)
        self.sizes = sizes.join(self.file_table(), "file").select("old", (F.col("first") + F.col("at")).alias("pos"), "size")
        large = self.sizes.filter(F.col("size") * F.lit(LARGE * shards) > F.lit(total)).orderBy(F.col("size").desc(), "old", "pos").collect()
        rooms, alone = even_capacities(total, shards, [r["size"] for r in large])
        self._homes(shards, rooms, large[:alone])
        stay = np.ones((len(self.old_bytes), shards), np.int64)
        if cost is not None:
            stay = np.array([[cost(i, j) for j in range(shards)] for i in range(len(self.old_bytes))], np.int64).reshape(-1, shards)
        for old, home in enumerate(self.home):
            if home is not None:
                stay[old, home] = 0
        self.flow = min_cost_flow(self.left, self.room, stay)
        self._blocks(large[alone:])

    def _bundle(self) -> None:
        per_shard = -(-max(1, len(self.files)) // OLD_SHARDS)
        self.old_bytes, self.old_rows, self.where = [], [], []
        for k, f in enumerate(self.files):
            if k % per_shard == 0:
                self.old_bytes.append(0)
                self.old_rows.append(0)
            self.where.append((f["file"], len(self.old_bytes) - 1, self.old_rows[-1]))
            self.old_bytes[-1] += f["bytes"]
            self.old_rows[-1] += f["rows"]

    def file_table(self) -> DataFrame:
        return _checked(small_table(self.spark, self.where, "file string, old int, first bigint"), len(self.where))

    def _homes(self, shards: int, rooms: list[int], alone: list) -> None:
        """New shards of old ones, and the shards of texts that fill one by themselves."""
        self.left = list(self.old_bytes)
        self.home: list[int | None] = [None] * len(self.left)
        self.single = []
        free = list(range(shards))
        living = sorted(sorted(range(len(self.left)), key=lambda i: -self.left[i])[: shards - len(alone)])
        for old in living:
            self.home[old] = free.pop(0)
        self.room = [0] * shards
        for row in alone:
            own = free.pop()
            self.single.append((row["old"], row["pos"], own))
            self.left[row["old"]] -= row["size"]
        taken = {own for _, _, own in self.single}
        for j, room in zip((j for j in range(shards) if j not in taken), rooms):
            self.room[j] = room

    def _blocks(self, large: list) -> None:
        by_old = defaultdict(list)
        for row in large:
            by_old[row["old"]].append(row)
        cuts, self.runs, self.homes = [], [], []
        alone = {old for old, _, _ in self.single}
        for old, home in enumerate(self.home):
            order = sorted((int(j) for j in np.flatnonzero(self.flow[old])), key=lambda j: (j != home, j))
            room = {j: int(self.flow[old, j]) for j in order}
            self.homes.append((old, home, order != [home] or old in alone))
            if not order:
                order, room = [home if home is not None else 0], {home if home is not None else 0: 0}
            for row in by_old[old]:
                into = max(order, key=lambda j: (room[j], j == home))
                room[into] -= row["size"]
                self.single.append((old, row["pos"], into))
            # What a large text overfills is taken from the other runs in turn.
            over = -sum(r for r in room.values() if r < 0)
            for j in sorted(order, key=lambda j: -room[j]):
                less = min(over, max(room[j], 0))
                room[j], over = max(room[j], 0) - less, over - less
            offset = 0
            for j in order[:-1]:
                offset += room[j]
                cuts.append((old, offset))
            self.runs.append([old, order])
        self.untouched = any(not touched for _, _, touched in self.homes)
        found = self._cut(cuts)
        runs, at = [], 0
        for old, order in self.runs:
            low = 0
            for j in order[:-1]:
                high = max(low, found[at])
                runs.append((old, low, high, j))
                low, at = high, at + 1
            runs.append((old, low, max(self.old_rows[old], low), order[-1]))
        self.runs = runs

    def _cut(self, cuts: list[tuple[int, int]]) -> list[int]:
        """Row numbers at which the bytes of small texts before them come nearest to each offset."""
        single = F.broadcast(small_table(self.spark, [(o, p) for o, p, _ in self.single], "old int, pos bigint"))
        small = self.sizes.join(single, ["old", "pos"], "left_anti")
        state = [[old, 0, self.old_rows[old], offset] for old, offset in cuts]
        factor = max(16, BINS // max(1, len(cuts)))
        while any(high - low > 1 for _, low, high, _ in state):
            ranges = sorted({(old, low, high, -(-(high - low) // factor)) for old, low, high, _ in state if high - low > 1})
            table = F.broadcast(small_table(self.spark, ranges, "old int, low bigint, high bigint, step bigint"))
            inside = small.join(table, "old").filter("pos >= low AND pos < high")
            bins = inside.groupBy("old", "low", F.expr("(pos - low) div step").alias("bin")).agg(F.sum("size").alias("bytes")).collect()
            counted = defaultdict(dict)
            for row in bins:
                counted[row["old"], row["low"]][row["bin"]] = row["bytes"]
            for cut in state:
                old, low, high, offset = cut
                if high - low > 1:
                    step, before, at = -(-(high - low) // factor), 0, 0
                    for at in sorted(counted[old, low]) or [0]:
                        more = counted[old, low].get(at, 0)
                        if before + more > offset:
                            break
                        before += more
                    else:
                        at = (high - low - 1) // step  # all of it lies before the cut
                    cut[1:] = [low + at * step, min(high, low + (at + 1) * step), offset - before]
        last = small_table(self.spark, sorted({(old, low) for old, low, high, _ in state if high > low}), "old int, pos bigint")
        sizes = {(r["old"], r["pos"]): r["size"] for r in small.join(F.broadcast(last), ["old", "pos"]).collect()}
        return [low + (2 * offset > sizes.get((old, low), 0)) if high > low else low for old, low, high, offset in state]
