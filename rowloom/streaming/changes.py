"""The newest point per key of a stream: keyed state that forgets idle keys, and a log of changes in levels."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rowloom.session import delete, finished, names_in

# A level holds up to three runs; the fourth makes one run of the next level.
FAN_OUT = 4
ARRIVAL = "__arrival"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state with timers needs, and no batches without rows, for the queries started inside."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class Newest(StatefulProcessor):
    """Keeps the newest point of a key and hands it on when it has changed.

    A timer clears the state of a key that has been idle since its last arrival; its last point is in the log. A point that comes
    after that is handed on whatever its time is, and the log takes the newer of both.
    """

    def __init__(self, keys: list[str], point: T.StructType, idle_ms: int) -> None:
        self.keys, self.point, self.idle_ms = keys, point, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.point)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = tuple(self.last.get()) if self.last.exists() else None
        best, arrived = known, None
        for row in rows:
            arrived = row[ARRIVAL]
            point = tuple(row[f.name] for f in self.point)
            if best is None or _order(point) > _order(best):
                best = point
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(arrived.timestamp() * 1000) + self.idle_ms)
        if best != known:
            self.last.update(best)
            yield Row(**dict(zip(self.keys, key)), **dict(zip(self.point.names, best)))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def _order(point: tuple) -> tuple:
    """Time, then the tie-breaker; null comes first, as in Spark."""
    return tuple((x is not None, x) if x is not None else (False,) for x in point[:2])


def newest_changes(series: DataFrame, keys: list[str], value: str, ts: str, tie: str, idle_ms: int | None = None) -> DataFrame:
    """A stream of keys whose newest point has changed: keys, ``ts``, ``tie``, ``value``.

    A repeated or late point changes nothing. State is one point per key that had one within ``idle_ms``, or per key
    without it. A point is compared by its own time however late it is, and none is dropped. Without ``idle_ms`` the state is that of an
    aggregation. With it, a timer per key follows the time of arrival, which needs the state store named in ``STATE_STORE``.
    """
    rows = series.select(*keys, ts, tie, value, F.current_timestamp().alias(ARRIVAL))
    if idle_ms is None:
        return _newest_kept(rows, keys, value, ts, tie)
    rows = rows.withWatermark(ARRIVAL, "0 seconds")
    point = T.StructType([rows.schema[c] for c in (ts, tie, value)])
    out = T.StructType([rows.schema[c] for c in keys] + list(point))
    return rows.groupBy(*keys).transformWithState(Newest(keys, point, idle_ms), out, "Update", "EventTime")


def _newest_kept(rows: DataFrame, keys: list[str], value: str, ts: str, tie: str) -> DataFrame:
    """The newest point of each key, of equal ones the first to arrive; handed on by the batch in which it has arrived.

    All rows of a batch have the batch's time as that of their arrival, also if the batch is run again.
    """
    point = F.struct(F.col(ts), F.col(tie), (-F.unix_micros(ARRIVAL)).alias(ARRIVAL), F.col(value))
    newest = rows.groupBy(*keys).agg(F.max(point).alias("__last"))
    arrived = F.col(f"__last.{ARRIVAL}") == -F.unix_micros(F.current_timestamp())
    return newest.filter(arrived).select(*keys, *[F.col("__last")[c].alias(c) for c in (ts, tie, value)])


def runs_of(count: int) -> list[tuple[int, int]]:
    """The runs that hold the first ``count`` batches, as ranges of batches: one per digit unit of ``count`` to the base of ``FAN_OUT``."""
    runs, at, size = [], 0, 1
    while size * FAN_OUT <= count:
        size *= FAN_OUT
    while size:
        for _ in range((count - at) // size):
            runs.append((at, at + size))
            at += size
        size //= FAN_OUT
    return runs


def _run(path: str, run: tuple[int, int]) -> str:
    return f"{path}/run-{run[0]}-{run[1]}"


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the newest by the first two other columns."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__last")).select(*keys, "__last.*")


def write_changes(changes: DataFrame, path: str, checkpoint: str, keys: list[str]) -> None:
    """Run what is available and write each batch's changes as a run of the log.

    A batch writes one run: its own rows, together with the runs of full levels that it completes. So a batch writes as much as has
    changed, and over all batches a change is written again once per level. A batch that is run again after a
    failure replaces its run. Runs that the state before did not need any more are deleted.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, before, after = batch.sparkSession, runs_of(number), runs_of(number + 1)
        covered = [run for run in before if run not in after]
        rows = batch
        for run in covered:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(_run(path, run)))
        _newest(rows, keys).write.mode("overwrite").parquet(_run(path, after[-1]))
        # Readers of the state before may still read its runs.
        for run in set(runs_of(number - 1)) - set(before) - set(after) if number else ():
            delete(spark, _run(path, run))

    query = (
        changes.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def log_runs(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """The runs of the newest finished state."""
    done = [tuple(map(int, n.split("-")[1:])) for n in names_in(spark, path) if n.startswith("run-") and finished(spark, f"{path}/{n}")]
    return runs_of(max((to for _, to in done), default=0))


def read_changes(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest point per key over all runs of the log."""
    runs = log_runs(spark, path)
    if not runs:
        raise ValueError(f"no finished batch in {path}")
    return _newest(spark.read.parquet(*[_run(path, run) for run in runs]), keys)
