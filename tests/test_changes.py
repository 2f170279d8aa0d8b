import os

from pyspark.sql import functions as F

from rowloom.operators.boards import latest_value
from rowloom.session import fresh_path
from rowloom.streaming import changes

SCHEMA = "run int, key string, ts int, seq int, value double"
KEYS = ["run", "key"]


def arrive(spark, path, rows, idle_ms=None):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{path}/in")
    with changes.rocks_state(spark):
        changes.write_changes(changes.newest_changes(stream, KEYS, "value", "ts", "seq", idle_ms), f"{path}/log", f"{path}/checkpoint", KEYS)


def sizes(spark, path):
    return {run: spark.read.parquet(f"{path}/log/run-{run[0]}-{run[1]}").count() for run in changes.log_runs(spark, f"{path}/log")}


def test_runs_by_digits():
    for count in range(300):
        runs = changes.runs_of(count)
        assert [r[0] for r in runs] == [0, *[r[1] for r in runs]][: len(runs)] and (runs[-1][1] if runs else 0) == count
        assert len(runs) <= 3 * 5 and all((b - a).bit_length() % 2 == 1 and (b - a) & (b - a - 1) == 0 for a, b in runs)


def test_log_equals_batch_with_late_and_repeated_points(spark):
    path = fresh_path(spark, "t")
    first = [(i, "loss", 10, i, i / 4) for i in range(200)]
    batches = [
        first,
        [(1, "loss", 11, 900, 0.5), (1, "loss", 11, 900, 0.5)],
        # Late, repeated, and new points; a point without a time comes before all others.
        [(2, "loss", 3, 901, 9.0), (3, "loss", 10, 3, 0.75), (4, "epoch", None, 902, 1.0), (4, "epoch", None, 905, 2.0)],
        [(5, "loss", 10, 903, None), (None, None, 1, 904, 7.0)],
        [(4, "epoch", 0, 1, 3.0)],
    ]
    seen, written = [], []
    for rows in batches:
        seen += rows
        arrive(spark, path, rows)
        got = changes.read_changes(spark, f"{path}/log", KEYS).select("run", "key", "value")
        want = latest_value(spark.createDataFrame(seen, SCHEMA).fillna(-1, ["ts"]), KEYS, "value", "ts", "seq")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        written.append(sizes(spark, path))
    # What a batch writes is what it changed; the fourth makes one run of four.
    assert written[0] == {(0, 1): 200} and written[1][(1, 2)] == 1 and written[2][(2, 3)] == 1
    assert written[3] == {(0, 4): 202} and written[4][(4, 5)] == 1
    # Runs of the state before stay for its readers, older ones are gone.
    left = {n for n in os.listdir(f"{path}/log") if n.startswith("run-")}
    assert left == {"run-0-4", "run-4-5"}


def test_kept_points_never_leave_the_engine(spark):
    path = fresh_path(spark, "t")
    rows = [(1, "loss", 5, 1, 0.5), (2, "loss", None, 2, 0.1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{path}/in")
    changed = changes.newest_changes(stream, KEYS, "value", "ts", "seq")
    assert changed.columns == ["run", "key", "ts", "seq", "value"]
    plan = changed._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "TransformWithState" not in plan
    changes.write_changes(changed, f"{path}/log", f"{path}/checkpoint", KEYS)
    # A repeated point with another value, a late one and one without a time change nothing; a first time does.
    arrive(spark, path, [(1, "loss", 5, 1, 0.9), (1, "loss", 4, 7, 0.8), (1, "loss", None, 9, 0.7), (2, "loss", 0, 0, None)])
    assert sizes(spark, path)[(1, 2)] == 1
    got = {r["run"]: (r["ts"], r["seq"], r["value"]) for r in changes.read_changes(spark, f"{path}/log", KEYS).collect()}
    assert got == {1: (5, 1, 0.5), 2: (0, 0, None)}


def test_idle_keys_are_forgotten_and_come_back(spark):
    path = fresh_path(spark, "t")
    arrive(spark, path, [(1, "loss", 5, 1, 0.5), (2, "loss", 5, 2, 0.1)], idle_ms=0)
    arrive(spark, path, [(3, "loss", 1, 3, 0.3)], idle_ms=0)
    # The state of key 1 is gone, but a late point does not win over the log.
    arrive(spark, path, [(1, "loss", 4, 4, 9.0), (2, "loss", 6, 5, 0.2)], idle_ms=0)
    got = {r["run"]: r["value"] for r in changes.read_changes(spark, f"{path}/log", KEYS).collect()}
    assert got == {1: 0.5, 2: 0.2, 3: 0.3}


def test_a_batch_that_runs_again_replaces_its_run(spark):
    path = fresh_path(spark, "t")
    arrive(spark, path, [(1, "loss", 5, 1, 0.5)])
    # An unfinished run of the next batch, as a lost driver leaves it.
    spark.range(3).withColumn("x", F.lit(1)).write.parquet(f"{path}/log/run-1-2")
    os.remove(f"{path}/log/run-1-2/_SUCCESS")
    assert changes.log_runs(spark, f"{path}/log") == [(0, 1)]
    arrive(spark, path, [(1, "loss", 6, 2, 0.6)])
    assert [r["value"] for r in changes.read_changes(spark, f"{path}/log", KEYS).collect()] == [0.6]
