from pyspark.sql import functions as F

from rowloom.functions.templates import render_train
from rowloom.operators.boards import latest_value
from rowloom.session import fresh_path
from rowloom.streaming import streams

SCHEMA = "run int, key string, ts int, seq int, value double"


def test_progress_over_several_arrivals(spark):
    path = fresh_path(spark, "t")
    batches = [
        [(1, "epoch", 1, 1, 0.5), (2, "epoch", 1, 2, 0.1)],
        [(1, "epoch", 3, 3, 0.9), (1, "epoch", 2, 4, 0.7)],
        [(2, "epoch", 0, 5, 9.0), (3, "loss", 1, 6, None)],
    ]
    seen = []
    for rows in batches:
        seen += rows
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{path}/in")
        stream = streams.read_stream(spark, f"{path}/in", "parquet", spark.createDataFrame([], SCHEMA).schema)
        latest = streams.latest_values(stream, ["run", "key"], "value", "ts", "seq")
        streams.write_latest(latest, f"{path}/out", f"{path}/checkpoint")
        got = streams.read_latest(spark, f"{path}/out", ["run", "key"]).select("run", "key", "value")
        want = latest_value(spark.createDataFrame(seen, SCHEMA), ["run", "key"], "value", "ts", "seq")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_rendered_stream_equals_batch(spark):
    path = fresh_path(spark, "t")
    df = spark.range(20).select("id", F.concat(F.lit("t"), "id").alias("text"))
    df.repartition(3).write.json(f"{path}/in")
    stream = streams.read_stream(spark, f"{path}/in", "jsonl", df.schema)
    for _ in range(2):
        streams.render_stream(stream, "{id}: {text}", f"{path}/out", f"{path}/checkpoint")
    got = spark.read.parquet(f"{path}/out")
    want = render_train(df, "{id}: {text}")
    assert sorted(r["prediction"] for r in got.collect()) == sorted(r["prediction"] for r in want.collect())
