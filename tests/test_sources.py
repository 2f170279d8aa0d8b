import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.operators import projection
from rowloom.session import fresh_path
from rowloom.sources import datasets, registry, results


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_with_quoted_commas(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'input,output,score\n"Hello, you","a ""b""\nc",1.0\n"x, y",z,25.0\n')
    df = datasets.read_dataset(spark, path, "csv", multiline=True)
    assert dict(df.dtypes)["score"] == "double" and df.filter("split = 'train'").count() == 2
    assert df.orderBy("score").first()["output"] == 'a "b"\nc'
    assert datasets.dataset_features(spark, path, "csv") == ["input", "output", "score"]


@pytest.mark.parametrize("text, n", [('[{"z": 1, "a": "x"}, {"a": "y", "b": true}]', 2), ('\n {"z": 1, "a": "x"}', 1)])
def test_json(spark, tmp_path, text, n):
    path = put(tmp_path, "a.json", text)
    assert datasets.read_dataset(spark, path, "json").count() == n
    assert datasets.dataset_features(spark, path, "json") == ["z", "a"]


def test_jsonl(spark, tmp_path):
    path = put(tmp_path, "a.jsonl", '\n{"z": {"q": 1}, "a": "x"}\n{"b": 2}\n')
    assert datasets.dataset_features(spark, path, "jsonl") == ["z", "a"]
    assert set(datasets.read_dataset(spark, path, "jsonl").columns) == {"z", "a", "b", "split"}


def test_parquet_splits(spark):
    path = fresh_path(spark, "t")
    spark.range(6).withColumn("split", F.when(F.col("id") < 2, "test").otherwise("train")).write.partitionBy("split").parquet(path)
    df = datasets.read_dataset(spark, path, "parquet")
    assert df.filter("split = 'test'").count() == 2
    assert datasets.dataset_features(spark, path, "parquet") == ["id"]


def test_unknown_kind(spark):
    for call in (datasets.read_dataset, datasets.dataset_features):
        with pytest.raises(ValueError):
            call(spark, "/nowhere", "project")


def test_split_orient(spark, tmp_path):
    (tmp_path / "t").mkdir()
    put(tmp_path / "t", "a.json", json.dumps({"columns": ["a", "b", "c"], "data": [[1, 2, 3], [4, 5, 6], [7, None, 9]]}))
    schema = T.StructType().add("c", "long").add("a", "long").add("b", "long").add("d", "string")
    got = datasets.read_split_orient(spark, str(tmp_path / "t"), schema).orderBy("a").collect()
    assert [tuple(r) for r in got] == [(3, 1, 2, None), (6, 4, 5, None), (9, 7, None, None)]
    put(tmp_path / "t", "b.json", "not a table")
    with pytest.raises(Exception):
        datasets.read_split_orient(spark, str(tmp_path / "t"), schema).collect()


def test_format_catalog(spark, tmp_path):
    doc = {"dataset_formats": {"k": {"name": "n", "description": "d", "format": {"question": "...", "choices": ["..."]}}, "l": {"name": "m", "description": None, "format": {}}}}
    got = datasets.format_catalog(spark, put(tmp_path, "f.json", json.dumps(doc, indent=1))).orderBy("key").collect()
    assert [tuple(r) for r in got] == [("k", "n", "d", ["question", "choices"]), ("l", "m", None, [])]


def test_results_by_run(spark):
    path = fresh_path(spark, "t")
    results.write_results(spark.createDataFrame([("a", 1), ("b", 2)], "run string, x int"), path)
    results.write_results(spark.createDataFrame([("b", 3)], "run string, x int"), path)
    assert sorted(r["x"] for r in results.read_results(spark, path).collect()) == [1, 3]
    pruned = results.read_results(spark, path, ["b"])
    assert [r["x"] for r in pruned.collect()] == [3]
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [run" in plan or "PartitionFilters: [isnotnull(run" in plan
    scans = [m for m in pruned._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in m]
    assert scans and all("DataFilters: []" in m for m in scans)
    assert [r["x"] for r in pruned.collect()] == [3]


def test_csv_export_round_trip(spark):
    path = fresh_path(spark, "t")
    rows = [(1, ' a "q", \n\\ '), (2, ""), (3, None), (4, "é")]
    results.export_csv(spark.createDataFrame(rows, "k int, t string"), path)
    got = datasets.read_dataset(spark, path, "csv", "k int, t string", multiline=True).drop("split")
    # As in other CSV readers an empty field is an absent one.
    assert {r["k"]: r["t"] for r in got.collect()} == {k: t or None for k, t in rows}


def test_snapshot_round_trip(spark):
    path = fresh_path(spark, "t")
    empty = registry.as_table(spark.createDataFrame([], "id string"), "prompts")
    some = registry.as_table(spark.createDataFrame([("c1", "x", None), ("c2", None, 1)], "id string, config string, is_default int"), "configs")
    registry.export_snapshot({"prompts": empty, "configs": some}, path)
    assert registry.read_snapshot(spark, path, "prompts").schema == empty.schema
    back = registry.read_snapshot(spark, path, "configs")
    assert sorted(map(str, back.collect())) == sorted(map(str, some.collect()))
    compact = {r["table"]: json.loads(r["record"]) for r in registry.export_compact({"configs": some.filter("id = 'c1'"), "prompts": empty}).collect()}
    assert compact == {"configs": {"id": "c1", "config": "x"}}


def test_snapshot_is_packed_in_files_of_bounded_rows(spark, monkeypatch):
    path = fresh_path(spark, "t")
    monkeypatch.setattr(registry, "FILE_ROWS", 1000)
    jobs = registry.as_table(spark.range(4000).coalesce(1).selectExpr("concat('j', id) AS id", "int(id % 5) AS num_workers"), "fine_tuning_jobs")
    for compression, share in (("lz4", 4), ("gzip", 8)):
        registry.export_snapshot({"fine_tuning_jobs": jobs}, path, compression)
        files = [f for f in os.listdir(f"{path}/fine_tuning_jobs/data") if f.startswith("part-")]
        assert len(files) == 4
        packed = sum(os.path.getsize(f"{path}/fine_tuning_jobs/data/{f}") for f in files)
        lines = jobs.select(F.to_json(F.struct(*jobs.columns), {"ignoreNullFields": "false"}).alias("t"))
        assert packed * share < lines.agg(F.sum(F.length("t"))).first()[0]
        assert registry.read_snapshot(spark, path, "fine_tuning_jobs").exceptAll(jobs).isEmpty()
        assert registry.read_snapshot(spark, path, "fine_tuning_jobs").count() == 4000


def test_merge_takes_first_rows_without_a_second_order(spark):
    current = registry.as_table(spark.createDataFrame([("a",)], "id string"), "models")
    rows = [("b", "x", 2), ("b", "none", None), ("b", "y", 1), (None, "z", 5), (None, "w", 4), ("a", "new", 0)]
    incoming = spark.createDataFrame(rows, "id string, name string, pos int")
    merged = registry.merge_snapshot("models", current.hint("merge"), incoming, "pos")
    # A row without a position comes first; ids that are null are one id.
    assert {(r["id"], r["name"]) for r in merged.collect()} == {("a", None), ("b", "none"), (None, "w")}
    # An order for the join on either side, none within an id.
    plan = merged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Sort [") == 2 and "Window" not in plan
    by_columns = registry.merge_snapshot("models", current, incoming.drop("pos"))
    assert {(r["id"], r["name"]) for r in by_columns.collect()} == {("a", None), ("b", "none"), (None, "w")}


def test_unknown_table(spark):
    with pytest.raises(ValueError):
        registry.merge_snapshot("nope", spark.range(1), spark.range(1))


def test_merge_keeps_what_is_there(spark):
    current = registry.as_table(spark.createDataFrame([("a", "old")], "id string, name string"), "models")
    incoming = spark.createDataFrame([("a", "new", 0), ("b", "late", 2), ("b", "first", 1)], "id string, name string, pos int")
    merged = registry.merge_snapshot("models", current, incoming, "pos")
    assert {(r["id"], r["name"]) for r in merged.collect()} == {("a", "old"), ("b", "first")}
    assert merged.columns == current.columns
    again = registry.merge_snapshot("models", merged, incoming, "pos")
    assert again.count() == 2


def test_projections(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert projection.ensure_columns(df, ["b", "z"]).first().asDict() == {"b": "x", "z": "Unknown"}
    assert projection.prefix_columns(df, "exp_").columns == ["exp_a", "exp_b"]
    assert projection.evolve_schema(df, T.StructType().add("a", "string").add("c", "double")).dtypes[-1] == ("c", "double")
    both = projection.union_pages([df, df.drop("b"), df.select("b")])
    assert both.count() == 3 and both.columns == ["a", "b"]
    with pytest.raises(ValueError):
        projection.union_pages([])


def test_fallback(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "a int, f string")
    keep = lambda m: sorted(r["a"] for r in projection.filter_with_fallback(df, m).collect())
    assert keep(F.col("f") == "x") == [1]
    assert keep(F.col("f") == "none") == [1, 2, 3]
    assert projection.filter_with_fallback(df, F.col("f") == "x", F.col("a") > 5).count() == 0
