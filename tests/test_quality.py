from pyspark.sql import functions as F

from rowloom.operators import boards, quality


def rules(spark, values):
    good = dict(framework_type="legacy", adapter_name="my-Adapter1", num_cpu=1, num_gpu=0, num_memory=1, num_workers=1, num_epochs=1,
                learning_rate=0.1, dataset_fraction=1.0, train_test_split=0.5, axolotl_config_id=None)
    schema = (
        "framework_type string, adapter_name string, num_cpu int, num_gpu int, num_memory int, num_workers int, num_epochs int, "
        "learning_rate double, dataset_fraction double, train_test_split double, axolotl_config_id string"
    )
    df = spark.createDataFrame([tuple({**good, **values}.values())], schema).withColumn("id", F.lit("j"))
    return {r["rule"].split(" ")[0] for r in quality.violations(df, quality.job_rules(), ["id"]).collect()}


def test_job_rules(spark):
    assert rules(spark, {}) == set()
    assert rules(spark, {"adapter_name": None}) == set() == rules(spark, {"adapter_name": ""})
    assert rules(spark, {"adapter_name": "--"}) == {"adapter_name"} == rules(spark, {"adapter_name": "a b"})
    assert rules(spark, {"framework_type": "axolotl"}) == {"axolotl_config_id"}
    assert rules(spark, {"framework_type": "axolotl", "axolotl_config_id": "c"}) == set()
    assert rules(spark, {"num_gpu": -1, "dataset_fraction": 0.0, "train_test_split": 1.01, "num_cpu": None}) == {
        "num_gpu", "dataset_fraction", "train_test_split", "num_cpu",
    }


def test_required_and_suffix(spark):
    df = spark.createDataFrame([("a", " \t", "project_csv", "x.csv"), ("b", None, "project_json", "x.csv"), ("c", "n", "huggingface", None)], "id string, name string, type string, location string")
    found = quality.violations(df, quality.required("name") + quality.suffix_rules("type", "location"), ["id"])
    assert {tuple(r) for r in found.collect()} == {("a", "name is required"), ("b", "name is required"), ("b", "location must end with .json")}


def test_config_dedup(spark):
    rows = [
        ("c3", "t", None, '{"a": 1, "b": {"x": 2.0}}'),
        ("c1", "t", None, '{ "b": {"x": 2}, "a": 1.0 }'),
        ("c2", "t", "f", '{"a": 1, "b": {"x": 2}}'),
        ("c4", "t", None, '{"a": true, "b": {"x": 2}}'),
        ("c5", "t", None, "{broken"),
        ("c6", "t", None, "{broken"),
        ("c7", "t", None, None),
    ]
    df = spark.createDataFrame(rows, "id string, type string, fam string, config string")
    got = {r["id"]: r["canonical_id"] for r in quality.config_dedup(df, "config", "type", "fam").collect()}
    assert {k: got[k] for k in ("c1", "c2", "c3", "c4", "c5", "c6")} == {"c1": "c1", "c2": "c2", "c3": "c1", "c4": "c4", "c5": "c5", "c6": "c5"}


def test_configs_are_reused(spark):
    schema = "id string, type string, config string"
    current = spark.createDataFrame([("c2", "a", '{"x": 1, "y": 2}'), ("c1", "a", '{"y":2,"x":1}'), ("c3", "b", '{"x": 1, "y": 2}'), ("c4", None, "no json")], schema)
    batch = spark.createDataFrame(
        [("n1", "a", '{"y": 2.0, "x": 1}'), ("n3", "a", '{"z": 1}'), ("n2", "a", '{ "z":1}'), ("n4", "b", '{"z":1}'), ("n5", None, "no json"), ("n6", "a", None)], schema
    )
    found = {r["id"]: (r["config_id"], r["is_new"]) for r in quality.add_configs(batch, current, "config", "type").collect()}
    assert found == {"n1": ("c1", False), "n2": ("n2", True), "n3": ("n2", True), "n4": ("n4", True), "n5": ("c4", False), "n6": ("n6", True)}
    twice = quality.duplicate_configs(current, "config", "type").collect()
    assert [(r["type"], r["canonical_id"], r["n_configs"]) for r in twice] == [("a", "c1", 2)]


def test_names_are_stripped_of_all_white_space(spark):
    df = spark.createDataFrame([("a\n",), ("a",), ("\t b",)], "name string")
    assert [tuple(r) for r in quality.duplicate_names(df, "name").collect()] == [("a", 2)]
    assert quality.names_taken(spark.createDataFrame([(" b\r\n",), ("c",)], "name string"), df, "name").count() == 1


def test_latest_per_parent_with_text_ids(spark):
    rows = [("p", "b", "2024-01-02"), ("p", "a", "2024-01-02"), ("p", "z", "2023-01-01"), ("q", "x", None), ("q", "y", "2020-01-01")]
    df = spark.createDataFrame(rows, "parent string, id string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert sorted((r["parent"], r["id"]) for r in boards.latest_per_parent(df, "parent", "at", "id").collect()) == [("p", "a"), ("q", "y")]


def test_references_are_shuffled_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    tables = {"a": spark.range(10).selectExpr("id", "id AS x", "id AS y"), "b": spark.range(5).select("id")}
    found = quality.fk_audit(tables, [quality.Edge("a", "x", "b"), quality.Edge("a", "y", "b")])
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2 and found.count() == 10


def test_references(spark):
    parent = spark.createDataFrame([("p1",)], "id string")
    child = spark.createDataFrame([("a", "p1"), ("b", "gone"), ("c", None), ("d", "gone")], "id string, fk string")
    found = quality.fk_audit({"parent": parent, "child": child}, [quality.Edge("child", "fk", "parent")])
    assert {tuple(r) for r in found.collect()} == {("child", "b", "fk", "gone"), ("child", "d", "fk", "gone")}


def test_names(spark):
    df = spark.createDataFrame([(" a ",), ("a",), ("b",)], "name string")
    assert [tuple(r) for r in quality.duplicate_names(df, "name").collect()] == [("a", 2)]
    assert quality.names_taken(spark.createDataFrame([("b ",), ("z",)], "name string"), df, "name").count() == 1


def test_pairs(spark):
    df = spark.createDataFrame([(1, "m", None), (1, "m", None), (1, "m", "a"), (2, "m", None), (2, None, None)], "p int, m string, a string")
    assert [tuple(r) for r in quality.repeated_pairs(df, "p", "m", "a").collect()] == [(1, "m", None, 2)]
    assert quality.missing_models(df, "m", "a").count() == 1


def test_delete_and_resolve(spark):
    sets = spark.createDataFrame([("d1",), ("d2",), ("d2",)], "id string")
    prompts = spark.createDataFrame([("p1", "d1"), ("p2", "d2"), ("p3", None)], "id string, dataset_id string")
    gone = spark.createDataFrame([("d1",), ("d1",), ("zz",)], "id string")
    for cascade, left in ((True, 2), (False, 3)):
        kept, children = boards.cascade_delete(sets, prompts, gone, "id", "dataset_id", cascade)
        assert (kept.count(), children.count()) == (2, left)
    found = {r["id"]: r["status"] for r in boards.resolve_ids(gone.distinct().union(spark.createDataFrame([("d2",)], "id string")), sets, "id").collect()}
    assert found == {"d1": "ok", "d2": "ambiguous", "zz": "missing"}


def test_boards(spark):
    jobs = spark.createDataFrame([("j1", "s1", "n1"), ("j2", None, "n2"), ("j3", "zz", "n3")], "id string, cml_job_id string, name string")
    scheduler = spark.createDataFrame([("s1", "other", "up")], "public_identifier string, name string, state string")
    exps = spark.createDataFrame([("j2", "x2")], "exp_name string, exp_id string")
    board = {r["id"]: (r["name"], r["name_cml"], r["state"], r["exp_id"]) for r in boards.job_board(jobs, scheduler, exps).collect()}
    assert board == {"j1": ("n1", "other", "up", None), "j2": ("n2", None, None, "x2"), "j3": ("n3", None, None, None)}
    kids = boards.children_list(jobs.select("id"), spark.createDataFrame([("j1", "a"), ("j1", "b"), (None, "c")], "p string, c string"), "id", "p", "c", "-")
    assert sorted(map(tuple, kids.collect())) == [("j1", "a"), ("j1", "b"), ("j2", "-"), ("j3", "-")]
    texts = spark.createDataFrame([("pay", "do pay")], "key string, text string")
    helps = boards.lookup_trimmed(spark.createDataFrame([(" pay\n",), ("no",)], "k string"), texts, "k", "h").collect()
    assert {r["h"] for r in helps} == {"do pay", "Unknown customer help category [no]."}


def test_progress_and_latest(spark):
    series = spark.createDataFrame([(1, "epoch", 1, 0.5, 1), (1, "epoch", 2, 1.21, 2), (1, "loss", 3, 9.0, 3), (2, "loss", 1, 1.0, 4)], "run int, key string, ts int, value double, seq int")
    runs = spark.createDataFrame([(1, 4), (2, 4)], "run int, num_epochs int")
    assert [tuple(r) for r in boards.training_progress(series, runs).collect()] == [(1, 31)]
    assert boards.metric_curves(series, ["loss"]).count() == 2
    rows = spark.createDataFrame([("m", 1, 5), ("m", 3, 7), ("m", 2, 7)], "p string, k int, at int")
    assert boards.latest_per_parent(rows, "p", "at", "k").first()["k"] == 2


def test_utilization(spark):
    df = spark.createDataFrame([(1.5, 4.0, 2.0, 8.0, None, 0.0)], "cpu double, cpuAllocatable double, memory double, memoryAllocatable double, nvidiaGPU double, nvidiaGPUAllocatable double")
    got = {r["resource_name"]: (r["progress"], r["used"], r["max_available"]) for r in boards.utilization(df, []).collect()}
    assert got == {"CPU": (37.5, "1.50 vCPU", "2.50 vCPU"), "MEMORY": (25.0, "2.00 GiB", "6.00 GiB"), "NVIDIAGPU": (0.0, "0.00 GPU", "0.00 GPU")}


def test_sort_recent(spark):
    df = spark.createDataFrame([("a", "2024-08-27T10:45:38.900Z"), ("b", "2024-08-28T00:00:00.000Z"), ("c", "junk")], "id string, at string")
    got = boards.sort_recent(df, "at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "id").collect()
    assert [r["id"] for r in got] == ["b", "a", "c"]
