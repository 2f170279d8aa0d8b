import hashlib
import math

import pytest
from pyspark.sql import functions as F

from rowloom.functions.hashing import with_row_key
from rowloom.operators import sampling as S


def order(keys, salt):
    return sorted(keys, key=lambda k: (int(hashlib.md5(f"{salt}:{k}".encode()).hexdigest()[:15], 16), str(k)))


def table(spark, n, splits=("train",)):
    df = spark.range(n).select(F.col("id").alias("k"))
    return df.withColumn("split", F.get(F.array(*[F.lit(s) for s in splits]), (F.col("k") % len(splits)).cast("int")))


def ids(df):
    return sorted(r["k"] for r in df.select("k").collect())


@pytest.mark.parametrize("n", [0, 1, 10, 257])
@pytest.mark.parametrize("split", [0.0, 0.1, 0.7, 0.9, 1.0])
def test_test_size_and_rows(spark, n, split):
    rows = S.train_test_split(table(spark, n).drop("split"), "k", split)
    test = ids(rows.filter("split = 'test'"))
    wanted = 0 if split >= 1 else math.ceil((1.0 - split) * n)
    assert test == sorted(order(range(n), "42:split")[:wanted])
    assert ids(rows) == list(range(n))


def test_share_uses_doubles(spark):
    assert len(ids(S.train_test_split(table(spark, 10), "k", 0.7).filter("split = 'test'"))) == 4


def test_half_of_ten_is_five(spark):
    assert len(ids(S.downsample(table(spark, 10), "k", 0.5))) == 5


def test_result_does_not_depend_on_partitions(spark):
    results = []
    for parts in (1, 7, 64):
        rows = S.sample_and_split(table(spark, 300).repartition(parts), "k", 0.6, 0.8)
        results.append(sorted((r["k"], r["split"]) for r in rows.collect()))
    assert results[0] == results[1] == results[2]
    assert len(results[0]) == 300 - math.ceil(0.4 * 300)


def test_narrowing_gives_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "RANKED_ROWS", 3)
    monkeypatch.setattr(S, "STEP_BITS", (2, 3, 4, 5))
    keep = ids(S.downsample(table(spark, 500), "k", 0.33))
    assert keep == sorted(order(range(500), "42:frac")[math.ceil((1.0 - 0.33) * 500) :])
    assert ids(S.eval_sample(table(spark, 500), "k", 0.25)) == sorted(order(range(500), "420:eval")[:125])


@pytest.mark.parametrize("n, fraction, wanted", [(25, 0.1, 2), (35, 0.1, 4), (10, 0.0, 0), (10, 1.0, 10)])
def test_eval_sample_rounds_half_to_even(spark, n, fraction, wanted):
    assert len(ids(S.eval_sample(table(spark, n), "k", fraction))) == wanted


def test_eval_wins_over_test_and_is_whole(spark):
    rows = S.sample_and_split(table(spark, 40, ("train", "eval", "test", "other")), "k", 0.5, 0.5)
    assert ids(rows.filter("split = 'test'")) == list(range(1, 40, 4))
    assert len(ids(rows.filter("split = 'train'"))) == 5


def test_test_is_used_without_eval(spark):
    rows = S.sample_and_split(table(spark, 20, ("train", "test")), "k", 1.0, 0.5)
    assert ids(rows.filter("split = 'test'")) == list(range(1, 20, 2))
    assert ids(rows.filter("split = 'train'")) == list(range(0, 20, 2))


def test_table_without_splits_or_train_is_rejected(spark):
    with pytest.raises(ValueError):
        S.sample_and_split(table(spark, 4).drop("split"), "k")
    with pytest.raises(ValueError):
        S.sample_and_split(table(spark, 4, ("test",)), "k")


def test_holdout_and_sizes(spark):
    sizes = {r["split"]: r["n_rows"] for r in S.split_sizes(S.holdout(table(spark, 100), "k", 0.05)).collect()}
    assert sizes["train"] + sizes["test"] == 100
    assert sizes["test"] == math.ceil((1.0 - (1.0 - 0.05)) * 100)


def test_row_keys_for_copies(spark):
    df = spark.createDataFrame([("a", 1)] * 23 + [("b", None)] * 2 + [(None, 3)], "x string, y int")
    keyed = with_row_key(df, copies_per_task=5)
    assert sorted(map(str, keyed.drop("row_key").collect())) == sorted(map(str, df.collect()))
    assert keyed.select("row_key").distinct().count() == 26
    again = with_row_key(df.repartition(7), copies_per_task=5)
    assert {r["row_key"] for r in keyed.collect()} == {r["row_key"] for r in again.collect()}


def test_preview_is_repeatable(spark):
    assert ids(S.preview(table(spark, 50), "k", 5, 3)) == ids(S.preview(table(spark, 50).repartition(9), "k", 5, 3))


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_preview_of_each_group(spark, parts):
    rows = [("hot", i, f"t{i}") for i in range(900)] + [("hot", 7, "again")] * 300 + [(g, i, "x") for g in ("a", "b", None) for i in range(g == "a" and 3 or 40)]
    df = spark.createDataFrame(rows, "g string, k int, t string").repartition(parts)
    found = {}
    for r in S.preview_each(df, "g", "k", 5, "s").collect():
        found.setdefault(r["g"], []).append(r["k"])
    order = lambda k: (int(hashlib.md5(f"s:{k}".encode()).hexdigest()[:15], 16), str(k))
    for g in ("hot", "a", "b", None):
        assert sorted(found[g]) == sorted(sorted((k for h, k, _ in rows if h == g), key=order)[:5])
    assert S.preview_each(df.limit(0), "g", "k", 5).count() == 0


def test_equal_rows_are_dealt_by_count(spark):
    df = spark.createDataFrame([(7, "x")] * 500 + [(i, "y") for i in range(100)], "k int, t string").repartition(6)
    split = S.train_test_split(df, "k", 0.6)
    assert split.filter("split = 'test'").count() == 240 and sorted(map(tuple, split.drop("split").collect())) == sorted(map(tuple, df.collect()))


def test_leakage_counts_texts(spark):
    df = spark.createDataFrame(
        [(1, "a", "train"), (2, "a", "test"), (3, "b", "test"), (4, "c", "train"), (5, "a", "test")], "k int, t string, split string"
    )
    found = {r["check"]: (r["leaked_rows"], r["test_rows"]) for r in S.leakage(df, "k", F.col("t")).collect()}
    assert found == {"row_key": (0, 3), "text": (2, 3)}


def test_split_params(spark):
    adapters = spark.createDataFrame([("a1", "x"), ("a2", "y"), ("a3", "x")], "id string, name string")
    jobs = spark.createDataFrame(
        [("j2", "x", 0.1, 0.2), ("j1", "x", 0.7, 0.8), ("j3", None, 0.3, 0.3)],
        "id string, adapter_name string, dataset_fraction double, train_test_split double",
    )
    found = {r[0]: (r[1], r[2]) for r in S.split_params(adapters, jobs).collect()}
    assert found == {"a1": (0.7, 0.8), "a2": (1.0, 0.9), "a3": (0.7, 0.8)}


def test_repeated_and_null_keys_are_counted_exactly(spark):
    repeated = spark.range(1000).selectExpr("id % 50 AS k", "id AS v")
    assert S.downsample(repeated, "k", 0.51).count() == 510
    equal = spark.range(1000).selectExpr("id % 3 AS k")
    split = S.train_test_split(equal, "k", 0.7).groupBy("split", "k").count().collect()
    assert sum(r["count"] for r in split if r["split"] == "test") == 301 and sum(r["count"] for r in split) == 1000
    nulls = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k bigint")
    assert S.train_test_split(nulls, "k", 0.3).filter("split = 'test'").count() == 3
    assert S.downsample(spark.createDataFrame([(None,)] * 10, "k bigint"), "k", 0.5).count() == 5
    a, b = (sorted(map(tuple, S.downsample(repeated.repartition(n), "k", 0.51).collect())) for n in (1, 7))
    assert a == b
