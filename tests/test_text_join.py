import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowloom.operators import text_join


def cells(rows):
    return sorted(tuple("<null>" if x is None or x != x else repr(x) for x in row) for row in rows)


SOURCE = [("q1", "a1", 1, 0.5), ("q1", "a1", 2, 0.5), ("q1", "a1", 2, 0.5), (None, "a", 3, None), (None, "a", 4, float("nan")), ("null", "a", 5, 0.0), (None, None, 6, 1.0), ("", "", 7, 2.0), ("q9", "x", 8, 1.0)]
RESULTS = [("q1", "a1", 0.1, 10), ("q1", "a1", 0.1, 10), ("q1", "a1", 0.2, 11), (None, "a", 0.3, 12), (None, None, 0.4, 13), (None, None, None, 14), ("", None, 0.5, 15), ("", "", 0.6, 16), ("q8", "x", 0.7, 17)]


def wanted(source, results, on):
    left, right = (pd.DataFrame(rows, columns=names, dtype=object) for rows, names in (source, results))
    return [tuple(r) for r in left.merge(right, on=on, how="inner").itertuples(index=False)]


@pytest.mark.parametrize("per_task", [1, 2, 1000])
@pytest.mark.parametrize("parts", [1, 7, 64])
def test_join_equals_a_merge(spark, parts, per_task):
    a = spark.createDataFrame(SOURCE, "model_input string, expected_output string, note int, w double").repartition(parts)
    b = spark.createDataFrame(RESULTS, "model_input string, expected_output string, score double, note int").repartition(parts)
    got = text_join.join_results_by_text(a, b, per_task=per_task)
    assert got.columns == ["model_input", "expected_output", "note_x", "w", "score", "note_y"]
    want = wanted((SOURCE, ["model_input", "expected_output", "note", "w"]), (RESULTS, ["model_input", "expected_output", "score", "note"]), ["model_input", "expected_output"])
    assert cells(got.collect()) == cells(want)


def test_numbers_match_by_value(spark):
    a = spark.createDataFrame([(0.0, "x"), (float("nan"), "y"), (None, "z"), (1.0, "w")], "k double, a string")
    b = spark.createDataFrame([(-0.0, 1), (None, 2), (1.0, 3), (2.0, 4)], "k double, b int")
    got = text_join.join_results_by_text(a, b, on=["k"]).select("a", "b").collect()
    assert sorted(map(tuple, got)) == [("w", 3), ("x", 1), ("y", 2), ("z", 2)]


def test_a_pair_with_a_third_of_the_rows(spark):
    many = [("q", "a", i % 40) for i in range(300)] + [(f"q{i}", "a", i) for i in range(600)]
    a = spark.createDataFrame(many, "model_input string, expected_output string, note int")
    b = a.withColumnRenamed("note", "score")
    got = text_join.join_results_by_text(a, b, per_task=500)
    assert got.count() == 300 * 300 + 600 and got.filter("model_input = 'q' AND note = 3 AND score = 5").count() == 64
    plan = text_join.merge_counted(text_join.counted(a), text_join.counted(b), text_join.PAIR, 500)
    assert plan.count() == 40 * 40 + 600 and plan.agg(F.sum(text_join.COPIES)).first()[0] == 300 * 300 + 600


def test_runs_side_by_side(spark):
    rows = [("q", "a", "x", 1.0), ("q", "a", "x", 1.0), ("q", "a", "y", 2.0), ("q", "a", "y", 3.0), (None, "b", "x", 4.0), (None, "b", "y", None), ("only", "x", "x", 5.0)]
    results = spark.createDataFrame(rows, "model_input string, expected_output string, run string, s double")
    got = text_join.compare_rows_by_text(results, "run", ["x", "y"], ["s"], per_task=3)
    assert got.columns == ["model_input", "expected_output", "s x", "s y"]
    assert cells(got.collect()) == cells([("q", "a", 1.0, 2.0)] * 2 + [("q", "a", 1.0, 3.0)] * 2 + [(None, "b", 4.0, None)])


def test_empty_sides(spark):
    a = spark.createDataFrame(SOURCE, "model_input string, expected_output string, note int, w double")
    b = spark.createDataFrame([], "model_input string, expected_output string, score double")
    assert text_join.join_results_by_text(a, b).count() == 0 and text_join.join_results_by_text(a.limit(0), b).count() == 0
