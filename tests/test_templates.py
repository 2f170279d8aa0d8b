import random

import pytest
from pyspark.sql import functions as F

from rowloom.functions import templates as T
from rowloom.functions.names import artifact_name, last_path_part, last_word, registered_name, run_name, status_label
from rowloom.functions.jsontext import canonical_json, lenient_variant, option

FLOATS = [
    0.0, -0.0, 1.0, -1.5, 0.1, 1e-5, 1.5e-5, 0.0001, 0.00012345, 0.001, 9999999.0, 1e7, 12345678.9, 123456789.125, 1e15,
    1e16, 1.5e16, 1e20, -1e20, 1.25e100, 3e-7, float("inf"), float("-inf"), float("nan"), None,
]


def render(spark, rows, schema, template, eos=None):
    return [r["prediction"] for r in T.render_train(spark.createDataFrame(rows, schema).coalesce(1), template, eos=eos).collect()]


def test_floats_print_like_python(spark):
    assert render(spark, [(x,) for x in FLOATS], "x double", "{x}") == [str(x) for x in FLOATS]


def test_random_floats_print_like_python(spark):
    rng = random.Random(7)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 15) for _ in range(5000)] + [rng.random() for _ in range(2000)]
    assert render(spark, [(x,) for x in values], "x double", "{x}") == [str(x) for x in values]


def test_other_values(spark):
    rows = [(True, 3, "é $1 \\n {b}", None), (None, -7, "", "q\"uote\nline")]
    schema = "b boolean, i bigint, s string, n string"
    template = "{{{b}}} {i}|{s}|{n} {{ok}}"
    wanted = [template.format(b=r[0], i=r[1], s=r[2], n=r[3]) for r in rows]
    assert render(spark, rows, schema, template) == wanted
    assert render(spark, rows, schema, template, "</s>") == [w + "</s>" for w in wanted]


def test_nested_fields(spark):
    rows = [((1, ["p", "q"]), {"k": 2.5})]
    got = render(spark, rows, "s struct<a: int, l: array<string>>, m map<string, double>", "{s.a} {s[l][1]} {m[k]} {s.l[5]}")
    assert got == ["1 q 2.5 None"]


@pytest.mark.parametrize("template", ["{missing}", "{x:>10}", "{x!r}", "{", "{}", "{x.y}", "{prediction}"])
def test_errors_come_before_any_row(spark, template):
    with pytest.raises((T.TemplateError, TypeError)):
        T.render_train(spark.range(0).withColumnRenamed("id", "x"), template)


def test_field_is_overwritten_from_the_input_value(spark):
    assert render(spark, [("old",)], "prediction string", "[{prediction}]") == ["[old]"]


def test_eval_pair(spark):
    df = spark.createDataFrame([("q", "a")], "question string, answer string")
    row = T.render_eval_pair(df, "Q: {question}", "{answer}\n").first()
    assert (row["model_input"], row["expected_output"]) == ("Q: q", "a\n")


LENIENT = [
    ("{a} {b} {c}", "1 x {c}"),
    ("no braces", "no braces"),
    ("{} { } {a", "{} { } {a"),
    ("{{a}}", "{{a}}"),
    ("{a}{a}", "11"),
    ("", ""),
]


@pytest.mark.parametrize("template, wanted", LENIENT)
def test_lenient(spark, template, wanted):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert T.render_lenient(df, template, "out").first()["out"] == wanted


def test_lenient_by_row_is_one_literal_pass(spark):
    rows = [(t, 1, "x") for t, _ in LENIENT] + [("{b}", 1, "\\1 $0 {a}"), (None, 1, "x"), ("{b}", 1, None)]
    df = spark.createDataFrame(rows, "t string, a int, b string").coalesce(1)
    got = [r["out"] for r in T.render_lenient_by_row(df, "t", ["a", "b"], "out").collect()]
    assert got == [w for _, w in LENIENT] + ["\\1 $0 {a}", None, "None"]


def test_placeholders(spark):
    df = spark.createDataFrame([("{a} and {b c}",), ("none",), ("",)], "t string").coalesce(1)
    got = df.select(T.placeholders(F.col("t")), T.first_placeholder(F.col("t")), T.last_placeholder(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(["a", "b c"], "a", "b c"), ([], None, None), ([], None, None)]


def test_compose(spark):
    df = spark.createDataFrame([("p \n\n", "\t c\n "), ("p", "")], "p string, c string").coalesce(1)
    got = [r[0] for r in df.select(T.compose_training_template(F.col("p"), F.col("c"))).collect()]
    assert got == ["p c", "p"]


def test_status_labels(spark):
    df = spark.createDataFrame([("succeeded",), ("failed",), (None,), ("PENDING now",), ("Unknown",)], "s string").coalesce(1)
    got = [r[0] for r in df.select(status_label(F.col("s"))).collect()]
    assert got == ["🟢 Succeeded", "🔴 Failed", "⚪ Unknown", "⚪ Pending now", "⚪ Unknown"]


def test_names(spark):
    base, adapter = "org/some-long-model-name-with-many-parts", "my/adapter-with-a-name"
    full = f"{base}-{adapter}".replace("/", "-")
    df = spark.createDataFrame([(base, adapter)], "b string, a string")
    art = artifact_name(F.col("b"), F.col("a"))
    row = df.select(art, registered_name(art), run_name(F.col("b"), F.lit(None)), run_name(F.col("b"), F.col("a"))).first()
    assert tuple(row) == (full[-49:], "ft-model-" + full[-49:][-40:], base, f"{base} + {adapter}")
    row = df.select(last_word(F.lit("a b\tc \n")), last_path_part(F.lit("x/y/z"))).first()
    assert tuple(row) == ("c", "z")


def test_json_text(spark):
    rows = [('{"b": 1.0, "a": [1, {"d": 2, "c": null}]}',), ('{"a":[1,{"c":null,"d":2.0}],"b":1}',), ("{'a': 3}",), ("{",), ("",), (None,)]
    df = spark.createDataFrame(rows, "j string").coalesce(1)
    canon = [r[0] for r in df.select(canonical_json(F.col("j"))).collect()]
    assert canon[0] == canon[1] and canon[2:] == [None] * 4
    value = F.try_variant_get(lenient_variant(F.col("j"), '{"a": -1}'), "$.a", "int")
    assert [r[0] for r in df.select(value).collect()][2:] == [3, -1, -1, -1]
    row = spark.range(1).select(
        option(F.parse_json(F.lit('{"x": 1}')), F.parse_json(F.lit('{"x": 2, "y": 3}')), "x", 9, "int"),
        option(F.parse_json(F.lit('{"x": 1}')), F.parse_json(F.lit('{"x": 2, "y": 3}')), "y", 9, "int"),
        option(F.parse_json(F.lit("{}")), F.parse_json(F.lit("{}")), "z", 9, "int"),
    ).first()
    assert tuple(row) == (1, 3, 9)
