import os
import random
import re
import uuid
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowloom.functions import textstats
from rowloom.operators import compare, metrics, predict
from rowloom.operators.overlap import sequence_hits, summary_hits
from rowloom.session import fresh_path

TEXTS = [
    ("the cat sat on the mat", "the cat lay on the mat the"),
    ("", "x"),
    ("x", ""),
    (None, "x"),
    ("Über straße A1 a1", "a1 a1 a1 stra"),
    ("one two\nthree four. five", "two one\nfive four three\n\none"),
    ("same same same", "same same same"),
    ("a b c", "d e f"),
]


def tokens(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t


def f_score(hits, n, m):
    p, r = (hits / n if n else 0), (hits / m if m else 0)
    return 2 * p * r / (p + r) if p + r else 0.0


def plain_summary_hits(prediction, target):
    """Union of subsequences by the full table, walked back from its end."""
    given = [tokens(x) for x in (prediction or "").split("\n") if tokens(x)]
    wanted = [tokens(x) for x in (target or "").split("\n") if tokens(x)]
    left, right = Counter(sum(given, [])), Counter(sum(wanted, []))
    hits = 0
    for line in wanted:
        union = set()
        for other in given:
            t, i, j = table(line, other), len(line), len(other)
            while i and j:
                if line[i - 1] == other[j - 1]:
                    union.add(i - 1)
                    i, j = i - 1, j - 1
                elif t[i][j - 1] > t[i - 1][j]:
                    j -= 1
                else:
                    i -= 1
        for at in sorted(union):
            if left[line[at]] and right[line[at]]:
                hits, left[line[at]], right[line[at]] = hits + 1, left[line[at]] - 1, right[line[at]] - 1
    return hits


def random_pairs(n):
    rng = random.Random(5)
    line = lambda: " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 12)))
    return [("\n".join(line() for _ in range(rng.randint(1, 4))), "\n".join(line() for _ in range(rng.randint(1, 4)))) for _ in range(n)]


def test_subsequences_against_the_full_table():
    for a, b in TEXTS + random_pairs(200):
        hits, n, m = sequence_hits((a or "").lower(), b.lower())
        assert hits == table(tokens(a), tokens(b))[-1][-1]
        assert (n or 0, m or 0) == (len(tokens(a)), len(tokens(b)))
        assert summary_hits((a or "").lower(), b.lower())[0] == plain_summary_hits(a, b)


def test_long_texts_are_taken_whole():
    rng = random.Random(1)
    words = [f"w{rng.randint(0, 500)}" for _ in range(20_000)]
    a, b = " ".join(words), " ".join(words[:7000] + ["zz"] + words[7000:])
    assert sequence_hits(a, b) == (20_000, 20_000, 20_001)


def test_rouge_columns(spark):
    rows = TEXTS + random_pairs(30)
    df = spark.createDataFrame(rows, "p string, t string").coalesce(1)
    got = metrics.score(df, "p", "t", ["exact_match", "rouge1", "rougeL", "rougeLsum"]).collect()
    for r, (p, t) in zip(got, rows):
        a, b = tokens(p), tokens(t)
        overlap = sum((Counter(a) & Counter(b)).values())
        assert r["exact_match"] == float(p == t)
        assert r["rouge1"] == pytest.approx(f_score(overlap, len(a), len(b)))
        assert r["rougeL"] == pytest.approx(f_score(table(a, b)[-1][-1], len(a), len(b)))
        assert r["rougeLsum"] == pytest.approx(f_score(plain_summary_hits(p, t), len(a), len(b)))


def test_own_metric(spark):
    df = spark.createDataFrame([("ab", "a")], "p string, t string")
    extra = {"longer": lambda p, t: F.length(p) - F.length(t)}
    assert metrics.score(df, "p", "t", [], extra).first()["longer"] == 1


@pytest.mark.parametrize("text", ["Hello big world. Why?", "no mark", "xyz 123 bcd brr!", "émile a été!!! ok", "Aeiou..."])
def test_grades(spark, text):
    words = re.findall("[A-Za-z0-9]+", text)
    w, s = len(words), max(1, len(re.findall("[.!?]+", text)))
    syllables = sum(max(1, len(re.findall("[aeiouy]+", x.lower()))) for x in words)
    row = spark.createDataFrame([(text,)], "t string").select(
        textstats.flesch_kincaid(F.col("t")), textstats.automated_readability(F.col("t"))
    ).first()
    assert row[0] == pytest.approx(0.39 * w / s + 11.8 * syllables / w - 15.59)
    assert row[1] == pytest.approx(4.71 * len("".join(words)) / w + 0.5 * w / s - 21.43)


def test_grade_of_nothing_is_null(spark):
    row = spark.createDataFrame([("",), ("...",), (None,)], "t string").select(textstats.flesch_kincaid(F.col("t"))).collect()
    assert [r[0] for r in row] == [None] * 3


@pytest.mark.parametrize("accuracy", [10, 20_000])
def test_exact_quantile(spark, accuracy):
    rng = np.random.default_rng(3)
    groups = {"normal": rng.normal(size=900), "ties": np.repeat([1.0, 2.0, 5.0], 300), "one": np.array([4.0]), "two": np.array([1.0, 2.0])}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("normal", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    for q in (0.0, 0.25, 0.9, 1.0):
        got = {r["g"]: r["quantile"] for r in metrics.exact_quantile(df, ["g"], "x", q, accuracy).collect()}
        for g, xs in groups.items():
            assert got[g] == pytest.approx(np.quantile(xs, q), abs=1e-12), (g, q)


def test_aggregates_and_report(spark):
    rows = [("r", 1.0, 0.2), ("r", 0.0, 0.9), ("s", 1.0, None)]
    df = spark.createDataFrame(rows, "run string, a double, toxic double")
    got = {(r["run"], r["metric"]): r["score"] for r in metrics.metric_aggregates(df, "run", ["a"]).collect()}
    assert got[("r", "a/v1/mean")] == 0.5 and got[("r", "a/v1/variance")] == 0.25
    assert got[("r", "a/v1/p90")] == pytest.approx(0.9) and got[("s", "a/v1/p90")] == 1.0
    tox = {(r["run"], r["metric"]): r["score"] for r in metrics.toxicity_stats(df, "run", "toxic").collect()}
    assert tox[("r", "toxicity/v1/ratio")] == 0.5
    kept = metrics.metric_report(metrics.metric_aggregates(df, "run", ["a"]))
    assert {r["metric"] for r in kept.collect()} == {"a/v1/mean"}


def test_comparison(spark):
    reports = spark.createDataFrame(
        [("x", "m", 1.0), ("y", "m", 2.0), ("x", "only", 3.0), ("x", "n", None), ("y", "n", 0.5)], "run string, metric string, score double"
    )
    got = {r["metric"]: (r["x"], r["y"]) for r in compare.compare_aggregates(reports, "run", ["x", "y"]).collect()}
    assert got == {"m": (1.0, 2.0), "n": (None, 0.5)}
    source = spark.createDataFrame([(1, "q", "a"), (2, "q", "a"), (3, "q", "b")], "row_id int, model_input string, expected_output string")
    results = spark.createDataFrame(
        [(1, "x", 0.1), (1, "y", 0.2), (2, "x", 0.3), (2, "y", None), (3, "x", 0.5)], "row_id int, run string, s double"
    )
    rows = compare.compare_rows(source, results, "run", ["x", "y"], ["s"]).orderBy("row_id").collect()
    assert [(r["row_id"], r["s x"], r["s y"]) for r in rows] == [(1, 0.1, 0.2), (2, 0.3, None)]
    swapped = compare.compare_rows(source, results, "run", ["y", "x"], ["s"]).orderBy("row_id").collect()
    assert [(r["s x"], r["s y"]) for r in swapped] == [(0.1, 0.2), (0.3, None)]
    marked = compare.mark_user_columns(source, ["row_id"])
    assert marked.columns[0] == "row_id_$useradded$" and compare.unmark_user_columns(marked).columns == source.columns


def test_batches_and_models(spark):
    def load(model, adapter):
        return lambda prompts: [f"{model}/{adapter}/{len(prompts) <= 3}/{p}" for p in prompts]

    df = spark.range(11).select("id", F.concat(F.lit("p"), "id").alias("prompt"))
    rows = predict.batch_predict(predict.fanout_models(df, [("m", None), ("m", "a")]), "prompt", load, batch_size=3).collect()
    assert {r["prediction"] for r in rows} == {f"m/{a}/True/p{i}" for i in range(11) for a in (None, "a")}
    assert all(r["latency"] >= 0 for r in rows)
    alone = predict.batch_predict(df, "prompt", load).collect()
    assert {r["prediction"] for r in alone} == {f"None/None/True/p{i}" for i in range(11)}


def test_strip_prompt(spark):
    row = spark.range(1).select(predict.strip_prompt(F.lit("pröa"), F.lit("prö")), predict.strip_prompt(F.lit("p"), F.lit("p"))).first()
    assert tuple(row) == ("a", "")


def test_models_are_loaded_once_per_worker(spark, tmp_path):
    from rowloom.operators import predict

    log = str(tmp_path / "loads")

    def load(model, adapter):
        with open(log, "a") as f:
            f.write(f"{model} {adapter}\n")
        return lambda prompts: [f"{model}:{p}" for p in prompts]

    rows = spark.range(700).selectExpr("CAST(id AS STRING) AS p").repartition(12)
    models = [("a", None), ("b", "x"), ("c", None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    found = predict.batch_predict(predict.fanout_models(rows, models), "p", load).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == 2100 and all(r["prediction"] == f"{r['model']}:{r['p']}" for r in found)
    with open(log) as f:
        assert len(f.readlines()) <= 4 * len(models)


def test_brackets_that_miss_are_mended(spark):
    random.seed(4)
    rows = [("a", random.gauss(0, 10)) for _ in range(3000)] + [("b", float(i % 7)) for i in range(2000)] + [("c", 1.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    for q in (0.0, 0.1, 0.5, 0.9, 1.0):
        for accuracy in (1, 5, 50):
            found = {r["g"]: r["quantile"] for r in metrics.exact_quantile(df, ["g"], "x", q, accuracy=accuracy, slack=0.0).collect()}
            for g in "abc":
                values = [x for h, x in rows if h == g]
                assert found[g] == pytest.approx(float(pd.Series(values).quantile(q)), abs=1e-9)
            assert set(found) == {"a", "b", "c"}


def test_parts_merge_to_the_whole(spark):
    random.seed(5)
    rows = [(run, metric, 1e6 + random.gauss(3, 2), random.randrange(7)) for run in ("r", "s") for metric in ("m", "n") for _ in range(700)] + [("r", "m", None, 0), ("t", "m", 4.0, 3)]
    long = spark.createDataFrame(rows, "run string, metric string, value double, part int").repartition(4)
    whole = metrics.summarise(long, ["run", "metric"], "value")
    merged = metrics.merge_summaries(metrics.summarise(long, ["run", "metric", "part"], "value"), ["run", "metric"])
    halves = metrics.summarise(long, ["run", "metric", "part"], "value").withColumn("half", F.col("part") % 2)
    twice = metrics.merge_summaries(metrics.merge_summaries(halves, ["run", "metric", "half"]), ["run", "metric"])
    want = {(r["run"], r["metric"]): r for r in whole.collect()}
    for found in (merged, twice):
        got = {(r["run"], r["metric"]): r for r in found.collect()}
        assert set(got) == set(want)
        for key, r in got.items():
            assert (r["n"], r["least"], r["most"]) == (want[key]["n"], want[key]["least"], want[key]["most"])
            assert r["mean"] == pytest.approx(want[key]["mean"], rel=1e-12) and r["m2"] == pytest.approx(want[key]["m2"], rel=1e-9)
    told = {(r["run"], r["metric"]): r["score"] for r in metrics.merged_aggregates(long, merged, "run").collect()}
    for run, metric in want:
        values = pd.Series([v for a, b, v, _ in rows if (a, b) == (run, metric) and v is not None])
        assert told[run, f"{metric}/v1/p90"] == pytest.approx(values.quantile(0.9), rel=1e-12)
        assert told[run, f"{metric}/v1/variance"] == pytest.approx(values.var(ddof=0), rel=1e-6, abs=1e-9)


def test_answers_survive_a_lost_call(spark):
    path, calls = fresh_path(spark, "t"), fresh_path(spark, "calls").removeprefix("file:")
    os.makedirs(calls)

    def loader(broken):
        def load(model, adapter):
            def answer(prompts):
                if broken and any("p9" in p for p in prompts):
                    raise RuntimeError("lost")
                open(f"{calls}/{uuid.uuid4().hex}-{len(prompts)}", "w").close()
                return [f"{model}/{adapter}: {p}" for p in prompts]

            return answer

        return load

    def asked():
        return sum(int(name.split("-")[1]) for name in os.listdir(calls))

    rows = [(i, f"p{i}", m, a) for i in range(30) for m, a in (("m", None), ("m", "x"))] + [(None, None, "m", None), (3, "p3", "m", None)]
    df = spark.createDataFrame(rows, "k int, p string, model string, adapter string")
    df = df.withColumn("p", F.coalesce("p", F.lit("none")))
    with pytest.raises(Exception):
        predict.predict_missing(df, "k", "p", loader(True), path, waves=8)
    before = asked()
    kept = sum(spark.read.parquet(f"{path}/{r['wave']}").count() for r in spark.read.parquet(f"{path}/manifest").collect())
    assert 0 < kept < 62
    done = predict.predict_missing(df, "k", "p", loader(False), path, waves=8)
    assert asked() - before == 62 - kept
    want = sorted((str(k), f"{m}/{a}: {p or 'none'}") for k, p, m, a in rows)
    assert sorted((str(r["k"]), r["prediction"]) for r in done.collect()) == want
    # Nothing is missing any more; a new prompt for an old key is.
    before = asked()
    again = predict.predict_missing(df.withColumn("p", F.when(F.col("k") == 5, "new").otherwise(F.col("p"))), "k", "p", loader(False), path)
    assert asked() - before == 2 and again.count() == 62 and again.filter("prediction LIKE '%new'").count() == 2
    assert predict.predict_missing(df.limit(0), "k", "p", loader(False), fresh_path(spark, "t")).count() == 0
