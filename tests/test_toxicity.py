import os
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rowloom.operators import metrics, toxicity

FOLDER = "/root/testdata/sf0.1"


def rows(count, seed):
    random.seed(seed)
    found = []
    for i in range(count):
        words = [f"w{random.randint(0, 60)}" for _ in range(random.randint(5, 30))]
        toxic = i % 3 == 0
        if toxic:
            # A word that is toxic only after another one.
            at = random.randrange(len(words))
            words[at : at + 1] = ["you", "fool"]
        else:
            words += random.choice([["you"], ["the", "fool"], []])
        found.append((i, " ".join(words), int(toxic)))
    return found


def test_runs_of_words(spark):
    df = spark.createDataFrame([("It's A a  test",), ("one",), ("",), (None,), ("x y",)], "t string")
    got = [r[0] for r in df.select(toxicity.word_runs(df.t)).collect()]
    assert got == [["it's", "a", "a", "test", "it's a", "a a", "a test"], ["one"], [], [], ["x", "y", "x y"]]


def test_held_out_rows_are_told_apart(spark):
    schema = "id int, text string, toxic int"
    model = toxicity.train_toxicity(spark.createDataFrame(rows(400, 1) + [(900, "no label", None), (901, None, 0)], schema), "text", "toxic")
    scored = toxicity.score_toxicity(spark.createDataFrame(rows(200, 2) + [(902, None, 1)], schema), model, "text")
    assert scored.columns == ["id", "text", "toxic", "toxicity"]
    assert toxicity.area_under_curve(scored, "toxic") > 0.95
    assert scored.filter("text IS NULL").first()["toxicity"] is None
    again = toxicity.score_toxicity(scored.withColumnRenamed("toxic", "prediction"), model, "text")
    assert again.columns == ["id", "text", "prediction", "toxicity"] and again.filter("toxicity BETWEEN 0 AND 1").count() == 200
    stats = metrics.toxicity_stats(scored.selectExpr("'r' AS run", "toxicity").filter("toxicity IS NOT NULL"), "run", "toxicity")
    assert {r["metric"] for r in stats.collect()} == {f"toxicity/v1/{x}" for x in ("mean", "variance", "p90", "ratio")}


def test_one_label_and_none(spark):
    schema = "id int, text string, toxic int"
    model = toxicity.train_toxicity(spark.createDataFrame([(1, "a", 0), (2, "b", 0)], schema), "text", "toxic")
    assert toxicity.score_toxicity(spark.createDataFrame([(3, "c", None)], schema), model, "text").first()["toxicity"] < 0.01
    with pytest.raises(ValueError):
        toxicity.train_toxicity(spark.createDataFrame([(1, "a", None)], schema), "text", "toxic")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_held_out_documents(spark):
    documents, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    labelled = documents.join(labels, "doc_id").select("doc_id", "text", "toxic")
    model = toxicity.train_toxicity(labelled.filter("doc_id % 2 = 0"), "text", "toxic")
    held_out = toxicity.score_toxicity(labelled.filter("doc_id % 2 = 1"), model, "text")
    assert toxicity.area_under_curve(held_out, "toxic") >= 0.9


def test_scores_are_those_of_the_models_own_steps(spark, monkeypatch):
    random.seed(4)
    odd = ["", None, " ", "one", "İstanbul ÉTÉ ß ſ", "a a a a", "don't 'quote' x_y", "𝒳𝒴 𝟙 你好 мир ½ e\u0301", "\x00 \x1f\ttab\nline", "é" * 999]
    texts = [t for _, t, _ in rows(200, 3)] + odd + ["".join(random.choices("abé'1 .-\n你", k=k)) for k in range(60)]
    labelled = spark.createDataFrame(rows(200, 3), "id int, text string, toxic int")
    model = toxicity.train_toxicity(labelled, "text", "toxic")
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    steps = model.transform(df.withColumn("__runs", toxicity.word_runs(F.col("text")))).select("id", vector_to_array("__probability")[1])
    want = dict(map(tuple, steps.collect()))
    for block in (1 << 22, 50):
        monkeypatch.setattr(toxicity, "BLOCK_BYTES", block)
        got = {r["id"]: r["toxicity"] for r in toxicity.score_toxicity(df, model, "text").collect()}
        assert {i for i, s in got.items() if s is None} == {texts.index(None)}
        assert all(s is None or abs(s - want[i]) < 1e-12 for i, s in got.items())
    words = sorted({w for t in texts if t for w in t.split()})
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    slots = toxicity.slots_of(data, np.concatenate(([0], ends[:-1])), ends).tolist()
    assert slots == [model.stages[0].indexOf(w) for w in words]


def test_texts_are_read_once_for_training(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    labelled = spark.createDataFrame(rows(100, 5), "id int, text string, toxic int").withColumn("text", F.udf(seen)("text"))
    toxicity.train_toxicity(labelled, "text", "toxic")
    assert read.value == 100
