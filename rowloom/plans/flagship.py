"""The whole way from conversations to a report per model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.hashing import bucket
from rowloom.functions.names import run_name
from rowloom.functions.templates import OUTPUT_FIELD, render_eval_pair
from rowloom.operators import metrics, predict, sampling
from rowloom.plans.fixtures import given

MODELS = [("good", None), ("weak", None)]
# Of ten rows, how many each stub model answers rightly.
RIGHT = {"good": 7, "weak": 3}


def evaluate_stub_models(spark: SparkSession, folder: str) -> DataFrame:
    """Render pairs, take the test rows, answer them with two stub models and report means."""
    pairs = given(spark, folder, "pairs").withColumn("split", F.lit("train"))
    split = sampling.sample_and_split(pairs, "row_id", 1.0, 0.5)
    rendered = render_eval_pair(split.filter(F.col("split") == "test"), "{instruction}\n", "{response}")
    asked = predict.fanout_models(rendered, MODELS).withColumn("run", run_name(F.col("model"), F.col("adapter")))
    right = F.lit(False)
    for model, share in RIGHT.items():
        right = right | ((F.col("model") == model) & (bucket(model, "row_id") % 10 < share))
    answered = asked.withColumn("prediction", F.when(right, F.col("response")).otherwise(F.col("instruction")))
    names = ["exact_match", "rouge1", "flesch_kincaid_grade_level", "ari_grade_level"]
    scored = metrics.score(answered, "prediction", OUTPUT_FIELD, names)
    rate = metrics.exact_match_rate(answered, "run", "prediction", OUTPUT_FIELD)
    found = metrics.metric_aggregates(scored, "run", names).unionByName(rate)
    return metrics.metric_report(found)
