"""Model output, metrics and run comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.functions import names, textstats
from rowloom.functions.templates import INPUT_FIELD, OUTPUT_FIELD
from rowloom.operators import compare, metrics, predict, text_join, toxicity
from rowloom.plans import query
from rowloom.plans.fixtures import given, table
from rowloom.session import fresh_path
from rowloom.sources import results

RUNS = ("good", "weak")
MODELS = [("base", None), ("base", "tuned"), ("other", "tuned")]


def load_echo(model, adapter):
    """A stand-in for a model: answers with its own name and the prompt."""
    return lambda prompts: [f"{model}+{adapter}: {p}" for p in prompts]


@query(
    "batch_predict",
    """SELECT row_id, m.model, m.adapter, concat(m.model, '+', coalesce(m.adapter, 'None'), ': ', instruction) AS prediction, TRUE AS timed
       FROM #pairs, (VALUES ('base', NULL), ('base', 'tuned'), ('other', 'tuned')) m(model, adapter)""",
)
def batch_predict(spark, sf):
    rows = predict.fanout_models(given(spark, sf, "pairs").select("row_id", "instruction"), MODELS)
    out = predict.batch_predict(rows, "instruction", load_echo)
    return out.select("row_id", "model", "adapter", "prediction", (F.col("latency") >= 0).alias("timed"))


@query(
    "predict_missing",
    """SELECT row_id, m.model, m.adapter, concat(m.model, '+', coalesce(m.adapter, 'None'), ': ', instruction) AS prediction
       FROM #pairs, (VALUES ('base', NULL), ('base', 'tuned'), ('other', 'tuned')) m(model, adapter)""",
)
def predict_missing(spark, sf):
    """Half of the rows first; the second call asks for the others only."""
    rows = predict.fanout_models(given(spark, sf, "pairs").select("row_id", "instruction"), MODELS)
    path = fresh_path(spark, "answers")
    predict.predict_missing(rows.filter("row_id % 2 = 0"), "row_id", "instruction", load_echo, path, waves=2)
    return predict.predict_missing(rows, "row_id", "instruction", load_echo, path, waves=2).select("row_id", "model", "adapter", "prediction")


@query(
    "fanout_models",
    """SELECT row_id, concat('base: ', instruction) AS base, concat('base + tuned: ', instruction) AS "base + tuned",
              concat('other + tuned: ', instruction) AS "other + tuned" FROM #pairs""",
)
def fanout_models(spark, sf):
    rows = predict.fanout_models(given(spark, sf, "pairs").select("row_id", "instruction"), MODELS)
    run = names.run_name(F.col("model"), F.col("adapter"))
    answered = rows.select("row_id", run.alias("run"), F.concat_ws(": ", run, "instruction").alias("prediction"))
    return predict.side_by_side(answered, "row_id", "run", ["base", "base + tuned", "other + tuned"])


@query("strip_prompt", "SELECT row_id, run, prediction FROM #predictions")
def strip_prompt(spark, sf):
    echoed = given(spark, sf, "predictions").withColumn("output", F.concat("model_input", "prediction"))
    answer = predict.strip_prompt(F.col("output"), F.col("model_input"))
    return echoed.select("row_id", "run", answer.alias("prediction"))


@query(
    "exact_match",
    """SELECT run, 'exact_match/v1' AS metric, round(avg(CASE WHEN prediction = expected_output THEN 1.0::DOUBLE ELSE 0 END), 9) AS score
       FROM #predictions GROUP BY run""",
)
def exact_match(spark, sf):
    rate = metrics.exact_match_rate(given(spark, sf, "predictions"), "run", "prediction", OUTPUT_FIELD)
    return rate.withColumn("score", F.round("score", 9))


ROUGE1 = """
    WITH p AS (SELECT row_id, run, prediction, expected_output FROM #predictions),
    a AS (SELECT row_id, run, t, COUNT(*) AS n FROM (SELECT row_id, run, unnest(regexp_extract_all(lower(prediction), '[a-z0-9]+')) AS t FROM p) GROUP BY ALL),
    b AS (SELECT row_id, run, t, COUNT(*) AS n FROM (SELECT row_id, run, unnest(regexp_extract_all(lower(expected_output), '[a-z0-9]+')) AS t FROM p) GROUP BY ALL),
    h AS (SELECT a.row_id, a.run, SUM(least(a.n, b.n))::DOUBLE AS hits FROM a JOIN b USING (row_id, run, t) GROUP BY 1, 2),
    na AS (SELECT row_id, run, SUM(n)::DOUBLE AS n FROM a GROUP BY 1, 2), nb AS (SELECT row_id, run, SUM(n)::DOUBLE AS n FROM b GROUP BY 1, 2),
    r AS (SELECT p.row_id, p.run, coalesce(2.0 * (h.hits / na.n) * (h.hits / nb.n) / (h.hits / na.n + h.hits / nb.n), 0.0) AS rouge1
          FROM p LEFT JOIN h USING (row_id, run) LEFT JOIN na USING (row_id, run) LEFT JOIN nb USING (row_id, run))"""


@query("rouge1", f"{ROUGE1} SELECT row_id, run, round(rouge1, 9) AS rouge1 FROM r")
def rouge1(spark, sf):
    value = metrics.rouge1(F.col("prediction"), F.col(OUTPUT_FIELD))
    return given(spark, sf, "predictions").select("row_id", "run", F.round(value, 9).alias("rouge1"))


@query(
    "rouge_l",
    """WITH RECURSIVE p AS (SELECT row_id, run, regexp_extract_all(lower(prediction), '[a-z0-9]+') AS a,
                                   regexp_extract_all(lower(expected_output), '[a-z0-9]+') AS b FROM #predictions),
       dp(row_id, run, i, l) AS (
         SELECT row_id, run, 0::BIGINT, list_transform(b, lambda x: 0::BIGINT) FROM p
         UNION ALL
         SELECT row_id, run, i + 1, list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])) FROM (
           SELECT dp.row_id, dp.run, dp.i,
                  list_transform(p.b, lambda x, j: CASE WHEN x = p.a[dp.i + 1] THEN 1 + CASE WHEN j = 1 THEN 0 ELSE dp.l[j - 1] END ELSE dp.l[j] END) AS c
           FROM dp JOIN p USING (row_id, run) WHERE dp.i < len(p.a)) s),
       h AS (SELECT p.row_id, p.run, coalesce(dp.l[-1], 0)::DOUBLE AS hits, len(a)::DOUBLE AS na, len(b)::DOUBLE AS nb
             FROM p JOIN dp ON dp.row_id = p.row_id AND dp.run = p.run AND dp.i = len(p.a))
       SELECT row_id, run, round(CASE WHEN hits > 0 THEN 2.0 * (hits / na) * (hits / nb) / (hits / na + hits / nb) ELSE 0.0 END, 9) AS rouge_l FROM h""",
)
def rouge_l(spark, sf):
    value = metrics.rouge_l(F.col("prediction"), F.col(OUTPUT_FIELD))
    return given(spark, sf, "predictions").select("row_id", "run", F.round(value, 9).alias("rouge_l"))


# No SQL for the union of subsequences: it is checked against a plain table in the tests.
@query("rouge_lsum")
def rouge_lsum(spark, sf):
    value = metrics.rouge_lsum(F.col("prediction"), F.col(OUTPUT_FIELD))
    return given(spark, sf, "predictions").select("row_id", "run", F.round(value, 9).alias("rouge_lsum"))


AGGREGATES = """
    SELECT run, 'latency/v1/mean' AS metric, round(avg(latency), 9) AS score FROM #predictions GROUP BY run
    UNION ALL SELECT run, 'latency/v1/variance', round(var_pop(latency), 9) FROM #predictions GROUP BY run
    UNION ALL SELECT run, 'latency/v1/p90', round(quantile_cont(latency, 0.9), 9) FROM #predictions GROUP BY run"""


@query("latency_stats", AGGREGATES)
def latency_stats(spark, sf):
    stats = metrics.metric_aggregates(given(spark, sf, "predictions"), "run", ["latency"])
    return stats.withColumn("score", F.round("score", 9))


COUNTS = """
    WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z0-9]+') AS words FROM @documents),
    c AS (SELECT doc_id, len(words)::DOUBLE AS w, greatest(len(regexp_extract_all(text, '[.!?]+')), 1)::DOUBLE AS s,
                 length(array_to_string(words, ''))::DOUBLE AS ch,
                 list_sum(list_transform(words, lambda x: greatest(len(regexp_extract_all(lower(x), '[aeiouy]+')), 1)))::DOUBLE AS syl FROM w)"""


@query(
    "flesch_kincaid",
    f"{COUNTS} SELECT doc_id, CASE WHEN w > 0 THEN round(0.39::DOUBLE * (w / s) + 11.8::DOUBLE * (syl / w) + (-15.59)::DOUBLE, 9) END AS grade FROM c",
)
def flesch_kincaid(spark, sf):
    grade = F.round(textstats.flesch_kincaid(F.col("text")), 9)
    return table(spark, sf, "documents").select("doc_id", grade.alias("grade"))


@query(
    "ari",
    f"{COUNTS} SELECT doc_id, CASE WHEN w > 0 THEN round(4.71::DOUBLE * (ch / w) + 0.5::DOUBLE * (w / s) + (-21.43)::DOUBLE, 9) END AS grade FROM c",
)
def ari(spark, sf):
    grade = F.round(textstats.automated_readability(F.col("text")), 9)
    return table(spark, sf, "documents").select("doc_id", grade.alias("grade"))


@query(
    "toxicity_stats",
    """WITH s AS (SELECT d.source AS run, l.toxic::DOUBLE AS x FROM @documents d JOIN @labels l USING (doc_id))
       SELECT run, 'toxicity/v1/mean' AS metric, round(avg(x), 9) AS score FROM s GROUP BY run
       UNION ALL SELECT run, 'toxicity/v1/variance', round(var_pop(x), 9) FROM s GROUP BY run
       UNION ALL SELECT run, 'toxicity/v1/p90', round(quantile_cont(x, 0.9), 9) FROM s GROUP BY run
       UNION ALL SELECT run, 'toxicity/v1/ratio', round(avg(CASE WHEN x >= 0.5 THEN 1.0::DOUBLE ELSE 0 END), 9) FROM s GROUP BY run""",
)
def toxicity_stats(spark, sf):
    scored = table(spark, sf, "documents").select("doc_id", F.col("source").alias("run")).join(table(spark, sf, "labels"), "doc_id")
    return metrics.toxicity_stats(scored, "run", "toxic").withColumn("score", F.round("score", 9))


_ALL_AGGREGATES = f"""{ROUGE1},
    x AS (SELECT p.run, CASE WHEN p.prediction = p.expected_output THEN 1.0::DOUBLE ELSE 0 END AS exact_match, r.rouge1
          FROM p JOIN r USING (row_id, run)),
    l AS (SELECT run, 'exact_match' AS name, exact_match AS x FROM x UNION ALL SELECT run, 'rouge1', rouge1 FROM x),
    g AS (SELECT run, concat(name, '/v1/mean') AS metric, round(avg(x), 9) AS score FROM l GROUP BY run, name
          UNION ALL SELECT run, concat(name, '/v1/variance'), round(var_pop(x), 9) FROM l GROUP BY run, name
          UNION ALL SELECT run, concat(name, '/v1/p90'), round(quantile_cont(x, 0.9), 9) FROM l GROUP BY run, name)"""


def scored(spark, sf):
    rows = given(spark, sf, "predictions")
    return metrics.score(rows, "prediction", OUTPUT_FIELD, ["exact_match", "rouge1"])


def written_scores(spark, sf):
    """Row-wise results go out once per run; all aggregates read them back."""
    path = fresh_path(spark, "scores")
    results.write_results(scored(spark, sf).select("run", "row_id", "exact_match", "rouge1", "latency"), path)
    return results.read_results(spark, path)


@query("metric_aggregates", f"{_ALL_AGGREGATES} SELECT run, metric, score FROM g")
def metric_aggregates(spark, sf):
    found = metrics.metric_aggregates(written_scores(spark, sf), "run", ["exact_match", "rouge1"])
    return found.withColumn("score", F.round("score", 9))


@query(
    "value_quantile",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 9) AS p90 FROM @lineitem GROUP BY l_returnflag""",
)
def value_quantile(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    found = metrics.exact_quantile(rows, ["l_returnflag"], "l_extendedprice", 0.9)
    return found.select("l_returnflag", F.round("quantile", 9).alias("p90"))


@query(
    "coarse_quantile",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 9) AS p90 FROM @lineitem GROUP BY l_returnflag""",
)
def coarse_quantile(spark, sf):
    """A sketch far too coarse, trusted to the point: its brackets miss and are mended."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    found = metrics.exact_quantile(rows, ["l_returnflag"], "l_extendedprice", 0.9, accuracy=10, slack=0.0)
    return found.select("l_returnflag", F.round("quantile", 9).alias("p90"))


@query("merged_aggregates", f"{_ALL_AGGREGATES} SELECT run, metric, score FROM g")
def merged_aggregates(spark, sf):
    """The rows come in seven parts; each leaves a summary, and the summaries are merged."""
    rows = written_scores(spark, sf)
    long = metrics.long_form(rows.withColumn("part", F.col("row_id") % 7), ["run", "part"], ["exact_match", "rouge1"])
    path = fresh_path(spark, "summaries")
    metrics.summarise(long, ["run", "metric", "part"], "value").write.partitionBy("run", "part").parquet(path)
    merged = metrics.merge_summaries(spark.read.parquet(path), ["run", "metric"])
    return metrics.merged_aggregates(long, merged, "run").withColumn("score", F.round("score", 9))


@query("toxicity_scores")
def toxicity_scores(spark, sf):
    """All documents, by a model learnt from the labels of those with an even number."""
    documents = table(spark, sf, "documents").select("doc_id", F.col("source").alias("run"), "text")
    labelled = documents.join(table(spark, sf, "labels"), "doc_id").filter("doc_id % 2 = 0")
    model = toxicity.train_toxicity(labelled, "text", "toxic")
    return toxicity.score_toxicity(documents, model, "text").select("doc_id", "run", "toxicity")


@query("scored_toxicity_stats")
def scored_toxicity_stats(spark, sf):
    path = fresh_path(spark, "toxicity")
    toxicity_scores(spark, sf).write.parquet(path)
    return metrics.toxicity_stats(spark.read.parquet(path).filter("toxicity IS NOT NULL"), "run", "toxicity").withColumn("score", F.round("score", 9))


_REPORT = f"""{_ALL_AGGREGATES},
    rep AS (SELECT run, metric, score FROM g WHERE contains(metric, 'mean')
            UNION ALL SELECT run, 'exact_match/v1', score FROM g WHERE metric = 'exact_match/v1/mean')"""


def report(spark, sf):
    rate = metrics.exact_match_rate(given(spark, sf, "predictions"), "run", "prediction", OUTPUT_FIELD)
    found = metrics.metric_aggregates(written_scores(spark, sf), "run", ["exact_match", "rouge1"]).unionByName(rate)
    return metrics.metric_report(found).withColumn("score", F.round("score", 9))


@query("metric_report", f"{_REPORT} SELECT run, metric, score FROM rep")
def metric_report(spark, sf):
    return report(spark, sf)


@query(
    "join_results",
    f"{ROUGE1} SELECT r.row_id, r.run, q.instruction AS model_input, q.response AS expected_output, round(r.rouge1, 9) AS rouge1 FROM r JOIN #pairs q USING (row_id)",
)
def join_results(spark, sf):
    source = given(spark, sf, "pairs").select(
        "row_id", F.col("instruction").alias(INPUT_FIELD), F.col("response").alias(OUTPUT_FIELD)
    )
    found = scored(spark, sf).select("row_id", "run", F.round("rouge1", 9).alias("rouge1"))
    return compare.join_results(source, found)


@query(
    "compare_aggregates",
    f"""{_REPORT} SELECT a.metric, a.score AS good, b.score AS weak FROM rep a JOIN rep b ON b.metric = a.metric AND b.run = 'weak' WHERE a.run = 'good'""",
)
def compare_aggregates(spark, sf):
    return compare.compare_aggregates(report(spark, sf), "run", RUNS)


@query(
    "compare_rows",
    f"""{ROUGE1} SELECT q.row_id, q.instruction AS model_input, q.response AS expected_output,
          round(a.rouge1, 9) AS "rouge1 good", round(b.rouge1, 9) AS "rouge1 weak",
          x.latency AS "latency good", y.latency AS "latency weak"
        FROM #pairs q JOIN r a ON a.row_id = q.row_id AND a.run = 'good' JOIN r b ON b.row_id = q.row_id AND b.run = 'weak'
        JOIN #predictions x ON x.row_id = q.row_id AND x.run = 'good' JOIN #predictions y ON y.row_id = q.row_id AND y.run = 'weak'""",
)
def compare_rows(spark, sf):
    source = given(spark, sf, "pairs").select(
        "row_id", F.col("instruction").alias(INPUT_FIELD), F.col("response").alias(OUTPUT_FIELD)
    )
    found = scored(spark, sf).select("row_id", "run", F.round("rouge1", 9).alias("rouge1"), "latency")
    return compare.compare_rows(source, found, "run", RUNS, ["rouge1", "latency"])


# Texts cut short, so that pairs repeat and some expected outputs are missing.
_CUT = """SELECT row_id, run, substr(model_input, 1, 3) AS model_input, CASE WHEN length(expected_output) % 3 > 0 THEN substr(expected_output, 1, 2) END AS expected_output,
        CAST(floor(latency * 10) AS INT) AS tenth, length(prediction) > length(expected_output) AS longer FROM #predictions"""


def _cut(spark, sf):
    rows = given(spark, sf, "predictions")
    expected = F.when(F.length(OUTPUT_FIELD) % 3 > 0, F.substring(OUTPUT_FIELD, 1, 2)).alias(OUTPUT_FIELD)
    tenth, longer = F.floor(F.col("latency") * 10).cast("int").alias("tenth"), (F.length("prediction") > F.length(OUTPUT_FIELD)).alias("longer")
    return rows.select("row_id", "run", F.substring(INPUT_FIELD, 1, 3).alias(INPUT_FIELD), expected, tenth, longer)


@query(
    "join_results_by_text",
    f"""WITH c AS ({_CUT})
        SELECT a.model_input, a.expected_output, a.row_id % 7 AS note, b.tenth AS score FROM c a JOIN c b
        ON a.model_input IS NOT DISTINCT FROM b.model_input AND a.expected_output IS NOT DISTINCT FROM b.expected_output WHERE a.run = 'good' AND b.run = 'weak'""",
)
def join_results_by_text(spark, sf):
    rows = _cut(spark, sf)
    source = rows.filter("run = 'good'").select(INPUT_FIELD, OUTPUT_FIELD, (F.col("row_id") % 7).alias("note"))
    return text_join.join_results_by_text(source, rows.filter("run = 'weak'").select(INPUT_FIELD, OUTPUT_FIELD, F.col("tenth").alias("score")))


@query(
    "compare_rows_by_text",
    f"""WITH c AS ({_CUT})
        SELECT a.model_input, a.expected_output, a.tenth AS "tenth good", a.longer AS "longer good", b.tenth AS "tenth weak", b.longer AS "longer weak" FROM c a JOIN c b
        ON a.model_input IS NOT DISTINCT FROM b.model_input AND a.expected_output IS NOT DISTINCT FROM b.expected_output WHERE a.run = 'good' AND b.run = 'weak'""",
)
def compare_rows_by_text(spark, sf):
    return text_join.compare_rows_by_text(_cut(spark, sf), "run", RUNS, ["tenth", "longer"])


@query(
    "first_non_null",
    """SELECT l_orderkey, arg_min(l_shipmark, pos) FILTER (WHERE l_shipmark IS NOT NULL) AS adapter_id
       FROM (SELECT l_orderkey, CASE WHEN l_returnflag <> 'N' THEN concat('a', l_partkey) END AS l_shipmark,
                    concat(l_linenumber, '-', lpad(CAST(l_partkey AS VARCHAR), 12, '0')) AS pos FROM @lineitem) GROUP BY l_orderkey""",
)
def first_non_null(spark, sf):
    adapter = F.when(F.col("l_returnflag") != "N", F.concat(F.lit("a"), F.col("l_partkey")))
    pos = F.concat_ws("-", "l_linenumber", F.lpad(F.col("l_partkey").cast("string"), 12, "0"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", adapter.alias("adapter_id"), pos.alias("pos"))
    return compare.first_non_null(rows, "l_orderkey", "adapter_id", "pos")
