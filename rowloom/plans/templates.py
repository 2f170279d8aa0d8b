"""Prompt templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.functions import jsontext, names
from rowloom.functions import templates as T
from rowloom.operators import sampling, template_choice
from rowloom.plans import query
from rowloom.plans.fixtures import given, table
from rowloom.sources.datasets import parsed_features

TRAIN_TEMPLATE = "### Instruction:\n{instruction}\n\n### Response {{ok}}:\n{response}"


@query(
    "render_train",
    """SELECT row_id, concat('### Instruction:', chr(10), instruction, chr(10), chr(10), '### Response {ok}:', chr(10), response, '</s>')
              AS prediction FROM #pairs""",
)
def render_train(spark, sf):
    return T.render_train(given(spark, sf, "pairs"), TRAIN_TEMPLATE).select("row_id", "prediction")


@query(
    "render_values",
    """SELECT l_orderkey, l_linenumber, concat(CAST(l_quantity AS VARCHAR), ' of ', l_partkey, ' at ', CAST(l_extendedprice AS VARCHAR),
              ' taxed ', CASE WHEN l_tax > 0 THEN 'True' ELSE 'False' END, ' note ', CASE WHEN l_returnflag = 'N' THEN 'None' ELSE l_returnflag END)
              AS prediction FROM @lineitem""",
)
def render_values(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.struct("l_quantity", "l_partkey", "l_extendedprice").alias("line"),
        (F.col("l_tax") > 0).alias("taxed"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("note"),
    )
    template = "{line[l_quantity]} of {line.l_partkey} at {line.l_extendedprice} taxed {taxed} note {note}"
    return T.render_train(rows, template, eos=None).select("l_orderkey", "l_linenumber", "prediction")


@query(
    "render_eval_pair",
    """SELECT row_id, concat('### Instruction:', chr(10), instruction) AS model_input, concat(response, chr(10)) AS expected_output FROM #pairs""",
)
def render_eval_pair(spark, sf):
    rows = T.render_eval_pair(given(spark, sf, "pairs"), "### Instruction:\n{instruction}", "{response}\n")
    return rows.select("row_id", T.INPUT_FIELD, T.OUTPUT_FIELD)


@query(
    "render_lenient",
    "SELECT doc_id, concat('{unknown} ', lang, ' {{source} {}: ', text, ' {') AS example FROM @documents",
)
def render_lenient(spark, sf):
    docs = table(spark, sf, "documents")
    return T.render_lenient(docs, "{unknown} {lang} {{source} {}: {text} {", "example").select("doc_id", "example")


@query(
    "render_lenient_by_row",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN concat('<', lang, '> ', text) WHEN lang = 'fr' THEN concat(source, ' {title}', source)
              ELSE 'no placeholder' END AS example FROM @documents""",
)
def render_lenient_by_row(spark, sf):
    template = (
        F.when(F.col("lang") == "en", "<{lang}> {text}")
        .when(F.col("lang") == "fr", "{source} {title}{source}")
        .otherwise("no placeholder")
    )
    docs = table(spark, sf, "documents").withColumn("template", template)
    return T.render_lenient_by_row(docs, "template", ["lang", "text", "source"], "example").select("doc_id", "example")


@query(
    "placeholders",
    """SELECT id, CAST(len(regexp_extract_all(prompt_template, '\\{(.*?)\\}', 1)) AS BIGINT) AS n_placeholders,
              regexp_extract_all(prompt_template, '\\{(.*?)\\}', 1)[1] AS input_guess,
              regexp_extract_all(input_template, '\\{(.*?)\\}', 1)[-1] AS target_guess FROM #prompts""",
)
def placeholders(spark, sf):
    prompts = given(spark, sf, "prompts")
    return prompts.select(
        "id",
        F.size(T.placeholders(F.col("prompt_template"))).cast("bigint").alias("n_placeholders"),
        T.first_placeholder(F.col("prompt_template")).alias("input_guess"),
        T.last_placeholder(F.col("input_template")).alias("target_guess"),
    )


_PRIORITY = "[" + ", ".join(f"'{name}'" for name in template_choice.OUTPUT_NAMES) + "]"
_LINE = "'<' || upper(f[1]) || lower(f[2:]) || '>: {' || f || '}' || chr(10)"
_HEAD = template_choice.PROMPT_HEAD.strip()


@query(
    "generate_templates",
    f"""WITH d AS (SELECT id, CAST(features AS VARCHAR[]) AS features FROM #datasets),
        r AS (SELECT *, list_filter({_PRIORITY}, lambda p: list_contains(list_transform(features, lambda f: lower(f)), p))[1] AS best FROM d),
        o AS (SELECT *, CASE WHEN best IS NULL THEN features[-1] ELSE list_filter(features, lambda f: lower(f) = best)[1] END AS output_column FROM r)
        SELECT id, output_column,
               '{_HEAD}' || chr(10) || chr(10) || array_to_string(list_transform(list_filter(features, lambda f: f <> output_column), lambda f: {_LINE}), '')
                 || '<' || upper(output_column[1]) || lower(output_column[2:]) || '>: ' || chr(10) AS prompt_template,
               '{{' || output_column || '}}' || chr(10) AS completion_template
        FROM o""",
)
def generate_templates(spark, sf):
    datasets = parsed_features(given(spark, sf, "datasets").select("id", "features"), "features")
    made = template_choice.generate_templates(datasets, "features")
    return made.select("id", "output_column", "prompt_template", "completion_template")


@query(
    "compose_training_template",
    """SELECT doc_id, concat(regexp_replace(text, '\\n+$', ''), regexp_replace(regexp_replace(concat(' ', chr(10), source, chr(10)), '^\\s+', ''), '\\s+$', ''))
              AS training_template FROM @documents""",
)
def compose_training_template(spark, sf):
    completion = F.concat(F.lit(" \n"), F.col("source"), F.lit("\n"))
    composed = T.compose_training_template(F.col("text"), completion)
    return table(spark, sf, "documents").select("doc_id", composed.alias("training_template"))


@query(
    "format_template_text",
    f"""WITH d AS (SELECT id, list_transform(CAST(features AS VARCHAR[]), lambda f: {_LINE}) AS lines FROM #datasets)
        SELECT id AS dataset_id, array_to_string(lines, '') AS prompt_template FROM d
        WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT dataset_id FROM #prompts) p WHERE p.dataset_id = d.id AND len(d.lines) > 3)""",
)
def format_template_text(spark, sf):
    datasets = parsed_features(given(spark, sf, "datasets"), "features")
    # Datasets with more than three columns and a prompt already have the generated one.
    have = datasets.filter(F.size("features") > 3).select(
        F.col("id").alias("dataset_id"), template_choice.feature_lines(F.col("features")).alias("prompt_template")
    )
    have = have.join(given(spark, sf, "prompts").select("dataset_id"), "dataset_id", "left_semi")
    return template_choice.format_prompts(datasets, have, F.col("id"), "features")


@query(
    "template_audit",
    """WITH p AS (SELECT id, dataset_id, unnest(list_distinct(regexp_extract_all(prompt_template, '\\{(.*?)\\}', 1))) AS placeholder FROM #prompts)
       SELECT p.id AS prompt_id, p.dataset_id, p.placeholder FROM p LEFT JOIN #datasets d ON d.id = p.dataset_id
       WHERE NOT coalesce(list_contains(CAST(d.features AS VARCHAR[]), p.placeholder), FALSE)""",
)
def template_audit(spark, sf):
    datasets = parsed_features(given(spark, sf, "datasets"), "features")
    return template_choice.template_audit(given(spark, sf, "prompts"), datasets, "prompt_template", "features")


@query(
    "preview_examples",
    """SELECT doc_id, concat(lang, ': ', text) AS prediction FROM @documents
       ORDER BY @b(look;doc_id), CAST(doc_id AS VARCHAR) LIMIT 20""",
)
def preview_examples(spark, sf):
    docs = table(spark, sf, "documents")
    return T.render_train(sampling.preview(docs, "doc_id", 20, "look"), "{lang}: {text}", eos=None).select(
        "doc_id", "prediction"
    )


@query(
    "preview_each_dataset",
    """SELECT doc_id, source, concat(lang, ': ', text) AS prediction
       FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY @b(look;doc_id), CAST(doc_id AS VARCHAR)) AS n FROM @documents) WHERE n <= 5""",
)
def preview_each_dataset(spark, sf):
    """Each source stands for a dataset."""
    shown = sampling.preview_each(table(spark, sf, "documents"), "source", "doc_id", 5, "look")
    return T.render_train(shown, "{lang}: {text}", eos=None).select("doc_id", "source", "prediction")


_FORMATS = ", ".join(
    f"({i}, '{name}', {cols})" for i, (name, cols) in enumerate(template_choice.FORMATS.items())
)


@query(
    "best_format",
    f"""WITH f(pos, name, cols) AS (VALUES {_FORMATS}),
        m AS (SELECT d.id, f.name, f.pos, len(list_intersect(f.cols, CAST(d.features AS VARCHAR[]))) AS n FROM #datasets d, f),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, pos) AS rn FROM m)
        SELECT id, CASE WHEN n > 0 THEN name END AS format, CAST(n AS BIGINT) AS overlap FROM r WHERE rn = 1""",
)
def best_format(spark, sf):
    datasets = parsed_features(given(spark, sf, "datasets").select("id", "features"), "features")
    matched = template_choice.best_format(datasets, "features")
    return matched.select("id", "format", F.col("overlap").cast("bigint").alias("overlap"))


@query(
    "conform_format",
    "SELECT instruction, CAST(NULL AS VARCHAR) AS input, response AS output FROM #pairs",
)
def conform_format(spark, sf):
    columns = template_choice.FORMATS["alpaca"]
    return template_choice.conform_format(given(spark, sf, "pairs"), columns, {"response": "output"})


@query(
    "artifact_name",
    """SELECT doc_id, right(replace(concat(source, '/', lang, '-', text), '/', '-'), 49) AS artifact,
              concat('ft-model-', right(right(replace(concat(source, '/', lang, '-', text), '/', '-'), 49), 40)) AS registered FROM @documents""",
)
def artifact_name(spark, sf):
    artifact = names.artifact_name(F.concat_ws("/", "source", "lang"), F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", artifact.alias("artifact"), names.registered_name(artifact).alias("registered")
    )


@query(
    "last_segment",
    """SELECT page_id, regexp_extract(url, '[^/]*$') AS last_part, regexp_extract(html, '(\\S+)\\s*$', 1) AS last_word FROM @pages""",
)
def last_segment(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", names.last_path_part(F.col("url")).alias("last_part"), names.last_word(F.col("html")).alias("last_word")
    )


@query(
    "lenient_json",
    """SELECT id, CASE WHEN json_valid(config) THEN json_extract_string(config, '$.lr')::DOUBLE
                       WHEN json_valid(replace(config, '''', '"')) THEN json_extract_string(replace(config, '''', '"'), '$.lr')::DOUBLE
                       ELSE -1 END AS lr FROM #configs""",
)
def lenient_json(spark, sf):
    parsed = jsontext.lenient_variant(F.col("config"), '{"lr": -1}')
    return given(spark, sf, "configs").select("id", F.variant_get(parsed, "$.lr", "double").alias("lr"))


@query(
    "option_precedence",
    """SELECT id, coalesce(CASE WHEN is_default = 1 THEN 0.25 END,
              CASE WHEN json_valid(config) THEN json_extract_string(config, '$.lr')::DOUBLE END, 0.5) AS lr,
              coalesce(CASE WHEN json_valid(config) THEN json_extract_string(config, '$.b.k')::DOUBLE::BIGINT END, 50) AS k FROM #configs""",
)
def option_precedence(spark, sf):
    args = F.try_parse_json(F.when(F.col("is_default") == 1, '{"lr": 0.25}').otherwise("{}"))
    config = F.try_parse_json("config")
    return given(spark, sf, "configs").select(
        "id",
        jsontext.option(args, config, "lr", 0.5, "double").alias("lr"),
        jsontext.option(args, config, "b.k", 50, "bigint").alias("k"),
    )
