"""Sources, sinks and projections."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.names import status_label
from rowloom.functions.templates import render_eval_pair
from rowloom.operators import compare, projection
from rowloom.plans import query
from rowloom.plans.fixtures import given, table
from rowloom.session import fresh_path
from rowloom.sources import datasets, results
from rowloom.streaming import changes, streams


@query(
    "scan_csv",
    "SELECT CAST(doc_id AS BIGINT) AS doc_id, text, lang, source, CAST(n_chars AS BIGINT) AS n_chars, 'train' AS split FROM @documents",
)
def scan_csv(spark, sf):
    path = fresh_path(spark, "csv")
    results.export_csv(table(spark, sf, "documents"), path)
    read = datasets.read_dataset(spark, path, "csv", multiline=True)  # texts have line breaks
    return read.withColumns({"doc_id": F.col("doc_id").cast("bigint"), "n_chars": F.col("n_chars").cast("bigint")})


@query("scan_json", "SELECT page_id, url, html, 'train' AS split FROM @pages")
def scan_json(spark, sf):
    # Files that each hold one array, of the pages of a range of a hundred ids, side by side in one folder.
    path = fresh_path(spark, "json")
    rows = table(spark, sf, "pages").withColumn("part", F.floor(F.col("page_id") / 100))
    arrays = rows.groupBy("part").agg(F.to_json(F.collect_list(F.struct("page_id", "url", "html"))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", "1").text(path)
    return datasets.read_dataset(spark, path, "json").select("page_id", "url", "html", "split")


@query("scan_jsonl", "SELECT conv_id, turn, role, text, 'train' AS split FROM @conversations")
def scan_jsonl(spark, sf):
    path = fresh_path(spark, "jsonl")
    table(spark, sf, "conversations").write.json(path)
    return datasets.read_dataset(spark, path, "jsonl").select("conv_id", "turn", "role", "text", "split")


@query(
    "scan_parquet_splits",
    """SELECT split, COUNT(*) AS n_rows, CAST(SUM(length(text)) AS BIGINT) AS n_chars FROM #split_documents
       WHERE split IN ('train', 'eval') GROUP BY split""",
)
def scan_parquet_splits(spark, sf):
    path = fresh_path(spark, "splits")
    given(spark, sf, "split_documents").write.partitionBy("split").parquet(path)
    read = datasets.read_dataset(spark, path, "parquet").filter(F.col("split").isin("train", "eval"))
    return read.groupBy("split").agg(F.count("*").alias("n_rows"), F.sum(F.length("text")).alias("n_chars"))


@query("normalize_splits", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'eval' ELSE 'train' END AS split FROM @documents")
def normalize_splits(spark, sf):
    docs = table(spark, sf, "documents")
    return projection.normalize_splits(docs.select("doc_id", F.when(F.col("lang") == "en", "eval").alias("split")))


@query(
    "dataset_features",
    """SELECT features, COUNT(*) AS n_records FROM (
         SELECT concat_ws('|', 'o_totalprice', CASE WHEN o_orderstatus <> 'P' THEN 'o_orderstatus' END, 'o_custkey',
                          CASE WHEN o_totalprice > 250000 THEN 'big' END) AS features FROM @orders)
       GROUP BY features""",
)
def dataset_features(spark, sf):
    orders = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus")
    big = F.when(F.col("o_totalprice") > 250000, F.lit(True)).alias("big")
    records = orders.select(F.to_json(F.struct("o_totalprice", status, "o_custkey", big)).alias("record"))
    listed = datasets.record_features(records, "record")
    return listed.groupBy(F.array_join("features", "|").alias("features")).agg(F.count("*").alias("n_records"))


@query(
    "path_features",
    """SELECT kind, features FROM (VALUES ('csv', 'conv_id|turn|role'), ('json', 'turn|role|conv_id'), ('jsonl', 'turn|role|conv_id'), ('parquet', 'conv_id|turn|role')) t(kind, features)
       WHERE EXISTS (SELECT 1 FROM @conversations)""",
)
def path_features(spark, sf):
    """The features of one dataset stored in four ways, each listed from its path."""
    rows = table(spark, sf, "conversations").filter("role IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "role")
    turned, paths = rows.select("turn", "role", "conv_id"), {kind: fresh_path(spark, kind) for kind in ("csv", "json", "jsonl", "parquet")}
    results.export_csv(rows, paths["csv"])
    rows.write.parquet(paths["parquet"])
    turned.write.json(paths["jsonl"])
    turned.groupBy(F.floor(F.col("conv_id") / 1000)).agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).select("value").write.option(
        "maxRecordsPerFile", "1"
    ).text(paths["json"])
    found = [(kind, "|".join(datasets.dataset_features(spark, path, kind))) for kind, path in paths.items()]
    return spark.createDataFrame(found, "kind string, features string")


@query(
    "dataset_catalog",
    """SELECT id, trim(name) AS name, CAST(len(CAST(features AS VARCHAR[])) AS BIGINT) AS n_features,
              CAST(features AS VARCHAR[])[1] AS first_feature FROM #datasets""",
)
def dataset_catalog(spark, sf):
    listed = datasets.parsed_features(given(spark, sf, "datasets"), "features")
    return listed.select(
        "id",
        F.trim("name").alias("name"),
        F.size("features").cast("bigint").alias("n_features"),
        F.get("features", F.lit(0)).alias("first_feature"),
    )


@query("split_orient_table", "SELECT doc_id, lang, n_chars FROM @documents")
def split_orient_table(spark, sf):
    # One table per thousand documents, with the columns in another order than the schema.
    path = fresh_path(spark, "split-orient")
    docs = table(spark, sf, "documents").withColumn("part", F.floor(F.col("doc_id") / 1000))
    row = F.array(F.col("lang"), F.col("doc_id").cast("string"), F.col("n_chars").cast("string"))
    names = F.array(F.lit("lang"), F.lit("doc_id"), F.lit("n_chars"))
    tables = docs.groupBy("part").agg(F.to_json(F.struct(names.alias("columns"), F.collect_list(row).alias("data"))).alias("value"))
    tables.select("value").write.option("maxRecordsPerFile", "1").text(path)
    schema = T.StructType().add("doc_id", "long").add("lang", "string").add("n_chars", "long")
    return datasets.read_split_orient(spark, path, schema)


@query(
    "write_read_results",
    "SELECT row_id, prediction, latency, run FROM #predictions WHERE run = 'good'",
)
def write_read_results(spark, sf):
    path = fresh_path(spark, "results")
    results.write_results(given(spark, sf, "predictions"), path)
    return results.read_results(spark, path, ["good"]).select("row_id", "prediction", "latency", "run")


@query(
    "export_results_csv",
    "SELECT CAST(row_id AS BIGINT) AS row_id, run, prediction, latency FROM #predictions",
)
def export_results_csv(spark, sf):
    path = fresh_path(spark, "results-csv")
    results.export_csv(given(spark, sf, "predictions").select("row_id", "run", "prediction", "latency"), path)
    schema = "row_id bigint, run string, prediction string, latency double"
    return datasets.read_dataset(spark, path, "csv", schema, multiline=True).drop("split")


@query(
    "format_catalog",
    """SELECT concat('f', p_partkey) AS key, p_name AS name, CAST(NULL AS VARCHAR) AS description, 'instruction|output' AS columns FROM @part
       UNION ALL
       SELECT concat('g', p_partkey), p_type, p_brand, concat('question|', lower(p_type), '|answer') FROM @part""",
)
def format_catalog(spark, sf):
    path = fresh_path(spark, "formats")
    entry = F.struct(
        F.col("p_name").alias("name"),
        F.lit(None).cast("string").alias("description"),
        F.create_map(F.lit("instruction"), F.lit("..."), F.lit("output"), F.lit("...")).alias("format"),
    )
    other = F.struct(
        F.col("p_type").alias("name"),
        F.col("p_brand").alias("description"),
        F.create_map(
            F.lit("question"), F.lit("..."), F.lower("p_type"), F.lit("[]"), F.lit("answer"), F.lit("...")
        ).alias("format"),
    )
    both = F.create_map(F.concat(F.lit("f"), F.col("p_partkey")), entry, F.concat(F.lit("g"), F.col("p_partkey")), other)
    docs = table(spark, sf, "part").select(F.to_json(F.struct(both.alias("dataset_formats"))).alias("value"), "p_brand")
    docs.select("value").write.text(path)
    # Here every line is a document, so the files are read line by line.
    listed = datasets.format_catalog(spark, path, multiline=False)
    return listed.withColumn("columns", F.array_join("columns", "|"))


EVAL_SQL = """SELECT row_id, concat('### ', instruction, chr(10), '>') AS model_input, response AS expected_output FROM #pairs"""


def eval_pairs(spark, sf):
    return render_eval_pair(given(spark, sf, "pairs"), "### {instruction}\n>", "{response}")


@query("eval_select", EVAL_SQL)
def eval_select(spark, sf):
    return compare.eval_select(eval_pairs(spark, sf), ["row_id"])


@query("user_column_roundtrip", "SELECT row_id, instruction AS instruction, response AS expected_output FROM #pairs")
def user_column_roundtrip(spark, sf):
    path = fresh_path(spark, "marked")
    rows = eval_pairs(spark, sf).select("row_id", "instruction", "expected_output")
    compare.mark_user_columns(rows, ["row_id", "instruction"]).write.parquet(path)
    return compare.unmark_user_columns(spark.read.parquet(path))


@query("filter_by_kind", "SELECT l_orderkey, l_linenumber, l_quantity FROM @lineitem WHERE l_returnflag = 'R'")
def filter_by_kind(spark, sf):
    rows = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R")
    return rows.select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "filter_with_fallback",
    """SELECT 'hit' AS kind, id, model_family FROM #configs WHERE type = 'click' AND model_family = 'family-1' AND is_default = 1
       UNION ALL SELECT 'fallback', id, model_family FROM #configs WHERE type = 'click'""",
)
def filter_with_fallback(spark, sf):
    configs = given(spark, sf, "configs").select("id", "type", "model_family", "is_default")

    def family(name):
        match = (F.col("model_family") == name) & (F.col("is_default") == 1)
        return projection.filter_with_fallback(configs, match, F.col("type") == "click")

    hit = family("family-1").select(F.lit("hit").alias("kind"), "id", "model_family")
    return hit.unionByName(family("no such").select(F.lit("fallback").alias("kind"), "id", "model_family"))


@query(
    "prefix_columns",
    "SELECT s_suppkey AS exp_s_suppkey, s_name AS exp_s_name, s_acctbal AS exp_s_acctbal FROM @supplier",
)
def prefix_columns(spark, sf):
    return projection.prefix_columns(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "exp_")


@query("ensure_columns", "SELECT o_orderkey, o_orderstatus, 'Unknown' AS exp_id, 'Unknown' AS html_url FROM @orders")
def ensure_columns(spark, sf):
    return projection.ensure_columns(table(spark, sf, "orders"), ["o_orderkey", "o_orderstatus", "exp_id", "html_url"])


@query("evolve_schema", "SELECT event_id, value, CAST(NULL AS VARCHAR) AS framework, CAST(NULL AS BIGINT) AS gpu_label FROM @events")
def evolve_schema(spark, sf):
    added = T.StructType().add("value", "double").add("framework", "string").add("gpu_label", "long")
    return projection.evolve_schema(table(spark, sf, "events").select("event_id", "value"), added)


@query(
    "nested_default",
    "SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'Unknown') AS k, 'Unknown' AS status FROM @events",
)
def nested_default(spark, sf):
    latest = F.from_json("props", "struct<k: int, status: string>").alias("latest")
    rows = table(spark, sf, "events").select("event_id", latest)
    return rows.select(
        "event_id",
        projection.nested_or(F.col("latest.k")).alias("k"),
        projection.nested_or(F.col("latest.status")).alias("status"),
    )


@query(
    "status_label",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN '⚪ Unknown' WHEN o_orderstatus = 'F' THEN '🔴 Failed'
              WHEN o_orderstatus = 'O' THEN '🔵 Running' ELSE concat('⚪ ', 'P', lower(substr(o_orderpriority, 2))) END AS label
       FROM @orders""",
)
def status_labels(spark, sf):
    status = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(None))
        .when(F.col("o_orderstatus") == "F", "failed")
        .when(F.col("o_orderstatus") == "O", "running")
        .otherwise(F.concat(F.lit("p"), F.substring("o_orderpriority", 2, 100)))
    )
    return table(spark, sf, "orders").select("o_orderkey", status_label(status).alias("label"))


@query(
    "union_pages",
    """SELECT event_id, ts, value, CAST(NULL AS VARCHAR) AS props FROM @events WHERE event_type = 'click'
       UNION ALL SELECT event_id, NULL, value, props FROM @events WHERE event_type = 'view'
       UNION ALL SELECT event_id, ts, NULL, props FROM @events WHERE event_type NOT IN ('click', 'view')""",
)
def union_pages(spark, sf):
    events, kind = table(spark, sf, "events"), F.col("event_type")
    pages = [
        events.filter(kind == "click").select("event_id", "ts", "value"),
        events.filter(kind == "view").select("value", "props", "event_id"),
        events.filter(~kind.isin("click", "view")).select("event_id", "ts", "props"),
    ]
    return projection.union_pages(pages)


@query(
    "progress_stream",
    """SELECT user_id AS run, event_type AS key, arg_max(value, (ts, event_id)) AS value FROM @events GROUP BY user_id, event_type""",
)
def progress_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = streams.read_stream(spark, sf, "parquet", schema, glob="events.parquet")
    keyed = stream.select(F.col("user_id").alias("run"), F.col("event_type").alias("key"), "ts", "event_id", "value")
    path = fresh_path(spark, "progress")
    latest = streams.latest_values(keyed, ["run", "key"], "value", "ts", "event_id")
    streams.write_latest(latest, f"{path}/out", f"{path}/checkpoint")
    return streams.read_latest(spark, f"{path}/out", ["run", "key"]).select("run", "key", "value")


@query(
    "progress_changes",
    """SELECT user_id AS run, event_type AS key, arg_max(value, (ts, event_id)) AS value FROM @events GROUP BY user_id, event_type""",
)
def progress_changes(spark, sf):
    """The events come a few files at a time; what a batch changes goes to the log."""
    events = table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("key"), "ts", "event_id", "value")
    path, keys = fresh_path(spark, "changes"), ["run", "key"]
    for part in range(6):
        events.filter(F.col("event_id") % 6 == part).write.mode("append").parquet(f"{path}/in")
    files = len(spark.read.parquet(f"{path}/in").inputFiles())
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", -(-files // 6)).parquet(f"{path}/in")
    with changes.rocks_state(spark):
        changed = changes.newest_changes(stream, keys, "value", "ts", "event_id")
        changes.write_changes(changed, f"{path}/log", f"{path}/checkpoint", keys)
    return changes.read_changes(spark, f"{path}/log", keys).select("run", "key", "value")


@query(
    "render_stream",
    "SELECT doc_id, concat('[', lang, '] ', text, '</s>') AS prediction FROM @documents",
)
def render_stream(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    path = fresh_path(spark, "stream")
    docs.write.json(f"{path}/in")
    stream = streams.read_stream(spark, f"{path}/in", "jsonl", docs.schema)
    streams.render_stream(stream, "[{lang}] {text}", f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema("doc_id bigint, prediction string").parquet(f"{path}/out")
