"""Registry snapshots, boards and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.functions.names import status_label
from rowloom.functions.hashing import bucket
from rowloom.operators import boards, quality
from rowloom.operators.projection import nested_or
from rowloom.plans import query
from rowloom.plans.fixtures import given, table
from rowloom.session import fresh_path
from rowloom.sources import registry

TABLES = tuple(registry.SCHEMAS)
# Columns each table is filled with here; all others are null.
FILLED = {
    "models": "id type framework name description huggingface_model_name",
    "datasets": "id type name description huggingface_name location features",
    "adapters": "id type name description model_id location fine_tuning_job_id",
    "prompts": "id type name description dataset_id prompt_template input_template completion_template",
    "fine_tuning_jobs": (
        "id base_model_id dataset_id num_workers cml_job_id adapter_id num_cpu num_gpu num_memory num_epochs "
        "learning_rate dataset_fraction train_test_split framework_type axolotl_config_id adapter_name"
    ),
    "evaluation_jobs": "id type cml_job_id parent_job_id base_model_id dataset_id num_workers adapter_id",
    "configs": "id type description config model_family is_default",
}


def in_schema_order(name):
    return [c for c, _ in registry.columns_of(name) if c in FILLED[name].split()]


def registry_tables(spark, sf):
    return {name: registry.as_table(given(spark, sf, name), name) for name in TABLES}


def _export_sql(name):
    columns = in_schema_order(name)
    text = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '<null>')" for c in columns)
    n_columns = len(registry.columns_of(name))
    return f"SELECT '{name}' AS \"table\", id, {n_columns} AS n_columns, md5(concat_ws('|', {text})) AS content FROM #{name}"


@query("registry_export", " UNION ALL ".join(_export_sql(name) for name in TABLES))
def registry_export(spark, sf):
    path = fresh_path(spark, "snapshot")
    registry.export_snapshot(registry_tables(spark, sf), path)
    found = None
    for name in TABLES:
        df = registry.read_snapshot(spark, path, name)
        text = [F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in in_schema_order(name)]
        part = df.select(
            F.lit(name).alias("table"),
            "id",
            F.lit(len(df.columns)).alias("n_columns"),
            F.md5(F.concat_ws("|", *text)).alias("content"),
        )
        found = part if found is None else found.unionByName(part)
    return found


def _compact_sql(name):
    keys = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN '{c}' END" for c in in_schema_order(name))
    return f"SELECT '{name}' AS \"table\", id, concat_ws(',', {keys}) AS keys FROM #{name}"


@query("registry_export_compact", " UNION ALL ".join(_compact_sql(name) for name in TABLES))
def registry_export_compact(spark, sf):
    records = registry.export_compact(registry_tables(spark, sf))
    return records.select(
        "table",
        F.get_json_object("record", "$.id").alias("id"),
        F.array_join(F.json_object_keys("record"), ",").alias("keys"),
    )


@query(
    "registry_merge",
    """WITH i AS (SELECT concat('d', l_partkey * 10) AS id, l_returnflag AS type, concat('import ', l_orderkey) AS name,
                         concat_ws('-', lpad(CAST(l_orderkey AS VARCHAR), 12, '0'), l_linenumber, l_suppkey, l_returnflag) AS pos FROM @lineitem),
       f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS rn FROM i)
       SELECT id, type, name, location FROM #datasets
       UNION ALL SELECT id, type, name, NULL FROM f WHERE rn = 1 AND id NOT IN (SELECT id FROM #datasets)""",
)
def registry_merge(spark, sf):
    pos = F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), "l_linenumber", "l_suppkey", "l_returnflag")
    incoming = table(spark, sf, "lineitem").select(
        F.concat(F.lit("d"), F.col("l_partkey") * 10).alias("id"),
        F.col("l_returnflag").alias("type"),
        F.concat(F.lit("import "), F.col("l_orderkey")).alias("name"),
        pos.alias("pos"),
    )
    current = registry.as_table(given(spark, sf, "datasets"), "datasets")
    return registry.merge_snapshot("datasets", current, incoming, "pos").select("id", "type", "name", "location")


_JOBS = """SELECT concat('j', o_orderkey) AS id, CASE WHEN o_orderstatus <> 'P' THEN concat('s', o_custkey) END AS cml_job_id, o_orderpriority AS name FROM @orders"""
_SCHEDULER = "SELECT concat('s', c_custkey) AS public_identifier, c_mktsegment AS status, c_name AS name FROM @customer"


@query(
    "job_board",
    f"""SELECT j.id, j.name, s.name AS name_cml, s.status, e.exp_id FROM ({_JOBS}) j LEFT JOIN ({_SCHEDULER}) s ON s.public_identifier = j.cml_job_id
        LEFT JOIN (SELECT concat('j', p_partkey * 3) AS exp_name, concat('x', p_partkey) AS exp_id FROM @part) e ON e.exp_name = j.id""",
)
def job_board(spark, sf):
    experiments = table(spark, sf, "part").select(
        F.concat(F.lit("j"), F.col("p_partkey") * 3).alias("exp_name"), F.concat(F.lit("x"), F.col("p_partkey")).alias("exp_id")
    )
    board = boards.job_board(_jobs(spark, sf), _scheduler(spark, sf), experiments)
    return board.select("id", "name", "name_cml", "status", "exp_id")


def _jobs(spark, sf):
    cml = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("s"), F.col("o_custkey")))
    return table(spark, sf, "orders").select(
        F.concat(F.lit("j"), F.col("o_orderkey")).alias("id"), cml.alias("cml_job_id"), F.col("o_orderpriority").alias("name")
    )


def _scheduler(spark, sf):
    return table(spark, sf, "customer").select(
        F.concat(F.lit("s"), F.col("c_custkey")).alias("public_identifier"),
        F.col("c_mktsegment").alias("status"),
        F.col("c_name").alias("name"),
    )


@query(
    "eval_board",
    """SELECT e.id, e.parent_job_id, o.o_orderstatus AS status, x.exp_id FROM #evaluation_jobs e
       JOIN @orders o ON concat('s', o.o_orderkey) = e.cml_job_id
       LEFT JOIN (SELECT concat('u', s_suppkey) AS parent_job_id, s_name AS exp_id FROM @supplier) x ON x.parent_job_id = e.parent_job_id""",
)
def eval_board(spark, sf):
    scheduler = table(spark, sf, "orders").select(
        F.concat(F.lit("s"), F.col("o_orderkey")).alias("public_identifier"), F.col("o_orderstatus").alias("status")
    )
    experiments = table(spark, sf, "supplier").select(
        F.concat(F.lit("u"), F.col("s_suppkey")).alias("parent_job_id"), F.col("s_name").alias("exp_id")
    )
    jobs = given(spark, sf, "evaluation_jobs").select("id", "cml_job_id", "parent_job_id")
    return boards.eval_board(jobs, scheduler, experiments).select("id", "parent_job_id", "status", "exp_id")


@query(
    "dimension_lookup",
    """SELECT o_orderkey, c_name AS customer_name, coalesce(n_name, 'Unknown') AS nation_name FROM @orders
       LEFT JOIN @customer ON c_custkey = o_custkey + 1 LEFT JOIN @nation ON n_nationkey = o_custkey % 30""",
)
def dimension_lookup(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_custkey") + 1).alias("customer"), (F.col("o_custkey") % 30).alias("nation")
    )
    named = boards.lookup(orders, table(spark, sf, "customer"), "customer", "c_custkey", "c_name", "customer_name", None)
    named = boards.lookup(named, table(spark, sf, "nation"), "nation", "n_nationkey", "n_name", "nation_name", "Unknown")
    return named.select("o_orderkey", "customer_name", "nation_name")


@query(
    "job_summary",
    """SELECT o_orderkey AS id, c_name AS name, CASE o_orderstatus WHEN 'F' THEN '🔴 Failed' WHEN 'O' THEN '🔵 Running' ELSE '⚪ Unknown' END AS label
       FROM @orders JOIN @customer ON c_custkey = o_custkey""",
)
def job_summary(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "running")
    jobs = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.struct(status.alias("status")).alias("latest"))
    both = jobs.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    label = status_label(nested_or(F.col("latest.status")))
    return both.select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("name"), label.alias("label"))


@query(
    "children_list",
    """SELECT c_custkey, coalesce('order ' || o_orderkey, ' -- No Adapters available for this base model -- ') AS child
       FROM @customer LEFT JOIN @orders ON o_custkey = c_custkey AND o_totalprice > 300000""",
)
def children_list(spark, sf):
    children = table(spark, sf, "orders").filter(F.col("o_totalprice") > 300000)
    children = children.select("o_custkey", F.concat(F.lit("order "), F.col("o_orderkey")).alias("child"))
    return boards.children_list(table(spark, sf, "customer"), children, "c_custkey", "o_custkey", "child")


@query(
    "lookup_default",
    """SELECT event_id, coalesce('help for ' || p.p_type, format('Unknown customer help category [{}].', concat(' ', event_type, event_id % 60, ' '))) AS help
       FROM @events LEFT JOIN (SELECT concat('click', p_size) AS k, min(p_type) AS p_type FROM @part GROUP BY 1) p ON p.k = concat(event_type, event_id % 60)""",
)
def lookup_default(spark, sf):
    texts = table(spark, sf, "part").groupBy(F.concat(F.lit("click"), F.col("p_size")).alias("key")).agg(F.min("p_type").alias("t"))
    texts = texts.select("key", F.concat(F.lit("help for "), F.col("t")).alias("text"))
    category = F.concat(F.lit(" "), F.col("event_type"), F.col("event_id") % 60, F.lit(" "))
    events = table(spark, sf, "events").select("event_id", category.alias("category"))
    return boards.lookup_trimmed(events, texts, "category", "help").select("event_id", "help")


@query(
    "sort_recent",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS created_at FROM @events ORDER BY ts DESC, event_id""",
)
def sort_recent(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    events = table(spark, sf, "events").select("event_id", text.alias("created_at"))
    recent = boards.sort_recent(events, "created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "event_id")
    return recent.select("event_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"))


@query(
    "training_progress",
    """WITH l AS (SELECT run, arg_max(value, (ts, seq)) AS value FROM (SELECT * FROM #series WHERE ts IS NOT NULL AND value IS NOT NULL) WHERE key = 'epoch' GROUP BY run)
       SELECT run, CAST(ceil(value / (run % 7 + 20) * 100) AS BIGINT) AS progress FROM l""",
)
def training_progress(spark, sf):
    whole = given(spark, sf, "series").filter("ts is not null and value is not null")
    runs = table(spark, sf, "events").select(F.col("user_id").alias("run")).distinct()
    runs = runs.withColumn("num_epochs", F.col("run") % 7 + 20)
    return boards.training_progress(whole, runs)


@query(
    "metric_curves",
    """SELECT run, key, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, value FROM #series WHERE key IN ('loss', 'eval_loss') AND ts IS NOT NULL AND value IS NOT NULL""",
)
def metric_curves(spark, sf):
    curves = boards.metric_curves(given(spark, sf, "series"), ["loss", "eval_loss"])
    return curves.select("run", "key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "value")


@query(
    "latest_per_group",
    """WITH b AS (SELECT o_custkey AS model_id, arg_max(o_orderkey, (o_orderdate, -o_orderkey)) AS build_id FROM @orders GROUP BY 1),
       d AS (SELECT l_orderkey AS build_id, l_partkey AS deployment_id, max(l_returnflag) AS flag, max(l_shipdate) AS shipped FROM @lineitem GROUP BY 1, 2),
       l AS (SELECT build_id, arg_max(deployment_id, (shipped, -deployment_id)) AS deployment_id, arg_max(flag, (shipped, -deployment_id)) AS flag FROM d GROUP BY 1)
       SELECT c_custkey AS model_id, b.build_id, l.deployment_id, coalesce(l.flag = 'R', FALSE) AS is_deployed
       FROM @customer LEFT JOIN b ON b.model_id = c_custkey LEFT JOIN l ON l.build_id = b.build_id""",
)
def latest_per_group(spark, sf):
    models = table(spark, sf, "customer").select(F.col("c_custkey").alias("model_id"))
    builds = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("model_id"), F.col("o_orderkey").alias("build_id"), F.col("o_orderdate").alias("updated_at")
    )
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("build_id"), F.col("l_partkey").alias("deployment_id"))
    deployments = lines.agg(F.max("l_shipdate").alias("updated_at"), F.max("l_returnflag").alias("flag")).withColumn(
        "status", F.when(F.col("flag") == "R", "deployed").otherwise("stopped")
    )
    return boards.latest_deployment(models, builds, deployments)


@query("jobs_by_parent", "SELECT parent_job_id, COUNT(*) AS n_jobs FROM #evaluation_jobs GROUP BY parent_job_id")
def jobs_by_parent(spark, sf):
    return boards.jobs_by_parent(given(spark, sf, "evaluation_jobs"), "parent_job_id")


@query(
    "utilization",
    """WITH w AS (SELECT o_orderkey, CAST(o_orderkey % 16 AS DOUBLE) AS cpu, CAST(o_orderkey % 3 * 8 AS DOUBLE) AS cpu_max,
                         CAST(o_custkey AS DOUBLE) / 4 AS mem, CAST(o_custkey AS DOUBLE) AS mem_max FROM @orders),
       l AS (SELECT o_orderkey, 'CPU' AS resource_name, cpu AS used, cpu_max AS most, 'vCPU' AS unit FROM w
             UNION ALL SELECT o_orderkey, 'MEMORY', mem, mem_max, 'GiB' FROM w UNION ALL SELECT o_orderkey, 'NVIDIAGPU', 0, 0, 'GPU' FROM w)
       SELECT o_orderkey, resource_name, CASE WHEN most <> 0 THEN round(used / most * 100, 9) ELSE 0 END AS progress,
              format('{:.2f} {}', used, unit) AS used, format('{:.2f} {}', most - used, unit) AS max_available FROM l""",
)
def utilization(spark, sf):
    wide = table(spark, sf, "orders").select(
        "o_orderkey",
        (F.col("o_orderkey") % 16).alias("cpu"),
        (F.col("o_orderkey") % 3 * 8).alias("cpuAllocatable"),
        (F.col("o_custkey") / 4).alias("memory"),
        F.col("o_custkey").alias("memoryAllocatable"),
        F.lit(None).cast("double").alias("nvidiaGPU"),
        F.lit(0).alias("nvidiaGPUAllocatable"),
    )
    return boards.utilization(wide, ["o_orderkey"]).withColumn("progress", F.round("progress", 9))


_CANON = """CASE WHEN json_valid(config) THEN concat(json_extract_string(config, '$.lr')::DOUBLE, '/', json_extract_string(config, '$.b.k')::DOUBLE)
                 ELSE concat('raw', config) END"""


@query(
    "config_dedup",
    f"""WITH k AS (SELECT *, {_CANON} AS canon FROM #configs)
        SELECT id, min(id) OVER (PARTITION BY type, model_family, canon) AS canonical_id FROM k""",
)
def config_dedup(spark, sf):
    configs = given(spark, sf, "configs")
    return quality.config_dedup(configs, "config", "type", "model_family").select("id", "canonical_id")


@query(
    "config_reuse",
    f"""WITH k AS (SELECT *, {_CANON} AS canon, @b(stored;id) % 3 > 0 AS stored FROM #configs),
        have AS (SELECT type, model_family, canon, min(id) AS have FROM k WHERE stored GROUP BY ALL),
        own AS (SELECT type, model_family, canon, min(id) AS own FROM k WHERE NOT stored GROUP BY ALL)
        SELECT k.id, coalesce(have, own) AS config_id, have IS NULL AS is_new FROM k
        JOIN own ON k.type IS NOT DISTINCT FROM own.type AND k.model_family IS NOT DISTINCT FROM own.model_family AND k.canon = own.canon
        LEFT JOIN have ON k.type IS NOT DISTINCT FROM have.type AND k.model_family IS NOT DISTINCT FROM have.model_family AND k.canon = have.canon
        WHERE NOT stored""",
)
def config_reuse(spark, sf):
    """A third of the configurations arrives at a table of the others."""
    configs = given(spark, sf, "configs")
    stored = F.pmod(bucket("stored", "id"), F.lit(3)) > 0
    found = quality.add_configs(configs.filter(~stored), configs.filter(stored), "config", "type", "model_family")
    return found.select("id", "config_id", "is_new")


@query(
    "duplicate_configs",
    f"""SELECT type, model_family, min(id) AS canonical_id, COUNT(*) AS n_configs FROM (SELECT *, {_CANON} AS canon FROM #configs)
        GROUP BY type, model_family, canon HAVING COUNT(*) > 1""",
)
def duplicate_configs(spark, sf):
    return quality.duplicate_configs(given(spark, sf, "configs"), "config", "type", "model_family")


def _import_sql(name):
    columns = in_schema_order(name)
    text = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '<null>')" for c in columns)
    return f"SELECT '{name}' AS \"table\", id, md5(concat_ws('|', {text})) AS content FROM #{name}"


@query("registry_import", " UNION ALL ".join(_import_sql(name) for name in TABLES))
def registry_import(spark, sf):
    """A snapshot of all tables, written and merged into tables that have half of its rows."""
    path, tables = fresh_path(spark, "snapshot"), registry_tables(spark, sf)
    registry.export_snapshot(tables, path)
    current = {name: df.filter(F.pmod(bucket("half", "id"), F.lit(2)) == 0) for name, df in tables.items()}
    found = None
    for name, df in registry.import_snapshot(spark, path, current).items():
        text = [F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in in_schema_order(name)]
        part = df.select(F.lit(name).alias("table"), "id", F.md5(F.concat_ws("|", *text)).alias("content"))
        found = part if found is None else found.unionByName(part)
    return found


@query(
    "duplicate_names",
    "SELECT trim(name) AS name, COUNT(*) AS n_rows FROM #datasets GROUP BY 1 HAVING COUNT(*) > 1",
)
def duplicate_names(spark, sf):
    return quality.duplicate_names(given(spark, sf, "datasets"), "name")


@query(
    "names_taken",
    "SELECT id, name FROM #adapters WHERE name IN (SELECT adapter_name FROM #fine_tuning_jobs)",
)
def names_taken(spark, sf):
    current = given(spark, sf, "fine_tuning_jobs").withColumnRenamed("adapter_name", "name")
    return quality.names_taken(given(spark, sf, "adapters"), current, "name").select("id", "name")


_PRESENT = {name: f"(SELECT id FROM #{name})" for name in TABLES}
_EDGES = [edge for edge in registry.EDGES if edge[1] in FILLED[edge[0]].split()]


@query(
    "fk_audit",
    " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", id, '{fk}' AS fk, {fk} AS value FROM #{t} WHERE {fk} IS NOT NULL AND {fk} NOT IN {_PRESENT[parent]}"
        for t, fk, parent in _EDGES
    ),
)
def fk_audit(spark, sf):
    tables = {name: given(spark, sf, name) for name in TABLES}
    return quality.fk_audit(tables, [quality.Edge(*edge) for edge in _EDGES])


_PROMPT_FIELDS = ("id", "name", "dataset_id", "prompt_template", "input_template", "completion_template")


@query(
    "required_fields",
    " UNION ALL ".join(
        f"SELECT id, '{c} is required' AS rule FROM #prompts WHERE trim(coalesce({c}, '')) = ''" for c in _PROMPT_FIELDS
    ),
)
def required_fields(spark, sf):
    return quality.violations(given(spark, sf, "prompts"), quality.required(*_PROMPT_FIELDS), ["id"])


_JOB_RULES = {
    "framework_type is unknown": "framework_type NOT IN ('legacy', 'axolotl')",
    "adapter_name may hold letters, digits and hyphens only": "NOT regexp_matches(replace(adapter_name, '-', ''), '^[A-Za-z0-9]+$')",
    "num_cpu must be greater than 0": "num_cpu <= 0",
    "num_gpu must be 0 or greater": "num_gpu < 0",
    "num_memory must be greater than 0": "num_memory <= 0",
    "num_workers must be greater than 0": "num_workers <= 0",
    "num_epochs must be greater than 0": "num_epochs <= 0",
    "learning_rate must be greater than 0": "learning_rate <= 0",
    "dataset_fraction must be between 0 and 1": "dataset_fraction <= 0 OR dataset_fraction > 1",
    "train_test_split must be between 0 and 1": "train_test_split <= 0 OR train_test_split > 1",
    "axolotl_config_id is required": "framework_type = 'axolotl' AND axolotl_config_id IS NULL",
}


@query(
    "rule_violations",
    " UNION ALL ".join(f"SELECT id, '{rule}' AS rule FROM #fine_tuning_jobs WHERE {sql}" for rule, sql in _JOB_RULES.items()),
)
def rule_violations(spark, sf):
    return quality.violations(given(spark, sf, "fine_tuning_jobs"), quality.job_rules(), ["id"])


@query(
    "suffix_violations",
    " UNION ALL ".join(
        f"SELECT id, 'location must end with {end}' AS rule FROM #datasets WHERE type = '{kind}' AND NOT suffix(location, '{end}')"
        for kind, end in quality.SUFFIXES.items()
    ),
)
def suffix_violations(spark, sf):
    return quality.violations(given(spark, sf, "datasets"), quality.suffix_rules("type", "location"), ["id"])


@query(
    "cascade_delete",
    """WITH gone AS (SELECT DISTINCT concat('d', l_orderkey) AS id FROM @lineitem WHERE l_returnflag = 'R')
       SELECT 'datasets' AS "table", id FROM #datasets WHERE id NOT IN (SELECT id FROM gone)
       UNION ALL SELECT 'prompts', id FROM #prompts WHERE dataset_id NOT IN (SELECT id FROM gone)""",
)
def cascade_delete(spark, sf):
    gone = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R")
    gone = gone.select(F.concat(F.lit("d"), F.col("l_orderkey")).alias("id"))
    datasets, prompts = boards.cascade_delete(
        given(spark, sf, "datasets"), given(spark, sf, "prompts"), gone, "id", "dataset_id", cascade=True
    )
    return datasets.select(F.lit("datasets").alias("table"), "id").unionByName(
        prompts.select(F.lit("prompts").alias("table"), "id")
    )


@query(
    "resolve_ids",
    """WITH c AS (SELECT o_custkey, COUNT(*) AS n FROM @orders GROUP BY 1)
       SELECT c_custkey AS id, CASE WHEN n = 1 THEN 'ok' WHEN n IS NULL THEN 'missing' ELSE 'ambiguous' END AS status
       FROM @customer LEFT JOIN c ON o_custkey = c_custkey""",
)
def resolve_ids(spark, sf):
    requests = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return boards.resolve_ids(requests, table(spark, sf, "orders"), "o_custkey")


@query(
    "repeated_pairs",
    """SELECT parent_job_id, base_model_id, adapter_id, COUNT(*) AS n_rows FROM (
         SELECT parent_job_id, concat('m', event_id % 30) AS base_model_id, CASE WHEN value > 10 THEN concat('a', event_id % 3) END AS adapter_id
         FROM (SELECT concat('u', user_id) AS parent_job_id, event_id, value FROM @events)) GROUP BY ALL HAVING COUNT(*) > 1""",
)
def repeated_pairs(spark, sf):
    events = table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("parent_job_id"),
        F.concat(F.lit("m"), F.col("event_id") % 30).alias("base_model_id"),
        F.when(F.col("value") > 10, F.concat(F.lit("a"), F.col("event_id") % 3)).alias("adapter_id"),
    )
    return quality.repeated_pairs(events, "parent_job_id", "base_model_id", "adapter_id")


@query("missing_models", "SELECT event_id FROM @events WHERE value > 20 AND event_type = 'error'")
def missing_models(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") != "error", "m").alias("model"),
        F.when(F.col("value") <= 20, "a").alias("adapter"),
    )
    return quality.missing_models(events, "model", "adapter").select("event_id")
