"""Joins and aggregates behind the job and evaluation boards.

No side is broadcast by hint: Spark broadcasts a side when its size is known to be below
``spark.sql.autoBroadcastJoinThreshold``, and splits hot keys of larger joins at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts shown where something is absent.
NO_CHILDREN = " -- No Adapters available for this base model -- "
NO_HELP = "Unknown customer help category [%s]."

# Resource, column with its maximum, unit.
RESOURCES = (
    ("cpu", "cpuAllocatable", "vCPU"),
    ("memory", "memoryAllocatable", "GiB"),
    ("nvidiaGPU", "nvidiaGPUAllocatable", "GPU"),
)


def suffixed(df: DataFrame, taken: Sequence[str], suffix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rename the columns that the other side of a join already has."""
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c in taken and c not in keep})


def job_board(jobs: DataFrame, scheduler: DataFrame, experiments: DataFrame, suffix: str = "_cml") -> DataFrame:
    """Every job, with its scheduler entry and its experiment where there is one."""
    right = suffixed(scheduler, jobs.columns, suffix)
    both = jobs.join(right, jobs["cml_job_id"] == right["public_identifier"], "left")
    exp = suffixed(experiments, both.columns, suffix)
    return both.join(exp, both["id"] == exp["exp_name"], "left")


def eval_board(jobs: DataFrame, scheduler: DataFrame, experiments: DataFrame, suffix: str = "_cml") -> DataFrame:
    """Evaluation jobs that the scheduler knows, with the experiment of their parent."""
    right = suffixed(scheduler, jobs.columns, suffix)
    both = jobs.join(right, jobs["cml_job_id"] == right["public_identifier"])
    exp = suffixed(experiments, both.columns, suffix, keep=["parent_job_id"])
    return both.join(exp, "parent_job_id", "left")


def lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str, value: str, name: str, default: str | None) -> DataFrame:
    """Add ``name``: the dimension's value for the key, or the default."""
    side = dim.select(F.col(dim_key).alias("__key"), F.col(value).alias("__value"))
    found = df.join(side, df[key] == F.col("__key"), "left")
    text = F.col("__value") if default is None else F.coalesce(F.col("__value"), F.lit(default))
    return found.withColumn(name, text).drop("__key", "__value")


def lookup_trimmed(df: DataFrame, texts: DataFrame, key: str, name: str) -> DataFrame:
    """Text for a trimmed key, or a sentence that names the unknown key."""
    side = texts.select(F.col("key").alias("__key"), F.col("text").alias("__text"))
    trimmed = F.regexp_replace(F.col(key), r"^\s+|\s+\z", "")
    found = df.withColumn("__trim", trimmed).join(side, F.col("__trim") == F.col("__key"), "left")
    missing = F.format_string(NO_HELP, F.col(key))
    return found.withColumn(name, F.coalesce("__text", missing)).drop("__key", "__text", "__trim")


def children_list(
    parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, child: str, placeholder: str = NO_CHILDREN
) -> DataFrame:
    """One row per parent and child, and one placeholder row per parent without children.

    The list stays in rows, since one parent may have any number of children. The inner join can
    split a hot parent; the placeholder needs only the distinct keys of the children.
    """
    names = children.select(F.col(child_key).alias("__parent"), F.col(child).alias("child"))
    found = parents.join(names, parents[parent_key] == F.col("__parent")).select(parents[parent_key], "child")
    used = names.select("__parent").distinct()
    empty = parents.join(used, parents[parent_key] == F.col("__parent"), "left_anti")
    return found.unionByName(empty.select(parent_key, F.lit(placeholder).alias("child")))


def sort_recent(df: DataFrame, created: str, pattern: str, *ties: str) -> DataFrame:
    """Parse the time text and put the newest rows first; ties in the order of further columns."""
    parsed = df.withColumn(created, F.try_to_timestamp(F.col(created), F.lit(pattern)))
    return parsed.orderBy(F.col(created).desc(), *ties)


def latest_value(series: DataFrame, keys: Sequence[str], value: str, ts: str, tie: str) -> DataFrame:
    """The value with the greatest time per key, as a partial aggregate."""
    return series.groupBy(*keys).agg(F.max_by(value, F.struct(ts, tie)).alias(value))


def training_progress(series: DataFrame, runs: DataFrame, key: str = "epoch") -> DataFrame:
    """Percentage of the epochs done, rounded up, per run that has reported any."""
    last = latest_value(series.filter(F.col("key") == key), ["run"], "value", "ts", "seq")
    done = F.ceil(F.col("value") / F.col("num_epochs") * 100).cast("bigint")
    return last.join(runs, "run").select("run", done.alias("progress"))


def metric_curves(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The points of each wanted curve, those without time or value left out.

    A curve stays in rows: one run may hold any number of points. Consumers sort what they draw.
    """
    whole = F.col("ts").isNotNull() & F.col("value").isNotNull()
    return series.filter(F.col("key").isin(*keys) & whole).select("run", "key", "ts", "value")


def latest_per_parent(df: DataFrame, parent: str, at: str, key: str, *carry: str) -> DataFrame:
    """Per parent the row with the greatest time; of equal times the lowest key."""
    # Keys may be text, so the time is turned round; rows without a time come last.
    late = F.coalesce(-F.unix_micros(F.col(at).cast("timestamp")), F.lit(2**63 - 1))
    rank = F.struct(late.alias("t"), F.col(key).alias("k"))
    return df.groupBy(parent).agg(F.min_by(F.struct(key, at, *carry), rank).alias("last")).select(parent, "last.*")


def latest_deployment(models: DataFrame, builds: DataFrame, deployments: DataFrame) -> DataFrame:
    """Per model: its latest build, that build's latest deployment, and whether that is deployed."""
    build = latest_per_parent(builds, "model_id", "updated_at", "build_id").select("model_id", "build_id")
    deployed = deployments.join(build.select("build_id"), "build_id", "left_semi")
    last = latest_per_parent(deployed, "build_id", "updated_at", "deployment_id", "status")
    status = last.select("build_id", "deployment_id", "status")
    joined = models.join(build, "model_id", "left").join(status, "build_id", "left")
    live = F.coalesce(F.col("status") == "deployed", F.lit(False))
    return joined.select("model_id", "build_id", "deployment_id", live.alias("is_deployed"))


def jobs_by_parent(jobs: DataFrame, parent: str) -> DataFrame:
    """Parents and how many jobs they have."""
    return jobs.groupBy(parent).agg(F.count("*").alias("n_jobs"))


def utilization(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row per resource: share in use, used and free amounts as text."""
    rows = F.array(
        *[
            F.struct(
                F.lit(used.upper()).alias("resource_name"),
                F.coalesce(F.col(used).cast("double"), F.lit(0.0)).alias("used"),
                F.coalesce(F.col(most).cast("double"), F.lit(0.0)).alias("most"),
                F.lit(unit).alias("unit"),
            )
            for used, most, unit in RESOURCES
        ]
    )
    long = df.select(*ids, F.explode(rows).alias("r")).select(*ids, "r.*")
    used, most = F.col("used"), F.col("most")
    return long.select(
        *ids,
        "resource_name",
        F.when(most != 0, used / most * 100).otherwise(F.lit(0.0)).alias("progress"),
        F.format_string("%.2f %s", used, F.col("unit")).alias("used"),
        F.format_string("%.2f %s", most - used, F.col("unit")).alias("max_available"),
    )


def cascade_delete(
    parents: DataFrame, children: DataFrame, gone: DataFrame, parent_key: str, child_key: str, cascade: bool
) -> tuple[DataFrame, DataFrame]:
    """Both tables without the rows whose id is in ``gone``; children go only on cascade."""
    ids = gone.select(F.col(gone.columns[0]).alias("__gone")).distinct()
    kept: list[DataFrame] = []
    for table, key in ((parents, parent_key), (children, child_key)):
        if table is children and not cascade:
            kept.append(table)
            continue
        kept.append(table.join(ids, table[key] == F.col("__gone"), "left_anti"))
    return kept[0], kept[1]


def resolve_ids(requests: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """For every requested id whether the registry has it once, never or several times."""
    counts = registry.groupBy(F.col(key).alias("__id")).agg(F.count("*").alias("n"))
    n: Column = F.coalesce(F.col("n"), F.lit(0))
    status = F.when(n == 1, "ok").when(n == 0, "missing").otherwise("ambiguous")
    return requests.join(counts, requests[requests.columns[0]] == F.col("__id"), "left").select(
        *requests.columns, status.alias("status")
    )
