"""Checks over whole registry tables: rules, uniqueness, references, duplicates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.jsontext import canonical_json

# Frameworks a job may name, and the file ending of each local dataset kind.
FRAMEWORKS = ("legacy", "axolotl")
SUFFIXES = {"project_csv": ".csv", "project_json": ".json", "project_jsonl": ".jsonl"}


@dataclass(frozen=True)
class Rule:
    """A name and a condition that holds for a row that breaks the rule."""

    name: str
    broken: Column


def blank(column: str) -> Column:
    return F.coalesce(F.regexp_replace(F.col(column).cast("string"), r"^\s+|\s+\z", ""), F.lit("")) == ""


def required(*columns: str) -> list[Rule]:
    return [Rule(f"{c} is required", blank(c)) for c in columns]


def positive(*columns: str) -> list[Rule]:
    return [Rule(f"{c} must be greater than 0", ~F.coalesce(F.col(c) > 0, F.lit(False))) for c in columns]


def not_negative(*columns: str) -> list[Rule]:
    return [Rule(f"{c} must be 0 or greater", ~F.coalesce(F.col(c) >= 0, F.lit(False))) for c in columns]


def share(*columns: str) -> list[Rule]:
    """More than 0 and at most 1."""
    return [
        Rule(f"{c} must be between 0 and 1", ~F.coalesce((F.col(c) > 0) & (F.col(c) <= 1), F.lit(False)))
        for c in columns
    ]


def job_rules() -> list[Rule]:
    """What a training job has to meet."""
    name, framework = F.col("adapter_name"), F.col("framework_type")
    return [
        Rule("framework_type is unknown", ~F.coalesce(framework.isin(*FRAMEWORKS), F.lit(False))),
        Rule(
            "adapter_name may hold letters, digits and hyphens only",
            F.coalesce(name != "", F.lit(False)) & ~name.rlike(r"\A-*[\p{L}\p{N}][\p{L}\p{N}-]*\z"),
        ),
        *positive("num_cpu"),
        *not_negative("num_gpu"),
        *positive("num_memory", "num_workers", "num_epochs", "learning_rate"),
        *share("dataset_fraction", "train_test_split"),
        Rule("axolotl_config_id is required", (framework == "axolotl") & blank("axolotl_config_id")),
    ]


def suffix_rules(kind: str, location: str) -> list[Rule]:
    """A local dataset has to be a file of its kind."""
    return [
        Rule(f"{location} must end with {end}", (F.col(kind) == k) & ~F.coalesce(F.endswith(F.col(location), F.lit(end)), F.lit(False)))
        for k, end in SUFFIXES.items()
    ]


def violations(df: DataFrame, rules: Sequence[Rule], ids: Sequence[str]) -> DataFrame:
    """One row per row and broken rule; all broken rules are told, in one pass."""
    told = F.array_compact(F.array(*[F.when(r.broken, F.lit(r.name)) for r in rules]))
    return df.select(*ids, F.explode(told).alias("rule"))


def stripped(text: Column) -> Column:
    """Without white space at both ends, by the same rule as ``blank``."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def duplicate_names(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(stripped(F.col(name)).alias("name")).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def names_taken(batch: DataFrame, current: DataFrame, name: str) -> DataFrame:
    """Rows of a batch whose trimmed name the table has already."""
    have = current.select(stripped(F.col(name)).alias("__name")).distinct()
    return batch.join(have, stripped(batch[name]) == F.col("__name"), "left_semi")


@dataclass(frozen=True)
class Edge:
    """A column of one table whose values are keys of another."""

    table: str
    fk: str
    target: str


def fk_audit(tables: Mapping[str, DataFrame], edges: Sequence[Edge], key: str = "id") -> DataFrame:
    """Every reference without a target, as (table, id, fk, value). An absent reference is fine.

    All references of a table are taken from one scan and shuffled once. Ids are unique, so a hot
    value is a hot left key of the anti join only, which adaptive execution splits.
    """
    if not edges:
        raise ValueError("no edges")
    refs = _union(
        tables[name].select(
            F.lit(name).alias("table"),
            F.col(key).cast("string").alias("id"),
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(e.fk).alias("fk"),
                            F.lit(e.target).alias("target"),
                            F.col(f"`{e.fk}`").cast("string").alias("value"),
                        )
                        for e in edges
                        if e.table == name
                    ]
                )
            ).alias("ref"),
        )
        for name in dict.fromkeys(e.table for e in edges)
    )
    refs = refs.select("table", "id", "ref.*").filter(F.col("value").isNotNull())
    have = _union(
        tables[name].select(F.lit(name).alias("target"), F.col(key).cast("string").alias("value"))
        for name in dict.fromkeys(e.target for e in edges)
    )
    return refs.join(have, ["target", "value"], "left_anti").select("table", "id", "fk", "value")


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def config_groups(configs: DataFrame, config: str, *same: str) -> DataFrame:
    """One row per group of equal configurations: the id to use and the size.

    Only hashes of the canonical text are shuffled, and equal ones collapse before the shuffle.
    """
    return _hashed(configs, config).groupBy(*same, "__h").agg(
        F.min("id").alias("canonical_id"), F.count("*").alias("n_configs")
    )


def config_dedup(configs: DataFrame, config: str, *same: str) -> DataFrame:
    """Add ``canonical_id``: the lowest id among configurations that are equal as JSON.

    A text that is no JSON is only equal to itself.
    """
    keys = [*same, "__h"]
    groups = config_groups(configs, config, *same).drop("n_configs").withColumnsRenamed({k: f"__g{k}" for k in keys})
    rows = _hashed(configs, config)
    on = [rows[k].eqNullSafe(groups[f"__g{k}"]) for k in keys]
    # A group that many rows share is a hot key on the left, which adaptive execution splits.
    return rows.join(groups, on, "left").drop("__h", *[f"__g{k}" for k in keys])


def duplicate_configs(configs: DataFrame, config: str, *same: str) -> DataFrame:
    """Groups of equal configurations that are stored more than once: the id to use and the size."""
    return config_groups(configs, config, *same).filter("n_configs > 1").drop("__h")


def add_configs(batch: DataFrame, current: DataFrame, config: str, *same: str) -> DataFrame:
    """The batch with ``config_id`` and ``is_new``: the lowest stored id of an equal configuration, else one of the batch.

    Configurations that are equal within the batch share its lowest id; the rows to insert are those
    that are new and carry their own id.
    """
    keys = [*same, "__h"]
    have = config_groups(current, config, *same).select(*keys, F.col("canonical_id").alias("__have"))
    own = config_groups(batch, config, *same).select(*keys, F.col("canonical_id").alias("__own"))
    known = own.withColumnsRenamed({k: f"__o{k}" for k in keys})
    known = known.join(have, [known[f"__o{k}"].eqNullSafe(have[k]) for k in keys], "left").drop(*keys)
    rows = _hashed(batch, config)
    found = rows.join(known, [rows[k].eqNullSafe(known[f"__o{k}"]) for k in keys], "left")
    return found.select(*batch.columns, F.coalesce("__have", "__own").alias("config_id"), F.col("__have").isNull().alias("is_new"))


def _hashed(configs: DataFrame, config: str) -> DataFrame:
    text = F.coalesce(canonical_json(F.col(config)), F.concat(F.lit("not json:"), F.col(config)))
    return configs.withColumn("__h", F.md5(text))


def repeated_pairs(df: DataFrame, parent: str, model: str, adapter: str) -> DataFrame:
    """(model, adapter) pairs that a request names more than once; no adapter is a value too."""
    return df.groupBy(parent, model, adapter).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def missing_models(df: DataFrame, model: str, adapter: str) -> DataFrame:
    return df.filter(F.col(model).isNull() & F.col(adapter).isNull())
