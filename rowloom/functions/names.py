"""Small text functions on names, labels and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Job status and the label shown for it.
STATUS_LABELS = {
    "succeeded": "🟢 Succeeded",
    "running": "🔵 Running",
    "scheduling": "🟡 Scheduling",
    "failed": "🔴 Failed",
    "Unknown": "⚪ Unknown",
}
OTHER_STATUS = "⚪ "


def capitalized(text: Column) -> Column:
    """First letter upper, all others lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2**31 - 1)))


def status_label(status: Column) -> Column:
    known = F.coalesce(status, F.lit("Unknown"))
    label = F.lit(None).cast("string")
    for value, text in STATUS_LABELS.items():
        label = F.when(known == value, text).otherwise(label)
    return F.coalesce(label, F.concat(F.lit(OTHER_STATUS), capitalized(known)))


def artifact_name(base: Column, adapter: Column) -> Column:
    """``base-adapter`` without slashes; its last 49 characters."""
    return F.right(F.replace(F.concat(base, F.lit("-"), adapter), F.lit("/"), F.lit("-")), F.lit(49))


def registered_name(artifact: Column) -> Column:
    return F.concat(F.lit("ft-model-"), F.right(artifact, F.lit(40)))


def last_word(text: Column) -> Column:
    return F.regexp_extract(text, r"(\S+)\s*\z", 1)


def last_path_part(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def run_name(model: Column, adapter: Column) -> Column:
    """``model`` or ``model + adapter``."""
    has = F.coalesce(adapter, F.lit("")) != ""
    return F.when(has, F.concat(model, F.lit(" + "), adapter)).otherwise(model)
