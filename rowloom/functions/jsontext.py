"""JSON held as text: lenient reading, canonical form, option lookup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_variant(text: Column, default: str) -> Column:
    """Parse; else parse with single quotes as double quotes; else the default document."""
    text = F.when(text != "", text)
    requoted = F.replace(text, F.lit("'"), F.lit('"'))
    return F.coalesce(
        F.try_parse_json(text), F.try_parse_json(requoted), F.parse_json(F.lit(default))
    )


def canonical_json(text: Column) -> Column:
    """One text for all spellings of a document: keys sorted, blanks gone, 1.0 written as 1."""
    return F.try_parse_json(text).cast("string")


def option(args: Column, config: Column, name: str, default: object, kind: str) -> Column:
    """The value in the arguments, else in the configuration, else the default."""
    path = f"$.{name}"
    return F.coalesce(
        F.try_variant_get(args, path, kind), F.try_variant_get(config, path, kind), F.lit(default).cast(kind)
    )
