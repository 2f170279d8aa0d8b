"""Prompt templates as Catalyst expressions.

A template is read once on the driver and becomes one ``concat``; rows never meet Python.
"""

from __future__ import annotations

import re
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.pytext import pystr

# Field names and the marker that ends a training example.
TRAIN_FIELD = "prediction"
INPUT_FIELD = "model_input"
OUTPUT_FIELD = "expected_output"
DEFAULT_EOS = "</s>"

# Fixed value: what counts as a placeholder where a template is searched, not formatted.
PLACEHOLDER = r"\{(.*?)\}"

_STEP = re.compile(r"\.(\w+)|\[([^\]]+)\]")


class TemplateError(ValueError):
    """A template that the given columns cannot fill."""


def _resolve(field: str, schema: T.StructType) -> Column:
    head = re.match(r"[^.\[]*", field).group()
    if head not in schema.fieldNames():
        raise TemplateError(f"template names '{head}', columns are {schema.fieldNames()}")
    value, kind, pos = F.col(f"`{head}`"), schema[head].dataType, len(head)
    while pos < len(field):
        step = _STEP.match(field, pos)
        if not step:
            raise TemplateError(f"cannot read placeholder '{field}'")
        name, pos = step.group(1) or step.group(2), step.end()
        if isinstance(kind, T.StructType) and name in kind.fieldNames():
            value, kind = value.getField(name), kind[name].dataType
        elif isinstance(kind, T.ArrayType) and name.isdigit():
            value, kind = F.get(value, F.lit(int(name))), kind.elementType
        elif isinstance(kind, T.MapType):
            value, kind = value.getItem(name), kind.valueType
        else:
            raise TemplateError(f"'{name}' is not part of '{head}'")
    return pystr(value, kind)


def _joined(parts: list[Column | str]) -> Column:
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts if not (isinstance(p, str) and p == "")]
    if not columns:
        return F.lit("")
    return columns[0] if len(columns) == 1 else F.concat(*columns)


def compile_strict(template: str, schema: T.StructType, suffix: str = "") -> Column:
    """``template.format(**row)``; an unknown placeholder is an error before any row is read."""
    parts: list[Column | str] = []
    try:
        pieces = list(Formatter().parse(template))
    except ValueError as error:
        raise TemplateError(str(error)) from error
    for literal, field, spec, conversion in pieces:
        parts.append(literal)
        if field is None:
            continue
        if spec or conversion not in (None, "s"):
            raise TemplateError(f"format specs are not supported: '{field}'")
        parts.append(_resolve(field, schema))
    return _joined([*parts, suffix])


def compile_lenient(template: str, schema: T.StructType) -> Column:
    """Fill the placeholders that are columns and leave every other brace as it stands."""
    parts: list[Column | str] = []
    done = 0
    for hit in re.finditer(PLACEHOLDER, template):
        if hit.group(1) in schema.fieldNames():
            parts += [template[done : hit.start()], pystr(F.col(f"`{hit.group(1)}`"), schema[hit.group(1)].dataType)]
            done = hit.end()
    return _joined([*parts, template[done:]])


def render_train(
    df: DataFrame, template: str, field: str = TRAIN_FIELD, eos: str | None = DEFAULT_EOS
) -> DataFrame:
    """Training text per row, closed by the end marker unless ``eos`` is None."""
    return df.withColumn(field, compile_strict(template, df.schema, eos or ""))


def render_eval_pair(df: DataFrame, input_template: str, completion_template: str) -> DataFrame:
    """Model input and expected output per row, without an end marker."""
    return df.withColumns(
        {
            INPUT_FIELD: compile_strict(input_template, df.schema),
            OUTPUT_FIELD: compile_strict(completion_template, df.schema),
        }
    )


def render_lenient(df: DataFrame, template: str, field: str) -> DataFrame:
    return df.withColumn(field, compile_lenient(template, df.schema))


def render_lenient_by_row(df: DataFrame, template: str, columns: list[str], field: str) -> DataFrame:
    """Lenient rendering where each row brings its own template in the column ``template``.

    The text between placeholders and the placeholders alternate, so one pass fills them all and
    text put in by one placeholder is never searched for another.
    """
    values = F.create_map(
        *[c for name in columns for c in (F.lit(name), pystr(F.col(f"`{name}`"), df.schema[name].dataType))]
    )
    between = F.split(F.col(template), PLACEHOLDER, -1)
    names = F.regexp_extract_all(F.col(template), F.lit(PLACEHOLDER), 1)
    work = df.withColumns({"__values": values, "__between": between, "__names": names})
    filled = F.transform(
        F.col("__names"),
        lambda name, i: F.concat(
            F.get(F.col("__between"), i),
            F.coalesce(F.try_element_at(F.col("__values"), name), F.concat(F.lit("{"), name, F.lit("}"))),
        ),
    )
    text = F.concat(F.array_join(filled, ""), F.element_at(F.col("__between"), -1))
    return work.withColumn(field, text).drop("__values", "__between", "__names")


def placeholders(template: Column) -> Column:
    return F.regexp_extract_all(template, F.lit(PLACEHOLDER), 1)


def first_placeholder(template: Column) -> Column:
    return F.try_element_at(placeholders(template), F.lit(1))


def last_placeholder(template: Column) -> Column:
    return F.try_element_at(placeholders(template), F.lit(-1))


def compose_training_template(prompt: Column, completion: Column) -> Column:
    """The prompt without trailing newlines followed by the completion without outer blanks."""
    return F.concat(F.regexp_replace(prompt, r"\n+\z", ""), F.regexp_replace(completion, r"^\s+|\s+\z", ""))
