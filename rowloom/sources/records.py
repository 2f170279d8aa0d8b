"""Records of text files that may break lines anywhere, cut by many tasks per file.

A file is read in byte ranges, and every range in pieces: up to the next line break for CSV, up to the next ``}`` for JSON.
Where a range begins, inside quotes or not and how deep, is not known to its task. So each range first
tells, for both beginnings, how it would end; these are chained per file; and then each range cuts its
records. Records that lie in several ranges are put together from their parts. No cell ever holds more than a record.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import groupby
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.session import fresh_path, written

BLANK = " \t\r\n"
BEFORE_RECORD = BLANK + ",[\ufeff"
# The key before the rows of a table, up to the first of them.
DATA = r'(?<!\\)"data"\s*:\s*\[\s*'
# Line breaks inside a CSV field, while records are lines of a working file.
MARK = "\x01"
BREAKS = (("\n", "n"), ("\r", "r"))


class CsvScan:
    """Quoted fields begin at a field's start and end at a quote that is not doubled (RFC 4180)."""

    separator = "\n"

    def __init__(self, delimiter: str = ",") -> None:
        self.delimiter = delimiter

    def begins(self, first: str) -> int:
        return 0

    def step(self, line: str, inside: bool) -> tuple[bool, int]:
        """Whether the line ends inside quotes, and by how many levels it goes down."""
        if '"' not in line:
            return inside, 0
        at = 0
        while True:
            if inside:
                quote = line.find('"', at)
                if quote < 0:
                    return True, 0
                at = quote + 1
                if line.startswith('"', at):
                    at += 1
                    continue
                inside = False
            elif line.startswith('"', at) and at == 0:
                inside, at = True, 1
                continue
            # The next field that begins with a quote.
            quote = line.find(f'{self.delimiter}"', at)
            if quote < 0:
                return False, 0
            inside, at = True, quote + 1 + len(self.delimiter)

    def record(self, pieces: list[str]) -> str | None:
        """The record's text; None for an empty line."""
        return self.separator.join(pieces).removesuffix("\r") or None

    def rest(self, pieces: list[str]) -> None:
        """What follows the last record."""


class JsonScan:
    """Elements of an array of objects, or one object."""

    separator = "}"

    def begins(self, first: str) -> int:
        """Records end at depth 1 in a file that is an array."""
        return int(first.lstrip(BLANK + "\ufeff").startswith("["))

    def step(self, piece: str, inside: bool) -> tuple[bool, int]:
        if "\\" in piece:
            piece = piece.replace("\\\\", "").replace('\\"', "")
        parts = piece.split('"')
        outside = "".join(parts[inside::2])
        depth = outside.count("{") + outside.count("[") - outside.count("]")
        inside = inside != (len(parts) % 2 == 0)
        # The piece was cut at a closing brace.
        return inside, depth - (not inside)

    def record(self, pieces: list[str]) -> str:
        text = self.separator.join(pieces).lstrip(BEFORE_RECORD) + self.separator
        if not text.startswith("{"):
            raise ValueError(f"not an array of objects: {text[:80]!r}")
        return text.replace("\r", " ").replace("\n", " ")

    def rest(self, pieces: list[str]) -> None:
        text = self.separator.join(pieces).strip(BEFORE_RECORD + "]")
        if text:
            raise ValueError(f"not an array of objects: {text[:80]!r}")


class TableScan:
    """The rows of ``{"columns": [...], "data": [[...], ...]}``; the first one comes with all that stands before it.

    ``data`` is the last key and what stands before it lies in the first range; a file that is not like that is refused.
    """

    separator = "]"

    def begins(self, first: str) -> int:
        """Rows end at depth 2: in the list of the object."""
        return 2

    def step(self, piece: str, inside: bool) -> tuple[bool, int]:
        if "\\" in piece:
            piece = piece.replace("\\\\", "").replace('\\"', "")
        parts = piece.split('"')
        outside = "".join(parts[inside::2])
        inside = inside != (len(parts) % 2 == 0)
        return inside, outside.count("{") + outside.count("[") - outside.count("}") - (not inside)

    def record(self, pieces: list[str]) -> str:
        text = self.separator.join(pieces).lstrip(BLANK + ",\ufeff") + self.separator
        if not text.startswith("[") and not (text.startswith("{") and re.search(DATA + r"\[", text)):
            raise ValueError(f"not a table of columns and data: {text[:80]!r}")
        return text.replace("\r", " ").replace("\n", " ")

    def rest(self, pieces: list[str]) -> None:
        text = self.separator.join(pieces).strip(BLANK + "\ufeff")
        if text.strip("]}" + BLANK) and not re.search(rf"{DATA}\]\s*\}}\]?\Z", text):
            raise ValueError(f"not a table of columns and data: {text[:80]!r}")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[str]]]:
    """The byte ranges a task reads, with what is known about each and its pieces in order."""

    def rows():
        for batch in batches:
            names = [n for n in batch.schema.names if n != "value"]
            known = {n: batch.column(n) for n in names}
            values = batch.column("value").to_pylist()
            places = list(zip(known["file"].to_pylist(), known["start"].to_pylist()))
            for row, (place, value) in enumerate(zip(places, values)):
                yield place, row, known, value

    for _, members in groupby(rows(), key=lambda r: r[0]):
        first = next(members)
        yield {n: c[first[1]].as_py() for n, c in first[2].items()}, (r[3] for r in _chained(first, members))


def _chained(first, rest):
    yield first
    yield from rest


REPORT = "file string, start bigint, base int, in_out boolean, depth_out bigint, least_out bigint, in_in boolean, depth_in bigint, least_in bigint"


def _report(scan) -> Callable:
    """What a range does to quotes and depth if it begins outside quotes, and if it begins inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for known, pieces in _ranges(batches):
            inside, depth, least, base = [False, True], [0, 0], [1 << 40, 1 << 40], None
            for piece in pieces:
                if base is None:
                    base = scan.begins(piece) if known["start"] == 0 else 0
                steps = [scan.step(piece, inside[0])]
                # Once both are alike they stay so, and only their depths differ.
                steps.append(steps[0] if inside[0] == inside[1] else scan.step(piece, inside[1]))
                for i, (now, change) in enumerate(steps):
                    inside[i], depth[i] = now, depth[i] + change
                    if not now:
                        least[i] = min(least[i], depth[i])
            found.append((known["file"], known["start"], base or 0, inside[0], depth[0], least[0], inside[1], depth[1], least[1]))
        yield _batch(found, REPORT)

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [field.split() for field in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


ENTRY = "file string, start bigint, base int, inside boolean, depth bigint, opened bigint"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before each range, from the reports of a file in order; ``opened``: the range in which the open record begins."""
    file = None
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            if row["file"] != file:
                file, base, inside, depth, opened = row["file"], row["base"], False, 0, None
            found.append((file, row["start"], base, inside, depth, opened))
            way = "in" if inside else "out"
            ended = opened is None or row[f"least_{way}"] + depth <= base
            depth, inside = depth + row[f"depth_{way}"], row[f"in_{way}"]
            open_now = inside or depth > base
            opened = (row["start"] if ended else opened) if open_now else None
        yield _batch(found, ENTRY)


RECORDS = "file string, start bigint, number bigint, opened bigint, value string"


def _cut(scan) -> Callable:
    """Records of a range; parts of records that go over its borders carry the range in which they begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for known, pieces in _ranges(batches):
            file, start, base, inside, depth, opened = (known[n] for n in ("file", "start", "base", "inside", "depth", "opened"))
            found, held, number, size = [], [], 0, 0
            for piece in pieces:
                inside, change = scan.step(piece, inside)
                depth += change
                held.append(piece)
                if not inside and depth == base:
                    if opened is not None:
                        found.append((file, start, 0, opened, scan.separator.join(held)))
                    elif (record := scan.record(held)) is not None:
                        found.append((file, start, number, None, record))
                        number += 1
                    size += sum(map(len, held))
                    held, opened = [], None
                    if size > 1 << 20:
                        yield _batch(found, RECORDS)
                        found, size = [], 0
            if held and not inside and depth <= base:
                scan.rest(held)
            elif held:
                found.append((file, start, number, start if opened is None else opened, scan.separator.join(held)))
            yield _batch(found, RECORDS)

    return run


def records(spark: SparkSession, path: str, scan: CsvScan | JsonScan | TableScan) -> DataFrame:
    """The records of the files at ``path``: ``file, start, number, value``; ``start`` and ``number`` give their order in the file.

    Files are read by Spark's text reader, in any store it reads. The input is read three times: for the reports, for the records, and for
    the parts at range borders. A report is one small row per range, so what is broadcast is one row for
    each ``spark.sql.files.maxPartitionBytes`` of input. Compressed files are one range. Files are UTF-8.
    """
    text = spark.read.option("lineSep", scan.separator).text(path)
    pieces = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    reports = pieces.mapInArrow(_report(scan), REPORT).repartition(parts, "file").sortWithinPartitions("file", "start")
    entries = reports.mapInArrow(_chain, ENTRY)
    known = pieces.join(F.broadcast(entries), ["file", "start"])
    cut = known.select("file", "start", "base", "inside", "depth", "opened", "value").mapInArrow(_cut(scan), RECORDS)
    whole = cut.filter("opened IS NULL").select("file", "start", "number", "value")
    part = F.struct("start", "value").alias("part")
    # A record's parts: as large as the record.
    number = F.max(F.when(F.col("start") == F.col("opened"), F.col("number"))).alias("number")
    joined = cut.filter("opened IS NOT NULL").groupBy("file", "opened").agg(number, F.array_sort(F.collect_list(part)).alias("parts"))
    joined = joined.select("file", F.col("opened").alias("start"), "number", F.col("parts.value").alias("values"))
    return whole.unionByName(joined.mapInArrow(_join(scan), "file string, start bigint, number bigint, value string"))


def _join(scan) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("file", "start", "number", "values")))
            yield _batch([(file, start, number, scan.record(values)) for file, start, number, values in rows], "file string, start bigint, number bigint, value string")

    return run


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Objects of JSON files, each an array of objects or one object, as rows."""
    lines = fresh_path(spark, "json-records")
    records(spark, path, JsonScan()).select("value").write.text(lines)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(lines)


def read_table_records(spark: SparkSession, path: str) -> DataFrame:
    """``columns`` and ``row``, both arrays of texts, of files that hold a table of columns and data each."""
    found = written(records(spark, path, TableScan()), "table-rows")
    head = F.concat(F.regexp_extract("value", rf"(?s)^(.*?){DATA}\[", 1), F.lit('"data":null}'))
    columns = F.from_json(head, "columns array<string>", {"mode": "FAILFAST"}).getField("columns")
    heads = found.filter(F.col("value").startswith("{")).select("file", columns.alias("columns"))
    values = found.select("file", F.regexp_replace("value", rf"(?s)^\{{.*?{DATA}(?=\[)", "").alias("value"))
    row = F.from_json("value", "array<string>", {"mode": "FAILFAST"}).alias("row")
    return values.join(heads, "file").select("columns", row)


def _hidden(text: F.Column) -> F.Column:
    text = F.replace(text, F.lit(MARK), F.lit(MARK + "m"))
    for char, name in BREAKS:
        text = F.replace(text, F.lit(char), F.lit(MARK + name))
    return text


def _shown(text: F.Column) -> F.Column:
    for char, name in BREAKS:
        text = F.replace(text, F.lit(MARK + name), F.lit(char))
    return F.replace(text, F.lit(MARK + "m"), F.lit(MARK))


def read_csv_records(spark: SparkSession, path: str, options: dict[str, str], schema: T.StructType | str | None = None) -> DataFrame:
    """CSV files with a header, whose quoted fields may hold line breaks, as rows.

    ``options`` are those of Spark's reader. Each file has its own header, and one file's names the columns. Quotes are doubled
    inside quoted fields and do not stand in others; lines end with a line feed, before which a carriage return may stand.
    """
    scan = CsvScan(options.get("sep", ","))
    header = first_record(spark, path, scan)
    if header is None:
        raise ValueError(f"no header in {path}")
    hidden = _hidden(F.lit(header))
    lines = fresh_path(spark, "csv-records")
    spark.range(1).select(hidden.alias("value")).write.text(lines)
    found = records(spark, path, scan).filter("NOT (start = 0 AND number = 0)").select(_hidden(F.col("value")).alias("value"))
    # Spark expects the header in each file, and a task writes one.
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    found = found.select(first.alias("first"), "value")
    found.select(F.explode(F.when(F.col("first"), F.array(hidden, "value")).otherwise(F.array("value"))).alias("value")).write.mode("append").text(lines)
    reader = spark.read.options(**{**options, "header": "true", "multiLine": "false"})
    rows = (reader if schema is None else reader.schema(schema)).csv(lines)
    rows = rows.withColumns({f.name: _shown(F.col(f"`{f.name}`")) for f in rows.schema if isinstance(f.dataType, T.StringType)})
    return rows.withColumnsRenamed({c: _plain_name(c) for c in rows.columns if MARK in c})


def _plain_name(name: str) -> str:
    for char, mark in BREAKS:
        name = name.replace(MARK + mark, char)
    return name.replace(MARK + "m", MARK)


def first_record(spark: SparkSession, path: str, scan: CsvScan | JsonScan) -> str | None:
    """The first record of the first file that has one, from no more pieces than it has, up to doubling; None without one."""
    for file in sorted(spark.read.text(path).inputFiles()):
        # Spark deals a single file's ranges out in their order.
        pieces = spark.read.option("lineSep", scan.separator).text(unquote(file)).select("value")
        size, have = 16, None
        while have is None or len(have) == size // 2:
            have = [r["value"] for r in pieces.limit(size).collect()]
            inside, depth, begin = False, 0, 0
            for i, piece in enumerate(have):
                inside, change = scan.step(piece, inside)
                depth += change
                if not inside and depth == scan.begins(have[0]):
                    record = scan.record(have[begin : i + 1])
                    if record is not None:
                        return record
                    begin = i + 1
            size *= 2
    return None


def keys_of(record: str) -> list[str]:
    """The keys of a JSON object in their order."""
    found = json.loads(record)
    return list(found) if isinstance(found, dict) else []
