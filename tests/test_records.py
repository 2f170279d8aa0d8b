import csv
import io
import json
import random

import pytest

from rowloom.sources import datasets
from rowloom.sources.records import CsvScan, JsonScan, first_record, records


@pytest.fixture(params=[64, 333, 1 << 20])
def ranges(spark, request):
    """Files are cut into ranges of so many bytes."""
    names = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield request.param
    for n, v in before.items():
        spark.conf.set(n, v)


def put(folder, name, text):
    path = folder / name
    path.write_bytes(text.encode())
    return str(path)


WORDS = ["a", "", "é{", "}", 'say "x"', "back\\", "\\\\", "line\nbreak", "[1]", ", ", "\t", "}{", "ü" * 30, "true", '\\"', "],[", "\x01n"]


def some_objects(count, seed):
    random.seed(seed)

    def value(depth):
        kind = random.random()
        if depth and kind < 0.2:
            return {random.choice("abc{}"): value(depth - 1) for _ in range(random.randint(0, 3))}
        if depth and kind < 0.35:
            return [value(depth - 1) for _ in range(random.randint(0, 3))]
        return random.choice([random.randint(-5, 10**6), None, True, 1.5, *WORDS, *WORDS])

    return [{"id": i, **{random.choice(["t", "u", "v w", 'q"', "n{"]): value(3) for _ in range(random.randint(0, 4))}} for i in range(count)]


@pytest.mark.parametrize("shape", [{}, {"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_json_arrays_are_cut_into_their_objects(spark, tmp_path, ranges, shape):
    objects = some_objects(60, len(shape))
    path = put(tmp_path, "a.json", " \n" * (len(shape) % 2) + json.dumps(objects, **shape) + "\n")
    found = records(spark, path, JsonScan())
    assert found.rdd.getNumPartitions() >= (5 if ranges < 1000 else 1)
    rows = sorted(found.collect(), key=lambda r: (r["start"], r["number"]))
    assert [json.loads(r["value"]) for r in rows] == objects
    assert json.loads(first_record(spark, path, JsonScan())) == objects[0]


def test_json_rows_are_those_of_a_whole_file(spark, tmp_path, ranges):
    objects = [{"z": i, "a": random.choice(WORDS), "l": [i, 2.5], "o": {"x": None if i % 3 else "y"}} for i in range(40)]
    put(tmp_path, "a.json", json.dumps(objects))
    put(tmp_path, "b.json", json.dumps(objects[:3], indent=1))
    put(tmp_path, "c.json", json.dumps({"z": 99, "a": "one", "l": [], "o": {"x": "}"}}))
    put(tmp_path, "d.json", "[]")
    put(tmp_path, "e.json", "﻿[\r\n]")
    mine, whole = (datasets.read_dataset(spark, str(tmp_path), "json", whole_files=w) for w in (False, True))
    assert mine.dtypes == whole.dtypes and sorted(map(str, mine.collect())) == sorted(str(r) for r in whole.collect())
    assert datasets.read_dataset(spark, str(tmp_path), "json", "z bigint").agg({"z": "sum"}).first()[0] == sum(range(40)) + 3 + 99


def test_first_record_of_a_long_array(spark, tmp_path, ranges):
    nested = {"k": [{"x": i} for i in range(50)], "b": 1}
    path = put(tmp_path, "a.json", json.dumps([nested, *some_objects(200, 9)]))
    assert datasets.dataset_features(spark, path, "json") == ["k", "b"]
    with pytest.raises(ValueError):
        datasets.dataset_features(spark, put(tmp_path, "b.json", " [ ] "), "json")


@pytest.mark.parametrize("text", ["[1, 2]", '[{"a": 1}, 5]', '["}", {"a": 1}]', "plain"])
def test_what_is_no_array_of_objects_is_refused(spark, tmp_path, text):
    with pytest.raises(Exception, match="not an array of objects"):
        datasets.read_dataset(spark, put(tmp_path, "a.json", text), "json").collect()


FIELDS = ["", "plain", "with, comma", 'a "quoted" word', "two\nlines", "three\n\nlines\n", '"', '""', "\r\n", 'x"\n"y', "é\x01n", " "]


def some_csv(count, seed, ending):
    random.seed(seed)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=ending)
    rows = [["id", "text", "more\nthan one"]] + [[i, random.choice(FIELDS), random.choice(FIELDS)] for i in range(count)]
    writer.writerows(rows)
    return out.getvalue(), rows


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_csv_rows_with_line_breaks(spark, tmp_path, ranges, ending):
    text, rows = some_csv(80, len(ending), ending)
    path = put(tmp_path, "a.csv", text)
    found = sorted(records(spark, path, CsvScan()).collect(), key=lambda r: (r["start"], r["number"]))
    assert [next(csv.reader(io.StringIO(r["value"], newline=""))) for r in found] == [[str(x) for x in r] for r in rows]
    df = datasets.read_dataset(spark, path, "csv", multiline=True)
    assert df.columns == ["id", "text", "more\nthan one", "split"] and dict(df.dtypes)["id"] == "int"
    got = [[r["id"], r["text"] or "", r["more\nthan one"] or ""] for r in sorted(df.collect(), key=lambda r: r["id"])]
    assert got == rows[1:]
    assert datasets.dataset_features(spark, path, "csv") == rows[0]


def test_csv_is_read_as_in_one_piece(spark, tmp_path, ranges):
    folder = tmp_path / "t"
    folder.mkdir()
    for name in "ab":
        put(folder, f"{name}.csv", '\na,b,c\n1,"x\ny",2.5\n\n2,,\n3,"",7\n4,"only"\n5,"p","q","r"\n')
    mine, whole = (datasets.read_dataset(spark, str(folder), "csv", multiline=True, whole_files=w) for w in (False, True))
    assert mine.dtypes == whole.dtypes and sorted(map(str, mine.collect())) == sorted(map(str, whole.collect()))
    typed = datasets.read_dataset(spark, str(folder), "csv", "a int, b string, c string", multiline=True)
    assert typed.count() == whole.count() and typed.filter("b = 'x\ny'").count() == 2


def test_csv_without_rows_or_header(spark, tmp_path):
    df = datasets.read_dataset(spark, put(tmp_path, "a.csv", "x,y\n"), "csv", multiline=True)
    assert df.columns == ["x", "y", "split"] and df.count() == 0
    with pytest.raises(ValueError):
        datasets.read_dataset(spark, put(tmp_path, "b.csv", ""), "csv", multiline=True)


def test_a_record_over_many_ranges(spark, tmp_path, ranges):
    long = "x\n" * 3000
    path = put(tmp_path, "a.csv", f'a,b\n1,"{long}"\n2,"{long}"\n3,z\n')
    rows = sorted(datasets.read_dataset(spark, path, "csv", multiline=True).collect(), key=lambda r: r["a"])
    assert [(r["a"], r["b"]) for r in rows] == [(1, long), (2, long), (3, "z")]
    path = put(tmp_path, "b.json", json.dumps([{"a": [{"b": i} for i in range(900)]}, {"a": []}]))
    assert sorted(len(r["a"]) for r in datasets.read_dataset(spark, path, "json").collect()) == [0, 900]


def test_tables_are_cut_into_their_rows(spark, tmp_path, ranges):
    random.seed(7)
    cell = lambda: random.choice([*WORDS, 1, None, [1, ["]"]], {"x": "["}, True])
    data = [[i, cell(), cell()] for i in range(70)]
    put(tmp_path, "a.json", json.dumps({"columns": ["id", 'b"data": [[', "c"], "data": data}, ensure_ascii=False) + "\n")
    put(tmp_path, "b.json", json.dumps({"columns": ["c", "id"], "data": [["z", 900], ["y", 901]]}, indent=1 if ranges > 64 else None))
    put(tmp_path, "c.json", json.dumps({"columns": ["id"], "data": []}))
    schema = "id bigint, c string"
    got = {r["id"]: r["c"] for r in datasets.read_split_orient(spark, str(tmp_path), spark.createDataFrame([], schema).schema).collect()}
    assert set(got) == {*range(70), 900, 901} and got[900] == "z"
    for i, _, c in data:
        if c is None or isinstance(c, str):
            assert got[i] == c
        elif not isinstance(c, (list, dict)):
            assert got[i] == json.dumps(c)
        else:
            assert json.loads(got[i]) == c


@pytest.mark.parametrize("text", ['{"data": [[1]], "columns": ["a"]}', '{"columns": [["a"], ["b"]], "data": [[1, 2]]}', "[[1, 2]]", '{"a": 1}'])
def test_what_is_no_table_is_refused(spark, tmp_path, text):
    with pytest.raises(Exception):
        datasets.read_split_orient(spark, put(tmp_path, "a.json", text), spark.createDataFrame([], "a int").schema).collect()
