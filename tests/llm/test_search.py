"""Vector search and archives against plain Python."""

import random
import zipfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from rowloom.llm import vector_file, warc_zip
from rowloom.llm.vector_file import top_k
from rowloom.llm.warc_zip import base32_sha1, members, parse_record, read_archives, record, round_trip, write_archives


def by_hand(rows, asked, k=5):
    import math

    def ok(v):
        return v and all(x is not None and math.isfinite(x) for x in v)

    ints = {(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows if i is not None and ok(v)}
    out = set()
    for q, v in ints:
        if asked(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints if i != q and len(w) == len(v))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def test_search_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vector_file, "BLOCK", 64)
    monkeypatch.setattr(vector_file, "QUERIES", 8)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.2, 12).astype(np.float32).tolist()) for i in range(700)]
    common = rows[50][1]
    rows += [(1000 + i, common) for i in range(150)] + [(2000 + i, [0.0] * 12) for i in range(20)]
    rows += [(50, None), (3000, []), (3050, [float("nan")] + [0.0] * 11), (3051, [None] * 12), (3100, [float("inf")] * 12), (None, common), (3150, [0.5, 0.5]), (3151, [0.25, 0.5])]
    rows += [rows[50], (1050, common)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id bigint, embedding array<float>, score string, query string").repartition(5)
    found = top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == by_hand(rows, lambda i: i % 50 == 0)


def test_few_vectors(spark):
    schema = "vec_id bigint, embedding array<double>"
    assert top_k(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    assert top_k(spark.createDataFrame([(0, [1.0])], schema), F.col("vec_id") % 50 == 0).count() == 0
    found = top_k(spark.createDataFrame([(0, [1.0, -0.3]), (1, [0.1, 0.2]), (2, [0.1, 0.2])], schema), F.col("vec_id") % 50 == 0)
    assert [tuple(r) for r in found.orderBy("rank").collect()] == [(0, 1, 1, 256 * 25 - 77 * 51), (0, 2, 2, 256 * 25 - 77 * 51)]


@pytest.mark.parametrize("seed", range(4))
def test_bounds_hold(seed):
    rng = np.random.default_rng(seed)
    data, asked = rng.integers(-300, 300, (50, 6)), rng.integers(-300, 300, (7, 6))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(50)), pa.array(data.tolist(), pa.list_(pa.int64()))], names=["class", "ints"])
    vector_file.TaskContext.get = staticmethod(lambda: type("T", (), {"partitionId": staticmethod(lambda: 0)}))
    packed = next(vector_file._pack(iter([batch])))
    kinds = {"query": pa.array([list(range(7))], pa.list_(pa.int64())), "ints": pa.array([asked.reshape(-1).tolist()], pa.list_(pa.int64()))}
    row = pa.RecordBatch.from_arrays([packed.column(c) for c in ("length", "classes", "cells", "low", "step")] + list(kinds.values()), names=["length", "classes", "cells", "low", "step", *kinds])
    found = next(vector_file._scan(5)(iter([row]))).to_pylist()
    true = asked @ data.T
    assert all(r["low"] <= true[r["query"], r["class"]] <= r["high"] for r in found)
    for q in range(7):
        best = set(np.argsort(-true[q], kind="stable")[:6].tolist())
        assert best <= {r["class"] for r in found if r["query"] == q} or len(set(true[q])) < 50


def pages_by_hand(rows, least=0):
    out = Counter()
    for page_id, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == body and p is not None]
        first = min(same) if same and len(body) >= least and sum((h or "").encode() == body for _, _, h in rows) > 1 else None
        revisit = first is not None and first != page_id
        out[page_id, len(body), base32_sha1(body), "revisit" if revisit else "response", first if revisit else None] += 1
    return out


ROWS = [(i, f"http://x.example/{i}", f"<html>é {i % 7}</html>" if i % 5 else f"<p>{i}\r\n\r\nWARC/1.1\r\n\r\n</p>") for i in range(60)]
ROWS += [(100, None, None), (101, "", ""), (102, "http://a\r\nWARC-Type: bad", "x"), (None, "u", "<html>é 1</html>"), (None, None, "only here"), (None, None, "only here")]
ROWS += [(103, "long", "<b>漢字</b>" * 200_000), (1, "again", "<html>é 1</html>"), (1, "again", "<html>é 1</html>")]


@pytest.mark.parametrize("least", [0, 20])
def test_round_trip(spark, least):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id bigint, url string, html string, digest string").repartition(3)
    found = round_trip(df, least).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found) == pages_by_hand(ROWS, least)
    bodies = {(p, (h or "").encode()) for p, _, h in ROWS}
    assert all((r["page_id"], bytes(r["payload"])) in bodies for r in found if r["record_type"] == "response")
    assert round_trip(df.limit(0)).count() == 0


def test_archives_are_valid_zip_files_of_bounded_size(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id bigint, url string, html string").coalesce(1)
    archives = write_archives(df, f"file://{tmp_path}/a", archive_bytes=2000)
    listed = archives.collect()
    assert len(listed) > 2 and sum(r["records"] for r in listed) == len(ROWS)
    for r in listed:
        with zipfile.ZipFile(r["path"].removeprefix("file://")) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {0}
            ours = members(fs.LocalFileSystem().open_input_file(r["path"].removeprefix("file://")))
            assert {i.filename: i.file_size for i in z.infolist()} == {n: s for n, (_, s) in ours.items()}
    assert read_archives(spark, archives).count() == len(ROWS)


@pytest.mark.parametrize("wide", [False, True])
def test_archives_of_other_writers(tmp_path, wide):
    path = str(tmp_path / "b.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\x05\x06 a comment that looks like an end"
        with z.open("archive/a.warc.gz", "w", force_zip64=wide) as f:
            f.write(b"0123456789")
        z.writestr("indexes/é.cdxj", b"abc")
    with fs.LocalFileSystem().open_input_file(path) as source:
        found = members(source)
        assert {n: source.read_at(size, at) for n, (at, size) in found.items()} == {"archive/a.warc.gz": b"0123456789", "indexes/é.cdxj": b"abc"}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaa")
    with pytest.raises(ValueError), fs.LocalFileSystem().open_input_file(path) as source:
        members(source)


def test_broken_payloads_are_noticed():
    whole = record(7, "http://x", b"payload", 7, base32_sha1(b"payload"), None)
    assert parse_record(whole)["payload"] == b"payload" and parse_record(whole)["page_id"] == 7
    with pytest.raises(ValueError):
        parse_record(whole.replace(b"payload\r\n\r\n", b"paYload\r\n\r\n"))


def test_ids_are_drawn_from_all_records(spark):
    rng = random.Random(3)
    rows = [(i, "u", "same" if rng.random() < 0.4 else f"own {i}") for i in range(500)]
    found = round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found) == pages_by_hand(rows)
