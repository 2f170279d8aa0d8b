import hashlib

import pytest

from rowloom.operators import packing


def bucket(key):
    return int(hashlib.md5(f"pack:{'' if key is None else key}".encode()).hexdigest()[:15], 16)


def expected(rows, length, separator):
    tokens = []
    for key, text in sorted(rows, key=lambda r: (bucket(r[0]), r[0] is not None, r[0] or 0, r[1] or "")):
        tokens += (text or "").split() + ([separator] if separator else [])
    return {b: tokens[b * length : (b + 1) * length] for b in range(-(-len(tokens) // length))}, len(tokens)


ROWS = [(i, " ".join(f"t{i}_{j}" for j in range((i * 7) % 40))) for i in range(60)] + [(60, None), (7, "same key"), (None, "no key"), (3, "x " * 100)]


@pytest.mark.parametrize("separator", ["</s>", None])
@pytest.mark.parametrize("parts", [1, 7, 64])
def test_blocks(spark, parts, separator):
    want, size = expected(ROWS, 16, separator)
    df = spark.createDataFrame(ROWS, "k bigint, t string").repartition(parts)
    got = packing.pack_sequences(df, "k", "t", 16, separator=separator).collect()
    assert {r["block"]: r["tokens"] for r in got} == want
    assert sum(r["n_tokens"] for r in got) == size and all(r["n_tokens"] == len(r["tokens"]) for r in got)
    full = packing.pack_sequences(df, "k", "t", 16, separator=separator, drop_tail=True).collect()
    assert len(full) == size // 16
    assert tuple(packing.dropped_tokens(df, "t", 16, separator=separator).first()) == (size, size // 16, size % 16)


def test_short_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "one two")], "k bigint, t string")
    assert [r["tokens"] for r in packing.pack_sequences(df, "k", "t").collect()] == [["one", "two", "</s>"]]
    assert packing.pack_sequences(df.limit(0), "k", "t").count() == 0
    assert tuple(packing.dropped_tokens(df.limit(0), "t").first()) == (0, 0, 0)


def test_one_key_with_most_of_the_table(spark):
    rows = [(7, f"row {i % 50} " + "x " * (i % 9)) for i in range(400)] + [(None, "none at all")] * 100 + [(i, f"t{i}") for i in range(100, 200)]
    df = spark.createDataFrame(rows, "k bigint, t string").repartition(6)
    got = {r["block"]: r["tokens"] for r in packing.pack_sequences(df, "k", "t", 32).collect()}
    want, size = expected([(k, t) for k, t in rows], 32, "</s>")
    assert sum(map(len, got.values())) == size and sorted(t for b in got.values() for t in b) == sorted(t for b in want.values() for t in b)
    # Keys keep their order; texts of the hot key are whole, in an order of their own.
    stream = [t for b in sorted(got) for t in got[b]]
    samples = " ".join(stream).split(" </s>")
    assert sorted(" ".join(s.split()) for s in samples if s.strip()) == sorted(" ".join(t.split()) for _, t in rows)
    again = {r["block"]: r["tokens"] for r in packing.pack_sequences(df.repartition(2), "k", "t", 32).collect()}
    assert again == got
