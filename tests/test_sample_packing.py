import hashlib
import random
from collections import Counter

import pytest

from rowloom.operators import ordering, sample_packing
from rowloom.operators.sample_packing import first_fit_decreasing, pack_samples


def plain(sizes, length):
    """Sample by sample: (size, bin, offset) and the number of bins."""
    left, found = [], []
    for size in sorted(sizes, reverse=True):
        b = next((b for b, room in enumerate(left) if room >= size), len(left))
        if b == len(left):
            left.append(length)
        found.append((size, b, length - left[b]))
        left[b] -= size
    return found, len(left)


def test_runs_of_bins_equal_single_bins():
    random.seed(5)
    for _ in range(500):
        length = random.randint(1, 40)
        sizes = [random.randint(1, length) for _ in range(random.randint(0, 70))]
        shares, bins = first_fit_decreasing(Counter(sizes).items(), length)
        found = [(-s.size, r, s.first + (r - s.low) // s.each, s.offset + (r - s.low) % s.each * s.size) for s in shares for r in range(s.low, s.high)]
        assert ([(-size, b, at) for size, _, b, at in sorted(found)], bins) == plain(sizes, length)


def test_work_depends_on_sizes_not_on_samples():
    counts = [(size, 10**9 // size) for size in range(1, 1025)]
    shares, bins = first_fit_decreasing(counts, 1024)
    assert len(shares) < 8 * 1024 and max(Counter(s.size for s in shares).values()) < 40
    assert sum(s.high - s.low for s in shares) == sum(n for _, n in counts)
    assert sum(size * n for size, n in counts) / (bins * 1024) > 0.97


def bucket(key):
    return int(hashlib.md5(f"pack:{'' if key is None else key}".encode()).hexdigest()[:15], 16)


def expected(rows, length, separator, longer="cut"):
    pieces = []
    for key, text in rows:
        tokens = (text or "").split() + ([separator] if separator else [])
        cut = [tokens[i : i + length] for i in range(0, len(tokens), length)]
        pieces += [(-len(c), bucket(key), key is not None, key or 0, i, c) for i, c in enumerate(cut) if longer == "cut" or len(cut) == 1]
    blocks = {}
    order = sorted(pieces)
    for (_, b, at), piece in zip(plain([len(p[-1]) for p in pieces], length)[0], order):
        blocks.setdefault(b, []).append((at, piece[-1]))
    return {b: [c for _, c in sorted(found)] for b, found in blocks.items()}


ROWS = [(i, " ".join(f"t{i}_{j}" for j in range((i * 7) % 40))) for i in range(60)] + [(60, None), (None, "no key"), (61, ""), (3000, "x " * 100)]


@pytest.mark.parametrize("separator", ["</s>", None])
@pytest.mark.parametrize("parts", [1, 7, 64])
def test_blocks(spark, parts, separator):
    want = expected(ROWS, 32, separator)
    df = spark.createDataFrame(ROWS, "k bigint, t string").repartition(parts)
    got = pack_samples(df, "k", "t", 32, separator=separator).collect()
    assert {r["block"] for r in got} == set(want)
    for r in got:
        samples = want[r["block"]]
        room = 32 - sum(map(len, samples))
        assert r["tokens"] == [t for s in samples for t in s] + ["<pad>"] * room and len(r["tokens"]) == 32
        assert r["sample_ids"] == [i + 1 for i, s in enumerate(samples) for _ in s] + [0] * room
        assert r["position_ids"] == [i for s in samples for i in range(len(s))] + [0] * room
        assert (r["n_tokens"], r["n_samples"], r["padding"]) == (32 - room, len(samples), room)


def test_longer_samples_left_out_and_no_padding(spark):
    df = spark.createDataFrame(ROWS, "k bigint, t string")
    want = expected(ROWS, 16, "</s>", "drop")
    got = pack_samples(df, "k", "t", 16, longer="drop", pad=None).collect()
    assert {r["block"]: r["tokens"] for r in got} == {b: [t for s in samples for t in s] for b, samples in want.items()}
    assert all(r["padding"] == 0 and len(r["sample_ids"]) == len(r["tokens"]) == r["n_tokens"] for r in got)
    with pytest.raises(ValueError):
        pack_samples(df, "k", "t", longer="split")


def test_one_row_value_with_most_of_the_table(spark):
    rows = [(7, "a b c")] * 400 + [(i, "x " * (i % 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "k bigint, t string").repartition(5)
    got = pack_samples(df, "k", "t", 16)
    assert Counter(tuple(s) for r in got.collect() for s in split(r)) == Counter(tuple(t.split() + ["</s>"]) for _, t in rows)
    told = sample_packing.fill_rate(got, 16).first()
    bins = plain([len(t.split()) + 1 for _, t in rows], 16)[1]
    assert told["n_blocks"] == bins and told["n_samples"] == 600 and told["fill"] == pytest.approx(sum(len(t.split()) + 1 for _, t in rows) / bins / 16)


def split(row):
    found = {}
    for token, sample in zip(row["tokens"], row["sample_ids"]):
        if sample:
            found.setdefault(sample, []).append(token)
    return found.values()


def test_no_samples(spark):
    df = spark.createDataFrame([(1, None)], "k bigint, t string")
    assert pack_samples(df, "k", "t", separator=None).count() == 0 and pack_samples(df.limit(0), "k", "t").count() == 0
    assert tuple(sample_packing.fill_rate(pack_samples(df.limit(0), "k", "t")).first()) == (0, 0, 0, None)


@pytest.mark.parametrize("parts", [1, 7])
def test_positions(spark, parts):
    rows = [(5,)] * 300 + [(i,) for i in range(100)] + [(None,)] * 3
    df = spark.createDataFrame(rows, "x int").repartition(parts)
    got = ordering.positioned(df, ["x"]).collect()
    assert sorted(r["position"] for r in got) == list(range(403))
    assert [r["x"] for r in sorted(got, key=lambda r: r["position"])] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    placed = ordering.positioned(df)
    assert sorted(r["position"] for r in placed.collect()) == list(range(403))
    assert ordering.positioned(df.limit(0), ["x"]).count() == 0
