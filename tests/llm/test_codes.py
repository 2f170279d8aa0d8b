"""Vector codes: the trie against plain distances, whole training against a loop."""

import hashlib

import numpy as np
import pytest

from rowloom.llm import vector_codes as codes
from rowloom.llm.vector_codes import PARTS, books_digest, compress, nearest, trie, with_label_errors

SCHEMA = "vec_id bigint, embedding array<float>, label int, vector string, code string, error string, of string, largest string"


def plain(parts, book):
    distances = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
    return distances.argmin(axis=1), distances.min(axis=1)


@pytest.mark.parametrize("width, spread", [(1, 3), (2, 3), (4, 2), (4, 200), (7, 1), (0, 1)])
@pytest.mark.parametrize("leaves", [1, 5, 1 << 12])
def test_trie_finds_the_nearest(width, spread, leaves, monkeypatch):
    monkeypatch.setattr(codes, "LEAVES", leaves)
    rng = np.random.default_rng(width * 100 + spread)
    for _ in range(20):
        parts = rng.integers(-spread, spread + 1, (int(rng.integers(1, 80)), width))
        book = rng.integers(-spread, spread + 1, (int(rng.integers(1, 10)), width))
        kinds, branch, counts, leaf = trie(parts)
        assert np.array_equal(kinds[leaf], parts) and counts.sum() == len(parts) and len(kinds) == len({tuple(p) for p in parts.tolist()})
        assert [tuple(k) for k in kinds.tolist()] == sorted(tuple(k) for k in kinds.tolist())
        best, error = nearest(kinds, branch, book)
        want, distance = plain(parts, book)
        assert np.array_equal(best[leaf], want) and np.array_equal(error[leaf], distance)


def loop(rows, entries=64, rounds=2):
    """The contract word by word."""
    kept = [(i, np.floor(np.array(v, np.float64) * 256).astype(np.int64), label) for i, v, label, *_ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ids = sorted({i for i, _, _ in kept if i is not None})[:entries]
    start = [min(tuple(v.tolist()) for j, v, _ in kept if j == i) for i in ids]
    if not start:
        return [], []
    width = len(start[0]) // PARTS
    books = [[list(s[p * width : (p + 1) * width]) for s in start] for p in range(PARTS)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(PARTS):
            groups = {}
            for _, v, _ in kept:
                part = v[p * width : (p + 1) * width].tolist()
                groups.setdefault(best(part, books[p])[1], []).append(part)
            for e, members in groups.items():
                books[p][e] = [sum(column) // len(members) for column in zip(*members)]
    found = []
    for i, v, label in kept:
        told = [best(v[p * width : (p + 1) * width].tolist(), books[p]) for p in range(PARTS)]
        found.append((i, label, "".join(f"{e:02x}" for _, e in told), sum(d for d, _ in told)))
    return found, books


def some_rows(width=2, count=150):
    rng = np.random.default_rng(8)
    rows = [(int(i), rng.normal(0, 0.3, PARTS * width).astype(np.float32).tolist(), None if i % 5 == 0 else int(i % 3)) for i in rng.permutation(count)]
    rows += [(3, [0.5] * PARTS * width, 1)] * 40 + [(3, [-0.25] * PARTS * width, 1), (None, [0.1] * PARTS * width, 2)] * 2
    odd = [float("nan"), float("inf"), None]
    rows += [(900 + k, [x] + [0.0] * (PARTS * width - 1), 0) for k, x in enumerate(odd)] + [(950, None, 1)]
    return [(*r, "v", "c", "e", "o", "l") for r in rows]


@pytest.mark.parametrize("parts", [1, 7])
def test_training_equals_the_loop(spark, parts):
    rows = some_rows()
    found, books = compress(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    want, want_books = loop(rows)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str) and books.tolist() == want_books
    assert books_digest(books) == hashlib.sha256(",".join(str(x) for book in want_books for entry in book for x in entry).encode()).hexdigest()


def test_label_errors(spark):
    rows = spark.createDataFrame([(1, 5, "a", 10), (2, None, "b", 1), (3, None, "c", 2), (4, 5, "d", 7)], "vec_id bigint, label int, code string, error bigint")
    assert {r.vec_id: r.label_error for r in with_label_errors(rows).collect()} == {1: 17, 2: 3, 3: 3, 4: 17}


def test_no_vectors_and_wrong_ones(spark):
    found, books = compress(spark.createDataFrame([], SCHEMA))
    assert found.collect() == [] and books.size == 0
    found, _ = compress(spark.createDataFrame([(None, [0.5] * PARTS, 1, *"vceol")], SCHEMA))
    assert found.collect() == []
    with pytest.raises(ValueError, match="17"):
        compress(spark.createDataFrame([(1, [0.5] * 17, 1, *"vceol")], SCHEMA))
    with pytest.raises(ValueError, match="large"):
        compress(spark.createDataFrame([(1, [1e30] * PARTS, 1, *"vceol")], SCHEMA))


def test_vectors_of_no_components(spark):
    found, _ = compress(spark.createDataFrame([(1, [], 1, *"vceol"), (2, [], None, *"vceol")], SCHEMA))
    assert sorted(map(tuple, found.collect())) == [(1, 1, "00" * PARTS, 0), (2, None, "00" * PARTS, 0)]
