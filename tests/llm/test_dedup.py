"""Near duplicates and repeated lines against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import no_documents, odd_documents, odd_rows
from pyspark.sql import functions as F

from rowloom.llm import hamming_join
from rowloom.llm.common import Words, grams
from rowloom.llm.components import components
from rowloom.llm.hamming_join import _chunk_keys, keep_one, minhash_factors, near_duplicates, signature
from rowloom.llm.line_runs import LineRuns, drop_repeated_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def expected(rows, size, percent=80):
    """(id, text) -> (n, component) by comparing all pairs."""
    sets = {r: shingles(r[1], size) for r in set(rows)}
    nodes = [r for r in sets if r[0] is not None and sets[r]]
    parent = {r: r for r in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                parent[find(a)] = find(b)
    least = {}
    for r in nodes:
        least[find(r)] = min(least.get(find(r), r[0]), r[0])
    return Counter((r[0], len(sets[r]), least[find(r)] if r in parent else r[0]) for r in rows)


def edited(rng, words, share):
    return [rng.choice(["alpha", "beta", "gamma"]) + str(rng.randrange(999)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("block", [8 << 20, 4000])
def test_near_duplicates_match_all_pairs(spark, monkeypatch, block):
    # Small blocks, so that components meet across them.
    monkeypatch.setattr(hamming_join, "BLOCK_BYTES", block)
    rng = random.Random(3)
    rows, number = [], 0
    for group in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 8, 60, 300]))]
        for _ in range(rng.choice([1, 2, 12])):
            rows.append((number, " ".join(edited(rng, base, rng.choice([0, 0.01, 0.02, 0.04])))))
            number += 1
    rng.shuffle(rows)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=4).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == expected(rows, 4)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    assert len({r["component_id"] for r in found}) < len(rows) - 20


def test_a_chain_in_one_large_group_is_one_component(spark):
    # Each text is near its neighbours only, so no pivot is linked with all.
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 120])) for i in range(60)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=4).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == expected(rows, 4)
    assert {r["component_id"] for r in found} == {0}


def test_signatures_within_the_guaranteed_distance_share_a_key():
    rng = np.random.default_rng(1)
    import pyarrow as pa

    for _ in range(200):
        a = rng.integers(0, 256, 72, dtype=np.uint8)
        b = a.copy()
        b[rng.choice(72, 23, replace=False)] ^= 1
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()], pa.binary())], names=["node", "signature"])
        keys = next(_chunk_keys(iter([batch]))).column("bucket").to_pylist()
        assert set(keys[:72]) & set(keys[72:])
    assert signature(np.arange(5, dtype=np.uint64), minhash_factors()).shape == (72,)


def test_odd_documents(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    found = near_duplicates(odd_documents(spark), words=4).collect()
    want = Counter((i, n, None if i is None else c) for (i, n, c), k in expected(rows, 4).items() for _ in range(k))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == want
    kept = keep_one(odd_documents(spark), words=4)
    assert kept.columns == odd_documents(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(3) == 1 and ids.count(5) == 2 and None in ids and {100, 101, 102, 106} <= set(ids)
    assert near_duplicates(no_documents(spark)).count() == 0 and keep_one(no_documents(spark)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {x: find(x) for x in linked}


def lines_left(rows, least_length, least_docs):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_length:
                holders[key(line)].add(-(2**63) if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if len(holders[key(x)]) < least_docs or max(holders[key(x)]) == (-(2**63) if i is None else i)]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return Counter(out)


def test_repeated_lines(spark):
    rng = random.Random(5)
    pool = [f"  A Common line {i} of some length é " for i in range(12)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own {i} {rng.random()}" for _ in range(rng.randrange(1, 9)))) for i in range(80)]
    rows += [(None, pool[0] + "\n" + pool[1]), (3, pool[2].upper()), (7, None), (8, ""), (9, "\n"), (200, pool[0] + "\n" + pool[0]), *[(50, pool[3])] * 4]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = drop_repeated_lines(df, least_length=10, least_docs=5)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in found.collect()) == lines_left(rows, 10, 5)
    assert found.columns == ["doc_id", "text", "n_lines", "n_dropped", "kept"]


def test_repeated_lines_of_odd_documents(spark):
    found = drop_repeated_lines(odd_documents(spark), least_length=3, least_docs=2)
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in found.collect()) == lines_left(rows, 3, 2)
    assert drop_repeated_lines(no_documents(spark)).count() == 0


def test_runs_are_compacted(spark):
    runs = LineRuns(spark, fan=2)
    for batch in range(5):
        rows = [(k, k, 100 - batch) for k in range(batch * 3, batch * 3 + 6)]
        runs.add(spark.createDataFrame(rows, "k1 bigint, k2 bigint, doc bigint"))
    assert {level: len(names) for level, names in runs.levels.items() if names} == {0: 1, 2: 1}
    found = {r["k1"]: r["holder"] for r in runs.repeated(2).collect()}
    assert found == {k: 100 - (k // 3 - 1) for k in range(3, 15)}
    name = runs.names()[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = spark.table(name).join(spark.table(name), ["k1", "k2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.close()
    assert not runs.names()


def test_words_of_long_texts_and_batches():
    hasher = Words()
    texts = [b"The  cat\tsat", None, b"", b"x " * 200_000, "Él É".encode(), b"y" * 300_000]
    found = list(hasher.of_many(texts))
    assert [len(f) for f in found] == [3, 0, 0, 200_000, 2, 1]
    assert (found[3] == hasher.of(b"X")[0][0]).all() and len(grams(found[0], 4)) == 1 and len(grams(found[1], 4)) == 0


def test_text_hash_tells_rows_of_one_id_apart(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "quite another text here now"), (0, "a b c d e f")], "doc_id bigint, text string")
    left = keep_one(df, words=4).select("doc_id", F.substring("text", 1, 5).alias("t")).collect()
    assert sorted((r["doc_id"], r["t"]) for r in left) == [(0, "a b c"), (1, "quite")]
