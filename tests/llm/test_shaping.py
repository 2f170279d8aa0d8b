"""Resharding, decontamination and mixing against plain Python."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import no_documents, odd_documents, odd_rows, stored

from rowloom.llm import decontaminate
from rowloom.llm.decontaminate import align, clean, contaminated
from rowloom.llm.mixing import fair_mix, mixed
from rowloom.llm.resharding import even_capacities, min_cost_flow, reshard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("seed", range(6))
def test_flow_is_as_cheap_as_any(seed):
    rng = random.Random(seed)
    supply = [rng.randrange(4) for _ in range(3)]
    capacity = [rng.randrange(4) for _ in range(2)]
    capacity.append(max(0, sum(supply) - sum(capacity)))
    cost = np.array([[rng.randrange(5) for _ in range(3)] for _ in range(3)])
    flow = min_cost_flow(supply, capacity, cost)
    assert flow.sum(1).tolist() == supply and (flow.sum(0) <= capacity).all() and (flow >= 0).all()
    rows = [[c for c in itertools.product(range(s + 1), repeat=3) if sum(c) == s] for s in supply]
    best = min(
        sum(cost[i][j] * r[j] for i, r in enumerate(way) for j in range(3)) for way in itertools.product(*rows) if all(sum(r[j] for r in way) <= capacity[j] for j in range(3))
    )
    assert (flow * cost).sum() == best


def test_flow_moves_only_what_is_too_much():
    old, new = [100, 10, 40, 50], [40] * 5
    cost = np.ones((4, 5), int)
    for i in range(4):
        cost[i, i] = 0
    assert (min_cost_flow(old, new, cost) * cost).sum() == sum(max(0, x - 40) for x in old)
    with pytest.raises(ValueError):
        min_cost_flow([5], [4], np.zeros((1, 1)))


def test_a_text_larger_than_a_shard_gets_its_own():
    assert even_capacities(1000, 4, [700, 60]) == ([100, 100, 100], 1)
    assert even_capacities(0, 3, []) == ([0, 0, 0], 0)


def shape(found, shards):
    by = defaultdict(list)
    for r in found:
        by[r["shard"]].append(r)
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    return [sum(len((r["text"] or "").encode()) + 8 for r in by[j]) for j in range(shards)]


def test_reshard_is_even_and_moves_little(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randrange(200)) for i in range(3000)] + [(3000 + i, "y" * 9000) for i in range(10)]
    path = str(tmp_path / "old")
    spark.createDataFrame(rows, "doc_id bigint, text string").repartitionByRange(5, "doc_id").write.parquet(path)
    docs = spark.read.parquet(path)
    found = reshard(docs, shards=8)
    assert found.columns == ["doc_id", "text", "shard", "slot"]
    found = found.collect()
    assert Counter((r["doc_id"], r["text"]) for r in found) == Counter(rows)
    sizes = shape(found, 8)
    assert max(sizes) - min(sizes) < 300
    before = defaultdict(int)
    for r in docs.selectExpr("_metadata.file_path AS f", "doc_id", "length(text) + 8 AS n").collect():
        before[r["f"]] += r["n"]
    home = {f: i for i, f in enumerate(sorted(before))}
    files = {r["doc_id"]: r["f"] for r in docs.selectExpr("_metadata.file_path AS f", "doc_id").collect()}
    moved = sum(len(r["text"]) + 8 for r in found if home[files[r["doc_id"]]] != r["shard"])
    least = sum(max(0, n - sum(before.values()) / 8) for n in before.values())
    assert moved <= least + 8 * 300


def test_old_shards_that_lose_nothing_are_not_rewritten(spark, tmp_path):
    for i, n in enumerate([10, 10, 40]):
        spark.range(n).selectExpr("id AS doc_id", "'abcdefgh' AS text").coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    found = reshard(docs, shards=4)
    assert [n // 16 for n in shape(found.collect(), 4)] == [15] * 4
    fewer = reshard(docs, shards=2).collect()
    assert [n // 16 for n in shape(fewer, 2)] == [30, 30]


def test_reshard_of_odd_documents(spark):
    rows = odd_rows()
    found = reshard(odd_documents(spark), shards=3)
    assert Counter((r["doc_id"], r["text"], r["row"]) for r in found.collect()) == Counter((r[0], r[1], "r") for r in rows)
    sizes = shape(found.collect(), 3)
    assert sorted(sizes)[:2] == pytest.approx([sum(sizes) - max(sizes)] * 2, rel=0.6) or max(sizes) > sum(sizes) / 2
    assert reshard(no_documents(spark), shards=3).count() == 0


def mix_by_hand(rows, weights=(1, 2, 3), most=3):
    sizes = [len(WORD.findall(r[1] or "")) for r in rows]
    total = Counter()
    for r, n in zip(rows, sizes):
        total[r[3]] += n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = {}, sum(sizes), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > most * total[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        for s in over:
            target[s] = float(most * total[s])
            left -= most * total[s]
        free -= over
    return total, target


def stream_by_hand(rows, budget=None, most=3):
    """Words taken by (id, source): all copies by finish time, cut at the budget."""
    total, target = mix_by_hand(rows)
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    copies, rank = [], 0
    for source in names:
        queue = sorted((hashlib.md5(f"mix:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, len(WORD.findall(r[1] or ""))) for r in rows if r[3] == source)
        begun = 0
        for _, known, doc_id, size in queue:
            key = (doc_id if known else None, source)
            copies += [((c * total[source] + begun + size) / target[source], rank, c, size, key) for c in range(most) if size]
            begun += size
            rank += 1
    left, taken = round(sum(target.values())) if budget is None else budget, Counter()
    for _, _, _, size, key in sorted(copies):
        taken[key] += max(0, min(size, left))
        left -= size
    return taken


def test_the_sorted_stream_decides(spark):
    """Long documents of one source: those that end late are left out, and others take the room, which no cut per source does."""
    rows = [(i, "w " * (400 if i % 4 == 0 else 3), "en", "ab"[i % 4 == 0]) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    found = {(r["doc_id"], r["source"]): r["taken"] for r in fair_mix(df)[0].collect()}
    assert {k: v for k, v in found.items() if v} == {k: v for k, v in stream_by_hand(rows).items() if v}
    _, target = mix_by_hand(rows)
    by_source = Counter()
    for (_, source), n in found.items():
        by_source[source] += n
    assert sum(found.values()) == round(sum(target.values())) and all(abs(by_source[s] - target[s]) <= 400 for s in target)


def test_mix_reaches_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 60), "en", ["a", "b", "c", "é", None][min(4, int(rng.expovariate(0.7)))]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    plan, stream = fair_mix(df)
    found = plan.collect()
    total, target = mix_by_hand(rows)
    taken = Counter()
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == total[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
    # Each source is within one document of its target, and all together meet the budget to a word.
    assert all(abs(taken[s] - target[s]) < 60 for s in target) and sum(taken.values()) == sum(total.values())
    # Finish times follow the hash order of each queue, and the stream is sorted by them.
    packets = stream.orderBy("words_before").collect()
    assert [p["finish"] for p in packets] == sorted(p["finish"] for p in packets)
    assert packets[-1]["words_before"] + packets[-1]["words"] == sum(taken.values())
    want = stream_by_hand(rows)
    assert {(r["doc_id"], r["source"]): r["taken"] for r in found} == {(r[0], r[3]): want[r[0], r[3]] for r in rows}
    again = fair_mix(df.repartition(7))[0].collect()
    assert {r["doc_id"]: r["taken"] for r in again} == {r["doc_id"]: r["taken"] for r in found}
    assert sum(r["taken"] for r in fair_mix(df, budget=1000)[0].collect()) == pytest.approx(1000, abs=5)


def test_mix_of_odd_documents(spark):
    rows = odd_rows()
    plan = fair_mix(odd_documents(spark))[0].collect()
    assert Counter((r["doc_id"], r["size"]) for r in plan) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    _, target = mix_by_hand(rows)
    taken = Counter()
    for r in plan:
        taken[r["source"]] += r["taken"]
    want = stream_by_hand(rows)
    by_row = Counter()
    for r in plan:
        by_row[r["doc_id"], r["source"]] += r["taken"]
    assert {k: v for k, v in by_row.items() if v} == {k: v for k, v in want.items() if v}
    longest = max(r["size"] for r in plan)
    assert all(abs(taken[s] - target[s]) <= longest for s in target)
    docs = odd_documents(spark)
    kept = mixed(docs)
    assert kept.columns == docs.columns
    times = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert all(n <= 3 * rows_ for (k, n) in times.items() for rows_ in [sum((r[0], r[1]) == k for r in rows)])
    assert times[100, None] == times[101, ""] == 1
    assert mixed(no_documents(spark)).count() == 0 and fair_mix(no_documents(spark))[0].count() == 0


def slow_align(text, item):
    best, table = 0, defaultdict(int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(text) + 1):
            same = 2 if item[i - 1] == text[j - 1] else -1
            table[i, j] = max(0, table[i - 1, j - 1] + same, table[i - 1, j] - 1, table[i, j - 1] - 1)
            best = max(best, table[i, j])
    return best


@pytest.mark.parametrize("seed", range(5))
def test_alignment(seed):
    rng = np.random.default_rng(seed)
    text, item = rng.integers(0, 6, 60), rng.integers(0, 6, 14)
    score, first, end = align(text, item)
    assert score == slow_align(text.tolist(), item.tolist()) == slow_align(text[first:end].tolist(), item.tolist())


def test_contaminated(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 30
    items = [(k, " ".join(rng.choice(words) for _ in range(25))) for k in range(12)]
    items += [(50, items[3][1].upper()), (51, None), (52, ""), (53, "the of")]
    docs, want = [], set()
    for d in range(120):
        text = [rng.choice(words) for _ in range(rng.randrange(0, 400))]
        if d % 3 == 0:
            k = d % 12
            copy = items[k][1].split()
            if d % 2:  # edited: words changed, dropped and added
                copy[5:6], copy[14:14] = ["changed"], ["more", "words"]
                del copy[20]
            at = rng.randrange(len(text) + 1)
            text[at:at] = copy
            want.add((d, k))
        docs.append((d, " ".join(text)))
    docs += [(None, items[0][1]), (900, None), (901, ""), (902, items[1][1] * 1 + " x" * 150_000)] + [(903, items[2][1])] * 3
    want |= {(None, 0), (902, 1), (903, 2)}
    df, tests = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    found = contaminated(df, tests).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and len(found) == len(want) + 2
    assert all(0.5 <= r["score"] <= 1 and r["to_word"] - r["from_word"] >= 12 for r in found)
    left = clean(df, tests).collect()
    assert Counter(left) == Counter(r for r in df.collect() if r["doc_id"] not in {d for d, _ in want})


def test_seeds_find_every_six_words_in_common(spark):
    # Six words in a row of an item are enough to be looked at; half of them is enough to be reported.
    item = [f"a{i}" for i in range(12)]
    docs = [(i, " ".join(["z"] * 5 + item[i : i + 6] + ["y"] * 5)) for i in range(7)]
    common = [(100 + i, " ".join(item[3:6])) for i in range(50)]
    found = contaminated(spark.createDataFrame(docs + common, "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string"))
    assert sorted(r["doc_id"] for r in found.collect()) == list(range(7))


def test_edited_copies_of_short_items_are_found_as_by_alignment(spark):
    # Plain Smith-Waterman over the whole text is the truth, for copies that share three words in a row with their item.
    rng = random.Random(5)
    items = [(k, [f"w{rng.randrange(400)}" for _ in range(rng.randrange(8, 21))]) for k in range(40)]
    copies = [(k, [f"x{rng.randrange(10**6)}" if rng.random() < 0.3 else w for w in words]) for k, words in items for _ in range(12)]
    copies += [(k, [f"x{rng.randrange(10**6)}" if j % 4 == 3 else w for j, w in enumerate(words)]) for k, words in items]
    docs, want = [], set()
    for d, (_, copy) in enumerate(copies):
        text = [f"y{rng.randrange(1000)}" for _ in range(20)] + copy + [f"y{rng.randrange(1000)}" for _ in range(20)]
        docs.append((d, " ".join(text)))
        three = set(zip(text, text[1:], text[2:]))
        for k, words in items:
            if three & set(zip(words, words[1:], words[2:])) and slow_align(text, words) >= len(words):
                want.add((d, k))
    df, tests = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id bigint, text string")
    assert len(want) > 250 and {(r["doc_id"], r["item_id"]) for r in contaminated(df, tests).collect()} == want
    assert {r["doc_id"] for r in clean(df, tests).collect()} == set(range(len(docs))) - {d for d, _ in want}


def test_items_with_equal_words_are_one_in_any_number_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 10)
    item, breaks = [f"a{i}" for i in range(12)], [" ", "  ", "\n", "\t", " \r\n", "\x0b", "\x0c "]
    items = [(k, b + b.join(item if k % 2 else [w.upper() for w in item]) + b * (k % 3)) for k, b in enumerate(breaks, 3)]
    found = contaminated(spark.createDataFrame([(1, " ".join(item))], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert [(r["doc_id"], r["item_id"], r["score"]) for r in found.collect()] == [(1, 3, 1.0)]


def test_decontamination_of_odd_documents(spark, tmp_path):
    docs = stored(odd_documents(spark), tmp_path)
    tests = spark.createDataFrame([(1, odd_rows()[4][1])], "item_id bigint, text string")
    assert 4 in {r["doc_id"] for r in contaminated(docs, tests).collect()}
    left = clean(docs, tests)
    assert left.columns == docs.columns and 4 not in {r["doc_id"] for r in left.collect()}
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert contaminated(docs, nothing).count() == 0 and clean(docs, nothing).count() == docs.count()
    assert contaminated(no_documents(spark), tests).count() == 0 and clean(no_documents(spark), tests).count() == 0
