"""Conversation repair against a plain search over costs and audits."""

import hashlib
import re
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import conversations as repair
from rowloom.llm.conversation_queries import damaged, report
from rowloom.llm.conversations import cheapest_edits, digests, faults, repaired, summary

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place string, number string, digest string, block string, edit string, cost string"
WHITE = " \t\n\x0b\x0c\r"
PATTERN = re.compile("(s?(ua)+)?")


def want(rows):
    """One conversation: what the contract says, by trying all ways."""
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    seen, marks = set(), []
    for _, role, text in rows:
        end = text.rstrip(WHITE)
        marks.append("b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, last, inserted):
        ways = []
        if i == len(rows) and last in ("", "a"):
            ways.append((0, "", ()))
        if inserted < 3:
            new = "a" if last == "u" else "u"
            cost, audit, out = best(i, new, inserted + 1)
            ways.append((cost + 2, "I" + audit, (("user:" if new == "u" else "assistant:"),) + out))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, out = best(i + 1, last, 0)
            ways.append((cost + 3, "D" + audit, out))
            if marks[i] not in ("b", "d"):
                more = marks[i] == "t"
                if role[:1] and role[:1] in allowed[last]:
                    cost, audit, out = best(i + 1, role[:1], 0)
                    ways.append((cost + more, "K" + audit, (f"{role}:{text}",) + out))
                new = "a" if last == "u" else "u"
                cost, audit, out = best(i + 1, new, 0)
                ways.append((cost + 2 + more, "R" + audit, (f"{'user' if new == 'u' else 'assistant'}:{text}",) + out))
        return min(ways) if ways else (1 << 50, "", ())

    cost, audit, out = best(0, "", 0)
    assert PATTERN.fullmatch("".join(line[0] for line in out))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def some_conversations(count, longest, seed):
    rng = np.random.default_rng(seed)
    roles = ["system", "user", "assistant", "tool", "", None, "unicorn", "User"]
    texts = ["Yes.", "no", " Why? \n", "", "\t", None, "Oh!", "a.b", "é…", "x" * 3000]
    rows = []
    for conv in range(count):
        size = int(rng.integers(1, longest + 1))
        for turn in range(size):
            role = roles[rng.choice(len(roles), p=[0.1, 0.36, 0.36, 0.06, 0.03, 0.03, 0.03, 0.03])]
            text = texts[rng.integers(len(texts))] if rng.random() < 0.5 else f"Text {rng.integers(10**6)}{'.' if rng.random() < 0.8 else ''}"
            number = None if rng.random() < 0.03 else int(turn + (rng.random() < 0.1) * rng.integers(-2, 3))
            rows.append((None if conv == 0 else conv, number, role, text))
    return rows


def stored(spark, rows, parts=3):
    return spark.createDataFrame([(*r, *"pndbec") for r in rows], SCHEMA).repartition(parts)


def grouped(rows):
    groups = {}
    for conv, *row in rows:
        groups.setdefault(conv, []).append(row)
    return groups


def columns(r):
    return (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)


@pytest.mark.parametrize("parts", [1, 7])
def test_small_conversations(spark, parts):
    rows = some_conversations(120, 7, 1)
    data = stored(spark, rows, parts)
    found = {r.conv_id: columns(r) for r in report(data, data).collect()}
    groups = grouped(rows)
    assert set(found) == set(groups)
    for conv, group in groups.items():
        assert found[conv] == want(group), group


def test_conversations_over_many_blocks(spark, monkeypatch):
    """Blocks of four rows, and more ranges than conversations: most pieces are linked."""
    monkeypatch.setattr(repair, "BLOCK_BITS", 2)
    rows = some_conversations(6, 60, 2)
    data = stored(spark, rows)
    found = {r.conv_id: columns(r) for r in report(data, data).collect()}
    for conv, group in grouped(rows).items():
        assert found[conv] == want(group)


def test_long_conversation_with_equal_rows(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"Row {i}.") for i in range(1500)] + [(1, 5, "user", "Row 5.")] * 300 + [(2, None, "user", None)]
    data = stored(spark, rows, 4)
    found = {r.conv_id: r for r in report(data, data).collect()}
    # A first user and a last assistant are missing.
    assert found[1].audit == "I" + "K" * 6 + "D" * 300 + "K" * 1494 + "I"
    assert (found[1].duplicate, found[1].illegal, found[1].cost, found[1].gaps) == (300, 300, 904, 0)
    said = ["user:"] + [f"{'user' if i % 2 else 'assistant'}:Row {i}." for i in range(1500)] + ["assistant:"]
    assert found[1].repaired_sha256 == hashlib.sha256("\n".join(said).encode()).hexdigest()
    assert columns(found[2]) == want(grouped(rows)[2])


def test_repaired_rows_follow_the_pattern_in_any_layout(spark):
    rows = some_conversations(40, 9, 3)
    data = stored(spark, rows)
    edits = cheapest_edits(faults(data))
    for whole in (False, True):
        said = {}
        for r in sorted(repaired(data, edits, whole).collect(), key=lambda r: (r.place, r.number)):
            if r.edit != "D":
                said.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        for conv, group in grouped(rows).items():
            assert hashlib.sha256("\n".join(said.get(conv, [])).encode()).hexdigest() == want(group)[-1]


def test_no_rows(spark):
    data = stored(spark, [])
    assert report(data, data).collect() == [] and digests(repaired(data, cheapest_edits(faults(data)))).collect() == [] and summary(faults(data)).collect() == []
    lost = stored(spark, [(4, 1, "user", "Hi."), (None, None, None, None)])
    rows = sorted((columns(r) for r in report(lost, data).collect()), key=str)
    assert rows == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] * 2


def test_damage(spark):
    import zlib

    rows = some_conversations(60, 6, 4)
    found = sorted(tuple(r) for r in damaged(stored(spark, rows)).select(F.coalesce("conv_id", F.lit(-1)), F.coalesce("turn", F.lit(-9)), "role", "text").collect())
    expected = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        row = (-1 if conv is None else conv, -9 if turn is None else turn, "user" if code == 4 else role, text)
        expected += [row] * {0: 0, 3: 2}.get(code, 1)
    assert found == sorted(expected)
