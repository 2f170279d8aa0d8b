"""Test items in training text: n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from string import ascii_lowercase, ascii_uppercase
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import Words, arrow_batches, grams, text_bytes

SEED_WORDS = 3
LEAST = 0.5  # of the score of an item's full copy
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_WORDS = 200_000  # words of items that are searched for in one pass over the documents


class Items:
    """A block of test items: their words and seeds, which are all n-grams of all items."""

    def __init__(self, ids: list, words: list[np.ndarray]) -> None:
        self.ids, self.words = ids, words
        per_item = [grams(w, SEED_WORDS) for w in words]
        seed = np.concatenate([np.zeros(0, np.uint64), *per_item])
        order = np.argsort(seed, kind="stable")
        self.seed = seed[order]
        self.seed_item = np.repeat(np.arange(len(words)), [len(g) for g in per_item])[order]
        self.seed_at = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g in per_item]])[order]
        self.sizes = np.array([len(w) for w in words], np.int64)


def align(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: score, first word and end word in ``text``."""
    size = len(text)
    score, start = np.zeros(size + 1, np.int64), np.arange(size + 1)
    best = (0, 0, 0)
    slope = -GAP * np.arange(size + 1)
    for word in item:
        step = np.where(text == word, MATCH, MISMATCH)
        new, begun = np.zeros(size + 1, np.int64), np.arange(size + 1)
        for value, origin in ((score[:-1] + step, start[:-1]), (score[1:] + GAP, start[1:])):
            better = value > new[1:]
            new[1:][better], begun[1:][better] = value[better], origin[better]
        # Gaps in the item: the best of all earlier cells less the words between.
        lifted = new + slope
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(size + 1), 0))
        along = top - slope
        better = along > new
        new[better], begun[better] = along[better], begun[source[better]]
        score, start = new, begun
        at = int(np.argmax(score))
        if score[at] > best[0]:
            best = (int(score[at]), int(start[at]), at)
    return best


def matches(words: np.ndarray, items: Items, least: float = LEAST) -> list[tuple[int, int, int, int]]:
    """``item number, score, first word, end word`` of the best alignment of each item that scores enough."""
    if len(words) < SEED_WORDS or not len(items.seed):
        return []
    own = grams(words, SEED_WORDS)
    low, high = np.searchsorted(items.seed, own, "left"), np.searchsorted(items.seed, own, "right")
    at = np.flatnonzero(high > low)
    if not len(at):
        return []
    several = (high - low)[at]
    k = np.arange(several.sum()) + np.repeat(low[at] - np.cumsum(several) + several, several)
    item = items.seed_item[k]
    size, begin = items.sizes[item], np.repeat(at, several) - items.seed_at[k]
    first, end = np.maximum(0, begin - size // 2 - 1), np.minimum(len(words), begin + size + size // 2 + 1)
    order = np.lexsort((end, first, item))
    item, first, end = item[order], first[order], end[order]
    cuts = np.flatnonzero(item[1:] != item[:-1]) + 1
    found = []
    for item, starts, ends in zip(item[np.append(0, cuts)].tolist(), np.split(first, cuts), np.split(end, cuts)):
        best, target = (0, 0, 0), items.words[item]
        enough = least * MATCH * len(target)
        joined: list[list[int]] = []
        for a, b in zip(starts.tolist(), ends.tolist()):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        for a, b in joined:
            # No alignment scores more than the words of the item that the window holds.
            if MATCH * np.isin(target, words[a:b]).sum() >= max(enough, best[0] + 1):
                score, first, end = align(words[a:b], target)
                if score > best[0]:
                    best = (score, a + first, a + end)
        if best[0] and best[0] >= enough:
            found.append((item, *best))
    return found


def _blocks(items: DataFrame, id_column: str, text_column: str) -> Iterator[Items]:
    """Items with equal words are one, called by the smallest id. A block has a bounded number of words."""
    text = F.col(text_column).cast("string")
    rows = items.select(F.col(id_column).alias("id"), text.alias("text")).filter("text IS NOT NULL")
    size = rows.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    blocks = int(size // BLOCK_WORDS) + 1
    hasher = Words()
    # Texts with equal words go to one block, whatever the white space.
    plain = F.trim(F.regexp_replace(F.translate("text", ascii_uppercase, ascii_lowercase), "[\\x20\\x09-\\x0D]+", " "))
    for block in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64(plain), F.lit(blocks)) == block).groupBy("text").agg(F.min("id").alias("id"))
        by_words: dict[bytes, tuple] = {}
        for row in part.toLocalIterator():
            words = hasher.of(row["text"].encode())[0]
            known = by_words.get(words.tobytes())
            if len(words) >= SEED_WORDS:
                ids = [x for x in (row["id"], known and known[0]) if x is not None]
                by_words[words.tobytes()] = (min(ids, default=None), words)
        if by_words:
            ordered = sorted(by_words.values(), key=lambda x: (x[0] is None, x[0] or 0, len(x[1])))
            yield Items([x[0] for x in ordered], [x[1] for x in ordered])


def _prepared(docs: DataFrame, items: DataFrame, item_id: str, item_text: str) -> list:
    arrow_batches(docs.sparkSession)
    found = []
    for block in _blocks(items, item_id, item_text):
        names = ("ids", "words", "sizes", "seed", "seed_item", "seed_at")
        found.append(docs.sparkSession.sparkContext.broadcast(SimpleNamespace(**{n: getattr(block, n) for n in names})))
    return found


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: float = LEAST,
) -> DataFrame:
    """One row per document and test item it holds: ids, ``score`` (share of a full copy's score), ``from_word, to_word``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Every three words in a row of an item are a seed, however
    common. Around each seed that a text holds, text and item are aligned (match 2, other word -1, gap -1) and the best
    alignment counts from half of a full copy's score on. A copy that shares no three words in a row with its item is not seen.

    Seeds and items of a block (at most 200,000 words or one item) go to all tasks; with more items, the documents
    are read once for each further block. Documents are never shuffled. Null and empty texts match nothing; items of fewer than three words cannot be told
    from prose and are not searched for; equal items are one, called by the smallest id; repeated rows
    give repeated results; rows without an id are reported without one.
    """
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    schema = f"`{id_column}` bigint, `{item_id}` bigint, score double, from_word bigint, to_word bigint"
    result = None
    for shared in _prepared(docs, items, item_id, item_text):
        part = rows.mapInArrow(_report(shared, least, (id_column, item_id)), schema)
        result = part if result is None else result.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if result is None else result


def clean(docs: DataFrame, items: DataFrame, text_column: str = "text", least: float = LEAST) -> DataFrame:
    """The documents that hold no test item; all columns stay as they are."""
    for shared in _prepared(docs, items, "item_id", "text"):
        docs = docs.mapInArrow(_without(shared, least, text_column), docs.schema)
    return docs


def _report(shared, least: float, names: tuple[str, str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, items = Words(), shared.value
        for batch in batches:
            rows = []
            for doc, words in zip(batch.column("id").to_pylist(), hasher.of_many(text_bytes(batch, "text"))):
                for item, score, first, end in matches(words, items, least):
                    rows.append((doc, items.ids[item], score / (MATCH * len(items.words[item])), first, end))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*names, "score", "from_word", "to_word"])

    return run


def _without(shared, least: float, column: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, items = Words(), shared.value
        for batch in batches:
            keep = [not matches(words, items, least) for words in hasher.of_many(text_bytes(batch, column))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run
