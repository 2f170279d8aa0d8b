"""Token ids in files of Simple-8b words."""

import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import no_documents, odd_documents, odd_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowloom.llm import token_files
from rowloom.llm.token_files import BLOCK_IDS, COUNTS, WIDTHS, Encoder, FileWriter, _blocks, footer_of, pack, read_ids, round_trip, store_of, unpack, write_ids
from rowloom.session import fresh_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def some_ids(rng, trial):
    size = int(rng.integers(1, 700))
    widths = rng.integers(0, 65, size) if trial % 3 == 0 else np.full(size, rng.integers(0, 65)) if trial % 3 == 1 else rng.integers(0, 4, size) * 20 % 65
    return np.array([int(rng.integers(0, 1 << 63)) * 2 + 1 & (1 << int(w)) - 1 for w in widths], np.uint64)


def test_blocks_come_back():
    rng = np.random.default_rng(3)
    for trial in range(200):
        ids = some_ids(rng, trial)
        words, escapes = pack(ids)
        assert np.array_equal(unpack(words, escapes, len(ids)), ids)
        assert np.array_equal(escapes, ids[ids >= 1 << 60]) or (ids >= 1 << 53).any()
    assert len(pack(np.zeros(0, np.uint64))[0]) == 0


def test_words_take_what_fits():
    """Brute force: from each place on, the most ids that fit 60 bits together."""
    rng = np.random.default_rng(4)
    for trial in range(60):
        ids = [int(x) for x in some_ids(rng, trial) if x < 1 << 53]
        at, want = 0, []
        while at < len(ids):
            fit = [s for s in range(1, len(COUNTS)) if all(x >> int(WIDTHS[s]) == 0 for x in ids[at : at + COUNTS[s]])]
            want.append((fit[-1], sum(x << int(WIDTHS[fit[-1]]) * j for j, x in enumerate(ids[at : at + COUNTS[fit[-1]]]))))
            at += int(COUNTS[fit[-1]])
        words, _ = pack(np.array(ids, np.uint64))
        assert [(int(w) >> 60, int(w) & (1 << 60) - 1) for w in words] == want


def test_one_block_is_read_alone():
    sink, ids = io.BytesIO(), np.random.default_rng(5).integers(0, 1 << 40, 3 * BLOCK_IDS + 11).astype(np.uint64)
    sink.close = lambda: None
    file = FileWriter(sink)
    file.add(7, ids[:100])
    file.add(None, ids[100:])
    file.add(9, ids[:0])
    file.close()
    source = pa.BufferReader(sink.getvalue())
    table, doc_ids, null, counts = footer_of(source)
    assert len(table) == 4 and null.tolist() == [False, True, False] and doc_ids[[0, 2]].tolist() == [7, 9] and counts.tolist() == [100, len(ids) - 100, 0]
    assert np.array_equal(next(_blocks(source, table[2:3])), ids[2 * BLOCK_IDS : 3 * BLOCK_IDS])
    with pytest.raises(ValueError):
        footer_of(pa.BufferReader(b"x" * 64))


def test_words_by_themselves_are_whole_texts(tokenizer):
    odd = ["", None, "ΑΣ ΑΣ x y", "á ́b é\x1cq\x85z", "<|endoftext|> <|startoftext|>x", "don't I'LL 12,3\x0b\x0c\r\n x", "x" * 5000, "한국어 テ 𝔘 ﷺ"]
    odd += ["'s 's' t's", "﻿ a ​ b", "ﬁ İI ǅ İ.", "a\x00b \x1f c", "... a. b, c;: d!? ?!", "KK a</w> </w>"]
    encode = Encoder(TOKENIZER, 1)
    for _ in range(2):
        assert [ids.tolist() for ids in encode(pa.array(odd))] == [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in odd]


def want_rows(rows, tokenizer):
    pairs = sorted(((r[0], r[1] or "") for r in rows), key=lambda p: (p[0] is not None, p[0] or 0))
    ids = [e.ids + [1] for e in tokenizer.encode_batch([t for _, t in pairs], add_special_tokens=False)]
    return [(doc, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (doc, _), i in zip(pairs, ids)]


@pytest.mark.parametrize("parts", [1, 7])
def test_odd_documents(spark, tokenizer, parts):
    read = round_trip(odd_documents(spark).repartition(parts), TOKENIZER)
    rows = read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.crc) for r in rows), key=str) == sorted(want_rows(odd_rows(), tokenizer), key=str)
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:i]) for i in range(len(rows))]
    told = [r.doc_id for r in rows]
    assert told == sorted(told, key=lambda i: (i is not None, i or 0))


def test_many_files_and_no_documents(spark):
    files = write_ids(odd_documents(spark), fresh_path(spark, "ids"), TOKENIZER, 1, file_ids=200)
    assert files.count() > 6 and files.filter("number > 0").count() > 0
    rows = sorted(read_ids(spark, files, 8).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:i]) for i in range(len(rows))]
    assert all(len(r.ids) == 8 * r.n_tokens and r.ids.endswith(b"\x01" + b"\0" * 7) for r in rows)
    assert round_trip(no_documents(spark), TOKENIZER).collect() == []


def test_unknown_store_is_refused_before_any_work(spark):
    with pytest.raises(ValueError, match="ftp"):
        write_ids(no_documents(spark), "ftp://host/folder", TOKENIZER, 1)
    assert store_of("file:/tmp/x")[1] == store_of("/tmp/x")[1] == store_of("file:///tmp/x")[1] == "/tmp/x"


def test_known_words_are_not_copied_and_batches_share_lookups(monkeypatch):
    encode, tokenizer = Encoder(TOKENIZER, 1), Tokenizer.from_file(TOKENIZER)
    texts = ["a Dog, café x1 &&&", "", None, " über   a ", "word" * 50] + [f"w{i} tail{i}." for i in range(300)]
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    pools = []
    for at in range(0, len(texts), 5):
        got = encode(pa.array(texts[at : at + 5], pa.string()))
        assert [g.tolist() for g in got] == want[at : at + 5]
        if not pools or pools[-1] is not encode.pool:
            pools.append(encode.pool)
        assert len(encode.pool) >= encode.ids_used
    # Sixty batches bring new words; the pool moves only when it has doubled.
    assert len(pools) < 20
    calls, batches = [], [pa.RecordBatch.from_pydict({"doc_id": [i, None], "text": ["x" * 400, "é"]}) for i in range(10)]
    monkeypatch.setattr(token_files, "GATHERED", 1000)
    for ids, part in token_files._gathered(iter(batches)):
        calls.append((ids, part.to_pylist()))
    assert 1 < len(calls) < 10
    assert [x for ids, _ in calls for x in ids] == [x for i in range(10) for x in (i, None)]
    assert [x for _, part in calls for x in part] == ["x" * 400, "é"] * 10
