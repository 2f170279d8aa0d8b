"""Token ids of documents in files of Simple-8b words, written and read by Spark tasks.

A file holds the ids of its documents one after another, cut into blocks of ``BLOCK_IDS``:

    magic | words of block 0 | its escapes | words of block 1 | ... | footer | length of the footer | magic

A word has 64 bits: a selector of four bits on top tells how many ids of which width lie in the other 60.
Selector 0 is an escape: its word holds a place in the block's list of escapes, which are ids of more than 60 bits, stored
whole. The footer has, for each block, where it begins, how many words, escapes and ids it has, and for each
document its id and number of tokens. A block is decoded without its neighbours, one numpy step per selector.
"""

from __future__ import annotations

import json
import os
import struct
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import U64, arrow_batches, small_table
from rowloom.session import fresh_path, written

MAGIC = b"S8BIDS01"
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 25  # about 64 MB; a longer document makes a longer file
FILE_DOCUMENTS = 1 << 20
KEPT_WORDS = 1 << 20  # words whose ids a worker remembers
KEPT_IDS = 1 << 23
JOINED = 64
GATHERED = 1 << 23  # bytes of texts that are encoded together at least, if a task has as many
TAIL = ".,;:!?"
NO_ID = -(1 << 63)

# Selector s packs COUNTS[s] ids of WIDTHS[s] bits.
COUNTS = np.array([1, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
WIDTHS = np.array([64, *(60 // COUNTS[1:])])

# What a folder's scheme is called by pyarrow.
SCHEMES = {"": "", "file": "", "dbfs": "/dbfs", "s3": "s3", "s3a": "s3", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs", "abfs": "abfs", "abfss": "abfss"}


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; an unknown scheme is an error that names it."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.FileSystem.from_uri(path)
    if scheme not in SCHEMES:
        raise ValueError(f"cannot write files to {scheme}: name a folder of one of {sorted(s for s in SCHEMES if s)}")
    known = SCHEMES[scheme]
    if known == "" or known.startswith("/"):
        return fs.FileSystem.from_uri(known + "/" + rest.lstrip("/"))
    return fs.FileSystem.from_uri(f"{known}:{rest}")


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One block of unsigned 64-bit ids as words and escapes: each word takes as many ids as fit."""
    most = int(COUNTS[-1])
    bits = np.zeros(len(ids) + most, np.uint8)
    # A double rounds ids of 54 bits and more up, which can only make a width too generous.
    bits[: len(ids)] = np.frexp(ids.astype(np.float64))[1]
    widest, chosen, size = {1: bits}, np.zeros(len(bits), np.uint8), 1
    chosen[bits <= WIDTHS[1]] = 1
    for selector in range(2, len(COUNTS)):
        count = int(COUNTS[selector])
        step = count - size
        # The widest of `count` ids is that of the first `size` and of the last `size` of them.
        window = np.zeros_like(bits)
        window[: len(bits) - step] = np.maximum(widest[size][: len(bits) - step], widest[size][step:])
        widest, size = {count: window}, count
        chosen[window <= WIDTHS[selector]] = selector
    jumps = COUNTS[chosen].tolist()
    starts, at = [], 0
    while at < len(ids):
        starts.append(at)
        at += jumps[at]
    starts = np.array(starts, np.int64)
    selectors = chosen[starts]
    words = selectors.astype(np.uint64) << U64(60)
    padded = np.concatenate((ids, np.zeros(most, np.uint64)))
    for selector in np.unique(selectors[selectors > 0]):
        here = np.flatnonzero(selectors == selector)
        places = np.arange(COUNTS[selector])
        shifted = padded[starts[here, None] + places] << (places * WIDTHS[selector]).astype(np.uint64)
        words[here] |= np.bitwise_or.reduce(shifted, axis=1)
    escaped = np.flatnonzero(selectors == 0)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    return words, ids[starts[escaped]]


def unpack(words: np.ndarray, escapes: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` ids of a block."""
    selectors = (words >> U64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[selectors])
    starts = ends - COUNTS[selectors]
    ids = np.zeros(max(count, int(ends[-1]) if len(ends) else 0), np.uint64)
    for selector in np.unique(selectors):
        here = np.flatnonzero(selectors == selector)
        if selector == 0:
            ids[starts[here]] = escapes[words[here].astype(np.int64)]
            continue
        places = np.arange(COUNTS[selector])
        shifted = words[here, None] >> (places * WIDTHS[selector]).astype(np.uint64)
        ids[starts[here, None] + places] = shifted & U64((1 << int(WIDTHS[selector])) - 1)
    return ids[:count]


class FileWriter:
    """Streams documents into one file; only the open block and the footer's lists are held."""

    def __init__(self, sink) -> None:
        self.sink, self.at, self.ids = sink, len(MAGIC), 0
        self.blocks: list[tuple[int, int, int, int]] = []
        self.documents: list[tuple[int, bool, int]] = []
        self.waiting: list[np.ndarray] = []
        self.held = 0
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.documents.append((NO_ID if doc_id is None else doc_id, doc_id is None, len(ids)))
        self.waiting.append(ids)
        self.held += len(ids)
        self.ids += len(ids)
        if self.held >= BLOCK_IDS:
            whole = np.concatenate(self.waiting)
            cut = len(whole) // BLOCK_IDS * BLOCK_IDS
            for begin in range(0, cut, BLOCK_IDS):
                self._block(whole[begin : begin + BLOCK_IDS])
            self.waiting, self.held = [whole[cut:].copy()], len(whole) - cut

    def _block(self, ids: np.ndarray) -> None:
        words, escapes = pack(ids.astype(np.uint64))
        self.sink.write(words.astype("<u8").tobytes())
        self.sink.write(escapes.astype("<u8").tobytes())
        self.blocks.append((self.at, len(words), len(escapes), len(ids)))
        self.at += 8 * (len(words) + len(escapes))

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.waiting))
        names = ("<i8", "?", "<i8")
        footer = struct.pack("<QQ", len(self.blocks), len(self.documents)) + np.array(self.blocks, "<i8").tobytes()
        footer += b"".join(np.array(column, kind).tobytes() for column, kind in zip(zip(*self.documents), names))
        self.sink.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.sink.close()


def footer_of(source) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks (begin, words, escapes, ids) and the documents' ids, null marks and token counts."""
    size = source.size()
    length, magic = struct.unpack("<Q8s", source.read_at(16, size - 16))
    if magic != MAGIC or source.read_at(len(MAGIC), 0) != MAGIC:
        raise ValueError("not a file of token ids")
    footer = source.read_at(length, size - 16 - length)
    blocks, documents = struct.unpack_from("<QQ", footer)
    at = 16 + 32 * blocks
    table = np.frombuffer(footer, "<i8", 4 * blocks, 16).reshape(blocks, 4)
    doc_ids = np.frombuffer(footer, "<i8", documents, at)
    null = np.frombuffer(footer, "?", documents, at + 8 * documents)
    return table, doc_ids, null, np.frombuffer(footer, "<i8", documents, at + 9 * documents)


def _pieces(word: str) -> int:
    """Into how many parts a tokenizer cuts a word of letters, closing marks behind it or both; 0 for any other."""
    stem = word.rstrip(TAIL)
    if stem and not (stem.isalpha() and stem.lower().isalpha()):
        return 0
    return bool(stem) + (len(stem) < len(word))


def _byte_level(path: str) -> bool:
    """Whether the file lower-cases and then knows bytes by letters, so that an ASCII word is its own lower-case text."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    steps = [(told.get(name) or {}).get(parts, []) for name, parts in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
    return [[s["type"] for s in step] for step in steps] == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] and not steps[1][1]["add_prefix_space"]


def _with_room(values: np.ndarray, used: int, wanted: int) -> np.ndarray:
    """An array that has place for ``wanted`` values, the first ``used`` as before."""
    if wanted <= len(values):
        return values
    grown = np.empty(max(wanted, 2 * len(values)), values.dtype)
    grown[:used] = values[:used]
    return grown


class Encoder:
    """Texts to ids by a tokenizer that treats words between white space by themselves.

    Words a batch repeats are encoded once, and a worker remembers the ids of up to ``KEPT_WORDS``. Only for tokenizers whose steps
    never look across ``[\\x20\\x09-\\x0D]`` and drop it, as those with word ends do.
    """

    def __init__(self, path: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.byte_level = Tokenizer.from_file(path), end_id, _byte_level(path)
        self.model = self.tokenizer.model
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        """Slot 0 has the end id; the ids of slot s lie in ``pool`` between bytes ``ends[s]`` and ``ends[s + 1]``. Both have room for more than is in use."""
        self.known: dict[str, int] = {}
        self.pool, self.ends = np.array([self.end], np.uint32), np.array([0, 4])
        self.slots_used = self.ids_used = 1

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _part(self, part: str) -> list[int]:
        return [token.id for token in self.model.tokenize(part.lower())]

    def _new(self, words: list[str]) -> list[list[int]]:
        """Ids of words not yet known: ASCII letters by the model alone, other letters many at a time, the rest one by one."""
        found: list[list[int] | None] = [None] * len(words)
        joined, single = [], []
        for i, word in enumerate(words):
            if self.byte_level and word.isascii() and word.isalpha():
                found[i] = self._part(word)
                continue
            parts = _pieces(word)
            if parts and self.byte_level and word.isascii():
                stem = word.rstrip(TAIL)
                found[i] = (self._part(stem) if stem else []) + (self._part(word[len(stem) :]) if len(stem) < len(word) else [])
            else:
                (joined if parts else single).append((i, word, parts))
        groups = [joined[k : k + JOINED] for k in range(0, len(joined), JOINED)]
        for group, ids in zip(groups, self._encoded([" ".join(w for _, w, _ in group) for group in groups])):
            # Cut where a token closes a part.
            closing = np.flatnonzero(self.closes[ids]) + 1
            counts = np.cumsum([n for _, _, n in group])
            if len(closing) == counts[-1]:
                ends = closing[counts - 1].tolist()
                for (i, _, _), begin, end in zip(group, [0, *ends], ends):
                    found[i] = ids[begin:end]
            else:
                single += group
        for (i, _, _), ids in zip(single, self._encoded([w for _, w, _ in single])):
            found[i] = ids
        return found

    def _slots(self, words: list[str]) -> np.ndarray:
        slots = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(slots < 0)
        if len(missing) and (self.slots_used + len(missing) > KEPT_WORDS or self.ids_used > KEPT_IDS):
            self._forget()
            missing = np.arange(len(words))
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            ids = self._new(new)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            first, at = self.slots_used, self.ids_used
            self.slots_used, self.ids_used = first + len(ids), at + int(sizes.sum())
            # Room is doubled, so that a batch does not copy what earlier ones have brought.
            self.ends, self.pool = _with_room(self.ends, first + 1, self.slots_used + 1), _with_room(self.pool, at, self.ids_used)
            self.ends[first + 1 : self.slots_used + 1] = 4 * (at + np.cumsum(sizes))
            self.pool[at : self.ids_used] = np.fromiter(chain.from_iterable(ids), np.uint32, self.ids_used - at)
            self.known.update(zip(new, range(first, first + len(new))))
            slots[missing] = np.arange(first, first + len(new))
        return slots

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, the end id last; a null text has only that."""
        words = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        flat = words.flatten().dictionary_encode()
        slots = np.append(self._slots(flat.dictionary.to_pylist()), 0)
        # The end of a text is a word of its own after the text's words.
        after = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))
        code = np.insert(flat.indices.to_numpy(zero_copy_only=False), after, len(slots) - 1)
        # The ids of a word are copied as one stretch of bytes.
        pool = pa.LargeBinaryArray.from_buffers(pa.large_binary(), self.slots_used, [None, pa.py_buffer(self.ends), pa.py_buffer(self.pool)])
        found = pool.take(pa.array(slots[code]))
        ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)[1:] // 4
        cuts = ends[after + np.arange(len(after))]
        return np.split(np.frombuffer(found.buffers()[2], np.uint32, int(cuts[-1]) if len(cuts) else 0), cuts[:-1])


def _encoder(path: str, end_id: int) -> Encoder:
    """The worker process's encoder: the words it knows outlive a task."""
    kept = sys.modules.setdefault("rowloom_encoders", types.ModuleType("rowloom_encoders")).__dict__.setdefault("encoders", {})
    if (path, end_id) not in kept:
        kept.clear()
        kept[path, end_id] = Encoder(path, end_id)
    return kept[path, end_id]


def write_ids(documents: DataFrame, folder: str, tokenizer: str, end_id: int, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of all rows of ``doc_id, text`` below ``folder``; return ``part, number, path, ids_before, ids``.

    Documents lie in ascending order of their ids, null ids first; rows of one id by a hash of the text. A null
    text is an empty one. A task writes its documents into files one after another;
    ``ids_before`` counts the ids in its earlier files. Files get new names in every attempt and only those of finished
    tasks are listed, so a task may be lost and run again. ``tokenizer`` is a path that every executor has.
    """
    spark = documents.sparkSession
    store_of(folder)
    arrow_batches(spark)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # The last column only deals equal rows to several tasks.
    order = ["doc_id", "digest", "spread"]
    rows = rows.withColumns({"digest": F.xxhash64("text"), "spread": F.monotonically_increasing_id()})
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions("doc_id", "digest", "text", "spread").select("doc_id", "text")
    schema = "part int, number int, path string, ids_before bigint, ids bigint"
    return written(rows.mapInArrow(_write(folder, tokenizer, end_id, file_ids), schema), "id-files")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    """Ids and texts of several batches together, so that words are looked up once for all of them."""
    ids, texts, size = [], [], 0
    for batch in batches:
        ids += batch.column("doc_id").to_pylist()
        texts.append(batch.column("text").cast(pa.large_string()))
        size += texts[-1].nbytes
        if size >= GATHERED:
            yield ids, pa.concat_arrays(texts)
            ids, texts, size = [], [], 0
    if ids:
        yield ids, pa.concat_arrays(texts)


def _write(folder: str, tokenizer: str, end_id: int, file_ids: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, part, file, before, done = None, TaskContext.get().partitionId(), None, 0, []
        for doc_ids, texts in _gathered(batches):
            encode = encode or _encoder(tokenizer, end_id)
            for doc_id, ids in zip(doc_ids, encode(texts)):
                if file is None:
                    store, base = store_of(folder)
                    store.create_dir(base, recursive=True)
                    name = f"ids-{uuid.uuid4().hex}.s8b"
                    file = FileWriter(store.open_output_stream(f"{base}/{name}"))
                file.add(doc_id, ids)
                if file.ids >= file_ids or len(file.documents) >= FILE_DOCUMENTS:
                    file.close()
                    done.append((part, len(done), f"{folder}/{name}", before, file.ids))
                    before, file = before + file.ids, None
        if file is not None:
            file.close()
            done.append((part, len(done), f"{folder}/{name}", before, file.ids))
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        columns = list(zip(*done)) if done else [()] * len(kinds)
        names = ["part", "number", "path", "ids_before", "ids"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def read_ids(spark: SparkSession, files: DataFrame, id_bytes: int = 4) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of all documents of the files that ``write_ids`` listed.

    ``start`` counts the ids of all earlier documents; ``ids`` are little-endian unsigned numbers of ``id_bytes`` bytes.
    The driver sees one total per writing task; a reading task holds a block and a document.
    """
    totals = files.groupBy("part").agg(F.sum("ids").alias("ids")).orderBy("part").collect()
    shifts, at = [], 0
    for row in totals:
        shifts.append((row["part"], at))
        at += row["ids"]
    placed = files.join(F.broadcast(small_table(spark, shifts, "part int, shift bigint")), "part")
    placed = placed.select("path", (F.col("shift") + F.col("ids_before")).alias("start"))
    spread = placed.repartition(max(1, min(files.count(), 10_000)))
    return spread.mapInArrow(_read(id_bytes), "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def _blocks(source, table: np.ndarray) -> Iterator[np.ndarray]:
    for begin, words, escapes, ids in table.tolist():
        data = np.frombuffer(source.read_at(8 * (words + escapes), begin), "<u8")
        yield unpack(data[:words], data[words:], ids)


def _read(id_bytes: int) -> Callable:
    names, kinds = ["doc_id", "start", "n_tokens", "ids"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def rows_of(path: str, start: int) -> Iterator[tuple]:
        store, inner = store_of(path)
        with store.open_input_file(inner) as source:
            table, doc_ids, null, counts = footer_of(source)
            blocks, waiting = _blocks(source, table), np.zeros(0, np.uint64)
            for doc_id, missing, count in zip(doc_ids.tolist(), null.tolist(), counts.tolist()):
                pieces, held = [waiting], len(waiting)
                while held < count:
                    pieces.append(next(blocks))
                    held += len(pieces[-1])
                ids = np.concatenate(pieces) if len(pieces) > 1 else waiting
                waiting = ids[count:]
                yield None if missing else doc_id, start, count, ids[:count].astype(f"<u{id_bytes}").tobytes()
                start += count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                rows, size = [], 0
                for row in rows_of(path, start):
                    rows.append(row)
                    size += row[2]
                    if size >= BLOCK_IDS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def round_trip(documents: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the ids into new files in the shared folder and read these again."""
    spark = documents.sparkSession
    return read_ids(spark, write_ids(documents, fresh_path(spark, "token-ids"), tokenizer, end_id))
