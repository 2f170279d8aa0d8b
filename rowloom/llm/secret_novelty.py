"""Secrets in text: patterns, and strings that a primed compressor cannot shorten."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import arrow_batches, text_bytes

# The base patterns. Bytes patterns know ASCII letters only, in either case where it says so.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX_BYTES, TOKEN_BYTES = b"0123456789abcdef", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "novel")

# Candidates of the compressor: long strings of letters and digits a little after a word that promises a secret.
CANDIDATE_LEAST = 16
SENSITIVE = re.compile(rb"pass|secret|token|key|auth|credential|private|signature|bearer", re.IGNORECASE)
NEAR, AROUND = 48, 512  # bytes before a candidate that are searched for such a word; bytes of text it is compared with
BITS = 3.5  # bits per character that a secret costs at least
PARTS = re.compile(rb"[^=]+=*$|[^=]+")  # what "=" parts, as in KEY=value; at the end of a run it is padding
LETTERS = re.compile(rb"[A-Z]?[a-z]{3,}|[A-Z]{4,}")
IDENTIFIERS = 4096  # most common parts of identifiers that prime the compressor
LEVEL = 3


def runs(data: np.ndarray, member: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Longest runs of bytes in ``member`` that have at least ``least`` bytes."""
    edge = np.concatenate(([False], member[data], [False]))
    change = np.flatnonzero(edge[1:] != edge[:-1])
    starts, ends = change[::2], change[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def members_of(values: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


def base_spans(text: bytes, hexadecimal: np.ndarray) -> list[tuple[int, int, int]]:
    """``start, kind number, end`` in bytes, leftmost and not overlapping within each kind."""
    found, lower = [], text.lower()
    if any(word in lower for word in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(a, 2, b) for a, b in runs(np.frombuffer(text, np.uint8), hexadecimal, HEX_LEAST)]
    return sorted(found)


class Novelty:
    """Bytes that a string adds to its surroundings once compressed, with known identifiers as dictionary."""

    def __init__(self, identifiers: bytes) -> None:
        known = None
        if len(identifiers) >= 8:
            known = zstandard.ZstdCompressionDict(identifiers, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)

    def bits(self, around: bytes, candidate: bytes) -> float:
        """Marginal compressed bits per character."""
        return 8 * (len(self.packer.compress(around + candidate)) - len(self.packer.compress(around))) / len(candidate)


def candidates(text: bytes, member: np.ndarray) -> list[tuple[int, int]]:
    found = []
    for start, end in runs(np.frombuffer(text, np.uint8), member, CANDIDATE_LEAST):
        for part in PARTS.finditer(text[start:end]):
            a, word = start + part.start(), part[0]
            word = word.rstrip(b".=-") if word[-1:] in (b".", b"-") else word
            mixed = re.search(rb"[0-9]", word) or (re.search(rb"[a-z]", word) and re.search(rb".[A-Z]", word))
            if len(word) >= CANDIDATE_LEAST and mixed and re.search(rb"[A-Za-z]", word):
                found.append((a, a + len(word)))
    return found


def surroundings(text: bytes, a: int, b: int) -> bytes:
    """The text around a candidate without the candidate and its copies, whole or cut by the window."""
    word, at, high = text[a:b], max(0, a - AROUND), b + AROUND
    pieces, copy = [], text.find(word, max(0, at - len(word) + 1))
    while 0 <= copy < high:
        pieces.append(text[at:copy] if copy > at else b"")
        at = max(at, copy + len(word))
        copy = text.find(word, at)
    return b"".join([*pieces, text[at:high]])


def novel_spans(text: bytes, member: np.ndarray, novelty: Novelty, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """All places of the strings that are novel at one of them at least."""
    free = [(a, b) for a, b in candidates(text, member) if not any(s < b and a < e for s, _, e in taken)]
    novel = set()
    for a, b in free:
        word = text[a:b]
        if word not in novel and SENSITIVE.search(text[max(0, a - NEAR) : a]) and novelty.bits(surroundings(text, a, b), word) >= BITS:
            novel.add(word)
    return [(a, 3, b) for a, b in free if text[a:b] in novel]


def identifier_parts(docs: DataFrame, text_column: str = "text", count: int = IDENTIFIERS) -> bytes:
    """The words (``Customer``, ``customer``, ``CUSTOMER``) that most documents hold within long strings, the most common last, as a dictionary.

    All documents are counted; the ``count`` most common parts are all the driver gets.
    """
    arrow_batches(docs.sparkSession)
    parts = docs.select(F.col(text_column).cast("string").alias("text")).mapInArrow(_parts, "part string")
    counted = parts.groupBy("part").agg(F.count("*").alias("n")).filter("n > 1")
    best = counted.orderBy(F.col("n").desc(), "part").limit(count).toArrow().column("part").to_pylist()
    return " ".join(reversed(best)).encode()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    member = members_of(TOKEN_BYTES)
    for batch in batches:
        found = []
        for text in text_bytes(batch, "text"):
            own = set()
            for a, b in runs(np.frombuffer(text or b"", np.uint8), member, CANDIDATE_LEAST):
                own.update(LETTERS.findall(text[a:b]))
            found += sorted(x.decode() for x in own)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["part"])


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id and ``spans``, an array of ``kind, start, end`` in code points, by start, then kind.

    Kinds: ``assign``, ``access`` and ``hex`` are the base patterns. ``novel`` are strings of 16 or more
    of ``A-Za-z0-9+/_.=-`` with a letter and a digit or letters of both cases, outside of base spans, up to 48 bytes after
    a word such as password, key or auth (``KEY=value`` is measured as a name and a value), that add at least 3.5 bits per character to the compressed
    text around them (512 bytes on each side, without their own copies). The compressor is primed with the parts of identifiers
    that are common in all documents, so composed names cost little. A string that is novel at one place of a text is reported at all of them.

    A null or empty text has no spans; the id may be null; repeated rows are reported each. Texts
    are read whole and never shuffled.
    """
    arrow_batches(docs.sparkSession)
    identifiers = identifier_parts(docs, text_column)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_find(identifiers), f"id {kind}, spans array<struct<kind string, start bigint, end bigint>>")
    return found.withColumnRenamed("id", id_column)


def _find(identifiers: bytes):
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty, hexadecimal, member = Novelty(identifiers), members_of(HEX_BYTES), members_of(TOKEN_BYTES)
        for batch in batches:
            rows = []
            for text in text_bytes(batch, "text"):
                text = text or b""
                found = base_spans(text, hexadecimal)
                found = sorted(found + novel_spans(text, member, novelty, found))
                if found and not text.isascii():
                    # Bytes that continue a character are not counted.
                    before = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
                    found = [(int(before[a]), k, int(before[b])) for a, k, b in found]
                rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, spans)], names=["id", "spans"])

    return run
