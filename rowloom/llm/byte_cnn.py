"""Language identification with a byte convolutional network, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm.common import arrow_batches, quoted, text_bytes, written

WINDOW = 128  # bytes that are judged together
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 16, 8
SAMPLE_TEXTS = 400  # labelled texts per language that are learned from
SAMPLE_WINDOWS = 6  # windows of each
EPOCHS, BATCH, RATE = 6, 64, 0.004
CHUNK = 1024  # windows that are judged at once
UNKNOWN = "und"


def byte_classes() -> np.ndarray:
    """A-Z as a-z, all digits as one, all blanks as one."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[48:58] = 48
    table[[9, 10, 11, 12, 13]] = 32
    return table


def windows(data: bytes) -> np.ndarray:
    """All bytes of a text in rows of ``WINDOW``; the last row is filled up with blanks."""
    values = byte_classes()[np.frombuffer(data, np.uint8)]
    rows = max(1, -(-len(values) // WINDOW))
    out = np.full(rows * WINDOW, 32, np.uint8)
    out[: len(values)] = values
    return out.reshape(rows, WINDOW)


class Network:
    """Embedding, convolutions of several widths, maximum over the window, softmax."""

    def __init__(self, classes: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, 0.5, (256, EMBEDDING)), "w": np.zeros((len(WIDTHS) * FILTERS, classes)), "b": np.zeros(classes)}
        for w in WIDTHS:
            self.p[f"f{w}"] = rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w * EMBEDDING, FILTERS))
            self.p[f"c{w}"] = np.zeros(FILTERS)

    def train(self, data: np.ndarray, labels: np.ndarray, seed: int = 11) -> None:
        rng, step = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for _ in range(EPOCHS):
            order = rng.permutation(len(data))
            for at in range(0, len(order), BATCH):
                pick, step = order[at : at + BATCH], step + 1
                for k, g in self._gradient(data[pick], labels[pick]).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.p[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def _gradient(self, data: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(data)
        embedded = p["e"][data]
        pooled, kept = [], []
        for w in WIDTHS:
            parts = np.concatenate([embedded[:, j : WINDOW - w + 1 + j] for j in range(w)], axis=2)
            out = parts @ p[f"f{w}"] + p[f"c{w}"]
            best = out.argmax(1)
            value = np.take_along_axis(out, best[:, None], 1)[:, 0]
            pooled.append(np.maximum(value, 0))
            kept.append((parts, best, value > 0))
        features = np.concatenate(pooled, axis=1)
        chance = softmax(features @ p["w"] + p["b"])
        wrong = chance.copy()
        wrong[np.arange(n), labels] -= 1
        wrong /= n
        grads = {"w": features.T @ wrong, "b": wrong.sum(0), "e": np.zeros_like(p["e"])}
        back = wrong @ p["w"].T
        for i, w in enumerate(WIDTHS):
            parts, best, live = kept[i]
            g = back[:, i * FILTERS : (i + 1) * FILTERS] * live
            chosen = parts[np.arange(n)[:, None], best]  # rows x filters x inputs
            grads[f"f{w}"] = np.einsum("nfi,nf->if", chosen, g)
            grads[f"c{w}"] = g.sum(0)
            inputs = (g[:, :, None] * p[f"f{w}"].T[None]).reshape(n, FILTERS, w, EMBEDDING)
            places = data[np.arange(n)[:, None, None], best[:, :, None] + np.arange(w)]
            np.add.at(grads["e"], places.reshape(-1), inputs.reshape(-1, EMBEDDING))
        return grads


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Judge:
    """The trained network with its convolutions as tables over pairs of neighbouring bytes."""

    def __init__(self, p: dict[str, np.ndarray]) -> None:
        self.w, self.b, self.tables = p["w"], p["b"], {}
        for w in WIDTHS:
            taps = [(p["e"] @ p[f"f{w}"][j * EMBEDDING : (j + 1) * EMBEDDING]).astype(np.float32) for j in range(w)]
            taps[0] = taps[0] + p[f"c{w}"].astype(np.float32)
            pairs = [(taps[j][:, None] + taps[j + 1][None]).reshape(-1, FILTERS) for j in range(0, w - 1, 2)]
            self.tables[w] = pairs, (taps[-1] if w % 2 else None)

    def chances(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of each language for each window."""
        pair = rows[:, :-1].astype(np.int32) * 256 + rows[:, 1:]
        pooled = []
        for w, (pairs, last) in self.tables.items():
            size = WINDOW - w + 1
            out = pairs[0][pair[:, :size]]
            for j, table in enumerate(pairs[1:], 1):
                out += table[pair[:, 2 * j : 2 * j + size]]
            if last is not None:
                out += last[rows[:, w - 1 : w - 1 + size]]
            pooled.append(np.maximum(out.max(1), 0))
        return softmax(np.concatenate(pooled, axis=1) @ self.w + self.b)

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all windows of each text, window by window in bounded pieces."""
        total = np.zeros((len(texts), len(self.b)))
        waiting, owners, size = [], [], 0
        for i, text in enumerate([*texts, None]):
            for piece in [] if text is None else range(0, max(1, len(text)), CHUNK * WINDOW):
                own = windows(text[piece : piece + CHUNK * WINDOW])
                waiting.append(own)
                owners.append(np.full(len(own), i))
                size += len(own)
                if size >= CHUNK:
                    self._add(total, waiting, owners)
                    waiting, owners, size = [], [], 0
        if waiting:
            self._add(total, waiting, owners)
        return total / total.sum(1, keepdims=True)

    def _add(self, total: np.ndarray, waiting: list, owners: list) -> None:
        rows, of = np.concatenate(waiting), np.concatenate(owners)
        for at in range(0, len(rows), CHUNK):
            np.add.at(total, of[at : at + CHUNK], self.chances(rows[at : at + CHUNK]))


def held_out(id_column: str) -> Column:
    """Rows that are never learned from: every fifth by the checksum of the id."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", texts: int = SAMPLE_TEXTS) -> tuple[list[str], dict]:
    """Languages and weights, learned from at most ``texts`` labelled texts per language that are not held out.

    The texts are those with the smallest hash, repeated rows once, each with up to 6 of its windows of 128 bytes, spread
    evenly over it. That sample is all the driver gets.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).cast("string").alias("text"), F.col(label_column).cast("string").alias("lang"))
    known = rows.filter(F.col("lang").isNotNull() & has_letter("text") & ~held_out("id"))
    keyed = known.withColumn("h", F.xxhash64("id", "text"))
    # Places first, texts after: only ids, languages and hashes are ranked.
    place = F.dense_rank().over(Window.partitionBy("lang").orderBy("h"))
    first = keyed.select("lang", "h").withColumn("place", place).filter(F.col("place") <= texts).groupBy("lang").agg(F.max("h").alias("last"))
    first = written(first.select(F.col("lang").alias("of"), "last"), "sample-limits")
    sample = keyed.join(first, (F.col("lang") == F.col("of")) & (F.col("h") <= F.col("last"))).dropDuplicates(["lang", "h"])
    found = sample.select("lang", "h", "text").mapInArrow(_some_windows, "lang string, h bigint, window binary")
    table = found.toArrow().sort_by([("lang", "ascending"), ("h", "ascending"), ("window", "ascending")])
    if not table.num_rows:
        return [], {}
    names = sorted(set(table.column("lang").to_pylist()))
    number = {n: i for i, n in enumerate(names)}
    labels = np.array([number[x] for x in table.column("lang").to_pylist()])
    data = np.frombuffer(b"".join(table.column("window").to_pylist()), np.uint8).reshape(-1, WINDOW)
    network = Network(len(names))
    network.train(data, labels)
    return names, network.p


def _some_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, found = [], []
        for i, text in enumerate(text_bytes(batch, "text")):
            own = windows(text)
            for j in np.unique(np.linspace(0, len(own) - 1, SAMPLE_WINDOWS).astype(int)):
                rows.append(i)
                found.append(own[j].tobytes())
        kept = batch.select(["lang", "h"]).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.binary())], names=["lang", "h", "window"])


def has_letter(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string").rlike("\\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: tuple[list[str], dict], text_column: str = "text") -> DataFrame:
    """All columns with ``lang_pred`` and ``score``; columns of these names are replaced.

    The whole text is judged in windows of 128 bytes; ``score`` is the mean probability of the
    language with the largest one, ties to the first in code point order. A text that is null or has no letter is
    ``und`` with score 0, and so is every text if nothing was learned. Texts do not influence each other.
    """
    names, weights = model
    arrow_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    fields = [docs.schema[c] for c in kept]
    rows = docs.select(*[F.col(quoted(c)) for c in kept], F.when(has_letter(quoted(text_column)), F.col(quoted(text_column)).cast("string")).alias("__text"))
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_judge(names, weights), schema)


def _judge(names: list[str], weights: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(weights) if names else None
        for batch in batches:
            texts = text_bytes(batch, "__text")
            asked = [i for i, t in enumerate(texts) if t is not None and judge]
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if asked:
                chance = judge.texts([texts[i] for i in asked])
                for i, c in zip(asked, chance):
                    langs[i], scores[i] = names[int(c.argmax())], min(1.0, float(c.max()))
            kept = batch.select([n for n in batch.schema.names if n != "__text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(langs), pa.array(scores)], names=[*kept.schema.names, "lang_pred", "score"])

    return run


def accepted(docs: DataFrame, least: float = 0.35) -> DataFrame:
    """The documents whose language is recognised with a score of at least ``least``; columns stay as they are."""
    marked = identify(docs.select(F.col("text"), F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row")), train(docs))
    return marked.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
