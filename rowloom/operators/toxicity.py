"""A toxicity score learnt from labelled rows: logistic regression over hashed runs of words."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.session import written

# Slots of the hashed runs; a model has one weight for each.
SLOTS = 1 << 18
LEAST_TEXTS = 10
PENALTY = 0.1
ROUNDS = 60
WORD = r"[\p{L}\p{N}']+"
BETWEEN = r"[^\p{L}\p{N}']+"
SCORE = "toxicity"
BLOCK_BYTES = 1 << 22  # bytes of texts that are scored together


def word_runs(text: Column) -> Column:
    """Runs of one and of two words of the whole text, in lower case; none for a null text."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))

    def runs(words: Column) -> Column:
        following = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
        return F.concat(words, F.slice(following, 1, F.greatest(F.size(words) - 1, F.lit(0))))

    # The words are made once, not once for each place they are used.
    return F.get(F.transform(F.array(words), runs), F.lit(0))


def _with_runs(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("__runs", word_runs(F.col(text)))


def train_toxicity(labelled: DataFrame, text: str, label: str) -> PipelineModel:
    """Learn from all rows with a label (0 or 1); rows without one are left out.

    A run of words counts once per text, by the logarithm of how rare it is, and not at all in fewer than ``LEAST_TEXTS`` texts. Each step adds
    the gradients of all rows up in a tree of tasks; the driver holds two vectors of ``SLOTS`` numbers. Texts are read once: their slots are
    written to the shared folder. Where all labels are alike, that label is the answer for every text.
    """
    rows = _with_runs(labelled.filter(F.col(label).isNotNull()).select(F.col(text), F.col(label).cast("double").alias("__label")), text)
    hashed = HashingTF(numFeatures=SLOTS, binary=True, inputCol="__runs", outputCol="__counts")
    counted = written(hashed.transform(rows).select("__counts", "__label"), "runs")
    if counted.isEmpty():
        raise ValueError("no labelled rows")
    weighed = IDF(minDocFreq=LEAST_TEXTS, inputCol="__counts", outputCol="__features").fit(counted)
    names = {"featuresCol": "__features", "labelCol": "__label", "rawPredictionCol": "__raw", "probabilityCol": "__probability", "predictionCol": "__predicted"}
    fit = LogisticRegression(**names, regParam=PENALTY, maxIter=ROUNDS, aggregationDepth=3, standardization=False)
    return PipelineModel([hashed, weighed, fit.fit(weighed.transform(counted))])


def slots_of(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The slots ``HashingTF`` gives to stretches of a buffer of bytes: Murmur3 of 32 bits with seed 42."""
    u32 = np.uint32
    padded = np.concatenate((data, np.zeros(4, np.uint8))).astype(u32)
    fours = padded[:-3] | padded[1:-2] << u32(8) | padded[2:-1] << u32(16) | padded[3:] << u32(24)

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return x << u32(by) | x >> u32(32 - by)

    def mixed(k: np.ndarray) -> np.ndarray:
        return turned(k * u32(0xCC9E2D51), 15) * u32(0x1B873593)

    sizes = ends - begins
    # Longest first, so that those with a further block are at the front.
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = begins[order], sizes[order]
    h, blocks = np.full(len(sizes), 42, u32), sizes // 4
    for block in range(int(blocks[0]) if len(blocks) else 0):
        here = np.searchsorted(-blocks, -block, "left")
        h[:here] = turned(h[:here] ^ mixed(fours[begins[:here] + 4 * block]), 13) * u32(5) + u32(0xE6546B64)
    rest = (u32(1) << (8 * (sizes % 4)).astype(u32)) - u32(1)
    h ^= mixed(fours[begins + 4 * blocks] & rest) ^ sizes.astype(u32)
    h = (h ^ h >> u32(16)) * u32(0x85EBCA6B)
    h = (h ^ h >> u32(13)) * u32(0xC2B2AE35)
    found = np.empty(len(h), np.int64)
    found[order] = (h ^ h >> u32(16)) % u32(SLOTS)
    return found


def _sums(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The sum of the weights of each text's slots, each once; words are apart by blanks."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    # Borders lie before each byte and after the last one; a text's border parts words as a blank does.
    blank = np.concatenate(([True], data == ord(" "), [True]))
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    begins = np.flatnonzero(~blank[1:] & (blank[:-1] | border))
    ends = np.flatnonzero(~blank[:-1] & (blank[1:] | border))
    rows = np.searchsorted(offsets, begins, "right") - 1
    pairs = np.flatnonzero(rows[1:] == rows[:-1])
    slots = slots_of(data, np.concatenate((begins, begins[pairs])), np.concatenate((ends, ends[pairs + 1])))
    # Sorting is faster here than the hash table behind numpy's unique.
    keys = np.sort(np.concatenate((rows, rows[pairs])) * SLOTS + slots)
    keys = keys[np.diff(keys, prepend=-1) > 0]
    return np.bincount(keys // SLOTS, weights[keys % SLOTS], len(texts))


def _scorer(weights: np.ndarray, intercept: float) -> Callable[[pa.Array], pa.Array]:
    def run(texts: pa.Array) -> pa.Array:
        found, at = [], 0
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
        while at < len(texts):
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + BLOCK_BYTES, "right")))
            found.append(_sums(texts.slice(at, to - at), weights))
            at = to
        with np.errstate(over="ignore"):
            return pa.array(1 / (1 + np.exp(-(np.concatenate([np.zeros(0), *found]) + intercept))))

    return run


def score_toxicity(df: DataFrame, model: PipelineModel, text: str, name: str = SCORE) -> DataFrame:
    """Add ``name``: the probability that a text is toxic; null for a null text.

    The model's transformations in one step: each slot's weight is its rareness times its coefficient, and the runs are hashed where
    they lie in the text, a batch of texts at a time.
    """
    weights, fit = model.stages[1].idf.toArray() * model.stages[2].coefficients.toArray(), model.stages[2]
    probability = F.arrow_udf(_scorer(weights, fit.intercept), "double")
    given = F.col(text).cast("string")
    words = F.regexp_replace(F.lower(F.coalesce(given, F.lit(""))), BETWEEN, " ")
    score = F.when(given.isNotNull(), probability(words))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != name], score.alias(name))


def area_under_curve(scored: DataFrame, label: str, name: str = SCORE) -> float:
    """How often a toxic row scores above one that is not; rows without label or score are left out."""
    rows = scored.filter(F.col(label).isNotNull() & F.col(name).isNotNull()).select(F.col(name).alias("s"), F.col(label).cast("double").alias("l"))
    return BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="l", numBins=0).evaluate(rows)
