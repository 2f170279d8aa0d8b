"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import Words, arrow_batches, grams, mix, signed, text_bytes, written
from rowloom.llm.components import components

# A signature has CHUNKS * WIDTH components of BITS bits. Two signatures that differ in at most
# CHUNKS * (ERRORS + 1) - 1 = 23 components have, by the pigeonhole principle, a chunk with at most
# ERRORS = 1 differing component, and so share the key made without that component.
CHUNKS, WIDTH, BITS = 12, 6, 8
GUARANTEED = 2 * CHUNKS - 1
# At a similarity of 0.8 a signature differs in 14.4 components on average, with a deviation of 3.4. Pairs beyond
# the guaranteed distance are found too unless every chunk has two errors or more: once in 400,000.
FAR = 36
BLOCK_BYTES = 8 << 20  # shingles of the classes that are compared at once
COLUMNS = 4096  # shingles that are counted at once
BINARY64, WHOLE = np.dtype("<u8"), "node bigint, signature binary, words binary"


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (smallest id reachable), ``kept``, ``text_hash``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a set holds the distinct runs of ``words``
    words, or the whole sequence if it is shorter. Two documents are linked if 100 * intersection
    is at least ``percent`` * union, counted on the full sets.

    Documents with equal sets are one class, found by hash. Classes get signatures, and each chunk
    of a signature gives one key per component left out, so that classes whose chunks differ in one
    component at most meet in a bucket. A bucket never emits all its pairs: classes with an equal chunk
    are compared with the bucket's best connected one first and what is linked becomes one component. Of the
    buckets with one error only those matter after that in which components meet, and their classes are compared
    block by block with all those of other components. So no link that could join two components is
    skipped. A pair counts after its signatures (at most 36 of 72 components differ) and its full sets have been compared.

    A null or empty text or one of blanks has an empty set and links with nothing. Rows without an
    id take no part in links and are kept. Repeated rows are copies of each other. Further columns
    are not read.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    signed_rows = rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        _signatures(words), "id bigint, text_hash bigint, n_shingles bigint, node bigint, signature binary"
    )
    all_rows = written(signed_rows, "signatures")
    classes = written(
        all_rows.filter("n_shingles > 0 AND id IS NOT NULL").groupBy("node").agg(F.min("id").alias("doc"), F.first("signature").alias("signature")), "classes"
    )
    keys = classes.select("node", "signature").mapInArrow(_chunk_keys, "bucket bigint, node bigint")
    shared = keys.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    # Only classes that meet another one in a bucket have anything to be compared with.
    wanted = written(keys.join(shared, "bucket").select("node").distinct().join(classes, "node"), "met-classes")
    linked = _link(rows, wanted, words, percent)
    smallest = linked.join(classes.select("node", "doc"), "node").groupBy("component").agg(F.min("doc").alias("least"))
    of_class = classes.select("node", "doc").join(linked.join(smallest, "component").select("node", "least"), "node", "left")
    of_class = written(of_class.select("node", F.coalesce("least", "doc").alias("component_id")), "class-components")
    found = all_rows.drop("signature").join(of_class, "node", "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")))
    return found.withColumn("component_id", component).select(
        F.col("id").alias(id_column), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash"
    )


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without all but one of each group: the smallest ``doc_id`` stays, one row of it."""
    found = near_duplicates(docs, words=words, percent=percent)
    gone = found.filter("NOT kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", F.col("row.doc_id").cast("bigint").alias("__id"), F.xxhash64(F.col("row.text").cast("string")).alias("__hash")
    )
    stays = rows.join(gone, ["__id", "__hash"], "left_anti")
    one = F.row_number().over(Window.partitionBy("__id", "__hash").orderBy(F.lit(1)))
    return stays.withColumn("__copy", one).filter("__copy = 1").select("row.*")


def _link(rows: DataFrame, met: DataFrame, words: int, percent: int) -> DataFrame:
    """``node, component`` of all classes that are linked with another one."""
    wanted = met.withColumnRenamed("doc", "id")
    sets = written(rows.join(wanted, "id").mapInArrow(_sets(words), WHOLE).dropDuplicates(["node"]), "sets")
    # Without errors: chunks that are equal as a whole, twelve rows per class.
    equal = met.select("node", "signature").mapInArrow(_whole_chunks, "bucket bigint, node bigint")
    several = equal.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    # A class in many large buckets makes a good pivot; the hash tells equally good ones apart.
    size = F.sum("n").over(Window.partitionBy("node"))
    rank = (F.shiftleft(size, 20) + F.pmod(F.xxhash64("node"), F.lit(1 << 20))).alias("rank")
    buckets = written(equal.join(several, "bucket").select("bucket", "node", rank), "equal-chunks")
    edges = _confirmed(written(_pivot_pairs(buckets), "pairs"), sets, percent)
    # With one error: only buckets where classes of different components meet.
    labels = components(edges)
    labelled = met.join(labels, "node", "left").select("node", "signature", F.coalesce("component", "node").alias("label"))
    keys = labelled.mapInArrow(_labelled_keys, "bucket bigint, node bigint, label bigint")
    mixed = keys.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most").select("bucket")
    live = written(keys.join(mixed, "bucket"), "mixed-buckets")
    return components(edges.unionByName(_between_components(live, sets, percent)))


def _between_components(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links between classes of different components that share a bucket.

    Classes are put into blocks of at most about 8 MB of shingles, those that meet the same large component
    together. For each pair of blocks with a bucket in common (mostly a block and itself) the classes that such a
    bucket holds are brought together and compared as wholes. So no pair of classes is ever a
    row, and a class moves once per block that it meets.
    """
    parts = live.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("label", "n").alias("main"), F.max("n").alias("n"))
    family = live.join(parts, "bucket").groupBy("node", "label").agg(F.max_by("main", "n").alias("family"))
    family = written(family.join(sets.select("node", F.octet_length("words").alias("bytes")), "node"), "families")
    sizes = family.groupBy("family").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).alias("blocks"))
    # Small families share blocks with others; large ones are cut by hash.
    alone = F.xxhash64("family", F.pmod(F.xxhash64("node"), F.col("blocks")))
    total = int((family.agg(F.sum("bytes")).first()[0] or 0) // BLOCK_BYTES) + 1
    block = F.when(F.col("blocks") > 1, alone).otherwise(F.pmod(F.xxhash64("family"), F.lit(total)))
    placed = family.join(sizes, "family").select("node", "label", block.alias("block"))
    touched = written(live.select("bucket", "node").join(placed, "node"), "placed-classes")
    others = touched.select("bucket", F.col("block").alias("other")).distinct()
    low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    met = touched.join(others, "bucket").select(low, high, "block", "node", "label").distinct()
    own = F.struct("node", "label", "signature", "words")
    # The classes of one block, or of two, so what is collected is bounded.
    sides = [F.collect_list(F.when(F.col("block") == F.col(side), own)).alias(side) for side in ("low", "high")]
    pairs = met.join(sets, "node").withColumnsRenamed({"low": "l", "high": "h"}).withColumns({"low": F.col("l"), "high": F.col("h")})
    pairs = pairs.groupBy("l", "h").agg(*sides).select(F.col("low").alias("left"), F.when(F.col("l") != F.col("h"), F.col("high")).alias("right"))
    arrow_batches(live.sparkSession, 1)
    found = written(pairs.mapInArrow(_block_links(percent), "a bigint, b bigint"), "links")
    arrow_batches(live.sparkSession)
    return found


def _pivot_pairs(buckets: DataFrame) -> DataFrame:
    """Every class of a bucket with its best ranked one, distinct over all buckets."""
    pivots = buckets.groupBy("bucket").agg(F.max_by("node", "rank").alias("other"))
    met = buckets.join(pivots, "bucket").filter("node <> other")
    return met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures are near and whose full sets overlap enough."""
    for side in "ab":
        own = sets.select(F.col("node").alias(side), F.col("signature").alias(f"s{side}"), F.col("words").alias(f"w{side}"))
        pairs = pairs.join(own, side)
    return written(pairs.mapInArrow(_near(percent), "a bigint, b bigint"), "links")


def minhash_factors() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * CHUNKS * WIDTH + 1, dtype=np.uint64))
    return (seeds[::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[1::2] >> np.uint64(32)).astype(np.uint32)


def signature(shingles: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The lowest bits of each minimum; sets of any size are taken in pieces of bounded memory."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(CHUNKS * WIDTH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 4096):
        best = np.minimum(best, (short[None, at : at + 4096] * factors[0][:, None] + factors[1][:, None]).min(1))
    # The lowest bits of a minimum are even only after mixing.
    return (mix(best.astype(np.uint64)) >> np.uint64(64 - BITS)).astype(np.uint8)


def set_hash(shingles: np.ndarray) -> int:
    """One number for a sorted set."""
    return int(mix(np.array([np.bitwise_xor.reduce(mix(shingles + np.uint64(1))), shingles.sum(dtype=np.uint64)], np.uint64))[0] ^ mix(shingles.sum(dtype=np.uint64, keepdims=True) + np.uint64(len(shingles)))[0])


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, factors = Words(), minhash_factors()
        for batch in batches:
            sizes, nodes, signatures = [], [], []
            for hashes in hasher.of_many(text_bytes(batch, "text")):
                shingles = np.unique(grams(hashes, words))
                sizes.append(len(shingles))
                nodes.append(set_hash(shingles) if len(shingles) else None)
                signatures.append(signature(shingles, factors).tobytes() if len(shingles) else None)
            node = pa.array([None if n is None else n - (1 << 64) * (n >> 63) for n in nodes], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), node, pa.array(signatures, pa.binary())],
                names=["id", "text_hash", "n_shingles", "node", "signature"],
            )

    return run


def _chunk_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key for each chunk and component left out: those of two signatures agree where the chunks differ in no other component."""
    for batch in batches:
        _, keys = _keys(batch)
        node = np.repeat(batch.column("node").to_numpy(), CHUNKS * WIDTH)
        yield pa.RecordBatch.from_arrays([pa.array(signed(keys.reshape(-1))), pa.array(node)], names=["bucket", "node"])


def _whole_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells, _ = _keys(batch)
        node = np.repeat(batch.column("node").to_numpy(), CHUNKS)
        yield pa.RecordBatch.from_arrays([pa.array(signed(cells.reshape(-1))), pa.array(node)], names=["bucket", "node"])


def _labelled_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, keys = _keys(batch)
        node, label = (np.repeat(batch.column(c).to_numpy(), CHUNKS * WIDTH) for c in ("node", "label"))
        yield pa.RecordBatch.from_arrays([pa.array(signed(keys.reshape(-1))), pa.array(node), pa.array(label)], names=["bucket", "node", "label"])


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of whole chunks (rows x chunks) and of chunks without each component (rows x chunks x width)."""
    place = mix(np.arange(1, WIDTH + 1, dtype=np.uint64)) | np.uint64(1)
    salt = mix(np.arange(1000, 1000 + CHUNKS * WIDTH, dtype=np.uint64)).reshape(1, CHUNKS, WIDTH)
    parts = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(-1, CHUNKS, WIDTH)
    terms = mix((parts.astype(np.uint64) + np.uint64(1)) * place)
    whole = terms.sum(2, keepdims=True, dtype=np.uint64)
    return mix(whole[:, :, 0] + salt[:, :, 0] * np.uint64(3)), mix(whole - terms + salt)


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Words()
        for batch in batches:
            wanted, nodes, sets, places = batch.column("node").to_pylist(), [], [], []
            for place, (node, hashes) in enumerate(zip(wanted, hasher.of_many(text_bytes(batch, "text")))):
                shingles = np.unique(grams(hashes, words))
                # A row that has only its id in common with the class is another text.
                if len(shingles) and (set_hash(shingles) - node) % (1 << 64) == 0:
                    nodes.append(node)
                    sets.append(shingles.astype(BINARY64).tobytes())
                    places.append(place)
            signatures = batch.column("signature").take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), signatures, pa.array(sets, pa.binary())], names=["node", "signature", "words"])

    return run


def _near(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            good = (a != b).sum(1) <= FAR
            for i in np.flatnonzero(good):
                a, b = (np.frombuffer(batch.column(c)[int(i)].as_buffer(), BINARY64) for c in ("wa", "wb"))
                both = np.sort(np.concatenate((a, b)))
                common = int((both[1:] == both[:-1]).sum())
                good[i] = 100 * common >= percent * (len(a) + len(b) - common)
            keep, names = pa.array(good), ["a", "b"]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in names], names=names)

    return run


def _block_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left = _unpacked(batch.column("left")[i].values)
                other = batch.column("right")[i].values
                a, b = linked_between(left, left if other is None else _unpacked(other), percent)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _unpacked(classes: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    node, label = (classes.field(c).to_numpy() for c in ("node", "label"))
    signatures = np.frombuffer(b"".join(classes.field("signature").to_pylist()), np.uint8).reshape(len(node), -1)
    return node, label, signatures, [np.frombuffer(w.as_buffer(), BINARY64) for w in classes.field("words")]


def linked_between(left: tuple, right: tuple, percent: int, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of both blocks that belong to different components and have near signatures and similar sets."""
    found = [_linked_part(tuple(x[at : at + rows] for x in left), right, percent) for at in range(0, len(left[0]), rows)]
    return tuple(np.concatenate([f[k] for f in found]) for k in (0, 1))


def _linked_part(left: tuple, right: tuple, percent: int) -> tuple[np.ndarray, np.ndarray]:
    differ = np.zeros((len(left[0]), len(right[0])), np.int16)
    for k in range(left[2].shape[1]):
        differ += left[2][:, k, None] != right[2][None, :, k]
    asked = (differ <= FAR) & (left[1][:, None] != right[1][None, :])
    rows, columns = np.flatnonzero(asked.any(1)), np.flatnonzero(asked.any(0))
    if not len(rows):
        return left[0][:0], right[0][:0]
    x, y = [left[3][i] for i in rows], [right[3][j] for j in columns]
    wx, wy = np.concatenate(x), np.concatenate(y)
    ox, oy = (np.repeat(np.arange(len(z)), [len(w) for w in z]) for z in (x, y))
    shared = np.intersect1d(wx, wy)  # other shingles are in no intersection
    common = np.zeros((len(x), len(y)), np.float32)
    at_x, at_y = np.searchsorted(shared, wx), np.searchsorted(shared, wy)
    in_x, in_y = at_x < len(shared), at_y < len(shared)
    in_x[in_x] = shared[at_x[in_x]] == wx[in_x]
    in_y[in_y] = shared[at_y[in_y]] == wy[in_y]
    for low in range(0, len(shared), COLUMNS):
        both = []
        for n, at, inside, owner in ((len(x), at_x, in_x, ox), (len(y), at_y, in_y, oy)):
            here = inside & (at >= low) & (at < low + COLUMNS)
            table = np.zeros((n, COLUMNS), np.float32)
            table[owner[here], at[here] - low] = 1
            both.append(table)
        common += both[0] @ both[1].T
    sizes = np.array([len(w) for w in x])[:, None] + np.array([len(w) for w in y])[None]
    good = asked[np.ix_(rows, columns)] & (100 * common >= percent * (sizes - common))
    i, j = np.nonzero(good)
    return left[0][rows[i]], right[0][columns[j]]
