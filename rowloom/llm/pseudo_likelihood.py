"""Document scores by masked pseudo-likelihood under a bidirectional window network."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import Words, arrow_batches, mix, running, text_bytes, written

SIDE = 2  # words on each side
EMBEDDING, HIDDEN = 8, 8  # equal, so that rows of all tables are alike
LEAST_ROWS, ROW_FACTOR = 4096, 8  # rows of the tables at least, and times the root of the vocabulary
TOP = 8  # levels of the tree whose nodes have weights to themselves
TOP_NODES = (1 << TOP) - 1
DENSE = 5  # levels of few nodes, which are worked out for all words by products of matrices
DENSE_NODES = (1 << DENSE) - 1
BATCH, RATE = 512, 0.3
BLOCK_WORDS = 1 << 17  # words whose ways through the tree are worked out together
CACHED_ROWS = 2048  # words that are scored at once
STEEP = 60.0  # where the logistic function is a line, and its exponential far from overflowing
FAN_IN = 16
NEAR = np.array([j for j in range(-SIDE, SIDE + 1) if j])  # where the words around a word are
PAD = 0  # the embedding that stands for "outside of the text"
TOKEN = np.dtype("<u4")
NODE = np.dtype([("slot", np.int64), ("base", np.float32), ("sign", np.float32)])
CHUNK_WORDS = 1 << 22  # words of texts that are numbered together before all words are


def pack_tokens(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id, tokens``: the words of every document as ranks by falling count over all documents, four bytes each."""
    return ranked_tokens(docs, id_column, text_column)[0]


def ranked_tokens(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """The packed tokens, and ``n, words``: how many words occur n times.

    Words are known by 64 bits of hash. Texts go to chunks that number their own words; the chunks' words are counted,
    ranked and joined in tables with one row per word and chunk, and a chunk's ranks meet its texts.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    pieces = written(rows.mapInArrow(_pieces, f"chunk bigint, ids array<{kind}>, sizes binary, tokens binary, words binary, counts binary"), "pieces")
    words = pieces.select("chunk", "words", "counts").mapInArrow(_words, "word bigint, chunk bigint, local bigint, n bigint")
    counted = words.groupBy("word").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1).cast("bigint"))
    ranks = running(counted, [F.col("n").desc(), F.col("word")], ["one"], "ranks").select("word", "n", F.col("one_before").alias("rank"))
    placed = words.select("word", "chunk", "local").join(ranks.select("word", "rank"), "word").select("chunk", "local", "rank")
    texts = pieces.select("chunk", "ids", "sizes", "tokens")
    tokens = texts.groupBy("chunk").cogroup(placed.groupBy("chunk")).applyInArrow(_with_ranks, f"id {kind}, tokens binary")
    return written(tokens, "tokens"), ranks.groupBy("n").agg(F.count("*").alias("words"))


def _packed(values: np.ndarray) -> bytes:
    """Numbers byte by byte: all lowest bytes first, so that the empty ones at the end shrink to nothing."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 1)


def _unpacked(data: bytes, kind: np.dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, part, chunk = Words(), TaskContext.get().partitionId(), 0
    ids, texts, size = [], [], 0

    def numbered(kind: pa.DataType) -> pa.RecordBatch:
        words, local, n = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
        sizes = np.array([len(t) for t in texts], np.int64)
        columns = [pa.array([(part << 32) + chunk]), pa.array([ids], pa.list_(kind))]
        columns += [pa.array([x], pa.binary()) for x in (_packed(sizes), _packed(local.astype(TOKEN)), words.tobytes(), _packed(n.astype(np.int64)))]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "sizes", "tokens", "words", "counts"])

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field("id").type
        for name, own in zip(batch.column("id").to_pylist(), hasher.of_many(text_bytes(batch, "text"))):
            ids.append(name)
            texts.append(own)
            size += len(own) + 1
            if size >= CHUNK_WORDS:
                yield numbered(kind)
                ids, texts, size, chunk = [], [], 0, chunk + 1
    if ids:
        yield numbered(kind)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, words, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "words", "counts"))):
            words = np.frombuffer(words, np.int64)
            columns = [words, np.full(len(words), chunk), np.arange(len(words)), _unpacked(counts, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["word", "chunk", "local", "n"])


def _with_ranks(texts: pa.Table, placed: pa.Table) -> pa.Table:
    local, rank = placed.column("local").to_numpy(), placed.column("rank").to_numpy()
    if len(rank) and rank.max() > np.iinfo(TOKEN).max:
        raise ValueError("more than 2^32 different words")
    ranks = np.empty(len(rank), TOKEN)
    ranks[local] = rank
    ids, packed = texts.column("ids").combine_chunks().flatten(), []
    for sizes, tokens in zip(texts.column("sizes").to_pylist(), texts.column("tokens").to_pylist()):
        cuts = np.cumsum(_unpacked(sizes, np.int64))[:-1]
        packed += [t.tobytes() for t in np.split(ranks[_unpacked(tokens, TOKEN)], cuts)]
    return pa.table({"id": ids, "tokens": pa.array(packed, pa.binary())})


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.frombuffer(t, TOKEN) for t in batch.column("tokens").to_pylist()]
        some, n = np.unique(np.concatenate([np.zeros(0, TOKEN), *found]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(n.astype(np.int64))], names=["rank", "n"])


class Tree:
    """A binary tree over all words by falling count; every word is a leaf of its own.

    A node is a range of ranks and is cut where its halves have most nearly equal counts. It is kept as the spectrum (``words`` words occur
    ``n`` times each, by falling n) and worked out along the way to a word, so its size does not depend on the vocabulary.
    A node's base value, the logarithm of the ratio of the counts on both sides, makes the tree say a word's exact
    share of all counts where nothing is learned.
    """

    def __init__(self, n: np.ndarray, words: np.ndarray) -> None:
        self.n, self.size, self.total = n, int(words.sum()), int((words * n).sum())
        self.first, self.mass = np.cumsum(words) - words, np.cumsum(words * n) - words * n

    def before(self, ranks: np.ndarray) -> np.ndarray:
        """The counts of all words before a rank."""
        step = np.searchsorted(self.first, ranks, "right") - 1
        return self.mass[step] + (ranks - self.first[step]) * self.n[step]

    def paths(self, ranks: np.ndarray, rows: int) -> Paths | Ways:
        """The nodes on the way to each word: the first ``DENSE`` levels side by side, deeper ones in a row after each other.

        Each node of the ``TOP`` levels has a row of weights to itself; deeper ones share the others by a hash of where they cut.
        Words go down together: a node is cut once for all words below it, which follow each other in order of their ranks.
        """
        if len(ranks) > 1 and (ranks[1:] <= ranks[:-1]).any():
            kinds, which = np.unique(ranks, return_inverse=True)
            return self.paths(kinds, rows).of(which)
        count = len(ranks)
        top = np.zeros((count, DENSE), NODE)
        top["slot"] = DENSE_NODES
        # The nodes of a level: their ranks, the counts before their ends, the words below them, their number in the tree.
        some = int(count > 0 and self.size > 1)
        a, b, start, end, first, last, heap = (np.full(some, x, np.int64) for x in (0, self.size, 0, self.total, 0, count, 1))
        depth, deep, counts = 0, [], np.zeros(count, np.int64)
        while len(a):
            half = (start + end) >> 1
            step = np.searchsorted(self.mass, half, "right") - 1
            each = self.n[step]
            whole = (half - self.mass[step]) // each
            cut, middle = self.first[step] + whole, self.mass[step] + whole * each
            # Of this rank and the next the nearer one, but no cut at an end of the node.
            nearer = (middle + each - half < half - middle) & (cut + 1 < b)
            cut += nearer
            middle += nearer * each
            outside = np.flatnonzero((cut <= a) | (cut >= b))
            cut[outside] = np.clip(cut[outside], a[outside] + 1, b[outside] - 1)
            middle[outside] = self.before(cut[outside])
            base = np.log((end - middle) / (middle - start)).astype(np.float32)
            width, turn = last - first, first + (ranks[first] < cut)
            several = np.flatnonzero(width > 1)
            turn[several] = np.searchsorted(ranks, cut[several])
            whose = np.repeat(first - (np.cumsum(width) - width), width) + np.arange(width.sum())
            sign = np.where(whose >= np.repeat(turn, width), np.float32(1), np.float32(-1))
            slots = heap - 1
            if depth >= TOP:
                slots = TOP_NODES + (mix(cut.astype(np.uint64)) % np.uint64(rows - TOP_NODES)).astype(np.int64)
            if depth < DENSE:
                nodes, at = top[:, depth], whose
            else:
                nodes, at = np.empty(len(whose), NODE), slice(None)
                deep.append((whose, nodes))
                counts[whose] = len(deep)
            nodes["slot"][at], nodes["base"][at], nodes["sign"][at] = np.repeat(slots, width), np.repeat(base, width), sign
            halves = ((a, cut), (cut, b), (start, middle), (middle, end), (first, turn), (turn, last), (2 * heap, 2 * heap + 1))
            nodes = [np.stack(x, axis=1).reshape(-1) for x in halves]
            live = np.flatnonzero((nodes[5] > nodes[4]) & (nodes[1] - nodes[0] > 1))
            a, b, start, end, first, last, heap = (x[live] for x in nodes)
            depth += 1
        found = Paths(top, np.empty(counts.sum(), NODE), counts)
        for level, (whose, nodes) in enumerate(deep):
            found.deep.view(np.complex128)[found.starts[whose] + level] = nodes.view(np.complex128)
        return found


class Paths:
    """Ways through the tree: ``top`` has the nodes by word and level, ``deep`` the others in a row, ``counts`` of them for each word."""

    def __init__(self, top: np.ndarray, deep: np.ndarray, counts: np.ndarray) -> None:
        self.top, self.deep, self.counts, self.starts = top, deep, counts, np.cumsum(counts) - counts
        self.falling = -counts.astype(np.int16)  # numpy sorts short numbers fastest

    def of(self, words: np.ndarray) -> Ways:
        """The ways of some of the words."""
        order = np.argsort(self.falling[words], kind="stable")
        words = words[order]
        counts = self.counts[words]
        # So many words, the first ones, have a deep node on a level.
        active = len(words) - np.cumsum(np.bincount(counts))[:-1]
        total = np.cumsum(active)
        whose = np.arange(total[-1] if len(total) else 0) - np.repeat(total - active, active)
        at = np.take(self.starts[words], whose) + np.repeat(np.arange(len(active)), active)
        return Ways(np.take(self.top, words, axis=0), np.take(self.deep, at), whose, active.tolist(), order)

    def all(self) -> Ways:
        return self.of(np.arange(len(self.counts)))


class Ways:
    """Ways of words in ``order``, those with most deep nodes first: ``deep`` is level by level, of the ``active`` first words each, ``whose`` says which."""

    def __init__(self, top: np.ndarray, deep: np.ndarray, whose: np.ndarray, active: list[int], order: np.ndarray) -> None:
        self.top, self.deep, self.whose, self.active, self.order = top, deep, whose, active, order

    def all(self) -> Ways:
        return self

    def add(self, total: np.ndarray, values: np.ndarray) -> None:
        """Add the rows of deep nodes to those of their words."""
        at = 0
        for n in self.active:
            total[:n] += values[at : at + n]
            at += n


def table_rows(vocabulary: int) -> int:
    """Rows of the tables of embeddings and of nodes: they grow with the root of the vocabulary."""
    return max(LEAST_ROWS, int(ROW_FACTOR * vocabulary**0.5))


class Inputs:
    """The embedding of each word: three in four rows belong to one common word each, the others share the rest."""

    def __init__(self, rows: int) -> None:
        self.own, self.shared = rows - rows // 4, rows // 4

    def __getitem__(self, ranks):
        ranks = np.asarray(ranks, np.uint64)
        spread = self.own + (mix(ranks + np.uint64(1)) % np.uint64(self.shared)).astype(np.int32)
        return np.where(ranks < self.own, ranks.astype(np.int32), spread) + np.int32(1)


def initial(rows: int = 0, seed: int = 5) -> dict[str, np.ndarray]:
    rows, rng = rows or LEAST_ROWS, np.random.default_rng(seed)
    return {
        "e": rng.normal(0, 0.3, (rows + 1, EMBEDDING)).astype(np.float32),
        "w": rng.normal(0, (1 / (2 * SIDE * EMBEDDING)) ** 0.5, (2 * SIDE * EMBEDDING, HIDDEN)).astype(np.float32),
        "b": np.zeros(HIDDEN, np.float32),
        "u": np.zeros((rows, HIDDEN), np.float32),
    }


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.reshape(-1) for v in p.values()])


def unflat(values: np.ndarray) -> dict[str, np.ndarray]:
    fixed = EMBEDDING + (2 * SIDE * EMBEDDING + 1) * HIDDEN
    out, at = {}, 0
    for k, v in initial((len(values) - fixed) // (EMBEDDING + HIDDEN)).items():
        out[k] = values[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


class Block:
    """Many short texts, or a part of a long one: its words are ``kinds[which]``, of the texts ``owner``, at the places ``at`` of a row of inputs."""

    def __init__(self, ids: list, parts: list, to_input: Inputs) -> None:
        sizes = np.array([len(part) for _, part, _ in parts])
        self.ids, self.owner = ids, np.repeat(np.arange(len(parts)), sizes)
        kinds, self.which = np.unique(np.concatenate([part for _, part, _ in parts]), return_inverse=True)
        self.kinds = kinds.astype(np.int64)
        # All parts in a row, each with room for its neighbours on both sides.
        self.at = np.arange(len(self.which)) + SIDE * (2 * self.owner + 1)
        self.row = np.full(len(self.which) + 2 * SIDE * len(parts), PAD, np.int32)
        self.row[self.at] = to_input[kinds][self.which]
        for start, (before, part, after) in zip((np.cumsum(sizes + 2 * SIDE) - sizes - SIDE).tolist(), parts):
            if len(before) or len(after):
                self.row[start - len(before) : start] = to_input[before]
                self.row[start + len(part) : start + len(part) + len(after)] = to_input[after]

    def batches(self, size: int) -> Iterator[tuple[slice, tuple[np.ndarray, np.ndarray], np.ndarray]]:
        """So many words at a time: which of the block, inputs and places, kinds."""
        for start in range(0, len(self.which), size):
            some = slice(start, start + size)
            at = self.at[some]
            low = at[0] - SIDE
            yield some, (self.row[low : at[-1] + SIDE + 1], at - low), self.which[some]


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[Block]:
    to_input, ids, parts, size = Inputs(rows), [], [], 0
    for batch in batches:
        for name, packed in zip(batch.column("id").to_pylist(), batch.column("tokens").to_pylist()):
            own = np.frombuffer(packed, TOKEN)
            for at in range(0, max(1, len(own)), BLOCK_WORDS):
                end = min(len(own), at + BLOCK_WORDS)
                ids.append((name, at == 0))
                parts.append((own[max(0, at - SIDE) : at], own[at:end], own[end : end + SIDE]))
                size += end - at
                if size >= BLOCK_WORDS:
                    yield Block(ids, parts, to_input)
                    ids, parts, size = [], [], 0
    if ids:
        yield Block(ids, parts, to_input)


def in_a_row(around: np.ndarray | tuple) -> tuple[np.ndarray, np.ndarray]:
    """Inputs in a row and the places of the words in it. The words around each word may be given instead: each has a stretch of its own then."""
    if isinstance(around, tuple):
        return around
    row = np.full((len(around), 2 * SIDE + 1), PAD, np.int32)
    row[:, SIDE + NEAR] = around
    return row.reshape(-1), np.arange(len(around)) * (2 * SIDE + 1) + SIDE


def hidden(p: dict[str, np.ndarray], row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The embeddings around each word, left to right, and the hidden layer; the word itself is masked."""
    inputs = np.take(np.take(p["e"], row, axis=0), at[:, None] + NEAR, axis=0).reshape(len(at), -1)
    h = inputs @ p["w"]
    h += p["b"]
    return inputs, np.tanh(h, out=h)


def node_values(p: dict[str, np.ndarray], h: np.ndarray, ways: Ways) -> tuple[np.ndarray, np.ndarray, tuple]:
    """How strongly each node of the ways speaks for the side that is taken: top nodes and deep nodes; places of the top ones, weights and words of the deep ones."""
    places = np.arange(0, len(h) << DENSE, 1 << DENSE)[:, None] + ways.top["slot"]
    top = np.take(h @ p["u"][: 1 << DENSE].T, places)
    top += ways.top["base"]
    top *= ways.top["sign"]
    weights, own = np.take(p["u"], ways.deep["slot"], axis=0), np.take(h, ways.whose, axis=0)
    deep = (own * weights) @ np.ones(HIDDEN, h.dtype)
    deep += ways.deep["base"]
    deep *= ways.deep["sign"]
    return top, deep, (places, weights, own)


def surprise(x: np.ndarray) -> np.ndarray:
    """Minus the logarithm of the logistic function."""
    found = np.log(1 + np.exp(np.minimum(-x, STEEP)))
    return found if x.min(initial=0) > -STEEP else found + np.maximum(-x - STEEP, 0)


def log_chance(p: dict[str, np.ndarray], around: np.ndarray | tuple, paths: Paths | Ways) -> np.ndarray:
    """The logarithm of the probability of each word: of the sides taken at all nodes on its way."""
    (row, at), ways = in_a_row(around), paths.all()
    top, deep, _ = node_values(p, hidden(p, row, at[ways.order])[1], ways)
    total = (surprise(top) * np.abs(ways.top["sign"])).sum(1, dtype=np.float64)
    ways.add(total, surprise(deep))
    found = np.empty(len(total))
    found[ways.order] = -total
    return found


def _rows(table: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Each row of numbers as one value, which numpy sets faster."""
    return table.view(kind)[:, 0]


class Learner:
    """Adagrad over the words of one task."""

    def __init__(self, p: dict[str, np.ndarray]) -> None:
        self.p = {k: v.copy() for k, v in p.items()}
        self.square = {k: np.full_like(v, 1e-4) for k, v in p.items()}
        self.place = np.zeros(max(len(v) for v in p.values()), np.int64)
        self.row = np.dtype((np.void, EMBEDDING * p["e"].itemsize))

    def step(self, around: np.ndarray | tuple, paths: Paths | Ways) -> None:
        row, at = in_a_row(around)
        p, size, ways = self.p, len(at), paths.all()
        at, scale = at[ways.order], np.float32(1 / size)
        inputs, h = hidden(p, row, at)
        top, deep, (places, weights, own) = node_values(p, h, ways)
        # By word and node. Levels that a short way does not have are one more node, with sign 0.
        wrong = np.zeros((size, 1 << DENSE), h.dtype)
        wrong.reshape(-1)[places] = -ways.top["sign"] / (1 + np.exp(np.minimum(top, STEEP))) * scale
        back = wrong @ p["u"][: 1 << DENSE]
        self._move("u", slice(0, DENSE_NODES), (wrong.T @ h)[:DENSE_NODES])
        wrong = -ways.deep["sign"] / (1 + np.exp(np.minimum(deep, STEEP))) * scale
        wrong = np.repeat(wrong, HIDDEN).reshape(-1, HIDDEN)
        weights *= wrong
        ways.add(back, weights)
        own *= wrong
        self._move_rows("u", np.ascontiguousarray(ways.deep["slot"]), own)
        back *= 1 - h * h
        # What comes back to each place of the row, from the words around it.
        placed = np.zeros((len(row) + 2 * SIDE, HIDDEN), h.dtype)
        _rows(placed, self.row)[at + SIDE] = _rows(back, self.row)
        near = np.concatenate([placed[SIDE - j : len(placed) - SIDE - j] for j in NEAR], axis=1)
        to_inputs = near @ p["w"].reshape(len(NEAR), EMBEDDING, HIDDEN).swapaxes(1, 2).reshape(-1, EMBEDDING)
        self._move("w", slice(None), inputs.T @ back)
        self._move("b", slice(None), np.ones(size, h.dtype) @ back)
        self._move_rows("e", row, to_inputs)

    def _move_rows(self, name: str, rows: np.ndarray, gradients: np.ndarray) -> None:
        """Only the rows that occur move: their gradients are added up, two numbers at a time as a complex one."""
        if not len(rows):
            return
        each = np.arange(len(rows))
        self.place[rows] = each
        some = np.take(rows, np.flatnonzero(np.take(self.place, rows) == each))
        self.place[some] = each[: len(some)]
        where, total = np.take(self.place, rows), np.zeros((len(some), gradients.shape[1]), gradients.dtype)
        pair = np.result_type(gradients, np.complex64)
        for column, values in zip(total.view(pair).T, gradients.view(pair).T):
            np.add.at(column, where, values)
        self._move(name, some, total)

    def _move(self, name: str, rows, gradient: np.ndarray) -> None:
        values, squares = self.p[name], self.square[name]
        if isinstance(rows, slice):
            square, value = squares[rows], values[rows]
            square += gradient * gradient
            value -= gradient * np.float32(RATE) / np.sqrt(square)
            return
        square = np.take(squares, rows, axis=0)
        square += gradient * gradient
        _rows(squares, self.row)[rows] = _rows(square, self.row)
        gradient *= np.float32(RATE)
        gradient /= np.sqrt(square, out=square)
        _rows(values, self.row)[rows] = _rows(np.take(values, rows, axis=0) - gradient, self.row)


def _train(start: np.ndarray, tree: Tree):
    """One row per task: its weights, and how many words it has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, words = Learner(unflat(start)), 0
        rows = len(learner.p["u"])
        for block in blocks(batches, rows):
            paths = tree.paths(block.kinds, rows)
            for _, around, which in block.batches(BATCH):
                learner.step(around, paths.of(which))
            words += len(block.which)
        columns = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([words], pa.int64()), pa.array([flat(learner.p).tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["task", "words", "weights"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights of several tasks as one row: each weighs as many words as its task has read."""
    total, words = None, 0
    for batch in batches:
        for n, weights in zip(batch.column("words").to_pylist(), batch.column("weights").to_pylist()):
            found = np.frombuffer(weights, np.float32).astype(np.float64) * n
            total, words = found if total is None else total + found, words + n
    if words:
        yield pa.RecordBatch.from_arrays([pa.array([words], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["words", "weights"])


def train(tokens: DataFrame, rounds: int = 1, spectrum: DataFrame | None = None) -> dict[str, np.ndarray | Tree]:
    """Weights and the tree of words, learned from every word of every document.

    Each task runs over its own documents from the same start, and the tasks' weights are averaged by the
    words they have read: a row per task, added up in ``FAN_IN`` tasks before the driver. It also gets the
    ``spectrum`` (how many words occur n times), which has fewer rows than twice the root of all words.
    """
    if spectrum is None:
        each = tokens.select("tokens").mapInArrow(_counts, "rank bigint, n bigint").groupBy("rank").agg(F.sum("n").alias("n"))
        spectrum = each.groupBy("n").agg(F.count("*").alias("words"))
    found = spectrum.orderBy(F.col("n").desc()).toArrow()
    tree = Tree(found.column("n").to_numpy(), found.column("words").to_numpy())
    values = flat(initial(table_rows(tree.size)))
    for _ in range(rounds):
        learned = tokens.mapInArrow(_train(values, tree), "task int, words bigint, weights binary")
        added = learned.repartition(FAN_IN, "task").select("words", "weights").mapInArrow(_add, "words bigint, weights binary").collect()
        if added:
            total = sum(np.frombuffer(row["weights"], np.float64) for row in added)
            values = (total / sum(row["words"] for row in added)).astype(np.float32)
    return {"values": values, "tree": tree}


def _score(model: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = unflat(model["values"])
        rows = len(p["u"])

        def give(names: list, sizes: list, totals: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(totals, pa.float64())], names=["id", "n_tokens", "log_prob"])

        # A text that is split over blocks is given out once its last part has been added.
        open_name, open_total, open_n, live = None, 0.0, 0, False
        for block in blocks(batches, rows):
            paths, value = model["tree"].paths(block.kinds, rows), np.zeros(len(block.which))
            for some, around, which in block.batches(CACHED_ROWS):
                value[some] = log_chance(p, around, paths.of(which))
            total = np.bincount(block.owner, value, len(block.ids))
            size = np.bincount(block.owner, minlength=len(block.ids))
            names, totals, sizes = [], [], []
            for (name, first), t, n in zip(block.ids, total.tolist(), size.tolist()):
                if first:
                    if live:
                        names.append(open_name)
                        totals.append(open_total)
                        sizes.append(open_n)
                    open_name, open_total, open_n, live = name, t, n, True
                else:
                    open_total, open_n = open_total + t, open_n + n
            yield give(names, sizes, totals)
        if live:
            yield give([open_name], [open_n], [open_total])

    return run


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rounds: int = 1) -> DataFrame:
    """One row per document: id, ``n_tokens``, ``log_prob`` and ``mean_log_prob``.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, each counted by itself. Each is predicted from two
    words on either side, itself left out, by embeddings, a tanh layer and a binary tree over all words (see ``Tree``), at each node of which the hidden
    layer moves the odds from those of the counts. ``log_prob`` is the sum of the logarithms over all words, the
    pseudo-log-likelihood. Counts and weights come from all documents (see ``train``).

    A null or empty text has no tokens: the sum is 0 and the mean null. Long texts are scored in parts that see
    each other's words. Ids are integers and may be null or repeat; rows are not merged.
    """
    arrow_batches(docs.sparkSession)
    tokens, spectrum = ranked_tokens(docs.withColumn(id_column, F.col(id_column).cast("bigint")), id_column, text_column)
    model = train(tokens, rounds, spectrum)
    found = tokens.mapInArrow(_score(model), "id bigint, n_tokens bigint, log_prob double")
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return found.select(F.col("id").alias(id_column), "n_tokens", "log_prob", mean.alias("mean_log_prob"))
